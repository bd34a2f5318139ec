"""All registered queries."""

from . import document_plans, event_plans, graph_plans, merge_plans, relation_plans, stream_plans, text_plans  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
