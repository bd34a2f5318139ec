"""Small value expressions: null handling, maps, glyphs, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import _col


def money(c: Column | str, scale: int = 6) -> Column:
    """Exact decimal form of a cost, so that sums do not depend on the order of adding."""
    return F.coalesce(_col(c).cast(f"decimal(28,{scale})"), F.lit(0).cast(f"decimal(28,{scale})"))


def or_default(c: Column | str, default) -> Column:
    """Zero, empty and NULL all count as unset."""
    c = _col(c)
    return F.when(c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "0") & (c.cast("string") != "0.0"), c).otherwise(
        F.lit(default) if not isinstance(default, Column) else default
    )


def call_failed(is_error: Column | str, return_code: Column | str) -> Column:
    return F.coalesce(_col(is_error), F.lit(False)) | F.coalesce(_col(return_code) != 0, F.lit(False))


def merge_maps(old: Column | str, new: Column | str) -> Column:
    """New entries overwrite, keys only the old map has survive."""
    old, new = _col(old), _col(new)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def verified_glyph(flags: Column | str) -> Column:
    """Box glyph for the number of true flags among review, implementation and test."""
    done = F.size(F.filter(_col(flags), lambda x: x))
    return F.element_at(F.array(*[F.lit(g) for g in K.VERIFIED_GLYPHS]), done + 1)


def progress_status(glyph: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.PROGRESS_GLYPHS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _col(glyph)), F.lit("unknown"))


def bump_version(version: Column | str, part: Column | str) -> Column:
    """``MAJOR`` / ``MINOR`` / ``PATCH`` increment of a dotted version."""
    numbers = F.transform(F.split(_col(version), r"\."), lambda x: x.cast("int"))
    major, minor, patch = (F.get(numbers, F.lit(i)) for i in range(3))
    part = _col(part)
    return (
        F.when(part == "MAJOR", F.concat_ws(".", major + 1, F.lit(0), F.lit(0)))
        .when(part == "MINOR", F.concat_ws(".", major, minor + 1, F.lit(0)))
        .when(part == "PATCH", F.concat_ws(".", major, minor, patch + 1))
        .otherwise(_col(version))
    )


def rule_of_three(trials: Column | str) -> Column:
    """Upper bound of a failure rate after ``trials`` runs without a failure."""
    return F.lit(3.0) / _col(trials)


def clip(c: Column | str, chars: int) -> Column:
    return F.substring(_col(c), 1, chars)
