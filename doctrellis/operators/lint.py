"""Lint rules for requirement documents and other artefacts.

A requirement document is read into one row per element (category, requirement, group,
sub-requirement, spec group, spec).  Parents, attributes and counts are found along the array
of a document's elements, in its row, so the whole rule set shuffles and sorts nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import markdown as M
from ..functions.text import all_matches, contains_any, let, lines_of, repeated, scanned, trim_u
from .facts import holding

_ATTRIBUTE = r"(?U)^\s*-\s+\*\*([^*：:]+)[：:]\s*\*\*\s*(.*)$"
_SPEC = r"(?U)^\s*-\s+\*\*([A-Za-z][A-Za-z0-9_.-]*)\*\*\s*[:：]\s*(.*)$"
_BOLD_LINE = r"(?U)^\s*\*\*([^*]+)\*\*\s*$"
_ID = r"^([A-Za-z][A-Za-z0-9_.-]*)"
_LEVEL_KINDS = {3: "category", 4: "UR", 5: "group", 6: "SR"}
_CHAIN = ("category", "UR", "group", "SR", "spec_group")
_DEPTHS = (*_CHAIN, "SP")
_ATTRIBUTES = {"理由": "reason", "説明": "explanation", "分割軸": "axis"}


_TYPED = "struct<line: int, kind: string, depth: int, id: string, name: string, attr: string>"
_UPWARDS = (f"struct<x: {_TYPED}, reason: string, explanation: string, axis: string, reason_below: string, explanation_below: string, axis_below: string, "
            "next4: int, next5: int, next6: int, from4: int, from5: int, from6: int>")
_DOWNWARDS = (f"struct<x: {_TYPED}, y: {_UPWARDS}, " + ", ".join(f"line{i}: int, label{i}: string" for i in range(1, 6)) + ", before4: int, upto4: int>")


def _lines_to_read(docs: DataFrame, missing_category: bool) -> DataFrame:
    """``(path, lines)`` with an array of ``(line, text)`` in the row of each document.

    On request documents without a category have a line 0 without text; only documents with
    some mark of an element are split, the others just get their line 0.
    """
    if missing_category:
        plain = lines_of("text")
        held = docs.select("path", F.when(F.contains("text", F.lit("###")) | F.contains("text", F.lit("**")), plain).otherwise(F.array().cast("array<string>")).alias("_lines"))
    else:
        held = holding(docs, "###", "**").select("path", lines_of("text").alias("_lines"))
    numbered = F.transform("_lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    if not missing_category:
        return held.select("path", numbered.alias("lines"))
    none = F.array(F.struct(F.lit(0).alias("line"), F.lit(None).cast("string").alias("text")))
    has_category = F.exists("_lines", lambda x: F.rlike(x, F.lit(r"^###\s")))
    return held.select("path", F.when(has_category, numbered).otherwise(F.concat(none, numbered)).alias("lines"))


def _typed(line: Column) -> Column:
    """What ``_TYPED`` names of a line; NULL if it is no element."""
    def noted(x: Column) -> Column:
        # The first visible character decides which patterns a line is tried against.
        head = F.substring(F.ltrim(x["text"]), 1, 1)
        return F.struct(
            x["line"].alias("line"), x["text"].alias("text"), head.alias("head"),
            F.when(F.startswith(x["text"], F.lit("###")), F.length(F.regexp_extract(x["text"], r"^(#+)\s", 1))).alias("level"),
            F.when(head == "-", F.rlike(x["text"], F.lit(_SPEC))).alias("is_spec"),
        )

    def kind(x: Column) -> Column:
        told = F.when(x["line"] == 0, "no_category").when(x["level"] > 6, "too_deep")
        for depth, name in _LEVEL_KINDS.items():
            told = told.when(x["level"] == depth, name)
        told = (
            told.when(x["is_spec"], "SP")
            .when((x["head"] == "-") & F.rlike(x["text"], F.lit(_ATTRIBUTE)), "attribute")
            .when((x["head"] == "*") & F.rlike(x["text"], F.lit(_BOLD_LINE)), "spec_group")
        )
        return F.struct(x["line"].alias("line"), x["text"].alias("text"), told.alias("kind"))

    def read(x: Column) -> Column:
        title = trim_u(F.regexp_replace(x["text"], "^#+", ""))
        depth = F.coalesce(*[F.when(x["kind"] == kind, F.lit(i + 1)) for i, kind in enumerate(_DEPTHS)], F.lit(0))
        return F.struct(
            x["line"].alias("line"), x["kind"].alias("kind"), depth.alias("depth"),
            F.when(x["kind"].isin("UR", "SR"), F.regexp_extract(title, _ID, 1))
            .when(x["kind"] == "SP", F.regexp_extract(x["text"], _SPEC, 1)).alias("id"),
            F.when(x["kind"] == "SP", trim_u(F.regexp_extract(x["text"], _SPEC, 2)))
            .when(x["kind"] == "spec_group", trim_u(F.regexp_extract(x["text"], _BOLD_LINE, 1)))
            .when(x["kind"] == "attribute", trim_u(F.regexp_extract(x["text"], _ATTRIBUTE, 2)))
            .otherwise(title).alias("name"),
            F.when(x["kind"] == "attribute", trim_u(F.regexp_extract(x["text"], _ATTRIBUTE, 1))).alias("attr"),
        )

    return let(let(noted(line), kind), lambda x: F.when(x["kind"].isNotNull(), read(x)))


def _upwards(last: Column, x: Column) -> Column:
    """From the end: the attributes of an owner, and the depth of the next element of a depth from 1 to 4, 5 or 6."""
    attribute, owner = x["kind"] == "attribute", x["kind"].isin("UR", "SR", "SP")

    def below(label: str, name: str) -> Column:
        mine = F.when(attribute & (x["attr"] == label), x["name"])
        return F.when(~owner, F.greatest(last[f"{name}_below"], mine)).alias(f"{name}_below")

    return F.struct(
        x.alias("x"), *[F.when(owner, last[f"{name}_below"]).alias(name) for name in _ATTRIBUTES.values()],
        *[below(label, name) for label, name in _ATTRIBUTES.items()],
        *[last[f"from{n}"].alias(f"next{n}") for n in (4, 5, 6)],
        *[F.when(x["depth"].between(1, n), x["depth"]).otherwise(last[f"from{n}"]).alias(f"from{n}") for n in (4, 5, 6)],
    )


def _downwards(last: Column, y: Column) -> Column:
    """From the top: the open parents, and the depth of the element of a depth from 1 to 4 before; a shallower element closes deeper ones."""
    x = y["x"]
    depth = x["depth"]

    def kept(i: int, own: Column, name: str) -> Column:
        return F.when(depth == i, own).when(~depth.between(1, i - 1), last[f"{name}{i}"]).alias(f"{name}{i}")

    parents = [kept(i, own, name) for i in range(1, 6) for own, name in ((x["line"], "line"), (F.coalesce(x["id"], x["name"]), "label"))]
    return F.struct(
        x.alias("x"), y.alias("y"), *parents, last["upto4"].alias("before4"),
        F.when(depth.between(1, 4), depth).otherwise(last["upto4"]).alias("upto4"),
    )


def _once(docs: DataFrame, rows: Column, name: str) -> DataFrame:
    """``(path, name)`` through a generator: the test for empty arrays that comes with a later one would find them a second time."""
    return docs.select(F.inline(F.array(F.struct("path", rows.alias(name)))))


def _element_arrays(docs: DataFrame, missing_category: bool) -> DataFrame:
    """``(path, rows)``: the elements of each document with all that is near them, in its row: nothing is shuffled or sorted."""
    may_matter = F.filter("lines", lambda x: F.substring(F.ltrim(x["text"]), 1, 1).isin("#", "*", "-") | (x["line"] == 0))
    typed = F.array_compact(F.transform(may_matter, _typed))
    upwards = F.reverse(scanned(F.reverse(typed), _UPWARDS, _upwards))
    downwards = scanned(F.filter(upwards, lambda y: y["x"]["kind"] != "attribute"), _DOWNWARDS, _downwards)
    return _once(_lines_to_read(docs, missing_category), downwards, "rows")


_NEAR = [
    *[f"x.{c}" for c in ("line", "kind", "id", "name")], *[f"y.{c}" for c in _ATTRIBUTES.values()],
    *[f"line{i + 1} as {kind.lower()}_line" for i, kind in enumerate(_CHAIN)],
    f"concat_ws(' / ', {', '.join(f'label{i + 1}' for i in range(len(_CHAIN)))}) as trail",
]


def elements(docs: DataFrame, missing_category: bool = False) -> DataFrame:
    """``(path, line, kind, id, name, reason, explanation, axis, category_line, ur_line,
    group_line, sr_line, spec_group_line, trail)``.

    A parent line is NULL when a shallower element closed that parent before; ``trail`` has the
    names of the open parents.  On request a document without a category has an element of
    kind ``no_category`` on line 0.
    """
    return _element_arrays(docs, missing_category).select("path", F.inline("rows")).selectExpr("path", *_NEAR)


def requirement_paths(element_rows: DataFrame) -> DataFrame:
    """``(path, line, sp_id, trail)``: each spec with the names of its open parents."""
    return element_rows.filter("kind = 'SP'").select("path", "line", F.col("id").alias("sp_id"), "trail")


def lint_requirements(docs: DataFrame) -> DataFrame:
    """``(rule, severity, path, line, subject)`` for the rules on requirement documents."""
    bodies = F.transform("rows", lambda r: F.when(r["x"]["kind"] == "SP", F.lower(F.regexp_replace(r["x"]["name"], r"(?U)\s+", " "))))
    told = F.arrays_zip(
        F.col("rows").alias("r"), repeated(F.transform("rows", lambda r: r["x"]["id"])).alias("same_id"), let(bodies, repeated).alias("same_body"),
    )
    near = _once(_element_arrays(docs, missing_category=True), told, "told").select("path", F.inline("told")).select("path", "r.*", "same_id", "same_body")
    rows = near.selectExpr("path", *_NEAR, "same_id", "same_body", "y.next4", "y.next5", "y.next6", "before4")
    kind = F.col("kind")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    group, sub, spec_group, spec = (F.lit(_DEPTHS.index(k) + 1) for k in ("group", "SR", "spec_group", "SP"))
    lone = (kind == "SR") & F.col("before4").eqNullSafe(group) & ~F.col("next4").eqNullSafe(sub)
    numbers = F.size(all_matches("id", "-([0-9]+)"))
    rules = [
        ("reason_required", "error", kind.isin("UR", "SR") & ~lone & blank("reason")),
        ("id_unique", "error", F.col("id").isNotNull() & F.col("same_id")),
        ("id_form", "error", kind.isin("UR", "SR") & ~F.rlike("id", F.lit(K.REQUIREMENT_ID))),
        ("id_namespace", "error", F.rlike("id", F.lit(K.SHORT_ID)) & ~F.rlike("id", F.lit(K.NAMESPACED_ID))),
        ("spec_group_has_spec", "error", (kind == "spec_group") & ~F.col("next6").eqNullSafe(spec)),
        ("group_has_sub_requirement", "error", (kind == "group") & ~F.col("next4").eqNullSafe(sub)),
        ("sub_requirement_has_spec_group", "error", (kind == "SR") & ~F.col("next5").eqNullSafe(spec_group)),
        ("spec_under_sub_requirement", "error", (kind == "SP") & F.col("sr_line").isNull()),
        ("group_name_form", "error", kind.isin("category", "group", "spec_group") & ~F.rlike("name", F.lit(K.GROUP_NAME))),
        ("heading_depth", "error", kind == "too_deep"),
        ("document_has_category", "error", kind == "no_category"),
        ("three_levels", "warning", (kind == "SR") & (numbers > 4)),
        ("forced_two_layers", "warning", lone & ~(blank("reason") & blank("explanation"))),
        ("ambiguous_word", "warning", (kind == "SP") & (F.size(contains_any("name", K.AMBIGUOUS_WORDS)) > 0)),
        ("negative_expression", "warning", (kind == "SP") & (F.size(contains_any("name", K.NEGATIVE_WORDS)) > 0)),
        ("duplicate_spec_text", "warning", (kind == "SP") & F.col("same_body")),
        ("division_axis", "error", F.col("axis").isNotNull() & ~F.col("axis").isin(*K.DIVISION_AXES)),
    ]
    hits = F.array_compact(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, test in rules])
    )
    return rows.select(
        "path", "line", F.coalesce("id", "name").alias("subject"), F.explode(hits).alias("h")
    ).select("h.rule", "h.severity", "path", "line", "subject")


def missing_frontmatter(docs: DataFrame, required: list[str]) -> DataFrame:
    """``(path, key)`` of required front-matter keys a document lacks."""
    lacking = F.array_except(F.array(*[F.lit(k) for k in required]), M.frontmatter_keys(lines_of("text")))
    return docs.select("path", F.explode(lacking).alias("key"))


def missing_degraded_note(docs: DataFrame, source_prefix: str = "latest-specs/", note: str = "degraded mode") -> DataFrame:
    """Documents whose tables cite fallback sources without saying so."""
    cites = F.exists(lines_of("text"), lambda x: M.is_table_row(x) & F.contains(x, F.lit(source_prefix)))
    return docs.filter(cites & ~F.contains("text", F.lit(note))).select("path")


def word_hits(docs: DataFrame, key: str, words, text: str = "text") -> DataFrame:
    """``(key, word, lines)``: number of lines of each document that contain each word."""
    hit = F.explode(F.flatten(F.transform(lines_of(text), lambda x: contains_any(x, words))))
    return docs.select(key, hit.alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("lines"))


def relation_errors(relations: DataFrame, names: DataFrame, source: str, target: str, key: str,
                    axis: str = "division_axis") -> DataFrame:
    """Relations with an end that does not resolve, or an axis outside the enumeration."""
    known = names.select(key).distinct()
    ends = relations.join(
        known.select(F.col(key).alias(source), F.lit(True).alias("_s")), source, "left"
    ).join(known.select(F.col(key).alias(target), F.lit(True).alias("_t")), target, "left")
    problem = (
        F.when(F.col("_s").isNull(), "source_missing")
        .when(F.col("_t").isNull(), "target_missing")
        .when(~F.col(axis).isin(*K.DIVISION_AXES), "bad_axis")
    )
    return ends.withColumn("problem", problem).filter("problem is not null").select(source, target, axis, "problem")
