"""Typed facts from documents ``(path, text)``.

Documents are split inside the row; only lines that carry a fact leave the projection, so
a later shuffle by path moves facts, not text.  Groups by path are as large as one
document, which was a single value to begin with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import markdown as M
from ..functions.text import (
    _col, all_matches, basename, extension, first_match, let, lines_of, ltrim_u, normalize_heading,
    resolve_path, stem, trim_u,
)


def md_lines(docs: DataFrame) -> DataFrame:
    """``(path, line, text)`` with 1-based line numbers."""
    return docs.select("path", F.posexplode(lines_of("text")).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).alias("line"), "text"
    )


def holding(docs: DataFrame, *marks: str) -> DataFrame:
    """Documents that contain any of the marks: a byte search that spares the others the split."""
    test = F.lit(False)
    for mark in marks:
        test = test | F.contains("text", F.lit(mark))
    return docs.filter(test)


def lint_headings(docs: DataFrame) -> DataFrame:
    """Distinct ``(path, heading)`` of level-2-or-deeper headings in compare form."""
    return docs.select("path", F.explode(M.lint_titles(lines_of("text"))).alias("heading"))


def headings(docs: DataFrame) -> DataFrame:
    """``(path, line, level, heading)`` for every heading of level 1 to 6, dates masked."""
    lines = md_lines(docs).filter(F.startswith("text", F.lit("#"))).withColumn(
        "title", trim_u(M.any_heading("text"))
    ).filter("title is not null")
    return lines.select(
        "path", "line",
        F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"),
        F.regexp_replace("title", K.ISO_DATE, "\\" + K.DATE_MASK).alias("heading"),
    )


def resolved_refs(docs: DataFrame, home_prefix: str, repo_prefix: str) -> DataFrame:
    """``(path, line, seq, heading, target)``: every apply with the file it points into.

    Backward as-of: the nearest resolvable Read on the same or an earlier line; only the
    first Read of a line counts; without one the document itself is meant.
    """
    lines = md_lines(holding(docs, "apply")).filter(
        (F.contains("text", F.lit("apply")) & F.rlike("text", F.lit(K.APPLY_REF)))
        | (F.contains("text", F.lit("Read")) & F.rlike("text", F.lit(K.READ_TARGET)))
    )
    reads = resolve_path(first_match("text", K.READ_TARGET), home_prefix, repo_prefix)
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.withColumn("target", F.last(reads, ignorenulls=True).over(so_far))
        .select("path", "line", "target", F.posexplode(all_matches("text", K.APPLY_REF)).alias("seq", "ref"))
        .select(
            "path", "line", "seq",
            normalize_heading("ref").alias("heading"),
            F.coalesce("target", "path").alias("target"),
        )
    )


def agent_definitions(docs: DataFrame) -> DataFrame:
    """``(agent, path, name, has_section, tokens)``: one row per definition file."""
    def opens_inputs(line: Column) -> Column:
        return F.rlike(line, F.lit(r"(?U)^\s*### ")) & F.contains(F.lower(line), F.lit(K.REQUIRED_SECTION))

    named = F.filter("_lines", lambda x: F.rlike(x, F.lit(K.NAME_LINE)))
    return docs.select("path", "text", lines_of("text").alias("_lines")).select(
        stem("path").alias("agent"),
        "path",
        first_match(F.get(named, F.lit(0)), K.NAME_LINE).alias("name"),
        F.exists("_lines", opens_inputs).alias("has_section"),
        M.quoted_keys("text").alias("tokens"),
    )


def agent_inputs(docs: DataFrame) -> DataFrame:
    """``(path, key, is_optional)`` declared in the input sections of a definition.

    The latest ``### `` heading decides how bullets are read; keys come only from the part
    before the first colon.
    """
    inputs = docs.filter(
        F.contains(F.lower("text"), F.lit(K.REQUIRED_SECTION)) | F.contains(F.lower("text"), F.lit(K.OPTIONAL_SECTION))
    )
    lines = md_lines(inputs).withColumn("bare", trim_u("text"))
    is_title = F.startswith("bare", F.lit("### "))
    title = F.lower("bare")
    section = (
        F.when(is_title & F.contains(title, F.lit(K.REQUIRED_SECTION)), "required")
        .when(is_title & F.contains(title, F.lit(K.OPTIONAL_SECTION)), "optional")
        .when(is_title, "none")
    )
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.split_part("text", F.lit(":"), F.lit(1))
    optional = (
        (F.col("section") == "optional")
        | F.contains(F.lower(head), F.lit(K.OPTIONAL_WORD))
        | F.contains(head, F.lit(K.ONLY_WHEN_WORD))
    )
    return (
        lines.filter(is_title | F.startswith("bare", F.lit("- ")))
        .withColumn("section", F.last(section, ignorenulls=True).over(so_far))
        .filter(F.col("section").isin("required", "optional") & F.startswith("bare", F.lit("- ")))
        .select("path", F.explode(all_matches(head, K.QUOTED_KEY)).alias("key"), optional.alias("is_optional"))
        .distinct()
    )


def agent_calls(docs: DataFrame) -> DataFrame:
    """``(path, line, agent, parsed, passed_required, passed_optional)`` per call line.

    The payload is the first code fence that opens on the call line or within the three
    lines below it.  A document is cut at its fences: the calls of a part, with those on the
    fence that ends it, ask for that fence, whose payload is the part after it.  All that
    happens in the row of the document, so nothing is shuffled or sorted.
    """
    # The first visible character tells most lines apart from fences and payload keys.
    def may_matter(text: Column) -> Column:
        head = F.substring(F.ltrim(text), 1, 1)
        return F.contains(text, F.lit("subagent_type")) | F.rlike(head, F.lit(r"(?U)[A-Z`（(\s]"))

    numbered = F.transform(lines_of("text"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), M.is_fence(t).alias("fence")))
    split = holding(docs, "subagent_type").select("path", F.filter(numbered, lambda x: x["fence"] | may_matter(x["text"])).alias("lines"))
    at = F.filter(F.transform("lines", lambda x, i: F.when(x["fence"], i + 1)), lambda i: i.isNotNull())
    cut = split.withColumn("cuts", F.concat(F.array(F.lit(0)), at, F.array(F.size("lines") + 1)))
    # From each cut the lines to the next one, that included, and those between it and the one after.
    parts = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda start, j: let(
        F.struct(F.get("cuts", j + 1).alias("fence"), F.get("cuts", j + 2).alias("end")),
        lambda c: F.struct(
            F.get("lines", c["fence"] - 1)["line"].alias("next_fence"),
            F.filter(F.slice("lines", start + 1, c["fence"] - start), lambda x: F.contains(x["text"], F.lit("subagent_type"))).alias("calls"),
            F.when(c["end"].isNotNull(), F.slice("lines", c["fence"] + 1, c["end"] - c["fence"] - 1)).alias("payload"),
        ),
    ))
    asked = cut.select("path", F.inline(F.filter(parts, lambda p: F.size(p["calls"]) > 0)))
    calls = F.filter(
        F.transform("calls", lambda x: F.struct(x["line"].alias("line"), first_match(x["text"], K.SUBAGENT).alias("agent"))),
        lambda x: x["agent"].isNotNull(),
    )

    texts = F.transform(F.coalesce("payload", F.array().cast("array<struct<line: int, text: string, fence: boolean>>")), lambda x: F.struct(
        first_match(x["text"], K.PAYLOAD_KEY).alias("required"), first_match(x["text"], K.PAYLOAD_KEY_AFTER_CONDITION).alias("optional"),
    ))
    read = asked.select("path", "next_fence", calls.alias("calls"), texts.alias("keys"))
    required = F.array_sort(F.array_distinct(F.array_compact(F.transform("keys", lambda k: k["required"]))))
    optional = F.array_sort(F.array_distinct(F.array_compact(F.transform("keys", lambda k: F.when(k["required"].isNull(), k["optional"])))))
    met = read.select("path", "next_fence", required.alias("keys"), optional.alias("extra"), F.explode("calls").alias("call"))
    nothing = F.array().cast("array<string>")
    parsed = F.coalesce(F.col("next_fence") <= F.col("call.line") + 3, F.lit(False))
    return met.select(
        "path", "call.line", "call.agent", parsed.alias("parsed"),
        F.when(parsed, F.col("keys")).otherwise(nothing).alias("passed_required"),
        F.when(parsed, F.col("extra")).otherwise(nothing).alias("passed_optional"),
    )


def script_calls(docs: DataFrame) -> DataFrame:
    """``(path, line, seq, script, subcommand, flags)`` for every script named in the text.

    Arguments run to the next back-quote on the logical line; the subcommand is the first
    bare word in front of any flag.
    """
    # The look-ahead captures the arguments without consuming them, so a later script on
    # the same line is found as well.
    with_rest = K.SCRIPT_NAME + r"(?=([^`]*))"
    logical = holding(docs, ".py").select("path", F.explode(M.logical_lines("text")).alias("l")).select(
        "path", F.col("l.line").alias("line"), F.col("l.text").alias("text")
    ).filter(F.rlike("text", F.lit(K.SCRIPT_NAME)))
    found = logical.select(
        "path", "line",
        F.posexplode(
            F.arrays_zip(
                all_matches("text", with_rest, 1).alias("script"),
                all_matches("text", with_rest, 2).alias("rest"),
            )
        ).alias("seq", "call"),
    ).select("path", "line", "seq", F.col("call.script").alias("script"), F.col("call.rest").alias("rest"))
    words = F.filter(F.split("rest", r"(?U)\s+"), lambda t: t != "")
    flag_at = F.array_position(F.transform("words", lambda t: F.rlike(t, F.lit("^" + K.FLAG))), True)
    front = F.when(flag_at > 0, F.slice("words", 1, F.greatest(flag_at - 1, F.lit(0)))).otherwise(F.col("words"))
    return found.withColumn("words", words).select(
        "path", "line", "seq", "script",
        F.get(F.filter(front, lambda t: F.rlike(t, F.lit(K.BARE_WORD))), F.lit(0)).alias("subcommand"),
        F.filter(
            F.transform("words", lambda t: F.regexp_extract(t, f"^({K.FLAG})", 1)), lambda t: t != ""
        ).alias("flags"),
    )


def is_template(path: Column | str) -> Column:
    """Direct child of a folder named exactly ``templates``."""
    return F.rlike(_col(path), F.lit(r"(^|/)templates/[^/]+\.md$"))


def placeholder_tokens(docs: DataFrame) -> DataFrame:
    """``(path, token, template)``; distinct per document."""
    return holding(docs, "{").select(
        "path", is_template("path").alias("template"), F.explode(M.placeholders("text")).alias("token")
    )


def config_pairs(docs: DataFrame) -> DataFrame:
    """``(path, line, key, value)`` of ``KEY: value`` lines, decoration and comments removed."""
    def unquote(c: Column) -> Column:
        return F.regexp_replace(c, "^`+|`+$", "")

    def trim(c: Column | str) -> Column:
        return F.regexp_replace(c, K.CONFIG_EDGES, "")

    # the first test spares the other lines the trim, the second one leaves out values of white space alone
    near = md_lines(docs).filter(F.rlike("text", F.lit(K.CONFIG_LINE)))
    lines = near.withColumn("bare", trim("text")).filter(F.rlike("bare", F.lit(K.CONFIG_LINE)))
    value = unquote(trim(F.regexp_extract("bare", K.CONFIG_LINE, 2)))
    value = unquote(trim(F.regexp_replace(value, K.CONFIG_NOTE, "")))
    return lines.select("path", "line", F.regexp_extract("bare", K.CONFIG_LINE, 1).alias("key"), value.alias("value"))


def typed_config(pairs: DataFrame, float_keys: list[str], int_keys: list[str]) -> DataFrame:
    """One row per document, last good value of each typed key; bad numbers are ignored."""
    columns = [(k, "double") for k in float_keys] + [(k, "int") for k in int_keys]
    return pairs.groupBy("path").agg(
        *[
            F.max_by(
                F.col("value").try_cast(t),
                F.when((F.col("key") == k) & F.col("value").try_cast(t).isNotNull(), F.col("line")),
            ).alias(k)
            for k, t in columns
        ]
    )


def frontmatter(docs: DataFrame) -> DataFrame:
    """``(path, key)`` of front-matter keys."""
    return docs.select("path", F.explode(M.frontmatter_keys(lines_of("text"))).alias("key"))


def tables(docs: DataFrame) -> DataFrame:
    """Markdown table rows: ``(path, table_line, line, header, cells, is_separator)``.

    Consecutive pipe lines form one table, named by the line of its header.
    """
    rows = md_lines(holding(docs, "|")).filter(F.contains("text", F.lit("|")) & M.is_table_row("text"))
    order = Window.partitionBy("path").orderBy("line")
    grouped = rows.withColumn("_block", F.col("line") - F.row_number().over(order))
    block = Window.partitionBy("path", "_block").orderBy("line")
    cells = M.table_cells("text")
    return (
        grouped.withColumn("cells", cells)
        .withColumn("table_line", F.first("line").over(block))
        .withColumn("header", F.first("cells").over(block))
        .select(
            "path", "table_line", "line", "header", "cells",
            F.forall("cells", lambda c: F.rlike(c, F.lit("^:?-+:?$"))).alias("is_separator"),
        )
    )


def table_column_errors(table_rows: DataFrame) -> DataFrame:
    """Rows whose cell count differs from their header's."""
    return table_rows.filter(F.size("cells") != F.size("header")).select(
        "path", "line", F.size("header").alias("expected"), F.size("cells").alias("found")
    )


def _mermaid_parts(docs: DataFrame, every: bool) -> DataFrame:
    """``(path, block, lines)``: the lines inside each mermaid fence, cut out in the row of the document."""
    numbered = F.transform(lines_of("text"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), M.is_fence(t).alias("fence")))
    shape = r"-->|---|-\.->|==>|\[|\(|^\s*(graph|flowchart|sequenceDiagram|erDiagram|stateDiagram|classDiagram)\b|^\s*(end|subgraph)\b"
    split = holding(docs, K.MERMAID_FENCE).select(
        "path", F.filter(numbered, lambda x: F.lit(every) | x["fence"] | F.rlike(x["text"], F.lit(shape))).alias("lines")
    )
    at = F.filter(F.transform("lines", lambda x, i: F.when(x["fence"], i + 1)), lambda i: i.isNotNull())
    parts = F.transform("fences", lambda start, j: F.struct(
        (j + 1).cast("bigint").alias("block"), trim_u(F.get("lines", start - 1)["text"]).alias("opener"),
        F.slice("lines", start + 1, F.coalesce(F.get("fences", j + 1), F.size("lines") + 1) - start - 1).alias("lines"),
    ))
    opened = F.filter(parts, lambda p: (p["block"] % 2 == 1) & F.startswith(p["opener"], F.lit("```mermaid")))
    return split.withColumn("fences", at).select("path", F.inline(opened)).drop("opener")


def mermaid_blocks(docs: DataFrame, every: bool = False) -> DataFrame:
    """``(path, block, line, text)``: the lines inside mermaid fences; unless ``every``, those that may hold something."""
    return _mermaid_parts(docs, every).select("path", "block", F.inline("lines")).drop("fence")


_QUOTED = r'"[^"]*"'
_KINDS = r"^(?:(?:graph|flowchart)(?:\s+(?:TB|TD|BT|RL|LR))?\s*;?|(?:sequence|class|er|state|requirement)Diagram(?:-v2)?|gantt|pie\b.*|journey|mindmap|timeline|gitGraph\b.*|quadrantChart)$"
_OPENS = r"^(?:subgraph|loop|alt|opt|par|critical|break|rect|box)\b|\{$"
_CLOSES = r"^(?:end|\})$"


def diagram_faults(docs: DataFrame) -> DataFrame:
    """``(path, block, line, fault)`` of mermaid blocks.

    ``kind``: the first line names no kind of diagram or no direction; ``quote``: a quote is left
    open; ``bracket``: round, square and curly brackets of a line do not nest, outside quotes;
    ``end``: an ``end`` or ``}`` closes nothing; ``open``: a ``subgraph``, a block of a sequence or
    a body in braces is never closed.  Comments (``%%``) and blank lines are skipped.

    Brackets are taken away pair by pair from the inside out; what is open across lines is
    summed over the lines of a block, forwards and backwards, all in the row of the document.
    """
    pair = r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}"

    def unpaired(quoted: Column) -> Column:
        # cardinalities and flags use bracket signs of their own
        plain = F.regexp_replace(F.regexp_replace(quoted, r"[|}o]{1,2}(?:--|\.\.)[|{o]{1,2}", ""), r"(?<=\w)>[^\[\]]*\]", "")
        plain = F.when(F.rlike(quoted, F.lit(rf"{_OPENS}|{_CLOSES}")), F.regexp_replace(plain, r"\{$|^\}$", "")).otherwise(plain)

        def nested(text: Column) -> Column:
            rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[(\[{]"))))
            return F.aggregate(rounds, text, lambda rest, _: F.regexp_replace(rest, pair, ""))

        return F.rlike(let(plain, nested), F.lit(r"[()\[\]{}]"))

    def judged(x: Column, quoted: Column) -> Column:
        step = F.when(F.rlike(quoted, F.lit(_OPENS)), 1).when(F.rlike(quoted, F.lit(_CLOSES)), -1).otherwise(0)
        return F.struct(
            x["line"].alias("line"), x["bare"].alias("bare"), F.contains(quoted, F.lit('"')).alias("quote"),
            unpaired(quoted).alias("bracket"), step.alias("step"),
        )

    def gather(state: Column, test: Column, line: Column) -> Column:
        return F.when(test, F.concat(state["at"], F.array(line))).otherwise(state["at"]).alias("at")

    def forwards(state: Column, x: Column) -> Column:
        depth = state["depth"] + x["step"]
        ends = gather(state, (x["step"] < 0) & (depth < state["lowest"]), x["line"])
        return F.struct(depth.alias("depth"), F.least(state["lowest"], depth).alias("lowest"), ends)

    def backwards(state: Column, x: Column) -> Column:
        depth = state["depth"]
        opens = gather(state, (x["step"] > 0) & (F.coalesce(state["later"], depth) >= depth), x["line"])
        return F.struct((depth - x["step"]).alias("depth"), F.least(state["later"], depth).alias("later"), opens)

    none = F.array().cast("array<int>").alias("at")
    ends = F.aggregate("read", F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"), none), forwards, lambda s: s["at"])
    opens = F.aggregate(
        F.reverse("read"), F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("later"), none), backwards, lambda s: s["at"]
    )

    def named(rows: Column, fault: str, line=lambda x: x) -> Column:
        return F.transform(rows, lambda x: F.struct(line(x).alias("line"), F.lit(fault).alias("fault")))

    bare = F.transform("lines", lambda x: F.struct(x["line"].alias("line"), F.trim(F.regexp_replace(x["text"], r"%%.*$", "")).alias("bare")))
    blocks = _mermaid_parts(docs, every=True).select("path", "block", F.filter(bare, lambda x: x["bare"] != "").alias("bare"))
    read = blocks.select("path", "block", F.transform("bare", lambda x: let(F.regexp_replace(x["bare"], _QUOTED, ""), lambda q: judged(x, q))).alias("read"))
    line = lambda x: x["line"]
    return read.select("path", "block", F.inline(F.concat(
        named(F.filter(F.slice("read", 1, 1), lambda x: ~F.rlike(x["bare"], F.lit(_KINDS))), "kind", line),
        named(F.filter("read", lambda x: x["quote"]), "quote", line),
        named(F.filter("read", lambda x: ~x["quote"] & x["bracket"]), "bracket", line),
        named(ends, "end"), named(opens, "open"),
    )))


def mermaid_edges(docs: DataFrame) -> DataFrame:
    """``(path, line, src, dst)`` of arrows, also of several on a line; node labels are dropped."""
    label = r"(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})"
    arrow = r"\s*(?:-->|---|-\.->|==>)(?:\|[^|]*\|)?\s*"
    chain = rf"^\s*[A-Za-z0-9_]+{label}?(?:{arrow}[A-Za-z0-9_]+{label}?)+"
    bare = F.regexp_replace(F.regexp_extract("text", chain, 0), label, "")  # an arrow in a label is text
    nodes = F.transform(F.split(bare, arrow, -1), lambda n: F.regexp_extract(n, r"^\s*([A-Za-z0-9_]+)", 1))
    steps = F.transform(
        F.sequence(F.lit(0), F.size("_nodes") - 2),
        lambda i: F.struct(F.get("_nodes", i).alias("src"), F.get("_nodes", i + 1).alias("dst")),
    )
    lines = mermaid_blocks(docs).withColumn("text", F.regexp_replace("text", _QUOTED, ""))
    return lines.filter(F.rlike("text", F.lit(chain))).withColumn("_nodes", nodes).select("path", "line", F.inline(steps))


def mermaid_errors(docs: DataFrame) -> DataFrame:
    """Lines of a mermaid block whose square or round brackets do not balance."""
    def count(ch: str) -> Column:
        return F.regexp_count("text", F.lit("\\" + ch))

    return mermaid_blocks(docs).filter(
        (count("[") != count("]")) | (count("(") != count(")"))
    ).select("path", "line", "text")


def is_comment_line(path: Column | str, text: Column | str) -> Column:
    """Whole-line comment in the language the file extension stands for."""
    marks = F.create_map(*[F.lit(x) for pair in K.LINE_COMMENTS.items() for x in pair])
    mark = F.try_element_at(marks, extension(path))
    return F.coalesce(F.startswith(ltrim_u(text), mark), F.lit(False))


def artifact_files(docs: DataFrame) -> DataFrame:
    """Leave out review by-products: the brief and anything below a review folder."""
    return docs.filter(
        ~F.array_contains(F.split("path", "/"), K.REVIEW_FOLDER) & (basename("path") != K.REVIEW_BRIEF)
    )
