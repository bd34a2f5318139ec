"""Line, token and lint operators over the text tables as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions.text import all_matches, lines_of, mask_dates, normalize_heading
from ..operators import facts, lint, merge, references, report, structure, trace
from ..operators.ordered import Previous, ordered_scan
from .corpus import lines, say
from .registry import query, table

# Lines of a text column in DuckDB; the texts break lines with line feeds only.
_LINES = """SELECT {key}, i AS line, a[i] AS text FROM (SELECT {key}, CASE WHEN a[len(a)] = '' THEN a[1:len(a)-1] ELSE a END AS a
 FROM (SELECT {key}, string_split({col}, chr(10)) AS a FROM {tab})), unnest(range(1, len(a) + 1)) AS u(i)"""
_DOC_LINES = _LINES.format(key="doc_id", col="text", tab="documents")


def _document_lines(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.posexplode(lines_of("text")).alias("line", "text")
    ).withColumn("line", F.col("line") + 1)


@query("line_explode", f"SELECT doc_id, line, length(text) AS n_chars FROM ({_DOC_LINES})")
def line_explode(spark, folder):
    return _document_lines(spark, folder).select("doc_id", "line", F.length("text").alias("n_chars"))


@query("line_profile", f"""
SELECT doc_id, count(*) AS n_lines, count(DISTINCT text) AS n_distinct, max(length(text)) AS longest FROM ({_DOC_LINES}) GROUP BY 1""")
def line_profile(spark, folder):
    """Line statistics inside the row: no explode, no shuffle."""
    lines = lines_of("text")
    return table(spark, folder, "documents").select("doc_id", lines.alias("l")).select(
        "doc_id", F.size("l").alias("n_lines"), F.size(F.array_distinct("l")).alias("n_distinct"),
        F.array_max(F.transform("l", lambda x: F.length(x))).alias("longest"),
    )


@query("last_line", f"""
SELECT doc_id, max_by(text, line) AS last_line FROM ({_DOC_LINES}) GROUP BY 1""")
def last_line(spark, folder):
    """Summary line of a run's output: its last line; an empty output has none and so no row."""
    return table(spark, folder, "documents").where(F.col("text").isNull() | (F.col("text") != "")).select(
        "doc_id", F.try_element_at(lines_of("text"), F.lit(-1)).alias("last_line")
    )


@query("heading_extract", r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '<h([1-6])[^>]*>([^<]*)</h', 1) AS lv, regexp_extract_all(html, '<h([1-6])[^>]*>([^<]*)</h', 2) AS tx FROM pages)
SELECT page_id, i - 1 AS seq, lv[i]::INTEGER AS level,
 trim(regexp_replace(trim(ltrim(tx[i], '#')), '\s*[\(（][^()（）]*[\)）]\s*$', '')) AS heading
FROM h, unnest(range(1, len(lv) + 1)) AS u(i)""")
def heading_extract(spark, folder):
    pattern = "<h([1-6])[^>]*>([^<]*)</h"
    found = F.arrays_zip(all_matches("html", pattern, 1).alias("level"), all_matches("html", pattern, 2).alias("title"))
    return table(spark, folder, "pages").select("page_id", F.posexplode(found).alias("seq", "h")).select(
        "page_id", "seq", F.col("h.level").cast("int").alias("level"), normalize_heading("h.title").alias("heading")
    )


@query("id_extract_all", r"""
SELECT doc_id, i - 1 AS seq, m[i] AS token FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS m FROM documents),
 unnest(range(1, len(m) + 1)) AS u(i)""")
def id_extract_all(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.posexplode(all_matches("text", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0)).alias("seq", "token")
    )


@query("struct_props", r"""
SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))), ',') AS tags,
 len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<li>')) AS items,
 len(regexp_extract_all(html, '<h[1-6]')) AS headings FROM pages""")
def struct_props(spark, folder):
    def n(pattern):
        return F.regexp_count("html", F.lit(pattern)).cast("bigint")

    return table(spark, folder, "pages").select(
        "page_id", F.array_join(M.sorted_set(all_matches("html", "<([a-z][a-z0-9]*)")), ",").alias("tags"),
        n("<a ").alias("links"), n("<li>").alias("items"), n("<h[1-6]").alias("headings"),
    )


@query("date_mask", r"""
SELECT o_orderkey, regexp_replace('Seen ' || strftime(o_orderdate, '%Y-%m-%d') || ' by ' || o_custkey, '[0-9]{4}-[0-9]{2}-[0-9]{2}', '{DATE}', 'g') AS masked FROM orders""")
def date_mask(spark, folder):
    text = F.concat(F.lit("Seen "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" by "), F.col("o_custkey").cast("string"))
    return table(spark, folder, "orders").select("o_orderkey", mask_dates(text).alias("masked"))


_WORDS = ("licensed", "License", "version", "token =", "###")


@query("lint_ambiguity", f"""
SELECT doc_id, w AS word, count(*) AS lines FROM ({_DOC_LINES}), unnest(['licensed', 'License', 'version', 'token =', '###']) AS u(w)
WHERE contains(text, w) GROUP BY 1, 2""")
def lint_ambiguity(spark, folder):
    return lint.word_hits(table(spark, folder, "documents"), "doc_id", _WORDS)


_PIPES = f"SELECT doc_id, line, len(string_split(text, '|')) AS cells FROM ({_DOC_LINES}) WHERE contains(text, '|')"


@query("table_columns", f"""
WITH p AS ({_PIPES}), n AS (SELECT doc_id, cells, count(*) AS c FROM p GROUP BY 1, 2),
m AS (SELECT doc_id, arg_max(cells, {{'c': c, 'k': -cells}}) AS usual FROM n GROUP BY 1)
SELECT doc_id, line, cells, usual FROM p JOIN m USING (doc_id) WHERE cells <> usual""")
def table_columns(spark, folder):
    """Pipe lines whose column count differs from the usual one of their document."""
    pipes = _document_lines(spark, folder).filter(F.contains("text", F.lit("|"))).select(
        "doc_id", "line", F.size(F.split("text", r"\|", -1)).alias("cells")
    )
    usual = (
        pipes.groupBy("doc_id", "cells").count().groupBy("doc_id")
        .agg(F.max_by("cells", F.struct(F.col("count"), -F.col("cells"))).alias("usual"))
    )
    return pipes.join(usual, "doc_id").filter("cells <> usual")


# Benchmark passages, whole and by their first words; no words make the empty passage.
_PASSAGES = """SELECT item_id * 1000 + k AS item_id, array_to_string(string_split(text, ' ')[1:k], ' ') AS text
 FROM benchmark, unnest([0, 1, 2, 3, 5, 40, 900]) AS u(k)"""


@query("golden_subset", f"""
SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS contained FROM ({_PASSAGES}) b""")
def golden_subset(spark, folder):
    """Which benchmark passages occur in any document, word for word."""
    sizes = F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 3, 5, 40, 900)])).alias("k")
    passages = table(spark, folder, "benchmark").select("item_id", "text", sizes).select(
        (F.col("item_id") * 1000 + F.col("k")).alias("item_id"), F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("k")), " ").alias("text")
    )
    return structure.passages_found(passages, table(spark, folder, "documents").select("doc_id", "text"))


_NORM = r"lower(trim(regexp_replace(text, '[ \n\t]+', ' ', 'g')))"


@query("dup_text", f"""
SELECT sha256({_NORM}) AS digest, count(*) AS n, min(doc_id) AS first_member FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_text(spark, folder):
    """Documents with the same text after normalising case and white space.

    Grouped by digest: what is shuffled is one partial count per distinct text and task.
    """
    norm = F.lower(F.trim(F.regexp_replace("text", r"[ \n\t]+", " ")))
    return trace.duplicates(table(spark, folder, "documents"), F.sha2(norm, 256), "doc_id", "digest")


@query("dup_lines", f"""
SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_member FROM ({_DOC_LINES}) WHERE length(text) > 0 GROUP BY 1 HAVING count(*) > 1""")
def dup_lines(spark, folder):
    """The same spec sentence pasted more than once, anywhere in the corpus."""
    rows = _document_lines(spark, folder).filter("length(text) > 0")
    return trace.duplicates(rows, F.md5("text"), "doc_id", "digest")


@query("dup_ids", "SELECT l_orderkey || '-' || l_linenumber AS key, count(*) AS n, min(l_partkey) AS first_member FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dup_ids(spark, folder):
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return trace.duplicates(table(spark, folder, "lineitem"), key, "l_partkey")


@query("change_magnitude", """
WITH c AS (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, p AS old_size, n AS new_size, abs(n - p) > p * 0.2 AS large FROM c WHERE p IS NOT NULL""")
def change_magnitude(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").alias("new_size"))
    scanned = ordered_scan(turns, ["conv_id"], ["turn"], {"old_size": Previous(F.col("new_size"))})
    return scanned.filter("old_size is not null").select(
        "conv_id", "turn", "old_size", "new_size", trace.large_change(F.col("old_size"), F.col("new_size")).alias("large")
    )


@query("config_values", r"""
SELECT doc_id, line, upper(lang) || '_KEY' AS key, 'v' || n_chars AS value
FROM documents, unnest([2, 3]) AS u(line)""")
def config_values(spark, folder):
    """``KEY: value`` lines in either decoration, from a block put before each document's whole text."""
    docs = table(spark, folder, "documents").withColumn("k", F.upper("lang"))
    block = docs.select(
        F.col("doc_id").cast("string").alias("path"),
        lines("```", say("{}_KEY: v{}   # note", "k", "n_chars"), say("- `{}_KEY` = `v{}`", "k", "n_chars"), "not a pair", "```", F.col("text")).alias("text"),
    )
    return facts.config_pairs(block).select(F.col("path").cast("bigint").alias("doc_id"), "line", "key", "value")


@query("config_typed", """
SELECT doc_id, n_chars / 4.0 AS LIMIT_USD, n_chars::INTEGER AS MAX_STEPS FROM documents""")
def config_typed(spark, folder):
    """Typed settings: a later bad number does not undo an earlier good one."""
    docs = table(spark, folder, "documents").withColumn("q", F.col("n_chars") / 4)
    block = docs.select(
        F.col("doc_id").cast("string").alias("path"),
        lines(say("LIMIT_USD: {}", "q"), "LIMIT_USD: many", say("MAX_STEPS: {}", "n_chars"), "MAX_STEPS: 1.5", F.col("text")).alias("text"),
    )
    return facts.typed_config(facts.config_pairs(block), ["LIMIT_USD"], ["MAX_STEPS"]).select(
        F.col("path").cast("bigint").alias("doc_id"), "LIMIT_USD", "MAX_STEPS"
    )


@query("help_catalogue", """
WITH s AS (SELECT DISTINCT lang || '.py' AS script, source AS sub FROM documents)
SELECT script, sub AS subcommand, '--from-' || sub AS flag FROM s""")
def help_catalogue(spark, folder):
    """Subcommands and flags read back out of help text, one help page per script and source."""
    pairs = table(spark, folder, "documents").select(F.concat("lang", F.lit(".py")).alias("script"), "source").distinct()
    top = pairs.select("script", F.lit("").alias("subcommand"), say("usage: {} [-h] {{},x-only}", "script", "source").alias("text"))
    sub = pairs.select("script", F.col("source").alias("subcommand"), say("usage: {} [--from-{}]", "script", "source").alias("text"))
    _, subs, flags = references.parse_help(top.unionByName(sub))
    return flags.join(subs, ["script", "subcommand"], "left_semi").select("script", "subcommand", "flag")


@query("cells_tsv", """
SELECT p_partkey, c AS "column", CASE c WHEN 'p_name' THEN p_name WHEN 'p_brand' THEN p_brand ELSE p_size::VARCHAR END AS value,
 p_partkey || chr(9) || c || chr(9) || (CASE c WHEN 'p_name' THEN p_name WHEN 'p_brand' THEN p_brand ELSE p_size::VARCHAR END) AS tsv
FROM part, unnest(['p_name', 'p_brand', 'p_size']) AS u(c)""")
def cells_tsv(spark, folder):
    return report.unpivot_cells(table(spark, folder, "part"), "p_partkey", ["p_name", "p_brand", "p_size"])


@query("snapshot_diff", """
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE n_chars > 300),
b AS (SELECT doc_id, sha256(CASE WHEN contains(text, 'License') THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'de')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed'
 WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def snapshot_diff(spark, folder):
    """Difference of two stages of a document tree; digests travel, texts stay put."""
    docs = table(spark, folder, "documents")
    before = docs.filter("n_chars > 300").select("doc_id", F.sha2("text", 256).alias("digest"))
    edited = F.when(F.contains("text", F.lit("License")), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = docs.filter("lang <> 'de'").select("doc_id", F.sha2(edited, 256).alias("digest"))
    return trace.reconcile(before, after, ["doc_id"], ["digest"])


@query("snapshot_sync", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'copied' WHEN d.n_chars > 1000 + 1000 * l.quality THEN 'updated' ELSE 'skipped' END AS action
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def snapshot_sync(spark, folder):
    source = table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("mtime"))
    target = table(spark, folder, "labels").select("doc_id", (1000 + 1000 * F.col("quality")).alias("mtime"))
    return merge.sync_actions(source, target, on="doc_id")
