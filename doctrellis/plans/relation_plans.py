"""Joins, aggregates and traceability operators over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import values as V
from ..functions.text import changed_under, contains_any, dirname
from ..operators import ledger, merge, report, trace
from ..operators.discovery import work_folder
from ..operators.ordered import RowNumber, ordered_scan
from ..sources import sinks
from .registry import query, table


@query("ref_exists_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def ref_exists_anti(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return trace.missing_from(orders, lines, ["o_orderkey"])


@query("min_children", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def min_children(spark, folder):
    return trace.childless(
        table(spark, folder, "orders").select("o_orderkey"), table(spark, folder, "lineitem").select("l_orderkey"),
        "o_orderkey", "l_orderkey",
    )


@query("child_counts", """
SELECT o_orderkey, count(l_orderkey) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def child_counts(spark, folder):
    """Children per parent, counted before the join so the join sees one row per parent."""
    counted = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_suppkey").alias("n_suppliers")
    )
    return table(spark, folder, "orders").select("o_orderkey").join(counted, "o_orderkey", "left").fillna(0, ["n_lines", "n_suppliers"])


@query("key_set_diff", """
SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'""")
def key_set_diff(spark, folder):
    """Pairs only ever seen among returns.  One scan: both sets are flags of one aggregate."""
    pairs = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.bool_and(F.col("l_returnflag") == "R").alias("only")
    )
    return pairs.filter("only").drop("only")


@query("key_set_union", """
SELECT l_suppkey AS key, 'supplier' AS kind FROM lineitem UNION SELECT l_partkey, 'part' FROM lineitem""")
def key_set_union(spark, folder):
    lines = table(spark, folder, "lineitem")
    both = F.array(
        F.struct(F.col("l_suppkey").alias("key"), F.lit("supplier").alias("kind")),
        F.struct(F.col("l_partkey").alias("key"), F.lit("part").alias("kind")),
    )
    return lines.select(F.inline(both)).distinct()


@query("key_set_intersect", """
SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1""")
def key_set_intersect(spark, folder):
    """Suppliers with both properties; one pass, one flag per property."""
    flags = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.bool_or((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "R")).alias("a"),
        F.bool_or(F.col("l_discount") >= 0.1).alias("b"),
    )
    return flags.filter("a and b").select("l_suppkey")


@query("array_set_ops", """
SELECT l_orderkey, concat_ws(',', CASE WHEN bool_or(l_returnflag = 'A') THEN 'A' END, CASE WHEN bool_or(l_linestatus = 'F') THEN 'F' END, CASE WHEN bool_or(l_returnflag = 'N') THEN 'N' END,
  CASE WHEN bool_or(l_linestatus = 'O') THEN 'O' END, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' END) AS known,
 concat_ws(',', CASE WHEN NOT bool_or(l_returnflag = 'A') THEN 'A' END, CASE WHEN NOT bool_or(l_linestatus = 'F') THEN 'F' END, CASE WHEN NOT bool_or(l_returnflag = 'N') THEN 'N' END,
  CASE WHEN NOT bool_or(l_linestatus = 'O') THEN 'O' END, CASE WHEN NOT bool_or(l_returnflag = 'R') THEN 'R' END) AS missing
FROM lineitem GROUP BY 1""")
def array_set_ops(spark, folder):
    """Union and difference of small key sets per call (each set has at most five values)."""
    sets = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("s")
    )
    known = F.array_union("f", "s")
    every = F.array(*[F.lit(x) for x in "AFNOR"])
    return sets.select(
        "l_orderkey", F.array_join(F.array_sort(known), ",").alias("known"),
        F.array_join(F.array_sort(F.array_except(every, known)), ",").alias("missing"),
    )


@query("flag_wiring", """
WITH u AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, value FROM events),
allowed AS (SELECT DISTINCT event_type, k FROM u WHERE value > 250)
SELECT event_type, k AS flag, count(*) AS calls FROM u WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.event_type = u.event_type AND a.k = u.k) GROUP BY 1, 2""")
def flag_wiring(spark, folder):
    """Type and key pairs outside the catalogue that larger events establish."""
    used = table(spark, folder, "events").select("event_type", F.get_json_object("props", "$.k").alias("flag"), "value")
    calls = used.groupBy("event_type", "flag").agg(F.count(F.lit(1)).alias("calls"))
    return trace.missing_from(calls, used.filter("value > 250"), ["event_type", "flag"])


@query("first_match", """
SELECT o_custkey, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey, min(o_orderdate)::DATE::VARCHAR AS first_date FROM orders GROUP BY 1""")
def first_match(spark, folder):
    first = trace.first_per(
        table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]
    )
    return first.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_date"))


@query("false_failure_rate", """
SELECT lang, count(*) FILTER (toxic = 1) AS failed, count(*) AS calibrated, round(count(*) FILTER (toxic = 1) / count(*), 6) AS rate
FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY 1""")
def false_failure_rate(spark, folder):
    runs = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").select(
        "lang", F.when(F.col("quality") == 1, "calibrate").otherwise("assert").alias("mode"), (F.col("toxic") == 1).alias("false_failure")
    )
    return ledger.false_failure_rate(runs, ["lang"])


@query("representative_sample", """
WITH f AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, first_order, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS rank FROM f
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) <= 3""")
def representative_sample(spark, folder):
    """The first three suppliers of each part, one line each."""
    per_pair = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first_order"))
    return trace.top_per(per_pair, ["l_partkey"], [F.col("l_suppkey")], 3)


@query("noise_symbols", """
SELECT l_partkey, count(DISTINCT l_suppkey) AS n_files FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 30""")
def noise_symbols(spark, folder):
    # Two-step distinct count: pairs first, so a hot part is spread over its suppliers.
    pairs = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_files")).filter("n_files > 30")


@query("count_reconcile", """
WITH r AS (SELECT source, CASE WHEN n_chars < 200 THEN 'comment' WHEN dup > 1 THEN 'dedup' WHEN lang = 'de' THEN 'noise-collapse' ELSE 'recorded' END AS reason
 FROM (SELECT source, lang, n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS dup FROM documents))
SELECT source, count(*) AS raw, count(*) FILTER (reason = 'recorded') AS recorded, count(*) FILTER (reason = 'dedup') AS dedup,
 count(*) FILTER (reason = 'comment') AS filtered, count(*) FILTER (reason = 'noise-collapse') AS collapsed, true AS balanced FROM r GROUP BY 1""")
def count_reconcile(spark, folder):
    """raw = recorded + dedup + filtered + collapsed per source.

    A copy is any document but the smallest id of its text.  The smallest id comes from an
    aggregate over digests, so a text with very many copies is one row on the right side.
    """
    from ..operators.discovery import reconcile_counts

    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("_first"))
    reason = (
        F.when(F.col("n_chars") < 200, "comment").when(F.col("doc_id") != F.col("_first"), "dedup")
        .when(F.col("lang") == "de", "noise-collapse").otherwise("recorded")
    )
    return reconcile_counts(docs.join(first, "digest").withColumn("reason", reason), ["source"])


@query("coverage_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_missing(spark, folder):
    return trace.missing_from(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"), ["doc_id"])


@query("coverage_summary", """
SELECT lang, count(*) AS total, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS uncovered,
 round(count(l.doc_id) * 100.0 / count(*), 2) AS percent, count(l.doc_id) * 100 >= count(*) * 80 AS passes
FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def coverage_summary(spark, folder):
    labelled = trace.distinct_keys(table(spark, folder, "labels"), "doc_id").withColumn("hit", F.lit(True))
    rows = table(spark, folder, "documents").select("doc_id", "lang").join(labelled, "doc_id", "left")
    return trace.coverage(rows, ["lang"], F.col("hit").isNotNull())


@query("unique_candidate", """
WITH c AS (SELECT s_nationkey, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS only_one FROM supplier WHERE s_acctbal > 9000 GROUP BY 1)
SELECT n_nationkey, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN only_one END AS s_suppkey FROM nation LEFT JOIN c ON s_nationkey = n_nationkey""")
def unique_candidate(spark, folder):
    suppliers = table(spark, folder, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return trace.unique_candidate(table(spark, folder, "nation").select("n_nationkey"), suppliers, "n_nationkey", "s_suppkey")


@query("trace_chain", """
SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def trace_chain(spark, folder):
    """Counts per hop, rolled up hop by hop: each join meets pre-counted children."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    orders = (
        table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left")
        .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.sum("lines").alias("lines"))
    )
    customers = (
        table(spark, folder, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"), F.sum("lines").alias("lines"))
    )
    nations = table(spark, folder, "nation").join(customers, "n_nationkey", "left").groupBy("n_regionkey").agg(
        F.count(F.lit(1)).alias("nations"), *[F.sum(c).alias(c) for c in ("customers", "orders", "lines")]
    )
    return (
        table(spark, folder, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .select("r_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nations", "customers", "orders", "lines")])
    )


@query("trace_gaps", """
SELECT 'customer' AS hop, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'part', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)""")
def trace_gaps(spark, folder):
    """Rows of each hop that nothing of the next hop refers to."""
    lines = table(spark, folder, "lineitem")
    hops = [
        ("customer", table(spark, folder, "customer").select(F.col("c_custkey").alias("key")), table(spark, folder, "orders").select(F.col("o_custkey").alias("key"))),
        ("order", table(spark, folder, "orders").select(F.col("o_orderkey").alias("key")), lines.select(F.col("l_orderkey").alias("key"))),
        ("part", table(spark, folder, "part").select(F.col("p_partkey").alias("key")), lines.filter("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("key"))),
    ]
    out = None
    for hop, required, covered in hops:
        part = trace.missing_from(required, covered, ["key"]).select(F.lit(hop).alias("hop"), "key")
        out = part if out is None else out.unionByName(part)
    return out


@query("file_collision", """
WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT l_partkey, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT l_partkey, l_suppkey, n AS n_owners FROM p JOIN n USING (l_partkey)""")
def file_collision(spark, folder):
    return trace.shared_targets(table(spark, folder, "lineitem"), "l_partkey", "l_suppkey")


@query("concurrent_overlap", """
WITH p AS (SELECT DISTINCT l_partkey, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'),
n AS (SELECT l_partkey, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT l_partkey, o_orderpriority, n AS n_owners FROM p JOIN n USING (l_partkey)""")
def concurrent_overlap(spark, folder):
    """Parts touched by open orders of more than one priority."""
    open_orders = table(spark, folder, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    touched = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(open_orders, "l_orderkey")
    return trace.shared_targets(touched, "l_partkey", "o_orderpriority")


@query("full_diff", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN l.doc_id IS NULL THEN 'removed'
 WHEN d.q <> l.q THEN 'changed' ELSE 'same' END AS status
FROM (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS q FROM documents WHERE lang = 'en') d
FULL JOIN (SELECT doc_id, quality AS q FROM labels) l ON d.doc_id = l.doc_id""")
def full_diff(spark, folder):
    left = table(spark, folder, "documents").filter("lang = 'en'").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("q"))
    right = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("q"))
    return trace.reconcile(left, right, ["doc_id"], ["q"])


@query("tally_rollup", """
SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus AS s FROM orders UNION SELECT 'X') LEFT JOIN orders ON o_orderstatus = s GROUP BY 1
UNION ALL SELECT 'TOTAL', count(*) FROM orders""")
def tally_rollup(spark, folder):
    """Status histogram with a total row; a status nobody has shows 0."""
    orders = table(spark, folder, "orders")
    statuses = orders.select(F.explode(F.array("o_orderstatus", F.lit("X"))).alias("o_orderstatus"))
    return trace.tally(orders, "o_orderstatus", statuses)


@query("tally_reconcile", """
WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_orderkey, l_returnflag, max(l_linenumber) AS stated FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_returnflag, stated::BIGINT AS stated, n AS counted, stated = n AS agrees FROM c JOIN s USING (l_orderkey, l_returnflag)""")
def tally_reconcile(spark, folder):
    """Stated result counts against a recount of the rows."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    stated = lines.groupBy("l_orderkey", "l_returnflag").agg(F.max("l_linenumber").cast("bigint").alias("stated"))
    return trace.tally_matches(lines, stated, ["l_orderkey"], "l_returnflag")


@query("inverted_index", """
WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
i AS (SELECT source, (n - 1) // 100 AS block, count(*) AS members, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM n GROUP BY 1, 2)
SELECT t.source, coalesce(block, 0) AS block, coalesce(members, 0) AS members, coalesce(ids, '—') AS ids
FROM (SELECT DISTINCT source FROM documents UNION SELECT DISTINCT 'lang-' || lang FROM documents) t LEFT JOIN i USING (source)""")
def inverted_index(spark, folder):
    docs = table(spark, folder, "documents").select("source", "doc_id")
    # a source may hold a third of all rows
    numbered = ordered_scan(docs, ["source"], ["doc_id"], {"n": RowNumber()}, segments=int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = trace.posting_lists(docs, "source", "doc_id", numbered, 100)
    tags = table(spark, folder, "documents").select(F.explode(F.array("source", F.concat(F.lit("lang-"), "lang"))).alias("source"))
    return trace.with_empty_tags(index, tags, "source")


@query("crosstab", """
SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) FILTER (o_orderstatus = 'P') AS "n_P", count(*) AS n_total
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def crosstab(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").join(
        table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey"
    )
    return trace.crosstab(rows, "c_nationkey", "o_orderstatus", ["F", "O", "P"])


@query("access_matrix", """
SELECT l_suppkey, p_type, concat_ws('', CASE WHEN bool_or(op = 'C') THEN 'C' END, CASE WHEN bool_or(op = 'R') THEN 'R' END, CASE WHEN bool_or(op = 'U') THEN 'U' END, CASE WHEN bool_or(op = 'D') THEN 'D' END) AS ops
FROM (SELECT l_suppkey, p_type, CASE WHEN l_returnflag = 'A' THEN 'C' WHEN l_returnflag = 'R' THEN 'D' WHEN l_linestatus = 'O' THEN 'U' ELSE 'R' END AS op FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2""")
def access_matrix(spark, folder):
    op = (
        F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "R", "D")
        .when(F.col("l_linestatus") == "O", "U").otherwise("R")
    )
    rows = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"), op.alias("op")).join(
        table(spark, folder, "part").select("p_partkey", "p_type"), "p_partkey"
    )
    return trace.access_matrix(rows, "l_suppkey", "p_type", "op")


@query("index_rows", """
SELECT c_nationkey, count(DISTINCT c_mktsegment) AS modules, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS last_cr
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def index_rows(spark, folder):
    """Modules per repository and the change that touched it last."""
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate").join(
        table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey"
    )
    return rows.groupBy("c_nationkey").agg(
        F.countDistinct("c_mktsegment").alias("modules"),
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_cr"),
    )


@query("caller_counts", """
WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS callers FROM lineitem GROUP BY 1)
SELECT p_partkey, coalesce(callers, 0) AS callers, p_size AS stated, coalesce(callers, 0) = p_size AS agrees FROM part LEFT JOIN c ON l_partkey = p_partkey""")
def caller_counts(spark, folder):
    """Direct callers per function against the number its table states."""
    pairs = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey").distinct()
    counted = pairs.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("callers"))
    return table(spark, folder, "part").join(counted, "p_partkey", "left").select(
        "p_partkey", F.coalesce("callers", F.lit(0)).alias("callers"), F.col("p_size").alias("stated"),
        (F.coalesce("callers", F.lit(0)) == F.col("p_size")).alias("agrees"),
    )


@query("scale_warnings", """
SELECT c_nationkey, kind, n, CASE kind WHEN 'UR' THEN 20 WHEN 'SP' THEN 50 ELSE 10 END AS "limit" FROM (
 SELECT c_nationkey, 'UR' AS kind, count(*) AS n FROM customer GROUP BY 1 UNION ALL
 SELECT c_nationkey, 'SP', count(*) FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 UNION ALL
 SELECT c_nationkey, 'module', count(DISTINCT c_mktsegment) FROM customer GROUP BY 1)
WHERE n > CASE kind WHEN 'UR' THEN 20 WHEN 'SP' THEN 50 ELSE 10 END""")
def scale_warnings(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    placed = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    per = customers.join(placed, "c_custkey", "left").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("UR"), F.sum("n").alias("SP"), F.countDistinct("c_mktsegment").alias("module")
    )
    counts = per.unpivot("c_nationkey", ["UR", "SP", "module"], "kind", "n")
    return trace.scale_warnings(counts, ["c_nationkey"])


@query("forced_two_layers", """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber FROM n WHERE c = 1 AND (l_returnflag = 'R' OR l_linestatus = 'O')""")
def forced_two_layers(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "returned").otherwise(" ").alias("reason"),
        F.when(F.col("l_linestatus") == "O", "open").alias("explanation"),
    )
    return trace.forced_two_layers(rows).select(F.col("group_id").alias("l_orderkey"), "l_linenumber")


@query("relation_errors", """
SELECT l_partkey AS source, l_suppkey AS target, l_returnflag AS division_axis,
 CASE WHEN p_partkey IS NULL THEN 'source_missing' WHEN s.p2 IS NULL THEN 'target_missing' ELSE 'bad_axis' END AS problem
FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)
LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON p_partkey = l_partkey LEFT JOIN (SELECT p_partkey AS p2 FROM part WHERE p_size > 5) s ON s.p2 = l_suppkey""")
def relation_errors(spark, folder):
    """Relations whose ends or axis do not resolve; both ends look into the same id list."""
    from ..operators.lint import relation_errors as check

    relations = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("division_axis")
    ).distinct()
    names = table(spark, folder, "part").filter("p_size > 5").select(F.col("p_partkey").alias("id"))
    return check(relations, names, "source", "target", "id")


@query("deprecated_modules", """
SELECT DISTINCT c_nationkey AS repo, c_mktsegment AS module FROM customer WHERE c_mktsegment <> 'BUILDING'
EXCEPT SELECT c_nationkey, c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 495000
EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9500""")
def deprecated_modules(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("repo"), F.col("c_mktsegment").alias("module"), "c_acctbal")
    big = table(spark, folder, "orders").filter("o_totalprice > 495000").select(F.col("o_custkey").alias("c_custkey"))
    return trace.deprecated_modules(
        customers.select("repo", "module").distinct(), customers.join(big, "c_custkey", "left_semi"), ["BUILDING"],
        customers.filter("c_acctbal > 9500"),
    )


@query("routing", """
SELECT c_custkey, CASE WHEN n_nationkey IS NULL OR n_regionkey > 2 THEN 'to confirm' ELSE 'repo-' || n_name END AS destination
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def routing(spark, folder):
    destinations = table(spark, folder, "nation").filter("n_regionkey <= 2").select(
        F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("repo-"), "n_name").alias("destination")
    )
    return trace.route(
        table(spark, folder, "customer").select("c_custkey", "c_nationkey"), destinations, "c_nationkey", "destination", "to confirm"
    ).select("c_custkey", "destination")


@query("topn_uncertain", """
WITH d AS (SELECT lang, doc_id, n_chars, coalesce(quality, 0) AS q FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY q, n_chars DESC, doc_id) AS rank FROM d
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY q, n_chars DESC, doc_id) <= 5""")
def topn_uncertain(spark, folder):
    """Review brief: the five least certain documents per language, longest first."""
    docs = table(spark, folder, "documents").select("lang", "doc_id", "n_chars").join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    order = [F.coalesce("quality", F.lit(0)), F.col("n_chars").desc(), F.col("doc_id")]
    return trace.top_per(docs, ["lang"], order, 5).select("lang", "doc_id", "n_chars", "rank")


@query("suite_verdict", """
SELECT o_orderpriority AS stage, bool_and(o_totalprice > 1100) AS ok, count(*) AS suites FROM orders GROUP BY 1""")
def suite_verdict(spark, folder):
    return report.suite_verdict(
        table(spark, folder, "orders").select(F.col("o_orderpriority").alias("stage"), (F.col("o_totalprice") > 1100).alias("ok"))
    )


@query("repo_outcome", """
SELECT c_nationkey::VARCHAR AS repo, bool_and(c_acctbal >= -900) AS ok, count(*) FILTER (c_acctbal < -900) AS failures FROM customer GROUP BY 1
UNION ALL SELECT 'ALL', bool_and(c_acctbal >= -900), count(*) FILTER (c_acctbal < -900) FROM customer""")
def repo_outcome(spark, folder):
    return merge.repo_outcome(
        table(spark, folder, "customer").select(F.col("c_nationkey").cast("string").alias("repo"), (F.col("c_acctbal") >= -900).alias("ok"))
    )


@query("impact_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def impact_filter(spark, folder):
    """Promote only entries of high or medium impact."""
    impact = F.when(F.col("o_orderpriority") == "1-URGENT", K.PROMOTED_IMPACT[0]).when(
        F.col("o_orderpriority") == "2-HIGH", K.PROMOTED_IMPACT[1]
    ).otherwise("低")
    return table(spark, folder, "orders").filter(impact.isin(*K.PROMOTED_IMPACT)).select("o_orderkey")


@query("tag_filter", """
SELECT p_partkey FROM part WHERE split_part(p_name, ' ', 1) IN ('small', 'blue') OR split_part(p_name, ' ', 2) IN ('small', 'blue')""")
def tag_filter(spark, folder):
    """Any-of filter on a tag list."""
    wanted = F.array(F.lit("small"), F.lit("blue"))
    return table(spark, folder, "part").filter(F.arrays_overlap(F.split("p_name", " "), wanted)).select("p_partkey")


@query("verified_glyphs", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['□□□', '■□□', '■■□', '■■■'][1 + (CASE WHEN l_tax > 0 THEN 1 ELSE 0 END) + (CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) + (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)] AS glyph FROM lineitem""")
def verified_glyphs(spark, folder):
    flags = F.array(F.col("l_tax") > 0, F.col("l_discount") > 0.05, F.col("l_linestatus") == "F")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.verified_glyph(flags).alias("glyph"))


@query("progress_states", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'in progress' ELSE 'unknown' END AS state FROM orders""")
def progress_states(spark, folder):
    glyph = F.when(F.col("o_orderstatus") == "F", "✅").when(F.col("o_orderstatus") == "O", "🔄").otherwise("?")
    return table(spark, folder, "orders").select("o_orderkey", V.progress_status(glyph).alias("state"))


@query("version_bump", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN (p_size + 1) || '.0.0' WHEN 'SMALL' THEN p_size || '.' || (p_partkey + 1) || '.0'
 WHEN 'LARGE' THEN p_size || '.' || p_partkey || '.8' ELSE p_size || '.' || p_partkey || '.7' END AS version FROM part""")
def version_bump(spark, folder):
    version = F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.lit("7"))
    part = F.when(F.col("p_type") == "ECONOMY", "MAJOR").when(F.col("p_type") == "SMALL", "MINOR").when(F.col("p_type") == "LARGE", "PATCH")
    return table(spark, folder, "part").select("p_partkey", V.bump_version(version, F.coalesce(part, F.lit("-"))).alias("version"))


@query("next_revision", "SELECT l_orderkey, max(l_linenumber) + 1 AS next_revision FROM lineitem GROUP BY 1")
def next_revision(spark, folder):
    return merge.next_revision(table(spark, folder, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("seed_names", """
SELECT o_orderkey, 'phase' || (CASE o_orderstatus WHEN 'F' THEN 'Close' WHEN 'O' THEN '02' ELSE '11' END) || '-' || (CASE WHEN o_orderstatus = 'P' THEN 'multi' ELSE 'single' END) AS seed FROM orders""")
def seed_names(spark, folder):
    phase = F.when(F.col("o_orderstatus") == "F", "close").when(F.col("o_orderstatus") == "O", "02").otherwise("11")
    variant = F.when(F.col("o_orderstatus") == "P", "multi").otherwise("single")
    return table(spark, folder, "orders").select("o_orderkey", ledger.seed_name(phase, variant).alias("seed"))


@query("model_lookup", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'm-' || (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') ELSE 'm-' || (SELECT count(*) FROM orders) END AS model FROM customer""")
def model_lookup(spark, folder):
    """Exact key first, else (also for an empty entry) the wildcard entry."""
    counted = table(spark, folder, "orders").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    models = counted.select(F.inline(F.array(
        F.struct(F.lit("BUILDING").alias("key"), F.concat(F.lit("m-"), F.col("urgent").cast("string")).alias("model")),
        F.struct(F.lit("MACHINERY").alias("key"), F.lit("").alias("model")),
        F.struct(F.lit("*").alias("key"), F.concat(F.lit("m-"), F.col("all").cast("string")).alias("model")),
    )))
    return ledger.lookup_with_default(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), models, "c_mktsegment", "model").select("c_custkey", "model")


@query("rule_of_three", """
SELECT c_mktsegment, count(*) AS trials, round(3.0 / count(*), 6) AS bound FROM customer GROUP BY 1""")
def rule_of_three(spark, folder):
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("trials")).select(
        "c_mktsegment", "trials", F.round(V.rule_of_three("trials"), 6).alias("bound")
    )


@query("group_name_form", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN '＜' || p_name || '＞' ELSE '<' || p_name || '>' END AS name, p_size > 25 AS ok FROM part""")
def group_name_form(spark, folder):
    name = F.when(F.col("p_size") > 25, F.concat(F.lit("＜"), "p_name", F.lit("＞"))).otherwise(F.concat(F.lit("<"), "p_name", F.lit(">")))
    return table(spark, folder, "part").select("p_partkey", name.alias("name")).withColumn("ok", F.rlike("name", F.lit(K.GROUP_NAME)))


@query("word_list_hits", """
SELECT p_partkey, concat_ws(',', CASE WHEN contains(p_name, 'bolt') THEN 'bolt' END, CASE WHEN contains(p_name, 'ring') THEN 'ring' END) AS words FROM part""")
def word_list_hits(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.array_join(contains_any("p_name", ["bolt", "ring"]), ",").alias("words"))


@query("changed_paths", r"""
SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages
WHERE regexp_matches(regexp_replace(url, '^https?://[^/]*', ''), '^(/en/|/de/1)')""")
def changed_paths(spark, folder):
    """Changed paths that call for a check."""
    paths = table(spark, folder, "pages").select("page_id", F.regexp_replace("url", r"^https?://[^/]*", "").alias("path"))
    return paths.filter(changed_under("path", ["/en/", "/de/1"]))


@query("tenth_revision", "SELECT l_orderkey, CAST(max(l_linenumber) * 0.9 + 0.1 AS DECIMAL(18,1)) AS next_revision FROM lineitem GROUP BY 1")
def tenth_revision(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_linenumber") * F.lit("0.9").cast("decimal(2,1)")).alias("rev"))
    return merge.tenth_revision(rows, ["l_orderkey"], "rev")


@query("next_run", """
SELECT o_custkey, 'run ' || CASE WHEN count(*) + 95 < 100 THEN lpad((count(*) + 95)::VARCHAR, 2, '0') ELSE (count(*) + 95)::VARCHAR END AS next_run
FROM orders GROUP BY 1""")
def next_run(spark, folder):
    """Run labels around the step from two digits to three."""
    runs = table(spark, folder, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) + 94).alias("run"))
    return merge.next_run(runs, ["o_custkey"])


@query("emptied_folders", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS folder FROM pages)
SELECT folder FROM p GROUP BY 1 HAVING bool_and(page_id IN (SELECT item_id * 3 FROM benchmark))""")
def emptied_folders(spark, folder):
    """Folders that a removal manifest leaves without any page."""
    pages = table(spark, folder, "pages").select("page_id", dirname(F.regexp_replace("url", r"[?#].*$", "")).alias("folder"))
    manifest = table(spark, folder, "benchmark").select((F.col("item_id") * 3).alias("page_id"))
    return merge.emptied_folders(pages, manifest, pages, "page_id")


@query("graph_changed", """
WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, count(DISTINCT l_partkey) AS n, count(*) AS e FROM lineitem WHERE year(l_shipdate) IN (1996, 1997) GROUP BY 1, 2)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, NOT (a.n IS NOT DISTINCT FROM b.n AND a.e IS NOT DISTINCT FROM b.e) AS changed
FROM (FROM y WHERE y = 1996) a FULL JOIN (FROM y WHERE y = 1997) b USING (l_suppkey)""")
def graph_changed(spark, folder):
    """Suppliers whose part graph has another size than the year before."""
    lines = table(spark, folder, "lineitem").withColumn("y", F.year("l_shipdate")).filter("y in (1996, 1997)")
    # pairs first, then their number: no supplier's parts meet in one set
    pairs = lines.groupBy("l_suppkey", "y", "l_partkey").agg(F.count(F.lit(1)).alias("k"))
    sizes = pairs.groupBy("l_suppkey").pivot("y", [1996, 1997]).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("e"))
    return sizes.select("l_suppkey", trace.graph_changed(F.col("1996_n"), F.col("1997_n"), F.col("1996_e"), F.col("1997_e")).alias("changed"))


@query("rule_routing", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'urgent-closed' WHEN o_orderstatus = 'F' THEN 'closed'
 WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'high-open' ELSE 'to confirm' END AS destination FROM orders""")
def rule_routing(spark, folder):
    """Promotion by step and condition; a rule without a condition takes what the others leave."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("step"), F.col("o_orderpriority").alias("urgency"))
    status, urgency = F.col("step"), F.col("urgency")
    rules = orders.select("step", "urgency").distinct().select("step", F.explode(F.array(
        F.when((status == "F") & (urgency == "1-URGENT"), F.struct(urgency.alias("urgency"), F.lit("urgent-closed").alias("destination"))),
        F.when(status == "F", F.struct(F.lit(None).cast("string").alias("urgency"), F.lit("closed").alias("destination"))),
        F.when((status == "O") & (urgency == "2-HIGH"), F.struct(urgency.alias("urgency"), F.lit("high-open").alias("destination"))),
    )).alias("r")).filter("r is not null").select("step", "r.*").distinct()
    return trace.route_by_rules(orders, rules, "step", ["urgency"], "destination", "to confirm").select("o_orderkey", "destination")


@query("chain_gaps", """
WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority AS phase, o_orderpriority[1]::INTEGER AS p FROM orders),
c AS (SELECT DISTINCT phase, p FROM d), f AS (SELECT o_custkey, max(p) AS m FROM d GROUP BY 1)
SELECT f.o_custkey, c.phase FROM f JOIN c ON c.p < f.m WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.o_custkey = f.o_custkey AND d.p = c.p)""")
def chain_gaps(spark, folder):
    """Phases that a customer skipped on the way to its furthest one."""
    orders = table(spark, folder, "orders").select("o_custkey", F.col("o_orderpriority").alias("phase"))
    chain = orders.select("phase").distinct().withColumn("position", F.substring("phase", 1, 1).cast("int"))
    return trace.chain_gaps(orders, chain, ["o_custkey"])


@query("phase_commands", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'run-now' ELSE 'phase ' || o_orderpriority || ' --go' END AS command FROM orders""")
def phase_commands(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("phase"))
    commands = orders.filter("phase = '1-URGENT'").select("phase", F.lit("run-now").alias("command"))
    return ledger.phase_command(orders, commands, "phase", "phase {} --go").select("o_orderkey", "command")


@query("review_brief", """
WITH d AS (SELECT lang, doc_id, n_chars, coalesce(quality, 0) AS q FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT lang, doc_id, ceil(n_chars / 900)::BIGINT AS minutes, row_number() OVER (PARTITION BY lang ORDER BY q, n_chars DESC, doc_id) AS rank FROM d)
SELECT *, (sum(minutes) OVER (PARTITION BY lang ORDER BY rank))::BIGINT AS minutes_so_far FROM r WHERE rank <= 7""")
def review_brief(spark, folder):
    """Reading order of the least certain documents, with the time it takes."""
    docs = table(spark, folder, "documents").select("lang", "doc_id", "n_chars").join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    order = [F.coalesce("quality", F.lit(0)), F.col("n_chars").desc(), F.col("doc_id")]
    return trace.review_brief(docs, ["lang"], order, 7, "n_chars", 900).select("lang", "doc_id", "minutes", "rank", "minutes_so_far")


@query("golden_files", """
SELECT lpad(c_nationkey::VARCHAR, 3, '0') AS doc_set, count(*) AS members, min(c_custkey) AS first, true AS newline FROM customer GROUP BY 1""")
def golden_files(spark, folder):
    """Golden objects written as one file per set and read back."""
    root = work_folder(spark, "goldens")
    customers = table(spark, folder, "customer").groupBy(F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("doc_set")).agg(
        F.count(F.lit(1)).alias("members"), F.min("c_custkey").alias("first")
    )
    sinks.write_goldens(sinks.golden_json(customers, "doc_set"), root)
    read = sinks.read_golden_files(spark, root)
    return read.select("doc_set", F.endswith("json", F.lit("\n")).alias("newline"), F.from_json("json", "members bigint, first bigint").alias("g")).select(
        "doc_set", "g.*", "newline"
    )


_RUNS = """WITH r AS (SELECT event_id, 'run-' || event_id AS seed, CASE WHEN event_type = 'error' THEN 'calibrate' ELSE 'assert' END AS mode, event_type AS model,
 CASE WHEN value > 25 THEN 'violations' ELSE 'ok' END AS status, CASE WHEN event_type <> 'view' THEN CAST(value AS DECIMAL(28,4)) END AS cost, value > 25 AS bad FROM events)"""


def _runs(spark, folder):
    """A run per event; dear ones have violations, views cost nothing."""
    bad = F.col("value") > 25
    return table(spark, folder, "events").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("seed"),
        F.when(F.col("event_type") == "error", "calibrate").otherwise("assert").alias("mode"), F.col("event_type").alias("model"),
        F.when(bad, "violations").otherwise("ok").alias("status"), F.when(F.col("event_type") != "view", F.col("value")).alias("cost_usd"),
        F.when(bad, F.array(F.concat(F.lit("dear "), "event_type"), F.lit("second"))).alias("violations"), bad.alias("false_failure"),
    )


@query("run_report", f"""{_RUNS}
SELECT seed, 0 AS line, '[' || seed || '] mode=' || mode || ' model=' || model || ' -> ' || status || coalesce(' ($' || cost::VARCHAR || ')', '') AS rendered FROM r
UNION ALL SELECT seed, 1, '    ✗ dear ' || model FROM r WHERE bad UNION ALL SELECT seed, 2, '    ✗ second' FROM r WHERE bad""")
def run_report(spark, folder):
    """Every run and its violations as lines."""
    return report.render_runs(_runs(spark, folder))


@query("run_report_totals", f"""{_RUNS}
SELECT 1 AS line, '偽失敗率: ' || count(*) FILTER (mode = 'calibrate' AND bad) || '/' || count(*) FILTER (mode = 'calibrate') AS rendered FROM r HAVING count(*) FILTER (mode = 'calibrate') > 0
UNION ALL SELECT 2, '累積コスト: $' || sum(cost)::DECIMAL(28,4)::VARCHAR || ' / 上限 $30.0000（工程数 ' || count(cost) || '）' FROM r""")
def run_report_totals(spark, folder):
    """What the runs add up to."""
    return report.render_run_totals(_runs(spark, folder), 30.0)


@query("run_report_json", f"""{_RUNS} SELECT seed, mode, status, cost::DOUBLE AS cost, CASE WHEN bad THEN 2 END AS violations FROM r""")
def run_report_json(spark, folder):
    """The runs as objects, read back."""
    rows = report.runs_json(_runs(spark, folder))
    parsed = F.from_json("json", "mode string, status string, cost_usd double, violations array<string>")
    return rows.select("seed", parsed.alias("j")).select(
        "seed", "j.mode", "j.status", F.col("j.cost_usd").alias("cost"), F.when(F.col("j.violations").isNotNull(), F.size("j.violations")).alias("violations"))


@query("suite_report", """
WITH s AS (SELECT 'tests/' || c_custkey AS dir, c_acctbal >= 0 AS ok, c_mktsegment AS summary, c_name, c_acctbal < -500 AS long FROM customer)
SELECT dir, 0 AS line, CASE WHEN ok THEN '✅ ' ELSE '❌ ' END || dir || '  ' || summary AS rendered FROM s
UNION ALL SELECT dir, 1, 'FAILED ' || c_name FROM s WHERE NOT ok UNION ALL SELECT dir, 2, 'in debt' FROM s WHERE long""")
def suite_report(spark, folder):
    """A suite per customer; those in debt have failed and show their output."""
    output = F.concat(F.lit("FAILED "), "c_name", F.when(F.col("c_acctbal") < -500, F.lit("\nin debt\n")).otherwise(""))
    return report.render_suites(table(spark, folder, "customer").select(
        F.concat(F.lit("tests/"), F.col("c_custkey").cast("string")).alias("dir"), (F.col("c_acctbal") >= 0).alias("ok"), F.col("c_mktsegment").alias("summary"), output.alias("output"),
    ))
