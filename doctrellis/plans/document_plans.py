"""Document operators over corpora derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions.text import lines_of
from ..operators import facts, incremental, lint, references, report, structure, trace
from ..operators.discovery import work_folder
from . import corpus
from .registry import query, table

_SEGMENT = """CASE o_orderpriority WHEN '1-URGENT' THEN 'BUILDING' WHEN '2-HIGH' THEN 'AUTOMOBILE'
 WHEN '3-MEDIUM' THEN 'MACHINERY' WHEN '4-NOT SPECIFIED' THEN 'HOUSEHOLD' WHEN '5-LOW' THEN 'FURNITURE' END"""
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_EXTRA = "(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END)"

# Violations of checks A and B on the order corpus, stated over the tables.
_CHECK_A = f"""
SELECT 'A' AS "check", 'error' AS severity, 'skills/order/' || o_orderkey || '.md' AS file, 10 AS line,
 CASE WHEN c_mktsegment = 'MACHINERY' OR c_custkey IS NULL
  THEN 'apply Segment ' || {_SEGMENT} || ': file books/customer/c' || o_custkey || '.md does not exist'
  ELSE 'apply Segment ' || {_SEGMENT} || ': no such heading in books/customer/c' || o_custkey || '.md' END AS message
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE c_custkey IS NULL OR c_mktsegment = 'MACHINERY' OR c_mktsegment <> {_SEGMENT}"""
_CHECK_NAMES = """
SELECT 'B' AS "check", 'error' AS severity, 'books/customer/c' || c_custkey || '.md' AS file, 1 AS line,
 'name ' || c_name || ' differs from file name c' || c_custkey AS message
FROM customer WHERE c_mktsegment = 'FURNITURE'"""
_CHECK_B = """
SELECT 'B' AS "check", CASE WHEN c_custkey IS NULL OR c_mktsegment = 'MACHINERY' THEN 'error' ELSE 'warning' END AS severity,
 'skills/order/' || o_orderkey || '.md' AS file, 11 AS line,
 CASE WHEN c_custkey IS NULL OR c_mktsegment = 'MACHINERY' THEN 'agent c' || o_custkey || ' has no definition'
  WHEN c_acctbal < 0 THEN 'agent c' || o_custkey || ' declares no inputs; contract not compared'
  ELSE 'key STATUS_P is not mentioned by agent c' || o_custkey END AS message
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE c_custkey IS NULL OR c_mktsegment = 'MACHINERY' OR c_acctbal < 0 OR o_orderstatus = 'P'"""
_CHECK_C = """
SELECT 'C' AS "check", 'warning' AS severity, 'skills/part/templates/' || p_partkey || '.md' AS file, 0 AS line,
 'placeholder P_' || p_partkey || ' is never mentioned' AS message
FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)"""
_CHECK_D = """
WITH e AS (SELECT event_id, ts, event_type, 'u' || user_id AS sub, '--k' || json_extract_string(props, '$.k') AS flag FROM events),
known AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-16'),
used AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-16'),
subs AS (SELECT DISTINCT event_type, sub FROM known),
flags AS (SELECT DISTINCT event_type, sub, flag FROM known)
SELECT 'D' AS "check", CASE WHEN s.sub IS NULL AND event_type NOT IN (SELECT event_type FROM known) THEN 'warning' ELSE 'error' END AS severity,
 'skills/run/' || event_id || '.md' AS file, 1 AS line,
 CASE WHEN event_type NOT IN (SELECT event_type FROM known) THEN event_type || '.py is not in the catalogue; call not compared'
      WHEN s.sub IS NULL THEN event_type || '.py has no subcommand ' || u.sub
      ELSE event_type || '.py ' || u.sub || ' has no flag ' || u.flag END AS message
FROM used u LEFT JOIN subs s USING (event_type, sub) LEFT JOIN flags f USING (event_type, sub, flag)
WHERE s.sub IS NULL OR f.flag IS NULL"""


def _check_a(spark, folder):
    orders, customers = corpus.order_docs(spark, folder), corpus.customer_docs(spark, folder)
    docs = orders.unionByName(customers)
    return references.check_apply(docs, docs, corpus.HOME, corpus.REPO)


def _agents(spark, folder):
    """Definition files: direct children of the agent folder."""
    return corpus.customer_docs(spark, folder).filter(F.rlike("path", F.lit(r"^books/customer/[^/]+\.md$")))


def _check_b(spark, folder):
    return references.check_agents(corpus.order_docs(spark, folder), _agents(spark, folder))


def _check_d(spark, folder):
    """Calls of the later half of the month against the usage documented in the first half."""
    docs = corpus.run_docs(spark, folder)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    documented = facts.script_calls(docs.filter(F.col("ts") < cut))
    flags = documented.select("script", "subcommand", F.explode("flags").alias("flag"))
    scripts = documented.groupBy("script").agg(F.lit(True).alias("available"), F.lit(True).alias("has_subs"))
    calls = facts.script_calls(docs.filter(F.col("ts") >= cut))
    return references.check_wiring(calls, scripts, documented.select("script", "subcommand"), flags)


query("check_apply_headings", _CHECK_A)(_check_a)
query("check_agent_contracts", _CHECK_B)(_check_b)
query("check_agent_names", _CHECK_NAMES)(lambda s, d: references.check_agent_names(_agents(s, d)))
query("check_template_placeholders", _CHECK_C)(lambda s, d: references.check_placeholders(corpus.template_docs(s, d)))
query("check_script_wiring", _CHECK_D)(_check_d)


def _all_checks(spark, folder):
    return (
        _check_a(spark, folder)
        .unionByName(references.check_agent_names(_agents(spark, folder)))
        .unionByName(_check_b(spark, folder))
        .unionByName(references.check_placeholders(corpus.template_docs(spark, folder)))
        .unionByName(_check_d(spark, folder))
    )


_ALL = f"""SELECT * FROM ({_CHECK_A}) UNION ALL SELECT * FROM ({_CHECK_NAMES}) UNION ALL SELECT * FROM ({_CHECK_B})
UNION ALL SELECT * FROM ({_CHECK_C}) UNION ALL SELECT * FROM ({_CHECK_D})"""


@query("check_summary", f"""
SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
 count(*) AS total, count(*) FILTER (severity = 'error') = 0 AS ok FROM ({_ALL})""")
def check_summary(spark, folder):
    return report.summarize(_all_checks(spark, folder))


@query("check_counts", f"""SELECT "check", severity, count(*) AS n FROM ({_ALL}) GROUP BY 1, 2""")
def check_counts(spark, folder):
    return report.summarize_by_check(_all_checks(spark, folder))


@query("report_lines", f"""
SELECT file, line, (CASE WHEN severity = 'error' THEN '❌' ELSE '⚠️' END) || ' [' || "check" || '] ' ||
 (CASE WHEN line > 0 THEN file || ':' || line ELSE file END) || '  ' || message AS rendered FROM ({_ALL})""")
def report_lines(spark, folder):
    return report.render_text(_all_checks(spark, folder))


@query("report_json", f"""
SELECT '{{"check":"' || "check" || '","severity":"' || severity || '","file":"' || file || '","line":' || line ||
 ',"message":"' || message || '"}}' AS json FROM ({_CHECK_A})""")
def report_json(spark, folder):
    return report.render_json(_check_a(spark, folder))


@query("resolved_references", f"""
SELECT 'skills/order/' || o_orderkey || '.md' AS path, 7 AS line, 0 AS seq, 'Priority ' || o_orderpriority AS heading,
 'skills/order/' || o_orderkey || '.md' AS target FROM orders
UNION ALL
SELECT 'skills/order/' || o_orderkey || '.md', 10, 0, 'Segment ' || {_SEGMENT},
 'books/customer/c' || o_custkey || '.md' FROM orders""")
def resolved_references(spark, folder):
    return facts.resolved_refs(corpus.order_docs(spark, folder), corpus.HOME, corpus.REPO)


@query("document_headings", f"""
SELECT 'skills/order/' || o_orderkey || '.md' AS path, 5 AS line, 1 AS level, 'Order ' || o_orderkey AS heading FROM orders
UNION ALL SELECT 'skills/order/' || o_orderkey || '.md', 6, 2, 'Priority ' || o_orderpriority || ' ({{DATE}})' FROM orders
UNION ALL SELECT 'skills/order/' || o_orderkey || '.md', 20 + {_EXTRA}, 2, 'Seen on {{DATE}}' FROM orders""")
def document_headings(spark, folder):
    return facts.headings(corpus.order_docs(spark, folder))


def _yearbook(spark, folder, later: bool):
    """A page per customer and, later on, per supplier: customers in debt are rewritten then, solvent machine builders are gone."""
    customers = table(spark, folder, "customer")
    debt = F.col("c_acctbal") < 0
    state = F.when(debt & F.lit(later), F.lit("## In debt")).otherwise(F.concat(F.lit("## Segment "), "c_mktsegment"))
    if later:
        customers = customers.filter(debt | (F.col("c_mktsegment") != "MACHINERY"))
    pages = corpus.render(customers, corpus.say("year/c{}.md", "c_custkey"), corpus.lines(corpus.say("# Customer {}", "c_custkey"), state, "text"))
    if later:
        pages = pages.unionByName(corpus.render(
            table(spark, folder, "supplier"), corpus.say("year/s{}.md", "s_suppkey"), corpus.lines(corpus.say("# Supplier {}", "s_suppkey"), "nothing else")))
    return pages


def _two_years(spark, folder):
    root = work_folder(spark, "facts")
    incremental.refresh_facts(_yearbook(spark, folder, False), facts.headings, root, 1)
    return root, incremental.refresh_facts(_yearbook(spark, folder, True), facts.headings, root, 2)


@query("facts_incremental", """
WITH c AS (SELECT * FROM customer WHERE c_acctbal < 0 OR c_mktsegment <> 'MACHINERY')
SELECT 'year/c' || c_custkey || '.md' AS path, 1 AS line, 1 AS level, 'Customer ' || c_custkey AS heading FROM c
UNION ALL SELECT 'year/c' || c_custkey || '.md', 2, 2, CASE WHEN c_acctbal < 0 THEN 'In debt' ELSE 'Segment ' || c_mktsegment END FROM c
UNION ALL SELECT 'year/s' || s_suppkey || '.md', 1, 1, 'Supplier ' || s_suppkey FROM supplier""")
def facts_incremental(spark, folder):
    """Headings after pages came, changed and went: the same as those of a whole run."""
    return _two_years(spark, folder)[1]


@query("facts_incremental_work", """
SELECT 'year/c' || c_custkey || '.md' AS path FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'year/s' || s_suppkey || '.md' FROM supplier""")
def facts_incremental_work(spark, folder):
    """Which pages the second run extracted."""
    return spark.read.parquet(f"{_two_years(spark, folder)[0]}/facts/version=2").select("path").distinct()


@query("lint_headings", f"""
SELECT 'skills/order/' || o_orderkey || '.md' AS path, 'Priority ' || o_orderpriority AS heading FROM orders
UNION ALL SELECT 'skills/order/' || o_orderkey || '.md', 'Seen on ' || {_DAY} FROM orders""")
def lint_headings(spark, folder):
    return facts.lint_headings(corpus.order_docs(spark, folder))


@query("document_profiles", f"""
SELECT 'skills/order/' || o_orderkey || '.md' AS path,
 'Order ' || o_orderkey || ';Priority ' || o_orderpriority || ' (' || {_DAY} || ');Seen on ' || {_DAY} AS headings,
 'name;status' AS frontmatter_keys,
 'CR-' || o_orderkey || ';SP-' || o_orderkey || '-001;UR-' || o_custkey AS ids,
 CASE WHEN o_orderstatus = 'P' THEN '{{STATUS_P}}' ELSE '' END AS unreplaced_tokens,
 3 + {_EXTRA} AS table_row_count, 1 AS mermaid_count FROM orders""")
def document_profiles(spark, folder):
    joined = [F.array_join(c, ";").alias(c) for c in ("headings", "frontmatter_keys", "ids", "unreplaced_tokens")]
    return structure.document_profiles(corpus.order_docs(spark, folder)).select(
        "path", *joined, "table_row_count", "mermaid_count"
    )


def _order_sets(spark, folder):
    """The order corpus, one document set per status."""
    return corpus.order_docs(spark, folder).withColumn(
        "doc_set", M.frontmatter_map(lines_of("text"))["status"]
    )


_ORDER_FACTS = """
SELECT DISTINCT o_orderstatus AS doc_set, unnest(['heading', 'heading', 'heading', 'frontmatter_key', 'frontmatter_key', 'id', 'id', 'id']) AS kind,
 unnest(['Order ' || o_orderkey, 'Priority ' || o_orderpriority || ' ({DATE})', 'Seen on {DATE}', 'name', 'status',
  'CR-' || o_orderkey, 'SP-' || o_orderkey || '-001', 'UR-' || o_custkey]) AS value FROM orders
UNION ALL SELECT DISTINCT o_orderstatus, 'unreplaced_token', '{STATUS_P}' FROM orders WHERE o_orderstatus = 'P'"""


@query("set_facts", _ORDER_FACTS)
def set_facts(spark, folder):
    return structure.set_facts(_order_sets(spark, folder))


@query("set_counts", f"""
SELECT o_orderstatus AS doc_set, count(*) AS files, sum(3 + {_EXTRA})::BIGINT AS table_row_count, count(*) AS mermaid_count
FROM orders GROUP BY 1""")
def set_counts(spark, folder):
    return structure.set_counts(_order_sets(spark, folder))


def _golden(spark, folder):
    """Golden of every set but one: what customers with orders of the year 1997 on promise.

    Ids come from the customers, so ids of customers without an order in the set are
    missing from the actual text; one required heading exists, the other does not.
    """
    sets = F.explode(F.array(F.lit("O"), F.lit("P"))).alias("doc_set")
    ids = table(spark, folder, "customer").select(sets, F.lit("id").alias("kind"), F.concat(F.lit("UR-"), F.col("c_custkey").cast("string")).alias("value"))
    fixed = table(spark, folder, "orders").select(
        F.explode(F.array(
            F.struct(F.lit("required_heading").alias("kind"), F.lit("Seen on {DATE}").alias("value")),
            F.struct(F.lit("required_heading").alias("kind"), F.lit("Sign-off").alias("value")),
            F.struct(F.lit("frontmatter_key").alias("kind"), F.lit("owner").alias("value")),
        )).alias("f"), F.col("o_orderstatus").alias("doc_set"),
    ).filter("doc_set <> 'F'").select("doc_set", "f.kind", "f.value").distinct()
    return ids.unionByName(fixed)


_GOLDEN_CTE = f"""WITH actual AS MATERIALIZED ({_ORDER_FACTS}),
golden AS MATERIALIZED (SELECT s AS doc_set, 'id' AS kind, 'UR-' || c_custkey AS value FROM customer, unnest(['O', 'P']) AS u(s)
 UNION ALL SELECT DISTINCT o_orderstatus, unnest(['required_heading', 'required_heading', 'frontmatter_key']),
  unnest(['Seen on {{DATE}}', 'Sign-off', 'owner']) FROM orders WHERE o_orderstatus <> 'F')"""


@query("golden_violations", f"""{_GOLDEN_CTE}
, expected AS (SELECT *, replace(kind, 'required_', '') AS actual_kind FROM golden)
SELECT g.doc_set, 'missing_' || g.kind AS kind, g.value FROM expected g
 LEFT JOIN actual a ON a.doc_set = g.doc_set AND a.value = g.value AND a.kind = g.actual_kind WHERE a.value IS NULL
UNION ALL SELECT doc_set, kind, value FROM actual WHERE kind = 'unreplaced_token' AND doc_set IN (SELECT doc_set FROM golden)""")
def golden_violations(spark, folder):
    return structure.compare_with_golden(structure.set_facts(_order_sets(spark, folder)), _golden(spark, folder))


@query("golden_missing", f"{_GOLDEN_CTE} SELECT DISTINCT doc_set FROM actual WHERE doc_set NOT IN (SELECT doc_set FROM golden)")
def golden_missing(spark, folder):
    return structure.without_golden(_order_sets(spark, folder), _golden(spark, folder))


@query("golden_refresh", f"""{_GOLDEN_CTE}
SELECT doc_set, kind, value FROM golden WHERE kind = 'required_heading'
UNION ALL SELECT doc_set, kind, value FROM actual""")
def golden_refresh(spark, folder):
    return structure.refresh_golden(_golden(spark, folder), structure.set_facts(_order_sets(spark, folder)))


@query("agent_inputs", """
SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'archive' ELSE 'books' END || '/customer/c' || c_custkey || '.md' AS path,
 unnest(['AMOUNT', 'STATUS_O', 'STATUS_F', 'CURRENCY', 'RUSH']) AS key,
 unnest([false, false, false, true, true]) AS is_optional
FROM customer WHERE c_acctbal >= 0""")
def agent_inputs(spark, folder):
    return facts.agent_inputs(corpus.customer_docs(spark, folder))


@query("agent_definitions", """
SELECT 'c' || c_custkey AS agent, CASE WHEN c_mktsegment = 'FURNITURE' THEN c_name ELSE 'c' || c_custkey END AS name,
 c_acctbal >= 0 AS has_section,
 CASE WHEN c_acctbal >= 0 THEN 'AMOUNT,CURRENCY,IGNORED_KEY,NOT_AN_INPUT,RUSH,STATUS_F,STATUS_O' ELSE '' END AS tokens
FROM customer""")
def agent_definitions(spark, folder):
    return facts.agent_definitions(corpus.customer_docs(spark, folder)).select(
        "agent", "name", "has_section", F.array_join("tokens", ",").alias("tokens")
    )


@query("call_payloads", """
SELECT 'skills/order/' || o_orderkey || '.md' AS path, 11 AS line, 'c' || o_custkey AS agent, true AS parsed,
 'AMOUNT,STATUS_' || o_orderstatus AS passed_required, 'RUSH' AS passed_optional FROM orders""")
def call_payloads(spark, folder):
    return facts.agent_calls(corpus.order_docs(spark, folder)).select(
        "path", "line", "agent", "parsed",
        F.array_join("passed_required", ",").alias("passed_required"),
        F.array_join("passed_optional", ",").alias("passed_optional"),
    )


@query("script_calls", """
SELECT 'skills/run/' || event_id || '.md' AS path, 1 AS line, 0 AS seq, event_type || '.py' AS script,
 'u' || user_id AS subcommand, '--k' || json_extract_string(props, '$.k') || ',--amount' AS flags FROM events""")
def script_calls(spark, folder):
    return facts.script_calls(corpus.run_docs(spark, folder)).withColumn("flags", F.array_join("flags", ","))


@query("placeholder_tokens", """
SELECT 'skills/part/templates/' || p_partkey || '.md' AS path, true AS template, unnest(['P_' || p_partkey, 'DB']) AS token FROM part
UNION ALL SELECT 'skills/return/' || l_orderkey || '-' || l_linenumber || '.md', false, 'P_' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45""")
def placeholder_tokens(spark, folder):
    return facts.placeholder_tokens(corpus.template_docs(spark, folder))


@query("frontmatter_values", """
SELECT 'skills/order/' || o_orderkey || '.md' AS path, unnest(['name', 'status']) AS key,
 unnest([o_orderkey::VARCHAR, o_orderstatus]) AS value FROM orders""")
def frontmatter_values(spark, folder):
    return corpus.order_docs(spark, folder).select(
        "path", F.explode(M.frontmatter_map(lines_of("text"))).alias("key", "value")
    )


@query("frontmatter_missing", """
SELECT 'skills/order/' || o_orderkey || '.md' AS path, 'module' AS key FROM orders""")
def frontmatter_missing(spark, folder):
    return lint.missing_frontmatter(corpus.order_docs(spark, folder), ["name", "status", "module"])


@query("frontmatter_upsert", """
SELECT 'skills/order/' || o_orderkey || '.md' AS path, 'name;status' AS keys, 'v-' || o_orderpriority AS name_value,
 'name;status;model' AS keys_added FROM orders""")
def frontmatter_upsert(spark, folder):
    docs = corpus.order_docs(spark, folder).withColumn("priority", F.regexp_extract("text", r"## Priority ([^(]+) \(", 1))
    replaced = M.set_frontmatter_value("text", "name", F.concat(F.lit("v-"), F.col("priority")))
    added = M.set_frontmatter_value("text", "model", F.lit("m"))

    def keys(text):
        return F.array_join(F.transform(M.frontmatter_lines(lines_of(text)), lambda x: F.split_part(x, F.lit(":"), F.lit(1))), ";")

    return docs.select("path", replaced.alias("r"), added.alias("a")).select(
        "path", keys("r").alias("keys"), M.frontmatter_map(lines_of("r"))["name"].alias("name_value"), keys("a").alias("keys_added")
    )


@query("table_cells", """
SELECT 'skills/order/' || o_orderkey || '.md' AS path, 17 AS table_line, 19 AS line,
 'CR-' || o_orderkey || ',UR-' || o_custkey || ',SP-' || o_orderkey || '-001.002' AS cells FROM orders
UNION ALL SELECT 'skills/order/' || o_orderkey || '.md', 17, 20, 'open,{STATUS_P}' FROM orders WHERE o_orderstatus = 'P'""")
def table_cells(spark, folder):
    rows = facts.tables(corpus.order_docs(spark, folder))
    return rows.filter("line > table_line and not is_separator").select(
        "path", "table_line", "line", F.array_join("cells", ",").alias("cells")
    )


@query("table_column_errors", """
SELECT 'skills/order/' || o_orderkey || '.md' AS path, 20 AS line, 3 AS expected, 2 AS found FROM orders WHERE o_orderstatus = 'P'""")
def table_column_errors(spark, folder):
    return facts.table_column_errors(facts.tables(corpus.order_docs(spark, folder)))


@query("diagram_edges", f"""
SELECT 'skills/order/' || o_orderkey || '.md' AS path, 23 + {_EXTRA} AS line, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders""")
def diagram_edges(spark, folder):
    return facts.mermaid_edges(corpus.order_docs(spark, folder))


@query("diagram_errors", """
SELECT 'skills/order/' || o_orderkey || '.md' AS path, 24 AS line, '  o' || o_orderkey || '[order --> done' AS text
FROM orders WHERE o_orderstatus = 'F'""")
def diagram_errors(spark, folder):
    return facts.mermaid_errors(corpus.order_docs(spark, folder))


@query("diagram_syntax", """
WITH d AS (SELECT 'diagrams/' || o_orderkey || '.md' AS path, o_orderpriority AS p, o_orderstatus AS s FROM orders)
SELECT path, 2 AS line, 'kind' AS fault FROM d WHERE p = '5-LOW' UNION ALL SELECT path, 3, 'open' FROM d WHERE p = '2-HIGH'
UNION ALL SELECT path, 5, CASE s WHEN 'F' THEN 'bracket' ELSE 'quote' END FROM d WHERE s <> 'O' UNION ALL SELECT path, 7, 'end' FROM d WHERE p = '3-MEDIUM'""")
def diagram_syntax(spark, folder):
    """Faults of diagrams: kinds, quotes, nesting of brackets and of subgraphs."""
    return facts.diagram_faults(corpus.diagram_docs(spark, folder)).select("path", "line", "fault")


@query("diagram_label_arrows", """
SELECT 'diagrams/' || o_orderkey || '.md' AS path, 4 AS line, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders""")
def diagram_label_arrows(spark, folder):
    """Edges of diagrams whose labels hold arrows and brackets."""
    return facts.mermaid_edges(corpus.diagram_docs(spark, folder))


@query("traceability_rows", """
SELECT 'req/' || o_orderkey || '.md' AS path, 'UR-' || o_custkey AS ur_id, 'SR-' || o_orderkey || '-001' AS sr_id,
 'SP-' || o_orderkey || '-' || n AS sp_id FROM orders, unnest(['001', '002']) AS u(n)""")
def traceability_rows(spark, folder):
    return trace.traceability_rows(facts.tables(corpus.requirement_docs(spark, folder))).drop("line")


_REQ = """WITH r AS (SELECT 'req/' || o_orderkey || '.md' AS path, o_orderstatus AS st, o_orderpriority AS pr,
 'CR-2026-' || o_custkey || '-' AS ns, o_orderkey AS k,
 (CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 1 ELSE 0 END) AS ax,
 (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS rs FROM orders)"""


@query("requirement_lint", f"""{_REQ}
SELECT 'group_name_form' AS rule, 'error' AS severity, path, 1 AS line, st AS subject FROM r WHERE st = 'P'
UNION ALL SELECT 'reason_required', 'error', path, 2, CASE WHEN pr = '4-NOT SPECIFIED' THEN 'UR-' || k ELSE ns || 'UR-' || k END FROM r WHERE pr = '5-LOW'
UNION ALL SELECT 'id_namespace', 'error', path, 2, 'UR-' || k FROM r WHERE pr = '4-NOT SPECIFIED'
UNION ALL SELECT 'division_axis', 'error', path, 2, ns || 'UR-' || k FROM r WHERE pr = '2-HIGH'
UNION ALL SELECT 'forced_two_layers', 'warning', path, 5 + ax, ns || 'SR-' || k || '-001' FROM r WHERE pr = '1-URGENT'
UNION ALL SELECT 'ambiguous_word', 'warning', path, 7 + ax + rs, ns || 'SP-' || k || '-001.001' FROM r WHERE st = 'O'
UNION ALL SELECT 'duplicate_spec_text', 'warning', path, 7 + ax + rs, ns || 'SP-' || k || '-001.001' FROM r WHERE st = 'F'
UNION ALL SELECT 'duplicate_spec_text', 'warning', path, 8 + ax + rs, ns || 'SP-' || k || '-001.002' FROM r WHERE st = 'F'
UNION ALL SELECT 'spec_group_has_spec', 'error', path, 8 + ax + rs, '＜later＞' FROM r WHERE st = 'P'""")
def requirement_lint(spark, folder):
    return lint.lint_requirements(corpus.requirement_docs(spark, folder))


@query("requirement_trails", f"""{_REQ}
SELECT path, 7 + ax + rs + n AS line, ns || 'SP-' || k || '-001.00' || (n + 1) AS sp_id,
 (CASE WHEN st = 'P' THEN st ELSE '＜' || st || '＞' END) || ' / ' ||
 (CASE WHEN pr = '4-NOT SPECIFIED' THEN 'UR-' || k ELSE ns || 'UR-' || k END) || ' / ＜' || pr || '＞ / ' ||
 ns || 'SR-' || k || '-001 / ＜terms＞' AS trail
FROM r, unnest([0, 1]) AS u(n) WHERE n = 0 OR st = 'F'""")
def requirement_trails(spark, folder):
    return lint.requirement_paths(lint.elements(corpus.requirement_docs(spark, folder)))


@query("degraded_note_missing", "SELECT 'skills/order/' || o_orderkey || '.md' AS path FROM orders WHERE o_orderstatus = 'P'")
def degraded_note_missing(spark, folder):
    return lint.missing_degraded_note(corpus.order_docs(spark, folder), source_prefix="{STATUS_P}", note="degraded mode")


@query("comment_lines", """
SELECT 'src/customer/' || c_custkey || '.py' AS path, 1 AS line FROM customer""")
def comment_lines(spark, folder):
    rows = facts.md_lines(corpus.source_files(spark, folder))
    return rows.filter(facts.is_comment_line("path", "text")).select("path", "line")


@query("flat_requirements", f"""{_REQ}
SELECT path, 1 AS line, CASE WHEN st = 'P' THEN st ELSE '＜' || st || '＞' END AS category, NULL AS sp, '' AS reason FROM r
UNION ALL SELECT path, 2, NULL, NULL, CASE WHEN pr = '5-LOW' THEN '' ELSE pr END FROM r
UNION ALL SELECT path, 4 + ax, NULL, NULL, '' FROM r
UNION ALL SELECT path, 5 + ax, NULL, NULL, CASE WHEN pr = '1-URGENT' THEN 'late' ELSE '' END FROM r
UNION ALL SELECT path, 6 + ax + rs, NULL, NULL, '' FROM r
UNION ALL SELECT path, 7 + ax + rs, NULL, ns || 'SP-' || k || '-001.001', '' FROM r
UNION ALL SELECT path, 8 + ax + rs, NULL, ns || 'SP-' || k || '-001.002', '' FROM r WHERE st = 'F'
UNION ALL SELECT path, 8 + ax + rs, NULL, NULL, '' FROM r WHERE st = 'P'""")
def flat_requirements(spark, folder):
    from ..sources.sinks import flat_requirements as flat

    return flat(lint.elements(corpus.requirement_docs(spark, folder))).select("path", "line", "category", "sp", "reason")


@query("hit_filter_audit", """
SELECT 'customer' AS kind, 'comment' AS reason, count(*) AS n FROM customer
UNION ALL SELECT 'customer', 'recorded', 3 * count(*) FROM customer UNION ALL SELECT 'order', 'recorded', 3 * count(*) FROM orders
UNION ALL SELECT 'invoice', 'recorded', 3 * count(*) FROM orders WHERE o_orderstatus = 'F'""")
def hit_filter_audit(spark, folder):
    """Comment lines are set aside with a reason, never silently dropped."""
    rows = facts.md_lines(corpus.source_files(spark, folder))
    reason = F.when(facts.is_comment_line("path", "text"), "comment").otherwise("recorded")
    return rows.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("kind"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("golden_json_round_trip", f"""
SELECT 'skills/order/' || o_orderkey || '.md' AS path,
 'Order ' || o_orderkey || ';Priority ' || o_orderpriority || ' (' || {_DAY} || ');Seen on ' || {_DAY} AS headings,
 'name;status' AS keys, 'CR-' || o_orderkey || ';SP-' || o_orderkey || '-001;UR-' || o_custkey AS ids, 3 + {_EXTRA} AS table_row_count FROM orders""")
def golden_json_round_trip(spark, folder):
    """Profiles written as JSON objects and read back, value by value."""
    from ..sources.files import GOLDEN_SCHEMA
    from ..sources.sinks import golden_json

    written = golden_json(structure.document_profiles(corpus.order_docs(spark, folder)))
    return written.select("path", F.from_json("json", GOLDEN_SCHEMA).alias("g")).select(
        "path", F.array_join("g.headings", ";").alias("headings"), F.array_join("g.frontmatter_keys", ";").alias("keys"),
        F.array_join("g.ids", ";").alias("ids"), "g.table_row_count",
    )


@query("artifact_folders", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'own/' || o_custkey WHEN o_orderpriority <> '5-LOW' THEN 'books/CR-*/' || o_orderpriority END AS folder FROM orders""")
def artifact_folders(spark, folder):
    """Folder by phase from the default table unless the row configures its own."""
    from ..sources.files import artifact_globs

    orders = table(spark, folder, "orders")
    folders = orders.select("o_orderpriority").distinct().select(
        F.col("o_orderpriority").alias("phase"), F.concat(F.lit("books/CR-*/"), F.col("o_orderpriority")).alias("pattern")
    ).filter("phase <> '5-LOW'")
    rows = orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("phase"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("own/"), F.col("o_custkey").cast("string"))).alias("own"),
    )
    return artifact_globs(rows, folders, "phase", "own").select("o_orderkey", "folder")
