"""Graph walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import dirname
from ..operators import discovery, walk
from ..session import cut_lineage
from . import corpus
from .registry import query, table


@query("bfs_waves", """
WITH RECURSIVE e AS (SELECT DISTINCT 'P' || l_partkey AS a, 'S' || l_suppkey AS b FROM lineitem),
g AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e),
w(node, depth) AS (SELECT 'S' || s_suppkey, 0 FROM supplier WHERE s_acctbal < 1000 UNION SELECT dst, depth + 1 FROM w JOIN g ON src = node WHERE depth < 4)
SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def bfs_waves(spark, folder):
    """Waves over the graph of parts and suppliers from suppliers with a low balance."""
    part = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    both = F.array(
        F.struct(part.alias("src"), supplier.alias("dst")), F.struct(supplier.alias("src"), part.alias("dst"))
    )
    edges = table(spark, folder, "lineitem").select(F.inline(both))
    seeds = table(spark, folder, "supplier").filter("s_acctbal < 1000").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))
    return discovery.reach(edges, seeds, max_depth=4)


@query("reachability", """
SELECT 'R' || r_regionkey AS node, 0 AS depth FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0
UNION ALL SELECT 'C' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0
UNION ALL SELECT 'O' || o_orderkey, 3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0
UNION ALL SELECT DISTINCT 'P' || l_partkey, 4 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0""")
def reachability(spark, folder):
    """Everything that depends, over any number of hops, on one region."""
    def tag(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    hops = [
        ("nation", "R", "n_regionkey", "N", "n_nationkey"), ("customer", "N", "c_nationkey", "C", "c_custkey"),
        ("orders", "C", "o_custkey", "O", "o_orderkey"), ("lineitem", "O", "l_orderkey", "P", "l_partkey"),
    ]
    edges = None
    for name, a, src, b, dst in hops:
        part = table(spark, folder, name).select(tag(a, src).alias("src"), tag(b, dst).alias("dst"))
        edges = part if edges is None else edges.unionByName(part)
    seeds = table(spark, folder, "region").filter("r_regionkey = 0").select(tag("R", "r_regionkey").alias("node"))
    return discovery.reach(edges, seeds)


# A priority is in a fifth of all order files, hundreds at the smallest scale: noisy.  A
# customer is in the files of its own orders, dozens at any scale: quiet.
_MAX_FILES = 100
_RICH = 9000
_BUCKETS = 8

# The walk from one priority and the rich customers, location by location.
_HITS = f"""WITH s AS (SELECT c_custkey AS c FROM customer WHERE c_acctbal > {_RICH}),
o AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus = 'F' AS f FROM orders WHERE o_custkey IN (SELECT c FROM s)),
m AS (SELECT DISTINCT c FROM o WHERE f),
p AS (SELECT 'src/order/' || o_orderkey || '.py' AS file, row_number() OVER (ORDER BY 'src/order/' || o_orderkey || '.py') AS n FROM orders WHERE o_orderpriority[1] = '1'),
h AS (
 SELECT 0 AS wave, 'customer_' || c AS symbol, 'src/customer/' || c || '.py' AS file, unnest([1, 2]) AS line, unnest(['comment', 'recorded']) AS reason, 'HIGH' AS confidence FROM s
 UNION ALL SELECT 0, 'customer_' || c, 'src/order/' || o || '.py', 3, 'recorded', 'HIGH' FROM o
 UNION ALL SELECT 0, 'customer_' || c, 'src/invoice/' || o || '.py', 3, 'recorded', 'HIGH' FROM o WHERE f
 UNION ALL SELECT 0, 'priority_1', file, 2, CASE WHEN n <= {{limit}} THEN 'recorded' ELSE 'noise-collapse' END, 'HIGH' FROM p
 UNION ALL SELECT 1, 'order_' || o, 'src/order/' || o || '.py', 1, 'recorded', 'HIGH' FROM o
 UNION ALL SELECT 1, 'order_' || o, 'src/invoice/' || o || '.py', 2, 'recorded', 'HIGH' FROM o WHERE f
 UNION ALL SELECT 1, 'invoice_' || o, 'src/invoice/' || o || '.py', 1, 'recorded', 'HIGH' FROM o WHERE f
 UNION ALL SELECT 2, 'net_' || o, 'src/invoice/' || o || '.py', unnest([2, 3]), 'dedup', 'HIGH' FROM o WHERE f
 UNION ALL SELECT 3, 'base_' || c, 'src/customer/' || c || '.py', unnest([2, 3]), unnest(['dedup', 'recorded']), 'MEDIUM' FROM m
 UNION ALL SELECT 4, 'rate_' || c, 'src/customer/' || c || '.py', unnest([3, 4]), unnest(['dedup', 'recorded']), 'HIGH' FROM m)"""
_COLLAPSED = _HITS.format(limit=_MAX_FILES)
_WHOLE = _HITS.format(limit=10**12)
_COUNTS = """count(*) AS raw, count(*) FILTER (reason = 'recorded') AS recorded, count(*) FILTER (reason = 'dedup') AS dedup,
 count(*) FILTER (reason = 'comment') AS filtered, count(*) FILTER (reason = 'noise-collapse') AS collapsed, true AS balanced FROM h"""
_CONFIRMED = "SELECT file, min(confidence) AS confidence FROM h WHERE reason IN ('recorded', 'noise-collapse') GROUP BY 1"


def _walk(spark, folder, collapse=True, max_waves=8, root=None, **options):
    index = discovery.code_index(corpus.source_files(spark, folder))
    rich = table(spark, folder, "customer").filter(F.col("c_acctbal") > _RICH).select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("symbol"))
    urgent = table(spark, folder, "orders").filter("o_orderpriority like '1%'").select(F.lit("priority_1").alias("symbol")).distinct()
    return walk.discover(index, rich.unionByName(urgent), max_files=_MAX_FILES, max_waves=max_waves, collapse=collapse, root=root, buckets=_BUCKETS, **options)


@query("discovery_confirmed", f"{_COLLAPSED} {_CONFIRMED}")
def discovery_confirmed(spark, folder):
    """Files a walk from one priority and some customers confirms as affected."""
    return _walk(spark, folder)["confirmed"]


@query("discovery_hits", f"{_COLLAPSED} SELECT wave, symbol, file, line, reason, confidence FROM h")
def discovery_hits(spark, folder):
    """Every location with the wave, the symbol and what became of it."""
    return _walk(spark, folder)["hits"].select("wave", "symbol", "file", "line", "reason", "confidence")


@query("discovery_hits_uncollapsed", f"{_WHOLE} SELECT wave, symbol, file, line, reason, confidence FROM h")
def discovery_hits_uncollapsed(spark, folder):
    """The same walk with all lines of noisy symbols recorded."""
    return _walk(spark, folder, collapse=False)["hits"].select("wave", "symbol", "file", "line", "reason", "confidence")


@query("discovery_frontier", f"""{_COLLAPSED}
SELECT DISTINCT wave, symbol, CASE WHEN confidence = 'MEDIUM' THEN file END AS scope_file, confidence FROM h""")
def discovery_frontier(spark, folder):
    """Symbols of all waves, certain ones and those of one file."""
    return _walk(spark, folder)["frontier"].select("wave", "symbol", "scope_file", "confidence")


@query("discovery_counts", f"{_COLLAPSED} SELECT wave, symbol, {_COUNTS} GROUP BY 1, 2")
def discovery_counts(spark, folder):
    """Counts of each search of each wave."""
    return _walk(spark, folder)["counts"]


@query("discovery_metrics", f"{_COLLAPSED} SELECT wave, {_COUNTS} GROUP BY 1")
def discovery_metrics(spark, folder):
    """Counts of each wave."""
    return _walk(spark, folder)["metrics"]


@query("discovery_resumed", f"{_COLLAPSED} {_CONFIRMED}")
def discovery_resumed(spark, folder):
    """The walk in three sittings on one folder."""
    root = discovery.work_folder(spark, "resumed")
    for waves in (1, 3, 8):
        found = _walk(spark, folder, max_waves=waves, root=root)
    return found["confirmed"]


@query("discovery_pending", f"""{_COLLAPSED}
SELECT symbol, 'paused' AS status FROM h WHERE wave = 2 GROUP BY 1""")
def discovery_pending(spark, folder):
    """What a walk of two waves leaves to be searched."""
    return discovery.close_pending(_walk(spark, folder, max_waves=2)["pending"], None, 1).select("symbol", "status")


@query("discovery_rows", f"""{_COLLAPSED},
c AS (SELECT *, CASE WHEN confidence = 'HIGH' THEN 1 ELSE dense_rank() OVER (PARTITION BY wave, confidence ORDER BY file)
  + (CASE WHEN wave IN (SELECT wave FROM h WHERE confidence = 'HIGH') THEN 1 ELSE 0 END) END AS command FROM h)
SELECT wave, symbol, file, line, 'W' || wave || '-C' || command AS command_id,
 'W' || wave || '-R' || row_number() OVER (PARTITION BY wave ORDER BY command, symbol, file, line) AS row_id FROM c""")
def discovery_rows(spark, folder):
    """Every location under the number of its row and of the command that found it."""
    return walk.numbered(_walk(spark, folder), segments=8).select("wave", "symbol", "file", "line", "command_id", "row_id")


@query("discovery_origins", f"""{_COLLAPSED}
SELECT DISTINCT 1 AS wave, symbol, 'customer_' || c AS origin, file AS origin_file, 3 AS origin_line FROM h
  JOIN (SELECT o, c FROM o) k ON symbol IN ('order_' || k.o, 'invoice_' || k.o) AND file = CASE WHEN symbol[1] = 'o' THEN 'src/order/' ELSE 'src/invoice/' END || k.o || '.py' WHERE wave = 1
UNION ALL SELECT 2, 'net_' || o, 'order_' || o, 'src/invoice/' || o || '.py', 2 FROM o WHERE f
UNION ALL SELECT 3, 'base_' || c, min('net_' || o), 'src/invoice/' || min('net_' || o)[5:] || '.py', 3 FROM o WHERE f GROUP BY c
UNION ALL SELECT 4, 'rate_' || c, 'base_' || c, 'src/customer/' || c || '.py', 3 FROM m""")
def discovery_origins(spark, folder):
    """Where each symbol of the walk came from: the first hit that led to it."""
    rows = _walk(spark, folder)["frontier"].filter("wave > 0")
    return rows.select("wave", "symbol", "origin", "origin_file", "origin_line")


_LOG = f"""{_COLLAPSED},
n AS (SELECT wave, count(DISTINCT symbol) AS n FROM h GROUP BY 1),
t AS (SELECT wave, count(*) AS raw, count(*) FILTER (reason = 'recorded') AS recorded, count(*) FILTER (reason = 'dedup') AS dedup,
 count(*) FILTER (reason = 'comment') AS filtered, count(*) FILTER (reason = 'noise-collapse') AS collapsed FROM h GROUP BY 1),
l AS (SELECT t.*, coalesce(n.n, 0) AS frontier FROM t LEFT JOIN n ON n.wave = t.wave + 1)"""


def _broken(hits):
    """A classification that leaves everything out."""
    return hits.filter("false").select("symbol", "file", "line", F.lit(True).alias("relevant"))


@query("discovery_log", f"{_LOG} SELECT wave, raw, recorded, dedup, filtered, collapsed, frontier FROM l")
def discovery_log(spark, folder):
    """The log of a walk that broke off inside a wave, and after one whose rows were lost in part."""
    root = discovery.work_folder(spark, "broken")
    _walk(spark, folder, max_waves=2, root=root)
    try:
        _walk(spark, folder, max_waves=3, root=root, classify=_broken)
        raise AssertionError("a wave without classes was committed")
    except ValueError:
        pass
    whole = _walk(spark, folder, max_waves=3, root=root)
    some = cut_lineage(whole["hits"].filter("wave = 2").drop("wave").filter("file < 'src/invoice/2'"))
    discovery.WaveStore(spark, root).write("hits", 2, some)  # the rest is gone
    log = _walk(spark, folder, root=root)["log"].filter("waves > 0")
    return log.select((F.col("waves") - 1).alias("wave"), "raw", "recorded", "dedup", "filtered", "collapsed", "frontier")


@query("discovery_view", f"""{_LOG}
SELECT 'wave' AS section, '' AS item, '- wave ' || wave || ': ' || raw || ' rows = ' || recorded || ' recorded + ' || dedup || ' known + ' || filtered
  || ' filtered + ' || collapsed || ' collapsed; next ' || frontier || ', put off 0' AS line FROM l WHERE wave < 2
UNION ALL SELECT DISTINCT 'pending', symbol, '- [ ] `' || symbol || '`' FROM h WHERE wave = 2
UNION ALL SELECT DISTINCT 'warning', '', '- search backend ctags is not there; searched with index' FROM l WHERE wave < 2""")
def discovery_view(spark, folder):
    """The readable state of a paused walk, whose backend was replaced."""
    view = walk.walk_view(_walk(spark, folder, max_waves=2, backend="ctags"))
    return view.select("section", "item", "line").distinct()


_REACHED = f"""WITH m AS (SELECT c_custkey AS c FROM customer WHERE c_acctbal > {_RICH} AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')),
o AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus = 'F' AS f FROM orders WHERE o_custkey IN (SELECT c FROM m))"""


def _from_invoices(spark, folder, priority):
    """A walk from the net amounts of rich customers' invoices."""
    rich = table(spark, folder, "customer").filter(F.col("c_acctbal") > _RICH).select(F.col("c_custkey").alias("o_custkey"))
    billed = table(spark, folder, "orders").filter("o_orderstatus = 'F'").join(rich, "o_custkey", "left_semi")
    seeds = billed.select(F.concat(F.lit("net_"), F.col("o_orderkey").cast("string")).alias("symbol"))
    index = discovery.code_index(corpus.source_files(spark, folder))
    return walk.discover(index, seeds, max_files=_MAX_FILES, max_waves=12, priority=priority, buckets=_BUCKETS)


_AFFECTED = f"""{_REACHED}
SELECT 'src/customer/' || c || '.py' AS file, 'HIGH' AS confidence FROM m
UNION ALL SELECT 'src/order/' || o || '.py', 'HIGH' FROM o UNION ALL SELECT 'src/invoice/' || o || '.py', 'HIGH' FROM o WHERE f"""


@query("discovery_by_priority", _AFFECTED)
def discovery_by_priority(spark, folder):
    """Files confirmed when far folders wait."""
    return _from_invoices(spark, folder, "neighbours")["confirmed"]


@query("discovery_without_priority", _AFFECTED)
def discovery_without_priority(spark, folder):
    """The same files when nothing waits."""
    return _from_invoices(spark, folder, None)["confirmed"]


@query("discovery_deferred", f"""{_REACHED}
SELECT 'customer_' || c AS symbol FROM m UNION ALL SELECT 'rate_' || c FROM m UNION ALL SELECT 'order_' || o FROM o""")
def discovery_deferred(spark, folder):
    """Symbols that waited: all that only files of customers and orders led to."""
    return _from_invoices(spark, folder, "neighbours")["deferred"].select("symbol").distinct()


@query("discovery_expanded", """
WITH RECURSIVE l AS (SELECT 'Region_' || n_regionkey AS src, 'Nation_' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'Nation_' || c_nationkey, 'Customer_' || c_custkey FROM customer
  UNION ALL SELECT 'Nation_' || s_nationkey, 'Supplier_' || s_suppkey FROM supplier
  UNION ALL SELECT 'Customer_' || c_custkey, 'Client_' || c_custkey FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'Client_' || c_custkey, 'Debtor_' || c_custkey FROM customer WHERE c_acctbal < 0),
e(symbol, depth) AS (SELECT 'Region_0', 0 UNION ALL SELECT 'total', 0 UNION ALL SELECT 'Nation_' || n_nationkey, 1 FROM nation WHERE n_nationkey = 3
  UNION SELECT dst, depth + 1 FROM e JOIN l ON src = symbol)
SELECT symbol, min(depth) AS depth FROM e GROUP BY 1""")
def discovery_expanded(spark, folder):
    """Symbols to start from: heirs of a region, the definitions of a file and an attribute, under all their names."""
    seeds = spark.createDataFrame([("Region_0",), ("src/model/nation_3.py",), ("self.total",)], "symbol string")
    return discovery.expand_seeds(discovery.symbol_links(corpus.class_files(spark, folder)), seeds)


@query("discovery_links", """
SELECT 'subclass' AS kind, count(*) AS links FROM (SELECT 1 FROM nation UNION ALL SELECT 1 FROM customer UNION ALL SELECT 1 FROM customer
  UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM supplier)
UNION ALL SELECT 'alias', 2 * count(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'entry', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + 4 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)""")
def discovery_links(spark, folder):
    """How many links of each kind the class files hold."""
    return discovery.symbol_links(corpus.class_files(spark, folder)).groupBy("kind").agg(F.count(F.lit(1)).alias("links"))


@query("discovery_scopes", """
SELECT 'limit_' || c_custkey AS symbol, 'src/model/customer_' || c_custkey || '.py' AS file, unnest([2, 5, 7, 9, 10]) AS line,
 unnest(['Customer_' || c_custkey, 'open', 'inner', 'close', NULL]) AS scope, unnest([1, 4, 6, 8, NULL]) AS scope_start FROM customer""")
def discovery_scopes(spark, folder):
    """The nearest definition around each use of a limit."""
    files = corpus.class_files(spark, folder)
    uses = discovery.code_index(files).tokens.filter(F.startswith("symbol", F.lit("limit_"))).select("symbol", "file", "line")
    return discovery.in_scopes(uses, discovery.definition_scopes(files))


@query("neighbor_priority", r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS dir, contains(url, 'utm_source') AS hit FROM pages),
c AS (SELECT DISTINCT dir FROM p WHERE hit)
SELECT page_id, CASE WHEN dir IN (SELECT dir FROM c) OR dir IN (SELECT regexp_replace(dir, '/[^/]*$', '') FROM c) OR regexp_replace(dir, '/[^/]*$', '') IN (SELECT dir FROM c)
 THEN 'HIGH' ELSE 'LOW' END AS priority FROM p""")
def neighbor_priority(spark, folder):
    """Pages near folders confirmed by a campaign link come first, the others are deferred."""
    pages = table(spark, folder, "pages").select(
        "page_id", dirname(F.regexp_replace("url", r"[?#].*$", "")).alias("dir"), F.contains("url", F.lit("utm_source")).alias("hit")
    )
    return discovery.with_priority(pages, pages.filter("hit").select("dir")).select("page_id", "priority")
