"""Buckets, priorities, the log, numbers and scopes of walks; seeds under all their names."""
import pytest
from pyspark.sql import functions as F

from doctrellis.operators import discovery
from doctrellis.operators.walk import Walk, discover, numbered, walk_view


def chain(n=7):
    """Each function is called by the next one, in folders that alternate between near and far."""
    files = [("near/a/f0.py", "def f0():\n    return 1")]
    for i in range(1, n):
        files.append((f"{'near/a' if i % 3 else f'far/z{i}'}/f{i}.py", f"def f{i}():\n    return f{i - 1}()"))
    return files + [(f"other/o{i}.py", f"def o{i}():\n    return {i}") for i in range(40)]


@pytest.fixture(scope="module")
def index(spark):
    return discovery.code_index(spark.createDataFrame(chain(), "path string, text string"))


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([("f0",)], "symbol string")


@pytest.fixture(scope="module")
def plain(index, seeds):
    walk = discover(index, seeds, 5, 30, buckets=16)
    return walk


def confirmed(walk):
    return {(r.file, r.confidence) for r in walk["confirmed"].collect()}


def test_priorities_change_the_order_and_lose_nothing(spark, index, seeds, plain):
    walk = discover(index, seeds, 5, 30, priority="neighbours", buckets=4)
    assert confirmed(walk) == confirmed(plain) and len(confirmed(plain)) == 7
    assert {r.symbol for r in walk["deferred"].collect()} == {"f3", "f6"}
    far = {r.origin_file.split("/")[0] for r in walk["deferred"].collect()}
    assert far == {"far"}
    assert all(r.balanced for r in walk["counts"].collect())


def test_a_catalogue_rates_top_folders_and_others_are_high(spark, index, seeds, plain):
    catalogue = spark.createDataFrame([("near", "LOW"), ("unused", "HIGH")], "dir string, priority string")
    walk = discover(index, seeds, 5, 30, priority=catalogue, buckets=4)
    assert confirmed(walk) == confirmed(plain)
    assert {r.origin_file.split("/")[0] for r in walk["deferred"].collect()} == {"near"}


def test_a_pause_keeps_what_was_put_off(spark, tmp_path, index, plain):
    seeds = spark.createDataFrame([("f0",), ("f1",)], "symbol string")
    root = f"file://{tmp_path}/walk"
    paused = discover(index, seeds, 5, 2, priority="neighbours", buckets=4, root=root)
    waiting = {(r.symbol, r.priority) for r in paused["pending"].collect()}
    assert ("f3", "LOW") in waiting
    assert "- [ ] `f3` (put off)" in {r.line for r in walk_view(paused).collect()}
    whole = discover(index, seeds, 5, 30, priority="neighbours", buckets=4, root=root)
    assert confirmed(whole) == confirmed(plain)
    # what is dropped at a pause is never searched, put off or not
    root = f"file://{tmp_path}/dropped"
    paused = discover(index, seeds, 5, 2, priority="neighbours", buckets=4, root=root)
    ended = discover(index, seeds, 5, 30, priority="neighbours", buckets=4, root=root, dropped=paused["pending"])
    assert ended["hits"].filter("wave > 1").count() == 0 and ended["pending"].count() == 0


def test_late_waves_open_the_buckets_of_their_frontier(spark, tmp_path, index, seeds):
    root = f"file://{tmp_path}/walk"
    walk = discover(index, seeds, 5, 30, buckets=16, root=root)
    log = {r.waves: r for r in walk["log"].collect()}
    assert all(r.opened == 1 for n, r in log.items() if n)  # a symbol a wave
    store = Walk(index, root, 16).store
    schema = Walk(index, root, 16).tokens
    every = store.in_buckets("index", 0, list(range(16)), schema)
    some = store.in_buckets("index", 0, [3, 5], schema)
    rows = {b: every.filter(F.col("bucket") == b).count() for b in (3, 5)}
    some.write.format("noop").mode("overwrite").save()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert some.count() == sum(rows.values()) < every.count()
    assert {r.bucket for r in some.select("symbol", discovery.bucket_of("symbol", 16).alias("bucket")).distinct().collect()} <= {3, 5}


def test_the_log_tells_a_wave_that_lost_rows(spark, tmp_path, index, seeds, plain):
    root = f"file://{tmp_path}/walk"
    discover(index, seeds, 5, 4, root=root, buckets=4)
    walk = Walk(index, root, 4)
    assert walk.last().waves == 4
    hits = walk.store.wave("hits", 3)
    walk.store.write("hits", 3, spark.createDataFrame([], hits.schema))
    assert walk.last().waves == 3
    assert confirmed(discover(index, seeds, 5, 30, root=root)) == confirmed(plain)  # buckets as in the folder


def test_a_backend_that_is_not_there_is_said(index, seeds):
    walk = discover(index, seeds, 5, 2, backend="lsp", buckets=4)
    assert {(r.backend, r.warning) for r in walk["log"].filter("waves > 0").collect()} == {("index", "search backend lsp is not there; searched with index")}
    assert any("lsp" in r.line for r in walk_view(walk).collect())


def test_rows_and_commands_are_numbered(plain):
    rows = numbered(plain, segments=3).orderBy("wave").collect()
    assert len(rows) == plain["hits"].count() == len({r.row_id for r in rows})
    for wave in {r.wave for r in rows}:
        own = sorted((r for r in rows if r.wave == wave), key=lambda r: int(r.row_id.split("R")[1]))
        assert [r.row_id for r in own] == [f"W{wave}-R{k}" for k in range(1, len(own) + 1)]
        assert [(r.symbol, r.file, r.line) for r in own] == sorted((r.symbol, r.file, r.line) for r in own)
        assert {r.command_id for r in own} == {f"W{wave}-C1"}


def test_the_same_name_in_several_scopes_goes_to_the_hook(spark):
    files = spark.createDataFrame([
        ("a.py", "def one(value):\n    return value"), ("b.py", "def two(value):\n    return value"), ("c.py", "def run():\n    one(target)\n    two(target)\n    three(target)"),
        ("d.py", "def three(alone):\n    return alone"),
    ], "path string, text string")
    index, seeds, asked = discovery.code_index(files), spark.createDataFrame([("target",)], "symbol string"), []

    def resolve(rows):
        asked.extend((r.symbol, r.scope_file) for r in rows.collect())
        return rows.filter("scope_file = 'b.py'")

    walk = discover(index, seeds, 10, 2, resolve=resolve, buckets=4)
    found = {(r.symbol, r.scope_file) for r in walk["frontier"].filter("confidence = 'MEDIUM'").collect()}
    assert found == {("value", "b.py"), ("alone", "d.py")}
    assert set(asked) == {("value", "a.py"), ("value", "b.py")}
    again = discover(index, seeds, 10, 2, buckets=4)
    assert again["frontier"].filter("confidence = 'MEDIUM'").count() == 3


def test_names_that_seeds_go_by(spark):
    files = spark.createDataFrame([
        ("m/base.py", "class Base:\n    def run(self):\n        pass"),
        ("m/mid.py", "from m.base import Base as Root\nclass Mid(pkg.Root, Other, metaclass=Meta):\n    pass"),
        ("w/leaf.ts", "export class Leaf extends Mid<T> implements Shape, Named {\n}\ninterface Wide extends Shape, Tall {"),
        ("w/index.ts", "export { Leaf as Blatt, Other as Anders } from './leaf';"),
        ("w/text.md", "a class of its own extends nothing"),
    ], "path string, text string")
    links = discovery.symbol_links(files)
    pairs = {(r.src, r.dst) for r in links.filter("kind <> 'entry'").collect()}
    assert {("Base", "Root"), ("Root", "Mid"), ("Other", "Mid"), ("Shape", "Leaf"), ("Named", "Leaf"), ("Shape", "Wide"), ("Tall", "Wide"),
            ("Leaf", "Blatt"), ("Other", "Anders")} <= pairs and not any("Meta" in p for p in pairs)
    seeds = spark.createDataFrame([("m/base.py",), ("self.count",), ("Shape",)], "symbol string")
    got = {r.symbol: r.depth for r in discovery.expand_seeds(links, seeds).collect()}
    assert got == {"Base": 1, "run": 1, "Root": 2, "Mid": 3, "count": 0, "Shape": 0, "Leaf": 1, "Wide": 1, "Blatt": 2}


def test_nearest_definition(spark):
    text = "top = 1\nclass A:\n    x = 1\n\n    def f(self):\n        x = 2\n\n        def g():\n            x\n        return x\n    y = x\n\nx = 3"
    files = spark.createDataFrame([("a.py", text), ("b.py", "no x here")], "path string, text string")
    scopes = discovery.definition_scopes(files)
    assert {(r.name, r.start, r.end) for r in scopes.collect()} == {("A", 2, 12), ("f", 5, 10), ("g", 8, 9)}
    hits = spark.createDataFrame([("x", "a.py", n) for n in (3, 6, 9, 10, 11, 13)] + [("x", "b.py", 1)], "symbol string, file string, line int")
    got = {(r.file, r.line): (r.scope, r.scope_start) for r in discovery.in_scopes(hits, scopes).collect()}
    assert got == {("a.py", 3): ("A", 2), ("a.py", 6): ("f", 5), ("a.py", 9): ("g", 8), ("a.py", 10): ("f", 5), ("a.py", 11): ("A", 2), ("a.py", 13): (None, None), ("b.py", 1): (None, None)}


def test_large_frontiers_leave_most_of_the_index_out(spark):
    names = spark.range(0, 3000).selectExpr("'n' || id * 7 as symbol")
    rows = spark.range(0, 40000).selectExpr("'n' || id as symbol", "id")
    met = discovery.may_be_among(rows, names, "symbol")
    assert met.columns == ["symbol", "id"]
    assert met.filter("id % 7 = 0 and id < 21000").count() == 3000 and met.count() < 3100
    assert discovery.may_be_among(rows, names.filter("false"), "symbol").count() == 0


def test_index_is_written_without_a_sort(spark, tmp_path):
    store = discovery.WaveStore(spark, str(tmp_path), 4)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = spark.range(0, 1000).selectExpr("'s' || id % 50 as symbol", "id")
    store.write_in_place("index", 0, rows, "symbol")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert store.in_buckets("index", 0, [0, 1, 2, 3], rows.schema).count() == 1000
    one = spark.read.parquet(f"{tmp_path}/index/wave=0/bucket=1")
    ids = [[r.id for r in part] for part in one.rdd.glom().collect()]
    assert all(part == sorted(part) for part in ids) and len(ids) > 0
