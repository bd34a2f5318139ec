"""Graph walks against brute force; noise collapse must not change what is found."""
import random

import pytest
from pyspark.sql import functions as F

from doctrellis.operators import discovery
from doctrellis.operators.walk import discover


def test_reach_long_chain_and_cycle(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)] + [("n7", "n0"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("n0",)], "node string")
    assert {r.node: r.depth for r in discovery.reach(edges, seeds).collect()} == {f"n{i}": i for i in range(8)}
    assert {r.node for r in discovery.reach(edges, seeds, max_depth=2).collect()} == {"n0", "n1", "n2"}


def test_reverse_module_graph(spark):
    uses = [("m1", "m0"), ("m2", "m0"), ("m3", "m0"), ("m4", "m1"), ("m5", "m1")]
    edges = spark.createDataFrame([(b, a) for a, b in uses], "src string, dst string")
    got = {r.node: r.depth for r in discovery.reach(edges, spark.createDataFrame([("m0",)], "node string")).collect()}
    assert {n for n, d in got.items() if d == 1} == {"m1", "m2", "m3"}
    assert {n for n, d in got.items() if d == 2} == {"m4", "m5"}


def sources(spark):
    rng = random.Random(11)
    files = []
    for i in range(30):
        body = [f"def f{i}(p{i}):", f"    # mentions f{rng.randrange(30)}", f"    v{i} = f{rng.randrange(30)}(p{i})"]
        if rng.random() < 0.6:
            body.append("    noisy(1)")
        files.append((f"src/d{i % 3}/m{i}.py", "\n".join(body)))
    files.append(("src/d0/noisy.py", "def noisy(level):\n    return level"))
    return spark.createDataFrame(files, "path string, text string"), files


@pytest.mark.parametrize("seed", ["f3", "noisy"])
def test_collapse_is_equivalent(spark, seed):
    files, _ = sources(spark)
    index = discovery.code_index(files)
    seeds = spark.createDataFrame([(seed,)], "symbol string")
    runs = [discover(index, seeds, max_files=5, max_waves=8, collapse=c) for c in (True, False)]
    confirmed = [{(r.file, r.confidence) for r in run["confirmed"].collect()} for run in runs]
    frontier = [{(r.wave, r.symbol, r.scope_file, r.confidence) for r in run["frontier"].collect()} for run in runs]
    assert confirmed[0] == confirmed[1] and frontier[0] == frontier[1] and confirmed[0]
    for run in runs:
        assert all(r.balanced for r in run["counts"].collect())
    hits = [{(r.symbol, r.file, r.line) for r in run["hits"].filter("reason <> 'dedup'").collect()} for run in runs]
    assert hits[0] == hits[1]
    if seed == "noisy":
        assert runs[0]["counts"].filter("collapsed > 0").count() == 1 and runs[1]["counts"].filter("collapsed > 0").count() == 0
        assert runs[0]["frontier"].filter("wave > 0").count() == 0  # a noisy symbol does not propagate


def test_propagation_rules(spark):
    files = spark.createDataFrame([
        ("a.py", "def outer(x):\n    got = target(x)\n    callee(1, got)"),
        ("b.py", "def callee(first, second):\n    return second"),
        ("c.py", "def other():\n    second = 1  # same name elsewhere"),
        ("d.py", "# target only in a comment"),
    ], "path string, text string")
    run = discover(discovery.code_index(files), spark.createDataFrame([("target",)], "symbol string"), max_files=10, max_waves=5)
    frontier = {(r.symbol, r.scope_file, r.confidence) for r in run["frontier"].collect()}
    assert {("target", None, "HIGH"), ("outer", None, "HIGH"), ("got", None, "HIGH"), ("second", "b.py", "MEDIUM")} <= frontier
    assert {r.file for r in run["confirmed"].collect()} == {"a.py", "b.py"}
    assert {(r.file, r.reason) for r in run["hits"].filter("wave = 0").collect()} == {("a.py", "recorded"), ("d.py", "comment")}


def test_missing_class_stops_the_wave(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    return target")], "path string, text string")
    with pytest.raises(ValueError, match="without a class"):
        discover(
            discovery.code_index(files), spark.createDataFrame([("target",)], "symbol string"), 10, 3,
            classify=lambda hits: hits.filter("false").selectExpr("symbol", "file", "line", "true as relevant"),
        )


def test_irrelevant_hits_neither_confirm_nor_propagate(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    return target"), ("b.py", "def g():\n    return f()")], "path string, text string")
    run = discover(
        discovery.code_index(files), spark.createDataFrame([("target",)], "symbol string"), 10, 3,
        classify=lambda hits: hits.selectExpr("symbol", "file", "line", "false as relevant"),
    )
    assert run["confirmed"].count() == 0 and run["frontier"].count() == 1


def test_no_seed_finds_nothing(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    return 1")], "path string, text string")
    run = discover(discovery.code_index(files), spark.createDataFrame([], "symbol string"), 10, 3)
    assert run["hits"].count() == 0 and run["confirmed"].count() == 0


def test_priority(spark):
    dirs = spark.createDataFrame([("a/b",), ("a",), ("a/b/c",), ("a/x",), ("z",), ("a/b/c/d",)], "dir string")
    got = {r.dir: r.priority for r in discovery.with_priority(dirs, spark.createDataFrame([("a/b",)], "dir string")).collect()}
    assert got == {"a/b": "HIGH", "a": "HIGH", "a/b/c": "HIGH", "a/x": "LOW", "z": "LOW", "a/b/c/d": "LOW"}


def test_depth_cap_pauses(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    return target"), ("b.py", "def g():\n    return f()")], "path string, text string")
    run = discover(discovery.code_index(files), spark.createDataFrame([("target",)], "symbol string"), 10, max_waves=1)
    assert {r.symbol for r in run["pending"].collect()} == {"f"}
    assert {r.status for r in discovery.close_pending(run["pending"], None, 1).collect()} == {"paused"}
    assert {r.status for r in discovery.close_pending(run["pending"], "prune", 2).collect()} == {"record"}


def test_two_symbols_on_a_line_of_a_noisy_one(spark):
    """A location that a noisy symbol met first still propagates the other symbol on it."""
    files = [("a.py", "def late():\n    return 1"), ("b.py", "def start():\n    keep = noisy(late())"), ("z.py", "def zed():\n    return late() + start()")]
    files += [(f"n{i}.py", f"def n{i}():\n    return noisy({i})") for i in range(9)]
    index = discovery.code_index(spark.createDataFrame(files, "path string, text string"))
    seeds = spark.createDataFrame([("noisy",), ("a",)], "symbol string").union(spark.createDataFrame([("return",)], "symbol string").filter("false"))
    runs = [discover(index, seeds.union(spark.createDataFrame([("late",)], "symbol string")), 3, 6, collapse=c) for c in (True, False)]
    frontier = [{(r.wave, r.symbol) for r in run["frontier"].collect()} for run in runs]
    assert frontier[0] == frontier[1] and {"keep", "zed", "start"} <= {s for _, s in frontier[0]}


def test_calls_inside_calls_and_strings(spark):
    text = """    got = f(g(x, h(w)), y, 'a,b', z) + k("q(1)", v)"""
    got = spark.createDataFrame([(text,)], "text string").select(discovery.calls_of(F.col("text")).alias("c")).first().c
    assert [c.replace(" ", "") for c in got] == ["h(w)", "k('',v)", "g(x,hw)", "f(gxhw,y,'',z)"]
    files = spark.createDataFrame([("m.py", "def f(p, q, r, s):\n    return q"), ("n.py", f"def run():\n{text}")], "path string, text string")
    run = discover(discovery.code_index(files), spark.createDataFrame([("w",), ("y",), ("z",)], "symbol string"), 10, 2)
    found = {(r.symbol, r.scope_file, r.confidence) for r in run["frontier"].filter("wave = 1").collect()}
    assert found == {("run", None, "HIGH"), ("got", None, "HIGH"), ("p", "m.py", "MEDIUM"), ("q", "m.py", "MEDIUM"), ("s", "m.py", "MEDIUM")}


def test_common_callee_names_stay_linear(spark):
    files = spark.createDataFrame([(f"d{i}.py", "def run(a):\n    return a") for i in range(60)] + [(f"c{i}.py", f"def c{i}():\n    run(v{i})") for i in range(60)], "path string, text string")
    index = discovery.code_index(files)
    assert index.tokens.filter("symbol like 'v%'").count() == 60 and index.formals.count() == 60


def test_resumed_walk_is_the_whole_walk(spark, tmp_path):
    files, _ = sources(spark)
    index, seeds = discovery.code_index(files), spark.createDataFrame([("f3",)], "symbol string")
    whole = discover(index, seeds, 5, 6)
    root = f"file://{tmp_path}/walk"
    for waves in (1, 2, 2, 6):
        part = discover(index, seeds, 5, waves, root=root)
    for name in ("hits", "frontier", "confirmed", "counts", "pending"):
        columns = [c for c in whole[name].columns if c not in ("derived", "passed")]
        assert sorted(map(str, part[name].select(columns).collect())) == sorted(map(str, whole[name].select(columns).collect()))
    # a wave that broke off before its state row counts for nothing and is done again
    half = f"file://{tmp_path}/half"
    discover(index, seeds, 5, 2, root=half)
    discovery.WaveStore(spark, half).write("hits", 2, whole["hits"].drop("wave").limit(3))
    discovery.WaveStore(spark, half).write("frontier", 3, whole["frontier"].drop("wave").limit(2))
    again = discover(index, seeds, 5, 6, root=half)
    assert sorted(map(str, again["confirmed"].collect())) == sorted(map(str, whole["confirmed"].collect()))
    assert sorted(map(str, again["frontier"].collect())) == sorted(map(str, whole["frontier"].collect()))
    # pruned symbols are not searched
    stop = f"file://{tmp_path}/stop"
    first = discover(index, seeds, 5, 1, root=stop)
    ended = discover(index, seeds, 5, 6, root=stop, dropped=first["pending"])
    assert ended["hits"].filter("wave > 0").count() == 0
