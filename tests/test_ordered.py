"""Plain and segmented scans agree with a hand-written reference on every scan kind."""
import random

import pytest
from pyspark.sql import functions as F

from doctrellis.operators import ordered as O


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(900):
        key = "hot" if rng.random() < 0.6 else rng.choice("abc")
        out.append((key, i, rng.choice([None, 1, 2, 3]), rng.choice(["x", "y"])))
    return out


def expected(rows):
    by_key = {}
    for key, i, v, w in rows:
        by_key.setdefault(key, []).append((i, v, w))
    result = {}
    for key, items in by_key.items():
        total, last = 0, None
        for pos, (i, v, w) in enumerate(items):
            before_total, before_last = total, last
            total += v or 0
            last = v if v is not None else last
            ahead = next((x[1] for x in items[pos:] if x[1] is not None), None)
            result[(key, i)] = (
                total, before_total, last, before_last, ahead, pos + 1,
                items[pos - 1][1] if pos else None,
                items[pos + 1][1] if pos + 1 < len(items) else None,
            )
    return result


@pytest.mark.parametrize("segments", [None, 9])
def test_scans(spark, rows, segments):
    df = spark.createDataFrame(rows, "k string, i int, v int, w string")
    got = O.ordered_scan(
        df, ["k"], ["i"],
        {
            "total": O.RunningSum(F.col("v")),
            "before": O.RunningSum(F.col("v"), inclusive=False),
            "last": O.LastValue(F.col("v")),
            "last_before": O.LastValue(F.col("v"), inclusive=False),
            "ahead": O.NextValue(F.col("v")),
            "n": O.RowNumber(),
            "lag": O.Previous(F.col("v")),
            "lead": O.Following(F.col("v")),
        },
        segments=segments,
    ).collect()
    assert {(r.k, r.i): (r.total, r.before, r["last"], r.last_before, r.ahead, r.n, r["lag"], r["lead"])
            for r in got} == expected(rows)


@pytest.mark.parametrize("segments", [None, 9])
def test_runs(spark, rows, segments):
    df = spark.createDataFrame(rows, "k string, i int, v int, w string")
    got = {(r.k, r.i): r.run_no for r in O.runs_of_equal(
        df, ["k"], ["i"], "w", segments=segments).collect()}
    state, want = {}, {}
    for key, i, _, w in rows:
        run, prev = state.get(key, (0, None))
        run += 1 if prev != w else 0
        state[key] = (run, w)
        want[(key, i)] = run
    assert got == want


@pytest.mark.parametrize("segments", [None, 9])
def test_until_first(spark, rows, segments):
    df = spark.createDataFrame(rows, "k string, i int, v int, w string")
    got = {(r.k, r.i): r.reached for r in O.until_first(
        df, ["k"], ["i"], (F.col("i") > 100) & (F.col("v") == 3),
        segments=segments).collect()}
    stopped, want = set(), {}
    for key, i, v, _ in rows:
        want[(key, i)] = key not in stopped
        if i > 100 and v == 3:
            stopped.add(key)
    assert got == want
