"""Whitening, vector search and source divergence against brute force."""
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest

from doctrellis.llm import queries, vector_search
from doctrellis.llm.divergence import source_divergence
from doctrellis.llm.jacobi_davidson import largest, minres
from doctrellis.llm.vector_search import Tree, bins, calibrated, directions, nearest
from doctrellis.llm.whitening import Centre, whitened

VECTORS = "vec_id long, embedding array<float>, label int, component int, rank int, score double, leaf string, member string"


def table(spark, rows, schema=VECTORS):
    """(id, vector) rows with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, v, 1, 2, 3, 0.5, "x", "y") for i, v in rows], schema)


def awkward(rng, d=6, n=40):
    """Vectors of ``d`` entries, with repeated rows and ids, nulls, zeros and other lengths among them."""
    rows = [(i, [float(x) for x in rng.standard_normal(d)]) for i in range(n)]
    rows += [rows[3], rows[3], (5, rows[7][1]), (None, rows[9][1]), (50, rows[10][1]), (100, [0.0] * d), (150, None), (200, []), (250, [1.0] * (d + 1)),
             (300, [1.0, None] + [0.0] * (d - 2)), (350, [float("nan")] * d), (400, [float("inf")] + [0.0] * (d - 1))]
    return rows


# ---- largest eigenpairs

@pytest.mark.parametrize("kind", ["flat", "falling", "ties", "rank", "nothing"])
def test_largest_eigenpairs(kind):
    rng, d = np.random.default_rng(5), 150
    x = rng.standard_normal((600, d))
    if kind == "falling":
        x *= np.linspace(1, 0.05, d)
    if kind == "rank":
        x = x[:9]
    v = {"ties": np.diag(np.repeat(np.arange(15.0), 10)), "nothing": np.zeros((d, d))}.get(kind, x.T @ x / len(x))
    asked = []

    def product(block):
        asked.append(block.shape[1])
        return v @ block

    values, vectors = largest(product, d, 12)
    want = np.linalg.eigvalsh(v)[::-1][:12]
    assert np.allclose(values, want, rtol=1e-13, atol=1e-13 * max(1, want[0]))
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * max(1, want[0])
    assert np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-13
    assert max(asked) < d / 2  # the matrix itself is never asked for


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    a = q * np.concatenate([np.linspace(-3, -1, 10), np.linspace(1, 4, 20)]) @ q.T
    b = rng.standard_normal((30, 4))
    assert np.abs(a @ minres(lambda x: a @ x, b, 60) - b).max() < 1e-9


# ---- whitening

def brute_whitened(rows, wanted=32):
    kept = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    d = Counter(len(v) for _, v in kept).most_common(1)[0][0]
    kept = [(i, v) for i, v in kept if len(v) == d]
    x = np.floor(64 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    few = min(wanted, int((e > 1e-9 * e[0]).sum()))
    return kept, ((n * x - s) ** 2).sum(axis=1), centred @ u[:, :few] / np.sqrt(e[:few]), e[:few] / e.sum()


def compare_whitened(spark, rows):
    kept, deviation, z, explained = brute_whitened(rows)
    got = whitened(table(spark, rows)).collect()
    assert len(got) == z.size and {r["n"] for r in got} == {len(kept)}
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    assert sorted(by) == list(range(1, z.shape[1] + 1))
    key = lambda i, w: (i is None, i or 0, round(abs(w), 7))
    for c, part in by.items():
        assert part[0]["explained"] == pytest.approx(explained[c - 1], rel=1e-9) and part[0]["identity_error"] < 1e-9
        want = sorted(((i, int(v), w) for (i, _), v, w in zip(kept, deviation, z[:, c - 1])), key=lambda x: key(x[0], x[2]))
        have = sorted(((r["vec_id"], r["deviation"], r["whitened"]) for r in part), key=lambda x: key(x[0], x[2]))
        assert [x[:2] for x in have] == [x[:2] for x in want]
        sign = np.sign(sum(a[2] * b[2] for a, b in zip(have, want)))
        assert np.allclose([x[2] for x in have], [sign * x[2] for x in want], atol=1e-8)


def test_whitening(spark):
    compare_whitened(spark, awkward(np.random.default_rng(2)))


def test_whitening_of_fewer_rows_than_dimensions(spark):
    rng = np.random.default_rng(3)
    compare_whitened(spark, [(i, [float(x) for x in rng.standard_normal(40)]) for i in range(7)])


def test_whitening_of_nothing_and_of_equal_vectors(spark):
    assert whitened(table(spark, [])).collect() == []
    assert whitened(table(spark, [(1, None), (2, [])])).collect() == []
    assert whitened(table(spark, [(i, [0.5, 0.25]) for i in range(4)])).collect() == []


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 5], [-(1 << 41), 7]])
    sums = [int(v) for v in x.sum(axis=0)]
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert Centre(3, sums).deviations(x) == want and max(want) > 1 << 63


def test_deviation_has_an_exact_form_where_a_long_ends(spark):
    rows = [(i, [float(2**36) * i, 1.0]) for i in range(3)]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").orderBy("vec_id").collect()
    xs = [[64 * 2**36 * i, 64] for i in range(3)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(x, (sum(c) for c in zip(*xs)))) for x in xs]
    assert [r["deviation"] for r in got] == [None if w >= 1 << 63 else w for w in want] and None in [r["deviation"] for r in got]
    assert [r["deviation_exact"] for r in got] == [Decimal(w) for w in want]


def test_whitening_of_the_table(spark, small):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare_whitened(spark, rows)
    assert queries.QUERIES["op11_whitening"](spark, small).count() == 32 * len(rows)


# ---- vector search

def brute_nearest(rows):
    kept = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    d = Counter(len(v) for _, v in kept).most_common(1)[0][0]
    kept = list(dict.fromkeys((i, tuple(np.float32(x).item() for x in v)) for i, v in kept if len(v) == d))
    out = []
    for i, v in kept:
        if i % 50 == 0:
            a = np.array(v)
            near = sorted((-(a * np.array(w)).sum() / np.sqrt((a * a).sum()) / np.sqrt((np.array(w) ** 2).sum()), j) for j, w in kept if (j, w) != (i, v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near[:5], 1)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12)


def test_nearest_vectors_with_awkward_rows(spark):
    rows = awkward(np.random.default_rng(7))
    same(found(nearest(table(spark, rows), recall=1.0, leaf=4)), brute_nearest(rows))


def test_nearest_vectors_when_most_rows_are_one_vector(spark):
    rng = np.random.default_rng(8)
    hot, other = [float(x) for x in rng.standard_normal(8)], [[float(x) for x in rng.standard_normal(8)] for _ in range(60)]
    rows = [(i, hot if i % 3 else other[i % 60]) for i in range(600, 0, -1)]
    same(found(nearest(table(spark, rows).repartition(5), recall=1.0, leaf=4)), brute_nearest(rows))


def test_nearest_vectors_in_small_bins_and_steps(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(5)]) for i in range(400)]
    for name, value in (("LEAST_BIN", 9), ("MOST_BIN", 9), ("CELLS", 50)):
        monkeypatch.setattr(vector_search, name, value)
    same(found(nearest(table(spark, rows), recall=1.0, leaf=20)), brute_nearest(rows))


def test_nearest_vectors_of_few_rows_and_of_none(spark):
    assert found(nearest(table(spark, []))) == []
    assert found(nearest(table(spark, [(1, [1.0, 2.0])]))) == []
    assert found(nearest(table(spark, [(50, [1.0, 2.0])]))) == []
    rows = [(50, [1.0, 2.0]), (51, [2.0, 1.0]), (52, [-1.0, 1.0])]
    same(found(nearest(table(spark, rows))), brute_nearest(rows))


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 2e-300]), (2, [1e300, -1e300]), (3, [1.0, 1.0])]
    got = found(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0))
    assert [x[2] for x in got] == [3, 1, 2] and np.allclose([x[3] for x in got], [1, 3 / np.sqrt(10), 0])


def test_recall_on_the_tables(spark):
    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
        want = {x[0]: set() for x in brute_nearest(rows[:0] or rows)} if folder.endswith("0.01") else None
        got = found(queries.QUERIES["op12_nearest_vectors"](spark, folder))
        x = np.array([v for _, v in rows], float)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        ids = np.array([i for i, _ in rows])
        q = np.flatnonzero(ids % 50 == 0)
        near = x[q] @ x.T
        near[np.arange(len(q)), q] = -9
        truth = {(int(ids[a]), int(ids[b])) for a, row in zip(q, np.argsort(-near, axis=1)[:, :5]) for b in row}
        assert len(got) == 5 * len(q) and (want is None or set(want) == {g[0] for g in got})
        assert len(truth & {(g[0], g[2]) for g in got}) >= 0.9 * len(truth)


def test_tree_visits_every_leaf_best_first_and_calibration_widens():
    rng = np.random.default_rng(4)
    x = directions(rng.standard_normal((500, 6)))
    tree = Tree(x, leaf=12, branches=4)
    leaves = tree.visits(x[0], tree.leaves)
    assert len(leaves) == len(set(leaves)) == tree.leaves and tree.visits(x[0], 3) == leaves[:3]
    place = tree.leaf_of(x)
    near = (x @ x.T).argsort(axis=1)[:, -4:-1]
    neighbours = [(q, int(place[m])) for q in range(50) for m in near[q]]
    assert calibrated(tree, x[:50], neighbours, 0.5) <= calibrated(tree, x[:50], neighbours, 0.9) <= calibrated(tree, x[:50], neighbours, 1.0) <= tree.leaves
    assert calibrated(tree, x[:50], [], 0.9) == 1


def test_bins_hold_no_more_than_their_size():
    first, many = bins({3: 5, 4: 4, 7: 25, 9: 1, 11: 10}, 10, 12)
    held = Counter()
    for leaf, rows in {3: 5, 4: 4, 9: 1, 11: 10}.items():
        assert many[leaf] == 1
        held[first[leaf]] += rows
    assert many[7] == 3 and held[first[3]] == 9 and first[4] == first[3]


# ---- source divergence

def brute_divergence(rows, ranks=200):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(fold))) for t, lang, source in rows]
    out = []
    for lang in {x[0] for x in words}:
        own = [x for x in words if x[0] == lang]
        documents = Counter(w for _, _, ws in own for w in set(ws))
        kept = sorted(w for w, n in documents.items() if n >= 3)
        of = {s: Counter(w for _, x, ws in own if x == s for w in ws if documents[w] >= 3) for s in {x[1] for x in own}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in of.items()}, share(sum(of.values(), Counter()))
        order = lambda x: (-x[1], x[0].encode())
        for s in of:
            pairs = sorted(((o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in of if o != s), key=order)
            terms = sorted(((w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if of[s][w] and p[s][w] > q[w]), key=order)
            out += [(lang, s, "pair", o, v, k) for k, (o, v) in enumerate(pairs, 1)]
            out += [(lang, s, "term", w, v, k) for k, (w, v) in enumerate(terms[:ranks], 1)]
    return sorted(out)


def divergence_rows():
    rng = np.random.default_rng(11)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "äßxyz語"] + ["Tea", "TEA", "I'm", "É"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 60)).tolist()), ["en", "de", None, ""][rng.integers(4)], [f"s{k}" for k in range(7)][rng.integers(7)]) for _ in range(200)]
    rows += [(None, "en", "none"), ("", "fr", "a"), (" 1 2 3 ", "fr", "b"), ("only once here", "it", None), ("x " * 90_000, "en", "s1")]
    return rows + rows[:5]


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_divergence(spark):
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, 1, "t", 5) for r in rows], "text string, lang string, source string, n long, term string, value int")
    want = brute_divergence(rows)
    assert result(source_divergence(docs)) == want
    assert result(source_divergence(docs.repartition(7), sources=2, terms=9)) == want
    assert result(source_divergence(docs, ranks=5)) == brute_divergence(rows, 5)


def test_divergence_of_awkward_documents_and_of_none(spark, rows, nothing):
    plain = [(r["text"], r["lang"], r["source"]) for r in rows.collect()]
    assert result(source_divergence(rows)) == brute_divergence(plain)
    assert source_divergence(nothing).collect() == []
