"""Nearest vectors by cosine from a hierarchical k-means tree.

*Tree.*  A bounded sample (``SAMPLE`` distinct vectors, those of the smallest hashes) is split
by k-means into ``BRANCHES`` parts, these again, down to leaves of at most ``LEAF`` sample
vectors.  Every row goes down the tree to its leaf.
*Search.*  A query goes through the tree best bin first: a priority queue holds nodes by the
cosine to their centre, the nearest one is opened, and leaves are visited in the order in
which they come out.  How many are visited is calibrated: for ``CALIBRATION`` of the queries
the true neighbours among all rows are found by comparing everything, and leaf visits widen
until ``RECALL`` of these neighbours lie in visited leaves.
*Work.*  Leaves are packed into bins of bounded size, a large leaf being cut over several by
hashes.  A query travels once to each bin in which it visits a leaf, streams past the bin's
members and keeps the best few of each bin; these are ranked over all bins.

Equal vectors need no more than ``K`` + 1 ids: tasks give on only the smallest ones that they
meet, and queries of equal vectors are searched once, so a vector that is a third of all rows
is no hot group.  Scores are computed per pair, always in the same order, from the original
vectors, so that equal vectors tie.

Rows with a null id, and vectors that are null, empty, zero, of another length than most have
(of several such lengths, the smallest), or with null or non-finite components take no part.
Rows alike in id and vector are one; different vectors under one id are rows of their own, and
only the query's own row is no candidate of it.  An empty table gives an empty table.  Only
``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Shared, mapped, written

K = 5
EVERY = 50  # queries are the ids divisible by this
SAMPLE, LEAF, BRANCHES = 50_000, 48, 12
CALIBRATION, RECALL = 300, 0.96
LEAST_BIN, MOST_BIN = 4096, 65_536  # rows of a bin
CELLS = 2_000_000  # scores held at once
SLACK = 1e-9  # between a score by matrix product and by pair
ROW = ["vec_id", "k1", "k2", "member", "vector"]
VECTORS = "vec_id long, k1 long, k2 long, member boolean, vector binary"
FOUND = "q1 long, q2 long, score double, vec_id long, k1 long, k2 long"


def taking_part(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, as far as one row shows."""
    kind = rows.schema["embedding"].dataType.elementType.typeName()
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return known.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


class Vectors:
    """Reads vectors of ``d`` entries of one kind as doubles."""

    def __init__(self, kind: str, d: int):
        self.kind, self.d = np.dtype(kind), d

    def __call__(self, column: pa.Array) -> np.ndarray:
        return self.of(b"".join(column.to_pylist()))

    def of(self, blob: bytes) -> np.ndarray:
        x = np.frombuffer(blob, self.kind).reshape(-1, self.d).astype(float)
        with np.errstate(over="ignore"):
            length = (x * x).sum(axis=1)
        odd = ~((length > 1e-200) & (length < 1e200))  # squares that ran over or under
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        return x


def placed_rows(rows: DataFrame, read: Vectors, tree) -> DataFrame:
    """(vec_id, k1, k2, member, vector, leaf) of vectors; (k1, k2) is a digest of the vector.

    Of equal vectors a task makes members of the ``K`` + 1 smallest ids that it has met so far
    only: no more are needed.  Queries stay, as members or not.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, values = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().astype(read.kind, copy=False)
            blob, width = values.tobytes(), read.d * read.kind.itemsize
            vectors = [blob[at:at + width] for at in range(0, len(blob), width)]
            keys = [hashlib.md5(v).digest() for v in vectors]
            state = np.zeros(len(ids), np.int8)  # 1 for a query only, 2 for a member
            for i, (id_, key) in enumerate(zip(ids.tolist(), keys)):
                smallest = met.setdefault(key, [])
                if -id_ in smallest:
                    continue
                if len(smallest) <= K:
                    heapq.heappush(smallest, -id_)
                elif id_ < -smallest[0]:
                    heapq.heapreplace(smallest, -id_)
                else:
                    state[i] = id_ % EVERY == 0
                    continue
                state[i] = 2
            if len(met) > 300_000:
                met.clear()
            own = np.flatnonzero(state)
            digest = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)[own]
            leaves = tree.value.leaf_of(directions(read.of(blob))[own])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[own]), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(state[own] == 2), pa.array([vectors[i] for i in own.tolist()], pa.binary()), pa.array(leaves),
            ], names=[*ROW, "leaf"])

    return mapped(rows, VECTORS + ", leaf long", work)


def directions(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, each pair by itself."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1)) / np.sqrt((b * b).sum(axis=1))


def k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """The part of each direction, by means of directions."""
    centres = points[rng.choice(len(points), k, replace=False)]
    part = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        before, part = part, (points @ centres.T).argmax(axis=1)
        if (before == part).all():
            break
        sums = np.stack([np.bincount(part, weights=column, minlength=k) for column in points.T], axis=1)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return part


class Tree:
    """Node 0 is the root; ``children`` has the first child and how many there are, 0 for a leaf."""

    def __init__(self, sample: np.ndarray, leaf: int = LEAF, branches: int = BRANCHES):
        points = directions(np.unique(sample, axis=0)) if len(sample) else sample
        rng = np.random.default_rng(0)
        centres, self.children, held = [np.zeros(points.shape[1])], [(0, 0)], [points]
        node = 0
        while node < len(held):
            own = held[node]
            if len(own) > leaf:
                part = k_means(own, min(branches, len(own)), rng)
                groups = [own[part == p] for p in np.unique(part)]
                if len(groups) > 1:
                    self.children[node] = (len(held), len(groups))
                    for g in groups:
                        mean = g.sum(axis=0)
                        length = np.sqrt(mean @ mean)
                        centres.append(mean / length if length > 0 else g[0])
                        self.children.append((0, 0))
                        held.append(g)
            held[node] = None
            node += 1
        self.centres = np.stack(centres)
        self.first, self.count = np.array(self.children).T
        self.leaves = int((self.count == 0).sum())

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf (a node's number) of each direction."""
        at = np.zeros(len(points), np.int64)
        open_ = np.arange(len(points)) if self.count[0] else np.zeros(0, np.int64)
        while len(open_):
            for node in np.unique(at[open_]).tolist():
                own = open_[at[open_] == node]
                first, count = self.children[node]
                at[own] = first + (points[own] @ self.centres[first:first + count].T).argmax(axis=1)
            open_ = open_[self.count[at[open_]] > 0]
        return at

    def visits(self, point: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves that a direction visits, best bin first."""
        queue, visited = [(0.0, 0)], []
        while queue and len(visited) < most:
            _, node = heapq.heappop(queue)
            first, count = self.children[node]
            if not count:
                visited.append(node)
                continue
            for i, near in enumerate((self.centres[first:first + count] @ point).tolist()):
                heapq.heappush(queue, (-near, first + i))
        return visited


def foremost(q: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the ``K`` + 1 best different rows (id, key) of each query; ties go to smaller ids."""
    order = np.lexsort((keys[:, 1], keys[:, 0], ids, -score, q))
    same = (q[order][1:] == q[order][:-1]) & (ids[order][1:] == ids[order][:-1]) & (keys[order][1:] == keys[order][:-1]).all(axis=1)
    order = order[np.append(True, ~same)] if len(order) else order
    q = q[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    return order[np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) <= K]


def best(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, keys: np.ndarray, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, score) of each query's ``K`` + 1 best different members.

    ``allowed`` lists (queries, slice of members) that are compared; without it, all are.
    """
    near = np.full((len(queries), len(members)), -2.0)
    own, other = directions(queries), directions(members)
    for rows, part in [(slice(None), slice(None))] if allowed is None else allowed:
        near[rows, part] = own[rows] @ other[part].T
    most = min(K + 1, len(members))
    limit = np.maximum(np.partition(near, -most, axis=1)[:, -most] - SLACK, -1.5)
    q, m = np.nonzero(near >= limit[:, None])
    score = scores(queries[q], members[m])
    kept = foremost(q, score, ids[m], keys[m])
    return q[kept], m[kept], score[kept]


def distinct_rows(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the different (id, key) rows."""
    return np.sort(np.unique(np.column_stack([ids, keys]), axis=0, return_index=True)[1])


def columns_of(batch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, keys) of rows whose first columns are vec_id, k1, k2."""
    return batch.column(0).to_numpy(), np.column_stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])


def true_neighbours(members: DataFrame, read: Vectors, chosen: list) -> list[tuple[int, int]]:
    """(number of a chosen query, leaf) of each of its true neighbours among all rows, by comparing with all."""
    sent = members.sparkSession.sparkContext.broadcast(b"".join(r["vector"] for r in chosen))  # CALIBRATION vectors

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = read.of(sent.value)
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, CELLS // len(queries))):
                part = batch.slice(at, max(1, CELLS // len(queries)))
                ids, keys = columns_of(part)
                own = distinct_rows(ids, keys)
                ids, keys, leaf = ids[own], keys[own], part.column(5).to_numpy()[own]
                q, m, score = best(queries, read(part.column(4).take(pa.array(own))), ids, keys)
                held = [np.concatenate(x) for x in zip(held, (q, score, ids[m], keys[m], leaf[m]))]
                kept = foremost(*held[:4])
                held = [x[kept] for x in held]
        q, score, ids, keys, leaf = held
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (q.astype(np.int32), score, ids, keys[:, 0], keys[:, 1], leaf)], names=["query", "score", "vec_id", "k1", "k2", "leaf"])

    found = mapped(members.select(*ROW, "leaf"), "query int, score double, vec_id long, k1 long, k2 long, leaf long", work).distinct()
    falling = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "k1", "k2")
    rows = found.withColumn("place", F.row_number().over(falling)).where(f"place <= {K + 1}").orderBy("query", "place").collect()  # bounded by CALIBRATION
    sent.destroy()
    out, taken = [], [0] * len(chosen)
    for r in rows:
        own = chosen[r["query"]]
        if (r["vec_id"], r["k1"], r["k2"]) != (own["vec_id"], own["k1"], own["k2"]) and taken[r["query"]] < K:
            taken[r["query"]] += 1
            out.append((r["query"], r["leaf"]))
    return out


def calibrated(tree: Tree, points: np.ndarray, neighbours: list[tuple[int, int]], recall: float) -> int:
    """Leaf visits that take in ``recall`` of the true neighbours, widened from one on."""
    if not neighbours:
        return 1
    places = [{leaf: i for i, leaf in enumerate(tree.visits(p, tree.leaves))} for p in points]
    after = np.sort([places[q][leaf] for q, leaf in neighbours])
    visits = 1
    while np.searchsorted(after, visits) < recall * len(after):
        visits += 1
    return visits


def bins(counts: dict[int, int], size: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, bins) of each leaf: leaves that are close in the tree fill a bin; a larger leaf has bins of its own."""
    first, many = np.zeros(nodes, np.int64), np.ones(nodes, np.int64)
    at = filled = 0
    for leaf in sorted(counts):
        if filled and filled + counts[leaf] > size:
            at, filled = at + 1, 0
        first[leaf], many[leaf] = at, -(-counts[leaf] // size)
        at, filled = at + int(many[leaf]) - 1, filled + counts[leaf]
    return first, many


def search_bins(members: DataFrame, queries: DataFrame, read: Vectors) -> DataFrame:
    """The best members of each query in each bin: a bin's members are held, queries stream past them."""
    names = ["vec_id", "k1", "k2", "leaf", "vector", "leaves", "bin", "kind"]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    both = members.select("vec_id", "k1", "k2", "leaf", "vector", none("leaves", "array<long>"), "bin", F.lit(0).alias("kind")).unionByName(
        queries.select(none("vec_id", "long"), "k1", "k2", none("leaf", "long"), "vector", "leaves", "bin", F.lit(1).alias("kind")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, whole = None, [], None
        for batch in batches:
            which = np.column_stack([batch.column(6).to_numpy(), batch.column(7).to_numpy()])
            edges = np.append(np.flatnonzero(np.append(True, (which[1:] != which[:-1]).any(axis=1))), len(which))
            for a, b in zip(edges, edges[1:]):
                if which[a, 0] != now:
                    now, held, whole = which[a, 0], [], None
                if not which[a, 1]:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    whole, held = loaded(held), []
                if whole is not None:
                    yield from matched(batch.slice(a, b - a), *whole)

    def loaded(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids, keys = columns_of(rows)
        leaf = rows.column("leaf").to_numpy()
        own = distinct_rows(ids, keys)
        own = own[np.argsort(leaf[own], kind="stable")]
        leaf = leaf[own]
        starts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        slices = {int(leaf[s]): slice(int(s), int(e)) for s, e in zip(starts, np.append(starts[1:], len(leaf)))}
        return read(rows.column("vector").take(pa.array(own))), ids[own], keys[own], slices

    def matched(part: pa.RecordBatch, vectors: np.ndarray, ids: np.ndarray, keys: np.ndarray, slices: dict[int, slice]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(ids))
        for at in range(0, part.num_rows, step):
            own = part.slice(at, step)
            rows: dict[int, list[int]] = {}
            for i, leaves in enumerate(own.column(5).to_pylist()):
                for leaf in leaves:
                    rows.setdefault(leaf, []).append(i)
            q, m, score = best(read(own.column(4)), vectors, ids, keys, [(np.array(r), slices[leaf]) for leaf, r in rows.items() if leaf in slices])
            yield pa.RecordBatch.from_arrays([
                own.column(1).take(pa.array(q)), own.column(2).take(pa.array(q)), pa.array(score), pa.array(ids[m]), pa.array(keys[m, 0]), pa.array(keys[m, 1]),
            ], names=["q1", "q2", "score", "vec_id", "k1", "k2"])

    return mapped(both.select(names).repartition("bin").sortWithinPartitions("bin", "kind"), FOUND, work)


def nearest(rows: DataFrame, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the ``K`` nearest rows found for each row whose id ``EVERY`` divides."""
    spark, schema = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    known = taking_part(rows)
    usual = known.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    known = known.where(F.size("embedding") == usual["size"])
    read = Vectors("f4" if known.schema["embedding"].dataType.elementType.typeName() == "float" else "f8", usual["size"])
    sample = known.orderBy(F.xxhash64("embedding", "vec_id")).limit(SAMPLE).select("embedding").toArrow()  # SAMPLE vectors
    tree = Tree(read.of(sample.column(0).combine_chunks().flatten().to_numpy().astype(read.kind, copy=False).tobytes()), leaf)
    model = Shared(spark, tree)  # two vectors for LEAF sample vectors at most
    placed = written(placed_rows(known, read, model), "search-leaves")
    asked = placed.where(F.col("vec_id") % EVERY == 0).select("vec_id", "k1", "k2", "vector").distinct()
    chosen = asked.orderBy(F.xxhash64("vec_id", "k1", "k2")).limit(CALIBRATION).collect()
    if not chosen:
        return spark.createDataFrame([], schema)
    members = placed.where("member")
    points = directions(read.of(b"".join(r["vector"] for r in chosen)))
    most = calibrated(tree, points, true_neighbours(members, read, chosen), recall)

    counts = {r["leaf"]: r["count"] for r in members.groupBy("leaf").count().collect()}  # as many rows as leaves
    size = min(MOST_BIN, max(LEAST_BIN, sum(counts.values()) // (3 * spark.sparkContext.defaultParallelism)))
    first, many = bins(counts, size, len(tree.children))
    leaves = sorted(counts)
    to_bins = F.broadcast(spark.createDataFrame(pa.table({"leaf": leaves, "first": first[leaves], "many": many[leaves]})))  # as many rows as leaves
    dealt = members.join(to_bins, "leaf").withColumn("bin", F.col("first") + F.pmod(F.xxhash64("k1", "k2", "vec_id"), "many"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to: list[tuple[int, int, list[int]]] = []
            for i, point in enumerate(directions(read(batch.column(2)))):
                own: dict[int, list[int]] = {}
                for node in model.value.visits(point, most):
                    for at in range(first[node], first[node] + many[node]):
                        own.setdefault(at, []).append(node)
                to += [(i, at, nodes) for at, nodes in own.items()]
            place = pa.array([x[0] for x in to], pa.int64())
            yield pa.RecordBatch.from_arrays([
                *(c.take(place) for c in batch.columns), pa.array([x[2] for x in to], pa.list_(pa.int64())), pa.array([x[1] for x in to], pa.int64()),
            ], names=["k1", "k2", "vector", "leaves", "bin"])

    once = asked.groupBy("k1", "k2").agg(F.first("vector").alias("vector"))
    hits = search_bins(dealt, mapped(once, "k1 long, k2 long, vector binary, leaves array<long>, bin long", route), read)
    by_vector = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id", "k1", "k2")
    few = hits.withColumn("place", F.row_number().over(by_vector)).where(f"place <= {K + 1}")
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).join(few, ["q1", "q2"])
    pairs = pairs.where("query_id <> vec_id or q1 <> k1 or q2 <> k2")
    falling = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id", "k1", "k2")
    ranked = pairs.withColumn("rank", F.row_number().over(falling).cast("int")).where(f"rank <= {K}")
    return ranked.select("query_id", "rank", "vec_id", "score")
