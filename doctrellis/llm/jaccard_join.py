"""N-gram Jaccard join with count-vector R-trees.

The set of a document is its distinct 5-word shingles; documents link from a Jaccard
similarity of 75 / 100.  Documents of equal sets form a class, and classes are joined:

1. *Blocks.*  A fixed-size sketch of shingle counts over all documents orders shingles, rare
   ones first.  Two sets that link share one of the first ``n - ceil(3n/4) + 1`` shingles of
   each, whatever the order, so classes are brought together by those.  Equal blocks are one.
2. *Count vectors.*  Shingles are hashed into groups, about one for four of them; a class is
   the point of its group counts.  In a block the points are packed into an R-tree; the summed coordinate
   minima of a point and a node (or point) bound the overlap, and what can't reach the
   overlap needed is cut off.  Surviving pairs leave a spanning forest per block.
3. *Verification.*  Components of these forests hold all links.  In each, the sets themselves
   are compared, again behind the R-tree, and exact links remain.

Groups of any size are cut into tiles.  Each tile meets itself and the first tile; members
that then still stand outside their group's main component meet every tile, a tile of them at
a time.  So no task holds a whole hot group, and no pair of different components is left out.
Documents of equal sets are one member, and links inside what is connected aren't sought.

Null and empty texts have no set and link with nothing; repeated rows are members of one
class; rows with a null id get their set's component; an empty table gives an empty table;
only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded, mapped, utf8, written
from .components import components
from .shingles import distinct_sets, mixed, shingle_hashes

SKETCH_BITS = 20
GROUPS, SHARE = 64, 4  # groups of a count vector: at least, and a set's size over it
PAIRS = 4096  # two-class blocks compared together
LEAF = 16  # points of an R-tree leaf
BLOCK_TILE = 8_000_000  # shingles of a block's classes in one task (a quarter of that in group counts)
SET_TILE = 1_000_000  # shingles of a component in one task
UP, DOWN = 75, 100  # similarity as a fraction


def needed(a, b):
    """Least overlap with which sets of these sizes link."""
    return -(-UP * (a + b) // (UP + DOWN))


def sketch(docs: DataFrame) -> np.ndarray:
    """Documents with a shingle in each of 2**SKETCH_BITS buckets: a fixed-size summary of all documents."""
    size, pieces = 1 << SKETCH_BITS, 512

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in bounded(batches, 0):
            hashes, _ = shingle_hashes(utf8(batch.column(0)))
            total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size).astype(np.uint32)
        for piece, part in enumerate(total.reshape(pieces, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["piece", "counts"])

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in rows:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(blob, np.uint32)
                held[piece] = held[piece] + own if piece in held else own
        for piece, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["piece", "counts"])

    schema = "piece int, counts binary"
    summed = mapped(mapped(docs.select(F.col("text").cast("string")), schema, count).repartition("piece"), schema, add)
    total = np.zeros((pieces, size // pieces), np.uint32)
    for row in summed.collect():  # 4 MB in all
        total[row["piece"]] = np.frombuffer(row["counts"], np.uint32)
    return total.ravel()


def groups_for(size: int) -> int:
    """Groups of a set's count vector: a power of two of about a quarter of its size or more.

    Random sets of one size differ by more than links may as long as groups keep up with size.
    """
    return max(GROUPS, 1 << max(0, (size - 1) // SHARE).bit_length())


def count_vector(hashes: np.ndarray) -> bytes:
    """Group counts in bytes; should one not fit, all are at the limit, which bounds any overlap."""
    groups = groups_for(len(hashes))
    counts = np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return (np.full(groups, 255) if counts.max(initial=0) > 255 else counts).astype(np.uint8).tobytes()


def vector(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).astype(np.uint16)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors over fewer groups: groups are low bits of the hashes, so some fall together."""
    return points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.uint16)


def class_of(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number that equal sets share."""
    total = np.zeros(n, np.uint64)
    np.add.at(total, owner, mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    return total.astype(np.int64)


FACTS = "doc_id long, class long, n_shingles long, vector binary, prefix array<long>"


def facts(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """Per document its class, set size, count vector, and the shingles that blocks are made of.

    Vector and prefix are given once per class and task.
    """
    known = docs.sparkSession.sparkContext.broadcast(order)  # 2**SKETCH_BITS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, met = known.value, set()
        for batch in bounded(batches):
            n = batch.num_rows
            hashes, owner = shingle_hashes(utf8(batch.column(1)))
            hashes, owner = distinct_sets(hashes, owner, counts[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])
            sizes = np.bincount(owner, minlength=n)
            starts = np.cumsum(sizes) - sizes
            classes = class_of(hashes, owner, n)
            fresh = np.zeros(n, bool)
            for i in np.flatnonzero(sizes).tolist():
                c = int(classes[i])
                if c not in met:
                    met.add(c)
                    fresh[i] = True
            most = np.where(fresh, sizes - (3 * sizes + 3) // 4 + 1, 0)
            signed = hashes.astype(np.int64)
            ends = np.cumsum(most)
            at = np.arange(int(ends[-1]) if n else 0) + np.repeat(starts - (ends - most), most)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(signed[at]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(classes, mask=sizes == 0), pa.array(sizes),
                pa.array([count_vector(hashes[a:a + k]) if new else None for a, k, new in zip(starts, sizes, fresh)], pa.binary()), prefix,
            ], names=["doc_id", "class", "n_shingles", "vector", "prefix"])
            if len(met) > 1_000_000:
                met.clear()

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), FACTS, work)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows that end with a whole group, and where groups (by the first ``keys`` columns) start."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None and held.num_rows else rows
        starts = group_starts(rows, keys)
        last = int(starts[-1])
        if last:
            yield rows.slice(0, last), starts[:-1]
        held = rows.slice(last)
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def group_starts(rows: pa.Table, keys: int) -> np.ndarray:
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for k in range(keys):
        column = rows.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def blocks(rows: DataFrame) -> DataFrame:
    """(block, class) from (key, class): keys that different classes share; equal sets of classes are one block."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 1):
            classes = table.column(1).to_numpy()
            new = np.ones(len(classes), bool)
            new[1:] = classes[1:] != classes[:-1]
            new[starts] = True  # rows are sorted by class within a key
            group = np.searchsorted(starts, np.arange(len(classes)), side="right") - 1
            classes, group = classes[new], group[new]
            sizes = np.bincount(group, minlength=len(starts))
            block = np.zeros(len(starts), np.uint64)
            np.add.at(block, group, mixed(classes.astype(np.uint64)))
            several = sizes[group] > 1
            found = np.unique(np.stack([block[group[several]].astype(np.int64), classes[several]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["block", "class"])

    together = rows.repartition("key").sortWithinPartitions("key", "class")
    return mapped(together, "block long, class long", work).distinct()


class Tree:
    """Two levels of count vectors: leaves of points of similar size and shape, each with its greatest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        wide = points.argmax(axis=1)
        self.order = np.lexsort((wide, sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.starts = np.arange(0, len(sizes), LEAF)
        self.greatest = np.maximum.reduceat(self.points, self.starts, axis=0)
        self.least_size = np.minimum.reduceat(self.sizes, self.starts)
        self.most_size = np.maximum.reduceat(self.sizes, self.starts)

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points whose summed minima with ``point`` reach the overlap that a link needs."""
        fits = (UP * size <= DOWN * self.most_size) & (UP * self.least_size <= DOWN * size)
        fits[fits] = np.minimum(self.greatest[fits], point).sum(axis=1) >= needed(size, self.least_size[fits])
        at = (self.starts[fits][:, None] + np.arange(LEAF)).ravel()
        at = at[at < len(self.sizes)]
        return self.order[at[np.minimum(self.points[at], point).sum(axis=1) >= needed(size, self.sizes[at])]]


def forest(vectors: list[np.ndarray], sizes: np.ndarray, label: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what ``linked`` (a member, its candidates) connects; equal labels are connected already.

    There is a tree for each number of groups; sets that link have equal numbers, or one has
    twice as many as the other.
    """
    _, comp = np.unique(label, return_inverse=True)
    groups = np.fromiter(map(len, vectors), np.int64, len(vectors))
    trees = {}
    for g in np.unique(groups).tolist():
        own = np.flatnonzero(groups == g)
        trees[g] = own, Tree(np.stack([vectors[i] for i in own]), sizes[own])
    edges = []
    for i, (own, size) in enumerate(zip(vectors, sizes.tolist())):
        members, tree = trees[len(own)]
        found = members[tree.near(own, size)]
        found = found[found < i]
        if len(own) // 2 in trees:
            members, tree = trees[len(own) // 2]
            found = np.concatenate([found, members[tree.near(folded(own[None], len(own) // 2)[0], size)]])
        found = found[comp[found] != comp[i]]
        while len(found):
            for j in linked(i, found[:32]):
                if comp[j] != comp[i]:
                    edges.append((i, int(j)))
                    comp[comp == comp[j]] = comp[i]
            found = found[32:]
            found = found[comp[found] != comp[i]]
    return edges


def overlaps(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Exact test of links between sets of sorted hashes."""
    def linked(i: int, others: np.ndarray) -> np.ndarray:
        own = sets[i]
        flat = np.concatenate([sets[j] for j in others])
        lengths = np.fromiter((len(sets[j]) for j in others), np.int64, len(others))
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(lengths) - lengths)
        return others[both >= needed(len(own), lengths)]

    return linked


MEMBERS = "group long, tile int, class long, label long, n_shingles long, vector binary, shingles binary"
EDGES = "a long, b long"


def edges_of_tiles(members: DataFrame) -> DataFrame:
    """Links within each (group, tile), as edges of a spanning forest."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 2):
            ends = np.append(starts[1:], table.num_rows)
            classes, labels, sizes = (table.column(c).to_numpy() for c in ("class", "label", "n_shingles"))
            vectors, exact = [vector(v) for v in table.column("vector").to_pylist()], table.column("shingles")
            widths = np.fromiter(map(len, vectors), np.int64, len(vectors))
            a, b = [], []
            several = ends - starts > 1
            if exact.null_count:  # most blocks hold two classes
                pairs = starts[ends - starts == 2]
                alike = pairs[widths[pairs] == widths[pairs + 1]]
                several[np.searchsorted(starts, alike)] = False
                for width in np.unique(widths[alike]).tolist():
                    left = alike[widths[alike] == width]
                    for at in range(0, len(left), PAIRS):
                        own = left[at:at + PAIRS]
                        bound = np.minimum(np.stack([vectors[i] for i in own]), np.stack([vectors[i + 1] for i in own])).sum(axis=1)
                        near = own[(bound >= needed(sizes[own], sizes[own + 1])) & (labels[own] != labels[own + 1])]
                        a += classes[near].tolist()
                        b += classes[near + 1].tolist()
            for s, e in zip(starts[several].tolist(), ends[several].tolist()):
                if exact.null_count:
                    test = lambda i, others: others
                else:
                    test = overlaps([np.frombuffer(x, np.uint64) for x in exact.slice(s, e - s).to_pylist()])
                for i, j in forest(vectors[s:e], sizes[s:e], labels[s:e], test):
                    a.append(int(classes[s + i]))
                    b.append(int(classes[s + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = members.repartition("group", "tile").sortWithinPartitions("group", "tile", "class")
    return mapped(dealt, EDGES, work)


def joined(members: DataFrame, weight: str, limit: int) -> DataFrame:
    """Edges (a, b) that connect all links within groups of ``members`` (group, class, n_shingles, vector, shingles).

    ``weight`` is the SQL of a member's share of ``limit``, the most that a tile should hold.
    """
    columns = ["group", "tile", "class", "label", "n_shingles", "vector", "shingles"]
    totals = members.groupBy("group").agg(F.expr(f"cast(ceil(sum({weight}) / {limit}) as int)").alias("tiles"))
    wide = written(totals.where("tiles > 1"), "wide-groups")
    if wide.isEmpty():
        return written(edges_of_tiles(members.withColumn("tile", F.lit(0)).withColumn("label", F.col("class")).select(columns)), "links")
    tiles = F.coalesce("tiles", F.lit(1))
    sized = members.join(wide, "group", "left").withColumn("own", F.pmod(F.xxhash64("class"), tiles).cast("int"))
    every = F.sequence(F.lit(0), tiles - 1)
    first = sized.withColumn("label", F.col("class")).withColumn(
        "tile", F.explode(F.when(F.col("own") == 0, every).otherwise(F.array("own")))).select(columns)
    edges = written(edges_of_tiles(first), "links")

    # groups of several tiles: members outside the main component of their group meet every tile
    roots = components(edges)
    parts = sized.where("tiles > 1").join(roots.withColumnRenamed("node", "class"), "class", "left")
    parts = parts.withColumn("label", F.coalesce("root", "class")).drop("root")
    counted = parts.groupBy("group", "label").agg(F.count("*").alias("n"))
    main = counted.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.where(F.col("most") < F.col("all")).withColumn("outside", F.col("all") - F.col("most"))
    parts = parts.join(main, "group")
    # a tile of outsiders has the same share of members as a tile of the group
    slices = F.greatest(F.lit(1), F.ceil(F.col("outside") * F.col("tiles") / F.col("all")).cast("int"))
    parts = parts.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("class", F.lit(1)), F.col("slices")).cast("int"))
    number = lambda tile, piece: tile * F.col("slices") + piece
    all_slices = F.sequence(F.lit(0), F.col("slices") - 1)
    as_tile = parts.withColumn("tile", F.explode(F.transform(all_slices, lambda s: number(F.col("own"), s))))
    as_outsider = parts.where(F.col("label") != F.col("main")).withColumn("tile", F.explode(F.transform(every, lambda t: number(t, F.col("slice")))))
    second = as_tile.select(columns).unionByName(as_outsider.select(columns)).dropDuplicates(["group", "tile", "class"])
    return edges.unionByName(written(edges_of_tiles(second), "links"))


def candidate_components(found: DataFrame, block_tile: int) -> DataFrame:
    """(class, root) of classes that may have links."""
    points = found.where(F.col("vector").isNotNull()).groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.first("vector").alias("vector"))
    rows = found.where(F.col("vector").isNotNull()).select(F.explode("prefix").alias("key"), "class")
    shared = written(blocks(rows), "blocks")
    members = shared.join(points, "class").select(F.col("block").alias("group"), "class", "n_shingles", "vector", F.lit(None).cast("binary").alias("shingles"))
    return components(joined(members, f"greatest({GROUPS * SHARE}, n_shingles)", block_tile))


def sets_of(docs: DataFrame) -> DataFrame:
    """Sorted shingle hashes and count vector of documents (group, class, text)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            n = batch.num_rows
            hashes, owner = distinct_sets(*shingle_hashes(utf8(batch.column(2))))
            sizes = np.bincount(owner, minlength=n)
            parts = np.split(hashes, np.cumsum(sizes)[:-1])
            out = pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes), pa.array([count_vector(p) for p in parts], pa.binary()),
                pa.array([p.tobytes() for p in parts], pa.binary()),
            ], names=["group", "class", "n_shingles", "vector", "shingles"])
            # rows that share an id may have another text than the one that was meant
            yield out.filter(pa.array(class_of(hashes, owner, n) == batch.column(1).to_numpy()))

    return mapped(docs, "group long, class long, n_shingles long, vector binary, shingles binary", work)


def jaccard_components(docs: DataFrame, block_tile: int = BLOCK_TILE, set_tile: int = SET_TILE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; component_id is the smallest id that links reach."""
    found = written(facts(docs, sketch(docs)), "shingle-facts")
    nodes = candidate_components(found, block_tile)
    roots = nodes.select("root").distinct().select(F.col("root").alias("class"), "root")
    grouped = nodes.select(F.col("node").alias("class"), "root").unionByName(roots)
    # one document of each candidate class gives its set
    chosen = found.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    chosen = grouped.join(chosen, "class").select("doc_id", F.col("root").alias("group"), "class")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(sets_of(texts.join(chosen, "doc_id").select("group", "class", "text")), "candidate-sets")
    links = components(joined(sets, "n_shingles", set_tile))
    placed = found.select("doc_id", "n_shingles", "class").join(links.withColumnRenamed("node", "class"), "class", "left")
    placed = written(placed.withColumn("root", F.coalesce("root", "class")), "placed")
    smallest = placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("smallest"))
    final = placed.join(smallest, "root", "left")
    return final.select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """Of each component the rows with its smallest id, each text of such an id once, with all columns.

    Of rows alike in id and text the first stays, by their other columns in order (maps as JSON).
    Documents without words, and components without any id, keep their rows.
    """
    leader, number = (fresh_name(docs, name) for name in ("leader", "copy_number"))
    placed = jaccard_components(docs)
    leaders = placed.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(leader)).distinct()
    kept = docs.join(leaders, F.col("doc_id").eqNullSafe(F.col(leader)), "left_semi")
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    quoted = {f.name: F.col("`" + f.name.replace("`", "``") + "`") for f in others}
    order = [F.to_json(F.struct(quoted[f.name])) if "map<" in f.dataType.simpleString() else quoted[f.name] for f in others]
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*order or [F.lit(0)])
    return kept.withColumn(number, F.row_number().over(copies)).where(F.col(number) == 1).drop(number)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
