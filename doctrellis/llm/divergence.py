"""How far the word use of sources is from that of other sources and of their language.

The groups are the (lang, source) pairs; a language keeps the terms that at least three of
its documents have.  Ranking works on *cells*: all terms of a group with equal (group count,
lang count) have one value, so it is evaluated once a cell.  Cells of equal value are merged,
ranked by cumulative multiplicity, and only those that reach the wanted ranks are expanded
into terms, in UTF-8 order.  Divergences between sources are sums over count vectors: terms
with equal counts in all sources of a tile are one row with a multiplicity.

Sources of a language are dealt into blocks and terms into pieces; a task has the terms of one
piece in two blocks of sources, so neither many sources nor many terms make a large task.
Shares are exact: decimals up to the division, longs after it.

A document is a row, so repeated rows count each.  Null text, lang and source are ''; texts
without letters give a group without terms; an empty table gives an empty table; only
``text``, ``lang`` and ``source`` are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded, mapped, numbering, utf8, written

LEAST_DOCUMENTS = 3  # of a language, for a term to be kept
RANKS = 200  # of terms
SCALE = 1_000_000_000
HELD = 1_500_000  # (group, term) pairs that a task holds before it gives them on
SOURCES = 48  # of a block
TERMS = 20_000  # of a piece

#: Upper case becomes lower case, what belongs to no term a blank.
FOLD = bytes(i + 32 if 0x41 <= i <= 0x5A else i if i >= 0x80 or 0x61 <= i <= 0x7A else 0x20 for i in range(256))
COUNTS = "lang string, source string, term string, n long, documents long"


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of each column for them."""
    if not len(keys):
        return keys, *columns
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], *(np.add.reduceat(c[by], starts) for c in columns)


class Tally:
    """Occurrences and documents of terms by group, over some batches."""

    def __init__(self):
        self.group, self.term = numbering(), numbering()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        words = [t.translate(FOLD).split() for t in utf8(batch.column(0))]
        groups = [self.group[pair] for pair in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        terms = np.fromiter(map(self.term.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        pairs, times = np.unique(np.repeat(np.arange(len(words)), sizes) << 32 | terms, return_counts=True)
        keys = np.array(groups, np.int64)[pairs >> 32] << 32 | pairs & 0xFFFFFFFF
        self.parts.append(summed(keys, times.astype(np.int64), np.ones(len(keys), np.int64)))
        self.size += len(self.parts[-1][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The sums, and a row without a term for each group."""
        if not self.group:
            return
        keys, times, documents = summed(*(np.concatenate(x) for x in zip(*self.parts)))
        groups = np.concatenate([keys >> 32, np.arange(len(self.group))])
        named = np.arange(len(groups)) < len(keys)
        terms = pa.array(list(self.term), pa.binary()).take(pa.array(np.append(keys & 0xFFFFFFFF, np.zeros(len(self.group), np.int64)), mask=~named))
        none = np.zeros(len(self.group), np.int64)
        langs, sources = (pa.array([g[i] for g in self.group], pa.string()).take(pa.array(groups)) for i in (0, 1))
        whole = pa.RecordBatch.from_arrays([
            langs, sources, terms.cast(pa.string()), pa.array(np.append(times, none)), pa.array(np.append(documents, none)),
        ], names=[x.split()[0] for x in COUNTS.split(", ")])
        for at in range(0, whole.num_rows, 100_000):
            yield whole.slice(at, 100_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents), a row per task and pair at least; null terms name the groups."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in bounded(batches, 0):
            tally.add(batch)
            if tally.size >= HELD:
                yield from tally.rows()
                tally = Tally()
        yield from tally.rows()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return mapped(docs.select(*map(text, ("text", "lang", "source"))), COUNTS, work)


def kept_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, lang_n, first): terms that a language keeps, and a row with a null term per group.

    ``first`` marks one of the rows of each (lang, term), of which there are as many as sources.
    """
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    term = Window.partitionBy("lang", "term")
    known = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("documents").over(term).alias("in_documents"),
        (F.col("source") == F.min("source").over(term)).alias("first"),
    )
    return written(known.where(f"term is null or in_documents >= {LEAST_DOCUMENTS}").drop("in_documents"), "kept-terms")


def group_facts(kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, sources) of every group."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("firsts"))
    langs = groups.groupBy("lang").agg(F.sum("firsts").alias("terms"), F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    return written(groups.drop("firsts").join(langs, "lang"), "group-facts")


def share(count: str, total: str) -> Column:
    """Smoothed share of a term in a group, in whole parts of SCALE; of no use, but a number, where no terms are kept."""
    return F.expr(f"1 + cast({SCALE} as decimal(12,0)) * cast({count} + 1 as decimal(20,0)) div cast(greatest({total} + terms, 1) as decimal(20,0))")


def term_ranks(kept: DataFrame, facts: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, item, value, rank) of the terms that a group uses more than its language, to rank ``ranks``."""
    group, cell = ["lang", "source"], ["lang", "source", "n", "lang_n"]
    named = kept.where("term is not null and n > 0")
    cells = named.groupBy(*cell).agg(F.count("*").alias("times")).join(facts, group)
    cells = cells.withColumns({"p": share("n", "total"), "q": share("lang_n", "lang_total")}).where("p > q")
    cells = written(cells.select(*cell, "times", F.expr("(p - q) * (p - q) div q").alias("value")), "cells")
    falling = Window.partitionBy(*group).orderBy(F.desc("value"))
    # a value has a term at least, so the first ``ranks`` values hold all that is wanted
    values = cells.groupBy(*group, "value").agg(F.sum("times").alias("times")).withColumn("place", F.row_number().over(falling)).where(f"place <= {ranks}")
    before = F.coalesce(F.sum("times").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = values.withColumn("before", before).where(f"before < {ranks}").select(*group, "value", "before")
    chosen = cells.drop("times").join(reached, [*group, "value"])
    tied = Window.partitionBy(*group, "value").orderBy("term")
    terms = named.join(chosen, cell).withColumn("place", F.row_number().over(tied)).where(f"place <= {ranks}")
    rank = (F.col("before") + F.col("place")).cast("int")
    return terms.select(*group, F.col("term").alias("item"), "value", rank.alias("rank")).where(f"rank <= {ranks}")


SUMS = "lang string, source string, item string, value long, seen long"


def tile_sums(names: list[str], own: np.ndarray, other: np.ndarray, base: np.ndarray, shares: np.ndarray) -> tuple[list, list, list]:
    """Sums of (p - q)^2 div q over the rows of ``shares`` for pairs from an ``own`` and an ``other`` source."""
    vectors, times = np.unique(shares, axis=0, return_counts=True) if len(shares) else (shares, np.zeros(0, np.int64))
    pairs: list[tuple[str, str, int]] = []
    for b in range(len(names)):
        a = np.flatnonzero((own & other[b] | other & own[b]) & (np.arange(len(names)) != b))
        apart = vectors[:, a] - vectors[:, [b]]
        total = times @ (apart * apart // vectors[:, [b]])
        pairs += zip([names[i] for i in a], [names[b]] * len(a), total.tolist())
    return tuple(map(list, zip(*pairs))) or ([], [], [])


def pair_sums(kept: DataFrame, facts: DataFrame, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """(lang, source, item, value): divergence of each source from each other one of its language."""
    dealt = facts.withColumns({
        "base": share("0", "total"), "blocks": F.expr(f"cast(ceil(sources / {sources}) as int)"), "pieces": F.expr(f"cast(ceil(greatest(terms, 1) / {terms}) as int)"),
    }).withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    tiled = lambda df: df.withColumn("tile", tile).select("*", "tile.i", "tile.j").drop("tile")
    members = dealt.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    members = tiled(members).select("lang", "i", "j", "piece", "source", "block", "base")
    named = kept.where("term is not null").select("lang", "source", "term", "n").join(dealt, ["lang", "source"])
    counts = tiled(named.withColumn("piece", F.pmod(F.xxhash64("term"), "pieces").cast("int"))).select(
        "lang", "i", "j", "piece", "source", "term", share("n", "total").alias("p"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("source").to_pylist()
        block, base = right.column("block").to_numpy(), right.column("base").to_numpy()
        lang, i, j = (right.column(c)[0].as_py() for c in ("lang", "i", "j"))
        term = left.column("term").combine_chunks().dictionary_encode()
        shares = np.tile(base, (len(term.dictionary), 1))
        place = {name: k for k, name in enumerate(names)}
        column = np.fromiter(map(place.__getitem__, left.column("source").to_pylist()), np.int64, left.num_rows)
        shares[term.indices.to_numpy(), column] = left.column("p").to_numpy()
        source, item, value = tile_sums(names, block == i, block == j, base, shares)
        return pa.table([
            pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64()),
            pa.array([len(shares)] * len(source), pa.int64()),
        ], names=[x.split()[0] for x in SUMS.split(", ")])

    keys = ["lang", "i", "j", "piece"]
    found = counts.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(work, SUMS)
    found = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # terms that neither source of a tile has
    bases = dealt.select("lang", "source", "base", "terms")
    both = found.join(bases, ["lang", "source"]).join(bases.select("lang", F.col("source").alias("item"), F.col("base").alias("q")), ["lang", "item"])
    return both.select("lang", "source", "item", F.expr("value + (terms - seen) * ((base - q) * (base - q) div q)").alias("value"))


def source_divergence(docs: DataFrame, ranks: int = RANKS, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: divergences from other sources, and a group's own terms."""
    kept = kept_counts(docs)
    facts = group_facts(kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(kept, facts, sources, terms).withColumn("rank", F.row_number().over(order).cast("int"))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(term_ranks(kept, facts, ranks), "term"))
