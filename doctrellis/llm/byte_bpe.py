"""Byte-level BPE as recursive SQL in each partition.

A task has a DuckDB connection of its own with the merge table (left id, right id, rank) of a
rank file.  The distinct pre-tokens of a batch become rows (word, position, token); the
recursive query joins neighbouring rows with the merge table, contracts the leftmost pair of
minimum rank of each word, and goes on until no word has a pair left.  A pre-token that is a
token itself needs no merging.  Decoding aggregates the bytes of tokens in position order.

For pre-tokens over ``LONG`` bytes one round contracts all pairs of the minimum rank, left to
right, so that rounds stay few: a merge of some rank never gives a pair of the same or a
smaller one, so the order of rounds and hence the result is the same.

Null and empty texts have no tokens; repeated rows and null ids are encoded row by row; an
empty table gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import ChunkEncoder, ragged
from .common import bounded, mapped, utf8

WORDS = 30_000  # pre-tokens of one recursive query
LONG = 256
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"

LEFTMOST = """
WITH RECURSIVE steps AS (
  SELECT word, pos, id, true AS live FROM bytes
  UNION ALL
  (WITH pairs AS (
     SELECT word, pos, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos
     FROM steps WHERE live WINDOW w AS (PARTITION BY word ORDER BY pos)),
   best AS (
     SELECT word, arg_min(pos, rank * 4294967296 + pos) AS left_pos, arg_min(next_pos, rank * 4294967296 + pos) AS right_pos, min(rank) AS low
     FROM pairs JOIN merges ON id = left_id AND next_id = right_id GROUP BY word)
   SELECT pairs.word, pos, CASE WHEN pos = left_pos THEN low ELSE id END, low IS NOT NULL
   FROM pairs LEFT JOIN best USING (word) WHERE right_pos IS NULL OR pos <> right_pos))
SELECT word, pos, id FROM steps WHERE NOT live
"""

ALL_LOWEST = """
WITH RECURSIVE steps AS (
  SELECT word, pos, id, true AS live FROM bytes
  UNION ALL
  (WITH pairs AS (
     SELECT word, pos, id, lead(id) OVER w AS next_id, row_number() OVER w AS place
     FROM steps WHERE live WINDOW w AS (PARTITION BY word ORDER BY pos)),
   ranked AS (
     SELECT pairs.*, rank, min(rank) OVER (PARTITION BY word) AS low
     FROM pairs LEFT JOIN merges ON id = left_id AND next_id = right_id),
   runs AS (
     SELECT *, coalesce(rank = low, false) AS lowest, place - row_number() OVER (PARTITION BY word, coalesce(rank = low, false) ORDER BY place) AS run FROM ranked),
   chosen AS (
     SELECT *, lowest AND row_number() OVER (PARTITION BY word, run, lowest ORDER BY place) % 2 = 1 AS left_half FROM runs),
   halves AS (
     SELECT *, lag(left_half, 1, false) OVER (PARTITION BY word ORDER BY place) AS right_half FROM chosen)
   SELECT word, pos, CASE WHEN left_half THEN low ELSE id END, low IS NOT NULL FROM halves WHERE NOT right_half))
SELECT word, pos, id FROM steps WHERE NOT live
"""

DECODED = "SELECT word, string_agg(bytes, '' ORDER BY pos) AS hex FROM merged JOIN tokens USING (id) GROUP BY word ORDER BY word"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class SqlEncoder(ChunkEncoder):
    """Chunks encoded and decoded by DuckDB."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = ranks = read_ranks(path)
        self.dtype = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32
        self.sql = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        splits = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        merges = pa.table(dict(zip(("left_id", "right_id", "rank"), map(np.array, zip(*splits)))))
        tokens = pa.table({"id": np.array(list(ranks.values())), "bytes": [t.hex() for t in ranks]})
        self.sql.register("merges_in", merges)
        self.sql.register("tokens_in", tokens)
        self.sql.execute("CREATE TABLE merges AS SELECT * FROM merges_in; CREATE TABLE tokens AS SELECT * FROM tokens_in")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)])
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.piece_bytes: list[bytes] = []
        self.chunk_bytes: list[bytes] = []

    def merged(self, words: list[bytes], query: str) -> pa.Table:
        """(word, pos, id) of all tokens of ``words``."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        places = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.sql.register("bytes", pa.table({"word": np.repeat(np.arange(len(words)), sizes), "pos": places, "id": self.byte[raw]}))
        return self.sql.sql(query).to_arrow_table()

    def tokenise(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.tokenise_some(fresh[at:at + WORDS]) for at in range(0, len(fresh), WORDS)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def tokenise_some(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in fresh]
        known = [self.ranks.get(x, -1) for x in raw]
        kinds = np.array([0 if k >= 0 else 1 if len(x) <= LONG else 2 for k, x in zip(known, raw)])
        own = np.flatnonzero(kinds == 0)
        tables = [pa.table({"word": own, "pos": np.zeros(len(own), np.int64), "id": np.array(known)[own]})]
        for kind, query in ((1, LEFTMOST), (2, ALL_LOWEST)):
            at = np.flatnonzero(kinds == kind)
            if len(at):
                found = self.merged([raw[i] for i in at], query)
                tables.append(pa.table({"word": at[found.column("word").to_numpy()], "pos": found.column("pos"), "id": found.column("id").cast(pa.int64())}))
        self.sql.register("merged", pa.concat_tables(tables))
        decoded = self.sql.sql(DECODED).to_arrow_table()
        self.piece_bytes += map(bytes.fromhex, decoded.column("hex").to_pylist())
        ids = self.sql.execute("SELECT word, id FROM merged ORDER BY word, pos").fetchnumpy()
        return ids["id"].astype(self.dtype), np.bincount(ids["word"], minlength=len(fresh))

    def learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers, sizes = super().learn(fresh)
        take = list(map(self.piece_bytes.__getitem__, numbers.tolist()))
        ends = np.cumsum(sizes).tolist()
        self.chunk_bytes += [take[b - 1] if n == 1 else b"".join(take[b - n:b]) for b, n in zip(ends, sizes.tolist())]
        return numbers, sizes

    def decode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(ids end to end, ids per text, the bytes that the ids of each text stand for)."""
        numbers, counts = self.numbers([self.chunks(t) for t in texts])
        ids, each = ragged(self.flat, self.lengths, numbers)
        per_text = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=each, minlength=len(texts)).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(counts)])
        take = list(map(self.chunk_bytes.__getitem__, numbers.tolist()))
        return ids, per_text, [b"".join(take[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def byte_bpe(docs: DataFrame, path: str) -> DataFrame:
    """Per row: the number of tokens, the ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in bounded(batches):
            encoder = encoder or SqlEncoder(path)
            ids, each, decoded = encoder.decode_texts([x.decode() for x in utf8(batch.column(1))])
            offsets = np.concatenate([[0], np.cumsum(each)]) * 4
            wide = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(each),
                pa.array([wide[a:b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()), pa.array(decoded, pa.binary()),
            ], names=["doc_id", "n_tokens", "ids", "decoded"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), SCHEMA, work)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``text`` replaced by n_tokens, ids and decoded text; columns of these names give way."""
    at = docs.columns.index("text")
    others = [i for i, c in enumerate(docs.columns) if i != at and c not in ("n_tokens", "ids", "decoded")]
    fields = [docs.schema.fields[i] for i in others]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long, ids binary, decoded string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in bounded(batches, at):
            encoder = encoder or SqlEncoder(path)
            ids, each, decoded = encoder.decode_texts([x.decode() for x in utf8(batch.column(at))])
            offsets = np.concatenate([[0], np.cumsum(each)]) * 4
            wide = ids.astype("<u4").tobytes()
            columns = [batch.column(i) for i in others] + [
                pa.array(each), pa.array([wide[a:b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                pa.array([x.decode() for x in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), "n_tokens", "ids", "decoded"])

    return mapped(docs, schema, work)
