"""Token ids as Arrow files of equal-length sequences.

Documents are put in ascending ``doc_id`` order (null first, equal ids by text) by a range
partitioning; each partition becomes a shard.  A shard is an Arrow IPC file whose batches
hold ``ids`` as fixed-size lists and ``mask`` as fixed-size lists of bits, so any sequence is
found by its number and read without a copy from a memory map.  The documents of a shard lie
end to end, each closed by the end id; only the last sequence of a shard is padded (mask 0).
A second Arrow file of the shard lists its documents (id, first position, length).

Shard files get names of their own per attempt; only those that a finished task reports are
listed in the manifest, so lost executors leave no half-written shard in it.

Null and empty texts give the end id alone; repeated rows are stored each; an empty table
gives no shard and an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .chunks import ChunkEncoder
from .common import bounded, mapped, shared_dir, utf8, written

SEQUENCE = 2048  # ids of one sequence
BATCH = 64  # sequences of one record batch
END_ID = 2

MANIFEST = "shard int, path string, index_path string, n_docs long, n_ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class LibraryEncoder(ChunkEncoder):
    """Ids as the tokenizers library gives them; texts with a special string go to it as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # the model's character for each byte, as the library's own byte-level step gives it
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {b: self.byte_character(byte_level, b) for b in range(256)}
        super().__init__()

    @staticmethod
    def byte_character(byte_level, b: int) -> str:
        """ASCII is asked for itself; any other byte is read off a character that holds it."""
        if b < 128:
            return byte_level.pre_tokenize_str(chr(b))[0][0]
        for n in range(0x80, 0x110000, 0x40 if b >= 0xC0 else 1):
            if not 0xD800 <= n < 0xE000 and b in chr(n).encode():
                return byte_level.pre_tokenize_str(chr(n))[0][0][chr(n).encode().index(b)]
        return chr(b)  # not a byte of UTF-8

    def tokenise(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, alphabet = self.tokenizer.model.tokenize, self.alphabet
        found = [tokenize(("\u0120" + p[1:] if p[0] == " " else p) if p[1:].isalpha() and p.isascii() else p.encode().decode("latin-1").translate(alphabet)) for p in fresh]
        return np.array([t.id for x in found for t in x], self.dtype), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        ids, lengths = super().encode(["" if i in whole else t for i, t in enumerate(texts)])
        if not whole:
            return ids, lengths
        edges = np.concatenate([[0], np.cumsum(lengths)])
        pieces = [np.array(whole[i], self.dtype) if i in whole else ids[edges[i]:edges[i + 1]] for i in range(len(texts))]
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class SequenceFile:
    """Writes ids as batches of fixed-size lists, and their masks."""

    def __init__(self, sink, dtype, size: int):
        kind = pa.from_numpy_dtype(dtype)
        self.size, self.dtype = size, dtype
        self.schema = pa.schema([("ids", pa.list_(kind, size)), ("mask", pa.list_(pa.bool_(), size))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0

    def put(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        full = self.size * BATCH
        if self.waiting >= full:
            values = np.concatenate(self.held)
            for at in range(0, len(values) - full + 1, full):
                self.batch(values[at:at + full], full)
            rest = values[len(values) // full * full:]
            self.held, self.waiting = [rest], len(rest)

    def batch(self, values: np.ndarray, used: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.size) for x in (values, np.arange(len(values)) < used)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        values = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        if len(values):
            padded = np.zeros(-(-len(values) // self.size) * self.size, self.dtype)
            padded[:len(values)] = values
            self.batch(padded, len(values))
        self.writer.close()


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """Encode ``docs`` with the tokenizer file ``path`` into shards below ``folder``; returns the manifest."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, store, encoder, lengths, owners = TaskContext.get().partitionId(), None, None, [], []
        for batch in bounded(batches):
            if store is None:
                encoder = LibraryEncoder(path)
                fs, root = filesystem(folder)
                fs.create_dir(root, recursive=True)
                name = f"{shard:06d}-{uuid.uuid4().hex}"
                sink = fs.open_output_stream(f"{root}/{name}.arrow")
                store = SequenceFile(sink, encoder.dtype, size)
            ids, each = encoder.encode([x.decode() for x in utf8(batch.column(1))])
            store.put(np.insert(ids, np.cumsum(each), end_id).astype(encoder.dtype))
            lengths.append(each + 1)
            owners.append(batch.column(0))
        if store is None:
            return
        store.close()
        sink.close()
        n = np.concatenate(lengths)
        index = pa.table({"doc_id": pa.chunked_array(owners), "first": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n)})
        with fs.open_output_stream(f"{root}/{name}.index.arrow") as out, pa.ipc.new_file(out, index.schema) as writer:
            writer.write_table(index, max_chunksize=10_000)
        yield pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}.arrow"]), pa.array([f"{folder}/{name}.index.arrow"]),
            pa.array([len(n)], pa.int64()), pa.array([store.total], pa.int64()),
        ], names=["shard", "path", "index_path", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # equal ids lie side by side in one range or in neighbouring ones, by a digest of the text
    digest = F.xxhash64("text")
    ordered = ordered.repartitionByRange("doc_id", digest).sortWithinPartitions("doc_id", digest, "text")
    return written(mapped(ordered, MANIFEST, work), "token-manifest")


def open_shard(path: str) -> pa.ipc.RecordBatchFileReader:
    """A shard (or its index) ready for random access; mapped, not read, if it lies in a local or mounted folder."""
    from pyarrow import fs

    store, place = filesystem(path)
    return pa.ipc.open_file(pa.memory_map(place) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(place))


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence; the ids are a view of the file's bytes."""
    batch = reader.get_batch(number // BATCH)
    row = number % BATCH
    return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)


def shard_digests(path: str, index_path: str) -> pa.Table:
    """(doc_id, first, n_tokens, ids_crc32) of the documents of one shard, batch by batch."""
    index = open_shard(index_path).read_all()
    first, n = index.column("first").to_numpy(), index.column("n_tokens").to_numpy()
    digest = np.zeros(len(n), np.int64)
    reader, base, doc = open_shard(path), 0, 0
    for b in range(reader.num_record_batches):
        values = reader.get_batch(b).column(0).flatten().to_numpy().astype("<u4")
        while doc < len(n) and first[doc] < base + len(values):
            low, high = max(first[doc] - base, 0), first[doc] + n[doc] - base
            digest[doc] = zlib.crc32(values[low:high].tobytes(), int(digest[doc]))
            if high > len(values):
                break
            doc += 1
        base += len(values)
    return index.append_column("ids_crc32", pa.array(digest))


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per stored document: where it starts among all ids, its length, and the checksum of its ids."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = shard_digests(row["path"], row["index_path"])
                start = pa.array(found.column("first").to_numpy() + row["before"])
                out = pa.table({"doc_id": found.column("doc_id"), "start": start, "n_tokens": found.column("n_tokens"), "ids_crc32": found.column("ids_crc32")})
                yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    # one row per shard: the running total is over as many rows as there are shards
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", "index_path", before.alias("before"))
    shards = max(manifest.count(), 1)
    return mapped(placed.repartition(shards), RESULT, work)


def token_store(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SEQUENCE, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as shards and read them back."""
    folder = folder or shared_dir(docs.sparkSession, "token-shards")
    return read_digests(write_shards(docs, path, folder, end_id, size))
