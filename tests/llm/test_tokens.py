"""Token counts, byte BPE and the token store against the public libraries."""
import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from doctrellis.llm import queries
from doctrellis.llm.byte_bpe import SqlEncoder, byte_bpe, encoded, read_ranks
from doctrellis.llm.token_counts import token_counts
from doctrellis.llm.token_store import LibraryEncoder, open_shard, sequence, token_store, write_shards

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(path):
    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_counts_of_awkward_rows(rows):
    tokenizer = library(WORDS)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect())
    got = token_counts(rows, WORDS, 20).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)


def test_counts_of_a_table(spark, small):
    tokenizer = library(WORDS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op5_token_counts"](spark, small).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_bpe_of_awkward_rows(rows, reference):
    want = sorted((str(r.doc_id), np.array(reference.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in rows.collect())
    got = byte_bpe(rows, RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_bpe_of_a_table(spark, small, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.QUERIES["op4_byte_bpe"](spark, small).collect():
        ids = np.array(reference.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_long_pretokens_merge_as_short_ones(reference):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abetnio"), n)) for n in (1, 2, 7, 40, 255, 256, 257, 300, 900)] + ["a" * 257, "ab" * 200, "ACGT" * 300]
    encoder = SqlEncoder(RANKS)
    ids, lengths = encoder.tokenise(words)
    parts = np.split(ids, np.cumsum(lengths)[:-1])
    assert [p.tolist() for p in parts] == [reference.encode_ordinary(w) for w in words]


def test_encoded_keeps_columns(rows):
    out = encoded(rows, RANKS)
    assert set(out.columns) == set(rows.columns) - {"text"} | {"ids", "decoded"}
    assert out.count() == rows.count()


def test_store_of_awkward_rows(rows):
    tokenizer = library(BYTES)
    order = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in rows.collect())
    got = sorted(token_store(rows, BYTES, size=16).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [k for k, _ in order]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    want = sorted(zlib.crc32(np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, t in order)
    assert sorted(r.ids_crc32 for r in got) == want


def test_sequences_are_equal_and_masked(rows, spark, tmp_path):
    shards = write_shards(rows, BYTES, f"file://{tmp_path}/shards", size=16).collect()
    assert sum(s.n_docs for s in shards) == rows.count()
    for shard in shards:
        reader, n = open_shard(shard.path), 0
        count = sum(reader.get_batch(b).num_rows for b in range(reader.num_record_batches))
        for k in range(count):
            ids, mask = sequence(reader, k)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            n += int(mask.sum())
        assert n == shard.n_ids


def test_chunks_are_the_library(reference):
    encoder, tokenizer = LibraryEncoder(BYTES), library(BYTES)
    for text in ("", " ", "a  b", "a \n b", " x", "x ", "\x1c a \x1c\x1c b", " \x85 b  c", "a <|endoftext|> b  <|endoftext|>", "é́ ß. ,"):
        ids, lengths = encoder.encode([text])
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and lengths.tolist() == [len(ids)]


def test_empty_tables(nothing):
    assert token_counts(nothing, WORDS).count() == 0
    assert byte_bpe(nothing, RANKS).count() == 0
    assert encoded(nothing, RANKS).count() == 0
    assert token_store(nothing, BYTES).count() == 0
