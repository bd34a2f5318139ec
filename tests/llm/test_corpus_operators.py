"""Jaccard join, language-model scores and the pipeline against brute force."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from doctrellis.llm import lm_scoring, queries
from doctrellis.llm.blocks import planes
from doctrellis.llm.byte_bpe import read_ranks
from doctrellis.llm.components import components
from doctrellis.llm.context_mixing import CODE, HEAD, KINDS, Counts, Mixer, before_words, decisions, edges, head_keys, heads, log_odds, spelled
from doctrellis.llm.decontaminate import contaminated
from doctrellis.llm.jaccard_join import folded, groups_for, jaccard_components, needed, one_per_component
from doctrellis.llm.lm_scoring import lm_scores
from doctrellis.llm.quality_rules import quality_rules
from doctrellis.llm.secret_scan import redact


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    """{row number: (set size, smallest id reachable)} of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(len(s), d if not s else least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed, groups, copies, words):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        source = [f"w{rng.randrange(10_000)}" for _ in range(words)]
        for _ in range(copies):
            text = list(source)
            for _ in range(rng.randrange(0, max(1, words // 40))):
                text[rng.randrange(len(text))] = f"v{rng.randrange(10_000)}"
            rows.append(" ".join(text[rng.randrange(0, 1 + words // 12):]))
    rng.shuffle(rows)
    return list(enumerate(rows))


def check(spark, rows, **tiles):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs, **tiles).collect())
    assert got == sorted((str(d), n, str(c)) for (d, _), (n, c) in zip(rows, brute_components(rows)))


@pytest.mark.parametrize("tiles", [{}, {"block_tile": 1500, "set_tile": 900}])
def test_join_of_near_copies(spark, tiles):
    check(spark, near_copies(1, 12, 14, 90) + [(1000 + i, t) for i, t in near_copies(2, 6, 5, 700)], **tiles)


def test_join_of_a_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op1_jaccard_join"](spark, small).collect()}
    assert got == {d: x for (d, _), x in zip(docs, brute_components(docs))}


def test_join_of_awkward_rows(spark, rows, nothing):
    check(spark, [(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()])
    assert jaccard_components(nothing).count() == 0 and one_per_component(nothing).count() == 0
    kept = one_per_component(rows)
    assert kept.schema == rows.schema and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 5}


def test_borders_and_bounds():
    assert needed(4, 4) == 4 and needed(7, 7) == 6 and needed(3, 4) == 3
    assert [groups_for(n) for n in (1, 256, 257, 512, 513, 4096)] == [64, 64, 128, 128, 256, 1024]
    points = np.arange(256, dtype=np.uint16).reshape(2, 128)
    assert folded(points, 64).sum() == points.sum() and (folded(points, 64)[0] == points[0, :64] + points[0, 64:]).all()


def test_components_of_a_long_path(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 300)}, 1001: 1000}


def test_mixer_learns_a_language():
    rng = random.Random(6)
    words = [b"".join(rng.choice([b"ta", b"ke", b"mi", b"so"]) for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    counts = Counter(words[:2000])
    keys, kinds = list(counts), np.zeros(len(counts), np.int64)
    tables = Counts()
    tables.add(keys, kinds, np.array([counts[k] for k in keys]))
    model = Mixer.start(log_odds(tables.ones, tables.all))
    before = model.log10(words[2000:], np.zeros(1000, np.int64)).mean()
    tuning = Counter(words[2000:])
    for _ in range(20):
        model.learn(list(tuning), np.zeros(len(tuning), np.int64), np.array(list(tuning.values())))
    assert model.log10(words[2000:], np.zeros(1000, np.int64)).mean() > before
    one = model.log10([b"take"], np.zeros(1, np.int64))[0]
    assert one > model.log10([b"zzqx"], np.zeros(1, np.int64))[0] + 2


def test_counts_beyond_32_bits():
    tables = Counts()
    for _ in range(2):
        tables.add([b"a"], np.zeros(1, np.int64), np.array([3 << 30]))
    assert int(tables.all.max()) >= 6 << 30


def test_probabilities_of_words_sum_below_one():
    model = Mixer.start(np.zeros(log_odds(np.zeros(1), np.zeros(1)).size, np.int8).repeat(int(__import__("doctrellis.llm.context_mixing", fromlist=["CELLS"]).CELLS)))
    first = [bytes([b]) for b in range(256) if b not in (10, 32)] + [b""]
    spelled_first = [w for w in first]
    # an untrained model gives each byte 1 / 256; a one-byte word is two bytes long, the end is one
    got = model.log10(spelled_first, np.zeros(len(first), np.int64))
    assert np.allclose(got[:-1], 2 * -math.log10(256)) and math.isclose(got[-1], -math.log10(256), rel_tol=1e-6)


def brute_base(rows):
    words = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    fold = [None if d is None else zlib.crc32(str(d).encode()) % 7 for d, _ in rows]
    count = Counter(w for x, f in zip(words, fold) if f is not None and f != 2 for w in x)
    n, v = sum(count.values()), len(count)
    return [(None if f is None else f == 2, len(x), sum(count[w] > 0 for w in x), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x)) for x, f in zip(words, fold)]


def compare_base(rows, got):
    order = lambda x: (str(x[0]), x[1][1], x[1][4])
    want = sorted(((d, b) for (d, _), b in zip(rows, brute_base(rows))), key=order)
    found = sorted(((r.doc_id, (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in got), key=order)
    assert [(d, b[:4]) for d, b in found] == [(d, b[:4]) for d, b in want]
    assert all(math.isclose(x[1][4], y[1][4], rel_tol=1e-9) for x, y in zip(found, want))


def test_scores(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.QUERIES["op3_lm_scoring"](spark, folder).collect()
    compare_base(docs, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -4.5
    texts = dict(docs)
    for r in held[:20]:
        size = sum(map(len, (texts[r.doc_id] or "").encode().split())) + len((texts[r.doc_id] or "").split()) + 1
        assert math.isclose(r.bits_per_byte, -r.score / math.log10(2) / size, rel_tol=0.05)
    assert np.mean([r.bits_per_byte for r in held]) < 3


def test_scores_of_awkward_rows(rows, nothing, spark):
    compare_base([(r.doc_id, r.text) for r in rows.collect()], lm_scores(rows).collect())
    assert lm_scores(nothing).count() == 0
    lone = spark.createDataFrame([(1, None), (None, "x")], "doc_id long, text string")
    assert all(r.score < 0 for r in lm_scores(lone).collect()) and KINDS < 256


def test_the_tuning_fold_reaches_the_scores(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    rng = random.Random(3)
    rows = [(i, " ".join(["zyxwvq"] * 40 if fold(i) == 3 else ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(40)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    per_word = [r.score / r.n_tokens for r in lm_scores(docs).collect() if fold(r.doc_id) == 3]
    assert per_word and min(per_word) > -2  # never seen, it costs 7 bytes


def test_bytes_before_words():
    rng = random.Random(1)
    texts = [[bytes(rng.choice(b"abc\x00\xff") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))] + [b""] for _ in range(200)]
    words = [w for t in texts for w in t]
    first, last = edges(words)
    before = before_words(last, np.array([i == 0 for t in texts for i in range(len(t))]))
    code = lambda raw: sum((b + 1) << (CODE * i) for i, b in enumerate(raw[:HEAD]))
    want = [code(b" ".join(t[:i])[::-1]) for t in texts for i in range(len(t))]
    assert before.tolist() == want and first.tolist() == [code(w + b" " if w else b"\n") for w in words]
    kinds = np.array([rng.randrange(KINDS) for _ in words])
    for place, (keys, there, number) in enumerate(head_keys(kinds, before, first)):
        head, of_kind = heads(keys, place)
        assert there.tolist() == [i for i, w in enumerate(words) if len(w or b"") >= place]
        assert of_kind[number].tolist() == kinds[there].tolist()
        assert [bytes(x[:place + 1]) for x in head.bytes[number]] == [(words[i] + b" " if words[i] else b"\n")[:place + 1] for i in there]


def test_contexts_cross_word_borders():
    first, last = edges([b"one", b"word", b"ore", b"word"])
    before = before_words(last, np.array([True, False, True, False]))[[1, 3]]  # "word" after "one" and after "ore"
    whole, kinds = decisions(spelled([b"word"]), np.zeros(1, np.int64))[0], np.zeros(2, np.int64)
    for place, (keys, _, number) in enumerate(head_keys(kinds, before, first[[1, 3]])):
        head, of_kind = heads(keys, place)
        cells = [x[number] for x in decisions(spelled(head), of_kind)[0]]
        differ = [bool((x[0] != x[1]).any()) for x in cells]
        assert differ == [[False, False, True, True, False, False], [False, False, False, True, False, False], [False] * 6][place]
        assert all((x[0] == y[place]).all() for x, y in zip(cells[4:], whole[4:]))  # the word so far is the same everywhere
    rest = decisions(spelled([b"word"], HEAD), np.zeros(1, np.int64))[0]
    assert all((x == y[HEAD:]).all() for x, y in zip(rest, whole))


def test_slices_of_a_block_keep_the_bytes_before(monkeypatch):
    rng = random.Random(2)
    texts = [[bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 9))] + [b""] for _ in range(60)]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    first, last = edges(list(number))
    documents = {"counts": np.array([len(t) for t in texts]), "numbers": planes(np.array([number[w] for t in texts for w in t])),
                 "first": planes(first), "last": planes(last)}
    rows = lambda: [(which.start + d, *x) for which, owner, *rest in lm_scoring.read_along(documents) for d, *x in zip(owner, *rest)]
    whole = rows()
    assert [r[0] for r in whole] == [i for i, t in enumerate(texts) for _ in t]
    for size in (1, 2, 7):
        monkeypatch.setattr(lm_scoring, "TEXT_WORDS", size)
        assert rows() == whole


def test_scores_follow_the_order_of_words(spark):
    rng = random.Random(4)
    pairs = ["kalu zu", "tiri ro", "mopa pe", "suno xi"]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    inside = " ".join(pairs * 10)
    rows = [(i, " ".join(rng.choice(pairs) for _ in range(30))) for i in range(400) if i not in held[:2]]
    rows += [(held[0], inside), (held[1], " ".join(sorted(inside.split())))]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right, wrong = got[held[0]], got[held[1]]
    assert math.isclose(right.base_score, wrong.base_score, rel_tol=1e-9) and right.score > wrong.score + 10


def stages_by_hand(spark, docs, folder):
    """The pipeline from operators' reports and plain Python; rows as {id: text}."""
    kept = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    left = [(d, t) for (d, t), (_, c) in zip(left, brute_components(left)) if d == c]
    table = spark.createDataFrame(left, "doc_id long, text string")
    leaks = {r.doc_id for r in contaminated(table, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    return {r.doc_id: r.text for r in redact(table.where(~F.col("doc_id").isin(list(leaks)))).collect()}


def test_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = stages_by_hand(spark, docs, folder)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.decoded for r in got} == want and len(got) == len(want)
    for r in got[:200]:
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(want[r.doc_id]) and r.n_chars == len(want[r.doc_id])


def test_stages_of_awkward_rows(spark, rows, nothing, small):
    for table in (rows, nothing):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, small)
            assert k == 4 or docs.schema == rows.schema
        assert docs.count() <= table.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, small).count() <= rows.count()


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, small).columns == docs.columns


def test_one_per_component_with_clashing_names_and_differing_copies(spark):
    made = [(1, "a b c d e f", "de", 1, 2, {"k": 1}), (1, "a b c d e f", "aa", 1, 2, {"k": 2}), (1, "a b c d e f", "aa", 1, 2, {"k": 1}), (2, "a b c d e f", "en", 3, 4, None),
            (3, "other words in this one here", "fr", 5, 6, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, leader int, copy_number int, Leader_ map<string, int>")
    for rows in (docs, docs.orderBy(F.desc("lang")).repartition(3)):
        kept = one_per_component(rows)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.lang, r.leader, r.copy_number) for r in kept.collect()) == [(1, "aa", 1, 2), (3, "fr", 5, 6)]
    assert kept.where("doc_id = 1").first()["Leader_"] == {"k": 1}


def test_components_say_when_they_do_not_end(spark, monkeypatch):
    from doctrellis.llm import components as module

    monkeypatch.setattr(module, "ROUNDS", 1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    with pytest.raises(RuntimeError, match="still change"):
        components(edges)
