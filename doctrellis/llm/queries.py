"""Queries of this package's operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import byte_bpe
from .common import crc_fold, table
from .decontaminate import contaminated
from .divergence import source_divergence
from .jaccard_join import jaccard_components
from .line_blocks import extract
from .lm_scoring import lm_scores
from .quality_model import fit_quality, quality_scores
from .quality_rules import quality_rules
from .secret_scan import digests, secret_spans
from .token_counts import token_counts
from .token_store import token_store
from .vector_search import nearest
from .whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


@query("op1_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


@query("op2_quality_model")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs, fold = table(spark, folder, "documents"), crc_fold("doc_id", 3)
    model = fit_quality(docs, table(spark, folder, "labels"), "quality", fold != 1)
    scores = quality_scores(docs, model)
    return scores.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_lm_scoring")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))


@query("op4_byte_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = byte_bpe(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_quality_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


@query("op7_token_store")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return token_store(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return digests(secret_spans(table(spark, folder, "documents")))


@query("op9_line_blocks")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


@query("op10_decontaminate")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings")).drop("deviation_exact")


@query("op12_nearest_vectors")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


@query("op13_divergence_audit", r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
g AS MATERIALIZED (SELECT x.lang, x.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS lang_n,
  coalesce((SELECT sum(c.n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l ON l.lang = x.lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + g.v)::HUGEINT AS p, coalesce(c.n, 0) AS n,
  1 + 1000000000::HUGEINT * (k.n + 1) // (g.lang_n + g.v)::HUGEINT AS q
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))
