"""Structural profiles of documents and their comparison with golden profiles.

A profile of one document is a row of arrays (bounded by the document).  A profile of a
set of documents is kept long, one row per distinct fact, because a set may be any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import markdown as M
from ..functions.text import let, lines_of, trim_u
from ..session import cut_lineage
from .facts import artifact_files

EXTRACTED = ("heading", "frontmatter_key", "id", "unreplaced_token")


def document_profiles(docs: DataFrame) -> DataFrame:
    """One row per document; a pure projection."""
    return artifact_files(docs).select("path", M.structural_properties("text").alias("p")).select("path", "p.*")


def set_facts(docs: DataFrame, doc_set: str = "doc_set") -> DataFrame:
    """Distinct ``(doc_set, kind, value)``, headings date-masked for comparison."""
    def tag(kind: str, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    def masked(lines):
        return F.transform(
            M.headings(lines), lambda h: trim_u(F.regexp_replace(h, K.ISO_DATE, "\\" + K.DATE_MASK))
        )

    found = let(
        lines_of("text"),
        lambda lines: F.concat(
            tag("heading", masked(lines)),
            tag("frontmatter_key", M.frontmatter_keys(lines)),
            tag("id", M.artifact_ids("text")),
            tag("unreplaced_token", M.unreplaced_tokens("text")),
        ),
    )
    # Never NULL, so that no join downstream infers a test that would parse all texts twice.
    set_name = F.coalesce(F.col(doc_set), F.lit("")).alias("doc_set")
    return (
        artifact_files(docs).select(set_name, F.explode(found).alias("f"))
        .select("doc_set", "f.kind", "f.value").distinct()
    )


def set_counts(docs: DataFrame, doc_set: str = "doc_set") -> DataFrame:
    """``(doc_set, files, table_row_count, mermaid_count)``."""
    rows = F.size(F.filter(lines_of("text"), M.is_table_row)).cast("bigint")
    return (
        artifact_files(docs)
        .select(F.col(doc_set).alias("doc_set"), rows.alias("r"), M.mermaid_count("text").alias("m"))
        .groupBy("doc_set")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("r").alias("table_row_count"), F.sum("m").alias("mermaid_count"))
    )


def golden_facts(goldens: DataFrame) -> DataFrame:
    """Long form of golden rows ``(doc_set, headings, frontmatter_keys, ids, required_headings)``."""
    def tag(kind: str, column: str):
        nothing = F.array().cast("array<string>")
        return F.transform(
            F.coalesce(F.col(column), nothing), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
        )

    return goldens.select(
        "doc_set",
        F.explode(
            F.concat(
                tag("heading", "headings"), tag("frontmatter_key", "frontmatter_keys"),
                tag("id", "ids"), tag("required_heading", "required_headings"),
            )
        ).alias("f"),
    ).select("doc_set", "f.kind", "f.value").distinct()


def compare_with_golden(actual: DataFrame, golden: DataFrame) -> DataFrame:
    """``(doc_set, kind, value)`` of every violation.

    Missing required headings, ids and front-matter keys, and any token left unreplaced in
    the actual text, whether or not the golden recorded it.  Sets without a golden are not
    compared (see ``without_golden``).
    """
    required = golden.filter(F.col("kind").isin("required_heading", "id", "frontmatter_key"))
    sides = required.select(
        "doc_set", F.when(F.col("kind") == "required_heading", "heading").otherwise(F.col("kind")).alias("kind"),
        "value", F.col("kind").alias("expected"), F.lit(None).cast("boolean").alias("present"),
    ).unionByName(actual.select(
        "doc_set", "kind", "value", F.lit(None).cast("string").alias("expected"), F.lit(True).alias("present")
    ))
    # One aggregate over both sides: each input is read once and no value is hot.
    met = sides.groupBy("doc_set", "kind", "value").agg(F.max("expected").alias("expected"), F.max("present").alias("present"))
    judged = met.filter(
        (F.col("expected").isNotNull() & F.col("present").isNull()) | (F.col("kind") == "unreplaced_token")
    ).select(
        "doc_set",
        F.when(F.col("expected").isNotNull(), F.concat(F.lit("missing_"), "expected")).otherwise(F.col("kind")).alias("kind"),
        "value",
    )
    return judged.join(golden.select("doc_set").distinct(), "doc_set", "left_semi")


def without_golden(sets: DataFrame, golden: DataFrame) -> DataFrame:
    """Document sets that stop before any costly step because no golden exists."""
    return sets.select("doc_set").distinct().join(golden.select("doc_set").distinct(), "doc_set", "left_anti")


def refresh_golden(old: DataFrame, actual: DataFrame) -> DataFrame:
    """New extracted facts replace the old ones; hand-written kinds and other sets survive.

    The new facts are needed twice, so they are written down: texts are parsed once.
    """
    actual = cut_lineage(actual.select("doc_set", "kind", "value"))
    touched = actual.select("doc_set").distinct().withColumn("_new", F.lit(True))
    kept = old.join(touched, "doc_set", "left").filter(
        F.col("_new").isNull() | ~F.col("kind").isin(*EXTRACTED)
    )
    return kept.select("doc_set", "kind", "value").unionByName(actual)


SHORT_BLOCK = 2000  # passages of one or two words searched for together


def passages_found(items: DataFrame, docs: DataFrame, inner_words: int = 4) -> DataFrame:
    """``(item_id, contained)``: whether each passage occurs word for word in any document.

    ``items(item_id, text)`` meet ``docs(doc_id, text)`` on a key every document holding
    the passage must have, then the pair is checked on the full texts.  The key is a run of
    inner words (the first and last word may touch other text in the document); a passage
    of three to five words uses its longest inner word.  Shorter passages have no such key:
    they are a query set that every document is searched for in its row, ``SHORT_BLOCK``
    different ones at a time.  An empty passage is in every document.
    """
    white = r"(?U)\s+"
    words = F.split("text", white)
    sized = items.select("item_id", "text", words.alias("_w"), F.size(words).alias("_n"))
    word_docs = docs.select("doc_id", words.alias("_w"))

    def runs(n: int):
        starts = F.sequence(F.lit(1), F.size("_w") - (n - 1))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(F.col("_w"), i, n), " ")))

    enough = inner_words + 2
    inner = F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    tiers = [
        (sized.filter(F.col("_n") >= enough), F.array_join(F.slice("_w", 2, inner_words), " "),
         word_docs.filter(F.size("_w") >= inner_words), runs(inner_words)),
        (sized.filter((F.col("_n") >= 3) & (F.col("_n") < enough)), longest, word_docs, F.array_distinct("_w")),
    ]
    pairs = None
    for tier_items, key, tier_docs, keys in tiers:
        # Explode only keys: the text stays behind and is fetched for candidates alone.
        found = tier_docs.select("doc_id", F.explode(keys).alias("_key")).join(
            tier_items.select("item_id", key.alias("_key")), "_key"
        ).select("doc_id", "item_id")
        pairs = found if pairs is None else pairs.unionByName(found)
    hits = (
        pairs.distinct()
        .join(docs.select("doc_id", F.col("text").alias("_doc")), "doc_id")
        .join(items.select("item_id", F.col("text").alias("_passage")), "item_id")
        .filter(F.contains("_doc", F.col("_passage")))
        .select("item_id").distinct()
    )
    short = sized.filter((F.col("_n") < 3) & (F.length("text") > 0)).select("text").distinct()
    blocks = -(-short.count() // SHORT_BLOCK)
    for block in range(blocks):
        own = short.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).agg(F.array_agg("text").alias("_short"))
        # one row of about SHORT_BLOCK passages of at most two words
        held = docs.select(F.col("text").alias("_doc")).join(F.broadcast(own)).select(
            F.explode(F.filter("_short", lambda p: F.contains("_doc", p))).alias("text")
        ).distinct()
        hits = hits.unionByName(items.join(held, "text", "left_semi").select("item_id").distinct())
    some = docs.select(F.lit(True).alias("_hit")).limit(1)
    empty = items.filter(F.length("text") == 0).select("item_id").distinct().join(some)  # one row on the right
    hits = hits.withColumn("_hit", F.lit(True)).unionByName(empty)
    return items.select("item_id").join(hits, "item_id", "left").select(
        "item_id", F.coalesce("_hit", F.lit(False)).alias("contained")
    )
