"""Fact tables that follow a corpus: only documents that are new or changed are extracted again.

A folder holds, for each version, the facts of the documents that this version extracted and a
manifest ``(path, digest, version)`` of all documents, which says in which version's folder the
facts of a document lie.  What a version extracts and writes follows the change; the manifest is
a narrow row per document.  A version that is run again writes the same folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Extract = Callable[[DataFrame], DataFrame]


def digest(docs: DataFrame) -> DataFrame:
    """``(path, digest)``, one row per path; a path that is there twice has the greatest digest."""
    return docs.groupBy("path").agg(F.max(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))


def refresh_facts(docs: DataFrame, extract: Extract, root: str, version: int) -> DataFrame:
    """Bring the facts below ``root`` up to ``docs(path, text)`` as ``version`` (from 1 on, one after the other).

    ``extract(docs)`` gives rows with a ``path``; returns the facts of all documents that are there.
    A document without facts is in the manifest alone; one that is gone is in no newer manifest.
    """
    spark = docs.sparkSession
    now = digest(docs)
    if version > 1:
        before = spark.read.parquet(f"{root}/manifest/version={version - 1}")
        now = now.join(before.withColumnRenamed("version", "_at"), ["path", "digest"], "left")
        now = now.select("path", "digest", F.coalesce("_at", F.lit(version)).alias("version"))
    else:
        now = now.withColumn("version", F.lit(version))
    now.write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    changed = spark.read.parquet(f"{root}/manifest/version={version}").filter(F.col("version") == version)
    own = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).join(changed.select("path", "digest"), ["path", "digest"], "left_semi")
    extract(own.dropDuplicates(["path"]).select(*docs.columns)).write.mode("overwrite").parquet(f"{root}/facts/version={version}")
    return facts_at(spark, root, version)


def facts_at(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The facts of one version's documents."""
    manifest = spark.read.parquet(f"{root}/manifest/version={version}").select("path", "version")
    schema = spark.read.parquet(f"{root}/facts/version={version}").schema
    facts = spark.read.option("basePath", f"{root}/facts").schema(schema.add("version", "integer")).parquet(*[f"{root}/facts/version={v}" for v in range(1, version + 1)])
    return facts.join(manifest, ["path", "version"], "left_semi").drop("version")
