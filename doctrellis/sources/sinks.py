"""Writing snapshots, goldens, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str) -> None:
    """Mirror: whatever the destination held is replaced."""
    df.write.mode("overwrite").parquet(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Create once; an existing destination is left untouched."""
    df.write.mode("ignore").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only JSON-lines log; earlier entries are never rewritten."""
    df.write.mode("append").json(path)


def write_responses(df: DataFrame, path: str, phase: str = "phase") -> None:
    """Raw responses for later diagnosis, one folder per phase."""
    df.write.mode("overwrite").partitionBy(phase).json(path)


def golden_json(profiles: DataFrame, name: str = "path") -> DataFrame:
    """One pretty JSON object per document profile; non-ASCII text is kept as it is."""
    members = [c for c in profiles.columns if c != name]
    return profiles.select(name, F.to_json(F.struct(*members), {"pretty": "true"}).alias("json"))


def write_report(rendered: DataFrame, path: str, column: str = "rendered") -> None:
    """Text report, one line per row, ordered by file and line across part files."""
    rendered.orderBy("file", "line").select(column).write.mode("overwrite").text(path)


def write_tsv(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def flat_requirements(elements: DataFrame) -> DataFrame:
    """Spreadsheet rows: one per requirement element, each kind of id in its own column."""
    def when(kind: str):
        return F.when(F.col("kind") == kind, F.coalesce("id", "name"))

    return elements.select(
        "path", "line",
        when("category").alias("category"), when("UR").alias("ur"), when("group").alias("group_name"),
        when("SR").alias("sr"), when("spec_group").alias("spec_group"), when("SP").alias("sp"),
        F.coalesce("name", F.lit("")).alias("title"), F.coalesce("reason", F.lit("")).alias("reason"),
    )


def write_goldens(goldens: DataFrame, root: str, name: str = "doc_set", json: str = "json") -> None:
    """One file per document set, ``doc_set=<name>/part-*.json``, each object closed by a newline.

    Rows of a set go to one task by its name; sets are written side by side.
    """
    goldens.select(name, F.col(json).alias("value")).repartition(name).write.mode("overwrite").partitionBy(name).text(root)


def read_golden_files(spark, root: str, name: str = "doc_set") -> DataFrame:
    """``(doc_set, json)`` of what ``write_goldens`` wrote; names stay text, with all their zeros."""
    return spark.read.schema(f"value string, `{name}` string").text(root, wholetext=True).select(name, F.col("value").alias("json"))
