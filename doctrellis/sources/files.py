"""Reading document trees, goldens and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import _col

GOLDEN_SCHEMA = (
    "headings array<string>, frontmatter_keys array<string>, ids array<string>, "
    "unreplaced_tokens array<string>, table_row_count bigint, mermaid_count bigint, "
    "required_headings array<string>, _corrupt_record string"
)


def _relative(root: str) -> Column:
    """Path below ``root``; file paths arrive URL-encoded."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    bare_root = root.rstrip("/").split("://")[-1] if "://" in root else root.rstrip("/").removeprefix("file:")
    at = F.instr(plain, bare_root + "/")
    return F.substr(plain, at + len(bare_root) + 1)


def read_tree(spark: SparkSession, root: str, recursive: bool = True, glob: str = "*.md") -> DataFrame:
    """``(path, text, mtime)``: one row per file; unreadable or vanished files are left out.

    Small files are packed into shared tasks by the file source; a file is never split, as
    its text is one value.  Order the result by path where an order matters.
    """
    return (
        spark.read.option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", glob)
        .option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
        .text(root, wholetext=True)
        .select(
            _relative(root).alias("path"), F.col("value").alias("text"),
            F.col("_metadata.file_modification_time").alias("mtime"),
        )
    )


def read_goldens(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_set, ..., corrupt)``: one row per golden file, the set named after the file or, as
    ``write_goldens`` leaves them, after its folder ``doc_set=<name>``.

    Every member is optional; a file that is not JSON shows up as ``corrupt``, so that the
    next refresh can replace it entirely.
    """
    parsed = F.from_json(F.col("text"), GOLDEN_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    folder = F.regexp_extract("path", r"^doc_set=([^/]*)/[^/]+$", 1)
    # Spark escapes some characters in the names of such folders
    name = F.when(folder != "", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(F.regexp_replace("path", r"\.json$", ""))
    found = read_tree(spark, root, glob="{*.json,part-*}").filter((folder != "") | F.rlike("path", F.lit(r"^[^/]+\.json$")))
    return found.select(
        name.alias("doc_set"), parsed.alias("g")
    ).select("doc_set", "g.*").withColumn("corrupt", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON-lines log."""
    return spark.read.schema(schema).option("ignoreMissingFiles", "true").json(path)


def artifact_globs(rows: DataFrame, folders: DataFrame, phase: str, override: str | None = None) -> DataFrame:
    """Adds ``folder``, the folder pattern a row's phase writes to.

    ``folders(phase, pattern)`` is the caller's table, one row per phase; a pattern that the
    row configures itself (column ``override``) wins, an unknown phase has none.
    """
    known = folders.select(F.col("phase").alias(phase), F.col("pattern").alias("_pattern"))
    own = F.col(override) if override else F.lit(None).cast("string")
    return rows.join(known, phase, "left").withColumn("folder", F.coalesce(own, F.col("_pattern"))).drop("_pattern")


def first_folder(folders: DataFrame, wanted: DataFrame, root: str = "") -> DataFrame:
    """``(key, folder)``: the first folder, by path, that fits each key's pattern, else the root.

    ``folders(path)``, ``wanted(key, parent, name)``: both ends of a one-wildcard pattern are
    plain columns, so the match is an equi-join.
    """
    split = folders.select(
        "path", F.split_part("path", F.lit("/"), F.lit(1)).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name")
    )
    best = split.groupBy("parent", "name").agg(F.min("path").alias("folder"))
    return wanted.join(best, ["parent", "name"], "left").select("key", F.coalesce("folder", F.lit(root)).alias("folder"))


def test_suites(files: DataFrame) -> DataFrame:
    """Folders that directly hold test modules, with the number of modules."""
    return (
        files.filter(F.rlike("path", F.lit(r"(^|/)tests/test_[^/]+\.py$")))
        .groupBy(F.regexp_replace("path", "/[^/]+$", "").alias("suite"))
        .agg(F.count(F.lit(1)).alias("modules"))
    )


def staged_path(seed: Column | str, path: Column | str) -> Column:
    """Where a seed file goes in an isolated workspace; the shared base only with single seeds."""
    seed, path = _col(seed), _col(path)
    shared = F.startswith(path, F.lit("multi/"))
    return F.when(~shared, F.concat(F.lit("ws/"), path)).when(F.endswith(seed, F.lit("-single")), path)
