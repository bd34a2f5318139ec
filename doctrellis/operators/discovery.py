"""Wave-by-wave discovery over a reference graph, and plain graph reachability.

Every wave is written below a shared folder as ``<table>/wave=<n>`` before the next one
starts: that is the checkpoint, it cuts the lineage and it survives lost executors.  The walk
itself is in ``walk``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import _col, all_matches, carried, dirname, let, lines_of
from ..session import durable_dir
from .facts import holding, is_comment_line, md_lines


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{durable_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_MASK_BITS = 1 << 26


def may_be_among(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` may be one of the names: all that are, and few others while names are fewer than ``_MASK_BITS``.

    Names are marked by hash in words of 64 bits, so what goes out to all tasks is bounded: at
    most a million words, whatever the number of names.  A join of what is left decides.
    """
    place = F.pmod(F.xxhash64(column), F.lit(_MASK_BITS))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    marks = names.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_mark"))
    mask = marks.groupBy("_word").agg(F.bit_or("_mark").alias("_marks"))
    met = rows.withColumn("_word", word).join(F.broadcast(mask), "_word").filter(F.bit_get("_marks", bit) == 1)
    return met.drop("_word", "_marks")


class WaveStore:
    """Tables of a walk, one folder per wave; some are laid out by a hash of their key as well."""

    SPREAD = 8  # parts of a bucket that are written apart, as one key may have most rows
    ROW_GROUP = 16 << 20  # bytes that a task holds of each bucket it writes in place

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root, self.buckets = spark, root, buckets

    def write(self, table: str, wave: int, df: DataFrame) -> DataFrame:
        """Write one wave and return it read back; rewriting a wave replaces it."""
        path = f"{self.root}/{table}/wave={wave}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def wave(self, table: str, wave: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/wave={wave}")

    def write_buckets(self, table: str, wave: int, df: DataFrame, key: str, spread: str) -> None:
        """Write one wave in folders by a hash of ``key``; ``spread`` cuts what one key has."""
        part = F.pmod(F.xxhash64(spread), F.lit(self.SPREAD))
        laid = df.withColumn("bucket", bucket_of(key, self.buckets)).repartition("bucket", part).sortWithinPartitions("bucket", key)
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table}/wave={wave}")

    def write_in_place(self, table: str, wave: int, df: DataFrame, key: str) -> None:
        """Write one wave in folders by a hash of ``key``, each task for itself: no shuffle, and rows that lie together stay so.

        A task keeps a file of each bucket open, with small row groups, instead of sorting its rows by bucket.
        """
        laid = df.withColumn("bucket", bucket_of(key, self.buckets)).write.mode("overwrite").option("parquet.block.size", self.ROW_GROUP)
        before = self.spark.conf.get(_WRITERS)
        self.spark.conf.set(_WRITERS, self.buckets)
        try:
            laid.partitionBy("bucket").parquet(f"{self.root}/{table}/wave={wave}")
        finally:
            self.spark.conf.set(_WRITERS, before)

    def in_buckets(self, table: str, wave: int | str, buckets: list[int], schema) -> DataFrame:
        """What one wave, or all (``*``), has in some buckets: the folders of others aren't opened."""
        read = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
        rows = read.parquet(f"{self.root}/{table}/wave={wave}")
        return rows if len(buckets) == self.buckets else rows.filter(F.col("bucket").isin(buckets))

    def read(self, table: str, schema) -> DataFrame:
        """All waves so far, with the wave number as a column."""
        return (
            self.spark.read.option("basePath", f"{self.root}/{table}").schema(schema)
            .parquet(f"{self.root}/{table}/wave=*")
            .withColumn("wave", F.regexp_extract(F.col("_metadata.file_path"), r"wave=(\d+)", 1).cast("int"))
        )


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, depth)``: nodes reachable from ``seeds(node)`` along ``edges(src, dst)``.

    Breadth first: each wave joins only the newest nodes with the edges, drops what is
    known, and stops when nothing is new or at ``max_depth``.
    """
    spark = edges.sparkSession
    store = WaveStore(spark, work_folder(spark, "reach"))
    graph = store.write("edges", 0, edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    newest = store.write("nodes", 0, seeds.select("node").distinct())
    schema = newest.schema
    depth, size = 0, newest.count()
    while size and (max_depth is None or depth < max_depth):
        depth += 1
        known = store.read("nodes", schema).select("node")
        stepped = (
            graph.join(newest.withColumnRenamed("node", "src"), "src")
            .select(F.col("dst").alias("node")).distinct()
            .join(known, "node", "left_anti")
        )
        newest = store.write("nodes", depth, stepped)
        size = newest.count()
    return store.read("nodes", schema).select("node", F.col("wave").alias("depth"))


@dataclass
class CodeIndex:
    """``tokens(file, line, symbol, is_comment, derived, passed)`` and
    ``formals(callee, position, formal, callee_file)``.

    ``places``, if given, are the same tokens with the text of their line unread; a walk keeps
    those and reads the lines of hits alone (``read_places``).
    """

    tokens: DataFrame
    formals: DataFrame
    places: DataFrame | None = None


_STRING = r"""\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^'\\\\]|\\\\.)*'""".replace("\\\\", "\\")


def calls_of(text: Column) -> Column:
    """``array<string>`` of the calls ``name(arguments)`` in a line, inner ones first.

    String literals are emptied.  From the inside out, each call is noted and its brackets and
    commas become blanks, so that the outer call keeps its own arguments apart; a line without
    brackets left is done.
    """
    def peel(state: Column, _: Column) -> Column:
        parts = F.regexp_extract_all(state["rest"], F.lit(r"(\([^()]*\)|[^()]+|[()])"), 1)
        opened = F.transform(parts, lambda x: F.when(F.rlike(x, F.lit(r"^\([^()]*\)$")), F.translate(x, "(),", "   ")).otherwise(x))
        inner = F.regexp_extract_all(state["rest"], F.lit(r"(?<!def )(?<!class )\b([A-Za-z_]\w*\([^()]*\))"), 1)
        peeled = F.struct(F.array_join(opened, "").alias("rest"), F.concat(state["found"], inner).alias("found"))
        return F.when(F.contains(state["rest"], F.lit("(")), peeled).otherwise(state)

    def calls(bare: Column) -> Column:
        levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(bare, F.lit(r"\("))))
        start = F.struct(bare.alias("rest"), F.array().cast("array<string>").alias("found"))
        return F.aggregate(levels, start, peel, lambda s: s["found"])

    return let(F.regexp_replace(text, _STRING, "''"), calls)


_DEFINE = r"^\s*(?:def|class|function|func|fn)\s+([A-Za-z_]\w*)"
_WORD = r"([A-Za-z_]\w*)"
_READ = "struct<is_comment: boolean, derived: array<string>, passed: array<struct<callee: string, position: int>>>"
LONG_LINE = 200  # characters; the text of a longer line is not repeated for each name on it


def _arguments_of(text: Column) -> Column:
    """``array<struct<callee, position, words>>``: one per argument of a call, with the identifiers in it."""
    return F.flatten(F.transform(
        F.when(~F.rlike(text, F.lit(_DEFINE)) & F.contains(text, F.lit("(")), calls_of(text)),
        lambda call: F.transform(
            F.split(F.regexp_extract(call, r"\((.*)\)$", 1), ","),
            lambda a, i: F.struct(
                F.regexp_extract(call, r"^(\w+)\(", 1).alias("callee"), i.alias("position"), F.regexp_extract_all(a, F.lit(_WORD), 1).alias("words"),
            ),
        ),
    )).cast("array<struct<callee: string, position: int, words: array<string>>>")


def _targets_of(text: Column, enclosing: Column) -> Column:
    lhs = F.regexp_extract(text, r"^\s*(?:[\w.]*\.)?([A-Za-z_]\w*)\s*=[^=]", 1)
    return F.array_compact(F.array(enclosing, F.nullif(lhs, F.lit(""))))


def _read_for(symbol: Column, is_comment: Column, targets: Column, arguments: Column) -> Column:
    """What a line holds for one of its names."""
    passed = F.transform(
        F.filter(arguments, lambda a: F.array_contains(a["words"], symbol)),
        lambda a: F.struct(a["callee"].alias("callee"), a["position"].alias("position")),
    )
    return F.struct(is_comment.alias("is_comment"), F.array_distinct(F.filter(targets, lambda d: d != symbol)).alias("derived"), passed.alias("passed")).cast(_READ)


def read_places(places: DataFrame, *more: str) -> DataFrame:
    """Tokens from places whose lines are still to be read."""
    text, symbol = F.col("text"), F.col("symbol")
    now = _read_for(symbol, is_comment_line("file", "text"), _targets_of(text, F.col("enclosing")), _arguments_of(text))
    return places.select("file", "line", "symbol", F.coalesce("read", now).alias("read"), *more).select("file", "line", "symbol", "read.*", *more)


def code_index(files: DataFrame) -> CodeIndex:
    """Index of source files ``(path, text)``, as large as the files themselves.

    There is one token row per distinct identifier on a line.  ``derived`` lists the symbols
    a hit propagates to everywhere (HIGH): the enclosing definition and an assignment target.
    ``passed`` lists the calls it is an argument of, as ``struct<callee, position>``; which
    parameters those are is looked up for hits alone, so a name that many files define and
    many call costs nothing until it is reached.

    The enclosing definition is carried along the lines inside the row of a file.  Few places
    are ever hit, so a place keeps the text of its line and what the line holds is read from a
    hit; only lines of more than ``LONG_LINE`` characters are read before they are laid out.
    """
    split = files.select(F.col("path").alias("file"), lines_of("text").alias("text"))
    defined = split.withColumn("_def", F.transform("text", lambda t: F.nullif(F.regexp_extract(t, _DEFINE, 1), F.lit(""))))
    enclosed = (
        defined.withColumn("enclosing", carried(F.col("_def")))
        .select("file", F.posexplode(F.arrays_zip("text", "enclosing")).alias("pos", "l"))
        .select("file", (F.col("pos") + 1).alias("line"), "l.*")
        .filter(F.rlike("text", F.lit(r"\w")))
    )
    formals = (
        split.select("file", F.explode("text").alias("text"))
        .filter(F.contains("text", F.lit("(")))
        .withColumn("_def", F.regexp_extract("text", _DEFINE, 1)).filter("_def <> ''")
        .select(
            F.col("_def").alias("callee"), F.col("file").alias("callee_file"),
            F.posexplode(F.split(F.regexp_extract("text", r"\(([^)]*)\)", 1), ",")).alias("position", "formal"),
        )
        .select("callee", "position", F.regexp_extract("formal", r"^\s*([A-Za-z_]\w*)", 1).alias("formal"), "callee_file")
        .filter("formal <> ''").distinct()
    )
    long = F.length("text") > LONG_LINE
    noted = F.when(long, F.struct(
        is_comment_line("file", "text").alias("is_comment"), _targets_of(F.col("text"), F.col("enclosing")).alias("targets"),
        _arguments_of(F.col("text")).alias("arguments"),
    ))
    places = enclosed.select(
        "file", "line", F.when(~long, F.col("text")).alias("text"), F.when(~long, F.col("enclosing")).alias("enclosing"), noted.alias("_noted"),
        F.array_distinct(all_matches("text", _WORD)).alias("_symbols"),
    ).select("file", "line", "text", "enclosing", "_noted", F.explode("_symbols").alias("symbol")).select(
        "file", "line", "symbol", "text", "enclosing",
        F.when(F.col("_noted").isNotNull(), _read_for(F.col("symbol"), F.col("_noted.is_comment"), F.col("_noted.targets"), F.col("_noted.arguments"))).alias("read"),
    )
    return CodeIndex(read_places(places), formals, places)


def noisy_symbols(hits: DataFrame, max_files: int) -> DataFrame:
    """HIGH symbols found in strictly more than ``max_files`` distinct files."""
    return (
        hits.filter("confidence = 'HIGH'").select("symbol", "file").distinct()
        .groupBy("symbol").agg(F.count(F.lit(1)).alias("n_files")).filter(F.col("n_files") > max_files)
    )


def representatives(hits: DataFrame, max_files: int) -> DataFrame:
    """Per symbol the first line of each of its first ``max_files`` files, by path."""
    per_file = hits.groupBy("symbol", "file").agg(F.min("line").alias("line"))
    by_path = Window.partitionBy("symbol").orderBy("file")
    return per_file.withColumn("_n", F.row_number().over(by_path)).filter(F.col("_n") <= max_files).drop("_n")


def reconcile_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """raw = recorded + dedup + filtered + collapsed, per command; absent reasons count 0."""
    def n(reason: str) -> Column:
        return F.count_if(F.col("reason") == reason)

    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw"), n("recorded").alias("recorded"), n("dedup").alias("dedup"),
        n("comment").alias("filtered"), n("noise-collapse").alias("collapsed"),
    ).withColumn("balanced", F.expr("raw = recorded + dedup + filtered + collapsed"))


def close_pending(pending: DataFrame, choice: str | None, pauses: int) -> DataFrame:
    """Status of the symbols a paused walk left: what was chosen, else ``paused``.

    ``choice`` is ``prune``, ``record`` or ``out-of-scope``; a second pause is recorded
    without asking.
    """
    if choice not in (None, "prune", "record", "out-of-scope"):
        raise ValueError(f"unknown choice {choice}")
    return pending.withColumn("status", F.lit("record" if pauses > 1 else choice or "paused"))


def number_rows(rows: DataFrame, wave: str, label: str, numbered: str, name: str = "row_id") -> DataFrame:
    """``W{wave}-{label}{n}`` identifiers from a per-wave position column."""
    return rows.withColumn(name, F.format_string(f"W%s-{label}%d", F.col(wave).cast("string"), F.col(numbered)))


def neighbour(of: Column | str, other: Column | str) -> Column:
    """Relation of two folders at depth one: ``same``, ``parent``, ``child`` or NULL."""
    of, other = _col(of), _col(other)
    return (
        F.when(of == other, "same")
        .when(dirname(of) == other, "parent")
        .when(dirname(other) == of, "child")
    )


def with_priority(frontier: DataFrame, confirmed_dirs: DataFrame, folder: str = "dir") -> DataFrame:
    """HIGH when the folder is, contains or lies directly in a confirmed folder, else LOW.

    The neighbourhood (each folder, its parent, and marks for its children) is an equi-join
    on folder names; nobody compares all folders with all others.
    """
    confirmed = confirmed_dirs.select(F.col("dir").alias("_d")).distinct()
    near = confirmed.select(F.explode(F.array("_d", dirname("_d"))).alias(folder)).distinct().withColumn("_near", F.lit(True))
    parents = confirmed.select(F.col("_d").alias("_parent"), F.lit(True).alias("_child")).distinct()
    return (
        frontier.withColumn("_parent", dirname(folder))
        .join(near, folder, "left").join(parents, "_parent", "left")
        .withColumn("priority", F.when(F.col("_near").isNotNull() | F.col("_child").isNotNull(), "HIGH").otherwise("LOW"))
        .drop("_near", "_child", "_parent")
    )


_IDENTIFIER = r"^[A-Za-z_]\w*$"
_NAMES = r"([A-Za-z_][\w.]*)"


def symbol_links(files: DataFrame) -> DataFrame:
    """``(src, dst, kind, file, line)``: names that a change of ``src`` reaches before any search.

    ``subclass``: from a class or interface to what extends or implements it; ``alias``: from an
    imported or exported name to the name it gets; ``entry``: from a file's path to what it
    defines.  Of dotted names the last part counts.
    """
    lines = holding(files, "class", "interface", "import", "export", "def", "func", "fn ").transform(md_lines)
    text = F.col("text")
    heir = F.regexp_extract(text, r"\b(?:class|interface)\s+([A-Za-z_]\w*)", 1)
    bases = F.concat_ws(
        ",", F.regexp_extract(text, r"^\s*class\s+\w+\s*\(([^)]*)\)", 1), F.regexp_extract(text, r"\bextends\s+([\w.,\s]+?)(?:\bimplements\b|\{|$)", 1),
        F.regexp_extract(text, r"\bimplements\s+([\w.,\s]+)", 1),
    )
    # keyword arguments of a class head are no bases
    parents = F.regexp_extract_all(F.regexp_replace(bases, r"\w+\s*=[^,]*", ""), F.lit(_NAMES), F.lit(1))
    named = r"([A-Za-z_][\w.]*\s+as\s+[A-Za-z_]\w*)"
    aliases = F.when(F.rlike(text, F.lit(r"^\s*(?:from|import|export)\b")), F.regexp_extract_all(text, F.lit(named), F.lit(1)))
    defined = F.regexp_extract(text, r"^\s*(?:export\s+)?(?:def|class|interface|function|func|fn)\s+([A-Za-z_]\w*)", 1)

    def last_part(name: Column) -> Column:
        return F.substring_index(name, ".", -1)

    def link(src: Column, dst: Column, kind: str) -> Column:
        return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))

    links = F.concat(
        F.when(heir != "", F.transform(parents, lambda p: link(last_part(p), heir, "subclass"))).otherwise(F.array()),
        F.coalesce(F.transform(aliases, lambda a: link(last_part(F.regexp_extract(a, r"^(\S+)", 1)), F.regexp_extract(a, r"(\S+)$", 1), "alias")), F.array()),
        F.when(defined != "", F.array(link(F.col("path"), defined, "entry"))).otherwise(F.array()),
    ).cast("array<struct<src: string, dst: string, kind: string>>")
    return lines.select(F.inline(links), F.col("path").alias("file"), "line")


def expand_seeds(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(symbol, depth)``: seeds and all that subclasses, aliases and entry points lead to.

    A seed may be a symbol, a dotted or ``self.`` form, of which the last part is searched, or
    the path of a file.
    """
    form = F.rlike("symbol", F.lit(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$"))
    starts = seeds.select(F.explode(F.array_distinct(F.array("symbol", F.when(form, F.substring_index("symbol", ".", -1)).otherwise(F.col("symbol"))))).alias("node"))
    found = reach(links.select("src", "dst"), starts)
    return found.filter(F.rlike("node", F.lit(_IDENTIFIER))).select(F.col("node").alias("symbol"), "depth")


def definition_scopes(files: DataFrame) -> DataFrame:
    """``(file, name, start, end)``: line ranges of definitions, by indentation, nested ones too."""
    lines = F.transform(lines_of("text"), lambda t, i: F.struct(
        (i + 1).alias("line"), F.length(F.regexp_extract(t, r"^(\s*)", 1)).alias("indent"),
        F.regexp_extract(t, r"^\s*(?:export\s+)?(?:async\s+)?(?:def|class|interface|function|func|fn)\s+([A-Za-z_]\w*)", 1).alias("name"), (F.trim(t) != "").alias("filled"),
    ))
    held = holding(files, "def", "class", "interface", "func", "fn ").select(F.col("path").alias("file"), F.filter(lines, lambda x: x["filled"]).alias("lines"))
    # a definition ends before the next line that is not indented more
    ranges = F.transform(F.filter("lines", lambda d: d["name"] != ""), lambda d: F.struct(
        d["name"].alias("name"), d["line"].alias("start"),
        F.coalesce(
            F.array_min(F.transform(F.filter("lines", lambda x: (x["line"] > d["line"]) & (x["indent"] <= d["indent"])), lambda x: x["line"])) - 1,
            F.element_at("lines", -1)["line"],
        ).alias("end"),
    ))
    return held.select("file", F.inline(ranges))


def in_scopes(hits: DataFrame, scopes: DataFrame) -> DataFrame:
    """Hits ``(symbol, file, line)`` with ``scope`` and ``scope_start`` of the nearest definition around them, or NULL."""
    around = hits.select("symbol", "file", "line").distinct().join(scopes, "file").filter(F.col("line").between(F.col("start"), F.col("end")))
    nearest = around.groupBy("symbol", "file", "line").agg(F.max_by("name", F.struct("start", F.negative("end"))).alias("scope"), F.max("start").alias("scope_start"))
    return hits.join(nearest, ["symbol", "file", "line"], "left")
