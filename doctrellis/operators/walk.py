"""The discovery walk: wave by wave from seed symbols to all files that they affect.

A walk lives in a folder.  The index lies there in buckets by a hash of the symbol, so a wave
opens the buckets of its frontier only, and so do the locations that were met, by file.  Each
wave ends with a row in the append-only ``log``: its counts by reason, and how many symbols
are to be searched next or were put off.  The log is the state: a walk that is started again
goes on after the last wave whose tables have the rows that its log row says, and does again
what broke off.

Symbols that come from folders of low priority are put off: they wait in a table of their own
until nothing of high priority is left, so what they lead to is found later but not lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import dirname
from .discovery import CodeIndex, WaveStore, bucket_of, may_be_among, noisy_symbols, number_rows, read_places, reconcile_counts, representatives, with_priority, work_folder
from .ordered import RowNumber, ordered_scan

SYMBOL = ["symbol", "scope_file", "confidence", "priority", "origin", "origin_file", "origin_line"]
_FRONTIER = "symbol string, scope_file string, confidence string, priority string, origin string, origin_file string, origin_line int"
_LOG = ("waves int, frontier bigint, deferred bigint, waiting bigint, raw bigint, recorded bigint, dedup bigint, filtered bigint, collapsed bigint, "
        "backend string, warning string, buckets int, opened int")
_LOG_COLUMNS = [tuple(c.split()) for c in _LOG.split(", ")]
_REASONS = {"recorded": "recorded", "dedup": "dedup", "filtered": "comment", "collapsed": "noise-collapse"}
JUDGED = "reason in ('recorded', 'dedup')"
LIVE = "reason in ('recorded', 'noise-collapse') and (relevant or noisy)"
BACKENDS = {"auto": "index", "index": "index"}


@dataclass
class Frontier:
    """Symbols to be searched, how many, and the buckets of the index with those for everywhere and for one file."""

    rows: DataFrame
    size: int
    everywhere: list[int]
    scoped: list[int]


def _measured(rows: DataFrame, buckets: int) -> Frontier:
    def of(test):
        return F.collect_set(F.when(test, bucket_of("symbol", buckets)))  # at most ``buckets`` numbers

    found = rows.agg(F.count(F.lit(1)).alias("n"), of(F.col("scope_file").isNull()).alias("e"), of(F.col("scope_file").isNotNull()).alias("s")).first()
    return Frontier(rows, found.n, sorted(found.e), sorted(found.s))


def _priorities(rows: DataFrame, store: WaveStore, priority) -> DataFrame:
    """Rows with the priority of the folder of their ``file``."""
    if priority is None:
        return rows.withColumn("priority", F.lit("HIGH"))
    if isinstance(priority, DataFrame):  # a catalogue of top folders; what it lacks is HIGH
        known = priority.select(F.col("dir").alias("_dir"), F.col("priority").alias("_p")).dropDuplicates(["_dir"])
        return rows.join(known, F.substring_index("file", "/", 1) == F.col("_dir"), "left").withColumn("priority", F.coalesce("_p", F.lit("HIGH"))).drop("_dir", "_p")
    return with_priority(rows.withColumn("_dir", dirname("file")), store.wave("dirs", 0), "_dir").drop("_dir")


def _next_symbols(spread: DataFrame, formals: DataFrame) -> DataFrame:
    """Symbols that propagating hits lead to, one row each.

    The origin is the first hit, by symbol, file and line; the best priority of all hits counts.
    """
    origin = F.struct(F.col("symbol").alias("origin"), F.col("file").alias("origin_file"), F.col("line").alias("origin_line")).alias("o")
    named = spread.select(origin, "priority", F.explode("derived").alias("symbol")).select(
        "o", "priority", "symbol", F.lit(None).cast("string").alias("scope_file"), F.lit("HIGH").alias("confidence"),
    )
    passed = (
        spread.select(origin, "priority", F.col("symbol").alias("actual"), F.inline("passed"))
        .join(formals, ["callee", "position"]).filter("actual <> formal")
        .select("o", "priority", F.col("formal").alias("symbol"), F.col("callee_file").alias("scope_file"), F.lit("MEDIUM").alias("confidence"))
    )
    return named.unionByName(passed).groupBy("symbol", "scope_file", "confidence").agg(F.min("o").alias("o"), F.min("priority").alias("priority")).select(
        "symbol", "scope_file", "confidence", "priority", "o.*"
    )


def _unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose symbol is searched neither everywhere nor in their scope."""
    everywhere = known.filter("scope_file is null").select("symbol")
    return rows.join(everywhere, "symbol", "left_anti").join(
        known.select(F.col("symbol").alias("_ks"), F.col("scope_file").alias("_kf")),
        (F.col("symbol") == F.col("_ks")) & F.col("scope_file").eqNullSafe(F.col("_kf")), "left_anti",
    ).select(*SYMBOL)


def with_folders(rows: DataFrame) -> StructType:
    """The schema of rows that lie in folders by wave and bucket."""
    return StructType([*rows.schema.fields, StructField("wave", IntegerType()), StructField("bucket", IntegerType())])


class Walk:
    """Tables of one walk and the steps of a wave."""

    FEW = 100_000  # symbols that Spark may send to all tasks as they are

    def __init__(self, index: CodeIndex, root: str, buckets: int):
        self.spark = index.tokens.sparkSession
        self.unread = index.places is not None
        self.laid = index.places if self.unread else index.tokens
        self.tokens, self.formals = with_folders(self.laid), with_folders(index.formals)
        self.store = WaveStore(self.spark, root, buckets)

    def log(self) -> DataFrame:
        return self.store.read("log", self.spark.createDataFrame([], _LOG).schema).drop("wave")

    def commit(self, wave: int, frontier: Frontier, deferred: int, waiting: int, counts, backend: str, warning: str | None, opened: int) -> None:
        """Wave ``wave`` is whole; written last."""
        row = (wave, frontier.size, deferred, waiting, *counts, backend, warning, self.store.buckets, opened)
        columns = [F.lit(value).cast(kind).alias(name) for value, (name, kind) in zip(row, _LOG_COLUMNS)]
        self.store.write("log", wave, self.spark.range(1).select(*columns))

    def last(self):
        """The log row of the last whole wave, if the folder holds a walk; a wave whose tables lack rows isn't whole."""
        try:
            rows = sorted(self.log().collect(), key=lambda r: -r.waves)  # a row for each wave
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return next((r for r in rows if self.whole(r)), None)

    def whole(self, row) -> bool:
        tables = [("frontier", row.waves, row.frontier)]
        if row.waves:
            tables += [("hits", row.waves - 1, row.raw), ("deferred", row.waves, row.deferred)]
        try:
            return all(self.store.wave(name, n).count() == rows for name, n, rows in tables)
        except AnalysisException:
            return False

    def start(self, index: CodeIndex, seeds: DataFrame) -> None:
        store = self.store
        store.write_in_place("index", 0, self.laid, "symbol")
        store.write_buckets("formals", 0, index.formals, "callee", "callee_file")
        none = {"origin": "string", "origin_file": "string", "origin_line": "int"}
        rows = seeds.select("symbol").distinct().select(
            "symbol", F.lit(None).cast("string").alias("scope_file"), F.lit("HIGH").alias("confidence"), F.lit("HIGH").alias("priority"),
            *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()],
        )
        frontier = _measured(store.write("frontier", 0, rows), store.buckets)
        store.write("dropped", 0, rows.filter("false"))
        self.commit(0, frontier, 0, 0, (0,) * 5, "index", None, 0)

    def table(self, name: str, upto: int) -> DataFrame:
        """All waves of a table of symbols up to one."""
        return self.store.read(name, self.spark.createDataFrame([], _FRONTIER).schema).filter(F.col("wave") <= upto)

    def known(self, wave: int) -> DataFrame:
        """What was or is to be searched, or was dropped."""
        searched = self.table("frontier", wave).select("symbol", "scope_file")
        return searched.unionByName(self.table("dropped", wave).select("symbol", "scope_file")).distinct()

    def put_off(self, wave: int) -> DataFrame:
        """Deferred symbols that nothing has searched since, one row each."""
        first = F.min(F.struct("priority", "origin", "origin_file", "origin_line")).alias("o")
        rows = self.table("deferred", wave).groupBy("symbol", "scope_file", "confidence").agg(first).select("symbol", "scope_file", "confidence", "o.*")
        return _unknown(rows, self.known(wave))

    def found(self, wave: int, frontier: Frontier) -> DataFrame:
        """Locations of the frontier's symbols; one that is searched everywhere is not searched in a file as well."""
        def read(buckets: list[int]) -> DataFrame:
            rows = self.store.in_buckets("index", 0, buckets, self.tokens).drop("bucket", "wave")
            # A large frontier is joined by shuffling: most of the index stays out of that.
            return may_be_among(rows, wanted.select("symbol"), "symbol") if frontier.size > self.FEW else rows

        wanted = frontier.rows.select("symbol", "scope_file", "confidence")
        everywhere = wanted.filter("scope_file is null").drop("scope_file")
        rows = read(frontier.everywhere).join(everywhere, "symbol") if frontier.everywhere or not frontier.scoped else None
        if frontier.scoped:
            scoped = wanted.filter("scope_file is not null").withColumnRenamed("scope_file", "file").join(everywhere, "symbol", "left_anti")
            scoped = read(frontier.scoped).join(scoped, ["symbol", "file"])
            rows = scoped if rows is None else rows.unionByName(scoped)
        rows = read_places(rows, "confidence") if self.unread else rows
        return self.store.write("matched", wave, rows.select("symbol", "file", "line", "confidence", "is_comment", "derived", "passed"))

    def seen(self, wave: int, found: DataFrame) -> DataFrame:
        """Locations that earlier waves recorded, in the buckets of the files that were found."""
        files = found.agg(F.collect_set(bucket_of("file", self.store.buckets)).alias("b")).first().b  # at most ``buckets`` numbers
        rows = self.store.in_buckets("seen", "*", sorted(files), with_folders(found.select("file", "line"))).filter(F.col("wave") < wave)
        return rows.select("file", "line", F.lit(True).alias("_seen")).distinct()


def discover(
    index: CodeIndex, seeds: DataFrame, max_files: int, max_waves: int, collapse: bool = True,
    comment_filter: bool = True, classify=None, root: str | None = None, dropped: DataFrame | None = None,
    priority: DataFrame | str | None = None, resolve=None, backend: str = "auto", buckets: int = 32,
) -> dict[str, DataFrame]:
    """Walk from ``seeds(symbol)``; returns ``hits``, ``frontier``, ``confirmed``, ``counts``,
    ``metrics``, ``pending``, ``deferred`` and ``log``.

    Reaching ``max_waves`` pauses the walk and loses nothing: ``pending`` holds the symbols
    that were found but not searched, put off or not (see ``close_pending``).  Given a ``root``
    folder that holds a walk, it goes on after its last whole wave; ``dropped(symbol)`` then
    leaves symbols out of what waits (prune, record or out of scope).

    Per wave: match the frontier against the index, set comment lines and locations that
    an earlier wave met aside (kept, with the reason), test what remains for noise, keep
    representatives of noisy symbols, derive the next frontier from the symbols that are not
    noisy.  A location that was met before is counted once, but another symbol on it still
    propagates.  All files of noisy symbols are confirmed all the same, and locations are
    the same with and without ``collapse``, so results do not depend on it.

    ``priority`` puts symbols off that only come from folders of low priority: ``neighbours``
    rates folders that wave 0 confirms, their parents and children HIGH and others LOW; a table
    ``(dir, priority)`` rates top folders, and those that it lacks are HIGH.

    ``classify(hits) -> DataFrame`` may add a boolean ``relevant`` per (symbol, file,
    line); a hit it leaves without a class stops the wave before anything is committed.
    ``resolve(rows) -> DataFrame`` may take out rows of MEDIUM symbols that are new in several
    scopes.  ``backend`` names how to search; one that isn't there is replaced by the index,
    which the log says.
    """
    spark = index.tokens.sparkSession
    walk = Walk(index, root or work_folder(spark, "discover"), buckets)
    state = walk.last()
    if state is None:
        walk.start(index, seeds)
        state = walk.last()
    walk.store.buckets = state.buckets  # as the folder was laid out
    store, wave, waiting = walk.store, state.waves, state.waiting
    used = BACKENDS.get(backend, "index")
    warning = None if backend in BACKENDS else f"search backend {backend} is not there; searched with {used}"
    frontier = _measured(store.wave("frontier", wave), store.buckets)
    if dropped is not None:
        gone = dropped.select("symbol").distinct()
        left = walk.put_off(wave) if waiting else None
        frontier = _measured(frontier.rows.join(gone, "symbol", "left_anti"), store.buckets)
        if left is not None:
            store.write("dropped", wave, left.join(gone, "symbol", "left_semi"))
    hit_schema = store.wave("hits", 0).schema if wave else None
    if not frontier.size and waiting and wave < max_waves:
        frontier, waiting = _measured(store.write("frontier", wave, walk.put_off(wave)), store.buckets), 0
        walk.commit(wave, frontier, state.deferred, 0, [state[c] for c in ("raw", *_REASONS)], state.backend, state.warning, state.opened)
    while frontier.size and wave < max_waves:
        opened = len({*frontier.everywhere, *frontier.scoped})
        found = walk.found(wave, frontier)
        tagged = found.join(walk.seen(wave, found), ["file", "line"], "left") if wave else found.withColumn("_seen", F.lit(None).cast("boolean"))
        aside = F.when(F.col("is_comment") & F.lit(comment_filter), "comment").when(F.col("_seen").isNotNull(), "dedup")
        judged = tagged.withColumn("reason", aside).drop("_seen", "is_comment")
        noisy = noisy_symbols(judged.filter("reason is null"), max_files).select("symbol", F.lit(True).alias("noisy"))
        marked = judged.join(noisy, "symbol", "left").withColumn("noisy", F.col("noisy").isNotNull())
        if collapse:
            kept = representatives(marked.filter("noisy and reason is null"), max_files).withColumn("_kept", F.lit(True))
            marked = marked.join(kept, ["symbol", "file", "line"], "left").withColumn(
                "reason", F.when(F.col("noisy") & F.col("_kept").isNull() & F.col("reason").isNull(), "noise-collapse").otherwise(F.col("reason"))
            ).drop("_kept")
        hits = marked.withColumn("reason", F.coalesce("reason", F.lit("recorded"))).withColumn("relevant", F.lit(True))
        if classify is not None:
            classes = classify(hits.filter(JUDGED).drop("relevant")).select("symbol", "file", "line", "relevant")
            hits = hits.drop("relevant").join(classes, ["symbol", "file", "line"], "left")
            if not hits.filter(f"{JUDGED} and relevant is null").isEmpty():
                raise ValueError(f"wave {wave}: hits without a class; nothing was committed")
            hits = hits.withColumn("relevant", F.coalesce("relevant", F.lit(True)))
        hits = store.write("hits", wave, hits.select("symbol", "file", "line", "confidence", "derived", "passed", "reason", "noisy", "relevant"))
        hit_schema = hits.schema
        store.write_buckets("seen", wave, hits.filter("reason in ('recorded', 'noise-collapse')").select("file", "line").distinct(), "file", "line")
        if not wave and isinstance(priority, str):
            store.write("dirs", 0, hits.filter(LIVE).select(dirname("file").alias("dir")).distinct())

        counts = hits.agg(F.count(F.lit(1)), *[F.count_if(F.col("reason") == reason) for reason in _REASONS.values()]).first()
        spread = _priorities(hits.filter(f"{JUDGED} and relevant and not noisy"), store, priority)
        formals = store.in_buckets("formals", 0, list(range(store.buckets)), walk.formals).drop("bucket", "wave")
        fresh = _unknown(_next_symbols(spread, formals), walk.known(wave))
        if resolve is not None:
            fresh = _resolved(fresh, resolve)
        wave += 1
        if priority is None:
            deferred, chosen = 0, store.write("frontier", wave, fresh)
            store.write("deferred", wave, fresh.filter("false"))
        else:
            both = store.write("fresh", wave, fresh)  # derived once, told apart twice
            deferred = store.write("deferred", wave, both.filter("priority = 'LOW'")).count()
            chosen = store.write("frontier", wave, both.filter("priority = 'HIGH'"))
        waiting += deferred
        frontier = _measured(chosen, store.buckets)
        if not frontier.size and waiting and wave < max_waves:
            frontier, waiting = _measured(store.write("frontier", wave, walk.put_off(wave)), store.buckets), 0
        walk.commit(wave, frontier, deferred, waiting, counts, used, warning, opened)

    if hit_schema is None:
        empty = index.tokens.filter("false").select("symbol", "file", "line", F.lit("HIGH").alias("confidence"), "derived", "passed").withColumns({
            "reason": F.lit("recorded"), "noisy": F.lit(False), "relevant": F.lit(True),
        })
        hit_schema = store.write("hits", 0, empty).schema
    all_hits = store.read("hits", hit_schema).filter(F.col("wave") < max(wave, 1))
    live_hits = all_hits.filter(LIVE)
    pending = frontier.rows.unionByName(walk.put_off(wave)) if waiting else frontier.rows
    return {
        "hits": all_hits,
        "frontier": walk.table("frontier", wave),
        "confirmed": live_hits.groupBy("file").agg(F.min("confidence").alias("confidence")),
        "counts": reconcile_counts(all_hits, ["wave", "symbol"]),
        "metrics": reconcile_counts(all_hits, ["wave"]),
        "pending": pending,
        "deferred": walk.table("deferred", wave) if wave else walk.table("frontier", -1),
        "log": walk.log().filter(F.col("waves") <= wave),
    }


def _resolved(fresh: DataFrame, resolve) -> DataFrame:
    """``resolve`` decides on MEDIUM symbols that are new in several scopes; the others stay."""
    medium = F.col("confidence") == "MEDIUM"
    several = fresh.filter(medium).groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("symbol")
    asked = fresh.filter(medium).join(several, "symbol", "left_semi")
    kept = resolve(asked).select("symbol", "scope_file", F.lit(True).alias("_kept"))
    decided = fresh.join(several.withColumn("_several", F.lit(True)), "symbol", "left").join(kept, ["symbol", "scope_file"], "left")
    return decided.filter(~medium | F.col("_several").isNull() | F.col("_kept").isNotNull()).select(*SYMBOL)


def numbered(walk: dict[str, DataFrame], segments: int) -> DataFrame:
    """All rows of the walk with their ``row_id`` and ``command_id``.

    A wave searches everywhere with its first command, then each file that a scope names with
    one of its own, in order of path.  Rows are numbered through a wave by command, symbol,
    file and line; ``segments`` cuts waves that have most rows.
    """
    scopes = walk["frontier"].select("wave", "scope_file").distinct()
    everywhere = scopes.groupBy("wave").agg(F.count_if(F.col("scope_file").isNull()).alias("_first"))
    commands = ordered_scan(scopes.filter("scope_file is not null"), ["wave"], ["scope_file"], {"_n": RowNumber()}, segments=segments).join(everywhere, "wave")
    commands = commands.select("wave", F.col("scope_file").alias("_scope"), (F.col("_n") + F.col("_first")).alias("_command"))
    rows = walk["hits"].withColumn("_scope", F.when(F.col("confidence") == "MEDIUM", F.col("file")))
    rows = rows.join(commands, ["wave", "_scope"], "left").withColumn("_command", F.coalesce("_command", F.lit(1).cast("bigint")))
    placed = ordered_scan(rows, ["wave"], ["_command", "symbol", "file", "line"], {"_n": RowNumber()}, segments=segments)
    named = number_rows(number_rows(placed, "wave", "R", "_n"), "wave", "C", "_command", "command_id")
    return named.drop("_n", "_command", "_scope")


def walk_view(walk: dict[str, DataFrame]) -> DataFrame:
    """The state to be read by people, ``(section, wave, item, line)``: made from the log and what waits, never edited."""
    log = walk["log"].withColumn("_mark", F.when(F.expr("raw = recorded + dedup + filtered + collapsed"), "").otherwise(" (counts differ)"))
    waves = log.filter("waves > 0").select(
        F.lit("wave").alias("section"), (F.col("waves") - 1).alias("wave"), F.lit("").alias("item"),
        F.format_string(
            "- wave %d: %d rows = %d recorded + %d known + %d filtered + %d collapsed; next %d, put off %d%s", F.col("waves") - 1,
            "raw", "recorded", "dedup", "filtered", "collapsed", "frontier", "deferred", "_mark",
        ).alias("line"),
    )
    warned = log.filter("warning is not null").select(F.lit("warning").alias("section"), (F.col("waves") - 1).alias("wave"), F.lit("").alias("item"), F.concat(F.lit("- "), "warning").alias("line"))
    scope = F.when(F.col("scope_file").isNull(), F.lit("")).otherwise(F.concat(F.lit(" in `"), F.col("scope_file"), F.lit("`")))
    pending = walk["pending"].select(
        F.lit("pending").alias("section"), F.lit(None).cast("int").alias("wave"), F.col("symbol").alias("item"),
        F.concat(F.lit("- [ ] `"), "symbol", F.lit("`"), scope, F.when(F.col("priority") == "LOW", F.lit(" (put off)")).otherwise("")).alias("line"),
    )
    return waves.unionByName(warned).unionByName(pending)
