"""Unicode-aware string expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ltrim_u(c: Column | str) -> Column:
    """Drop leading white space, the ideographic space included."""
    return F.regexp_replace(_col(c), r"(?U)^\s+", "")


def rtrim_u(c: Column | str) -> Column:
    """Drop trailing white space, the ideographic space included."""
    return F.regexp_replace(_col(c), r"(?U)\s+$", "")


def trim_u(c: Column | str) -> Column:
    return rtrim_u(ltrim_u(c))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Expressions inside higher-order functions are not shared by the optimizer; a lambda
    variable is computed once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def carried(values: Column) -> Column:
    """For each element of an array the last one so far that is not NULL.

    Each run between two values is one repetition, so the work is linear in the array and
    nothing is shuffled or sorted for it.
    """
    size = F.size(values)
    marked = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("at"), v.alias("v"))), lambda m: m["v"].isNotNull())

    def runs(marks: Column) -> Column:
        before = F.array_repeat(F.get(values, F.lit(-1)), F.coalesce(F.get(marks, F.lit(0))["at"], size))
        return F.concat(F.array(before), F.transform(
            marks, lambda m, j: F.array_repeat(m["v"], F.coalesce(F.get(marks, j + 1)["at"], size) - m["at"])
        ))

    return F.flatten(let(marked, runs))


_BLOCK = 512  # states that are put together before they are set aside


def scanned(rows: Column, state: str, step) -> Column:
    """The state after each element of an array; ``step(last, element)`` gives the next one, ``last`` is NULL at first.

    States are collected in blocks, so the work is linear in the array for all sizes that a row
    has, and nothing is shuffled or sorted for it.
    """
    none = F.array().cast(f"array<{state}>")
    start = F.struct(none.alias("block"), F.array().cast(f"array<array<{state}>>").alias("blocks"))

    def put(kept: Column, element: Column) -> Column:
        block, full = kept["block"], F.size(kept["block"]) >= _BLOCK
        following = F.array(step(F.get(block, F.size(block) - 1), element))
        return F.struct(
            F.concat(F.when(full, none).otherwise(block), following).alias("block"),
            F.when(full, F.concat(kept["blocks"], F.array(block))).otherwise(kept["blocks"]).alias("blocks"),
        )

    return F.aggregate(rows, start, put, lambda kept: F.flatten(F.concat(kept["blocks"], F.array(kept["block"]))))


def repeated(keys: Column) -> Column:
    """For each element of an array of texts whether another one is equal; NULL has no equal.

    Found by sorting inside the row, so an array with many equal keys is not quadratic.
    """
    by_key = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    marked = let(by_key, lambda s: F.transform(s, lambda x, j: F.struct(
        x["i"].alias("i"), F.coalesce((F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]), F.lit(False)).alias("same"),
    )))
    told = F.array_compact(keys)
    return F.when(F.size(told) == F.size(F.array_distinct(told)), F.array_repeat(F.lit(False), F.size(keys))).otherwise(
        F.transform(F.sort_array(marked), lambda x: x["same"])
    )


def lines_of(c: Column | str) -> Column:
    """Array of lines; a final line break does not open another, empty line.

    Nearly all texts break lines with line feeds alone; those take a plain split, the
    pattern is left to texts that hold any other line break.
    """
    text = _col(c)
    feed = F.lit("\n")
    body = F.when(F.endswith(text, feed), F.left(text, F.length(text) - 1)).otherwise(text)
    closed = F.regexp_replace(text, f"(?:{K.LINE_BREAK})\\z", "")
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(~F.rlike(text, F.lit(K.OTHER_BREAK)), F.split(body, "\n", -1))
        .otherwise(F.split(closed, K.LINE_BREAK, -1))
    )


def all_matches(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group))


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First capture, or NULL when the pattern does not match (evaluates the pattern once)."""
    return F.get(all_matches(c, pattern, group), F.lit(0))


def normalize_heading(c: Column | str) -> Column:
    """Compare form of a heading: no leading marks, no single trailing parenthesis."""
    bare = trim_u(F.regexp_replace(_col(c), "^#+", ""))
    return trim_u(F.regexp_replace(bare, K.TRAILING_PARENTHESIS, ""))


def mask_dates(c: Column | str) -> Column:
    return trim_u(F.regexp_replace(_col(c), K.ISO_DATE, K.DATE_MASK.replace("{", "\\{")))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """File name without its last suffix; a name that only starts with a dot keeps it."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)\.([^.]*)$", 1))


def dirname(path: Column | str) -> Column:
    """Everything before the last slash; empty at the top."""
    return F.when(F.instr(_col(path), "/") > 0, F.regexp_replace(_col(path), "/[^/]*$", "")).otherwise("")


def resolve_path(ref: Column | str, home_prefix: str, repo_prefix: str) -> Column:
    """Map a reference under ``home_prefix`` into the corpus; NULL when it cannot be resolved.

    A reference holding a ``{`` is still a template, any other prefix is out of reach.
    """
    ref = _col(ref)
    return F.when(
        ~F.contains(ref, F.lit("{")) & F.startswith(ref, F.lit(home_prefix)),
        F.concat(F.lit(repo_prefix), F.substr(ref, F.lit(len(home_prefix) + 1))),
    )


def contains_any(c: Column | str, words) -> Column:
    """Sorted array of the words that occur in the text (plain substring test)."""
    text = _col(c)
    hits = F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])
    return F.array_sort(F.array_compact(hits))


def changed_under(path: Column | str, prefixes) -> Column:
    """Whether a changed path lies under one of the prefixes that a check watches."""
    tests = [F.startswith(_col(path), F.lit(p)) for p in prefixes]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))
