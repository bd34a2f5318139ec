"""Row-local Markdown facts: one document in, arrays of facts out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import _col, all_matches, first_match, let, lines_of, normalize_heading, trim_u


def sorted_set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def lint_heading(line: Column | str) -> Column:
    """Title of a level-2-or-deeper heading line, NULL for other lines (not normalised)."""
    return first_match(line, K.LINT_HEADING)


def any_heading(line: Column | str) -> Column:
    """Title of a level-1-to-6 heading line, NULL for other lines."""
    return first_match(line, K.ANY_HEADING)


def _marked(lines: Column) -> Column:
    """Lines that start with a heading mark: a cheap test in front of the patterns."""
    return F.filter(lines, lambda x: F.startswith(x, F.lit("#")))


def headings(lines: Column) -> Column:
    return sorted_set(F.array_compact(F.transform(_marked(lines), lambda x: trim_u(any_heading(x)))))


def lint_titles(lines: Column) -> Column:
    """Distinct level-2-or-deeper headings in compare form."""
    return F.array_distinct(
        F.array_compact(F.transform(_marked(lines), lambda x: normalize_heading(lint_heading(x))))
    )


def is_table_row(line: Column | str) -> Column:
    """A pipe is the first and the last character that is not white space."""
    return F.rlike(_col(line), F.lit(r"(?U)^\s*\|(?:.*\|)?\s*$"))


def is_fence(line: Column | str) -> Column:
    return F.rlike(_col(line), F.lit(r"(?U)^\s*" + K.CODE_FENCE))


def _is_rule(line: Column) -> Column:
    return F.contains(line, F.lit("---")) & F.rlike(line, F.lit(r"(?U)^\s*---\s*$"))  # most lines need no pattern


def _before(array: Column, position: Column) -> Column:
    """Elements in front of a 1-based position."""
    return F.slice(array, 1, F.greatest(position - 1, F.lit(0)))


def frontmatter_lines(lines: Column) -> Column:
    """Lines between the opening rule on line 1 and the next rule (or the end)."""
    def body(all_lines: Column) -> Column:
        rest = F.slice(all_lines, 2, F.size(all_lines))
        inside = let(
            F.array_position(F.transform(rest, _is_rule), True),
            lambda close: F.when(close > 0, _before(rest, close)).otherwise(rest),
        )
        return F.when(_is_rule(F.get(all_lines, F.lit(0))), inside).otherwise(F.array().cast("array<string>"))

    return let(lines, body)


def frontmatter_keys(lines: Column) -> Column:
    keys = F.transform(frontmatter_lines(lines), lambda x: F.regexp_extract(x, K.FRONTMATTER_KEY, 1))
    return sorted_set(F.filter(keys, lambda k: k != ""))


def frontmatter_map(lines: Column) -> Column:
    """Flat key/value pairs; the last entry wins when a key repeats."""
    pairs = F.filter(
        F.transform(
            frontmatter_lines(lines),
            lambda x: F.struct(
                F.regexp_extract(x, K.FRONTMATTER_KEY, 1).alias("key"),
                trim_u(F.regexp_replace(x, K.FRONTMATTER_KEY, "")).alias("value"),
            ),
        ),
        lambda p: p["key"] != "",
    )

    def last_wins(entries: Column) -> Column:
        names = F.transform(entries, lambda p: p["key"])
        return F.filter(
            entries,
            lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(entries)), p["key"]),
        )

    return F.map_from_entries(let(pairs, last_wins))


def artifact_ids(text: Column | str) -> Column:
    return sorted_set(all_matches(text, K.ARTIFACT_ID))


def unreplaced_tokens(text: Column | str) -> Column:
    return sorted_set(all_matches(text, K.UNREPLACED, 0))


def placeholders(text: Column | str) -> Column:
    return sorted_set(all_matches(text, K.PLACEHOLDER))


def quoted_keys(text: Column | str) -> Column:
    return sorted_set(all_matches(text, K.QUOTED_KEY))


def mermaid_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(K.MERMAID_FENCE)).cast("bigint")


def structural_properties(text: Column | str) -> Column:
    """Struct of sorted fact sets and counts for one document."""
    return let(
        lines_of(text),
        lambda lines: F.struct(
            headings(lines).alias("headings"),
            frontmatter_keys(lines).alias("frontmatter_keys"),
            artifact_ids(text).alias("ids"),
            unreplaced_tokens(text).alias("unreplaced_tokens"),
            F.size(F.filter(lines, is_table_row)).cast("bigint").alias("table_row_count"),
            mermaid_count(text).alias("mermaid_count"),
        ),
    )


def table_cells(line: Column | str) -> Column:
    """Cells of a pipe row: outer pipes dropped, split on the others, each trimmed; ``\\|`` is text."""
    inner = F.regexp_replace(F.regexp_replace(trim_u(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(trim_u(c), F.lit("\\|"), F.lit("|")))


def logical_lines(text: Column | str) -> Column:
    """Lines with trailing-backslash continuations merged, as ``struct<line, text>``.

    Each line carries its 1-based number through the merge, so the number that survives
    is that of the first physical line.
    """
    numbered = F.transform(
        lines_of(text), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\x01"), x)
    )
    merged = F.regexp_replace(
        F.regexp_replace(F.array_join(numbered, "\n"), "\\\\\n[0-9]+\x01", " "), r"\\$", " "
    )
    return F.transform(
        F.filter(F.split(merged, "\n", -1), lambda x: x != ""),
        lambda x: F.struct(
            F.substring_index(x, "\x01", 1).cast("int").alias("line"),
            F.regexp_replace(x, "^[0-9]+\x01", "").alias("text"),
        ),
    )


def set_frontmatter_value(text: Column | str, key: str, value: Column | str) -> Column:
    """Replace the first ``key:`` line of the front matter or add one at its end.

    Text without a closed front matter stays as it is.
    """
    text = _col(text)
    value = F.lit(value) if isinstance(value, str) else value
    rule, new_line = F.array(F.lit("---")), F.array(F.concat(F.lit(f"{key}: "), value))
    ending = F.when(F.endswith(text, F.lit("\n")), "\n").otherwise("")

    def with_key(block: Column) -> Column:
        return let(
            F.array_position(F.transform(block, lambda x: F.rlike(x, F.lit(rf"(?U)^\s*{key}\s*:"))), True),
            lambda at: F.when(
                at > 0, F.concat(_before(block, at), new_line, F.slice(block, (at + 1).cast("int"), F.size(block)))
            ).otherwise(F.concat(block, new_line)),
        )

    def rebuilt(rest: Column, close: Column) -> Column:
        block = let(_before(rest, close), with_key)
        tail = F.slice(rest, (close + 1).cast("int"), F.size(rest))
        return F.concat(F.array_join(F.concat(rule, block, rule, tail), "\n"), ending)

    def body(lines: Column) -> Column:
        return let(
            F.slice(lines, 2, F.size(lines)),
            lambda rest: let(
                F.array_position(F.transform(rest, _is_rule), True),
                lambda close: F.when(
                    _is_rule(F.get(lines, F.lit(0))) & (close > 0), rebuilt(rest, close)
                ).otherwise(text),
            ),
        )

    return let(lines_of(text), body)
