"""Reference-integrity checks.  Each returns ``(check, severity, file, line, message)``.

Facts are computed once; a missing reference shows up as a NULL after a left join with the
distinct definitions, so no check scans the corpus more often than it has inputs.  The
distinct right sides keep a popular definition to one row, and the left sides are plain
equi-join inputs that adaptive execution can split when one target is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import all_matches, basename
from . import facts


def _violation(check: str, severity, file: str, line, message: Column) -> list[Column]:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    line = F.lit(line) if isinstance(line, int) else F.col(line)
    return [
        F.lit(check).alias("check"), severity.alias("severity"), F.col(file).alias("file"),
        line.cast("int").alias("line"), message.alias("message"),
    ]


def check_apply(docs: DataFrame, targets: DataFrame, home_prefix: str, repo_prefix: str) -> DataFrame:
    """Every apply must name a heading of the file read last."""
    refs = facts.resolved_refs(docs, home_prefix, repo_prefix)
    files = targets.select(F.col("path").alias("target"), F.lit(True).alias("_file"))
    titles = facts.lint_headings(targets).select(
        F.col("path").alias("target"), "heading", F.lit(True).alias("_title")
    )
    joined = refs.join(files, "target", "left").join(titles, ["target", "heading"], "left")
    return joined.filter("_file is null or _title is null").select(
        *_violation(
            "A", "error", "path", "line",
            F.when(F.col("_file").isNull(), F.format_string("apply %s: file %s does not exist", "heading", "target"))
            .otherwise(F.format_string("apply %s: no such heading in %s", "heading", "target")),
        )
    )


def check_agents(docs: DataFrame, agents: DataFrame) -> DataFrame:
    """Calls must reach a definition, and pass only keys the definition mentions."""
    calls = facts.agent_calls(docs)
    # Calls are as many as the documents: they pass by the definitions and are not sorted for that.
    definitions = facts.agent_definitions(agents).select("agent", "has_section", "tokens").hint("shuffle_hash")
    unknown = F.array_sort(F.array_except("passed_required", "tokens"))
    state = (
        F.when(F.col("has_section").isNull(), "undefined")
        .when(~F.col("has_section"), "no-section")
        .when(~F.col("parsed"), "no-payload")
        .otherwise("checked")
    )
    judged = calls.join(definitions, "agent", "left").withColumn("state", state).select(
        "path", "line", "agent", "state",
        F.explode_outer(F.when(F.col("state") == "checked", unknown).otherwise(F.array(F.lit("")))).alias("key"),
    )
    message = (
        F.when(F.col("state") == "undefined", F.format_string("agent %s has no definition", "agent"))
        .when(F.col("state") == "no-section", F.format_string("agent %s declares no inputs; contract not compared", "agent"))
        .when(F.col("state") == "no-payload", F.format_string("call of %s has no payload block; contract not compared", "agent"))
        .otherwise(F.format_string("key %s is not mentioned by agent %s", "key", "agent"))
    )
    severity = F.when(F.col("state") == "undefined", "error").otherwise("warning")
    return judged.filter("key is not null").select(*_violation("B", severity, "path", "line", message))


def check_agent_names(agents: DataFrame) -> DataFrame:
    """A definition's ``name:`` must equal its file stem; a missing name is tolerated."""
    named = facts.agent_definitions(agents)
    return named.filter("name is not null and name <> agent").select(
        *_violation("B", "error", "path", 1, F.format_string("name %s differs from file name %s", "name", "agent"))
    )


def check_placeholders(docs: DataFrame, examples=K.EXAMPLE_PLACEHOLDERS) -> DataFrame:
    """Template placeholders that no other document mentions."""
    tokens = facts.placeholder_tokens(docs)
    in_templates = tokens.filter(F.col("template") & ~F.col("token").isin(*examples))
    mentioned = tokens.filter(~F.contains("path", F.lit("/templates/"))).select("token").distinct()
    return in_templates.join(mentioned, "token", "left_anti").select(
        *_violation("C", "warning", "path", 0, F.format_string("placeholder %s is never mentioned", "token"))
    )


def parse_help(help_text: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogue from captured help output ``(script, subcommand, text)``.

    ``subcommand`` is empty for the top-level help.  Returns ``scripts(script, available,
    has_subs)``, ``subs(script, subcommand)`` and ``flags(script, subcommand, flag)``.
    """
    groups = F.transform(
        all_matches("text", K.HELP_GROUP),
        lambda g: F.filter(F.split(g, ","), lambda p: p != ""),
    )
    usable = F.filter(groups, lambda g: (F.size(g) >= 2) | F.exists(g, lambda p: F.contains(p, F.lit("-"))))
    top = help_text.filter("subcommand = ''").select(
        "script", F.length(F.trim("text")).alias("n"), F.array_distinct(F.flatten(usable)).alias("subs")
    )
    scripts = top.select("script", (F.col("n") > 0).alias("available"), (F.size("subs") > 0).alias("has_subs"))
    subs = top.select("script", F.explode("subs").alias("subcommand")).distinct()
    flags = help_text.select(
        "script", "subcommand", F.explode(all_matches("text", f"({K.FLAG})")).alias("flag")
    ).distinct()
    return scripts, subs, flags


def check_wiring(calls: DataFrame, scripts: DataFrame, subs: DataFrame, flags: DataFrame,
                 allowed: DataFrame | None = None) -> DataFrame:
    """Script calls must name catalogued subcommands and flags.

    ``allowed(script)`` restricts the calls to scripts under control.  A call without a
    subcommand to a script that has some is not judged, its flags included.
    """
    if allowed is not None:
        calls = calls.join(allowed.select("script").distinct(), "script", "left_semi")
    known = scripts.groupBy("script").agg(
        F.bool_or("available").alias("available"), F.bool_or("has_subs").alias("has_subs")
    )
    sub_flags = subs.select("script", "subcommand").distinct().withColumn("_sub", F.lit(True))
    flag_set = flags.select("script", F.col("subcommand").alias("_scope"), "flag").distinct().withColumn("_flag", F.lit(True))
    judged = (
        calls.join(known, "script", "left")
        .join(sub_flags, ["script", "subcommand"], "left")
        .withColumn(
            "state",
            F.when(F.col("has_subs").isNull(), "missing")
            .when(~F.col("available"), "unavailable")
            .when(F.col("has_subs") & F.col("subcommand").isNull(), "skip")
            .when(F.col("has_subs") & F.col("_sub").isNull(), "bad-subcommand")
            .otherwise("flags"),
        )
        .filter("state <> 'skip'")
    )
    per_flag = judged.select(
        "path", "line", "seq", "script", "subcommand", "state",
        F.explode_outer(F.when(F.col("state") == "flags", F.col("flags"))).alias("flag"),
        F.when(F.col("has_subs"), F.col("subcommand")).otherwise("").alias("_scope"),
    ).filter("state <> 'flags' or flag is not null")
    label = F.concat_ws(" ", "script", "subcommand")
    message = (
        F.when(F.col("state") == "missing", F.format_string("%s is not in the catalogue; call not compared", "script"))
        .when(F.col("state") == "unavailable", F.format_string("%s gives no help; call not compared", "script"))
        .when(F.col("state") == "bad-subcommand", F.format_string("%s has no subcommand %s", "script", "subcommand"))
        .otherwise(F.format_string("%s has no flag %s", label, F.col("flag")))
    )
    severity = F.when(F.col("state").isin("missing", "unavailable"), "warning").otherwise("error")
    return (
        per_flag.join(flag_set, ["script", "_scope", "flag"], "left")
        .filter("state <> 'flags' or _flag is null")
        .select(*_violation("D", severity, "path", "line", message))
    )


def run_checks(docs: DataFrame, agents: DataFrame, home_prefix: str, repo_prefix: str,
               checks: str = "ABCD", catalogue: tuple | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Bag union of the selected checks in the order A, B(name), B(contract), C, D.

    Check A looks at skills and agents alike; the others at the side they concern.
    Branches that are not selected are never planned.
    """
    both = docs.select("path", "text").unionByName(agents.select("path", "text"))
    parts = []
    if "A" in checks:
        parts.append(check_apply(both, both, home_prefix, repo_prefix))
    if "B" in checks:
        parts += [check_agent_names(agents), check_agents(docs, agents)]
    if "C" in checks:
        parts.append(check_placeholders(docs))
    if "D" in checks and catalogue is not None:
        parts.append(check_wiring(facts.script_calls(docs), *catalogue, allowed=allowed))
    return reduce(DataFrame.unionByName, parts)


def first_script(files: DataFrame) -> DataFrame:
    """``(script, path)``: for each script name the first path below a ``scripts`` folder."""
    return (
        files.filter(F.rlike("path", F.lit(r"(^|/)scripts/[^/]+$")))
        .groupBy(basename("path").alias("script"))
        .agg(F.min("path").alias("path"))
    )
