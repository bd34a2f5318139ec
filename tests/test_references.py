"""Reference checks on inline documents: what they must find and must leave alone."""
from doctrellis.operators import facts, references

HOME, REPO = "~/.h/", "r/"


def docs(spark, **files):
    return spark.createDataFrame(list(files.items()) if files else [], "path string, text string")


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "path string, text string")


def rows(df):
    return sorted((r.check, r.severity, r.file, r.line) for r in df.collect())


def test_check_apply(spark):
    skill = "\n".join([
        "## Own (x)",
        'apply "## Own"',                                   # 2: no Read yet -> itself, fine
        "Read `~/.h/a.md` then Read `~/.h/b.md`",           # only the first Read counts
        'apply "## Good Heading" and apply "## Missing"',   # 4: one of two is wrong
        "Read `~/.h/{X}.md` Read `~/.h/b.md`",              # first unresolvable: line skipped
        'apply "## Good Heading"',                          # 6: still a.md
        "Read `~/.h/gone.md`",
        'apply "## Anything"',                              # 8: file missing
        'apply "## Late" after Read `~/.h/b.md`',           # 9: same line counts
    ])
    corpus = frame(spark, [("r/s.md", skill), ("r/a.md", "# t\n## Good Heading (UR-1)\n"), ("r/b.md", "### Late\n")])
    found = references.check_apply(corpus, corpus, HOME, REPO)
    assert rows(found) == [("A", "error", "r/s.md", 4), ("A", "error", "r/s.md", 8)]
    seqs = facts.resolved_refs(corpus, HOME, REPO).filter("line = 4").collect()
    assert sorted((r.seq, r.target) for r in seqs) == [(0, "r/a.md"), (1, "r/a.md")]


def test_check_agents(spark):
    agent = "\n".join([
        "---", "name: helper", "---", "### Inputs (provided by the caller)",
        "- `A_KEY`, `B_KEY`: with `NOT_DECLARED`", "- `C_KEY` (optional): x", "- `D_KEY` (MODE=x のみ): y",
        "### Optional inputs", "- `E_KEY`: z", "#### deeper", "- `F_KEY`: still optional", "### Other", "- `G_KEY`: no",
    ])
    agents = frame(spark, [("ag/helper.md", agent), ("ag/bare.md", "nothing"), ("ag/wrong.md", "name: other\nname: wrong")])
    inputs = {(r.key, r.is_optional) for r in facts.agent_inputs(agents).collect()}
    assert inputs == {("A_KEY", False), ("B_KEY", False), ("C_KEY", True), ("D_KEY", True), ("E_KEY", True), ("F_KEY", True)}
    skill = "\n".join([
        "subagent_type=helper", "", "", "```", "A_KEY: 1", "NOT_DECLARED: 2", "ZZ_KEY: 3", "（a のみ）OPT_KEY: 4", "  B_KEY: indented", "```",
        "subagent_type: `ghost`", "subagent_type=bare", "subagent_type=helper", "", "", "", "```", "Q_KEY: too far", "```", "AFTER: x",
    ])
    skills = frame(spark, [("sk/s.md", skill)])
    calls = {r.line: r for r in facts.agent_calls(skills).collect()}
    assert calls[1].passed_required == ["A_KEY", "NOT_DECLARED", "ZZ_KEY"] and calls[1].passed_optional == ["OPT_KEY"]
    assert not calls[13].parsed and calls[13].passed_required == []
    assert rows(references.check_agents(skills, agents)) == [
        ("B", "error", "sk/s.md", 11), ("B", "warning", "sk/s.md", 1), ("B", "warning", "sk/s.md", 12), ("B", "warning", "sk/s.md", 13),
    ]
    assert rows(references.check_agent_names(agents)) == [("B", "error", "ag/wrong.md", 1)]


def test_fence_without_end_runs_to_the_end(spark):
    skills = frame(spark, [("s.md", "subagent_type=x\n```\nA: 1\ntext\nB: 2")])
    call = facts.agent_calls(skills).first()
    assert call.parsed and call.passed_required == ["A", "B"]


def test_two_calls_share_a_fence(spark):
    skills = frame(spark, [("s.md", "subagent_type=x\nsubagent_type=y\n```\nA: 1\n```")])
    got = {r.agent: r.passed_required for r in facts.agent_calls(skills).collect()}
    assert got == {"x": ["A"], "y": ["A"]}


def test_check_placeholders(spark):
    corpus = frame(spark, [
        ("s/templates/t.md", "{USED} {UNUSED} {DB} {lower} {UNUSED}"),
        ("s/templates/deep/u.md", "{DEEP}"),           # not a direct child: no template
        ("s/skill.md", "fill {USED}"),
    ])
    found = references.check_placeholders(corpus).collect()
    assert [(r.file, r.line, r.message) for r in found] == [("s/templates/t.md", 0, "placeholder UNUSED is never mentioned")]


def test_script_calls(spark):
    text = "\n".join([
        "run `tool.py add --name x --force` and `tool.py` too",
        "python tool.py \\", "  remove \\", "  --all [--dry-run]", "tool.py --flag late", "tool.py [--opt] a.b two other.py z",
    ])
    got = [(r.line, r.seq, r.script, r.subcommand, r.flags) for r in
           facts.script_calls(frame(spark, [("s.md", text)])).orderBy("line", "seq").collect()]
    assert got == [
        (1, 0, "tool.py", "add", ["--name", "--force"]), (1, 1, "tool.py", None, []),
        (2, 0, "tool.py", "remove", ["--all"]),
        (5, 0, "tool.py", None, ["--flag"]),
        (6, 0, "tool.py", "two", []), (6, 1, "other.py", "z", []),
    ]


def test_check_wiring(spark):
    help_text = spark.createDataFrame([
        ("tool.py", "", "usage: tool.py [-h] {add,remove} --version {x}"), ("tool.py", "add", "usage: add [--name N] [--force]"),
        ("plain.py", "", "usage: plain.py [--out O]"), ("dead.py", "", " "),
    ], "script string, subcommand string, text string")
    scripts, subs, flags = references.parse_help(help_text)
    assert {(r.script, r.subcommand) for r in subs.collect()} == {("tool.py", "add"), ("tool.py", "remove")}
    calls = facts.script_calls(frame(spark, [("s.md", "\n".join([
        "tool.py add --name x --bad", "tool.py drop --bad", "tool.py --bad", "plain.py go --out x --nope", "dead.py x", "lost.py y", "free.py z",
    ]))]))
    allowed = spark.createDataFrame([("tool.py",), ("plain.py",), ("dead.py",), ("lost.py",)], "script string")
    found = references.check_wiring(calls, scripts, subs, flags, allowed)
    assert sorted((r.line, r.severity, r.message) for r in found.collect()) == [
        (1, "error", "tool.py add has no flag --bad"), (2, "error", "tool.py has no subcommand drop"),
        (4, "error", "plain.py go has no flag --nope"),
        (5, "warning", "dead.py gives no help; call not compared"),
        (6, "warning", "lost.py is not in the catalogue; call not compared"),
    ]


def test_run_checks_selects(spark):
    corpus = frame(spark, [("s/a.md", 'apply "## No"\nsubagent_type=ghost')])
    agents = frame(spark, [("ag/x.md", "name: y")])
    letters = lambda c: sorted({r.check for r in references.run_checks(corpus, agents, HOME, REPO, c).collect()})
    assert letters("A") == ["A"] and letters("AB") == ["A", "B"]


def test_calls_are_not_sorted_to_meet_their_definitions(spark):
    docs = spark.createDataFrame([(f"d{i}.md", "subagent_type=a\n```\nKEY: 1\n```\nsubagent_type=b") for i in range(20)], "path string, text string")
    agents = spark.createDataFrame([("x/a.md", "---\nname: a\n---\n### Inputs (provided by the caller)\n- `OTHER`: x")], "path string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = references.check_agents(docs, agents)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        got = found.groupBy("severity").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.severity: r["count"] for r in got} == {"warning": 20, "error": 20}
