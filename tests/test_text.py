"""Text and Markdown expressions on inline rows."""
from pyspark.sql import functions as F

from doctrellis.functions import markdown as M
from doctrellis.functions import text as T
from doctrellis.functions import values as V
from doctrellis.plans.catalog import QUERIES


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_lines_like_splitlines(spark):
    for text in ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc", "x\x0by\x0cz", "p\x85q r ", "\na", "a\r\n", "a\x1cb\x1d\n"]:
        assert one(spark, T.lines_of("t"), text) == text.splitlines(), repr(text)


def test_trim_covers_ideographic_space(spark):
    assert one(spark, T.trim_u("t"), "　 a b　\t") == "a b"


def test_normalize_heading(spark):
    for raw, want in [
        ("## Make the sheet (UR-016)", "Make the sheet"),
        ("## レビュー（最大 N 回）", "レビュー"),
        ("## Load Config", "Load Config"),
        ("### A (b) (c)", "A (b)"),
        ("## Nested (a (b))", "Nested (a (b))"),
    ]:
        assert one(spark, T.normalize_heading("t"), raw) == want


def test_ids(spark):
    ids = lambda s: one(spark, M.artifact_ids("t"), s)
    assert ids("see SP-001-001.001 now") == ["SP-001-001"]
    assert ids("CR-2026-970-UR-001 and UR-001") == ["CR-2026-970-UR-001", "UR-001"]
    assert ids("対応SP-001を") == []
    assert ids("SP-XXX-YYY") == ["SP-XXX-YYY"]


def test_unreplaced_tokens_sorted(spark):
    assert one(spark, M.unreplaced_tokens("t"), "x {SP_ID} y {CR_PATH} {lower} {SP_ID}") == ["{CR_PATH}", "{SP_ID}"]


def test_frontmatter(spark):
    keys = lambda s: one(spark, M.frontmatter_keys(T.lines_of("t")), s)
    assert keys("---\nb: 1\na-x: 2\n  nested: 3\n---\nc: 4") == ["a-x", "b"]
    assert keys("---\na: 1\nb: 2") == ["a", "b"]  # no closing rule: to the end
    assert keys("x\n---\na: 1\n---") == []
    assert one(spark, M.frontmatter_map(T.lines_of("t")), "---\na: 1\nb: x y\na: 3\n---") == {"a": "3", "b": "x y"}


def test_set_frontmatter_value(spark):
    put = lambda s: one(spark, M.set_frontmatter_value("t", "model", F.lit("m1")), s)
    assert put("---\nname: a\nmodel: old\n---\nbody\n") == "---\nname: a\nmodel: m1\n---\nbody\n"
    assert put("---\nname: a\n---\nbody") == "---\nname: a\nmodel: m1\n---\nbody"
    assert put("body\nmodel: old") == "body\nmodel: old"
    assert put("---\nname: a\nno end") == "---\nname: a\nno end"


def test_profile(spark):
    text = "---\nk: v\n---\n# Top\n## Two 2026-01-02\n| a | b |\n|---|---|\n|x\n```mermaid\ngraph\n```\nUR-001 {TOK}\n"
    p = one(spark, M.structural_properties("t"), text)
    assert p.headings == ["Top", "Two 2026-01-02"] and p.frontmatter_keys == ["k"]
    assert p.ids == ["UR-001"] and p.unreplaced_tokens == ["{TOK}"]
    assert (p.table_row_count, p.mermaid_count) == (2, 1)
    assert one(spark, T.mask_dates("t"), " due 2026-01-02 or 2027-03-04 ") == "due {DATE} or {DATE}"


def test_logical_lines(spark):
    got = one(spark, M.logical_lines("t"), "a \\\n b \\\n c\n\nd\\")
    assert [(r.line, r.text) for r in got] == [(1, "a   b   c"), (4, ""), (5, "d ")]


def test_paths(spark):
    assert one(spark, T.stem("t"), "a/b.c/d.tar.gz") == "d.tar"
    assert one(spark, T.stem("t"), "a/.hidden") == ".hidden"
    assert one(spark, T.extension("t"), "a/b.PY") == "py"
    assert one(spark, T.dirname("t"), "a/b/c") == "a/b" and one(spark, T.dirname("t"), "a") == ""
    resolve = lambda s: one(spark, T.resolve_path("t", "~/.h/", "r/"), s)
    assert resolve("~/.h/x/y.md") == "r/x/y.md" and resolve("~/.h/{X}.md") is None and resolve("/abs/x.md") is None


def test_values(spark):
    row = spark.range(1).select(
        V.verified_glyph(F.array(F.lit(False), F.lit(True), F.lit(False))).alias("gap"),
        V.verified_glyph(F.array(F.lit(True), F.lit(True), F.lit(True))).alias("all"),
        V.progress_status(F.lit("✅")).alias("done"),
        V.bump_version(F.lit("1.2.3"), F.lit("MINOR")).alias("minor"),
        V.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("h"), F.lit("x")), F.create_map(F.lit("a"), F.lit("2"))).alias("m"),
        V.or_default(F.lit(0), F.lit(7)).alias("zero"),
        V.call_failed(F.lit(None).cast("boolean"), F.lit(None).cast("int")).alias("fine"),
        V.call_failed(F.lit(False), F.lit(1)).alias("bad"),
    ).first()
    assert (row.gap, row.all, row.done, row.minor) == ("■□□", "■■■", "done", "1.3.0")
    assert row.m == {"a": "2", "h": "x"} and row.zero == 7 and (row.fine, row.bad) == (False, True)


def test_last_line_of_empty_texts(spark, tmp_path):
    texts = {1: "a\nb", 2: "", 3: "\n", 4: None, 5: "x\r\ny\r\n", 6: "one"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.last_line for r in QUERIES["last_line"](spark, str(tmp_path)).collect()}
    assert got == {1: "b", 3: "", 4: None, 5: "y", 6: "one"}
