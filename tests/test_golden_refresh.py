"""A refresh parses the texts once."""
from doctrellis.operators import structure


def test_refresh_reads_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(f"d{i}.md", f"# H{i}", "s" if i % 2 else "t") for i in range(6)]
    docs = spark.createDataFrame(rows, "path string, text string, doc_set string").mapInPandas(counted, "path string, text string, doc_set string")
    old = spark.createDataFrame([("s", "heading", "gone"), ("s", "required_heading", "kept"), ("u", "heading", "other")], "doc_set string, kind string, value string")
    got = {tuple(r) for r in structure.refresh_golden(old, structure.set_facts(docs)).collect()}
    assert got == {("s", "required_heading", "kept"), ("u", "heading", "other")} | {(s, "heading", t[2:]) for _, t, s in rows}
    assert seen.value == 6
