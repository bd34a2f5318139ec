"""Facts that follow a corpus equal those of a whole run."""
from doctrellis.operators import facts, incremental


def test_adds_edits_removals_and_repeats(spark, tmp_path):
    root, schema = f"file://{tmp_path}/facts", "path string, text string"
    versions = [
        [("a", "# A"), ("b", "# B\n## C"), ("c", "no heading"), ("d", None)],
        [("a", "# A"), ("b", "# B"), ("d", None), ("e", "# E"), ("e", "# E")],
        [("a", "# A"), ("b", "# B"), ("d", None), ("e", "# E")],
        [("c", "# now"), ("b", "# B\n## C"), ("a", "# A")],
        [],
    ]
    seen = []

    def extract(docs):
        seen.append(sorted(r.path for r in docs.collect()))
        return facts.headings(docs)

    for n, rows in enumerate(versions, 1):
        docs = spark.createDataFrame(rows, schema)
        whole = sorted(map(str, facts.headings(docs.dropDuplicates()).collect()))
        for _ in range(2):  # a version that is run again is the same
            got = incremental.refresh_facts(docs, extract, root, n)
            assert sorted(map(str, got.collect())) == whole
    assert seen[::2] == seen[1::2] == [["a", "b", "c", "d"], ["b", "e"], [], ["b", "c"], []]
    assert {r.heading for r in incremental.facts_at(spark, root, 1).collect()} == {"A", "B", "C"}
