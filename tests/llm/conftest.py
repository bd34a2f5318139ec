import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest  # noqa: E402

#: doc_id, text, lang, source, n_chars as every documents table has them, and columns that clash with results.
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double, kept boolean"


def awkward_texts() -> list:
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [None, "", " \t\n", "one", "two  words\n", "a b c d e", "a b c d e", long, "naïve Ünïcödé 語言模型   x\x1cy", "don't 'll <|endoftext|> a  <|endoftext|>",
            "x" * 3000, "A.B,C! " * 40]


@pytest.fixture(scope="session")
def rows(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    texts = awkward_texts()
    made = [(i if i != 3 else None, t, None if i % 3 else "en", "s", None if t is None else len(t), 1, 0.5, None) for i, t in enumerate(texts)]
    made += [made[4], made[4], (5, "another text under an id that is there", "en", None, 3, None, None, True)]
    return spark.createDataFrame(made, DOCUMENTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
