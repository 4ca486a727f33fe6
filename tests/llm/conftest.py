import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns that clash with outputs."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    long_ = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(rng.choice(words) for _ in range(200))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "  \n\t ", "de", None, 5), (None, "lone words here", "en", "b", 15),
        (4, base, "en", "a", 1), (5, base, "fr", "b", 1), (5, base, "fr", "b", 1), (6, base + " tail", None, "a", 1),
        (7, long_, "en", "a", 1), (None, None, None, None, None), (8, "Ünïcode Äpfel <|endoftext|> 漢字 \U0001f600 it's 12", "de", "c", 3),
    ]
    clash = ", fingerprint int, score string, size int, n_words string, shard string, component_id string, copies string, labels int, items int, __x int"
    return spark.createDataFrame([(*r, 1, "x", 2, "y", "z", "q", "c", 3, 4, 5) for r in rows], DOCS + clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
