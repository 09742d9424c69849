import random

import pytest

from quire.runtime import ship

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gkey string, fp int, h string, score int, block int, side string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def hard_rows():
    """Nulls, empty and long texts, ties and repeated rows; the rest of the columns clash with names used inside."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    line = " ".join(rng.choice(words) for _ in range(16))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + (f"\n{line}." if k % 3 == 0 else "") for k in range(40)]
    rows = [(3 * k % 41, t) for k, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (102, None), (None, texts[3]), (None, None), (7, texts[4]), (103, texts[5]), (103, texts[5]), (104, " \n\t "), (105, "x" * 5000), (106, line * 30), (107, "漢字 " * 40), (108, "me@corp.example 10.0.0.1")]
    return [(d, t, None if k % 4 else "en", None if k % 5 else "src0", None, "g", 1, "h", 0, 2, "s") for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
