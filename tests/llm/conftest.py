import random

import pytest

WORDS = "the of and to in is that was he for on are with as his they at be this from have or by one had not but what all were when we there can an your which their".split()


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def prose():
    def make(n, seed=0, vocabulary=400):
        r = random.Random(seed)
        pool = WORDS + [r.choice(WORDS) + r.choice(WORDS) + str(i) for i in range(vocabulary)]
        return " ".join(r.choice(pool) for _ in range(n))

    return make


#: Rows that every operator must take: missing and empty texts, blanks, ties, repeats, a missing id and other scripts.
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "same text here", "en", "b"), (5, "same text here", "en", "b"), (4, "same text here", "en", "b"),
    (None, "no id at all", "en", None), (6, "日本語 😀 é x \x00 ▁▁ ß", "ja", "c"), (7, "x" * 50_000, None, "c"), (8, "- 1.2.3.4 ,;", "", ""),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
