import random

import pytest

EXTRA = "row long, size long, fp long, label string, key string, node string, pass int, finish double, range string, shuffle string, suspect boolean, __n int, __sha string, __own long, __row long, __id long, __s string, __mix_id long, __mix_size long, doc string, own string, id string, n int, sha binary, digest string, of string, k string, at string, node_id string, size_of string, by_name map<string,int>, parts array<int>, inner struct<a: int, m: map<string,int>>"
#: Values of the further columns, which operators are to leave alone.
CLASH = (7, 8, 9, "label", "key", "node", 1, 0.5, "range", "shuffle", True, 3, "sha", 4, 5, 6, "s", 10, 11, "doc", "own", "id", 12, b"sha", "digest", "of", "k", "at", "node_id", "size_of", {"a": 1}, [1, 2], (3, {"b": 4}))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, words=12):
    return " ".join("".join(rng.choice("abdefghilmnorstuw") for _ in range(rng.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(1)
    long = " ".join(sentence(rng) for _ in range(4_000))
    base = sentence(rng, 60)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", None, None),
        (4, None, "en", "a"), (5, "", "de", "b"), (6, "", None, "b"), (7, " \n\t ", "de", None), (8, long, "en", "a"),
        (9, long + " end", "en", "c"), (None, base, "en", "a"), (None, None, None, None), (10, "!!! 123 ???", "en", "b"),
        (11, "x", "en", "b"), (12, "\u0000 ▁ \U0001f600", "fr", "c"), (12, "another text", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, None, *CLASH) for r in rows], f"{DOCS}, {EXTRA}")


@pytest.fixture(scope="session")
def unchanged():
    """Are the further columns of all rows what they were?"""

    def check(rows):
        return all(tuple(r)[5:] == CLASH for r in rows)

    return check


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"{DOCS}, {EXTRA}")
