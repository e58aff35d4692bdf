"""Searches by the rarest word and by interval, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from colophon.operators import lookup


@pytest.fixture(scope="module")
def skewed(spark):
    """A vocabulary in which every label has the word "american"."""
    rng = random.Random(1)
    rows = [("LCSH", f"American {rng.choice('abcdef')}{k % 97} item{k}", f"u/{k}") for k in range(3_000)]
    rows += [("FAST", "Äpfel", "f/1"), ("FAST", "äpfel und Birnen", "f/2"), ("FAST", "", "f/3"), ("FAST", "a", "f/4"), ("FAST", None, "f/5")]
    return rows, spark.createDataFrame(rows, "source string, label string, uri string")


def test_candidates_come_by_the_rarest_word(spark, skewed):
    rows, vocabulary = skewed
    asked = spark.createDataFrame([(f"american item{k}",) for k in range(0, 3_000, 7)] + [("american nothing",), ("item5 American",), ("Äpfel",)], "query string")
    index = lookup.word_index(vocabulary)
    found = lookup.index_hits(asked, index)
    got = {(r["query"], r.uri) for r in found.collect()}
    want = {(q, u) for (q,) in asked.collect() for _, label, u in rows if label is not None and set(q.lower().split()) <= set(label.lower().split())}
    assert got == want
    # the join on the leading word brings up as many candidates as there are hits, not all labels for each query
    parts = asked.select("query", F.explode(F.split(F.lower("query"), " ")).alias("word"))
    by_rarest = parts.join(index.select("word", "n_rows").distinct(), "word").groupBy("query").agg(F.min("n_rows").alias("n")).agg(F.sum("n")).first()[0]
    by_first = parts.where("word = 'american'").count() * 3_000
    assert by_rarest < 4_000 < by_first


@pytest.mark.parametrize("per_range", [50_000, 100, 7])
def test_labels_that_start_with_a_query(spark, skewed, per_range):
    rows, vocabulary = skewed
    asked = [("american a",), ("American b1",), ("ä",), ("Äpfel u",), ("zzz",), ("a",), ("0",), ("american a0 item",), ("\U0010ffff",)]
    found = lookup.left_anchored_hits(spark.createDataFrame(asked, "query string"), vocabulary, per_range)
    got = [(r["query"], r.uri) for r in found.collect()]
    want = [(q, u) for (q,) in asked for _, label, u in rows if label is not None and label.lower().startswith(q.lower())]
    assert sorted(got) == sorted(want)


def test_nothing_to_search(spark, skewed):
    _, vocabulary = skewed
    none = spark.createDataFrame([], "query string")
    assert lookup.search(none, vocabulary).count() == 0
    assert lookup.left_anchored_hits(none, vocabulary).count() == 0
    some = spark.createDataFrame([("american",)], "query string")
    assert lookup.search(some, vocabulary.limit(0)).count() == 0


def test_lost_texts_are_read_again_by_path(spark):
    from colophon.sources.folder import missing_texts

    failed = spark.createDataFrame([(1, "a"), (2, "b")], "item_index int, path string")
    documents = spark.createDataFrame([("a", "text of a"), ("c", "other")], "path string, text string")
    got = sorted((r.item_index, r.text, r.reason) for r in missing_texts(failed, documents).collect())
    assert got == [(1, "text of a", None), (2, None, "the file cannot be read")]
