"""Counts of a task's terms: each with its own term, whether texts are listed or walked; texts stay UTF-8."""

import collections
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colophon.llm import source_divergence

TEXTS = ["b a b É", "a É É c", "", "ZOO b b b", "c a", "漢字 b"]


@pytest.mark.parametrize("long_bytes", [1, 1 << 22])
def test_counts_of_a_task(monkeypatch, long_bytes):
    monkeypatch.setattr(source_divergence, "LONG_BYTES", long_bytes)
    rows = pd.DataFrame({"gid": [1, 2, 1, 2, 1, 1], "lid": 9, "text": TEXTS})
    n, docs = collections.Counter(), collections.Counter()
    for gid, text in zip(rows["gid"], TEXTS):
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("ZOO", "zoo"))
        n.update((gid, w) for w in words)
        docs.update({(gid, w) for w in words})
    texts = pd.concat(source_divergence._counter(64, True)([rows]))
    assert {(r.gid, r.term): (r.n, r.docs) for r in texts.itertuples()} == {k: (n[k], docs[k]) for k in n}
    named = {r.digest: r.term for r in texts.itertuples()}
    parts = list(source_divergence._counter(64)([rows]))
    counted = pd.concat(p for p in parts if p["gid"].iloc[0])
    assert {(r.gid, named[r.digest]): (r.n, r.docs) for r in counted.itertuples()} == {k: (n[k], docs[k]) for k in n}
    told = pd.concat(p for p in parts if not p["gid"].iloc[0])
    assert {(r.digest, r.term) for r in told.itertuples()} == set(named.items()) and len(told) == len(named)
    assert all(isinstance(p["term"].array, pd.arrays.ArrowExtensionArray) for p in parts)


def test_terms_are_shuffled_once_and_only_kept_ones_are_written(spark, monkeypatch):
    """4 000 terms of one document each beside ten kept ones, in two groups: no table holds the rare ones."""
    tables, plain = {}, source_divergence.materialize

    def watched(df, *args):
        exchanges = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        tables[args[0]] = exchanges, (found := plain(df, *args))
        return found

    docs = spark.range(200, numPartitions=4).select(F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.col("id"))
    word = F.translate(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.lit("r"), F.col("id") * 20 + i))), "0123456789", "abcdefghij")
    text = F.concat_ws(" ", word, *[F.lit(f"often{c}") for c in "abcdefghij"]).alias("text")
    monkeypatch.setattr(source_divergence, "materialize", watched)
    counts, names = source_divergence.kept_terms(source_divergence.numbered(docs.select("lang", "source", text))[1])
    assert {n for n, (exchanges, table) in tables.items() if table.count() > 30} == set()
    assert tables["kept"][0] == 1
    assert sorted(r["term"] for r in names.collect()) == [f"often{c}" for c in "abcdefghij"]
    assert sorted(r["n"] for r in counts.collect()) == [100] * 20


@pytest.mark.parametrize("bits", [64, 4])
def test_texts_of_a_slot_lie_in_one_row(spark, bits):
    """Each has the digest that Spark finds for it, and lies in the slot of its counts."""
    rows = pd.DataFrame({"gid": [1, 2, 1, 2, 1, 1], "lid": [9, 8] * 3, "text": TEXTS})
    plain = pd.concat(source_divergence._counter(bits)([rows]))
    dealt = pd.concat(source_divergence._dealt(source_divergence._counter(bits))([rows]))
    counted = ["gid", "lid", "digest", "n", "docs"]
    assert plain[plain["docs"] > 0][counted].values.tolist() == dealt[dealt["docs"] > 0][counted].values.tolist()
    texts = dealt[dealt["docs"] == 0]
    assert not texts.duplicated(["lid", "digest"]).any()
    slot = lambda digest: digest % (1 << 64) >> (64 - source_divergence.SLOT_BITS)
    found = sorted((r.lid, t, slot(r.digest)) for r in texts.itertuples() for t in r.term.split(" "))
    told = plain[plain["docs"] == 0]
    assert found == sorted((r.lid, r.term, slot(r.digest)) for r in told.itertuples())
    same = spark.createDataFrame([(t,) for t in told["term"]], "term string").select(F.expr(f"shiftrightunsigned(xxhash64(term), {64 - bits})"))
    assert [r[0] for r in same.collect()] == told["digest"].tolist()
