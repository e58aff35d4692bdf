"""Why records have failed: each text goes to Python once, and only if it is long; a long one is counted in parts."""

import random

import pytest
from pyspark.sql import functions as F

from colophon.functions import json_repair, quality
from colophon.operators import extraction
from colophon.plans.queries import QUERIES


def evaluations(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def items(spark, raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "item_index long, raw string")
    blank = json_repair.blank_record().withField("title", F.lit("t")).withField("abstract", F.lit("a"))
    return rows.select("item_index", "raw", blank.alias("record"), F.array(*[F.lit(k) for k in quality.REQUIRED]).alias("keys"))


def test_the_histogram_finds_each_reason_once(spark):
    assert evaluations(QUERIES["failure_histogram"](spark, "/root/testdata/sf0.001")) == 1


def test_failures_find_each_reason_once(spark):
    raws = ["{}" + "x" * 3000, "." * 900 + "{}", '{"title": "fine"}', "{}" + " a" * 600, "Error: x", None]
    failed = extraction.failures(items(spark, raws))
    assert evaluations(failed) == 1
    assert {r.item_index: r.failure_reason for r in failed.collect()} == {0: quality.BROKEN, 3: quality.REPETITION, 4: quality.EXPLICIT, 5: quality.EMPTY}
    assert failed.columns == ["item_index", "raw", "record", "keys", "failure_reason"]


@pytest.mark.parametrize("letters", ["ab \n", "aé漢 ", "a😀\t😀", " \n\t\r"])
def test_long_texts_are_counted_as_short_ones(one, monkeypatch, letters):
    text = "".join(random.Random(3).choices(letters, k=5000))
    expected = max((text.count(c) for c in set(text) - set(" \n\t\r")), default=0)
    assert one(quality.top_character, text) == expected
    import pyarrow as pa

    monkeypatch.setattr(quality, "_PART_BYTES", 1001)
    assert quality._top_character_of(pa.array([text])[0].as_buffer()) == expected
