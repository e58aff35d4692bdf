"""Arrays split at byte ranges against a plain parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colophon import storage
from colophon.errors import FormatError
from colophon.sources.json_array import read_elements, split_elements


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def items(n, seed=1):
    rng = random.Random(seed)
    odd = ['"', "\\", "{", "}", "[", "]", "\n", "é", "\U0001f600", '\\"', "a", ",", " ", "}]", '"}', "\\\\"]
    for k in range(n):
        text = "".join(rng.choices(odd, k=rng.randint(0, 40)))
        yield {"k": k, "text": text, text[:3]: [{"deep": {"er": text}}, [], {}], "none": None}


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_in_many_ranges_equal_a_plain_parser(spark, tmp_path, small_ranges, indent):
    """Some 5 MB over ranges of 64 KB: braces, quotes and escapes at the ends of ranges, one long element."""
    want = [*items(9_000), {"k": -1, "long": "}{\\\"" * 100_000}, *items(3_000, 2)]
    path = tmp_path / "array.json"
    path.write_text(json.dumps(want, indent=indent, ensure_ascii=False), encoding="utf-8")
    found = read_elements(spark, str(path))
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
    assert [json.loads(r["value"]) for r in found.orderBy("index").collect()] == want
    assert [r["index"] for r in found.select("index").orderBy("index").collect()] == list(range(len(want)))


def test_files_and_arrays_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]\n[{"x": 3}]\n')
    (tmp_path / "b.json").write_text(' [ ] ')
    (tmp_path / "c.json").write_text('[{"x": {"y": "}"}}]')
    rows = read_elements(spark, str(tmp_path)).select(F.element_at(F.split("file", "/"), -1).alias("f"), "index", "value")
    assert sorted(map(tuple, rows.collect())) == [("a.json", 0, '{"x": 1}'), ("a.json", 1, '{"x": 2}'), ("a.json", 2, '{"x": 3}'), ("c.json", 0, '{"x": {"y": "}"}}')]


@pytest.mark.parametrize("text", ["{}", "[1,", "[1, 2]", '[{"a": 1}', '[{"a": 1}, 5]', '[{"a" 1}]', '{"a": [{"b": 1}]}', '[{"a": "}]', "nothing", '["x", {"a": 1}]'])
def test_what_is_no_array_of_objects(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert split_elements(spark, str(tmp_path / "x.json"))[1].count() > 0
    with pytest.raises(FormatError):
        read_elements(spark, str(tmp_path / "x.json"))


def test_tables_are_cleaned_up(spark):
    kept = storage.written(spark.range(3))
    assert kept.count() == 3
    path = kept.inputFiles()[0].rsplit("/", 2)[0]
    storage.clean_up(spark)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
