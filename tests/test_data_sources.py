"""Sheets and batch result files as formats of spark.read, functions for SQL."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from colophon.errors import FormatError, MissingInput
from colophon.functions import session, similarity, text
from colophon.operators import chunking
from colophon.sources import completions, data_sources, workbook


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(n):
    rng = random.Random(5)
    for k in range(n):
        content = "".join(rng.choices(['"', "\\", "\n", "é", "\U0001f600", "a", " ", "}"], k=rng.randint(0, 200)))
        yield [
            {"custom_id": f"r{k}", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": content}, "finish_reason": "stop"}], "usage": {"prompt_tokens": k, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 1}}}}},
            {"custom_id": f"r{k}", "response": {"status_code": 429, "body": {"error": {"message": "slow"}}}},
            {"custom_id": f"r{k}", "error": {"code": "expired"}, "response": None},
            {"custom_id": f"r{k}", "response": {"body": {"choices": []}}},
            {"custom_id": f"r{k}", "response": {"body": {"choices": [{"message": {"content": None}}], "usage": None}}},
        ][k % 5 if k % 7 else 0]


@pytest.mark.parametrize("size", [97, 4_096, 1 << 20])
def test_ranges_of_a_batch_file_equal_the_whole(spark, tmp_path, size):
    """Ends of ranges fall anywhere, also right behind a line's end; lines longer than a range; blank lines."""
    (tmp_path / "in").mkdir()
    for name, end in (("a.jsonl", "\n"), ("b.jsonl", "")):
        (tmp_path / "in" / name).write_text("\n\n".join(json.dumps(x, ensure_ascii=False) for x in lines(60)) + end, encoding="utf-8")
    (tmp_path / "in" / "_hidden").write_text("no")
    data_sources.register(spark)
    found = spark.read.format("colophon_batch").option("rangeBytes", size).load(str(tmp_path / "in"))
    want = completions.outcomes(spark.read.text([str(tmp_path / "in" / x) for x in ("a.jsonl", "b.jsonl")]).where("value <> ''"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
    assert found.rdd.getNumPartitions() > (1 if size > 4_096 else 5)


def test_filters_on_a_batch_file_are_pushed(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(x) for x in lines(100)))
    data_sources.register(spark)
    found = spark.read.format("colophon_batch").load(str(tmp_path / "r.jsonl"))
    some = found.where("error IS NULL AND custom_id LIKE 'r1%' AND prompt > 20")
    assert not re.search(r"\bFilter\b", plan(some))
    assert sorted(r.custom_id for r in some.collect()) == sorted(r.custom_id for r in found.collect() if r.error is None and r.custom_id.startswith("r1") and r.prompt > 20)
    assert found.where(F.col("custom_id").isin("r7", "r8")).count() == 2 and found.where("error IS NOT NULL").count() + found.where("error IS NULL").count() == 100
    assert found.where("length(custom_id) = 2").count() == 10  # stays with Spark


def test_faults_of_batch_files(spark, tmp_path):
    data_sources.register(spark)
    (tmp_path / "bad.jsonl").write_text('{"custom_id": "a"}\nno json\n')
    with pytest.raises(Exception, match="no JSON"):
        spark.read.format("colophon_batch").load(str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "none.jsonl").write_text("")
    assert spark.read.format("colophon_batch").load(str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(Exception, match="no file"):
        spark.read.format("colophon_batch").load(str(tmp_path / "missing")).collect()


ODD = ["x", "", " two  spaces ", None, "<&>\"'", "é\U0001f600", "tab\tline\nend\rx", "bell\x07"]


@pytest.fixture
def sheets(spark, tmp_path):
    rows = [(k, ODD[k % len(ODD)], f"s{k % 3}") for k in range(250)]
    df = spark.createDataFrame(rows, "id int, odd string, `the source` string").repartition(3, "id")
    workbook.write_sheet(df, str(tmp_path / "out"), "A & B", 40)
    return rows, str(tmp_path / "out")


def test_sheets_are_written_by_many_tasks_and_read_back(spark, sheets):
    rows, path = sheets
    found = workbook.read_sheet(spark, path, "A & B")
    assert found.columns == ["row_number", "id", "odd", "the source"] and found.rdd.getNumPartitions() >= 7
    plain = lambda x: x if x is None else x.replace("\x07", "")
    assert sorted((int(r.id), r.odd, r["the source"]) for r in found.collect()) == sorted(((k, plain(o), s) for k, o, s in rows), key=lambda r: r[0])
    cells = workbook.read_cells(spark, path)
    assert cells.where("error IS NOT NULL").count() == 0 and cells.where("row > 1 AND col = 1").count() == 250
    assert {r.m for r in found.groupBy().agg(F.max("row_number").alias("m")).collect()} == {41}


def test_columns_and_filters_of_a_sheet_are_pruned(spark, sheets):
    rows, path = sheets
    found = workbook.read_sheet(spark, path, "A & B", ["the source"])
    assert found.columns == ["row_number", "the source"] and found.count() == 250
    some = found.where("row_number <= 5 AND `the source` = 's1'")
    assert not re.search(r"\bFilter\b", plan(some))
    assert {r["the source"] for r in some.collect()} == {"s1"} and max(r.row_number for r in some.collect()) <= 5
    with pytest.raises(FormatError):
        workbook.read_sheet(spark, path, "A & B", ["none"])


def test_a_sheet_is_read_no_further_than_a_filter_allows(tmp_path):
    """The rest of the file is broken, and is not looked at."""
    good = workbook.workbook_of("S", ["a"], [[str(k)] for k in range(5_000)])
    (tmp_path / "s.xlsx").write_bytes(good)
    kind = data_sources.SheetSource({"path": str(tmp_path / "s.xlsx"), "sheet": "S"}).schema()
    reader = data_sources.SheetReader(kind, {"path": str(tmp_path / "s.xlsx"), "sheet": "S"})
    assert not list(reader.pushFilters([data_sources.LessThanOrEqual(("row_number",), 3), data_sources.IsNotNull(("a",))]))
    assert [r["a"] for r in reader.rows(reader.partitions()[0])] == ["0", "1"]


def test_faults_of_sheets(spark, tmp_path):
    empty = spark.createDataFrame([], "a string, b string")
    workbook.write_sheet(empty, str(tmp_path / "empty"))
    assert workbook.read_sheet(spark, str(tmp_path / "empty")).columns == ["row_number", "a", "b"]
    assert workbook.read_sheet(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(MissingInput):
        workbook.read_sheet(spark, str(tmp_path / "none"))
    with pytest.raises(FormatError):
        workbook.write_sheet(empty, str(tmp_path / "x"), rows=0)
    assert [workbook.column_letters(workbook.column_number(x)) for x in ("A1", "Z1", "AA7", "AZ1", "ZZ1", "AAA1")] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]


def test_sql_functions_equal_the_columns(spark):
    session.register(spark)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abÉç 1ß", k=rng.randint(0, 12)))
    pairs = spark.createDataFrame([(word(), word()) for _ in range(80)] + [("", ""), (None, "a"), ("a", "")], "a string, b string")
    pairs.createOrReplaceTempView("label_pairs")
    told = spark.sql("SELECT a, b, lcs_ratio(a, b) AS r, latin_key(a) AS k, wide_key(a) AS w FROM label_pairs")
    want = pairs.select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("r"), text.latin_key(F.col("a")).alias("k"), text.wide_key(F.col("a")).alias("w"))
    assert sorted(map(str, told.collect())) == sorted(map(str, want.collect()))
    assert "Python" not in plan(told)


def test_chunks_by_a_table_function(spark):
    session.register(spark)
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, "".join(rng.choices(["word ", "end. ", "\n\n", "é"], k=60 * k))) for k in range(12)] + [(99, None)], "doc_id int, text string")
    docs.createOrReplaceTempView("long_docs")
    told = spark.sql("SELECT d.doc_id, c.chunk_index, c.piece AS text FROM long_docs d, LATERAL text_chunks(d.text, 100, 300, 20) c")
    want = chunking.chunks(docs.where("text IS NOT NULL"), chunking.Chunking(front=100, size=300, overlap=20))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.select("doc_id", "chunk_index", "text").collect()))
    assert "Arrow" in plan(told)
