"""Text in order, written by many tasks."""

from pyspark.sql import functions as F

from colophon.plans import reports
from colophon.sources import ordered_text


def listing(spark, n):
    """Groups of which one has two thirds of the rows, in no order, and heads."""
    rows = spark.range(n, numPartitions=7).select(F.when(F.col("id") % 3 < 2, "b").otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("g"), F.col("id").alias("n"), F.lit(1).alias("k"))
    body = rows.withColumn("line", F.format_string("  %s é %d", "g", "n"))
    heads = body.select("g").distinct().select("g", F.lit(-1).cast("long").alias("n"), F.lit(0).alias("k"), F.format_string("[%s]", "g").alias("line"))
    return body.unionByName(heads), ["g", "k", "n"]


def plain(n):
    groups = {}
    for i in range(n):
        groups.setdefault("b" if i % 3 < 2 else f"c{i % 5}", []).append(i)
    return [x for g in sorted(groups) for x in [f"[{g}]", *[f"  {g} é {i}" for i in groups[g]]]]


def test_parts_joined_are_the_text(spark, tmp_path):
    n, path, target = 3000, f"{tmp_path}/text", f"{tmp_path}/one.txt"
    text = [reports.title(spark.range(1), "Title"), listing(spark, n), (spark.createDataFrame([], "line string"), []), (spark.createDataFrame([(None,), ("z",), ("",), ("z",)], "line string"), [])]
    expected = ["Title", *plain(n), "", "z", "z"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the text were long
    try:
        ordered_text.write_parts(text, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = ordered_text.manifest(spark, path).collect()
    assert len([p for p in parts if p.section == "001"]) > 1  # one task has not seen all of it
    assert [r.line for r in ordered_text.read_lines(spark, path).orderBy("number").collect()] == expected
    assert list(ordered_text.lines_of(text)) == expected
    for _ in range(2):  # an older export is replaced
        size = ordered_text.export(spark, path, target)
    whole = (tmp_path / "one.txt").read_bytes()
    assert whole.decode().split("\n") == [*expected, ""]
    assert size == len(whole) == sum(p.bytes for p in parts)
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]


def test_a_text_written_again_replaces_its_parts(spark, tmp_path):
    path = f"{tmp_path}/text"
    ordered_text.write_parts([listing(spark, 500), reports.title(spark.range(1), "end")], path)
    ordered_text.write_parts([listing(spark, 5)], path)
    assert [r.line for r in ordered_text.read_lines(spark, path).orderBy("number").collect()] == plain(5)


def test_reports_of_nothing(spark):
    status = spark.createDataFrame([], "item_index long, status string, n_selected int, n_unmatched int, has_issue boolean")
    selected = spark.createDataFrame([], "item_index long, label_pos int, term_label string, uri string, source string")
    unmatched = spark.createDataFrame([], "item_index long, label_pos int, label string")
    assert list(reports.selection_report(status, selected, unmatched)) == ["Vocabulary selection"]
    answers = spark.createDataFrame([("a", None, "lost", None, None), ("b", None, None, 1, 2)], "custom_id string, content string, error string, prompt long, completion long")
    assert list(reports.response_log(answers)) == ["--- a (? + ? tokens)", "ERROR lost", "--- b (1 + 2 tokens)", ""]
