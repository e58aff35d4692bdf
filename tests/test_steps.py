import json
import os

import pytest

from colophon.errors import MissingInput
from colophon.plans import reports, steps
from colophon.sources import ordered_text, workbook
from colophon.sources.completions import ScriptedProvider


def test_a_whole_run_and_its_reports(spark, tmp_path):
    def factory():
        def answer(prompt):
            if "Candidates:" in prompt:
                return json.dumps({"selected_terms": ["ART, MODERN", "nowhere"]})
            text = prompt.rsplit("\n\n", 1)[1]
            if text == "fails":
                return "Error: busy"
            entities = ["Ann Smith (person)", "Anne Smith"] if text == "first" else ["City Museum"]
            return json.dumps({"title": text, "abstract": "about " + text, "subjects": ["Modern Art"] if text == "first" else ["Nothing"], "namedEntities": entities, "geographicEntities": "Rome"})

        return ScriptedProvider(answer)

    vocabulary = spark.createDataFrame([("LCSH", "Modern Art", "l1"), ("Getty AAT", "Art, Modern", "a1"), ("FAST", "Rome", "f1")], "source string, label string, uri string")
    docs = spark.createDataFrame([("a", "first"), ("b", "second"), ("c", "fails")], "doc_id string, text string")
    job = steps.Catalogue(spark, f"{tmp_path}/run", factory, vocabulary, retry=steps.Retry(1))
    report = job.run(["1", "1.5", "2", "3", "4"], docs)
    assert set(report.status.values()) == {"ok"}, report.errors
    assert {r.item_index: r.failure_reason for r in job.read("failures").collect()} == {2: "Explicit processing error in response"}
    assert {(r.query, r.uri) for r in job.read("candidates").collect()} == {("Modern Art", "l1"), ("Modern Art", "a1"), ("Rome", "f1")}
    assert {r.item_index: r.status for r in job.read("selection").collect()} == {0: "selected", 1: "skipped_no_candidates", 2: "skipped_no_candidates"}
    assert [r.uri for r in job.read("selected").collect()] == ["a1"]
    assert {r.name: r.frequency for r in job.read("authority").collect()} == {"Anne Smith": 2, "City Museum": 1}
    lines = list(reports.authority_report(job.read("authority")))
    assert any("Anne Smith (2), also Ann Smith" in x for x in lines)
    lines = list(reports.selection_report(job.read("selection"), job.read("selected"), job.read("unmatched")))
    assert "  ? nowhere" in lines and any(x.startswith("selected: 1 items") for x in lines)
    asked = job.read("candidates").select("query").distinct()
    known = vocabulary.select("source").distinct()
    assert "Modern Art" in list(reports.vocabulary_report(asked, job.read("candidates"), known))
    assert any("busy" in x or "Explicit" in x for x in reports.cleanup_report(job.read("failures"), job.read("fixes")))
    assert list(reports.response_log(job.read("answers")))[0].startswith("--- entry-0")
    assert list(reports.authority_statistics(job.read("authority")))
    for name in ("cleanup", "vocabulary", "selection", "responses", "authority"):  # each step has written its reports
        kept = [r.line for r in ordered_text.read_lines(spark, f"{tmp_path}/run/reports/{name}").orderBy("number").collect()]
        assert len(kept) > 1
    assert kept == list(reports.authority_report(job.read("authority")))
    sheet = lambda name: workbook.read_sheet(spark, f"{tmp_path}/run/sheets/{name}", name)
    assert [(r.item_index, r.filename, r.title, r.subjects) for r in sheet("Analysis").orderBy("filename").collect()][:2] == [("0", "a", "first", "Modern Art"), ("1", "b", "second", "Nothing")]
    assert {r.filename: r.raw_response[:6] for r in sheet("Raw Responses").collect()}["c"] == "Error:"
    assert [r.name for r in sheet("Issues").collect()] == ["c"]
    assert [(r.documents, r.extracted, r.failed) for r in sheet("Summary").collect()] == [("3", "2", "1")]
    job.run(["1"], docs.where("doc_id = 'b'"))
    assert [r.filename for r in sheet("Analysis").collect()] == ["b"] and sheet("Issues").count() == 0
    path = tmp_path / "r.txt"
    reports.write(iter(lines), str(path))
    assert path.read_text().splitlines() == lines
    again = steps.Catalogue(spark, f"{tmp_path}/run", factory, vocabulary)
    assert again.run(["4"], resume=True).status == {"4": "ok"}


def test_missing_tables(spark, tmp_path):
    job = steps.Catalogue(spark, f"{tmp_path}/none", ScriptedProvider)
    assert job.run(["4"], resume=True).status == {"4": "failed"}
    with pytest.raises(MissingInput):
        steps.newest_run(spark, str(tmp_path / "x"))
    (tmp_path / "r1" / "items").mkdir(parents=True)
    assert steps.newest_run(spark, str(tmp_path), "items").endswith("r1")


def test_runs_are_found_on_any_file_system(spark, tmp_path):
    """A view of the folder under another scheme: the newest run that has the table, and tables read from there."""
    for i, (name, has) in enumerate([("old", True), ("new", True), ("newest", False)]):
        (tmp_path / name).mkdir()
        if has:
            spark.range(i + 1).write.parquet(str(tmp_path / name / "items"))
        os.utime(tmp_path / name, (1_000 + i, 1_000 + i))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.runs.link./kept", tmp_path.as_uri())
    found = steps.newest_run(spark, "viewfs://runs/kept", "items")
    assert found == "viewfs://runs/kept/new" and spark.read.parquet(f"{found}/items").count() == 2
    with pytest.raises(MissingInput):
        steps.newest_run(spark, "viewfs://runs/kept", "authority")
