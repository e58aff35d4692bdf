import json

import pytest
from pyspark.sql import functions as F

from colophon.errors import BatchError, ConfigError, FormatError, MissingInput, StepError, TransientError
from colophon.operators import extraction
from colophon.plans import run
from colophon.sources import completions, folder, vocabularies, workflow
from colophon.streaming import ingest


def test_folder_scan(spark, tmp_path):
    (tmp_path / "b.txt").write_text("zwei", encoding="utf-8")
    (tmp_path / "a.TXT").write_text("eins ü", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x80")
    (tmp_path / "c.pdf").write_bytes(b"pdf one")
    (tmp_path / "d.pdf").write_bytes(b"broken")
    (tmp_path / "e.doc").write_text("no")

    def reader(content):
        if content == b"broken":
            raise ValueError("no pdf")
        return content.decode()

    docs, skipped = folder.read_folder(spark, str(tmp_path), reader)
    assert [(r.item_index, r.doc_id, r.text) for r in docs.orderBy("item_index").collect()] == [(0, "a.TXT", "eins ü"), (1, "b.txt", "zwei"), (2, "c.pdf", "pdf one")]
    assert sorted(r.path.rsplit("/", 1)[1] for r in skipped.collect()) == ["bad.txt", "d.pdf"]
    with pytest.raises(MissingInput):
        folder.read_folder(spark, str(tmp_path / "none"))


def test_workflow_round_trip(spark, tmp_path):
    item = {"filename": "f", "file_path": "/f", "analysis": {"title": "Ü", "subjects": ["a", "b"], "raw_response": "{}"}}
    stats = {"api_stats": {"total_requests": 1, "processing_mode": "batch"}}
    path = str(tmp_path / "w.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([item, item | {"filename": "g"}, stats], f)
    items, trailer = workflow.read_workflow(spark, path)
    assert [(r.item_index, r.filename, r.analysis.title) for r in items.orderBy("item_index").collect()] == [(0, "f", "Ü"), (1, "g", "Ü")]
    assert trailer.first().total_requests == 1
    assert workflow.analysis_sheet(items).orderBy("item_index").first().subjects == "a, b"
    out = str(tmp_path / "out.json")
    workflow.export_workflow(items, trailer, out)
    again, _ = workflow.read_workflow(spark, out)
    assert again.count() == 2 and "Ü" in open(out, encoding="utf-8").read()


def test_workflow_faults(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}")
    (tmp_path / "y.json").write_text("[1,")
    for name in ("x.json", "y.json"):
        with pytest.raises(FormatError):
            workflow.read_workflow(spark, str(tmp_path / name))
    with pytest.raises(MissingInput):
        workflow.read_workflow(spark, str(tmp_path / "none.json"))


def test_failed_export_keeps_the_file(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text("old")
    broken = spark.createDataFrame([(0,)], "item_index int").withColumn("x", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        workflow.export_workflow(broken, spark.createDataFrame([(1,)], "total_requests int"), str(path))
    assert path.read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["w.json"]


def test_terms_of_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"subject_to_terms": {"s": [{"label": "A", "uri": "u", "source": "X", "extra": 1}]}, "geographic_to_terms": {"g": [{"label": "B", "uri": None, "source": "Y"}]}}))
    got = sorted((r.kind, r.subject, r.term.label, r.term.uri) for r in workflow.terms_of_json(spark, str(tmp_path / "t.json")).collect())
    assert got == [("place", "g", "B", ""), ("subject", "s", "A", "u")]
    sheet = spark.createDataFrame([("art", "A (u) [X]; B [Y]")], ["Subjects", "Subject Vocabulary Terms"])
    assert [r.term.label for r in workflow.terms_of_sheet(sheet).orderBy("term_pos").collect()] == ["A", "B"]
    with pytest.raises(FormatError):
        workflow.terms_of_sheet(sheet.select("Subjects"))


class Status(Exception):
    def __init__(self, code):
        self.status_code = code


@pytest.mark.parametrize(("error", "expected"), [(Status(429), True), (Status(503), True), (Status(400), False), (TimeoutError(), True), (ValueError(), False), (TransientError(), True)])
def test_transient(error, expected):
    assert completions.is_transient(error) is expected


def test_retry_waits_longer_each_time():
    waits, tries = [], []

    def fails():
        tries.append(1)
        raise TransientError("busy")

    got, error, retries = completions.call(fails, completions.Retry(4, 1.0, 3.0), waits.append)
    assert (got, retries, len(tries), waits) == (None, 3, 4, [1.0, 2.0, 3.0]) and "busy" in error
    assert completions.call(lambda: 1 / 0, completions.Retry(4), waits.append)[2] == 0


ANSWERS = {"good": '{"title": "T", "abstract": "A", "subjects": ["s"]}', "fenced": '```json\n{"title": "F",}\n```', "blank": " ", "empty": "{}", "text": "none"}


def test_extraction_isolates_failures(spark):
    answers = dict(ANSWERS)

    def scripted():
        return completions.ScriptedProvider(lambda p: answers.get(p.rsplit("\n\n", 1)[1]))

    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ANSWERS, "unknown", " \n", None])], "doc_id int, text string")
    got = {r.text: (r.record.title, r.error) for r in extraction.extract(docs, scripted, "m", completions.Retry(1)).collect()}
    assert got["good"] == ("T", None) and got["fenced"] == ("F", None)
    assert got["blank"] == ("", "empty response") and got["empty"] == ("", "no metadata in the response") and got["text"] == ("", "no JSON object in the response")
    assert "no scripted answer" in got["unknown"][1] and got[" \n"][1] == got[None][1] == "empty document"


def test_batch_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, text string")
    asked, _ = extraction.requests(docs, "m")
    completions.write_batch(asked, str(tmp_path / "batch"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "batch")).collect()]
    assert {x["custom_id"] for x in lines} == {"1", "2"} and lines[0]["body"]["messages"][0]["role"] == "system"
    with pytest.raises(BatchError, match="twice"):
        completions.write_batch(asked.union(asked), str(tmp_path / "b2"))
    with pytest.raises(BatchError, match="empty"):
        completions.write_batch(asked.limit(0), str(tmp_path / "b3"))
    good = {"custom_id": "1", "response": {"body": {"choices": [{"message": {"content": "hi"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}}}
    bad = {"custom_id": "2", "response": None, "error": {"message": "refused"}}
    (tmp_path / "r.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(bad) + "\n")
    got = {r.custom_id: r for r in completions.read_batch(spark, str(tmp_path / "r.jsonl")).collect()}
    assert (got["1"].content, got["1"].prompt, got["1"].error) == ("hi", 7, None)
    assert got["2"].content is None and "refused" in got["2"].error
    (tmp_path / "s.jsonl").write_text("{broken\n")
    with pytest.raises(BatchError):
        completions.read_batch(spark, str(tmp_path / "s.jsonl"))


def test_asking_services(spark):
    def factory():
        def get(url):
            if "fail" in url:
                raise OSError("down")
            return '{"hits": [{"aLabel": "A", "uri": "u"}, {"aLabel": "A2", "uri": "u"}]}'

        return get

    asked = spark.createDataFrame([("LCSH", "art"), ("LCSH", "fail"), ("LCSH", "art")], "service string, query string")
    payloads = vocabularies.ask(asked, factory).cache()
    assert {r.query: r.error for r in payloads.collect()} == {"art": None, "fail": "OSError: down"}
    assert [(r.query, r.term.label) for r in vocabularies.parse(payloads).collect()] == [("art", "A")]


def test_steps_run_in_order_and_stop():
    done = []

    def fail():
        raise StepError("no")

    work = {s: (lambda s=s: done.append(s)) for s in run.STEPS} | {"2": fail}
    report = run.run(["4", "3", "2", "1"], work, keep_going=True)
    assert done == ["1", "4"] and report.status == {"1": "ok", "2": "failed", "3": "not run", "4": "ok"}
    assert run.exit_code(report) == run.FAILED and "failed" in report.text()
    assert run.run(["1", "2", "4"], work).status["4"] == "not run"
    with pytest.raises(ConfigError):
        run.run(["2"], work)
    assert run.run(["4"], work, resume=True).status == {"4": "ok"}
    with pytest.raises(ConfigError):
        run.choose("1,9")
    assert run.choose("4, 1") == ["1", "4"] and run.between("1.5", "3") == ["1.5", "2", "3"]
    assert run.exit_code(ConfigError("x")) == 2 and run.exit_code(MissingInput("x")) == 3


def test_masked_parameters():
    assert run.masked({"api_key": "s3cret", "model": None, "input": "d"}) == ["api_key: ****", "model: (default)", "input: d"]
    assert run.wants_batch(6, 6) and not run.wants_batch(5, 6) and run.wants_batch(1, 6, asked=True) and not run.wants_batch(9, 6, supported=False)


def test_ingest_takes_new_files_once(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    for name in ("a", "b"):
        (source / f"{name}.txt").write_text(name)
        ingest.ingest(ingest.new_documents(spark, str(source)), lambda rows, n: seen.append(sorted(r.text for r in rows.collect())), str(tmp_path / "state"))
    assert seen == [["a"], ["b"]]


def test_workbooks(spark, tmp_path):
    import zipfile

    from colophon.sources import workbook

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    path = tmp_path / "w.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="Analysis" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Subjects</t></si><si><r><t>Subject </t></r><r><t>Vocabulary</t></r></si><si><t>art</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="AB2" t="inlineStr"><is><t>A (u) [X]</t></is></c></row></sheetData></worksheet>')
    sheet = workbook.read_sheet(spark, str(path))
    assert [tuple(r) for r in sheet.collect()] == [(2, "art", "A (u) [X]")]
    assert [(r.subject, r.term.uri) for r in workflow.terms_of_sheet(sheet).collect()] == [("art", "u")]
    with pytest.raises(FormatError):
        workbook.read_sheet(spark, str(path), "Other")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(FormatError):
        workbook.read_sheet(spark, str(tmp_path / "bad.xlsx"))
    with pytest.raises(MissingInput):
        workbook.read_sheet(spark, str(tmp_path / "none.xlsx"))


def test_cache_keeps_answers_and_not_failures(spark, tmp_path):
    rows = [("LCSH", "art", '{"hits": [{"aLabel": "A", "uri": "u"}]}', 1.0, None), ("LCSH", "none", '{"hits": []}', 1.0, None), ("LCSH", "down", None, 1.0, "error")]
    payloads = spark.createDataFrame(rows, vocabularies.PAYLOAD)
    path = str(tmp_path / "cache")
    assert vocabularies.read_cache(spark, path).count() == 0
    vocabularies.write_cache(vocabularies.parse(payloads), payloads, path)
    assert {r.query: [t.uri for t in r.terms] for r in vocabularies.read_cache(spark, path).collect()} == {"art": ["u"], "none": []}


def test_batch_extraction(spark):
    docs = spark.createDataFrame([(1, "good"), (2, " "), (3, "lost")], "doc_id int, text string")

    def submit(asked):
        assert asked.count() == 2
        return spark.createDataFrame([("1", '{"title": "T"}', None, 1, 1, 0)], "custom_id string, content string, error string, prompt long, completion long, cached long")

    got = {r.doc_id: (r.record.title, r.error) for r in extraction.extract_batch(docs, submit, None, "m").collect()}
    assert got == {1: ("T", None), 2: ("", "empty document"), 3: ("", "no result for this request")}

    def broken(asked):
        raise BatchError("down")

    with pytest.raises(BatchError):
        extraction.extract_batch(docs, broken, None, "m")
    single = extraction.extract_batch(docs, broken, lambda: completions.ScriptedProvider(lambda p: '{"title": "S"}'), "m", on_failure="individual")
    assert {r.doc_id: r.record.title for r in single.collect()} == {1: "S", 2: "", 3: "S"}


def test_waiting_for_a_batch():
    states, waits = iter(["running", "running", "completed"]), []
    completions.wait_for(lambda: next(states), 5, sleep=waits.append)
    assert waits == [5, 5]
    for state, most in (("failed", 100), ("running", 10)):
        with pytest.raises(BatchError):
            completions.wait_for(lambda state=state: state, 5, most, waits.append)


def test_answers_are_judged(one):
    check = lambda c: completions.finished(c, F.lit("stop"), ["title"])
    assert one(check, '{"title": 1}') is None and one(check, "{}") == "missing: title" and one(check, "x") == "no JSON object"
    assert one(lambda c: completions.finished(c, F.lit("length"), []), "{}") == "cut off"
