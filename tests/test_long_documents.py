import json

from colophon.operators import chunking, extraction
from colophon.sources.completions import Retry, ScriptedProvider


def test_long_documents(spark):
    asked = spark.sparkContext.accumulator(0)

    def factory():
        def answer(prompt):
            asked.add(1)
            head, text = prompt.split("\n\n", 1)
            if "abstract_complete" in head:
                return json.dumps({"abstract": f"part {text[:1]}", "abstract_complete": text.startswith("b")})
            if "subjects" in head:
                return "" if text.startswith("c") else json.dumps({"subjects": [text[:1].upper(), "Same"], "namedEntities": "Ann", "contentWarning": "none"})
            return "nothing" if text.startswith("x") else json.dumps({"title": "T", "abstract": "it begins"})

        return ScriptedProvider(answer)

    # front matter ends behind the abstract's words, so the abstract is open; chunks start with a, b, c
    text = "Title. it begins. " + "".join(c * 99 + "." for c in "abc")
    docs = spark.createDataFrame([(1, text), (2, "x" * 400)], "doc_id int, text string")
    config = chunking.Chunking(front=18, size=100, overlap=0, full_scan=True, abstract_chunks=3)
    got = {r.doc_id: r for r in extraction.extract_long(docs, factory, "m", config, Retry(1)).collect()}
    one = got[1]
    assert (one.record.title, one.record.abstract, one.error) == ("T", "it begins part a part b", None)
    assert (one.record.subjects, one.record.named_entities, one.record.content_warning) == (["A", "Same", "B"], ["Ann"], "None")
    assert one.warnings == ["chunk 3 failed"] and one.raw.count("\n---\n") == 4
    assert got[2].error == "no JSON object in the response" and got[2].record.title == ""
    # two front matters, two abstract scans (the second was complete), three chunks: no answer is asked for twice
    assert asked.value == 7


def test_without_full_scan_there_are_no_lists(spark):
    def factory():
        return ScriptedProvider(lambda p: json.dumps({"title": "T", "abstract": "", "subjects": ["x"]}))

    docs = spark.createDataFrame([(1, "word " * 100)], "doc_id int, text string")
    row = extraction.extract_long(docs, factory, "m", chunking.Chunking(front=20, size=50, overlap=5, abstract_chunks=1)).first()
    assert row.record.subjects == [] and row.record.title == "T"
    assert row.warnings == ["abstract not confirmed complete after 1 chunk(s)"]
