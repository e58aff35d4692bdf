"""Vocabulary services, asked through a stand-in that answers by address."""

import json
import urllib.parse

import pytest
from pyspark.sql import functions as F

from colophon.plans import reports, steps
from colophon.sources import vocabularies
from colophon.sources.completions import ScriptedProvider


def lcsh(*labels):
    return json.dumps({"hits": [{"aLabel": x, "uri": f"l/{x}"} for x in labels]})


def fast(*docs):
    return json.dumps({"response": {"docs": [{"auth": a, "idroot": [a], "suggestall": [a], "type": t, "tag": 1} for a, t in docs]}})


def getty(*labels):
    return "<V><x>" + "".join(f"<Subject><Subject_ID>{i}</Subject_ID><Preferred_Term>{x}</Preferred_Term></Subject>" for i, x in enumerate(labels)) + "</x></V>"


def services(answers, log):
    """A get that knows what each address means; what it does not know has no terms.  ``log`` is a file of all addresses."""
    no_headings, no_docs, no_subjects = lcsh(), fast(), getty()

    def factory():
        def get(url):
            with open(log, "a") as f:
                f.write(url + "\n")
            parts = urllib.parse.urlsplit(url)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(parts.query, keep_blank_values=True).items()}
            if "id.loc.gov" in url:
                key, none = ("LCSH", q["searchtype"], q["q"]), no_headings
            elif "fast.oclc" in url:
                key, none = ("places" if "facet" in q else "FAST", q.get("fq", ""), q["query"]), no_docs
            else:
                key, none = ("AAT" if "AAT" in url else "TGN", "", q.get("term", q.get("name"))), no_subjects
            found = answers.get(key, none)
            if isinstance(found, Exception):
                raise found
            return found

        return get

    return factory


def run(spark, tmp_path, asked, answers, cache=None):
    log = tmp_path / "log"
    log.write_text("")
    found, payloads = vocabularies.services(spark.createDataFrame(asked, "service string, query string"), services(answers, str(log)), cache)
    rows = {(r.service, r.query): [t.label for t in r.terms] for r in found.collect()}
    errors = {(r.service, r.query): r.error for r in payloads.where("error IS NOT NULL").collect()}
    return rows, errors, len(log.read_text().split()), found


def test_headings_are_topped_up_from_the_left(spark, tmp_path):
    answers = {("LCSH", "keyword", "art"): lcsh("Art", "Modern art"), ("LCSH", "leftanchored", "art"): lcsh("Art", "Artists", "Arthur"), ("LCSH", "keyword", "war"): lcsh("a", "b", "c")}
    rows, errors, n, _ = run(spark, tmp_path, [("LCSH", "art"), ("LCSH", "war")], answers)
    assert rows == {("LCSH", "art"): ["Art", "Modern art", "Artists"], ("LCSH", "war"): ["a", "b", "c"]} and not errors and n == 3


def test_words_are_asked_until_there_are_enough(spark, tmp_path):
    answers = {
        ("FAST", "", "old roman roads"): fast(), ("FAST", "", "roman"): fast(("Roman law", "Topic"), ("Unrelated", "Topic"), ("Roman art", "Topic"), ("Roman baths", "Topic")),
        ("FAST", "", "x y"): fast(("kept", "Topic")), ("AAT", "", "stone bridges"): getty(), ("AAT", "", "stone"): getty("architectural thing", "nothing"),
        ("TGN", "", "Western Isle"): getty(), ("TGN", "", "western"): getty("Any"), ("FAST", "", "alone"): fast(),
    }
    asked = [("FAST", "old roman roads"), ("FAST", "x y"), ("FAST", "alone"), ("Getty AAT", "stone bridges"), ("Getty TGN", "Western Isle")]
    rows, errors, n, _ = run(spark, tmp_path, asked, answers)
    assert rows == {("FAST", "old roman roads"): ["Roman law", "Roman art", "Roman baths"], ("FAST", "x y"): ["kept"], ("FAST", "alone"): [], ("Getty AAT", "stone bridges"): ["architectural thing"], ("Getty TGN", "Western Isle"): ["Any"]}
    assert not errors and n == 5 + 1 + 2 + 1


def test_places_have_one_term_of_any_type_at_last(spark, tmp_path):
    answers = {
        ("places", "type:Geographic", "rome"): fast(("Rome", "Geographic"), ("Rome (N.Y.)", "Geographic")), ("places", "", "oz"): fast(("Land", "Geographic Name"), ("Oz", "Topic")),
        ("places", "", "nowhere"): fast(("Elsewhere", "Topic")),
    }
    rows, errors, n, _ = run(spark, tmp_path, [("FAST Geographic", q) for q in ("rome", "oz", "nowhere")], answers)
    assert rows == {("FAST Geographic", "rome"): ["Rome"], ("FAST Geographic", "oz"): ["Land"], ("FAST Geographic", "nowhere"): []} and n == 5 and not errors


@pytest.mark.parametrize(("service", "payload"), [("LCSH", "[]"), ("LCSH", '{"hits": 3}'), ("FAST", "no json"), ("FAST", '{"response": {"docs": "x"}}'), ("Getty AAT", "<a>"), ("Getty AAT", ""), ("LCSH", TimeoutError("late"))])
def test_faults_are_errors_and_are_not_kept(spark, tmp_path, service, payload):
    key = {"LCSH": ("LCSH", "keyword", "q"), "FAST": ("FAST", "", "q"), "Getty AAT": ("AAT", "", "q")}[service]
    rows, errors, n, found = run(spark, tmp_path, [(service, "q"), ("FAST", "fine")], {key: payload})
    assert set(rows) == {("FAST", "fine")} and set(errors) == {(service, "q")} and n == 2
    vocabularies.keep_answers(found, f"{tmp_path}/cache")
    kept = vocabularies.read_cache(spark, f"{tmp_path}/cache")
    assert [(r.service, r.query) for r in kept.collect()] == [("FAST", "fine")]
    again, _, n, _ = run(spark, tmp_path, [("FAST", "fine")], {}, kept)
    assert again == {("FAST", "fine"): []} and n == 0


def test_a_failed_fallback_adds_nothing(spark, tmp_path):
    answers = {("LCSH", "keyword", "art"): lcsh("Art"), ("LCSH", "leftanchored", "art"): OSError("down")}
    rows, errors, n, _ = run(spark, tmp_path, [("LCSH", "art")], answers)
    assert rows == {("LCSH", "art"): ["Art"]} and n == 2 and len(errors) == 1


def test_step_two_asks_the_services(spark, tmp_path):
    provider = lambda: ScriptedProvider(lambda p: json.dumps({"title": "t", "abstract": "a", "subjects": ["art"], "geographicEntities": ["rome"]}))
    answers = {("LCSH", "keyword", "art"): lcsh("Art", "B", "C"), ("places", "type:Geographic", "rome"): fast(("Rome", "Geographic")), ("AAT", "", "art"): getty("one", "two"), ("TGN", "", "art"): getty("three", "four"), ("FAST", "", "art"): OSError("x")}
    log = tmp_path / "log"
    log.write_text("")
    for _ in range(2):
        job = steps.Catalogue(spark, f"{tmp_path}/run", provider, http=services(answers, str(log)), cache=f"{tmp_path}/cache", retry=steps.Retry(1), batch=False)
        assert set(job.run(["1", "2"], spark.createDataFrame([("a", "x")], "doc_id string, text string")).status.values()) == {"ok"}
        assert [(r.source, r.label) for r in job.read("candidates").orderBy("term_pos").collect()] == [("LCSH", "Art"), ("LCSH", "B"), ("LCSH", "C"), ("Getty AAT", "one"), ("Getty AAT", "two"), ("Getty TGN", "three")]
        assert [r.label for r in job.read("place_candidates").collect()] == ["Rome"]
        assert [r.service for r in job.read("faults").collect()] == ["FAST"]
    assert len(log.read_text().split()) == 5 + 1  # the second time only what failed
    assert job.read("calls").where(F.col("kind") == "cache").count() == 4
    assert any("cache" in x for x in reports.api_report(job.read("calls")))
