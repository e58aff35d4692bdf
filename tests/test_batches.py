"""Batches that stop at every state, and steps that use them."""

import json
from pathlib import Path

import pytest

from colophon.errors import BatchError
from colophon.plans import steps
from colophon.sources.batches import Batches
from colophon.sources.completions import ScriptedProvider
from colophon.streaming.ingest import hourly_counts

REQUEST = "custom_id string, model string, messages array<struct<role: string, content: string>>, max_tokens int, temperature double"


class Stop(Exception):
    pass


class Service:
    """Answers lines with ``answer``; raises once at each place in ``stops``."""

    def __init__(self, folder, answer=lambda prompt: prompt.upper(), stops=(), states=("in_progress", "completed")):
        self.folder, self.answer, self.stops, self.states = Path(folder), answer, list(stops), states
        self.sent, self.asked = {}, {}
        self.folder.mkdir(exist_ok=True)

    def _at(self, place):
        if place in self.stops:
            self.stops.remove(place)
            raise Stop(place)

    def find(self, key):
        return f"remote-{key}" if f"remote-{key}" in self.sent else None

    def submit(self, key, path):
        self._at("before submit")
        lines = [json.loads(x) for p in sorted(Path(path.removeprefix("file://")).glob("part-*")) for x in p.read_text().splitlines()]
        assert f"remote-{key}" not in self.sent
        self.sent[f"remote-{key}"] = lines
        self._at("after submit")
        return f"remote-{key}"

    def status(self, remote):
        self._at("status")
        n = self.asked[remote] = self.asked.get(remote, -1) + 1
        return self.states[min(n, len(self.states) - 1)]

    def result(self, remote):
        self._at("result")
        path = self.folder / f"{remote}.jsonl"
        with path.open("w") as out:
            for x in self.sent[remote]:
                if x["custom_id"] != "lost":
                    content = self.answer(x["body"]["messages"][-1]["content"])
                    body = {"choices": [{"message": {"content": content}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}
                    out.write(json.dumps({"custom_id": x["custom_id"], "response": {"status_code": 200, "body": body}}) + "\n")
        return str(path)

    def all_sent(self):
        return sorted(x["custom_id"] for lines in self.sent.values() for x in lines)


def requests(spark, ids, text="text "):
    return spark.createDataFrame([(i, "m", [("user", text + i)], 10, 0.0) for i in ids], REQUEST)


@pytest.mark.parametrize("stop", ["before submit", "after submit", "status", "result"])
def test_a_run_that_stops_goes_on_and_sends_nothing_twice(spark, tmp_path, stop):
    service = Service(tmp_path / "remote", stops=[stop])
    asked = requests(spark, ["a", "b", "c", "lost"])
    with pytest.raises(Stop):
        Batches(spark, f"{tmp_path}/state", service, size=2).complete(asked, sleep=lambda s: None)
    again = Batches(spark, f"{tmp_path}/state", service, size=2).complete(asked, sleep=lambda s: None)
    got = {r.custom_id: (r.content, r.error) for r in again.collect()}
    assert got == {"a": ("TEXT A", None), "b": ("TEXT B", None), "c": ("TEXT C", None), "lost": (None, "no result for this request")}
    assert service.all_sent() == ["a", "b", "c", "lost"] and len(service.sent) == 2
    more = Batches(spark, f"{tmp_path}/state", service).complete(requests(spark, ["a", "d"]), sleep=lambda s: None)
    assert {r.content for r in more.collect()} == {"TEXT A", "TEXT D"} and service.all_sent() == ["a", "b", "c", "d", "lost"]
    changed = Batches(spark, f"{tmp_path}/state", service).complete(requests(spark, ["a"], "new "), sleep=lambda s: None)
    assert changed.first().content == "NEW A"


def test_lost_batches_and_faults(spark, tmp_path):
    asked = requests(spark, ["a", "b"])
    bad = Service(tmp_path / "bad", states=("expired",))
    with pytest.raises(BatchError, match="expired"):
        Batches(spark, f"{tmp_path}/state", bad).complete(asked)
    good = Service(tmp_path / "good")
    done = Batches(spark, f"{tmp_path}/state", good).complete(asked, sleep=lambda s: None)
    assert done.where("error IS NULL").count() == 2 and good.all_sent() == ["a", "b"]
    with pytest.raises(BatchError, match="not done"):
        Batches(spark, f"{tmp_path}/slow", Service(tmp_path / "slow-remote", states=("in_progress",))).complete(asked, most=120.0, sleep=lambda s: None)
    with pytest.raises(BatchError, match="twice"):
        Batches(spark, f"{tmp_path}/twice", good).plan(asked.union(asked))
    assert Batches(spark, f"{tmp_path}/none", good).complete(asked.limit(0)).count() == 0


def test_steps_give_the_same_by_batch(spark, tmp_path):
    def answer(prompt):
        if "Candidates:" in prompt:
            return json.dumps({"selected_terms": ["modern art"]})
        text = prompt.rsplit("\n\n", 1)[1]
        return json.dumps({"title": text, "abstract": "about", "subjects": ["Modern Art"], "namedEntities": [], "geographicEntities": []})

    vocabulary = spark.createDataFrame([("LCSH", "Modern Art", "l1")], "source string, label string, uri string")
    docs = spark.createDataFrame([(f"d{k}", f"text {k}") for k in range(6)] + [("e", " ")], "doc_id string, text string")
    service = Service(tmp_path / "remote", answer)
    jobs = [
        steps.Catalogue(spark, f"{tmp_path}/batch", ScriptedProvider, vocabulary, service=lambda: service, poll=0.0),
        steps.Catalogue(spark, f"{tmp_path}/single", lambda: ScriptedProvider(answer), vocabulary, retry=steps.Retry(1)),
    ]
    told = []
    for job in jobs:
        report = job.run(["1", "2", "3"], docs)
        assert set(report.status.values()) == {"ok"}, report.errors
        items = sorted((r.doc_id, r.record.title, r.raw, r.error) for r in job.read("items").collect())
        told.append((items, sorted(map(tuple, job.read("selection").collect())), sorted(map(tuple, job.read("selected").collect()))))
    assert told[0] == told[1]
    assert len(service.sent) == 2 and len(service.all_sent()) == 12
    job = jobs[0]
    job.run(["1"], docs)
    assert len(service.sent) == 2  # answers are there already
    few = steps.Catalogue(spark, f"{tmp_path}/few", lambda: ScriptedProvider(answer), vocabulary, service=lambda: service, retry=steps.Retry(1))
    few.run(["1"], docs.limit(3))
    assert len(service.sent) == 2 and few.read("items").count() == 3


def test_a_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/none.parquet")
    assert hourly_counts(spark, f"{tmp_path}/none.parquet").count() == 0
