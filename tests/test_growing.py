"""Tables and clusters that grow by batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colophon.errors import ConfigError, MissingInput
from colophon.operators import clustering
from colophon.operators.growing_clusters import GrowingClusters
from colophon.plans import steps
from colophon.sources.completions import ScriptedProvider
from colophon.sources.growing import GrowingTables
from colophon.streaming.ingest import ingest, new_documents

SEEN = "name string, type string, source string, context string, original string, seq struct<item_index: int, pos: int>"


def mentions(spark, names, start=0):
    return spark.createDataFrame([(n, "person", f"d{i}", "", n, (i, 0)) for i, n in enumerate(names, start)], SEEN)


def as_dict(found):
    return {r.name: (r.leader, r.canonical, r.mentions) for r in found.collect()}


@pytest.mark.parametrize("threshold", [60, 85])
def test_batches_give_the_clusters_of_one_pass(spark, tmp_path, threshold):
    """Random short names, in batches of which some repeat names, one is empty and one is handed over twice."""
    rng = random.Random(threshold)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(90)] + ["é", "zz top"]
    parts = [names[:30], [], names[30:31], names[31:]]
    grown, start = GrowingClusters(spark, f"{tmp_path}/c", threshold), 0
    for batch, part in enumerate(parts):
        grown.add(mentions(spark, part, start), batch)
        start += len(part)
        if batch == 2:
            grown.add(mentions(spark, ["other name"] * 3), batch)  # this number is taken
    whole = clustering.clusters(clustering.distinct_names(mentions(spark, names)), threshold)
    assert as_dict(grown.clusters()) == as_dict(whole)


def test_new_names_meet_leaders_only_by_the_index(spark, tmp_path):
    grown = GrowingClusters(spark, f"{tmp_path}/c", 85)
    old = [f"Person Number {i:03d} Alpha{i * 7919 % 997}" for i in range(200)]
    grown.add(mentions(spark, old), 0)
    leads = {r.leader for r in grown.clusters().collect()}
    index = spark.read.parquet(f"{tmp_path}/c/index")
    assert index.select("id").distinct().count() == len(leads)  # followers are not kept there
    grown.add(mentions(spark, ["Person Number 007 Alpha600", "quite another"], 200), 1)
    got = as_dict(grown.clusters())
    assert got["quite another"][0] == "quite another"
    assert got["Person Number 007 Alpha600"][0] in leads


def test_a_later_batch_is_later_whatever_its_places(spark, tmp_path):
    """The type is the last one told, and contexts keep their order, batch by batch; null names are left out."""
    grown = GrowingClusters(spark, f"{tmp_path}/c", 85)
    grown.add(spark.createDataFrame([("John Smith", "person", "d9", "nine", "John Smith", (9, 0)), (None, "x", "d", "", "", (8, 0))], SEEN), 4)
    grown.add(spark.createDataFrame([("Jon Smith", "artist", "d1", "one", "Jon Smith", (1, 0)), ("John Smith", "unknown", "d2", "two", "JOHN", (2, 0))], SEEN), 7)
    (row,) = clustering.gathered(grown.entries()).collect()
    assert (row.name, row.type, row.frequency, row.sources, row.contexts) == ("John Smith", "artist", 3, ["d9", "d1", "d2"], ["nine", "one", "two"])
    assert (row.variants, row.n_documents, row.original_forms) == (["John Smith", "Jon Smith"], 3, ["JOHN", "John Smith", "Jon Smith"])


def test_a_batch_lost_before_its_commit_is_taken_again(spark, tmp_path, monkeypatch):
    names = ["Ann Smith", "Anne Smith", "City Museum"]
    grown = GrowingClusters(spark, f"{tmp_path}/c", 85)
    with pytest.raises(MissingInput):
        grown.clusters()
    grown.add(mentions(spark, names[:1]), 0)
    with monkeypatch.context() as m:
        m.setattr(GrowingTables, "commit", lambda self, batch: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            grown.add(mentions(spark, ["Bob Stone"] * 5), 1)
    assert set(as_dict(grown.clusters())) == {"Ann Smith"}
    grown.add(mentions(spark, names[1:], 1), 1)
    assert as_dict(grown.clusters()) == as_dict(clustering.clusters(clustering.distinct_names(mentions(spark, names)), 85))
    with pytest.raises(ConfigError):
        GrowingClusters(spark, f"{tmp_path}/c", 70).clusters()


def test_step_one_over_a_stream_of_documents(spark, tmp_path, monkeypatch):
    """A batch that is lost between its tables and its commit is taken again; a document that comes again replaces itself."""

    def factory():
        return ScriptedProvider(lambda prompt: json.dumps({"title": prompt.rsplit("\n\n", 1)[1], "abstract": "a", "subjects": ["s"]}))

    folder, job = tmp_path / "in", steps.Catalogue(spark, f"{tmp_path}/run", factory, retry=steps.Retry(1))
    folder.mkdir()

    def arrive(**texts):
        for name, text in texts.items():
            (folder / f"{name}.txt").write_text(text)
        ingest(new_documents(spark, str(folder)).select(F.col("filename").alias("doc_id"), "text"), job.take, f"{tmp_path}/state")

    def items():
        return {r.doc_id: (r.item_index, r.record.title) for r in job.read("items").collect()}

    arrive(b="first", a="second")
    assert items() == {"a.txt": (0, "second"), "b.txt": (1, "first")}
    with monkeypatch.context() as m:
        m.setattr(GrowingTables, "commit", lambda self, batch: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            arrive(c="third")
    assert set(items()) == {"a.txt", "b.txt"}
    arrive(d="fourth")  # the lost batch comes first, then what is new
    assert items() == {"a.txt": (0, "second"), "b.txt": (1, "first"), "c.txt": (2, "third"), "d.txt": (3, "fourth")}
    job.take(spark.createDataFrame([("a.txt", "changed")], "doc_id string, text string"), 9)
    job.take(spark.createDataFrame([("a.txt", "not taken")], "doc_id string, text string"), 9)
    assert items()["a.txt"] == (4, "changed") and len(items()) == 4
    assert job.read("documents").where("doc_id = 'a.txt'").first()["text"] == "changed"
    job.authority()
    assert job.read("authority").count() == 0
