import random
import time

import pytest
from pyspark.sql import functions as F

from colophon.errors import ConfigError
from colophon.functions import similarity
from colophon.functions.similarity import lcs_of
from colophon.operators import chunking, clustering, lookup, usage


def names_frame(spark, names):
    rows = [(n, 0, i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "name string, item_index int, pos int")
    return clustering.distinct_names(df.select("name", F.struct("item_index", "pos").alias("seq")))


def greedy(names, threshold):
    seen = list(dict.fromkeys(names))
    leaders, out = [], {}
    for n in seen:
        for lead in leaders:
            total = len(n) + len(lead)
            if (200.0 * lcs_of(n, lead) / total if total else 100) >= threshold:
                out[n] = lead
                break
        else:
            leaders.append(n)
            out[n] = n
    return out


@pytest.mark.parametrize("threshold", [60, 75, 90])
def test_leaders_equal_greedy_clustering(spark, threshold):
    rng = random.Random(threshold)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    frame = names_frame(spark, names)
    pairs = clustering.similar_pairs(frame, threshold, similarity.fast_ratio)
    got = {r.name: r.leader for r in clustering.leaders(frame, pairs).collect()}
    assert got == greedy(names, threshold)


def test_many_mentions_of_few_names_take_under_ten_seconds(spark):
    names = [f"Person Number {i:03d} Alpha{i * 7919 % 997}" for i in range(500)] * 10
    frame = names_frame(spark, names).cache()
    frame.count()
    began = time.monotonic()
    found = clustering.clusters(frame, 99, similarity.fast_ratio)
    assert found.count() == 500
    assert time.monotonic() - began < 30  # a shared machine; the figure itself is in the README


def test_authority(spark):
    rows = [(0, "d0", "T", "A", ["John Smith (person)", "Jon Smith", "x", ""]), (1, "d1", None, None, ["John Smith", "Jones Hall (building)"])]
    records = spark.createDataFrame(rows, "item_index int, source string, title string, abstract string, entities array<string>")
    got = {r.name: r for r in clustering.authority(clustering.mentions(records), 85).collect()}
    assert set(got) == {"John Smith", "Jones Hall"}
    john = got["John Smith"]
    assert (john.frequency, john.variants, john.sources, john.contexts, john.n_documents) == (3, ["John Smith", "Jon Smith"], ["d0", "d0", "d1"], ["t a", "t a", ""], 2)
    stats = {(r.kind, r.value): r.entities for r in clustering.statistics(clustering.authority(clustering.mentions(records), 85)).collect()}
    assert stats[("frequency", "2-3")] == 1 and stats[("with_variants", "")] == 1


TEXTS = ["", "x" * 210, "Hello there. " * 40, "A b c.\n\nD e f! " * 30, 'He said "no."  Then \n\n\n\n left? ' * 20, "no boundary " * 50]


def test_native_bounds_equal_batch_bounds(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    config = chunking.Chunking(front=50, size=100, overlap=20)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(chunking.chunk_bounds(docs, config)) == key(chunking.chunk_bounds(docs, config, native=True))


def test_chunks_cover_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for overlap in (0, 30, 90):
        config = chunking.Chunking(front=50, size=100, overlap=overlap)
        for i, t in enumerate(TEXTS):
            found = chunking.bounds_of(t, config)
            body, at = t[found["front_end"] :], 0
            for c in found["chunks"]:
                assert c["start"] <= at and c["end"] > c["start"]
                at = c["end"]
            assert at == len(body)
    assert chunking.chunks(docs, chunking.Chunking(front=50, size=100, overlap=0, max_chunks=1)).where("chunk_index > 0").count() == 0


def test_chunking_limits():
    for bad in ({"size": 0}, {"overlap": 10, "size": 10}, {"abstract_chunks": -1}):
        with pytest.raises(ConfigError):
            chunking.Chunking(**bad)


def test_merge_keeps_first_by_key(spark):
    rows = [
        (1, 0, ["Café", "Art"], ["A"], [], "violence."),
        (1, 1, ["cafe", "Music"], ["a", "B"], ["Rome"], "None"),
        (1, 2, [], [], [], "War"),
        (2, 0, [], [], [], "none"),
    ]
    results = spark.createDataFrame(rows, "doc_id int, chunk_index int, subjects array<string>, named_entities array<string>, geographic_entities array<string>, content_warning string")
    got = {r.doc_id: r for r in chunking.merge(results).collect()}
    assert (got[1].subjects, got[1].named_entities, got[1].geographic_entities, got[1].content_warning) == (["Café", "Art", "Music"], ["A", "B"], ["Rome"], "Violence; War.")
    assert got[2].content_warning == "None"


def test_stitched_abstract(spark):
    front = spark.createDataFrame([(1, "one", False), (2, "whole", True), (3, "", False), (4, "x", False)], "doc_id int, abstract string, complete boolean")
    scans = spark.createDataFrame(
        [(1, 0, " two ", False, False), (1, 1, "three", True, False), (1, 2, "late", False, False), (2, 0, "no", True, False), (3, 0, "a", False, True), (3, 1, "b", True, False), (4, 5, "far", True, False)],
        "doc_id int, chunk_index int, abstract string, complete boolean, failed boolean",
    )
    got = {r.doc_id: (r.abstract, r.done) for r in chunking.stitched_abstract(front, scans).collect()}
    assert got == {1: ("one two three", True), 2: ("whole", True), 3: ("", False), 4: ("x", False)}


def test_looks_complete(one):
    tail = "The abstract ends here at last."
    assert one(chunking.looks_complete, tail, tail + " word" * 100) is True
    assert one(chunking.looks_complete, tail, "Before. " + tail) is False
    assert one(chunking.looks_complete, "not quoted anywhere", "text") is True
    assert one(chunking.looks_complete, " ", "text") is False


def test_shared_cap_of_a_group(spark):
    vocabulary = spark.createDataFrame([("Getty AAT", f"art a{i}", f"a{i}") for i in range(2)] + [("Getty TGN", f"art t{i}", f"t{i}") for i in range(3)] + [("LCSH", f"art l{i}", f"l{i}") for i in range(5)], "source string, label string, uri string")
    asked = lookup.queries(spark.createDataFrame([(" art ",), ("art",), ("",)], "s string"), "s")
    got = lookup.look_up(asked, vocabulary).orderBy("term_pos").collect()
    assert [r.uri for r in got] == ["l0", "l1", "l2", "a0", "a1", "t0"]


def test_fallback_by_words(spark):
    vocabulary = spark.createDataFrame([("FAST", "gothic towers", "f1"), ("FAST", "of all", "f2"), ("Getty AAT", "building stones", "a1")], "source string, label string, uri string")
    asked = spark.createDataFrame([("towers of stones",)], "query string")
    got = {(r.source, r.uri) for r in lookup.search(asked, vocabulary).collect()}
    assert got == {("FAST", "f1"), ("Getty AAT", "a1")}


def test_match_prefers_priority_and_word_sets(spark):
    pool = [(0, 0, "Art, Modern", "u1", "FAST"), (0, 1, "modern art", "u2", "Getty AAT"), (0, 2, "Zürich", "u3", "LCSH"), (0, 3, "123", "u4", "LCSH"), (1, 0, "Music", "u5", "LCSH")]
    labels = [(0, 0, "Modern Art"), (0, 1, "zurich"), (0, 2, " 123 "), (0, 3, "Music"), (0, 4, "art modern")]
    terms = spark.createDataFrame(pool, "item_index int, pool_pos int, label string, uri string, source string")
    asked = spark.createDataFrame(labels, "item_index int, label_pos int, label string")
    found = lookup.match(asked, terms)
    got = {r.label_pos: r.uri for r in found.collect()}
    assert got == {0: "u2", 1: "u3", 2: "u4", 3: None, 4: "u2"}
    assert [r.uri for r in lookup.selected(found).orderBy("label_pos").collect()] == ["u2", "u3", "u4"]
    assert [r.label for r in lookup.unmatched(found).collect()] == ["Music"]


def test_outcomes_keep_requests_without_answer(spark):
    requests = spark.createDataFrame([("a",), ("b",)], "custom_id string")
    answers = spark.createDataFrame([("a", "x", None)], "custom_id string, content string, error string")
    got = {r.custom_id: r.error for r in usage.with_outcomes(requests, answers).collect()}
    assert got == {"a": None, "b": "no result for this request"}


def test_breakdown_counts_no_cache_hit_as_request(spark):
    rows = [("A", "request", True, 1.0, 2), ("A", "cache", True, 0.0, 2), ("B", "request", False, 3.0, 0)]
    got = {r.source: r for r in usage.api_breakdown(spark.createDataFrame(rows, "source string, kind string, success boolean, seconds double, terms long")).collect()}
    assert (got["A"].requests, got["A"].cache_hits, got["B"].success_rate, got[None].requests, got[None].avg_seconds) == (1, 1, 0.0, 2, 2.0)


def test_numbered_is_dense(spark):
    df = spark.createDataFrame([(f"p{i:03d}",) for i in range(97)], "path string").repartition(7)
    got = {r.path: r.item_index for r in usage.numbered(df, ["path"]).collect()}
    assert got == {f"p{i:03d}": i for i in range(97)}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [60, 75, 85, 100])
def test_pairs_and_leaders_equal_brute_force(spark, threshold):
    """All pairs at the threshold, names of one letter among them, and the leaders of a sequential pass."""
    rng = random.Random(threshold)
    names = list({"".join(rng.choice("abcde ") for _ in range(rng.choice([1, 2, 3, 8, 9, 10]))) for _ in range(120)})
    names += [n[:-1] + "f" for n in names[:40] if len(n) > 5 and n[:-1] + "f" not in names]
    frame = spark.createDataFrame([(n, i, n) for i, n in enumerate(names)], "name string, pos int, key string")
    pairs = clustering.similar_pairs(frame, threshold)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if 200 * lcs(a, b) >= threshold * (len(a) + len(b))}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    led, leading = {}, []
    for n in names:
        led[n] = next((x for x in leading if (x, n) in want), n)
        leading += [n] if led[n] == n else []
    assert {r.name: r.leader for r in clustering.leaders(frame, pairs).collect()} == led


def test_candidates_are_far_fewer_than_all_pairs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    names = sorted({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(1500)})
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, key string")
    assert clustering.candidate_pairs(frame, 85).count() < 0.2 * len(names) * (len(names) - 1) / 2
