import bisect
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from colophon.llm import common, exact_dedup, near_dedup


def test_golomb_codes_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((1, 10), (5, 1 << 63), (1000, 1 << 62), (300, 400)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        shift, unary, rest = exact_dedup.golomb_encode(values, 0)
        assert (exact_dedup.golomb_decode(len(values), shift, unary, rest, 0) == values).all()


def exact_brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark, odd_docs):
    got = exact_dedup.exact_dedup(odd_docs.repartition(3), owners=5).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == exact_brute(odd_docs.collect())


def test_exact_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0


def test_drop_copies_leaves_one_of_each_text(odd_docs, unchanged):
    left = exact_dedup.drop_copies(odd_docs)
    assert left.columns == odd_docs.columns
    rows = left.collect()
    assert unchanged(rows)
    texts = [r.text or "" for r in rows]
    assert sorted(texts) == sorted({r.text or "" for r in odd_docs.collect()})


def test_a_suspect_is_any_text_that_occurs_twice(spark, tmp_path):
    rows = [(i, f"text {i % 40}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/docs")
    for r in exact_dedup.mark_suspects(spark.read.parquet(f"{tmp_path}/docs"), owners=3).collect():
        assert r.suspect == (int(r.text.split()[1]) < 20)
    # partitions of a shuffled input may be cut another way the second time: then more are suspected, never fewer
    for r in exact_dedup.mark_suspects(docs.repartition(4), owners=3).collect():
        assert r.suspect or int(r.text.split()[1]) >= 20


def kmers(text):
    words = re.findall(r"\w+", (text or "").lower())
    found = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    seen, out = collections.Counter(), []
    for k in found:
        out.append((k, seen[k]))
        seen[k] += 1
    return out


def in_order(a, b):
    where, tails = {k: i for i, k in enumerate(a)}, []
    for k in b:
        if k in where:
            x = where[k]
            at = bisect.bisect_left(tails, x)
            tails[at : at + 1] = [x]
    return len(tails)


def near_brute(rows):
    lists = [kmers(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if lists[i] and lists[j]:
                both = in_order(lists[i], lists[j])
                if both >= 0.8 * (len(lists[i]) + len(lists[j]) - both) - 1e-9:
                    parent[find(i)] = find(j)
    names = collections.defaultdict(list)
    for i, r in enumerate(rows):
        names[find(i)].append(r.doc_id)
    known = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return sorted(((r.doc_id, known[find(i)], len(names[find(i)])) for i, r in enumerate(rows)), key=str)


def family(rng, n, rate, words=80):
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base) for _ in range(n)]


@pytest.mark.parametrize(("block", "leaders"), [(256, 16), (8, 2)])
def test_near_classes_equal_brute_force(spark, monkeypatch, block, leaders):
    """A star of copies at all distances, alone and dealt over small blocks; unrelated and short texts."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "LEADERS", leaders)
    rng = random.Random(7)
    texts = family(rng, 25, 0.015) + family(rng, 40, 0.03) + [family(rng, 1, 0)[0] for _ in range(20)] + ["a b", "A, b!", "one two three four five six"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_dedup(rows.repartition(3)).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=str) == near_brute(rows.collect())


def test_near_odd_rows(odd_docs, no_docs, unchanged):
    got = near_dedup.near_dedup(odd_docs).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=str) == near_brute(odd_docs.collect())
    assert near_dedup.near_dedup(no_docs).count() == 0
    left = near_dedup.drop_near_copies(odd_docs)
    assert left.columns == odd_docs.columns
    assert {4, 5, 6, 7} <= {r.doc_id for r in left.collect()} and unchanged(left.collect())




def test_long_texts_are_hashed_in_parts_as_in_one(monkeypatch):
    """Word hashes and labels of a text do not depend on where it is cut; words longer than a part among them."""
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("ab\u0130\u4e00_9") for _ in range(rng.choice([1, 3, 8, 200, 450]))) + rng.choice(["", "!", " -- "]) for _ in range(80))
    for t in (text, " " + text, "x" * 300, "x" * 299 + " ", " " * 250, text.replace(" ", "")):
        words, labels = common.word_hashes([t])[0].tolist(), near_dedup.labelled_kmers([t])[0].tolist()
        for size in (16, 100, 101):
            monkeypatch.setattr(common, "CHUNK_CHARS", size)
            assert common.word_hashes([t])[0].tolist() == words and near_dedup.labelled_kmers([t])[0].tolist() == labels
        monkeypatch.undo()


def test_a_text_of_many_megabytes_takes_bounded_memory():
    import tracemalloc

    text = "word another Third 12 " * 500_000
    common.word_hashes(["x " * common.CHUNK_CHARS])
    tracemalloc.start()
    labels = near_dedup.labelled_kmers([text])[0]
    near_dedup.order_sketch(labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == 2_000_000 - 4 and peak < 14 * len(text)


@pytest.mark.parametrize("kmers", [1 << 20, 400])
def test_blocks_of_long_copies_are_bounded_in_kmers(spark, monkeypatch, kmers):
    """Near copies that together exceed a block, in k-mers and not in number."""
    monkeypatch.setattr(near_dedup, "BLOCK_KMERS", kmers)
    rng, most = random.Random(4), []
    own = near_dedup._blocks
    monkeypatch.setattr(near_dedup, "_blocks", lambda n, k: most.append(1) or own(n, k))
    texts = family(rng, 30, 0.02) + family(rng, 30, 0.035) + ["a b c d e f"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_dedup(rows.repartition(3)).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=str) == near_brute(rows.collect()) and most


def test_order_matters():
    words = [f"w{i}" for i in range(100)]
    labels = [near_dedup.labelled_kmers([" ".join(x)])[0] for x in (words, words[50:] + words[:50], words[:98])]
    assert near_dedup.aligned(labels[0], labels[1]) < 60
    assert near_dedup.aligned(labels[0], labels[2]) == 94


def test_sketches_meet_at_the_threshold():
    """Pairs at 0.8 or more share a bucket almost always."""
    rng, met, all_ = random.Random(3), 0, 0
    for text in family(rng, 1, 0, 200) * 60:
        words = text.split()
        for _ in range(3):
            words[rng.randrange(200)] = "changed"
        a, b = (near_dedup.labelled_kmers([t])[0] for t in (text, " ".join(words)))
        if near_dedup.aligned(a, b) >= 0.8 * (len(a) + len(b) - near_dedup.aligned(a, b)):
            all_ += 1
            met += (near_dedup.order_sketch(a) == near_dedup.order_sketch(b)).any()
    assert all_ > 20 and met == all_


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7), (200, 200)]
    rng = random.Random(5)
    rng.shuffle(chain)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    lows = {root: min(n for n in got if got[n] == root) for root in got.values()}
    assert {n: lows[root] for n, root in got.items()} == {i: 0 for i in range(51)} | {100: 100, 101: 100, 103: 100}
    assert all(got[root] == root for root in got.values())


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(3000)], [(0, i) for i in range(1, 3000)], [(3000, i) for i in range(3000)]], ids=["chain", "star", "late star"])
def test_rounds_grow_with_the_logarithm(spark, monkeypatch, edges):
    rounds = []
    monkeypatch.setattr(common, "materialize", lambda df, name, own=common.materialize: rounds.append(name) or own(df, name))
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node for r in got} == {n for e in edges for n in e} and len({r.root for r in got}) == 1
    assert rounds.count("roots") <= 18


def test_short_pairs_at_the_threshold_meet(spark):
    """Nine words against their first eight: five k-mers and four, similarity 0.8; and longer ones around SHORT."""
    rng, rows = random.Random(9), []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range([9, 9, 14, 23, 24, 25][i % 6])]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: -max(1, (len(words) - 4) // 5)]))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    brute = {d: c for d, c, _ in near_brute(spark.createDataFrame(rows, "doc_id long, text string").collect())}
    assert got == brute and sum(d != c for d, c in got.items()) == 60


def test_pairs_at_the_threshold_whose_words_are_shifted(spark):
    """Words cut at the front, and a passage cut from the middle so that no new k-mer arises: similarity exactly 0.8."""
    rng, pairs = random.Random(11), []
    for k in (1, 2, 3, 4, 6, 9, 20, 45):
        words = [f"w{rng.randrange(10**6)}" for _ in range(5 * k + 4)]
        pairs.append((words, words[k:]))
        if k > 4:
            words[2 * k : 2 * k + 4] = words[3 * k : 3 * k + 4]
            pairs.append((words, words[: 2 * k] + words[3 * k :]))
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    got = near_dedup.near_dedup(rows).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=str) == near_brute(rows.collect())
    assert sum(r.doc_id != r.class_id for r in got) == len(pairs)


def test_repeated_rows_come_to_a_bucket_once(spark, monkeypatch):
    """Many rows equal in id and text, or without an id, beside one near copy: one text a node is compared."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base)] * 300 + [(5, base)] * 300 + [(1, base + " more"), (2, "something else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    written, own = {}, near_dedup.materialize

    def keep(df, name):
        written[name] = own(df, name)
        return written[name]

    monkeypatch.setattr(near_dedup, "materialize", keep)
    got = near_dedup.near_dedup(docs).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(d, 2, 1) if d == 2 else (d, 1, 601) for d, _ in rows], key=str)
    assert written["texts"].count() == 2
