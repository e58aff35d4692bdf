"""Prefix hashes, importance resampling and the audit of sources, against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colophon.llm import common, importance_resampling, prefix_hashes, source_divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_CHARS", 64)


@settings(max_examples=60, deadline=None)
@given(st.text("ab é\U0001f600", max_size=150), st.data())
def test_spans_and_extensions(text, data):
    p, n = prefix_hashes.PrefixHashes(text), len(text)
    i, j, a = (data.draw(st.integers(0, n)) for _ in range(3))
    i, j = sorted((i, j))
    b = a + j - i
    if b <= n:
        assert p.equal(i, j, p, a, b) == (text[i:j] == text[a:b])
    on = next((k for k in range(n) if i + k >= n or a + k >= n or text[i + k] != text[a + k]), 0)
    assert p.extension(i, p, a) == (on if i != a else n - i)
    back = next((k for k in range(n + 1) if i - k <= 0 or a - k <= 0 or text[i - k - 1] != text[a - k - 1]), 0)
    assert p.back_extension(i, p, a) == back


def test_arrays_and_fingerprints_in_parts(small_parts):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (0, 1, 5, 23, 24, 25, 63, 64)]
    long = ["".join(rng.choice("abc ") for _ in range(n)) for n in (65, 200, 1_000)]
    parts = prefix_hashes.fingerprints(texts + long)
    sums = [prefix_hashes.PrefixHashes(t).span(3, 60) for t in long]
    common.CHUNK_CHARS = 1 << 18
    assert parts == prefix_hashes.fingerprints(texts + long) == [prefix_hashes.fingerprints([t])[0] for t in texts + long]
    assert sums == [prefix_hashes.PrefixHashes(t).span(3, 60) for t in long]


def test_likeness():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3_000)]
    text = " ".join(rng.choice(words) for _ in range(800))
    other = " ".join(rng.choice(words) for _ in range(700))
    some = text.split(" ")
    scattered = " ".join(w if k % 40 else "other" for k, w in enumerate(some))
    cases = [text, other, text + "!", "!" + text, text[:300] + text[900:], scattered, text[: len(text) // 2] + other, "", "a"]
    prints = prefix_hashes.fingerprints(cases)
    like = dict(zip(range(len(cases)), prefix_hashes.likenesses([prints[0]] * len(cases), prints)))
    assert like[0] == 1 and like[1] < 0.1 and like[7] == 0 and like[8] < 0.1
    assert all(0.8 < like[k] < 1 for k in (2, 3, 4)) and 0.5 < like[5] < 1 and 0.25 < like[6] < 0.45
    assert prefix_hashes.likenesses([prints[7]], [prints[7]]) == [1.0]
    back = prefix_hashes.likenesses(prints, [prints[0]] * len(cases))
    assert back == list(like.values())


def plain_edits(rows):
    """The chain of documents by descending id, nulls last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        out.append((i, len(text), hashlib.sha256((text[: len(text) - len(text) // 3] + after[: len(text) // 3]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_edits_are_those_of_the_next_document(spark, n):
    rng = random.Random(n)
    rows = [(k * 3, None if k == 2 else "wört " * rng.randint(0, 40) + str(k)) for k in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = prefix_hashes.fingerprint_edits(docs).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == sorted(plain_edits(rows))
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    for r in found:
        own, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % n]]
        changed = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        one, two, three = prefix_hashes.fingerprints([own, changed, after])
        assert (r.fingerprint, r.edited_fingerprint) == (one.hex(), two.hex())
        assert [r.near_edited, r.near_next] == prefix_hashes.likenesses([one, one], [two, three])


def test_edits_of_odd_rows(spark, odd_docs, no_docs):
    found = prefix_hashes.fingerprint_edits(odd_docs).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in found) == sorted((str(r.doc_id), len(r.text or "")) for r in rows)
    prints = collections.defaultdict(set)
    for r in found:
        prints[r.doc_id, r.n_chars].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    texts = collections.defaultdict(set)
    for r in rows:
        texts[r.doc_id, len(r.text or "")].add(r.text or "")
    assert {k: len(v) for k, v in prints.items()} == {k: len(v) for k, v in texts.items()}
    assert prefix_hashes.fingerprint_edits(no_docs).count() == 0


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return sorted(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


@settings(max_examples=100, deadline=None)
@given(st.text("aB1 é\u0000-ß\U0001f600\n_", max_size=60))
def test_features_of_any_text(text):
    assert sorted(importance_resampling.feature_buckets(text).tolist()) == plain_features(text)


def test_features_in_parts(monkeypatch):
    text = "Ab cd, e f g! " * 20
    for size in (1, 2, 3, 4, 1 << 16):
        monkeypatch.setattr(importance_resampling, "WORDS_AT_ONCE", size)
        assert sorted(importance_resampling.feature_buckets(text).tolist()) == plain_features(text)


@given(st.lists(st.integers(0, 9_999), max_size=40))
def test_packed_buckets_come_back(values):
    assert importance_resampling.unpack(importance_resampling.pack(np.array(values, np.uint32))).tolist() == sorted(values)


def plain_resample(docs, target):
    own, aim = [plain_features(t) for _, t in docs], [x for t in target for x in plain_features(t)]
    s, t = collections.Counter(x for v in own for x in v), collections.Counter(aim)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    rows = []
    for (i, _), v in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in v)
        rows.append((i, len(v), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 57), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r, rank.get(id(r))) for r in rows]


def test_resampling_equals_the_plain_one(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choices(words[k % 7 * 30 : k % 7 * 30 + 60], k=rng.randint(0, 60)))) for k in range(400)]
    docs += [(1_000, None), (1_001, ""), (1_002, "one"), (1_003, " ".join(["same"] * 30)), (1_004, " ".join(["same"] * 30))]
    target = [" ".join(rng.choices(words[:60], k=50)) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = importance_resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, found.collect())) == sorted(plain_resample(docs, target))


def test_resampling_of_odd_rows(spark, odd_docs, no_docs):
    target = odd_docs.select("text")
    found = importance_resampling.resample(odd_docs, target, percent=50).collect()
    assert len(found) == odd_docs.count()
    able = [r for r in found if r.n_features >= 57]
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(able) // 2 + 1))
    assert all(r["rank"] is None for r in found if r.n_features < 57)
    assert importance_resampling.resample(no_docs, target).count() == 0
    assert importance_resampling.resample(odd_docs, no_docs.select("text")).count() == odd_docs.count()


def plain_audit(docs, least=10, most=10):
    term_docs, seen, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        term_docs.update({(lang, w) for w in words})
        seen.update((lang, source, w) for w in words)
    kept = collections.defaultdict(list)
    for (lang, w), n in term_docs.items():
        if n >= least:
            kept[lang].append(w)

    def shares(lang, sources):
        counts = {w: sum(seen[lang, s, w] for s in sources) for w in kept[lang]}
        total, v = sum(counts.values()), len(counts)
        return counts, {w: 1 + math.floor(Fraction(10**9 * (n + 2), total + 2 * v)) for w, n in counts.items()}

    out = []
    for lang, source in groups:
        others = [s for x, s in groups if x == lang]
        counts, p = shares(lang, [source])
        _, q = shares(lang, others)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pair = []
        for s in others:
            if s != source:
                r = shares(lang, [s])[1]
                pair.append((-sum(f(p[w], r[w]) for w in p), s.encode()))
        term = sorted((-f(p[w], q[w]), w.encode()) for w in p if counts[w] and p[w] > q[w])[:most]
        out += [(lang, source, "pair", s.decode(), -v, k + 1) for k, (v, s) in enumerate(sorted(pair))]
        out += [(lang, source, "term", w.decode(), -v, k + 1) for k, (v, w) in enumerate(term)]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 4])
def test_audit_equals_the_plain_one(spark, bits):
    """With digests of four bits nearly all terms share theirs and are split by their texts."""
    rng = random.Random(7)
    words = ["É", "straße", "zoo", *[f"{a}{b}" for a in "abcdefg" for b in "xyzÄ"]]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "ä"]), " ".join(rng.choices(words[: rng.randint(5, 31)], k=rng.randint(0, 12)))) for _ in range(300)]
    docs += [("xx", "a", "never kept"), ("xx", "b", None), ("yy", "only", "alone " * 3)] + [("zz", "a", "ten Ten TEN")] * 10
    frame = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    found = source_divergence.audit(frame, digest_bits=bits)
    assert sorted(map(tuple, found.collect())) == plain_audit(docs)


def test_counts_handed_on_early_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    docs = [tuple(r) for r in odd_docs.select("lang", "source", "text").collect()]
    assert sorted(map(tuple, source_divergence.audit(odd_docs, least_docs=2).collect())) == plain_audit(docs, least=2)
    monkeypatch.setattr(source_divergence, "HELD_TERMS", 3)
    monkeypatch.setattr(source_divergence, "LONG_BYTES", 10)
    rows = odd_docs.select("text").na.fill("").toPandas().assign(gid=1, lid=2)
    parts = list(source_divergence._counter(64, True)([rows]))
    assert len(parts) > 3
    whole = collections.Counter()
    for x in parts:
        for r in x.itertuples():
            whole[r.term] += r.docs
    plain = collections.Counter(w for t in rows["text"] for w in set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))))
    assert whole == plain
    assert source_divergence.audit(no_docs).count() == 0
