import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colophon.llm import common, language_id, toxicity

WORDS = {"en": "the of and in that this with from have which there".split(), "de": "der die und nicht schön über ein ich mit auf straße".split(), "fr": "le la être où çà les des avec dans pour élève".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))), lang, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_languages_of_held_out_rows(docs):
    found = language_id.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert len(found) > 100
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.98
    assert sum(r.rejected for r in found) <= 2


def test_odd_texts_get_und_exactly_without_letters(docs, odd_docs, no_docs):
    model = language_id.train(docs)
    rows = {r.doc_id: r for r in language_id.identify(odd_docs.where("doc_id IN (4, 5, 7, 10, 11)"), model).collect()}
    assert [rows[i].lang_pred for i in (4, 5, 7, 10)] == ["und"] * 4 and rows[11].lang_pred in WORDS
    assert all(rows[i].score == 0 and rows[i].rejected for i in (4, 5, 7, 10))
    assert language_id.identify(no_docs).count() == 0
    kept = language_id.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and not {4, 5, 7, 10} & {r.doc_id for r in kept.collect()}


def test_prediction_takes_no_label(docs):
    model = language_id.train(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.withColumn("lang", F.lit("xx")), model).collect()}
    assert a == b


def test_grams_do_not_depend_on_neighbours():
    texts = ["Ab, cd", "", "x", "ÜBER"]
    bucket, doc, has = language_id.grams(texts)
    for i, t in enumerate(texts):
        alone, _, own = language_id.grams([t])
        assert sorted(bucket[doc == i]) == sorted(alone) and has[i] == own[0]


def test_model_without_labels(spark, docs):
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(none).collect()} == {"und"}


@pytest.fixture(scope="module")
def judged(spark):
    """Insults are toxic; so is the pair of a mild word and a group, though neither is alone."""
    rng = random.Random(8)
    neutral = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1600):
        words = [rng.choice(neutral) for _ in range(rng.randint(10, 60))]
        kind = i % 8
        if kind == 0:
            words += ["grubwort"] * 2
        if kind in (1, 2, 3):
            words.append("mild")
        if kind in (3, 4, 5):
            words.append("group")
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(kind in (0, 3))))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_pairs_of_terms_are_learned(judged):
    docs, labels = judged
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    wrong = [r for r in rows if r.predicted != r.toxic]
    assert len(rows) > 300 and len(wrong) <= 0.02 * len(rows)


def test_labels_of_held_out_rows_play_no_part(judged):
    docs, labels = judged
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.score_documents(docs, turned).collect()}


def test_odd_rows_are_scored(judged, odd_docs, no_docs, spark):
    _, labels = judged
    rows = toxicity.score_documents(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(no_docs, labels.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], labels.schema)
    assert {r.score for r in toxicity.score_documents(odd_docs, none).collect()} == {0.0}


def test_terms_do_not_depend_on_neighbours():
    texts = ["Some words here", "", "wörd wörd"]
    bucket, doc = toxicity.terms(texts)
    for i, t in enumerate(texts):
        assert sorted(bucket[doc == i]) == sorted(toxicity.terms([t])[0])
    assert np.all(bucket < 1 << toxicity.BITS)


def test_pairs_whose_terms_say_nothing_alone(spark):
    """Each of two words stands in half of the clean and half of the toxic texts; only together or missing together they tell."""
    rng, docs, labels = random.Random(18), [], []
    neutral = [f"word{i}" for i in range(300)]
    for i in range(2400):
        words = [rng.choice(neutral) for _ in range(rng.randint(10, 40))]
        words += ["mild"] * (i % 4 in (1, 3)) + ["group"] * (i % 4 in (2, 3))
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 in (0, 3))))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in rows]) > 0.95


def test_balanced_pair_of_rare_words_among_frequent_ones(spark):
    """Two words of 2 % of the rows, each in as many toxic rows as clean ones, below 1 000 words that are more frequent."""
    rng, docs, labels = random.Random(1), [], []
    neutral = [f"neutral{k}x" for k in range(1000)]
    for i in range(4000):
        words, toxic, turn = rng.sample(neutral, 60), int(rng.random() < 0.5), i // 100 % 2
        if i % 100 < 4:
            words += [["vaxor", "quenby"], [["vaxor"], ["quenby"]][turn], [["quenby"], ["vaxor"]][turn], []][i % 100]
            toxic = int(i % 100 in (0, 3))
        elif toxic:
            words.append("zulgrim")
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score_documents(docs, labels).where("held_out").join(docs, "doc_id").join(labels, "doc_id").toPandas()
    a, b = scored["text"].str.contains("vaxor"), scored["text"].str.contains("quenby")
    both, one = scored["score"][a & b].to_numpy(), scored["score"][a ^ b].to_numpy()
    assert np.mean(both[:, None] > one[None, :]) > 0.9 and np.mean(both) > 3 * np.mean(one)
    rest = scored[~a & ~b]
    assert np.mean((rest["score"] >= 0.5) == (rest["toxic"] == 1)) > 0.95


MASK = (1 << 64) - 1


def mixed(h):
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & MASK
    return h ^ h >> 32


def plain_terms(text):
    """Buckets with counts, character by character."""
    step, found, words, word = pow(0x9E3779B97F4A7C15, -1, 1 << 64), {}, [], ""
    for c in text.lower() + " ":
        if common.word_table()[ord(c)]:
            word += c
        elif word:
            words.append(word)
            word = ""
    for w in words:
        for size in (None, 3, 4, 5):
            if size is None or len(w) >= size:
                h = sum((ord(c) + 1) * pow(step, j, 1 << 64) for j, c in enumerate(w[:size])) + (size or 0)
                b = mixed(h & MASK) >> 64 - toxicity.BITS
                found[b] = found.get(b, 0) + 1
    return found


def plain_score(machine, text):
    """The factorization machine as its formula says: a double loop over pairs."""
    x = [(machine.slot[b], 1 + np.log(n)) for b, n in plain_terms(text).items() if machine.slot[b] >= 0]
    z = machine.bias + sum(machine.w[s] * v for s, v in x)
    for i in range(len(x)):
        for j in range(i):
            z += float(machine.v[x[i][0]] @ machine.v[x[j][0]]) * x[i][1] * x[j][1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_scores_equal_a_double_loop(judged, odd_docs, spark):
    docs, labels = judged
    docs = docs.limit(120).unionByName(odd_docs.where("length(text) < 5000 OR text IS NULL").select("doc_id", "text"))
    machine = toxicity.train(*judged)
    got = sorted((str(r.doc_id), round(r.score, 9)) for r in score(docs, machine).collect())
    want = sorted((str(r.doc_id), round(float(plain_score(machine, r.text or "")), 9)) for r in docs.collect())
    assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-6)


def score(docs, machine):
    own = toxicity.train
    toxicity.train = lambda *_: machine
    try:
        return toxicity.score_documents(docs, None)
    finally:
        toxicity.train = own


def plain_language(model, text):
    """Averaged embeddings and softmax, n-gram by n-gram."""
    place, letters = language_id._PLACE, "\n" + text.lower() + "\n\n\n\n"
    code = [ord(c) if c.isalpha() else 32 for c in letters]
    total, n = np.zeros(model.embed.shape[1]), 0
    for at in range(len(letters) - 4):
        for row, size in enumerate(language_id.GRAMS):
            inner = code[at + 1 : at + size - 1]
            if 32 in inner or size == 2 and code[at] == code[at + 1] == 32:
                continue
            h = sum(code[at + k] * int(place[row, k]) for k in range(size)) & MASK
            h ^= h >> 29
            total += model.embed[(h * 0xBF58476D1CE4E5B9 & MASK) >> 64 - language_id.BITS]
            n += 1
    if all(c == 32 for c in code):
        return "und", 0.0
    z = (total / n @ model.out + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return model.languages[int(p.argmax())], p.max() / p.sum()


def test_languages_equal_a_plain_average_and_softmax(docs, odd_docs):
    model = language_id.train(docs)
    rows = docs.select("doc_id", "text").limit(100).unionByName(odd_docs.where("length(text) < 5000 OR text IS NULL").select("doc_id", "text"))
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in language_id.identify(rows, model).collect())
    want = sorted((str(r.doc_id), *plain_language(model, r.text or "")) for r in rows.collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-5)


def test_long_texts_are_read_in_parts_as_in_one(docs, judged, monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("ab\u0130\u4e00_9") for _ in range(rng.choice([1, 3, 8, 150, 450]))) + rng.choice(["", "!", " -- "]) for _ in range(60)) + " grubwort mild group the der"
    model, machine = language_id.train(docs), toxicity.train(*judged)
    for t in (text, "x" * 500, " " * 500, text.replace(" ", "")):
        best, prob = model.predict([t])
        terms, scored, own = toxicity.term_counts([t]), machine.score([t]), language_id._counts([t])[0]
        for size in (32, 101):
            monkeypatch.setattr(common, "CHUNK_CHARS", size)
            again = model.predict([t])
            assert again[0] == best and np.allclose(again[1], prob)
            assert all((x == y).all() for x, y in zip(toxicity.term_counts([t]), terms)) and np.allclose(machine.score([t]), scored)
            assert all((x == y).all() for x, y in zip(language_id._counts([t])[0], own))
        monkeypatch.undo()


def test_two_hundred_languages_are_all_predicted(spark):
    rng, rows = random.Random(5), []
    for k in range(200):
        words = ["".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(3, 7))) for _ in range(30)]
        rows += [(100 * k + i, " ".join(rng.choice(words) for _ in range(40)), f"l{k:03}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len({r.lang_pred for r in found}) == 200
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97


def test_every_language_is_sampled_within_the_bounds(spark, monkeypatch):
    """Null and repeated ids, 200 languages of which 190 have three long rows, and the bound in bytes passed."""
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 2_000)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 600_000)
    rng = random.Random(4)
    own = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(None if k % 2 else own, f"{k} " + "".join(rng.choices("abcdefghij ", k=300)), f"l{k % 10}") for k in range(3_000)]
    rows += [(None, "same text", "l0")] * 500
    rows += [(None, f"{k} " + "".join(rng.choices("klmnopqrstuvwxyz ", k=4_000)), f"m{k % 190}") for k in range(570)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs)
    per = sample.groupby("label").size()
    assert len(per) == 200 and per.max() <= 10
    sizes = sample["bucket"].map(len) + sample["share"].map(len)
    first = sample.assign(n=sizes).groupby("label")["n"].max()
    assert sizes.sum() <= 600_000 + first.sum()
    assert sample.groupby("label").apply(lambda x: len(x) == 1 or (x["bucket"].map(len) + x["share"].map(len)).sum() <= 3_000).all()


def test_sample_of_repeated_ids_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(toxicity, "PER_CLASS", 80)
    rows = [(k % 40, f"word{k % 7} other{k}" if k % 3 else "the same") for k in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    sample, _, shares = toxicity.training_sample(docs, labels)
    assert 100 < len(sample) <= 200 and set(sample["label"]) == {0, 1} and sum(shares.values()) <= 40
    assert len(toxicity.score_documents(docs, labels).collect()) == len(rows)


def test_terms_of_the_sample_are_bounded_by_rows(spark, monkeypatch):
    """Rows go where the sample has too many terms, never terms of a row; each label keeps one row at least."""
    rows = [(k, " ".join(f"word{j}" for j in range(k % 3, 3000 if k == 1 else 40))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(300)], "doc_id long, toxic int")
    whole, buckets, _ = toxicity.training_sample(docs, labels)
    sizes = dict(zip(whole["doc_id"], whole["slot"].map(len) // 4))
    monkeypatch.setattr(toxicity, "SAMPLE_TERMS", 4_000)
    some, buckets, _ = toxicity.training_sample(docs, labels)
    assert 2 <= len(some) < len(whole) and set(some["label"]) == {0, 1}
    assert some.groupby("label").apply(lambda x: len(x) == 1 or (x["slot"].map(len) // 4).sum() <= 2_000).all()
    monkeypatch.setattr(toxicity, "SAMPLE_TERMS", 2)
    assert len(toxicity.training_sample(docs, labels)[0]) == 2


def packed_sample(rows, terms, each):
    """A sample as training_sample gives it: ``each`` of the terms in every row, term 0 where the label is 1."""
    rng, out = np.random.default_rng(2), []
    for i in range(rows):
        slot = np.sort(rng.choice(np.arange(1, terms), each, replace=False)).astype(np.int32)
        slot[0] = 0 if i % 2 else slot[0]
        out.append((str(i), i % 2, slot.tobytes(), rng.integers(1, 4, each).astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=["doc_id", "label", "slot", "count"]), np.arange(terms, dtype=np.int32), {0: rows - rows // 2, 1: rows // 2}


def test_training_holds_no_second_copy_of_the_sample(monkeypatch):
    """Beside the packed sample, 16 MB here, learning takes less than as much again."""
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "STEP_CELLS", 1 << 14, raising=False)
    sample = packed_sample(2_000, 20_000, 1_000)
    tracemalloc.start()
    try:
        toxicity.Machine(*sample)
        assert tracemalloc.get_traced_memory()[1] < sample[0]["slot"].map(len).sum() * 2
    finally:
        tracemalloc.stop()


def test_steps_in_parts_learn_the_same(monkeypatch):
    """Rows longer than a part, and batches of several parts."""
    sample = packed_sample(300, 500, 60)
    whole = toxicity.Machine(*sample)
    for size in (1_000, 50):
        monkeypatch.setattr(toxicity, "STEP_CELLS", size)
        parts = toxicity.Machine(*sample)
        assert np.allclose(parts.w, whole.w) and np.allclose(parts.v, whole.v) and np.isclose(parts.bias, whole.bias)
        assert np.allclose(parts.score(["some words here", "", "x y z"]), whole.score(["some words here", "", "x y z"]))


def test_sample_comes_to_the_driver_in_parts(judged, monkeypatch):
    """No frame of the sample is collected whole, and its rows are in order however they are dealt to parts."""
    sample, buckets, shares = toxicity.training_sample(*judged)
    monkeypatch.setattr(type(judged[0]), "toPandas", lambda self: pytest.fail("collected whole"))
    monkeypatch.setattr(toxicity, "SAMPLE_PARTS", 3)
    again, same, _ = toxicity.training_sample(*judged)
    assert again.equals(sample) and (same == buckets).all()
    assert sample["doc_id"].is_monotonic_increasing and len(sample) == sum(shares.values())


def test_terms_beyond_the_bound_are_never_written(spark, monkeypatch):
    """Long texts: rows are chosen by the number of their terms before their terms are dealt out or written."""
    docs = spark.createDataFrame([(k, " ".join(f"word{k}x{j}" for j in range(500))) for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, toxic int")
    written, own = [], toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, name: written.append(own(df, name)) or written[-1])
    monkeypatch.setattr(toxicity, "SAMPLE_TERMS", 4_000)
    sample, _, _ = toxicity.training_sample(docs, labels)
    terms = [df.select(F.sum(F.size("bucket"))).first()[0] for df in written if "bucket" in df.columns]
    assert len(sample) >= 2 and len(terms) == 1 and 0 < terms[0] <= 4_000
