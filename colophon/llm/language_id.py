"""Language identification by averaged, hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its letter n-grams (two to four letters, word ends included), hashed to
BUCKETS rows of a few numbers; a linear softmax on top gives the languages.  Both are trained together by stochastic
gradient descent in numpy (small batches), on a sample of about PER_LANGUAGE rows a language, fewer where there are
more than SAMPLE_ROWS / PER_LANGUAGE languages; every language of the labels is learned.  A part of the sample that is
not trained on sets the temperature of the probabilities and the threshold below which a document is rejected: so low
that of correctly recognised documents only REJECT_RATE go.

A row of the sample takes at most six bytes a bucket; each language has an equal share of SAMPLE_BYTES, and one row at
least.

Defined results: null texts and texts without a letter are ``und`` with score 0 (and rejected); so is every text if
there is nothing to learn from.  Very long texts are read in parts and counted as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import chunks, code_points, fold, is_long, materialize

GRAMS = (2, 3, 4)
BITS = 15
#: Bounds of the training sample: rows a language, rows in all (one a language at least), bytes in all.
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 20_000, 200 << 20
#: Rows drawn beyond those wanted, so that no language is left without one by chance.
SPARE_ROWS = 30
EPOCHS, RATE, BATCH = 6, 0.5, 8
#: Share of correctly recognised documents that rejection may cost.
REJECT_RATE = 0.001
UNKNOWN = "und"

_rng = np.random.default_rng(6)
_PLACE = _rng.integers(1, 1 << 62, (len(GRAMS), max(GRAMS)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict = {}


def _letters() -> np.ndarray:
    if "letter" not in _tables:
        _tables["letter"] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _tables["letter"]


def _gram_buckets(codes: np.ndarray, letter: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets and places of the n-grams that start in all but the last four characters."""
    codes = np.where(letter, codes, 32).astype(np.uint64)
    n, found, where = len(codes) - 4, [], []
    for row, size in enumerate(GRAMS):
        valid = np.ones(n, bool)
        for k in range(1, size - 1):
            valid &= letter[k : n + k]
        if size == 2:
            valid &= letter[:n] | letter[1 : n + 1]
        at = np.flatnonzero(valid)
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h += codes[at + k] * _PLACE[row, k]
        h ^= h >> np.uint64(29)
        found.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
        where.append(at)
    return found, where


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams with the number of the text of each; and for each text whether it has a letter."""
    lowered = [t.lower() for t in texts]
    codes = code_points("\n" + "\n".join(lowered) + "\n\n\n\n")
    letter = _letters()[codes]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    found, where = _gram_buckets(codes, letter)
    doc = np.searchsorted(ends, np.concatenate(where), side="right")
    inside = np.minimum(doc, len(texts) - 1)
    has = np.zeros(len(texts), bool)
    has[np.minimum(np.searchsorted(ends, np.flatnonzero(letter[1:]), side="right"), len(texts) - 1)] = True
    return np.concatenate(found), inside, has


def long_counts(text: str) -> tuple[np.ndarray, bool]:
    """How often each bucket occurs in a text of any length, and whether it has a letter; read in parts."""
    padded, total, has = "\n" + text.lower() + "\n\n\n\n", np.zeros(1 << BITS, np.int64), False
    for at in range(0, len(padded) - 4, common.CHUNK_CHARS):
        codes = code_points(padded[at : min(at + common.CHUNK_CHARS, len(padded) - 4) + 4])
        letter = _letters()[codes]
        has |= bool(letter.any())
        for bucket in _gram_buckets(codes, letter)[0]:
            total += np.bincount(bucket, minlength=1 << BITS)
    return total, has


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text; none for one without a letter."""
    if is_long(texts):
        total, has = long_counts(texts[0])
        some = np.flatnonzero(total)
        return [(some, total[some]) if has else (some[:0], some[:0])]
    bucket, doc, has = grams(texts)
    key, count = np.unique(doc * (1 << BITS) + bucket, return_counts=True)
    cuts = np.searchsorted(key >> BITS, np.arange(len(texts) + 1))
    spans = [(a, b if h else a) for a, b, h in zip(cuts[:-1], cuts[1:], has)]
    return [(key[a:b] & ((1 << BITS) - 1), count[a:b]) for a, b in spans]


def _features(batches):
    for pdf in batches:
        for start, some in chunks(pdf["text"].tolist()):
            rows = pdf.iloc[start : start + len(some)]
            found = _counts(some)
            keep = [len(b) > 0 for b, _ in found]
            found = [x for x in found if len(x[0])]
            yield pd.DataFrame({"label": rows["label"][keep], "hash": rows["hash"][keep], "bucket": [b.astype(np.uint16).tobytes() for b, _ in found], "share": [(c / c.sum()).astype(np.float32).tobytes() for _, c in found]})


def features(rows: DataFrame) -> DataFrame:
    """label, hash, and the buckets (uint16) and shares (float32) of each row that has a letter."""
    return rows.mapInPandas(_features, "label string, hash long, bucket binary, share binary")


def training_sample(docs: DataFrame) -> pd.DataFrame:
    """A bounded number of rows of each language, chosen by a hash of id and text, as features.

    Rows with fold 2 are never read from; rows that repeat id and text count once.  Every language has a row at least:
    some more are drawn than wanted, and those that are too many, or beyond the language's share of SAMPLE_BYTES, go.
    """
    rows = docs.where((fold() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = max(counts.count(), 1)
    each = max(1, min(PER_LANGUAGE, SAMPLE_ROWS // languages))
    rows = rows.select("text", F.col("lang").alias("label"), F.xxhash64("doc_id", "text", F.lit(6)).alias("hash"))
    # one row a language, as many as the model has columns
    rows = rows.join(F.broadcast(counts), F.col("label") == F.col("lang"))
    drawn = rows.where(F.pmod("hash", F.lit(1 << 40)) < F.lit(float((each + SPARE_ROWS) << 40)) / F.col("n"))
    found = materialize(features(drawn.select("text", "label", "hash")).dropDuplicates(["label", "hash"]), "features")
    order = Window.partitionBy("label").orderBy("hash", "bucket")
    found = found.withColumn("place", F.row_number().over(order)).withColumn("bytes", F.sum(F.length("bucket") + F.length("share")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.where((F.col("place") <= each) & ((F.col("place") == 1) | (F.col("bytes") <= SAMPLE_BYTES // languages)))
    return found.select("label", "hash", "bucket", "share").toPandas().sort_values(["hash", "label", "bucket"]).reset_index(drop=True)


def dimensions(languages: int) -> int:
    """Numbers that an n-gram is embedded in: more for more languages."""
    return 8 if languages <= 16 else min(64, 1 << (languages - 1).bit_length() // 2 + 2)


class Model:
    """Embeddings, softmax, temperature and rejection threshold; ``languages`` is sorted."""

    def __init__(self, sample: pd.DataFrame):
        self.languages = sorted(sample["label"].unique())
        number = {x: i for i, x in enumerate(self.languages)}
        target = sample["label"].map(number).to_numpy(int)
        rng, k = np.random.default_rng(1), len(self.languages)
        dim = dimensions(k)
        self.embed = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
        self.out, self.bias = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
        held = np.zeros(len(sample), bool)
        for x in range(k):  # every fifth row of each language; all of it is learned from if there are too few
            held[np.flatnonzero(target == x)[4::5]] = True
        buckets = [np.frombuffer(x, np.uint16).astype(np.int64) for x in sample["bucket"]]
        shares = [np.frombuffer(x, np.float32) for x in sample["share"]]
        train = np.flatnonzero(~held)
        steps, step = EPOCHS * len(train), 0
        for _ in range(EPOCHS):
            order = rng.permutation(train)
            for start in range(0, len(order), BATCH):
                rows = order[start : start + BATCH]
                rate = RATE * (1 - step / steps) + 0.01
                bucket, share = np.concatenate([buckets[i] for i in rows]), np.concatenate([shares[i] for i in rows])
                sizes = np.array([len(buckets[i]) for i in rows])
                row = np.repeat(np.arange(len(rows)), sizes)
                mean = np.add.reduceat(share[:, None] * self.embed[bucket], np.cumsum(sizes) - sizes)
                error = self._softmax(mean @ self.out + self.bias)
                error[np.arange(len(rows)), target[rows]] -= 1
                back = error @ self.out.T
                self.out -= rate * mean.T @ error
                self.bias -= rate * 0.1 * error.sum(axis=0)
                np.subtract.at(self.embed, bucket, (rate * 100 * share)[:, None] * back[row])
                step += len(rows)
        used = np.flatnonzero(held) if held.any() else train
        logits = np.array([shares[i] @ self.embed[buckets[i]] for i in used]).reshape(len(used), dim) @ self.out + self.bias
        losses = {t: -np.log(self._softmax(logits / t)[np.arange(len(used)), target[used]] + 1e-12).mean() for t in np.geomspace(0.3, 20, 40)}
        self.temperature = min(losses, key=losses.get)
        prob = self._softmax(logits / self.temperature)
        right = prob.argmax(axis=1) == target[used]
        self.threshold = float(np.quantile(prob.max(axis=1)[right], REJECT_RATE, method="lower")) * 0.9 if right.any() else 0.0

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Most likely language (-1: no letter) and its calibrated probability."""
        if is_long(texts):
            total, has = long_counts(texts[0])
            mean, has = (total @ self.embed / max(total.sum(), 1))[None, :], np.array([has])
        else:
            bucket, doc, has = grams(texts)
            n = len(texts)
            count = np.maximum(np.bincount(doc, minlength=n), 1)
            rows = self.embed[bucket]
            mean = np.stack([np.bincount(doc, weights=rows[:, k], minlength=n) for k in range(rows.shape[1])], axis=1) / count[:, None]
        prob = self._softmax((mean @ self.out + self.bias) / self.temperature)
        return np.where(has, prob.argmax(axis=1), -1), np.where(has, prob.max(axis=1), 0.0)


def train(docs: DataFrame) -> Model | None:
    sample = training_sample(docs)
    return Model(sample) if len(sample) else None


def _predictor(spark, model: Model | None):
    return spark.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each document."""
    model = model or train(docs)
    shared = _predictor(docs.sparkSession, model)

    def run(batches):
        model = shared.value
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            lang, score, rejected = np.full(len(pdf), UNKNOWN, object), np.zeros(len(pdf)), np.ones(len(pdf), bool)
            for start, some in chunks(texts) if model else ():
                best, prob = model.predict(some)
                part = slice(start, start + len(some))
                lang[part] = [model.languages[k] if k >= 0 else UNKNOWN for k in best]
                score[part], rejected[part] = prob, (best < 0) | (prob < model.threshold)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": lang, "score": score, "rejected": rejected})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (fold() == 2).alias("held_out"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is recognised."""
    model = model or train(docs)
    shared = _predictor(docs.sparkSession, model)

    @F.pandas_udf("boolean")
    def accepted(text: pd.Series) -> pd.Series:
        model, keep = shared.value, np.zeros(len(text), bool)
        texts = ["" if t is None else t for t in text]
        for start, some in chunks(texts) if model else ():
            best, prob = model.predict(some)
            keep[start : start + len(some)] = (best >= 0) & (prob >= model.threshold)
        return pd.Series(keep)

    return docs.where(accepted("text"))
