"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and word beginnings of three to five letters, hashed to 2**BITS buckets.  Every bucket that
LEAST_DOCS rows of the sample have gets a weight and a vector of FACTORS numbers: the score is the logistic function of
bias, weights and all pairwise products of vectors, so that two terms together can say what neither says alone.  Terms
whose presence goes with the label (chi-square) and a few frequent ones are learned first, then all terms together, for
as many rounds as make the loss on one row in CHECKED smaller; where no round does, the others stay without effect.
It learns from about PER_CLASS rows of each label, weighted back to the labels' shares.

What comes to the driver is bounded: SAMPLE_ROWS rows at most, and of them (in the order of a hash of id and text) as
many as have SAMPLE_TERMS different terms in all, eight bytes each, half of it for each label.  Rows are left out by
that bound, never terms of a row.  They come part by part, are held once, as these bytes, and only the cells of
STEP_CELLS (or of one row) are ever unpacked at a time.

Defined results: null and empty texts are scored by the bias alone; without both labels to learn from every score is
the share of label 1 (0 if there are none); several labels of one document count as the largest.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _powers, chunks, code_points, fold, is_long, materialize, mix, word_parts, word_sum, word_table

BITS, FACTORS = 20, 8
PREFIXES = (3, 4, 5)
#: Bound of the training sample: rows of each label (on average over hashes), and rows of it in all.
PER_CLASS, SAMPLE_ROWS = 4_000, 10_000
#: Bound of the sample's different terms, summed over its rows: eight bytes each come to the driver.
SAMPLE_TERMS = 8_000_000
LEAST_DOCS = 3
#: Parts in which the sample comes to the driver, one at a time; cells (a term of a row) that are unpacked at once.
SAMPLE_PARTS, STEP_CELLS = 16, 1 << 18
#: Terms that may pass the chi-square test by chance, however many are tested; and the weakest level of the test.
CHANCE_TERMS, WEAKEST = 20, 0.01
#: Frequent terms that are learned with those from the start, as they tell long texts from short ones.
FIRST_OTHERS = 128
#: One row in CHECKED judges how long all terms are learned; learning ends after PATIENCE rounds that don't help.
CHECKED, PATIENCE = 5, 4
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.02, 1e-4
THRESHOLD = 0.3


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all terms and the number of the text of each."""
    lowered = [t.lower() for t in texts]
    codes = code_points("\n".join(lowered) + "\n")
    ends_of = np.cumsum([len(t) + 1 for t in lowered])
    edge = np.diff(word_table()[codes].astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)], out=sums[1:])
    doc = np.searchsorted(ends_of, starts, side="right")
    out, docs = [mix((sums[ends] - sums[starts]) * up[starts])], [doc]
    for size in PREFIXES:
        long = ends - starts >= size
        a = starts[long]
        out.append(mix((sums[a + size] - sums[a]) * up[a] + np.uint64(size)))
        docs.append(doc[long])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, bucket and count of each different term of each text, in order."""
    if not is_long(texts):
        bucket, doc = terms(texts)
        key, count = np.unique((doc << BITS) + bucket, return_counts=True)
        return key >> BITS, key & ((1 << BITS) - 1), count
    total = np.zeros(1 << BITS, np.int64)
    for part, whole in word_parts(texts[0].lower()):
        if whole:  # a word longer than a part: itself and its beginnings
            sums = [word_sum(part), *[word_sum(part[:size]) + size for size in PREFIXES]]
            bucket = (mix(np.array([x % (1 << 64) for x in sums], np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
        else:
            bucket = terms([part])[0]
        total += np.bincount(bucket, minlength=1 << BITS)
    found = np.flatnonzero(total)
    return np.zeros(len(found), np.int64), found, total[found]


def _sampled_terms(batches):
    """doc_id, label, bucket and count (arrays) of each text."""
    for pdf in batches:
        for start, some in chunks(pdf["text"].tolist()):
            doc, bucket, count = term_counts(some)
            cuts = np.searchsorted(doc, np.arange(len(some) + 1))
            part = pdf.iloc[start : start + len(some)]
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype(str), "hash": part["hash"], "label": part["label"], "bucket": [bucket[a:b].astype(np.int32) for a, b in spans], "count": [count[a:b].astype(np.int32) for a, b in spans]})


def chosen_terms(sample: DataFrame) -> np.ndarray:
    """Buckets seen in LEAST_DOCS rows or more, 2**BITS numbers at most: all of them get a weight and factors."""
    seen = sample.select(F.explode("bucket").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("seen"))
    found = seen.where(F.col("seen") >= LEAST_DOCS).select("bucket").mapInPandas(_packed_buckets, "buckets binary").collect()
    return np.sort(np.frombuffer(b"".join(r["buckets"] for r in found), np.int32))


def _packed_buckets(batches):
    for pdf in batches:
        yield pd.DataFrame({"buckets": [pdf["bucket"].to_numpy(np.int32).tobytes()]})


def within_bound(sizes: DataFrame) -> DataFrame:
    """Label, hash and id of the rows in the order of their hashes, by label, as long as their terms are within SAMPLE_TERMS / 2 a label (one row at least)."""
    order = Window.partitionBy("label").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = sizes.withColumn("before", F.coalesce(F.sum("terms").over(order), F.lit(0))).where(F.col("before") + F.col("terms") <= SAMPLE_TERMS // 2)
    first = sizes.groupBy("label").agg(F.min(F.struct("hash", "doc_id")).alias("f")).select("label", "f.hash", "f.doc_id")
    return kept.select("label", "hash", "doc_id").union(first).distinct()


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[pd.DataFrame, np.ndarray, dict[int, int]]:
    """Chosen terms (slots and counts) of a bounded sample, the buckets of the slots, and labelled rows by label.

    Rows with fold 2 are left out.  SAMPLE_ROWS bounds rows, however often an id repeats.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 2))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).where("label IN (0, 1)")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("label") == 1, PER_CLASS / max(shares.get(1, 0), 1)).otherwise(PER_CLASS / max(shares.get(0, 0), 1))
    hashed = F.xxhash64("doc_id", F.lit(3))
    chosen = known.where(F.pmod(hashed, F.lit(1 << 20)) < rate * (1 << 20)).orderBy(hashed).limit(SAMPLE_ROWS)
    chosen = materialize(chosen, "labels")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # ids may repeat: rows are thinned after the join too, and those that repeat id and text count once
    having = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("label") == 1, PER_CLASS / max(having.get(1, 0), 1)).otherwise(PER_CLASS / max(having.get(0, 0), 1))
    rows = texts.withColumn("hash", F.xxhash64("doc_id", "text", F.lit(4))).where(F.pmod("hash", F.lit(1 << 20)) < 2 * rate * (1 << 20))
    found = rows.mapInPandas(_sampled_terms, "doc_id string, hash long, label int, bucket array<int>, count array<int>")
    # rows are chosen by the numbers of their terms, then read again: terms beyond the bound are never shuffled or sorted
    sizes = found.select("doc_id", "hash", "label", F.size("bucket").alias("terms")).dropDuplicates(["doc_id", "hash"])
    sizes = materialize(sizes.orderBy("hash", "doc_id").limit(SAMPLE_ROWS), "sizes")
    kept = found.join(F.broadcast(within_bound(sizes)), ["label", "hash", "doc_id"], "left_semi")
    sample = materialize(kept.dropDuplicates(["doc_id", "hash"]), "terms")
    buckets = chosen_terms(sample)
    slot = np.full(1 << BITS, -1, np.int32)
    slot[buckets] = np.arange(len(buckets))

    def pack(batches):
        for pdf in batches:
            at = [slot[b] for b in pdf["bucket"]]
            keep = [a >= 0 for a in at]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "slot": [a[k].astype(np.int32).tobytes() for a, k in zip(at, keep)], "count": [c[k].astype(np.int32).tobytes() for c, k in zip(pdf["count"], keep)]})

    packed = sample.repartition(SAMPLE_PARTS, "hash").mapInPandas(pack, "doc_id string, label int, slot binary, count binary")
    # one part after another: the driver's JVM never holds the whole sample beside Python's
    rows = [(r["doc_id"], r["label"], bytes(r["slot"]), bytes(r["count"])) for r in packed.toLocalIterator()]
    found = pd.DataFrame(rows, columns=["doc_id", "label", "slot", "count"])
    return found.sort_values(["doc_id", "label", "slot"]).reset_index(drop=True), buckets, shares


class Cells:
    """The sample's terms and counts, row by row, as packed numbers that are read a few rows at a time."""

    def __init__(self, slots: list[bytes], counts: list[bytes], y: np.ndarray):
        self.slots, self.counts, self.y = slots, counts, y
        self.sizes = np.array([len(s) // 4 for s in slots], np.int64)

    def of(self, chosen: np.ndarray) -> "Cells":
        """Only the cells of chosen terms."""
        slots, counts = [], []
        for s, c in zip(self.slots, self.counts):
            term = np.frombuffer(s, np.int32)
            keep = chosen[term]
            slots.append(term[keep].tobytes())
            counts.append(np.frombuffer(c, np.int32)[keep].tobytes())
        return Cells(slots, counts, self.y)

    def runs(self, rows: np.ndarray) -> list[np.ndarray]:
        """The rows in order, cut so that a run has at most STEP_CELLS cells, or is one row."""
        cuts, size = [], 0
        for i, n in enumerate(self.sizes[rows].tolist()):
            if size and size + n > STEP_CELLS:
                cuts.append(i)
                size = 0
            size += n
        return np.split(rows, cuts)

    def terms(self, rows: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join([self.slots[i] for i in rows]), np.int32)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, values and positions in ``rows`` of the cells of these rows."""
        value = 1 + np.log(np.frombuffer(b"".join([self.counts[i] for i in rows]), np.int32))
        return self.terms(rows), value, np.repeat(np.arange(len(rows)), self.sizes[rows])

    def first(self, n: int) -> np.ndarray:
        """Which of the n terms are learned first: those that go with the label by themselves (chi-square), and some frequent ones."""
        mean, seen, toxic = self.y.mean(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for total, rows in ((seen, np.arange(len(self.y))), (toxic, np.flatnonzero(self.y == 1))):
            for some in self.runs(rows):
                total += np.bincount(self.terms(some), minlength=n)
        expected = seen * mean
        chi = (toxic - expected) ** 2 / np.maximum(expected * (1 - mean), 1e-9)
        level = min(WEAKEST, CHANCE_TERMS / max(n, 1))
        told = chi >= NormalDist().inv_cdf(1 - level / 2) ** 2
        # terms of nearly all texts say nothing, in pairs neither
        others = np.flatnonzero(~told & (seen >= len(self.y) / 100) & (seen <= len(self.y) * 0.6))
        told[others[np.argsort(-seen[others], kind="stable")][:FIRST_OTHERS]] = True
        return told


class Fit:
    """Bias, weights and factors of n terms while they are learned by AdaGrad."""

    def __init__(self, prior: float, n: int):
        self.rng = np.random.default_rng(3)
        self.w0, self.w, self.v = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), np.zeros(n), self.rng.normal(0, 0.02, (n, FACTORS))
        self.g0, self.gw, self.gv = 1e-8, np.full(n, 1e-8), np.full((n, FACTORS), 1e-8)
        self.place = np.zeros(n, np.int32)

    def open(self, terms: np.ndarray) -> None:
        """Begin to learn these terms, with factors too small to disturb what is learned."""
        np.multiply(self.v, 0.1, out=self.v, where=terms[:, None])

    def run(self, cells: Cells, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int) -> None:
        batches = np.array_split(self.rng.permutation(rows), -(-len(rows) // BATCH))
        for _ in range(epochs):
            for b in self.rng.permutation(len(batches)):
                self.step(cells, batches[b], y, weight)

    def step(self, cells: Cells, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        runs, seen = cells.runs(rows), np.zeros(len(self.w), bool)
        for some in runs:
            seen[cells.terms(some)] = True
        mine = np.flatnonzero(seen)  # only terms of these rows change
        self.place[mine] = np.arange(len(mine))
        d0, dw, dv = 0.0, np.zeros(len(mine)), np.zeros((FACTORS, len(mine)))
        for some in runs:
            term, x, r = cells.take(some)
            z, s = _sums(self.w0, self.w, self.v, term, x, r, len(some))
            e = (_logistic(z) - y[some]) * weight[some] / len(rows)
            ex, t = e[r] * x, self.place[term]
            d0 += e.sum()
            dw += np.bincount(t, weights=ex, minlength=len(mine))
            for f in range(FACTORS):
                dv[f] += np.bincount(t, weights=ex * (s[r, f] - self.v[term, f] * x), minlength=len(mine))
        dw += DECAY * self.w[mine]
        self.g0 += d0**2
        self.gw[mine] += dw**2
        self.w0 -= RATE * 5 * d0 / np.sqrt(self.g0)
        self.w[mine] -= RATE * 5 * dw / np.sqrt(self.gw[mine])
        for f in range(FACTORS):
            d = dv[f] + DECAY * self.v[mine, f]
            self.gv[mine, f] += d**2
            self.v[mine, f] -= RATE * d / np.sqrt(self.gv[mine, f])

    def loss(self, cells: Cells, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """Weighted log loss of the rows."""
        total = 0.0
        for batch in np.array_split(rows, -(-len(rows) // BATCH)):
            for some in cells.runs(batch):
                term, x, r = cells.take(some)
                p = np.clip(_logistic(_sums(self.w0, self.w, self.v, term, x, r, len(some))[0]), 1e-9, 1 - 1e-9)
                total -= float((weight[some] * np.where(y[some] == 1, np.log(p), np.log(1 - p))).sum())
        return total


class Machine:
    """Second-order factorization machine on the chosen buckets."""

    def __init__(self, sample: pd.DataFrame, buckets: np.ndarray, shares: dict[int, int]):
        total = max(sum(shares.values()), 1)
        self.prior = shares.get(1, 0) / total
        self.slot = np.full(1 << BITS, -1, np.int32)
        y = sample["label"].to_numpy(float)
        self.trained = len(y) > 0 and 0 < y.sum() < len(y)
        self.bias, self.w, self.v = 0.0, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32)
        if not self.trained:
            return
        self.slot[buckets] = np.arange(len(buckets))
        cells = Cells(sample["slot"].tolist(), sample["count"].tolist(), y)
        # rows stand for as many labelled rows as the sampling rate says
        weight = np.where(y == 1, shares[1] / y.sum(), shares[0] / (len(y) - y.sum()))
        weight = weight / weight.mean()
        first = cells.first(len(buckets))
        some = cells.of(first)
        parts = np.random.default_rng(3).permutation(len(y)) % CHECKED
        learn, check = np.flatnonzero(parts != 0), np.flatnonzero(parts == 0)
        trial = Fit(self.prior, len(buckets))
        trial.run(some, learn, y, weight, EPOCHS)
        epochs, least = 0, trial.loss(some, check, y, weight)
        trial.open(~first)
        for done in range(1, EPOCHS + 1):
            trial.run(cells, learn, y, weight, 1)
            if (loss := trial.loss(cells, check, y, weight)) < least:
                epochs, least = done, loss
            elif done - epochs >= PATIENCE:
                break
        del trial
        fit = Fit(self.prior, len(buckets))
        fit.run(some, np.arange(len(y)), y, weight, EPOCHS)
        if epochs:
            fit.open(~first)
            fit.run(cells, np.arange(len(y)), y, weight, epochs)
        self.epochs, self.bias, self.w, self.v = epochs, float(fit.w0), fit.w, fit.v

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.prior)
        doc, bucket, count = term_counts(texts)
        slot = self.slot[bucket]
        keep = slot >= 0
        doc, term, count = doc[keep], slot[keep], count[keep]
        z, _ = _sums(self.bias, self.w, self.v, term, 1 + np.log(count), doc, len(texts))
        return _logistic(z)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(w0, w, v, term, x, row, n):
    """Raw scores of n rows and their factor sums; the products are formed for STEP_CELLS cells at a time."""
    linear, squares, s = np.zeros(n), np.zeros(n), np.zeros((n, FACTORS))
    for a in range(0, len(term), STEP_CELLS):
        t, part, r = term[a : a + STEP_CELLS], x[a : a + STEP_CELLS], row[a : a + STEP_CELLS]
        vx = v[t] * part[:, None]
        for f in range(FACTORS):
            s[:, f] += np.bincount(r, weights=vx[:, f], minlength=n)
        squares += np.bincount(r, weights=(vx**2).sum(axis=1), minlength=n)
        linear += np.bincount(r, weights=w[t] * part, minlength=n)
    return w0 + linear + 0.5 * ((s**2).sum(axis=1) - squares), s


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    return Machine(*training_sample(docs, labels))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        for pdf in batches:
            texts, score = ["" if t is None else t for t in pdf["text"]], np.zeros(len(pdf))
            for start, some in chunks(texts):
                score[start : start + len(some)] = shared.value.score(some)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (fold() == 2).alias("held_out"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
