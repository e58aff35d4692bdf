"""Near-duplicate documents by Order MinHash.

A document's k-mers are its runs of five words (lower case), labelled with their occurrence number.  For each of
BANDS hash functions the PICKS smallest labelled k-mers are sampled and put back into text order; documents whose
samples agree in content and order share a bucket.  Candidates are verified by a banded alignment of the labelled
k-mers: with L aligned k-mers out of n and m, the similarity is L / (n + m - L), which is at most their Jaccard
similarity and equals it where shared k-mers keep their order.  Documents are linked from 0.8 on, and a class is a
component of the links.

Documents with equal words are folded first.  Buckets with equal members are compared once, by hashed k-mers; texts
don't travel.  A bucket with more than BLOCK members or BLOCK_KMERS k-mers is dealt to blocks, each with a few leaders
of the bucket; what is still apart after that is compared again across blocks, members of the bucket's largest class
only with members of other classes.  So no pair of different texts is left out, none is emitted, and no task holds
more than about two blocks, whose size is bounded in k-mers (a longer document is a block of its own).

Defined results: a text without words (null, empty, marks only) is a class of its own; a text of one to four words
has one k-mer; the class is named by its smallest doc_id (null last), which is the row that stays; rows equal in id
and text stay or go together; other columns play no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, map_groups, materialize, mix, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: (1 - SIMILARITY) / (1 + SIMILARITY) as a whole fraction: a quotient of floats falls below it at exact ties.
APART, OF = ((1 - Fraction(str(SIMILARITY))) / (1 + Fraction(str(SIMILARITY)))).as_integer_ratio()
#: k-mers sampled by a hash function, and hash functions: a pair at 0.8 is missed once in 40,000 times.
PICKS, BANDS = 4, 20
#: Documents of at most SHORT k-mers are sampled FEW at a time (a pair of five and four k-mers would rarely agree in
#: four), those of at least LONG k-mers PICKS at a time: a similar pair has one of the two in common.
FEW, LONG, SHORT = 2, 16, 20
BLOCK, BLOCK_KMERS = 256, 1 << 20
LEADERS = 16

_rng = np.random.default_rng(20)
_PLACE = _rng.integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 62, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEQ = _rng.integers(0, 1 << 62, PICKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OCC = np.uint64(0x9E3779B97F4A7C15)


def labelled_kmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled k-mers of all texts in order and their offsets; word hashes and their offsets."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(texts)), count)
    first = at[doc] + np.arange(off[-1]) - off[doc]
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    kmer = np.zeros(off[-1], np.uint64)
    for k in range(WORDS):
        inside = first + k < at[doc + 1] if len(doc) else first
        kmer += np.where(inside, padded[first + k] + np.uint64(1), np.uint64(0)) * _PLACE[k]
    del first, padded
    kmer = mix(kmer)
    own = mix(kmer + doc.astype(np.uint64) * _OCC) if len(texts) > 1 else kmer
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    del own, doc
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    del ranked
    position = np.arange(len(new))
    position -= np.maximum.accumulate(np.where(new, position, 0))
    occurrence = np.zeros(len(new), np.uint64)
    occurrence[order] = position.astype(np.uint64)
    return mix(kmer + occurrence * _OCC), off, words, at


def order_sketch(labels: np.ndarray) -> np.ndarray:
    """Bucket keys of one document: BANDS for each number of picks that its length asks for."""
    n = len(labels)
    sets = [_keys(labels, PICKS)] if n >= LONG else []
    return np.concatenate([*sets, _keys(labels, FEW)] if n <= SHORT else sets)


def _keys(labels: np.ndarray, picks: int) -> np.ndarray:
    n = len(labels)
    out, step = np.full(BANDS, picks, np.uint64) + np.arange(BANDS, dtype=np.uint64) * _OCC, max(1, (1 << 21) // max(n, 1))
    for b in range(0, BANDS, step):
        some = slice(b, min(b + step, BANDS))
        if n > picks:
            values = (labels[None, :] ^ _XOR[some, None]) * _TIMES[some, None]
            chosen = np.sort(np.argpartition(values, picks - 1, axis=1)[:, :picks], axis=1)
            out[some] += (labels[chosen] * _SEQ[:picks]).sum(axis=1, dtype=np.uint64)
        else:
            out[some] += (labels * _SEQ[:n]).sum(dtype=np.uint64)
    return mix(out)


def _node(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _row(which: int) -> Column:
    """One of two hashes of id and text, which together name a row."""
    return F.xxhash64("doc_id", "text", *[F.lit(which)] * which)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row and row2 (hashes of id and text), node (digest of the words; null: none), size (k-mers), bands (bucket keys)."""

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for start, some in chunks(texts):
                labels, off, words, at = labelled_kmers(some)
                nodes = [_node(words[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:])]
                keys = [order_sketch(labels[a:b]).view(np.int64) if b > a else None for a, b in zip(off[:-1], off[1:])]
                part = pdf.iloc[start : start + len(some)]
                yield pd.DataFrame({"doc_id": part["doc_id"], "row": part["row"], "row2": part["row2"], "node": nodes, "size": np.diff(off), "bands": keys})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _row(0).alias("row"), _row(1).alias("row2"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(rows.mapInPandas(run, f"doc_id {kind}, row long, row2 long, node binary, size long, bands array<long>"), "sketches")


def _labels(batches):
    """node, text -> node, labels: what alignments work on."""
    for pdf in batches:
        for start, some in chunks(pdf["text"].tolist()):
            labels, off, _, _ = labelled_kmers(some)
            own = labels.view(np.int64)
            yield pd.DataFrame({"node": pdf["node"].iloc[start : start + len(some)], "labels": [own[a:b] for a, b in zip(off[:-1], off[1:])]})


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Labelled k-mers that a banded alignment of two documents pairs up, in order, at the most.

    Labels are unique within a document, so the alignment is a longest increasing run of matched positions.  For a
    similarity of 0.8 at most (n + m) / 9 k-mers stay alone, so no match lies further off the diagonal than that.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) * OF <= (len(a) + len(b)) * APART
    i, j = i[near], j[near]
    tails: list[int] = []
    for x in j[np.argsort(i)].tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails)


def _shared_counts(labels: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Matrix of the numbers of labels that documents have in common."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    values, inverse, counts = np.unique(labels, return_inverse=True, return_counts=True)
    common = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    doc, col = doc[keep], common[inverse[keep]]
    out, width = np.zeros((n, n), np.float32), max(1, (1 << 22) // n)
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    for start in range(0, int(common[-1]) + 1 if len(common) else 0, width):
        a, b = np.searchsorted(col, [start, start + width])
        has = np.zeros((n, width), np.float32)
        has[doc[a:b], col[a:b] - start] = 1
        out += has @ has.T
    return out


def linked_pairs(documents: list[np.ndarray], group: np.ndarray, open_pairs: np.ndarray | None = None):
    """Verified pairs that connect documents (their labels) which ``group`` has apart; groups are merged on the way."""
    labels, size = np.concatenate(documents), np.array([len(x) for x in documents])
    off = np.concatenate([[0], np.cumsum(size)])
    shared = _shared_counts(labels, off)
    may = shared >= SIMILARITY * (size[:, None] + size[None, :] - shared) - 1e-3
    may &= group[:, None] != group[None, :]
    if open_pairs is not None:
        may &= open_pairs | open_pairs.T
    parent = {g: g for g in group.tolist()}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    group = group.tolist()
    for i, j in np.argwhere(np.triu(may, 1)).tolist():
        x, y = find(group[i]), find(group[j])
        if x != y:
            both = aligned(labels[off[i] : off[i + 1]], labels[off[j] : off[j + 1]])
            if both >= SIMILARITY * (size[i] + size[j] - both):
                parent[x] = y
                yield i, j


def _edges(key, c):
    """Links inside one block of a bucket; ``side`` 0 and 1 are compared across, 2 with all."""
    numbers: dict[bytes, int] = {}
    group = np.array([numbers.setdefault(bytes(x), len(numbers)) for x in c["root"]])
    side = c["side"]
    across = None if (side == 2).all() else (side == 0)[:, None] & (side == 1)[None, :]
    pairs = list(linked_pairs(list(c["labels"]), group, across))
    if pairs:
        i, j = np.array(pairs).T
        yield [c["node"][i], c["node"][j]]


EDGES = "a binary, b binary"


def live_buckets(reps: DataFrame) -> DataFrame:
    """(key, n, kmers, node): members of buckets with two nodes or more; of buckets with equal members just one."""
    members = reps.select("node", "size", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("kmers"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    once = sizes.groupBy("n", "kmers", "x", "y").agg(F.min("key").alias("key"))
    return materialize(members.select("node", "key").join(once.drop("x", "y"), "key"), "buckets")


def _blocks(n, kmers):
    """Blocks that so many members with so many k-mers take."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(kmers / BLOCK_KMERS)).cast("int")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) edges between nodes that span all classes."""
    reps = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("row", "row2")).alias("m"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = materialize(reps.select("node", "m.row", "m.row2", "size", "bands"), "nodes")
    buckets = live_buckets(reps)
    need = reps.select("node", "row", "row2").join(buckets.select("node").distinct(), "node")
    # one text a row, folded before the shuffle: rows that repeat id and text must not come back once per copy
    texts = docs.select(_row(0).alias("row"), _row(1).alias("row2"), "text").where("text IS NOT NULL").groupBy("row", "row2").agg(F.first("text").alias("text"))
    texts = texts.join(need, ["row", "row2"]).select("node", "text")
    texts = materialize(texts.mapInPandas(_labels, "node binary, labels array<long>"), "texts")

    blocks = _blocks(F.col("n"), F.col("kmers"))
    own = F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int")
    # fewer leaders where documents are long: they come to every block
    most = F.least(F.lit(LEADERS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_KMERS // 4) * F.col("n") / F.col("kmers"))))
    leads = F.pmod(F.xxhash64("node", F.lit(3)), F.col("n")) < most
    first = buckets.withColumn("block", F.explode(F.when(leads, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))))
    first = first.join(texts, "node").select("key", "block", "node", "labels", F.col("node").alias("root"), F.lit(2).alias("side"))
    found = materialize(map_groups(first, ["key", "block"], _edges, EDGES).distinct(), "links")

    wide = materialize(buckets.where(blocks > 1), "wide")
    if not wide.limit(1).count():
        return found
    roots = components(found).select("node", "root")
    wide = materialize(wide.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "apart")
    parts = wide.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = parts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all")).where("m.c < all")
    wide = wide.join(largest.select("key", F.col("m.root").alias("main"), (F.col("all") - F.col("m.c")).alias("rest")), "key")
    others = _blocks(F.col("rest"), F.col("rest") * F.col("kmers") / F.col("n"))
    query = wide.where("root <> main").withColumn("i", F.pmod(F.xxhash64("node", F.lit(4)), others).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("side", F.lit(0))
    stock = wide.withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0), others - 1))).withColumn("side", F.lit(1))
    cols = ["key", "i", "j", "node", "root", "side"]
    again = query.select(cols).unionByName(stock.select(cols)).join(texts, "node")
    more = materialize(map_groups(again, ["key", "i", "j"], _edges, EDGES).distinct(), "links")
    return found.unionByName(more)


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept, row and row2 (hashes of id and text) for every document."""
    docs = docs.select("doc_id", "text")
    rows = sketches(docs)
    roots = components(links(docs, rows))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "row2")
    per_node = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    per_node = materialize(per_node.join(roots, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root")), "classes")
    classes = per_node.groupBy("root").agg(F.min("first").alias("m"), F.sum("n").alias("class_size"))
    named = per_node.select("node", "root").join(classes, "root").select("node", "m", "class_size")
    grouped = rows.where("node IS NOT NULL").select("doc_id", "row", "row2", "node").join(named, "node")
    stays = (F.col("row") == F.col("m.row")) & (F.col("row2") == F.col("m.row2"))
    grouped = grouped.select("doc_id", F.col("m.doc_id").alias("class_id"), "class_size", stays.alias("kept"), "row", "row2")
    alone = rows.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "row", "row2")
    return grouped.unionByName(alone)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that stay: one of each class."""
    gone = near_dedup(docs).where("NOT kept").select("row", "row2").distinct()
    rows = docs.select(F.struct("*").alias("doc"), _row(0).alias("row"), _row(1).alias("row2"))
    return rows.join(gone, ["row", "row2"], "left_anti").select("doc.*")
