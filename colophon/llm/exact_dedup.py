"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each source partition sorts the 64-bit fingerprints of its texts, cuts them by owner (a range of the fingerprint
space), Golomb-codes the gaps and sends one message per owner.  An owner decodes its messages, finds fingerprints
that occur more than once anywhere and answers each message with a bitmap.  Source partitions then read only their
own answers, and only texts marked in them are shuffled, where equal bytes are grouped as such.

Defined results: a null text counts as empty, empty texts equal each other, a null doc_id ranks below all others.
Rows that repeat both id and text share ``kept``; ``drop_copies`` leaves one of them.  Other columns play no part,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path

#: Source partitions whose answers share a folder (one file each), so that files grow with the partitions and not
#: with partitions times owners; a task reads that many partitions' answers to find its own.
SOURCES_PER_FOLDER = 16
#: Rows whose fingerprints one owner holds at most, on average: eight bytes each, a few times over.
ROWS_PER_OWNER = 2_000_000
#: Source partitions whose copies of a text are folded together before all of them are.
PARTS_PER_FOLD = 16

MESSAGE = "src long, owner int, n int, shift int, unary binary, rest binary, dup binary"


def golomb_encode(values: np.ndarray, low: int) -> tuple[int, bytes, bytes]:
    """Sorted uint64 values as gaps: the quotient by 2**shift in unary, the remainder in ``shift`` bits."""
    gaps = np.diff(values, prepend=np.uint64(low))
    shift = max(0, int(np.log2(max(1.0, 0.69 * float(gaps.astype(np.float64).mean())))))
    ends = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1) - 1
    unary = np.zeros(ends[-1] + 1, np.uint8)
    unary[ends] = 1
    bits = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - shift :]
    return shift, np.packbits(unary).tobytes(), np.packbits(bits).tobytes()


def golomb_decode(n: int, shift: int, unary: bytes, rest: bytes, low: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(shift)
    if shift:
        bits = np.zeros((n, 64), np.uint8)
        bits[:, 64 - shift :] = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * shift].reshape(n, shift)
        gaps |= np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _low(owner: int, owners: int) -> int:
    return -(-(owner << 64) // owners)


def _owners_of(sorted_fp: np.ndarray, owners: int) -> np.ndarray:
    """Cut points of the sorted fingerprints by owner."""
    lows = np.array([_low(o, owners) for o in range(owners)], np.uint64)
    return np.append(np.searchsorted(sorted_fp, lows), len(sorted_fp))


def _messages(owners: int):
    def run(batches):
        parts = [pdf["fp"].to_numpy() for pdf in batches]
        if not sum(map(len, parts)):
            return
        fps, counts = np.unique(np.concatenate(parts).view(np.uint64), return_counts=True)
        cuts, src, rows = _owners_of(fps, owners), TaskContext.get().partitionId(), []
        for o in range(owners):
            a, b = cuts[o], cuts[o + 1]
            if a < b:
                shift, unary, rest = golomb_encode(fps[a:b], _low(o, owners))
                rows.append((src, o, b - a, shift, unary, rest, np.packbits(counts[a:b] > 1).tobytes()))
        yield pd.DataFrame(rows, columns=["src", "owner", "n", "shift", "unary", "rest", "dup"])

    return run


def _answers(owners: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low = _low(int(key[0]), owners)
        lists = [golomb_decode(r.n, r.shift, r.unary, r.rest, low) for r in pdf.itertuples()]
        fps, counts = np.unique(np.concatenate(lists), return_counts=True)
        dup = []
        for fp, r in zip(lists, pdf.itertuples()):
            own = np.unpackbits(np.frombuffer(r.dup, np.uint8))[: r.n].astype(bool)
            dup.append(np.packbits(own | (counts[np.searchsorted(fps, fp)] > 1)).tobytes())
        return pdf.assign(dup=dup)

    return run


def _read_answers(path: str, src: int, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints this partition sent, and which of them occur elsewhere too."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    where = f"{root}/folder={src // SOURCES_PER_FOLDER}"
    if store.get_file_info(where).type != fs.FileType.Directory:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    rows = ds.dataset(where, filesystem=store, format="parquet").to_table(filter=ds.field("src") == src).sort_by("owner").to_pylist()
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    fps = [golomb_decode(r["n"], r["shift"], r["unary"], r["rest"], _low(r["owner"], owners)) for r in rows]
    dup = [np.unpackbits(np.frombuffer(r["dup"], np.uint8))[: r["n"]].astype(bool) for r in rows]
    return np.concatenate(fps), np.concatenate(dup)


def owners_for(docs: DataFrame) -> int:
    """Owners grow with the rows, so that an owner's part stays the same size."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_PER_OWNER))


def mark_suspects(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """(doc_id, text, fp, suspect): suspect is true for every text whose fingerprint occurs more than once.

    A fingerprint that is missing from the partition's own answers (a recomputed input was cut differently) counts
    as suspect, so a copy is never missed.
    """
    spark = docs.sparkSession
    owners = owners or owners_for(docs)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))
    sent = base.select("fp").mapInPandas(_messages(owners), MESSAGE)
    path = new_path(spark, "bitmaps")
    answers = sent.repartition(owners, "owner").groupBy("owner").applyInPandas(_answers(owners), MESSAGE)
    answers = answers.withColumn("folder", F.floor(F.col("src") / SOURCES_PER_FOLDER))
    answers.repartition(owners, "folder").sortWithinPartitions("folder", "src").write.partitionBy("folder").parquet(path)

    def suspect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fps = None
        for fp in batches:
            if fps is None:
                fps, dup = _read_answers(path, TaskContext.get().partitionId(), owners)
            own = fp.to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(fps, own), max(len(fps) - 1, 0))
            yield pd.Series(dup[at] | (fps[at] != own) if len(fps) else np.ones(len(own), bool))

    return base.withColumn("suspect", F.pandas_udf(suspect, "boolean")("fp"))


def exact_dedup(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    marked = mark_suspects(docs, owners).select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        "suspect",
        F.when(F.col("suspect"), F.col("text")).alias("text"),
        F.floor(F.spark_partition_id() / PARTS_PER_FOLD).alias("part"),
    )
    marked = materialize(marked, "marked")
    rows = marked.select("doc_id", "text_sha256", "suspect")
    # a text that very many rows share is folded in two steps: by its bytes in a few partitions, then over all
    in_parts = marked.where("suspect").groupBy("text_sha256", "text", "part").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    in_parts = materialize(in_parts, "folded")
    groups = in_parts.groupBy("text_sha256", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).drop("text")
    alone = rows.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    shared = rows.where("suspect").join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(shared)


def drop_copies(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that stay: of equal texts one, with the largest doc_id."""
    found = materialize(exact_dedup(docs, owners), "exact")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own"), digest.alias("sha"))
    which = [F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")]
    same = (F.col("sha") == F.col("digest")) & F.col("own").eqNullSafe(F.col("id"))
    left = rows.join(found.where("NOT kept").select(*which).distinct(), same, "left_anti")
    again = found.where("kept AND group_size > 1").groupBy(*which).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = materialize(again, "repeated")
    if not again.limit(1).count():
        return left.select("doc.*")
    once = left.join(again, same, "left_semi").dropDuplicates(["own", "sha"])
    return left.join(again, same, "left_anti").unionByName(once).select("doc.*")
