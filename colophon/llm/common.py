"""Helpers that several operators share: shared storage, hashing of words, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one vectorised step takes at once; a longer text is taken in parts.
CHUNK_CHARS = 1 << 18
#: Multiplier of the rolling word hash; odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (``spark.checkpoint.dir``); on one machine, where that is unset, a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colophon-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie, apart from those of others."""
    return f"{shared_dir(spark)}/colophon-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage with all it holds."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that still read them can't be used any more."""
    delete(spark, run_dir(spark))


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (null id: 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)), F.lit(0))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_tables: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, 2 * CHUNK_CHARS)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _tables["up"], _tables["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def word_table() -> np.ndarray:
    """For each code point: does it belong to a word (letter, digit, combining mark or underscore)?"""
    if "word" not in _tables:
        import unicodedata

        table = np.zeros(0x110000, bool)
        for i in range(0x110000):
            c = chr(i)
            table[i] = c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"
        _tables["word"] = table
    return _tables["word"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: list[str]):
    """(first index, texts) of runs of at most CHUNK_CHARS characters; a longer text comes alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


def is_long(texts: list[str]) -> bool:
    """Is this a single text that has to be taken in parts?"""
    return len(texts) == 1 and len(texts[0]) > CHUNK_CHARS


def word_parts(lowered: str):
    """A long text in order: (piece of whole words, False) of at most CHUNK_CHARS characters, (longer word, True)."""
    table, at = word_table(), 0
    while at < len(lowered):
        inside = table[code_points(lowered[at : at + CHUNK_CHARS])]
        if at + len(inside) >= len(lowered):
            yield lowered[at:], False
            return
        gaps = np.flatnonzero(~inside)
        if len(gaps):
            cut = max(int(gaps[-1]), 1)
            yield lowered[at : at + cut], False
            at += cut
            continue
        end = at + len(inside)
        while end < len(lowered):
            gaps = np.flatnonzero(~table[code_points(lowered[end : end + CHUNK_CHARS])])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + CHUNK_CHARS, len(lowered))
        yield lowered[at:end], True
        at = end


def word_sum(word: str) -> int:
    """The rolling hash of one word of any length, before mixing."""
    _, down = _powers(CHUNK_CHARS)
    total = 0
    for a in range(0, len(word), CHUNK_CHARS):
        codes = code_points(word[a : a + CHUNK_CHARS])
        part = int(((codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)]).sum(dtype=np.uint64))
        total += part * pow(_BASE, -a, 1 << 64)
    return total % (1 << 64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, in order, and offsets: text i has words offsets[i]:offsets[i+1]."""
    lowered = [t.lower() for t in texts]
    if is_long(lowered):
        parts = [mix(np.array([(word_sum(x) + len(x)) % (1 << 64)], np.uint64)) if whole else word_hashes([x])[0] for x, whole in word_parts(lowered[0])]
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    codes = code_points("\n".join(lowered) + "\n")
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in lowered], out=at[1:])
    inside = word_table()[codes]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, at)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the edges: (node, root), root being one node of the component, the same for all.

    Each round maps every node to the first of itself and its neighbours and contracts the edges; the maps are then
    composed backwards.  Nodes are ordered by a hash that changes every other round: whatever the numbering, a
    constant share of the nodes is expected to go (a chain halves, a star is gone in two rounds), so rounds grow with
    the logarithm of the largest component.  All steps are partial aggregates and equi-joins; nothing but a row
    count comes to the driver.  Nodes without edges are not returned.
    """
    left = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    maps = []
    while left.limit(1).count():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = [F.struct(F.xxhash64(n, F.lit(len(maps) // 2)).alias("at"), F.col(n).alias("root")) for n in ("node", "b")]
        step = both.withColumnRenamed("a", "node").groupBy("node").agg(F.min(rank[1]).alias("first"))
        step = materialize(step.select("node", F.least("first", rank[0])["root"].alias("root")), "roots")
        maps.append(step)
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        new = left.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        left = materialize(new.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out


def blocked(rows: DataFrame, bucket: list[str], member: str, block: int) -> DataFrame:
    """Deal the rows of each bucket with two or more rows to block pairs (bi <= bj), so that every two rows of a
    bucket meet in exactly one: inside a block where bi = bj, else across the two ``side``s.

    Groups hold 2 * ``block`` rows or so, however many rows a bucket has.
    """
    # written first: a join of two plain shuffles is one whose skewed partitions Spark splits
    sizes = materialize(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "sizes")
    dealt = rows.join(sizes, bucket).withColumn("__b", F.ceil(F.col("__n") / block).cast("int"))
    dealt = dealt.withColumn("__own", F.pmod(F.xxhash64(member), F.col("__b")).cast("int"))
    dealt = dealt.withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    return dealt.withColumns(
        {
            "bi": F.least("__own", "__with"),
            "bj": F.greatest("__own", "__with"),
            "side": F.when(F.col("__own") <= F.col("__with"), 0).otherwise(1),
        }
    ).drop("__n", "__b", "__own", "__with")


def map_groups(df: DataFrame, keys: list[str], work, schema: str, order: list[str] = ()) -> DataFrame:
    """``work(key, columns)`` over each group as numpy columns; yields lists of column arrays that fit ``schema``.

    Rows are hash-partitioned and sorted by the keys, so a task holds one group and one Arrow batch at a time;
    many small groups cost no pandas frame each.
    """
    import pandas as pd

    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for k in keys:
                col = pdf[k].to_numpy()
                same = col[1:] == col[:-1]
                if col.dtype.kind == "f":
                    same |= (col[1:] != col[1:]) & (col[:-1] != col[:-1])
                elif col.dtype == object:
                    same = np.array([x == y for x, y in zip(col[1:], col[:-1])], bool)
                new[1:] |= ~same
            cuts = [0, *np.flatnonzero(new).tolist()]
            yield from done(pdf.iloc[: cuts[-1]], cuts)
            rest = pdf.iloc[cuts[-1] :]
        if rest is not None:
            yield from done(rest, [0, len(rest)])

    def done(pdf, cuts):
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = {c: v[a:b] for c, v in cols.items()}
            out += list(work(tuple(part[k][0] for k in keys), part))
            if sum(len(x[0]) for x in out) > 50_000:
                yield pd.DataFrame({n: np.concatenate([x[i] for x in out]) for i, n in enumerate(names)})
                out = []
        if out:
            yield pd.DataFrame({n: np.concatenate([x[i] for x in out]) for i, n in enumerate(names)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def block_roots(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric boolean matrix, the smallest index of each row's component."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            member = np.zeros(n, bool)
            member[i] = True
            new = member
            while new.any():
                new = linked[new].any(axis=0) & ~member
                member = member | new
            root[member] = i
    return root
