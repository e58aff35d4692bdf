"""Importance resampling towards a target distribution, over hashed n-grams.

Separators are collapsed to single spaces, and one overlapped regex scan (a boundary, a word, up to two more, a look
ahead for the boundary) emits at each word the spans of one, two and three words that start there; their CRC-32,
carried on from span to span, gives the bucket.  A document's importance is the sum over its features of a bucket's
gain, the log ratio of the target's and the corpus' smoothed shares.  Gumbel noise from a hash of the id turns the
largest scores into a sample without replacement.

Texts are scanned once: a document's buckets are kept sorted as gaps of one byte each (255 goes on), from which corpus
counts and weights are then read.  Only the gains (BUCKETS numbers) come to the driver.  Ranks come from a range sort:
each partition's rows are numbered in place, and sums of partition sizes give the rank of its first row.

Defined results: a null text has no features, weight 0 and is never drawn; a null id is hashed as an empty one and
comes last among ties, which then go by weight and number of features.  Rows equal in all these are interchangeable.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice
from operator import methodcaller

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path

BUCKETS = 10_000
#: Share of the documents that is drawn, in per cent, and the least number of words of one that may be.
PERCENT, LEAST_WORDS = 5, 20
SEED = "42"
#: Words whose spans are in memory at once.
WORDS_AT_ONCE = 1 << 16

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The space before a word is its boundary; the second and third word are empty where the text ends.
_SPANS = regex.compile(rb" ([^ ]++)( ?+[^ ]*+)( ?+[^ ]*+)(?![^ ])")
_groups = methodcaller("groups")


def feature_buckets(text: str) -> np.ndarray:
    """Buckets of all runs of one to three words of a text, in no particular order, repeats included."""
    collapsed = b" " + _SEPARATORS.sub(b" ", text.encode("utf-8", "surrogatepass").translate(_LOWER)).strip(b" ")
    matches, out = _SPANS.finditer(collapsed, overlapped=True), []
    while some := list(islice(matches, WORDS_AT_ONCE)):
        one, two, three = zip(*map(_groups, some))
        # only the text's last words have none after them
        seconds, thirds = len(two) - (not two[-1]), len(three) - sum(not x for x in three[-2:])
        first = list(map(zlib.crc32, one))
        second = list(map(zlib.crc32, two[:seconds], first))
        out.append(np.array([*first, *second, *map(zlib.crc32, three[:thirds], second)], np.uint32) % BUCKETS)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pack(buckets: np.ndarray) -> bytes:
    """Sorted buckets as gaps: 255 stands for 255 and more to come, a smaller byte ends the gap."""
    more, rest = np.divmod(np.diff(np.sort(buckets).astype(np.int64), prepend=0), 255)
    out = np.full(int(more.sum()) + len(rest), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _scan(batches):
    for pdf in batches:
        found = [feature_buckets(t) if t else np.zeros(0, np.uint32) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_features": [len(x) for x in found], "packed": [pack(x) for x in found]})


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_features and the packed buckets of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(_scan, f"doc_id {kind}, n_features long, packed binary")


def _totals(batches):
    counts = np.zeros(BUCKETS, np.int64)
    for pdf in batches:
        for x in pdf["packed"]:
            counts += np.bincount(unpack(x), minlength=BUCKETS)
    some = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": some, "n": counts[some]})


def bucket_counts(found: DataFrame) -> DataFrame:
    """(bucket, n) over all documents; each task adds its own up first."""
    return found.select("packed").mapInPandas(_totals, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all buckets: a thousand times the log ratio of smoothed shares, rounded down."""
    everything = Window.partitionBy()
    rows = corpus.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    rows = rows.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    rows = rows.withColumns({"all_s": F.sum("s").over(everything), "all_t": F.sum("t").over(everything)})  # BUCKETS rows
    real = lambda c, more: F.col(c).cast("double") + F.lit(float(more))
    return rows.select("bucket", F.floor(1000 * F.ln(real("t", 1) * real("all_s", BUCKETS) / (real("s", 1) * real("all_t", BUCKETS)))).alias("gain"))


def noise(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score of each document."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "buckets")
    features(docs).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    table = gains(bucket_counts(found), bucket_counts(features(target.select(F.lit(0).alias("doc_id"), "text"))))
    gain = np.zeros(BUCKETS, np.int64)
    for row in table.collect():  # BUCKETS rows
        gain[row["bucket"]] = row["gain"]
    shared = spark.sparkContext.broadcast(gain)

    @F.pandas_udf("long")
    def weight(packed: pd.Series) -> pd.Series:
        return pd.Series([int(shared.value[unpack(x)].sum()) for x in packed], dtype="int64")

    rows = found.select("doc_id", "n_features", weight("packed").alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise())


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (1, 2, 3, .. of the drawn; null for all others) of each document."""
    spark = docs.sparkSession
    scored = materialize(weigh(docs, target), "scores")
    # w words have w + (w - 1) + (w - 2) features
    enough = F.col("n_features") >= (3 * least_words - 3 if least_words > 1 else least_words)
    drawn = percent * scored.where(enough).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the number holds the partition above 33 bits and the row's place in it below; a written table keeps it
    ranged = scored.where(enough).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged").withColumn("part", F.shiftright("place", 33))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))  # one row a partition
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranged.join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*columns))


#: CRC-32 by half bytes, low one first, from a table made by its rule; each different feature is hashed once.
ORACLE = r"""
    WITH crc AS (
      SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
        FROM (SELECT CAST(range AS BIGINT) AS i FROM range(16)))),
    texts AS (
      SELECT 0 AS of, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
    numbered AS (
      SELECT *, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM texts),
    grams AS (
      SELECT r, of, array_to_string(w[i : i + n - 1], ' ') AS f
      FROM (SELECT r, of, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM numbered, (SELECT unnest([1, 2, 3]) AS n))),
    counted AS (SELECT r, of, f, count(*) AS c FROM grams GROUP BY ALL),
    hashed AS (
      SELECT f, xor(4294967295, list_reduce(
               list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, len(h) + 1, 2), lambda k: [
                 CAST(strpos('0123456789ABCDEF', substr(h, k + 1, 1)) - 1 AS BIGINT),
                 CAST(strpos('0123456789ABCDEF', substr(h, k, 1)) - 1 AS BIGINT)]))),
               lambda x, y: xor(x >> 4, t[xor(x & 15, y) + 1]))) % 10000 AS b
      FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM counted), crc),
    per AS (SELECT r, of, b, sum(c) AS c FROM counted JOIN hashed USING (f) GROUP BY ALL),
    sums AS (
      SELECT range AS b, coalesce(sum(c) FILTER (of = 0), 0) AS s, coalesce(sum(c) FILTER (of = 1), 0) AS t
      FROM range(10000) LEFT JOIN per ON b = range GROUP BY range),
    gain AS (
      SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000.0::DOUBLE) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS g
      FROM sums),
    weighed AS (SELECT r, sum(c) AS n, sum(c * g) AS weight FROM per JOIN gain USING (b) WHERE of = 0 GROUP BY r),
    scored AS (
      SELECT id AS doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM numbered LEFT JOIN weighed USING (r) WHERE of = 0),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS p FROM scored)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN words >= 20 AND p <= (SELECT 5 * count(*) // 100 FROM scored WHERE words >= 20) THEN p END AS rank
    FROM placed"""
