"""Audit of how the sources of a language differ in their words.

Terms are counted inside tasks.  What is shuffled for the counts is of fixed width: numbers of the language and of the
group (language, source), the term's 64-bit digest, counts.  Texts go along once a task and language, those of a slot
(the digest's first bits) in one row.  Both are shuffled once, by language and slot, and never written otherwise: each
digest's documents are summed where its rows meet, and only kept terms, those that enough documents of the language
have, are written.  The least and the greatest text of such a digest say whether two terms share it: then documents are
read again, and it is split and counted by texts.  For the report, texts are joined back only for the terms that it names.

A group gives each kept term a smoothed share of a billion, rounded down; the divergence of two shares p and q is
floor((p - q)^2 / (p + q)), in whole numbers throughout.  The divergence of two sources is its sum over all kept terms.
Terms that neither has contribute the same, those that one has depend on its count alone, so that only terms that both
have meet in a join, and those counts are grouped first.

Defined results: null texts, languages and sources are empty strings; a language without kept terms has divergence 0
between its sources and no terms; other columns play no part, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents of a language that have a kept term at least; ranks of a group's terms that are reported.
LEAST_DOCS, MOST_TERMS = 10, 10
#: Different terms that a task holds before it hands on what it has counted.
HELD_TERMS = 500_000
#: Leading bits of a digest by which counts and texts of terms are dealt out: more deal more evenly, fewer join more texts.
SLOT_BITS = 14
#: Bytes of text from which on words are not listed at once.
LONG_BYTES = 1 << 22

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_TERM = re.compile(rb"[a-z\x80-\xff]+")

KEY = ["lid", "digest", "part"]
COUNTS = "gid long, lid long, digest long, n long, docs long, term string"


def _digests(terms: list[bytes], bits: int) -> np.ndarray:
    # with the seed of Spark's xxhash64
    found = np.fromiter(map(xxhash.xxh64_intdigest, terms, itertools.repeat(42)), np.uint64, len(terms))
    return (found >> np.uint64(64 - bits)).view(np.int64)


def _rows(occurring: dict, having: dict, bits: int, with_text: bool):
    """Counts by digest (term null) and the texts of each language once; or, with texts, counts by both."""
    def table(gid, lid, terms, n, docs, named):
        # UTF-8 as it was read, so that no term becomes a Python string
        texts = pa.array(terms, pa.binary()).view(pa.string()) if named else pa.nulls(len(terms), pa.string())
        return pd.DataFrame({"gid": gid, "lid": lid, "digest": _digests(terms, bits), "n": n, "docs": docs, "term": pd.arrays.ArrowExtensionArray(texts)})

    texts: dict[int, dict] = {}
    for (gid, lid), docs in having.items():
        if docs:
            # both hold a group's terms in the same order
            terms, n = list(docs), occurring[gid, lid].values()
            yield table(gid, lid, terms, np.fromiter(n, np.int64, len(terms)), np.fromiter(docs.values(), np.int64, len(terms)), with_text)
            texts.setdefault(lid, {}).update(docs)
    if not with_text:
        for lid, some in texts.items():
            yield table(0, lid, list(some), 0, 0, True)


def _counter(bits: int, with_text: bool = False):
    def run(batches):
        """Occurrences and documents of each term of each group."""
        occurring, having, held = {}, {}, 0
        for pdf in batches:
            for gid, lid, text in zip(pdf["gid"].tolist(), pdf["lid"].tolist(), pdf["text"]):
                data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
                own = _TERM.findall(data) if len(data) < LONG_BYTES else Counter(m[0] for m in _TERM.finditer(data))
                if (gid, lid) not in having:
                    occurring[gid, lid], having[gid, lid] = Counter(), Counter()
                docs = having[gid, lid]
                held -= len(docs)
                # counted from lists, not from counts: that loop is not Python's; terms in the order of their first place
                occurring[gid, lid].update(own)
                docs.update(dict.fromkeys(own).keys())
                held += len(docs)
                if held > HELD_TERMS:
                    yield from _rows(occurring, having, bits, with_text)
                    occurring, having, held = {}, {}, 0
        yield from _rows(occurring, having, bits, with_text)

    return run


def _dealt(count):
    def run(batches):
        """Counts as they are; of the texts of a language, one row a slot, with spaces between, which no term has."""
        for table in count(batches):
            if table["docs"].iloc[0]:
                yield table
                continue
            slots = table["digest"].to_numpy().view(np.uint64) >> np.uint64(64 - SLOT_BITS)
            order = np.argsort(slots, kind="stable")
            slots, first = np.unique(slots[order], return_index=True)
            terms = pa.array(table["term"].array[order], pa.string())
            terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
            lists = pa.ListArray.from_arrays(pa.array([*first, len(order)], pa.int32()), terms)
            digests = (slots << np.uint64(64 - SLOT_BITS)).view(np.int64)
            yield pd.DataFrame({"gid": 0, "lid": table["lid"].iloc[0], "digest": digests, "n": 0, "docs": 0, "term": pd.arrays.ArrowExtensionArray(pc.binary_join(lists, " "))})

    return run


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gid, lid, lang, source of each group; gid, lid, text of each document); numbers are hashes without collisions."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = materialize(texts.select("lang", "source").distinct(), "names")
    for seed in itertools.count():
        number = [F.xxhash64("lang", "source", F.lit(seed)).alias("gid"), F.xxhash64("lang", F.lit(seed)).alias("lid")]
        groups = names.select(*number, "lang", "source")
        n, gids, langs, lids = groups.agg(F.count(F.lit(1)), F.countDistinct("gid"), F.countDistinct("lang"), F.countDistinct("lid")).first()
        if (n, langs) == (gids, lids):
            return groups, texts.select(*number, "text")


def kept_terms(texts: DataFrame, least_docs: int = LEAST_DOCS, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(gid, lid, digest, part, n of kept terms that occur there; lid, digest, part, term of each kept term).

    ``part`` is 0 but for terms that share a digest.
    """
    # dealt out by slot once, straight from the tasks that counted; only what is kept is written
    slot = F.expr(f"shiftrightunsigned(digest, {64 - SLOT_BITS})")
    seen = texts.mapInPandas(_dealt(_counter(digest_bits)), COUNTS).repartition("lid", slot)
    seen = seen.select("gid", "lid", slot.alias("slot"), "digest", "n", "docs", F.explode_outer(F.split("term", " ")).alias("term"))
    seen = seen.withColumn("digest", F.expr(f"CASE WHEN term IS NULL THEN digest ELSE shiftrightunsigned(xxhash64(term), {64 - digest_bits}) END"))
    # the digest first: sorts compare it before they look at a row
    term = Window.partitionBy("digest", "lid", "slot")
    seen = seen.withColumns({"all_docs": F.sum("docs").over(term), "low": F.min("term").over(term), "high": F.max("term").over(term)}).where(F.col("all_docs") >= least_docs)
    # rows of texts have no documents
    kept = seen.withColumn("gid", F.when(F.col("docs") > 0, F.col("gid")))
    kept = kept.groupBy("slot", "lid", "digest", "gid", "low", "high").agg(F.sum("n").alias("n"))
    kept = materialize(kept.select("gid", "lid", "digest", "n", F.when(F.col("gid").isNull(), F.col("low")).alias("term"), (F.col("low") != F.col("high")).alias("shared")), "kept")
    zero, single = F.lit(0).alias("part"), kept.where("NOT shared")
    counts = single.where("gid IS NOT NULL").select("gid", "lid", "digest", zero, "n")
    names = single.where("gid IS NULL").select("lid", "digest", zero, "term")
    shared = kept.where("shared AND gid IS NULL").select("lid", "digest")
    if not shared.limit(1).count():
        return counts, names
    again = texts.mapInPandas(_counter(digest_bits, True), COUNTS).join(shared, ["lid", "digest"], "left_semi")
    again = materialize(again.groupBy("gid", "lid", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "shared")
    apart = again.groupBy("lid", "digest", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    apart = apart.select("lid", "digest", F.row_number().over(Window.partitionBy("lid", "digest").orderBy("term")).alias("part"), "term")
    counts = counts.unionByName(again.join(apart, ["lid", "digest", "term"]).select("gid", "lid", "digest", "part", "n"))
    return counts, names.unionByName(apart)


def _share(n: str, total: str, v: str) -> F.Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)); null where there are no terms."""
    return F.expr(f"1 + (1000000000BD * CAST({n} + 2 AS DECIMAL(19, 0))) div nullif(CAST({total} + 2 * {v} AS DECIMAL(19, 0)), 0)")


def _divergence(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS, digest_bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` for the other sources of the language, ``term`` for the
    terms that the group has more of than its language."""
    groups, texts = numbered(docs)
    counts, names = kept_terms(texts, least_docs, digest_bits)
    counts, names = materialize(counts, "counts"), materialize(names, "names")
    v = names.groupBy("lid").agg(F.count(F.lit(1)).alias("v"))
    sums = counts.groupBy("gid").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = groups.join(sums, "gid", "left").join(v, "lid", "left").na.fill(0, ["total", "own", "v"])
    groups = materialize(groups.withColumn("none", _share("0", "total", "v")), "groups")
    shares = counts.join(groups.drop("lid"), "gid").select("gid", *KEY, "n", _share("n", "total", "v").alias("p"), "none")
    shares = materialize(shares, "shares")

    # of each two sources: terms of both, terms of one, terms of neither
    one, two = (shares.select(*KEY, F.col("gid").alias(x), F.col("p").alias(f"p{x}"), F.col("none").alias(f"n{x}")) for x in "ab")
    both = one.join(two, KEY).where("a < b").groupBy("a", "b")
    both = both.agg(F.sum(F.expr(f"{_divergence('pa', 'pb')} - {_divergence('pa', 'nb')} - {_divergence('na', 'pb')} + {_divergence('na', 'nb')}")).alias("value"))
    like = shares.groupBy("lid", "gid", "p").agg(F.count(F.lit(1)).alias("n"))
    other = groups.select("lid", F.col("gid").alias("other"), "none")
    single = like.join(other, "lid").where("gid <> other").select(F.least("gid", "other").alias("a"), F.greatest("gid", "other").alias("b"), F.expr(f"n * ({_divergence('p', 'none')})").alias("value"))
    single = single.groupBy("a", "b").agg(F.sum("value").alias("value"))
    named = lambda x: groups.select("lid", F.col("gid").alias(x), F.col("own").alias(f"own_{x}"), F.col("none").alias(f"none_{x}"), "v")
    pairs = named("a").join(named("b").drop("v"), "lid").where("a < b")
    neither = pairs.select("a", "b", F.expr(f"(v - own_a - own_b) * ({_divergence('none_a', 'none_b')})").alias("value"))
    total = both.unionByName(single).unionByName(neither).groupBy("a", "b").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    total = materialize(total, "pairs")
    own, others = groups.select("gid", "lang", "source"), groups.select(F.col("gid").alias("other"), F.col("source").alias("item"))
    pair = total.select(F.col("a").alias("gid"), F.col("b").alias("other"), "value").unionByName(total.select(F.col("b").alias("gid"), F.col("a").alias("other"), "value"))
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    pair = pair.join(others, "other").withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    whole = counts.groupBy(*KEY).agg(F.sum("n").alias("all_n"))
    whole = whole.join(groups.groupBy("lid").agg(F.sum("total").alias("total"), F.max("v").alias("v")), "lid").select(*KEY, _share("all_n", "total", "v").alias("q"))
    more = shares.join(whole, KEY).where("p > q").withColumn("value", F.expr(_divergence("p", "q")))
    # ties with the last rank stay until their texts are there
    first = more.withColumn("place", F.rank().over(Window.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("place") <= most_terms)
    first = first.select("gid", *KEY, "value").join(names, KEY).select("gid", F.col("term").alias("item"), "value")
    first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.join(own, "gid").select(*columns).unionByName(first.join(own, "gid").select(*columns))


ORACLE = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (
      SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM d),
    per AS (SELECT r, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
    kept AS (SELECT lang, term FROM per GROUP BY ALL HAVING count(*) >= 10),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (
      SELECT g.lang, g.source, k.term, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS n
      FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN per p ON p.lang = g.lang AND p.source = g.source AND p.term = k.term GROUP BY ALL),
    s AS (SELECT c.lang, source, term, n, 1 + (1000000000 * (n + 2)) // (CAST(sum(n) OVER (PARTITION BY c.lang, source) AS BIGINT) + 2 * v) AS p FROM c JOIN v ON v.lang = c.lang),
    l AS (
      SELECT x.lang, term, 1 + (1000000000 * (n + 2)) // (CAST(sum(n) OVER (PARTITION BY x.lang) AS BIGINT) + 2 * v) AS q
      FROM (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL) x JOIN v ON v.lang = x.lang),
    pair AS (
      SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source
      LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
    more AS (
      SELECT s.lang, s.source, s.term AS item, ((p - q) * (p - q)) // (p + q) AS value
      FROM s JOIN l ON s.lang = l.lang AND s.term = l.term WHERE s.n > 0 AND p > q),
    both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM more)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
           CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM both_parts QUALIFY part = 'pair' OR rank <= 10"""
