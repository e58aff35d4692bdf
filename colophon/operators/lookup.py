"""Free subjects and places looked up in controlled vocabularies, and selected labels matched back to terms."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import formatted, priority, term
from ..functions.text import comparison_key, latin_key, word_overlap, words
from ..storage import written

#: Fixed: words that widen a search for places; words that let a label pass as architecture.
PLACE_WORDS = ["american", "southern", "northern", "eastern", "western", "city", "state", "county"]
BUILDING_WORDS = ["architecture", "architectural", "building", "style"]
#: Fixed: order of the sources, and the group whose cap each shares.
SOURCES = [("LCSH", "LCSH"), ("FAST", "FAST"), ("Getty AAT", "Getty"), ("Getty TGN", "Getty")]
#: The source that places are looked up in, one term each.
PLACES, PLACE_LIMIT = "FAST Geographic", 1
#: Labels that one range of a left-anchored search holds on average.
LABELS_PER_RANGE = 50_000


def queries(values: DataFrame, column: str) -> DataFrame:
    """Distinct, trimmed, non-empty values: what has to be asked, once each."""
    trimmed = F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
    return values.select(trimmed.alias("query")).where("query <> ''").distinct()


def cached(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their terms, misses) of (service, query) rows."""
    return asked.join(cache, ["service", "query"]), asked.join(cache.select("service", "query"), ["service", "query"], "left_anti")


def _ranked(found: DataFrame, whole: Column) -> DataFrame:
    """Hits numbered by query and source: equal to the query first, then by label."""
    exact = (F.lower("label") != whole).cast("int")
    return found.withColumn("hit_pos", F.row_number().over(Window.partitionBy("query", "source").orderBy(exact, "label", "uri")))


def word_index(vocabulary: DataFrame) -> DataFrame:
    """A vocabulary's rows once for each word of their label, with the word, all words, and how many rows have the word.

    It can be written and kept: searches of any number of queries read it.
    """
    rows = vocabulary.withColumn("words", F.array_distinct(words(F.lower("label")))).withColumn("word", F.explode("words"))
    return rows.join(rows.groupBy("word").agg(F.count(F.lit(1)).alias("n_rows")), "word")


def index_hits(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(query, source, label, uri, hit_pos) of an indexed vocabulary: terms that contain all words of a query, exact first.

    The rarest word of a query leads to its candidates and the others are checked, so a frequent word brings up its
    rows only for queries that have nothing else.
    """
    parts = asked.select("query", F.array_distinct(words(F.lower("query"))).alias("parts"))
    known = index.select("word", "n_rows").distinct()
    led = parts.select("query", "parts", F.explode("parts").alias("word")).join(known, "word")
    led = led.groupBy("query", "parts").agg(F.min(F.struct("n_rows", "word")).alias("rarest"), F.count(F.lit(1)).alias("n"))
    led = led.where(F.col("n") == F.size("parts")).select("query", "parts", F.col("rarest.word").alias("word"))
    found = led.join(index, "word").where(F.size(F.array_except("parts", "words")) == 0)
    columns = [c for c in index.columns if c not in ("word", "words", "n_rows")]
    return _ranked(found, F.lower("query")).select("query", *columns, "hit_pos")


def table_hits(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The hits in a vocabulary that is indexed for this search only."""
    return index_hits(asked, word_index(vocabulary)).select("query", *vocabulary.columns, "hit_pos")


def left_anchored_hits(asked: DataFrame, vocabulary: DataFrame, per_range: int = LABELS_PER_RANGE) -> DataFrame:
    """(query, source, label, uri, hit_pos): terms whose label starts with the query.

    Labels are range-sorted; a query is the interval of what starts with it, and goes to the ranges it overlaps, where
    its labels are a slice of the sorted ones.  The cost is labels, queries and hits.
    """
    ranges = max(1, vocabulary.count() // per_range)
    rows = vocabulary.withColumn("start", F.lower("label")).where("start IS NOT NULL").repartitionByRange(ranges, "start").withColumn("range", F.spark_partition_id())
    rows = written(rows)
    firsts = rows.groupBy("range").agg(F.min("start").alias("first"))
    firsts = firsts.agg(F.array_sort(F.collect_list(F.struct("first", "range"))).alias("firsts"))  # a row a range
    q = F.col("start")
    before = F.size(F.filter("firsts", lambda x: x["first"] <= q))
    upto = F.size(F.filter("firsts", lambda x: (x["first"] <= q) | F.startswith(x["first"], q)))
    spans = asked.select("query", F.lower("query").alias("start")).crossJoin(F.broadcast(firsts))
    spans = spans.withColumn("among", F.slice("firsts", F.greatest(before, F.lit(1)), F.greatest(upto - F.greatest(before, F.lit(1)) + 1, F.lit(0))))
    spans = spans.select("query", "start", F.explode("among").alias("at")).select("query", "start", F.col("at.range").alias("range"))
    columns = vocabulary.columns

    def slices(labels, queries):
        labels = labels.sort_values("start")
        starts, found = labels["start"].tolist(), []
        for query, q in zip(queries["query"], queries["start"]):
            a = bisect.bisect_left(starts, q)
            b = bisect.bisect_right(starts, q, lo=a, key=lambda x: x[: len(q)])
            if a < b:
                found.append(labels.iloc[a:b][columns].assign(query=query))
        return pd.concat(found, ignore_index=True)[["query", *columns]] if found else labels.iloc[:0][columns].assign(query="")[["query", *columns]]

    schema = "query string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vocabulary.schema)
    found = rows.groupBy("range").cogroup(spans.groupBy("range")).applyInPandas(slices, schema)
    return _ranked(found, F.lower("query")).select("query", *columns, "hit_pos")


def fallback_words(query: Column, kind: str) -> Column:
    """What to ask when a query finds nothing: its longer words (several words only), or words that may name places."""
    w = words(query)
    if kind == "Getty TGN":
        return F.filter(words(F.lower(query)), lambda x: x.isin(PLACE_WORDS) | (F.length(x) > 4))
    return F.when(F.size(w) > 1, F.filter(w, lambda x: F.length(x) > 3)).otherwise(F.array().cast("array<string>"))


def accepted(label: Column, query: Column, kind: str, term_type: Column | None = None) -> Column:
    """May a fallback's hit stand for the query?"""
    if kind == "Getty TGN" or kind == "LCSH":
        return F.lit(True)
    out = word_overlap(label, query)
    if kind == "Getty AAT":
        for w in BUILDING_WORDS:
            out = out | F.contains(F.lower(label), F.lit(w))
    if kind == PLACES and term_type is not None:
        out = out | F.contains(F.lower(term_type), F.lit("geographic"))
    return out


def by_kind(kinds, build: Callable[[str], Column], none: Column) -> Column:
    """``build`` of the row's own source among ``kinds``."""
    for kind in kinds:
        none = F.when(F.col("source") == kind, build(kind)).otherwise(none)
    return none


def first_hits(hits: DataFrame, most: Column | int, *order: str) -> DataFrame:
    """Of each query and source the first hit of each uri, ``most`` of them, numbered by ``order``."""
    again = Window.partitionBy("query", "source", "uri").orderBy(*order)
    once = hits.withColumn("again", F.row_number().over(again)).where((F.col("again") == 1) | (F.col("uri") == "")).drop("again")
    return once.withColumn("hit_pos", F.row_number().over(Window.partitionBy("query", "source").orderBy(*order))).where(F.col("hit_pos") <= most)


def search(asked: DataFrame, vocabulary: DataFrame, most: int = 3) -> DataFrame:
    """Hits of each source, ``most`` of different uris at most, with those of a fallback where there are too few.

    LCSH adds headings that start with the query whenever it has fewer than ``most``; the others ask word by word, and
    only if nothing was found.
    """
    index = written(word_index(vocabulary))
    primary = written(index_hits(asked, index).where(F.col("hit_pos") <= most).withColumn("place", F.lit(0)))
    found = primary.groupBy("query", "source").agg(F.countDistinct("uri").alias("n"))
    of = lambda source: asked.withColumn("source", F.lit(source)).join(found, ["query", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    headings = vocabulary.where(F.col("source") == "LCSH")
    hits = primary.unionByName(left_anchored_hits(of("LCSH").where(F.col("n") < most).select("query"), headings).where(F.col("hit_pos") <= most).withColumn("place", F.lit(1)))
    others = [s for s, _ in SOURCES if s != "LCSH"]
    nothing = of(others[0])
    for source in others[1:]:
        nothing = nothing.unionByName(of(source))
    parts = by_kind(others, lambda s: fallback_words(F.col("query"), s), F.lit(None).cast("array<string>"))
    again = nothing.where("n = 0").select(F.col("query").alias("original"), "source", F.posexplode(parts).alias("place", "query"))
    more = again.join(index_hits(again.select("query").distinct(), index.where(F.col("source") != "LCSH")).where(F.col("hit_pos") <= most), ["query", "source"])
    may = by_kind(others, lambda s: accepted(F.col("label"), F.col("original"), s), F.lit(False))
    more = more.where(may).select(F.col("original").alias("query"), *vocabulary.columns, "hit_pos", (F.col("place") + 1).alias("place"))
    return first_hits(hits.unionByName(more), most, "place", "hit_pos", "label").drop("place")


def place_terms(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query, source, label, uri, type): the term of each place, not deduplicated over places.

    Geographic terms come first; only where there is none, the first two terms of any type are looked at, and stand if
    they share a word with the query or are of a geographic type.
    """
    geographic = vocabulary.where(F.col("type") == "Geographic")
    primary = table_hits(asked, geographic.withColumn("source", F.lit(PLACES))).where(F.col("hit_pos") <= 2 * PLACE_LIMIT)
    rest = asked.select("query").join(primary.select("query").distinct(), "query", "left_anti")
    more = table_hits(rest, vocabulary.withColumn("source", F.lit(PLACES))).where(F.col("hit_pos") <= 2 * PLACE_LIMIT)
    more = more.where(accepted(F.col("label"), F.col("query"), PLACES, F.col("type")))
    return first_hits(primary.unionByName(more), PLACE_LIMIT, "hit_pos").drop("hit_pos")


def capped(hits: DataFrame, limit: int = 3) -> DataFrame:
    """At most ``limit`` hits of each group of sources, in the sources' order, with the term's position."""
    order = F.lit(len(SOURCES))
    group = F.col("source")
    for i, (source, g) in enumerate(SOURCES):
        order = F.when(F.col("source") == source, i).otherwise(order)
        group = F.when(F.col("source") == source, g).otherwise(group)
    rows = hits.withColumn("client_pos", order).withColumn("grp", group)
    w = Window.partitionBy("query", "grp").orderBy("client_pos", "hit_pos", "label", "uri")
    return rows.withColumn("taken", F.row_number().over(w)).where(F.col("taken") <= limit)


def distinct_terms(rows: DataFrame) -> DataFrame:
    """The first term of each uri of a query; terms without a uri all stay."""
    w = Window.partitionBy("query", "uri").orderBy("client_pos", "hit_pos", "label")
    kept = rows.withColumn("again", F.row_number().over(w)).where((F.col("again") == 1) | (F.col("uri") == ""))
    pos = Window.partitionBy("query").orderBy("client_pos", "hit_pos", "label", "uri")
    return kept.withColumn("term_pos", F.row_number().over(pos)).drop("again")


def look_up(asked: DataFrame, vocabulary: DataFrame, limit: int = 3) -> DataFrame:
    """query, term_pos, label, uri, source, grp: what each subject is offered."""
    return distinct_terms(capped(search(asked, vocabulary, limit), limit)).select("query", "term_pos", "label", "uri", "source", "grp")


def write_back(items: DataFrame, terms: DataFrame, subjects: str = "subjects") -> DataFrame:
    """item_index, n_terms, cell: each item's terms in the order of its subjects, joined without repeats."""
    rows = items.select("item_index", F.posexplode(subjects).alias("pos", "query")).join(terms, "query")
    text = formatted(term(F.col("label"), F.col("uri"), F.col("source")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "term_pos", text.alias("text"))))
    return rows.groupBy("item_index").agg(F.count(F.lit(1)).alias("n_terms"), F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["text"])), "; ").alias("cell"))


def word_set(label: Column, native: bool = False) -> Column:
    """The distinct words of a label's comparison key, sorted and joined: equal word sets give equal strings."""
    key = (latin_key if native else comparison_key)(label)
    return F.array_join(F.array_sort(F.array_distinct(words(key))), " ")


def match(labels: DataFrame, terms: DataFrame, native: bool = False) -> DataFrame:
    """labels (item_index, label_pos, label) with the best term of the item's pool, null where none fits.

    A term fits if its words are the label's, in any order; only if no term does, if the two are equal but for case
    and surrounding blanks.  The source's priority decides, then the position in the pool (``pool_pos``).
    """
    pool = terms.select("item_index", "pool_pos", F.col("label").alias("term_label"), "uri", "source", word_set(F.col("label"), native).alias("k"), F.lower(F.trim("label")).alias("plain"))
    asked = labels.withColumn("k", word_set(F.col("label"), native)).withColumn("plain", F.lower(F.trim("label")))
    by_words = asked.where("k <> ''").join(pool.drop("plain"), ["item_index", "k"]).withColumn("way", F.lit(0))
    by_text = asked.join(pool.drop("k"), ["item_index", "plain"]).withColumn("way", F.lit(1))
    cols = ["item_index", "label_pos", "label", "term_label", "uri", "source", "pool_pos", "way"]
    w = Window.partitionBy("item_index", "label_pos").orderBy("way", priority(F.col("source")), "pool_pos")
    best = by_words.select(cols).unionByName(by_text.select(cols)).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "label", "way")
    return labels.join(best, ["item_index", "label_pos"], "left")


def selected(matched: DataFrame) -> DataFrame:
    """The matched terms of an item in order, each uri once."""
    w = Window.partitionBy("item_index", "uri").orderBy("label_pos")
    rows = matched.where("term_label IS NOT NULL").withColumn("r", F.row_number().over(w))
    return rows.where((F.col("r") == 1) | (F.col("uri") == "")).drop("r")


def unmatched(matched: DataFrame) -> DataFrame:
    return matched.where("term_label IS NULL").select("item_index", "label_pos", "label")


def status(items: DataFrame, pools: DataFrame, answers: DataFrame, matched: DataFrame) -> DataFrame:
    """item_index, status, n_selected, n_unmatched, has_issue.

    ``items``: item_index; ``pools``: the candidates; ``answers``: item_index, error (null: labels were read).
    """
    has_pool = pools.select("item_index").distinct().withColumn("offered", F.lit(True))
    chosen = selected(matched).groupBy("item_index").agg(F.count(F.lit(1)).alias("n_selected"))
    lost = unmatched(matched).groupBy("item_index").agg(F.count(F.lit(1)).alias("n_unmatched"))
    rows = items.join(has_pool, "item_index", "left").join(answers.withColumn("answered", F.lit(True)), "item_index", "left").join(chosen, "item_index", "left").join(lost, "item_index", "left")
    said = (
        F.when(F.col("offered").isNull(), "skipped_no_candidates")
        .when(F.col("answered").isNull() | F.col("error").isNotNull(), "failed")
        .when(F.coalesce("n_selected", F.lit(0)) > 0, "selected")
        .otherwise("none_selected")
    )
    zero = F.lit(0).cast("long")
    rows = rows.select("item_index", said.alias("status"), F.coalesce("n_selected", zero).alias("n_selected"), F.coalesce("n_unmatched", zero).alias("n_unmatched"))
    return rows.withColumn("has_issue", (F.col("status") == "failed") | (F.col("n_unmatched") > 0))


def terms_for(asked: DataFrame, topical: DataFrame, places: DataFrame) -> DataFrame:
    """Terms of each query: topical ones, or, only where it has none, those of places."""
    found = asked.join(topical, "query")
    rest = asked.join(topical.select("query").distinct(), "query", "left_anti")
    return found.unionByName(rest.join(places, "query"))
