"""Authority files: names clustered around leaders, and what is gathered for each cluster.

Clustering is greedy: in order of first appearance a name that no earlier leader is similar to leads, any other
joins the earliest similar leader.  That is the lexicographically first maximal independent set of the similarity
graph, found in rounds: a name with an earlier leader among its neighbours follows, one whose earlier neighbours
all follow leads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entities, similarity
from ..storage import cut

Similarity = Callable[[Column, Column], Column]


def mentions(records: DataFrame) -> DataFrame:
    """One row per entity: original, name, type, source, context, seq (order of mention).

    ``records``: item_index, source, title, abstract, entities (array).  Blank and one-character entities go.
    """
    told = F.array_join(F.filter(F.array(F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("abstract", F.lit("")))), lambda x: x != ""), " ")
    rows = records.select("item_index", "source", F.lower(told).alias("context"), F.posexplode("entities").alias("pos", "entity"))
    rows = rows.where(F.length(entities.strip(F.col("entity"))) >= 2).withColumn("parsed", entities.parsed(F.col("entity"))).where("parsed.name <> ''")
    seq = F.struct("item_index", "pos")
    return rows.select(entities.strip(F.col("entity")).alias("original"), "parsed.name", "parsed.type", "item_index", "source", "context", seq.alias("seq"))


def distinct_names(rows: DataFrame) -> DataFrame:
    """name, mentions, pos (smallest seq), key (normalised name)."""
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"), F.min("seq").alias("pos")).withColumn("key", entities.normalised_name(F.col("name")))


def grams(text: Column) -> Column:
    """Distinct letters of the text with their occurrence: "anna" has a1 n1 n2 a2."""
    letters = F.split(text, "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(letters), F.lit(1))), lambda i: F.concat(F.get(letters, i - 1), F.size(F.filter(F.slice(letters, F.lit(1), i), lambda c: c == F.get(letters, i - 1))).cast("string")))


def share(threshold: float) -> float:
    """The least share of the larger multiset of characters that names at the threshold have in common."""
    return threshold / (200.0 - threshold)


def lengths_fit(a: str, b: str, threshold: float) -> Column:
    """Can names of these lengths reach the threshold?  The longest common subsequence is at most the shorter one."""
    return F.least(a, b) * 200.0 >= (F.col(a) + F.col(b)) * F.lit(float(threshold)) - 1e-9


def gram_counts(names: DataFrame) -> DataFrame:
    """(g, n): in how many names a letter with its occurrence is."""
    return names.select(F.explode(grams(F.col("key"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def candidate_keys(names: DataFrame, share: float, counts: DataFrame | None = None) -> DataFrame:
    """(id, key): names that may overlap in ``share`` of the larger multiset of characters have a key in common.

    Characters (with their occurrence number) stand in one fixed order, the rarest first.  Two multisets that share n
    characters have two of them in common among the first size - n + 2 of each, so the keys are the pairs of these;
    where one character may do (names of one or two), the single ones are keys as well.  ``counts`` (g, n) gives the
    order where it is not to be that of these names; characters it lacks count as rarest.
    """
    base = names.select("id", grams(F.col("key")).alias("grams"))
    rare = gram_counts(names) if counts is None else counts
    ranked = base.select("id", F.size("grams").alias("size"), F.explode("grams").alias("g")).join(rare, "g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ordered = ranked.groupBy("id", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda x: x["g"]).alias("grams"))
    least = F.greatest(F.ceil(F.col("size") * F.lit(share) - 1e-9), F.lit(1)).cast("int")
    first = F.slice("grams", F.lit(1), F.least(F.col("size") - least + 2, F.col("size")))
    ordered = ordered.select("id", first.alias("first"), (least < 2).alias("one"))
    pairs = F.flatten(F.transform("first", lambda a, i: F.transform(F.slice("first", i + 2, F.size("first")), lambda b: F.concat_ws(" ", a, b))))
    return ordered.select("id", F.explode(F.when(F.col("one"), F.concat(pairs, F.col("first"))).otherwise(pairs)).alias("g"))


def candidate_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(ia, ib) of names that have a key in common, once each."""
    keys = candidate_keys(names, share(threshold)).join(names.select("id", F.length("key").alias("n")), "id")
    left, right = (keys.select(F.col("id").alias(i), F.col("n").alias(n), "g") for i, n in (("ia", "na"), ("ib", "nb")))
    return left.join(right, "g").where((F.col("ia") < F.col("ib")) & lengths_fit("na", "nb", threshold)).select("ia", "ib").distinct()


def similar_pairs(names: DataFrame, threshold: float = 85, similarity_of: Similarity = similarity.ratio) -> DataFrame:
    """(a, b, ratio) of names at or above the threshold, a before b.

    A pair at threshold t shares so many characters that two of the rarest few of each must meet (prefix filtering on
    character multisets): blocking by pairs of those loses nothing, keeps the join an equi-join and its keys many.
    Candidates are numbers; names are fetched for those that are left.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0 is needed: everything is similar at 0")
    names = cut(names.select("name", "pos", "key", F.monotonically_increasing_id().alias("id")))
    a, b = (names.select(F.col("id").alias(f"i{x}"), F.col("name").alias(x), F.col("pos").alias(f"p{x}"), F.col("key").alias(f"k{x}")) for x in "ab")
    near = candidate_pairs(names, threshold).join(a, "ia").join(b, "ib").where(similarity.may_reach(F.col("ka"), F.col("kb"), threshold))
    near = near.withColumn("ratio", similarity_of(F.col("ka"), F.col("kb"))).where(F.col("ratio") >= threshold)
    before = F.struct("pa", "a") < F.struct("pb", "b")
    return near.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("b"), "ratio")


def leaders(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, leader) for each name.

    In each round names without an earlier open neighbour lead, those beside a leader follow, and the edges of both go;
    what is left shrinks with every round.
    """
    order = names.select("name", F.struct("pos", "name").alias("rank"))
    edges = pairs.join(order.select(F.col("name").alias("a"), F.col("rank").alias("ra")), "a").join(order.select(F.col("name").alias("b"), F.col("rank").alias("rb")), "b")
    edges = cut(edges.select(F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high")))
    left, leading = edges, None
    while left.limit(1).count():
        lead = cut(left.select("low").distinct().join(left.select(F.col("high").alias("low")), "low", "left_anti"))
        leading = lead if leading is None else leading.unionByName(lead)
        led = left.join(lead, "low", "left_semi").select("high").distinct()
        left = left.join(led, "high", "left_anti").join(led.withColumnRenamed("high", "low"), "low", "left_anti")
        left = cut(left.join(lead, "low", "left_anti"))
    if leading is None:
        return names.select("name", F.col("name").alias("leader"))
    # names whose neighbours all follow lead too, but nobody follows them but through edges that lead says
    undecided = edges.select(F.col("high").alias("low")).distinct().join(leading, "low", "left_anti")
    led = edges.join(leading, "low", "left_semi").select(F.col("high").alias("low")).distinct()
    alone = undecided.join(led, "low", "left_anti")
    first = edges.join(cut(leading.unionByName(alone)), "low", "left_semi").groupBy("high").agg(F.min("low").alias("leader"))
    follow = first.select(F.col("high.name").alias("name"), F.col("leader.name").alias("leader"))
    return names.select("name").join(follow, "name", "left").select("name", F.coalesce("leader", "name").alias("leader"))


def clusters(names: DataFrame, threshold: float = 85, similarity_of: Similarity = similarity.fast_ratio) -> DataFrame:
    """(name, leader, canonical): the canonical name is the most frequent, then longest, then earliest of a cluster.

    The similarity works on Arrow batches by default: its row of bits is far cheaper than the fold of columns that
    ``similarity.ratio`` is, and equal to it.
    """
    names = cut(names)
    return with_canonical(cut(leaders(names, similar_pairs(names, threshold, similarity_of)).join(names, "name")))


def with_canonical(led: DataFrame) -> DataFrame:
    """The canonical name of each leader's cluster beside its names (name, leader, mentions, pos)."""
    best = F.struct(-F.col("mentions"), -F.length("name"), "pos", "name")
    top = led.groupBy("leader").agg(F.min_by("name", best).alias("canonical"))
    return led.join(top, "leader").select("name", "leader", "canonical", "mentions", "pos")


def entries(rows: DataFrame, threshold: float = 85, similarity_of: Similarity = similarity.fast_ratio) -> DataFrame:
    """Every mention with the canonical name of its cluster, as rows: no name's mentions meet in one row."""
    return rows.join(clusters(distinct_names(rows), threshold, similarity_of).select("name", "canonical"), "name")


def authority(rows: DataFrame, threshold: float = 85, similarity_of: Similarity = similarity.fast_ratio) -> DataFrame:
    """The authority file: canonical name, type, frequency, variants, sources, contexts, original forms, documents.

    Sources and contexts keep their order and repeats; the type is the last one told that is not "unknown".
    """
    return gathered(entries(rows, threshold, similarity_of))


def gathered(entries: DataFrame) -> DataFrame:
    """The authority file of such rows, an entry's mentions in arrays: an export, as the file has them."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("v")))), lambda x: x["v"])
    known = F.max_by(F.when(F.col("type") != "unknown", F.col("type")), F.when(F.col("type") != "unknown", F.col("seq")))
    return entries.groupBy(F.col("canonical").alias("name")).agg(
        F.coalesce(known, F.lit("unknown")).alias("type"),
        F.count(F.lit(1)).alias("frequency"),
        F.countDistinct("source").alias("n_documents"),
        F.array_sort(F.collect_set("name")).alias("variants"),
        ordered("source").alias("sources"),
        ordered("context").alias("contexts"),
        F.array_sort(F.collect_set("original")).alias("original_forms"),
        F.min("seq").alias("pos"),
    )


def bucket(frequency: Column) -> Column:
    return F.when(frequency == 1, "1").when(frequency <= 3, "2-3").when(frequency <= 10, "4-10").otherwise(">10")


def statistics(file: DataFrame) -> DataFrame:
    """(kind, value, entities, mentions, example): by type and by frequency, and totals of the authority file."""
    first = Window.partitionBy("type").orderBy("pos", "name")
    shown = file.withColumn("r", F.row_number().over(first))
    by_type = shown.groupBy(F.lit("type").alias("kind"), F.col("type").alias("value")).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("frequency").alias("mentions"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "name")))), lambda x: x["name"]), "; ").alias("examples"),
    )
    none = F.lit("").alias("examples")
    by_frequency = file.groupBy(F.lit("frequency").alias("kind"), bucket(F.col("frequency")).alias("value")).agg(F.count(F.lit(1)).alias("entities"), F.sum("frequency").alias("mentions")).withColumn("examples", F.lit(""))
    several = file.where(F.size("variants") > 1).agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum(F.size("variants") - 1), F.lit(0)).alias("mentions"))
    merged = several.select(F.lit("with_variants").alias("kind"), F.lit("").alias("value"), "entities", "mentions", none)
    return by_type.unionByName(by_frequency).unionByName(merged)
