"""Mixing sources to target weights by weighted fair queueing.

Every source emits its documents in a shuffled order (md5 of the id, or of the text where that is null), over and over.  A copy's virtual finish time
is the number of source tokens up to and including it, divided by the source's target; all sources reach time 1
when they have given what they should.  Copies are range-sorted by finish time over all sources and cut at the
total budget.

Running sums never gather a source or the whole mix in one task: the first hexadecimal digits of the md5 (or the
finish time's leading digits) cut the order into ranges, range totals are summed first, and only inside a range
rows are sorted.  The number of ranges grows with the rows, so that a range holds about ROWS_PER_RANGE of them.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in
order; a source without words has target 0; rows with equal id, source and size are interchangeable; other columns
play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a range of a source's order, or of the virtual finish time, holds on average at most.
ROWS_PER_RANGE = 20_000


def range_digits(rows: int) -> int:
    """Hexadecimal digits of the md5 that cut a source's order into ranges."""
    return min(10, next(d for d in range(1, 40) if 16**d * ROWS_PER_RANGE >= rows))


def time_ranges(rows: int) -> int:
    """Ranges of a unit of virtual finish time, for so many documents: in all sources as many rows pass in a unit."""
    return max(16, rows // ROWS_PER_RANGE)


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_passes: int = 3, cycle: int = 3) -> DataFrame:
    """Per source: source_size, weight and target.

    Sources by code point, null last, weigh 1, 2, .. ``cycle``, repeating.  The budget is the sum of all sizes; a
    target stops at ``max_passes`` times the source's size and the excess goes to the others by weight.  A source
    stops exactly if its cap for each unit of weight is at most what the sources not yet stopped would get, in
    order of that ratio, so two running sums over the table of sources decide it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(order) - 1) % cycle + 1)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = F.lit(max_passes) * F.col("source_size")
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(onward))
        .withColumn("open", cap > F.col("level") * F.col("weight"))
        .withColumn("rate", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    )
    return per.select("source", "source_size", "weight", F.when(F.col("open"), F.col("rate") * F.col("weight")).otherwise(cap).cast("double").alias("target"))


def queue(docs: DataFrame, max_passes: int = 3, cycle: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and ``upto``: the source's tokens up to this document in one pass."""
    # rows without an id are told apart by their texts, so that they don't share one range of their source
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), F.coalesce("text", F.lit(""))))
    rows = materialize(docs.select("doc_id", "source", size_of().alias("size"), F.md5(name.cast("binary")).alias("shuffle")), "sizes")
    key = F.concat(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), F.lit("/"), F.substring("shuffle", 1, range_digits(rows.count())))
    rows = rows.withColumn("range", key)
    totals = materialize(rows.groupBy("range").agg(F.first("source").alias("source"), F.sum("size").alias("size")), "ranges")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    targets = source_targets(totals, max_passes, cycle).withColumnRenamed("source", "__source")
    sums = sums.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")
    inside = Window.partitionBy("range").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(sums, "range")
    return rows.withColumn("upto", F.col("upto") + F.col("before")).select("doc_id", "source", "size", "source_size", "target", "upto", "shuffle")


def copies(queued: DataFrame, max_passes: int = 3) -> DataFrame:
    """One row per copy a source would emit, with its virtual finish time."""
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1)))
    out = queued.where("size > 0 AND target > 0").withColumn("pass", passes)
    return out.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target"))


def cut_point(emitted: DataFrame, budget: DataFrame, ranges: int) -> DataFrame:
    """One row: the last copy (finish, shuffle, doc_id, pass, size) that fits into the budget in order of finish time."""
    slot = F.floor(F.col("finish") * ranges).cast("long")
    emitted = emitted.withColumn("slot", slot)
    totals = emitted.groupBy("slot").agg(F.sum("size").alias("n"))
    running = totals.withColumn("before", F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    last = running.crossJoin(F.broadcast(budget)).where("before < budget").agg(F.max(F.struct("slot", "before", "budget")).alias("m")).select("m.*")
    order = Window.partitionBy("slot").orderBy("finish", "shuffle", "doc_id", "pass", "size").rowsBetween(Window.unboundedPreceding, 0)
    fits = emitted.join(F.broadcast(last), "slot").withColumn("sum", F.col("before") + F.sum("size").over(order))
    inside = fits.where("sum <= budget").agg(F.max(F.struct("finish", "shuffle", "doc_id", "pass", "size")).alias("last"))
    # nothing of the last range may fit: everything before that range does
    return inside.crossJoin(F.broadcast(last.agg(F.max("slot").alias("slot"))))


def mix(docs: DataFrame, max_passes: int = 3, cycle: int = 3) -> tuple[DataFrame, DataFrame]:
    """(queued documents, copies that the mix takes: doc_id, source, size, pass, finish)."""
    queued = materialize(queue(docs, max_passes, cycle), "queue")
    budget = queued.agg(F.sum("size").alias("budget"))
    emitted, ranges = copies(queued, max_passes), time_ranges(queued.count())
    cut = materialize(cut_point(emitted, budget, ranges), "cut")
    here = F.struct("finish", "shuffle", "doc_id", "pass", "size")
    slot = F.floor(F.col("finish") * ranges).cast("long")
    taken = emitted.crossJoin(F.broadcast(cut)).where((slot < F.col("slot")) | ((slot == F.col("slot")) & (here <= F.col("last"))))
    return queued, taken.select("doc_id", "source", "size", "pass", "finish", "shuffle")


def mixed_counts(docs: DataFrame, max_passes: int = 3, cycle: int = 3) -> DataFrame:
    """Per document: size, source_size, target and taken (words the mix takes, repeats counted)."""
    queued = materialize(queue(docs, max_passes, cycle), "queue")
    budget = queued.agg(F.sum("size").alias("budget"))
    ranges = time_ranges(queued.count())
    cut = materialize(cut_point(copies(queued, max_passes), budget, ranges), "cut")
    out = queued.join(F.broadcast(cut), how="left")
    took = F.lit(0).cast("long")
    for k in range(max_passes):
        finish = (F.lit(k) * F.col("source_size") + F.col("upto")) / F.col("target")
        slot = F.floor(finish * ranges).cast("long")
        here = F.struct(finish.alias("finish"), "shuffle", "doc_id", F.lit(k).alias("pass"), "size")
        fits = (slot < F.col("slot")) | ((slot == F.col("slot")) & (here <= F.col("last")))
        took = took + F.when((F.col("size") > 0) & (F.col("target") > 0) & F.coalesce(fits, F.lit(False)), F.col("size")).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", took.alias("taken"), "source")


def mixed_stream(docs: DataFrame, max_passes: int = 3, cycle: int = 3) -> DataFrame:
    """All columns of ``docs``, one row per copy that the mix takes, range-sorted by virtual finish time.

    The join back to the texts is on (doc_id, source, size); rows that repeat all three are numbered, so each row
    gets its own copies.
    """
    queued, taken = mix(docs, max_passes, cycle)
    copy = taken.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("n"), "pass", "finish")
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "source", size_of().alias("size"))
    on = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("n"))
    if queued.groupBy("doc_id", "source", "size").count().where("count > 1").limit(1).count():
        copy = copy.withColumn("k", F.row_number().over(Window.partitionBy("id", "of", "n", "pass").orderBy("finish")))
        own = Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64(F.to_json("doc")))  # maps can be written, not hashed
        rows = rows.withColumn("own", F.row_number().over(own))
        on = on & (F.col("own") == F.col("k"))
    return rows.join(copy, on).repartitionByRange("finish").sortWithinPartitions("finish").select("doc.*")
