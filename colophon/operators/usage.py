"""Requests, answers and what they took."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_ids(requests: DataFrame, key: str = "custom_id") -> DataFrame:
    """Ids that stand for more than one request."""
    return requests.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_outcomes(requests: DataFrame, responses: DataFrame, key: str = "custom_id", missing: str = "no result for this request") -> DataFrame:
    """Each request with its response; one without any has an error that says so."""
    found = requests.join(responses.withColumn("__there", F.lit(True)), key, "left")
    error = F.when(F.col("__there").isNull(), F.lit(missing)).otherwise(F.col("error"))
    return found.withColumn("error", error).drop("__there")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row: documents, those that succeeded and failed, and tokens."""
    ok = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return outcomes.agg(F.count(F.lit(1)).alias("documents"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), total("prompt"), total("completion"), total("cached"), (F.coalesce(F.sum("prompt"), F.lit(0)) + F.coalesce(F.sum("completion"), F.lit(0))).alias("total_tokens"))


def efficiency(outcomes: DataFrame) -> DataFrame:
    """Per model: calls, tokens, cost, averages and rates; calls without a time don't count in its average.

    ``outcomes``: model, error, prompt, completion, cached, cost, seconds.
    """
    ok = F.col("error").isNull()
    rows = outcomes.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("succeeded"),
        F.coalesce(F.sum("prompt"), F.lit(0)).alias("prompt"), F.coalesce(F.sum("completion"), F.lit(0)).alias("completion"), F.coalesce(F.sum("cached"), F.lit(0)).alias("cached"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"),
    )
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tokens = F.col("prompt") + F.col("completion")
    return rows.withColumns(
        {
            "avg_tokens": per(tokens, F.col("calls")),
            "cost_per_success": per(F.col("cost"), F.col("succeeded")),
            "tokens_per_second": per(tokens, F.col("seconds")),
            "cost_per_minute": per(F.col("cost") * 60, F.col("seconds")),
            "calls_per_minute": per(F.col("calls") * 60.0, F.col("seconds")),
        }
    )


def api_breakdown(calls: DataFrame) -> DataFrame:
    """Per source and, with a null source, over all: requests, failures, time, terms, cache hits, rates.

    ``calls``: source, kind ('request' or 'cache'), success, seconds, terms.  A cache hit is no request.
    """
    asked = F.col("kind") == "request"
    rows = calls.rollup("source").agg(
        F.count_if(asked).alias("requests"), F.count_if(asked & F.col("success")).alias("succeeded"), F.count_if(asked & ~F.col("success")).alias("failed"),
        F.count_if(~asked).alias("cache_hits"), F.coalesce(F.sum(F.when(asked, F.col("seconds"))), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"),
    )
    rate = lambda a: F.when(F.col("requests") > 0, a / F.col("requests")).otherwise(0.0)
    return rows.withColumn("success_rate", rate(F.col("succeeded"))).withColumn("avg_seconds", rate(F.col("seconds")))


def subject_results(calls: DataFrame) -> DataFrame:
    """Per subject: terms in all, terms by source (as "source=n" in order), seconds.

    ``calls``: subject, source, terms, seconds.
    """
    by_source = calls.groupBy("subject", "source").agg(F.sum("terms").alias("terms"), F.sum("seconds").alias("seconds"))
    entry = F.concat_ws("=", "source", F.col("terms").cast("string"))
    return by_source.groupBy("subject").agg(F.sum("terms").alias("total_terms"), F.array_join(F.array_sort(F.collect_list(entry)), "; ").alias("by_source"), F.sum("seconds").alias("seconds"))


def source_counts(terms: DataFrame, sources: DataFrame) -> DataFrame:
    """Number of terms of each known source, zero included."""
    found = terms.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sources.join(found, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("terms"))


def coverage(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: subjects, those with and without terms, and the share with, in per cent."""
    has = terms.select("query").distinct().withColumn("has", F.lit(True))
    rows = asked.join(has, "query", "left").agg(F.count(F.lit(1)).alias("subjects"), F.count_if(F.col("has").isNotNull()).alias("with_terms"))
    rate = F.when(F.col("subjects") > 0, 100 * F.col("with_terms") / F.col("subjects")).otherwise(0.0)
    return rows.withColumn("without_terms", F.col("subjects") - F.col("with_terms")).withColumn("rate", F.round(rate, 4))


def upsert(base: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """``base`` with the columns of ``fixes`` put over its own where the key is in both."""
    columns = [c for c in fixes.columns if c != key]
    renamed = fixes.withColumnsRenamed({c: f"__{c}" for c in columns}).withColumn("__hit", F.lit(True))
    out = base.join(renamed, key, "left")
    return out.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def numbered(rows: DataFrame, order: list[str], name: str = "item_index") -> DataFrame:
    """Dense numbers from 0 in the given order.

    Rows are range-sorted, counted a partition, and numbered inside: no single task sees them all.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    from ..storage import cut

    sorted_rows = cut(sorted_rows)
    counts = sorted_rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__p").orderBy(*order)
    return sorted_rows.join(F.broadcast(before), "__p").withColumn(name, (F.row_number().over(inside) - 1 + F.col("__before")).cast("long")).drop("__p", "__before")


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.sum("n_selected").alias("selected"), F.sum("n_unmatched").alias("unmatched"), F.count_if("has_issue").alias("issues"))


