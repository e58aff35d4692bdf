"""Prices of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: dollars for 1000 tokens of input, output and cached input.
PRICES = {
    "gpt-4o": (0.0025, 0.01, 0.00125),
    "gpt-4o-2024-08-06": (0.0025, 0.01, 0.00125),
    "gpt-4o-mini": (0.00015, 0.0006, 0.000075),
    "gpt-4o-mini-2024-07-18": (0.00015, 0.0006, 0.000075),
    "gpt-4.1": (0.002, 0.008, 0.0005),
    "gpt-4.1-2025-04-14": (0.002, 0.008, 0.0005),
    "gpt-4.1-mini": (0.0004, 0.0016, 0.0001),
    "gpt-4.1-mini-2025-04-14": (0.0004, 0.0016, 0.0001),
}
BATCH_DISCOUNT = 0.5


def price_table(spark: SparkSession, prices: dict[str, tuple] | None = None) -> DataFrame:
    """model, input_per_1k, output_per_1k, cached_per_1k, batch_discount."""
    rows = [(m, float(a), float(b), None if c is None else float(c), BATCH_DISCOUNT) for m, (a, b, c) in (prices or PRICES).items()]
    return spark.createDataFrame(rows, "model string, input_per_1k double, output_per_1k double, cached_per_1k double, batch_discount double")


def cost(prompt: Column, completion: Column, cached: Column, batch: Column) -> Column:
    """Dollars of a call, given the columns of its row in the price table; cached tokens are part of the prompt."""
    cached = F.least(cached, prompt)
    rate = F.coalesce("cached_per_1k", "input_per_1k")
    whole = (prompt - cached) / 1000 * F.col("input_per_1k") + completion / 1000 * F.col("output_per_1k") + cached / 1000 * rate
    return F.when(batch, whole * F.col("batch_discount")).otherwise(whole)


def with_cost(usage: DataFrame, prices: DataFrame, fallback: str | None = None) -> DataFrame:
    """``usage`` (model, prompt, completion, cached, batch) with its cost; null for an unknown model without fallback."""
    prices = F.broadcast(prices)  # a hand-written table of a few rows
    named = usage.join(prices.select(F.col("model").alias("__known")), F.col("model") == F.col("__known"), "left")
    named = named.withColumn("__priced", F.coalesce("__known", F.lit(fallback).cast("string")))
    priced = named.join(prices.withColumnRenamed("model", "__m"), F.col("__priced") == F.col("__m"), "left")
    return priced.withColumn("cost", cost(F.col("prompt"), F.col("completion"), F.col("cached"), F.col("batch"))).select(*usage.columns, "cost")


def usage_of(body: Column) -> Column:
    """STRUCT(prompt, completion, cached) of a response's JSON; what is missing counts as 0."""
    count = lambda path: F.coalesce(F.get_json_object(body, path).cast("long"), F.lit(0).cast("long"))
    return F.struct(count("$.usage.prompt_tokens").alias("prompt"), count("$.usage.completion_tokens").alias("completion"), count("$.usage.prompt_tokens_details.cached_tokens").alias("cached"))
