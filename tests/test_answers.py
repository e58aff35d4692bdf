"""Requests leave a batch one by one, and answers leave a task before the whole batch is asked."""

from pyspark.sql import functions as F

from colophon.sources import completions
from colophon.sources.completions import Retry, ScriptedProvider, complete, messages


def test_answers_leave_in_parts(spark):
    rows = spark.range(0, 1300, 1, 1).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("custom_id"), F.lit("m").alias("model"), messages(F.lit("s"), F.repeat(F.col("id").cast("string"), 3)).alias("messages"), F.lit(5).alias("max_tokens"), F.lit(0.0).alias("temperature"))

    def answer(asked):
        return None if asked.endswith("7") else asked * 900

    done = complete(rows, lambda: ScriptedProvider(answer), Retry(1))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert done.schema.simpleString() == "struct<" + completions.ANSWER.replace(" ", ":").replace(",:", ",") + ">"
    got = {r.custom_id: r for r in done.collect()}
    assert len(got) == 1300
    for i in range(1300):
        r, bad = got[f"r{i}"], i % 10 == 7
        assert r.content == (None if bad else str(i) * 2700) and r.prompt == (0 if bad else 10) and r.retries == 0
        assert r.error == ("PermanentError: no scripted answer" if bad else None)
