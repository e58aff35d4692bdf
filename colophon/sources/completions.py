"""Calls to a model, made where the rows are; answers are a table before anything else uses them."""

from __future__ import annotations

import hashlib
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BatchError, PermanentError, TransientError
from ..functions.pricing import usage_of

ANSWER = "custom_id string, content string, finish_reason string, prompt bigint, completion bigint, cached bigint, seconds double, retries int, error string"
_ANSWER = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (x.split(" ") for x in ANSWER.split(", "))])
#: Answers and their characters that a task holds before it hands them on.
HELD_ROWS, HELD_CHARS = 500, 1 << 20


@dataclass(frozen=True)
class Answer:
    content: str
    prompt: int = 0
    completion: int = 0
    cached: int = 0
    finish_reason: str | None = None


class Provider(ABC):
    """Made anew in each task by a factory, so clients are never shipped."""

    @abstractmethod
    def complete(self, model: str, messages: list[dict], max_tokens: int, temperature: float) -> Answer: ...


class ScriptedProvider(Provider):
    """Answers by the content of the last message, whatever the order of calls: for tests and dry runs."""

    def __init__(self, answers: dict[str, str] | Callable[[str], str], usage: tuple[int, int] = (10, 5)):
        self.answers, self.usage = answers, usage

    def complete(self, model, messages, max_tokens, temperature):
        asked = messages[-1]["content"]
        got = self.answers(asked) if callable(self.answers) else self.answers.get(hashlib.sha256(asked.encode()).hexdigest(), self.answers.get(asked))
        if got is None:
            raise PermanentError("no scripted answer")
        return Answer(got, *self.usage)


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    base: float = 1.0
    most: float = 30.0

    def delay(self, attempt: int) -> float:
        """Seconds to wait after the given attempt."""
        return min(self.most, self.base * 2 ** (attempt - 1))


def is_transient(error: Exception) -> bool:
    """Worth another try: rate limits, server errors, time-outs and broken connections."""
    if isinstance(error, TransientError | TimeoutError | ConnectionError):
        return True
    status = getattr(error, "status_code", None)
    if status is not None:
        return status == 429 or status >= 500
    name = type(error).__name__.lower()
    return any(x in name for x in ("timeout", "ratelimit", "connection", "unavailable"))


def call(work: Callable[[], Answer], retry: Retry, sleep: Callable[[float], None] = time.sleep) -> tuple[Answer | None, str | None, int]:
    """(answer, error, retries): only errors that may pass are tried again."""
    for attempt in range(1, retry.attempts + 1):
        try:
            return work(), None, attempt - 1
        except Exception as e:
            if attempt == retry.attempts or not is_transient(e):
                return None, f"{type(e).__name__}: {e}", attempt - 1
            sleep(retry.delay(attempt))
    raise AssertionError


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ANSWER.types)], schema=_ANSWER)


def complete(requests: DataFrame, factory: Callable[[], Provider], retry: Retry = Retry(), throttle: float = 0.0) -> DataFrame:
    """An answer or an error for each request (custom_id, model, messages, max_tokens, temperature).

    Retries happen inside a row, not by Spark's task retry, which would pay for a whole partition again.  Write the
    result before using it.
    """

    def run(batches):
        provider, rows, held = factory(), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                # one row at a time leaves the batch: its prompts are long
                r = batch.slice(i, 1).to_pylist()[0]
                began = time.monotonic()
                got, error, retries = call(lambda: provider.complete(r["model"], r["messages"], r["max_tokens"], r["temperature"]), retry)
                got = got or Answer("")
                rows.append((r["custom_id"], got.content if error is None else None, got.finish_reason, got.prompt, got.completion, got.cached, time.monotonic() - began, retries, error))
                held += len(got.content or "") + len(error or "")
                if throttle:
                    time.sleep(throttle)
                if len(rows) >= HELD_ROWS or held >= HELD_CHARS:
                    yield _answers(rows)
                    rows, held = [], 0
        if rows:
            yield _answers(rows)

    return requests.select("custom_id", "model", "messages", "max_tokens", "temperature").mapInArrow(run, ANSWER)


def messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def write_batch(requests: DataFrame, path: str, url: str = "/v1/chat/completions") -> None:
    """Lines of a batch file; an empty batch or an id used twice is an error."""
    from ..operators.usage import duplicate_ids

    if not requests.limit(1).count():
        raise BatchError("the batch is empty")
    if twice := duplicate_ids(requests).limit(1).collect():
        raise BatchError(f"id used twice: {twice[0]['custom_id']}")
    body = F.struct("model", "messages", "max_tokens", "temperature")
    requests.select(F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))).alias("value")).write.mode("overwrite").text(path)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of a batch result file: an answer where there are choices, or else the error's text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if lines.where(F.try_parse_json("value").isNull()).limit(1).count():
        raise BatchError(f"{path} has a line that is no JSON")
    return outcomes(lines)


def outcomes(lines: DataFrame) -> DataFrame:
    body = F.get_json_object("value", "$.response.body")
    status = F.coalesce(F.get_json_object("value", "$.response.status_code").cast("int"), F.lit(200))
    answered = (status == 200) & F.get_json_object(body, "$.choices[0]").isNotNull()
    told = F.coalesce(F.get_json_object("value", "$.error"), body, F.lit("no response"))
    error = F.when(~answered, F.concat(F.lit("status "), status.cast("string"), F.lit(": "), F.left(told, F.lit(500))))
    used = usage_of(body)
    return lines.select(
        F.get_json_object("value", "$.custom_id").alias("custom_id"),
        F.when(answered, F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.lit(""))).alias("content"),
        F.get_json_object(body, "$.choices[0].finish_reason").alias("finish_reason"),
        F.when(answered, used["prompt"]).otherwise(0).alias("prompt"),
        F.when(answered, used["completion"]).otherwise(0).alias("completion"),
        F.when(answered, used["cached"]).otherwise(0).alias("cached"),
        error.alias("error"),
    )


def wait_for(status: Callable[[], str], interval: float = 60.0, most: float = 86_400.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """Return when a remote batch is completed; failure, expiry, cancellation and the time-out are errors."""
    waited = 0.0
    while (state := status()) != "completed":
        if state in ("failed", "expired", "cancelled"):
            raise BatchError(f"the batch is {state}")
        if waited >= most:
            raise BatchError(f"the batch is {state} after {waited:.0f} s")
        sleep(interval)
        waited += interval


def finished(content: Column, finish_reason: Column, required: list[str]) -> Column:
    """What is wrong with an answer: cut off, unreadable, or without a required key; null if nothing."""
    from ..functions import json_repair

    fields = json_repair.repaired(content)
    missing = json_repair.missing_keys(fields, required)
    return F.when(finish_reason == "length", "cut off").when(fields.isNull(), "no JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
