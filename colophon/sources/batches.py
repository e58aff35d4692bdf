"""Remote batches as tables: requests are planned, submitted, polled and collected, and a run that stops goes on there.

A request is its id and a hash of its body.  Tables below one folder, in any storage Spark writes to: ``requests`` and
``answers`` by batch, ``files`` with what is sent, and ``events``, one small row for each change of a batch's state.
What is already planned is found by an anti-join, so nothing is asked twice; a batch that was sent, but whose event
was not written, is found again by its key at the service.  Requests of a batch that failed may be planned anew.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..errors import BatchError
from ..operators.usage import duplicate_ids, numbered, with_outcomes
from .completions import read_batch, write_batch

#: Fixed: how a service says that a batch has ended without results.
LOST = ("failed", "expired", "cancelled")
EVENT = "batch string, state string, remote string, at double"
_ANSWER = "batch string, custom_id string, content string, finish_reason string, prompt bigint, completion bigint, cached bigint, error string"
_REQUEST = "batch string, custom_id string, body bigint"


class BatchService(Protocol):
    def find(self, key: str) -> str | None:
        """The remote id of the batch that was sent with this key, if one was."""

    def submit(self, key: str, path: str) -> str:
        """Send the lines of the files at ``path``; the remote id."""

    def status(self, remote: str) -> str: ...

    def result(self, remote: str) -> str:
        """Where Spark can read the lines of a completed batch."""


class Batches:
    """The batches of one step of a run; ``size`` requests each at most."""

    def __init__(self, spark: SparkSession, folder: str, service: BatchService, size: int = 50_000):
        self.spark, self.folder, self.service, self.size = spark, folder, service, size

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            found = self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)
        return found.withColumn("batch", F.col("batch").cast("string"))

    def states(self) -> dict[str, tuple[str, str | None]]:
        """State and remote id of each batch: a few rows a batch come to the driver."""
        rows = self._table("events", EVENT).groupBy("batch").agg(F.max_by("state", "at").alias("state"), F.max_by("remote", F.when(F.col("remote").isNotNull(), F.col("at"))).alias("remote"))
        return {r["batch"]: (r["state"], r["remote"]) for r in rows.collect()}

    def _note(self, batches: list[str], state: str, remote: str | None = None) -> None:
        rows = [(b, state, remote, time.time()) for b in batches]
        self.spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{self.folder}/events")

    def _planned(self) -> DataFrame:
        """batch, custom_id, body of the requests that are on their way or answered."""
        good = [b for b, (state, _) in self.states().items() if state not in LOST]
        return self._table("requests", _REQUEST).where(F.col("batch").isin(good)).select("batch", "custom_id", "body")

    @staticmethod
    def _named(requests: DataFrame) -> DataFrame:
        body = F.xxhash64(F.to_json(F.struct("model", "messages", "max_tokens", "temperature")))
        return requests.select("custom_id", "model", "messages", "max_tokens", "temperature", body.alias("body"))

    def plan(self, requests: DataFrame) -> list[str]:
        """Put the requests that are new into batches; their keys."""
        if twice := duplicate_ids(requests).limit(1).collect():
            raise BatchError(f"id used twice: {twice[0]['custom_id']}")
        new = self._named(requests).join(self._planned(), ["custom_id", "body"], "left_anti")
        start = uuid.uuid4().hex
        rows = numbered(new, ["custom_id"], "number").withColumn("batch", F.concat(F.lit(f"{start}-"), F.floor(F.col("number") / self.size).cast("string"))).drop("number")
        rows.repartition("batch").write.mode("append").partitionBy("batch").parquet(f"{self.folder}/requests")
        keys = [r["batch"] for r in self._table("requests", _REQUEST).where(F.startswith("batch", F.lit(start))).select("batch").distinct().collect()]
        if keys:
            self._note(keys, "planned")
        return keys

    def advance(self) -> int:
        """Take every batch as far as it goes now; how many are still on their way."""
        waiting = 0
        for batch, (state, remote) in sorted(self.states().items()):
            if state == "planned":
                remote = self.service.find(batch)
                if remote is None:
                    path = f"{self.folder}/files/{batch}"
                    write_batch(self.spark.read.parquet(f"{self.folder}/requests/batch={batch}"), path)
                    remote = self.service.submit(batch, path)
                self._note([batch], "submitted", remote)
            elif state == "collected" or state in LOST:
                continue
            now = self.service.status(remote)
            if now == "completed":
                answers = read_batch(self.spark, self.service.result(remote))
                answers.write.mode("overwrite").parquet(f"{self.folder}/answers/batch={batch}")
                self._note([batch], "collected")
            elif now in LOST:
                self._note([batch], now)
            else:
                waiting += 1
                if state not in ("planned", now):
                    self._note([batch], now)
        return waiting

    def finish(self, interval: float = 60.0, most: float = 86_400.0, sleep: Callable[[float], None] = time.sleep) -> None:
        """Wait until all batches have ended; one without results is an error, as is the time-out."""
        before, waited = self.states(), 0.0
        while waiting := self.advance():
            if waited >= most:
                raise BatchError(f"{waiting} batches are not done after {waited:.0f} s")
            sleep(interval)
            waited += interval
        lost = [f"{b} is {s}" for b, (s, _) in sorted(self.states().items()) if s in LOST and before.get(b, ("",))[0] not in LOST]
        if lost:
            raise BatchError("; ".join(lost))

    def outcomes(self, requests: DataFrame) -> DataFrame:
        """Each request with its answer, or with an error that says it has none."""
        mine = self._named(requests).select("custom_id", "body")
        found = mine.join(self._planned(), ["custom_id", "body"]).select("batch", "custom_id")
        answers = found.join(self._table("answers", _ANSWER), ["batch", "custom_id"]).drop("batch").dropDuplicates(["custom_id"])
        return with_outcomes(mine.select("custom_id"), answers)

    def complete(self, requests: DataFrame, interval: float = 60.0, most: float = 86_400.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
        """Plan what is new, wait for all of it, and give the outcomes."""
        self.plan(requests)
        self.finish(interval, most, sleep)
        return self.outcomes(requests)
