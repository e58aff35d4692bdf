"""Tables that grow by numbered batches, in any storage Spark writes to.

A batch is a folder in each table, and counts once its commit is written, which happens last.  Readers see committed
batches only; a batch that was lost before its commit is written again over what it left, and one that is committed
is not taken twice.  Batches come in ascending order, as those of a stream do, so the last commit says it all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from ..errors import ConfigError

#: Fixed: name of the column (and folder) that tells batches apart.
BATCH = "batch"
_COMMITS = "note string, batch int"


class GrowingTables:
    """Tables below ``folder``.  ``note`` says how they are made; a folder made another way is an error."""

    def __init__(self, spark: SparkSession, folder: str, note: str = ""):
        self.spark, self.folder, self.note = spark, folder.rstrip("/"), note

    def last(self) -> int | None:
        """The last committed batch; None before the first."""
        try:
            commits = self.spark.read.schema(_COMMITS).parquet(f"{self.folder}/commits")
        except AnalysisException:  # nothing committed yet
            return None
        row = commits.agg(F.max(BATCH).alias("last"), F.max_by("note", BATCH).alias("note")).first()
        if row["last"] is not None and row["note"] != self.note:
            raise ConfigError(f"{self.folder} was made with {row['note']!r}, not {self.note!r}")
        return row["last"]

    def is_new(self, batch: int) -> bool:
        last = self.last()
        return last is None or batch > last

    def read(self, name: str, schema: StructType) -> DataFrame:
        """All committed rows of a table and their ``batch``; no rows where there are none."""
        whole = StructType([f for f in schema if f.name != BATCH] + [StructField(BATCH, IntegerType())])
        last = self.last()
        if last is None:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.folder}/{name}").where(F.col(BATCH) <= last)

    def write(self, name: str, rows: DataFrame, batch: int) -> DataFrame:
        """A batch's rows as they are written; they count from the commit on."""
        path = f"{self.folder}/{name}/{BATCH}={batch}"
        rows.drop(BATCH).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.drop(BATCH).schema).parquet(path)

    def commit(self, batch: int) -> None:
        self.spark.createDataFrame([(self.note,)], "note string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{BATCH}={batch}")


def newest(rows: DataFrame, *key: str) -> DataFrame:
    """The rows of the newest batch of each key: a key that comes again replaces what it was."""
    top = rows.groupBy(*key).agg(F.max(BATCH).alias(BATCH))
    return rows.join(top, [*key, BATCH], "left_semi")
