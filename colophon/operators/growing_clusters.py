"""Clusters of names that grow by batches, equal to those of one pass over all batches one after the other.

A name that leads keeps its place whatever comes later, and one that follows never leads.  So a new name has to meet
the leaders of earlier batches, which a kept index finds by pairs of rare characters, and, if it is similar to none of
them, the other new names.  Work on pairs is the batch's, not the table's; names known already are only counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import MissingInput
from ..functions import similarity
from ..sources.growing import GrowingTables
from . import clustering

_ORDER = StructType().add("g", "string").add("n", "long")
_INDEX = StructType().add("id", "long").add("n", "integer").add("g", "string")
_MEMBERS = StructType().add("name", "string").add("leader", "string")


class GrowingClusters:
    """Clusters kept below ``folder``: mentions, names, members, and the index of leaders, all by batch.

    A name's place is its batch, then its place inside.  Rows without a name are left out; a batch without rows adds
    nothing.  The characters' order is fixed by the first batch that has names, where unknown ones count as rarest;
    another order would find the same pairs, with more or fewer candidates.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: float = 85, similarity_of: clustering.Similarity = similarity.fast_ratio):
        if threshold <= 0:
            raise ValueError("a threshold above 0 is needed: everything is similar at 0")
        self.threshold, self.similarity_of = float(threshold), similarity_of
        self.tables = GrowingTables(spark, folder, f"threshold {float(threshold)}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take mentions (name, seq, any other columns) as batch ``batch``; one that was taken already changes nothing.

        Fits ``streaming.ingest``: a stream hands a lost batch over again under its number.
        """
        t = self.tables
        if not t.is_new(batch):
            return
        rows = t.write("mentions", rows.where("name IS NOT NULL"), batch)
        found = clustering.distinct_names(rows).select(F.monotonically_increasing_id().alias("id"), "name", "pos", "key")
        known = t.read("names", found.schema)
        new = t.write("names", found.join(known.select("name"), "name", "left_anti").select("id", "name", "pos", "key"), batch)
        order = t.read("order", _ORDER).drop("batch")
        if order.limit(1).count():
            t.write("order", order.limit(0), batch)
        else:
            order = t.write("order", clustering.gram_counts(new), batch)
        keys = t.write("keys", self._keys(new, order), batch)
        led = t.write("led", self._beside_leaders(new, keys, known), batch)
        free = new.join(led, "name", "left_anti")
        own = clustering.leaders(free, clustering.similar_pairs(free, self.threshold, self.similarity_of))
        members = t.write("members", own.select("name", "leader").unionByName(led), batch)
        leading = new.join(members.where("name = leader"), "name", "left_semi").select("id")
        t.write("index", keys.join(leading, "id", "left_semi"), batch)
        t.commit(batch)

    def _keys(self, names: DataFrame, order: DataFrame) -> DataFrame:
        """(id, n, g): the keys of names, and how long these are."""
        keys = clustering.candidate_keys(names, clustering.share(self.threshold), order)
        return keys.join(names.select("id", F.length("key").alias("n")), "id").select("id", "n", "g")

    def _beside_leaders(self, new: DataFrame, keys: DataFrame, known: DataFrame) -> DataFrame:
        """(name, leader) of new names that a leader of an earlier batch is similar to: the earliest of these."""
        index = self.tables.read("index", _INDEX).select(F.col("id").alias("old_id"), F.col("batch").alias("old_batch"), F.col("n").alias("old_n"), "g")
        fits = clustering.lengths_fit("n", "old_n", self.threshold)
        met = keys.join(index, "g").where(fits).select("id", "old_batch", "old_id").distinct()
        old = known.select(F.col("batch").alias("old_batch"), F.col("id").alias("old_id"), F.col("name").alias("old_name"), F.col("pos").alias("old_pos"), F.col("key").alias("old_key"))
        both = met.join(new.select("id", "name", "key"), "id").join(old, ["old_batch", "old_id"])
        near = both.where(similarity.may_reach(F.col("key"), F.col("old_key"), self.threshold)).where(self.similarity_of(F.col("old_key"), F.col("key")) >= self.threshold)
        return near.groupBy("name").agg(F.min_by("old_name", F.struct("old_batch", "old_pos", "old_name")).alias("leader"))

    def _read(self, name: str) -> DataFrame:
        path = f"{self.tables.folder}/{name}"
        if self.tables.last() is None:
            raise MissingInput(f"no batch in {self.tables.folder}")
        return self.tables.read(name, self.tables.spark.read.parquet(path).schema)

    def clusters(self) -> DataFrame:
        """(name, leader, canonical, mentions, pos) over all committed batches; pos has the batch and the place in it."""
        counts = self._read("mentions").groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))
        names = self._read("names").select("name", F.struct("batch", "pos").alias("pos"))
        return clustering.with_canonical(self.tables.read("members", _MEMBERS).drop("batch").join(names, "name").join(counts, "name"))

    def entries(self) -> DataFrame:
        """Every mention with the canonical name of its cluster, as rows; ``clustering.entries`` for one batch."""
        rows = self._read("mentions").withColumn("seq", F.struct("batch", "seq"))
        return rows.join(self.clusters().select("name", "canonical"), "name")
