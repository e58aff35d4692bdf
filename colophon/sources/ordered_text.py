"""Text in a given order, written by many tasks.

A text is a list of sections, each a frame with a ``line`` column and the columns it is sorted by.  A section is range-
sorted and written as numbered parts, ``section=000/part-00000-...`` and so on: read one after the other they are the
text.  Heads of groups are rows of their own, which sort before their group's, so that no task has to know where the one
before it ended.  One file is an export: its bytes pass through the driver as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.usage import numbered
from ..storage import cut

Section = tuple[DataFrame, list[Column | str]]


def _sorted(section: Section) -> DataFrame:
    rows, order = section
    return rows.orderBy(*order, "line").select("line")


def write_parts(sections: list[Section], path: str) -> None:
    """Write a text in place of an earlier one; ties of the order go by the line, null lines are left out."""
    for number, (rows, order) in enumerate(sections):
        _sorted((rows.where("line IS NOT NULL"), order)).write.mode("overwrite").text(f"{path}/section={number:03d}")
    spark = sections[0][0].sparkSession
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(old):  # a folder a section
        name = status.getPath().getName()
        if name.startswith("section=") and int(name[8:]) >= len(sections):
            store.delete(status.getPath(), True)


def lines_of(sections: list[Section]) -> Iterator[str]:
    """The lines of a text that is not written, a partition at a time."""
    for rows, order in sections:
        for row in _sorted((rows.where("line IS NOT NULL"), order)).toLocalIterator():
            yield row["line"]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(number, file, bytes) of a written text's parts, in the order they are read; parts without a byte are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    place = F.struct(F.regexp_extract("path", r"section=(\d+)/", 1).alias("section"), F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"))
    parts = found.where("length > 0").select(place.alias("place"), F.col("path").alias("file"), F.col("length").alias("bytes"))
    return parts.select("place.section", "place.part", "file", "bytes").orderBy("section", "part")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, line) of a written text, numbered from 0 as they follow each other; parts are read in byte ranges."""
    at = F.col("_metadata.file_path")
    place = [F.regexp_extract(at, r"section=(\d+)/", 1).alias("section"), F.regexp_extract(at, r"part-(\d+)", 1).cast("int").alias("part"), F.col("_metadata.file_block_start").alias("start")]
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").text(path)
    rows = cut(found.select(F.col("value").alias("line"), *place, F.monotonically_increasing_id().alias("inside")))
    return numbered(rows, ["section", "part", "start", "inside"], "number").select("number", "line")


def export(spark: SparkSession, path: str, target: str) -> int:
    """One file of a written text, in any storage Spark writes to; how many bytes it has.

    It is written beside its place and moved there when it is whole.
    """
    sc = spark.sparkContext
    hadoop, conf = sc._jvm.org.apache.hadoop, sc._jsc.hadoopConfiguration()
    place = hadoop.fs.Path(target)
    beside = hadoop.fs.Path(place.getParent(), f".{place.getName()}.tmp")
    store = place.getFileSystem(conf)
    total, out = 0, store.create(beside, True)
    try:
        for part in manifest(spark, path).toLocalIterator():
            source = hadoop.fs.Path(part["file"])
            hadoop.io.IOUtils.copyBytes(source.getFileSystem(conf).open(source), out, 1 << 20, False)
            total += part["bytes"]
    finally:
        out.close()
    store.delete(place, False)
    store.rename(beside, place)
    return total
