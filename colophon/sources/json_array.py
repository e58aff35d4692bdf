"""Large JSON arrays read in byte ranges.

A file is split at closing braces, which Spark's text reader does range by range, wherever the file lies.  No escape
of a string ends at a brace, so what a piece means depends on one bit only: does it start inside a string?  Each piece
says for itself how many quotes it has and how it changes the depth of brackets in either case; sums over ranges and
then inside each range (a prefix scan) give the state at every piece.  An element ends where the depth is one again.
Only the pieces of one element ever come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FormatError, MissingInput
from ..storage import written

#: What may stand between elements: commas, white space, and the brackets of the array itself.
_BETWEEN = r"[\s,\[\]\x{FEFF}]*"


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _depth(outside: Column) -> Column:
    return _count(outside, "{") + _count(outside, "[") - _count(outside, "]")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, pos, value, quotes, and the change of depth if the piece starts outside (out) or inside a string (ins)."""
    try:
        lines = spark.read.option("lineSep", "}").text(path)
    except Exception as e:
        raise MissingInput(f"no file {path}: {e}") from e
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # escapes are neither quotes nor ends of strings
    closed = lambda c: F.regexp_replace(c, r'"[^"]*("|$)', "")
    rows = lines.withColumn("bare", bare).withColumn("quotes", _count(F.col("bare"), '"'))
    return written(rows.withColumns({"out": _depth(closed(F.col("bare"))), "ins": _depth(closed(F.regexp_replace("bare", r'^[^"]*"?', "")))}).drop("bare"))


def _before(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: the sum of ``column`` over all earlier pieces of the file; ranges are summed first (one row each)."""
    ranges = rows.groupBy("file", "block").agg(F.sum(column).alias("__n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("file", "block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    own = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, ["file", "block"]).withColumn(name, F.col("__base") + F.coalesce(F.sum(column).over(own), F.lit(0))).drop("__base")


def split_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, index, value of each object of the arrays at ``path``; file, error of what is no array of objects).

    ``index`` counts from 0 in each file.  A file may hold several arrays, one after the other.
    """
    pieces = _pieces(spark, path)
    rows = _before(pieces.select("file", "block", "pos", "quotes", "out", "ins"), "quotes", "quotes_before")
    last = rows.groupBy("file").agg(F.max(F.struct("block", "pos")).alias("last"))  # has no brace after it
    inside = (F.col("quotes_before") % 2) == 1
    braced = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0) & (F.struct("block", "pos") < F.col("last"))
    rows = rows.join(last, "file").withColumn("closes", braced).withColumn("change", F.when(inside, F.col("ins")).otherwise(F.col("out")) - braced.cast("int"))
    rows = written(rows.select("file", "block", "pos", "quotes", "change", "closes"))
    rows = _before(rows, "change", "depth")
    rows = rows.withColumn("ends", (F.col("closes") & (F.col("depth") + F.col("change") == 1)).cast("int"))
    rows = _before(written(rows.select("file", "block", "pos", "ends")), "ends", "index")
    joined = pieces.select("file", "block", "pos", "value").join(rows, ["file", "block", "pos"])
    found = joined.groupBy("file", "index").agg(F.max("ends").alias("whole"), F.array_sort(F.collect_list(F.struct("block", "pos", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "}")
    found = written(found.select("file", "index", "whole", F.when(F.col("whole") == 1, F.concat(F.regexp_replace(text, f"^{_BETWEEN}", ""), F.lit("}"))).otherwise(text).alias("value")))
    elements = found.where("whole = 1").select("file", "index", "value")
    bad = elements.where(F.try_parse_json("value").isNull() | ~F.startswith("value", F.lit("{"))).select("file", F.concat(F.lit("element "), F.col("index").cast("string"), F.lit(" is no JSON object")).alias("error"))
    rest = found.where("whole = 0").where(~F.col("value").rlike(f"^{_BETWEEN}$")).select("file", F.lit("not an array of objects").alias("error"))
    first = pieces.groupBy("file").agg(F.min(F.struct("block", "pos", "value"))["value"].alias("value"))
    opened = first.where(~F.col("value").rlike(r"^[\s\x{FEFF}]*\[")).select("file", F.lit("does not begin with [").alias("error"))
    end = found.groupBy("file").agg(F.max_by("value", F.struct("index", -F.col("whole"))).alias("value"))
    closed = end.where(~F.col("value").rlike(r"\]\s*$")).select("file", F.lit("does not end with ]").alias("error"))
    return elements, bad.unionByName(rest).unionByName(opened).unionByName(closed)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, index, value of each object; a file that is no array of objects is an error."""
    elements, errors = split_elements(spark, path)
    if wrong := errors.first():
        raise FormatError(f"{wrong['file']}: {wrong['error']}")
    return elements
