"""Workflow files: a JSON array of items with a trailer of run statistics, and tables of workbook sheets."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError
from .json_array import read_elements

#: Fixed: columns of the analysis sheet.
SHEET = ["title", "creator", "date", "department", "abstract", "subjects", "type", "access", "publisher", "sponsor", "language", "named_entities", "geographic_entities", "content_warning"]
_ANALYSIS = ", ".join(f"{c}: {'array<string>' if c in ('subjects', 'named_entities', 'geographic_entities') else 'string'}" for c in SHEET)
ITEM = f"filename string, file_path string, analysis struct<{_ANALYSIS}, raw_response: string>"
STATS = "total_requests bigint, total_input_tokens bigint, total_output_tokens bigint, total_tokens bigint, processing_mode string"


def read_workflow(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items with item_index by position, api_stats) of a workflow file of any size."""
    schema = f"{ITEM}, api_stats struct<{', '.join(x.replace(' ', ': ', 1) for x in STATS.split(', '))}>"
    rows = read_elements(spark, path).select("index", F.from_json("value", f"struct<{', '.join(_colon(x) for x in _split(schema))}>").alias("item"))
    items = rows.where("item.api_stats IS NULL").select("item.*", F.col("index").alias("item_index")).drop("api_stats")
    return items, rows.where("item.api_stats IS NOT NULL").select("item.api_stats.*")


def _split(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def _colon(field: str) -> str:
    name, _, kind = field.partition(" ")
    return f"{name}: {kind}"


def export_workflow(items: DataFrame, stats: DataFrame, path: str) -> None:
    """One JSON file for other tools, written beside its place and moved there; Parquet stays the record of truth.

    Items come one partition at a time, so the driver holds no more than that.
    """
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write("[")
            first = True
            ordered = items.orderBy("item_index").drop("item_index").select(F.to_json(F.struct("*")).alias("j"))
            trailer = stats.select(F.to_json(F.struct(F.struct("*").alias("api_stats"))).alias("j"))
            for source in (ordered, trailer):
                for row in source.toLocalIterator():
                    out.write(("" if first else ",") + "\n" + json.dumps(json.loads(row["j"]), indent=2, ensure_ascii=False))
                    first = False
            out.write("\n]\n")
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.remove(name)
        raise


def analysis_sheet(items: DataFrame) -> DataFrame:
    """One flat row per item; lists joined by commas."""
    cols = [F.array_join(f"analysis.{c}", ", ").alias(c) if c in ("subjects", "named_entities", "geographic_entities") else F.col(f"analysis.{c}").alias(c) for c in SHEET]
    return items.select("item_index", "filename", *cols)


def raw_sheet(items: DataFrame) -> DataFrame:
    return items.select("item_index", "filename", F.col("analysis.raw_response").alias("raw_response"))


def issues_sheet(failed: DataFrame, skipped: DataFrame) -> DataFrame:
    """Failed documents and skipped files: name, problem."""
    a = failed.select(F.col("filename").alias("name"), F.col("error").alias("problem"))
    return a.unionByName(skipped.select(F.col("path").alias("name"), F.col("reason").alias("problem")))


def find_column(columns: list[str], *needles: str) -> str | None:
    """The first column whose name holds all needles, whatever its case."""
    return next((c for c in columns if all(n.lower() in c.lower() for n in needles)), None)


def terms_of_sheet(sheet: DataFrame) -> DataFrame:
    """kind, subject, term_pos, term: vocabulary columns of a sheet, keyed by the row's subject or place cell."""
    from ..functions.terms import from_cell

    out = None
    for kind, key, cell in (("subject", find_column(sheet.columns, "subjects"), find_column(sheet.columns, "subject vocabulary")), ("place", find_column(sheet.columns, "geographic entities"), find_column(sheet.columns, "geographic vocabulary"))):
        if key and cell:
            rows = sheet.select(F.lit(kind).alias("kind"), F.trim(key).alias("subject"), F.posexplode(from_cell(F.col(cell))).alias("term_pos", "term")).where("subject <> ''")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FormatError("no vocabulary column")
    return out


def terms_of_json(spark: SparkSession, path: str) -> DataFrame:
    """kind, subject, term_pos, term of a JSON file: a flat map, or maps for subjects and places."""
    from ..functions.terms import from_json

    rows = spark.read.text(path, wholetext=True)
    two = F.get_json_object("value", "$.subject_to_terms")
    subject = F.coalesce(two, F.col("value"))
    place = F.when(two.isNotNull(), F.get_json_object("value", "$.geographic_to_terms"))
    parts = [rows.select(F.lit(k).alias("kind"), F.explode(from_json(c)).alias("subject", "terms")) for k, c in (("subject", subject), ("place", place))]
    return parts[0].unionByName(parts[1]).select("kind", "subject", F.posexplode("terms").alias("term_pos", "term"))
