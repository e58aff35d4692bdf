"""Documents in a folder of text and PDF files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MissingInput
from ..operators.usage import numbered

DOCUMENT = "doc_id string, filename string, path string, text string, reason string"


def pdf_text(content: bytes) -> str:
    """Text of a PDF file; the library is only needed where PDF files are read."""
    import io

    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(content))


def read_folder(spark: SparkSession, folder: str, pdf_reader: Callable[[bytes], str] = pdf_text) -> tuple[DataFrame, DataFrame]:
    """(documents: item_index, doc_id, filename, path, text; skipped: path, reason).

    Files ending in .txt or .pdf in any case, not in sub-folders, numbered by path.  Text must be UTF-8; a file that
    can't be read is skipped with its reason.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.{txt,pdf,TXT,PDF,Txt,Pdf}").load(folder)
    except Exception as e:
        raise MissingInput(f"no folder {folder}: {e}") from e
    files = files.select("path", "content", F.element_at(F.split("path", "/"), -1).alias("filename"))
    texts = files.where(F.lower("filename").endswith(".txt"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    texts = texts.select(F.col("filename").alias("doc_id"), "filename", "path", F.when(valid, F.decode("content", "UTF-8")).alias("text"), F.when(~valid, "not valid UTF-8").alias("reason"))

    def read(batches):
        for pdf in batches:
            rows = []
            for path, name, content in zip(pdf["path"], pdf["filename"], pdf["content"]):
                try:
                    rows.append((name, name, path, pdf_reader(content), None))
                except Exception as e:  # any fault of a file or of the reader skips just that file
                    rows.append((name, name, path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "filename", "path", "text", "reason"])

    pdfs = files.where(F.lower("filename").endswith(".pdf")).mapInPandas(read, DOCUMENT)
    rows = texts.unionByName(pdfs)
    good = numbered(rows.where("reason IS NULL").drop("reason"), ["path"])
    return good, rows.where("reason IS NOT NULL").select("path", "reason")


def missing_texts(failed: DataFrame, documents: DataFrame) -> DataFrame:
    """The texts of failed rows again, by path; reason where there is none."""
    found = failed.join(documents.select("path", "text"), "path", "left")
    return found.withColumn("reason", F.when(F.col("text").isNull(), "the file cannot be read"))
