"""Long documents in overlapping chunks that end at sentences, and results of chunks put together again."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.json_repair import joined_warning
from ..functions.text import comparison_key, needs_chunking, strip


@dataclass(frozen=True)
class Chunking:
    enabled: bool = True
    whole_document: int = 400_000
    whole_document_tokens: int = 100_000
    front: int = 8_000
    size: int = 40_000
    overlap: int = 500
    full_scan: bool = False
    abstract_chunks: int = 3
    max_chunks: int | None = None

    def __post_init__(self) -> None:
        if min(self.whole_document, self.whole_document_tokens, self.front, self.size) <= 0:
            raise ConfigError("sizes must be positive")
        if not 0 <= self.overlap < self.size:
            raise ConfigError("the overlap must be at least 0 and below the chunk size")
        if self.abstract_chunks < 0 or (self.max_chunks or 0) < 0:
            raise ConfigError("numbers of chunks must not be negative")


#: Fixed: where a sentence or a paragraph ends.
BOUNDARY = r"[.!?][\"')\]]*\s|\n\n"


def cut_column(text: Column, start: Column, end: Column) -> Column:
    """Where a piece from ``start`` that should stop at ``end`` is cut: behind the last boundary in its back half.

    Boundaries are matched left to right without overlap: each is marked, and the last mark counts.
    """
    low = start + F.floor((end - start) / 2).cast("int")
    half = F.replace(F.substring(text, low + 1, end - low), F.lit("\x01"), F.lit(" "))
    marked = F.split(F.regexp_replace(half, f"(?U)({BOUNDARY})", "$1\x01"), "\x01")
    inside = end - F.length(F.element_at(marked, -1))
    return F.when(end >= F.length(text), F.length(text)).when(F.size(marked) > 1, inside).otherwise(end).cast("int")


def bounds_native(text: Column, config: Chunking) -> Column:
    """STRUCT(front_end, chunks ARRAY<STRUCT(start, end)>) without Python; starts and ends count within the body.

    A fold over as many steps as there can be chunks: each takes at least half a chunk less the overlap.
    """
    front = cut_column(text, F.lit(0), F.least(F.lit(config.front), F.length(text)))
    least = max(1, config.size // 2 - config.overlap)

    def chunks(front_end: Column) -> Column:
        body = F.substring(text, front_end + 1, F.lit(1 << 30))
        none = F.array().cast("array<struct<start: int, end: int>>")

        def step(done: Column, _: Column) -> Column:
            last = F.element_at(done, -1)
            start = F.when(F.size(done) == 0, 0).otherwise(F.greatest(last["end"] - config.overlap, last["start"] + 1))
            # one-element transforms bind a value once, where a lambda has no local names
            more = F.flatten(F.transform(F.array(start), lambda s: F.array(F.struct(s.alias("start"), cut_column(body, s, s + config.size).alias("end")))))
            finished = (F.size(done) > 0) & (F.coalesce(last["end"], F.lit(0)) >= F.length(body))
            return F.when(finished | (F.length(body) == 0), done).otherwise(F.concat(done, more))

        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.length(body) / least).cast("int")), none, step)

    return F.element_at(F.transform(F.array(front), lambda f: F.struct(f.alias("front_end"), chunks(f).alias("chunks"))), 1)


def bounds_of(text: str, config: Chunking) -> dict:
    """The same for one text, for use inside a batch function."""
    import re

    boundary = re.compile(BOUNDARY)

    def stop(body: str, start: int, end: int) -> int:
        if end >= len(body):
            return len(body)
        found = [m.end() for m in boundary.finditer(body, start + (end - start) // 2, end)]
        return found[-1] if found else end

    front = stop(text, 0, min(config.front, len(text)))
    body, out, start = text[front:], [], 0
    while start < len(body):
        end = stop(body, start, start + config.size)
        out.append({"start": start, "end": end})
        start = len(body) if end >= len(body) else max(end - config.overlap, start + 1)
    return {"front_end": front, "chunks": out}


def bounds(text: Column, config: Chunking) -> Column:
    """Chunk bounds over Arrow batches: the native fold repeats its text in each step and is slower."""

    @F.pandas_udf("front_end int, chunks array<struct<start: int, end: int>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bounds_of(t or "", config) for t in texts], columns=["front_end", "chunks"])

    return of(text)


def chunk_bounds(docs: DataFrame, config: Chunking, native: bool = False) -> DataFrame:
    """doc_id, front_end, chunk_index, start_pos, end_pos: one row per chunk."""
    found = docs.select("doc_id", (bounds_native if native else bounds)(F.col("text"), config).alias("b"))
    rows = found.select("doc_id", "b.front_end", F.posexplode("b.chunks").alias("chunk_index", "c"))
    return rows.select("doc_id", "front_end", "chunk_index", F.col("c.start").alias("start_pos"), F.col("c.end").alias("end_pos"))


def chunks(docs: DataFrame, config: Chunking) -> DataFrame:
    """doc_id, chunk_index (-1: front matter), text of each piece; at most ``max_chunks`` chunks of a document."""
    found = docs.select("doc_id", "text", bounds(F.col("text"), config).alias("b"))
    front = F.struct(F.lit(-1).alias("chunk_index"), F.left("text", F.col("b.front_end")).alias("text"))
    body = F.transform("b.chunks", lambda c, i: F.struct(i.alias("chunk_index"), F.substring(F.col("text"), F.col("b.front_end") + c["start"] + 1, c["end"] - c["start"]).alias("text")))
    rows = found.select("doc_id", F.explode(F.concat(F.array(front), body)).alias("p")).select("doc_id", "p.*")
    return rows if config.max_chunks is None else rows.where(F.col("chunk_index") < config.max_chunks)


def split_by_size(docs: DataFrame, config: Chunking) -> tuple[DataFrame, DataFrame]:
    """(documents to be taken whole, documents to be chunked)."""
    long = needs_chunking(F.col("text"), config.whole_document) if config.enabled else F.lit(False)
    return docs.where(~long), docs.where(long)


def first_by_key(rows: DataFrame, group: list[str], value: str, order: list[str], key: Column | None = None) -> DataFrame:
    """Of each group's values with an equal key (``comparison_key`` by default) the first in order."""
    keyed = rows.withColumn("__key", comparison_key(F.col(value)) if key is None else key)
    w = Window.partitionBy(*group, "__key").orderBy(*order)
    return keyed.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__key")


def merged_lists(results: DataFrame, column: str) -> DataFrame:
    """doc_id and the array of first values by key, over a document's chunks in order."""
    rows = results.select("doc_id", "chunk_index", F.posexplode(column).alias("pos", "value"))
    firsts = first_by_key(rows, ["doc_id"], "value", ["chunk_index", "pos"])
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "pos", "value")))
    return firsts.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["value"]).alias(column))


def merge(results: DataFrame) -> DataFrame:
    """Per document: subjects, named_entities, geographic_entities (first by key) and content_warning of its chunks."""
    bare = F.regexp_replace(strip(F.coalesce("content_warning", F.lit(""))), r"\.+$", "")
    said = results.withColumn("reasons", F.when((bare == "") | (F.lower(bare) == "none"), F.array().cast("array<string>")).otherwise(F.array(bare)))
    out = said.select("doc_id").distinct()
    none = F.array().cast("array<string>")
    for column in ("subjects", "named_entities", "geographic_entities", "reasons"):
        out = out.join(merged_lists(said, column), "doc_id", "left").withColumn(column, F.coalesce(column, none))
    return out.withColumn("content_warning", joined_warning(F.col("reasons"))).drop("reasons")


def stitched_abstract(front: DataFrame, scans: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, abstract, done: the front matter's abstract and the parts found in chunks up to the first complete one.

    ``front``: doc_id, abstract, complete.  ``scans``: doc_id, chunk_index, abstract, complete, failed (stops there).
    """
    scans = scans.where(F.col("chunk_index") < most)
    stop = scans.groupBy("doc_id").agg(
        F.min(F.when(F.col("complete") & ~F.col("failed"), F.col("chunk_index"))).alias("last"),
        F.min(F.when(F.col("failed"), F.col("chunk_index"))).alias("broken"),
    )
    parts = scans.join(stop, "doc_id").where((F.col("chunk_index") <= F.coalesce("last", F.lit(1 << 30))) & (F.col("chunk_index") < F.coalesce("broken", F.lit(1 << 30))))
    parts = parts.where(strip(F.coalesce("abstract", F.lit(""))) != "").select("doc_id", "chunk_index", strip(F.col("abstract")).alias("part"))
    first = front.where(strip(F.coalesce("abstract", F.lit(""))) != "").select("doc_id", F.lit(-1).alias("chunk_index"), strip(F.col("abstract")).alias("part"))
    open_front = front.where("NOT complete").select("doc_id")
    joined = first.unionByName(parts.join(open_front, "doc_id", "left_semi")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "part"))), lambda x: x["part"]), " ").alias("abstract"))
    done = F.col("complete") | (F.col("last").isNotNull() & (F.col("last") < F.coalesce("broken", F.lit(1 << 30))))
    return front.select("doc_id", "complete").join(joined, "doc_id", "left").join(stop, "doc_id", "left").select("doc_id", F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce(done, F.lit(False)).alias("done"))


def looks_complete(abstract: Column, text: Column, tail: int = 200) -> Column:
    """Does the text go on behind the end of the abstract?  An abstract that isn't quoted counts as complete."""
    key, whole = comparison_key(F.right(strip(abstract), F.lit(60))), comparison_key(text)
    found = F.instr(F.reverse(whole), F.reverse(key))
    return F.when(strip(F.coalesce(abstract, F.lit(""))) == "", False).when((key == "") | (found == 0), True).otherwise(found - 1 >= tail)
