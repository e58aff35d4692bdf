"""Documents to records: requests, answers, normal records, and the repair of failed ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BatchError
from ..functions import json_repair, quality
from ..functions.text import clean_ocr, fill_template, strip
from ..sources.completions import Provider, Retry, complete, messages
from ..storage import cut
from . import chunking
from .usage import with_outcomes

SYSTEM = "You describe documents for a library catalogue. Answer with one JSON object."
USER = (
    "Return title, creator, date, department, abstract, subjects (list), type, access, publisher, sponsor, language, "
    "namedEntities (list of \"name (type)\"), geographicEntities (list) and contentWarning of this document.\n\n$text"
)


def requests(docs: DataFrame, model: str, max_tokens: int = 8000, temperature: float = 0.0, user: str = USER) -> tuple[DataFrame, DataFrame]:
    """(requests, documents that are empty when cleaned: doc_id, error)."""
    cleaned = docs.withColumn("clean", strip(clean_ocr(F.coalesce("text", F.lit("")))))
    empty = cleaned.where("clean = ''").select("doc_id", F.lit("empty document").alias("error"))
    asked = cleaned.where("clean <> ''").select(F.col("doc_id").cast("string").alias("custom_id"), F.lit(model).alias("model"), messages(F.lit(SYSTEM), fill_template(user, text=F.col("clean"))).alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"))
    return asked, empty


def records(answers: DataFrame) -> DataFrame:
    """custom_id, record, raw, error of each answer: unreadable, empty and shapeless answers are errors of the row."""
    fields = json_repair.repaired(F.col("content"))
    rows = answers.withColumn("fields", fields)
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(strip(F.coalesce("content", F.lit(""))) == "", "empty response")
        .when(F.col("fields").isNull(), "no JSON object in the response")
        .when(F.size("fields") == 0, "no metadata in the response")
    )
    record = F.when(error.isNull(), json_repair.record(F.col("fields")))
    keep = [c for c in ("prompt", "completion", "cached", "seconds", "retries") if c in answers.columns]
    return rows.select("custom_id", record.alias("record"), F.coalesce("content", F.lit("")).alias("raw"), error.alias("error"), *keep)


def extract(docs: DataFrame, factory: Callable[[], Provider], model: str, retry: Retry = Retry()) -> DataFrame:
    """Each document with its record or error; blank record where it failed.  Answers are kept before use."""
    asked, empty = requests(docs, model)
    answers = cut(complete(asked, factory, retry))
    done = records(answers).withColumnRenamed("custom_id", "__id").unionByName(empty.select(F.col("doc_id").cast("string").alias("__id"), "error"), allowMissingColumns=True)
    rows = docs.join(done, docs["doc_id"].cast("string") == F.col("__id"), "left").drop("__id")
    error = F.when(F.col("record").isNull(), F.coalesce("error", F.lit("no result for this request")))
    return rows.withColumn("error", error).withColumn("record", F.coalesce("record", json_repair.blank_record()))


def failures(items: DataFrame) -> DataFrame:
    """item_index, failure_reason of items (item_index, record, raw, keys) that need another try."""
    complete_ = quality.complete_record(quality.REQUIRED, F.col("record.title"), F.col("record.abstract")) & (F.size(F.array_except(F.array(*[F.lit(k) for k in quality.REQUIRED]), F.col("keys"))) == 0)
    reason = quality.failure_reason(F.col("record").isNotNull(), F.col("raw"), complete_, F.col("__top"))
    return items.withColumn("__top", quality.once_top(F.col("raw"))).withColumn("failure_reason", reason).where("failure_reason IS NOT NULL").drop("__top")


def histogram(failed: DataFrame) -> DataFrame:
    """failure_reason, items: most frequent first, then by first appearance."""
    return failed.groupBy("failure_reason").agg(F.count(F.lit(1)).alias("items"), F.min("item_index").alias("first")).orderBy(F.desc("items"), "first").drop("first")


def reprocess(failed: DataFrame, factory: Callable[[], Provider], model: str, retry: Retry = Retry(3, 4.0)) -> DataFrame:
    """New records for failed items (item_index, text); rows that fail again keep their error."""
    again = extract(failed.select(F.col("item_index").alias("doc_id"), "text"), factory, model, retry)
    return again.withColumnRenamed("doc_id", "item_index")




FRONT = (
    "Return title, creator, date, department, abstract, type, access, publisher, sponsor and language of the document "
    "that begins like this.\n\n$text"
)
ABSTRACT = "Return abstract (what of the document's abstract stands in this part) and abstract_complete (true or false).\n\n$text"
CHUNK = "Return subjects, namedEntities, geographicEntities and contentWarning of this part of a document.\n\n$text"


def _answers(pieces: DataFrame, prompt: str, factory, model: str, retry: Retry) -> DataFrame:
    """doc_id, chunk_index and the answer for each piece; kept before use."""
    key = F.to_json(F.struct("doc_id", "chunk_index"))
    asked = pieces.select(key.alias("custom_id"), F.lit(model).alias("model"), messages(F.lit(SYSTEM), fill_template(prompt, text=F.col("text"))).alias("messages"), F.lit(4000).alias("max_tokens"), F.lit(0.0).alias("temperature"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    got = cut(complete(asked, factory, retry))
    return got.withColumn("k", F.from_json("custom_id", f"doc_id {kind}, chunk_index int")).select("k.doc_id", "k.chunk_index", "content", "error", "prompt", "completion", "cached")


def extract_long(docs: DataFrame, factory: Callable[[], Provider], model: str, config: chunking.Chunking, retry: Retry = Retry()) -> DataFrame:
    """doc_id, record, raw, error, warnings of documents that are taken in chunks.

    The front matter gives the scalars; if its abstract goes on, chunks are asked for the rest one after the other,
    each round only for documents whose abstract is still open.  With ``full_scan`` every chunk gives subjects,
    entities and warnings, which are merged; without it a document has none.  Only a failed front matter fails the
    document.
    """
    pieces = cut(chunking.chunks(docs, config))
    head = pieces.where("chunk_index = -1")
    front = _answers(head, FRONT, factory, model, retry)
    front = front.withColumn("fields", json_repair.repaired(F.col("content")))
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(strip(F.coalesce("content", F.lit(""))) == "", "empty response").when(F.col("fields").isNull() | (F.size("fields") == 0), "no JSON object in the response")
    front = front.withColumn("error", bad).withColumn("record", F.when(bad.isNull(), json_repair.record(F.col("fields"))))
    front = cut(front.join(head.select("doc_id", "text"), "doc_id").select("doc_id", "record", "content", "error", chunking.looks_complete(F.coalesce("record.abstract", F.lit("")), F.col("text")).alias("complete")))
    good = front.where("error IS NULL")

    scans, still = None, good.where("NOT complete").select("doc_id")
    for i in range(config.abstract_chunks):
        got = _answers(pieces.where(F.col("chunk_index") == i).join(still, "doc_id", "left_semi"), ABSTRACT, factory, model, retry)
        fields = json_repair.repaired(F.col("content"))
        failed = F.col("error").isNotNull() | fields.isNull() | (F.size(fields) == 0)
        got = cut(got.select("doc_id", "chunk_index", "content", json_repair.value(fields, "abstract").alias("abstract"), F.coalesce(F.lower(json_repair.value(fields, "abstract_complete")) == "true", F.lit(False)).alias("complete"), F.coalesce(failed, F.lit(True)).alias("failed")))
        scans = got if scans is None else scans.unionByName(got)
        still = cut(got.where("NOT complete AND NOT failed").select("doc_id"))
    fronts = good.select("doc_id", F.col("record.abstract").alias("abstract"), "complete")
    parts = good.select("doc_id", F.lit(-1).alias("at"), "content")
    if scans is None:
        told = fronts.select("doc_id", F.coalesce("abstract", F.lit("")).alias("abstract"), F.lit(True).alias("done"))
    else:
        told = chunking.stitched_abstract(fronts, scans, config.abstract_chunks)
        parts = parts.unionByName(scans.where("content IS NOT NULL").select("doc_id", F.col("chunk_index").alias("at"), "content"))

    none = F.array().cast("array<string>")
    rows = front.join(told, "doc_id", "left")
    warnings = F.when(~F.coalesce("done", F.lit(True)), F.array(F.lit(f"abstract not confirmed complete after {config.abstract_chunks} chunk(s)"))).otherwise(none)
    if config.full_scan:
        got = _answers(pieces.where("chunk_index >= 0").join(good.select("doc_id"), "doc_id", "left_semi"), CHUNK, factory, model, retry)
        fields = json_repair.repaired(F.col("content"))
        got = got.withColumn("r", F.when(F.col("error").isNull() & (F.size(fields) > 0), json_repair.record(fields)))
        merged = chunking.merge(got.where("r IS NOT NULL").select("doc_id", "chunk_index", "r.subjects", "r.named_entities", "r.geographic_entities", "r.content_warning"))
        lost = got.where("r IS NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit(" failed")))).alias("lost"))
        parts = parts.unionByName(got.where("r IS NOT NULL").select("doc_id", (F.col("chunk_index") + (1 << 20)).alias("at"), "content"))
        rows = rows.join(merged, "doc_id", "left").join(lost, "doc_id", "left")
        warnings = F.concat(warnings, F.coalesce("lost", none))
    else:
        rows = rows.select("*", none.alias("subjects"), none.alias("named_entities"), none.alias("geographic_entities"), F.lit("None").alias("content_warning"))
    raw = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n---\n").alias("raw"))
    lists = [F.coalesce(c, none).alias(c) for c in ("subjects", "named_entities", "geographic_entities")]
    scalars = [(F.col("abstract") if k == "abstract" else F.coalesce(F.col(f"record.{k}"), F.lit(""))).alias(k) for k in json_repair.SCALARS]
    record = F.struct(*scalars, *lists, F.coalesce("content_warning", F.lit("None")).alias("content_warning"))
    return rows.join(raw, "doc_id", "left").select("doc_id", F.when(F.col("error").isNull(), record).otherwise(json_repair.blank_record()).alias("record"), F.coalesce("raw", F.lit("")).alias("raw"), "error", warnings.alias("warnings"))


def extract_batch(docs: DataFrame, submit: Callable[[DataFrame], DataFrame], factory: Callable[[], Provider], model: str, on_failure: str = "raise") -> DataFrame:
    """The same by one remote batch: ``submit`` takes the requests and returns their outcomes (see ``read_batch``).

    Empty documents never enter the batch.  If the batch as a whole fails, that is the run's error, or, with
    ``on_failure="individual"``, documents are asked one by one.
    """
    asked, empty = requests(docs, model)
    try:
        answers = cut(submit(asked))
    except BatchError:
        if on_failure != "individual":
            raise
        return extract(docs, factory, model)
    done = records(with_outcomes(asked.select("custom_id"), answers)).withColumnRenamed("custom_id", "__id")
    done = done.unionByName(empty.select(F.col("doc_id").cast("string").alias("__id"), "error"), allowMissingColumns=True)
    rows = docs.join(done, docs["doc_id"].cast("string") == F.col("__id"), "left").drop("__id")
    return rows.withColumn("record", F.coalesce("record", json_repair.blank_record()))
