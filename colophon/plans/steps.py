"""The five steps over a run folder: each reads tables that earlier steps wrote, and writes its own."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, MissingInput
from ..functions import json_repair, quality, terms
from ..functions.text import clean_list, fill_template, truncate
from ..operators import chunking, clustering, extraction, lookup, usage
from ..sources import vocabularies, workbook, workflow
from ..sources.batches import Batches, BatchService
from ..sources.completions import Provider, Retry, complete, messages
from ..sources.growing import BATCH, GrowingTables, newest
from ..sources.ordered_text import Section, write_parts
from ..storage import cut
from . import reports, run

SELECT_SYSTEM = "You choose controlled-vocabulary terms for a catalogue record. Answer with one JSON object."
SELECT_USER = "Title: $title\nAbstract: $abstract\n\nCandidates:\n$candidates\nReturn {\"selected_terms\": [labels]}."
#: Fixed: the records' fields as Parquet tables.
TABLES = ("documents", "items", "failures", "fixes", "candidates", "place_candidates", "calls", "faults", "selection", "selected", "unmatched", "authority", "answers")


#: Tables that ``take`` lets grow.
TAKEN = ("documents", "items")


@dataclass(frozen=True)
class Catalogue:
    """A run over documents (doc_id, text), with tables below ``folder`` in any storage Spark writes to."""

    spark: SparkSession
    folder: str
    factory: Callable[[], Provider]
    vocabulary: DataFrame | None = None
    http: Callable[[], Callable[[str], str]] | None = None
    cache: str | None = None
    model: str = "gpt-4o-mini"
    threshold: float = 85
    retry: Retry = field(default_factory=Retry)
    batch: bool = True
    chunking: chunking.Chunking | None = None
    service: Callable[[], BatchService] | None = None
    use_batch: bool | None = None
    poll: float = 60.0

    def read(self, name: str) -> DataFrame:
        try:
            found = self.spark.read.parquet(f"{self.folder}/{name}")
        except Exception as e:
            raise MissingInput(f"no table {name} in {self.folder}") from e
        if name not in TAKEN or BATCH not in found.columns:
            return found
        return newest(GrowingTables(self.spark, self.folder).read(name, found.schema), "doc_id").drop(BATCH)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(name)

    def report(self, name: str, sections: Callable[[], list[Section]]) -> None:
        """Write a report below ``reports`` in numbered parts; its fault is told and never fails the step."""
        fault = reports.safely(lambda: write_parts(sections(), f"{self.folder}/reports/{name}"))
        if fault:
            warnings.warn(f"report {name}: {fault}", stacklevel=2)

    def wants_batch(self, rows: DataFrame, at_least: int) -> bool:
        """Remote batches are used if there is a service for them, as asked for or from ``at_least`` rows on."""
        return run.wants_batch(rows.limit(at_least).count(), at_least, self.use_batch, self.service is not None)

    def ask_batch(self, requests: DataFrame, name: str) -> DataFrame:
        """The outcomes of requests; those of an earlier try of this run are not asked again."""
        return Batches(self.spark, f"{self.folder}/batches/{name}", self.service()).complete(requests, self.poll)

    def extract(self, docs: DataFrame) -> None:
        """Step 1: a record, raw answer and error for each document, numbered by id."""
        numbered = self.write(usage.numbered(docs.select("doc_id", "text"), ["doc_id"]), "documents")
        self.write(self._extracted(numbered), "items")
        self.sheets()

    def sheets(self) -> None:
        """The workbooks of step 1 below ``sheets``: analysis, raw answers, issues, and a summary of the run."""
        items = self.items().withColumn("filename", F.col("doc_id").cast("string"))
        items = items.withColumn("analysis", F.struct("record.*", F.col("raw").alias("raw_response")))
        failed = items.where("error IS NOT NULL")
        skipped = self.spark.createDataFrame([], "path string, reason string")
        counts = items.select(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("error").isNull()).alias("extracted"), F.count("error").alias("failed"))
        self.sheet(workflow.analysis_sheet(items), "Analysis", "item_index")
        self.sheet(workflow.raw_sheet(items), "Raw Responses", "item_index")
        self.sheet(workflow.issues_sheet(failed, skipped), "Issues", "name")
        self.sheet(counts, "Summary", "documents")

    def sheet(self, rows: DataFrame, name: str, order: str) -> None:
        """Write a sheet in order, as workbooks numbered from part 0 on; a fault is told and never fails the step."""
        ordered = rows.repartitionByRange(order).sortWithinPartitions(order)
        fault = reports.safely(lambda: workbook.write_sheet(ordered, f"{self.folder}/sheets/{name}", name))
        if fault:
            warnings.warn(f"sheet {name}: {fault}", stacklevel=2)

    def take(self, docs: DataFrame, batch: int) -> None:
        """Step 1 over a micro-batch of documents, as ``streaming.ingest`` hands them over.

        Its documents are numbered after those of earlier batches; one that comes again replaces what it was.  A batch
        counts once it is committed: if it is lost before, it is taken again, and one that counts changes nothing more.
        """
        tables = GrowingTables(self.spark, self.folder)
        if not tables.is_new(batch):
            return
        numbered = usage.numbered(docs.select("doc_id", "text"), ["doc_id"])
        before = tables.read("documents", numbered.schema).agg(F.coalesce(F.max("item_index") + 1, F.lit(0))).first()[0]
        numbered = tables.write("documents", numbered.withColumn("item_index", F.col("item_index") + before), batch)
        tables.write("items", self._extracted(numbered), batch)
        tables.commit(batch)

    def _extracted(self, numbered: DataFrame) -> DataFrame:
        """item_index, doc_id, text, record, raw, error of numbered documents."""
        whole, long = chunking.split_by_size(numbered, self.chunking) if self.chunking else (numbered, numbered.limit(0))
        if self.wants_batch(whole, 6):
            done = extraction.extract_batch(whole, lambda asked: self.ask_batch(asked, "extraction"), self.factory, self.model)
        else:
            done = extraction.extract(whole, self.factory, self.model, self.retry)
        items = done.select("item_index", "doc_id", "text", "record", "raw", "error")
        if self.chunking:
            done = extraction.extract_long(long, self.factory, self.model, self.chunking, self.retry).drop("warnings")
            items = items.unionByName(long.join(done, "doc_id"))
        return items

    def items(self) -> DataFrame:
        """The records as they stand: fixes of step 1.5 over those of step 1."""
        items = self.read("items").select("item_index", "doc_id", "record", "raw", "error")
        try:
            fixes = self.read("fixes")
        except MissingInput:
            return items
        good = fixes.where("error IS NULL").select("item_index", "record", "raw", "error")
        return usage.upsert(items, good, "item_index")

    def clean_up(self) -> str:
        """Step 1.5: records that failed are made again; batch runs only."""
        if not self.batch:
            return "not a batch run"
        items = self.read("items").withColumn("keys", F.array(*[F.lit(k) for k in quality.REQUIRED]))
        failed = self.write(extraction.failures(items).select("item_index", "text", "failure_reason"), "failures")
        if not failed.limit(1).count():
            return "nothing to clean"
        self.write(extraction.reprocess(failed, self.factory, self.model, Retry(3, 4.0)), "fixes")
        self.report("cleanup", lambda: reports.cleanup_text(self.read("failures"), self.read("fixes")))
        return "cleaned"

    def look_up(self) -> None:
        """Step 2: candidate terms for each distinct subject and place, from a table or from the services.

        From the services, places are asked apart from subjects and keep their own table; ``calls`` has a row for each
        question (from the cache, or asked with its time), ``faults`` those that failed.
        """
        record = lambda c: lookup.queries(self.items().select(F.explode(clean_list(F.col(f"record.{c}"))).alias("v")), "v")
        subjects, places = record("subjects"), record("geographic_entities")
        if self.vocabulary is not None:
            self.write(lookup.look_up(subjects.union(places).distinct(), self.vocabulary), "candidates")
            self.report("vocabulary", lambda: reports.vocabulary_text(subjects.union(places).distinct(), self.read("candidates"), self.vocabulary.select("source").distinct()))
            return
        if self.http is None:
            raise ConfigError("step 2 needs a vocabulary, or services to ask")
        names = F.explode(F.array(*[F.lit(s) for s, _ in lookup.SOURCES]))
        asked = subjects.select(names.alias("service"), "query").union(places.select(F.lit(lookup.PLACES).alias("service"), "query"))
        known = vocabularies.read_cache(self.spark, self.cache) if self.cache else None
        answers, payloads = vocabularies.services(asked, self.http, known)
        answers = cut(answers)
        if self.cache:
            vocabularies.keep_answers(answers, self.cache)
        took = cut(payloads).groupBy("service", "query").agg(F.sum("seconds").alias("seconds"), F.max(F.when(F.col("place") == 0, F.col("error"))).alias("error"))
        calls = asked.join(answers, ["service", "query"], "left").join(took, ["service", "query"], "left")
        kind = F.when(F.col("cached"), "cache").otherwise("request")
        self.write(calls.select(F.col("service").alias("source"), F.col("query").alias("subject"), kind.alias("kind"), F.col("terms").isNotNull().alias("success"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("terms")), "calls")
        self.write(took.where("error IS NOT NULL").select("service", "query", "error"), "faults")
        hits = answers.select("query", F.col("service").alias("source"), F.posexplode("terms").alias("hit_pos", "term")).select("query", "source", "hit_pos", "term.label", "term.uri")
        found = lookup.distinct_terms(lookup.capped(hits.where(F.col("source") != lookup.PLACES)))
        self.write(found.select("query", "term_pos", "label", "uri", "source", "grp"), "candidates")
        self.write(hits.where(F.col("source") == lookup.PLACES).drop("hit_pos"), "place_candidates")
        self.report("vocabulary", lambda: reports.vocabulary_text(subjects, self.read("candidates"), self.read("calls").where(F.col("source") != lookup.PLACES).select("source").distinct()))
        self.report("requests", lambda: reports.api_text(self.read("calls")))

    def pools(self) -> DataFrame:
        """Each item's candidates, numbered in the order of its subjects; places are not offered."""
        rows = self.items().select("item_index", F.posexplode(clean_list(F.col("record.subjects"))).alias("pos", "query"))
        rows = rows.join(self.read("candidates"), "query")
        order = F.row_number().over(_by("item_index", "pos", "term_pos")) - 1
        return rows.withColumn("pool_pos", order)

    def select(self) -> None:
        """Step 3: labels chosen by the model, matched back to the pool; items without candidates are not asked."""
        pools, items = cut(self.pools()), self.items()
        block = terms.prompt_block(F.col("query"), F.transform(F.array_sort(F.collect_list(F.struct("term_pos", "label", "uri", "source"))), lambda x: terms.term(x["label"], x["uri"], x["source"])))
        offers = pools.groupBy("item_index", "query").agg(block.alias("block"), F.min("pos").alias("pos"))
        offers = offers.groupBy("item_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n").alias("candidates"))
        told = items.join(offers, "item_index")
        prompt = fill_template(SELECT_USER, title=truncate(F.coalesce("record.title", F.lit("")), 500), abstract=truncate(F.coalesce("record.abstract", F.lit("")), 4000), candidates=F.col("candidates"))
        requests = told.select(F.concat(F.lit("entry-"), F.col("item_index").cast("string")).alias("custom_id"), F.lit(self.model).alias("model"), messages(F.lit(SELECT_SYSTEM), prompt).alias("messages"), F.lit(1000).alias("max_tokens"), F.lit(0.0).alias("temperature"))
        if self.wants_batch(requests, 5):
            answers = self.ask_batch(requests, "selection")
            answers = answers.withColumns({"seconds": F.lit(0.0), "retries": F.lit(0)})
        else:
            answers = complete(requests, self.factory, Retry(5))
        answers = self.write(answers, "answers")
        answers = answers.select(F.substring_index("custom_id", "-", -1).cast("long").alias("item_index"), json_repair.selected_labels(F.col("content")).alias("labels"), "error")
        answers = answers.withColumn("error", F.when(F.col("error").isNull() & F.col("labels").isNull(), "answer of the wrong shape").otherwise(F.col("error")))
        matched = cut(lookup.match(answers.select("item_index", F.posexplode("labels").alias("label_pos", "label")), pools.select("item_index", "pool_pos", "label", "uri", "source")))
        self.write(lookup.selected(matched), "selected")
        self.write(lookup.unmatched(matched), "unmatched")
        self.write(lookup.status(items.select("item_index"), pools, answers.select("item_index", "error"), matched), "selection")
        self.report("selection", lambda: reports.selection_text(self.read("selection"), self.read("selected"), self.read("unmatched")))
        self.report("responses", lambda: reports.response_text(self.read("answers")))

    def authority(self) -> None:
        """Step 4: the authority file of all named entities."""
        rows = self.items().select("item_index", F.col("doc_id").cast("string").alias("source"), "record.title", "record.abstract", F.coalesce("record.named_entities", F.array().cast("array<string>")).alias("entities"))
        self.write(clustering.authority(clustering.mentions(rows), self.threshold), "authority")
        self.report("authority", lambda: reports.authority_text(self.read("authority")))

    def run(self, steps: list[str], docs: DataFrame | None = None, keep_going: bool = False, resume: bool = False) -> run.Report:
        work = {"1": lambda: self.extract(docs), "1.5": self.clean_up, "2": self.look_up, "3": self.select, "4": self.authority}
        return run.run(steps, work, keep_going, resume)


def _by(group: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(*order)


def newest_run(spark: SparkSession, parent: str, *required: str) -> str:
    """The most recently changed run folder that has the required entries, on any file system that the session reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(parent)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = [f for f in system.listStatus(at) if f.isDirectory()] if system.exists(at) else []
    runs = [f for f in runs if all(system.exists(path(f.getPath(), x)) for x in required)]
    if not runs:
        raise MissingInput(f"no run below {parent}")
    return max(runs, key=lambda f: (f.getModificationTime(), f.getPath().getName())).getPath().toString()


def settings(environment: dict[str, str]) -> dict[str, str | None]:
    """Provider settings by environment variable."""
    return {"model": environment.get("MODEL_NAME"), "api_key": environment.get("LLM_API_KEY")}
