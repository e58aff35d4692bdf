"""Reports as lines of text that Spark makes: sections for ``sources.ordered_text``, written by many tasks.

The functions that end in ``_report`` and ``_log`` give the same lines to the driver, a partition at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering, usage
from ..sources.ordered_text import Section, lines_of


def write(lines: Iterator[str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        for line in lines:
            out.write(line + "\n")


def safely(work, *args) -> str | None:
    """Run a report; a fault of a report is told, and never fails the step it reports on."""
    try:
        work(*args)
    except Exception as e:
        return f"{type(e).__name__}: {e}"
    return None


def title(rows: DataFrame, text: str) -> Section:
    return rows.sparkSession.range(1).select(F.lit(text).alias("line")), []


def vocabulary_text(asked: DataFrame, terms: DataFrame, sources: DataFrame) -> list[Section]:
    """Coverage, terms by source (known ones without terms too), and all subjects in order with their terms."""
    told = F.format_string("Subjects: %d, with terms: %d, without: %d (%.1f%%)", "subjects", "with_terms", "without_terms", "rate")
    by_source = usage.source_counts(terms, sources).select("source", F.format_string("%s: %d", "source", "terms").alias("line"))
    text = F.concat(F.lit("  - "), "label", F.when(F.col("uri") != "", F.concat(F.lit(" ("), "uri", F.lit(")"))).otherwise(""), F.lit(" ["), "source", F.lit("]"))
    found = terms.join(asked.select("query").distinct(), "query", "left_semi")
    some = found.select("query").distinct().withColumn("some", F.lit(True))
    heads = asked.select("query").distinct().join(some, "query", "left")
    heads = heads.select("query", F.lit(-1).alias("term_pos"), F.concat("query", F.when(F.col("some"), "").otherwise(": no terms")).alias("line"))
    listed = heads.unionByName(found.select("query", F.col("term_pos").cast("int"), text.alias("line")))
    coverage = usage.coverage(asked, terms).select(told.alias("line"))
    return [title(asked, "Vocabulary mapping"), (coverage, []), (by_source, ["source"]), (listed, ["query", "term_pos"])]


def api_text(calls: DataFrame) -> list[Section]:
    """Requests by source and in all, then subjects with the terms each source gave."""
    told = F.format_string("%s: %d requests, %d ok, %d failed, %d from cache, %d terms, %.1f%%, %.2f s each", F.coalesce("source", F.lit("all")), "requests", "succeeded", "failed", "cache_hits", "terms", 100 * F.col("success_rate"), "avg_seconds")
    totals = usage.api_breakdown(calls).select("source", told.alias("line"))
    per_subject = usage.subject_results(calls.where("success").select("subject", "source", "terms", "seconds"))
    lines = per_subject.select("subject", F.format_string("%s: %d (%s) in %.2f s", "subject", "total_terms", F.col("by_source").cast("string"), "seconds").alias("line"))
    return [title(calls, "Vocabulary requests"), (totals, [F.col("source").asc_nulls_last()]), (lines, ["subject"])]


def selection_text(status: DataFrame, selected: DataFrame, unmatched: DataFrame) -> list[Section]:
    """Counts by status and, for each item, what was selected and what could not be matched."""
    told = F.format_string("%s: %d items, %d terms, %d unmatched, %d with issues", "status", "items", "selected", "unmatched", "issues")
    counts = usage.status_counts(status).select("status", told.alias("line"))
    shown = F.concat(F.lit("  - "), F.concat_ws(" ", "term_label", "uri", "source"))
    a = selected.select("item_index", F.lit(0).alias("kind"), "label_pos", shown.alias("line"))
    b = unmatched.select("item_index", F.lit(1).alias("kind"), "label_pos", F.concat(F.lit("  ? "), "label").alias("line"))
    body = a.union(b)
    heads = body.select("item_index").distinct().select("item_index", F.lit(-1).alias("kind"), F.lit(-1).alias("label_pos"), F.format_string("Item %s", F.col("item_index").cast("string")).alias("line"))
    return [title(status, "Vocabulary selection"), (counts, ["status"]), (heads.union(body), ["item_index", "kind", "label_pos"])]


def authority_text(file: DataFrame, method: str = "longest common subsequence") -> list[Section]:
    """Types by frequency, then entities by type and frequency with up to five appearances each."""
    counts = file.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    by_type = counts.select("n", "first", F.format_string("%s: %d", "type", "n").alias("line"))
    others = F.array_join(F.filter("variants", lambda v: v != F.col("name")), "; ")
    named = F.concat(F.format_string("%s (%d)", "name", "frequency"), F.when(F.size("variants") > 1, F.concat(F.lit(", also "), others)).otherwise(""))
    more = F.size("sources") - 5
    seen = F.concat(F.lit("  in "), F.array_join(F.slice("sources", 1, 5), ", "), F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(""))
    body = file.select("type", "frequency", "pos", F.posexplode(F.array(named, seen)).alias("k", "line"))
    heads = counts.select("type", F.lit(None).cast("long").alias("frequency"), F.col("first").alias("pos"), F.lit(0).alias("k"), F.format_string("[%s]", "type").alias("line"))
    order = ["type", F.col("frequency").desc_nulls_first(), "pos", "k"]
    return [title(file, f"Entity authority file (names compared by {method})"), (by_type, [F.desc("n"), "first"]), (heads.unionByName(body), order)]


def cleanup_text(failed: DataFrame, fixed: DataFrame) -> list[Section]:
    """Reasons, most frequent first, and what became of each item."""
    counts = failed.groupBy("failure_reason").agg(F.count(F.lit(1)).alias("items"), F.min("item_index").alias("first"))
    reasons = counts.select("items", "first", F.format_string("%s: %d", "failure_reason", "items").alias("line"))
    rows = failed.select("item_index", "failure_reason").join(fixed.select("item_index", "error"), "item_index", "left")
    lines = rows.select("item_index", F.format_string("Item %s: %s -> %s", F.col("item_index").cast("string"), "failure_reason", F.coalesce("error", F.lit("fixed"))).alias("line"))
    return [title(failed, "Cleanup"), (reasons, [F.desc("items"), "first"]), (lines, ["item_index"])]


def response_text(answers: DataFrame) -> list[Section]:
    """Each answer as it came, below a line that names it."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    head = F.concat(F.lit("--- "), "custom_id", F.lit(" ("), number("prompt"), F.lit(" + "), number("completion"), F.lit(" tokens)"))
    body = F.when(F.col("error").isNull(), F.coalesce("content", F.lit(""))).otherwise(F.concat(F.lit("ERROR "), "error"))
    return [(answers.select("custom_id", F.posexplode(F.array(head, body)).alias("k", "line")), ["custom_id", "k"])]


def vocabulary_report(asked: DataFrame, terms: DataFrame, sources: DataFrame) -> Iterator[str]:
    return lines_of(vocabulary_text(asked, terms, sources))


def api_report(calls: DataFrame) -> Iterator[str]:
    return lines_of(api_text(calls))


def selection_report(status: DataFrame, selected: DataFrame, unmatched: DataFrame) -> Iterator[str]:
    return lines_of(selection_text(status, selected, unmatched))


def authority_report(file: DataFrame, method: str = "longest common subsequence") -> Iterator[str]:
    return lines_of(authority_text(file, method))


def cleanup_report(failed: DataFrame, fixed: DataFrame) -> Iterator[str]:
    return lines_of(cleanup_text(failed, fixed))


def response_log(answers: DataFrame) -> Iterator[str]:
    return lines_of(response_text(answers))


def authority_json(file: DataFrame) -> DataFrame:
    """One JSON record per entity, keyed by name; statistics are a table of their own."""
    fields = ["name", "type", "frequency", "n_documents", "variants", "sources", "contexts", "original_forms"]
    return file.select("name", F.to_json(F.struct(*fields)).alias("record"))


def authority_statistics(file: DataFrame) -> Iterator[str]:
    for r in clustering.statistics(file).orderBy("kind", "value").collect():  # a row a type and frequency class
        yield f"{r['kind']} {r['value']}: {r['entities']} entities, {r['mentions']} mentions" + (f" ({r['examples']})" if r["examples"] else "")


def usage_report(priced: DataFrame, batch: bool = False) -> Iterator[str]:
    """Calls, tokens, costs and rates by model; what a batch has saved."""
    yield "Token usage"
    for r in usage.efficiency(priced).orderBy("model").collect():  # one row a model
        yield f"{r['model']}: {r['calls']} calls, {r['succeeded']} ok, {r['prompt']} + {r['completion']} tokens ({r['cached']} cached), ${r['cost']:.6f}"
        yield f"  {r['avg_tokens']:.1f} tokens a call, {r['tokens_per_second']:.1f} tokens/s, ${r['cost_per_minute']:.4f}/min, {r['calls_per_minute']:.1f} calls/min, {r['avg_seconds']:.2f} s a call"
        if batch:
            yield f"  saved by batching: ${r['cost']:.6f}"
