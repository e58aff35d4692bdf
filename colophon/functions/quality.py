"""Which extraction results have failed, and why."""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import strip, words

#: Fixed: strings that mark an error message.
INDICATORS = [
    "Processing error:", "Error:", "Failed to", "Exception:", "Traceback:", "REPROCESSING FAILED:", "Timeout",
    "Connection error", "API error", "Internal server error", "Rate limit", "Service unavailable", "Bad gateway",
]
#: Fixed: the reasons, in the order in which they are looked for.
NO_ANALYSIS = "Missing analysis section"
EXPLICIT = "Explicit processing error in response"
EMPTY = "Empty response"
BROKEN = "Completely broken JSON structure"
REPETITION = "Extreme repetition/corruption pattern detected"
MISSING = "Required metadata fields missing"
#: Fixed: keys that a whole record has.
REQUIRED = ["title", "creator", "date", "department", "abstract", "subjects", "type", "access", "publisher", "sponsor", "language", "named_entities", "geographic_entities", "content_warning"]


#: Bytes of text that are counted at once, and characters that a full table of counts has.
_PART_BYTES, _CODES = 1 << 20, 0x110000


def _counts_of(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def _top_character_of(data: pa.Buffer | None) -> int:
    """A long text is counted in parts, so that a few MB beside the text itself are held."""
    if not data:
        return 0
    if data.size <= _PART_BYTES:
        codes = np.frombuffer(data, np.uint8)
        if codes.max() >= 128:
            codes = np.frombuffer(str(data, "utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        if codes.max() >= 1 << 16:
            # a table of counts would be large
            codes = codes[(codes != 32) & (codes != 10) & (codes != 9) & (codes != 13)]
            return int(np.unique(codes, return_counts=True)[1].max())
        counts = np.bincount(codes, minlength=33)
    else:
        counts, decode = np.zeros(_CODES, np.int64), codecs.getincrementaldecoder("utf-8")("replace").decode
        for at in range(0, data.size, _PART_BYTES):
            some = _counts_of(decode(data.slice(at, min(_PART_BYTES, data.size - at)), at + _PART_BYTES >= data.size))
            counts[: len(some)] += some
    counts[[9, 10, 13, 32]] = 0
    return int(counts.max())


@F.arrow_udf(IntegerType())
def top_character(text: pa.Array) -> pa.Array:
    """How often the most frequent character other than blank, tab and line ends occurs (null: 0).

    Over Arrow batches, in one pass: Spark's own functions have no count by character without a row for each one.  A
    batch is read where it lies, one text after the other, so that a worker holds it once.
    """
    return pa.array([_top_character_of(t.as_buffer()) for t in text], pa.int32())


def dominance(text: Column) -> Column:
    """The share of the text that its most frequent character takes."""
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(top_character(text) / F.greatest(F.length(text), F.lit(1)))


def longest_word_run(text: Column) -> Column:
    """The largest number of equal words in a row."""
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(w == s["word"], s["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(words(text), start, step, lambda s: s["most"])


#: Fixed: characters up to which a text is too short for its most frequent one to count.
SHORT = 1000


def long_top(text: Column, short: int = SHORT) -> Column:
    """``top_character`` of texts of more than ``short`` characters, 0 for others, which are never sent to Python."""
    return top_character(F.when(F.length(text) > short, text))


def once_top(text: Column) -> Column:
    """The same for ``failure_reason`` in a column of its own: rows chosen by the reason do not count it again."""
    return top_character.asNondeterministic()(F.when(F.length(text) > SHORT, text))


def extreme_repetition(text: Column, most_of_one: int = 2500, word_run: int = 500, top: Column | None = None) -> Column:
    long = F.length(text) > most_of_one
    top = F.when(long, long_top(text, min(SHORT, most_of_one)) if top is None else top).otherwise(0)
    repeated = (top > most_of_one) | (long & (F.length(text) > 2000) & (top / F.greatest(F.length(text), F.lit(1)) > 0.8))
    # a run of so many words takes that many characters and as many gaps
    run = F.when(F.length(text) >= 2 * word_run - 1, longest_word_run(text)).otherwise(0)
    return (F.length(strip(text)) >= 30) & (repeated | (run >= word_run))


def broken_json(text: Column, top: Column | None = None) -> Column:
    opened = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    closed = F.length(text) - F.length(F.replace(text, F.lit("}"), F.lit("")))
    message = strip(text).rlike("^(Error:|Failed:|Exception:)") & (F.length(text) < 50)
    top = long_top(text) if top is None else top
    uniform = F.when(F.length(text) > SHORT, top / F.greatest(F.length(text), F.lit(1))).otherwise(0.0) >= 0.8
    return (F.length(strip(text)) >= 10) & (((opened == 0) & (closed == 0)) | (F.abs(opened - closed) > 12) | message | uniform)


def failure_reason(has_analysis: Column, raw: Column, complete: Column, top: Column | None = None) -> Column:
    """The first reason that holds, or null.  ``complete``: all required keys are there, title and abstract not blank.

    ``top``: the column of ``once_top(raw)``, where rows are then chosen by the reason.
    """
    raw = F.coalesce(raw, F.lit(""))
    told = F.lit(False)
    for mark in INDICATORS:
        told = told | F.contains(raw, F.lit(mark))
    return (
        F.when(~F.coalesce(has_analysis, F.lit(False)), NO_ANALYSIS)
        .when(told, EXPLICIT)
        .when(strip(raw) == "", EMPTY)
        .when(broken_json(raw, top), BROKEN)
        .when(extreme_repetition(raw, top=top), REPETITION)
        .when(~F.coalesce(complete, F.lit(False)), MISSING)
    )


def complete_record(fields: list[str], title: Column, abstract: Column) -> Column:
    """Is each required key among ``fields``, and do title and abstract say something?"""
    if set(REQUIRED) - set(fields):
        return F.lit(False)
    return (strip(F.coalesce(title, F.lit(""))) != "") & (strip(F.coalesce(abstract, F.lit(""))) != "")


def batch_run(mode: Column) -> Column:
    """Was this a batch run?  A run that doesn't say counts as one."""
    return F.coalesce(F.upper(mode) == "BATCH", F.lit(True))
