"""The library's functions for SQL: ``register`` makes them known to a session.

``lcs_ratio``, ``latin_key`` and ``wide_key`` have bodies in SQL, so that Catalyst sees through them; ``text_chunks`` is a
table function over Arrow, to be called laterally.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import _ACCENTED, _PLAIN

BODIES = {
    "lcs_ratio(a STRING, b STRING) RETURNS DOUBLE": """
        CASE WHEN length(a) + length(b) = 0 THEN 100D ELSE 200D * CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0 ELSE element_at(
            aggregate(split(a, ''), array_repeat(0, length(b) + 1), (previous, letter) ->
                aggregate(sequence(1, length(b)), array(0), (done, j) -> concat(done, array(
                    CASE WHEN substring(b, j, 1) = letter THEN get(previous, j - 1) + 1 ELSE greatest(get(done, j - 1), get(previous, j)) END)))), -1) END
        / (length(a) + length(b)) END""",
    "latin_key(label STRING) RETURNS STRING": rf"""
        trim(regexp_replace(regexp_replace(translate(lower(coalesce(label, '')), '{_ACCENTED}', '{_PLAIN}'), r'[^a-z\s]', ''), r'\s+', ' '))""",
    "wide_key(label STRING) RETURNS STRING": r"""
        trim(regexp_replace(lower(coalesce(label, '')), r'(?U)[^\p{L}\p{N}]+', ' '))""",
}


class TextChunks:
    """Pieces of a text as ``operators.chunking`` cuts them: chunk_index (-1: front matter), start, end and text; no row for null."""

    def eval(self, text: str, front: int, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
        from ..operators.chunking import Chunking, bounds_of

        if text is None:
            return
        found = bounds_of(text, Chunking(front=front, size=size, overlap=overlap))
        at = found["front_end"]
        yield -1, 0, at, text[:at]
        for i, c in enumerate(found["chunks"]):
            yield i, at + c["start"], at + c["end"], text[at + c["start"] : at + c["end"]]


def register(spark: SparkSession) -> None:
    """Temporary functions of this session."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    chunks = udtf(TextChunks, returnType="chunk_index int, start_pos int, end_pos int, piece string", useArrow=True)
    spark.udtf.register("text_chunks", chunks)
