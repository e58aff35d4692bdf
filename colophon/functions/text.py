"""Text functions: columns in, columns out."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space in Python's sense.
_BLANK = r"(?U)\s+"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Runs of other characters than white space."""
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def clean_ocr(text: Column) -> Column:
    """No-break spaces become spaces, runs of blanks one space, three or more line ends two."""
    text = F.regexp_replace(F.translate(text, " ", " "), "[ \\t]+", " ")
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def comparison_key_of(text: str | None) -> str:
    """Letters a to z without accents and single spaces; everything else goes, digits included."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"[^a-z\s]", "", folded.lower())).strip()


@F.pandas_udf(StringType())
def comparison_key(text: pd.Series) -> pd.Series:
    """``comparison_key_of`` over Arrow batches: Spark has no compatibility decomposition of its own."""
    return text.map(comparison_key_of)


#: Fixed: Latin-1 letters with accents and what they decompose to.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def latin_key(text: Column) -> Column:
    """``comparison_key`` for Latin-1 texts without Python: equal wherever no other decomposable character occurs."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z\s]", ""), r"\s+", " "))


def wide_key(text: Column) -> Column:
    """A safer key: keeps letters of all scripts and digits, so "World War 1" and "World War 2" stay apart."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]+", " "))


def matching_label(text: Column) -> Column:
    """Lower case, single spaces, without one closing mark."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), _BLANK, " "), "[.,;:!?]$", "")


def split_list(value: Column) -> Column:
    """Trimmed, non-empty parts between commas and semicolons; null gives none."""
    return clean_list(F.split(F.coalesce(value, F.lit("")), "[,;]"))


def clean_list(values: Column) -> Column:
    """Trimmed, non-empty members; a null list gives none."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), strip)
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def word_overlap(a: Column, b: Column) -> Column:
    """Do the two share a word, whatever its case?"""
    return F.arrays_overlap(words(F.lower(F.coalesce(a, F.lit("")))), words(F.lower(b)))


def search_term(place: Column) -> Column:
    """Without a closing "(...)"."""
    inner = F.regexp_extract(place, r"(?s)^(.+)\([^(]*\)$", 1)
    return F.when(inner != "", strip(inner)).otherwise(place)


def truncate(text: Column, limit: int, marker: str = "\n[...truncated...]") -> Column:
    """At most ``limit`` characters, the marker included where it fits."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    short = F.left(text, F.lit(limit)) if limit <= len(marker) else F.concat(F.left(text, F.lit(limit - len(marker))), F.lit(marker))
    return F.when(F.length(text) <= limit, text).otherwise(short)


def fill_template(template: str, **values: Column) -> Column:
    """``$name`` and ``${name}`` filled in from columns, ``$$`` a dollar; what is filled in is not read again."""
    parts, at, missing = [], 0, set()
    for m in re.finditer(r"\$(?:(\$)|([A-Za-z_]\w*)|\{([A-Za-z_]\w*)\}|)", template):
        name = m[2] or m[3]
        if not m[0].removeprefix("$"):
            raise ValueError(f"a single $ at {m.start()}")
        parts.append(F.lit(template[at : m.start()]))
        if name and name not in values:
            missing.add(name)
        parts.append(F.lit("$") if m[1] else F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit(""))
        at = m.end()
    if missing:
        raise ValueError(f"missing values: {', '.join(sorted(missing))}")
    return F.concat(*parts, F.lit(template[at:]))


def needs_chunking(text: Column, limit: int = 400_000, token_count: Column | None = None, token_limit: int = 100_000) -> Column:
    """Is the text longer than a whole document may be?  Tokens, where they are counted, come before characters."""
    return token_count > token_limit if token_count is not None else F.length(text) > limit


def estimated_tokens(text: Column, images: Column | int = 0, completion_limit: int = 0) -> Column:
    """A rough count: four characters a token, 1000 an image, 100 of overhead, 0.6 of the completion's limit."""
    return F.floor(F.length(text) / 4) + F.lit(images) * 1000 + 100 + int(0.6 * completion_limit)
