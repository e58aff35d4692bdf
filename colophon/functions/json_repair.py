"""JSON objects out of model output, and their normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_OBJECT = "map<string,string>"
#: Fixed: fields that are trimmed; lists; names that subjects may have.
SCALARS = ["title", "creator", "date", "department", "abstract", "type", "access", "publisher", "sponsor", "language"]
ENTITY_LISTS = ["namedEntities", "geographicEntities"]
SUBJECT_NAMES = ["subjects", "topics", "subjectHeadings"]
SNAKE = {"namedEntities": "named_entities", "geographicEntities": "geographic_entities", "contentWarning": "content_warning"}


#: Fixed: what is removed, found and quoted when a text is read as an object.
FENCE = r"```json\s*|\s*```"
SURROUNDED = r"(?s)^[^{]*(\{.*\})[^}]*$"
FIRST_OBJECT = r"(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})"
BARE_KEY = r"(\w+):"
BARE_VALUE = r':\s*([^",\[\{][^,\]\}]*)'
TRAILING_COMMA = r",(\s*[}\]])"


def _no_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, TRAILING_COMMA, "$1")


def _object(text: Column) -> Column:
    """The top level of a JSON object as a map of JSON texts; null for anything else."""
    return F.from_json(text, _OBJECT, {"mode": "PERMISSIVE"})


def attempts(raw: Column) -> list[Column]:
    """The texts to try, in order: fences and surroundings removed; the first object in it; bare keys and values quoted."""
    outer = F.regexp_replace(F.regexp_replace(raw, FENCE, ""), SURROUNDED, "$1")
    inner = F.regexp_extract(raw, FIRST_OBJECT, 1)
    values = F.regexp_replace(F.regexp_replace(raw, BARE_KEY, '"$1":'), BARE_VALUE, ': "$1"')
    quoted = F.regexp_extract(_no_trailing_commas(values), r"(?s)(\{.*\})", 1)
    return [_no_trailing_commas(outer), _no_trailing_commas(inner), quoted]


def repaired(raw: Column) -> Column:
    """The first attempt that reads as an object (map of JSON texts), or null; blank input gives null."""
    tries = [F.when(t != "", _object(t)) for t in attempts(raw)]
    return F.when(strip(F.coalesce(raw, F.lit(""))) != "", F.coalesce(*tries))


def repaired_text(raw: Column) -> Column:
    """The text of that attempt."""
    chosen = F.coalesce(*[F.when((t != "") & _object(t).isNotNull(), t) for t in attempts(raw)])
    return F.when(strip(F.coalesce(raw, F.lit(""))) != "", chosen)


def value(fields: Column, key: str) -> Column:
    return F.try_element_at(fields, F.lit(key))


def as_list(fields: Column, key: str) -> Column:
    """A list, or the parts of a comma list; anything else is empty."""
    text = value(fields, key)
    array = F.from_json(text, "array<string>")
    commas = F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    is_list, is_object = F.ltrim(text).startswith("["), F.ltrim(text).startswith("{")
    return F.when(text.isNull() | is_object, none).when(is_list, F.coalesce(array, none)).otherwise(commas)


def entity_list(fields: Column, key: str) -> Column:
    """Distinct members in order, without single letters and digits."""
    return F.filter(F.array_distinct(as_list(fields, key)), lambda x: (F.length(x) > 1) | ~x.rlike(r"^[\p{L}\p{N}]$"))


def subject_list(fields: Column) -> Column:
    """The first of the names subjects may have that is there, empty or not."""
    out = F.array().cast("array<string>")
    for key in reversed(SUBJECT_NAMES):
        out = F.when(F.map_contains_key(fields, F.lit(key)), as_list(fields, key)).otherwise(out)
    return out


def content_warning(text: Column) -> Column:
    """"None", or a sentence with a capital letter and one full stop."""
    text = strip(F.coalesce(text, F.lit("")))
    said = F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30))
    return F.when((text == "") | (F.lower(text) == "none"), "None").otherwise(F.concat(F.regexp_replace(said, r"\.+$", ""), F.lit(".")))


def joined_warning(reasons: Column) -> Column:
    """One sentence of all reasons, or "None"."""
    bare = F.transform(reasons, lambda r: F.regexp_replace(strip(r), r"\.+$", ""))
    text = F.array_join(bare, "; ")
    said = F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30), F.lit("."))
    return F.when(F.size(reasons) == 0, "None").otherwise(said)


def record(fields: Column) -> Column:
    """The normal record of an object: trimmed scalars (null where absent), lists, content warning."""
    scalars = [strip(value(fields, k)).alias(k) for k in SCALARS]
    lists = [entity_list(fields, k).alias(SNAKE[k]) for k in ENTITY_LISTS]
    return F.struct(*scalars, subject_list(fields).alias("subjects"), *lists, content_warning(value(fields, "contentWarning")).alias("content_warning"))


def blank_record() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(*[F.lit("").alias(k) for k in SCALARS], none.alias("subjects"), *[none.alias(SNAKE[k]) for k in ENTITY_LISTS], F.lit("None").alias("content_warning"))


def missing_keys(fields: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(k) for k in required]), F.map_keys(fields))


def selected_labels(raw: Column) -> Column:
    """Labels of ``selected_terms`` (strings or objects with a label); null where the shape is wrong."""
    fields = repaired(raw)
    items = F.from_json(value(fields, "selected_terms"), "array<string>")
    labels = F.transform(items, lambda x: F.when(F.ltrim(x).startswith("{"), F.get_json_object(x, "$.label")).otherwise(x))
    return F.when(F.exists(labels, lambda x: x.isNull()), F.lit(None)).otherwise(labels)


def request_errors(model: Column, messages: Column, max_tokens: Column, temperature: Column) -> Column:
    """What is wrong with a request; empty if nothing.  ``messages``: array of STRUCT(role, content)."""
    roles = F.forall(messages, lambda m: F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)))
    contents = F.forall(messages, lambda m: strip(F.coalesce(m["content"], F.lit(""))) != "")
    found = F.array(
        F.when(F.coalesce(model, F.lit("")) == "", "no model"),
        F.when(F.size(messages) == 0, "no messages"),
        F.when(~roles, "invalid role"),
        F.when(~contents, "empty content"),
        F.when(~F.coalesce(max_tokens > 0, F.lit(False)), "max_tokens must be positive"),
        F.when(~F.coalesce(temperature.between(0, 2), F.lit(False)), "temperature must be within 0 and 2"),
    )
    return F.filter(found, lambda x: x.isNotNull())
