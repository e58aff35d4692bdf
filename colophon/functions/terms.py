"""Controlled-vocabulary terms: structs of label, uri, source and five optional fields."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .text import strip

FIELDS = ["label", "uri", "source", "description", "qid", "subject_id", "type", "tag"]
TERM = ", ".join(f"{f}: string" for f in FIELDS)
#: Fixed: priority of sources, small first; others come last.
PRIORITY = {"Getty AAT": 1, "LCSH": 2, "FAST": 3, "Getty TGN": 4}
LAST_PRIORITY = 999
#: Fixed: addresses that ids are appended to.
URIS = {"FAST": "http://id.worldcat.org/fast/", "Getty AAT": "http://vocab.getty.edu/aat/", "Getty TGN": "http://vocab.getty.edu/tgn/"}


def priority(source: Column) -> Column:
    out = F.lit(LAST_PRIORITY)
    for name, n in PRIORITY.items():
        out = F.when(source == name, n).otherwise(out)
    return out


def term(label: Column, uri: Column, source: Column, **more: Column) -> Column:
    given = {"label": label, "uri": uri, "source": source} | more
    return F.struct(*[F.coalesce(given[f].cast("string"), F.lit("")).alias(f) if f in given else F.lit("").alias(f) for f in FIELDS])


def formatted(t: Column) -> Column:
    """label (uri) [source]; the uri only if there is one."""
    source = F.when(F.coalesce(t["source"], F.lit("")) == "", "Unknown").otherwise(t["source"])
    uri = F.when(F.coalesce(t["uri"], F.lit("")) != "", F.concat(F.lit(" ("), t["uri"], F.lit(")"))).otherwise("")
    return F.concat(t["label"], uri, F.lit(" ["), source, F.lit("]"))


def cell(terms: Column) -> Column:
    """Formatted terms with a label, joined."""
    return F.array_join(F.transform(F.filter(terms, lambda t: t["label"] != ""), formatted), "; ")


#: Fixed: one term of a joined cell.
_ENTRY = r"\s*([^\[\]]*?)\s*(?:\(([^()\s]*)\)\s*)?\[([^\[\]]+)\]\s*(?:;|$)"


def from_cell(text: Column) -> Column:
    """The terms of a joined cell; a semicolon inside a label is tolerated."""
    parts = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_ENTRY), k) for k in (1, 2, 3)]
    rows = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "lus")]), lambda x: term(strip(x["l"]), x["u"], strip(x["s"])))
    return F.filter(rows, lambda t: t["label"] != "")


def from_json(text: Column) -> Column:
    """MAP(subject -> terms) of a JSON object; nulls become empty strings, unknown keys go."""
    parsed = F.from_json(text, f"map<string,array<struct<{TERM}>>>")
    return F.transform_values(parsed, lambda _, ts: F.transform(ts, lambda t: F.struct(*[F.coalesce(t[f], F.lit("")).alias(f) for f in FIELDS])))


def to_json(t: Column) -> Column:
    """label, uri and source always, the rest where not empty."""
    more = [F.nullif(t[f], F.lit("")).alias(f) for f in FIELDS[3:]]
    return F.to_json(F.struct(*[t[f].alias(f) for f in FIELDS[:3]], *more))


def distinct_by_uri(terms: Column) -> Column:
    """The first term of each uri; terms without one all stay.

    ``pos`` of the first term with the same uri decides, so order is kept.
    """
    uris = F.transform(terms, lambda t: t["uri"])
    return F.filter(terms, lambda t, i: (t["uri"] == "") | (F.array_position(uris, t["uri"]) == i + 1))


def prompt_block(subject: Column, terms: Column) -> Column:
    """The lines that offer a subject's candidates."""
    lines = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("  - "), formatted(t))), "\n")
    return F.concat(F.lit("Subject: "), subject, F.lit("\n"), F.when(F.size(terms) == 0, "  (No candidate controlled terms)").otherwise(lines), F.lit("\n"))


def json_fault(payload: Column, path: str, kind: str) -> Column:
    """Why a payload (JSON) can't be read, or null: it is no object, or what ``path`` names is not a list."""
    parsed = F.try_parse_json(payload)
    whole = F.schema_of_variant(parsed)
    inner = F.get_json_object(payload, path)
    no_object = parsed.isNull() | ~whole.startswith("OBJECT")
    no_list = inner.isNotNull() & ~F.ltrim(inner).startswith("[")
    return F.when(F.coalesce(no_object, F.lit(True)), F.lit(f"{kind} payload is not an object")).when(no_list, F.lit(f"{kind} payload has no list at {path}"))


def xml_fault(payload: Column, kind: str) -> Column:
    """Why a payload (XML) can't be read, or null."""
    return F.when(F.coalesce(F.length(F.trim(payload)), F.lit(0)) == 0, F.lit(f"{kind} payload is empty")).when(~well_formed(payload), F.lit(f"{kind} payload is not XML"))


@F.pandas_udf(BooleanType())
def well_formed(payload: pd.Series) -> pd.Series:
    """Is it XML?  Spark's own reader gives nulls for what it can't read, and for documents without the fields too."""

    def reads(text: str | None) -> bool:
        try:
            ElementTree.fromstring((text or "").strip())
        except ElementTree.ParseError:
            return False
        return True

    return payload.map(reads).astype(bool)


def fast_terms(payload: Column, source: str = "FAST", with_tag: bool = False) -> Column:
    """Terms of a suggest payload (JSON); a field may be a value or a list, whose first member counts."""
    docs = F.from_json(F.get_json_object(payload, "$.response.docs"), "array<struct<suggestall: string, idroot: string, auth: string, type: string, tag: string>>")
    docs = F.coalesce(docs, F.array().cast("array<struct<suggestall: string, idroot: string, auth: string, type: string, tag: string>>"))

    def first(x: Column) -> Column:
        x = F.coalesce(x, F.lit(""))
        return F.when(F.ltrim(x).startswith("["), F.coalesce(F.get(F.from_json(x, "array<string>"), F.lit(0)), F.lit(""))).otherwise(x)

    def joined(x: Column) -> Column:
        x = F.coalesce(x, F.lit(""))
        return F.when(F.ltrim(x).startswith("["), F.array_join(F.filter(F.from_json(x, "array<string>"), lambda y: y != ""), ", ")).otherwise(x)

    def build(d: Column) -> Column:
        auth, all_, root = first(d["auth"]), first(d["suggestall"]), first(d["idroot"])
        return term(F.when(auth != "", auth).otherwise(all_), F.when((all_ != "") & (root != ""), F.concat(F.lit(URIS["FAST"]), root)), F.lit(source), type=first(d["type"]), subject_id=root, tag=joined(d["tag"]) if with_tag else F.lit(""))

    return F.filter(F.transform(docs, build), lambda t: t["uri"] != "")


def lcsh_terms(payload: Column) -> Column:
    """Terms of a heading search payload (JSON): hits with label and uri."""
    kind = "array<struct<aLabel: string, uri: string>>"
    hits = F.coalesce(F.from_json(F.get_json_object(payload, "$.hits"), kind), F.array().cast(kind))
    rows = F.transform(hits, lambda h: term(h["aLabel"], h["uri"], F.lit("LCSH")))
    return F.filter(rows, lambda t: (t["label"] != "") & (t["uri"] != ""))


def getty_terms(xml: Column, source: str) -> Column:
    """Terms of a Getty answer (XML): subjects, at any depth, with id and preferred term."""
    subjects = F.regexp_extract_all(xml, F.lit(r"(?s)<Subject(?:\s[^>]*)?>(.*?)</Subject>"), F.lit(1))

    def inner(subject: Column, name: str) -> Column:
        found = F.from_xml(F.concat(F.lit("<r>"), subject, F.lit("</r>")), f"STRUCT<{name}: ARRAY<STRING>>")[name]
        return F.coalesce(F.trim(F.get(found, F.lit(0))), F.lit(""))

    def build(s: Column) -> Column:
        n = inner(s, "Subject_ID")
        return term(inner(s, "Preferred_Term"), F.when(n != "", F.concat(F.lit(URIS[source]), n)), F.lit(source), subject_id=n)

    rows = F.transform(F.coalesce(subjects, F.array().cast("array<string>")), build)
    return F.filter(rows, lambda t: (t["label"] != "") & (t["uri"] != ""))
