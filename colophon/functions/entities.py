"""Named entities: parsing "name (type)", guessing a type, normalising a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, words

#: Fixed: what in a name tells its type, in this order.
INSTITUTION = ["university", "college", "institute", "school", "department"]
ORGANIZATION = ["company", "co.", "inc.", "corp.", "corporation", "association", "society", "foundation", "committee"]
PROJECT = ["study", "project", "program", "trial", "survey"]
LOCATION = ["city", "state", "province", "county", "region", "country"]
#: Fixed: forms of personal names, and of "name (type)".
INITIALS = r"^[A-Z]\. ?[A-Z]\.? [A-Z]"
MIDDLE_INITIAL = r"^[A-Z][a-z]+ [A-Z]\. [A-Z]"
TYPED = r"^(.+?)\s*\(([^)]+)\)\s*$"


def _holds_any(low: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(low, F.lit(part))
    return found


def guessed_type(name: Column) -> Column:
    """The type that a name suggests by itself."""
    low, w = F.lower(name), words(name)
    capital = lambda x: F.substring(x, 1, 1).rlike(r"^\p{Lu}")
    two_capitals = (F.size(w) >= 2) & capital(F.get(w, F.lit(0))) & capital(F.get(w, F.lit(1)))
    return (
        F.when(_holds_any(low, INSTITUTION), "institution")
        .when(_holds_any(low, ORGANIZATION), "organization")
        .when(_holds_any(low, PROJECT), "project")
        .when(name.rlike(INITIALS) | name.rlike(MIDDLE_INITIAL) | two_capitals, "person")
        .when(_holds_any(low, LOCATION), "location")
        .otherwise("unknown")
    )


def parsed(entity: Column) -> Column:
    """STRUCT(name, type): the type in brackets at the end, or else the guessed one."""
    text = strip(entity)
    name, kind = F.regexp_extract(text, TYPED, 1), F.regexp_extract(text, TYPED, 2)
    return F.when(text.rlike(TYPED), F.struct(strip(name).alias("name"), F.lower(strip(kind)).alias("type"))).otherwise(F.struct(text.alias("name"), guessed_type(text).alias("type")))


def normalised_name(name: Column) -> Column:
    """Single spaces, "and" for "&", "Company" and "Incorporated" for "Co." and "Inc." before another word character."""
    name = F.replace(F.regexp_replace(strip(name), r"(?U)\s+", " "), F.lit("&"), F.lit("and"))
    name = F.regexp_replace(name, r"(?iU)\bCo\.\b", "Company")
    return F.regexp_replace(name, r"(?iU)\bInc\.\b", "Incorporated")
