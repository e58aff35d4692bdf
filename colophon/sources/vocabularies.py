"""Vocabulary services asked over the network, one request for each distinct query that no cache has."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..operators.lookup import PLACE_LIMIT, PLACES, accepted, fallback_words
from ..storage import cut

#: Fixed: addresses of the services.
FAST = "https://fast.oclc.org/searchfast/fastsuggest"
LCSH = "https://id.loc.gov/authorities/subjects/suggest2"
AAT = "http://vocabsservices.getty.edu/AATService.asmx/AATGetTermMatch"
TGN = "http://vocabsservices.getty.edu/TGNService.asmx/TGNGetTermMatch"

#: Fixed: parameters of the searches, by service and kind; $query is the query, $most the limit, $rows twice that.
_HEADINGS = {"q": "$query", "count": "$most", "memberOf": "http://id.loc.gov/authorities/subjects/collection_LCSHAuthorizedHeadings"}
_SUGGEST = {"query": "$query", "queryReturn": "suggestall,idroot,auth,type", "suggest": "autoSubject", "rows": "$rows", "sort": "usage desc"}
_PLACE = _SUGGEST | {"queryReturn": "suggestall,idroot,auth,type,tag", "facet": "type", "facet.field": "type"}
SEARCHES = {
    ("LCSH", "primary"): (LCSH, _HEADINGS | {"searchtype": "keyword"}),
    ("LCSH", "fallback"): (LCSH, _HEADINGS | {"searchtype": "leftanchored"}),
    ("FAST", "primary"): (FAST, _SUGGEST),
    ("FAST", "fallback"): (FAST, _SUGGEST),
    ("FAST Geographic", "primary"): (FAST, _PLACE | {"fq": "type:Geographic"}),
    ("FAST Geographic", "fallback"): (FAST, _PLACE),
    ("Getty AAT", "primary"): (AAT, {"term": "$query", "logop": "and", "notes": ""}),
    ("Getty AAT", "fallback"): (AAT, {"term": "$query", "logop": "and", "notes": ""}),
    ("Getty TGN", "primary"): (TGN, {"name": "$query", "placetypeid": "", "nationid": ""}),
    ("Getty TGN", "fallback"): (TGN, {"name": "$query", "placetypeid": "", "nationid": ""}),
}

PAYLOAD = "service string, query string, payload string, seconds double, error string"
_ASKED = "place int, asked string, " + PAYLOAD


def limit_of(service: str, most: int = 3) -> int:
    """Terms that a service gives for a query at most."""
    return PLACE_LIMIT if service == PLACES else most


def request_url(service: str, query: str, most: int = 3, kind: str = "primary") -> str:
    """The address of a search."""
    if (service, kind) not in SEARCHES:
        raise ValueError(f"no service {service!r}")
    base, params = SEARCHES[service, kind]
    n = limit_of(service, most)
    values = {"$query": query, "$most": str(n), "$rows": str(2 * n)}
    return f"{base}?{urllib.parse.urlencode({k: values.get(v, v) for k, v in params.items()})}"


@dataclass(frozen=True)
class HttpGet:
    """GET with a time-out, and a pause after every request, failed ones included."""

    timeout: float = 10.0
    pause: float = 0.5

    def __call__(self, url: str) -> str:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "colophon"}), timeout=self.timeout) as r:
                return r.read().decode("utf-8")
        finally:
            time.sleep(self.pause)


def ask(asked: DataFrame, factory: Callable[[], Callable[[str], str]] = HttpGet, most: int = 3, at_once: int = 4) -> DataFrame:
    """Payloads of (service, query) rows, or of those with ``place`` (0: primary) and ``asked`` (what is sent).

    An error stays with its row.  ``at_once`` bounds the parallel requests.
    """
    if "place" not in asked.columns:
        return ask(_primary(asked), factory, most, at_once).drop("place", "asked")

    def run(batches):
        get = factory()
        for pdf in batches:
            rows = []
            for service, query, place, text in zip(pdf["service"], pdf["query"], pdf["place"], pdf["asked"]):
                began, payload, error = time.monotonic(), None, None
                try:
                    payload = get(request_url(service, text, most, "fallback" if place else "primary"))
                except Exception as e:  # one failing request must not stop the others
                    payload, error = None, f"{type(e).__name__}: {e}"
                rows.append((place, text, service, query, payload, time.monotonic() - began, error))
            yield pd.DataFrame(rows, columns=["place", "asked", "service", "query", "payload", "seconds", "error"])

    asked = asked.select("service", "query", "place", "asked").distinct()
    return asked.repartition(at_once, "service", "query").mapInPandas(run, _ASKED)


def _primary(asked: DataFrame) -> DataFrame:
    return asked.select("service", "query", F.lit(0).alias("place"), F.col("query").alias("asked"))


def fault(service: Column, payload: Column) -> Column:
    """Why a payload can't be read, or null."""
    xml = F.when(service.startswith("Getty"), terms.xml_fault(F.when(service.startswith("Getty"), payload), "Getty"))
    found = F.when(service == "LCSH", terms.json_fault(payload, "$.hits", "LCSH"))
    found = found.when(service.isin("FAST", PLACES), terms.json_fault(payload, "$.response.docs", "FAST"))
    return F.coalesce(found, xml)


def checked(payloads: DataFrame) -> DataFrame:
    """``payloads`` with an error at each malformed one: an answer that can't be read is no answer without terms."""
    wrong = F.when(F.col("error").isNull(), fault(F.col("service"), F.col("payload")))
    return payloads.withColumn("error", F.coalesce("error", wrong))


def parse(payloads: DataFrame) -> DataFrame:
    """service, query, hit_pos, term of each payload (and place, asked where there are such)."""
    p = F.col("payload")
    keys = [c for c in ("service", "query", "place", "asked") if c in payloads.columns]
    found = (
        F.when(F.col("service") == "LCSH", terms.lcsh_terms(p))
        .when(F.col("service") == "FAST", terms.fast_terms(p))
        .when(F.col("service") == PLACES, terms.fast_terms(p, PLACES, with_tag=True))
        .when(F.col("service") == "Getty AAT", terms.getty_terms(F.when(F.col("service") == "Getty AAT", p), "Getty AAT"))
        .when(F.col("service") == "Getty TGN", terms.getty_terms(F.when(F.col("service") == "Getty TGN", p), "Getty TGN"))
    )
    return payloads.where("error IS NULL").select(*keys, F.posexplode(terms.distinct_by_uri(found)).alias("hit_pos", "term"))


def fallbacks(service: Column, query: Column) -> Column:
    """What a service is asked, in order, where its primary search gave too little."""
    out = F.when(service.isin("LCSH", PLACES), F.array(query))
    for kind in ("FAST", "Getty AAT", "Getty TGN"):
        out = out.when(service == kind, fallback_words(query, kind))
    return F.coalesce(out, F.array().cast("array<string>"))


def services(asked: DataFrame, factory: Callable[[], Callable[[str], str]] = HttpGet, cache: DataFrame | None = None, most: int = 3, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """(service, query, terms) of each (service, query) that was answered, and all payloads with their errors.

    First the cache, then the primary search, then, place by place, the fallbacks of those that still have too few
    different terms (LCSH: fewer than it may give; others: none), each hit checked.  A failed primary search leaves
    its query without an answer; a failed fallback only adds nothing.  Rounds are as many as a query has fallbacks.
    """
    spark = asked.sparkSession
    asked = asked.select("service", "query").distinct()
    hits = cache.join(asked, ["service", "query"], "left_semi").select("service", "query", "terms") if cache is not None else spark.createDataFrame([], CACHE)
    misses = asked.join(hits, ["service", "query"], "left_anti") if cache is not None else asked
    payloads = cut(checked(ask(_primary(misses), factory, most, at_once)))
    found = cut(parse(payloads))
    limit = F.when(F.col("service") == PLACES, PLACE_LIMIT).otherwise(most)
    answered = payloads.where("error IS NULL").select("service", "query")

    def short(found: DataFrame) -> DataFrame:
        n = found.groupBy("service", "query").agg(F.countDistinct("term.uri").alias("n"))
        return answered.join(n, ["service", "query"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < limit)

    first = short(found).where((F.col("n") == 0) | (F.col("service") == "LCSH"))
    plan = cut(first.select("service", "query", F.posexplode(fallbacks(F.col("service"), F.col("query"))).alias("place", "asked")).withColumn("place", F.col("place") + 1))
    last = plan.agg(F.max("place")).first()[0] or 0
    may = F.lit(True)
    for kind in ("FAST", PLACES, "Getty AAT"):
        may = F.when(F.col("service") == kind, accepted(F.col("term.label"), F.col("query"), kind, F.col("term.type"))).otherwise(may)
    for place in range(1, last + 1):
        due = plan.where(F.col("place") == place).join(short(found).select("service", "query"), ["service", "query"])
        more = cut(checked(ask(due, factory, most, at_once)))
        payloads = payloads.unionByName(more)
        found = cut(found.unionByName(parse(more).where(may)))
    again = Window.partitionBy("service", "query", "term.uri").orderBy("place", "hit_pos")
    once = found.withColumn("again", F.row_number().over(again)).where((F.col("again") == 1) | (F.col("term.uri") == ""))
    once = once.withColumn("pos", F.row_number().over(Window.partitionBy("service", "query").orderBy("place", "hit_pos"))).where(F.col("pos") <= limit)
    lists = once.groupBy("service", "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))
    fresh = answered.join(lists, ["service", "query"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(f"array<struct<{terms.TERM}>>")))
    return hits.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False))), payloads


CACHE = "service string, query string, terms array<struct<" + terms.TERM + ">>"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Answers kept from earlier runs; none if there is nothing readable."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except Exception:  # a missing or unreadable cache only means that everything is asked
        return spark.createDataFrame([], CACHE)


def write_cache(parsed: DataFrame, payloads: DataFrame, path: str) -> None:
    """Keep the terms of every query that was answered, those without terms included; failures are asked again."""
    answered = checked(payloads).where("error IS NULL").select("service", "query")
    found = parsed.groupBy("service", "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("hit_pos", "term"))), lambda x: x["term"]).alias("terms"))
    none = F.array().cast(f"array<struct<{terms.TERM}>>")
    answered.join(found, ["service", "query"], "left").withColumn("terms", F.coalesce("terms", none)).write.mode("append").parquet(path)


def keep_answers(answers: DataFrame, path: str) -> None:
    """Keep what ``services`` asked now, queries without terms included; failures have no row, so they are asked again."""
    answers.where("NOT cached").select("service", "query", "terms").write.mode("append").parquet(path)
