import collections
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colophon.llm import exact_dedup, language_id, mixing, sentencepiece_nbest

from .test_dedup import near_brute

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    kept = corpus_pipeline.identify_language(spark, docs, str(DATA))
    said = language_id.identify(docs)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in said.where("NOT rejected").collect()}
    exact = corpus_pipeline.drop_exact_copies(spark, kept, str(DATA))
    largest = kept.groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.max("doc_id").alias("d"))
    assert sorted(r.doc_id for r in exact.collect()) == sorted(r.d for r in largest.collect())
    near = corpus_pipeline.drop_near_copies(spark, exact, str(DATA))
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c, _ in near_brute(exact.collect())})
    mixed = corpus_pipeline.mix_sources(spark, near, str(DATA)).collect()
    want = collections.Counter()
    for r in mixing.mixed_counts(near).collect():
        if r.taken:
            want[r.doc_id] = r.taken // r.size
    assert collections.Counter(r.doc_id for r in mixed) == want
    assert all(set(df.columns) == set(docs.columns) for df in (kept, exact, near))
    whole = corpus_pipeline.run(spark, str(DATA)).collect()
    v = sentencepiece_nbest.Vocabulary(sentencepiece_nbest.read_model())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert collections.Counter(r.doc_id for r in whole) == want
    assert all(v.decode(r.ids) == texts[r.doc_id] and r.round_trip for r in whole)


def test_stages_on_nothing(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(DATA)).count() == 0


def test_operators_behind_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    assert exact_dedup.drop_copies and corpus_pipeline.ORACLE_SQL is None
