"""Trained operators: held-out figures on the driver's tables, and odd tables."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from trackloom.llm import language, quality, toxicity

def read(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


@pytest.fixture(scope="module")
def tables(spark):
    return read(spark, "sf0.01")


def odd(spark):
    rows = [(1, None, None, "a", 1.0), (2, "", "en", "a", 1.0), (2, "", "en", "a", 1.0), (None, "no id", "en", None, 1.0), (3, "1234 !!", None, "b", 1.0), (4, "word " * 30_000, "en", "b", 1.0), (5, "x", "fr", "b", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame([(1, 1, None), (4, 0, 1), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def checked(out, docs, predicted, least):
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if predicted:
            assert r.predicted == int(r.score >= least)
    return rows


def test_toxic_documents_are_told_from_clean_ones(spark):
    docs, labels = read(spark, "sf0.1")
    out = toxicity.report(docs, labels)
    checked(out, docs, True, 0.5)
    held = out.where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in held}
    assert share[0] <= 0.01 and share[1] >= 0.8
    clean = toxicity.clean(docs, labels)
    assert clean.columns == docs.columns and 0.85 < clean.count() / docs.count() < 0.97


def test_offending_sentences_are_located(spark):
    rows = [(i, f"A calm line number {i}. Another one." + (f" You vile{'st' * (i % 2)} thing {i}!" if i % 3 == 0 else ""), 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.train(docs, labels))
    assert out.columns == [*docs.columns, "toxicity_"]
    row = out.where("doc_id = 3").first()
    assert row["toxicity_"].score > 0.5 and [x.sentence for x in row["toxicity_"].offending] == ["You vilest thing 3!"]


def test_quality_is_learned(spark, tables):
    docs, labels = tables
    out = quality.report(docs, labels)
    checked(out, docs, True, 0.3)
    held = out.where("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.9


def test_language_is_learned(spark, tables):
    docs = tables[0]
    out = language.report(docs)
    checked(out, docs, False, 0)
    held = out.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.95


def test_odd_tables(spark):
    docs, labels = odd(spark)
    checked(toxicity.report(docs, labels), docs, True, 0.5)
    checked(quality.report(docs, labels), docs, True, 0.3)
    langs = {r.doc_id: r.lang_pred for r in checked(language.report(docs), docs, False, 0)}
    assert langs[1] == langs[2] == langs[3] == "und" and langs[5] in ("en", "fr")
    none, no_labels = docs.limit(0), labels.limit(0)
    for out in (toxicity.report(none, no_labels), quality.report(none, no_labels), language.report(none)):
        assert out.count() == 0
    assert toxicity.report(docs, no_labels).count() == quality.report(docs, no_labels).count() == 7
