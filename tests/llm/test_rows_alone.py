"""A row's result depends on its own text and on the tables, not on its neighbours or on the partitioning."""

from __future__ import annotations

import numpy as np
import pytest

from trackloom.llm import decontaminate, html_text, language, media, mixing, near_dup, pii, quality, sharding, toxicity

SF = "/root/testdata/sf0.001"
TEXTS = [b"", b"a", b" word", b"ends with ", b"Die Sonne scheint.", "été à Noël".encode(), b"x y " * 300]


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


REPORTS = {
    "op1": lambda d, s: mixing.report(d),
    "op2": lambda d, s: toxicity.report(d, table(s, "labels")),
    "op4": lambda d, s: quality.report(d, table(s, "labels")),
    "op5": lambda d, s: pii.report(d),
    "op6": lambda d, s: sharding.report(d),
    "op7": lambda d, s: decontaminate.report(d, table(s, "benchmark")),
    "op8": lambda d, s: media.report(d),
    "op9": lambda d, s: language.report(d),
    "op10": lambda d, s: near_dup.near_duplicates(d),
}


def rows(out):
    return sorted((tuple(r) for r in out.select(*sorted(out.columns)).collect()), key=lambda r: repr([x for x in r if not isinstance(x, float)]))


@pytest.mark.parametrize("name", REPORTS)
def test_the_partitioning_changes_nothing(spark, name):
    docs = table(spark, "documents")
    one, other = (rows(REPORTS[name](d, spark)) for d in (docs.coalesce(1), docs.repartition(7)))
    assert len(one) == len(other) == docs.count()
    for a, b in zip(one, other, strict=True):
        assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]
        assert np.allclose([x for x in a if isinstance(x, float)], [x for x in b if isinstance(x, float)], rtol=0, atol=1e-9)


def test_pages_do_not_depend_on_the_partitioning(spark):
    pages = table(spark, "pages")
    assert rows(html_text.extract(pages.coalesce(1))) == rows(html_text.extract(pages.repartition(7)))


@pytest.mark.parametrize("text", TEXTS)
def test_a_text_has_one_vector_wherever_it_stands(text):
    vectors = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIMENSIONS))
    others = [b"Other text", b"", b"end"]
    for f in (language.counts, lambda x: quality.pooled(x, vectors)):
        alone = f([text])[0]
        for at, run in ((0, [text, *others]), (1, [others[0], text, *others[1:]]), (3, [*others, text])):
            assert np.allclose(f(run)[at], alone, rtol=0, atol=1e-12)


def test_long_texts_lose_nothing_at_cuts(monkeypatch):
    text = "Das ist ein längerer Text, der geschnitten wird. ".encode() * 20
    whole = language.counts([text])
    monkeypatch.setattr(language, "PIECE", 37)
    assert (language.counts([text]) == whole).all()
    tokens = np.arange(1000)
    made = [(run[max(0, i - 2) : i + 3].tolist(), int(run[i])) for run, inner in quality._merged([tokens], 64) for i in range(len(run))[inner]]
    assert [own for _, own in made] == [*range(1000)]
    assert all(near == [x if 0 <= x < 1000 else -1 for x in range(own - 2, own + 3)] for near, own in made if own >= 0)
