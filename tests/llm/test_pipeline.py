"""The pipeline as a whole, over the driver's tables and over odd ones."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from trackloom.llm import decontaminate, mixing, store, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, found string"
BENCH = " ".join(f"b{i}" for i in range(14))


def words(n, at=0):
    return " ".join(f"w{at + i}" for i in range(n))


def made(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("i", BENCH), (None, None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_are_those_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontaminate", "mixing", "sharding"]
    assert all(f.__doc__ for _, f in corpus_pipeline.STAGES)


def test_every_stage_acts_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")), ["doc_id"]).where("toxicity.score >= 0.5").collect()}
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        kept[name] = Counter(r.doc_id for r in now.collect())
        assert now.columns == docs.columns + (["shard", "slot"] if name == "sharding" else [])
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    assert set(kept["toxicity"]) == every - toxic
    assert set(kept["near_dup"]) <= set(kept["toxicity"]) and max(kept["near_dup"].values()) == 1
    leaks = {r.doc_id for r in decontaminate.report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert set(kept["decontaminate"]) == set(kept["near_dup"]) - leaks
    assert set(kept["mixing"]) <= set(kept["decontaminate"]) and max(kept["mixing"].values()) <= mixing.MOST
    assert kept["sharding"] == kept["mixing"]
    slots = {}
    for r in now.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_odd_rows(spark, tmp_path):
    rows = [(1, words(60), "en", "a", 1, 7, "x"), (2, words(59) + " tail", "en", "a", 1, 7, "x"), (3, f"say {BENCH} done", "en", "b", 1, 7, "x"), (4, None, None, None, None, None, None), (5, "", "en", "b", 1, 7, "x"), (6, words(20, 500), None, None, 1, None, None)]
    rows += [(6, words(20, 500), None, None, 1, None, None)] * 3 + [(None, words(30, 900), "en", "b", 1, 7, "x")] * 2 + [(7, words(30_000, 2000), "en", "a", 1, 7, "x")]
    shared = Path(store.shared_dir(spark).removeprefix("file:")) / "trackloom"
    before = set(shared.glob("*"))
    out = corpus_pipeline.run(spark, made(spark, tmp_path, rows))
    assert [p.name.split("-")[0] for p in set(shared.glob("*")) - before] == ["sharding"]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "found", "shard_", "slot"]
    got = Counter(r.doc_id for r in out.collect())
    assert not {2, 3} & set(got) and set(got) <= {None, 1, 6, 7} and max(got.values()) <= 2
    assert all(r.shard == 7 for r in out.where("doc_id in (1, 7)").collect())


@pytest.mark.parametrize("folder", ["empty"])
def test_empty_tables(spark, tmp_path, folder):
    out = corpus_pipeline.run(spark, made(spark, tmp_path / folder, []))
    assert out.count() == 0 and out.columns[-2:] == ["shard_", "slot"]


def test_threads_do_not_remove_each_others_tables(spark):
    """One pipeline settles a stage while another is between keeping a table and reading it."""
    import threading

    kept, settled_now, out = threading.Event(), threading.Event(), {}

    def slow():
        def make():
            table = store.keep(spark.range(5), "slow")
            kept.set()
            settled_now.wait(60)
            return table

        out["slow"] = store.settled(spark, make, "slow_result")[0].count()

    thread = threading.Thread(target=slow)
    thread.start()
    assert kept.wait(60)
    out["fast"] = store.settled(spark, lambda: store.keep(spark.range(3), "fast"), "fast_result")[0].count()
    settled_now.set()
    thread.join(60)
    assert out == {"slow": 5, "fast": 3}
