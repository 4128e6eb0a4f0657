"""Operators whose results are fixed by their contract, against plain Python over small and odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import components, decontaminate, mixing, near_dup, pii, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rid string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 1, 7, "x") for d, t, s in rows], SCHEMA).repartition(3)


def words(n, at=0):
    return " ".join(f"w{at + i}" for i in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t", None), (4, "one", "b"), (4, "one", "b"), (5, "Two words", "b"), (6, "é " * 50, None), (None, "no id at all here now", "b"), (7, words(30_000), "c")]
COPIES = [(100 + i, words(40) + f" tail{i % 3}", "hot") for i in range(60)] + [(300 + i, words(60, 100 + i % 7), "b") for i in range(30)]


# ---- near duplicates


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    ids = sorted({d for d, _, _ in rows if d is not None})
    sets, up = {d: shingle_set(t) for d, t, _ in rows}, {d: d for d in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            s, t = sets[i], sets[j]
            if i < j and s and 100 * len(s & t) >= 85 * len(s | t):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, small):
    """Also with chunks so small that groups go through centres and pairs of chunks."""
    if small:
        monkeypatch.setattr(near_dup, "BUCKET_CHUNK", 4)
        monkeypatch.setattr(near_dup, "CLUSTER_CHUNK", 150)
        monkeypatch.setattr(near_dup, "CENTRES", 2)
    near = [(500 + i, words(100 - i, 5_000) + " " + words(i, 9_000 + 50 * i), "n") for i in range(12)]
    rows = ODD + COPIES + near
    got = near_dup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = classes(rows)
    for r in got:
        if r.doc_id is None:
            assert not r.kept or r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1]), r


def test_links_between_texts_near_different_centres(spark, monkeypatch):
    """The centres 1 and 2 settle 4 and 3; only the link of these two joins the balls."""
    monkeypatch.setattr(near_dup, "CLUSTER_CHUNK", 150)
    monkeypatch.setattr(near_dup, "CENTRES", 2)
    rows = [(d, words(100, 1_000 + at), "n") for d, at in ((1, 0), (4, 6), (3, 12), (2, 18))]
    got = near_dup.near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 1}


@pytest.mark.parametrize("exact", [False, True])
def test_chains_of_shuffled_ids_stay_whole(spark, exact):
    """Groups of two chains that don't touch, in which balls of centres touch in many ways."""
    random, rows, want = np.random.default_rng(5), [], set()
    for key in range(40):
        ids = (random.permutation(60) + 100 * key).tolist()
        for i, rid in enumerate(ids):
            at = 8 * (i % 30)
            odd = np.packbits(np.r_[np.arange(256) < at, np.full(256, i >= 30)]).tobytes()
            values = np.arange(at, at + 100, dtype=np.uint64) + np.uint64(10_000 * (i >= 30))
            rows.append((key, 60, rid, 1, bytearray(odd), bytearray(values.tobytes())))
        want |= {(rid, min(part)) for part in (ids[:30], ids[30:]) for rid in part}
    df = spark.createDataFrame(rows, "key long, size long, rid long, weight long, odd binary, set binary").repartition(5)
    # links of the chains reach over one step by the sets, over three by the bitmaps
    tests = {"exact": near_dup._exact((85, 100)), "most": 40, "wide": near_dup._exact((70, 100))} if exact else {"most": 24}
    links = near_dup._linked_within(df if exact else df.drop("set"), 7, **tests)
    assert {(r.id, r.component) for r in components.components(links).collect()} == want


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(table(spark, [])).count() == 0
    assert near_dup.distinct_documents(table(spark, [])).count() == 0


def test_one_document_of_each_class_stays(spark):
    rows = ODD + COPIES
    want = classes(rows)
    kept = near_dup.distinct_documents(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(d for d in want if want[d][1] == d)


def test_the_pipeline_drops_near_copies_from_0_80_on(spark):
    """Similarity 0.81 (1 and 2) is one document to the pipeline and two to the query; 0.78 (3 and 4) is two to both."""
    rows = [(d, words(100, at), "n") for d, at in ((1, 0), (2, 10), (3, 1_000), (4, 1_012))]
    docs = table(spark, rows)
    assert sorted(r.doc_id for r in corpus_pipeline._near_dup(spark, docs, "").collect()) == [1, 3, 4]
    assert all(r.kept for r in near_dup.near_duplicates(docs).collect())
    assert near_dup._most_bits((85, 100), near_dup.BANDS * near_dup.ROWS) == near_dup.MOST_BITS


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ---- benchmark decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item, body in items:
        b = plain_words(body)
        n = min(10, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    best = min(((-n, at, item) for item, _, at, n in longest(text, items)), default=(0, None, None))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), -best[0], *best[1:]


@pytest.mark.parametrize("slice_bytes", [16 << 20, 300])
def test_benchmark_windows_match_brute_force(spark, slice_bytes):
    items = [("i1", words(25, 50)), ("i2", "Short item"), ("i10", words(12, 60)), ("i3", ""), ("i4", None), ("i5", words(12, 60)), ("i6", "solo")]
    docs = ODD + [(20, "x, y " + words(30, 45) + " z", "a"), (21, "a SHORT-item; and solo", "a"), (22, words(9, 50), "a"), (23, words(10, 50) + " gap " + words(11, 61), "a"), (24, (words(12, 60) + " ") * 3, "a")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    want = Counter((d, *leaks(t, items)) for d, t, _ in docs)
    found = decontaminate.matched(table(spark, docs), benchmark, ["doc_id"], slice_bytes=slice_bytes)
    for r in found.collect():
        assert sum(b - a for a, b in r.found.hits) in {w[2] for w in want if w[0] == r.doc_id}
    assert Counter(tuple(r) for r in decontaminate.report(table(spark, docs), benchmark).collect()) == want
    clean = decontaminate.clean(table(spark, docs), benchmark)
    assert clean.columns == table(spark, []).columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(w[0] for w, n in want.items() for _ in range(n) if not w[5])


def test_longest_matches_have_their_places(spark):
    benchmark = spark.createDataFrame([("i", words(25, 50))], "item_id string, text string")
    row = decontaminate.matched(table(spark, [(1, "a b c " + words(20, 55) + " d", "s")]), benchmark).first()
    assert [tuple(m) for m in row.found.matches] == [("i", 5, 3, 20)]


def longest(text, items):
    """(item, its place, the text's place, words) of all matches of a window or more that can't be extended."""
    w, out = plain_words(text), set()
    for item, body in items:
        b = plain_words(body)
        for i in range(len(w)):
            for j in range(len(b)):
                n = 0
                while i + n < len(w) and j + n < len(b) and w[i + n] == b[j + n]:
                    n += 1
                if n and n >= min(10, len(b)) and not (i and j and w[i - 1] == b[j - 1]):
                    out.add((item, j, i, n))
    return out


def test_longest_matches_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 64)
    items = [("a", words(40)), ("b", "r r r r r r r r r r r r r s"), ("c", "one two three"), ("d", words(11, 5) + " x " + words(11, 5)), ("e", "é")]
    docs = [(i, t, "s") for i, t in enumerate([words(60), "q " + "r " * 30 + "s " + words(15, 3), "One, two! three one two three", words(11, 5) + " x " + words(13, 5), "", None, "ok é"])]
    got = decontaminate.matched(table(spark, docs), spark.createDataFrame(items, "item_id string, text string")).collect()
    for r in got:
        assert {tuple(m) for m in r.found.matches} == longest(r.text, items), r.doc_id


def test_items_without_ids_are_sliced_by_size(spark):
    items = spark.createDataFrame([(None, words(30, 50 * i)) for i in range(20)], "item_id string, text string")
    assert len(decontaminate._sliced(items.select(F.lit("").alias("item_id"), "text"), 400)) > 5
    docs = table(spark, [(i, words(12, 50 * i + 3), "s") for i in range(20)] + [(99, "clean text", "s")])
    found = {r.doc_id: r.found for r in decontaminate.matched(docs, items, ["doc_id"], slice_bytes=400).collect()}
    assert all(found[i].hits == [[0, 12]] and found[i]["items"] == [""] for i in range(20)) and found[99].hits == []


def test_one_scan_meets_all_slices(spark, monkeypatch):
    """Five slices and blocks of few pairs: one pass over the documents, and the matches of one slice."""
    items = spark.createDataFrame([(f"i{i}", words(40, 13 * i)) for i in range(10)], "item_id string, text string").repartition(1).cache()
    docs = table(spark, [(i, words(30 + i, 11 * i), "s") for i in range(20)] + ODD)
    want = {(r.doc_id, str(r.found)) for r in decontaminate.matched(docs, items, ["doc_id"]).collect()}
    monkeypatch.setattr(decontaminate, "PAIRS", 4)
    made = decontaminate.matched(docs, items, ["doc_id"], slice_bytes=400)
    assert len(decontaminate._sliced(items, 400)) >= 5
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, str(r.found)) for r in made.collect()} == want


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert {r.contaminated for r in decontaminate.report(table(spark, ODD), none).collect()} == {False}
    assert decontaminate.report(table(spark, []), none).count() == 0


# ---- mixing


def targets(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return sizes, target


def test_mix_meets_its_targets(spark):
    rows = ODD + COPIES
    got = mixing.report(table(spark, rows)).collect()
    sizes, target = targets(rows)
    source = {d: s for d, _, s in rows}
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r.source_size, r.target) == (sizes[s], pytest.approx(target[s]))
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.report(table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_index_permutations_are_permutations(spark):
    sizes = [1, 2, 3, 5, 16, 17, 255, 256, 257, 1000, 65_536]
    pairs = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    made = pairs.withColumn("p", mixing._permuted(F.col("i"), F.col("n"), F.col("seed"))).groupBy("n", "seed").agg(F.count_distinct("p").alias("d"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.sum((F.col("p") == F.col("i")).cast("int")).alias("fixed")).collect()
    assert len(made) == 2 * len(sizes)
    assert all((r.d, r.lo, r.hi) == (r.n, 0, r.n - 1) for r in made)
    assert all(r.fixed < 10 for r in made if r.n > 200)


@pytest.mark.parametrize("slots", [40_000, 65_536])
def test_shard_counts_spread_as_a_multinomial_draw(spark, slots):
    shard, share = 512, 0.3
    dealt = spark.range(int(slots * share)).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(20)))).select("seed", F.floor(mixing._permuted(F.col("id"), F.lit(slots), F.col("seed")) / shard).alias("shard"))
    counts = defaultdict(int, {(r.seed, r.shard): r["count"] for r in dealt.groupBy("seed", "shard").count().collect()})
    whole = [counts[s, k] for s in range(1, 21) for k in range(slots // shard)]
    want = shard * share * (1 - share)
    assert abs(np.mean(whole) - shard * share) < 1
    assert 0.8 * want < np.var(whole) < 1.2 * want
    # the first and second half of a shard's neighbours go together neither
    pairs = np.array(whole).reshape(20, -1)
    assert abs(np.corrcoef(pairs[:, :-1].ravel(), pairs[:, 1:].ravel())[0, 1]) < 0.15


def test_blocks_of_the_mix_hold_whole_words(spark):
    docs = table(spark, COPIES)
    mix = mixing.Mix(docs, block=16, shard_slots=8)
    texts = mix.packed(docs).collect()
    assert sum(len(r.text.split()) for r in texts) == sum(r.taken for r in mix.taken().collect())
    assert all(len(r.text.split()) <= 16 for r in texts)
    assert len({(r.shard, r.place, r.source) for r in texts}) == len(texts)


def test_slots_and_blocks_are_joined_without_a_broadcast(spark):
    """They look as small as what they are exploded from, whatever their number."""
    plan = mixing.Mix(table(spark, COPIES), block=1).pieces()._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in x and "block" in x for x in plan.splitlines())


def test_mix_of_nothing_and_many_equal_rows(spark, monkeypatch):
    assert mixing.report(table(spark, [])).count() == 0
    assert mixing.mixed_documents(table(spark, [])).count() == 0
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rows = [(1, "a b c", "s")] * 50 + [(2, "d e", "t")] * 3
    got = mixing.report(table(spark, rows)).collect()
    assert len(got) == 53 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mixed_documents(table(spark, rows)).columns == table(spark, []).columns


# ---- sharding


def check_shards(got, n):
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < n and (r.grown_shard == r.shard or r.grown_shard == n)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_are_gapless_and_grow_into_the_new_one(spark):
    rows = ODD + COPIES
    got = sharding.report(table(spark, rows)).collect()
    check_shards(got, 24)
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by_key = defaultdict(set)
    for r in got:
        by_key[r.doc_id].add(r.shard)
    assert all(len(x) == 1 for x in by_key.values())


def test_a_row_that_repeats_fills_more_than_one_bucket(spark):
    rows = spark.createDataFrame([(1, 5, 9)] * 200 + [(i, 5, 9) for i in range(50)] + [(None, None, 9)] * 30, "k long, m long, z long")
    got = sharding.shuffled(rows, "k", "m", "z", shards=3, bucket_rows=16).select("r.k", "shard", "slot", "grown_shard").collect()
    assert len(got) == 280
    check_shards(got, 3)


def test_fisher_yates_permutes(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 17):
        assert sorted(spark.range(1).select(sharding.fisher_yates(F.lit(n), F.lit(1)).alias("x")).first().x) == list(range(n))


def test_sharded_documents_keep_clashing_columns(spark):
    out = sharding.sharded_documents(table(spark, COPIES))
    assert out.columns == [*table(spark, []).columns, "shard_", "slot"]
    assert out.where("shard = 7").count() == len(COPIES)
    assert sharding.report(table(spark, [])).count() == 0


# ---- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ip = kind != "ip" or all(int(p) <= 255 for p in m[0].split("."))
            if ip and {"card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}.get(kind, True):
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_matches_the_plain_patterns(spark):
    card = "4111 1111-1111 1111"
    texts = [
        None, "", "mail a.b@c.de, a@b.c@d.e @x.y a@b a@-.-", "😀 x@y.zz é+49 (30) 123-4567 8", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 000001.2.3.255", card + " " + card, "44111111111111111 4111111111111111-", "+1 2 +123456789 ++49123456789", "a@b.c" * 5,
        "1.2.3 4.5.6.7 " + "9" * 400, "+4 ....... 12345678 +49 1234567890123456", "id 4111111111111111 4111 1111 1111 1112 and 5500005555555559", "x" * 50_000 + "@y.com " + "1." * 5_000, "a@b.co.é z@q.ŕ 1.1.1.1١",
    ]
    got = {r.doc_id: r for r in pii.report(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        counts = Counter(k for k, _, _ in want)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PLAIN), (i, t)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (i, t)
        assert [x for x in r.spans.split(",") if x and not x.startswith(("term", "secret"))] == [f"{k}:{a}:{b}" for k, a, b in want]


def test_terms_that_give_an_entity_away_are_spans_too(spark):
    rows = [(i, f"note {i} by Zorvath, zor@vath.org, about thing {i}", "s") for i in range(6)] + [(50 + i, f"other note {i} about thing", "s") for i in range(40)]
    docs = table(spark, rows)
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    text = dict((d, t) for d, t, _ in rows)
    for i in range(6):
        assert "zorvath" in {text[i][int(a) : int(b)].lower() for k, a, b in (x.split(":") for x in got[i].split(",")) if k == "term"}
    assert all(got[50 + i] == "" for i in range(40))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "zor" not in clean[0].lower() and "[EMAIL]" in clean[0] and clean[50] == text[50]
    assert pii.report(table(spark, [])).count() == 0


def hexes(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


def planted():
    rows = [(i, f"note {i} about thing, access token = \"{hexes(i)}\" word{i % 9} end", "s") for i in range(12)]
    rows += [(20 + i, f"Dr Quillfeather {'wrote' if i % 2 else 'rang'} from quill{i}@clinic.example.org on day{i} about thing", "s") for i in range(6)]
    rows += [(30 + i, f"plain note {i} about thing and day{i}, nothing else", "s") for i in range(40)]
    rows += [(90, "The far report names Quillfeather, though no address. quillfeather! Unquillfeathered.", "s"), (91, None, "s"), (91, None, "s"), (None, "null id, Quillfeather", "s"), (None, "null id, Quillfeather", "s")]
    rows += [(92, "é" * 200 + " İİ Quillfeather " + "x1 " * 2000 + "QUILLFEATHER", "s")]
    return rows


def counted(rows):
    """Classes of kind 0 and kind 4, and words and phrases within reach, counted by hand."""
    phrases = lambda ws: ws + [f"{v} {w}" for v, w in zip(ws, ws[1:], strict=False)]
    near, places, of, holds = {}, {}, {}, {}
    for at, (_, t, _) in enumerate(rows):
        t = t or ""
        for w in set(phrases(re.findall(r"[^\W_]+", t.lower()))):
            holds.setdefault(w, set()).add(at)
        for kind, pattern in ((0, r"[a-z0-9]+@([a-z0-9.]+)"), (4, r"\b[a-z0-9]{20,}\b")):
            for m in re.finditer(pattern, t):
                if kind == 4 and len(re.findall("[0-9]+", m[0])) < 5:
                    continue
                left, right = t[: m.start()], t[m.end() :]
                before, behind = (re.findall(r"[^\W_]+", x.lower()) for x in (left[-48:], right[:48]))
                if len(left) > 48 and left[-49:-47].isalnum():
                    before = before[1:]
                if len(right) > 48 and right[47:49].isalnum():
                    behind = behind[:-1]
                for e in [f"{kind}:kind:", f"{kind}:own:{m[0]}", f"0:group:{m[1]}" if kind == 0 else "4:group:token="]:
                    of.setdefault(e, set()).add(at)
                    for w in phrases(before) + phrases(behind):
                        near.setdefault((e, w), set()).add(at)
                        places.setdefault((e, w), set()).add((left[-48:], right[:48]))
    out = {}
    for (e, w), docs in near.items():
        p, q = len(of[e]) / len(rows), len(docs) / len(holds[w])
        if len(places[e, w]) >= 3 and math.log(q / p) >= 0.9 * -math.log(p):
            out[e, w] = (len(rows), len(of[e]), len(holds[w]), len(docs))
    return out


def test_what_discloses_is_counted_as_by_hand(spark):
    rows = [r for r in planted() if r[0] != 92]
    docs = table(spark, rows)
    places = pii.secret_places(docs).cache()
    assert [r.place for r in places.collect()] == ["token="]
    ents = pii.entities(pii.found_in(docs, None, places).cache(), places)
    got = {(r.entity, r.term): (r.total, r.with_entity, r.with_term, r.both) for r in pii.disclosing(docs, ents.cache(), pii.surroundings(ents)).collect()}
    assert got == counted(rows)
    assert ("4:kind:", "token") in got and ("4:group:token=", "access token") in got and ("0:group:clinic.example.org", "dr") in got and ("4:kind:", "about") not in got


def test_terms_are_spans_wherever_they_stand(spark):
    rows = planted()
    got = [(r.doc_id, r.spans) for r in pii.report(table(spark, rows)).collect()]
    assert len(got) == len(rows)
    # with the far mentions the name gives away less than the others, but still enough at a lower threshold
    low = [(r.doc_id, r.spans) for r in pii.report(table(spark, rows), disclosure=0.5).collect()]
    text = {d: t or "" for d, t, _ in rows}
    words = lambda d, spans: sorted((k, text[d][int(a) : int(b)]) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    for d, spans in got:
        if d is not None and d < 12:
            assert {("secret", hexes(d)), ("term", "token")} <= set(words(d, spans))
    assert words(90, dict(low)[90]) == [("term", "Quillfeather"), ("term", "quillfeather")]
    assert words(92, dict(low)[92]) == [("term", "QUILLFEATHER"), ("term", "Quillfeather")]
    assert [s for d, s in low if d is None] == ["term:9:21"] * 2 and dict(low)[91] == "" and all(dict(low)[30 + i] == "" for i in range(40))


def test_terms_appear_on_the_drivers_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spans = pii.report(docs).select("spans").collect()
    kinds = Counter(x.split(":")[0] for r in spans for x in r.spans.split(",") if x)
    assert kinds["secret"] >= 10 and kinds["term"] >= 10


def test_names_of_two_words_disclose_each_kind_of_entity(spark):
    """First and last names are common, with every other name too; a pair of them stands beside one entity alone."""
    first, last = ["Anna", "Bert", "Cleo", "Dina"], ["Moor", "Nagel", "Orth", "Pfau"]
    values = ["anna@clinic.example.org", "10.20.30.40", "4111 1111 1111 1111", "+49 (30) 123-4567"]
    rows = []
    for n, value in enumerate(values):
        for i in range(5):
            rows.append((len(rows), f"case {'abcde'[i]} of kind {'xy'[i % 2]}: {first[n]} {last[n]} has {value} since {'abcde'[i]}", "s"))
    for i in range(60):
        a, b = i % 4, (i + 1 + i // 4 % 3) % 4
        rows.append((100 + i, f"on {'abcde'[i % 5]} {first[a]} {last[b]} has nothing of kind {'xy'[i % 2]}: since case {'abcde'[i % 5]}", "s"))
    rows += [(200 + n, f"later {first[n].upper()}, {last[n]} came; {first[n]} and {last[n]} left", "s") for n in range(4)]
    text = {d: t for d, t, _ in rows}
    got = {r.doc_id: [(k, text[r.doc_id][int(a) : int(b)]) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in pii.report(table(spark, rows), disclosure=0.85).collect()}
    for n, kind in enumerate(PLAIN):
        for i in range(5):
            assert (kind, values[n]) in got[5 * n + i] and ("term", f"{first[n]} {last[n]}") in got[5 * n + i]
        assert got[200 + n] == [("term", f"{first[n].upper()}, {last[n]}")]
    assert not any(got[100 + i] for i in range(60))


def places_by_hand(texts):
    """(place, n_values, tied, identifying), from the definition."""
    holds, at, of = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for w in re.findall(r"[^\W_]+", t):
            holds[w].add(i)
        for m in re.finditer(r"""(?<![^\W_])([^\W_]{1,64}+)[ "']{0,4}+([=:])[ "']{0,4}+([^\W_]++(?:[-_+/][^\W_]++)*+)""", t):
            at[m[1] + m[2], max(re.findall(r"[^\W_]+", m[3]), key=len)].add(i)
            of[m[1] + m[2]].add(i)
    out, n = {}, len(texts)
    for p, rows in of.items():
        words = [(len(x), len(holds[w])) for (q, w), x in at.items() if q == p]
        tied = [1 + math.log(k / d) / math.log(n / len(rows)) for k, d in words] if len(rows) < n else [0]
        own = [1 - math.log(d) / math.log(n) for _, d in words]
        out[p] = (len(words), sum(tied) / len(tied), sum(own) / len(own))
    return out


def test_places_of_secrets_are_found_by_counts_alone(spark):
    pets = ["otter", "heron", "badger", "marten", "plover"]
    rows = [(i, f"login of {pets[i % 5]}\npassword: '{a}-{b}/{a}{i}' level: {['low', 'high'][i % 2]} note: the {pets[i % 5]} is back", "s") for i, (a, b) in enumerate(zip(["vex", "jolt", "quag", "brim", "fump", "zest", "yawl"], "abcdefg", strict=True))]
    rows += [(10, 'password = \'\' password = ""', "s"), (11, "api_key=Umbra9 https://a.example/x", "s"), (12, 'the "KEY" = "corvid" of http://b.example/y', "s"), (13, "é key=ßtrøm here", "s"), (14, None, "s"), (14, None, "s")]
    rows += [(20, rows[0][1], "s")] * 4 + [(30 + i, f"the plain {pets[i % 5]} note {i}: the low and the high way", "s") for i in range(40)]
    docs = table(spark, rows)
    got = {r.place: (r.n_values, round(r.tied, 9), round(r.identifying, 9)) for r in pii.secret_places(docs, identity=0.5).collect()}
    want = places_by_hand([t for _, t, _ in rows])
    assert got == {p: (k, round(t, 9), round(o, 9)) for p, (k, t, o) in want.items() if k >= 3 and t >= 0.9 and o >= 0.5}
    assert set(got) == {"password:", "key="}
    text = {d: t for d, t, _ in rows}
    secret = {r.doc_id: {text[r.doc_id][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "secret"} for r in pii.report(docs).collect()}
    assert secret[1] == {"jolt-b/jolt1"} and secret[20] == secret[0] == {"vex-a/vex0"} and secret[11] == {"Umbra9"} and secret[12] == {"corvid"} and secret[13] == {"ßtrøm"}
    assert not any(secret[30 + i] for i in range(40)) and secret[14] == secret[10] == set()
    assert pii.secret_places(table(spark, [])).count() == pii.secret_places(table(spark, rows[:1])).count() == 0


def test_running_ends_over_many_runs(spark):
    sizes = [[], [3], [1, 2] * 100, list(range(5000))]
    rows = pii._with_ends(spark.createDataFrame([(i, x) for i, x in enumerate(sizes)], "i int, sizes array<bigint>")).collect()
    for r in rows:
        assert r.ends == [sum(sizes[r.i][: k + 1]) for k in range(len(sizes[r.i]))]


# ---- placement by the highest hash, shuffles by Fisher and Yates


def test_shards_have_the_highest_hash(spark):
    keys = spark.createDataFrame([(i,) for i in [None, 0, -5, *range(1000, 1300)]], "key long")
    scores = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.xxhash64(F.lit(sharding.SEED), k, F.col("key")))
    for r in keys.select(scores.alias("scores"), sharding.shard_of(F.col("key"), 7).alias("shard"), sharding.shard_of(F.col("key"), 8).alias("grown")).collect():
        assert r.shard == max(range(7), key=lambda k: (r.scores[k], k)) and r.grown == max(range(8), key=lambda k: (r.scores[k], k))
        assert r.grown in (r.shard, 7)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 60])
def test_shuffles_are_those_of_their_draws(spark, n):
    draws = F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: F.pmod(F.xxhash64(F.lit(3), F.lit(11), i), i + 1).cast("int"))
    r = spark.range(1).select(draws.alias("draws"), sharding.fisher_yates(F.lit(n), F.lit(3), F.lit(11)).alias("turn")).first()
    want = []
    for i in range(n):
        want.append(i)
        j = r.draws[i]
        want[i], want[j] = want[j], want[i]
    assert r.turn == want and sorted(r.turn) == list(range(n))
