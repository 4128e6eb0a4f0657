"""Vector codes, repeated passages and the Merkle manifest against plain Python, over small and odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import merkle, substrings, vector_codes


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# ---- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, v string"


def vector_table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, "own", 7, "own") for i, v, label in rows], VECTORS).repartition(parts)


def lloyd(rows, entries=64, rounds=2, parts=16):
    """Every part against every entry, in whole numbers of any size."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    size = Counter(len(v) for _, v, _ in kept).most_common(1)[0][0]
    kept = [r for r in kept if len(r[1]) == size]
    width = size // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    books = [[cut(first[i])[p] for i in sorted(first)[:entries]] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for _, v, _ in kept:
                held[near(cut(v)[p], book)].append(cut(v)[p])
            new.append([[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for e, h in zip(book, held, strict=True)])
        books = new
    out = []
    for i, v, label in kept:
        codes = [near(x, book) for x, book in zip(cut(v), books, strict=True)]
        out.append((i, "".join(f"{c:02x}" for c in codes), sum(far(x, book[c]) for x, book, c in zip(cut(v), books, codes, strict=True)), label))
    labels = Counter()
    for _, _, error, label in out:
        labels[label] += error
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    return Counter((i, code, error, labels[label], digest) for i, code, error, label in out)


def random_vectors(n, dims=32, seed=1, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dims))
    return [(int(i), (centres[i % 9] + spread * r.normal(size=dims)).astype(np.float32).tolist(), int(i % 3)) for i in r.permutation(n)]


ODD_VECTORS = [
    (3, None, 1), (5, [], 1), (7, [None] * 32, 1), (9, [float("nan")] * 32, None), (11, [float("inf")] + [0.0] * 31, 2), (12, [1.0] * 31, 2), (13, [1.0] * 48, 2),
    (None, [0.25] * 32, None), (2, [0.5] * 32, None), (2, [0.5] * 32, None), (2, [-0.5] * 32, 1), (400, [-0.001] * 32, 4),
]


@pytest.mark.parametrize("rows", [random_vectors(150) + ODD_VECTORS, random_vectors(40) + ODD_VECTORS, [(i, [float(i % 2)] * 32, 0) for i in range(100)]], ids=["odd", "few", "ties"])
def test_codes_equal_plain_rounds(spark, rows):
    got = vector_codes.report(vector_table(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == lloyd(rows)


def test_codes_do_not_depend_on_the_partitioning(spark, monkeypatch):
    rows = random_vectors(300, spread=0.05) + ODD_VECTORS
    want = Counter(map(tuple, vector_codes.report(vector_table(spark, rows, 1)).collect()))
    monkeypatch.setattr(vector_codes, "TREE_ROWS", 16)
    assert Counter(map(tuple, vector_codes.report(vector_table(spark, rows, 7)).collect())) == want


def test_tables_without_usable_vectors_give_no_rows(spark):
    assert vector_codes.report(vector_table(spark, [])).collect() == []
    assert vector_codes.report(vector_table(spark, ODD_VECTORS[:6])).collect() == []


def test_large_components_are_cut_and_do_not_overflow(spark):
    rows = [(i, [(-1.0) ** i * 3e38] * 64, 0) for i in range(70)]
    got = vector_codes.report(vector_table(spark, rows)).collect()
    assert len(got) == 70 and all(r.error == 0 for r in got)
    assert vector_codes.most(64) ** 2 * 4 * 64 < 2**63 <= (2 * vector_codes.most(64) + 2) ** 2 * 4 * 64


@pytest.mark.parametrize("seed", range(6))
def test_subtrees_go_to_the_entries_that_points_would(seed):
    r = np.random.default_rng(seed)
    book = np.concatenate([r.integers(-40, 40, (20, 3)), np.repeat(r.integers(-40, 40, (1, 3)), 3, axis=0)])
    points = np.concatenate([np.repeat(book, 40, axis=0) + r.integers(-3, 4, (len(book) * 40, 3)), r.integers(-60, 60, (500, 3))])
    d = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    made = vector_codes.Filtered(points, book)
    want = d.argmin(axis=1)
    assert (made.codes == want).all() and (made.counts == np.bincount(want, minlength=len(book))).all()
    assert all((made.sums[e] == points[want == e].sum(axis=0)).all() for e in range(len(book)))
    assert made.whole > len(points) // 5


def test_restored_vectors_are_as_near_as_their_errors_say(spark):
    rows, dims = vector_codes.vectors(vector_table(spark, random_vectors(200)).select("vec_id", "embedding", "label"))
    rows = rows.withColumnRenamed("vec_id", "id")
    books = vector_codes.trained(rows, dims)
    for r in vector_codes.coded(rows, books).withColumn("again", vector_codes.restored(F.col("code"), books)).collect():
        off = sum((math.floor(256 * x) - (256 * y - 0.5)) ** 2 for x, y in zip(r.embedding, r.again, strict=True))
        assert len(r.again) == 32 and round(off) == r.error


# ---- repeated passages

TEXTS = "doc_id long, text string, lang string, source string, n_chars long, repeats string, found int"


def text_table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "own", 3) for i, t in rows], TEXTS).repartition(3)


def words(n, at=0):
    return " ".join(f"w{at + i}" for i in range(n))


def cut(rows, least):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + least]) for w in split for i in range(len(w) - least + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = {k for i in range(len(w) - least + 1) if seen[tuple(w[i : i + least])] > 1 for k in range(i, i + least)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), kept))
    return out


def passages(seed, n=60):
    """Texts of a small vocabulary with shared passages of many lengths, at their ends and inside, and with loops."""
    r = np.random.default_rng(seed)
    shared = [" ".join(f"p{k}x{i}" for i in range(20 + 3 * k)) for k in range(12)]
    rows = []
    for d in range(n):
        parts = [words(int(r.integers(0, 60)), int(r.integers(0, 9)) * 1000 + d * 70 * int(r.integers(0, 2)))]
        for _ in range(int(r.integers(0, 4))):
            p = shared[int(r.integers(12))].split()
            a, b = sorted(r.integers(0, len(p) + 1, 2).tolist())
            parts += [" ".join(p[a:b]), words(int(r.integers(0, 30)), 100_000 + d * 100)]
        if d % 7 == 0:
            parts.append("la li lu " * 30)
        rows.append((d, "\n".join(parts)))
    return rows


ODD_TEXTS = [(900, None), (901, ""), (902, " \t\n"), (903, "short text"), (904, "short text"), (905, words(35, 7)), (905, words(35, 7)), (None, words(40, 3)), (906, "É " * 34), (907, "É " * 200), (908, words(40_000, 500_000)), (909, words(50, 510_000) + " \x0b " + words(36, 530_010).upper())]


@pytest.mark.parametrize("hot", [None, "broadcast", "salted"])
@pytest.mark.parametrize(("least", "seed"), [(35, 8), (12, 4)])
def test_repeats_equal_all_windows(spark, monkeypatch, hot, least, seed):
    if hot:
        monkeypatch.setattr(substrings, "HOT_ROWS", 2)
        monkeypatch.setattr(substrings, "MOST_BROADCAST", 0 if hot == "salted" else 10**6)
    rows = passages(least) + ODD_TEXTS + [(2000 + i, words(80, 77) + (f" x{i}" if i % 5 else "")) for i in range(40)]
    got = substrings.report(text_table(spark, rows), least, seed)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = cut(rows, least)
    assert Counter(map(tuple, got.collect())) == Counter((d, n, gone, sha(kept)) for d, n, gone, kept in want)
    assert sum(gone > 0 for _, _, gone, _ in want) > 40 and sum(0 < gone < n for _, n, gone, _ in want) > 15


def test_texts_lose_their_repeats_and_nothing_else(spark):
    rows = passages(3) + ODD_TEXTS
    got = substrings.deduplicated(text_table(spark, rows), 12, 4)
    assert got.columns == [*text_table(spark, []).columns, "repeats_"]
    want = {(d, n, gone): kept for d, n, gone, kept in cut(rows, 12)}
    texts = Counter((d, t) for d, t in rows)
    for r in got.collect():
        gone = sum(x["to"] - x["from"] for x in r.repeats_)
        assert all(a["to"] < b["from"] for a, b in zip(r.repeats_, r.repeats_[1:], strict=False)) and all(x["to"] - x["from"] >= 12 for x in r.repeats_)
        assert (r.repeats, r.found) == ("own", 3)
        if gone:
            assert r.text in [kept for (d, _, g), kept in want.items() if (d, g) == (r.doc_id, gone)]
        else:
            assert texts[r.doc_id, r.text]
    assert got.count() == len(rows)


def test_no_texts_have_no_repeats(spark):
    assert substrings.report(text_table(spark, [])).collect() == []


# ---- Merkle manifest

ROWS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, root string, proof string"


def row_table(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, n, "own", 1, "own", "own") for d, t, lang, s, n in rows], ROWS).repartition(4)


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def way(tree, i, fan):
    out = []
    for nodes in tree[:-1]:
        a = i // fan * fan
        out.append((nodes[a:i], nodes[i + 1 : a + fan]))
        i //= fan
    return out


def manifest_of(rows, fan=16):
    text = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, lang, s, n: sha("".join(map(text, (d, s, lang, n, t))))
    sources = sorted({s for _, _, _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources}
    trees = {s: levels([leaf(*r) for r in own[s]], fan) for s in sources}
    top = levels([trees[s][-1][0] for s in sources], fan)
    root, out = (top[-1][0] if rows else None), Counter()
    for k, s in enumerate(sources):
        for i, (d, t, lang, _, n) in enumerate(own[s]):
            proof = way(trees[s], i, fan) + way(top, k, fan)
            hit = d is not None and t is not None and zlib.crc32(str(d).encode()) % 5 == 0
            x = leaf(d, re.sub("[A-Z]", lambda m: m[0].lower(), t) if hit else t, lang, s, n)
            for left, right in proof:
                x = sha("".join([*left, x, *right]))
            out[d, trees[s][0][i], trees[s][-1][0], root, sha("".join(y for a, b in proof for y in a + b)), x, x == root] += 1
    return out


def documents(n, hot=0):
    some = [(i, f"Text {i % 40}" if i % 9 else None, "en" if i % 4 else None, f"s{i % 5}" if i % 11 else None, i % 3 or None) for i in range(n)]
    odd = [(None, "", None, "s1", 0), (None, "", None, "s1", 0), (4, "Ä B", "de", "", 5), (4, "Ä B", "de", "", 5), (5, "Ä B " * 50_000, "de", "-", 5), (6, "x", "en", "é", 1), (7, "x", "en", "Z", 1)]
    return some + odd + [(10_000 + i, "Hot", "en", "hot", 3) for i in range(hot)]


@pytest.mark.parametrize("rows", [documents(60, 300), documents(3), [(1, "A", None, None, None)]], ids=["several levels", "few", "one"])
def test_manifest_equals_its_definition(spark, rows):
    got = merkle.report(row_table(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == manifest_of(rows)


def test_no_rows_have_no_root(spark):
    assert merkle.report(row_table(spark, [])).collect() == []


@pytest.mark.parametrize(("fan", "height"), [(2, 1), (3, 2)])
def test_walks_of_many_levels_meet(spark, fan, height):
    """Blocks so small that leaves and sources take several distributed walks each."""
    rows = documents(40, 70) + [(5000 + i, "one", "en", f"source {i:02}", i) for i in range(20)]
    table = row_table(spark, rows)
    leaf = merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    made = merkle.manifest(table.select("source", F.col("doc_id").alias("id"), leaf.alias("digest")), fan, height)
    got = made.select("id", "digest", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.folded(F.col("digest"), F.col("proof")))
    want = Counter()
    for (d, own, subroot, root, proof, _, _), n in manifest_of(rows, fan).items():
        want[d, own, subroot, root, proof, root] += n
    assert Counter(map(tuple, got.collect())) == want


def test_any_change_to_a_proof_or_leaf_is_seen(spark):
    table = row_table(spark, documents(50))
    leaf = merkle.leaf_of(F.col("doc_id"), F.col("text"))
    made = merkle.manifest(table.select("source", F.col("doc_id").alias("id"), leaf.alias("digest")))
    other = F.sha2(F.col("digest"), 256)
    moved = F.transform("proof", lambda s: F.struct((s["place"] + 1).alias("place"), s["others"].alias("others")))
    several = F.exists("proof", lambda s: F.length(s["others"]) > 64 * s["place"])
    kept = made.where(several).select((merkle.folded(F.col("digest"), F.col("proof")) == F.col("root")).alias("a"), (merkle.folded(other, F.col("proof")) == F.col("root")).alias("b"), (merkle.folded(F.col("digest"), moved) == F.col("root")).alias("c")).collect()
    assert kept and all((r.a, r.b, r.c) == (True, False, False) for r in kept)
