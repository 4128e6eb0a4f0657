"""The numbered queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontaminate, html_text, language, media, merkle, mixing, near_dup, pii, quality, sharding, substrings, toxicity, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(_table(spark, sf_dir, "documents"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(_table(spark, sf_dir, "embeddings"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_html": op3_html,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_decontaminate": op7_decontaminate,
    "op8_media": op8_media,
    "op9_language": op9_language,
    "op10_near_dup": op10_near_dup,
    "op11_vector_codes": op11_vector_codes,
    "op12_substrings": op12_substrings,
    "op13_merkle": op13_merkle,
}

_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(coalesce(" + _ASCII + ", ''), '{}')"

#: Windows of all lengths that items have, joined with those of documents; runs of these along both texts are the matches.
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM benchmark),
bw AS (SELECT q, item, n, j, array_to_string(w[j:j + n - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM (SELECT q, item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT r, n, i, q, item, j FROM dw JOIN bw USING (n, k)),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY r, q, n, i - j ORDER BY i) AS g FROM hits),
matches AS (SELECT r, item, min(i) - 1 AS place, max(i) - min(i) + n AS size FROM runs GROUP BY r, q, item, n, i - j, g),
longest AS (SELECT r, min({{'less': -size, 'place': place, 'item': item}}) AS x FROM matches GROUP BY r),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(-x.less, 0) AS BIGINT) AS longest, CAST(x.place AS BIGINT) AS longest_at, x.item AS longest_item
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN longest USING (r)
"""

#: All pairs of documents with a shingle in common, and the smallest id reachable over links.
OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text", "[^\\x20\\x09-\\x0D]+")} AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + n - 1], ' ') AS k
      FROM (SELECT r, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT r, doc_id, w, least(5, len(w)) AS n FROM d WHERE len(w) > 0))),
sizes AS (SELECT r, any_value(doc_id) AS id, count(*) AS n FROM s GROUP BY r),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.r < y.r GROUP BY x.r, y.r),
links AS (SELECT p.id AS a, q.id AS b FROM common JOIN sizes p ON common.a = p.r JOIN sizes q ON common.b = q.r WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT reach.id, ways.b FROM reach JOIN ways ON reach.other = ways.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (r) LEFT JOIN least ON least.id = d.doc_id
"""


def _op11_round(k: int) -> str:
    """Every part's nearest entry, and the codebooks that follow."""
    return f"""
a{k} AS (SELECT r, p, min({{'d': list_sum(list_transform(range(1, w + 1), lambda j: (q[j] - c[j]) * (q[j] - c[j]))), 'e': e}}) AS x FROM parts JOIN b{k} USING (p) GROUP BY r, p),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c
         FROM (SELECT p, x.e AS e, j, sum(q[j])::BIGINT AS s, count(*) AS n FROM a{k} JOIN parts USING (r, p), range(1, 4097) t(j) WHERE j <= w GROUP BY p, x.e, j) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))"""


#: Every part against all 64 entries of its place.
OP11_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, len(v) // 16 AS w, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS q FROM k, range(16) t(p)),
first AS (SELECT vec_id, min(r) AS r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT 64),
b0 AS (SELECT p, e, q AS c FROM first JOIN parts USING (r)),
{_op11_round(0)},
{_op11_round(1)},
{_op11_round(2)},
codes AS (SELECT r, string_agg(printf('%02x', x.e), '' ORDER BY p) AS code, CAST(sum(x.d) AS BIGINT) AS error FROM a2 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN k USING (r), books
"""

#: All windows of 35 words, and those that start at more than one place.
OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
each AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def _op13_tree(name: str, base: str, levels: int) -> str:
    """Nodes name0, name1, ... (tree, i, d, m) of all levels from ``base`` (tree, i, d) on, and the runs of each."""
    out = [f"{name}0 AS (SELECT tree, i, d, count(*) OVER (PARTITION BY tree) AS m FROM {base})"]
    for k in range(levels):
        out.append(f"{name}run{k} AS (SELECT tree, i // 16 AS g, list(d ORDER BY i) AS ds FROM {name}{k} WHERE m > 1 GROUP BY tree, i // 16)")
        up = f"SELECT tree, i // 16 AS i, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d FROM {name}{k} GROUP BY tree, i // 16"
        out.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM ({up}))")
    return ",\n".join(out)


def _op13_fold(name: str, tree: str, place: str, levels: int, first: str) -> str:
    """Rows of ``first`` with x folded, and p, the digests on the way, grown, level by level."""
    out = []
    for k in range(levels):
        before = first if k == 0 else f"{name}{k}"
        at = f"({place} // {16**k})"
        left, right = f"array_to_string(ds[1:{at} % 16], '')", f"array_to_string(ds[{at} % 16 + 2:], '')"
        out.append(f"{name}{k + 1} AS (SELECT f.* EXCLUDE (x, p), CASE WHEN ds IS NULL THEN x ELSE sha256({left} || x || {right}) END AS x, p || coalesce({left} || {right}, '') AS p FROM {before} f LEFT JOIN {tree}run{k} u ON f.{tree}tree = u.tree AND {at} // 16 = u.g)")
    return ",\n".join(out)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
_CRC = "list_reduce(list_concat([4294967295], list_transform(range(0, 8 * strlen({0})), lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr({0}, k // 8 + 1, 1)) ELSE 0 END)), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"

#: Trees of up to 16^5 leaves a source and 16^3 sources, level by level.
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '-') AS dtree, {_LEAF.format("text")} AS leaf,
           CASE WHEN xor({_CRC.format("CAST(doc_id AS VARCHAR)")}, 4294967295) % 5 = 0 THEN {_LEAF.format(_ASCII.format("text"))} END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY dtree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
base AS (SELECT dtree AS tree, pos AS i, leaf AS d FROM leaves),
{_op13_tree("d", "base", 5)},
tops AS (SELECT '' AS stree, tree AS dtree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM d5),
sbase AS (SELECT stree AS tree, place AS i, subroot AS d FROM tops),
{_op13_tree("s", "sbase", 3)},
start AS (SELECT r, doc_id, leaf, pos, dtree, coalesce(tampered, leaf) AS x, '' AS p FROM leaves),
{_op13_fold("f", "d", "pos", 5, "start")},
upper AS (SELECT f5.*, stree, subroot, place FROM f5 JOIN tops USING (dtree)),
{_op13_fold("g", "s", "place", 3, "upper")}
SELECT doc_id, leaf, subroot, s3.d AS root, sha256(p) AS proof_sha256, x AS folded_root, x = s3.d AS verified FROM g3, s3
"""

#: SQL for the operators that it can express in full.
ORACLE_SQL: dict[str, str] = {"op7_decontaminate": OP7_SQL, "op10_near_dup": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_substrings": OP12_SQL, "op13_merkle": OP13_SQL}
