"""A Merkle tree over a dataset's rows: a root that stands for all of them, and for each row the digests that lead to it.

Each row is a leaf; the leaves of a source in order make a tree of runs of 16, and the trees' roots, by source, make one
more.  Rows are numbered by one range sort over (source, order), counted per partition, so that a source of any size is
spread over tasks.  A tree is then cut into aligned blocks of 16^2 nodes, each of which is exactly one node two levels up.
A block is walked recursively in postorder: a call returns its subtree's digest, and while the calls unwind, the other
digests of a run are appended to the proof of each leaf below.  The blocks' roots are the nodes of the next distributed
walk, until every tree is one block.  On the way down each block meets the proof of its own root, one row a block, and is
walked once more to lay both together; proofs of leaves exist in the result alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.store import keep

FAN, HEIGHT = 16, 2
#: The query tampers with the rows whose hash of the id this divides.
TAMPERED = 5

_PROOF = "array<struct<place: int, others: string>>"
_PROOF_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))


def digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _field(x: Column) -> Column:
    x = x.cast("string")
    return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))


def leaf_of(*values: Column) -> Column:
    """The digest of some values, each '-' if null, else its UTF-8 bytes, a colon, and the value as text."""
    return F.sha2(F.concat(*[_field(x) for x in values]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to; a proof has a place and the other digests for each run on the way."""

    def up(d: Column, step: Column) -> Column:
        cut = step["place"] * 64
        return F.sha2(F.concat(F.substr(step["others"], F.lit(1), cut), d, F.substr(step["others"], cut + 1)), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """The digest of all of a proof's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["others"]), ""), 256)


def walked(nodes: list[str], height: int | None, fan: int = FAN) -> tuple[str, list[list[dict]]]:
    """The root of a block of consecutive nodes, ``height`` levels up (None: where a single node is left), and each node's
    proof: its place in its run and the run's other digests, run by run."""
    proofs: list[list[dict]] = [[] for _ in nodes]

    def visit(low: int, high: int, level: int) -> str:
        if not level:
            return nodes[low]
        step = fan ** (level - 1)
        parts = [(a, min(a + step, high)) for a in range(low, high, step)]
        below = [visit(a, b, level - 1) for a, b in parts]
        for i, (a, b) in enumerate(parts):
            ours = {"place": i, "others": "".join(below[:i] + below[i + 1 :])}
            for k in range(a, b):
                proofs[k].append(ours)
        return digest("".join(below))

    if height is None:
        height = 0
        while fan**height < len(nodes):
            height += 1
    return visit(0, len(nodes), height), proofs


def _walk(block: pa.Table, fan: int, height: int) -> tuple[pa.Table, str, list[list[dict]]]:
    """The walk over one block, its rows put in order; a block that is a whole tree goes up to that tree's root."""
    block = block.take(pc.sort_indices(block, sort_keys=[("pos", "ascending")]))
    return block, *walked(block["digest"].to_pylist(), height if block["n"][0].as_py() > fan**height else None, fan)


def _roots(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """(tree, pos, n, digest) of the blocks of ``nodes``."""

    def root(key: tuple, block: pa.Table) -> pa.Table:
        _, top, _ = _walk(block, fan, height)
        n = -(-block["n"][0].as_py() // fan**height)
        return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "digest": [top]})

    blocks = nodes.select("tree", F.floor(F.col("pos") / fan**height).cast("long").alias("block"), "pos", "n", "digest")
    return blocks.groupBy("tree", "block").applyInArrow(root, "tree string, pos long, n long, digest string")


def _met(nodes: DataFrame, roots: DataFrame, fan: int, height: int) -> DataFrame:
    """``nodes`` with top, and the proof up to their block's root and from there on, which ``roots`` (tree, pos, top, proof) has."""
    fields = nodes.schema.fields

    def meet(key: tuple, block: pa.Table, root: pa.Table) -> pa.Table:
        block, _, proofs = _walk(block, fan, height)
        rest, n = root["proof"][0].as_py(), block.num_rows
        out = {f.name: block[f.name] for f in fields}
        return pa.table(out | {"top": pa.array([root["top"][0].as_py()] * n, pa.string()), "proof": pa.array([p + rest for p in proofs], _PROOF_ARROW)})

    left = nodes.withColumn("block", F.floor(F.col("pos") / fan**height).cast("long")).groupBy("tree", "block")
    right = roots.select("tree", F.col("pos").alias("block"), "top", "proof").groupBy("tree", "block")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", top string, proof {_PROOF}"
    return left.cogroup(right).applyInArrow(meet, schema)


def _levels(nodes: DataFrame, fan: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that each distributed walk starts from, the leaves first, and the roots (tree, digest) of all trees."""
    levels = [nodes]
    while True:
        up = keep(_roots(levels[-1], fan, height), "blocks")
        if up.where("n > 1").isEmpty():
            return levels, up.select("tree", "digest")
        levels.append(up)


def _proved(levels: list[DataFrame], tops: DataFrame, fan: int, height: int) -> DataFrame:
    """The leaves with top and a proof that goes on, above their tree's root, as in ``tops`` (tree, top, proof)."""
    roots = tops.withColumn("pos", F.lit(0).cast("long"))
    for nodes in levels[:0:-1]:
        roots = keep(_met(nodes, roots, fan, height).select("tree", "pos", "top", "proof"), "proofs")
    return _met(levels[0], roots, fan, height)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree, with this partition's number and their place among its rows of the tree."""
    part, tree, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for t in batch["tree"].to_pylist():
            tree, n = t, n + 1 if t == tree else 0
            places.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos, gapless from 0 within each tree by ``order``, nulls first, and n, the tree's rows.  Rows equal in
    the order may change places.  A tree is spread over ranges; only its count in each of these meets in one task."""
    by = [F.col("tree"), *[F.asc_nulls_first(c) for c in order], F.col("tie")]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    placed = keep(ranged.mapInArrow(_counted, f"{schema}, part int, place long"), "placed")
    own = Window.partitionBy("tree")
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("held"))
    starts = counts.select("tree", "part", (F.sum("held").over(own.orderBy("part")) - F.col("held")).alias("start"), F.sum("held").over(own).alias("n"))
    return placed.join(starts, ["tree", "part"]).select(*rows.columns, (F.col("start") + F.col("place")).alias("pos"), "n")


def manifest(rows: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """``rows`` (source, id, digest: a leaf each, and any columns but tree, pos, n, top, proof, tie, part and place) with
    subroot, root and proof.

    Leaves ascend by id within their source, nulls first, then by digest, so that rows of one id have one order, too.
    Every ``fan`` consecutive nodes, the last run fewer or one alone, become the digest of their digests, until one is
    left: the source's subroot, a lone leaf itself.  Subroots ascend by source, bytewise, a null first, and become the root
    in the same way.  The proof is an array of (place, others), which ``folded`` leads to the root.  Repeated rows are leaves
    each; no rows give no rows.  A text's length plays no part: only digests of rows are moved.
    """
    tree = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    leaves = keep(_numbered(rows.withColumn("tree", tree), ["id", "digest"]), "leaves")
    levels, subroots = _levels(leaves, fan, height)
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper, root = _levels(keep(_numbered(sources, ["name"]), "sources"), fan, height)
    tops = root.select("tree", F.col("digest").alias("top"), F.array().cast(_PROOF).alias("proof"))
    named = _proved(upper, tops, fan, height).select(F.col("name").alias("tree"), F.struct("digest", "top").alias("both"), "proof")
    # a leaf's own root and the root of all travel with its proof, as one string
    above = named.select("tree", F.concat("both.digest", "both.top").alias("top"), "proof")
    made = _proved(levels, keep(above, "tops"), fan, height)
    return made.select(*rows.columns, F.substring("top", 1, 64).alias("subroot"), F.substring("top", 65, 64).alias("root"), "proof")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf is of doc_id, source, lang, n_chars and text, nulls told from empty texts.  Where 5 divides the CRC-32 of the
    doc_id as text, the folding starts from the row with its text's A-Z lowered; a null id is never tampered with."""
    leaf = lambda text: leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("source", F.col("doc_id").alias("id"), leaf(F.col("text")).alias("digest"), F.when(hit, leaf(lowered)).alias("tampered"))
    end = folded(F.coalesce("tampered", "digest"), F.col("proof"))
    out = manifest(rows).select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), end.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
