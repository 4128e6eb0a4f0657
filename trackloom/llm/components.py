"""Connected components of an edge table by repeated contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.store import keep


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parents (id, parent <= id) up to their roots, doubling the step each round."""
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        step = keep(parents.join(up, "parent").select("id", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "roots")
        parents = step.select("id", "parent")
        if step.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b: long): the smallest id that can be reached.

    Each round every id points to its smallest neighbour, the pointers are followed to their roots and the edges are
    drawn again between roots, so a round at least halves the ids that are left.  Aggregations by id combine before
    their shuffle; an id with very many edges costs no task more than its share.  Nulls and loops are ignored; an
    empty table gives an empty one.
    """
    least: Column = F.least("id", "other")
    edges = edges.select("a", "b").where("a <> b")
    total = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("id", "other")
        first = keep(both.groupBy("id").agg(F.min(least).alias("parent")), "nearest")
        if first.isEmpty():
            return total if total is not None else first.select("id", F.col("parent").alias("component"))
        roots = _roots(first)
        moved = roots.select(F.col("id").alias("component"), "parent")
        if total is None:
            total = roots.select("id", F.col("parent").alias("component"))
        else:
            total = keep(total.join(moved, "component", "left").select("id", F.coalesce("parent", "component").alias("component")), "components")
        ends = [roots.select(F.col("id").alias(c), F.col("parent").alias(f"root_{c}")) for c in "ab"]
        edges = keep(edges.join(ends[0], "a").join(ends[1], "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
