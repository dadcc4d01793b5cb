"""Graphs as edge tables (a, b)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """id, component (its lowest id) of every id on an edge (a, b) between two ids.

    Contracts the graph: each id points at its lowest neighbour or itself, pointers are followed to their ends by
    doubling, and every tree of pointers becomes one id, its lowest, until no edge is left. A path of n ids in order
    takes one contraction and log2(n) doublings. Nothing is collected.
    """
    edges = stored(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("low")).select("x", F.least("x", "low").alias("up")), "up")
        moved = True
        while moved:
            ends = up.select(F.col("x").alias("up"), F.col("up").alias("top"))
            twice = up.select("x", "up").join(ends, "up").select("x", F.col("top").alias("up")).join(ends, "up")
            near, up = up, stored(twice.select("x", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved")), "up")
            moved = not up.where("moved").isEmpty()
            discard(near)
        old, up = (labels, edges, up), up.select("x", "up")
        labels = stored(labels.join(up, F.col("component") == F.col("x"), "left").select("id", F.coalesce("up", "component").alias("component")), "labels")
        for end in ("a", "b"):
            edges = edges.join(up.withColumnRenamed("x", end), end).withColumn(end, F.col("up")).drop("up")
        edges = stored(edges.where("a != b").distinct(), "edges")
        discard(*old)
    discard(edges)
    return labels


def transitive_closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """All pairs joined by a path along a -> b, by doubling; an error if that isn't reached in so many rounds."""
    closed = stored(edges.select("a", "b").distinct(), "closure")
    n = closed.count()
    for _ in range(rounds):
        longer = closed.join(closed.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        closed = stored(closed.unionByName(longer).distinct(), "closure")
        if (m := closed.count()) == n:
            return closed
        n = m
    raise RuntimeError("the closure has longer paths than its rounds allow")


def maximal_cliques(neighbours: Mapping[int, set[int]]) -> list[tuple[int, ...]]:
    """All maximal cliques of a small graph, by branching on the vertex with most neighbours among the candidates."""
    out: list[tuple[int, ...]] = []
    stack = [(frozenset(), set(neighbours), set())]
    while stack:
        clique, candidates, done = stack.pop()
        if not candidates and not done:
            out.append(tuple(sorted(clique)))
            continue
        if not candidates:
            continue
        pivot = max(candidates | done, key=lambda v: len(candidates & neighbours[v]))
        for v in sorted(candidates - neighbours[pivot]):
            stack.append((clique | {v}, candidates & neighbours[v], done & neighbours[v]))
            candidates = candidates - {v}
            done = done | {v}
    return sorted(out)


def inconsistent_pairs(sites: DataFrame) -> DataFrame:
    """Pairs (a, b) of columns (ids) that can't stand in one alignment: their order differs in two sequences, or they share one site only in part.

    sites: id, seq, begin; one row a sequence of a column.
    """
    left, right = (sites.select(F.col("id").alias(n), "seq", F.col("begin").alias(f"{n}_begin")) for n in "ab")
    met = left.join(right, "seq").where("a < b").groupBy("a", "b").agg(F.min(F.signum(F.col("a_begin") - F.col("b_begin"))).alias("low"), F.max(F.signum(F.col("a_begin") - F.col("b_begin"))).alias("high"))
    return met.where("low != high").select("a", "b")


def dot(edges: DataFrame, name: str = "g") -> str:
    """Graphviz text of a graph small enough to draw."""
    lines = [f"  {r['a']} -- {r['b']};" for r in edges.orderBy("a", "b").toLocalIterator()]
    return "\n".join([f"graph {name} {{", *lines, "}"]) + "\n"
