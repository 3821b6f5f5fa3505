"""Classes of equal texts and connected components, as joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliant.workspace import Workspace


def components(work: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges, root being the smallest node reachable.

    Each round, every node points at its smallest neighbour if that is smaller, pointers are followed one step on,
    and the edges are contracted; what is left shrinks geometrically. Every round is a written table, so a lost
    executor repeats one round at most.
    """
    left = work.put(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b"), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        onward = lowest.select(F.col("node").alias("to"), F.col("to").alias("then"))
        points = work.put(lowest.join(onward, "to", "left").select("node", F.coalesce("then", "to").alias("to")), "points")
        steps.append(points)
        first = points.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        second = points.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        left = left.join(first, "a").join(second, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b")
        left = work.put(left.distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0].select("node", F.col("to").alias("root"))
    for points in steps[1:]:
        then = points.select(F.col("node").alias("root"), F.col("to").alias("then"))
        roots = roots.join(then, "root", "left").select("node", F.coalesce("then", "root").alias("root"))
    return work.put(roots, "roots") if len(steps) > 1 else roots


def text_keys(text=None) -> list:
    """Two hash columns that stand for a text; null is as empty."""
    said = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    return [F.xxhash64(said).alias("h1"), F.xxhash64(F.lit(17), said).alias("h2")]


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of df in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
