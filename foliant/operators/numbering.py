"""Places and running sums of rows within their group, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from foliant.workspace import Workspace


def running(work: Workspace, rows: DataFrame, group: list[str], order: list[str], **sums: str) -> DataFrame:
    """rows with running sums within `group` by `order`, the row itself included; sums: name = column.

    A range sort deals a group over many tasks; each sums up its own part, and the sums of earlier parts, of which there
    is one for each partition and group, are added.
    """
    held = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    held = work.put(held.withColumn("_seq", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_seq", 33))
    keys = ["_part", *group]
    totals = held.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*keys, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    own = W.partitionBy(*keys).orderBy("_seq").rowsBetween(W.unboundedPreceding, 0)
    parts = held.withColumns({n: F.sum(c).over(own) for n, c in sums.items()})
    done = parts.join(before, keys).withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums})
    return done.drop("_seq", "_part", *(f"_{n}" for n in sums))


def numbered_within(work: Workspace, rows: DataFrame, group: list[str], order: list[str], name: str = "_n") -> DataFrame:
    """rows with their place from 0 within `group` by `order`."""
    placed = running(work, rows.withColumn("_one", F.lit(1).cast("long")), group, order, **{name: "_one"})
    return placed.withColumn(name, F.col(name) - 1).drop("_one")
