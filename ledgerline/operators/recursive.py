"""Bounded walks up parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored


def walk(starts: DataFrame, steps: DataFrame, most: int = 50) -> DataFrame:
    """start, stop, passed: where a walk from each start stops.

    starts: (start, at), at null for a start that leads nowhere. steps: (node, up, passes), one row per node; the
    walk leaves a node upwards while `passes` holds and fewer than `most` nodes were passed, and stops there or
    where up is null. Walks still under way are joined with the steps once per round; it ends when none is.
    """
    now = stored(starts.select("start", "at", F.lit(0).alias("passed")), "walk")
    done = []
    for _ in range(most):
        onward = now.join(steps.filter("passes").select(F.col("node").alias("at"), "up"), "at", "left_semi")
        if onward.isEmpty():
            break
        stays = now.join(steps.filter("passes").select(F.col("node").alias("at")), "at", "left_anti")
        done.append(stays)
        moved = now.join(steps.filter("passes").select(F.col("node").alias("at"), "up"), "at").select("start", F.col("up").alias("at"), (F.col("passed") + 1).alias("passed"))
        now = stored(moved, "walk")
    out = now
    for d in done:
        out = out.unionByName(d)
    return out.withColumnRenamed("at", "stop")
