"""Intervals: merging overlaps into islands, and points or facts inside intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import stored


def prefix_max(df: DataFrame, by: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """df with the maximum of value over all earlier rows of `by` (null for the first).

    bucket must grow with the order; windows span one bucket each, and a small second window carries the
    maximum from bucket to bucket, so a hot key is spread over its buckets. With by=[] the same holds for the
    whole table.
    """
    b = df.withColumns({"_b": bucket, "_v": value})
    local = W.partitionBy(*by, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    per = b.groupBy(*by, "_b").agg(F.max("_v").alias("_m"))
    key = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    carried = per.select(*[F.col(k).alias("_k_" + k) for k in by], F.col("_b").alias("_kb"), F.max("_m").over(key.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_c"))
    on = F.col("_b") == F.col("_kb")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col("_k_" + k))
    joined = b.withColumn("_l", F.max("_v").over(local)).join(carried, on, "left")
    return joined.withColumn(out, F.greatest("_l", "_c")).select(*df.columns, out)


def prefix_count(df: DataFrame, by: list[str], bucket: Column, order: list[Column], flag: Column, out: str) -> DataFrame:
    """df with the number of flagged rows up to and including each, windowed bucket by bucket as prefix_max."""
    b = df.withColumns({"_b": bucket, "_v": F.when(flag, 1).otherwise(0)})
    local = W.partitionBy(*by, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    per = b.groupBy(*by, "_b").agg(F.sum("_v").alias("_m"))
    key = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    carried = per.select(*[F.col(k).alias("_k_" + k) for k in by], F.col("_b").alias("_kb"), F.sum("_m").over(key.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_c"))
    on = F.col("_b") == F.col("_kb")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col("_k_" + k))
    joined = b.withColumn("_l", F.sum("_v").over(local)).join(carried, on, "left")
    return joined.withColumn(out, F.col("_l") + F.coalesce("_c", F.lit(0))).select(*df.columns, out)


def merge_intervals(spans: DataFrame, start: str, end: str, tie: str, *, by: list[str] | None = None, bucket: Column | None = None, out: str = "interval_number") -> DataFrame:
    """spans with the number of the merged interval each belongs to, from 1 in order of start; touching spans merge.

    Rows with a null start or end are left out; start > end counts as empty at start. bucket: a column that
    grows with start (default: its day).
    """
    by = by or []
    df = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    bucket = F.to_date(F.col(start)) if bucket is None else bucket
    order = [F.col(start), F.col(end), F.col(tie)]
    seen = prefix_max(df, by, bucket, order, F.greatest(F.col(start), F.col(end)), "_seen")
    opens = F.col("_seen").isNull() | (F.col(start) > F.col("_seen"))
    return prefix_count(seen, by, bucket, order, opens, out).drop("_seen")


def contained_in(points: DataFrame, spans: DataFrame, at: Column, low: Column, high: Column, width: int, *, equal: list[tuple[str, str]] | None = None) -> DataFrame:
    """points joined with every span that holds them: low < at <= high (whole numbers).

    Spans are laid out over buckets of `width`, points fall into one, so the join is an equi-join with a
    residual; choose width near the usual span length. equal: further (point column, span column) pairs, of
    which a null on the point's side fits any.
    """
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    p = points.withColumn("_pb", F.floor(at / width))
    cond = (F.col("_pb") == F.col("_bucket")) & (at > low) & (at <= high)
    for a, b in equal or []:
        cond = cond & (F.col(a).isNull() | (F.col(a) == F.col(b)))
    return p.join(s, cond).drop("_pb", "_bucket")


class Below:
    """Counts of points (x, y) with x under one bound and y under another, many at once: a wavelet matrix over the ranks of y."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        self.x, self.y = x[order], np.unique(y)
        ranks = np.searchsorted(self.y, y[order])
        self.levels = []
        for bit in reversed(range(max(1, len(self.y)).bit_length())):
            zero = (ranks >> bit & 1) == 0
            self.levels.append((bit, np.append(0, np.cumsum(zero))))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def count(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        left, right = np.zeros(len(hi), np.int64), np.searchsorted(self.x, hi).astype(np.int64)
        bound, out = np.searchsorted(self.y, lo), np.zeros(len(hi), np.int64)
        for bit, zeros in self.levels:
            one = bound >> bit & 1 == 1
            out += np.where(one, zeros[right] - zeros[left], 0)
            left, right = (np.where(one, zeros[-1] + i - zeros[i], zeros[i]) for i in (left, right))
        return out


def _numbers(batches: Iterator[pa.RecordBatch] | pa.Table, *names: str) -> list[np.ndarray]:
    return [batches[n].to_numpy() for n in names]


def range_count_distinct(ranges: DataFrame, facts: DataFrame, id: str, low: Column, high: Column, at: Column, key: str, width: int, out: str, block: int = 500_000) -> DataFrame:
    """`id` of each range with the number of distinct keys of facts with low <= at < high; ranges without facts don't appear.

    A key counts at its first fact in the range, that is where its fact before lies under low. So the number is that of
    facts under high whose predecessor is under low, less all facts under low: two counts below bounds, whatever
    the ranges' lengths. Up to `block` facts (one row per key and instant) go to every task as they are. More are cut
    into blocks by time and by predecessor; a grid of counts covers whole blocks, and what is left of a range's own
    two blocks is counted in tasks that hold one block each, with at most about `block` ranges beside it. Predecessors
    are found in time buckets of `width`, so a key with a third of all facts is spread over its buckets.
    """
    first = -(1 << 63)
    f = facts.filter(at.isNotNull() & F.col(key).isNotNull()).select(at.cast("long").alias("_at"), F.col(key).alias("_key")).distinct()
    points = prefix_max(f, ["_key"], F.floor(F.col("_at") / width), [F.col("_at")], F.col("_at"), "_prev").select("_at", F.coalesce("_prev", F.lit(first)).alias("_prev"))
    points = stored(points, "points")
    r = ranges.filter(low < high).select(F.col(id).alias("_id"), low.cast("long").alias("_low"), high.cast("long").alias("_high"))
    id_type = r.schema["_id"].dataType.simpleString()
    n = points.count()
    if n <= block:
        got = points.toArrow()  # at most `block` rows of two numbers
        x, y = _numbers(got, "_at", "_prev")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below, times = Below(x, y), np.sort(x)
            for b in batches:
                lo, hi = _numbers(b, "_low", "_high")
                yield pa.RecordBatch.from_arrays([b["_id"], pa.array(below.count(hi, lo) - np.searchsorted(times, lo))], names=["_id", "_n"])

        counted = r.mapInArrow(scan, f"_id {id_type}, _n long")
    else:
        counted = _blockwise(points, r, math.ceil(n / block), block, id_type)
    return counted.filter("_n > 0").select(F.col("_id").alias(id), F.col("_n").alias(out))


def _blockwise(points: DataFrame, r: DataFrame, parts: int, block: int, id_type: str) -> DataFrame:
    """range_count_distinct's counts where the points don't fit into one task."""
    parts = min(parts, 2048)  # the grid has its square of cells
    edges = [np.unique(e) for e in points.approxQuantile(["_at", "_prev"], [i / parts for i in range(1, parts)], 0.2 / parts)]
    edges = [e.astype(np.int64) for e in edges]

    def placed(a: str, b: str, names: list[str]):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                spots = [np.searchsorted(e, t[c].to_numpy(), side="right").astype(np.int32) for e, c in zip(edges, (a, b), strict=True)]
                yield pa.RecordBatch.from_arrays([*t.columns, *map(pa.array, spots)], names=[*names, "_tb", "_pb"])

        return scan

    points = stored(points.mapInArrow(placed("_at", "_prev", ["_at", "_prev"]), "_at long, _prev long, _tb int, _pb int"), "placed-points")
    r = stored(r.mapInArrow(placed("_high", "_low", ["_id", "_low", "_high"]), f"_id {id_type}, _low long, _high long, _tb int, _pb int").withColumn("_row", F.monotonically_increasing_id()), "placed-ranges")
    grid = np.zeros((len(edges[0]) + 2, len(edges[1]) + 2), np.int64)
    for tb, pb, k in points.groupBy("_tb", "_pb").count().toLocalIterator():
        grid[tb + 1, pb + 1] = k
    grid = grid.cumsum(0).cumsum(1)  # [i, j]: points of blocks before i and j
    by_time = grid[:, -1]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tb, pb, lo = _numbers(b, "_tb", "_pb", "_low")
            t_of_low = np.searchsorted(edges[0], lo, side="right")
            n = grid[tb, pb] - by_time[t_of_low]
            yield pa.RecordBatch.from_arrays([b["_row"], pa.array(n)], names=["_row", "_n"])

    counts = r.select("_row", "_tb", "_pb", "_low").mapInArrow(whole, "_row long, _n long")
    # The partial blocks: the range's end block by time, its start block by predecessor (times before that block), and, to be taken off, its start block by time.
    asked = r.select("_row", F.lit(0).alias("kind"), F.col("_tb").alias("b"), F.col("_high").alias("x"), F.col("_low").alias("y"))
    asked = asked.unionByName(r.select("_row", F.lit(1).alias("kind"), F.col("_pb").alias("b"), F.col("_tb").cast("long").alias("x"), F.col("_low").alias("y")))
    starts = r.select("_row", "_low").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b["_row"], b["_low"], pa.array(np.searchsorted(edges[0], b["_low"].to_numpy(), side="right").astype(np.int32))], names=["_row", "_low", "b"]) for b in bs), "_row long, _low long, b int")
    asked = asked.unionByName(starts.select("_row", F.lit(2).alias("kind"), "b", F.col("_low").alias("x"), F.lit((1 << 63) - 1).alias("y")))
    have = points.select(F.lit(0).alias("kind"), F.col("_tb").alias("b"), F.col("_at").alias("x"), F.col("_prev").alias("y"))
    have = have.unionByName(points.select(F.lit(1).alias("kind"), F.col("_pb").alias("b"), F.col("_tb").cast("long").alias("x"), F.col("_prev").alias("y")))
    have = have.unionByName(points.select(F.lit(2).alias("kind"), F.col("_tb").alias("b"), F.col("_at").alias("x"), F.lit(0).cast("long").alias("y")))
    shares = F.broadcast(asked.groupBy("kind", "b").agg(F.ceil(F.count("*") / block).cast("int").alias("shares")))  # a row per block
    asked = asked.join(shares, ["kind", "b"]).withColumn("share", F.pmod(F.xxhash64("_row"), "shares").cast("int")).drop("shares")
    have = have.join(shares, ["kind", "b"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares").withColumn("_row", F.lit(None).cast("long"))

    def local(key: tuple, points: pa.Table, asked: pa.Table) -> pa.Table:
        n = Below(*_numbers(points, "x", "y")).count(*_numbers(asked, "x", "y")) if points.num_rows else np.zeros(asked.num_rows, np.int64)
        return pa.table({"_row": asked["_row"], "_n": -n if key[0].as_py() == 2 else n})

    keys = ["kind", "b", "share"]
    partial = have.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(local, "_row long, _n long")
    sums = counts.unionByName(partial).groupBy("_row").agg(F.sum("_n").alias("_n"))
    return r.select("_row", "_id").join(sums, "_row").select("_id", "_n")
