"""Ordered rows: runs of equal values, consecutive pairs, stale values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import prefix_count, prefix_max


def with_previous(df: DataFrame, by: list[str], order: list[Column], bucket: Column | None = None, out: str = "_previous") -> DataFrame:
    """df with the row before each in its key, as a struct (null for the first).

    bucket: a column that grows with the order, for keys that may hold any share of all rows: windows then span one
    bucket each, and the last row of a bucket, one per bucket, is carried to the next that has rows.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    if bucket is None:
        return df.withColumn(out, F.lag(row).over(W.partitionBy(*by).orderBy(*order)))
    b = df.withColumns({"_b": bucket, "_row": row})
    last = b.groupBy(*by, "_b").agg(F.max_by("_row", F.struct(*order)).alias("_last"))
    carried = last.select(*[F.col(k).alias("_k_" + k) for k in by], F.col("_b").alias("_kb"), F.lag("_last").over(W.partitionBy(*by).orderBy("_b")).alias("_carried"))
    on = F.col("_b").eqNullSafe(F.col("_kb"))
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col("_k_" + k))
    near = b.withColumn("_near", F.lag("_row").over(W.partitionBy(*by, "_b").orderBy(*order)))
    return near.join(carried, on, "left").select(*df.columns, F.coalesce("_near", "_carried").alias(out))


def run_ids(df: DataFrame, by: list[str], order: list[Column], changed: Column, out: str = "run", bucket: Column | None = None) -> DataFrame:
    """df with the number of each row's run, from 1: a run starts at the first row and where `changed` holds.

    changed may use `_previous`, the struct of the row before. Without `bucket` keys must be bounded groups (captures of
    one response); with it they may hold any share of all rows, see with_previous.
    """
    marked = with_previous(df, by, order, bucket)
    starts = F.coalesce(F.col("_previous").isNull() | changed, F.lit(False))
    if bucket is None:
        counted = F.sum(F.when(starts, 1).otherwise(0)).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
        return marked.withColumn(out, counted).drop("_previous")
    return prefix_count(marked.withColumn("_starts", starts), by, bucket, order, F.col("_starts"), out).drop("_starts", "_previous")


def stale_flag(df: DataFrame, by: list[str], bucket: Column, order: list[Column], value: str, slack: float, out: str = "stale", only: Column | None = None) -> DataFrame:
    """df with 1 where value lies more than `slack` under an earlier one of its key (and `only` holds), else 0."""
    high = prefix_max(df, by, bucket, order, F.col(value), "_high")
    low = F.col(value) < F.col("_high") - slack
    return high.withColumn(out, F.when(low & (only if only is not None else F.lit(True)), 1).otherwise(0)).drop("_high")


def consecutive(df: DataFrame, by: list[str], order: list[Column], previous: dict[str, str], bucket: Column | None = None) -> DataFrame:
    """Rows that have a row before them in their key, with `previous` (column -> new name) of that row; bucket as in with_previous."""
    lagged = with_previous(df, by, order, bucket).filter(F.col("_previous").isNotNull())
    return lagged.withColumns({name: F.col("_previous")[c] for c, name in previous.items()}).drop("_previous")
