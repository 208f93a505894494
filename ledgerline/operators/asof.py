"""As-of joins: for each left row the nearest right row before or after it within a key.

Neither side is exploded and no row meets every other. Rows are windowed by (key, time bucket), so a key with a
third of all rows is cut into its buckets; what must be carried from one bucket to the next is one row per
bucket, scanned in a second, small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _nearest(left: DataFrame, right: DataFrame, by: list[str], lt: Column, rt: Column, tie: Column, strict: bool, take: list[str], prefix: str, bucket: int) -> DataFrame:
    """lt and rt grow towards the wanted side; of right rows with equal time the largest tie wins."""
    at, side = "_at", "_side"
    got = F.struct(rt.alias("t"), tie.alias("tie"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(take)])
    r = right.filter(rt.isNotNull()).select(*by, rt.alias(at), got.alias("_got"))
    ordinal = F.struct(*[F.col(c) for c in left.columns])
    known = lt.isNotNull()
    for k in by:
        known = known & F.col(k).isNotNull()
    l = left.withColumns({"_row": ordinal, at: lt})
    # At equal times a right row counts unless the join is strict: it sorts before the left row then.
    both = l.filter(known).select(*by, at, F.lit(None).cast(r.schema["_got"].dataType).alias("_got"), "_row", F.lit(1 if not strict else 0).alias(side)).unionByName(
        r.select(*by, at, "_got", F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.lit(0 if not strict else 1).alias(side))
    ).withColumn("_b", F.floor(F.col(at) / bucket))
    local = W.partitionBy(*by, "_b").orderBy(at, side, F.col("_got.tie").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    # Every bucket that holds rows of either side takes the last right row of the buckets before it.
    wanted = both.groupBy(*by, "_b").agg(F.max("_got").alias("_last"))
    carried = wanted.select(*by, "_b", F.last("_last", ignorenulls=True).over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    found = both.withColumn("_local", F.last("_got", ignorenulls=True).over(local)).filter(F.col("_row").isNotNull()).join(carried, [*by, "_b"], "left")
    hit = F.coalesce("_local", "_carried")
    out = found.select("_row.*", *[hit[f"v{i}"].alias(prefix + c) for i, c in enumerate(take)])
    rest = l.filter(~F.coalesce(known, F.lit(False))).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(prefix + c) for c in take])
    return out.unionByName(rest)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_t: Column, right_t: Column, tie: Column, take: list[str], *, strict: bool = False, prefix: str = "", bucket: int = 86_400_000) -> DataFrame:
    """left with `take` of the latest right row at or (strict) before left_t; of equal times the largest tie.

    Times are whole numbers of one unit, `bucket` units to a window. Left rows whose key or time is null, or that
    find nothing, get nulls; right rows with a null time are left out. Every left row comes out once.
    """
    return _nearest(left, right, by, left_t, right_t, tie, strict, take, prefix, bucket)


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], left_t: Column, right_t: Column, tie: Column, take: list[str], *, strict: bool = True, prefix: str = "", bucket: int = 86_400_000) -> DataFrame:
    """left with `take` of the earliest right row at or (strict) after left_t; of equal times the smallest tie (a number)."""
    return _nearest(left, right, by, -left_t, -right_t, -tie, strict, take, prefix, bucket)


def scd_ranges(dim: DataFrame, key: list[str], since: str, until: str = "until") -> DataFrame:
    """A slowly changing dimension with the start of each row's successor: [since, until), until null for the last."""
    return dim.withColumn(until, F.lead(since).over(W.partitionBy(*key).orderBy(since)))
