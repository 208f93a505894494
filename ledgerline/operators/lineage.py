"""Lineage: ordered id lists, re-summed numbers, content fingerprints, frame differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_ids(order: list[Column], id: str, only: Column | None = None) -> Column:
    """Aggregate: the group's ids as an array in the given order (of rows for which `only` holds)."""
    item = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(id).alias("id"))
    return F.transform(F.array_sort(F.collect_list(item if only is None else F.when(only, item))), lambda x: x["id"])


def resum(events: DataFrame, keys: list[str], contribution: Column, null_is_zero: bool, out: str = "resummed") -> DataFrame:
    """Each group's sum over its events: null if no event has a known contribution, unless that counts as zero."""
    total = F.sum(contribution.cast("double"))
    return events.groupBy(*keys).agg((F.coalesce(total, F.lit(0.0)) if null_is_zero else total).alias(out))


def agreement(reported: DataFrame, resummed: DataFrame, keys: list[str], value: str, out: str = "resummed", tolerance: float = 1e-9) -> DataFrame:
    """Reported and re-summed values side by side, and whether they agree within a relative tolerance (null agrees with null)."""
    on = None
    right = resummed.select(*[F.col(k).alias("_r_" + k) for k in keys], F.col(out))
    for k in keys:
        c = F.col(k).eqNullSafe(F.col("_r_" + k))
        on = c if on is None else on & c
    joined = reported.join(right, on, "left") if keys else reported.crossJoin(right)  # without keys both are one row
    a, b = F.col(value).cast("double"), F.col(out)
    same = F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))
    return joined.select(*keys, F.col(value), F.col(out), same.alias("agrees"))


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, checksum: equal for equal rows in any order and partitioning; repeated rows count."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) if str(df.schema[c].dataType).startswith("MapType") else F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: dict[str, float] | None = None) -> DataFrame:
    """keys, field, left_value, right_value of every value that differs between two aggregate frames; a missing row counts as 0."""
    tolerance = tolerance or {}
    l = left.select(*keys, *[F.col(v).cast("double").alias("l_" + v) for v in values])
    r = right.select(*keys, *[F.col(v).cast("double").alias("r_" + v) for v in values])
    both = l.join(r, keys, "full_outer")
    cells = F.array(*[F.struct(F.lit(v).alias("field"), F.coalesce("l_" + v, F.lit(0.0)).alias("left_value"), F.coalesce("r_" + v, F.lit(0.0)).alias("right_value"), F.lit(tolerance.get(v, 0.0)).alias("t")) for v in values])
    melted = both.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    off = F.abs(F.col("left_value") - F.col("right_value")) > F.col("t") * F.greatest(F.abs("left_value"), F.abs("right_value"))
    return melted.filter(off).drop("t")
