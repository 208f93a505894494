"""Messages delivered more than once: which rows are copies, and which copy is kept.

Rows are first combined per distinct (scope, primary, secondary) by a maximum over the whole tie-break order; that
aggregate is partial map-side, so an identifier with a third of all rows costs one row per input partition.
Everything after works on distinct identifiers. The order's columns are packed into one whole number (mixed radix,
the spans taken from the data), because only aggregates with buffers of fixed width stay hash aggregates.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .components import components


def latest_by(df: DataFrame, keys: list[str], order: Column, *, keep_null_keys: bool = True) -> DataFrame:
    """Of each group of equal keys the row with the largest `order`; rows with a null key pass through unmerged.

    `order` must end in a unique column, else any of the tied rows stays.
    """
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    cols = df.columns
    best = df.filter(~null).groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_row")).select("_row.*")
    return best.unionByName(df.filter(null)) if keep_null_keys else best


def key124(scope: Column, key: Column) -> Column:
    """(scope, key) as one number of 124 hashed bits, null where key is: narrow, and of fixed width for hash aggregates."""
    half = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 62)).cast("decimal(38,0)")
    both = (half(scope, key) * F.lit(Decimal(1 << 62)).cast("decimal(38,0)")).cast("decimal(38,0)") + half(F.lit(0x9E3779B9), key, scope)
    return F.when(key.isNotNull(), both.cast("decimal(38,0)"))


def identifier_labels(triples: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What links distinct identifiers (scope, primary, secondary; primary or secondary may be null).

    Equal primaries are copies; a row without primary is a copy of all rows with its secondary; copies of
    copies are copies. Gives (scope, secondary, label) for each secondary that a row without primary carries
    and a primary too, and (scope, primary, label) for each primary that is linked to another, or None if none
    is. Secondaries that no bare row carries link nothing. Chains are resolved by star contraction over the
    few linking edges only.
    """
    bare = (
        triples.filter(F.col("secondary").isNotNull()).groupBy("scope", "secondary")
        .agg(F.min("primary").alias("first"), F.max(F.col("primary").isNull().cast("int")).alias("bare"))
        .filter((F.col("bare") == 1) & F.col("first").isNotNull()).select("scope", "secondary", "first")
    )
    bare = stored(bare, "bare")
    edges = (
        triples.filter(F.col("primary").isNotNull() & F.col("secondary").isNotNull())
        .join(bare, ["scope", "secondary"]).filter(F.col("primary") != F.col("first"))
        .select(F.struct("scope", F.col("primary").alias("p")).alias("a"), F.struct("scope", F.col("first").alias("p")).alias("b")).distinct()
    )
    edges = stored(edges, "linking")
    if edges.isEmpty():
        return bare.withColumnRenamed("first", "label"), None
    linked = components(edges).select(F.col("node.scope").alias("scope"), F.col("node.p").alias("primary"), F.col("component.p").alias("label"))
    linked = stored(linked, "labels")
    by_secondary = bare.join(linked, (bare["scope"] == linked["scope"]) & (bare["first"] == linked["primary"]), "left")
    return by_secondary.select(bare["scope"], "secondary", F.coalesce("label", "first").alias("label")), linked


def identifier_groups(triples: DataFrame) -> DataFrame:
    """Adds group_primary and group_secondary, which together name the group of copies of each distinct identifier triple."""
    by_secondary, by_primary = identifier_labels(triples)
    t = triples.join(by_secondary.withColumnRenamed("label", "_s"), ["scope", "secondary"], "left")
    if by_primary is not None:
        t = t.join(by_primary.withColumnRenamed("label", "_p"), ["scope", "primary"], "left")
        t = t.withColumn("group_primary", F.when(F.col("primary").isNotNull(), F.coalesce("_p", "primary")).otherwise(F.col("_s"))).drop("_p")
    else:
        t = t.withColumn("group_primary", F.coalesce("primary", "_s"))
    return t.drop("_s").withColumn("group_secondary", F.when(F.col("group_primary").isNull(), F.col("secondary")))


def _packed(rows: DataFrame, order: list[str]) -> tuple[Column, int, int] | None:
    """The order's columns (whole numbers, never null) as one, and span and least value of the last; None if it would have over 38 digits."""
    ends = rows.agg(*(F.min(c).alias(f"lo{i}") for i, c in enumerate(order)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(order))).first()
    spans = [(ends[f"lo{i}"], ends[f"hi{i}"] - ends[f"lo{i}"] + 1) if ends["lo0"] is not None else (0, 1) for i in range(len(order))]
    if math.prod(n for _, n in spans) >= 10**38:
        return None
    whole = lambda v: F.lit(Decimal(v)).cast("decimal(38,0)") if type(v) is int else F.col(v).cast("decimal(38,0)")
    out = whole(0)
    for c, (least, span) in zip(order, spans, strict=True):
        out = (out * whole(span)).cast("decimal(38,0)") + (whole(c) - whole(least)).cast("decimal(38,0)")
        out = out.cast("decimal(38,0)")
    return out, spans[-1][1], spans[-1][0]


def _best(rows: DataFrame, keys: list[str], *, ranked: bool) -> DataFrame:
    """The best row's rank of each group; if ids aren't part of the rank (ranked), the largest id of the best rank, each step a hash aggregate."""
    if not ranked:
        return rows.groupBy(*keys).agg(F.max("best").alias("best"))
    one = rows.groupBy(*keys, "best").agg(F.max("_id").alias("_id"))
    return one.groupBy(*keys).agg(F.max_by("_id", "best").alias("_id"), F.max("best").alias("best"))


def dropped_copies(rows: DataFrame, id: str, scope: Column, primary: str, secondary: str, order: list[Column]) -> DataFrame:
    """The `id` of every row that isn't the kept one of its group of copies.

    order: whole numbers, never null, whose largest values win, one after another; id (unique, a long) decides at last.
    Rows without both identifiers have no copies, rows without id are left out. Identifiers are compared by key124. Empty input: empty result. `rows` is
    read once.
    """
    cols = [f"_o{i}" for i in range(len(order))]
    keyed = rows.filter((F.col(primary).isNotNull() | F.col(secondary).isNotNull()) & F.col(id).isNotNull()).select(
        F.lit(0).alias("scope"), key124(scope, F.col(primary)).alias("primary"), key124(scope, F.col(secondary)).alias("secondary"), *(o.cast("long").alias(c) for o, c in zip(order, cols, strict=True)), F.col(id).cast("long").alias("_id")
    )
    keyed = stored(keyed, "keyed")
    whole, without = _packed(keyed, [*cols, "_id"]), None
    if whole is None:
        without = _packed(keyed, cols)
    best = whole[0] if whole else without[0] if without else F.struct(*cols, "_id")
    ranked = without is not None
    triples = stored(_best(keyed.select("scope", "primary", "secondary", "_id", best.alias("best")), ["scope", "primary", "secondary"], ranked=ranked), "identifiers")
    kept = _best(identifier_groups(triples), ["scope", "group_primary", "group_secondary"], ranked=ranked)
    if whole:
        kept = kept.select(((F.col("best") % F.lit(Decimal(whole[1]))) + F.lit(Decimal(whole[2]))).cast("long").alias("_id"))
    elif not ranked:
        kept = kept.select("best._id")
    return keyed.select("_id").join(kept.select("_id"), "_id", "left_anti").select(F.col("_id").alias(id))
