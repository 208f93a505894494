"""Matching records of two tables by nearest time within an entity.

Both sides are range-partitioned together by (entity, time), so an entity with a third of all rows is spread
over as many tasks as it needs. Each task scans its sorted rows once and finds, for every left record, the
nearest right record before and after it inside the partition. The right records at partition edges, two for
each partition, go through a prefix scan in both directions and complete the left records near the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import blocks, drop, stored

_SCANNED = (
    "part int, edge boolean, entity string, t long, id long, before_t long, before_id long, after_t long, after_id long, "
    "open_before boolean, open_after boolean, first_entity string, first_t long, first_id long, last_entity string, last_t long, last_id long"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition, sorted by entity, t, side (right first), id: its left rows with partners, and one row on its edges."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    part = TaskContext.get().partitionId()
    rows = pa.Table.from_batches(batches)
    n = rows.num_rows
    entity = rows["entity"].combine_chunks()
    code = entity.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    t, ids, right = rows["t"].to_numpy(), rows["id"].combine_chunks(), rows["right"].to_numpy()  # ids may be null
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(right, at, -1))
    after = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]
    left = np.nonzero(~right)[0]
    b, a = before[left], after[left]
    has_b = (b >= 0) & (code[np.maximum(b, 0)] == code[left])
    has_a = (a < n) & (code[np.minimum(a, n - 1)] == code[left])
    # A left row may have its partner in another partition if no right row of this one stands between it and the edge.
    open_b, open_a = (b < 0) & (code[left] == code[0]), (a == n) & (code[left] == code[-1])
    b, a = np.where(has_b, b, 0), np.where(has_a, a, 0)
    b_, a_ = pa.array(b, mask=~has_b), pa.array(a, mask=~has_a)
    m = len(left)
    none_s, none_l = pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())
    cols = [
        pa.array(np.full(m, part, np.int32)), pa.array(np.zeros(m, bool)), entity.take(pa.array(left)), pa.array(t[left]), ids.take(pa.array(left)),
        pa.array(t[b], mask=~has_b), ids.take(b_), pa.array(t[a], mask=~has_a), ids.take(a_),
        pa.array(open_b), pa.array(open_a), none_s, none_l, none_l, none_s, none_l, none_l,
    ]
    names = [f.split()[0] for f in _SCANNED.split(", ")]
    if m:
        yield from pa.table(dict(zip(names, cols, strict=True))).to_batches(max_chunksize=50_000)
    r = np.nonzero(right)[0]
    ends = [(entity[int(i)].as_py(), int(t[i]), ids[int(i)].as_py()) for i in (r[0], r[-1])] if len(r) else [(None, None, None)] * 2
    one = [part, True, None, None, None, None, None, None, None, None, None, *ends[0], *ends[1]]
    kinds = [c.type for c in cols]
    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], names=names)


def nearest(
    left: DataFrame, right: DataFrame, left_cols: tuple[Column, Column, Column], right_cols: tuple[Column, Column, Column], tolerance: int
) -> DataFrame:
    """left_id, right_id, distance: for each left record the right record of its entity nearest in time, at most `tolerance` away.

    The column triples are (entity, time, id); times are whole numbers of one unit, ids whole numbers. Among
    right records at one instant the smallest id stands; if one before and one after are equally near, the
    earlier. A right record at a left record's own instant counts as distance 0. Left records without partner
    don't appear; rows with a null entity or time match
    nothing, nor do right rows with a null id; left ids may repeat or be null (each row is matched). Empty tables
    give no rows.
    """
    le, lt, li = left_cols
    re_, rt, ri = right_cols
    lefts = left.select(le.cast("string").alias("entity"), lt.cast("long").alias("t"), li.cast("long").alias("id"), F.lit(False).alias("right"))
    # One right record per instant: combined map-side, so neither an instant nor an entity can fill a task.
    rights = (
        right.select(re_.cast("string").alias("entity"), rt.cast("long").alias("t"), ri.cast("long").alias("id"))
        .filter("entity is not null and t is not null and id is not null").groupBy("entity", "t").agg(F.min("id").alias("id")).withColumn("right", F.lit(True))
    )
    # Stored, because ranges are sampled before they are cut, and counted, so that no task holds more than a bounded part.
    both = stored(lefts.filter("entity is not null and t is not null").unionByName(rights), "both")
    parts = blocks(both.sparkSession, both.count())
    ordered = both.repartitionByRange(parts, "entity", "t", F.col("right").desc(), "id").sortWithinPartitions("entity", "t", F.col("right").desc(), "id")
    scanned = stored(ordered.mapInArrow(_scan, _SCANNED), "scanned")
    drop(both)

    # The prefix scan: one row per partition, so its size follows the number of tasks and not the data.
    edges = scanned.filter("edge").select("part", F.struct("last_entity", "last_t", "last_id").alias("last"), F.struct("first_entity", "first_t", "first_id").alias("first"), F.col("last_id").isNotNull().alias("any"))
    back = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.orderBy(F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = edges.select(
        "part",
        F.last(F.when(F.col("any"), F.col("last")), ignorenulls=True).over(back).alias("prev"),
        F.last(F.when(F.col("any"), F.col("first")), ignorenulls=True).over(ahead).alias("next"),
    )
    rows = scanned.filter("not edge").join(F.broadcast(carried), "part", "left")
    from_before = F.when(F.col("open_before") & (F.col("prev.last_entity") == F.col("entity")), F.col("prev"))
    from_after = F.when(F.col("open_after") & (F.col("next.first_entity") == F.col("entity")), F.col("next"))
    rows = rows.select(
        F.col("id").alias("left_id"), "t",
        F.coalesce("before_t", from_before["last_t"]).alias("bt"), F.coalesce("before_id", from_before["last_id"]).alias("bi"),
        F.coalesce("after_t", from_after["first_t"]).alias("at"), F.coalesce("after_id", from_after["first_id"]).alias("ai"),
    )
    b, a = F.col("t") - F.col("bt"), F.col("at") - F.col("t")
    take_b = F.col("bt").isNotNull() & (F.col("at").isNull() | (b <= a))
    return rows.select("left_id", F.when(take_b, F.col("bi")).otherwise(F.col("ai")).alias("right_id"), F.when(take_b, b).otherwise(a).alias("distance")).filter(
        F.col("right_id").isNotNull() & (F.col("distance") <= tolerance)
    )
