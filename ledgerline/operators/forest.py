"""Parent-child rows to rooted forests: roots, depths, cycles, paths and descendants.

Weighted disjoint-set forests. Each range of ids is one block: its links are united there with path
compression, every node keeping its offset to the block's root. Only block roots whose parent lies in
another block go on, as links between roots with summed weights; blocks are merged hierarchically until no
link leaves its block. Offsets are then added back down. The work per level shrinks with the share of
links that cross blocks; where ids have no locality and a level does not shrink, pointer doubling by joins
takes over, so no task ever holds more than a bounded block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import blocks, checked_broadcast, drop, stored

#: Links that one task may unite on its own; above it a level is split or doubled by joins.
BLOCK_LINKS = 500_000
FAN_IN = 8
CYCLE = -1

_LEVEL = "id long, root long, dist long, open boolean, ext long, extw long"


def key128(scope: list[Column], key: Column) -> list[Column]:
    """Two independent 64-bit hashes of (scope, key): 16 bytes in place of long strings, both null where key is."""
    return [
        F.when(key.isNotNull(), F.xxhash64(*scope, key)),
        F.when(key.isNotNull(), F.xxhash64(F.lit(0x9E3779B9), key, *scope)),
    ]


def nodes_of(rows: DataFrame, id: str, scope: list[str], key: str, parent: str, *extra: Column) -> DataFrame:
    """One row per node: h1, h2 (its key), p1, p2 (its parent's key), id, and the `extra` aggregates.

    Rows of equal scope and key are one node with the smallest id and the one non-null parent; if they name
    different parents, the parent counts as unknown. Rows with a null key, scope or id are no nodes. Hot keys are
    combined map-side.
    """
    s = [F.col(c) for c in scope]
    rows = rows.filter(F.col(key).isNotNull() & F.col(id).isNotNull())
    for c in s:
        rows = rows.filter(c.isNotNull())
    h, p = key128(s, F.col(key)), key128(s, F.col(parent))
    rows = rows.withColumns({"_h1": h[0], "_h2": h[1], "_p1": p[0], "_p2": p[1], "_id": F.col(id)})
    # Longs only, so that it stays a hash aggregate.
    one = (F.min("_p1") == F.max("_p1")) & (F.min("_p2") == F.max("_p2"))
    least = lambda c: F.when(one | F.min(c).isNull(), F.min(c)).otherwise(0)
    return rows.groupBy("_h1", "_h2").agg(
        least("_p1").alias("p1"), least("_p2").alias("p2"), F.min("_id").alias("id"), *extra
    ).withColumnsRenamed({"_h1": "h1", "_h2": "h2"})


def links_of(nodes: DataFrame, *keep: str) -> DataFrame:
    """id, pid, orphan and `keep`: each node's parent node; pid is null for roots, orphan if the parent's key is unknown.

    Null parents stay out of the join (they would all meet in one task); a parent with very many children is
    left to AQE's skew split, as both sides come straight from stored tables.
    """
    have = nodes.filter(F.col("p1").isNotNull())
    up = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("id").alias("pid"))
    joined = have.select("id", "p1", "p2", *keep).join(up, ["p1", "p2"], "left")
    roots = nodes.filter(F.col("p1").isNull()).select("id", F.lit(None).cast("long").alias("pid"), F.lit(False).alias("orphan"), *keep)
    return joined.select("id", "pid", F.col("pid").isNull().alias("orphan"), *keep).unionByName(roots)


def unite(ids: np.ndarray, pid: np.ndarray, w: np.ndarray, has: np.ndarray, open_: np.ndarray):
    """One block's weighted disjoint-set forest: arrays root, dist, open, and ext, extw of the roots that leave the block.

    has: the node has a parent; open_: that parent is a node of this level (else it is a final root, or CYCLE).
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ids, pid, w, has, open_ = ids[order], pid[order], w[order], has[order], open_[order]
    at = np.searchsorted(ids, pid)
    at[at == n] = 0
    inside = has & open_ & (ids[at] == pid) if n else has
    ptr = np.where(inside, at, np.arange(n))
    off = np.where(inside, w, 0)
    for _ in range(max(1, n).bit_length() + 1):
        far = ptr[ptr]
        if np.array_equal(far, ptr):
            break
        off = off + off[ptr]
        ptr = far
    cyclic = inside[ptr]  # what hasn't arrived at a root by now never will
    top_has, top_open = has[ptr], open_[ptr] & has[ptr]
    root = np.where(top_has & ~top_open, pid[ptr], ids[ptr])
    dist = off + np.where(top_has & ~top_open, w[ptr], 0)
    lost = cyclic | (root == CYCLE)
    root, dist = np.where(lost, CYCLE, root), np.where(lost, CYCLE, dist)
    is_open = top_open & ~cyclic
    leaves = ~inside & has & open_
    return ids, root, dist, is_open, leaves, pid, w


def _unite_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    pid = table["pid"].combine_chunks()
    has = pid.is_valid().to_numpy(zero_copy_only=False)
    ids, root, dist, is_open, leaves, ext, extw = unite(
        table["id"].to_numpy(), pid.fill_null(0).to_numpy(zero_copy_only=False), table["w"].to_numpy(), has, table["open"].to_numpy()
    )
    out = pa.table({
        "id": ids, "root": root, "dist": dist, "open": is_open,
        "ext": pa.array(ext, mask=~leaves), "extw": pa.array(extw, mask=~leaves),
    })
    yield from out.to_batches(max_chunksize=100_000)


def _double(links: DataFrame, rows: int) -> DataFrame:
    """Pointer doubling by joins until every link ends at a final root: for levels whose ids have no locality."""
    for _ in range(max(1, rows).bit_length() + 1):
        done, still = links.filter(~F.col("open")), links.filter("open")
        if still.isEmpty():
            return links
        up = links.select(F.col("id").alias("pid"), F.col("pid").alias("_p"), F.col("w").alias("_w"), F.col("open").alias("_o"))
        ahead = still.join(up, "pid").select("id", F.col("_p").alias("pid"), (F.col("w") + F.col("_w")).alias("w"), F.col("_o").alias("open"))
        following = stored(done.unionByName(ahead), "double")
        drop(links)
        links = following
    return links.select("id", F.when(F.col("open"), CYCLE).otherwise(F.col("pid")).alias("pid"), "w", F.lit(False).alias("open"))


def rooted(links: DataFrame, block_links: int = BLOCK_LINKS, weight: str | None = None) -> DataFrame:
    """id, root, depth for links (id unique, pid null for roots; every other pid is an id of links).

    weight: a column with a link's length (not negative, never null); depth is then the sum of lengths up to the root.
    Nodes on a cycle or below one get root and depth -1. An empty input gives an empty result.
    """
    spark = links.sparkSession
    w = F.lit(1) if weight is None else F.col(weight)
    level = links.select(F.col("id").cast("long").alias("id"), F.col("pid").cast("long").alias("pid"), w.cast("long").alias("w"), F.col("pid").isNotNull().alias("open"))
    level = stored(level, "links")
    rows = level.count()
    parts = blocks(spark, rows, block_links)
    levels: list[tuple[DataFrame, int]] = []
    while True:
        ranged = level.repartitionByRange(parts, "id") if parts > 1 else level.coalesce(1)
        united = stored(ranged.mapInArrow(_unite_arrow, _LEVEL), "united")
        drop(level)
        levels.append((united, rows))
        crossing = united.filter(F.col("ext").isNotNull()).select(F.col("id").alias("x"), "ext", "extw")
        count = crossing.count()
        if not count:
            break
        target = united.select(F.col("id").alias("ext"), "root", "dist", "open")
        level = stored(
            checked_broadcast(crossing, count, 24).join(target, "ext").select(
                F.col("x").alias("id"), F.col("root").alias("pid"), (F.col("extw") + F.greatest(F.col("dist"), F.lit(0))).alias("w"), "open"
            ),
            "merged",
        )
        if count > block_links and 2 * count > rows:
            level = _double(level, count)
        rows, parts = count, 1 if count <= block_links else max(math.ceil(count / block_links), parts // FAN_IN)
    below, n = levels[-1]
    result = below.select("id", "root", "dist")
    for united, size in reversed(levels[:-1]):
        top = result.select(F.col("id").alias("_r"), F.col("root").alias("_root"), F.col("dist").alias("_dist"))
        on = (F.when(F.col("open"), F.col("root"))) == F.col("_r")
        joined = united.filter("open").join(checked_broadcast(top, n, 24), on)
        result = joined.select(
            "id", F.col("_root").alias("root"), F.when(F.col("_root") == CYCLE, CYCLE).otherwise(F.col("dist") + F.col("_dist")).alias("dist")
        ).unionByName(united.filter(~F.col("open")).select("id", "root", "dist"))
        n = size
    return result.select("id", "root", F.col("dist").alias("depth"))


# --- paths and descendants ---------------------------------------------------------------------------------

STEP = 32


def paths(links: DataFrame, step: int = STEP, placed: DataFrame | None = None) -> DataFrame:
    """id, root, depth, anchor, segment: each node's path, indexed in steps.

    segment runs from below the anchor down to the node, 1 to `step` nodes; the anchor is the ancestor whose depth
    is the next multiple of `step` above (null for a root, whose segment is itself). The full path is the anchor's
    path and then the segment, so a tree as deep as it is large still takes at most `step` ids a node. Segments
    grow by pointer doubling: log2(step) joins. Nodes without root don't appear.
    """
    placed = rooted(links) if placed is None else placed
    good = placed.filter(F.col("root") != CYCLE)
    now = links.select("id", F.col("pid").alias("top")).join(good, "id")
    up = good.select(F.col("id").alias("top"), (F.col("depth") % step == 0).alias("_stop"))
    now = now.join(up, "top", "left").withColumns({"segment": F.array("id"), "ends": F.coalesce("_stop", F.lit(True))}).drop("_stop")
    now = stored(now.select("id", "root", "depth", "top", "segment", "ends"), "paths")
    for _ in range(max(1, step - 1).bit_length()):
        above = now.filter(F.col("depth") % step != 0).select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("segment").alias("_segment"), F.col("ends").alias("_ends"))
        grown = now.filter(~F.col("ends")).join(above, "top").select("id", "root", "depth", F.col("_top").alias("top"), F.concat("_segment", "segment").alias("segment"), F.col("_ends").alias("ends"))
        following = stored(now.filter("ends").unionByName(grown), "paths")
        drop(now)
        now = following
    return now.select("id", "root", "depth", F.col("top").alias("anchor"), "segment")


def _sum_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block's trees: each node's sum of weights below and at it inside the block, its local root, and where that root hangs."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    t = pa.Table.from_batches(got)
    pid = t["pid"].combine_chunks()
    order = np.argsort(t["id"].to_numpy(), kind="stable")
    has = pid.is_valid().to_numpy(zero_copy_only=False)[order]
    up = pid.fill_null(0).to_numpy(zero_copy_only=False)[order]
    ids, weight = t["id"].to_numpy()[order], t["weight"].to_numpy()[order]
    total = weight.tolist()
    n = len(ids)
    at = np.searchsorted(ids, up)
    at[at == n] = 0
    inside = has & (ids[at] == up)
    _, root, dist, _, _, _, _ = unite(ids, np.where(inside, up, 0), np.ones(n, np.int64), inside, inside)
    parent = at.tolist()
    for i in np.argsort(-dist, kind="stable").tolist():
        if inside[i]:
            total[parent[i]] += total[i]
    out = pa.table({
        "id": ids, "pid": pa.array(up, mask=~has), "weight": weight, "top": root, "total": pa.array(total, pa.int64()), "ext": pa.array(up, mask=~(has & ~inside)),
        "part": np.full(n, TaskContext.get().partitionId(), np.int32),
    })
    yield from out.to_batches(max_chunksize=100_000)


def _doubled_sums(tree: DataFrame, rows: int) -> DataFrame:
    """id, total for a forest (id, pid, weight) without cycles whose ids have no locality: pointer doubling by joins.

    After k rounds total holds the weights less than 2**k links below a node, and up is its ancestor 2**k links above.
    Each round adds to every node the totals of those that point at it: log2(depth) rounds.
    """
    now = stored(tree.select("id", F.col("pid").alias("up"), F.col("weight").alias("total")), "doubled")
    for _ in range(max(1, rows).bit_length() + 1):
        rising = now.filter("up is not null")
        if rising.isEmpty():
            return now.select("id", "total")
        more = rising.groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("_more"))
        ahead = rising.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        grown = now.join(more, "id", "left").join(ahead, F.col("up") == F.col("_id"), "left")
        following = stored(grown.select("id", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_more", F.lit(0))).alias("total")), "doubled")
        drop(now)
        now = following
    raise ValueError("a forest with a cycle has no subtree sums")


def _subtree_sums(tree: DataFrame, rows: int, parts: int, block_links: int) -> DataFrame:
    """id, total for a forest (id, pid, weight) without cycles: block sums, then the tree of block roots, then the blocks again.

    Where the tree of block roots doesn't shrink, it is summed by pointer doubling.
    """
    ranged = tree.repartitionByRange(parts, "id") if parts > 1 else tree.coalesce(1)
    schema = "id long, pid long, weight long, top long, total long, ext long, part int"
    local = stored(ranged.mapInArrow(_sum_arrow, schema), "sums")
    crossing = local.filter("ext is not null").select(F.col("id").alias("x"), "ext", F.col("total").alias("weight"))
    count = crossing.count() if parts > 1 else 0
    if not count:
        return local.select("id", "total")
    over = local.select(F.col("id").alias("ext"), F.col("top").alias("pid"))
    linked = crossing.join(over, "ext")
    tops = local.filter("ext is null and id = top").select("id", F.lit(None).cast("long").alias("pid"), F.col("total").alias("weight"))
    upper = stored(linked.select(F.col("x").alias("id"), "pid", "weight").unionByName(tops.join(linked.select(F.col("pid").alias("id")).distinct(), "id", "left_semi")), "upper")
    size = upper.count()
    fewer = 1 if size <= block_links else max(1, math.ceil(size / block_links), parts // FAN_IN)
    above = _subtree_sums(upper, size, fewer, block_links) if fewer < parts else _doubled_sums(upper, size)
    extra = crossing.select(F.col("x").alias("id"), "ext").join(above, "id").groupBy(F.col("ext").alias("id")).agg(F.sum("total").alias("_extra"))
    # The same blocks again: ranges are sampled, and would fall elsewhere a second time.
    again = local.join(extra, "id", "left").select("id", "pid", (F.col("weight") + F.coalesce("_extra", F.lit(0))).alias("weight"), "part")
    return again.repartitionById(parts, "part").drop("part").mapInArrow(_sum_arrow, schema).select("id", "total")


def descendant_counts(links: DataFrame, block_links: int = BLOCK_LINKS, placed: DataFrame | None = None) -> DataFrame:
    """id, descendants: the number of nodes below each node. Nodes without root don't appear."""
    placed = rooted(links, block_links) if placed is None else placed
    tree = links.join(placed.filter(F.col("root") != CYCLE).select("id"), "id", "left_semi").select("id", "pid", F.lit(1).cast("long").alias("weight"))
    tree = stored(tree, "tree")
    rows = tree.count()
    sums = _subtree_sums(tree, rows, blocks(links.sparkSession, rows, block_links), block_links)
    return sums.select("id", (F.col("total") - 1).alias("descendants"))


def _siblings_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of (pid, id): the sizes of each node's earlier siblings in the range; sum, of parents at the range's ends, all of theirs."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    t = pa.Table.from_batches(got)
    ids, pid, size = (t[c].to_numpy() for c in ("id", "pid", "size"))
    order = np.lexsort((ids, pid))
    ids, pid, size = ids[order], pid[order], size[order]
    n = len(ids)
    new = np.append(True, pid[1:] != pid[:-1])
    before = np.cumsum(size) - size
    before = before - before[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    ends = np.append(new[1:], True) & ((pid == pid[0]) | (pid == pid[-1]))
    out = pa.table({
        "id": ids, "pid": pid, "part": np.full(n, TaskContext.get().partitionId(), np.int64), "before": before, "sum": pa.array(before + size, mask=~ends),
    })
    yield from out.to_batches(max_chunksize=100_000)


def preorder(links: DataFrame, block_links: int = BLOCK_LINKS, placed: DataFrame | None = None) -> DataFrame:
    """id, root, position, descendants: every node's descendants as a range, one row a node.

    position counts a tree's nodes from 0 at the root, each before the nodes below it and siblings by id. The nodes
    below a node are those of its root with a position in (position, position + descendants]. A node stands 1 and
    the sizes of its earlier siblings behind its parent, so positions are depths over links of that length; siblings
    are summed by ranges of (pid, id), so no task holds more than a block of them. Nodes without root don't appear.
    """
    placed = rooted(links, block_links) if placed is None else placed
    sizes = stored(descendant_counts(links, block_links, placed), "sizes")
    sized = stored(links.select("id", "pid").join(sizes.select("id", (F.col("descendants") + 1).alias("size")), "id"), "sized")
    below = sized.filter("pid is not null")
    rows = below.count()
    parts = blocks(links.sparkSession, rows, block_links)
    ranged = below.repartitionByRange(parts, "pid", "id") if parts > 1 else below.coalesce(1)
    local = stored(ranged.mapInArrow(_siblings_arrow, "id long, pid long, part long, before long, sum long"), "siblings")
    # At most two rows a range.
    earlier = F.sum("sum").over(W.partitionBy("pid").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    carried = local.filter("sum is not null").select(F.col("pid").alias("_pid"), F.col("part").alias("_part"), earlier.alias("_c")).filter("_c is not null")
    behind = local.join(F.broadcast(carried), (F.col("pid") == F.col("_pid")) & (F.col("part") == F.col("_part")), "left")
    behind = behind.select("id", "pid", (F.col("before") + F.coalesce("_c", F.lit(0)) + 1).alias("w"))
    tops = sized.filter("pid is null").select("id", "pid", F.lit(0).cast("long").alias("w"))
    return rooted(behind.unionByName(tops), block_links, "w").withColumnRenamed("depth", "position").join(sizes, "id")


def descendants(order: DataFrame, asked: DataFrame, bucket: int = 64) -> DataFrame:
    """ancestor, id: every node below each asked node (asked: id), from a stored table of preorder().

    A node's descendants are a range of positions in its tree, so both sides meet in buckets of positions: no group holds
    more than `bucket` nodes and the asked ancestors above them, and beyond the two ends of a range every row of the
    join is a row of the result. Ids that are no node with a root, or have nothing below them, give nothing.
    """
    from_, to = F.col("position") + 1, F.col("position") + F.col("descendants")
    wide = bucket * 10_000  # exploded in two steps, so that no row holds a long array
    a = order.join(asked.select("id").filter("id is not null").distinct(), "id", "left_semi").filter("descendants > 0").select(F.col("id").alias("ancestor"), "root", from_.alias("lo"), to.alias("hi"))
    a = a.withColumn("w", F.explode(F.sequence(F.expr(f"lo div {wide}"), F.expr(f"hi div {wide}"))))
    a = a.withColumn("b", F.explode(F.sequence(F.greatest(F.expr(f"lo div {bucket}"), F.col("w") * 10_000), F.least(F.expr(f"hi div {bucket}"), F.col("w") * 10_000 + 9_999))))
    nodes = order.select("id", "root", "position", F.expr(f"position div {bucket}").alias("b"))
    return a.join(nodes, ["root", "b"]).filter("position between lo and hi").select("ancestor", "id")


def full_paths(links: DataFrame, asked: DataFrame, placed: DataFrame | None = None, step: int = STEP) -> DataFrame:
    """id, position, node: every asked node's whole path (asked: id), a row for each node from the root (position 0) down to itself.

    Paths are put together from indexed segments: the anchors of paths() are a forest of their own, `step` times
    less deep, whose paths are found the same way. log_step(depth) levels, each two joins and as many rows as the
    result. Rows instead of arrays, so a path of any length fits. Nodes without root give nothing.
    """
    placed = stored(rooted(links).select("id", "root", "depth"), "placed") if placed is None else placed
    segments = stored(paths(links, step, placed), "segments")
    here = stored(segments.join(asked.select("id").filter("id is not null").distinct(), "id", "left_semi").select("id", "anchor", F.col("id").alias("end")), "asked")
    ends = here.select("id", "end")
    anchors = here.filter("anchor is not null").select(F.col("anchor").alias("id"))
    if not anchors.isEmpty():
        upper = stored(segments.filter(f"depth % {step} = 0").select("id", F.col("anchor").alias("pid"), "root", F.expr(f"depth div {step}").alias("depth")), "anchors")
        above = full_paths(upper.select("id", "pid"), anchors, upper.select("id", "root", "depth"), step).select(F.col("id").alias("anchor"), F.col("node").alias("end"))
        ends = ends.unionByName(here.select("id", "anchor").join(above, "anchor").select("id", "end"))
    parts = ends.join(segments.select(F.col("id").alias("end"), "depth", "segment"), "end")
    return parts.select("id", F.col("depth"), "segment", F.posexplode("segment").alias("i", "node")).select("id", (F.col("depth") - F.size("segment") + 1 + F.col("i")).alias("position"), "node")
