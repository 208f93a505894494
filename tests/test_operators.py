import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import asof, copies, intervals, lineage, recursive, runs


def sides(seed):
    r = random.Random(seed)
    row = lambda i: (i, r.choice(["a", "b", "c", None]), r.choice([None, *range(30)]))
    return [row(i) for i in range(200)], [row(1000 + i) for i in range(200)]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("bucket", [7, 1000])
def test_asof_against_brute_force(spark, strict, forward, bucket):
    left, right = sides(7)
    l = spark.createDataFrame(left, "id long, k string, t long")
    r = spark.createDataFrame(right, "rid long, k string, t long")
    join = asof.asof_forward if forward else asof.asof_backward
    got = {x.id: (x.r_rid, x.r_t) for x in join(l, r, ["k"], F.col("t"), F.col("t"), F.col("rid"), ["rid", "t"], strict=strict, prefix="r_", bucket=bucket).collect()}
    for i, k, t in left:
        fits = [(rt, rid) for rid, rk, rt in right if None not in (k, t, rt) and rk == k and ((rt > t if strict else rt >= t) if forward else (rt < t if strict else rt <= t))]
        want = (min(fits) if forward else max(fits)) if fits else (None, None)
        assert got[i] == (want[1], want[0])
    assert len(got) == len(left)


def test_asof_empty_sides(spark):
    l = spark.createDataFrame([(1, "a", 5)], "id long, k string, t long")
    none = spark.createDataFrame([], "rid long, k string, t long")
    args = (["k"], F.col("t"), F.col("t"), F.col("rid"), ["rid"])
    assert [tuple(r) for r in asof.asof_backward(l, none, *args).collect()] == [(1, "a", 5, None)]
    assert asof.asof_backward(l.limit(0), none, *args).collect() == []


def test_merge_intervals_against_brute_force(spark):
    r = random.Random(3)
    spans = [(i, s := r.randrange(3000), s + r.randrange(-2, 25)) for i in range(200)] + [(900, None, 5), (901, 5, None)]
    df = spark.createDataFrame(spans, "id long, s long, e long")
    got = {x.id: x.interval_number for x in intervals.merge_intervals(df, "s", "e", "id", bucket=F.floor(F.col("s") / 50)).collect()}
    want, number, end = {}, 0, None
    for s, e, i in sorted((s, e, i) for i, s, e in spans if None not in (s, e)):
        if end is None or s > end:
            number, end = number + 1, None
        end = max(x for x in (end, s, e) if x is not None)
        want[i] = number
    assert got == want


def test_prefix_max_by_key(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["x", "y", None]), r.randrange(100), r.choice([None, r.random()])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v double")
    got = {x.id: x.m for x in intervals.prefix_max(df, ["k"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")], F.col("v"), "m").collect()}
    for i, k, t, _ in rows:
        before = [v for j, kk, tt, v in rows if kk == k and (tt, j) < (t, i) and v is not None]
        assert got[i] == (max(before) if before else None)


def test_containment_and_range_count(spark):
    r = random.Random(4)
    points = [(i, r.randrange(500), r.choice(["a", "b", None])) for i in range(100)]
    spans = [(i, s := r.randrange(500), s + r.randrange(1, 90), r.choice("ab")) for i in range(40)]
    p, s = spark.createDataFrame(points, "id long, at long, w string"), spark.createDataFrame(spans, "sid long, lo long, hi long, sw string")
    got = {(x.id, x.sid) for x in intervals.contained_in(p, s, F.col("at"), F.col("lo"), F.col("hi"), 30, equal=[("w", "sw")]).collect()}
    assert got == {(i, j) for i, a, w in points for j, lo, hi, sw in spans if lo < a <= hi and w in (None, sw)}
    want = {j: len({w for _, a, w in points if w is not None and lo <= a < hi}) for j, lo, hi, _ in spans}
    for block in (500_000, 15):  # all facts in every task, or in blocks
        n = {x.sid: x.n for x in intervals.range_count_distinct(s, p, "sid", F.col("lo"), F.col("hi"), F.col("at"), "w", 30, "n", block).collect()}
        assert n == {j: c for j, c in want.items() if c}
    assert intervals.range_count_distinct(s, p.limit(0), "sid", F.col("lo"), F.col("hi"), F.col("at"), "w", 30, "n").collect() == []


def test_points_below_bounds():
    g = np.random.default_rng(4)
    for n in (0, 1, 7, 300):
        x, y = g.integers(-50, 50, n), g.integers(-50, 50, n)
        hi, lo = g.integers(-60, 60, 200), g.integers(-60, 60, 200)
        assert intervals.Below(x, y).count(hi, lo).tolist() == [int(((x < a) & (y < b)).sum()) for a, b in zip(hi, lo, strict=True)]


def test_runs_and_pairs(spark):
    rows = [("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("u", 4, "a"), ("v", 1, None), ("v", 2, None), ("v", 3, "a")]
    df = spark.createDataFrame(rows, "k string, t long, v string")
    for bucket in (None, F.floor(F.col("t") / 2)):
        got = {(x.k, x.t): x.run for x in runs.run_ids(df, ["k"], [F.col("t")], ~F.col("_previous.v").eqNullSafe(F.col("v")), bucket=bucket).collect()}
        assert got == {("u", 1): 1, ("u", 2): 1, ("u", 3): 2, ("u", 4): 3, ("v", 1): 1, ("v", 2): 1, ("v", 3): 2}
        assert {(x.k, x.t, x.before) for x in runs.consecutive(df, ["k"], [F.col("t")], {"v": "before"}, bucket).collect()} == {("u", 2, "a"), ("u", 3, "a"), ("u", 4, "b"), ("v", 2, None), ("v", 3, None)}


def test_walk_stops(spark):
    steps = spark.createDataFrame([(1, None, True), (2, 1, True), (3, 2, False), (4, 3, True), (5, 6, True), (6, 5, True)], "node long, up long, passes boolean")
    starts = spark.createDataFrame([(10, 2), (11, 4), (12, None), (13, 5)], "start long, at long")
    got = {r.start: (r.stop, r.passed) for r in recursive.walk(starts, steps, 7).collect()}
    assert got == {10: (None, 2), 11: (3, 1), 12: (None, 0), 13: (6, 7)}  # the circle ends at the limit


def brute_copies(rows):
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            same_m = a[2] is not None and a[2] == b[2]
            bare = a[2] is None and a[3] is not None and a[3] == b[3]
            if a[1] == b[1] and (same_m or bare):
                group[find(i)] = find(j)
    best = {}
    for i, a in enumerate(rows):
        if a[2] is None and a[3] is None:
            continue
        g = find(i)
        if g not in best or (a[4], a[0]) > (best[g][4], best[g][0]):
            best[g] = a
    kept = {a[0] for a in best.values()}
    return {a[0] for a in rows if (a[2] or a[3]) and a[0] not in kept}


@pytest.mark.parametrize("wide", [0, 1, 2])
def test_dropped_copies_against_brute_force(spark, wide, capsys):
    """wide: whether order and id fit into one packed number, or the order alone, or neither."""
    r = random.Random(wide)
    far = r.sample([0, 1, -(1 << 62), 1 << 62], 4) if wide else range(4)
    rows = [(i, r.choice("st"), r.choice([None, *(f"m{k}" for k in range(25))]), r.choice([None, *(f"q{k}" for k in range(25))]), r.choice(far)) for i in r.sample(range(1 << 62), 120)]
    df = spark.createDataFrame([*rows, (None, "s", "m1", None, 9)], "raw_line_id long, session_id string, message_id string, request_id string, o long").withColumns({"scope": F.lit(1), "primary": F.lit("clash"), "best": F.lit(2)})
    order = [[F.col("o")], [F.col("o"), F.when(F.col("o") > 5, 1 << 30).otherwise(0)], [F.col("o")] * 3][wide]
    ask = lambda d: copies.dropped_copies(d, "raw_line_id", F.col("session_id"), "message_id", "request_id", order)
    assert {x.raw_line_id for x in ask(df).collect()} == brute_copies(rows)
    assert ask(df.limit(0)).collect() == []
    if not wide:
        packed = copies._packed(df.select("o", "raw_line_id").filter("raw_line_id is not null"), ["o", "raw_line_id"])
        df.groupBy("message_id").agg(F.max(packed[0])).explain()
        assert "SortAggregate" not in capsys.readouterr().out
