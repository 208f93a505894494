import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import forest
from ledgerline.operators.components import components
from ledgerline.runtime import stored


def brute(links):
    up, out = dict(links), {}
    for x in up:
        seen, at, d = {x}, x, 0
        while up[at] is not None:
            at, d = up[at], d + 1
            if at in seen:
                at, d = -1, -1
                break
            seen.add(at)
        out[x] = (at, d)
    return out


def random_links(n, seed, local):
    r = random.Random(seed)
    ids = r.sample(range(10 * n), n)
    order = sorted(ids) if local else ids
    links = {}
    for i, x in enumerate(order):
        links[x] = None if i == 0 or r.random() < 0.05 else order[i - 1] if r.random() < 0.7 else order[r.randrange(i)]
    for _ in range(3):  # cycles, one of a single node
        a = r.sample(ids, 4)
        for x, y in zip(a, a[1:] + a[:1], strict=True):
            links[x] = y
    links[ids[0]] = ids[0]
    return list(links.items())


@pytest.mark.parametrize(("seed", "local", "block"), [(1, True, 10_000), (2, True, 40), (3, False, 40), (4, False, 7)])
def test_rooted_against_brute_force(spark, seed, local, block):
    links = random_links(600, seed, local)
    df = spark.createDataFrame(links, "id long, pid long")
    got = {r.id: (r.root, r.depth) for r in forest.rooted(df, block).collect()}
    assert got == brute(links)


def test_deep_chain_over_many_blocks(spark):
    n = 3000
    df = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("pid"))
    got = forest.rooted(df, 100).agg(F.max("depth"), F.min("root"), F.max("root"), F.count("*")).first()
    assert tuple(got) == (n - 1, 0, 0, n)


def test_rooted_empty(spark):
    assert forest.rooted(spark.createDataFrame([], "id long, pid long")).collect() == []


def test_nodes_merge_copies_and_find_parents(spark):
    rows = [
        (5, "s", "a", None), (3, "s", "a", None), (7, "s", "b", "a"), (6, "s", "b", None), (8, "s", "c", "gone"), (9, "t", "d", "a"), (10, None, "x", "a"), (11, "s", None, "a"),
        (12, "s", "e", "a"), (13, "s", "e", "b"), (None, "s", "f", "a"),
    ]
    df = spark.createDataFrame(rows, "raw_line_id long, session_id string, uuid string, parent_uuid string").withColumns({"h1": F.lit("clash"), "id": F.lit("clash")})
    nodes = forest.nodes_of(df, "raw_line_id", ["session_id"], "uuid", "parent_uuid")
    got = {r.id: (r.pid, r.orphan) for r in forest.links_of(nodes).collect()}
    # e names two parents: its parent counts as unknown
    assert got == {3: (None, False), 6: (3, False), 8: (None, True), 9: (None, True), 12: (None, True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        group[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = {row.node: row.component for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_paths_and_descendants(spark):
    links = random_links(300, 9, True)
    up, want = dict(links), brute(links)
    df = spark.createDataFrame(links, "id long, pid long")
    paths = {r.id: (r.anchor, list(r.segment)) for r in forest.paths(df, 8).collect()}
    good = {x for x in up if want[x][0] != -1}
    assert set(paths) == good

    def whole(x):
        anchor, segment = paths[x]
        return ([] if anchor is None else whole(anchor)) + segment

    sizes = {r.id: r.descendants for r in forest.descendant_counts(df, 50).collect()}
    below = dict.fromkeys(good, 0)
    for x in good:
        p = [x]
        while up[p[-1]] is not None:
            p.append(up[p[-1]])
            below[p[-1]] += 1
        assert whole(x) == p[::-1] and len(paths[x][1]) <= 8
    assert sizes == below
    some = sorted(good)[:5]
    asked = spark.createDataFrame([(x,) for x in [*some, some[0], None, -5]], "id long").withColumn("root", F.lit(3))
    order = stored(forest.preorder(df), "preorder")
    for bucket in (1, 8):
        got = [(r.ancestor, r.id) for r in forest.descendants(order, asked, bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, x) for x in good for a in whole(x)[:-1] if a in some}
    got = sorted((r.id, r.position, r.node) for r in forest.full_paths(df, asked, step=4).collect())
    assert got == sorted((x, n, a) for x in some if x in good for n, a in enumerate(whole(x)))
    assert forest.full_paths(df, asked.limit(0)).collect() == forest.descendants(order.limit(0), asked).collect() == []


@pytest.mark.parametrize("block", [10_000, 40])
def test_preorder_gives_every_descendant(spark, block):
    links = random_links(300, 9, True)
    up, want = dict(links), brute(links)
    rows = forest.preorder(spark.createDataFrame(links, "id long, pid long"), block).collect()
    at = {(r.root, r.position): r.id for r in rows}
    assert {r.id: r.root for r in rows} == {x: root for x, (root, _) in want.items() if root != -1} and len(at) == len(rows)
    got = {(r.id, at[r.root, p]) for r in rows for p in range(r.position + 1, r.position + r.descendants + 1)}
    pairs = set()
    for r in rows:
        x = r.id
        while (x := up[x]) is not None:
            pairs.add((x, r.id))
    assert got == pairs
    for a, b in zip(ordered := sorted(rows, key=lambda r: (up[r.id] or 0, r.id)), ordered[1:]):  # siblings stand by id
        assert up[a.id] is None or up[a.id] != up[b.id] or a.position < b.position


def test_preorder_empty(spark):
    assert forest.preorder(spark.createDataFrame([], "id long, pid long")).collect() == []


@pytest.mark.parametrize(("seed", "block"), [(3, 40), (4, 7)])
def test_descendants_where_ids_have_no_locality(spark, seed, block):
    links = random_links(300, seed, False)
    top = max(x for x, _ in links) + 1  # a parent whose children fill many blocks
    links += [(top, None), *((top + i, top) for i in range(1, 150)), (top + 150, top + 7)]
    up, want = dict(links), brute(links)
    below = {x: set() for x in up if want[x][0] != -1}
    for x in below:
        y = x
        while (y := up[y]) is not None:
            below[y].add(x)
    df = spark.createDataFrame(links, "id long, pid long")
    assert {r.id: r.descendants for r in forest.descendant_counts(df, block).collect()} == {x: len(s) for x, s in below.items()}
    rows = forest.preorder(df, block).collect()
    at = {(r.root, r.position): r.id for r in rows}
    assert {r.id: {at[r.root, p] for p in range(r.position + 1, r.position + r.descendants + 1)} for r in rows} == below


def test_descendants_of_a_scattered_chain(spark):
    n = 1000
    df = spark.range(n).select((F.col("id") * 387 % n).alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1) * 387 % n).alias("pid"))
    got = {r.id: r.descendants for r in forest.descendant_counts(df, 100).collect()}
    assert got == {i * 387 % n: n - 1 - i for i in range(n)}


def test_descendants_over_blocks_cut_from_samples(spark):
    n = 60_000
    df = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("pid"))
    wrong = forest.descendant_counts(df, 10_000).filter(F.col("descendants") != n - 1 - F.col("id"))
    assert wrong.count() == 0
