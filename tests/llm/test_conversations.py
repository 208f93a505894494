"""Conversations against a brute-force reading of the statement, on dense random trees."""

import collections
import random

import duckdb
import pytest

from ledgerline.llm import conversations, queries

LINE = "raw_line_id long, line_class string, session_id string, line_type string, is_sidechain int, uuid string, parent_uuid string, is_meta int, message_text string"
REQ = "raw_line_id long, message_id string, request_id string"


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def brute(lines, requests):
    session = {r[0]: r[2] if r[2] is not None else "<missing>" for r in lines}
    bare = {(session.get(i, "<missing>"), q) for i, m, q in requests if m is None and q is not None}
    copies, own = Groups(), {}
    for i, m, q in requests:
        s = session.get(i, "<missing>")
        if m is not None:
            own[i] = ("m", s, m)
            if q is not None and (s, q) in bare:
                copies.join(own[i], ("r", s, q))
        elif q is not None:
            own[i] = ("r", s, q)
    nodes = collections.defaultdict(list)
    for r in lines:
        if r[2] is not None and r[5] is not None:
            nodes[r[2], r[5]].append(r)
    parent = {k: (k[0], p) for k, v in nodes.items() for p in {r[6] for r in v} if p is not None}

    def chain(k):
        seen = [k]
        while k in parent and parent[k] in nodes:
            k = parent[k]
            if k in seen:
                return None
            seen.append(k)
        return None if k in parent else seen

    trees = collections.defaultdict(list)
    for k in nodes:
        if c := chain(k):
            trees[c[-1]].append(k)
    ident = {k: min(r[0] for r in v) for k, v in nodes.items()}
    out = []
    for root, ks in trees.items():
        inside, speaking = Groups(), []
        user = {k: any(r[3] == "user" and r[7] == 0 for r in nodes[k]) for k in ks}
        for k in ks:
            asks = any(r[1] == "request" for r in nodes[k])
            if (asks or user[k]) and any(r[4] == 0 for r in nodes[k]):
                speaking.append(k)
                for r in nodes[k]:
                    if not user[k] and r[0] in own:
                        inside.join(k, copies.find(own[r[0]]))
        messages = collections.defaultdict(list)
        for k in speaking:
            messages[inside.find(k)].append(k)
        of = {k: min(ident[x] for x in g) for g in messages.values() if any((r[8] or "").strip(" \t\n\xa0​﻿") for k in g for r in nodes[k]) for k in g}
        before = {}
        for k, m in of.items():
            above = [(n, of[x]) for n, x in enumerate(chain(k)) if of.get(x, m) != m]
            before.setdefault(m, []).extend(above[:1])
        before = {m: min(b)[1] if b else None for m, b in before.items()}
        is_user = {m: user[k] for k, m in of.items()}
        after = {b: m for m, b in before.items()}
        line = [after[None]] if None in after else []
        while line and line[-1] in after and len(line) <= len(before):
            line.append(after[line[-1]])
        turns = [is_user[m] for m in line]
        if line and len(line) == len(before) == len(after) and turns[0] and all(not (a and b) for a, b in zip(turns, [*turns[1:], True], strict=True)):
            out += [(ident[root], n, m, "user" if is_user[m] else "assistant") for n, m in enumerate(line)]
    return sorted(out)


def instance(seed, sessions=600):
    r = random.Random(seed)
    lines, requests = [], []
    for s in range(sessions):
        name = r.choice([f"s{s}"] * 20 + [None, "<missing>"])
        size, kinds = r.randint(1, 12), r.choice(["ua", "ua", "uax", "uaxms"])
        for i in range(size):
            up = r.choice([i - 1] * 8 + [i - 2, r.randrange(size)])
            key, above = f"{s}-{i}", f"{s}-{up}" if up >= 0 else r.choice([None] * 6 + ["gone"])
            kind = kinds[i % 2] if r.random() < 0.8 else r.choice(kinds + "a")
            for _ in range(r.choice([1, 1, 1, 2, 3])):
                n = r.getrandbits(40)
                lines.append((
                    n, "request" if kind == "a" else "ignored_type", name, {"a": "assistant", "x": "system"}.get(kind, "user"), r.choice([int(kind == "s")] * 9 + [1, None]),
                    r.choice([key] * 15 + [None]), r.choice([above] * 5 + [None]), r.choice([int(kind == "m")] * 12 + [None]), r.choice(["text"] * 9 + [None, "", " ﻿​\n\xa0"]),
                ))
                if kind == "a":
                    pool = r.choice([i, i, i, i - 1, r.randrange(size)])
                    requests.append((n, r.choice([f"m{pool}"] * 5 + [None]), r.choice([f"q{pool}"] * 3 + [f"q{r.randrange(size)}", None])))
    r.shuffle(lines)
    return lines, requests


@pytest.mark.parametrize("seed", range(2))
def test_conversations_against_brute_force(spark, seed, tmp_path):
    lines, requests = instance(seed)
    want = brute(lines, requests)
    assert len(want) > 100
    p, q = spark.createDataFrame(lines, LINE), spark.createDataFrame(requests, REQ)
    out = conversations.conversations(p.repartition(3), q).select("root_line_id", "message_position", "raw_line_id", "speaker")
    assert sorted(map(tuple, out.collect())) == want
    db = duckdb.connect()
    for name, df in (("parsed_lines", p), ("requests", q)):
        df.write.parquet(str(tmp_path / name))
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    assert sorted(db.execute(queries.SQL["p4_conversations"]).fetchall()) == want


def test_chains_and_circles_are_climbed(spark):
    chains = [(i, i - 1 if i else None, 1 if i else 0, "end" if not i else None) for i in range(100)] + [(200, 201, 1, None), (201, 202, 1, None), (202, 201, 1, None)]
    ended, circling = conversations.climb(spark.createDataFrame(chains, "node long, to long, hops long, e string").withColumnRenamed("e", "end"), "end")
    assert sorted((r.node, r.hops, r.end) for r in ended.collect()) == [(i, i, "end") for i in range(100)]
    assert sorted(r.node for r in circling.collect()) == [200, 201, 202]
    assert conversations.climb(spark.createDataFrame([], "node long, to long, hops long"))[0].collect() == []
