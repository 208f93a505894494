"""Rebuilding conversations from message rows.

Everything is resolved by iterative pointer-jumping joins (`climb`): each round one join replaces a pointer by its
target's, so a chain of n links takes log2(n) rounds, and only unresolved rows go on. Three climbs do the work:
from every node to its root, which tells orphans and cycles apart; from runs of mere links to the message above
them; and from every message to the first of its conversation, whose length is its position. Messages of a tree
form a conversation if they make one line; that is decided from counts per tree, so no conversation is ever
gathered in one task however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import copies, forest
from ..operators.components import components
from ..runtime import blocks, checked_broadcast, drop, stored, stored_together

#: Something besides white space, no-break spaces, zero-width spaces and byte order marks.
SHOWS = r"(?U)[^\s\x{A0}\x{200B}\x{FEFF}]"


def climb(pointers: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """Every chain followed to its end: (node, to, hops, `carried`) of those that end, and the same of those on or below a circle.

    A row is settled when `to` is null; else `to` is a node of the same table, `hops` away (nodes are unique). A row
    takes over what the settled row it arrives at carries, and adds up hops. Among chains that end, the rows nearest
    to settled ones settle in every round, so once none does only circles are left.
    """
    now = stored(pointers.select("node", "to", "hops", *carried), "pointers")
    tables, left = [now], now.filter("to is not null").count()
    while left:
        active = now.filter("to is not null")
        ahead = _settled(tables[:-1], now).select(*(F.col(c).alias("_" + c) for c in now.columns))
        moved = checked_broadcast(active, left, 64, 4 << 20).join(ahead, F.col("to") == F.col("_node")).select(
            "node", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), *(F.col("_" + c).alias(c) for c in carried)
        )
        now, before = stored(moved.repartition(blocks(now.sparkSession, left)), "pointers"), left
        tables.append(now)
        left = now.filter("to is not null").count()
        if left == before:
            break
    ended, circling = stored(_settled(tables[:-1], now).filter("to is null"), "ended"), stored(now.filter("to is not null"), "circling")
    drop(*tables)
    return ended, circling


def _settled(earlier: list[DataFrame], now: DataFrame) -> DataFrame:
    """The rows settled in earlier rounds, by one scan, and all of the last one."""
    return now.unionByName(stored_together(earlier).filter("to is null")) if earlier else now


def copy_labels(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """raw_line_id, copy_group of each row of requests with an identifier: equal for copies by p2, whichever rows link them."""
    asked = lines.filter("line_class = 'request'").select("raw_line_id", "session_id")
    r = requests.select("raw_line_id", "message_id", "request_id").filter("message_id is not null or request_id is not null").join(asked, "raw_line_id", "left")
    by = lambda c: copies.key124(F.coalesce("session_id", F.lit("<missing>")), F.col(c))
    r = stored(r.select("raw_line_id", by("message_id").alias("primary"), by("request_id").alias("secondary")), "request-ids")
    triples = r.select(F.lit(0).alias("scope"), "primary", "secondary").distinct()
    by_secondary, by_primary = copies.identifier_labels(stored(triples, "identifiers"))
    named = r.filter("primary is not null").select("raw_line_id", F.col("primary").alias("copy_group"))
    if by_primary is not None:
        named = named.join(by_primary.select(F.col("primary").alias("copy_group"), "label"), "copy_group", "left").select("raw_line_id", F.coalesce("label", "copy_group").alias("copy_group"))
    bare = r.filter("primary is null").join(by_secondary.select("secondary", "label"), "secondary", "left")
    return stored(named.unionByName(bare.select("raw_line_id", F.coalesce("label", "secondary").alias("copy_group"))), "copy-groups")


def message_nodes(lines: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One stored row per node: its parent's key, what its rows say, and copy_group, the smallest of its request rows.

    The second table has id, copy_group and other of the nodes whose rows belong to further groups of copies.
    """
    rows = lines.filter("session_id is not null and uuid is not null").select(
        "raw_line_id", "session_id", "uuid", "parent_uuid", "line_class", "line_type", "is_sidechain", "is_meta", F.col("message_text").rlike(SHOWS).alias("shows")
    )
    is_request = F.col("line_class") == "request"
    labels = copy_labels(lines, requests)
    asks, other = rows.filter(is_request).join(labels, "raw_line_id", "left"), rows.filter(~is_request | is_request.isNull())
    rows = asks.unionByName(other.withColumn("copy_group", F.lit(None).cast("decimal(38,0)")))
    any_ = lambda c: F.coalesce(F.max(F.when(c, True)), F.lit(False))
    nodes = stored(
        forest.nodes_of(
            rows, "raw_line_id", ["session_id"], "uuid", "parent_uuid",
            any_((F.col("line_type") == "user") & (F.col("is_meta") == 0)).alias("is_user"), any_(is_request).alias("is_request"),
            any_(F.col("is_sidechain") == 0).alias("is_main"), any_(F.col("shows")).alias("shows"),
            F.min("copy_group").alias("copy_group"), F.max("copy_group").alias("last_group"),
        ),
        "nodes",
    )
    h = forest.key128([F.col("session_id")], F.col("uuid"))
    many = nodes.filter("copy_group <> last_group").select("h1", "h2", "id", "copy_group")
    further = asks.select(h[0].alias("h1"), h[1].alias("h2"), F.col("copy_group").alias("other")).join(many, ["h1", "h2"]).filter("other <> copy_group")
    further = further.select("id", "copy_group", "other").distinct()
    return nodes.drop("last_group"), further if not many.isEmpty() else further.limit(0)


def _joined_groups(talk: DataFrame, further: DataFrame) -> DataFrame:
    """talk with one copy_group for all groups that a speaking node of the same tree joins."""
    edges = stored(further.join(talk.filter("copy_group is not null").select("id", "root"), "id").select(
        F.struct("root", F.col("copy_group").alias("g")).alias("a"), F.struct("root", F.col("other").alias("g")).alias("b")
    ).distinct(), "group-links")
    if edges.isEmpty():
        return talk
    joined = components(edges).select(F.col("node.root").alias("root"), F.col("node.g").alias("copy_group"), F.col("component.g").alias("_g"))
    return talk.join(joined, ["root", "copy_group"], "left").withColumn("copy_group", F.coalesce("_g", "copy_group")).drop("_g")


def conversations(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """root_line_id, message_position, raw_line_id, speaker of each message of each whole conversation.

    Rows without session or uuid are no nodes. Trees whose root names an unknown parent, nodes on or below
    cycles, and trees without messages, with forks, with a first message that isn't a user's or a user message
    without direct reply give nothing. Nulls in is_meta or is_sidechain count as not 0. Empty tables give no rows.
    """
    nodes, further = message_nodes(lines, requests)
    one, zero, null = F.lit(1).cast("long"), F.lit(0).cast("long"), lambda t: F.lit(None).cast(t)
    links = stored(forest.links_of(nodes, "is_user", "is_request", "is_main", "shows", "copy_group"), "links")
    top = lambda c: F.when(F.col("pid").isNull(), c)
    rooted, _ = climb(links.select(F.col("id").alias("node"), F.col("pid").alias("to"), one.alias("hops"), top(F.col("id")).alias("root"), top(~F.col("orphan")).alias("whole")), "root", "whole")
    placed = links.join(rooted.filter("whole").select(F.col("node").alias("id"), "root"), "id")
    speaks = F.col("is_main") & (F.col("is_user") | F.col("is_request"))
    placed = stored(placed.select("id", "pid", "root", "is_user", speaks.alias("speaks"), "shows", F.when(~F.col("is_user"), F.col("copy_group")).alias("copy_group")), "placed")

    # Messages: request nodes that share copies in one tree are one, every other speaking node is its own.
    talk = _joined_groups(placed.filter("speaks"), further)
    alone = talk.filter("copy_group is null and shows").select("id", F.col("id").alias("message"))
    merged = stored(talk.filter("copy_group is not null").groupBy("root", "copy_group").agg(F.min("id").alias("message"), F.max("shows").alias("shows")).filter("shows").drop("shows"), "merged")
    together = talk.filter("copy_group is not null").join(merged, ["root", "copy_group"]).select("id", "message")
    marked = alone.unionByName(together)
    nodes_ = stored(placed.select("id", "pid", "root", "is_user").join(marked, "id", "left"), "marked")

    # Every node's parent, and whether that is part of a message.
    up = nodes_.select(F.col("id").alias("pid"), F.col("message").alias("end"), F.col("is_user").alias("end_user"))
    below = stored(nodes_.filter("pid is not null").join(up, "pid", "left"), "parents")
    tops = nodes_.filter("pid is null")
    mere = below.filter("message is null").select(F.col("id").alias("node"), F.when(F.col("end").isNull(), F.col("pid")).alias("to"), one.alias("hops"), "end", F.when(F.col("end").isNotNull(), F.col("end_user")).alias("end_user"))
    roots = tops.filter("message is null").select(F.col("id").alias("node"), null("long").alias("to"), one.alias("hops"), null("long").alias("end"), null("boolean").alias("end_user"))
    ends = climb(mere.unionByName(roots), "end", "end_user")[0].select(F.col("node").alias("pid"), (F.col("hops") + 1).alias("hops"), "end", "end_user")

    # Each message follows the nearest other message above any of its nodes.
    own = F.struct("message", "root", "is_user").alias("m")
    said = below.filter("message is not null")
    near = said.filter("end is not null").select(own, one.alias("hops"), "end", "end_user").unionByName(
        said.filter("end is null").join(ends, "pid", "left").select(own, ends["hops"], ends["end"], ends["end_user"])
    ).unionByName(tops.filter("message is not null").select(own, null("long").alias("hops"), null("long").alias("end"), null("boolean").alias("end_user")))
    other = F.col("end").isNotNull() & (F.col("end") != F.col("m.message"))
    before = F.min(F.when(other, F.struct("hops", "end", "end_user")))
    messages = near.groupBy("m").agg(before.alias("b")).select("m.message", "m.root", "m.is_user", F.col("b.end").alias("before"), F.col("b.end_user").alias("before_user"))
    messages = stored(messages, "messages")

    # One line: a single first message, no two followers of one, every user message answered, first a user's.
    per = messages.groupBy("root", "before").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("is_user"), 1)).alias("users"), F.count(F.when(F.col("before_user") & ~F.col("is_user"), 1)).alias("answers"),
    )
    per_root = per.groupBy("root").agg(
        F.max("n").alias("most"), F.sum("users").alias("users"), F.sum("answers").alias("answers"),
        F.sum(F.when(F.col("before").isNull(), F.col("n")).otherwise(0)).alias("firsts"), F.sum(F.when(F.col("before").isNull(), F.col("users")).otherwise(0)).alias("user_firsts"),
    )
    good = per_root.filter("most = 1 and firsts = 1 and user_firsts = 1 and users = answers").select("root")
    kept = stored(messages.join(good, "root", "left_semi"), "kept")
    steps = kept.select(F.col("message").alias("node"), F.col("before").alias("to"), F.when(F.col("before").isNull(), zero).otherwise(one).alias("hops"))
    place, circling = climb(steps)
    circles = kept.join(circling.select(F.col("node").alias("message")), "message", "left_semi").select("root").distinct()
    whole = kept.join(circles, "root", "left_anti").join(place.select(F.col("node").alias("message"), "hops"), "message")
    return whole.select(
        F.col("root").alias("root_line_id"), F.col("hops").alias("message_position"), F.col("message").alias("raw_line_id"), F.when(F.col("is_user"), "user").otherwise("assistant").alias("speaker")
    )
