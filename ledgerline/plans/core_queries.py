"""Queries p1 to p3: drifting schemas, repeated deliveries, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import copies, drift, forest
from ..runtime import stored
from .drift_sql import P1_COLUMNS_SQL, P1_FOUND_SQL

MISSING = "<missing>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_lines").filter("kind = 'log'")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a batch's fields against the contract."""
    contract = drift.Contract.of(table(spark, d, "line_fields"))
    return drift.drift_report(log_lines(spark, d), contract)


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """All log lines as one table with the contract's fields, and the values that did not fit."""
    contract = drift.Contract.of(table(spark, d, "line_fields"))
    mapped = stored(drift.path_maps(log_lines(spark, d), contract), "mapped")
    changed = drift.changes(stored(drift.mapped_stats(mapped, contract), "paths"), contract)
    return drift.unified(mapped, stored(changed, "changes"), contract)


def p1_columns(spark: SparkSession, d: str) -> DataFrame:
    """Per field of the unified table: lines that fill it, and values that did not fit."""
    contract = drift.Contract.of(table(spark, d, "line_fields"))
    t = stored(p1_unified(spark, d), "unified")
    paths = sorted(contract.paths())
    filled = t.agg(*(F.count(drift.column_name(p)).alias(drift.column_name(p)) for p in paths)).select(F.explode(F.array(*(F.struct(F.lit(p).alias("field_path"), F.col(drift.column_name(p)).alias("filled")) for p in paths))).alias("x")).select("x.*")
    failed = t.select(F.explode("failed_casts").alias("x")).groupBy("x.path").agg(F.count("*").alias("failed"))
    return filled.join(failed, filled["field_path"] == failed["path"], "left").select("field_path", "filled", F.coalesce("failed", F.lit(0)).alias("failed"))


def request_rows(spark: SparkSession, d: str) -> DataFrame:
    """requests with what their lines say: session, sidechain, time, run and line number."""
    lines = table(spark, d, "parsed_lines").filter("line_class = 'request'").select("raw_line_id", "session_id", "is_sidechain", "timestamp_utc", "first_run_id")
    numbers = table(spark, d, "raw_lines").filter("kind = 'log'").select("raw_line_id", "line_number")
    requests = table(spark, d, "requests").select("raw_line_id", "message_id", "request_id", "output_tokens")
    return requests.join(lines, "raw_line_id", "left").join(numbers, "raw_line_id", "left").withColumn("session_id", F.coalesce("session_id", F.lit(MISSING)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of requests that are later deliveries of a response that another row keeps."""
    order = [
        F.col("output_tokens").isNotNull().cast("int"), F.coalesce("output_tokens", F.lit(0)), -F.coalesce("is_sidechain", F.lit(0)), F.col("timestamp_utc").isNotNull().cast("int"),
        F.coalesce(-F.unix_micros(F.col("timestamp_utc").cast("timestamp")), F.lit(0)), F.coalesce("first_run_id", F.lit(-1)), F.coalesce("line_number", F.lit(-1)),
    ]
    return copies.dropped_copies(request_rows(spark, d), "raw_line_id", F.col("session_id"), "message_id", "request_id", order)


P2_FOUND_SQL = """
WITH RECURSIVE rows AS (
  SELECT r.raw_line_id, coalesce(p.session_id, '<missing>') AS s, r.message_id AS m, r.request_id AS q, r.output_tokens AS o,
         p.is_sidechain AS side, p.timestamp_utc AS t, p.first_run_id AS run, w.line_number AS n
  FROM requests r LEFT JOIN parsed_lines p USING (raw_line_id) LEFT JOIN raw_lines w USING (raw_line_id)
  WHERE r.message_id IS NOT NULL OR r.request_id IS NOT NULL),
keyed AS (SELECT *, coalesce('m/' || m, 'r/' || q) AS k FROM rows),
bare AS (SELECT DISTINCT s, q FROM rows WHERE m IS NULL),
edge AS (SELECT DISTINCT a.s, a.k AS x, 'r/' || a.q AS y FROM keyed a JOIN bare b ON a.s = b.s AND a.q = b.q),
pair AS (SELECT s, x, y FROM edge UNION SELECT s, y, x FROM edge UNION SELECT s, x, x FROM edge),
reach(s, x, y) AS (SELECT s, x, y FROM pair UNION SELECT r.s, r.x, b.y FROM reach r JOIN pair b ON b.s = r.s AND b.x = r.y),
label AS (SELECT s, x, min(y) AS l FROM reach GROUP BY s, x),
ranked AS (
  SELECT raw_line_id, row_number() OVER (
    PARTITION BY k.s, coalesce(l.l, k.k)
    ORDER BY o DESC NULLS LAST, coalesce(side, 0) ASC, t ASC NULLS LAST, run DESC NULLS LAST, n DESC NULLS LAST, raw_line_id DESC) AS rank
  FROM keyed k LEFT JOIN label l ON l.s = k.s AND l.x = k.k)
SELECT raw_line_id FROM ranked WHERE rank > 1
"""


def parsed_nodes(spark: SparkSession, d: str, *extra) -> DataFrame:
    return forest.nodes_of(table(spark, d, "parsed_lines"), "raw_line_id", ["session_id"], "uuid", "parent_uuid", *extra)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every node of the conversation trees; -1 on and below cycles."""
    nodes = stored(parsed_nodes(spark, d), "nodes")
    return forest.rooted(forest.links_of(nodes)).select(F.col("id").alias("raw_line_id"), F.col("root").alias("root_line_id"), "depth")


P3_FOUND_SQL = """
WITH RECURSIVE node AS (
  SELECT session_id AS s, uuid AS u, min(raw_line_id) AS id, min(parent_uuid) AS p
  FROM parsed_lines WHERE session_id IS NOT NULL AND uuid IS NOT NULL GROUP BY 1, 2),
link AS (SELECT c.id, n.id AS up FROM node c LEFT JOIN node n ON n.s = c.s AND n.u = c.p),
walk(id, root, depth) AS (
  SELECT id, id, 0 FROM link WHERE up IS NULL
  UNION ALL SELECT l.id, w.root, w.depth + 1 FROM walk w JOIN link l ON l.up = w.id)
SELECT l.id AS raw_line_id, coalesce(w.root, -1) AS root_line_id, CAST(coalesce(w.depth, -1) AS BIGINT) AS depth
FROM link l LEFT JOIN walk w ON w.id = l.id
"""

def _placed_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    links = stored(forest.links_of(stored(parsed_nodes(spark, d), "nodes")).select("id", "pid"), "tree-links")
    return links, stored(forest.rooted(links), "placed")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each node's path in steps of 32: the anchor's path, then the segment down to the node."""
    links, placed = _placed_links(spark, d)
    segment = F.array_join(F.transform("segment", lambda x: x.cast("string")), "/")
    return forest.paths(links, placed=placed).select(F.col("id").alias("raw_line_id"), F.col("root").alias("root_line_id"), "depth", F.col("anchor").alias("anchor_line_id"), segment.alias("segment"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes lie below each node."""
    links, placed = _placed_links(spark, d)
    return forest.descendant_counts(links, placed=placed).select(F.col("id").alias("raw_line_id"), "descendants")


def p3_preorder(spark: SparkSession, d: str) -> DataFrame:
    """Which nodes lie below each node: those of its root with a position in (position, position + descendants]."""
    links, placed = _placed_links(spark, d)
    return forest.preorder(links, placed=placed).select(F.col("id").alias("raw_line_id"), F.col("root").alias("root_line_id"), "position", "descendants")


def _every_20th(links: DataFrame) -> DataFrame:
    """The stated query set of searches: ids divisible by 20."""
    return links.filter("id % 20 = 0").select("id")


def p3_full_paths(spark: SparkSession, d: str) -> DataFrame:
    """The whole path of each node whose id is divisible by 20, a row for each node on it."""
    links, placed = _placed_links(spark, d)
    return forest.full_paths(links, _every_20th(links), placed).select(F.col("id").alias("raw_line_id"), "position", F.col("node").alias("path_line_id"))


def p3_below(spark: SparkSession, d: str) -> DataFrame:
    """All nodes below each node whose id is divisible by 20."""
    links, placed = _placed_links(spark, d)
    order = stored(forest.preorder(links, placed=placed), "preorder")
    return forest.descendants(order, _every_20th(links)).select(F.col("ancestor").alias("raw_line_id"), F.col("id").alias("descendant_line_id"))


_TREE = """WITH RECURSIVE node AS (
  SELECT session_id AS s, uuid AS u, min(raw_line_id) AS id, min(parent_uuid) AS p
  FROM parsed_lines WHERE session_id IS NOT NULL AND uuid IS NOT NULL GROUP BY 1, 2),
link AS (SELECT c.id, n.id AS up FROM node c LEFT JOIN node n ON n.s = c.s AND n.u = c.p),
walk(id, root, depth, path) AS (
  SELECT id, id, 0, [id] FROM link WHERE up IS NULL
  UNION ALL SELECT l.id, w.root, w.depth + 1, list_append(w.path, l.id) FROM walk w JOIN link l ON l.up = w.id)"""
P3_PATHS_SQL = _TREE + """
SELECT id AS raw_line_id, root AS root_line_id, CAST(depth AS BIGINT) AS depth, CASE WHEN depth > 0 THEN path[(depth - 1) // 32 * 32 + 1] END AS anchor_line_id,
       CASE WHEN depth = 0 THEN CAST(id AS VARCHAR) ELSE array_to_string(path[(depth - 1) // 32 * 32 + 2:], '/') END AS segment FROM walk
"""
P3_DESCENDANTS_SQL = _TREE + """
SELECT id AS raw_line_id, count(below.a) AS descendants FROM walk LEFT JOIN (SELECT unnest(path[:-2]) AS a FROM walk) below ON below.a = id GROUP BY id
"""
P3_PREORDER_SQL = _TREE + """
SELECT w.id AS raw_line_id, w.root AS root_line_id, row_number() OVER (PARTITION BY w.root ORDER BY w.path) - 1 AS position, coalesce(b.n, 0) AS descendants
FROM walk w LEFT JOIN (SELECT a, count(*) AS n FROM (SELECT unnest(path[:-2]) AS a FROM walk) GROUP BY a) b ON b.a = w.id
"""

P3_FULL_PATHS_SQL = _TREE + """
SELECT raw_line_id, CAST(n - 1 AS BIGINT) AS position, path[n] AS path_line_id FROM (SELECT id AS raw_line_id, path, unnest(range(1, len(path) + 1)) AS n FROM walk WHERE id % 20 = 0)
"""
P3_BELOW_SQL = _TREE + """
SELECT a AS raw_line_id, id AS descendant_line_id FROM (SELECT id, unnest(path[:-2]) AS a FROM walk) WHERE a % 20 = 0
"""

QUERIES = {"p1_found": p1_found, "p1_unified": p1_unified, "p1_columns": p1_columns, "p2_found": p2_found, "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_preorder": p3_preorder, "p3_full_paths": p3_full_paths, "p3_below": p3_below}
SQL = {"p1_found": P1_FOUND_SQL, "p1_columns": P1_COLUMNS_SQL, "p2_found": P2_FOUND_SQL, "p3_found": P3_FOUND_SQL, "p3_paths": P3_PATHS_SQL, "p3_descendants": P3_DESCENDANTS_SQL, "p3_preorder": P3_PREORDER_SQL, "p3_full_paths": P3_FULL_PATHS_SQL, "p3_below": P3_BELOW_SQL}
