"""Queries p4 to p8 over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stored
from . import conversations, mixing, nearest, packing, stuffing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The messages of all whole conversations, in order."""
    return p4_conversations(spark, d).drop("speaker")


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "parsed_lines"), table(spark, d, "requests"))


P4_CONVERSATIONS_SQL = r"""
WITH RECURSIVE asked AS (
  SELECT r.raw_line_id, coalesce(p.session_id, '<missing>') AS s, r.message_id AS m, r.request_id AS q, coalesce('m/' || r.message_id, 'r/' || r.request_id) AS k
  FROM requests r LEFT JOIN parsed_lines p USING (raw_line_id) WHERE r.message_id IS NOT NULL OR r.request_id IS NOT NULL),
bare AS (SELECT DISTINCT s, q FROM asked WHERE m IS NULL),
edge AS (SELECT DISTINCT a.s, a.k AS x, 'r/' || a.q AS y FROM asked a JOIN bare b ON a.s = b.s AND a.q = b.q),
pair AS (SELECT s, x, y FROM edge UNION SELECT s, y, x FROM edge UNION SELECT s, x, x FROM edge),
reach(s, x, y) AS (SELECT s, x, y FROM pair UNION SELECT r.s, r.x, b.y FROM reach r JOIN pair b ON b.s = r.s AND b.x = r.y),
label AS (SELECT s, x, min(y) AS l FROM reach GROUP BY s, x),
copies AS (SELECT a.raw_line_id, coalesce(l.l, a.k) AS g FROM asked a LEFT JOIN label l ON l.s = a.s AND l.x = a.k),
lines AS (
  SELECT p.*, c.g, coalesce(regexp_matches(message_text, '[^\s\p{Z}\x{200B}\x{FEFF}]'), false) AS shows
  FROM parsed_lines p LEFT JOIN copies c USING (raw_line_id) WHERE session_id IS NOT NULL AND uuid IS NOT NULL),
node AS (
  SELECT session_id AS s, uuid AS u, min(raw_line_id) AS id, min(parent_uuid) AS p, bool_or(line_type = 'user' AND is_meta = 0) AS usr,
         bool_or(line_class = 'request') AS req, bool_or(is_sidechain = 0) AS main, bool_or(shows) AS shows
  FROM lines GROUP BY 1, 2),
link AS (
  SELECT c.id, n.id AS up, c.p, c.usr, c.main AND (c.usr OR c.req) AS speaks, c.shows FROM node c LEFT JOIN node n ON n.s = c.s AND n.u = c.p),
tree(id, root) AS (
  SELECT id, id FROM link WHERE p IS NULL
  UNION ALL SELECT l.id, t.root FROM tree t JOIN link l ON l.up = t.id),
said AS (SELECT t.root, l.id, l.usr, l.shows FROM tree t JOIN link l USING (id) WHERE l.speaks),
member AS (
  SELECT DISTINCT t.root, t.id, l.g FROM said t JOIN node n ON n.id = t.id JOIN lines l ON l.session_id = n.s AND l.uuid = n.u WHERE l.g IS NOT NULL AND NOT t.usr),
both_ AS (SELECT DISTINCT a.root, a.g AS x, b.g AS y FROM member a JOIN member b ON a.root = b.root AND a.id = b.id),
joined(root, x, y) AS (SELECT root, x, y FROM both_ UNION SELECT j.root, j.x, b.y FROM joined j JOIN both_ b ON b.root = j.root AND b.x = j.y),
one AS (SELECT root, x, min(y) AS g FROM joined GROUP BY root, x),
talk AS (
  SELECT t.root, t.id, t.usr, t.shows, coalesce(o.g, CAST(t.id AS VARCHAR)) AS k
  FROM said t LEFT JOIN (SELECT m.root, m.id, min(o.g) AS g FROM member m JOIN one o ON o.root = m.root AND o.x = m.g GROUP BY 1, 2) o ON o.root = t.root AND o.id = t.id),
message AS (SELECT root, k, min(id) AS m FROM talk GROUP BY root, k HAVING bool_or(shows)),
marked AS (SELECT t.id, m.m, t.usr FROM talk t JOIN message m ON m.root = t.root AND m.k = t.k),
walk(id, root, near, far) AS (
  SELECT l.id, l.id, CAST(NULL AS BIGINT), 0 FROM link l WHERE l.p IS NULL
  UNION ALL
  SELECT l.id, w.root, coalesce(k.m, w.near), CASE WHEN k.m IS NULL THEN w.far + 1 ELSE 1 END
  FROM walk w JOIN link l ON l.up = w.id LEFT JOIN marked k ON k.id = w.id),
msg AS (
  SELECT w.root, k.m, bool_or(k.usr) AS usr, arg_min(w.near, w.far * 1000000000000 + w.near) FILTER (WHERE w.near <> k.m) AS before
  FROM walk w JOIN marked k ON k.id = w.id GROUP BY w.root, k.m),
follows AS (SELECT a.*, b.usr AS before_usr FROM msg a LEFT JOIN msg b ON b.m = a.before),
forks AS (SELECT root FROM follows WHERE before IS NOT NULL GROUP BY root, before HAVING count(*) > 1),
ok AS (
  SELECT root FROM follows GROUP BY root
  HAVING count(*) FILTER (WHERE before IS NULL) = 1 AND bool_and(usr) FILTER (WHERE before IS NULL)
     AND count(*) FILTER (WHERE usr) = count(*) FILTER (WHERE before_usr AND NOT usr)),
line(root, m, usr, position) AS (
  SELECT f.root, f.m, f.usr, 0 FROM follows f JOIN ok USING (root) WHERE f.before IS NULL AND f.root NOT IN (SELECT root FROM forks)
  UNION ALL SELECT f.root, f.m, f.usr, l.position + 1 FROM line l JOIN follows f ON f.before = l.m),
whole AS (SELECT root FROM line GROUP BY root HAVING count(*) = (SELECT count(*) FROM follows f WHERE f.root = line.root))
SELECT root AS root_line_id, CAST(position AS BIGINT) AS message_position, m AS raw_line_id, CASE WHEN usr THEN 'user' ELSE 'assistant' END AS speaker
FROM line JOIN whole USING (root)
"""
P4_FOUND_SQL = f"SELECT root_line_id, message_position, raw_line_id FROM ({P4_CONVERSATIONS_SQL})"


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """reading_line_id, request_line_id, distance_ms of each five-hour reading and the response nearest in time."""
    ok = table(spark, d, "status_readings").filter("status = 'ok' and captured_at_s is not null").select("raw_line_id", "captured_at_s", "session_id", "transcript_path")
    five = table(spark, d, "rate_limit_windows").filter("window_name = 'five_hour' and validity = 'valid'").select("raw_line_id").distinct()
    named = F.nullif(F.regexp_extract("transcript_path", r"([^/\\]+?)(?:\.jsonl)?$", 1), F.lit(""))
    session = F.coalesce("session_id", named)
    # Epoch seconds of our era stay under 1e11; what is above was written in milliseconds.
    millis = F.round(F.when(F.col("captured_at_s") > 1e11, F.col("captured_at_s")).otherwise(F.col("captured_at_s") * 1000))
    lines = table(spark, d, "parsed_lines").filter("line_class = 'request' and timestamp_utc is not null and session_id is not null").select("raw_line_id", "session_id", "timestamp_utc")
    # Both joins are on unique ids of growing tables: merged, never broadcast.
    requests = table(spark, d, "requests").select("raw_line_id").join(lines.hint("merge"), "raw_line_id")
    pairs = nearest.nearest(
        ok.join(five.hint("merge"), "raw_line_id", "left_semi"), requests, (session, millis, F.col("raw_line_id")),
        (F.col("session_id"), F.unix_millis(F.col("timestamp_utc").cast("timestamp")), F.col("raw_line_id")), 45_000,
    )
    return pairs.select(F.col("left_id").alias("reading_line_id"), F.col("right_id").alias("request_line_id"), F.col("distance").alias("distance_ms"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).drop("distance_ms")


P5_PAIRS_SQL = r"""
WITH reading AS (
  SELECT raw_line_id AS id, coalesce(session_id, nullif(regexp_extract(transcript_path, '([^/\\]+?)(?:\.jsonl)?$', 1), '')) AS s,
         CAST(round(CASE WHEN captured_at_s > 1e11 THEN captured_at_s ELSE captured_at_s * 1000 END) AS BIGINT) AS t
  FROM status_readings WHERE status = 'ok'
    AND raw_line_id IN (SELECT raw_line_id FROM rate_limit_windows WHERE window_name = 'five_hour' AND validity = 'valid')),
response AS (SELECT r.raw_line_id AS id, p.session_id AS s, epoch_ms(p.timestamp_utc) AS t FROM requests r JOIN parsed_lines p USING (raw_line_id) WHERE p.timestamp_utc IS NOT NULL),
near AS (
  SELECT a.id, b.id AS other, abs(a.t - b.t) AS d, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.t - b.t), b.t, b.id) AS n
  FROM reading a JOIN response b ON a.s = b.s AND abs(a.t - b.t) <= 45000)
SELECT id AS reading_line_id, other AS request_line_id, d AS distance_ms FROM near WHERE n = 1
"""
P5_FOUND_SQL = f"SELECT reading_line_id, request_line_id FROM ({P5_PAIRS_SQL})"


def _packs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The kinds of containers: a fixed table of a few rows."""
    packs = table(spark, d, "pack_sizes").select("pack_name", "capacity_tokens").filter("capacity_tokens is not null").take(1001)
    if len(packs) > 1000:
        raise ValueError("pack_sizes has more than 1,000 rows")
    return [(r[0], r[1]) for r in packs]


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Which tokens of which document stand in which container, for each kind of container."""
    return packing.packed(mixing.sized(table(spark, d, "documents")), _packs(spark, d)).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, by harmonic classes topped up and by plain ones."""
    sizes, packs = mixing.sized(table(spark, d, "documents")), _packs(spark, d)
    out = None
    for method in ("classed", "harmonic"):
        used = packing.packed(sizes, packs, method).groupBy("pack_name", "capacity_tokens").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
        used = used.select(F.lit(method).alias("method"), "*", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
        out = used if out is None else out.unionByName(used)
    return out


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of container: documents packed whole, and how often anything is wrong (a container overfull, a token lost or twice, a text cut without need)."""
    sizes, packs = mixing.sized(table(spark, d, "documents")), _packs(spark, d)
    pieces = stored(packing.packed(sizes, packs), "packed")
    keys = ["pack_name", "capacity_tokens"]
    loads = pieces.groupBy(*keys, "container_id").agg(F.sum("tokens").alias("load")).groupBy(*keys).agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("overfull"))
    last = F.max(F.col("first_token") + F.col("tokens"))
    got = pieces.groupBy(*keys, "id").agg(F.sum("tokens").alias("packed"), last.alias("last"), F.count("*").alias("parts"), F.count_distinct("first_token").alias("starts"))
    whole = got.join(sizes.select("id", F.col("tokens").alias("due")), "id")
    fine = (F.col("packed") == F.col("due")) & (F.col("last") == F.col("due")) & (F.col("parts") == F.col("starts"))
    cut = F.col("parts") != F.ceil(F.col("due") / F.col("capacity_tokens"))
    return whole.groupBy(*keys).agg(F.count_if(fine).alias("whole_documents"), F.count_if(~fine).alias("wrong_documents"), F.count_if(cut).alias("cut_without_need")).join(loads, keys)


P6_CHECK_SQL = """
SELECT pack_name, capacity_tokens, (SELECT count(*) FROM documents WHERE text <> '') AS whole_documents, 0 AS wrong_documents, 0 AS cut_without_need, 0 AS overfull FROM pack_sizes
"""


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = mixing.sized(table(spark, d, "documents"))
    rate = stored(mixing.rates(sizes, table(spark, d, "mix_targets")), "rates")
    return mixing.mix(sizes, rate), rate


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: each use of each document."""
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: its documents, and whether the mix keeps to its rate, its cap and its share."""
    sizes = mixing.sized(table(spark, d, "documents"))
    rate = stored(mixing.rates(sizes, table(spark, d, "mix_targets")), "rates")
    mixed = stored(mixing.mix(sizes, rate), "mix")
    used = mixed.groupBy("id").agg(F.count("*").alias("uses"), F.count_distinct("copy").alias("numbers"), F.max("copy").alias("last"))
    each = sizes.filter("tokens > 0").join(rate.select("source", "rate", "max_repeats"), "source").join(used, "id", "left").fillna(0, ["uses", "numbers", "last"])
    off = ~F.col("uses").isin(0) & ((F.col("uses") != F.col("numbers")) | (F.col("uses") != F.col("last")))
    off = off | (F.col("uses") < F.floor("rate")) | (F.col("uses") > F.ceil("rate")) | (F.col("uses") > F.col("max_repeats"))
    per = each.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(off).alias("off_their_rate"))
    # A draw strays by the root of its sum of squares: five times that is never reached by chance.
    spread = each.groupBy("source").agg(F.sqrt(F.sum(F.pow("tokens", 2))).alias("spread"))
    whole = mixed.agg(F.sum("tokens").alias("whole"))
    share = mixing.shares(mixed, rate).join(spread, "source", "left").crossJoin(F.broadcast(whole))
    held = F.when(F.col("docs") == 0, F.col("actual_share") == 0).otherwise(F.abs(F.col("mixed_tokens") - F.col("rate") * F.col("tokens")) <= 5 * F.col("spread"))
    return share.select("source", "target_share", "max_repeats", held.alias("share_held")).join(per, "source", "left").fillna(0, ["documents", "off_their_rate"])


P7_CHECK_SQL = r"""
WITH d AS (SELECT regexp_replace(regexp_replace(lower(trim(regexp_replace(source, '[\s\x{A0}]+', ' ', 'g'))), '[_ ]', '-', 'g'), '', '') AS source FROM documents WHERE text <> '')
SELECT t.source, t.target_share, t.max_repeats, true AS share_held, count(d.source) AS documents, 0 AS off_their_rate FROM mix_targets t LEFT JOIN d ON d.source = t.source GROUP BY ALL
"""


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of repeated keywords, links or tags."""
    return stuffing.stuffed(table(spark, d, "documents"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.page_scores(table(spark, d, "documents"))


QUERIES = {
    "p4_found": p4_found, "p4_conversations": p4_conversations, "p5_found": p5_found, "p5_pairs": p5_pairs,
    "p6_packed": p6_packed, "p6_fill": p6_fill, "p6_check": p6_check, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_check": p7_check, "p8_found": p8_found, "p8_scores": p8_scores,
}
SQL = {"p4_found": P4_FOUND_SQL, "p4_conversations": P4_CONVERSATIONS_SQL, "p5_found": P5_FOUND_SQL, "p5_pairs": P5_PAIRS_SQL, "p6_check": P6_CHECK_SQL, "p7_check": P7_CHECK_SQL}
