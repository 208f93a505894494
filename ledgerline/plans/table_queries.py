"""The operators on ordinary relational tables: queries q01 to q38, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import intervals, lineage, periods, recursive, runs
from ..operators.asof import asof_backward, asof_forward, scd_ranges
from ..operators.copies import latest_by
from .views import DAY_MS, ms

QUERIES: dict = {}
SQL: dict[str, str] = {}
MINUTE_MS = 60_000
FIVE_HOURS_MS = 18_000_000
#: A price list by return flag and a plan list by month: invented rows.
FLAG_PRICES = [("A", "0001-01-01", 0.02), ("A", "1995-01-01", 0.03), ("N", "1996-06-01", 0.01), ("R", "0001-01-01", 0.05)]
MONTH_PLANS = [("1993-01", "first"), ("1995-07", "second"), ("1997-01", "third")]
SPANS = [("a", "1993-01-01", "1994-06-30"), ("b", "1994-01-01", "1995-12-31"), ("c", "1997-01-01", "1997-12-31")]


def query(sql: str | None):
    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, lambda name: spark.read.parquet(f"{d}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DEDUP = """SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY value DESC NULLS LAST, ts, event_id DESC) = 1"""


def _latest(t) -> DataFrame:
    e = t("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return latest_by(e, ["user_id", "event_type", "day"], F.struct(F.coalesce("value", F.lit(float("-inf"))), -ms("ts"), "event_id"))


@query(f"SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, ts, value FROM ({_DEDUP})")
def q01_dedup_latest(spark, t):
    return _latest(t).select("event_id", "user_id", "event_type", "day", "ts", "value")


@query(f"""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS without_value, count(*) FILTER (WHERE value > 50) AS high, round(sum(value), 3) AS total, min(ts) AS covers_from, max(ts) AS covers_to FROM ({_DEDUP}) GROUP BY 1""")
def q02_usage_by_type(spark, t):
    v = F.col("value")
    return _latest(t).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("without_value"), F.count_if(v > 50).alias("high"), F.round(F.sum(v), 3).alias("total"), F.min("ts").alias("covers_from"), F.max("ts").alias("covers_to")
    )


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM ({_DEDUP}) GROUP BY 1, 2")
def q03_usage_by_day_type(spark, t):
    return _latest(t).groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


_CLASSES = ("malformed", "failure", "sale", "visit", "other")


@query("""WITH c AS (SELECT CASE WHEN NOT json_valid(props) THEN 'malformed' WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'purchase' THEN 'sale' WHEN event_type IN ('view', 'click') THEN 'visit' ELSE 'other' END AS class FROM events)
SELECT l.class, count(c.class) AS n FROM (VALUES ('malformed'), ('failure'), ('sale'), ('visit'), ('other')) l(class) LEFT JOIN c USING (class) GROUP BY 1""")
def q04_classify_lines(spark, t):
    kind = F.when(F.try_parse_json("props").isNull(), "malformed").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "sale").when(F.col("event_type").isin("view", "click"), "visit").otherwise("other")
    counts = t("events").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(c,) for c in _CLASSES], "class string")
    return every.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def q05_raw_line_identity(spark, t):
    return t("documents").filter("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_PRICED = """SELECT l.*, strftime(l_shipdate, '%Y-%m') AS month, p.rate, CASE WHEN p.flag IS NULL THEN 'no_price_row' WHEN l_quantity > 45 THEN 'rate_unverified' END AS unpriced_reason
FROM lineitem l LEFT JOIN (VALUES ('A', '0001-01-01', 0.02::DOUBLE), ('A', '1995-01-01', 0.03), ('N', '1996-06-01', 0.01), ('R', '0001-01-01', 0.05)) p(flag, since, rate)
  ON p.flag = l_returnflag AND p.since = (SELECT max(q.since) FROM (VALUES ('A', '0001-01-01'), ('A', '1995-01-01'), ('N', '1996-06-01'), ('R', '0001-01-01')) q(flag, since) WHERE q.flag = l_returnflag AND q.since <= strftime(l_shipdate, '%Y-%m-%d'))"""


def _priced(spark, t) -> DataFrame:
    p = scd_ranges(spark.createDataFrame(FLAG_PRICES, "flag string, since string, rate double"), ["flag"], "since", "until")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    l = t("lineitem").withColumns({"_day": day, "month": F.date_format("l_shipdate", "yyyy-MM")})
    m = l.join(F.broadcast(p), (F.col("l_returnflag") == F.col("flag")) & (F.col("_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))), "left")  # a hand-written list
    return m.withColumn("unpriced_reason", F.when(F.col("flag").isNull(), "no_price_row").when(F.col("l_quantity") > 45, "rate_unverified"))


@query(f"SELECT l_returnflag, unpriced_reason, count(*) AS n, round(sum(CASE WHEN unpriced_reason IS NULL THEN l_extendedprice * rate END), 4) AS cost FROM ({_PRICED}) GROUP BY 1, 2")
def q06_scd_price_cost(spark, t):
    cost = F.when(F.col("unpriced_reason").isNull(), F.col("l_extendedprice") * F.col("rate"))
    return _priced(spark, t).groupBy("l_returnflag", "unpriced_reason").agg(F.count("*").alias("n"), F.round(F.sum(cost), 4).alias("cost"))


@query(f"""SELECT m.*, (SELECT arg_max(name, since) FROM (VALUES ('1993-01', 'first'), ('1995-07', 'second'), ('1997-01', 'third')) p(since, name) WHERE since <= month) AS plan_name
FROM (SELECT month, count(*) AS lines, count(*) FILTER (WHERE unpriced_reason IS NULL) AS priced, CASE WHEN count(*) FILTER (WHERE unpriced_reason IS NULL) > 0 THEN round(sum(l_extendedprice * rate) FILTER (WHERE unpriced_reason IS NULL), 4) END AS cost FROM ({_PRICED}) GROUP BY 1) m""")
def q07_monthly_list_price(spark, t):
    ok = F.col("unpriced_reason").isNull()
    m = _priced(spark, t).groupBy("month").agg(F.count("*").alias("lines"), F.count_if(ok).alias("priced"), F.round(F.sum(F.when(ok, F.col("l_extendedprice") * F.col("rate"))), 4).alias("cost"))
    p = periods.lead_periods(spark.createDataFrame(MONTH_PLANS, "since string, plan_name string"), "since", "until")
    return periods.place(m, p, F.col("month"), "since", "until").select("month", "lines", "priced", "cost", "plan_name")


@query("""SELECT e.event_id, (SELECT max(c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts < e.ts) AS click_at,
  (SELECT arg_max(c.event_id, c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts < e.ts) AS click_id FROM events e WHERE e.event_type = 'error'""")
def q08_asof_prev_click(spark, t):
    e = t("events")
    errors, clicks = e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    out = asof_backward(errors, clicks, ["user_id"], ms("ts"), ms("ts"), F.col("event_id"), ["ts", "event_id"], strict=True, prefix="c_")
    return out.select("event_id", F.col("c_ts").alias("click_at"), F.col("c_event_id").alias("click_id"))


@query("""SELECT e.event_id, (SELECT min(c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'purchase' AND c.ts > e.ts) AS next_purchase, (SELECT min(c.ts) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'view' AND c.ts > e.ts) AS next_view FROM events e WHERE e.event_type = 'error'""")
def q09_next_after_hit(spark, t):
    e = t("events")
    out = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    for kind in ("purchase", "view"):
        out = asof_forward(out, e.filter(F.col("event_type") == kind).select("user_id", "ts", "event_id"), ["user_id"], ms("ts"), ms("ts"), F.col("event_id"), ["ts"], prefix=f"{kind}_")
    return out.select("event_id", F.col("purchase_ts").alias("next_purchase"), F.col("view_ts").alias("next_view"))


_ISLANDS = """SELECT event_id, user_id, start_ts, end_ts, sum(CASE WHEN seen IS NULL OR start_ts > seen THEN 1 ELSE 0 END) OVER (ORDER BY start_ts, end_ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS interval_number
FROM (SELECT *, max(end_ts) OVER (ORDER BY start_ts, end_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM (SELECT event_id, user_id, date_trunc('minute', ts) AS start_ts, date_trunc('minute', ts) + to_minutes(CAST(floor(greatest(value, 0) / 10) AS BIGINT)) AS end_ts FROM events WHERE event_type = 'error' AND value IS NOT NULL))"""


def _islands(t) -> DataFrame:
    e = t("events").filter("event_type = 'error' and value is not null")
    start = F.date_trunc("minute", "ts")
    spans = e.select("event_id", "user_id", start.cast("timestamp_ntz").alias("start_ts"), F.timestamp_millis(ms(start) + F.floor(F.greatest("value", F.lit(0.0)) / 10).cast("bigint") * MINUTE_MS).cast("timestamp_ntz").alias("end_ts"))
    return intervals.merge_intervals(spans, "start_ts", "end_ts", "event_id")


def _grouped(t) -> DataFrame:
    return _islands(t).groupBy("interval_number").agg(F.min("start_ts").alias("locked_from"), F.max("end_ts").alias("locked_until"), F.count("*").alias("hits"), F.count_distinct("user_id").alias("users"))


_GROUPED = f"SELECT interval_number, min(start_ts) AS locked_from, max(end_ts) AS locked_until, count(*) AS hits, count(DISTINCT user_id) AS users FROM ({_ISLANDS}) GROUP BY 1"


@query(f"SELECT g.*, (SELECT min(ts) FROM events e WHERE e.event_type = 'view' AND e.ts >= g.locked_until) AS next_view FROM ({_GROUPED}) g")
def q10_next_global(spark, t):
    v = t("events").filter("event_type = 'view'").select(F.lit(0).alias("_all"), "ts", "event_id")
    out = asof_forward(_grouped(t).withColumn("_all", F.lit(0)), v, ["_all"], ms("locked_until"), ms("ts"), F.col("event_id"), ["ts"], strict=False, prefix="v_", bucket=60_000)
    return out.select("interval_number", "locked_from", "locked_until", "hits", "users", F.col("v_ts").alias("next_view"))


@query(_ISLANDS)
def q11_lockout_islands(spark, t):
    return _islands(t)


@query(f"SELECT count(*) AS intervals, coalesce(sum(epoch_ms(locked_until) - epoch_ms(locked_from)), 0)::BIGINT AS locked_ms, coalesce(sum(hits), 0)::BIGINT AS hits FROM ({_GROUPED})")
def q12_lockout_totals(spark, t):
    return _grouped(t).agg(F.count("*").alias("intervals"), F.coalesce(F.sum(ms("locked_until") - ms("locked_from")), F.lit(0)).alias("locked_ms"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


@query("""WITH last AS (SELECT user_id, max(ts) AS last_error, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT * FROM last l WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = l.user_id AND e.event_type = 'purchase' AND e.ts > l.last_error)""")
def q13_not_resumed(spark, t):
    e = t("events")
    last = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("last_error"), F.count("*").alias("errors"))
    after = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("_p"))
    return last.join(after, "user_id", "left").filter(F.col("_p").isNull() | (F.col("_p") <= F.col("last_error"))).drop("_p")


_READ = f"SELECT *, (epoch_ms(ts) // {FIVE_HOURS_MS} + 1) * {FIVE_HOURS_MS} AS resets FROM events"


def _readings(t) -> DataFrame:
    return t("events").withColumn("resets", ((F.floor(ms("ts") / FIVE_HOURS_MS) + 1) * FIVE_HOURS_MS).cast("bigint"))


@query(f"SELECT event_type, resets, count(*) AS readings, min(ts) AS first_at, resets > (SELECT max(epoch_ms(ts)) FROM events) AS window_open FROM ({_READ}) GROUP BY 1, 2")
def q14_window_instances(spark, t):
    r = _readings(t)
    g = r.groupBy("event_type", "resets").agg(F.count("*").alias("readings"), F.min("ts").alias("first_at"))
    return g.crossJoin(F.broadcast(r.agg(F.max(ms("ts")).alias("_m")))).withColumn("window_open", F.col("resets") > F.col("_m")).drop("_m")  # one row


_STALE = f"SELECT *, CASE WHEN value < max(value) OVER (PARTITION BY event_type, resets ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 THEN 1 ELSE 0 END AS stale FROM ({_READ})"


def _stale(t) -> DataFrame:
    return runs.stale_flag(_readings(t), ["event_type", "resets"], F.floor(ms("ts") / 3_600_000), [F.col("ts"), F.col("event_id")], "value", 1)


@query(f"SELECT event_type, resets, event_id, ts, value FROM ({_STALE}) WHERE stale = 0 QUALIFY row_number() OVER (PARTITION BY event_type, resets ORDER BY ts DESC, event_id DESC) = 1")
def q15_headroom(spark, t):
    return _stale(t).filter("stale = 0").groupBy("event_type", "resets").agg(F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("l")).select("event_type", "resets", "l.*")


@query(f"SELECT event_type, resets, event_id, ts, value FROM ({_READ}) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type, resets ORDER BY value DESC, ts, event_id) = 1")
def q16_peak(spark, t):
    g = _readings(t).filter("value is not null").groupBy("event_type", "resets").agg(F.max_by(F.struct("event_id", "ts", "value"), F.struct("value", -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id"))).alias("p"))
    return g.select("event_type", "resets", "p.*")


@query(f"SELECT event_type, resets, level, event_id, ts, value FROM ({_READ}) JOIN (VALUES (40), (75)) l(level) ON value >= level QUALIFY row_number() OVER (PARTITION BY event_type, resets, level ORDER BY ts, event_id) = 1")
def q17_crossings(spark, t):
    r = _readings(t).withColumn("level", F.explode(F.array(F.lit(40), F.lit(75)))).filter("value >= level")
    return r.groupBy("event_type", "resets", "level").agg(F.min_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("f")).select("event_type", "resets", "level", "f.*")


@query(f"SELECT event_id, resets, stale FROM ({_STALE})")
def q18_stale_flag(spark, t):
    return _stale(t).select("event_id", "resets", "stale")


@query("""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m)
SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS length, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY user_id, run""")
def q19_run_lengths(spark, t):
    r = runs.run_ids(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")], ~F.col("_previous.event_type").eqNullSafe(F.col("event_type")), bucket=F.to_date("ts"))
    return r.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("length"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_PAIRS = """SELECT event_id, user_id, pid AS previous_id, pts AS previous_ts, ts, round(value - pv, 4) AS change, (SELECT count(DISTINCT v.user_id) FROM events v WHERE v.event_type = 'view' AND v.ts >= pts AND v.ts < p.ts) AS viewers
FROM (SELECT *, lag(event_id) OVER w AS pid, lag(ts) OVER w AS pts, lag(value) OVER w AS pv FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) p WHERE pid IS NOT NULL"""


def _pairs(t) -> DataFrame:
    e = t("events").filter("event_type = 'error'").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    p = runs.consecutive(e, ["user_id"], [F.col("ts"), F.col("event_id")], {"event_id": "previous_id", "ts": "previous_ts", "value": "_pv", "us": "_pus"}, F.to_date("ts"))
    facts = t("events").filter("event_type = 'view'").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id")
    n = intervals.range_count_distinct(p, facts, "event_id", F.col("_pus"), F.col("us"), F.col("us"), "user_id", 12 * 3_600_000_000, "n")
    return p.join(n, "event_id", "left").select("event_id", "user_id", "previous_id", "previous_ts", "ts", F.round(F.col("value") - F.col("_pv"), 4).alias("change"), F.coalesce("n", F.lit(0)).alias("viewers"))


@query(_PAIRS)
def q20_reading_pairs(spark, t):
    return _pairs(t)


@query(f"""SELECT u.user_id, u.readings, coalesce(p.pairs, 0) AS pairs, CASE WHEN u.readings >= 2 THEN round(coalesce(p.points, 0.0), 2) END AS unattributed
FROM (SELECT user_id, count(*) AS readings FROM events WHERE event_type = 'error' GROUP BY 1) u
LEFT JOIN (SELECT user_id, count(*) AS pairs, sum(change) FILTER (WHERE change > 0 AND viewers < 20) AS points FROM ({_PAIRS}) GROUP BY 1) p ON p.user_id = u.user_id""")
def q21_unattributed(spark, t):
    u = t("events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("readings"))
    p = _pairs(t).groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum(F.when((F.col("change") > 0) & (F.col("viewers") < 20), F.col("change"))).alias("points"))
    return u.join(p, "user_id", "left").select("user_id", "readings", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.when(F.col("readings") >= 2, F.round(F.coalesce("points", F.lit(0.0)), 2)).alias("unattributed"))


@query("""SELECT o_orderkey, (SELECT arg_min(name, (ends, name)) FROM (VALUES ('a', DATE '1993-01-01', DATE '1994-06-30'), ('b', DATE '1994-01-01', DATE '1995-12-31'), ('c', DATE '1997-01-01', DATE '1997-12-31')) s(name, starts, ends)
  WHERE CAST(o_orderdate AS DATE) > starts AND CAST(o_orderdate AS DATE) <= ends) AS span FROM orders""")
def q22_containment(spark, t):
    s = spark.createDataFrame(SPANS, "name string, starts string, ends string").select("name", F.unix_date(F.to_date("starts")).alias("lo"), F.unix_date(F.to_date("ends")).alias("hi"))
    o = t("orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    inside = intervals.contained_in(o, s, F.col("day"), F.col("lo"), F.col("hi"), 365)
    first = inside.groupBy("o_orderkey").agg(F.min_by("name", F.struct("hi", "name")).alias("span"))
    return o.select("o_orderkey").join(first, "o_orderkey", "left")


_PLANS = "(SELECT since, name, lead(since) OVER (ORDER BY since) AS until FROM (VALUES ('1993-01', 'first'), ('1995-07', 'second'), ('1997-01', 'third')) p(since, name))"


def _by_plan(spark, t) -> DataFrame:
    p = periods.lead_periods(spark.createDataFrame(MONTH_PLANS, "since string, name string"), "since", "until")
    o = t("orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return periods.place(o, p, F.col("month"), "since", "until").withColumn("kind", F.when(F.col("since").isNull(), "none").otherwise("plan"))


@query(f"SELECT CASE WHEN since IS NULL THEN 'none' ELSE 'plan' END AS kind, since, until, name, count(*) AS orders FROM orders LEFT JOIN {_PLANS} ON strftime(o_orderdate, '%Y-%m') >= since AND (until IS NULL OR strftime(o_orderdate, '%Y-%m') < until) GROUP BY 1, 2, 3, 4")
def q23_plan_periods(spark, t):
    return _by_plan(spark, t).groupBy("kind", "since", "until", "name").agg(F.count("*").alias("orders"))


@query(f"""SELECT p.kind, p.since, coalesce(o.n, 0) AS orders, round(coalesce(o.total, 0.0), 2) AS total, o.covers_from, o.covers_to FROM (SELECT 'plan' AS kind, since FROM {_PLANS} UNION ALL SELECT 'none', NULL UNION ALL SELECT 'unknown', NULL) p
LEFT JOIN (SELECT CASE WHEN since IS NULL THEN 'none' ELSE 'plan' END AS kind, since, count(*) AS n, sum(o_totalprice) AS total, min(o_orderdate) AS covers_from, max(o_orderdate) AS covers_to FROM orders LEFT JOIN {_PLANS} ON strftime(o_orderdate, '%Y-%m') >= since AND (until IS NULL OR strftime(o_orderdate, '%Y-%m') < until) GROUP BY 1, 2) o
ON o.kind = p.kind AND o.since IS NOT DISTINCT FROM p.since""")
def q24_by_plan_summary(spark, t):
    p = spark.createDataFrame([("plan", m) for m, _ in MONTH_PLANS] + [("none", None), ("unknown", None)], "kind string, since string")
    o = _by_plan(spark, t).groupBy(F.col("kind").alias("_k"), F.col("since").alias("_s")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderdate").alias("covers_from"), F.max("o_orderdate").alias("covers_to"))
    j = p.join(o, (F.col("kind") == F.col("_k")) & F.col("since").eqNullSafe(F.col("_s")), "left")
    return j.select("kind", "since", F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), "covers_from", "covers_to")


@query(f"""SELECT event_type, resets, CASE WHEN since > 0 THEN round(value * 3600000000 / since, 4) END AS per_hour, CASE WHEN since > 0 AND value > 0 AND value < 100 THEN since * 100 / value < {FIVE_HOURS_MS}000 END AS before_reset
FROM (SELECT *, epoch_us(ts) - resets * 1000 + {FIVE_HOURS_MS}000 AS since FROM ({_STALE}) WHERE stale = 0 QUALIFY row_number() OVER (PARTITION BY event_type, resets ORDER BY ts DESC, event_id DESC) = 1)""")
def q25_burn_rate(spark, t):
    h = q15_headroom(spark, t).withColumn("since", F.unix_micros(F.col("ts").cast("timestamp")) - F.col("resets") * 1000 + FIVE_HOURS_MS * 1000)
    v, known = F.col("value"), F.col("since") > 0
    limit = F.col("since") * 100 / F.when(v > 0, v)
    return h.select("event_type", "resets", F.when(known, F.round(v * 3_600_000_000 / F.col("since"), 4)).alias("per_hour"), F.when(known & (v > 0) & (v < 100), limit < FIVE_HOURS_MS * 1000).alias("before_reset"))


@query("""WITH RECURSIVE n AS (SELECT session_id AS s, uuid AS u, min(raw_line_id) AS id, min(parent_uuid) AS p, bool_or(line_type = 'attachment' OR line_type = 'system') AS passes FROM parsed_lines WHERE session_id IS NOT NULL AND uuid IS NOT NULL GROUP BY 1, 2),
l AS (SELECT c.id, c.passes, m.id AS up FROM n c LEFT JOIN n m ON m.s = c.s AND m.u = c.p),
w(start, pos, passed) AS (SELECT id, up, 0 FROM l UNION ALL SELECT w.start, l.up, w.passed + 1 FROM w JOIN l ON l.id = w.pos WHERE l.passes AND w.passed < 50)
SELECT start, arg_max(coalesce(pos, -1), passed) AS stop, max(passed) AS passed FROM w GROUP BY start""")
def q26_recursive_walk(spark, t):
    n = t("parsed_lines").filter("session_id is not null and uuid is not null").groupBy("session_id", "uuid").agg(F.min("raw_line_id").alias("id"), F.min("parent_uuid").alias("p"), F.coalesce(F.max(F.col("line_type").isin("attachment", "system")), F.lit(False)).alias("passes"))
    up = n.select("session_id", F.col("uuid").alias("p"), F.col("id").alias("up"))
    l = n.join(up, ["session_id", "p"], "left")
    out = recursive.walk(l.select(F.col("id").alias("start"), F.col("up").alias("at")), l.select(F.col("id").alias("node"), "up", "passes"))
    return out.select("start", F.coalesce("stop", F.lit(-1)).alias("stop"), "passed")


@query("""SELECT coalesce(a.target, n_name) AS nation, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS lines, count(a.target) AS aliased
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT min(n_name) AS source, max(n_name) AS target FROM nation WHERE n_regionkey = 1) a ON a.source = n_name GROUP BY 1""")
def q27_region_attribution(spark, t):
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")  # 25 rows by definition
    a = n.filter("n_regionkey = 1").agg(F.min("n_name").alias("source"), F.max("n_name").alias("target"))
    names = n.join(F.broadcast(a), n["n_name"] == a["source"], "left").select("n_nationkey", "n_name", "target")
    rows = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.coalesce("target", "n_name").alias("nation")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.count("*").alias("lines"), F.count("target").alias("aliased"))


@query("SELECT n_name AS nation, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / nullif(sum(sum(o_totalprice)) OVER (), 0), 6) AS share FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def q28_share_of_total(spark, t):
    rows = t("orders").select("o_custkey", "o_totalprice").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("s"))
    g = rows.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.sum("s").alias("s"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("s").alias("_all")))).select("nation", F.round("s", 2).alias("total"), F.round(F.try_divide("s", "_all"), 6).alias("share"))


@query("SELECT strftime(ts - INTERVAL 5 HOUR, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q29_local_month(spark, t):
    return t("events").groupBy(periods.local_month(F.col("ts"), "-05:00").alias("month"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, string_agg(event_id, ',' ORDER BY ts, event_id) AS ids, coalesce(string_agg(event_id, ',' ORDER BY ts, event_id) FILTER (WHERE event_type = 'error'), '') AS error_ids FROM events GROUP BY 1")
def q30_ordered_ids(spark, t):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    order = [F.col("ts"), F.col("event_id")]
    return t("events").groupBy("user_id").agg(text(lineage.ordered_ids(order, "event_id")).alias("ids"), text(F.filter(lineage.ordered_ids(order, "event_id", F.col("event_type") == "error"), lambda x: x.isNotNull())).alias("error_ids"))


@query("SELECT event_type, round(sum(value), 3) AS reported, round(sum(value), 3) AS resummed, true AS agrees FROM events GROUP BY 1")
def q31_resum_explain(spark, t):
    reported = t("events").groupBy("event_type").agg(F.sum("value").alias("reported"))
    again = lineage.resum(t("events").repartition("event_id"), ["event_type"], F.col("value"), False)
    return lineage.agreement(reported, again, ["event_type"], "reported").select("event_type", F.round("reported", 3).alias("reported"), F.round("resummed", 3).alias("resummed"), "agrees")


@query("""WITH a AS (SELECT user_id, count(*) AS n, sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS an, coalesce(b.n, 0) AS bn, coalesce(a.v, 0) AS av, coalesce(b.v, 0) AS bv FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT user_id, 'n' AS field, an::DOUBLE AS left_value, bn::DOUBLE AS right_value FROM j WHERE an <> bn UNION ALL SELECT user_id, 'v', round(av, 3), round(bv, 3) FROM j WHERE abs(av - bv) > 1e-9 * greatest(abs(av), abs(bv))""")
def q32_verify_diff(spark, t):
    side = lambda kind: t("events").filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return lineage.differences(side("click"), side("view"), ["user_id"], ["n", "v"], {"v": 1e-9}).select("user_id", "field", F.round("left_value", 3).alias("left_value"), F.round("right_value", 3).alias("right_value"))


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'finished' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'open' END AS state FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'none' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def q33_anti_semi(spark, t):
    c = t("customer").select("c_custkey")
    key = lambda df: df.select(F.col("o_custkey").alias("c_custkey"))
    every, done = key(t("orders")), key(t("orders").filter("o_orderstatus = 'F'"))
    finished = c.join(done, "c_custkey", "left_semi").withColumn("state", F.lit("finished"))
    open_ = c.join(every, "c_custkey", "left_semi").join(done, "c_custkey", "left_anti").withColumn("state", F.lit("open"))
    return finished.unionByName(open_).unionByName(c.join(every, "c_custkey", "left_anti").withColumn("state", F.lit("none")))


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, true AS free_of_order, true AS sees_a_copy, true AS sees_a_change FROM {n}" for n in ("orders", "events", "customer")))
def q34_fingerprint(spark, t):
    """Each table's fingerprint: the same in another order and partitioning, another one with a row more or a value changed."""
    out = None
    for name in ("orders", "events", "customer"):
        df = t(name)
        key = df.columns[0]
        first = df.orderBy(key).limit(1)
        prints = [lineage.fingerprint(x).select("*", F.lit(i).alias("i")) for i, x in enumerate((df, df.repartition(5, F.reverse(F.col(key).cast("string"))), df.unionByName(first), df.withColumn(key, F.col(key) + F.when(F.col(key) == F.lit(first.first()[0]), 1).otherwise(0))))]
        all_ = prints[0].unionByName(prints[1]).unionByName(prints[2]).unionByName(prints[3])
        of = lambda i: F.max(F.when(F.col("i") == i, F.col("checksum")))
        f = all_.agg(F.max(F.when(F.col("i") == 0, F.col("rows"))).alias("row_count"), (of(0) == of(1)).alias("free_of_order"), (of(0) != of(2)).alias("sees_a_copy"), (of(0) != of(3)).alias("sees_a_change"))
        f = f.select(F.lit(name).alias("table_name"), "*")
        out = f if out is None else out.unionByName(f)
    return out


@query("""SELECT event_id, k AS key, v AS value, CASE WHEN v IS NULL THEN 'no_number' WHEN v < 0 THEN 'negative' WHEN v > 50 THEN 'high' ELSE 'valid' END AS validity
FROM (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events), LATERAL (SELECT TRY_CAST(json_extract_string(props, '$.' || k) AS BIGINT) AS v)""")
def q35_variant_explode(spark, t):
    e = t("events").select("event_id", F.try_parse_json("props").alias("j")).filter("j is not null")
    x = spark.tvf.variant_explode(F.col("j").outer()).select("key", F.col("value").alias("v"))
    rows = e.lateralJoin(x).select("event_id", "key", F.try_variant_get("v", "$", "bigint").alias("value"))
    return rows.withColumn("validity", F.when(F.col("value").isNull(), "no_number").when(F.col("value") < 0, "negative").when(F.col("value") > 50, "high").otherwise("valid"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s"<>]+')) AS links, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]+')) AS addresses, len(regexp_extract_all(text, '\b[0-9]{1,3}(?:,[0-9]{3})+\b')) AS numbers,
  CASE WHEN contains(lower(text), 'five-hour') THEN 'five_hour' WHEN contains(lower(text), 'weekly') THEN 'seven_day' END AS window_name FROM documents WHERE text IS NOT NULL""")
def q36_text_parse(spark, t):
    low = F.lower("text")
    count = lambda rx: F.regexp_count("text", F.lit(rx)).cast("bigint")
    return t("documents").filter("text is not null").select(
        "doc_id", count(r'https?://[^\s"<>]+').alias("links"), count(r"[\w.+-]+@[\w-]+\.[\w.]+").alias("addresses"), count(r"\b[0-9]{1,3}(?:,[0-9]{3})+\b").alias("numbers"),
        F.when(F.contains(low, F.lit("five-hour")), "five_hour").when(F.contains(low, F.lit("weekly")), "seven_day").alias("window_name"),
    )


@query("SELECT raw_line_id, session_id, line_type, substr(sha256(coalesce(cwd, '') || chr(10) || coalesce(uuid, '')), 1, 32) AS origin, length(message_text) AS text_length FROM parsed_lines WHERE line_class <> 'malformed'")
def q37_scrub(spark, t):
    origin = F.substring(F.sha2(F.concat(F.coalesce("cwd", F.lit("")), F.lit("\n"), F.coalesce("uuid", F.lit(""))).cast("binary"), 256), 1, 32)
    return t("parsed_lines").filter("line_class <> 'malformed'").select("raw_line_id", "session_id", "line_type", origin.alias("origin"), F.length("message_text").cast("bigint").alias("text_length"))


@query("""SELECT 'events' AS source, min(ts) AS covers_from, max(ts) AS covers_to FROM events UNION ALL SELECT 'orders', min(o_orderdate), max(o_orderdate) FROM orders UNION ALL SELECT 'lineitem', min(l_shipdate), max(l_shipdate) FROM lineitem""")
def q38_coverage(spark, t):
    out = None
    for name, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        one = t(name).agg(F.min(c).alias("covers_from"), F.max(c).alias("covers_to")).select(F.lit(name).alias("source"), "*")
        out = one if out is None else out.unionByName(one)
    return out
