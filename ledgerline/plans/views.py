"""The metric views over the derived tables, from de-duplicated requests to projected prices.

Each view is a method that returns a DataFrame; what several views read (de-duplicated requests, window
readings, limit hits, lockout hits) is stored once per object. Observed views never read prices: those start at
`request_costs`. Times are milliseconds inside and timestamps without zone outside. Unknown is null, never 0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lines import WINDOW_SECONDS
from ..operators.asof import asof_backward, asof_forward, scd_ranges
from ..operators.copies import latest_by
from ..operators.intervals import contained_in, merge_intervals, range_count_distinct
from ..operators.periods import lead_periods, local_month, place
from ..operators.recursive import walk
from ..operators.runs import consecutive, run_ids, stale_flag
from ..runtime import stored
from ..sources import derive
from ..sources.store import Versions, signature_of
from . import dimensions as dim

#: Raised whenever a base view would be computed otherwise.
VERSION = "2"

DAY_MS, HOUR_MS = 86_400_000, 3_600_000
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "cache_write_unsplit_tokens"]


def ms(c: str | Column) -> Column:
    """Whole milliseconds since 1970 of a timestamp (session zone UTC)."""
    return F.unix_millis((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def at(c: str | Column) -> Column:
    """The timestamp without zone of whole milliseconds."""
    return F.timestamp_millis(F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (ms(later) - ms(earlier)) / 1000.0


def length_s(window: Column) -> Column:
    return F.when(window == "five_hour", WINDOW_SECONDS["five_hour"]).otherwise(WINDOW_SECONDS["seven_day"])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group: for groups of a few copies."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


class Telemetry:
    """The views over one folder of tables, or over DataFrames given by name."""

    def __init__(self, spark: SparkSession, folder: str = "", tables: dict[str, DataFrame] | None = None, views: str | None = None):
        """views: a folder that keeps the two base views from one report to the next, until what they read changes."""
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # times without zone are UTC throughout
        self.spark, self.folder, self.tables, self.views = spark, folder, tables or {}, views

    def _base(self, name: str, compute: Callable[[], DataFrame], *reads: str) -> DataFrame:
        """A base view, computed unless the stored one is of the same tables and rules."""
        if self.views is None:
            return stored(compute(), name)
        kept = Versions(self.spark, f"{self.views}/{name}")
        kept.refresh("".join(signature_of(self.table(t), VERSION) for t in reads), compute)
        return kept.read()

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return dim.frame(self.spark, rows, schema)

    # --- base ------------------------------------------------------------------------------------------

    @cached_property
    def request_lines(self) -> DataFrame:
        """Every request line with its key, session, time and place."""
        p = self.table("parsed_lines").filter("line_class = 'request'").select("raw_line_id", "session_id", "timestamp_raw", "timestamp_utc", "cwd", "is_sidechain")
        raw = self.table("raw_lines").filter("kind = 'log'").select("raw_line_id", "source_file_id", "first_run_id", "line_number")
        files = self.table("source_files").select("source_file_id", "root", "relative_path")
        session = F.coalesce("session_id", F.lit("<missing>"))
        m, r = F.nullif("message_id", F.lit("")), F.nullif("request_id", F.lit(""))
        key = F.coalesce(F.concat(session, F.lit("/m/"), m), F.concat(session, F.lit("/r/"), r))
        return self.table("requests").join(p, "raw_line_id").join(raw, "raw_line_id").join(files, "source_file_id").withColumn("dedup_key", key)

    @cached_property
    def requests_dedup(self) -> DataFrame:
        """V1: one row per response: most output, then main line, then earliest time, then the latest position."""
        rows = self.request_lines.select(
            "raw_line_id", "dedup_key", "message_id", "request_id", "model", *TOKENS, "speed", "service_tier", "inference_geo", "session_id", "timestamp_raw", "timestamp_utc",
            "cwd", "is_sidechain", "root", "relative_path", "first_run_id", "line_number", "source_file_id",
        )
        order = F.struct(
            F.coalesce("output_tokens", F.lit(-(1 << 62))), -F.col("is_sidechain"), F.col("timestamp_utc").isNotNull(), -ms("timestamp_utc"),
            "root", "relative_path", "first_run_id", "line_number", "raw_line_id",
        )
        return self._base("requests-dedup", lambda: latest_by(rows, ["dedup_key"], order), "requests", "parsed_lines", "raw_lines")

    def v01_requests_dedup(self) -> DataFrame:
        return self.requests_dedup.drop("service_tier", "inference_geo", "source_file_id")

    @cached_property
    def readings(self) -> DataFrame:
        """Valid window values of decoded readings; capture times in milliseconds, also where they were written so."""
        s = self.table("status_readings").filter("status = 'ok'").select("raw_line_id", "session_id", "captured_at_s")
        captured = F.round(F.when(F.col("captured_at_s") > 1e11, F.col("captured_at_s")).otherwise(F.col("captured_at_s") * 1000)).cast("bigint")
        w = self.table("rate_limit_windows").filter(F.col("validity") == "valid").filter(F.col("window_name").isin(*WINDOW_SECONDS))
        rows = w.join(s.withColumn("cap", captured).drop("captured_at_s"), "raw_line_id")
        return rows.select("raw_line_id", "window_name", "resets_at", F.round(F.col("resets_at") * 1000).cast("bigint").alias("reset"), "used_percentage", "session_id", "cap")

    @cached_property
    def window_readings(self) -> DataFrame:
        """V2: one row per observation of a window (columns as in V2, times as `observed`, `cap`, `reset` in ms beside)."""
        return self._base("window-readings", self._window_readings, "requests", "parsed_lines", "raw_lines", "status_readings", "rate_limit_windows")

    def _window_readings(self) -> DataFrame:
        lines = self.request_lines.filter("timestamp_utc is not null").select(
            "session_id", ms("timestamp_utc").alias("t"), "raw_line_id", F.coalesce("dedup_key", F.concat(F.lit("line:"), F.col("raw_line_id").cast("string"))).alias("response")
        )
        found = asof_backward(
            self.readings, lines, ["session_id"], F.col("cap") + 1000, F.col("t"), F.col("raw_line_id"), ["t", "response"], strict=True, prefix="m_", bucket=DAY_MS
        )
        inside = F.col("m_t") > F.col("reset") - length_s(F.col("window_name")) * 1000
        found = found.withColumn("response", F.when(inside, F.col("m_response"))).drop("m_t", "m_response")
        firsts = lines.groupBy("response").agg(F.min("t").alias("first_line"))
        dated = found.join(firsts, "response", "left")
        group = F.coalesce("response", F.concat(F.lit("capture:"), F.col("raw_line_id").cast("string")))
        keys = ["window_name", "reset", "session_id", "g"]
        runs = run_ids(dated.withColumn("g", group), keys, [F.col("cap"), F.col("raw_line_id")], F.abs(F.col("used_percentage") - F.col("_previous.used_percentage")) > 0.01)
        last = F.max_by(F.struct("raw_line_id", "resets_at", "used_percentage", "cap", "response", "first_line"), F.struct("cap", "raw_line_id"))
        kept = runs.groupBy(*keys, "run").agg(last.alias("k"), F.min("cap").alias("first_cap")).select("window_name", "reset", "session_id", "run", "first_cap", "k.*")
        observed = F.when(F.col("first_line").isNull(), F.col("cap")).when(F.col("run") == 1, F.col("first_line")).otherwise(F.col("first_cap"))
        via = F.when(F.col("response").isNull(), "capture").when(F.col("run") == 1, "last_request").otherwise("changed_capture")
        counted = kept.withColumns({"observed": observed, "observed_via": via}).withColumn("after_reset", (F.col("observed") > F.col("reset")).cast("int"))
        flagged = stale_flag(
            counted, ["window_name", "reset"], F.floor(F.col("observed") / HOUR_MS), [F.col("observed"), F.col("raw_line_id")], "used_percentage", 1, only=F.col("after_reset") == 0
        )
        return flagged.select(
            "raw_line_id", "window_name", "resets_at", at("reset").alias("reset_at_utc"), "used_percentage", "session_id", at("cap").alias("captured_at_utc"),
            at("observed").alias("observed_at_utc"), "observed_via", "after_reset", "stale", "observed", "cap", "reset",
        )

    def v02_window_readings(self) -> DataFrame:
        return self.window_readings.drop("observed", "cap", "reset")

    def repositories(self) -> DataFrame:
        """What a resolver found for each working directory; here by rule, in production by sources.repositories."""
        cwds = self.table("parsed_lines").select("cwd").filter("cwd is not null and cwd not like '/mnt/%'").distinct()
        root = F.nullif(F.regexp_extract("cwd", "^(/.*?/code/[^/]+)", 1), F.lit(""))
        outside = F.col("cwd").startswith("/opt/")
        return cwds.select("cwd", F.when(~outside, root).alias("repo_root"), (~F.col("cwd").contains("-docs")).cast("int").alias("root_exists"), F.when(outside, "not_git").otherwise("repo").alias("kind"))

    @cached_property
    def request_repositories(self) -> DataFrame:
        """V3: each request's repository and its kind, after aliases (one hop)."""
        r = self.repositories()
        d = self.requests_dedup.select("raw_line_id", "cwd")
        kind = F.when(F.col("known").isNull(), "unresolved").when(F.col("repo_root").isNotNull() & (F.col("root_exists") == 1), "repo").when(F.col("repo_root").isNotNull(), "missing").otherwise(F.col("kind"))
        found = d.join(r.withColumn("known", F.lit(1)), "cwd", "left").select("raw_line_id", "cwd", kind.alias("repo_kind"), normal_path(F.coalesce("repo_root", "cwd")).alias("repository"))
        aliases = self.values(dim.ALIASES, dim.ALIAS_SCHEMA)
        kinds = found.join(F.broadcast(aliases.select(F.col("to_repository").alias("repository")).distinct()), "repository", "left_semi")  # entered by hand
        kinds = kinds.groupBy("repository").agg(F.min_by("repo_kind", F.struct(F.col("repo_kind") != "repo", "repo_kind")).alias("to_kind"))
        targets = aliases.join(F.broadcast(kinds.withColumnRenamed("repository", "to_repository")), "to_repository", "left")
        n = found.join(F.broadcast(targets), found["repository"] == targets["from_repository"], "left")
        moved = F.col("from_repository").isNotNull()
        return n.select(
            "raw_line_id", "cwd", F.when(moved, F.coalesce("to_kind", "repo_kind")).otherwise(F.col("repo_kind")).alias("repo_kind"),
            F.coalesce("to_repository", "repository").alias("repository"), F.when(moved, F.col("repository")).alias("aliased_from"),
        )

    def v03_request_repositories(self) -> DataFrame:
        return self.request_repositories

    @cached_property
    def request_costs(self) -> DataFrame:
        """V4: each response at list price, or the reason why it has none."""
        prices = scd_ranges(self.values(dim.PRICES, dim.PRICE_SCHEMA), ["model_id"], "effective_from", "effective_until")
        d = self.requests_dedup.withColumn("day_utc", F.date_format("timestamp_utc", "yyyy-MM-dd"))
        # Prices are a list entered by hand: the ranges make this an equi-join with a residual on one broadcast side.
        m = d.join(
            F.broadcast(prices), (F.col("model") == F.col("model_id")) & (F.col("day_utc") >= F.col("effective_from")) & (F.col("effective_until").isNull() | (F.col("day_utc") < F.col("effective_until"))), "left"
        )
        zero = lambda c: F.coalesce(c, F.lit(0))
        fast = F.coalesce(F.col("speed") == "fast", F.lit(False))
        rate = lambda name: F.when(fast, F.col(f"fast_{name}_rate")).otherwise(F.col(f"{name}_rate"))
        whole = F.col("input_tokens") + F.col("cache_read_tokens") + zero("cache_write_5m_tokens") + zero("cache_write_1h_tokens") + zero("cache_write_unsplit_tokens")
        reason = (
            F.when(F.col("timestamp_utc").isNull(), "unparsed_timestamp").when(F.col("model_id").isNull(), "no_price_row")
            .when(fast & F.col("fast_input_rate").isNull(), "fast_rate_unknown")
            .when(F.col("service_tier").isNotNull() & (F.col("service_tier") != "standard"), "service_tier_not_standard")
            .when(F.col("standard_max_input").isNotNull() & (whole > F.col("standard_max_input")), "long_context_rate_unverified")
        )
        m = m.withColumns({"unpriced_reason": reason, "_geo": F.when(F.col("inference_geo") == "us", 1.1).otherwise(1.0)})
        usd = lambda n, name: F.when(F.col("unpriced_reason").isNull(), n * rate(name) * F.col("_geo") / 1e6)
        parts = {
            "input_usd": usd(F.col("input_tokens"), "input"), "output_usd": usd(F.col("output_tokens"), "output"), "cache_read_usd": usd(F.col("cache_read_tokens"), "read"),
            "cache_write_5m_usd": usd(zero("cache_write_5m_tokens") + zero("cache_write_unsplit_tokens"), "write_5m"), "cache_write_1h_usd": usd(zero("cache_write_1h_tokens"), "write_1h"),
        }
        m = m.withColumns(parts)
        total = F.col("input_usd")
        for p in list(parts)[1:]:
            total = total + F.col(p)
        return m.select(
            "raw_line_id", "dedup_key", "model", "day_utc", "timestamp_utc", "speed", "service_tier", "inference_geo", *TOKENS, "unpriced_reason",
            F.col("effective_from").alias("price_effective_from"), "verified_on",
            F.when(F.col("unpriced_reason").isNull() & (F.col("cache_write_unsplit_tokens") > 0), 1).otherwise(0).alias("is_lower_bound"), *parts, total.alias("total_usd"),
        )

    def v04_request_costs(self) -> DataFrame:
        return rounded(self.request_costs, 9)

    def v05_unpriced_requests(self) -> DataFrame:
        return self.request_costs.filter("unpriced_reason is not null").select("raw_line_id", "dedup_key", "model", "day_utc", "speed", "service_tier", "unpriced_reason")

    @cached_property
    def source_coverage(self) -> DataFrame:
        """V6: the span of each source, a row even where there is nothing."""
        logs = self.table("parsed_lines").agg(F.min("timestamp_utc").alias("covers_from"), F.max("timestamp_utc").alias("covers_to")).select(F.lit("session_logs").alias("source"), "*")
        line = self.window_readings.agg(F.min("observed_at_utc").alias("covers_from"), F.max("observed_at_utc").alias("covers_to")).select(F.lit("status_line").alias("source"), "*")
        return stored(logs.unionByName(line), "coverage")

    def v06_source_coverage(self) -> DataFrame:
        return self.source_coverage

    def spanned(self, df: DataFrame, source: str = "session_logs", prefix: str = "") -> DataFrame:
        """df with the source's span: one row, joined to every row."""
        c = self.source_coverage.filter(F.col("source") == source).select(F.col("covers_from").alias(prefix + "covers_from"), F.col("covers_to").alias(prefix + "covers_to"))
        return df.crossJoin(F.broadcast(c))

    # --- limit hits -------------------------------------------------------------------------------------

    @cached_property
    def placed_lines(self) -> DataFrame:
        """Every parsed line with what orders copies: root, path, run, line number."""
        place_ = self.table("raw_lines").filter("kind = 'log'").select("raw_line_id", "root", "relative_path", "line_number")
        return self.table("parsed_lines").join(place_, "raw_line_id")

    _canonical = ("root", "relative_path", "first_run_id", "line_number", "raw_line_id")

    def distinct_lines(self, lines: DataFrame) -> DataFrame:
        """Of the copies of a uuid in a session the first; lines without uuid each by themselves."""
        keyed = lines.withColumn("_u", F.coalesce("uuid", F.concat(F.lit("line:"), F.col("raw_line_id").cast("string"))))
        return first_by(keyed, ["session_id", "_u"], [F.col(c) for c in self._canonical]).drop("_u")

    @cached_property
    def hit_lines(self) -> DataFrame:
        return stored(self.distinct_lines(self.placed_lines.filter("line_class = 'limit_hit'")), "hit-lines")

    @cached_property
    def limit_events(self) -> DataFrame:
        """What limit-hit lines say of window and reset; only these lines' bytes are parsed."""
        hits = self.table("parsed_lines").filter("line_class = 'limit_hit'").select("raw_line_id")
        raw = self.table("raw_lines").filter("kind = 'log'").join(hits, "raw_line_id", "left_semi")
        return derive.log_facts(raw, only=["text_window", "reset_text", "text_reset_at_utc", "quota_window", "quota_reset_at_utc"]).drop("first_run_id")

    @cached_property
    def logged_limit_hits(self) -> DataFrame:
        """V7: distinct logged hits with window, reset, and whether they came in mid task, past metadata attachments."""
        hits = self.hit_lines
        sessions = hits.select("session_id").distinct()
        nodes = self.distinct_lines(self.placed_lines.filter("uuid is not null").join(sessions, "session_id", "left_semi")).select("raw_line_id", "session_id", "uuid", "parent_uuid", "line_type", "user_content", "is_meta")
        nodes = stored(nodes, "hit-nodes")
        attached = self.table("raw_lines").filter("kind = 'log'").join(nodes.filter("line_type = 'attachment'").select("raw_line_id"), "raw_line_id", "left_semi")
        facts = derive.log_facts(attached, only=["attachment_type", "command_mode"]).drop("first_run_id")
        passes = F.col("attachment_type").isin(*dim.PASSED_ATTACHMENTS) | ((F.col("attachment_type") == "queued_command") & (F.col("command_mode") == "task-notification"))
        facts = facts.filter(passes).select("raw_line_id", F.lit(True).alias("_p"))
        up = nodes.select("session_id", F.col("uuid").alias("parent_uuid"), F.col("raw_line_id").alias("up"))
        steps = stored(
            nodes.join(up, ["session_id", "parent_uuid"], "left").join(facts, "raw_line_id", "left").select(F.col("raw_line_id").alias("node"), "up", F.coalesce("_p", F.lit(False)).alias("passes")), "steps"
        )
        starts = hits.select("raw_line_id", "session_id", "parent_uuid").join(up, ["session_id", "parent_uuid"], "left").select(F.col("raw_line_id").alias("start"), F.col("up").alias("at"))
        ends = walk(starts, steps, 50).join(nodes.select(F.col("raw_line_id").alias("stop"), "user_content", F.col("is_meta").alias("stop_meta")), "stop", "left")
        position = F.when(F.col("user_content") == "tool_result", "mid_task").when((F.col("user_content") == "prompt") & (F.col("stop_meta") == 0), "turn_start").otherwise("unknown")
        ends = ends.select(F.col("start").alias("raw_line_id"), position.alias("position"), F.col("passed").alias("attachments_passed"))
        named = lambda q, t: F.when(F.col(q).isNotNull(), "log_field").when(F.col(t).isNotNull(), "log_text")
        out = hits.drop("position").join(ends, "raw_line_id").join(self.limit_events, "raw_line_id").select(
            "raw_line_id", "session_id", "uuid", "parent_uuid", "timestamp_utc", "is_sidechain", F.coalesce("quota_window", "text_window").alias("window_name"), "reset_text",
            F.coalesce("quota_reset_at_utc", "text_reset_at_utc").alias("reset_at_utc"), "position", "attachments_passed",
            named("quota_window", "text_window").alias("window_source"), named("quota_reset_at_utc", "text_reset_at_utc").alias("reset_source"),
        )
        return stored(out, "logged-hits")

    def v07_logged_limit_hits(self) -> DataFrame:
        return self.logged_limit_hits

    @cached_property
    def status_limit_groups(self) -> DataFrame:
        """V8: the first counted reading at 100 % of each window instance, and how many there were."""
        full = self.window_readings.filter("used_percentage >= 100 and after_reset = 0")
        g = full.groupBy("window_name", "resets_at").agg(F.min_by(F.struct("raw_line_id", "session_id", "observed_at_utc", "reset"), F.struct("observed", "raw_line_id")).alias("f"), F.count("*").alias("readings_at_limit"))
        return g.select(
            "f.raw_line_id", "window_name", "resets_at", "f.session_id", "readings_at_limit", F.col("f.observed_at_utc").alias("first_at_utc"), at(F.col("f.reset")).alias("reset_at_utc"),
            length_s(F.col("window_name")).alias("window_seconds"), F.col("f.reset").alias("reset"),
        )

    def v08_status_limit_groups(self) -> DataFrame:
        return self.status_limit_groups.drop("reset")

    @cached_property
    def limit_hits(self) -> DataFrame:
        """V9: every interruption once, logged or seen only in readings, with what came next in its session."""
        groups = stored(self.status_limit_groups, "groups")
        g = groups.select(F.col("raw_line_id").alias("g_id"), F.col("window_name").alias("g_window"), F.col("reset").alias("g_reset"), F.col("reset_at_utc").alias("g_reset_at"), F.col("window_seconds"))
        logged = self.logged_limit_hits.withColumn("hit", ms("timestamp_utc"))
        inside = contained_in(logged.filter("hit is not null"), g, F.col("hit"), F.col("g_reset") - F.col("window_seconds") * 1000, F.col("g_reset"), DAY_MS, equal=[("window_name", "g_window")])
        first = inside.groupBy("raw_line_id").agg(F.min_by(F.struct("g_id", "g_window", "g_reset_at"), F.struct("g_reset", "g_window")).alias("g")).select("raw_line_id", "g.*")
        l = logged.join(first, "raw_line_id", "left")
        from_logs = l.select(
            F.lit("session_log").alias("source"), "raw_line_id", F.col("g_id").alias("status_raw_line_id"), "session_id", F.col("timestamp_utc").alias("hit_at_utc"),
            F.coalesce("window_name", "g_window").alias("window_name"), F.coalesce("g_reset_at", "reset_at_utc").alias("reset_at_utc"),
            F.when(F.col("g_id").isNotNull(), "status_line").otherwise(F.col("reset_source")).alias("reset_source"), "reset_text", "position", "is_sidechain", "attachments_passed",
        )
        rest = groups.join(first.select(F.col("g_id").alias("raw_line_id")), "raw_line_id", "left_anti")
        null = F.lit(None).cast("string")
        from_readings = rest.select(
            F.lit("status_line").alias("source"), "raw_line_id", F.col("raw_line_id").alias("status_raw_line_id"), "session_id", F.col("first_at_utc").alias("hit_at_utc"), "window_name", "reset_at_utc",
            F.lit("status_line").alias("reset_source"), null.alias("reset_text"), F.lit("unknown").alias("position"), F.lit(0).alias("is_sidechain"), F.lit(0).alias("attachments_passed"),
        )
        merged = stored(from_logs.unionByName(from_readings), "merged-hits")
        sessions = merged.select("session_id").distinct()
        requests = self.requests_dedup.filter("timestamp_utc is not null").select("session_id", "timestamp_utc", "raw_line_id").join(sessions, "session_id", "left_semi")
        prompts = self.table("parsed_lines").filter("user_content = 'prompt' and is_meta = 0 and timestamp_utc is not null").select("session_id", "timestamp_utc", "raw_line_id", "origin_kind").join(sessions, "session_id", "left_semi")
        t = asof_forward(merged, requests, ["session_id"], ms("hit_at_utc"), ms("timestamp_utc"), F.col("raw_line_id"), ["timestamp_utc"], prefix="next_request_")
        t = asof_forward(t, prompts, ["session_id"], ms("hit_at_utc"), ms("timestamp_utc"), F.col("raw_line_id"), ["timestamp_utc", "origin_kind"], prefix="next_prompt_")
        end = self.source_coverage.filter("source = 'session_logs'").select(F.col("covers_to").alias("_end"))
        out = t.crossJoin(F.broadcast(end)).select(
            *merged.columns, seconds_between(F.col("reset_at_utc"), F.col("hit_at_utc")).alias("hit_to_reset_seconds"), F.col("next_request_timestamp_utc").alias("next_session_request_at_utc"),
            F.col("next_prompt_timestamp_utc").alias("next_session_prompt_at_utc"), F.col("next_prompt_origin_kind").alias("next_session_prompt_origin_kind"), (F.col("reset_at_utc") > F.col("_end")).alias("reset_after_coverage"),
        )
        return stored(out, "limit-hits")

    def v09_limit_hits_events(self) -> DataFrame:
        return self.limit_hits

    def v10_limit_hits(self) -> DataFrame:
        w = F.col("window_name")
        one = self.limit_hits.agg(
            F.count("*").alias("hits"), F.count_if(F.col("source") == "session_log").alias("logged_hits"), F.count_if(F.col("source") == "status_line").alias("status_line_only_hits"),
            F.count_if(w == "five_hour").alias("five_hour_hits"), F.count_if(w == "seven_day").alias("seven_day_hits"), F.count_if(w.isNull()).alias("unknown_window_hits"),
        )
        return self.spanned(self.spanned(one), "status_line", "status_line_")

    def v11_mid_task_events(self) -> DataFrame:
        return self.limit_hits.filter("position = 'mid_task'")

    def v12_mid_task(self) -> DataFrame:
        p = F.col("position")
        return self.spanned(self.limit_hits.agg(F.count_if(p == "mid_task").alias("mid_task"), F.count_if(p == "turn_start").alias("turn_start"), F.count_if(p == "unknown").alias("position_unknown")))

    @cached_property
    def lockout_hits(self) -> DataFrame:
        """The merged lockout interval of each hit with known times."""
        spans = self.limit_hits.filter("hit_at_utc is not null and reset_at_utc is not null").select("raw_line_id", F.col("hit_at_utc").alias("start_utc"), F.greatest("reset_at_utc", "hit_at_utc").alias("end_utc"))
        return stored(merge_intervals(spans, "start_utc", "end_utc", "raw_line_id"), "lockout-hits")

    def v13_lockout_interval_hits(self) -> DataFrame:
        return self.lockout_hits

    @cached_property
    def continuation_marks(self) -> DataFrame:
        """Each line a client wrote on going on by itself, with the latest hit before it in its session."""
        marks = self.distinct_lines(self.placed_lines.filter((F.col("origin_kind") == dim.CONTINUATION) & (F.col("is_meta") == 1) & F.col("timestamp_utc").isNotNull()))
        marks = marks.select("raw_line_id", "session_id", F.col("timestamp_utc").alias("continued_at_utc"))
        hits = self.hit_lines.filter("timestamp_utc is not null").select("session_id", "timestamp_utc", "raw_line_id")
        return asof_backward(marks, hits, ["session_id"], ms("continued_at_utc"), ms("timestamp_utc"), F.col("raw_line_id"), ["raw_line_id"], strict=True, prefix="hit_")

    def v14_auto_continuation_marks(self) -> DataFrame:
        return self.continuation_marks

    @cached_property
    def lockout_intervals(self) -> DataFrame:
        """Lockouts from first hit to last reset, with the next request anywhere and how sessions went on."""
        marks = self.continuation_marks.filter("hit_raw_line_id is not null").groupBy(F.col("hit_raw_line_id").alias("raw_line_id")).agg(F.count("*").alias("marks"), F.min("continued_at_utc").alias("first_mark"))
        p = self.table("parsed_lines").select("raw_line_id", F.col("session_id").alias("p_session"), F.lit(1).alias("logged"))
        s = self.table("status_readings").select("raw_line_id", F.col("session_id").alias("s_session"))
        members = self.lockout_hits.join(p, "raw_line_id", "left").join(s, "raw_line_id", "left").join(marks, "raw_line_id", "left")
        g = members.groupBy("interval_number").agg(
            F.min("start_utc").alias("locked_from_utc"), F.max("end_utc").alias("locked_until_utc"), F.count("*").alias("hits"), F.count_distinct(F.coalesce("p_session", "s_session")).alias("sessions"),
            F.count("logged").alias("refused_requests"), F.coalesce(F.sum("marks"), F.lit(0)).alias("auto_continuations"), F.min("first_mark").alias("first_mark"),
        ).withColumn("_all", F.lit(0))
        requests = self.requests_dedup.filter("timestamp_utc is not null").select(F.lit(0).alias("_all"), "timestamp_utc", "raw_line_id")
        # One key for all: minutes as buckets, so a window holds one minute of all requests and the carrying one a row a minute.
        g = asof_forward(g, requests, ["_all"], ms("locked_until_utc"), ms("timestamp_utc"), F.col("raw_line_id"), ["timestamp_utc"], strict=False, prefix="next_", bucket=60_000)
        end = self.source_coverage.filter("source = 'session_logs'").select(F.col("covers_to").alias("_end"))
        until = F.col("locked_until_utc")
        out = g.crossJoin(F.broadcast(end)).select(
            "interval_number", "locked_from_utc", "locked_until_utc", "hits", F.col("next_timestamp_utc").alias("next_request_at_utc"), seconds_between(until, F.col("locked_from_utc")).alias("lockout_seconds"),
            seconds_between(F.col("next_timestamp_utc"), until).alias("reset_to_next_request_seconds"), (until > F.col("_end")).alias("reset_after_coverage"), "auto_continuations",
            seconds_between(F.col("first_mark"), until).alias("first_auto_continuation_seconds"), "sessions", "refused_requests",
        )
        return stored(out, "lockouts")

    def v15_lockout_intervals(self) -> DataFrame:
        return self.lockout_intervals

    def v16_lockout_time(self) -> DataFrame:
        a = self.lockout_intervals.agg(F.count("*").alias("intervals"), F.coalesce(F.sum("lockout_seconds"), F.lit(0.0)).alias("lockout_seconds"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits_with_known_reset"))
        b = self.limit_hits.agg(F.count_if(F.col("reset_at_utc").isNull() | F.col("hit_at_utc").isNull()).alias("hits_with_unknown_reset"))
        return rounded(self.spanned(a.crossJoin(F.broadcast(b))), 6)

    def v17_auto_continuation_events(self) -> DataFrame:
        until = self.lockout_intervals.select("interval_number", "locked_until_utc")
        h = self.lockout_hits.select(F.col("raw_line_id").alias("hit_raw_line_id"), "interval_number")
        return self.continuation_marks.join(h, "hit_raw_line_id").join(until, "interval_number").select(
            "raw_line_id", "session_id", "continued_at_utc", "hit_raw_line_id", "interval_number", "locked_until_utc", seconds_between(F.col("continued_at_utc"), F.col("locked_until_utc")).alias("seconds_after_reset")
        )

    @cached_property
    def sessions_not_resumed(self) -> DataFrame:
        """Sessions without a request after their last hit."""
        e = self.limit_hits.filter("session_id is not null and session_id <> '<missing>' and hit_at_utc is not null")
        last = e.groupBy("session_id").agg(F.max_by(F.struct("raw_line_id", "hit_at_utc", "reset_at_utc", "reset_after_coverage"), F.struct("hit_at_utc", "raw_line_id")).alias("h"), F.count("*").alias("hits"))
        latest = self.requests_dedup.join(e.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.max("timestamp_utc").alias("_latest"))
        j = last.join(latest, "session_id", "left").filter(F.col("_latest").isNull() | (F.col("_latest") <= F.col("h.hit_at_utc")))
        return j.select("session_id", F.col("h.raw_line_id").alias("last_hit_raw_line_id"), F.col("h.hit_at_utc").alias("last_hit_at_utc"), "h.reset_at_utc", "h.reset_after_coverage", "hits")

    def v18_sessions_not_resumed_events(self) -> DataFrame:
        return self.sessions_not_resumed

    def v19_sessions_not_resumed(self) -> DataFrame:
        e = self.limit_hits.filter("session_id is not null and session_id <> '<missing>' and hit_at_utc is not null").agg(F.count_distinct("session_id").alias("sessions_with_hits"))
        n = self.sessions_not_resumed.agg(F.count("*").alias("sessions_not_resumed"), F.count_if("reset_after_coverage").alias("reset_after_coverage"), F.count_if(F.col("reset_at_utc").isNull()).alias("reset_unknown"))
        return self.spanned(e.crossJoin(F.broadcast(n)))

    # --- windows ----------------------------------------------------------------------------------------

    @cached_property
    def window_instances(self) -> DataFrame:
        """Each window instance with its readings and whether later usage may still come."""
        counted = F.col("after_reset") == 0
        g = self.window_readings.groupBy("window_name", "resets_at").agg(
            F.min("reset_at_utc").alias("reset_at_utc"), F.min("reset").alias("reset"), F.count_if(counted).alias("readings"), F.count_if(~counted).alias("readings_after_reset"),
            F.min(F.when(counted, F.col("observed_at_utc"))).alias("first_reading_at_utc"), F.count_if(counted & (F.col("stale") == 1)).alias("readings_stale"),
        )
        s = self.table("status_readings").filter("status = 'ok'")
        latest = s.agg(F.max(F.when(F.col("captured_at_s") > 1e11, F.col("captured_at_s") / 1000).otherwise(F.col("captured_at_s"))).alias("_latest"))
        g = g.crossJoin(F.broadcast(latest)).withColumn("window_open", F.col("resets_at") > F.col("_latest")).drop("_latest")
        return stored(self.spanned(g, "status_line"), "instances")

    def v20_window_instances(self) -> DataFrame:
        return self.window_instances.drop("reset")

    @cached_property
    def window_headroom(self) -> DataFrame:
        """The last counted, not stale reading of each instance."""
        last = self.window_readings.filter("after_reset = 0 and stale = 0").groupBy("window_name", "resets_at").agg(F.max_by(F.struct("used_percentage", "observed_at_utc", "raw_line_id", "observed"), F.struct("observed", "raw_line_id")).alias("l"))
        return self.window_instances.join(last, ["window_name", "resets_at"], "left").select(
            "window_name", "reset_at_utc", F.col("l.used_percentage").alias("last_used_percentage"), F.col("l.observed_at_utc").alias("last_reading_at_utc"), F.col("l.raw_line_id").alias("last_reading_raw_line_id"),
            "readings", "readings_after_reset", "first_reading_at_utc", "window_open", "covers_from", "covers_to", "readings_stale", "reset", F.col("l.observed").alias("_last"),
        )

    def v21_window_headroom(self) -> DataFrame:
        return self.window_headroom.drop("reset", "_last")

    @cached_property
    def window_peak(self) -> DataFrame:
        """The highest counted reading of each instance, the earliest among equals."""
        top = self.window_readings.filter("after_reset = 0").groupBy("window_name", "resets_at").agg(F.max_by(F.struct("used_percentage", "observed_at_utc", "raw_line_id"), F.struct("used_percentage", -F.col("observed"), -F.col("raw_line_id"))).alias("p"))
        return self.window_instances.join(top, ["window_name", "resets_at"], "left").select(
            "window_name", "reset_at_utc", F.col("p.used_percentage").alias("peak_used_percentage"), F.col("p.observed_at_utc").alias("peak_reading_at_utc"), F.col("p.raw_line_id").alias("peak_reading_raw_line_id"),
            "readings", "readings_after_reset", "window_open", "covers_from", "covers_to",
        )

    def v22_window_peak(self) -> DataFrame:
        return self.window_peak

    def crossings(self, window: str, levels: tuple[float, ...]) -> DataFrame:
        """The first counted reading at or above each level."""
        r = self.window_readings.filter((F.col("window_name") == window) & (F.col("after_reset") == 0)).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in levels]))).filter("used_percentage >= threshold")
        g = r.groupBy("window_name", "reset", "threshold").agg(F.min_by(F.struct("observed_at_utc", "used_percentage", "raw_line_id", "observed", "reset_at_utc"), F.struct("observed", "raw_line_id")).alias("f"))
        return g.select("window_name", "f.reset_at_utc", "threshold", F.col("f.observed_at_utc").alias("first_at_utc"), "f.used_percentage", ((F.col("reset") - F.col("f.observed")) / 1000.0).alias("seconds_before_reset"), "f.raw_line_id")

    def v23_weekly_crossings(self) -> DataFrame:
        return self.crossings("seven_day", (75, 90))

    def v23b_five_hour_crossings(self) -> DataFrame:
        return self.crossings("five_hour", (75, 90))

    @cached_property
    def reading_pairs(self) -> DataFrame:
        """Consecutive counted, not stale readings: the change, and the distinct responses in between."""
        r = self.window_readings.filter("after_reset = 0 and stale = 0")
        pairs = consecutive(r, ["window_name", "reset"], [F.col("observed"), F.col("raw_line_id")], {"raw_line_id": "previous_raw_line_id", "used_percentage": "_pu", "observed_at_utc": "previous_observed_at_utc", "observed": "_po"}, F.floor(F.col("observed") / DAY_MS))
        pairs = pairs.withColumn("_id", F.concat_ws("/", "window_name", F.col("reset").cast("string"), F.col("raw_line_id").cast("string")))
        pairs = stored(pairs, "pairs")
        facts = self.request_lines.filter("timestamp_utc is not null").select(ms("timestamp_utc").alias("t"), F.coalesce("dedup_key", F.concat(F.lit("line:"), F.col("raw_line_id").cast("string"))).alias("response"))
        n = range_count_distinct(pairs, facts, "_id", F.col("_po"), F.col("observed") + 1000, F.col("t"), "response", 600_000, "n")
        return stored(pairs.join(n, "_id", "left").select(
            "window_name", "reset_at_utc", "previous_raw_line_id", "raw_line_id", "previous_observed_at_utc", "observed_at_utc", (F.col("used_percentage") - F.col("_pu")).alias("change_percentage_points"),
            F.coalesce("n", F.lit(0)).alias("requests_between"),
        ), "reading-pairs")

    def v24_window_reading_pairs(self) -> DataFrame:
        return rounded(self.reading_pairs, 9)

    def v25_unattributed_usage_events(self) -> DataFrame:
        return rounded(self.reading_pairs.filter("requests_between = 0 and change_percentage_points > 0"), 9)

    @cached_property
    def unattributed_usage(self) -> DataFrame:
        """Per instance the points that rose without a response in between; null under two readings."""
        c, none = F.col("change_percentage_points"), F.col("requests_between") == 0
        g = self.reading_pairs.groupBy("window_name", "reset_at_utc").agg(
            F.count("*").alias("pairs"), F.count_if(none).alias("pairs_without_requests"), F.count_if(c < 0).alias("decreasing_pairs"), F.sum(F.when(none & (c > 0), c)).alias("_points")
        )
        zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
        return self.window_instances.join(g, ["window_name", "reset_at_utc"], "left").select(
            "window_name", "reset_at_utc", "readings", zero("pairs"), zero("pairs_without_requests"), zero("decreasing_pairs"),
            F.when(F.col("readings") >= 2, F.coalesce("_points", F.lit(0.0))).alias("unattributed_percentage_points"), "window_open", "covers_from", "covers_to",
        )

    def v26_unattributed_usage(self) -> DataFrame:
        return rounded(self.unattributed_usage, 6)

    # --- usage ------------------------------------------------------------------------------------------

    def machine_files(self) -> DataFrame:
        """Files of other machines, by their root."""
        m = self.values(dim.MACHINES, dim.MACHINE_SCHEMA)
        return self.table("source_files").select("source_file_id", "root").join(F.broadcast(m.select("root", "machine_id")), "root").drop("root")  # entered by hand

    @cached_property
    def usage_events(self) -> DataFrame:
        """Each response with its repository; other machines' under their own kind."""
        own = F.col("machine_id").isNull()
        r = self.request_repositories.drop("cwd")
        return self.requests_dedup.join(r, "raw_line_id").join(self.machine_files(), "source_file_id", "left").select(
            "raw_line_id", "dedup_key", "session_id", "timestamp_utc", "model", F.when(own, F.col("repository")).alias("repository"), F.when(own, F.col("repo_kind")).otherwise("other_machine").alias("repo_kind"),
            *TOKENS, F.when(own, F.col("aliased_from")).alias("aliased_from"),
        )

    def v27_usage_events(self) -> DataFrame:
        return self.usage_events

    def _sums(self) -> list[Column]:
        return [F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in TOKENS[:-1]], F.coalesce(F.sum(TOKENS[-1]), F.lit(0)).alias(TOKENS[-1])]

    def v28_usage_by_model(self) -> DataFrame:
        t = F.col("timestamp_utc")
        return self.spanned(self.usage_events.groupBy("model").agg(*self._sums(), F.count_if(F.col("dedup_key").isNull()).alias("unkeyed_requests"), F.count_if(t.isNull()).alias("requests_without_timestamp"), F.min(t).alias("first_request_at_utc"), F.max(t).alias("last_request_at_utc")))

    def v29_usage_by_repo(self) -> DataFrame:
        return self.spanned(self.usage_events.groupBy("repository", "repo_kind").agg(*self._sums(), F.count_if(F.col("timestamp_utc").isNull()).alias("requests_without_timestamp")))

    @cached_property
    def plan_periods(self) -> DataFrame:
        """Each plan's months, until the next one's."""
        p = lead_periods(self.values(dim.PLANS, dim.PLAN_SCHEMA), "effective_month", "until_month")
        return p.select(F.col("effective_month").alias("from_month"), "until_month", "plan_name")

    def v30_plan_periods(self) -> DataFrame:
        return self.plan_periods

    @cached_property
    def hits_by_plan(self) -> DataFrame:
        """Each hit in the plan period of its local month."""
        e = place(self.limit_hits, self.plan_periods, local_month(F.col("hit_at_utc"), dim.ZONE), "from_month", "until_month")
        kind = F.when(F.col("hit_at_utc").isNull(), "unknown").when(F.col("from_month").isNull(), "none").otherwise("plan")
        return e.select("raw_line_id", "session_id", "hit_at_utc", "window_name", "source", kind.alias("period_kind"), "from_month", "until_month", "plan_name")

    def v31_limit_hits_by_plan_events(self) -> DataFrame:
        return self.hits_by_plan

    @cached_property
    def lockouts_by_plan(self) -> DataFrame:
        """Each lockout in the period in which it began."""
        e = place(self.lockout_intervals, self.plan_periods, local_month(F.col("locked_from_utc"), dim.ZONE), "from_month", "until_month")
        return e.withColumn("period_kind", F.when(F.col("from_month").isNull(), "none").otherwise("plan"))

    def v32_lockout_by_plan_events(self) -> DataFrame:
        return self.lockouts_by_plan

    def v33_interruptions_by_plan(self) -> DataFrame:
        p, none = self.plan_periods, lambda t="string": F.lit(None).cast(t)
        first = p.agg(F.min("from_month").alias("until_month")).select(F.lit("none").alias("period_kind"), none().alias("from_month"), "until_month", none().alias("plan_name"))
        lost = first.select(F.lit("unknown").alias("period_kind"), none().alias("from_month"), none().alias("until_month"), none().alias("plan_name"))
        periods = p.select(F.lit("plan").alias("period_kind"), "*").unionByName(first).unionByName(lost)
        w = F.col("window_name")
        hits = self.hits_by_plan.groupBy("period_kind", "from_month").agg(F.count("*").alias("hits"), F.count_if(w == "five_hour").alias("five_hour_hits"), F.count_if(w == "seven_day").alias("seven_day_hits"), F.count_if(w.isNull()).alias("unknown_window_hits"))
        locks = self.lockouts_by_plan.groupBy("period_kind", "from_month").agg(F.count("*").alias("lockouts"), F.sum("lockout_seconds").alias("lockout_seconds"))
        # Spans by month first: as many rows as there are months.
        times = self.requests_dedup.select(F.col("timestamp_utc").alias("t")).unionByName(self.limit_hits.select(F.col("hit_at_utc").alias("t"))).filter("t is not null")
        months = times.groupBy(local_month(F.col("t"), dim.ZONE).alias("month")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
        placed = place(months, p, F.col("month"), "from_month", "until_month")
        spans = placed.groupBy(F.when(F.col("from_month").isNull(), "none").otherwise("plan").alias("period_kind"), "from_month").agg(F.min("t0").alias("covers_from"), F.max("t1").alias("covers_to"))
        out = periods
        for side in (hits, locks, spans):
            s = side.withColumnsRenamed({"period_kind": "_k", "from_month": "_m"})
            out = out.join(s, (F.col("period_kind") == F.col("_k")) & F.col("from_month").eqNullSafe(F.col("_m")), "left").drop("_k", "_m")
        zero = lambda c, v=0: F.coalesce(c, F.lit(v)).alias(c)
        to_month = F.date_format(F.add_months(F.to_date(F.concat("until_month", F.lit("-01"))), -1), "yyyy-MM")
        return out.select(
            "period_kind", "from_month", to_month.alias("to_month"), "until_month", "plan_name", zero("hits"), zero("five_hour_hits"), zero("seven_day_hits"), zero("unknown_window_hits"),
            zero("lockouts"), F.round(F.coalesce("lockout_seconds", F.lit(0.0)), 6).alias("lockout_seconds"), "covers_from", "covers_to",
        ).filter("hits > 0 or covers_from is not null")

    # --- projections ------------------------------------------------------------------------------------

    @cached_property
    def burn_rate(self) -> DataFrame:
        """When each window's limit would be reached at its mean rate since the window began."""
        h = self.window_headroom.withColumn("_start", F.col("reset") - length_s(F.col("window_name")) * 1000)
        used, since = F.col("last_used_percentage"), F.col("_last") - F.col("_start")
        known = since > 0
        limit = F.col("_start") + since * 100.0 / F.when(used > 0, used)
        some = known & (used > 0) & (used < 100)
        return h.select(
            "window_name", "reset_at_utc", at("_start").alias("window_start_utc"), "last_used_percentage", "last_reading_at_utc", "window_open", (used >= 100).alias("limit_reached"),
            F.when(known, used * HOUR_MS / since).alias("projected_percentage_points_per_hour"), F.when(some, at(F.floor(limit + 0.5).cast("bigint"))).alias("projected_limit_at_utc"),
            F.when(some, limit < F.col("reset")).alias("projected_limit_before_reset"), "covers_from", "covers_to",
        )

    def v34_burn_rate(self) -> DataFrame:
        return rounded(self.burn_rate, 6)

    @cached_property
    def list_price_by_month(self) -> DataFrame:
        """List price by local month beside the plan then in force; null where nothing was priced."""
        c = self.request_costs.filter("timestamp_utc is not null").withColumn("month", local_month(F.col("timestamp_utc"), dim.ZONE))
        priced = F.col("unpriced_reason").isNull()
        m = c.groupBy("month").agg(
            F.count("*").alias("requests"), F.count_if(priced).alias("priced_requests"), F.count_if(~priced).alias("unpriced_requests"), F.count_if(F.col("is_lower_bound") == 1).alias("lower_bound_requests"),
            F.count_if(priced & (F.col("day_utc") < F.col("verified_on"))).alias("priced_before_verified_requests"), F.max("verified_on").alias("verified_on"),
            F.sum("total_usd").alias("_usd"), F.min("timestamp_utc").alias("covers_from"), F.max("timestamp_utc").alias("covers_to"),
        )
        plans = lead_periods(self.values(dim.PLANS, dim.PLAN_SCHEMA), "effective_month", "_until").withColumnRenamed("usd_per_month", "plan_usd_per_month")
        p = place(m, plans, F.col("month"), "effective_month", "_until")
        return p.select(*m.columns[:7], F.when(F.col("priced_requests") > 0, F.col("_usd")).alias("api_list_price_usd"), "plan_name", "plan_usd_per_month", "covers_from", "covers_to")

    def v35_api_list_price(self) -> DataFrame:
        return rounded(self.list_price_by_month, 6)

    # --- machines ---------------------------------------------------------------------------------------

    def v36_line_machines(self) -> DataFrame:
        return self.table("raw_lines").select("raw_line_id", "source_file_id").join(self.machine_files(), "source_file_id", "left").select("raw_line_id", "machine_id")

    @cached_property
    def latest_week(self) -> DataFrame:
        """The latest weekly window: one row, of nulls if there is none."""
        w = self.window_instances.filter("window_name = 'seven_day'").agg(F.max("reset_at_utc").alias("reset_at_utc"))
        return w.select((F.col("reset_at_utc") - F.expr("interval 7 days")).alias("starts_at_utc"), "reset_at_utc")

    def v37_latest_weekly_window(self) -> DataFrame:
        return self.latest_week

    @cached_property
    def machine_requests(self) -> DataFrame:
        """Each response with the machine that recorded it."""
        m = self.values(dim.MACHINES, dim.MACHINE_SCHEMA).select("machine_id", "label")
        d = self.requests_dedup.join(self.machine_files(), "source_file_id", "left").join(F.broadcast(m), "machine_id", "left").crossJoin(F.broadcast(self.latest_week))
        own, zero, t = F.col("machine_id").isNull(), lambda c: F.coalesce(c, F.lit(0)), F.col("timestamp_utc")
        return d.select(
            "raw_line_id", "dedup_key", "timestamp_utc", "model", F.coalesce("machine_id", F.lit(dim.THIS_MACHINE[0])).alias("machine_id"),
            F.coalesce(F.when(own, dim.THIS_MACHINE[1]), "label", F.lit("Unnamed machine")).alias("machine_label"), own.alias("is_this_machine"), "input_tokens", "output_tokens", "cache_read_tokens",
            (zero("cache_write_5m_tokens") + zero("cache_write_1h_tokens") + zero("cache_write_unsplit_tokens")).alias("cache_write_tokens"),
            F.coalesce((t >= F.col("starts_at_utc")) & (t < F.col("reset_at_utc")), F.lit(False)).alias("in_latest_week"),
        )

    def v38_machine_requests(self) -> DataFrame:
        return self.machine_requests

    def v39_usage_by_machine(self) -> DataFrame:
        week = F.col("in_latest_week")
        g = self.machine_requests.groupBy("machine_id", "machine_label").agg(
            F.max("is_this_machine").alias("is_this_machine"), F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")],
            F.count_if(week).alias("week_requests"), F.coalesce(F.sum(F.when(week, F.col("output_tokens"))), F.lit(0)).alias("week_output_tokens"), F.min("timestamp_utc").alias("covers_from"), F.max("timestamp_utc").alias("covers_to"),
        )
        m = self.values(dim.MACHINES, dim.MACHINE_SCHEMA).select("machine_id", F.col("exported_at").alias("last_export_at_utc"))
        return g.join(F.broadcast(m), "machine_id", "left").crossJoin(F.broadcast(self.latest_week.withColumnsRenamed({"starts_at_utc": "week_starts_at_utc", "reset_at_utc": "week_reset_at_utc"})))

    @cached_property
    def list_price_by_machine(self) -> DataFrame:
        """List price of each machine's requests and its share of all recorded."""
        c = self.request_costs.select("raw_line_id", "total_usd", "unpriced_reason")
        total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
        g = self.machine_requests.join(c, "raw_line_id").groupBy("machine_id", "machine_label").agg(
            F.max("is_this_machine").alias("is_this_machine"), total("total_usd").alias("list_price_usd"), total(F.when(F.col("in_latest_week"), F.col("total_usd"))).alias("week_list_price_usd"),
            F.count_if(F.col("unpriced_reason").isNotNull()).alias("unpriced_requests"), F.min("timestamp_utc").alias("covers_from"), F.max("timestamp_utc").alias("covers_to"),
        )
        every = g.agg(F.sum("list_price_usd").alias("_all"), F.sum("week_list_price_usd").alias("_week"))
        share = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
        return g.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(self.latest_week)).select(
            *g.columns, share("list_price_usd", "_all").alias("share_of_recorded"), share("week_list_price_usd", "_week").alias("week_share_of_recorded"), F.col("starts_at_utc").alias("week_starts_at_utc"), F.col("reset_at_utc").alias("week_reset_at_utc"),
        )

    def v40_api_list_price_by_machine(self) -> DataFrame:
        return rounded(self.list_price_by_machine, 6)


def normal_path(c: Column) -> Column:
    """A Windows path with an upper-case drive and forward slashes; any other path as it is."""
    return F.when(c.rlike(r"^[A-Za-z]:[\\/]"), F.concat(F.upper(F.substring(c, 1, 1)), F.translate(F.substring(c, 2, 1 << 30), "\\", "/"))).otherwise(c)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """df with its computed doubles rounded, for comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in ("resets_at",) else F.col(c) for c, t in df.dtypes])


VIEWS = sorted(n for n in vars(Telemetry) if n[0] == "v" and n[1:3].isdigit())
QUERIES = {n: (lambda spark, d, n=n: getattr(Telemetry(spark, d), n)()) for n in VIEWS}
