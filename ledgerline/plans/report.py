"""Reports over the views: loaders, explanations that re-add every number, verification, page data, results by file."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import contained_in
from ..operators.lineage import agreement, differences, ordered_ids, resum
from ..runtime import stored
from ..sources import derive
from . import dimensions as dim
from .views import DAY_MS, TOKENS, Telemetry, length_s, ms

CLASSES = "malformed limit_hit api_error synthetic_other request retry_notice model_fallback ignored_type".split()


def joined(ids: Column) -> Column:
    """An array of ids as text; empty for none."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


class Reports(Telemetry):
    """What users ask for, each as DataFrames."""

    # --- R1, R2: everything a report shows ----------------------------------------------------------------

    def observed(self, reported_at: datetime | None = None) -> dict[str, DataFrame]:
        """The observed frames, ordered; a window is open at the report only until its reset."""
        return {
            "limit_hits": self.v10_limit_hits(), "mid_task": self.v12_mid_task(), "lockout": self.v16_lockout_time(), "lockout_intervals": self.lockout_intervals.orderBy("interval_number"),
            "interruptions_by_plan": self.v33_interruptions_by_plan().orderBy(F.when(F.col("period_kind") == "none", 0).when(F.col("period_kind") == "plan", 1).otherwise(2), "from_month"),
            "not_resumed": self.v19_sessions_not_resumed(), "windows": self.windows(reported_at).orderBy(F.desc("open_at_report"), F.desc("reset_at_utc"), "window_name"),
            "weekly_crossings": self.v23_weekly_crossings().orderBy(F.desc("reset_at_utc"), "threshold"), "by_model": self.v28_usage_by_model().orderBy(F.desc("output_tokens"), "model"),
            "by_repo": self.v29_usage_by_repo().orderBy(F.desc("output_tokens"), F.asc_nulls_first("repository")), "repository_aliases": self.values(dim.ALIASES, dim.ALIAS_SCHEMA).orderBy("from_repository"),
            "by_machine": self.v39_usage_by_machine().orderBy(F.desc("is_this_machine"), F.desc("requests"), "machine_label"),
        }

    def projected(self, reported_at: datetime | None = None) -> dict[str, DataFrame]:
        return {
            "burn_rate": self._open_at(self.v34_burn_rate(), reported_at).orderBy(F.desc("open_at_report"), F.desc("reset_at_utc"), "window_name"), "api_list_price": self.v35_api_list_price().orderBy("month"),
            "rate_readings": self.rate_readings().orderBy("verified_on"), "api_list_price_by_machine": self.v40_api_list_price_by_machine().orderBy(F.desc("is_this_machine"), F.desc("list_price_usd"), "machine_label"),
        }

    def _open_at(self, df: DataFrame, reported_at: datetime | None) -> DataFrame:
        still = F.lit(True) if reported_at is None else F.col("reset_at_utc") > F.lit(reported_at).cast("timestamp_ntz")
        return df.withColumn("open_at_report", F.col("window_open") & still)

    def windows(self, reported_at: datetime | None = None) -> DataFrame:
        """Headroom and peak of each window instance side by side."""
        p = self.window_peak.select("window_name", "reset_at_utc", "peak_used_percentage", "peak_reading_at_utc", "peak_reading_raw_line_id")
        return self._open_at(self.v21_window_headroom().join(p, ["window_name", "reset_at_utc"]), reported_at)

    def rate_readings(self) -> DataFrame:
        """Requests priced by rates that were read after their day."""
        c = self.request_costs.filter("timestamp_utc is not null and unpriced_reason is null and day_utc < verified_on")
        return c.groupBy("verified_on").agg(F.count("*").alias("priced_before_verified_requests"))

    def top_repositories(self, most: int = 20) -> DataFrame:
        """The repositories drawn; a report's feature, the rest stays in its table."""
        return self.v29_usage_by_repo().select("repository", "repo_kind", "requests", "output_tokens").orderBy(F.desc("output_tokens"), F.asc_nulls_first("repository"), "repo_kind").limit(most)

    def stored_data(self) -> DataFrame:
        """How much is stored and over which span."""
        a = self.requests_dedup.agg(F.count("*").alias("requests"), F.min("timestamp_utc").alias("first_request_at_utc"), F.max("timestamp_utc").alias("last_request_at_utc"))
        return a.crossJoin(F.broadcast(self.table("status_readings").agg(F.count_if(F.col("status") == "ok").alias("ok_readings"))))  # two single rows

    def ingest_summary(self) -> DataFrame:
        """One row of counts over the stored tables, a pass each."""
        parts = [
            self.table("source_files").agg(F.count("*").alias("files"), F.count_if(F.col("size_bytes").isNull()).alias("files_being_written")),
            self.table("raw_lines").agg(F.count("*").alias("lines"), F.count_if(F.col("kind") == "spool").alias("spool_lines"), F.max("first_run_id").alias("latest_run")),
            self.table("parsed_lines").agg(F.count_if(F.col("line_class") == "malformed").alias("malformed_lines"), F.count_if(F.col("line_class") == "limit_hit").alias("limit_hits")),
            self.request_lines.agg(F.count("*").alias("request_lines"), (F.count_distinct("dedup_key") + F.count_if(F.col("dedup_key").isNull())).alias("responses")),
            self.table("status_readings").agg(F.count_if(F.col("status") == "ok").alias("ok_readings"), F.count_if(F.col("status") != "ok").alias("bad_readings")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.crossJoin(F.broadcast(p))  # single rows
        return out

    def machine_list(self) -> DataFrame:
        """Each other machine with its stored lines."""
        lines = self.table("raw_lines").select("source_file_id").join(self.machine_files(), "source_file_id").groupBy("machine_id").agg(F.count("*").alias("n"))
        return self.values(dim.MACHINES, dim.MACHINE_SCHEMA).join(lines, "machine_id", "left").select("machine_id", "label", "exported_at", F.coalesce("n", F.lit(0)).alias("stored_lines"))

    # --- R3: every number from its events -----------------------------------------------------------------

    def explanations(self) -> dict[str, tuple[DataFrame, DataFrame, str, bool]]:
        """metric -> (reported: grp, value; events: grp, contribution; unit, null counts as zero), for 15 metrics."""
        one = F.lit(1.0)
        text = lambda *c: F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in c])
        whole = F.lit("all")

        def pair(reported, group, value, events, event_group, contribution, unit="count", zero=True):
            return (
                reported.select(group.alias("grp"), F.col(value).cast("double").alias("value") if isinstance(value, str) else value.cast("double").alias("value")),
                events.select(event_group.alias("grp"), contribution.cast("double").alias("contribution")), unit, zero,
            )

        win, rep, mach, plan = text("window_name", "reset_at_utc"), text("repository", "repo_kind"), text("machine_id"), text("period_kind", "from_month")
        headroom = self.v21_window_headroom().filter("last_reading_raw_line_id is not null")
        peak = self.window_peak.filter("peak_reading_raw_line_id is not null")
        readings = self.window_readings.select("window_name", "reset_at_utc", "raw_line_id", "used_percentage")
        cross = self.v23b_five_hour_crossings().unionByName(self.v23_weekly_crossings())
        burn = self.burn_rate.filter("projected_percentage_points_per_hour is not null")
        h = headroom.join(burn.select("window_name", "reset_at_utc", "window_start_utc"), ["window_name", "reset_at_utc"])
        rate = F.col("last_used_percentage") * 3600000 / (ms("last_reading_at_utc") - ms("window_start_utc"))
        costs = self.request_costs.filter("timestamp_utc is not null")
        from ..operators.periods import local_month

        month = local_month(F.col("timestamp_utc"), dim.ZONE)
        by_machine = self.machine_requests.join(self.request_costs.select("raw_line_id", "total_usd"), "raw_line_id")
        return {
            "limit-hits": pair(self.v10_limit_hits(), whole, "hits", self.limit_hits, whole, one),
            "mid-task": pair(self.v12_mid_task(), whole, "mid_task", self.v11_mid_task_events(), whole, one),
            "lockout": pair(self.v16_lockout_time(), whole, "lockout_seconds", self.lockout_intervals, whole, F.col("lockout_seconds"), "seconds"),
            "by-plan": pair(self.v33_interruptions_by_plan(), plan, "hits", self.hits_by_plan, plan, one),
            "not-resumed": pair(self.v19_sessions_not_resumed(), whole, "sessions_not_resumed", self.sessions_not_resumed, whole, one),
            "headroom": pair(headroom, win, "last_used_percentage", headroom.select("window_name", "reset_at_utc", F.col("last_reading_raw_line_id").alias("raw_line_id")).join(readings, ["window_name", "reset_at_utc", "raw_line_id"]), win, F.col("used_percentage"), "percent"),
            "peak": pair(peak, win, "peak_used_percentage", peak.select("window_name", "reset_at_utc", F.col("peak_reading_raw_line_id").alias("raw_line_id")).join(readings, ["window_name", "reset_at_utc", "raw_line_id"]), win, F.col("used_percentage"), "percent"),
            "crossings": pair(cross, text("window_name", "reset_at_utc", "threshold"), "used_percentage", cross.select("window_name", "reset_at_utc", "threshold", "raw_line_id").join(readings, ["window_name", "reset_at_utc", "raw_line_id"]), text("window_name", "reset_at_utc", "threshold"), F.col("used_percentage"), "percent"),
            "unattributed": pair(self.unattributed_usage.filter("unattributed_percentage_points is not null"), win, "unattributed_percentage_points", self.reading_pairs.filter("requests_between = 0 and change_percentage_points > 0"), win, F.col("change_percentage_points"), "points"),
            "by-model": pair(self.v28_usage_by_model(), text("model"), "output_tokens", self.usage_events, text("model"), F.col("output_tokens"), "tokens"),
            "by-repo": pair(self.v29_usage_by_repo(), rep, "output_tokens", self.usage_events, rep, F.col("output_tokens"), "tokens"),
            "by-machine": pair(self.v39_usage_by_machine(), mach, "requests", self.machine_requests, mach, one),
            "burn-rate": pair(burn, win, "projected_percentage_points_per_hour", h, win, rate, "points an hour"),
            "api-list-price": pair(self.list_price_by_month, text("month"), "api_list_price_usd", costs, month, F.col("total_usd"), "usd", False),
            "price-by-machine": pair(self.list_price_by_machine, mach, "list_price_usd", by_machine, mach, F.col("total_usd"), "usd"),
        }

    def explain(self, metric: str) -> DataFrame:
        """grp, value (as reported), resummed (from the events) and whether they agree: one query per metric."""
        return self._explained(*self.explanations()[metric])

    def explained_events(self, metric: str, most: int | None = 20) -> DataFrame:
        """The events behind a metric's numbers, group by group; at most `most` to show (None: all). Sums always take all."""
        events = self.explanations()[metric][1].orderBy("grp", F.desc_nulls_last("contribution"))
        return events if most is None else events.limit(most)

    def _explained(self, reported: DataFrame, events: DataFrame, unit: str, zero: bool) -> DataFrame:
        return agreement(reported, _all_groups(reported, resum(events, ["grp"], F.col("contribution"), zero), zero), ["grp"], "value")

    def explain_all(self) -> DataFrame:
        out = None
        for metric, parts in self.explanations().items():
            e = self._explained(*parts).select(F.lit(metric).alias("metric"), "grp", F.round("value", 6).alias("reported"), F.round("resummed", 6).alias("resummed"), "agrees")
            e = stored(e, "explained")  # a plan of fifteen metrics at once would cost more than it saves
            out = e if out is None else out.unionByName(e)
        return out

    # --- R8: against another tool's totals -----------------------------------------------------------------

    def verify_totals(self, cost: bool = False) -> DataFrame:
        """Tokens (and list price) by day and model of responses of which any copy lies in a file of this machine that is still there."""
        here = self.table("source_files").join(self.machine_files(), "source_file_id", "left_anti").filter("size_bytes is not null").select("source_file_id")
        visible = self.request_lines.join(here, "source_file_id", "left_semi").select("raw_line_id", "dedup_key")
        d = self.requests_dedup.filter("timestamp_utc is not null")
        by_key = d.filter("dedup_key is not null").join(visible.select("dedup_key"), "dedup_key", "left_semi")
        by_line = d.filter("dedup_key is null").join(visible.select("raw_line_id"), "raw_line_id", "left_semi").select(*by_key.columns)
        zero = lambda c: F.coalesce(c, F.lit(0))
        written = zero("cache_write_5m_tokens") + zero("cache_write_1h_tokens") + zero("cache_write_unsplit_tokens")
        sums = [F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum("cache_read_tokens").alias("cache_read"), F.sum(written).alias("cache_write")]
        rows = by_key.unionByName(by_line)
        if cost:
            rows = rows.join(self.request_costs.select("raw_line_id", "total_usd"), "raw_line_id", "left")
            sums.append(F.coalesce(F.sum("total_usd"), F.lit(0.0)).alias("cost"))
        return rows.groupBy(F.date_format("timestamp_utc", "yyyy-MM-dd").alias("day"), "model").agg(*sums)

    def verify(self, external: DataFrame) -> DataFrame:
        """Where our totals and another tool's (same columns, `cost` if it has one) differ, on the days that both have; cost by more than a billionth."""
        fields = ["input", "output", "cache_read", "cache_write", *(["cost"] if "cost" in external.columns else [])]
        ours = self.verify_totals("cost" in fields)
        days = ours.select("day").distinct().join(external.select("day").distinct(), "day", "left_semi")
        side = lambda df: df.join(days, "day", "left_semi")
        return differences(side(ours), side(external), ["day", "model"], fields, {"cost": 1e-9})

    def cost_by_day_model(self) -> DataFrame:
        """A20."""
        return self.request_costs.filter("total_usd is not null").groupBy("day_utc", "model").agg(F.round(F.sum("total_usd"), 9).alias("usd"))

    # --- S21: results by file ------------------------------------------------------------------------------

    def _totals(self, *keys: Column) -> DataFrame:
        return self.requests_dedup.groupBy(*keys).agg(F.count("*").alias("requests"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS])

    def totals_by_model(self) -> DataFrame:
        """A3."""
        return self._totals(F.col("model"))

    def totals_by_day(self) -> DataFrame:
        d = self.requests_dedup.filter("timestamp_utc is not null")
        return d.groupBy(F.date_format("timestamp_utc", "yyyy-MM-dd").alias("day"), "model").agg(F.count("*").alias("requests"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS])

    def class_counts(self) -> DataFrame:
        """Lines by class, with zeros."""
        n = self.table("parsed_lines").groupBy("line_class").agg(F.count("*").alias("n"))
        every = self.values([(c,) for c in CLASSES], "line_class string")
        return every.join(n, "line_class", "left").select("line_class", F.coalesce("n", F.lit(0)).alias("n"))

    def ignored_types(self) -> DataFrame:
        label = F.concat(F.col("line_type"), F.coalesce(F.concat(F.lit("/"), F.col("subtype")), F.lit("")))
        return self.table("parsed_lines").filter("line_class = 'ignored_type'").groupBy(label.alias("label")).agg(F.count("*").alias("n"))

    def event_lines(self) -> DataFrame:
        """The event lines with their place; only these lines' bytes are parsed."""
        ids = self.table("parsed_lines").filter(F.col("line_class").isin("limit_hit", "api_error", "synthetic_other", "retry_notice", "model_fallback")).select("raw_line_id", "line_class", "session_id", "timestamp_raw")
        raw = self.table("raw_lines").filter("kind = 'log'").join(ids.select("raw_line_id"), "raw_line_id", "left_semi")
        facts = derive.log_facts(raw, ["raw_line_id", "relative_path", "line_number"], ["error", "api_error_status", "text_window", "reset_text", "quota_window", "quota_reset_at_utc", "retry_rate_limits"])
        return ids.join(facts, "raw_line_id")

    def results(self) -> dict[str, DataFrame]:
        """Requests, totals, events and counts in canonical order, as golden files hold them."""
        d = self.requests_dedup.orderBy("root", "relative_path", "first_run_id", "line_number")
        return {"requests": d, "totals_by_model": self.totals_by_model(), "totals_by_day_utc": self.totals_by_day(), "events": self.event_lines().orderBy("relative_path", "line_number"), "lines": self.class_counts(), "ignored_types": self.ignored_types()}

    # --- H: what a page draws, with the ids behind each number ----------------------------------------------

    def _placed(self, df: DataFrame) -> DataFrame:
        """Df with what orders its lines canonically."""
        return df.join(self.table("raw_lines").select("raw_line_id", "source_file_id", "first_run_id", "line_number"), "raw_line_id", "left")

    _order = ("source_file_id", "first_run_id", "line_number", "raw_line_id")

    def _ids(self, only: Column | None = None) -> Column:
        return joined(F.filter(ordered_ids([F.col(c) for c in self._order], "raw_line_id", only), lambda x: x.isNotNull()))

    def page_windows(self) -> DataFrame:
        """H1: each window with its counted readings in order, as id:percentage:stale."""
        point = F.struct(F.col("observed").alias("o0"), F.col("raw_line_id").alias("o1"), F.concat_ws(":", F.col("raw_line_id").cast("string"), F.round("used_percentage", 2).cast("decimal(12,2)").cast("string"), F.col("stale").cast("string")).alias("p"))
        points = self.window_readings.filter("after_reset = 0").groupBy("window_name", "reset_at_utc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["p"]), ",").alias("points"))
        return self.windows().filter("readings > 0").join(points, ["window_name", "reset_at_utc"], "left").select("window_name", "reset_at_utc", "window_open", "peak_used_percentage", "last_used_percentage", "readings", F.coalesce("points", F.lit("")).alias("points"))

    def page_lockouts(self) -> DataFrame:
        """H2: lockouts with their hits, and the first request line at the instant of the next request."""
        hits = self._placed(self.lockout_hits).groupBy("interval_number").agg(self._ids().alias("hit_ids"))
        d = self.requests_dedup.select(F.col("timestamp_utc").alias("next_request_at_utc"), *self._order)
        nxt = self.lockout_intervals.select("interval_number", "next_request_at_utc").join(d, "next_request_at_utc").groupBy("interval_number").agg(F.min_by("raw_line_id", F.struct(*self._order)).alias("next_request_raw_line_id"))
        return self.lockout_intervals.select("interval_number", "locked_from_utc", "locked_until_utc", "hits", "lockout_seconds").join(hits, "interval_number", "left").join(nxt, "interval_number", "left")

    def page_interruptions(self) -> DataFrame:
        """H3: one row of ordered id lists, each by the rule that counts it."""
        w, s = F.col("window_name"), F.col("source")
        return self._placed(self.limit_hits).agg(
            self._ids().alias("hit_ids"), self._ids(F.col("reset_at_utc").isNull() | F.col("hit_at_utc").isNull()).alias("unknown_reset_ids"), self._ids(w == "five_hour").alias("five_hour_ids"),
            self._ids(w == "seven_day").alias("seven_day_ids"), self._ids(w.isNull()).alias("unknown_window_ids"), self._ids(s == "session_log").alias("logged_ids"), self._ids(s == "status_line").alias("status_line_only_ids"),
        )

    def page_by_plan(self) -> DataFrame:
        """H4."""
        return self._placed(self.hits_by_plan).groupBy("period_kind", "from_month").agg(F.count("*").alias("hits"), self._ids().alias("hit_ids"))

    def page_after_reset(self) -> DataFrame:
        """H5: readings captured after their window's reset."""
        return self._placed(self.window_readings.filter("after_reset = 1").select("raw_line_id")).agg(F.count("*").alias("n"), self._ids().alias("ids"))

    def _listed(self, events: DataFrame, group: Column) -> DataFrame:
        """grp, raw_line_id and what orders them: the lines behind a group as rows, because a model, repository or month can hold any share of all requests."""
        return self._placed(events.select(group.alias("grp"), "raw_line_id")).select("grp", *self._order)

    def page_models(self) -> DataFrame:
        """H6: totals; the lines behind them are in page_model_requests."""
        return self.usage_events.groupBy("model").agg(F.count("*").alias("requests"), F.sum("output_tokens").alias("output_tokens"))

    def page_model_requests(self) -> DataFrame:
        return self._listed(self.usage_events, F.col("model"))

    def page_repositories(self) -> DataFrame:
        return self.usage_events.groupBy("repository", "repo_kind").agg(F.count("*").alias("requests"), F.sum("output_tokens").alias("output_tokens"))

    def page_repository_requests(self) -> DataFrame:
        return self._listed(self.usage_events, F.concat_ws("|", F.coalesce("repository", F.lit("-")), "repo_kind"))

    def page_machines(self) -> DataFrame:
        """H7."""
        return self._placed(self.machine_requests).groupBy("machine_id").agg(F.count("*").alias("requests"), self._ids(F.col("in_latest_week")).alias("week_ids"))

    def page_burn(self, reported_at: datetime | None = None) -> DataFrame:
        """H8: projections of the windows open at the report."""
        return self._open_at(self.v34_burn_rate(), reported_at).filter("open_at_report")

    def page_months(self) -> DataFrame:
        """H9: the priced and unpriced requests of each local month, as rows."""
        from ..operators.periods import local_month

        c = self.request_costs.filter("timestamp_utc is not null")
        priced = F.when(F.col("unpriced_reason").isNull(), "priced").otherwise("unpriced")
        return self._listed(c, F.concat_ws("|", local_month(F.col("timestamp_utc"), dim.ZONE), priced))

    def page_events(self) -> DataFrame:
        """Place and time of every line that any hit, lockout or response of the page names."""
        ids = self.limit_hits.select("raw_line_id").unionByName(self.usage_events.select("raw_line_id")).unionByName(self.window_readings.select("raw_line_id")).distinct()
        p = self.table("parsed_lines").select("raw_line_id", "timestamp_utc")
        s = self.table("status_readings").select("raw_line_id", "captured_at_s")
        seconds = F.when(F.col("captured_at_s") > 1e11, F.col("captured_at_s") / 1000).otherwise(F.col("captured_at_s"))
        at = F.when(F.col("kind") == "spool", F.timestamp_millis(F.round(seconds * 1000).cast("bigint")).cast("timestamp_ntz")).otherwise(F.col("timestamp_utc"))
        lines = self.table("raw_lines").select("raw_line_id", "kind", "relative_path", "line_number").join(ids, "raw_line_id", "left_semi")
        return lines.join(p, "raw_line_id", "left").join(s, "raw_line_id", "left").select("raw_line_id", "relative_path", "line_number", at.alias("at_utc"))

    def page_price_notes(self) -> DataFrame:
        """The requests behind each note on prices, as rows."""
        c = self.request_costs.filter("timestamp_utc is not null")
        early = self._listed(c.filter("unpriced_reason is null and day_utc < verified_on"), F.concat(F.lit("verified "), F.col("verified_on")))
        return early.unionByName(self._listed(c.filter("is_lower_bound = 1"), F.lit("lower bound")))

    def page_placed_hits(self) -> DataFrame:
        """Each hit in the drawn window that holds it, at most one: of overlapping ones that with the earliest reset; hits of unknown window or time are in none."""
        w = self.window_instances.filter("readings > 0").select(F.col("window_name").alias("c_window"), "reset", F.col("reset_at_utc").alias("column_reset_at_utc"))
        hits = self.limit_hits.filter("window_name is not null and hit_at_utc is not null")
        inside = contained_in(hits.select("raw_line_id", "window_name", "hit_at_utc"), w, ms("hit_at_utc"), F.col("reset") - length_s(F.col("c_window")) * 1000, F.col("reset"), DAY_MS, equal=[("window_name", "c_window")])
        first = inside.groupBy("raw_line_id").agg(F.min_by("column_reset_at_utc", "reset").alias("column_reset_at_utc"))
        return self.limit_hits.select("raw_line_id", "source", "window_name", "hit_at_utc").join(first, "raw_line_id", "left")

    def page_crossings(self) -> DataFrame:
        """H5: the first readings at or above 75 and 90 % of both kinds of windows."""
        return self.v23b_five_hour_crossings().unionByName(self.v23_weekly_crossings())

    def page_plan_lockouts(self) -> DataFrame:
        """H4: the lockouts of each plan period."""
        return self.lockouts_by_plan.select("period_kind", "from_month", "interval_number", "locked_from_utc", "lockout_seconds")

    def page_machine_totals(self) -> DataFrame:
        """H7: each machine's requests, tokens, price and latest week, with its label."""
        price = self.list_price_by_machine.select("machine_id", F.round("list_price_usd", 6).alias("list_price_usd"), F.round("week_list_price_usd", 6).alias("week_list_price_usd"), "unpriced_requests")
        return self.v39_usage_by_machine().select("machine_id", "machine_label", "is_this_machine", "requests", "input_tokens", "output_tokens", "week_requests", "week_output_tokens").join(price, "machine_id", "left")

    def combining(self) -> DataFrame:
        """Whether lines of several machines are combined: this one takes part, or a file of another one is there."""
        here = self.values([dim.THIS_MACHINE], "machine_id string, label string").limit(1)
        either = here.select(F.lit(1).alias("x")).unionByName(self.machine_files().select(F.lit(1).alias("x")).limit(1))
        return either.agg((F.count("*") > 0).alias("combining"))

    def page(self, reported_at: datetime | None = None) -> dict[str, DataFrame]:
        """All of a page's frames."""
        return {
            "windows": self.page_windows(), "lockouts": self.page_lockouts(), "interruptions": self.page_interruptions(), "by_plan": self.page_by_plan(), "after_reset": self.page_after_reset(), "models": self.page_models(), "model_requests": self.page_model_requests(), "repository_requests": self.page_repository_requests(),
            "placed_hits": self.page_placed_hits(), "crossings": self.page_crossings(), "plan_lockouts": self.page_plan_lockouts(), "machine_totals": self.page_machine_totals(), "combining": self.combining(),
            "repositories": self.page_repositories(), "machines": self.page_machines(), "burn": self.page_burn(reported_at), "months": self.page_months(), "events": self.page_events(), "price_notes": self.page_price_notes(),
        }


def _all_groups(reported: DataFrame, resummed: DataFrame, zero: bool) -> DataFrame:
    """A reported group without events re-adds to 0 (or stays unknown)."""
    r = reported.select(F.col("grp").alias("_g")).distinct().join(resummed, F.col("_g") == F.col("grp"), "left")
    return r.select(F.col("_g").alias("grp"), F.coalesce("resummed", F.lit(0.0)).alias("resummed") if zero else F.col("resummed"))


#: Which views a view may read: observed ones never reach a price or a projection.
DEPENDS = {
    "requests_dedup": [], "window_readings": [], "request_repositories": ["requests_dedup"], "request_costs": ["requests_dedup", "prices"], "source_coverage": ["window_readings"],
    "logged_limit_hits": [], "status_limit_groups": ["window_readings"], "limit_hits": ["logged_limit_hits", "status_limit_groups", "requests_dedup", "source_coverage"], "lockout_hits": ["limit_hits"],
    "continuation_marks": [], "lockout_intervals": ["lockout_hits", "continuation_marks", "requests_dedup", "source_coverage"], "sessions_not_resumed": ["limit_hits", "requests_dedup"],
    "window_instances": ["window_readings", "source_coverage"], "window_headroom": ["window_instances"], "window_peak": ["window_instances"], "reading_pairs": ["window_readings"],
    "unattributed_usage": ["window_instances", "reading_pairs"], "usage_events": ["requests_dedup", "request_repositories"], "plan_periods": [], "hits_by_plan": ["limit_hits", "plan_periods"],
    "lockouts_by_plan": ["lockout_intervals", "plan_periods"], "latest_week": ["window_instances"], "machine_requests": ["requests_dedup", "latest_week"],
    "burn_rate": ["window_headroom"], "list_price_by_month": ["request_costs"], "list_price_by_machine": ["machine_requests", "request_costs"], "prices": [],
}
PROJECTED = {"prices", "request_costs", "burn_rate", "list_price_by_month", "list_price_by_machine"}


def reaches(view: str) -> set[str]:
    """Every view that `view` reads, directly or not."""
    out: set[str] = set()
    todo = list(DEPENDS[view])
    while todo:
        v = todo.pop()
        if v not in out:
            out.add(v)
            todo += DEPENDS[v]
    return out


def report_json(r: Reports, reported_at: datetime | None = None) -> str:
    """Unrounded rows, observed and projected apart. Reports are small frames by their nature."""
    rows = lambda frames: {k: [row.asDict(recursive=True) for row in f.collect()] for k, f in frames.items()}
    return json.dumps({"observed": rows(r.observed(reported_at)), "projected": rows(r.projected(reported_at))}, default=str, ensure_ascii=False, indent=1)


def report_text(r: Reports, reported_at: datetime | None = None) -> str:
    """The frames as plain tables; unknown is said as such, numbers get thousands marks at display only."""
    def cell(v: object) -> str:
        if v is None:
            return "unknown"
        return f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else "".join(c if c.isprintable() else "?" for c in str(v))

    out = []
    for section, frames in (("OBSERVED", r.observed(reported_at)), ("PROJECTED", r.projected(reported_at))):
        out.append(section)
        for name, f in frames.items():
            table = [f.columns] + [[cell(v) for v in row] for row in f.collect()]
            width = [max(len(line[i]) for line in table) for i in range(len(f.columns))]
            out += ["", name, *("  ".join(v.ljust(w) for v, w in zip(line, width, strict=True)).rstrip() for line in table)]
        out.append("")
    return "\n".join(out)


def duration(seconds: float | None) -> str:
    """The two largest units."""
    if seconds is None:
        return "unknown"
    left, parts = int(seconds), []
    for name, size in (("d", 86400), ("h", 3600), ("min", 60), ("s", 1)):
        n, left = divmod(left, size)
        if n or (name == "s" and not parts):
            parts.append(f"{n} {name}")
    return " ".join(parts[:2])


def save(folder: str, text: str, kind: str, at: datetime) -> str:
    """A dated file that never replaces another; a number is added up to 99 times."""
    for n in range(100):
        path = os.path.join(folder, f"report-{at:%Y-%m-%d-%H%M}{f'-{n}' if n else ''}.{kind}")
        try:
            with open(path, "x", encoding="utf-8") as f:
                f.write(text)
            return path
        except FileExistsError:
            continue
    raise FileExistsError(f"a hundred reports of this minute in {folder}")


def _q(method: str):
    return lambda spark, d: getattr(Reports(spark, d), method)()


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """Our parse of the raw lines, spoken as the test tables do: an error line with neither error nor status is synthetic_other there."""
    raw = Telemetry(spark, d).table("raw_lines")
    unnamed = (F.col("line_class") == "api_error") & (F.col("unknown_error") == "<missing>") & F.col("api_error_status").isNull()
    f = derive.log_facts(raw, only=[*derive.PARSED, "unknown_error", "api_error_status"]).withColumn("line_class", F.when(unnamed, "synthetic_other").otherwise(F.col("line_class")))
    return derive.parsed_lines(f)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return derive.requests(derive.log_facts(Telemetry(spark, d).table("raw_lines"), only=["line_class", *derive.REQUEST]))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return derive.status_readings(derive.spool_facts(Telemetry(spark, d).table("raw_lines")))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Our parse of the spool lines; the test tables call a percentage above 100 invalid, which is a real reading here."""
    w = derive.rate_limit_windows(derive.spool_facts(Telemetry(spark, d).table("raw_lines")))
    return w.withColumn("validity", F.when((F.col("validity").isin("valid", "invalid_resets_at")) & (F.col("used_percentage") > 100), "invalid_percentage").otherwise(F.col("validity")))


def _problems(spark: SparkSession, d: str) -> DataFrame:
    p = derive.line_problems(derive.log_facts(Telemetry(spark, d).table("raw_lines"), only=["problems"]))
    return p.groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("raw_line_id").alias("lines"))


def _identity(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct line of each file by the hash of its bytes, with its first place and its identity anywhere."""
    raw = Telemetry(spark, d).table("raw_lines").withColumn("h", F.sha2("line_bytes", 256))
    g = raw.groupBy("source_file_id", "relative_path", "h").agg(F.min("line_number").alias("line_number"), F.count("*").alias("copies"))
    origin = F.substring(F.sha2(F.concat_ws("\n", "relative_path", "h").cast("binary"), 256), 1, 32)
    return g.select("source_file_id", F.col("h").alias("content_hash"), "line_number", "copies", origin.alias("origin"))


def _scrubbed(spark: SparkSession, d: str) -> DataFrame:
    """What may leave the machine, by the members of each line that leave."""
    from ..sources.exchange import ORIGIN, scrubbed

    members = F.array_sort(F.array_except(F.json_object_keys("line"), F.array(F.lit(ORIGIN))))
    return scrubbed(Telemetry(spark, d).table("raw_lines")).select("raw_line_id", "origin", F.array_join(members, ",").alias("members"))


def _verify(spark: SparkSession, d: str) -> DataFrame:
    """Our totals against those of all copies: where counting every delivery goes wrong."""
    r = Reports(spark, d)
    zero = lambda c: F.coalesce(c, F.lit(0))
    every = r.request_lines.filter("timestamp_utc is not null").groupBy(F.date_format("timestamp_utc", "yyyy-MM-dd").alias("day"), "model").agg(
        F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum("cache_read_tokens").alias("cache_read"),
        F.sum(zero("cache_write_5m_tokens") + zero("cache_write_1h_tokens") + zero("cache_write_unsplit_tokens")).alias("cache_write"),
    )
    return r.verify(every)


QUERIES = {
    "ref_s04_parsed_lines": _parsed, "ref_s04_requests": _requests, "ref_s08_status_readings": _readings, "ref_s09_rate_limit_windows": _windows, "ref_p10_line_problems": _problems, "ref_s07_line_identity": _identity,
    "ref_p13_scrubbed_lines": _scrubbed, "ref_r03_explain_all": _q("explain_all"), "ref_r08_verify": _verify, "ref_j23_windows": _q("windows"), "ref_a17_rate_readings": _q("rate_readings"),
    "ref_a18_class_counts": _q("class_counts"), "ref_a18_ignored_types": _q("ignored_types"), "ref_a19_verify_totals": _q("verify_totals"), "ref_a20_cost_by_day_model": _q("cost_by_day_model"),
    "ref_a03_totals_by_model": _q("totals_by_model"), "ref_a03_totals_by_day": _q("totals_by_day"), "ref_a22_ingest_summary": _q("ingest_summary"), "ref_a26_stored_data": _q("stored_data"), "ref_a27_machine_list": _q("machine_list"),
    "ref_l06_top_repositories": _q("top_repositories"), "ref_s21_event_lines": _q("event_lines"),
    "ref_h01_windows": _q("page_windows"), "ref_h02_lockouts": _q("page_lockouts"), "ref_h03_interruptions": _q("page_interruptions"), "ref_h04_by_plan": _q("page_by_plan"), "ref_h05_after_reset": _q("page_after_reset"),
    "ref_h06_models": _q("page_models"), "ref_h06_repositories": _q("page_repositories"), "ref_h06_model_requests": _q("page_model_requests"), "ref_h06_repository_requests": _q("page_repository_requests"), "ref_j11_placed_hits": _q("page_placed_hits"),
    "ref_h05_crossings": _q("page_crossings"), "ref_h04_plan_lockouts": _q("page_plan_lockouts"), "ref_h07_machine_totals": _q("page_machine_totals"), "ref_u06_combining": _q("combining"), "ref_h07_machines": _q("page_machines"), "ref_h08_burn": _q("page_burn"), "ref_h09_months": _q("page_months"),
    "ref_h10_events": _q("page_events"), "ref_h11_price_notes": _q("page_price_notes"),
}
