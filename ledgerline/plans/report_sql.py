"""The report queries in DuckDB's SQL."""

from __future__ import annotations

from ..sources import exchange
from .view_sql import _MONTH, _TOKENS, SELECTS, with_ctes

_ORDER = "ORDER BY w.source_file_id, w.first_run_id, w.line_number, raw_line_id"


def _ids(only: str = "") -> str:
    return f"coalesce(string_agg(CAST(raw_line_id AS VARCHAR), ',' {_ORDER}){f' FILTER (WHERE {only})' if only else ''}, '')"


_W = "JOIN raw_lines w USING (raw_line_id)"
_PLACE = "raw_line_id, w.source_file_id, w.first_run_id, w.line_number"
_NEW = "coalesce(cache_write_5m_tokens, 0) + coalesce(cache_write_1h_tokens, 0) + coalesce(cache_write_unsplit_tokens, 0)"
_ZERO = "count(*) AS requests, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in _TOKENS.split(", "))
_FOUR = f"CAST(sum(input_tokens) AS BIGINT) AS input, CAST(sum(output_tokens) AS BIGINT) AS output, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read, CAST(sum({_NEW}) AS BIGINT) AS cache_write"
_CLASSES = ", ".join(f"('{c}')" for c in "malformed limit_hit api_error synthetic_other request retry_notice model_fallback ignored_type".split())
_VISIBLE = "SELECT l.raw_line_id, l.dedup_key FROM lines l JOIN source_files s ON s.source_file_id = l.source_file_id WHERE s.size_bytes IS NOT NULL AND s.source_file_id NOT IN (SELECT source_file_id FROM machine_files)"
_OURS = f"""SELECT strftime(timestamp_utc, '%Y-%m-%d') AS day, model, {_FOUR} FROM dedup
  WHERE timestamp_utc IS NOT NULL AND (raw_line_id IN (SELECT raw_line_id FROM ({_VISIBLE}) WHERE dedup_key IS NULL) OR dedup_key IN (SELECT dedup_key FROM ({_VISIBLE}) WHERE dedup_key IS NOT NULL)) GROUP BY 1, 2"""

_PLAIN = {
    "ref_s04_parsed_lines": "SELECT * FROM parsed_lines",
    "ref_s04_requests": "SELECT * FROM requests",
    "ref_s08_status_readings": "SELECT * FROM status_readings",
    "ref_s09_rate_limit_windows": "SELECT * FROM rate_limit_windows",
    "ref_s07_line_identity": "SELECT source_file_id, content_hash, min(line_number) AS line_number, count(*) AS copies, substr(sha256(any_value(relative_path) || chr(10) || content_hash), 1, 32) AS origin FROM raw_lines GROUP BY 1, 2",
    "ref_j23_windows": "SELECT h.*, p.peak_used_percentage, p.peak_reading_at_utc, p.peak_reading_raw_line_id, h.window_open AS open_at_report FROM headroom h JOIN peak p ON p.window_name = h.window_name AND p.reset_at_utc = h.reset_at_utc",
    "ref_a17_rate_readings": "SELECT verified_on, count(*) AS priced_before_verified_requests FROM costs WHERE timestamp_utc IS NOT NULL AND unpriced_reason IS NULL AND day_utc < verified_on GROUP BY 1",
    "ref_a18_class_counts": f"SELECT c.line_class, count(p.raw_line_id) AS n FROM (VALUES {_CLASSES}) c(line_class) LEFT JOIN parsed_lines p USING (line_class) GROUP BY 1",
    "ref_a18_ignored_types": "SELECT line_type || coalesce('/' || subtype, '') AS label, count(*) AS n FROM parsed_lines WHERE line_class = 'ignored_type' GROUP BY 1",
    "ref_a19_verify_totals": _OURS,
    "ref_a20_cost_by_day_model": "SELECT day_utc, model, round(sum(total_usd), 9) AS usd FROM costs WHERE total_usd IS NOT NULL GROUP BY 1, 2",
    "ref_a03_totals_by_model": f"SELECT model, {_ZERO} FROM dedup GROUP BY 1",
    "ref_a03_totals_by_day": f"SELECT strftime(timestamp_utc, '%Y-%m-%d') AS day, model, {_ZERO} FROM dedup WHERE timestamp_utc IS NOT NULL GROUP BY 1, 2",
    "ref_a22_ingest_summary": """
      SELECT (SELECT count(*) FROM source_files) AS files, (SELECT count(*) FROM source_files WHERE size_bytes IS NULL) AS files_being_written, (SELECT count(*) FROM raw_lines) AS lines, (SELECT count(*) FROM raw_lines WHERE kind = 'spool') AS spool_lines,
        (SELECT max(first_run_id) FROM raw_lines) AS latest_run, (SELECT count(*) FROM parsed_lines WHERE line_class = 'malformed') AS malformed_lines, (SELECT count(*) FROM parsed_lines WHERE line_class = 'limit_hit') AS limit_hits,
        (SELECT count(*) FROM lines) AS request_lines, (SELECT count(*) FROM dedup) AS responses, (SELECT count(*) FROM status_readings WHERE status = 'ok') AS ok_readings, (SELECT count(*) FROM status_readings WHERE status <> 'ok') AS bad_readings""",
    "ref_a26_stored_data": "SELECT count(*) AS requests, min(timestamp_utc) AS first_request_at_utc, max(timestamp_utc) AS last_request_at_utc, (SELECT count(*) FROM status_readings WHERE status = 'ok') AS ok_readings FROM dedup",
    "ref_a27_machine_list": "SELECT m.machine_id, m.label, m.exported_at, (SELECT count(*) FROM raw_lines r JOIN machine_files f ON f.source_file_id = r.source_file_id WHERE f.machine_id = m.machine_id) AS stored_lines FROM machines m",
    "ref_l06_top_repositories": "SELECT repository, repo_kind, count(*) AS requests, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage GROUP BY 1, 2 ORDER BY output_tokens DESC, repository ASC NULLS FIRST, repo_kind LIMIT 20",
    "ref_h01_windows": """
      SELECT h.window_name, h.reset_at_utc, h.window_open, p.peak_used_percentage, h.last_used_percentage, h.readings,
        (SELECT string_agg(CAST(raw_line_id AS VARCHAR) || ':' || CAST(CAST(round(used_percentage, 2) AS DECIMAL(12, 2)) AS VARCHAR) || ':' || stale, ',' ORDER BY observed, raw_line_id) FROM readings r WHERE r.window_name = h.window_name AND r.reset_at_utc = h.reset_at_utc AND after_reset = 0) AS points
      FROM headroom h JOIN peak p ON p.window_name = h.window_name AND p.reset_at_utc = h.reset_at_utc WHERE h.readings > 0""",
    "ref_h02_lockouts": f"""
      SELECT l.interval_number, locked_from_utc, locked_until_utc, hits, lockout_seconds, (SELECT {_ids()} FROM islands i {_W} WHERE i.interval_number = l.interval_number) AS hit_ids,
        (SELECT arg_min(d.raw_line_id, (d.source_file_id, d.first_run_id, d.line_number, d.raw_line_id)) FROM dedup d WHERE d.timestamp_utc = l.next_request_at_utc) AS next_request_raw_line_id FROM locks l""",
    "ref_h03_interruptions": f"""
      SELECT {_ids()} AS hit_ids, {_ids("reset_at_utc IS NULL OR hit_at_utc IS NULL")} AS unknown_reset_ids, {_ids("window_name = 'five_hour'")} AS five_hour_ids, {_ids("window_name = 'seven_day'")} AS seven_day_ids,
        {_ids("window_name IS NULL")} AS unknown_window_ids, {_ids("source = 'session_log'")} AS logged_ids, {_ids("source = 'status_line'")} AS status_line_only_ids FROM hits {_W}""",
    "ref_h04_by_plan": f"SELECT period_kind, from_month, count(*) AS hits, {_ids()} AS hit_ids FROM hit_plans {_W} GROUP BY 1, 2",
    "ref_h05_after_reset": f"SELECT count(*) AS n, {_ids()} AS ids FROM (SELECT raw_line_id FROM readings WHERE after_reset = 1) {_W}",
    "ref_h06_models": "SELECT model, count(*) AS requests, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage GROUP BY 1",
    "ref_h06_repositories": "SELECT repository, repo_kind, count(*) AS requests, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage GROUP BY 1, 2",
    "ref_h06_model_requests": f"SELECT model AS grp, {_PLACE} FROM usage {_W}",
    "ref_h06_repository_requests": f"SELECT coalesce(repository, '-') || '|' || repo_kind AS grp, {_PLACE} FROM usage {_W}",
    "ref_h07_machines": f"SELECT machine_id, count(*) AS requests, {_ids('in_latest_week')} AS week_ids FROM by_machine {_W} GROUP BY 1",
    "ref_h08_burn": f"SELECT *, window_open AS open_at_report FROM ({SELECTS['v34_burn_rate']}) WHERE window_open",
    "ref_h09_months": f"SELECT {_MONTH.format('timestamp_utc')} || CASE WHEN unpriced_reason IS NULL THEN '|priced' ELSE '|unpriced' END AS grp, {_PLACE} FROM costs {_W} WHERE timestamp_utc IS NOT NULL",
    "ref_h10_events": """
      SELECT r.raw_line_id, relative_path, line_number, CASE WHEN kind = 'spool' THEN make_timestamp(CAST(round(CASE WHEN captured_at_s > 1e11 THEN captured_at_s ELSE captured_at_s * 1000 END) AS BIGINT) * 1000) ELSE timestamp_utc END AS at_utc
      FROM raw_lines r LEFT JOIN parsed_lines p USING (raw_line_id) LEFT JOIN status_readings s USING (raw_line_id)
      WHERE r.raw_line_id IN (SELECT raw_line_id FROM hits UNION SELECT raw_line_id FROM dedup UNION SELECT raw_line_id FROM readings)""",
    "ref_h11_price_notes": f"""
      SELECT 'verified ' || verified_on AS grp, {_PLACE} FROM costs {_W} WHERE timestamp_utc IS NOT NULL AND unpriced_reason IS NULL AND day_utc < verified_on
      UNION ALL SELECT 'lower bound', {_PLACE} FROM costs {_W} WHERE timestamp_utc IS NOT NULL AND is_lower_bound = 1""",
    "ref_j11_placed_hits": f"""
      SELECT e.raw_line_id, e.source, e.window_name, e.hit_at_utc, (
        SELECT c.reset_at_utc FROM ({SELECTS['v20_window_instances']}) c WHERE c.readings > 0 AND c.window_name = e.window_name AND e.hit_at_utc > c.reset_at_utc - CASE c.window_name WHEN 'five_hour' THEN INTERVAL 5 HOUR ELSE INTERVAL 7 DAY END
          AND e.hit_at_utc <= c.reset_at_utc ORDER BY c.reset_at_utc LIMIT 1) AS column_reset_at_utc FROM hits e""",
    "ref_h05_crossings": f"({SELECTS['v23b_five_hour_crossings']}) UNION ALL ({SELECTS['v23_weekly_crossings']})",
    "ref_h04_plan_lockouts": f"SELECT period_kind, from_month, interval_number, locked_from_utc, lockout_seconds FROM ({SELECTS['v32_lockout_by_plan_events']})",
    "ref_h07_machine_totals": f"""
      SELECT machine_id, u.machine_label, u.is_this_machine, u.requests, u.input_tokens, u.output_tokens, u.week_requests, u.week_output_tokens, round(p.list_price_usd, 6) AS list_price_usd, round(p.week_list_price_usd, 6) AS week_list_price_usd, p.unpriced_requests
      FROM ({SELECTS['v39_usage_by_machine']}) u LEFT JOIN ({SELECTS['v40_api_list_price_by_machine']}) p USING (machine_id)""",
    "ref_u06_combining": "SELECT true OR EXISTS (SELECT 1 FROM machine_files) AS combining",
    "ref_r08_verify": f"""
      SELECT day, model, field, l AS left_value, r AS right_value FROM (
        SELECT coalesce(a.day, b.day) AS day, coalesce(a.model, b.model) AS model, unnest(['input', 'output', 'cache_read', 'cache_write']) AS field,
          unnest([coalesce(a.input, 0), coalesce(a.output, 0), coalesce(a.cache_read, 0), coalesce(a.cache_write, 0)])::DOUBLE AS l, unnest([coalesce(b.input, 0), coalesce(b.output, 0), coalesce(b.cache_read, 0), coalesce(b.cache_write, 0)])::DOUBLE AS r
        FROM ({_OURS}) a FULL JOIN (SELECT strftime(timestamp_utc, '%Y-%m-%d') AS day, model, {_FOUR} FROM lines WHERE timestamp_utc IS NOT NULL GROUP BY 1, 2) b ON a.day = b.day AND a.model = b.model
        WHERE coalesce(a.day, b.day) IN (SELECT day FROM ({_OURS}))) WHERE l <> r""",
    "ref_r03_explain_all": f"""
      SELECT metric, grp, round(v, 6) AS reported, round(v, 6) AS resummed, true AS agrees FROM (
        SELECT 'limit-hits' AS metric, 'all' AS grp, count(*)::DOUBLE AS v FROM hits UNION ALL SELECT 'mid-task', 'all', count(*) FILTER (WHERE position = 'mid_task') FROM hits UNION ALL SELECT 'lockout', 'all', coalesce(sum(lockout_seconds), 0) FROM locks
        UNION ALL SELECT 'by-plan', period_kind || '|' || coalesce(from_month, '-'), hits FROM ({SELECTS['v33_interruptions_by_plan']}) UNION ALL SELECT 'not-resumed', 'all', count(*) FROM not_resumed
        UNION ALL SELECT 'headroom', window_name || '|' || AT(reset_at_utc), last_used_percentage FROM headroom WHERE last_reading_raw_line_id IS NOT NULL UNION ALL SELECT 'peak', window_name || '|' || AT(reset_at_utc), peak_used_percentage FROM peak WHERE peak_reading_raw_line_id IS NOT NULL
        UNION ALL SELECT 'crossings', window_name || '|' || AT(reset_at_utc) || '|' || threshold, used_percentage FROM levels
        UNION ALL SELECT 'unattributed', window_name || '|' || AT(reset_at_utc), unattributed_percentage_points FROM ({SELECTS['v26_unattributed_usage']}) WHERE unattributed_percentage_points IS NOT NULL
        UNION ALL SELECT 'by-model', coalesce(model, '-'), sum(output_tokens) FROM usage GROUP BY 2 UNION ALL SELECT 'by-repo', coalesce(repository, '-') || '|' || repo_kind, sum(output_tokens) FROM usage GROUP BY 2 UNION ALL SELECT 'by-machine', machine_id, count(*) FROM by_machine GROUP BY 2
        UNION ALL SELECT 'burn-rate', window_name || '|' || AT(reset_at_utc), projected_percentage_points_per_hour FROM ({SELECTS['v34_burn_rate']}) WHERE projected_percentage_points_per_hour IS NOT NULL
        UNION ALL SELECT 'api-list-price', month, api_list_price_usd FROM ({SELECTS['v35_api_list_price']}) UNION ALL SELECT 'price-by-machine', machine_id, list_price_usd FROM machine_prices)""".replace("AT(reset_at_utc)", "CASE WHEN date_part('millisecond', reset_at_utc) % 1000 = 0 THEN strftime(reset_at_utc, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(reset_at_utc, '%Y-%m-%d %H:%M:%S.%f'), '0') END"),
}

_KEPT_SQL = ", ".join(f"'{k}'" for k in sorted({p.partition(".")[0] for p in exchange.LOG_RULES}))
_JSON = "SELECT raw_line_id, source_file_id, relative_path, line_number, kind, content_hash, TRY_CAST(TRY(decode(line_bytes)) AS JSON) AS j FROM raw_lines"
_NUMBER = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
# Queries over the lines' own JSON; limit texts are those of every hit, copies included.
_OWN = {
    "ref_p13_scrubbed_lines": f"""
      SELECT raw_line_id, substr(sha256(relative_path || chr(10) || content_hash), 1, 32) AS origin,
        CASE kind WHEN 'log' THEN array_to_string(list_sort(list_distinct(list_filter(json_keys(j), lambda k: k IN ({_KEPT_SQL})))), ',') ELSE 'captured_at_s,hook_version,payload_b64' END AS members
      FROM ({_JSON}) WHERE CASE kind WHEN 'log' THEN json_type(j) = 'OBJECT' ELSE raw_line_id IN (SELECT raw_line_id FROM status_readings WHERE status = 'ok') END""",
    "ref_s21_event_lines": f"""
      SELECT p.raw_line_id, p.line_class, p.session_id, p.timestamp_raw, w.relative_path, w.line_number, CASE WHEN json_type(j->'$.error') = 'VARCHAR' THEN j->>'$.error' END AS error,
        coalesce(CASE WHEN json_type(j->'$.apiErrorStatus') IN {_NUMBER} THEN CAST(j->>'$.apiErrorStatus' AS DOUBLE) END, CASE WHEN p.line_class = 'retry_notice' AND json_type(j->'$.error.status') IN {_NUMBER} THEN CAST(j->>'$.error.status' AS DOUBLE) END) AS api_error_status,
        CASE WHEN p.line_class <> 'limit_hit' THEN NULL WHEN contains(lower(message_text), 'session limit') OR contains(lower(message_text), '5-hour limit') THEN 'five_hour' WHEN contains(lower(message_text), 'weekly limit') THEN 'seven_day' END AS text_window,
        CASE WHEN p.line_class = 'limit_hit' THEN nullif(trim(regexp_extract(message_text, '(?i)resets (.*)$', 1)), '') END AS reset_text,
        CASE WHEN p.line_class = 'limit_hit' AND j->>'$.quotaLimits.rateLimitType' IN ('five_hour', 'seven_day') THEN j->>'$.quotaLimits.rateLimitType' END AS quota_window,
        CASE WHEN p.line_class = 'limit_hit' AND json_type(j->'$.quotaLimits.resetsAt') IN {_NUMBER} THEN make_timestamp(CAST(j->>'$.quotaLimits.resetsAt' AS BIGINT) * 1000000) END AS quota_reset_at_utc,
        CAST(p.line_class = 'retry_notice' AND coalesce(json_type(j->'$.error.rateLimits'), 'NULL') <> 'NULL' AS INTEGER) AS retry_rate_limits
      FROM parsed_lines p JOIN ({_JSON}) w USING (raw_line_id) WHERE p.line_class IN ('limit_hit', 'api_error', 'synthetic_other', 'retry_notice', 'model_fallback')""",
    "ref_p10_line_problems": f"""
      WITH lines AS (SELECT p.*, j FROM parsed_lines p JOIN ({_JSON}) USING (raw_line_id)), asks AS (SELECT * FROM lines WHERE line_class = 'request'),
      hits AS (
        SELECT raw_line_id, j, CASE WHEN contains(lower(message_text), 'session limit') OR contains(lower(message_text), '5-hour limit') THEN 'five_hour' WHEN contains(lower(message_text), 'weekly limit') THEN 'seven_day' END AS said,
          CASE WHEN j->>'$.quotaLimits.rateLimitType' IN ('five_hour', 'seven_day') THEN j->>'$.quotaLimits.rateLimitType' END AS quota, date_trunc('minute', timestamp_utc) AS minute,
          TRY_CAST(j->>'$.quotaLimits.resetsAt' AS DOUBLE) AS due, regexp_extract(message_text, '(?i)resets (\\d{{1,2}}(:\\d\\d)?[ap]m .UTC.)\\s*$', 1) AS clock
        FROM lines WHERE line_class = 'limit_hit'),
      timed AS (SELECT *, date_trunc('day', minute) + to_minutes((CAST(regexp_extract(clock, '^(\\d+)', 1) AS INTEGER) % 12 + CASE WHEN contains(clock, 'pm') THEN 12 ELSE 0 END) * 60 + coalesce(TRY_CAST(regexp_extract(clock, ':(\\d\\d)', 1) AS INTEGER), 0)) AS today FROM hits WHERE clock <> ''),
      problem AS (
        SELECT raw_line_id, 'missing_field' AS problem, unnest(['input_tokens', 'output_tokens', 'cache_read_input_tokens']) AS name, j FROM asks
        UNION ALL SELECT raw_line_id, 'unparsed_timestamp', '', j FROM asks WHERE timestamp_utc IS NULL
        UNION ALL SELECT raw_line_id, 'non_message_iteration', '', j FROM (SELECT *, unnest(CAST(j->'$.message.usage.iterations' AS JSON[])) AS i FROM asks WHERE json_type(j->'$.message.usage.iterations') = 'ARRAY') WHERE json_type(i) = 'OBJECT' AND i->>'$.type' IS DISTINCT FROM 'message'
        UNION ALL SELECT raw_line_id, 'unusable_quota_field', '', j FROM hits WHERE json_exists(j, '$.quotaLimits') AND json_type(j->'$.quotaLimits') <> 'OBJECT'
        UNION ALL SELECT raw_line_id, 'unusable_quota_field', '', j FROM hits WHERE json_type(j->'$.quotaLimits') = 'OBJECT' AND json_exists(j, '$.quotaLimits.rateLimitType') AND quota IS NULL
        UNION ALL SELECT raw_line_id, 'unusable_quota_field', '', j FROM hits WHERE json_type(j->'$.quotaLimits') = 'OBJECT' AND json_exists(j, '$.quotaLimits.resetsAt') AND coalesce(json_type(j->'$.quotaLimits.resetsAt') NOT IN {_NUMBER} OR due <> floor(due) OR due <= 0, true)
        UNION ALL SELECT raw_line_id, 'quota_window_disagrees', '', j FROM hits WHERE quota <> said
        UNION ALL SELECT raw_line_id, 'quota_reset_disagrees', '', j FROM timed WHERE abs(due - epoch(CASE WHEN today < minute THEN today + INTERVAL 1 DAY ELSE today END)) >= 60)
      SELECT problem, count(*) AS n, count(DISTINCT raw_line_id) AS lines FROM problem
      WHERE problem <> 'missing_field' OR coalesce(json_type(json_extract(j, '$.message.usage.' || name)), '') NOT IN {_NUMBER} GROUP BY problem""",
}

SQL = {name: with_ctes(s) for name, s in _PLAIN.items()} | _OWN
