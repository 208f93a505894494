"""The views in DuckDB's SQL, said the plain way (correlated, quadratic), for comparison on small tables."""

from __future__ import annotations

import re

from . import dimensions as dim

_TOKENS = "input_tokens, output_tokens, cache_read_tokens, cache_write_5m_tokens, cache_write_1h_tokens, cache_write_unsplit_tokens"
_LEN = "CASE window_name WHEN 'five_hour' THEN 18000 ELSE 604800 END"
_SPAN = "(SELECT covers_from FROM coverage WHERE source = '{0}') AS {1}covers_from, (SELECT covers_to FROM coverage WHERE source = '{0}') AS {1}covers_to"
_LOGS, _LINE = _SPAN.format("session_logs", ""), _SPAN.format("status_line", "")
_MONTH = f"strftime({{}} + INTERVAL '{dim.ZONE_HOURS} hours', '%Y-%m')"
_PASS = ", ".join(f"'{a}'" for a in dim.PASSED_ATTACHMENTS)
_SECONDS = "(epoch_ms({}) - epoch_ms({})) / 1000.0"

#: name -> definition; a definition may read those before it.
CTES: dict[str, str] = {
    "prices": f"SELECT * FROM {dim.values(dim.PRICES, dim.names_of(dim.PRICE_SCHEMA), 'p')}",
    "plans": f"SELECT * FROM {dim.values(dim.PLANS, dim.names_of(dim.PLAN_SCHEMA), 'p')}",
    "aliases": f"SELECT * FROM {dim.values(dim.ALIASES, dim.names_of(dim.ALIAS_SCHEMA), 'a')}",
    "machines": f"SELECT * FROM {dim.values(dim.MACHINES, dim.names_of(dim.MACHINE_SCHEMA), 'm')}",
    "machine_files": "SELECT f.source_file_id, m.machine_id FROM source_files f JOIN machines m ON m.root = f.root",
    "lines": """
      SELECT r.*, p.session_id, p.timestamp_raw, p.timestamp_utc, p.cwd, p.is_sidechain, f.root, f.relative_path, w.first_run_id, w.line_number, w.source_file_id,
             coalesce(coalesce(p.session_id, '<missing>') || '/m/' || nullif(message_id, ''), coalesce(p.session_id, '<missing>') || '/r/' || nullif(request_id, '')) AS dedup_key
      FROM requests r JOIN parsed_lines p USING (raw_line_id) JOIN raw_lines w USING (raw_line_id) JOIN source_files f ON f.source_file_id = w.source_file_id""",
    "dedup": """
      SELECT * FROM lines WHERE dedup_key IS NULL UNION ALL
      SELECT * FROM lines WHERE dedup_key IS NOT NULL QUALIFY row_number() OVER (
        PARTITION BY dedup_key ORDER BY output_tokens DESC NULLS LAST, is_sidechain, timestamp_utc ASC NULLS LAST, root DESC, relative_path DESC, first_run_id DESC, line_number DESC, raw_line_id DESC) = 1""",
    "caught": """
      SELECT w.raw_line_id, window_name, resets_at, CAST(round(resets_at * 1000) AS BIGINT) AS reset, used_percentage, session_id,
             CAST(round(CASE WHEN captured_at_s > 1e11 THEN captured_at_s ELSE captured_at_s * 1000 END) AS BIGINT) AS cap
      FROM rate_limit_windows w JOIN status_readings s USING (raw_line_id) WHERE status = 'ok' AND validity = 'valid' AND window_name IN ('five_hour', 'seven_day')""",
    "answered": f"""
      SELECT c.*, arg_max(coalesce(l.dedup_key, 'line:' || l.raw_line_id), (epoch_ms(l.timestamp_utc), l.raw_line_id)) AS response
      FROM caught c LEFT JOIN lines l ON l.session_id = c.session_id AND epoch_ms(l.timestamp_utc) < c.cap + 1000 AND epoch_ms(l.timestamp_utc) > c.reset - {_LEN} * 1000
      GROUP BY ALL""",
    "firsts": "SELECT coalesce(dedup_key, 'line:' || raw_line_id) AS response, min(epoch_ms(timestamp_utc)) AS first_line FROM lines GROUP BY 1",
    "runs": """
      SELECT *, sum(CASE WHEN prev IS NULL OR abs(used_percentage - prev) > 0.01 THEN 1 ELSE 0 END) OVER (PARTITION BY window_name, reset, session_id, g ORDER BY cap, raw_line_id ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT a.*, f.first_line, coalesce(a.response, 'capture:' || raw_line_id) AS g,
                   lag(used_percentage) OVER (PARTITION BY window_name, reset, session_id, coalesce(a.response, 'capture:' || raw_line_id) ORDER BY cap, raw_line_id) AS prev
            FROM answered a LEFT JOIN firsts f ON f.response = a.response)""",
    "observations": """
      SELECT *, CASE WHEN first_line IS NULL THEN cap WHEN run = 1 THEN first_line ELSE (SELECT min(b.cap) FROM runs b WHERE b.window_name = a.window_name AND b.reset = a.reset AND b.session_id IS NOT DISTINCT FROM a.session_id AND b.g = a.g AND b.run = a.run) END AS observed
      FROM (SELECT *, row_number() OVER (PARTITION BY window_name, reset, session_id, g, run ORDER BY cap DESC, raw_line_id DESC) AS copy FROM runs) a WHERE copy = 1""",
    "readings": """
      SELECT raw_line_id, window_name, resets_at, make_timestamp(reset * 1000) AS reset_at_utc, used_percentage, session_id, make_timestamp(cap * 1000) AS captured_at_utc, make_timestamp(observed * 1000) AS observed_at_utc,
             CASE WHEN response IS NULL THEN 'capture' WHEN run = 1 THEN 'last_request' ELSE 'changed_capture' END AS observed_via, CAST(observed > reset AS INTEGER) AS after_reset,
             CASE WHEN observed <= reset AND used_percentage < max(used_percentage) OVER (PARTITION BY window_name, reset ORDER BY observed, raw_line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 THEN 1 ELSE 0 END AS stale, observed, reset
      FROM observations""",
    "coverage": """
      SELECT 'session_logs' AS source, min(timestamp_utc) AS covers_from, max(timestamp_utc) AS covers_to FROM parsed_lines
      UNION ALL SELECT 'status_line', min(observed_at_utc), max(observed_at_utc) FROM readings""",
    "resolved": """
      SELECT DISTINCT cwd, CASE WHEN cwd NOT LIKE '/opt/%' THEN nullif(regexp_extract(cwd, '^(/.*?/code/[^/]+)', 1), '') END AS repo_root, CAST(cwd NOT LIKE '%-docs%' AS INTEGER) AS root_exists,
             CASE WHEN cwd LIKE '/opt/%' THEN 'not_git' ELSE 'repo' END AS kind
      FROM parsed_lines WHERE cwd IS NOT NULL AND cwd NOT LIKE '/mnt/%'""",
    "named": """
      SELECT raw_line_id, d.cwd, CASE WHEN r.cwd IS NULL THEN 'unresolved' WHEN repo_root IS NOT NULL AND root_exists = 1 THEN 'repo' WHEN repo_root IS NOT NULL THEN 'missing' ELSE kind END AS repo_kind, coalesce(repo_root, d.cwd) AS repository
      FROM dedup d LEFT JOIN resolved r ON r.cwd = d.cwd""",
    "repositories": """
      SELECT n.raw_line_id, n.cwd,
             CASE WHEN a.from_repository IS NULL THEN n.repo_kind ELSE coalesce((SELECT min(CASE repo_kind WHEN 'repo' THEN ' repo' ELSE repo_kind END) FROM named m WHERE m.repository = a.to_repository), n.repo_kind) END AS kind_,
             coalesce(a.to_repository, n.repository) AS repository, CASE WHEN a.from_repository IS NOT NULL THEN n.repository END AS aliased_from
      FROM named n LEFT JOIN aliases a ON a.from_repository = n.repository""",
    "priced": """
      SELECT d.*, strftime(timestamp_utc, '%Y-%m-%d') AS day_utc, p.* EXCLUDE (model_id), p.model_id AS price_model,
             d.input_tokens + d.cache_read_tokens + coalesce(cache_write_5m_tokens, 0) + coalesce(cache_write_1h_tokens, 0) + coalesce(cache_write_unsplit_tokens, 0) AS whole
      FROM dedup d LEFT JOIN prices p ON p.model_id = d.model AND p.effective_from = (SELECT max(q.effective_from) FROM prices q WHERE q.model_id = d.model AND q.effective_from <= strftime(d.timestamp_utc, '%Y-%m-%d'))""",
    "reasons": """
      SELECT *, coalesce(speed = 'fast', false) AS fast, CASE WHEN inference_geo = 'us' THEN 1.1 ELSE 1.0 END AS geo,
             CASE WHEN timestamp_utc IS NULL THEN 'unparsed_timestamp' WHEN price_model IS NULL THEN 'no_price_row' WHEN speed = 'fast' AND fast_input_rate IS NULL THEN 'fast_rate_unknown'
                  WHEN service_tier <> 'standard' THEN 'service_tier_not_standard' WHEN whole > standard_max_input THEN 'long_context_rate_unverified' END AS unpriced_reason
      FROM priced""",
    "cost_parts": """
      SELECT *, CAST(CASE WHEN unpriced_reason IS NULL THEN CASE WHEN fast THEN fast_input_rate ELSE input_rate END * input_tokens * geo / 1e6 END AS DOUBLE) AS input_usd,
             CAST(CASE WHEN unpriced_reason IS NULL THEN CASE WHEN fast THEN fast_output_rate ELSE output_rate END * output_tokens * geo / 1e6 END AS DOUBLE) AS output_usd,
             CAST(CASE WHEN unpriced_reason IS NULL THEN CASE WHEN fast THEN fast_read_rate ELSE read_rate END * cache_read_tokens * geo / 1e6 END AS DOUBLE) AS cache_read_usd,
             CAST(CASE WHEN unpriced_reason IS NULL THEN CASE WHEN fast THEN fast_write_5m_rate ELSE write_5m_rate END * (coalesce(cache_write_5m_tokens, 0) + coalesce(cache_write_unsplit_tokens, 0)) * geo / 1e6 END AS DOUBLE) AS cache_write_5m_usd,
             CAST(CASE WHEN unpriced_reason IS NULL THEN CASE WHEN fast THEN fast_write_1h_rate ELSE write_1h_rate END * coalesce(cache_write_1h_tokens, 0) * geo / 1e6 END AS DOUBLE) AS cache_write_1h_usd
      FROM reasons""",
    "costs": "SELECT *, CAST(CASE WHEN unpriced_reason IS NULL AND cache_write_unsplit_tokens > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_lower_bound, input_usd + output_usd + cache_read_usd + cache_write_5m_usd + cache_write_1h_usd AS total_usd FROM cost_parts",
    "copies": "SELECT p.*, w.root, w.relative_path, w.line_number, w.line_bytes, coalesce(p.uuid, 'line:' || raw_line_id) AS u FROM parsed_lines p JOIN raw_lines w USING (raw_line_id)",
    "distinct_lines": "SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY session_id, u ORDER BY root, relative_path, copies.first_run_id, line_number, raw_line_id) = 1",
    "hit_lines": "SELECT * FROM copies WHERE line_class = 'limit_hit' QUALIFY row_number() OVER (PARTITION BY session_id, u ORDER BY root, relative_path, copies.first_run_id, line_number, raw_line_id) = 1",
    "said": r"""
      SELECT *, CASE WHEN contains(lower(message_text), 'session limit') OR contains(lower(message_text), '5-hour limit') THEN 'five_hour' WHEN contains(lower(message_text), 'weekly limit') THEN 'seven_day' END AS text_window,
             nullif(trim(regexp_extract(message_text, '(?i)resets (.*)$', 1)), '') AS reset_text, TRY_CAST(decode(line_bytes) AS JSON) AS j
      FROM hit_lines""",
    "quoted": r"""
      SELECT *, CASE WHEN j->>'$.quotaLimits.rateLimitType' IN ('five_hour', 'seven_day') THEN j->>'$.quotaLimits.rateLimitType' END AS quota_window,
             make_timestamp(CAST(j->>'$.quotaLimits.resetsAt' AS BIGINT) * 1000000) AS quota_reset,
             (CAST(regexp_extract(reset_text, '^(\d+)', 1) AS INTEGER) % 12 + CASE WHEN regexp_matches(reset_text, '(?i)pm') THEN 12 ELSE 0 END) * 60 + coalesce(TRY_CAST(regexp_extract(reset_text, ':(\d\d)', 1) AS INTEGER), 0) AS clock,
             date_trunc('minute', timestamp_utc) AS minute
      FROM said""",
    "timed": """
      SELECT *, CASE WHEN regexp_matches(reset_text, '^[0-9]{1,2}(:[0-9]{2})?[ap]m .UTC.$') THEN
               date_trunc('day', minute) + to_minutes(clock) + CASE WHEN date_trunc('day', minute) + to_minutes(clock) < minute THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END END AS text_reset
      FROM quoted""",
    "climb": f"""
      SELECT h.raw_line_id AS hit, h.session_id, (SELECT n.raw_line_id FROM distinct_lines n WHERE n.session_id = h.session_id AND n.uuid = h.parent_uuid) AS line_id, 0 AS passed FROM hit_lines h
      UNION ALL
      SELECT c.hit, c.session_id, (SELECT n.raw_line_id FROM distinct_lines n WHERE n.session_id = c.session_id AND n.uuid = l.parent_uuid), c.passed + 1
      FROM climb c JOIN distinct_lines l ON l.raw_line_id = c.line_id
      WHERE l.line_type = 'attachment' AND c.passed < 50 AND (TRY_CAST(decode(l.line_bytes) AS JSON)->>'$.attachment.type' IN ({_PASS})
        OR (TRY_CAST(decode(l.line_bytes) AS JSON)->>'$.attachment.type' = 'queued_command' AND TRY_CAST(decode(l.line_bytes) AS JSON)->>'$.attachment.commandMode' = 'task-notification'))""",
    "stops": "SELECT hit, max(passed) AS passed, arg_max(coalesce(line_id, -1), passed) AS line_id FROM climb GROUP BY hit",
    "logged": """
      SELECT t.raw_line_id, t.session_id, t.uuid, t.parent_uuid, t.timestamp_utc, t.is_sidechain, coalesce(quota_window, text_window) AS window_name, reset_text, coalesce(quota_reset, text_reset) AS reset_at_utc,
             CASE WHEN l.user_content = 'tool_result' THEN 'mid_task' WHEN l.user_content = 'prompt' AND l.is_meta = 0 THEN 'turn_start' ELSE 'unknown' END AS position, s.passed AS attachments_passed,
             CASE WHEN quota_window IS NOT NULL THEN 'log_field' WHEN text_window IS NOT NULL THEN 'log_text' END AS window_source, CASE WHEN quota_reset IS NOT NULL THEN 'log_field' WHEN text_reset IS NOT NULL THEN 'log_text' END AS reset_source
      FROM timed t JOIN stops s ON s.hit = t.raw_line_id LEFT JOIN parsed_lines l ON l.raw_line_id = s.line_id""",
    "groups": f"""
      SELECT raw_line_id, window_name, resets_at, session_id, n AS readings_at_limit, observed_at_utc AS first_at_utc, reset_at_utc, CAST({_LEN} AS INTEGER) AS window_seconds, reset
      FROM (SELECT *, row_number() OVER (PARTITION BY window_name, resets_at ORDER BY observed, raw_line_id) AS k, count(*) OVER (PARTITION BY window_name, resets_at) AS n FROM readings WHERE used_percentage >= 100 AND after_reset = 0) WHERE k = 1""",
    "matched": """
      SELECT l.*, (SELECT arg_min(g.raw_line_id, (g.resets_at, g.window_name)) FROM groups g WHERE (l.window_name IS NULL OR l.window_name = g.window_name)
             AND epoch_ms(l.timestamp_utc) > g.reset - g.window_seconds * 1000 AND epoch_ms(l.timestamp_utc) <= g.reset) AS status_raw_line_id
      FROM logged l""",
    "all_hits": """
      SELECT 'session_log' AS source, l.raw_line_id, l.status_raw_line_id, l.session_id, l.timestamp_utc AS hit_at_utc, coalesce(l.window_name, g.window_name) AS window_name, coalesce(g.reset_at_utc, l.reset_at_utc) AS reset_at_utc,
             CASE WHEN g.raw_line_id IS NOT NULL THEN 'status_line' ELSE l.reset_source END AS reset_source, reset_text, position, is_sidechain, attachments_passed
      FROM matched l LEFT JOIN groups g ON g.raw_line_id = l.status_raw_line_id
      UNION ALL
      SELECT 'status_line', raw_line_id, raw_line_id, session_id, first_at_utc, window_name, reset_at_utc, 'status_line', NULL, 'unknown', 0, 0 FROM groups WHERE raw_line_id NOT IN (SELECT status_raw_line_id FROM matched WHERE status_raw_line_id IS NOT NULL)""",
    "hits": f"""
      SELECT h.*, {_SECONDS.format("reset_at_utc", "hit_at_utc")} AS hit_to_reset_seconds,
             (SELECT min(d.timestamp_utc) FROM dedup d WHERE d.session_id = h.session_id AND d.timestamp_utc > h.hit_at_utc) AS next_session_request_at_utc,
             (SELECT min(p.timestamp_utc) FROM parsed_lines p WHERE p.session_id = h.session_id AND p.user_content = 'prompt' AND p.is_meta = 0 AND p.timestamp_utc > h.hit_at_utc) AS next_session_prompt_at_utc,
             (SELECT arg_min(struct_pack(k := p.origin_kind), (p.timestamp_utc, p.raw_line_id)).k FROM parsed_lines p WHERE p.session_id = h.session_id AND p.user_content = 'prompt' AND p.is_meta = 0 AND p.timestamp_utc > h.hit_at_utc) AS next_session_prompt_origin_kind,
             reset_at_utc > (SELECT covers_to FROM coverage WHERE source = 'session_logs') AS reset_after_coverage
      FROM all_hits h""",
    "islands": """
      SELECT raw_line_id, start_utc, end_utc, sum(CASE WHEN seen IS NULL OR start_utc > seen THEN 1 ELSE 0 END) OVER (ORDER BY start_utc, end_utc, raw_line_id ROWS UNBOUNDED PRECEDING)::BIGINT AS interval_number
      FROM (SELECT *, max(end_utc) OVER (ORDER BY start_utc, end_utc, raw_line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
            FROM (SELECT raw_line_id, hit_at_utc AS start_utc, greatest(reset_at_utc, hit_at_utc) AS end_utc FROM hits WHERE hit_at_utc IS NOT NULL AND reset_at_utc IS NOT NULL))""",
    "marks": f"""
      SELECT m.raw_line_id, m.session_id, m.timestamp_utc AS continued_at_utc, (SELECT arg_max(h.raw_line_id, (h.timestamp_utc, h.raw_line_id)) FROM hit_lines h WHERE h.session_id = m.session_id AND h.timestamp_utc < m.timestamp_utc) AS hit_raw_line_id
      FROM (SELECT * FROM copies WHERE origin_kind = '{dim.CONTINUATION}' AND is_meta = 1 AND timestamp_utc IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY session_id, u ORDER BY root, relative_path, copies.first_run_id, line_number, raw_line_id) = 1) m""",
    "locks": f"""
      SELECT interval_number, locked_from_utc, locked_until_utc, hits, next_request_at_utc, {_SECONDS.format("locked_until_utc", "locked_from_utc")} AS lockout_seconds, {_SECONDS.format("next_request_at_utc", "locked_until_utc")} AS reset_to_next_request_seconds,
             locked_until_utc > (SELECT covers_to FROM coverage WHERE source = 'session_logs') AS reset_after_coverage, auto_continuations, {_SECONDS.format("first_mark", "locked_until_utc")} AS first_auto_continuation_seconds, sessions, refused_requests
      FROM (SELECT i.*, (SELECT min(d.timestamp_utc) FROM dedup d WHERE d.timestamp_utc >= i.locked_until_utc) AS next_request_at_utc FROM (
        SELECT interval_number, min(start_utc) AS locked_from_utc, max(end_utc) AS locked_until_utc, count(*) AS hits, count(DISTINCT coalesce(p.session_id, s.session_id)) AS sessions, count(p.raw_line_id) AS refused_requests,
               CAST(coalesce(sum((SELECT count(*) FROM marks m WHERE m.hit_raw_line_id = h.raw_line_id)), 0) AS BIGINT) AS auto_continuations, min((SELECT min(m.continued_at_utc) FROM marks m WHERE m.hit_raw_line_id = h.raw_line_id)) AS first_mark
        FROM islands h LEFT JOIN parsed_lines p USING (raw_line_id) LEFT JOIN status_readings s USING (raw_line_id) GROUP BY interval_number) i)""",
    "last_hits": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY hit_at_utc DESC, raw_line_id DESC) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM hits WHERE session_id <> '<missing>' AND hit_at_utc IS NOT NULL) WHERE k = 1",
    "not_resumed": "SELECT session_id, raw_line_id AS last_hit_raw_line_id, hit_at_utc AS last_hit_at_utc, reset_at_utc, reset_after_coverage, n AS hits FROM last_hits h WHERE NOT EXISTS (SELECT 1 FROM dedup d WHERE d.session_id = h.session_id AND d.timestamp_utc > h.hit_at_utc)",
    "instances": f"""
      SELECT window_name, resets_at, min(reset_at_utc) AS reset_at_utc, count(*) FILTER (WHERE after_reset = 0) AS readings, count(*) FILTER (WHERE after_reset = 1) AS readings_after_reset, min(observed_at_utc) FILTER (WHERE after_reset = 0) AS first_reading_at_utc,
             resets_at > (SELECT max(CASE WHEN captured_at_s > 1e11 THEN captured_at_s / 1000 ELSE captured_at_s END) FROM status_readings WHERE status = 'ok') AS window_open, {_LINE},
             count(*) FILTER (WHERE after_reset = 0 AND stale = 1) AS readings_stale
      FROM readings GROUP BY window_name, resets_at""",
    "headroom": """
      SELECT i.window_name, i.reset_at_utc, r.used_percentage AS last_used_percentage, r.observed_at_utc AS last_reading_at_utc, r.raw_line_id AS last_reading_raw_line_id, readings, readings_after_reset, first_reading_at_utc, window_open, covers_from, covers_to, readings_stale
      FROM instances i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY window_name, resets_at ORDER BY observed DESC, raw_line_id DESC) AS k FROM readings WHERE after_reset = 0 AND stale = 0) r ON r.window_name = i.window_name AND r.resets_at = i.resets_at AND r.k = 1""",
    "peak": """
      SELECT i.window_name, i.reset_at_utc, r.used_percentage AS peak_used_percentage, r.observed_at_utc AS peak_reading_at_utc, r.raw_line_id AS peak_reading_raw_line_id, readings, readings_after_reset, window_open, covers_from, covers_to
      FROM instances i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY window_name, resets_at ORDER BY used_percentage DESC, observed, raw_line_id) AS k FROM readings WHERE after_reset = 0) r ON r.window_name = i.window_name AND r.resets_at = i.resets_at AND r.k = 1""",
    "levels": """
      SELECT window_name, reset_at_utc, threshold, observed_at_utc AS first_at_utc, used_percentage, (reset - observed) / 1000.0 AS seconds_before_reset, raw_line_id
      FROM (SELECT r.*, threshold, row_number() OVER (PARTITION BY window_name, reset, threshold ORDER BY observed, raw_line_id) AS k FROM readings r JOIN (VALUES (75), (90)) l(threshold) ON used_percentage >= threshold WHERE after_reset = 0) WHERE k = 1""",
    "pairs": """
      SELECT window_name, reset_at_utc, pid AS previous_raw_line_id, raw_line_id, pat AS previous_observed_at_utc, observed_at_utc, used_percentage - pu AS change_percentage_points,
             (SELECT count(DISTINCT coalesce(l.dedup_key, 'line:' || l.raw_line_id)) FROM lines l WHERE l.timestamp_utc >= pat AND l.timestamp_utc < observed_at_utc + INTERVAL 1 SECOND) AS requests_between
      FROM (SELECT *, lag(raw_line_id) OVER w AS pid, lag(used_percentage) OVER w AS pu, lag(observed_at_utc) OVER w AS pat FROM readings WHERE after_reset = 0 AND stale = 0 WINDOW w AS (PARTITION BY window_name, reset ORDER BY observed, raw_line_id)) WHERE pid IS NOT NULL""",
    "usage": f"""
      SELECT d.raw_line_id, d.dedup_key, d.session_id, d.timestamp_utc, d.model, CASE WHEN f.machine_id IS NULL THEN r.repository END AS repository, CASE WHEN f.machine_id IS NULL THEN trim(r.kind_) ELSE 'other_machine' END AS repo_kind, {_TOKENS},
             CASE WHEN f.machine_id IS NULL THEN r.aliased_from END AS aliased_from
      FROM dedup d JOIN repositories r USING (raw_line_id) LEFT JOIN machine_files f ON f.source_file_id = d.source_file_id""",
    "periods": "SELECT effective_month AS from_month, lead(effective_month) OVER (ORDER BY effective_month) AS until_month, plan_name FROM plans",
    "hit_plans": f"""
      SELECT h.raw_line_id, h.session_id, h.hit_at_utc, h.window_name, h.source, CASE WHEN h.hit_at_utc IS NULL THEN 'unknown' WHEN p.from_month IS NULL THEN 'none' ELSE 'plan' END AS period_kind, p.from_month, p.until_month, p.plan_name
      FROM hits h LEFT JOIN periods p ON {_MONTH.format("h.hit_at_utc")} >= p.from_month AND (p.until_month IS NULL OR {_MONTH.format("h.hit_at_utc")} < p.until_month)""",
    "lock_plans": f"""
      SELECT l.*, CASE WHEN p.from_month IS NULL THEN 'none' ELSE 'plan' END AS period_kind, p.from_month, p.until_month, p.plan_name
      FROM locks l LEFT JOIN periods p ON {_MONTH.format("l.locked_from_utc")} >= p.from_month AND (p.until_month IS NULL OR {_MONTH.format("l.locked_from_utc")} < p.until_month)""",
    "week": "SELECT max(reset_at_utc) - INTERVAL 7 DAY AS starts_at_utc, max(reset_at_utc) AS reset_at_utc FROM instances WHERE window_name = 'seven_day'",
    "by_machine": f"""
      SELECT d.raw_line_id, d.dedup_key, d.timestamp_utc, d.model, coalesce(f.machine_id, '{dim.THIS_MACHINE[0]}') AS machine_id, CASE WHEN f.machine_id IS NULL THEN '{dim.THIS_MACHINE[1]}' ELSE coalesce(m.label, 'Unnamed machine') END AS machine_label,
             f.machine_id IS NULL AS is_this_machine, d.input_tokens, d.output_tokens, d.cache_read_tokens, coalesce(cache_write_5m_tokens, 0) + coalesce(cache_write_1h_tokens, 0) + coalesce(cache_write_unsplit_tokens, 0) AS cache_write_tokens,
             coalesce(d.timestamp_utc >= w.starts_at_utc AND d.timestamp_utc < w.reset_at_utc, false) AS in_latest_week
      FROM dedup d LEFT JOIN machine_files f ON f.source_file_id = d.source_file_id LEFT JOIN machines m ON m.machine_id = f.machine_id LEFT JOIN week w ON true""",
    "machine_prices": """
      SELECT machine_id, machine_label, bool_or(is_this_machine) AS is_this_machine, coalesce(sum(total_usd), 0.0) AS list_price_usd, coalesce(sum(total_usd) FILTER (WHERE in_latest_week), 0.0) AS week_list_price_usd,
             count(*) FILTER (WHERE unpriced_reason IS NOT NULL) AS unpriced_requests, min(r.timestamp_utc) AS covers_from, max(r.timestamp_utc) AS covers_to
      FROM by_machine r JOIN costs c USING (raw_line_id) GROUP BY machine_id, machine_label""",
}

_SUMS = "count(*) AS requests, " + ", ".join(f"CAST({'coalesce(sum(' + c + '), 0)' if c.endswith('unsplit_tokens') else 'sum(' + c + ')'} AS BIGINT) AS {c}" for c in _TOKENS.split(", "))
_COSTS = f"raw_line_id, dedup_key, model, day_utc, timestamp_utc, speed, service_tier, inference_geo, {_TOKENS}, unpriced_reason, effective_from AS price_effective_from, verified_on, is_lower_bound, " + ", ".join(
    f"round({c}, 9) AS {c}" for c in ("input_usd", "output_usd", "cache_read_usd", "cache_write_5m_usd", "cache_write_1h_usd", "total_usd")
)
_HITS = "source, raw_line_id, status_raw_line_id, session_id, hit_at_utc, window_name, reset_at_utc, reset_source, reset_text, position, is_sidechain, attachments_passed, hit_to_reset_seconds, next_session_request_at_utc, next_session_prompt_at_utc, next_session_prompt_origin_kind, reset_after_coverage"
_PAIRS = "window_name, reset_at_utc, previous_raw_line_id, raw_line_id, previous_observed_at_utc, observed_at_utc, round(change_percentage_points, 9) AS change_percentage_points, requests_between"

SELECTS: dict[str, str] = {
    "v01_requests_dedup": f"SELECT raw_line_id, dedup_key, message_id, request_id, model, {_TOKENS}, speed, session_id, timestamp_raw, timestamp_utc, cwd, is_sidechain, root, relative_path, first_run_id, line_number FROM dedup",
    "v02_window_readings": "SELECT * EXCLUDE (observed, reset) FROM readings",
    "v03_request_repositories": "SELECT raw_line_id, cwd, trim(kind_) AS repo_kind, repository, aliased_from FROM repositories",
    "v04_request_costs": f"SELECT {_COSTS} FROM costs",
    "v05_unpriced_requests": "SELECT raw_line_id, dedup_key, model, day_utc, speed, service_tier, unpriced_reason FROM costs WHERE unpriced_reason IS NOT NULL",
    "v06_source_coverage": "SELECT * FROM coverage",
    "v07_logged_limit_hits": "SELECT * FROM logged",
    "v08_status_limit_groups": "SELECT * EXCLUDE (reset) FROM groups",
    "v09_limit_hits_events": f"SELECT {_HITS} FROM hits",
    "v10_limit_hits": f"""
      SELECT count(*) AS hits, count(*) FILTER (WHERE source = 'session_log') AS logged_hits, count(*) FILTER (WHERE source = 'status_line') AS status_line_only_hits, count(*) FILTER (WHERE window_name = 'five_hour') AS five_hour_hits,
             count(*) FILTER (WHERE window_name = 'seven_day') AS seven_day_hits, count(*) FILTER (WHERE window_name IS NULL) AS unknown_window_hits, {_LOGS}, {_SPAN.format("status_line", "status_line_")} FROM hits""",
    "v11_mid_task_events": f"SELECT {_HITS} FROM hits WHERE position = 'mid_task'",
    "v12_mid_task": f"SELECT count(*) FILTER (WHERE position = 'mid_task') AS mid_task, count(*) FILTER (WHERE position = 'turn_start') AS turn_start, count(*) FILTER (WHERE position = 'unknown') AS position_unknown, {_LOGS} FROM hits",
    "v13_lockout_interval_hits": "SELECT * FROM islands",
    "v14_auto_continuation_marks": "SELECT * FROM marks",
    "v15_lockout_intervals": "SELECT * FROM locks",
    "v16_lockout_time": f"SELECT count(*) AS intervals, round(coalesce(sum(lockout_seconds), 0.0), 6) AS lockout_seconds, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits_with_known_reset, (SELECT count(*) FROM hits WHERE reset_at_utc IS NULL OR hit_at_utc IS NULL) AS hits_with_unknown_reset, {_LOGS} FROM locks",
    "v17_auto_continuation_events": f"SELECT m.*, i.interval_number, l.locked_until_utc, {_SECONDS.format('m.continued_at_utc', 'l.locked_until_utc')} AS seconds_after_reset FROM marks m JOIN islands i ON i.raw_line_id = m.hit_raw_line_id JOIN locks l ON l.interval_number = i.interval_number",
    "v18_sessions_not_resumed_events": "SELECT * FROM not_resumed",
    "v19_sessions_not_resumed": f"SELECT (SELECT count(*) FROM last_hits) AS sessions_with_hits, count(*) AS sessions_not_resumed, count(*) FILTER (WHERE reset_after_coverage) AS reset_after_coverage, count(*) FILTER (WHERE reset_at_utc IS NULL) AS reset_unknown, {_LOGS} FROM not_resumed",
    "v20_window_instances": "SELECT * FROM instances",
    "v21_window_headroom": "SELECT * FROM headroom",
    "v22_window_peak": "SELECT * FROM peak",
    "v23_weekly_crossings": "SELECT * FROM levels WHERE window_name = 'seven_day'",
    "v23b_five_hour_crossings": "SELECT * FROM levels WHERE window_name = 'five_hour'",
    "v24_window_reading_pairs": f"SELECT {_PAIRS} FROM pairs",
    "v25_unattributed_usage_events": f"SELECT {_PAIRS} FROM pairs WHERE requests_between = 0 AND change_percentage_points > 0",
    "v26_unattributed_usage": """
      SELECT i.window_name, i.reset_at_utc, readings, coalesce(pairs, 0) AS pairs, coalesce(pairs_without_requests, 0) AS pairs_without_requests, coalesce(decreasing_pairs, 0) AS decreasing_pairs,
             CASE WHEN readings >= 2 THEN round(coalesce(points, 0.0), 6) END AS unattributed_percentage_points, window_open, covers_from, covers_to
      FROM instances i LEFT JOIN (SELECT window_name, reset_at_utc, count(*) AS pairs, count(*) FILTER (WHERE requests_between = 0) AS pairs_without_requests, count(*) FILTER (WHERE change_percentage_points < 0) AS decreasing_pairs,
        sum(change_percentage_points) FILTER (WHERE requests_between = 0 AND change_percentage_points > 0) AS points FROM pairs GROUP BY 1, 2) t ON t.window_name = i.window_name AND t.reset_at_utc = i.reset_at_utc""",
    "v27_usage_events": "SELECT * FROM usage",
    "v28_usage_by_model": f"SELECT model, {_SUMS}, count(*) FILTER (WHERE dedup_key IS NULL) AS unkeyed_requests, count(*) FILTER (WHERE timestamp_utc IS NULL) AS requests_without_timestamp, min(timestamp_utc) AS first_request_at_utc, max(timestamp_utc) AS last_request_at_utc, {_LOGS} FROM usage GROUP BY model",
    "v29_usage_by_repo": f"SELECT repository, repo_kind, {_SUMS}, count(*) FILTER (WHERE timestamp_utc IS NULL) AS requests_without_timestamp, {_LOGS} FROM usage GROUP BY repository, repo_kind",
    "v30_plan_periods": "SELECT * FROM periods",
    "v31_limit_hits_by_plan_events": "SELECT * FROM hit_plans",
    "v32_lockout_by_plan_events": "SELECT * FROM lock_plans",
    "v33_interruptions_by_plan": f"""
      SELECT * FROM (
        SELECT p.period_kind, p.from_month, CASE WHEN p.until_month IS NOT NULL THEN strftime(CAST(p.until_month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') END AS to_month, p.until_month, p.plan_name,
          (SELECT count(*) FROM hit_plans h WHERE h.period_kind = p.period_kind AND h.from_month IS NOT DISTINCT FROM p.from_month) AS hits,
          (SELECT count(*) FROM hit_plans h WHERE h.period_kind = p.period_kind AND h.from_month IS NOT DISTINCT FROM p.from_month AND window_name = 'five_hour') AS five_hour_hits,
          (SELECT count(*) FROM hit_plans h WHERE h.period_kind = p.period_kind AND h.from_month IS NOT DISTINCT FROM p.from_month AND window_name = 'seven_day') AS seven_day_hits,
          (SELECT count(*) FROM hit_plans h WHERE h.period_kind = p.period_kind AND h.from_month IS NOT DISTINCT FROM p.from_month AND window_name IS NULL) AS unknown_window_hits,
          (SELECT count(*) FROM lock_plans l WHERE l.period_kind = p.period_kind AND l.from_month IS NOT DISTINCT FROM p.from_month) AS lockouts,
          round(coalesce((SELECT sum(lockout_seconds) FROM lock_plans l WHERE l.period_kind = p.period_kind AND l.from_month IS NOT DISTINCT FROM p.from_month), 0.0), 6) AS lockout_seconds,
          (SELECT min(t) FROM times WHERE p.period_kind <> 'unknown' AND (p.from_month IS NULL OR {_MONTH.format("t")} >= p.from_month) AND (p.until_month IS NULL OR {_MONTH.format("t")} < p.until_month)) AS covers_from,
          (SELECT max(t) FROM times WHERE p.period_kind <> 'unknown' AND (p.from_month IS NULL OR {_MONTH.format("t")} >= p.from_month) AND (p.until_month IS NULL OR {_MONTH.format("t")} < p.until_month)) AS covers_to
        FROM (SELECT 'plan' AS period_kind, * FROM periods UNION ALL SELECT 'none', NULL, (SELECT min(from_month) FROM periods), NULL UNION ALL SELECT 'unknown', NULL, NULL, NULL) p)
      WHERE hits > 0 OR covers_from IS NOT NULL""",
    "v34_burn_rate": f"""
      SELECT window_name, reset_at_utc, make_timestamp(start * 1000) AS window_start_utc, last_used_percentage, last_reading_at_utc, window_open, last_used_percentage >= 100 AS limit_reached,
             CASE WHEN since > 0 THEN round(last_used_percentage * 3600000 / since, 6) END AS projected_percentage_points_per_hour,
             CASE WHEN since > 0 AND last_used_percentage > 0 AND last_used_percentage < 100 THEN make_timestamp(CAST(floor(start + since * 100.0::DOUBLE / last_used_percentage + 0.5) AS BIGINT) * 1000) END AS projected_limit_at_utc,
             CASE WHEN since > 0 AND last_used_percentage > 0 AND last_used_percentage < 100 THEN start + since * 100.0::DOUBLE / last_used_percentage < epoch_ms(reset_at_utc) END AS projected_limit_before_reset, covers_from, covers_to
      FROM (SELECT *, epoch_ms(reset_at_utc) - {_LEN} * 1000 AS start, epoch_ms(last_reading_at_utc) - epoch_ms(reset_at_utc) + {_LEN} * 1000 AS since FROM headroom)""",
    "v35_api_list_price": f"""
      SELECT m.*, (SELECT arg_max(plan_name, effective_month) FROM plans p WHERE p.effective_month <= m.month) AS plan_name, (SELECT arg_max(usd_per_month, effective_month)::DOUBLE FROM plans p WHERE p.effective_month <= m.month) AS plan_usd_per_month
      FROM (SELECT {_MONTH.format("timestamp_utc")} AS month, count(*) AS requests, count(*) FILTER (WHERE unpriced_reason IS NULL) AS priced_requests, count(*) FILTER (WHERE unpriced_reason IS NOT NULL) AS unpriced_requests,
              count(*) FILTER (WHERE is_lower_bound = 1) AS lower_bound_requests, count(*) FILTER (WHERE unpriced_reason IS NULL AND day_utc < verified_on) AS priced_before_verified_requests, max(verified_on) AS verified_on,
              CASE WHEN count(*) FILTER (WHERE unpriced_reason IS NULL) > 0 THEN round(sum(total_usd), 6) END AS api_list_price_usd, min(timestamp_utc) AS covers_from, max(timestamp_utc) AS covers_to
            FROM costs WHERE timestamp_utc IS NOT NULL GROUP BY 1) m""",
    "v36_line_machines": "SELECT r.raw_line_id, f.machine_id FROM raw_lines r LEFT JOIN machine_files f USING (source_file_id)",
    "v37_latest_weekly_window": "SELECT * FROM week",
    "v38_machine_requests": "SELECT * FROM by_machine",
    "v39_usage_by_machine": """
      SELECT r.machine_id, r.machine_label, bool_or(is_this_machine) AS is_this_machine, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
             CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, count(*) FILTER (WHERE in_latest_week) AS week_requests, CAST(coalesce(sum(output_tokens) FILTER (WHERE in_latest_week), 0) AS BIGINT) AS week_output_tokens,
             min(timestamp_utc) AS covers_from, max(timestamp_utc) AS covers_to, any_value(m.exported_at) AS last_export_at_utc, any_value(w.starts_at_utc) AS week_starts_at_utc, any_value(w.reset_at_utc) AS week_reset_at_utc
      FROM by_machine r LEFT JOIN machines m ON m.machine_id = r.machine_id LEFT JOIN week w ON true GROUP BY r.machine_id, r.machine_label""",
    "v40_api_list_price_by_machine": """
      SELECT p.machine_id, machine_label, is_this_machine, round(list_price_usd, 6) AS list_price_usd, round(week_list_price_usd, 6) AS week_list_price_usd, unpriced_requests, covers_from, covers_to,
             round(list_price_usd / nullif((SELECT sum(list_price_usd) FROM machine_prices), 0), 6) AS share_of_recorded, round(week_list_price_usd / nullif((SELECT sum(week_list_price_usd) FROM machine_prices), 0), 6) AS week_share_of_recorded,
             w.starts_at_utc AS week_starts_at_utc, w.reset_at_utc AS week_reset_at_utc FROM machine_prices p LEFT JOIN week w ON true""",
}
CTES["times"] = "SELECT timestamp_utc AS t FROM dedup WHERE timestamp_utc IS NOT NULL UNION ALL SELECT hit_at_utc FROM hits WHERE hit_at_utc IS NOT NULL"


def with_ctes(select: str) -> str:
    """The select with the definitions it needs, in order."""
    need, todo = set(), [select]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
                need.add(name)
                todo.append(CTES[name])
    if not need:
        return select
    # Definitions read by several others are computed once.
    body = ",\n".join(f"{n} AS {'' if n == 'climb' else 'MATERIALIZED '}({CTES[n]})" for n in CTES if n in need)
    return f"WITH RECURSIVE {body.replace('climb AS (', 'climb(hit, session_id, line_id, passed) AS (')}\n{select}"


SQL = {name: with_ctes(s) for name, s in SELECTS.items()}
