"""Raw lines to derived tables: one narrow pass over the lines, no shuffle, each line by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import derive_log, derive_spool

#: Raised whenever a line would be derived otherwise; stored facts of another version are derived anew.
VERSION = "2"
_S, _L, _D, _I, _T = "string", "bigint", "double", "int", "timestamp_ntz"
LOG_FIELDS = {
    "line_class": _S, "session_id": _S, "line_type": _S, "subtype": _S, "timestamp_raw": _S, "timestamp_utc": _T, "cwd": _S, "git_branch": _S, "cc_version": _S,
    "is_sidechain": _I, "uuid": _S, "parent_uuid": _S, "origin_kind": _S, "user_content": _S, "is_meta": _I, "message_role": _S, "message_text": _S,
    "attachment_type": _S, "command_mode": _S, "dedup_key": _S, "message_id": _S, "request_id": _S, "model": _S,
    "input_tokens": _D, "output_tokens": _D, "cache_read_tokens": _D, "cache_write_5m_tokens": _D, "cache_write_1h_tokens": _D, "cache_write_unsplit_tokens": _D,
    "speed": _S, "service_tier": _S, "inference_geo": _S, "error": _S, "api_error_status": _D, "retry_rate_limits": _I, "unknown_error": _S,
    "text_window": _S, "reset_text": _S, "text_reset_at_utc": _T, "quota_window": _S, "quota_reset_at_utc": _T,
    "original_model": _S, "fallback_model": _S, "refusal_category": _S, "ignored_type": _S, "problems": "array<struct<problem:string,detail:string>>",
}
SPOOL_FIELDS = {
    "status": _S, "captured_at_s": _D, "hook_version": _L, "session_id": _S, "transcript_path": _S, "model_id": _S, "cc_version": _S, "cost_total_usd": _D, "has_rate_limits": _I,
    "windows": "array<struct<window_name:string,used_percentage:double,resets_at:double,validity:string>>",
}
_ARROW = {
    _S: pa.string(), _L: pa.int64(), _D: pa.float64(), _I: pa.int32(), _T: pa.timestamp("us"),
    LOG_FIELDS["problems"]: pa.list_(pa.struct([("problem", pa.string()), ("detail", pa.string())])),
    SPOOL_FIELDS["windows"]: pa.list_(pa.struct([("window_name", pa.string()), ("used_percentage", pa.float64()), ("resets_at", pa.float64()), ("validity", pa.string())])),
}


def _derived(raw: DataFrame, kind: str, keep: list[str], fields: dict[str, str], of: Callable[[bytes | None], dict], only: list[str] | None) -> DataFrame:
    wanted = {k: v for k, v in fields.items() if only is None or k in only}
    types = [_ARROW[v] for v in wanted.values()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [of(x) for x in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([g.get(k) if k != "problems" else [dict(zip(("problem", "detail"), p, strict=True)) for p in g[k]] for g in got], t) for k, t in zip(wanted, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*keep, *wanted])

    rows = raw.filter(F.col("kind") == kind).select(*keep, "line_bytes")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{k} {v}" for k, v in wanted.items()])
    return rows.mapInArrow(scan, schema)


def log_facts(raw: DataFrame, keep: list[str] = ("raw_line_id", "first_run_id"), only: list[str] | None = None) -> DataFrame:
    """One row per log line with every derived field (or `only` those)."""
    return _derived(raw, "log", list(keep), LOG_FIELDS, derive_log, only)


def spool_facts(raw: DataFrame, keep: list[str] = ("raw_line_id",)) -> DataFrame:
    return _derived(raw, "spool", list(keep), SPOOL_FIELDS, derive_spool, None)


PARSED = ["raw_line_id", *list(LOG_FIELDS)[:17], "first_run_id"]
REQUEST = ["raw_line_id", "message_id", "request_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "cache_write_unsplit_tokens", "speed", "service_tier", "inference_geo"]
EVENT = ["raw_line_id", "line_class", "error", "api_error_status", "text_window", "reset_text", "text_reset_at_utc", "quota_window", "quota_reset_at_utc", "retry_rate_limits", "original_model", "fallback_model", "request_id", "refusal_category"]


def parsed_lines(facts: DataFrame) -> DataFrame:
    return facts.select(*PARSED)


def requests(facts: DataFrame) -> DataFrame:
    """The request lines. Token counts are whole numbers where JSON has them so; a fraction keeps its double in log_facts."""
    tokens = [c for c in REQUEST if c.endswith("_tokens")]
    return facts.filter("line_class = 'request'").select(*[F.col(c).cast("bigint").alias(c) if c in tokens else F.col(c) for c in REQUEST])


def events(facts: DataFrame) -> DataFrame:
    """Limit hits, API errors, other synthetic lines, retry notices and model fallbacks."""
    return facts.filter(F.col("line_class").isin("limit_hit", "api_error", "synthetic_other", "retry_notice", "model_fallback")).select(*EVENT)


def line_problems(facts: DataFrame) -> DataFrame:
    """raw_line_id, position, problem, detail: each line's problems in order."""
    return facts.select("raw_line_id", F.posexplode("problems").alias("position", "p")).select("raw_line_id", "position", "p.problem", "p.detail")


def status_readings(facts: DataFrame) -> DataFrame:
    return facts.drop("windows")


def rate_limit_windows(facts: DataFrame) -> DataFrame:
    return facts.select("raw_line_id", F.explode("windows").alias("w")).select("raw_line_id", "w.*")
