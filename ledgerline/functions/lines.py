"""What one line says: its class, links, tokens, limits and problems; pure functions of the line's bytes."""

from __future__ import annotations

import base64
import math
import re
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

from .strict_json import compact, filled, member, number, parse_object, text

MISSING = "<missing>"
SYNTHETIC_MODEL = "<synthetic>"
EVENT_CLASSES = frozenset(("limit_hit", "api_error", "synthetic_other", "retry_notice", "model_fallback"))
WINDOW_SECONDS = {"five_hour": 5 * 3600, "seven_day": 7 * 86400}

_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:(Z)|([+-])(\d\d):(\d\d))", re.ASCII)
_CLOCK = re.compile(r"(\d{1,2})(?::(\d\d))?\s*([ap])m\s*\(([^()]+)\)", re.I | re.ASCII)
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?")
#: Last second a four-digit year can write.
LATEST_SECOND = 253_402_300_799


def line_class(line: dict | None) -> str:
    """The first class that fits; error lines before requests, as synthetic error lines carry token counts too."""
    if line is None:
        return "malformed"
    kind, sub = line.get("type"), line.get("subtype")
    if line.get("isApiErrorMessage") is True:
        return "limit_hit" if line.get("error") == "rate_limit" else "api_error"
    if member(line, "message", "model") == SYNTHETIC_MODEL:
        return "synthetic_other"
    if kind == "assistant" and type(member(line, "message", "usage")) is dict:
        return "request"
    if kind == "system" and sub in ("api_error", "model_refusal_fallback"):
        return "retry_notice" if sub == "api_error" else "model_fallback"
    return "ignored_type"


def instant(raw: object) -> datetime | None:
    """A strict ISO-8601 time with seconds and zone, in UTC without zone, cut to milliseconds."""
    m = _ISO.fullmatch(raw) if type(raw) is str else None
    if not m:
        return None
    year, month, day, hour, minute, second = map(int, m.groups()[:6])
    offset = timedelta(hours=int(m[10] or 0), minutes=int(m[11] or 0))
    if int(m[10] or 0) > 23 or int(m[11] or 0) > 59:
        return None
    try:
        local = datetime(year, month, day, hour, minute, second, int((m[7] or "0")[:3].ljust(3, "0")) * 1000)
        return local + offset if m[9] == "-" else local - offset
    except (ValueError, OverflowError):
        return None


def content_text(line: dict) -> str | None:
    """A message's text: a string, or the text strings of a list joined; None if there is no such string."""
    content = member(line, "message", "content")
    if type(content) is list:
        said = [t for part in content if (t := text(member(part, "text"))) is not None]
        return "".join(said) if said else None
    return text(content)


def user_content(line: dict) -> str | None:
    if line.get("type") != "user":
        return None
    content = member(line, "message", "content")
    if type(content) is list:
        return "tool_result" if any(member(part, "type") == "tool_result" for part in content) else "prompt"
    return "prompt" if type(content) is str else None


def dedup_key(line: dict) -> str | None:
    """Session with the message's id, else with the request's id, else None."""
    session = filled(line.get("sessionId")) or MISSING
    if m := filled(member(line, "message", "id")):
        return f"{session}/m/{m}"
    if r := filled(line.get("requestId")):
        return f"{session}/r/{r}"
    return None


def limit_text(said: str) -> tuple[str | None, str | None]:
    """(window, reset text) of a limit notice; any case; session wording before weekly."""
    low = said.lower()
    window = None
    for wording, name in (("session limit", "five_hour"), ("5-hour limit", "five_hour"), ("weekly limit", "seven_day")):
        if wording in low:
            window = name
            break
    _, found, rest = low.partition("resets ")
    reset = said[len(said) - len(rest) :].strip() if found and len(low) == len(said) else rest.strip()
    return window, reset or None


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # unknown or malformed names
        return None


def reset_time(said: str | None, hit: datetime | None) -> datetime | None:
    """The first minute from the hit's own on, within 48 hours, at which the zone's clock shows the text's time."""
    m = _CLOCK.fullmatch(said.strip()) if said and hit else None
    zone = _zone(m[4].strip()) if m else None
    if not m or not zone or not 1 <= int(m[1]) <= 12 or int(m[2] or 0) > 59:
        return None
    want = (int(m[1]) % 12 + 12 * (m[3] in "pP")) * 60 + int(m[2] or 0)
    start = hit.replace(second=0, microsecond=0, tzinfo=UTC)
    for step in range(48 * 60 + 1):
        now = start + timedelta(minutes=step)
        clock = now.astimezone(zone)
        if clock.hour * 60 + clock.minute == want:
            return now.replace(tzinfo=None)
    return None


def quota(line: dict) -> tuple[str | None, datetime | None, list[str]]:
    """(window, reset, unusable members) of a limit hit's structured fields."""
    if "quotaLimits" not in line:
        return None, None, []
    q = line["quotaLimits"]
    if type(q) is not dict:
        return None, None, ["quotaLimits"]
    window = q.get("rateLimitType") if q.get("rateLimitType") in WINDOW_SECONDS else None
    at, reset = number(q.get("resetsAt")), None
    if at is not None and math.isfinite(at) and at == int(at) and 0 < at <= LATEST_SECOND:
        reset = datetime(1970, 1, 1) + timedelta(seconds=int(at))
    bad = [name for name, got in (("rateLimitType", window), ("resetsAt", reset)) if name in q and got is None]
    return window, reset, bad


def iso(t: datetime) -> str:
    return f"{t:%Y-%m-%dT%H:%M:%S}.{t.microsecond // 1000:03d}Z"


def derive_log(raw: bytes | None) -> dict:
    """Every derived field of a log line; a malformed line has its class and nothing else."""
    line = parse_object(raw)
    kind = line_class(line)
    if line is None:
        return {"line_class": kind, "is_sidechain": 0, "is_meta": 0, "problems": []}
    at, message, problems = instant(line.get("timestamp")), line.get("message"), []
    session = filled(line.get("sessionId"))
    out = {
        "line_class": kind, "session_id": session or MISSING, "line_type": filled(line.get("type")) or MISSING, "subtype": text(line.get("subtype")),
        "timestamp_raw": compact(line["timestamp"]) if "timestamp" in line else None, "timestamp_utc": at,
        "cwd": text(line.get("cwd")), "git_branch": text(line.get("gitBranch")), "cc_version": text(line.get("version")),
        "is_sidechain": int(line.get("isSidechain") is True), "uuid": filled(line.get("uuid")), "parent_uuid": filled(line.get("parentUuid")),
        "origin_kind": text(member(line, "origin", "kind")), "user_content": user_content(line), "is_meta": int(line.get("isMeta") is True),
        "message_role": text(member(message, "role")), "message_text": content_text(line),
        "attachment_type": text(member(line, "attachment", "type")), "command_mode": text(member(line, "attachment", "commandMode")),
    }
    if kind == "request":
        usage = message["usage"]
        split = usage.get("cache_creation") if type(usage.get("cache_creation")) is dict else None
        for column, name in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_tokens", "cache_read_input_tokens")):
            out[column] = number(usage.get(name))
            if out[column] is None:
                out[column] = 0
                problems.append(("missing_field", name))
        if at is None:
            problems.append(("unparsed_timestamp", compact(line.get("timestamp"))))
        iterations = usage.get("iterations")
        for i in iterations if type(iterations) is list else ():
            if type(i) is dict and i.get("type") != "message":
                problems.append(("non_message_iteration", filled(i.get("type")) or MISSING))
        count = lambda o, name: number(o.get(name)) or 0
        out |= {
            "dedup_key": dedup_key(line), "message_id": text(message.get("id")), "request_id": text(line.get("requestId")), "model": filled(message.get("model")) or MISSING,
            "cache_write_5m_tokens": count(split, "ephemeral_5m_input_tokens") if split is not None else None,
            "cache_write_1h_tokens": count(split, "ephemeral_1h_input_tokens") if split is not None else None,
            "cache_write_unsplit_tokens": count(usage, "cache_creation_input_tokens") if split is None else None,
            "speed": text(usage.get("speed")), "service_tier": text(usage.get("service_tier")), "inference_geo": text(usage.get("inference_geo")),
        }
    if kind in EVENT_CLASSES:
        error = line.get("error")
        status = number(line.get("apiErrorStatus"))
        if status is None and kind == "retry_notice":
            status = number(member(error, "status"))
        out |= {"error": text(error), "api_error_status": status, "retry_rate_limits": int(kind == "retry_notice" and member(error, "rateLimits") is not None)}
        if kind == "api_error" and text(error) != "server_error":
            out["unknown_error"] = text(error) if text(error) is not None else MISSING
        if kind == "limit_hit":
            window, said = limit_text(content_text(line) or "")
            reset = reset_time(said, at)
            qwindow, qreset, bad = quota(line)
            out |= {"text_window": window, "reset_text": said, "text_reset_at_utc": reset, "quota_window": qwindow, "quota_reset_at_utc": qreset}
            problems += [("unusable_quota_field", b) for b in bad]
            if qwindow and window and qwindow != window:
                problems.append(("quota_window_disagrees", f"quotaLimits={qwindow} text={window}"))
            if qreset and reset and abs(qreset - reset) >= timedelta(minutes=1):
                problems.append(("quota_reset_disagrees", f"quotaLimits={iso(qreset)} text={iso(reset)}"))
        if kind == "model_fallback":
            out |= {"original_model": text(line.get("originalModel")), "fallback_model": text(line.get("fallbackModel")), "refusal_category": text(line.get("apiRefusalCategory"))}
    if kind == "ignored_type":
        out["ignored_type"] = out["line_type"] + (f"/{out['subtype']}" if out["subtype"] is not None else "")
    out["problems"] = problems
    return out


def validity(window: str, used: float | None, resets: float | None) -> str:
    """Whether a window's values can be used; above 100 % is a real reading, an epoch as a percentage isn't."""
    if window not in WINDOW_SECONDS:
        return "unknown_window"
    if used is None or used < 0:
        return "invalid_percentage"
    if used >= 1e9:
        return "invalid_epoch_in_percentage"
    return "valid" if resets is not None and 1e9 <= resets < 1e10 else "invalid_resets_at"


def derive_spool(raw: bytes | None) -> dict:
    """A status reading and its windows: each object under rate_limits, as written, with its validity."""
    line = parse_object(raw)
    at, hook, coded = (number(member(line, "captured_at_s")), number(member(line, "hook_version")), text(member(line, "payload_b64")))
    if at is None or hook is None or coded is None:
        return {"status": "malformed_line", "has_rate_limits": 0, "windows": []}
    head = {"captured_at_s": float(at), "hook_version": int(hook), "has_rate_limits": 0, "windows": []}
    if not _BASE64.fullmatch(coded):
        return {"status": "malformed_payload_encoding", **head}
    payload = parse_object(base64.b64decode(coded))
    if payload is None:
        return {"status": "malformed_payload", **head}
    limits = payload.get("rate_limits")
    windows = []
    for name, w in limits.items() if type(limits) is dict else ():
        if type(w) is dict:
            used, resets = number(w.get("used_percentage")), number(w.get("resets_at"))
            windows.append({"window_name": name, "used_percentage": used, "resets_at": resets, "validity": validity(name, used, resets)})
    cost = number(member(payload, "cost", "total_cost_usd"))
    return head | {
        "status": "ok", "session_id": text(payload.get("session_id")), "transcript_path": text(payload.get("transcript_path")), "model_id": text(member(payload, "model", "id")),
        "cc_version": text(payload.get("version")), "cost_total_usd": cost, "has_rate_limits": int(type(limits) is dict), "windows": windows,
    }
