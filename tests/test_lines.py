import base64
import json
from datetime import datetime

import pytest

from ledgerline.functions import lines as L
from ledgerline.functions.strict_json import parse_object

USAGE = {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 3}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        (None, "malformed"), ({"isApiErrorMessage": True, "error": "rate_limit"}, "limit_hit"), ({"isApiErrorMessage": True}, "api_error"), ({"isApiErrorMessage": "true", "type": "x"}, "ignored_type"),
        ({"type": "assistant", "message": {"model": "<synthetic>", "usage": {}}}, "synthetic_other"), ({"type": "assistant", "message": {"usage": {}}}, "request"), ({"type": "assistant", "message": {"usage": []}}, "ignored_type"),
        ({"type": "system", "subtype": "api_error"}, "retry_notice"), ({"type": "system", "subtype": "model_refusal_fallback"}, "model_fallback"), ({"type": "system"}, "ignored_type"),
    ],
)
def test_classes(line, want):
    assert L.line_class(line) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2026-09-02T01:30:00.000+02:00", datetime(2026, 9, 1, 23, 30)), ("2026-09-02T01:30:00.1239Z", datetime(2026, 9, 2, 1, 30, 0, 123000)), ("2026-09-02T01:30:00.5Z", datetime(2026, 9, 2, 1, 30, 0, 500000)),
        ("2026-02-30T00:00:00Z", None), ("2026-09-02", None), ("2026-09-02T24:00:00Z", None), ("2026-09-02T01:30:00z", None), ("2026-09-02T01:30:00+24:00", None), ("2026-09-02T01:30:60Z", None), (5, None), (None, None), ("yesterday", None),
    ],
)
def test_instants(raw, want):
    assert L.instant(raw) == want


@pytest.mark.parametrize(
    ("said", "hit", "want"),
    [
        ("6:10am (UTC)", datetime(2026, 9, 1, 3), datetime(2026, 9, 1, 6, 10)), ("6am (UTC)", datetime(2026, 9, 1, 6, 0, 30), datetime(2026, 9, 1, 6)), ("12am (UTC)", datetime(2026, 9, 1, 3), datetime(2026, 9, 2)),
        ("2:30am (Europe/Berlin)", datetime(2026, 3, 28, 23, 0), datetime(2026, 3, 30, 0, 30)),  # the hour that spring skips: the next day's
        ("2:30am (Europe/Berlin)", datetime(2026, 10, 24, 23, 0), datetime(2026, 10, 25, 0, 30)),  # twice in autumn: the first
        ("13am (UTC)", datetime(2026, 9, 1), None), ("6:60am (UTC)", datetime(2026, 9, 1), None), ("6am (Nowhere/Land)", datetime(2026, 9, 1), None), ("soon", datetime(2026, 9, 1), None), (None, datetime(2026, 9, 1), None), ("6am (UTC)", None, None),
    ],
)
def test_reset_times(said, hit, want):
    assert L.reset_time(said, hit) == want


def test_limit_texts():
    assert L.limit_text("You've hit your Session Limit · resets 6:10am (UTC)") == ("five_hour", "6:10am (UTC)")
    assert L.limit_text("weekly limit and 5-hour limit") == ("five_hour", None)
    assert L.limit_text("Weekly limit. RESETS  ") == ("seven_day", None)
    assert L.limit_text("") == (None, None)


def test_quota():
    assert L.quota({}) == (None, None, [])
    assert L.quota({"quotaLimits": 3}) == (None, None, ["quotaLimits"])
    assert L.quota({"quotaLimits": {"rateLimitType": "five_hour", "resetsAt": 1788329400}}) == ("five_hour", datetime(2026, 9, 2, 6, 10), [])
    assert L.quota({"quotaLimits": {"rateLimitType": "x", "resetsAt": 1.5}}) == (None, None, ["rateLimitType", "resetsAt"])
    assert L.quota({"quotaLimits": {"resetsAt": True}})[2] == ["resetsAt"]


def test_request_fields_and_problems():
    line = {"type": "assistant", "sessionId": "s", "requestId": "r", "timestamp": 4, "message": {"id": "", "usage": {"input_tokens": "5", "output_tokens": True, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 9, "iterations": [{"type": "advisor"}, {"type": "message"}, 4, {}]}}}
    d = L.derive_log(json.dumps(line).encode())
    assert (d["dedup_key"], d["input_tokens"], d["output_tokens"], d["cache_read_tokens"], d["cache_write_unsplit_tokens"], d["cache_write_5m_tokens"]) == ("s/r/r", 0, 0, 2, 9, None)
    assert d["problems"] == [("missing_field", "input_tokens"), ("missing_field", "output_tokens"), ("unparsed_timestamp", "4"), ("non_message_iteration", "advisor"), ("non_message_iteration", "<missing>")]
    split = L.derive_log(json.dumps({"type": "assistant", "message": {"id": "m", "usage": USAGE | {"cache_creation": {"ephemeral_5m_input_tokens": 4}}}}).encode())
    assert (split["cache_write_5m_tokens"], split["cache_write_1h_tokens"], split["cache_write_unsplit_tokens"], split["dedup_key"]) == (4, 0, None, "<missing>/m/m")


def test_disagreements():
    line = {"isApiErrorMessage": True, "error": "rate_limit", "timestamp": "2026-09-01T03:00:00Z", "message": {"content": "weekly limit resets 6:10am (UTC)"}, "quotaLimits": {"rateLimitType": "five_hour", "resetsAt": 1788243060}}
    assert [p for p, _ in L.derive_log(json.dumps(line).encode())["problems"]] == ["quota_window_disagrees", "quota_reset_disagrees"]


def spool(payload, **more):
    return json.dumps({"captured_at_s": 1.5, "hook_version": 1, "payload_b64": base64.b64encode(payload).decode()} | more).encode()


def test_spool_statuses():
    assert L.derive_spool(b"{")["status"] == "malformed_line"
    assert L.derive_spool(spool(b"{}", captured_at_s="1"))["status"] == "malformed_line"
    assert L.derive_spool(spool(b"{}", payload_b64="a!!b"))["status"] == L.derive_spool(spool(b"{}", payload_b64="QQ"))["status"] == "malformed_payload_encoding"
    assert L.derive_spool(spool(b"[1]"))["status"] == "malformed_payload"
    d = L.derive_spool(spool(json.dumps({"rate_limits": {"five_hour": {"used_percentage": 130, "resets_at": 1.7e9}, "x": 4, "monthly": {}, "seven_day": {"used_percentage": True}}}).encode()))
    assert [(w["window_name"], w["validity"]) for w in d["windows"]] == [("five_hour", "valid"), ("monthly", "unknown_window"), ("seven_day", "invalid_percentage")]


@pytest.mark.parametrize(("used", "resets", "want"), [(None, 1.7e9, "invalid_percentage"), (-1, 1.7e9, "invalid_percentage"), (1.7e9, 1.7e9, "invalid_epoch_in_percentage"), (5, None, "invalid_resets_at"), (5, 1e10, "invalid_resets_at"), (0, 1e9, "valid")])
def test_validity(used, resets, want):
    assert L.validity("five_hour", used, resets) == want


def test_strict_objects():
    assert parse_object(b'{"a":1,"a":2}') == {"a": 2}
    for bad in (None, b"", b"[]", b"1", b'{"a":1} x', b'{"a":Infinity}', b"{", b"null"):
        assert parse_object(bad) is None
