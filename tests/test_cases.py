"""Session logs as they occur, each case with the requests, events and problems that must come out; everything is read twice."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.report import Reports
from ledgerline.sources.ingest import Ingest


def ask(mid, out, *, rid=None, at="2026-03-01T10:00:00Z", session="s", uuid=None, model="large", usage=None, message=None, **line):
    u = {"input_tokens": 10, "output_tokens": out, "cache_read_input_tokens": 3} | (usage or {})
    m = {"role": "assistant", "model": model, "usage": u} | ({"id": mid} if mid else {}) | (message or {})
    return {"type": "assistant", "sessionId": session, "timestamp": at, "uuid": uuid or f"u{mid}{out}{at}", "message": m} | ({"requestId": rid} if rid else {}) | line


def hit(said, **line):
    return {"type": "assistant", "sessionId": "s", "timestamp": "2026-03-01T10:10:00Z", "isApiErrorMessage": True, "error": "rate_limit", "uuid": said, "message": {"model": "<synthetic>", "content": [{"type": "text", "text": said}]}} | line


def synthetic(error=None, flag=True, **line):
    return {"type": "assistant", "sessionId": "s", "timestamp": "2026-03-01T10:10:00Z", "message": {"model": "<synthetic>", "content": [{"type": "text", "text": "API Error"}]}} | ({"isApiErrorMessage": True} if flag else {}) | ({"error": error} if error else {}) | line


WEEKLY = "You've hit your weekly limit · resets 3pm (UTC)"
#: case -> lines; bytes stand as they are, a list of two lists is what the file holds in the first and in the second run.
CASES = {
    "01-snapshots": [ask("m1", 1), ask("m1", 5), ask("m1", 9)],
    "02-across-runs": ([ask("m2", 4)], [ask("m2", 4), ask("m2", 40)]),
    "03-fragment": ([ask("m3", 3), b'{"type":"assistant"'], [ask("m3", 3), ask("m3b", 4)]),
    "04-replay": [ask("m4", 7, uuid="a"), ask("m4", 7, uuid="b", isSidechain=True)],
    "05-missing-ids": [ask(None, 2, rid="r5"), ask(None, 6, rid="r5"), ask(None, 1, uuid="x"), ask(None, 1, uuid="y")],
    "06-models": [ask("m6", 1, model="large"), ask("m6b", 2, model="small")],
    "07-midnight": [ask("m7", 1, at="2026-03-01T23:59:59Z"), ask("m7b", 2, at="2026-03-02T01:00:00+02:00")],
    "08-hits": [hit("You've hit your session limit · resets 3:40pm (Europe/Berlin)"), hit("5-hour limit reached · resets 4pm (UTC)"), hit(WEEKLY), hit("You've reached your limit.")],
    "09-errors": [synthetic("server_error"), synthetic("strange"), synthetic(), synthetic(flag=False)],
    "10-malformed": [b'{"type":"user"', b"[1,2]", b""],
    "11-subagent": [ask("m11", 5, session="parent", isSidechain=True)],
    "12-rewritten": ([ask("m12a", 1), ask("m12b", 2), ask("m12c", 3)], [ask("m12d", 4)]),
    "15-retries": [
        {"type": "system", "subtype": "api_error", "sessionId": "s", "error": {"status": 529, "rateLimits": {"x": 1}}}, {"type": "system", "subtype": "api_error", "sessionId": "s", "error": {"rateLimits": None}},
    ],
    "16-cache-writes": [
        ask("m16", 1, usage={"cache_creation": {"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 6}, "cache_creation_input_tokens": 10}), ask("m16b", 1, usage={"cache_creation_input_tokens": 8}),
    ],
    "17-edges": [ask("m17", 1, usage={"input_tokens": None}), ask("m17b", 1, at="soon"), ask("m17c", 1, usage={"iterations": [{"type": "message"}, {"type": "advisor"}]})],
    "18-growing-over-midnight": [ask("m18", 1, at="2026-03-01T23:59:50Z"), ask("m18", 9, at="2026-03-02T00:00:10Z")],
    "19-equal-over-midnight": [ask("m19", 9, at="2026-03-02T00:00:10Z"), ask("m19", 9, at="2026-03-01T23:59:50Z")],
    "20-quota-fields": [
        hit(WEEKLY, quotaLimits={"rateLimitType": "five_hour", "resetsAt": 1772380800}), hit(WEEKLY + " ", quotaLimits={"rateLimitType": "monthly", "resetsAt": 1.5}), hit(WEEKLY + "  ", quotaLimits="none"),
    ],
    "21-null-iteration": [ask("m21", 1, usage={"iterations": [{"type": "message", "model": None}]})],
    "22-fallback": [{"type": "system", "subtype": "model_refusal_fallback", "sessionId": "s", "originalModel": "large", "fallbackModel": "small", "apiRefusalCategory": "c"}],
}


def lines(case, run):
    got = CASES[case]
    got = got[run - 1] if isinstance(got, tuple) else got
    body = [x if isinstance(x, bytes) else json.dumps(x, ensure_ascii=False).encode() for x in got]
    return b"\n".join(body) + (b"" if case == "03-fragment" and run == 1 else b"\n")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Two runs over all cases, each case with its own sessions; after each, what came out."""
    base = tmp_path_factory.mktemp("cases")
    ingest, out = Ingest(spark, str(base / "store")), {}
    for run in (1, 2):
        for case in CASES:
            path = base / "root/projects" / case / ("deep/agent.jsonl" if case == "11-subagent" else "a.jsonl")
            os.makedirs(path.parent, exist_ok=True)
            path.write_bytes(lines(case, run).replace(b'"sessionId": "s"', b'"sessionId": "%s"' % case.encode()))
        ingest.run(str(base / "root"), run)
        assert ingest.run(str(base / "root"), run, full=True) == 0  # read again as a whole: nothing new
        tables = ingest.tables()
        r = Reports(spark, tables=tables)
        place = ingest.raw.read().select("raw_line_id", F.split("relative_path", "/")[1].alias("case"), "line_number")
        by = lambda df, of=place: {c: sorted((x for x in rows if x["case"] == c), key=lambda x: x["line_number"]) for rows in [[x.asDict() for x in df.join(of, "raw_line_id").collect()]] for c in CASES}
        kept = r.requests_dedup.drop("line_number")
        out[run] = {
            "requests": by(kept), "events": by(tables["events"]), "lines": by(tables["parsed_lines"].select("raw_line_id", "line_class", "session_id", "timestamp_utc")), "problems": by(tables["line_problems"]),
            "days": {(x.day, x.model): x.output_tokens for x in r.totals_by_day().collect()}, "files": {x.problem for x in ingest.problems.read().collect()},
        }
    return out


def requests(store, case, run=2):
    return [(x["message_id"], x["output_tokens"]) for x in store[run]["requests"][case]]


def test_one_request_per_response(store):
    assert requests(store, "01-snapshots") == [("m1", 9)]
    assert requests(store, "02-across-runs", 1) == [("m2", 4)] and requests(store, "02-across-runs") == [("m2", 40)]
    assert [x["is_sidechain"] for x in store[2]["requests"]["04-replay"]] == [0]
    assert sorted((x["request_id"] or "", x["output_tokens"]) for x in store[2]["requests"]["05-missing-ids"]) == [("", 1), ("", 1), ("r5", 6)]
    assert [(x["model"], x["output_tokens"]) for x in store[2]["requests"]["06-models"]] == [("large", 1), ("small", 2)]
    assert [x["session_id"] for x in store[2]["requests"]["11-subagent"]] == ["parent"]


def test_lines_are_read_when_complete_and_kept_when_rewritten(store):
    assert requests(store, "03-fragment", 1) == [("m3", 3)] and requests(store, "03-fragment") == [("m3", 3), ("m3b", 4)]
    assert sorted(requests(store, "12-rewritten")) == [("m12a", 1), ("m12b", 2), ("m12c", 3), ("m12d", 4)] and store[2]["files"] == {"file_rewritten"}
    assert [x["line_class"] for x in store[2]["lines"]["10-malformed"]] == ["malformed"] * 3


def test_days_are_those_of_utc(store):
    at = {x["message_id"]: f"{x['timestamp_utc']:%m-%d %H}" for case in ("07-midnight", "18-growing-over-midnight", "19-equal-over-midnight") for x in store[2]["requests"][case]}
    assert at == {"m7": "03-01 23", "m7b": "03-01 23", "m18": "03-02 00", "m19": "03-01 23"}  # the final snapshot dates a response, the earliest of equal ones too
    assert store[2]["days"]["2026-03-02", "large"] == 9


def test_cache_writes_and_edges(store):
    got = {x["message_id"]: (x["cache_write_5m_tokens"], x["cache_write_1h_tokens"], x["cache_write_unsplit_tokens"]) for x in store[2]["requests"]["16-cache-writes"]}
    assert got == {"m16": (4, 6, None), "m16b": (None, None, 8)}
    problems = {(x["problem"], x["detail"]) for x in store[2]["problems"]["17-edges"]}
    assert problems == {("missing_field", "input_tokens"), ("unparsed_timestamp", '"soon"'), ("non_message_iteration", "advisor")}
    assert requests(store, "21-null-iteration") == [("m21", 1)] and store[2]["problems"]["21-null-iteration"] == []


def test_limit_hits(store):
    got = [(x["text_window"], x["reset_text"], x["text_reset_at_utc"] and f"{x['text_reset_at_utc']:%H:%M}") for x in store[2]["events"]["08-hits"]]
    assert got == [("five_hour", "3:40pm (Europe/Berlin)", "14:40"), ("five_hour", "4pm (UTC)", "16:00"), ("seven_day", "3pm (UTC)", "15:00"), (None, None, None)]
    got = [(x["quota_window"], x["quota_reset_at_utc"] is not None) for x in store[2]["events"]["20-quota-fields"]]
    assert got == [("five_hour", True), (None, False), (None, False)]
    problems = [(x["line_number"], x["problem"], x["detail"]) for x in store[2]["problems"]["20-quota-fields"]]
    assert {p[:2] for p in problems} == {(1, "quota_window_disagrees"), (1, "quota_reset_disagrees"), (2, "unusable_quota_field"), (3, "unusable_quota_field")}
    assert {p[2] for p in problems if p[0] > 1} == {"rateLimitType", "resetsAt", "quotaLimits"}


def test_other_events(store):
    assert [(x["line_class"], x["error"]) for x in store[2]["events"]["09-errors"]] == [("api_error", "server_error"), ("api_error", "strange"), ("api_error", None), ("synthetic_other", None)]
    assert [(x["api_error_status"], x["retry_rate_limits"]) for x in store[2]["events"]["15-retries"]] == [(529.0, 1), (None, 0)]
    assert [(x["line_class"], x["original_model"], x["fallback_model"], x["refusal_category"]) for x in store[2]["events"]["22-fallback"]] == [("model_fallback", "large", "small", "c")]
    assert requests(store, "22-fallback") == []
