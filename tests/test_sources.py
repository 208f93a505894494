import gzip
import hashlib
import json
import os
from datetime import datetime

import pytest

from ledgerline.runtime import stored
from ledgerline.sources import exchange, files, prices, repositories, store
from ledgerline.sources.ingest import Ingest


def write(root, name, data: bytes):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def read(spark, root, width, state=None, full=False):
    started, problems = files.resume(files.discover(spark, str(root)), state, full)
    got = files.complete_lines(started, width)
    return started, got, [(r.relative_path, r.problem) for r in problems.collect()]


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_complete_lines_whatever_the_ranges(spark, tmp_path, width):
    one = b'{"a":1}\r\n\n\xff\xfe bytes\nlong ' + b"x" * 200 + b"\nlast without newline"
    write(tmp_path, "projects/p/a.jsonl", one)
    write(tmp_path, "projects/p/deep/er/b.jsonl", b"only\n")
    write(tmp_path, "projects/c.jsonl", b"")
    write(tmp_path, "projects/p/no.txt", b"x\n")
    os.symlink(tmp_path / "projects/p/a.jsonl", tmp_path / "projects/link.jsonl")
    _, got, _ = read(spark, tmp_path, width)
    rows = sorted((r.relative_path, r.line_number, r.byte_offset, bytes(r.line_bytes), r.content_hash) for r in got.collect())
    want, at = [], 0
    for n, line in enumerate(one.split(b"\n")[:-1], 1):
        want.append(("projects/p/a.jsonl", n, at, line, hashlib.sha256(line).hexdigest()))
        at += len(line) + 1
    want.append(("projects/p/deep/er/b.jsonl", 1, 0, b"only", hashlib.sha256(b"only").hexdigest()))
    assert rows == sorted(want)


def test_resume_and_rewrite(spark, tmp_path):
    write(tmp_path, "projects/a.jsonl", b"1\n2\n3")
    started, got, _ = read(spark, tmp_path, 2)
    state = stored(files.state_after(started, got), "state")  # as read now, not when the file has grown
    assert [tuple(r)[2:4] for r in state.collect()] == [(4, 2)]
    write(tmp_path, "projects/a.jsonl", b"1\n2\n34\n5\n")
    _, got, problems = read(spark, tmp_path, 2, state)
    assert sorted((r.line_number, bytes(r.line_bytes)) for r in got.collect()) == [(3, b"34"), (4, b"5")] and problems == []
    write(tmp_path, "projects/a.jsonl", b"9\n")
    _, got, problems = read(spark, tmp_path, 2, state)
    assert [(r.line_number, bytes(r.line_bytes)) for r in got.collect()] == [(1, b"9")] and problems == [("projects/a.jsonl", "file_rewritten")]
    _, got, problems = read(spark, tmp_path, 2, state, full=True)
    assert got.count() == 1 and problems == []
    write(tmp_path, "other", b"7\n8\n9\n")
    os.replace(tmp_path / "other", tmp_path / "projects/a.jsonl")  # another file, longer than what was read
    _, got, problems = read(spark, tmp_path, 2, state)
    assert got.count() == 3 and problems == [("projects/a.jsonl", "file_rewritten")]
    assert read(spark, tmp_path, 2, state.drop("inode"))[1].count() == 1  # a state without inodes goes by size alone


def test_ingest_is_idempotent_and_keeps_rewritten_lines(spark, tmp_path):
    root, out = tmp_path / "root", str(tmp_path / "out")
    line = lambda i: json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "timestamp": "2026-01-01T00:00:00Z"}).encode() + b"\n"
    write(root, "projects/a.jsonl", line(1) + line(1) + line(2))
    ingest = Ingest(spark, out)
    assert ingest.run(str(root), 1, range_bytes=50) == 2
    first = ingest.raw.read().collect()
    assert ingest.run(str(root), 2) == 0 and ingest.run(str(root), 3, full=True) == 0
    assert sorted(ingest.raw.read().collect()) == sorted(first)
    write(root, "projects/a.jsonl", line(3))
    write(root, "projects/b.jsonl", line(3) + line(4))
    assert ingest.run(str(root), 4) == 3
    rows = {r.raw_line_id: (r.source_file_id, r.line_number, r.first_run_id) for r in ingest.raw.read().collect()}
    assert rows == {1: (1, 1, 1), 2: (1, 3, 1), 3: (1, 1, 4), 4: (2, 1, 4), 5: (2, 2, 4)}
    assert [r.problem for r in ingest.problems.read().collect()] == ["file_rewritten"]
    assert {r.uuid for r in ingest.derived()["parsed_lines"].collect()} == {"u1", "u2", "u3", "u4"}


def test_only_new_lines_are_derived_and_all_of_them_anew_for_new_rules(spark, tmp_path, monkeypatch):
    root, ingest = tmp_path / "root", Ingest(spark, str(tmp_path / "out"))
    line = lambda i: json.dumps({"type": "user", "uuid": f"u{i}"}).encode() + b"\n"
    write(root, "projects/a.jsonl", line(1) + line(2))
    ingest.run(str(root), 1)
    ingest.derive()
    first = ingest.log_facts.head()["parts"]
    write(root, "projects/a.jsonl", line(1) + line(2) + line(3))
    ingest.run(str(root), 2)
    ingest.derive()
    ingest.derive()
    parts = ingest.log_facts.head()["parts"]
    assert parts[:1] == first and len(parts) == 2
    assert sorted(r.uuid for r in ingest.log_facts.read().collect()) == ["u1", "u2", "u3"]
    monkeypatch.setattr("ledgerline.sources.derive.VERSION", "later")
    ingest.derive()
    assert len(ingest.log_facts.head()["parts"]) == 1 and ingest.log_facts.read().count() == 3


def test_machines_share_their_lines(spark, tmp_path):
    folder, now = tmp_path / "shared", datetime(2026, 1, 5)
    step = lambda i, name, where=folder: i.share(where and str(where), name, name.title(), "a" * 64, 9, now)
    one, two = (Ingest(spark, str(tmp_path / n)) for n in ("one", "two"))
    for ingest, words in ((one, "ab"), (two, "c")):
        root = tmp_path / ("root-" + words)
        write(root, "projects/x.jsonl", b"".join(json.dumps({"type": "user", "uuid": w, "cwd": "secret"}).encode() + b"\n" for w in words))
        ingest.run(str(root), 1)
    assert step(one, "one", None) == {"kind": "off"} and step(one, "one")["kind"] == "folder_missing"
    os.makedirs(folder)
    assert step(one, "one") == {"kind": "done", "imported": 0, "problems": []}
    assert step(two, "two")["imported"] == 2 and step(two, "two")["imported"] == 0
    assert step(one, "one")["imported"] == 1
    rows = {(r.root, json.loads(r.line_bytes)["uuid"]) for r in two.raw.read().filter("root like 'machine:%'").collect()}
    assert rows == {("machine:one", "a"), ("machine:one", "b")}
    assert not any(b"secret" in r.line_bytes for r in two.raw.read().filter("root like 'machine:%'").collect())


def test_base_views_are_kept_until_their_tables_change(spark, tmp_path):
    from ledgerline.plans.report import Reports

    root, ingest = tmp_path / "root", Ingest(spark, str(tmp_path / "out"))
    line = lambda i: json.dumps({"type": "assistant", "uuid": f"u{i}", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "message": {"id": f"m{i}", "model": "x", "usage": {"input_tokens": 1, "output_tokens": i}}}).encode() + b"\n"
    write(root, "projects/a.jsonl", line(1))
    ingest.run(str(root), 1)
    report = lambda: Reports(spark, tables=ingest.tables(), views=str(tmp_path / "views"))
    head = lambda: os.listdir(tmp_path / "views/requests-dedup")
    assert report().requests_dedup.count() == 1
    before = sorted(head())
    assert report().requests_dedup.count() == 1 and sorted(head()) == before
    write(root, "projects/a.jsonl", line(1) + line(2))
    ingest.run(str(root), 2)
    assert report().requests_dedup.count() == 2 and sorted(head()) != before


def test_ids_follow_the_order(spark):
    df = spark.createDataFrame([(c, i) for i, c in enumerate("hgfedcba")], "k string, v long")
    got = {r.k: r.id for r in store.with_ids(df, ["k"], 100, "id").collect()}
    assert got == {c: 101 + i for i, c in enumerate("abcdefgh")}


def test_upsert_delete_and_versions(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v long")
    new = spark.createDataFrame([(None, 9), ("d", 4)], "k string, v long")
    assert {tuple(r) for r in store.upsert(old, new, ["k"]).collect()} == {("a", 1), ("c", 3), (None, 9), ("d", 4)}
    assert {tuple(r) for r in store.without(old, old.k == "a").collect()} == {(None, 2), ("c", 3)}
    t = store.Versions(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.write(old, "one")
    t.append(new)
    assert t.read().count() == 5
    assert not t.refresh("one", lambda: old) and t.refresh("two", lambda: new) and t.read().count() == 2
    parts = [p for p in os.listdir(tmp_path / "t") if p.startswith("part")]
    assert len(parts) == 1
    assert store.signature_of(t.read(), "v1") != store.signature_of(t.read(), "v2")


def test_scrubbing_leaves_no_words():
    line = {
        "type": "user", "cwd": "/home/secret", "message": {"role": "user", "content": [{"type": "text", "text": "secret"}, "secret"], "id": "m", "usage": {"input_tokens": 1}}, "error": {"message": "secret", "status": 4, "rateLimits": {"x": 1}},
        "attachment": {"type": "file", "path": "secret"}, "origin": "secret", "gitBranch": "secret",
    }
    out = exchange.scrub_log(line)
    assert "secret" not in json.dumps(out)
    assert out["message"] == {"id": "m", "usage": {"input_tokens": 1}, "content": [{"type": "text"}, None]} and out["error"] == {"status": 4, "rateLimits": {}}
    notice = exchange.scrub_log({"isApiErrorMessage": True, "message": {"content": "Session limit"}})
    assert notice["message"]["content"] == "Session limit"


def test_export_and_import(spark, tmp_path):
    body = [json.dumps({"type": "user", "uuid": u}).encode() for u in "abc"] + [b"broken"]
    raw = spark.createDataFrame([(i, 1, "r", "p/x.jsonl", "log", i, 0, hashlib.sha256(b).hexdigest(), b, 1 + i % 2) for i, b in enumerate(body)], "raw_line_id long, source_file_id long, root string, relative_path string, kind string, line_number long, byte_offset long, content_hash string, line_bytes binary, first_run_id long")
    months = spark.createDataFrame([(1, "2026-01"), (2, "2026-02")], "first_run_id long, month string")
    folder = str(tmp_path / "out")
    exchange.export(raw, months, folder)
    exchange.export(raw, months, folder)  # months are replaced, not added to
    lines, problems = exchange.imported(spark, folder)
    assert lines.count() == 3 and problems.count() == 0
    known = lines.select("origin").limit(1)
    again, _ = exchange.imported(spark, folder, known_origins=known)
    assert again.count() == 2
    write(folder, "bad.jsonl.gz", gzip.compress(b'{"x":1}\n' + b"y" * 70_000 + b"\npartial"))
    write(folder, "cut.jsonl.gz", gzip.compress(b"abc" * 1000)[:-10])
    _, problems = exchange.imported(spark, folder)
    assert {(os.path.basename(r.file), r.problem, r.lines) for r in problems.collect()} == {("bad.jsonl.gz", "line_rejected", 2), ("cut.jsonl.gz", "damaged", 1)}
    assert exchange.expand(gzip.compress(b"0" * 100), 50) is None


def test_exports_stay_below_the_cap_and_larger_files_are_reported(spark, tmp_path, monkeypatch):
    body = [json.dumps({"type": "user", "uuid": str(u)}).encode() for u in range(7)]
    raw = spark.createDataFrame([(i, "p/x.jsonl", "log", hashlib.sha256(b).hexdigest(), b, 1) for i, b in enumerate(body)], "raw_line_id long, relative_path string, kind string, content_hash string, line_bytes binary, first_run_id long")
    folder = str(tmp_path / "out")
    monkeypatch.setattr(exchange, "FILE_LINES", 3, raising=False)
    exchange.export(raw, spark.createDataFrame([(1, "2026-01")], "first_run_id long, month string"), folder)
    assert sum(f.endswith(".gz") for _, _, names in os.walk(folder) for f in names if not f.startswith(".")) == 3
    assert exchange.imported(spark, folder)[0].count() == 7
    write(folder, "large.jsonl.gz", os.urandom(5000))
    monkeypatch.setattr(exchange, "MOST_FILE", 4000)
    lines, problems = exchange.imported(spark, folder)
    assert lines.count() == 7 and [(os.path.basename(r.file), r.problem) for r in problems.collect()] == [("large.jsonl.gz", "too large")]


def test_roots(tmp_path):
    has = lambda *ok: lambda p: p in {os.path.join(o, "projects") for o in ok}
    assert files.roots("~/x, /y,/y", None, "/h", "tool", has("/h/x", "/y")) == ["/h/x", "/y"]
    assert files.roots(None, "/c", "/h", "tool", has("/c/tool", "/h/.tool")) == ["/c/tool", "/h/.tool"]
    with pytest.raises(FileNotFoundError):
        files.roots("/nowhere", None, "/h", "tool", has())


def test_price_rows():
    row = {"model_id": "m", "effective_from": "2026-01-01", "verified_on": "2026-02-01", "input": 1, "output": 2, "cache_write_5m": 3, "cache_write_1h": 4, "cache_read": 5, "fast": None, "standard_rate_max_input_tokens": None, "source_url": "u"}
    assert prices.rows({"rows": [row]})[0][:3] == ("m", "2026-01-01", 1.0)
    for bad in ({"input": -1}, {"effective_from": "2026"}, {"model_id": ""}, {"standard_rate_max_input_tokens": 0}, {"fast": 3}, {"output": "2"}):
        with pytest.raises(ValueError):
            prices.rows({"rows": [row | bad]})
    with pytest.raises(ValueError):
        prices.rows({"rows": [row, row]})
    assert prices.plan("2026-01", "17.50", " Plan ") == ("2026-01", 17.5, "Plan")
    for bad in (("2026-13", "1", "x"), ("2026-01", "1e3", "x"), ("2026-01", "1", " ")):
        with pytest.raises(ValueError):
            prices.plan(*bad)
    assert prices.alias([], "~/a/", "/b", "/home/u", {"/home/u/a"}) == [("/home/u/a", "/b")]
    for aliases, a, b in (([], "/a", "/a"), ([], "a", "/b"), ([("/b", "/c")], "/a", "/b"), ([("/x", "/a")], "/a", "/b"), ([], "/unknown", "/b")):
        with pytest.raises(ValueError):
            prices.alias(aliases, a, b, "/h", {"/a"})


def test_repositories(spark):
    lines = spark.createDataFrame([("/r/sub",), ("/r/sub",), ("/plain",), ("/gone/x",), (None,)], "cwd string")
    there = {"/r", "/r/sub", "/plain", "/gone"}
    ask = {"/r/sub": "/r", "/gone": "/gone"}.get
    got = {r.cwd: (r.kind, r.repo_root, r.root_exists, r.resolved_via) for r in repositories.repositories(lines, [("/old", "repo", "/old", 1, "git", "t")], there.__contains__, ask).collect()}
    assert got == {"/r/sub": ("repo", "/r", 1, "git"), "/plain": ("not_git", None, None, "git"), "/gone/x": ("missing", "/gone", 1, "parent"), "/old": ("missing", "/old", 0, "last_known")}


def test_command_line(spark, tmp_path, capsys):
    from ledgerline.__main__ import main

    root, out = tmp_path / "root", str(tmp_path / "store")
    body = {"type": "assistant", "sessionId": "s", "uuid": "u", "requestId": "r", "timestamp": "2026-01-01T00:00:00Z", "message": {"id": "m", "model": "x", "usage": {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 3}}}
    write(root, "projects/a.jsonl", json.dumps(body).encode() + b"\n")
    assert main(["ingest", str(root), out, "--run", "1"]) == 0 and "1 new lines" in capsys.readouterr().out
    assert main(["explain", out, "by-model"]) == 0
    assert capsys.readouterr().out.split("\n") == ["x: report shows 2.0 | from the events 2.0", "  x: 2.0", ""]
    totals = {"day": "2026-01-01", "model": "x", "input": 1, "output": 2, "cache_read": 3, "cache_write": 0, "cost": 0.0}
    write(tmp_path, "totals.json", json.dumps(totals).encode())
    assert main(["verify", out, str(tmp_path / "totals.json")]) == 0
    write(tmp_path, "totals.json", json.dumps(totals | {"output": 5, "cost": 1e-3}).encode())
    assert main(["verify", out, str(tmp_path / "totals.json")]) == 1
    assert "2026-01-01 x output: ours 2.0 | theirs 5.0" in capsys.readouterr().out
    assert main(["plan-price", "2026-01", "20", "one", "--store", out]) == main(["plan-price", "2026-01", "25", "two", "--store", out]) == 0
    assert capsys.readouterr().out.endswith("2026-01 25.0 two\n")
    assert main(["report", out, "--save", str(tmp_path)]) == 0
    text = open(capsys.readouterr().out.strip()).read()
    assert "OBSERVED" in text and "PROJECTED" in text and "unknown" in text
