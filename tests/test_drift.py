import json

from pyspark.sql import functions as F

from ledgerline.operators import drift

FIELDS = [
    ("version", "any", "string", "semver", True), ("type", "any", "string", "word", True), ("kind", "any", "string", "word", True), ("parentUuid", "any", "string|null", "uuid", False),
    ("message", "assistant", "object", "object", True), ("message.usage", "assistant", "object", "object", True), ("message.usage.input", "assistant", "number", "count", True),
    ("error", "assistant", "string", "word", False), ("error", "retry_notice", "object", "object", True), ("error.rateLimits", "retry_notice", "object|null", "window_map", True),
]


def lines(spark, *batches):
    rows, i = [], 0
    for f, batch in enumerate(batches, 1):
        for x in batch:
            i += 1
            rows.append((i, f, 1, "log", x if isinstance(x, (bytes, type(None))) else json.dumps(x).encode()))
    return spark.createDataFrame(rows, "raw_line_id long, source_file_id long, first_run_id long, kind string, line_bytes binary").withColumns({"path": F.lit("clash"), "carrier": F.lit("clash")})


def contract(spark):
    return drift.Contract.of(spark.createDataFrame(FIELDS, "field_path string, carrier string, json_types string, value_form string, is_always boolean").withColumn("note", F.lit(1)))


def ok(**more):
    return {"version": "1.2.3", "type": "user", "kind": "external"} | more


def found(spark, *batches):
    c = contract(spark)
    return {(r.source_file_id, r.change_kind, r.old_path, r.new_path) for r in drift.drift_report(lines(spark, *batches), c).collect()}


def test_all_kinds_of_change(spark):
    plain = ok()
    usage = ok(type="assistant", message={"usage": {"input": 1}})
    got = found(
        spark,
        [plain, ok(parentUuid=None), usage],
        [ok(version=[1, 2]), ok(version=3), plain],  # retyped
        [{"type": "user", "kind": "x"}, {"type": "user", "kind": "y"}],  # removed
        [{"type": "user", "kind": "x", "build": "1.0.2"}, {"type": "user", "kind": "x", "build": "1.0.3"}],  # renamed
        [{"type": "user", "kind": "x", "build": "1.0.2", "note": 4}],  # renamed and added
        [{"type": "user", "kind": "x", "entry": "Started from here."}],  # another form: removed and added
        [ok(type="assistant", message={"usage": {"in": 5, "share": "4 %"}}), ok(type="assistant", message={"usage": {"in": 6}})],
        [ok(type="assistant", message={"text": 1})],  # a parent that isn't there: only itself is removed
        [ok(type="system", subtype="api_error", error={"limits": {"five_hour": {"used_percentage": 1}}, "causes": ["x"]})],
        [ok(type="system", subtype="api_error", error={"rateLimits": None}), ok(type="assistant", message={"usage": {"input": 1.5}}, error="late")],
        [ok(extra={"deep": {"er": 1}})],
    )
    assert got == {
        (2, "retyped", "version", "version"), (3, "removed", "version", ""), (4, "renamed", "version", "build"), (5, "renamed", "version", "build"), (5, "added", "", "note"),
        (6, "removed", "version", ""), (6, "added", "", "entry"), (7, "renamed", "message.usage.input", "message.usage.in"), (7, "added", "", "message.usage.share"),
        (8, "removed", "message.usage", ""), (8, "added", "", "message.text"), (9, "renamed", "error.rateLimits", "error.limits"), (9, "added", "", "error.causes"), (11, "added", "", "extra"),
        (9, "added", "", "subtype"), (10, "added", "", "subtype"),
    }


def test_no_objects_no_batches(spark):
    deep = b"[" * 100_000
    assert found(spark, [None, b"", b"[1]", b"3", b"{\"a\":1} x", b"{\"a\": NaN}", b"\xff\xfe", deep, b"{" + b'"a":' * 50_000]) == set()
    c = contract(spark)
    assert drift.drift_report(lines(spark, []), c).collect() == []
    empty = drift.Contract.of(spark.createDataFrame([], "field_path string, carrier string, json_types string, value_form string, is_always boolean"))
    assert {(r.change_kind, r.new_path) for r in drift.drift_report(lines(spark, [{"a": 1}]), empty).collect()} == {("added", "a")}


def test_long_integers_and_repeated_keys(spark):
    raw = b'{"version":"9.9.9","version":"1.2.3","type":"user","kind":"x","n":' + b"9" * 5000 + b"}"
    assert found(spark, [raw]) == {(1, "added", "", "n")}


def test_unified_table(spark):
    c = contract(spark)
    df = lines(spark, [{"type": "assistant", "kind": "x", "build": "1.0.2", "message": {"usage": {"input": 7}}}], [ok(version=3, message={"usage": {"input": "seven"}}, type="assistant")], [b"broken"])
    mapped = drift.path_maps(df, c)
    assert drift.changes(drift.mapped_stats(mapped, c), c).exceptAll(drift.drift_report(df, c)).count() == 0
    t = drift.unified(mapped, drift.drift_report(df, c), c)
    rows = {r.raw_line_id: r for r in t.collect()}
    assert set(rows) == {1, 2}
    assert rows[1].version == "1.0.2" and rows[1].message__usage__input == 7 and rows[1].failed_casts == []
    assert rows[2].version is None and {(f.path, f.found, f.value) for f in rows[2].failed_casts} == {("version", "number", "3"), ("message.usage.input", "string", "seven")}
    assert dict(t.dtypes)["message__usage__input"] == "bigint"


def test_names_that_look_like_marks(spark):
    got = found(spark, [ok(**{"": 1, "extra{}": 1}), ok()], [ok(type="assistant", message=None) | {"message{}": 1}])
    assert got == {(1, "added", "", ""), (1, "added", "", "extra{}"), (2, "added", "", "message{}")}


def test_more_fields_than_a_word_and_null_ids(spark):
    names = [f"f{i}" for i in range(150)]
    c = drift.Contract.of(spark.createDataFrame([(n, "any", "number", "count", True) for n in names] + [("x.y", "user", "string", "word", True)], "field_path string, carrier string, json_types string, value_form string, is_always boolean"))
    full = {n: 1 for n in names}
    rows = [(1, None, None, full | {"f63": "x"}), (2, None, None, {k: v for k, v in full.items() if k not in ("f64", "f149")} | {"f64b": 2}), (3, 7, 1, {k: v for k, v in full.items() if k != "f128"} | {"type": "user", "x": {}})]
    df = spark.createDataFrame([(i, f, r, json.dumps(o).encode()) for i, f, r, o in rows], "raw_line_id long, source_file_id long, first_run_id long, line_bytes binary")
    got = {tuple(r) for r in drift.drift_report(df, c).collect()}
    assert got == {(None, None, "retyped", "f63", "f63"), (None, None, "added", "", "f64b"), (7, 1, "removed", "f128", ""), (7, 1, "removed", "x.y", ""), (7, 1, "added", "", "type"), (7, 1, "added", "", "x")}
