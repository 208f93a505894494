import pytest

from ledgerline.sources.store import Versions
from ledgerline.streaming import tail


def test_tail_follows_growing_and_rewritten_files(spark, tmp_path):
    logs, out, mark = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "mark")
    logs.mkdir()

    def run():
        q = tail.follow(tail.tail(spark, str(logs)), out, mark)
        assert q.awaitTermination(120)
        table = Versions(spark, out).read()
        return sorted((r.relative_path, r.line_number, bytes(r.line_bytes)) for r in table.collect())

    (logs / "a.jsonl").write_bytes(b"1\n2\npart")
    assert run() == [("a.jsonl", 1, b"1"), ("a.jsonl", 2, b"2")]
    with (logs / "a.jsonl").open("ab") as f:
        f.write(b"ial\n")
    (logs / "b.jsonl").write_bytes(b"1\n")
    assert run() == [("a.jsonl", 1, b"1"), ("a.jsonl", 2, b"2"), ("a.jsonl", 3, b"partial"), ("b.jsonl", 1, b"1")]
    assert len(run()) == 4
    (logs / "a.jsonl").write_bytes(b"2\n9\n")  # shorter: read again from 0, the line that is known stays one
    assert [x for x in run() if x[2] in (b"2", b"9")] == [("a.jsonl", 2, b"2"), ("a.jsonl", 2, b"9")]


def test_latest_responses_takes_late_rows(spark, tmp_path):
    schema = "dedup_key string, output_tokens long, raw_line_id long"
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for rows in ([("a", 1, 1), ("b", 5, 2), (None, 1, 3)], [("a", 7, 4), ("b", 2, 5)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        q = tail.latest_responses(spark.readStream.schema(schema).parquet(src), ["output_tokens", "raw_line_id"], out, mark)
        assert q.awaitTermination(120)
    assert {tuple(r) for r in Versions(spark, out).read().collect()} == {("a", 7, 4), ("b", 5, 2), (None, 1, 3)}


def test_latest_responses_needs_line_ids(spark, tmp_path):
    src = spark.readStream.schema("dedup_key string, output_tokens long").parquet(str(tmp_path))
    with pytest.raises(ValueError):
        tail.latest_responses(src, ["output_tokens"], str(tmp_path / "out"), str(tmp_path / "mark"))
