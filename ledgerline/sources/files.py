"""JSONL files read byte-exactly: discovery, complete lines, resuming where the last run stopped.

A file is cut into byte ranges, one task each, so a file with a third of all bytes is read by as many tasks as
its size asks for. Lines are split at 0x0A only; a line belongs to the range it starts in and may reach into
the next; a last line without newline is left for a later run. Line numbers come from a first, parallel count
of newlines per range. Nothing is decoded: hashes and offsets are over the bytes as written.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import stored

FILES = "root string, relative_path string, kind string, size_bytes long, inode long"
STATE = "root string, relative_path string, byte_offset long, line_count long"
LINES = "root string, relative_path string, kind string, line_number long, byte_offset long, content_hash string, line_bytes binary"
CHUNK = 1 << 20


def roots(explicit: str | None, config_home: str | None, home: str, name: str, is_dir=os.path.isdir) -> list[str]:
    """Folders that hold a projects folder: the explicit comma-separated list, else config_home/name and home/.name.

    An explicit list of which no entry holds one is an error; repeated entries count once.
    """
    given = [e.strip() for e in (explicit or "").split(",") if e.strip()]
    if given:
        found = [r for r in dict.fromkeys(os.path.join(home, e[2:]) if e.startswith("~/") else home if e == "~" else e for e in given) if is_dir(os.path.join(r, "projects"))]
        if not found:
            raise FileNotFoundError(f"none of these folders holds a projects folder: {explicit}")
        return found
    usual = ([os.path.join(config_home, name)] if config_home and config_home.startswith("/") else []) + [os.path.join(home, "." + name)]
    return [r for r in dict.fromkeys(usual) if is_dir(os.path.join(r, "projects"))]


def discover(spark: SparkSession, root: str, below: str = "projects", suffix: str = ".jsonl", kind: str = "log") -> DataFrame:
    """Every file under root/below with the suffix, any depth, sorted by path bytes; links and unreadable folders are skipped."""
    found, skipped = [], 0

    def unreadable(_: OSError) -> None:
        nonlocal skipped
        skipped += 1

    for folder, dirs, names in os.walk(os.path.join(root, below), onerror=unreadable):
        dirs[:] = [d for d in dirs if not os.path.islink(os.path.join(folder, d))]
        for n in names:
            path = os.path.join(folder, n)
            if n.endswith(suffix) and not os.path.islink(path) and os.path.isfile(path):
                found.append((root, os.path.relpath(path, root).replace(os.sep, "/"), kind, (st := os.stat(path)).st_size, st.st_ino))
    found.sort(key=lambda f: f[1].encode())
    return spark.createDataFrame(found, FILES)


def resume(files: DataFrame, state: DataFrame | None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files with start_offset and start_line, problems): where each file's reading starts.

    A file shorter than what was read of it, or another one (by inode, where both are known) under its name, was
    rewritten: it starts at 0 again and is reported. full starts
    every file at 0; lines that are known already are dropped by the store.
    """
    if state is None or full:
        start = files.withColumns({"start_offset": F.lit(0).cast("long"), "start_line": F.lit(0).cast("long")})
        return start, files.limit(0).select("root", "relative_path", F.lit("file_rewritten").alias("problem"))
    before = F.col("inode") if "inode" in state.columns else F.lit(None).cast("long")
    j = files.join(state.select("root", "relative_path", "byte_offset", "line_count", before.alias("_inode")), ["root", "relative_path"], "left")
    shorter = F.coalesce((F.col("size_bytes") < F.col("byte_offset")) | F.coalesce(F.col("inode") != F.col("_inode"), F.lit(False)), F.lit(False))
    where = lambda c: F.when(shorter, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    started = j.select("root", "relative_path", "kind", "size_bytes", "inode", where("byte_offset").alias("start_offset"), where("line_count").alias("start_line"))
    return started, j.filter(shorter).select("root", "relative_path", F.lit("file_rewritten").alias("problem"))


def _open(root: str, relative: str):
    filesystem, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return filesystem.open_input_file(f"{path}/{relative}")


def _ranges(started: DataFrame, width: int) -> DataFrame:
    todo = started.filter("start_offset < size_bytes")
    cut = todo.withColumn("lo", F.explode(F.sequence("start_offset", F.col("size_bytes") - 1, F.lit(width))))
    return cut.withColumn("hi", F.least(F.col("lo") + width, F.col("size_bytes")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            n, at = 0, r["lo"]
            with _open(r["root"], r["relative_path"]) as f:
                f.seek(at)
                while at < r["hi"] and (data := f.read(min(CHUNK, r["hi"] - at))):
                    n += data.count(b"\n")
                    at += len(data)
            out.append((r["root"], r["relative_path"], r["lo"], n))
        if out:
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["root", "relative_path", "lo", "newlines"])


def _lines_in(f, lo: int, hi: int, at_start: bool) -> Iterator[tuple[int, bytes, int]]:
    """(offset, bytes, 1 if another line reaches into the range) of the complete lines that start in [lo, hi)."""
    base = lo if at_start else lo - 1  # the byte before tells whether a line starts at lo
    f.seek(base)
    buf, cur, seen, reaches, skipping = b"", 0, 0, 0, not at_start
    while True:
        end = buf.find(b"\n", max(cur, seen))
        if end < 0:
            seen = len(buf) - cur
            data = f.read(max(CHUNK, seen))  # twice as much each time, so a very long line costs linear time
            if not data:
                return
            base, buf, cur = base + cur, buf[cur:] + data, 0
            continue
        if skipping:
            skipping, reaches = False, int(base + end >= lo)
        elif base + cur < hi:
            yield base + cur, buf[cur:end], reaches
        cur, seen = end + 1, 0
        if base + cur >= hi:
            return


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in LINES.split(", ")]
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in batches:
        for r in b.to_pylist():
            rows, held, number = [], 0, r["before"]
            with _open(r["root"], r["relative_path"]) as f:
                for start, line, reaches in _lines_in(f, r["lo"], r["hi"], r["lo"] == r["start_offset"]):
                    number += 1
                    rows.append((r["root"], r["relative_path"], r["kind"], number + reaches, start, hashlib.sha256(line).hexdigest(), line))
                    held += len(line)
                    if held > 4 * CHUNK or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


def complete_lines(started: DataFrame, range_bytes: int = 128 << 20) -> DataFrame:
    """The complete lines of every file from its start on: 1-based line numbers, byte offsets, SHA-256, bytes."""
    ranges = _ranges(started, range_bytes)
    counted = ranges.repartition("root", "relative_path", "lo").mapInArrow(_count, "root string, relative_path string, lo long, newlines long")
    per_file = W.partitionBy("root", "relative_path").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    # Newlines before a range are complete lines before it; a line that reaches in ends with one more.
    before = counted.select("root", "relative_path", "lo", F.coalesce(F.sum("newlines").over(per_file), F.lit(0)).alias("_n"))
    ranges = ranges.join(before, ["root", "relative_path", "lo"]).withColumn("before", (F.col("start_line") + F.col("_n")).cast("long")).drop("_n")
    return stored(ranges, "ranges").repartition("root", "relative_path", "lo").mapInArrow(_read, LINES)


def state_after(started: DataFrame, lines: DataFrame) -> DataFrame:
    """root, relative_path, byte_offset, line_count, inode of every file once `lines` are read."""
    read = lines.groupBy("root", "relative_path").agg(F.max(F.col("byte_offset") + F.length("line_bytes") + 1).alias("_o"), F.max("line_number").alias("_n"))
    j = started.join(read, ["root", "relative_path"], "left")
    return j.select("root", "relative_path", F.coalesce("_o", "start_offset").alias("byte_offset"), F.coalesce("_n", "start_line").alias("line_count"), "inode")
