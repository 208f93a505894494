"""Following files that grow: a streaming source with byte offsets per file, and sinks that take each line once.

The built-in file source reads a file once, so it can't follow one. This source lists a folder, remembers each
file's byte offset and line count in the stream's own offsets, and reads complete lines only. What arrives late
is taken whenever it comes; there is no watermark, as a response's kept line may still change.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.store import Versions, unknown_lines

LINES = "relative_path string, line_number bigint, byte_offset bigint, content_hash string, line_bytes binary"


class _Range(InputPartition):
    def __init__(self, path: str, relative: str, start: int, line: int, end: int):
        self.path, self.relative, self.start, self.line, self.end = path, relative, start, line, end


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.most = int(options.get("maxbytesperfile", 256 << 20))
        self._known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _ends(self, path: str, start: int, line: int) -> tuple[int, int]:
        """Offset and line count after the last complete line within the next `most` bytes (further, if one line is longer)."""
        end, n, at = start, line, start
        with open(path, "rb") as f:
            f.seek(start)
            while data := f.read(1 << 20):
                k = data.count(b"\n")
                if k:
                    n += k
                    end = at + data.rindex(b"\n") + 1
                at += len(data)
                if k and end - start >= self.most:
                    break
        return end, n

    def latestOffset(self) -> dict:
        now: dict[str, list[int]] = {}
        for folder, dirs, names in os.walk(self.root):
            dirs[:] = [d for d in dirs if not os.path.islink(os.path.join(folder, d))]
            for name in names:
                path = os.path.join(folder, name)
                if not name.endswith(self.suffix) or os.path.islink(path):
                    continue
                rel = os.path.relpath(path, self.root)
                start, line, generation = self._known.get(rel, [0, 0, 0])
                if os.path.getsize(path) < start:  # rewritten: read again, known lines are dropped by the sink
                    start, line, generation = 0, 0, generation + 1
                now[rel] = [*self._ends(path, start, line), generation]
        self._known = dict(sorted(now.items()))
        return {"files": json.dumps(self._known)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        self._known = self._known or b
        out = []
        for rel, (to, _, generation) in b.items():
            at, line, before = a.get(rel, [0, 0, generation])
            if before != generation:
                at, line = 0, 0
            if to > at:
                out.append(_Range(os.path.join(self.root, rel), rel, at, line, to))
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at, n = partition.start, partition.line
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                n += 1
                yield partition.relative, n, at, hashlib.sha256(line[:-1]).hexdigest(), line[:-1]
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """format("tail"): options path (a folder), suffix, maxBytesPerFile."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader({k.lower(): v for k, v in self.options.items()})


def tail(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("suffix", suffix).load(path)


def follow(lines: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Appends each line once to the store in folder, whatever is delivered or replayed; the started query.

    Identity is (file, content): a batch that runs twice finds its lines known, so the sink is idempotent.
    """

    def sink(batch: DataFrame, _: int) -> None:
        table = Versions(batch.sparkSession, folder)
        new = unknown_lines(batch, table.read(), ("relative_path", "content_hash")).persist()
        if not new.isEmpty():
            table.append(new)
        new.unpersist()

    q = lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")).start()


def latest_responses(requests: DataFrame, order: list[str], folder: str, checkpoint: str, line_id: str = "raw_line_id"):
    """Keeps one row per dedup_key in folder while rows stream in; a later delivery that orders higher replaces it.

    No row is forgotten: the kept rows are the state, replaced whole after each batch, and late rows compete like
    any other. Rows without key are kept each; line_id, unique and never null, tells them from replays.
    """
    if line_id not in requests.columns:
        raise ValueError(f"rows need their line's id: {line_id}")

    def sink(batch: DataFrame, _: int) -> None:
        table = Versions(batch.sparkSession, folder)
        old = table.read()
        rows = batch if old is None else old.unionByName(batch)
        best = F.max_by(F.struct(*rows.columns), F.struct(*order))
        keyed = rows.filter("dedup_key is not null").groupBy("dedup_key").agg(best.alias("r")).select("r.*")
        table.write(keyed.unionByName(rows.filter("dedup_key is null").dropDuplicates([line_id])))

    return requests.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
