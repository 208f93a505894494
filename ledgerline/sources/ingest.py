"""One ingest run: files to new raw lines, the facts of lines not derived yet, and what machines share."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop, stored
from . import derive, exchange, files, store


#: Lines of other machines stand under this and the machine's name.
MACHINE_ROOT = "machine:"


class Ingest:
    """Raw lines (appended to), file state and problems under one folder; derived tables come from the raw lines alone.

    A run reads from where the last one stopped, drops lines that are known, and appends. The file state moves
    last: a run that dies before it reads the same bytes again, and drops the lines it had stored.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        table = lambda n: store.Versions(spark, f"{self.folder}/{n}")
        self.raw, self.state, self.problems, self.runs = map(table, ("raw_lines", "file_state", "problems", "runs"))
        self.log_facts, self.spool_facts, self.origins = map(table, ("log_facts", "spool_facts", "origins"))

    def run(self, root: str, run_id: int, *, full: bool = False, below: str = "projects", kind: str = "log", range_bytes: int = 128 << 20) -> int:
        """Ingests a root; the number of new lines."""
        found = files.discover(self.spark, root, below, kind=kind)
        started, problems = files.resume(found, self.state.read(), full)
        started = stored(started, "started")
        lines = stored(files.complete_lines(started, range_bytes), "read")
        known = self.raw.read()
        new = stored(store.unknown_lines(lines, known), "new")
        n = self._append(new, run_id)
        after = stored(files.state_after(started, lines), "after")
        old_state = self.state.read()
        problems = stored(problems.withColumn("run_id", F.lit(run_id).cast("long")), "problems")
        if old_state is not None and "inode" not in old_state.columns:
            old_state = old_state.withColumn("inode", F.lit(None).cast("long"))
        self.state.write(after if old_state is None else store.upsert(old_state, after, ["root", "relative_path"]))
        self.problems.append(problems)
        drop(started, lines, new, after, problems)
        return n

    def _append(self, new: DataFrame, run_id: int, at: datetime | None = None) -> int:
        """Numbers new lines and appends them; how many there were."""
        self.runs.append(self.spark.createDataFrame([(run_id, (at or datetime.now()).strftime("%Y-%m"))], "first_run_id long, month string"))
        known = self.raw.read()
        n = new.count()
        # A file keeps the id it had; new files follow in order of root and path.
        top = (known.agg(F.max("raw_line_id"), F.max("source_file_id")).first() if known is not None else None) or (0, 0)
        old_files = known.select("root", "relative_path", "source_file_id").distinct() if known is not None else None
        fresh = new.select("root", "relative_path").distinct()
        if old_files is not None:
            fresh = fresh.join(old_files, ["root", "relative_path"], "left_anti")
        file_ids = store.with_ids(fresh, ["root", "relative_path"], top[1] or 0, "source_file_id")
        file_ids = file_ids if old_files is None else old_files.unionByName(file_ids)
        rows = store.with_ids(new.join(file_ids, ["root", "relative_path"]).withColumn("first_run_id", F.lit(run_id).cast("long")), ["root", "relative_path", "line_number"], top[0] or 0)
        self.raw.append(rows.select("raw_line_id", "source_file_id", "root", "relative_path", "kind", "line_number", "byte_offset", "content_hash", "line_bytes", "first_run_id"))
        return n

    def share(self, folder: str | None, machine_id: str, label: str, account_hash: str, run_id: int, now: datetime) -> dict:
        """The machines step of a run: this machine's scrubbed lines out, the others' in, each of their lines once.

        No folder: off. A folder that isn't there is more often an unmounted drive than a new one, so it isn't made.
        """
        if folder is None:
            return {"kind": "off"}
        if not os.path.isdir(folder):
            return {"kind": "folder_missing", "folder": folder}
        raw, months = self.raw.read(), self.runs.read()
        if raw is not None:
            own = os.path.join(folder, machine_id)
            exchange.export(raw.filter(~F.col("root").startswith(MACHINE_ROOT)), months.groupBy("first_run_id").agg(F.min("month").alias("month")), own)
            exchange.write_description(own, machine_id, label, account_hash, now.isoformat())
        taken, problems = 0, []
        for other in sorted(os.listdir(folder)):
            if other == machine_id or not os.path.isfile(os.path.join(folder, other, "machine.json")):
                continue
            lines, faults = exchange.imported(self.spark, os.path.join(folder, other), known_origins=self.origins.read())
            lines = stored(lines, "imported")
            new = lines.select(
                F.lit(MACHINE_ROOT + other).alias("root"), F.regexp_extract("file", r"(kind=.*)$", 1).alias("relative_path"), F.regexp_extract("file", "kind=(log|spool)", 1).alias("kind"),
                "line_number", F.lit(0).cast("long").alias("byte_offset"), F.sha2("line_bytes", 256).alias("content_hash"), "line_bytes",
            )
            taken += self._append(stored(store.unknown_lines(new, self.raw.read()), "new"), run_id, now)
            self.origins.append(lines.select("origin"))
            problems += [tuple(r) for r in faults.limit(1000).collect()]  # shown to a person
        return {"kind": "done", "imported": taken, "problems": problems}

    def derive(self) -> None:
        """Derives the lines whose facts aren't stored yet; all of them if the stored facts are of another version."""
        raw = self.raw.read()
        for table, of in ((self.log_facts, derive.log_facts), (self.spool_facts, derive.spool_facts)):
            head = table.head()
            if not head or head["signature"] != derive.VERSION:
                table.write(of(raw), derive.VERSION)
                continue
            kind = "log" if of is derive.log_facts else "spool"
            # Ids first, so that no line's bytes are shuffled.
            ids = stored(raw.filter(F.col("kind") == kind).select("raw_line_id").join(table.read().select("raw_line_id"), "raw_line_id", "left_anti"), "undone")
            if not ids.isEmpty():
                table.append(of(raw.join(ids, "raw_line_id", "left_semi")))
            drop(ids)

    def derived(self) -> dict[str, DataFrame]:
        """The derived tables, each line by itself and once: deleting the stored facts and deriving again gives the same rows."""
        self.derive()
        log, spool = self.log_facts.read(), self.spool_facts.read()
        return {
            "parsed_lines": derive.parsed_lines(log), "requests": derive.requests(log), "events": derive.events(log), "line_problems": derive.line_problems(log),
            "status_readings": derive.status_readings(spool), "rate_limit_windows": derive.rate_limit_windows(spool),
        }

    def tables(self) -> dict[str, DataFrame]:
        """What reports read: raw lines, source files and the derived tables."""
        raw = self.raw.read()
        ids = raw.groupBy("source_file_id", "root", "relative_path", "kind").agg(F.count("*").alias("line_count"))
        state = self.state.read().select("root", "relative_path", "byte_offset")
        source_files = ids.join(state, ["root", "relative_path"], "left").withColumn("size_bytes", F.col("byte_offset"))
        return self.derived() | {"raw_lines": raw, "source_files": source_files}
