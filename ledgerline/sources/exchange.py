"""Lines shared between machines: personal text left behind, monthly gzip JSONL files, imports that store each line once."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import derive_spool
from ..functions.strict_json import compact, member, parse_object

# Fields of a log line that go on as written.
KEPT = (
    "type", "subtype", "sessionId", "uuid", "parentUuid", "timestamp", "isSidechain", "isMeta", "isApiErrorMessage", "requestId", "apiErrorStatus", "version", "originalModel", "fallbackModel",
    "apiRefusalCategory",
)
#: path -> what leaves of it. "[]" are a list's items, "!" is what stands where an object is expected. Anything not
#: listed stays behind; where a path goes on and something else than an object or list stands there, only what has no text leaves.
LOG_RULES = {
    **dict.fromkeys(KEPT, "whole"),
    "error.!": "whole", "error.status": "whole", "error.isNetworkDown": "whole", "error.rateLimits": "presence",
    "quotaLimits.rateLimitType": "whole", "quotaLimits.resetsAt": "whole",
    "origin.kind": "whole",
    "attachment.type": "whole", "attachment.commandMode": "whole",
    "message.id": "whole", "message.model": "whole", "message.usage": "whole", "message.content.[].type": "whole",
}
#: A client's own error notice keeps its text.
NOTICE_RULES = {p: r for p, r in LOG_RULES.items() if not p.startswith("message.content")} | {"message.content": "whole"}
PAYLOAD_RULES = dict.fromkeys(("session_id", "version", "rate_limits", "model.id", "cost.total_cost_usd"), "whole")
SPOOL_RULES = dict.fromkeys(("captured_at_s", "hook_version", "payload_b64"), "whole")
ORIGIN = "lineOrigin"
EXPORT_NAME = re.compile(r"(log|spool)-(\d{4}-(?:0[1-9]|1[0-2]))\.jsonl\.gz")
MOST_LINE, MOST_FILE, MOST_EXPANDED = 64 << 10, 64 << 20, 512 << 20
#: Lines of an exported file: of the longest that an import takes, so many stay below MOST_FILE uncompressed.
FILE_LINES = 1000

_LEAVES = {"whole": lambda v: v, "presence": lambda v: None if v is None else {}}


def _tree(rules: dict[str, str]) -> dict:
    """The rules by their paths' members; ends are functions."""
    out: dict = {}
    for path, rule in rules.items():
        *upper, last = path.split(".")
        at = out
        for name in upper:
            at = at.setdefault(name, {})
        at[last] = _LEAVES[rule]
    return out


_LOG, _NOTICE, _PAYLOAD, _SPOOL = map(_tree, (LOG_RULES, NOTICE_RULES, PAYLOAD_RULES, SPOOL_RULES))


def masked(value: object, rules: dict | Callable) -> object:
    """What the rules let through of a JSON value, in its own order."""
    if callable(rules):
        return rules(value)
    if type(value) is dict:
        return {k: masked(v, rules[k]) for k, v in value.items() if k in rules}
    if type(value) is list:
        return [masked(v, rules["[]"]) if type(v) is dict else None for v in value] if "[]" in rules else []
    if "!" in rules:
        return rules["!"](value)
    return "" if type(value) is str else value


def scrub_log(line: dict) -> dict:
    """A log line without what people or models wrote."""
    return masked(line, _NOTICE if line.get("isApiErrorMessage") is True else _LOG)


def scrub_spool(raw: bytes | None) -> dict | None:
    """A whole status line with only session, version, model, cost and limits; None for any other."""
    if derive_spool(raw)["status"] != "ok":
        return None
    line = masked(parse_object(raw), _SPOOL)
    payload = masked(parse_object(base64.b64decode(line["payload_b64"])), _PAYLOAD)
    return line | {"payload_b64": base64.b64encode(compact(payload).encode()).decode()}


def line_origin(relative_path: str, content_hash: str) -> str:
    """A line's identity anywhere: 32 hex digits over its file's path and its content."""
    return hashlib.sha256(f"{relative_path}\n{content_hash}".encode()).hexdigest()[:32]


def scrubbed(raw: DataFrame) -> DataFrame:
    """raw_line_id, kind, first_run_id, origin, line: what may leave the machine; malformed lines stay behind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, kind, run, path, digest, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                line = scrub_spool(body) if kind == "spool" else scrub_log(o) if (o := parse_object(body)) is not None else None
                if line is not None:
                    origin = line_origin(path, digest)
                    rows.append((i, kind, run, origin, compact(line | {ORIGIN: origin})))
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["raw_line_id", "kind", "first_run_id", "origin", "line"])

    rows = raw.select(F.col("raw_line_id").cast("long"), "kind", F.col("first_run_id").cast("long"), "relative_path", "content_hash", "line_bytes")
    return rows.mapInArrow(scan, "raw_line_id long, kind string, first_run_id long, origin string, line string")


def export(raw: DataFrame, run_month: DataFrame, folder: str) -> None:
    """Gzip JSONL by kind and month of the run that first saw the line (run_month: first_run_id, month), months replaced whole.

    Every task writes its own files of each month, so no month meets in one task; each partition folder is replaced
    dynamically, so other months stay.
    """
    spark = raw.sparkSession
    lines = scrubbed(raw).join(run_month, "first_run_id")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        lines.select("line", "kind", "month").write.mode("overwrite").partitionBy("kind", "month").option("maxRecordsPerFile", FILE_LINES).option("compression", "gzip").text(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def expand(data: bytes, most: int = MOST_EXPANDED) -> bytes | None:
    """A gzip file's content, or None if it is damaged, cut short, or would grow past the limit."""
    d = zlib.decompressobj(wbits=31)
    try:
        out = d.decompress(data, most)
    except zlib.error:
        return None
    return out if d.eof and not d.unconsumed_tail else None


def imported(spark: SparkSession, folder: str, known_files: DataFrame | None = None, known_origins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, problems) of another machine's export folder.

    Files that are unchanged (path, sha in known_files), too large or damaged are left for later, the latter two
    reported; lines that are too long or carry no origin are reported; a line whose origin is known, here or earlier in this import, is
    stored once. lines: file, origin, line_number, line_bytes, file_sha.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(folder)
    large = files.filter(F.col("length") > MOST_FILE).select(F.col("path").alias("file"), F.lit("too large").alias("problem"), F.lit(1).cast("long").alias("lines"))
    files = files.filter(F.col("length") <= MOST_FILE).select("path", "content", F.sha2("content", 256).alias("sha"))
    if known_files is not None:
        files = files.join(known_files.select("path", "sha"), ["path", "sha"], "left_anti")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                whole, rows = expand(content), []
                if whole is None:
                    rows.append((path, sha, None, None, None, "damaged"))
                else:
                    for n, line in enumerate(whole.split(b"\n")[:-1], 1):  # what follows the last newline isn't complete
                        origin = member(parse_object(line), ORIGIN) if len(line) <= MOST_LINE else None
                        ok = type(origin) is str and re.fullmatch("[0-9a-f]{32}", origin)
                        rows.append((path, sha, n, origin if ok else None, line if ok else None, None if ok else "line_rejected"))
                for i in range(0, len(rows), 5000):
                    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 5000], strict=True), types, strict=True)], names=["file", "file_sha", "line_number", "origin", "line_bytes", "problem"])

    rows = files.mapInArrow(scan, "file string, file_sha string, line_number long, origin string, line_bytes binary, problem string")
    good = rows.filter("problem is null").groupBy("origin").agg(F.min_by(F.struct("file", "file_sha", "line_number", "line_bytes"), F.struct("file", "line_number")).alias("r")).select("origin", "r.*")
    if known_origins is not None:
        good = good.join(known_origins.select("origin"), "origin", "left_anti")
    problems = rows.filter("problem is not null").groupBy("file", "problem").agg(F.count("*").alias("lines"))
    return good, problems.unionByName(large)


def write_description(folder: str, machine_id: str, label: str, account_hash: str, exported_at: str) -> None:
    """machine.json, written last and in one rename: a reader that sees it sees the whole export."""
    if not re.fullmatch("[0-9a-f]{64}", account_hash) or not 0 < len(label.strip()) <= 60 or not label.isprintable():
        raise ValueError("the label or the account's hash can't be used")
    body = {"format": 1, "machineId": machine_id, "label": label.strip(), "accountHash": account_hash, "exportedAt": exported_at}
    path = os.path.join(folder, "machine.json")
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(body, f)
    os.replace(path + ".new", path)


def read_gzip(path: str) -> list[str]:
    with gzip.open(path, "rt", encoding="utf-8") as f:
        return f.read().splitlines()
