"""Schemas that drift between files: one consistent table, and every change by batch.

Every line is loaded once as a map from dotted path to (raw JSON type, value). Paths run through objects for which
the contract lists members; every other value is a leaf. Listed paths are held by their position in the contract, so
a batch's statistics are bitmaps over it, one for each JSON type, combined inside the scan and then by a hash
aggregation: a file with a third of all rows ships one row per carrier and Arrow batch. Unlisted paths are counted
by name. Changes are judged on these statistics alone.

JSON is parsed in Python: a repeated key's last value counts, NaN and trailing text are refused and JSON types
stay apart, which the built-in JSON and variant functions do not offer together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strict_json import parse_object
from ..runtime import stored

TYPES = ("null", "boolean", "number", "string", "array", "object")
_BIT = {t: 1 << i for i, t in enumerate(TYPES)}

#: Value forms of strings. The names are the contract's.
_TEXT_FORMS = {
    "semver": re.compile(r"\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?"),
    "branch": re.compile(r"[A-Za-z0-9][\w.-]*(?:/[\w.-]+)*"),
    "abs_path": re.compile(r"(?:/|[A-Za-z]:[\\/]).*", re.S),
    "word": re.compile(r"[A-Za-z]+(?:[_-][A-Za-z]+)*"),
    "uuid": re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    "iso8601": re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?"),
    "id": re.compile(r"[a-z]+_[0-9A-Za-z]+"),
    "model": re.compile(r"[a-z]+(?:-[a-z0-9.]+)+|<synthetic>"),
    "sentence": re.compile(r"\S+(?:\s+\S+)+", re.S),
}
FORMS = (*_TEXT_FORMS, "flag", "count", "epoch_s", "object", "window_map", "list", "content")
_FORM_BIT = {f: 1 << i for i, f in enumerate(FORMS)}
_ALL_FORMS = (1 << len(FORMS)) - 1


def json_type(v: object) -> str:
    if v is None:
        return "null"
    if v is True or v is False:
        return "boolean"
    return {str: "string", list: "array", dict: "object"}.get(type(v), "number")


def form_bits(v: object) -> int:
    """The value forms that v has, as bits of FORMS."""
    bits = 0
    if type(v) is str:
        for f, rx in _TEXT_FORMS.items():
            if rx.fullmatch(v):
                bits |= _FORM_BIT[f]
        if bits & _FORM_BIT["sentence"] or not bits:
            bits |= _FORM_BIT["content"]
    elif v is True or v is False:
        bits = _FORM_BIT["flag"]
    elif type(v) is dict:
        bits = _FORM_BIT["object"]
        if v and all(type(x) is dict and "used_percentage" in x for x in v.values()):
            bits |= _FORM_BIT["window_map"]
    elif type(v) is list:
        bits = _FORM_BIT["list"]
        if v and all(type(x) is dict and "type" in x for x in v):
            bits |= _FORM_BIT["content"]
    elif v is not None:
        if v >= 0 and v == int(v) if v == v and abs(v) != float("inf") else False:
            bits |= _FORM_BIT["count"]
        if 1e9 <= v < 1e10:
            bits |= _FORM_BIT["epoch_s"]
    return bits


@dataclass(frozen=True)
class Contract:
    """Which paths a carrier's lines have: (path, carrier) -> (allowed type bits, form, always)."""

    fields: dict[tuple[str, str], tuple[int, str, bool]]
    through: frozenset[str] = field(default=frozenset())

    @classmethod
    def of(cls, line_fields: DataFrame, most: int = 100_000) -> Contract:
        """From the contract table, whose size is that of a schema; more than `most` rows are refused."""
        rows = line_fields.select("field_path", "carrier", "json_types", "value_form", "is_always").filter("field_path is not null").take(most + 1)
        if len(rows) > most:
            raise ValueError("the contract has too many rows for a schema")
        fields = {
            (p, c or "any"): (sum(_BIT.get(t, 0) for t in (types or "").split("|")), form or "", bool(always)) for p, c, types, form, always in rows
        }
        return cls(fields, frozenset(p.rpartition(".")[0] for p, _ in fields if "." in p))

    def allowed(self, path: str, carrier: str) -> int:
        """Type bits that a carrier's lines may have at a path; all of them where the contract doesn't say. null is always allowed."""
        own = self.fields.get((path, carrier)) or self.fields.get((path, "any"))
        return own[0] | 1 if own else (1 << len(TYPES)) - 1

    def paths(self) -> set[str]:
        return {p for p, _ in self.fields}

    def positions(self) -> list[str]:
        """The paths that have a position: the listed ones and the objects they run through."""
        return sorted(self.paths() | self.through)


#: Carriers of lines; "other" has no fields of its own. The contract's "any" stands for all of them.
CARRIERS = ("user", "assistant", "attachment", "system", "retry_notice", "other")


def carrier_of(line: dict) -> str:
    kind = line.get("type")
    if kind == "system":
        return "retry_notice" if line.get("subtype") == "api_error" else "system"
    return kind if kind in ("user", "assistant", "attachment") else "other"


def leaves(line: dict, through: frozenset[str], parent: str = "") -> Iterator[tuple[str, str, object]]:
    """(path, parent, value) of every member; objects with listed members are entered after being given themselves."""
    prefix = parent + "." if parent else ""
    for k, v in line.items():
        path = prefix + k
        yield path, parent, v
        if type(v) is dict and path in through:
            yield from leaves(v, through, path)


# --- path-value maps ----------------------------------------------------------------------------------------

_MORE = pa.struct([("parent", pa.string()), ("kind", pa.int8()), ("forms", pa.int64()), ("value", pa.string())])
_MAPPED = (
    "raw_line_id long, source_file_id long, first_run_id long, carrier string, kinds array<tinyint>, leaf array<string>, "
    "more map<string, struct<parent: string, kind: tinyint, forms: bigint, value: string>>"
)
_KIND = {t: i for i, t in enumerate(TYPES, 1)}


def _as_text(v: object) -> str | None:
    return v if type(v) is str else None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _maps(batches: Iterator[pa.RecordBatch], contract: Contract, values: bool) -> Iterator[pa.RecordBatch]:
    """Of (id, file, run, bytes): each JSON-object line as a path-value map."""
    through, listed, places = contract.through, contract.paths(), contract.positions()
    place, width = {p: i for i, p in enumerate(places)}, len(places)
    for b in batches:
        heads, kinds, leaf, ends, names, more = [], bytearray(), [], [0], [], []
        for i, f, r, raw in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if (line := parse_object(raw)) is None:
                continue
            heads.append((i, f, r, carrier_of(line)))
            row, texts, extra = bytearray(width), [None] * width if values else (), {}
            for path, parent, v in leaves(line, through):
                kind = _KIND[json_type(v)]
                if (at := place.get(path)) is not None:
                    row[at] = kind
                    if values:
                        texts[at] = _as_text(v)
                if path not in listed:
                    extra[path] = (parent, kind, _ALL_FORMS if v is None else form_bits(v), _as_text(v) if values else None)
            kinds += row
            leaf += texts
            names += extra
            more += extra.values()
            ends.append(len(names))
        if heads:
            n = len(heads)
            cols = [pa.array(c, x) for c, x in zip(zip(*heads, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            steps = pa.array(np.arange(n + 1, dtype=np.int32) * width)
            cols.append(pa.ListArray.from_arrays(steps, pa.array(np.frombuffer(kinds, np.int8))))
            cols.append(pa.ListArray.from_arrays(steps if values else pa.array(np.zeros(n + 1, np.int32)), pa.array(leaf, pa.string())))
            items = [pa.array(c, t.type) for c, t in zip(zip(*more, strict=True) if more else [[]] * 4, _MORE, strict=True)]
            cols.append(pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.StructArray.from_arrays(items, fields=list(_MORE))))
            yield pa.RecordBatch.from_arrays(cols, names=["raw_line_id", "source_file_id", "first_run_id", "carrier", "kinds", "leaf", "more"])


def path_maps(lines: DataFrame, contract: Contract, id: str = "raw_line_id", body: str = "line_bytes") -> DataFrame:
    """Each JSON-object line as path -> raw type and path -> value (strings as they are, anything else as JSON text).

    kinds and leaf hold the paths of contract.positions() (0 and null: not there), more the unlisted ones by name. Lines
    that are no JSON object are left out. Any column may be null; extra columns are ignored.
    """
    return _heads(lines, id, body).mapInArrow(lambda batches: _maps(batches, contract, True), _MAPPED)


def _heads(lines: DataFrame, id: str, body: str) -> DataFrame:
    return lines.select(F.col(id).cast("long"), F.col("source_file_id").cast("long"), F.col("first_run_id").cast("long"), F.col(body))


# --- statistics by batch ------------------------------------------------------------------------------------

_BITS = [f"b{t}" for t in range(len(TYPES))]
_STATS = "source_file_id long, first_run_id long, carrier string, word int, path string, parent string, lines long, " + ", ".join(f"{b} long" for b in _BITS) + ", due long, forms long"


def _fold(batches: Iterator[pa.RecordBatch], contract: Contract) -> Iterator[pa.RecordBatch]:
    """Of path-value maps: the statistics of each batch and carrier, and of each batch over all carriers ("any")."""
    places = contract.positions()
    place, width = {p: i for i, p in enumerate(places)}, len(places)
    words = max(1, -(-width // 64))
    above = np.array([place.get(p.rpartition(".")[0], -1) for p in places], int)
    bit = np.array([0, *(1 << t for t in range(len(TYPES)))], np.uint8)
    names = [c.split()[0] for c in _STATS.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * (3 + len(_BITS)))
    carrier_no = {c: i for i, c in enumerate((*CARRIERS, "any"))}

    def packed(m: np.ndarray) -> np.ndarray:
        out = np.zeros((len(m), words * 8), np.uint8)
        if width:
            got = np.packbits(m, axis=1, bitorder="little")
            out[:, : got.shape[1]] = got
        return out.view("<i8")

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        files, runs = (b.column(k).dictionary_encode("encode") for k in (1, 2))
        batch = files.indices.to_numpy().astype(np.int64) * len(runs.dictionary) + runs.indices.to_numpy()
        carriers = b.column(3).to_pylist()
        key = batch * len(carrier_no) + np.array([carrier_no[c] for c in carriers])
        order = np.argsort(key, kind="stable")
        group, start = np.unique(key[order], return_index=True)
        seen = np.bitwise_or.reduceat(bit[b.column(4).flatten().to_numpy().reshape(n, width)][order], start, axis=0) if width else np.zeros((len(group), 0), np.uint8)
        lines = np.diff(np.append(start, n))
        _, first = np.unique(group // len(carrier_no), return_index=True)
        group = np.append(group, group[first] // len(carrier_no) * len(carrier_no) + carrier_no["any"])
        seen = np.concatenate([seen, np.bitwise_or.reduceat(seen, first, axis=0)]) if width else np.zeros((len(group), 0), np.uint8)
        lines = np.append(lines, np.add.reduceat(lines, first))
        due = np.where(above >= 0, seen[:, np.maximum(above, 0)] & _BIT["object"], 1) != 0 if width else seen != 0
        maps = [packed((seen >> t) & 1) for t in range(len(TYPES))]
        of = group // len(carrier_no)
        f, r = (d.dictionary.take(pa.array(i)) for d, i in ((files, of // len(runs.dictionary)), (runs, of % len(runs.dictionary))))
        c = pa.array([(*CARRIERS, "any")[i] for i in group % len(carrier_no)], pa.string())
        dues, none = packed(due), pa.nulls(len(group), pa.string())
        for w in range(words):
            cols = [f, r, c, pa.array(np.full(len(group), w, np.int32)), none, none, pa.array(lines), *(pa.array(m[:, w]) for m in maps), pa.array(dues[:, w]), pa.nulls(len(group), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

        found: dict[tuple, list[int]] = {}
        more = b.column(6)
        if len(more.keys):
            row = np.repeat(np.arange(n), np.diff(more.offsets.to_numpy()))
            fs, rs = b.column(1).to_pylist(), b.column(2).to_pylist()
            parents, kinds, forms = (more.items.field(k).to_pylist() for k in range(3))
            for i, path, parent, kind, form in zip(row.tolist(), more.keys.to_pylist(), parents, kinds, forms, strict=True):
                for c in (carriers[i], "any"):
                    s = found.setdefault((fs[i], rs[i], c, path, parent), [0, 0, _ALL_FORMS])
                    s[0] += 1
                    s[1] |= 1 << kind - 1
                    s[2] &= form
        if found:
            rows = [(f, r, c, None, path, parent, k, *((t >> x) & 1 for x in range(len(TYPES))), None, form) for (f, r, c, path, parent), (k, t, form) in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _combined(partial: DataFrame) -> DataFrame:
    keys = ["source_file_id", "first_run_id", "carrier", "word", "path", "parent"]
    return partial.groupBy(*keys).agg(F.sum("lines").alias("lines"), *(F.bit_or(b).alias(b) for b in [*_BITS, "due"]), F.bit_and("forms").alias("forms"))


def path_stats(lines: DataFrame, contract: Contract, body: str = "line_bytes") -> DataFrame:
    """Per batch and carrier ("any": all of them): lines, and which paths they carry with which JSON types.

    Listed paths: one row for 64 positions (word), bit i of b0 to b5 set if a line has that type at position i, and of due if
    a line has the object that should carry it. Unlisted paths: a row each, with bit 0 for the types seen and the
    value forms that all non-null values share. The maps are folded inside the scan that makes them.
    """
    return _combined(_heads(lines, "raw_line_id", body).mapInArrow(lambda batches: _fold(_maps(batches, contract, False), contract), _STATS))


def mapped_stats(mapped: DataFrame, contract: Contract) -> DataFrame:
    """path_stats of a stored table of path_maps, without parsing again."""
    return _combined(mapped.mapInArrow(lambda batches: _fold(batches, contract), _STATS))


# --- changes ------------------------------------------------------------------------------------------------


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _and(a: DataFrame, b: DataFrame, nullable: list[str], keys: tuple[str, ...]) -> Column:
    """Equal in all columns; ids of files and runs may be null."""
    on = F.lit(True)
    for c in nullable:
        on = on & a[c].eqNullSafe(b[c])
    for c in keys:
        on = on & (a[c] == b[c])
    return on


def changes(stats: DataFrame, contract: Contract) -> DataFrame:
    """Every change of a batch against the contract: source_file_id, first_run_id, change_kind, old_path, new_path.

    retyped, removed, renamed and added as the module's users know them. If several unlisted paths could stand
    for a missing one, the one whose name shares most words with it and then the first by name is taken, and each
    stands for one path only. `stats` is read several times: pass a stored table.
    """
    spark, batch = stats.sparkSession, ["source_file_id", "first_run_id"]
    spot = {p: (i // 64, _signed(1 << i % 64)) for i, p in enumerate(contract.positions())}
    # All of these have as many rows as a schema has fields, whatever the data's size, so they are broadcast.
    names = spark.createDataFrame([(*spot[p], p) for p in sorted(contract.paths())], "word int, mask long, path string")
    wrong = spark.createDataFrame(
        [(c, spot[p][0], *(0 if contract.allowed(p, c) >> t & 1 else spot[p][1] for t in range(len(TYPES)))) for p in contract.paths() for c in CARRIERS],
        "carrier string, word int, " + ", ".join(f"n{t} long" for t in range(len(TYPES))),
    ).groupBy("carrier", "word").agg(*(F.bit_or(f"n{t}").alias(f"n{t}") for t in range(len(TYPES))))
    always = spark.createDataFrame(
        [(c, *spot[p], p, p.rpartition(".")[0], allowed | 1, _FORM_BIT.get(form, 0)) for (p, c), (allowed, form, is_always) in contract.fields.items() if is_always],
        "carrier string, word int, mask long, path string, parent string, allowed int, form long",
    )
    listed, unlisted = stats.filter("path is null"), stats.filter("path is not null")
    any_of = lambda cols: F.expr(" | ".join(cols))
    change = lambda kind, old, new: [*batch, F.lit(kind).alias("change_kind"), old.alias("old_path"), new.alias("new_path")]

    bad = listed.join(F.broadcast(wrong), ["carrier", "word"]).withColumn("bad", any_of(f"(b{t} & n{t})" for t in range(len(TYPES)))).filter("bad <> 0")
    retyped = bad.select(*batch, "word", "bad").join(F.broadcast(names), "word").filter("bad & mask <> 0").select(*change("retyped", F.col("path"), F.col("path")))

    # An always-field of lines that are there with its parent object, and that none of them carries.
    missing = listed.drop("path", "parent").join(F.broadcast(always), ["carrier", "word"]).withColumn("seen", any_of(_BITS)).filter("due & mask <> 0 and seen & mask = 0")
    missing = stored(missing.select(*batch, "carrier", "path", "parent", "allowed", "form"), "missing")

    # An unlisted path in its place, judged over the lines of the missing field's carrier.
    types = F.expr(" + ".join(f"(b{t} << {t})" for t in range(len(TYPES))))
    candidates = unlisted.select(*batch, "carrier", "parent", F.col("path").alias("new_path"), types.alias("types"), F.col("forms"))
    fits = missing.join(candidates, _and(missing, candidates, batch, ("carrier", "parent"))).select(*(missing[c] for c in missing.columns), "new_path", "types", "forms").filter("types & ~cast(allowed as bigint) = 0 and types <> 1 and forms & form <> 0")
    fits = fits.withColumn("near", -_shared_words(F.col("path"), F.col("new_path")))
    by_new = W.partitionBy(*batch, "new_path").orderBy("near", "path", "carrier")
    by_old = W.partitionBy(*batch, "carrier", "path").orderBy("near", "new_path")
    taken = fits.withColumn("i", F.row_number().over(by_new)).filter("i = 1").withColumn("j", F.row_number().over(by_old)).filter("j = 1")
    renamed = stored(taken.select(*batch, "carrier", "path", "new_path"), "renamed")

    gone = missing.join(renamed, _and(missing, renamed, batch, ("carrier", "path")), "left_anti")
    fresh = unlisted.filter("carrier = 'any'").select(*batch, F.col("path").alias("new_path"))
    fresh = fresh.join(renamed, _and(fresh, renamed, batch, ("new_path",)), "left_anti")
    out = retyped.unionByName(gone.select(*change("removed", F.col("path"), F.lit(""))))
    out = out.unionByName(renamed.select(*change("renamed", F.col("path"), F.col("new_path")))).unionByName(fresh.select(*change("added", F.lit(""), F.col("new_path"))))
    return out.distinct()


def _shared_words(a: Column, b: Column) -> Column:
    """How many words two path names share: camelCase and underscores split, lower case."""
    words = lambda c: F.split(F.lower(F.regexp_replace(F.regexp_replace(c, r"^.*\.", ""), r"([a-z])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    return F.size(F.array_intersect(words(a), words(b)))


# --- the consistent table ---------------------------------------------------------------------------------

_SQL_TYPE = {"boolean": "boolean", "number": "double", "string": "string"}


def column_name(path: str) -> str:
    """A listed path's column: dots become two underscores."""
    return path.replace(".", "__")


def unified(mapped: DataFrame, changed: DataFrame, contract: Contract) -> DataFrame:
    """One typed column per listed path, renamed paths read under the contract's name, and failed_casts.

    A path whose allowed types are one scalar (null apart) gets that type: numbers double, counts and epochs
    long, booleans boolean; all others are text (JSON text for objects and arrays). failed_casts lists path,
    type found and value of every carried value of a type that the contract does not allow for the carrier, or
    that the column's type can't hold; the column is null there.
    """
    batch, width = ["source_file_id", "first_run_id"], {p: i for i, p in enumerate(contract.positions())}
    swaps = changed.filter("change_kind = 'renamed'").groupBy(*batch).agg(F.map_from_entries(F.collect_set(F.struct("old_path", "new_path"))).alias("swap"))
    rows = mapped.join(swaps, _and(mapped, swaps, batch, ()), "left").select(*(mapped[c] for c in mapped.columns), "swap")
    code = lambda names: [_KIND[t] for t in names]
    by_path: dict[str, dict[str, tuple[int, str]]] = {}
    for (p, c), (t, form, _) in contract.fields.items():
        by_path.setdefault(p, {})[c] = (t, form)
    out, reports = [], []
    for path, carriers in sorted(by_path.items()):
        at = width[path]
        direct, swapped = F.nullif(F.col("kinds")[at], F.lit(0)), F.when(F.col("swap").isNotNull(), F.try_element_at("more", F.try_element_at("swap", F.lit(path))))
        kind = F.coalesce(direct, swapped["kind"])
        text = F.when(direct.isNotNull(), F.col("leaf")[at]).otherwise(swapped["value"])
        bits = 0
        for t, _ in carriers.values():
            bits |= t
        scalar = [t for t in TYPES[1:] if bits & _BIT[t]]
        forms = {f for _, f in carriers.values()}
        kind_sql = _SQL_TYPE.get(scalar[0], "string") if len(scalar) == 1 else "string"
        if kind_sql == "double" and forms <= {"count", "epoch_s"}:
            kind_sql = "bigint"
        ok = F.lit(False)
        for c, (t, _) in carriers.items():
            names = [x for x in TYPES if t & _BIT[x]] + ["null"]
            here = kind.isin(code(names))
            ok = ok | (here if c == "any" else (F.col("carrier") == c) & here)
        if "any" not in carriers:  # an unlisted carrier's value is kept if any carrier's type allows it
            ok = ok | (~F.col("carrier").isin(list(carriers)) & kind.isin(code([x for x in TYPES if bits & _BIT[x]] + ["null"])))
        value = F.when(ok, text.try_cast(kind_sql) if kind_sql != "string" else text)
        out.append(value.alias(column_name(path)))
        failed = kind.isNotNull() & (kind != _KIND["null"]) & value.isNull()
        reports.append(F.when(failed, F.struct(F.lit(path).alias("path"), F.get(F.array(*map(F.lit, TYPES)), kind - 1).alias("found"), text.alias("value"))))
    report = F.filter(F.array(*reports), lambda x: x.isNotNull()).alias("failed_casts")
    return rows.select("raw_line_id", *batch, "carrier", *out, report)


def drift_report(lines: DataFrame, contract: Contract) -> DataFrame:
    return changes(stored(path_stats(lines, contract), "paths"), contract)
