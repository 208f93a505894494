"""Append-only stores and small tables on plain Parquet: known lines dropped, rows replaced by key, versions swapped."""

from __future__ import annotations

import json
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import stored


def unknown_lines(incoming: DataFrame, known: DataFrame | None, keys: tuple[str, ...] = ("root", "relative_path", "content_hash"), first: str = "line_number") -> DataFrame:
    """The incoming rows whose key isn't known yet, of equal ones the first. Keys are never null; key and `first` name one row.

    Only keys are shuffled: what must go, later copies and known rows, is found by them and taken off the rows. `incoming`
    is read more than once: pass a stored table.
    """
    narrow = incoming.select(*keys, first)
    repeated = narrow.groupBy(*keys).agg(F.min(first).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    gone = narrow.join(repeated, list(keys)).filter(F.col(first) > F.col("_first")).select(*keys, first)
    if known is not None:
        gone = gone.unionByName(narrow.join(known.select(*keys), list(keys), "left_semi"))
    return incoming.join(gone, [*keys, first], "left_anti")


def with_ids(rows: DataFrame, order: list[str], after: int, name: str = "raw_line_id") -> DataFrame:
    """rows with ids after+1, after+2, ... in the given order: the same ids whenever the same rows come in.

    Rows are range-partitioned and numbered within partitions; partition counts, one row each, shift the numbers.
    """
    import pyarrow as pa

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(n + 1, n + 1 + b.num_rows), pa.int64())], names=[*b.schema.names, "_part", "_n"])
            n += b.num_rows

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(ordered.mapInArrow(number, fields + ", _part int, _n long"), "numbered")
    counts = numbered.groupBy("_part").agg(F.max("_n").alias("_m"))
    shift = counts.select("_part", F.coalesce(F.sum("_m").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return numbered.join(F.broadcast(shift), "_part").select(*rows.columns, (F.col("_n") + F.col("_s") + after).alias(name))  # a row per partition


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key; a null key is a key like any other."""
    on = None
    marked = new.select(*[F.col(k).alias("_k_" + k) for k in keys]).distinct()
    for k in keys:
        c = F.col(k).eqNullSafe(F.col("_k_" + k))
        on = c if on is None else on & c
    return old.join(marked, on, "left_anti").unionByName(new)


def without(old: DataFrame, gone: Column) -> DataFrame:
    """old without the rows for which `gone` holds (unknown counts as no)."""
    return old.filter(~F.coalesce(gone, F.lit(False)))


class Versions:
    """A table in a folder as a list of immutable parts; readers see the parts that the head file names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def head(self) -> dict | None:
        """parts and signature, or None for a table that was never written."""
        heads = self._fs.globStatus(self._path(f"{self.folder}/HEAD-*.json"))
        names = sorted(s.getPath().getName() for s in heads or [])
        if not names:
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/{names[-1]}", wholetext=True).first()[0])

    def read(self) -> DataFrame | None:
        head = self.head()
        return head and self.spark.read.parquet(*[f"{self.folder}/{p}" for p in head["parts"]])

    def _put(self, head: dict | None, parts: list[str], signature: str) -> None:
        # The head with the highest number counts, and it appears in one rename: readers never see half a change.
        n = (head["number"] + 1) if head else 0
        name = f"{self.folder}/HEAD-{n:012d}.json"
        out = self._fs.create(self._path(name + ".new"))
        out.write(bytearray(json.dumps({"number": n, "parts": parts, "signature": signature}).encode()))
        out.close()
        if not self._fs.rename(self._path(name + ".new"), self._path(name)):
            raise RuntimeError(f"another writer changed {self.folder}")
        if head:
            self._fs.delete(self._path(f"{self.folder}/HEAD-{head['number']:012d}.json"), False)
            for gone in set(head["parts"]) - set(parts):
                self._fs.delete(self._path(f"{self.folder}/{gone}"), True)

    def _part(self, df: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def write(self, df: DataFrame, signature: str = "") -> None:
        """df in place of the whole table."""
        self._put(self.head(), [self._part(df)], signature)

    def append(self, df: DataFrame) -> None:
        """df beside what is there; old parts are not read or rewritten."""
        head = self.head()
        self._put(head, [*(head["parts"] if head else []), self._part(df)], head["signature"] if head else "")

    def refresh(self, signature: str, compute) -> bool:
        """Writes compute() unless the stored version has the signature already; whether it wrote."""
        head = self.head()
        if head and head["signature"] == signature:
            return False
        self.write(compute(), signature)
        return True


def signature_of(df: DataFrame, version: str) -> str:
    """Changes when a table's files or the rules that read them (`version`) do; reads no data."""
    import hashlib

    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    found = []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        s = path.getFileSystem(conf).getFileStatus(path)
        found.append(f"{f}|{s.getLen()}|{s.getModificationTime()}")
    return hashlib.sha256("\n".join([version, *found]).encode()).hexdigest()
