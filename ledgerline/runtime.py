"""What operators need from the session: shared tables, row counts, checked broadcasts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows times their width stay under this.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Where it is unset, one of our own, and only on a local master: there is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerline_path = path
    return out


def stored_together(tables: list[DataFrame]) -> DataFrame:
    """Tables of stored() with one schema, read as one."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t._ledgerline_path for t in tables))


def drop(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more; any other frame is left alone."""
    for df in tables:
        if path := getattr(df, "_ledgerline_path", None):
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checked_broadcast(df: DataFrame, rows: int, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit; else as it is, for a shuffled join with AQE's skew handling."""
    return F.broadcast(df) if rows * width <= limit else df


def blocks(spark: SparkSession, rows: int, most: int = 500_000, least: int = 20_000) -> int:
    """Number of partitions for rows: none above `most` rows, all cores busy once there are `least` rows for each."""
    return max(1, math.ceil(rows / most), min(spark.sparkContext.defaultParallelism, math.ceil(rows / least)))
