"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which Spark may judge by itself whether a written table is broadcast; a 20th of it where rows hold arrays of structs.
BROADCAST_ROWS = 20_000
_OWN: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and the session is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _OWN[app]


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a lost executor costs no recomputation.

    Spark takes the bytes of compressed files, less those of columns not read, for the size of a table in memory, and
    would broadcast, through the driver, tables of many times its threshold.  So a table of more than BROADCAST_ROWS
    asks for sort-merge joins; F.broadcast on the other side still counts for more.
    """
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    wide = any(isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) for f in df.schema)
    if (seen.get.get("n") or 0) > (BROADCAST_ROWS // 20 if wide else BROADCAST_ROWS):
        out = out.hint("merge")
    if _SCRATCH:
        _SCRATCH[-1].append(path)
        out._written_to = path
    return out


class scratch:  # noqa: N801
    """Deletes, at its end, the tables that cut() wrote inside it, but for those kept."""

    def __enter__(self) -> scratch:
        self.kept: set[str] = set()
        _SCRATCH.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """df, which cut() returned; an outer scratch has it from now on."""
        self.kept.add(df._written_to)
        self.spark = df.sparkSession
        return df

    def __exit__(self, *_) -> None:
        written = _SCRATCH.pop()
        if _SCRATCH:
            _SCRATCH[-1] += [p for p in written if p in self.kept]
        for p in written if self.kept else ():
            if p not in self.kept:
                _delete(self.spark, p)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    root = f"{shared_dir(df.sparkSession)}/graphloom/"
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.removeprefix("file://") in parent:
            _delete(df.sparkSession, parent)
