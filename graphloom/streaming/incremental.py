"""Keeping an index up to date: only files whose content changed are parsed again.

State is a folder with a table of parsed files for each generation and a pointer to the latest.  A generation
is written whole before the pointer moves, so a lost job leaves the one before in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.graph import CodeGraph
from graphloom.operators.resolve import changed_files
from graphloom.plans.index import IndexResult, graph_of, parse_files
from graphloom.sources.scan import scan_directory


def _latest(spark: SparkSession, state: str) -> str | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{state}/latest")
    if not path.getFileSystem(conf).exists(path):
        return None
    return max(spark.read.text(f"{state}/latest").collect(), key=lambda r: int(r[0].split(" ")[0]))[0]


def _publish(spark: SparkSession, state: str, number: int, folder: str) -> None:
    spark.createDataFrame([(f"{number} {folder}",)], "value string").coalesce(1).write.mode("append").text(f"{state}/latest")


def parsed_state(spark: SparkSession, state: str) -> DataFrame | None:
    latest = _latest(spark, state)
    return None if latest is None else spark.read.parquet(latest.split(" ", 1)[1])


def update(spark: SparkSession, files: DataFrame, state: str, whole: bool = True) -> IndexResult:
    """Bring the state up to files (scan_directory's rows); with whole, files that are no longer there go.

    A changed file's rows replace its old ones.  Unchanged files are found by an anti-join on path and hash,
    and only carried over.
    """
    good = files.where("readable")
    latest = _latest(spark, state)
    before = None if latest is None else spark.read.parquet(latest.split(" ", 1)[1])
    total, bad = good.count(), files.where("not readable").count()
    fresh = good
    if before is not None:
        old = before.selectExpr("rel_path as path", "content_hash")
        ids = changed_files(good.selectExpr("rel_path as path", "content_hash"), old).selectExpr("path as rel_path")
        fresh = good.join(ids, "rel_path", "left_semi")
    changed = fresh.count()
    number = 0 if latest is None else int(latest.split(" ")[0]) + 1
    folder = f"{state}/parsed-{number}-{uuid.uuid4().hex[:8]}"
    out = parse_files(fresh)
    if before is not None:
        kept = before.join(fresh.select("rel_path"), "rel_path", "left_anti")
        if whole:
            kept = kept.join(good.select("rel_path"), "rel_path", "left_semi")
        out = kept.select(*out.columns).unionByName(out)
    out.write.parquet(folder)
    _publish(spark, state, number, folder)
    return IndexResult(changed, total - changed, bad)


def index_incrementally(spark: SparkSession, root: str, state: str, exclude: tuple[str, ...] = (), parity: bool = False) -> tuple[CodeGraph, IndexResult]:
    """The graph of a folder as it is now, parsing only what changed since the state was last brought up to date."""
    result = update(spark, scan_directory(spark, root, exclude), state)
    return graph_of(parsed_state(spark, state), parity), result


def watch(spark: SparkSession, root: str, state: str, checkpoint: str, once: bool = True):
    """A streaming query that brings the state up to date with files as they arrive or change under root.

    The streaming file source passes over empty files; update() with a scan has them.
    """
    from pyspark.sql import functions as F

    from graphloom.functions.text import basename, content_hash, excluded, extension
    from graphloom.languages import LANGUAGES

    root = root.rstrip("/")
    names = sorted({d for x in LANGUAGES.values() for d in x.excluded_dirs})
    languages = F.create_map(*[F.lit(x) for e, k in LANGUAGES.items() for x in (e, k.name)])
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(LANGUAGES) + "}").load(root if "://" in root else f"file://{root}")
    rel = F.substring(F.regexp_replace("path", "^file:/+", "/"), F.lit(len(root.removeprefix("file://")) + 2), F.lit(1 << 20))
    rows = stream.where(F.col("length") < 1 << 30).select(rel.alias("rel_path"), "content", "modificationTime")
    rows = rows.where(~excluded("rel_path", names)).select("rel_path", basename("rel_path").alias("basename"), "content", content_hash("content").alias("content_hash"), F.element_at(languages, extension("rel_path")).alias("language"), F.lit(True).alias("readable"), "modificationTime")

    def each(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("rel_path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "rel_path"]), "modificationTime").alias("x")).select("rel_path", "x.*").drop("modificationTime")
        update(batch.sparkSession, newest, state, whole=False)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
