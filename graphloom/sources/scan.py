"""Directory scans: source files as rows, whole, with their hash."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import basename, content_hash, excluded, extension
from graphloom.languages import LANGUAGES, by_name


def scan_directory(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), largest: int | None = None) -> DataFrame:
    """(rel_path, basename, content, content_hash, language, readable) of registered files below root.

    A file of more than ``largest`` bytes (without it, of more than a row can hold) is listed with readable false and
    without content; the length is filtered by the source, so its bytes are never read.  The source passes over empty
    files, so those come from its listing.
    """
    root, largest = root.rstrip("/"), largest or 1 << 30
    path = root if "://" in root else f"file://{root}"
    glob = "*{" + ",".join(LANGUAGES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    plain = F.regexp_replace("path", "^file:/+", "/")
    rel = F.expr("substring(_p, length(_r) + 2)")
    names = [*exclude, *sorted({d for x in LANGUAGES.values() for d in x.excluded_dirs})]
    languages = F.create_map(*[F.lit(x) for e, k in LANGUAGES.items() for x in (e, k.name)])

    def shaped(df: DataFrame, readable: bool, content=None) -> DataFrame:
        content = F.lit(None).cast("binary") if content is None else content
        one = df.select(plain.alias("_p"), F.lit(root.removeprefix("file://")).alias("_r"), content.alias("content")).select(rel.alias("rel_path"), "content")
        return one.where(~excluded("rel_path", names)).withColumn("language", F.element_at(languages, extension("rel_path"))).where("language is not null").withColumn("readable", F.lit(readable))

    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string").select(plain.alias("path"))
    empty = listed.join(files.select(plain.alias("path")), "path", "left_anti")
    found = shaped(files.where(F.col("length") <= largest), True, F.col("content")).unionByName(shaped(files.where(F.col("length") > largest), False)).unionByName(shaped(empty, True, F.lit(b"")))
    return found.select("rel_path", basename("rel_path").alias("basename"), "content", content_hash("content").alias("content_hash"), "language", "readable")


def sources_from(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """The same rows from texts held in memory."""
    return sources_of(spark.createDataFrame([(p, t.encode()) for p, t in texts.items()], "rel_path string, content binary"))


def sources_of(df: DataFrame) -> DataFrame:
    """The same rows from a table (rel_path, content); a path without a registered extension counts as zig."""
    languages = F.create_map(*[F.lit(x) for e, k in LANGUAGES.items() for x in (e, k.name)])
    df = df.withColumn("content", F.col("content").cast("binary")).withColumn("readable", F.lit(True))
    df = df.withColumn("language", F.coalesce(F.element_at(languages, extension("rel_path")), F.lit("zig")))
    return df.select("rel_path", basename("rel_path").alias("basename"), "content", content_hash("content").alias("content_hash"), "language", "readable")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): one file, whole."""
    return spark.read.text(path, wholetext=True)


def build_config(spark: SparkSession, root: str) -> list[str]:
    """The dependencies that the build files in a folder name, of every language; none where there are no such files."""
    root, out = root.rstrip("/"), []
    for language in by_name().values():
        for name in language.build_files:
            path = (root if "://" in root else f"file://{root}") + f"/{name}"
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                out += [d for r in read_text(spark, path).collect() for d in language.parse_build_config(r["value"])]
    return list(dict.fromkeys(out))
