"""Joins that resolve names and references: ranked fallbacks with at most one match for each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (resolved, raw, ...) with file_id: the file at the resolved path, else at the raw one, else null."""
    one = files.select(F.col("path").alias("resolved"), F.col("file_id").alias("_a"))
    two = files.select(F.col("path").alias("raw"), F.col("file_id").alias("_b"))
    return imports.join(one, "resolved", "left").join(two, "raw", "left").withColumn("file_id", F.coalesce("_a", "_b")).drop("_a", "_b")


def narrowest(wanted: DataFrame, members: DataFrame, up: DataFrame) -> DataFrame:
    """wanted (caller, name) with found: the first member of that name in the narrowest scope at or above the caller.

    up: ancestors of the callers (id, ancestor, hops).  An aggregation by (hops, id) picks the match, so nothing is
    sorted and partial results combine early.
    """
    wanted = wanted.select("caller", "name").distinct()
    own = wanted.select("caller").distinct()
    above = up.select(F.col("id").alias("caller"), F.col("ancestor").alias("scope"), "hops").join(own, "caller", "left_semi")
    scopes = own.select("caller", F.col("caller").alias("scope"), F.lit(0).alias("hops")).unionByName(above)
    m = members.where("parent_id is not null").groupBy(F.col("parent_id").alias("scope"), "name").agg(F.min("id").alias("found"))
    hits = wanted.join(scopes, "caller").join(m, ["scope", "name"])
    best = hits.groupBy("caller", "name").agg(F.min(F.struct("hops", "found")).alias("b"))
    return best.select("caller", "name", F.col("b.found").alias("found"), "b.hops")


def unique_only(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of keys that stand once; the same value twice is twice."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def cascade(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first branch whose condition holds, null included: a branch that fails doesn't fall through."""
    (first, value), *rest = branches
    return reduce(lambda c, b: c.when(*b), rest, F.when(first, value)).otherwise(otherwise)


def containing(points: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """points (pid, file_id, line) with id: the first range (by id) of the file with line_start <= line <= line_end.

    Ranges are cut into blocks of lines and joined on (file, block) by equality, so no pair of a point and a
    range far from it is ever made.
    """
    cut = ranges.select("id", "file_id", "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.col("line_end") / width))).alias("_block"))
    p = points.withColumn("_block", F.floor(F.col("line") / width))
    hit = p.join(cut, ["file_id", "_block"]).where("line between line_start and line_end")
    return hit.groupBy("pid").agg(F.min("id").alias("id"))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, content_hash) that are new or whose content is another."""
    return now.join(before.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
