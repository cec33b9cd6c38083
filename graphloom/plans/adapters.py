"""Relational tables as a property graph, so that every operator can be run and checked on them.

Regions are files, nations types, customers functions, suppliers constants, orders fields; brands and parts are
external.  The mapping is written once, as SQL both engines understand: ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

NODES = """
SELECT CAST(r_regionkey AS BIGINT) + 1000000000 AS id, r_name AS name, 'file' AS kind, r_name AS file_path, CAST(r_regionkey + 1 AS INT) AS line_start, CAST(NULL AS BIGINT) AS parent_id, 'public' AS visibility, 'none' AS external FROM {region}
UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 2000000000, n_name, 'type_def', CAST(NULL AS STRING), CAST(25 - n_nationkey AS INT), CAST(n_regionkey AS BIGINT) + 1000000000, 'public', 'none' FROM {nation}
UNION ALL SELECT c_custkey + 3000000000, c_name, 'function', CAST(NULL AS STRING), CAST(c_custkey % 97 AS INT), CAST(c_nationkey AS BIGINT) + 2000000000, CASE WHEN c_mktsegment = 'BUILDING' THEN 'private' ELSE 'public' END, 'none' FROM {customer}
UNION ALL SELECT o_orderkey + 4000000000, concat('order', CAST(o_orderkey AS STRING)), 'field', CAST(NULL AS STRING), CAST(o_orderkey % 89 AS INT), o_custkey + 3000000000, 'private', 'none' FROM {orders}
UNION ALL SELECT s_suppkey + 5000000000, s_name, 'constant', CAST(NULL AS STRING), CAST(s_suppkey % 83 AS INT), CAST(s_nationkey AS BIGINT) + 2000000000, 'private', 'none' FROM {supplier}
UNION ALL SELECT p_partkey + 6000000000, replace(p_name, ' ', '_'), 'type_def', CAST(NULL AS STRING), CAST(NULL AS INT), CAST(substring(p_brand, 7, 3) AS BIGINT) + 7000000000, 'public', 'dependency' FROM {part}
UNION ALL SELECT DISTINCT CAST(substring(p_brand, 7, 3) AS BIGINT) + 7000000000, replace(p_brand, '#', '_'), 'module', CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS BIGINT), 'public', 'dependency' FROM {part}
"""

#: With repeats; ord tells which of several came first, and source which file of lines it came from.
RAW_EDGES = """
SELECT l_orderkey + 4000000000 AS source_id, l_partkey + 6000000000 AS target_id, 'uses_type' AS edge_type, concat('line', CAST(l_linenumber AS STRING)) AS source, CAST(l_linenumber AS BIGINT) AS ord FROM {lineitem}
UNION ALL SELECT o_custkey + 3000000000, l_suppkey + 5000000000, 'calls', concat('line', CAST(l_linenumber AS STRING)), CAST(l_linenumber AS BIGINT) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT x.region + 1000000000, y.region + 1000000000, 'imports', 'phantom', CAST(0 AS BIGINT)
  FROM (SELECT DISTINCT c_custkey % 50 AS k, CAST(n_regionkey AS BIGINT) AS region FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) x
  JOIN (SELECT DISTINCT s_suppkey % 50 AS k, CAST(n_regionkey AS BIGINT) AS region FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey) y ON x.k = y.k
"""


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over tables of a folder, named {table}, and over frames given by name."""
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in set(re.findall(r"\{(\w+)\}", text)) - set(frames)}
    return spark.sql(text, **used, **{n: f for n, f in frames.items() if f"{{{n}}}" in text})


def duck(text: str) -> str:
    """The same SQL for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", text).replace("AS STRING", "AS VARCHAR")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, NODES)


#: Rows to a task where tables are large.
ROWS_A_PART = 1 << 20


def parts_of(spark: SparkSession, sf_dir: str) -> int | None:
    """Into how many parts lines of orders are to go; None where Spark's own parts are small enough.  Their number is in the file's footer."""
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return None if n < ROWS_A_PART * spark.sparkContext.defaultParallelism else -(-n // ROWS_A_PART)


def raw_edges(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """With ``parts``, orders and their lines meet in so many."""
    if parts is None:
        return sql(spark, sf_dir, RAW_EDGES)
    table = lambda name, key: spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(parts, key)
    text = RAW_EDGES.replace("{lineitem} JOIN {orders}", "{lines} JOIN {orders}")
    return sql(spark, sf_dir, text, lines=table("lineitem", "l_orderkey"), orders=table("orders", "o_orderkey"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes in the full schema."""
    from pyspark.sql import functions as F

    from graphloom.schemas import full_nodes

    n = nodes(spark, sf_dir).withColumn("external", F.struct(F.col("external").alias("kind"), F.lit(None).cast("string").alias("version")))
    return full_nodes(n)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges without loops; edge_id is a fixed mix of the key, unique over these tables."""
    from pyspark.sql import functions as F

    from graphloom.operators.graph import dedup_edges

    parts = parts_of(spark, sf_dir)
    return dedup_edges(raw_edges(spark, sf_dir, parts), "ord", parts and 2 * parts).withColumn("edge_id", F.expr(EDGE_ID)).drop("ord")


#: 2 bits of the type and 30 of each end's key, which together are unique.
EDGE_ID = """(source_id % 1000000000) * 1073741824 + target_id % 1000000000
  + CASE edge_type WHEN 'calls' THEN 0 WHEN 'imports' THEN 1152921504606846976 ELSE 2305843009213693952 END"""
EDGES = f"SELECT *, {EDGE_ID} AS edge_id FROM (SELECT source_id, target_id, edge_type, min(source) AS source FROM ({RAW_EDGES}) x WHERE source_id <> target_id GROUP BY source_id, target_id, edge_type) y"
