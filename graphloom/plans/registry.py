"""Registration of queries with SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.adapters import EDGES, NODES, RAW_EDGES, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = {"n": NODES, "r": RAW_EDGES, "e": EDGES}


def with_tables(text: str, tables: dict[str, str]) -> str:
    """The SQL with those of the tables that it names put in front, as common table expressions."""
    words = f" {text} ".replace("\n", " ").replace(")", " ").replace(",", " ")
    used = [f"{k} AS ({duck(v)})" for k, v in tables.items() if f" {k} " in words]
    body = text.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if recursive:
        body = ", " + body[len("WITH RECURSIVE") :] if used else body[len("WITH RECURSIVE") :]
    elif body.upper().startswith("WITH") and used:
        body = ", " + body[4:]
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(used) + " " if used or recursive else ""
    return head + body


def query(oracle: str | None = None, tables: dict[str, str] = TABLES):
    """Register a function of (spark, sf_dir); the oracle may use the tables n (nodes), r (raw edges) and e (edges)."""
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_tables(oracle, tables)
        return f

    return add
