"""Collects queries with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.plans import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(reads) under name; sql is DuckDB's twin over aln, iv and sq."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(fixture.alignments(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = fixture.oracle(sql)
        return f

    return add


def table_query(name: str, sql: str | None = None, raw: bool = False):
    """Registers f(spark, sf_dir) under name; raw: sql stands by itself."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql if raw else fixture.oracle(sql)
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new path for files that a query writes and reads: under the shared checkpoint folder, in a local session without one under a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="readloom-scratch-")
    return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"
