"""Connected components of a link table by alternating star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.runtime import checkpointed


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step: every neighbour of a node is hung on the smallest node nearby."""
    if larger_only:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = sides.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    hung = sides.join(low, "u")
    if larger_only:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (u, v: long, not null); component is the smallest node reachable.

    Ends when a large and a small star step leave the links as they were; each step is written to
    the checkpoint folder, so lost executors cost one step. An empty table gives an empty table.
    """
    state = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
    edges = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(edges)
    while seen[0]:
        edges = checkpointed(_star(_star(edges, True), False), free=True)
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
