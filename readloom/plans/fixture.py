"""Alignments derived from the driver's tables by one SQL text that Spark and DuckDB evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import aux, cigar
from readloom.operators.orders import numbered

_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

#: As far as READS depends on the order's columns: rows alike in these are the same read, so the others needn't be shuffled to place them.
_READ = _ORDER[:5]

#: lineitem with rnk, its row's place.
RANKED = f"SELECT *, row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS rnk FROM lineitem"

_ROWS = """
SELECT CAST(rnk AS BIGINT) AS rnk, CAST(l_suppkey AS INT) AS sk, CAST(l_partkey AS INT) AS pk, CAST(l_linenumber AS INT) AS ln, CAST(l_quantity AS INT) AS q,
  'r' || CAST(l_orderkey AS VARCHAR(20)) AS qname,
  CAST((l_suppkey * 7 + l_linenumber) % 5 AS INT) - 1 AS refid, CAST((l_partkey * 13 + l_linenumber * 5) % 997 AS INT) AS pos0,
  CASE WHEN l_suppkey % 7 = 0 THEN -1 ELSE CAST((l_suppkey * 3 + l_linenumber) % 4 AS INT) END AS mref, CAST((l_partkey * 17) % 997 AS INT) AS mpos,
  translate(md5(CAST(l_partkey AS VARCHAR(20)) || ':' || CAST(l_linenumber AS VARCHAR(20))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq,
  translate(md5('q' || CAST(l_partkey AS VARCHAR(20)) || ':' || CAST(l_suppkey AS VARCHAR(20))), '0123456789abcdef', '!(+.5:?ABCDEFGHI') AS qual
FROM {ranked}
"""

#: One row per read; cigar and aux as text.
READS = """
SELECT rnk AS rank, qname,
  (CASE WHEN refid < 0 THEN 4 ELSE 0 END) + (CASE WHEN pk % 3 = 1 THEN 0 + 16 * (pk % 2) ELSE 16 * (sk % 2) END)
  + (CASE WHEN ln IN (5, 6) THEN 256 WHEN ln = 7 THEN 2048 ELSE 0 END) + (CASE WHEN q % 17 = 0 THEN 512 ELSE 0 END)
  + (CASE WHEN sk % 11 = 0 THEN 0 ELSE 1 + (CASE WHEN ln % 2 = 1 THEN 64 ELSE 128 END) + (CASE WHEN mref < 0 THEN 8 ELSE 0 END)
     + (CASE WHEN pk % 3 = 1 THEN 32 ELSE 0 END) + (CASE WHEN refid >= 0 AND mref >= 0 AND pk % 2 = 0 THEN 2 ELSE 0 END) END) AS flag,
  refid, CASE WHEN refid < 0 THEN -1 ELSE pos0 END AS pos, CASE WHEN refid < 0 THEN 0 ELSE pk % 60 END AS mapq,
  CASE WHEN refid < 0 THEN '*' WHEN q % 5 = 0 THEN '4S20M2D8M' WHEN q % 5 = 1 THEN '10M3I19M' WHEN q % 5 = 2 THEN '12M5N20M' WHEN q % 5 = 3 THEN '2H3S24M5S' ELSE '32M' END AS cigar,
  mref AS mate_refid, CASE WHEN mref < 0 THEN -1 ELSE mpos END AS mate_pos,
  CASE WHEN refid >= 0 AND refid = mref THEN mpos - pos0 ELSE 0 END AS tlen, seq, qual,
  'RG:Z:rg' || CAST(sk % 3 AS VARCHAR(20)) || (CASE WHEN refid < 0 THEN '' ELSE '|NM:i:' || CAST(pk % 4 AS VARCHAR(20)) END)
  || (CASE WHEN pk % 3 = 0 THEN '|MC:Z:32M' WHEN pk % 3 = 1 THEN '|MC:i:' || CAST(pos0 AS VARCHAR(20)) ELSE '' END)
  || (CASE WHEN pk % 5 = 0 THEN '|MS:i:' || CAST(q AS VARCHAR(20)) ELSE '' END)
  || (CASE WHEN pk % 7 = 0 THEN '|sc:A:' || (CASE WHEN pk % 2 = 0 THEN 'L' ELSE 'F' END) ELSE '' END)
  || (CASE WHEN sk % 4 = 0 THEN '|as:i:' || CAST(q % 6 AS VARCHAR(20)) ELSE '' END) || '|AB:Z:x' AS aux
FROM {rows}
"""

#: Named intervals from part; references from nation's region keys.
INTERVALS = """
SELECT 'g' || CAST(p_partkey % 50 AS VARCHAR(20)) AS gene, 'p' || CAST(p_partkey AS VARCHAR(20)) AS name, CAST(p_partkey % 4 AS INT) AS refid,
  CAST(p_partkey * 31 % 997 AS INT) AS "from", CAST(p_partkey * 31 % 997 + p_size AS INT) AS "to" FROM part WHERE p_partkey % 10 = 0
"""
REFERENCES = "SELECT CAST(n AS INT) AS refid, 'chr' || CAST(n AS VARCHAR(20)) AS name, 1100 AS length FROM (SELECT DISTINCT r_regionkey AS n FROM region WHERE r_regionkey < 5) x"


def oracle(sql: str) -> str:
    """DuckDB SQL over the views aln, iv and sq."""
    rows = _ROWS.format(ranked="ranked")
    return f"WITH ranked AS ({RANKED}), raw AS ({rows}), aln AS ({READS.format(rows='raw')}), iv AS ({INTERVALS}), sq AS ({REFERENCES}) {sql}"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads in the row model's schema."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ranked = numbered(lineitem, [F.col(c) for c in _READ], F.floor(F.col("l_orderkey") / 4096), "rnk")
    reads = spark.sql(READS.format(rows="(" + _ROWS.format(ranked="{ranked}") + ")"), ranked=ranked)
    return reads.withColumns({"cigar": cigar.parse(F.col("cigar")), "aux": aux.parse(F.col("aux"))})


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INTERVALS.replace('"', "`").replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REFERENCES.replace("FROM region", "FROM {region}"), region=spark.read.parquet(f"{sf_dir}/region.parquet"))
