"""BLASTN XML: hits as alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom import model as m
from readloom.functions import sequences
from readloom.operators.reference import _run_lengths

_HSP = "num int, `bit-score` double, score double, evalue double, `query-from` int, `query-to` int, `hit-from` int, `hit-to` int, `query-frame` int, `hit-frame` int, identity int, positive int, gaps int, `align-len` int, qseq string, hseq string"
_HSP_FIELDS = ", ".join(f"`Hsp_{f.split()[0].strip('`')}`: {f.split()[1]}" for f in _HSP.split(", "))
SCHEMA = f"`Iteration_query-def` string, `Iteration_query-len` int, Iteration_hits struct<Hit: array<struct<Hit_def: string, Hit_hsps: struct<Hsp: array<struct<{_HSP_FIELDS}>>>>>>"


def read(spark: SparkSession, path: str, queries: DataFrame, sq: DataFrame, share: float = 0.0) -> DataFrame:
    """Alignments of BLASTN XML (rows of Iteration elements). queries: id, seq; sq: refid, name.

    Of each query and reference, the first match stays, and others that score share of it or more.
    Matches become =, mismatches X; the query's unaligned ends are soft clips. All but the first
    match of a query are secondary.
    """
    rows = spark.read.format("xml").option("rowTag", "Iteration").schema(SCHEMA).load(path)
    hits = rows.withColumn("_i", F.monotonically_increasing_id()).select("_i", F.regexp_extract("Iteration_query-def", r"^(\S+)", 1).alias("qname"), F.posexplode("Iteration_hits.Hit").alias("_h", "hit"))
    hsps = hits.select("_i", "qname", "_h", F.regexp_extract("hit.Hit_def", r"^(\S+)", 1).alias("name"), F.posexplode("hit.Hit_hsps.Hsp").alias("_k", "p"))
    best = F.first("p.Hsp_score").over(Window.partitionBy("_i", "_h").orderBy("_k"))
    kept = hsps.withColumn("_best", best).where((F.col("_k") == 0) | (F.col("p.Hsp_score") >= share * F.col("_best")))
    kept = kept.join(queries.select(F.col("id").alias("qname"), F.col("seq").alias("_q")), "qname").join(sq.select("name", "refid"), "name")
    back = F.col("p.Hsp_query-frame") * F.col("p.Hsp_hit-frame") < 0
    q, h = F.split("p.Hsp_qseq", ""), F.split("p.Hsp_hseq", "")
    ops = F.filter(F.zip_with(q, h, lambda a, b: F.when((a == "") | b.isNull() | a.isNull(), None).when(a == "-", "D").when(b == "-", "I").when(F.upper(a) == F.upper(b), "=").otherwise("X")), lambda x: x.isNotNull())
    front, rear = F.least("p.Hsp_query-from", "p.Hsp_query-to") - 1, F.length("_q") - F.greatest("p.Hsp_query-from", "p.Hsp_query-to")
    all_ops = F.concat(F.array_repeat(F.lit("S"), front), ops, F.array_repeat(F.lit("S"), rear))
    turned = F.when(back, F.reverse(all_ops)).otherwise(all_ops)
    first = (F.row_number().over(Window.partitionBy("_i").orderBy("_h", "_k")) == 1)
    tag = lambda t, kind, c: F.struct(F.lit(t).alias("tag"), F.lit(kind).alias("type"), c.cast("string").alias("value"))
    numbers = ["bit-score", "score", "evalue", "query-from", "query-to", "hit-from", "hit-to", "query-frame", "hit-frame", "identity", "positive", "gaps", "align-len"]
    tags = F.array(tag("AS", "i", F.col("p.Hsp_score").cast("int")), *[tag(f"Z{chr(65 + i)}", "f" if i < 3 else "i", F.col(f"p.Hsp_{n}")) for i, n in enumerate(numbers)])
    placed = kept.withColumns({"_first": first, "cigar": _run_lengths(F.transform(turned, lambda op: F.struct(op.alias("op"), F.lit(1).alias("len")))), "aux": tags})
    seq = F.when(back, sequences.reverse_complement(F.col("_q"))).otherwise(F.col("_q"))
    flag = F.when(back, m.REVERSE).otherwise(0).bitwiseOR(F.when(F.col("_first"), 0).otherwise(m.SECONDARY))
    none = F.lit(-1)
    return placed.select(
        (F.col("_i") * 1_000_000 + F.col("_h") * 1000 + F.col("_k")).alias("rank"), "qname", flag.alias("flag"), "refid", (F.least("p.Hsp_hit-from", "p.Hsp_hit-to") - 1).alias("pos"),
        F.lit(0).alias("mapq"), "cigar", none.alias("mate_refid"), none.alias("mate_pos"), F.lit(0).alias("tlen"), seq.alias("seq"), F.lit("*").alias("qual"), "aux",
    )
