"""Queries that group, join, order or count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import aux, cigar, flags, names
from readloom.operators import aggregates as A
from readloom.operators import checksums as S
from readloom.operators import duplicates as G
from readloom.operators import filters as D
from readloom.operators import folds as K
from readloom.operators import intervals as I
from readloom.operators import orders as O
from readloom.operators import pairs as P
from readloom.operators import reference as R
from readloom.plans import fixture
from readloom.plans.registry import query, scratch, table_query
from readloom.plans.row_queries import _REFLEN, tags_text
from readloom.sources import fastq as Q
from readloom.sources import sam

_NUM = "(CASE WHEN flag & 1 = 0 THEN 0 WHEN flag & 64 <> 0 THEN 1 ELSE 2 END)"
_MAIN = f"main AS (SELECT *, {_NUM} AS num, max(CASE WHEN {_NUM} = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qname) AS h1, max(CASE WHEN {_NUM} = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY qname) AS h2 FROM aln WHERE flag & 2304 = 0)"
_CLASS = "CASE WHEN num = 0 THEN 'S' WHEN num = 1 THEN (CASE WHEN h2 = 1 THEN 'F' ELSE 'O' END) ELSE (CASE WHEN h1 = 1 THEN 'F2' ELSE 'O2' END) END"
_FIVE = f"(CASE WHEN flag & 16 <> 0 THEN pos + {_REFLEN} - 1 + (CASE cigar WHEN '2H3S24M5S' THEN 5 ELSE 0 END) ELSE pos - (CASE cigar WHEN '4S20M2D8M' THEN 4 WHEN '2H3S24M5S' THEN 5 ELSE 0 END) END)"
_PAIRS = f"""m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY rank) AS k FROM main WHERE num = 1) x WHERE k = 1),
m2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY rank) AS k FROM main WHERE num = 2) x WHERE k = 1)"""


@query("e1_collate", f", {_MAIN}, {_PAIRS} SELECT qname, CAST(m1.rank AS VARCHAR) AS rank1, CAST(m2.rank AS VARCHAR) AS rank2, CASE WHEN m1.rank IS NULL THEN 'orphan2' WHEN m2.rank IS NULL THEN 'orphan1' ELSE 'pair' END AS kind FROM m1 FULL JOIN m2 USING (qname) UNION ALL SELECT qname, CAST(rank AS VARCHAR), NULL, 'single' FROM main WHERE num = 0")
def _(a: DataFrame) -> DataFrame:
    return P.mated(a).select("qname", F.col("a.rank").cast("string").alias("rank1"), F.col("b.rank").cast("string").alias("rank2"), "kind")


@query("e2_ranks_in_names", f", {_MAIN}, r AS (SELECT *, min(CASE WHEN num = 1 THEN rank END) OVER (PARTITION BY qname) AS r1, min(CASE WHEN num = 2 THEN rank END) OVER (PARTITION BY qname) AS r2 FROM main) SELECT rank, CASE WHEN num > 0 AND r1 IS NOT NULL AND r2 IS NOT NULL THEN CAST(r1 AS VARCHAR) || '_' || CAST(r2 AS VARCHAR) ELSE CAST(rank AS VARCHAR) || '_' || CAST(rank AS VARCHAR) END || '_' || qname AS qname FROM r")
def _(a: DataFrame) -> DataFrame:
    return P.ranks_in_names(a).select("rank", "qname")


@query("e2_uncollated", "SELECT rank, qname, flag FROM aln WHERE flag & 2304 = 0")
def _(a: DataFrame) -> DataFrame:
    return P.uncollated(a).select("rank", "qname", "flag")


_POST = f"""{_MAIN}, r AS (SELECT *, min(CASE WHEN num = 1 THEN rank END) OVER (PARTITION BY qname) AS r1, min(CASE WHEN num = 2 THEN rank END) OVER (PARTITION BY qname) AS r2 FROM main),
p AS (SELECT *, num > 0 AND r1 IS NOT NULL AND r2 IS NOT NULL AS paired FROM r),
n AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN paired THEN least(r1, r2) ELSE rank END, num, rank) - 1 AS place FROM p),
b AS (SELECT *, CASE WHEN paired THEN min(CASE WHEN num = 1 THEN place END) OVER (PARTITION BY qname) ELSE place END AS p1, CASE WHEN paired THEN min(CASE WHEN num = 2 THEN place END) OVER (PARTITION BY qname) ELSE place END AS p2 FROM n)"""


@query("e2_post_ranks", f", {_POST} SELECT rank AS old_rank, place AS rank, CAST(p1 AS VARCHAR) || CASE WHEN num > 0 THEN '_' || CAST(p2 AS VARCHAR) ELSE '' END || '_' || qname AS qname FROM b")
def _(a: DataFrame) -> DataFrame:
    digits = F.split(aux.value(F.col("aux"), "zz"), ",")
    old = F.aggregate(F.slice(digits, 2, 8), F.lit(0).cast("long"), lambda n, d: n * 256 + d.cast("long"))
    return P.post_ranks(a).select(old.alias("old_rank"), "rank", "qname")


@query("e3_pairs_only", f", {_MAIN}, {_PAIRS} SELECT qname, m1.seq AS seq1, m2.seq AS seq2 FROM m1 JOIN m2 USING (qname)")
def _(a: DataFrame) -> DataFrame:
    return P.mated(a).where("kind = 'pair'").select("qname", F.col("a.seq").alias("seq1"), F.col("b.seq").alias("seq2"))


@query("e4_fix_mate_coordinates", f", {_MAIN}, w AS (SELECT *, count(*) FILTER (num > 0) OVER (PARTITION BY qname) AS n, count(*) FILTER (num > 0 AND flag & 4 = 0) OVER (PARTITION BY qname) AS nm, max(CASE WHEN num > 0 AND flag & 4 = 0 THEN refid END) OVER (PARTITION BY qname) AS r, max(CASE WHEN num > 0 AND flag & 4 = 0 THEN pos END) OVER (PARTITION BY qname) AS p FROM main) SELECT rank, CASE WHEN f THEN r ELSE refid END AS refid, CASE WHEN f THEN p ELSE pos END AS pos, CASE WHEN f THEN r ELSE mate_refid END AS mate_refid, CASE WHEN f THEN p ELSE mate_pos END AS mate_pos FROM (SELECT *, n = 2 AND nm = 1 AND num > 0 AS f FROM w) x")
def _(a: DataFrame) -> DataFrame:
    return P.fix_mate_coordinates(a).select("rank", "refid", "pos", "mate_refid", "mate_pos")


@query("e6_fix_mates", f", {_MAIN}, {_PAIRS}, j AS (SELECT a.*, m.rank AS mr, m.refid AS m_refid, m.pos AS m_pos, m.flag AS m_flag, m.five AS m_five FROM (SELECT *, CASE WHEN flag & 2304 = 0 THEN {_NUM} ELSE 0 END AS num, {_FIVE} AS five FROM aln) a LEFT JOIN (SELECT qname, 2 AS num, rank, refid, pos, flag, {_FIVE} AS five FROM m1 UNION ALL SELECT qname, 1, rank, refid, pos, flag, {_FIVE} FROM m2) m ON a.qname = m.qname AND a.num = m.num) SELECT rank, CASE WHEN mr IS NULL THEN flag ELSE (flag & 65495) | (CASE WHEN m_flag & 4 <> 0 THEN 8 ELSE 0 END) | (CASE WHEN m_flag & 16 <> 0 THEN 32 ELSE 0 END) END AS flag, CASE WHEN mr IS NULL THEN mate_refid ELSE m_refid END AS mate_refid, CASE WHEN mr IS NULL THEN mate_pos ELSE m_pos END AS mate_pos, CASE WHEN mr IS NULL THEN tlen WHEN flag & 4 = 0 AND m_flag & 4 = 0 AND refid = m_refid THEN m_five - five + sign(m_five - five) ELSE 0 END AS tlen FROM j")
def _(a: DataFrame) -> DataFrame:
    return P.fix_mates(a).select("rank", "flag", "mate_refid", "mate_pos", "tlen")


@query("e5_fix_mate_coordinates_by_name", f", {_MAIN}, w AS (SELECT *, count(*) FILTER (num > 0) OVER (PARTITION BY qname) AS n, count(*) FILTER (num > 0 AND flag & 4 = 0) OVER (PARTITION BY qname) AS nm, max(CASE WHEN num > 0 AND flag & 4 = 0 THEN refid END) OVER (PARTITION BY qname) AS r, max(CASE WHEN num > 0 AND flag & 4 = 0 THEN pos END) OVER (PARTITION BY qname) AS p FROM main) SELECT rank, CASE WHEN f THEN r ELSE refid END AS refid, CASE WHEN f THEN p ELSE pos END AS pos, CASE WHEN f THEN r ELSE mate_refid END AS mate_refid, CASE WHEN f THEN p ELSE mate_pos END AS mate_pos FROM (SELECT *, n = 2 AND nm = 1 AND num > 0 AS f FROM w) x UNION ALL SELECT rank, refid, pos, mate_refid, mate_pos FROM aln WHERE flag & 2304 <> 0")
def _(a: DataFrame) -> DataFrame:
    return P.fix_mate_coordinates(a, keep_others=True).select("rank", "refid", "pos", "mate_refid", "mate_pos")


#: Score of a read from its qualities, and each primary row with its mate.
_SCORE = "list_sum(list_transform(string_split(qual, ''), lambda c: CASE WHEN c <> '' AND ascii(c) - 33 >= 15 THEN ascii(c) - 33 ELSE 0 END))"
_MATES = f"mm AS (SELECT a.*, m.rank AS mr, m.flag AS m_flag, m.mapq AS m_mapq, m.five AS m_five, m.score AS m_score, m.cigar AS m_cigar, m.ab AS m_ab FROM (SELECT *, CASE WHEN flag & 2304 = 0 THEN {_NUM} ELSE 0 END AS num FROM aln) a LEFT JOIN (SELECT qname, 3 - num AS num, rank, flag, mapq, cigar, substr(aux, 6, 3) AS ab, {_FIVE} AS five, CAST({_SCORE} AS BIGINT) AS score FROM (SELECT * EXCLUDE (k) FROM m1 UNION ALL SELECT * EXCLUDE (k) FROM m2) y) m ON a.qname = m.qname AND a.num = m.num)"


@query("e6_mate_qualities", f", {_MAIN}, {_PAIRS}, {_MATES} SELECT rank, CAST(m_mapq AS VARCHAR) AS mq FROM mm")
def _(a: DataFrame) -> DataFrame:
    return P.fix_mates(a).select("rank", aux.value(F.col("aux"), "MQ", "i").alias("mq"))


@query("h2_mate_support_tags", f", {_MAIN}, {_PAIRS}, {_MATES} SELECT rank, CAST(m_score AS VARCHAR) AS ms, CASE WHEN m_flag & 4 = 0 THEN CAST(m_five + 1 AS VARCHAR) END AS mc, CASE WHEN mr IS NULL THEN (CASE WHEN aux LIKE '%|MC:Z:%' THEN '32M' END) WHEN m_flag & 4 = 0 THEN m_cigar WHEN aux LIKE '%|MC:Z:%' THEN '32M' END AS mate_cigar, m_ab AS mt FROM mm")
def _(a: DataFrame) -> DataFrame:
    t = F.col("aux")
    return P.fix_mates(a, support=True, tag="RG").select("rank", aux.value(t, "ms").alias("ms"), aux.value(t, "mc").alias("mc"), aux.value(t, "MC", "Z").alias("mate_cigar"), F.lower(aux.value(t, "mt")).alias("mt"))


@query("e12_mate_cigars", f", {_MAIN}, {_PAIRS}, {_MATES} SELECT rank, CASE WHEN m_flag & 4 = 0 THEN m_cigar WHEN aux LIKE '%|MC:Z:%' THEN '32M' END AS mc FROM mm")
def _(a: DataFrame) -> DataFrame:
    return P.add_mate_cigars(a).select("rank", aux.value(F.col("aux"), "MC", "Z").alias("mc"))


@query("j20_matching_pairs", f", {_MAIN}, {_PAIRS} SELECT qname FROM m1 JOIN m2 USING (qname)")
def _(a: DataFrame) -> DataFrame:
    return P.mated(P.fix_mates(a)).where(flags.matching_pair()).select("qname")


@query("d11_by_class", f", {_MAIN} SELECT rank, {_CLASS} AS class FROM main WHERE {_CLASS} IN ('F', 'O2')")
def _(a: DataFrame) -> DataFrame:
    return D.by_class(P.classified(a), ("F", "O2")).select("rank", "class")


_ROUTE = f"""w AS (SELECT *, {_NUM} AS num, flag & 2304 = 0 AS main FROM aln),
v AS (SELECT *, count(*) FILTER (num = 1) OVER p AS c1, count(*) FILTER (num = 2) OVER p AS c2, count(*) FILTER (main AND num = 1) OVER p AS p1, count(*) FILTER (main AND num = 2) OVER p AS p2,
  count(*) FILTER (flag & 256 <> 0) OVER p AS s, min(CASE WHEN main AND num = 1 THEN flag END) OVER p AS f1, min(CASE WHEN main AND num = 2 THEN flag END) OVER p AS f2,
  min(CASE WHEN main AND num = 1 THEN refid END) OVER p AS r1, min(CASE WHEN main AND num = 2 THEN refid END) OVER p AS r2 FROM w WINDOW p AS (PARTITION BY qname))
SELECT rank, CASE WHEN flag & 1 = 0 THEN 'single' WHEN c1 = 0 OR c2 = 0 THEN 'orphan' WHEN flag & 2048 <> 0 THEN 'supplementary' WHEN s > 0 OR p1 <> 1 OR p2 <> 1 OR (f1 & 2) <> (f2 & 2) THEN 'inconsistent'
  WHEN (f1 & 4) <> 0 OR (f2 & 4) <> 0 THEN 'unmapped' WHEN r1 <> r2 THEN 'split' WHEN (f1 & 16) = (f2 & 16) THEN 'samestrand' WHEN (f1 & 2) <> 0 THEN 'proper' ELSE 'improper' END AS category FROM v"""


@query("d15_routed", ", " + _ROUTE)
def _(a: DataFrame) -> DataFrame:
    return P.routed(a).select("rank", "category")


@query("e7_merge_tags_by_rank", "SELECT rank, qname, CASE WHEN flag & 2304 = 0 THEN 'RG:Z:new|XX:i:1' || regexp_replace(aux, '^RG:Z:rg[0-9]', '') ELSE 'RG:Z:new|XX:i:1' || regexp_replace(regexp_replace(aux, '^RG:Z:rg[0-9]', ''), '[|]as:i:[0-9]', '') END AS aux, flag FROM aln")
def _(a: DataFrame) -> DataFrame:
    new = aux.parse(F.lit("RG:Z:new|XX:i:1"))
    aligned = a.withColumns({"qname": F.concat_ws("_", F.col("rank").cast("string"), "qname"), "aux": new, "flag": F.col("flag").bitwiseAND(~512)})
    return P.merge_tags_by_rank(aligned, a).select("rank", "qname", tags_text(), "flag")


@query("e8_merge_tags_by_name", "SELECT aln.rank, 'AB:Z:own' || replace(o.aux, '|AB:Z:x', '') AS aux FROM (SELECT qname, '|' || arg_min(aux, rank) AS aux FROM aln GROUP BY qname) o JOIN aln USING (qname)")
def _(a: DataFrame) -> DataFrame:
    return P.merge_tags_by_name(a.withColumn("aux", aux.parse(F.lit("AB:Z:own"))), a).select("rank", tags_text())


@query("e9_fill_bases", ", f AS (SELECT qname, arg_min(seq, rank) AS read FROM aln GROUP BY qname) SELECT rank, CASE WHEN cigar = '2H3S24M5S' THEN substr(t, CASE WHEN cigar = '2H3S24M5S' THEN 3 ELSE 1 END) ELSE t END AS seq, repeat('H', CASE WHEN cigar = '2H3S24M5S' THEN 30 ELSE 32 END) AS qual FROM (SELECT aln.*, CASE WHEN flag & 16 <> 0 THEN translate(reverse(read), 'ACGT', 'TGCA') ELSE read END AS t FROM aln JOIN f USING (qname)) x")
def _(a: DataFrame) -> DataFrame:
    fasta = a.groupBy("qname").agg(F.min_by("seq", "rank").alias("seq")).withColumnRenamed("qname", "id")
    return P.fill_bases(a, fasta).select("rank", "seq", "qual")


_OVER = f"o AS (SELECT a.rank, iv.* FROM aln a JOIN iv ON a.refid = iv.refid AND a.flag & 4 = 0 AND a.pos <= iv.\"to\" AND a.pos + greatest({_REFLEN}, 1) - 1 >= iv.\"from\")"


@table_query("e10_interval_overlaps", f", {_OVER} SELECT rank, gene, name FROM o")
def _(spark, sf_dir) -> DataFrame:
    return I.overlaps(fixture.alignments(spark, sf_dir), fixture.intervals(spark, sf_dir), 128).select("rank", "gene", "name")


@table_query("e10_annotate", f", {_OVER} SELECT a.rank, a.aux || coalesce('|CO:Z:' || n.co, '') AS aux FROM aln a LEFT JOIN (SELECT rank, string_agg('(' || gene || ',' || name || ')', ';' ORDER BY \"from\", \"to\", name) AS co FROM o GROUP BY rank) n USING (rank)")
def _(spark, sf_dir) -> DataFrame:
    return I.annotate(fixture.alignments(spark, sf_dir), fixture.intervals(spark, sf_dir)).select("rank", tags_text())


@table_query("e11_unified_transcripts", ', s AS (SELECT gene, refid, "from", "to", max("to") OVER (PARTITION BY gene, refid ORDER BY "from", "to" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), t AS (SELECT *, sum(CASE WHEN reach IS NULL OR "from" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY gene, refid ORDER BY "from", "to") AS island FROM s), m AS (SELECT gene, refid, min("from") AS f, max("to") AS t FROM t GROUP BY gene, refid, island) SELECT gene, CASE WHEN k = 1 THEN gene ELSE gene || \'_\' || CAST(k AS VARCHAR) END AS name, \'chr\' || CAST(refid AS VARCHAR) AS refname, f AS from_pos, t AS to_pos FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY refid, f) AS k FROM m) x')
def _(spark, sf_dir) -> DataFrame:
    iv = fixture.intervals(spark, sf_dir).withColumn("refname", F.concat(F.lit("chr"), F.col("refid").cast("string")))
    return I.unified_transcripts(iv, "^chr").select("gene", "name", "refname", F.col("from").alias("from_pos"), F.col("to").alias("to_pos"))


_SKIP = "((flag & 4 = 0 AND refid < 0) OR (flag & 1 <> 0 AND flag & 8 = 0 AND mate_refid < 0))"
_KIND = f"CASE WHEN {_SKIP} THEN 'skipped' WHEN flag & 1 = 0 THEN (CASE WHEN flag & 4 = 0 THEN 'single' ELSE 'unmapped_single' END) WHEN flag & 12 = 0 THEN 'pair' WHEN flag & 4 = 0 THEN 'first_only' WHEN flag & 8 = 0 THEN 'second_only' ELSE 'unmapped_pair' END"


_DIST = f"k AS (SELECT *, {_KIND} AS kind FROM aln WHERE {_SKIP} OR (flag & 2304 = 0 AND (flag & 1 = 0 OR flag & 64 <> 0))), d AS (SELECT kind, CASE WHEN kind IN ('pair', 'first_only', 'single') THEN refid ELSE -1 END AS refid, CASE WHEN kind IN ('pair', 'second_only') THEN mate_refid ELSE -1 END AS mate_refid, count(*) AS n, count(*) FILTER (kind = 'pair' AND mapq >= 5) AS n_mapq5, count(*) FILTER (kind = 'pair' AND flag & 2 <> 0) AS n_proper FROM k GROUP BY ALL)"


@query("f1_pair_distribution", f", {_DIST} SELECT * FROM d")
def _(a: DataFrame) -> DataFrame:
    return A.pair_distribution(a)


@query("f1_split_shares", f", {_DIST}, s AS (SELECT refid, sum(n) AS n FROM d WHERE kind = 'pair' AND refid <> mate_refid GROUP BY refid) SELECT refid, CAST(n AS BIGINT) AS n_split, round(CAST(n AS DOUBLE) / sum(n) OVER (), 9) AS share FROM s")
def _(a: DataFrame) -> DataFrame:
    return A.split_shares(A.pair_distribution(a)).withColumn("share", F.round("share", 9))


@query("f2_aligned_bases", "SELECT CAST(sum(32 + CASE WHEN cigar = '2H3S24M5S' THEN 2 ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE cigar WHEN '2H3S24M5S' THEN 10 WHEN '4S20M2D8M' THEN 4 ELSE 0 END) AS BIGINT) AS clipped, CAST(sum(CASE cigar WHEN '2H3S24M5S' THEN 24 WHEN '4S20M2D8M' THEN 28 ELSE 32 END) AS BIGINT) AS aligned FROM aln WHERE flag & 4 = 0")
def _(a: DataFrame) -> DataFrame:
    return A.aligned_bases(a)


@query("f3_scrap_counts", "SELECT CASE WHEN aux LIKE '%|sc:A:L%' THEN 'L' WHEN aux LIKE '%|sc:A:F%' THEN 'F' END AS scrap, count(*) AS entries, CAST(sum(length(seq)) AS BIGINT) AS bases FROM aln GROUP BY 1")
def _(a: DataFrame) -> DataFrame:
    return A.scrap_counts(a)


_BOTH = f", {_MAIN}, {_PAIRS}, b AS (SELECT abs(m1.rank - m2.rank) AS d, CAST(abs(m1.tlen) AS BIGINT) AS t, m1.flag & 2 <> 0 AS proper FROM m1 JOIN m2 USING (qname) WHERE m1.flag & 4 = 0 AND m2.flag & 4 = 0)"


@query("f4_distance_histograms", f"{_BOTH} SELECT 'rank' AS histogram, d AS value, count(*) AS n FROM b GROUP BY d UNION ALL SELECT 'tlen', t, count(*) FROM b GROUP BY t UNION ALL SELECT 'tlen_proper', t, count(*) FROM b WHERE proper GROUP BY t")
def _(a: DataFrame) -> DataFrame:
    return A.distance_histograms(P.mated(a))


_BLOCKS = "bl AS (SELECT refid, pos AS s, pos + 20 AS e FROM aln WHERE cigar = '4S20M2D8M' UNION ALL SELECT refid, pos + 22, pos + 30 FROM aln WHERE cigar = '4S20M2D8M' UNION ALL SELECT refid, pos, pos + 29 FROM aln WHERE cigar = '10M3I19M' UNION ALL SELECT refid, pos, pos + 12 FROM aln WHERE cigar = '12M5N20M' UNION ALL SELECT refid, pos + 17, pos + 37 FROM aln WHERE cigar = '12M5N20M' UNION ALL SELECT refid, pos, pos + 24 FROM aln WHERE cigar = '2H3S24M5S' UNION ALL SELECT refid, pos, pos + 32 FROM aln WHERE cigar = '32M')"


@query("f5_depth", f", {_BLOCKS} SELECT refid, CAST(p AS INT) AS pos, count(*) AS depth FROM (SELECT refid, unnest(range(s, e)) AS p FROM bl) x GROUP BY refid, p")
def _(a: DataFrame) -> DataFrame:
    return A.depth(A.aligned_blocks(a), 256)


@query("f6_span_depth_histogram", f"SELECT depth, count(*) AS n FROM (SELECT refid, p, count(*) AS depth FROM (SELECT refid, unnest(range(pos, pos + {_REFLEN})) AS p FROM aln WHERE flag & 12 = 0) x GROUP BY refid, p) y GROUP BY depth")
def _(a: DataFrame) -> DataFrame:
    return A.span_depth_histogram(a)


_CELLS = "c AS (SELECT refid, CAST(pos + i AS INT) AS pos, CAST(0 AS INT) AS col, CASE WHEN cigar = '4S20M2D8M' THEN (CASE WHEN i < 20 THEN substr(seq, 5 + i, 1) WHEN i < 22 THEN '*' ELSE substr(seq, 3 + i, 1) END) WHEN cigar = '10M3I19M' THEN substr(seq, CASE WHEN i < 10 THEN 1 + i ELSE 4 + i END, 1) WHEN cigar = '12M5N20M' THEN substr(seq, CASE WHEN i < 12 THEN 1 + i ELSE i - 4 END, 1) WHEN cigar = '2H3S24M5S' THEN substr(seq, 4 + i, 1) ELSE substr(seq, 1 + i, 1) END AS base FROM (SELECT *, unnest(range(0, CASE cigar WHEN '4S20M2D8M' THEN 30 WHEN '10M3I19M' THEN 29 WHEN '12M5N20M' THEN 37 WHEN '2H3S24M5S' THEN 24 ELSE 32 END)) AS i FROM aln WHERE flag & 516 = 0) x WHERE NOT (cigar = '12M5N20M' AND i >= 12 AND i < 17) UNION ALL SELECT refid, CAST(pos + 10 AS INT), CAST(i - 3 AS INT), substr(seq, 11 + i, 1) FROM (SELECT *, unnest(range(0, 3)) AS i FROM aln WHERE flag & 516 = 0 AND cigar = '10M3I19M') y)"


@query("f8_pileup_counts", f", {_CELLS} SELECT refid, pos, col, base, count(*) AS n FROM c GROUP BY ALL")
def _(a: DataFrame) -> DataFrame:
    return A.pileup(a).groupBy("refid", "pos", F.col("column").alias("col"), "base").agg(F.count("*").alias("n"))


@query("f8_phred_consensus")
def _(a: DataFrame) -> DataFrame:
    return A.phred_consensus(A.pileup(a))


@query("f9_consensus", f", {_CELLS}, n AS (SELECT refid, pos, col, base, count(*) AS n FROM c GROUP BY ALL), cov AS (SELECT refid, pos, sum(n) AS cover FROM n WHERE col = 0 GROUP BY ALL), h AS (SELECT refid, pos, col, sum(n) AS held FROM n WHERE col < 0 GROUP BY ALL), a AS (SELECT refid, pos, col, base, sum(n) AS n FROM (SELECT * FROM n UNION ALL SELECT refid, pos, col, '*', cover - held FROM h JOIN cov USING (refid, pos) WHERE cover > held) z GROUP BY ALL) SELECT refid, pos, col, string_agg(repeat(base, CAST(n AS BIGINT)), '' ORDER BY base) AS bases, CAST(sum(n) AS BIGINT) AS depth, CASE WHEN count(*) FILTER (n = m) > 1 THEN 'N' ELSE arg_max(base, n) END AS consensus FROM (SELECT *, max(n) OVER (PARTITION BY refid, pos, col) AS m FROM a) q GROUP BY refid, pos, col")
def _(a: DataFrame) -> DataFrame:
    return A.consensus(A.pileup(a)).withColumnRenamed("column", "col")


@query("f12_quality_histogram", "SELECT quality, \"char\", n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 9) AS share, round(CAST(sum(n) OVER (ORDER BY quality) AS DOUBLE) / sum(n) OVER (), 9) AS cumulative FROM (SELECT CAST(ascii(c) - 33 AS INT) AS quality, c AS \"char\", count(*) AS n FROM (SELECT unnest(string_split(qual, '')) AS c FROM aln) x WHERE c <> '' GROUP BY ALL) y")
def _(a: DataFrame) -> DataFrame:
    return A.quality_histogram(a).withColumns({"share": F.round("share", 9), "cumulative": F.round("cumulative", 9)})


@query("f13_quality_histogram_descending", "SELECT quality, \"char\", n, round(CAST(sum(n) OVER (ORDER BY quality DESC) AS DOUBLE) / sum(n) OVER (), 9) AS cumulative FROM (SELECT CAST(ascii(c) - 33 AS INT) AS quality, c AS \"char\", count(*) AS n FROM (SELECT unnest(string_split(qual, '')) AS c FROM aln) x WHERE c <> '' GROUP BY ALL) y")
def _(a: DataFrame) -> DataFrame:
    return A.quality_histogram(a, descending=True).select("quality", "char", "n", F.round("cumulative", 9).alias("cumulative"))


@table_query("f15_comment_pairs", f", {_OVER}, x AS (SELECT qname, {_NUM} AS num, rank, gene FROM (SELECT DISTINCT rank, gene FROM o) g JOIN aln USING (rank)), p AS (SELECT DISTINCT a.qname, a.rank AS r1, b.rank AS r2, least(a.gene, b.gene) AS name1, greatest(a.gene, b.gene) AS name2 FROM x a JOIN x b ON a.qname = b.qname AND a.num = 1 AND b.num = 2) SELECT name1, name2, count(*) AS n, array_to_string(list_sort(list_distinct(list(qname))), ',') AS reads FROM p GROUP BY ALL")
def _(spark, sf_dir) -> DataFrame:
    bare = fixture.alignments(spark, sf_dir).withColumn("aux", aux.parse(F.lit("")))  # only CO is asked for
    return A.comment_pairs(I.annotate_genes(bare, fixture.intervals(spark, sf_dir)))


@query("f16_class_counts", f", {_MAIN} SELECT {_CLASS} AS class, count(*) AS n FROM main GROUP BY 1")
def _(a: DataFrame) -> DataFrame:
    return A.class_counts(P.classified(a))


_DUPS = f"""e AS (SELECT rank, qname, substr(aux, 6, 3) AS lib, refid, {_FIVE} AS five, CASE WHEN flag & 16 <> 0 THEN 1 ELSE 0 END AS strand, CAST({_SCORE} AS BIGINT) AS score, {_NUM} AS num FROM aln WHERE flag & 2820 = 0 AND refid >= 0),
t AS (SELECT qname FROM e GROUP BY qname HAVING count(*) FILTER (num = 1) = 1 AND count(*) FILTER (num = 2) = 1),
pe AS (SELECT e.* FROM e JOIN t USING (qname) WHERE num > 0),
lr AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY refid, five, strand, rank) AS side FROM pe),
pp AS (SELECT l.qname, least(l.lib, r.lib) AS lib, l.refid AS r1, l.five AS f1, l.strand AS s1, r.refid AS r2, r.five AS f2, r.strand AS s2, l.score + r.score AS score, l.rank AS k1, r.rank AS k2 FROM lr l JOIN lr r USING (qname) WHERE l.side = 1 AND r.side = 2),
po AS (SELECT *, row_number() OVER (PARTITION BY lib, r1, f1, s1, r2, f2, s2 ORDER BY score DESC, least(k1, k2)) AS place FROM pp),
fo AS (SELECT e.*, pe.rank IS NOT NULL AS in_pair, row_number() OVER (PARTITION BY e.lib, e.refid, e.five, e.strand ORDER BY CASE WHEN pe.rank IS NOT NULL THEN 0 ELSE 1 END, e.score DESC, e.rank) AS place FROM e LEFT JOIN pe USING (rank)),
dup AS (SELECT k1 AS rank, lib, 'pair' AS kind FROM po WHERE place > 1 UNION ALL SELECT k2, lib, 'pair' FROM po WHERE place > 1 UNION ALL SELECT rank, lib, 'fragment' FROM fo WHERE place > 1 AND NOT in_pair)"""
_METRICS = f"""SELECT m.lib, unmapped_reads, unpaired_reads, CAST(read_pairs AS BIGINT) AS read_pairs, coalesce(fd, 0) AS fragment_duplicates, coalesce(pd, 0) AS pair_duplicates FROM
(SELECT substr(aux, 6, 3) AS lib, count(*) FILTER (flag & 4 <> 0) AS unmapped_reads, count(*) FILTER (flag & 4 = 0 AND NOT (flag & 1 <> 0 AND flag & 8 = 0)) AS unpaired_reads, count(*) FILTER (flag & 1 <> 0 AND flag & 12 = 0) // 2 AS read_pairs FROM aln WHERE flag & 2816 = 0 GROUP BY 1) m
LEFT JOIN (SELECT lib, count(*) FILTER (kind = 'fragment') AS fd, count(*) FILTER (kind = 'pair') // 2 AS pd FROM dup GROUP BY lib) d USING (lib)"""


@query("g1_mark_duplicates", f", {_DUPS} SELECT rank, CASE WHEN dup.rank IS NULL THEN flag ELSE flag | 1024 END AS flag FROM aln LEFT JOIN dup USING (rank)")
def _(a: DataFrame) -> DataFrame:
    return G.mark_duplicates(a).select("rank", "flag")


@query("g1_remove_duplicates", f", {_DUPS} SELECT rank, flag FROM aln WHERE rank NOT IN (SELECT rank FROM dup)")
def _(a: DataFrame) -> DataFrame:
    return G.mark_duplicates(a, remove=True).select("rank", "flag")


def _with_places(a: DataFrame) -> DataFrame:
    """Names that end in tile, x and y."""
    number = F.substring("qname", 2, 20).cast("long")
    return a.withColumn("qname", F.concat_ws(":", F.lit("t"), number % 3, number * 7 % 500, number))


_OPTICAL = _DUPS + """,
kp AS (SELECT k1, k2, lib, place, first_value(qname) OVER (PARTITION BY lib, r1, f1, s1, r2, f2, s2 ORDER BY score DESC, least(k1, k2)) AS kept FROM po),
kd AS (SELECT k1 AS rank, kept, lib FROM kp WHERE place > 1 UNION ALL SELECT k2, kept, lib FROM kp WHERE place > 1),
od AS (SELECT d.rank, d.lib, CAST(substr(d.kept, 2) AS BIGINT) AS k, CAST(substr(a.qname, 2) AS BIGINT) AS n FROM kd d JOIN aln a USING (rank)),
of AS (SELECT rank, lib, 't:' || CAST(k % 3 AS VARCHAR) || ':' || CAST(k * 7 % 500 AS VARCHAR) || ':' || CAST(k AS VARCHAR) AS od FROM od WHERE k % 3 = n % 3 AND abs(k * 7 % 500 - n * 7 % 500) <= 100 AND abs(k - n) <= 100)"""


@query("g3_optical_duplicates", f", {_OPTICAL} SELECT rank, od AS kept FROM of")
def _(a: DataFrame) -> DataFrame:
    return G.optical_duplicates(_with_places(a)).select("rank", "kept")


@query("g3_optical_tags", f", {_OPTICAL} SELECT rank, od FROM aln LEFT JOIN of USING (rank)")
def _(a: DataFrame) -> DataFrame:
    return G.tag_optical(_with_places(a)).select("rank", aux.value(F.col("aux"), "od").alias("od"))


@query("f14_library_metrics", f", {_DUPS} {_METRICS}")
def _(a: DataFrame) -> DataFrame:
    return G.library_metrics(a, G.duplicate_ranks(a))


_OPTICAL_METRICS = _METRICS.replace("AS pair_duplicates", "AS pair_duplicates, coalesce(o.n, 0) AS optical_pair_duplicates", 1) + " LEFT JOIN (SELECT lib, count(*) // 2 AS n FROM of GROUP BY lib) o USING (lib)"


@query("f14_optical_metrics", f", {_OPTICAL} {_OPTICAL_METRICS}")
def _(a: DataFrame) -> DataFrame:
    a = _with_places(a)
    return G.library_metrics(a, G.duplicate_ranks(a), optical=G.optical_duplicates(a))


@query("f14_set_sizes", f", {_DUPS} SELECT lib, CAST(size AS BIGINT) AS size, count(*) AS n FROM (SELECT lib, count(*) AS size FROM po GROUP BY lib, r1, f1, s1, r2, f2, s2 HAVING count(*) > 1) x GROUP BY lib, size")
def _(a: DataFrame) -> DataFrame:
    return G.set_sizes(G.duplicate_ranks(a))


@query("f14_return_histogram")
def _(a: DataFrame) -> DataFrame:
    return G.return_histogram(G.library_sizes(G.library_metrics(a, G.duplicate_ranks(a))))


_COORD = "CASE WHEN refid < 0 THEN 4294967296 ELSE refid END, CASE WHEN pos < 0 THEN 4294967296 ELSE pos END"


@query("g5_sorted_and_marked", f", {_DUPS}, z AS (SELECT rank, refid, pos, CASE WHEN dup.rank IS NULL THEN flag ELSE flag | 1024 END AS flag FROM aln LEFT JOIN dup USING (rank)) SELECT rank, flag, row_number() OVER (ORDER BY {_COORD}, rank) - 1 AS place FROM z")
def _(a: DataFrame) -> DataFrame:
    marked = G.mark_duplicates(a)
    key = names.coordinate_key(F.col("refid"), F.col("pos"))
    return O.numbered(marked, O.sort_keys(), F.struct(key[0].alias("r"), F.floor(key[1] / 64).alias("p")), "place").select("rank", "flag", "place")


@query("h1_sort_coordinate", f"SELECT rank, row_number() OVER (ORDER BY {_COORD}, rank) - 1 AS place FROM aln")
def _(a: DataFrame) -> DataFrame:
    key = names.coordinate_key(F.col("refid"), F.col("pos"))
    return O.numbered(a, O.sort_keys(), F.struct(key[0].alias("r"), F.floor(key[1] / 64).alias("p")), "place").select("rank", "place")


@query("h1_sort_queryname", "SELECT rank, row_number() OVER (ORDER BY CAST(substr(qname, 2) AS BIGINT), CASE WHEN flag & 128 <> 0 THEN 1 ELSE 0 END, rank) - 1 AS place FROM aln")
def _(a: DataFrame) -> DataFrame:
    return O.numbered(a, O.sort_keys("queryname"), F.floor(F.substring("qname", 2, 20).cast("long") / 512), "place").select("rank", "place")


@query("h1_sort_tag", f"SELECT rank, row_number() OVER (ORDER BY substr(aux, 6, 3), {_COORD}, rank) - 1 AS place FROM aln")
def _(a: DataFrame) -> DataFrame:
    key = names.coordinate_key(F.col("refid"), F.col("pos"))
    group = F.substring(aux.value(F.col("aux"), "RG"), 3, 5).cast("long")
    return O.numbered(a, O.sort_keys("tag", "RG"), F.struct(group.alias("g"), key[0].alias("r"), F.floor(key[1] / 64).alias("p")), "place").select("rank", "place")


@query("h1_sort_queryname_HI", "SELECT rank, row_number() OVER (ORDER BY CAST(substr(qname, 2) AS BIGINT), CASE WHEN flag & 128 <> 0 THEN 1 ELSE 0 END, rank % 3, rank) - 1 AS place FROM aln")
def _(a: DataFrame) -> DataFrame:
    hits = a.withColumn("aux", aux.put(F.col("aux"), "HI", "i", F.col("rank") % 3))
    return O.numbered(hits, O.sort_keys("queryname_HI"), F.floor(F.substring("qname", 2, 20).cast("long") / 512), "place").select("rank", "place")


@query("h6_template_order", "SELECT rank, row_number() OVER (ORDER BY qname, CASE WHEN flag & 1 <> 0 THEN 0 ELSE 1 END, CASE WHEN flag & 256 <> 0 THEN 1 ELSE 0 END, CASE WHEN flag & 2048 <> 0 THEN 1 ELSE 0 END, CASE WHEN flag & 64 <> 0 THEN 0 ELSE 1 END, rank) - 1 AS place FROM aln")
def _(a: DataFrame) -> DataFrame:
    return O.numbered(a, O.sort_keys("template"), F.substring("qname", 1, 4), "place").select("rank", "place")


@query("h4_rank_gaps", "SELECT 2 * rank AS rank, CAST(4 AS BIGINT) AS delta FROM aln WHERE rank % 10 = 1 AND rank > 1")
def _(a: DataFrame) -> DataFrame:
    kept = a.where("rank % 10 <> 0").withColumn("qname", F.concat_ws("_", (F.col("rank") * 2).cast("string"), "qname"))
    return O.rank_gaps(kept, 2, blocks=1000)


@table_query("h5_merge", f"SELECT name, pos, rank, row_number() OVER (ORDER BY CASE WHEN refid < 0 THEN 9 WHEN refid = 3 THEN 0 ELSE refid + 1 END, CASE WHEN pos < 0 THEN 4294967296 ELSE pos END, rank % 2, rank) - 1 AS place FROM aln LEFT JOIN sq USING (refid)")
def _(spark, sf_dir) -> DataFrame:
    a, sq = fixture.alignments(spark, sf_dir), fixture.references(spark, sf_dir).where("refid < 4")
    # the first input has its references the other way round
    swap = lambda c: F.when(F.col(c) < 0, F.col(c)).otherwise(F.pmod(F.col(c) + 1, F.lit(4)))
    one = (a.where("rank % 2 = 0").withColumns({"refid": swap("refid"), "mate_refid": swap("mate_refid")}), sq.withColumn("refid", swap("refid")))
    rows, head = O.merge([one, (a.where("rank % 2 = 1"), sq)])
    key = names.coordinate_key(F.col("refid"), F.col("pos"))
    placed = O.numbered(rows, [*key, F.col("file"), F.col("rank")], F.struct(key[0].alias("r"), F.floor(key[1] / 64).alias("p")), "place")
    return placed.join(head.select("refid", "name"), "refid", "left").select("name", "pos", "rank", "place")


@table_query("i1_concatenate", "SELECT name, pos, rank, CAST(rank % 2 AS INT) AS file FROM aln LEFT JOIN sq USING (refid)")
def _(spark, sf_dir) -> DataFrame:
    a, sq = fixture.alignments(spark, sf_dir), fixture.references(spark, sf_dir).where("refid < 4")
    rows, head = O.merge([(a.where("rank % 2 = 0"), sq), (a.where("rank % 2 = 1"), sq)])
    return rows.join(head.select("refid", "name"), "refid", "left").select("name", "pos", "rank", "file")


@query("i4_used_ids", "SELECT DISTINCT refid, substr(aux, 6, 3) AS rg FROM aln")
def _(a: DataFrame) -> DataFrame:
    return a.select("refid", aux.value(F.col("aux"), "RG").alias("rg")).distinct()


@query("b4_sparse_index", "SELECT rank, refid, pos FROM aln WHERE rank % 1024 = 0")
def _(a: DataFrame) -> DataFrame:
    return O.sparse_index(a)


@query("b6_names_by_class", f", {_MAIN} SELECT qname, {_CLASS} AS class FROM main")
def _(a: DataFrame) -> DataFrame:
    return P.classified(a).select("qname", "class")


@query("b7_chunks", "SELECT rank, rank // 1000 AS chunk FROM aln")
def _(a: DataFrame) -> DataFrame:
    return O.chunks(a, 1000).select("rank", "chunk")


@query("b8_dealt", "SELECT rank, rank % 7 AS part FROM aln")
def _(a: DataFrame) -> DataFrame:
    return O.dealt(a, 7).select("rank", "part")


@query("b9_exploded_files", "SELECT refid, CAST(CASE WHEN refid < 0 THEN 4 ELSE refid END AS INT) AS file FROM (SELECT DISTINCT refid FROM aln) x")
def _(a: DataFrame) -> DataFrame:
    return O.exploded_files(a, 10)


@table_query("a5_range_scan", f"SELECT rank FROM aln JOIN sq USING (refid) WHERE flag & 4 = 0 AND ((name = 'chr1' AND pos <= 199 AND pos + {_REFLEN} - 1 >= 99) OR (name = 'chr2' AND pos + {_REFLEN} - 1 >= 899))")
def _(spark, sf_dir) -> DataFrame:
    return O.range_scan(fixture.alignments(spark, sf_dir), fixture.references(spark, sf_dir), "chr1:100-200 chr2:900").select("rank")


_CHAIN = f"s AS (SELECT rank, refid, pos, pos + {_REFLEN} - 1 AS \"end\" FROM aln WHERE flag & 4 = 0), o AS (SELECT *, pos - lag(\"end\") OVER (PARTITION BY refid ORDER BY pos, rank) AS \"offset\" FROM s), ch AS (SELECT *, sum(CASE WHEN \"offset\" IS NULL OR \"offset\" >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY refid ORDER BY pos, rank) AS chain FROM o)"


@query("g8_chains", f", {_CHAIN} SELECT rank, refid, CAST(\"offset\" AS VARCHAR) AS gap, CAST(chain AS BIGINT) AS chain FROM ch")
def _(a: DataFrame) -> DataFrame:
    return O.chains(a, 5, 128).select("rank", "refid", F.col("offset").cast("string").alias("gap"), "chain")


@query("g8_longest_chain", f", {_CHAIN} SELECT refid, CAST(chain AS BIGINT) AS chain, CAST(sum(\"end\" - pos + 1) AS BIGINT) AS length, count(*) AS members FROM ch GROUP BY refid, chain ORDER BY length DESC, refid, chain LIMIT 1")
def _(a: DataFrame) -> DataFrame:
    return O.longest_chain(O.chains(a, 5, 128))


def _reference(a: DataFrame) -> DataFrame:
    """A made-up reference: refid n repeats the digits of a hash of n."""
    return a.sparkSession.range(4).select(F.col("id").cast("int").alias("refid"), F.repeat(F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), 35).alias("seq"))


_REF = "r AS (SELECT CAST(n AS INT) AS refid, repeat(translate(md5(CAST(n AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 35) AS bases FROM range(4) t(n))"


@query("c17_exact_cigars")
def _(a: DataFrame) -> DataFrame:
    return R.exact_cigars(a, _reference(a)).select("rank", cigar.to_text(F.col("cigar")).alias("cigar"))


@query("c18_mismatch_tags")
def _(a: DataFrame) -> DataFrame:
    tags = R.mismatch_tags(a, _reference(a))
    return tags.select("rank", aux.value(F.col("aux"), "MD").alias("md"), aux.value(F.col("aux"), "NM").cast("long").alias("nm"))


@query("c19_checked_alignments")
def _(a: DataFrame) -> DataFrame:
    return R.checked_alignments(a, _reference(a)).select("rank", cigar.to_text(F.col("cigar")).alias("cigar"), "seq")


@query("a9_bases_of", f", {_REF} SELECT rank, substr(bases, pos + 1, 25) AS bases FROM aln JOIN r USING (refid)")
def _(a: DataFrame) -> DataFrame:
    asked = a.where("refid >= 0").select("rank", F.col("refid").cast("string").alias("name"), "pos", F.lit(25).alias("len"))
    ref = _reference(a).select(F.col("refid").cast("string").alias("name"), "seq")
    found = R.bases_of(asked.select("name", "pos", "len").distinct(), ref, 64)
    return asked.join(found, ["name", "pos", "len"]).select("rank", F.col("seq").alias("bases"))


#: An adapter that a third of the reads run into, at a place that goes by rank.
_ADAPTER = "AGATCGGAAGAGCACACGTC"


@query("c22_list_adapters", f"SELECT rank, CASE WHEN rank % 3 = 0 THEN CAST(32 - rank % 13 AS VARCHAR) END AS cut, CASE WHEN rank % 3 = 0 THEN 'p' END AS name, CASE WHEN rank % 3 = 0 THEN CAST(1.0 AS VARCHAR) END AS share FROM aln")
def _(a: DataFrame) -> DataFrame:
    at = (F.col("rank") % 13).cast("int")
    read = F.when(F.col("rank") % 3 == 0, F.substring(F.concat(F.substring("seq", F.lit(1), at), F.lit(_ADAPTER), F.repeat(F.lit("T"), F.lit(20))), 1, 32)).otherwise(F.repeat(F.lit("C"), F.lit(32)))
    rows = a.withColumn("seq", F.when(F.col("flag").bitwiseAND(16) != 0, F.translate(F.reverse(read), "ACGT", "TGCA")).otherwise(read))
    adapters = a.sparkSession.createDataFrame([("p", _ADAPTER), ("q", "GGTTGGTTGGTTAACCGGTTGG")], "name string, seq string")
    t = F.col("aux")
    found = K.list_adapters(rows.withColumn("aux", aux.drop(t, ["as"])), adapters)
    return found.select("rank", aux.value(t, "as").alias("cut"), aux.value(t, "aa").alias("name"), aux.value(t, "af").alias("share"))


@query("d18_best_chain")
def _(a: DataFrame) -> DataFrame:
    return K.best_mappings(a, "chain").select("rank", "flag", "mate_refid", "mate_pos")


@query("d18_best_cluster")
def _(a: DataFrame) -> DataFrame:
    return K.best_mappings(a, "cluster").select("rank", "flag", "mate_refid", "mate_pos")


@query("f7_depth_peaks")
def _(a: DataFrame) -> DataFrame:
    return K.depth_peaks(A.depth(A.aligned_blocks(a)))


@query("f10_checksum_products")
def _(a: DataFrame) -> DataFrame:
    return S.checksum_products(a)


@query("f10_checksum_sums")
def _(a: DataFrame) -> DataFrame:
    return S.checksum_sums(a)


_TURNED = "CASE WHEN flag & 16 <> 0 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END"
#: Sums of the digests of flags and bases in words of 32 bits, from the last; then the carries.
_MD5_SUMS = f"""d AS (SELECT substr(aux, 6, 3) AS rg, flag & 512 = 0 AS ok, md5(CAST(flag & 193 AS VARCHAR) || chr(0) || {_TURNED}) AS h FROM aln WHERE flag & 2304 = 0),
g AS (SELECT rg, false AS pass_only, h FROM d UNION ALL SELECT rg, true, h FROM d WHERE ok UNION ALL SELECT NULL, false, h FROM d UNION ALL SELECT NULL, true, h FROM d WHERE ok),
s AS (SELECT rg, pass_only, count(*) AS n, sum(('0x' || substr(h, 25, 8))::BIGINT) AS w0, sum(('0x' || substr(h, 17, 8))::BIGINT) AS w1, sum(('0x' || substr(h, 9, 8))::BIGINT) AS w2, sum(('0x' || substr(h, 1, 8))::BIGINT) AS w3 FROM g GROUP BY rg, pass_only),
c1 AS (SELECT *, w1 + w0 // 4294967296 AS v1 FROM s), c2 AS (SELECT *, w2 + v1 // 4294967296 AS v2 FROM c1), c3 AS (SELECT *, w3 + v2 // 4294967296 AS v3 FROM c2)"""
_WORD = "printf('%08x', CAST({} % 4294967296 AS BIGINT))"


@query("f10_checksums_md5", f", {_MD5_SUMS} SELECT rg, pass_only, n, {_WORD.format('v3')} || {_WORD.format('v2')} || {_WORD.format('v1')} || {_WORD.format('w0')} AS b_seq FROM c3")
def _(a: DataFrame) -> DataFrame:
    return S.checksums(a, "md5").select("rg", "pass_only", "n", "b_seq")


@query("f10_checksums_sha512primesums")
def _(a: DataFrame) -> DataFrame:
    return S.checksums(a, "sha512primesums")


@query("f10_checksums_crc32prime64")
def _(a: DataFrame) -> DataFrame:
    return S.checksums(a, "crc32prime64")


@query("f10_checksums_murmur3")
def _(a: DataFrame) -> DataFrame:
    return S.checksums(a, "murmur3")


@query("f11_near_collisions")
def _(a: DataFrame) -> DataFrame:
    return S.near_collisions(S.read_digests(a))


@query("f11_bit_bias")
def _(a: DataFrame) -> DataFrame:
    return S.bit_bias(S.read_digests(a))


@query("f18_covered_bases", f"SELECT qname, count(DISTINCT p) AS covered FROM (SELECT qname, unnest(range(f, f + n)) AS p FROM (SELECT qname, CASE cigar WHEN '4S20M2D8M' THEN (CASE WHEN flag & 16 <> 0 THEN 0 ELSE 4 END) WHEN '2H3S24M5S' THEN 5 ELSE 0 END AS f, CASE cigar WHEN '4S20M2D8M' THEN 28 WHEN '2H3S24M5S' THEN 24 ELSE 32 END AS n FROM aln WHERE flag & 4 = 0) x) y GROUP BY qname")
def _(a: DataFrame) -> DataFrame:
    return K.covered_bases(a)


@query("c20_from_fastq", "SELECT rank, qname, CASE WHEN rank % 2 = 0 THEN 77 ELSE 141 END AS flag, replace(seq, 'A', 'N') AS seq FROM aln")
def _(a: DataFrame) -> DataFrame:
    mate = F.when(F.col("rank") % 2 == 0, "/1").otherwise("/2")
    records = a.select(F.col("rank").alias("place"), F.concat("qname", mate, F.lit(" note")).alias("name"), F.lower(F.translate("seq", "A", ".")).alias("seq"), "qual")
    return Q.to_alignments(records).select("rank", "qname", "flag", "seq")


@table_query("a6_read_fastq", f", {_MAIN} SELECT qname || CASE num WHEN 0 THEN '' WHEN 1 THEN '/1' ELSE '/2' END AS name, CASE WHEN flag & 16 <> 0 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END AS seq, '@' || CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual FROM main")
def _(spark, sf_dir) -> DataFrame:
    """Writes all reads as FASTQ, with a quality line that begins with '@', and reads the files."""
    path = scratch(spark)
    record = F.regexp_replace("record", "\n([^\n]*)$", "\n@$1")
    Q.from_alignments(fixture.alignments(spark, sf_dir)).select(record.alias("value")).write.text(path)
    return Q.read_fastq(spark, path).select("name", "seq", "qual")


@query("b5_to_fastq", f", {_MAIN} SELECT rank, {_CLASS} AS class, substr(aux, 6, 3) AS rg, '@' || qname || CASE num WHEN 0 THEN '' WHEN 1 THEN '/1' ELSE '/2' END || chr(10) || CASE WHEN flag & 16 <> 0 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END || chr(10) || '+' || chr(10) || CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS record FROM main")
def _(a: DataFrame) -> DataFrame:
    return Q.from_alignments(a).select("rank", "class", "rg", "record")


@query("b12_normalised_fasta", "SELECT rank AS place, '>' || qname || chr(10) || substr(seq, 1, 20) || chr(10) || substr(seq, 21) AS record FROM aln")
def _(a: DataFrame) -> DataFrame:
    records = a.select(F.col("rank").alias("place"), F.col("qname").alias("id"), F.lit("").alias("descr"), "seq")
    return Q.normalised_fasta(records, 20).select("place", "record")


@table_query("b1_sam_lines", "SELECT rank, qname || chr(9) || CAST(flag AS VARCHAR) || chr(9) || coalesce(s.name, '*') || chr(9) || CAST(pos + 1 AS VARCHAR) || chr(9) || CAST(mapq AS VARCHAR) || chr(9) || cigar || chr(9) || CASE WHEN m.name IS NULL THEN '*' WHEN m.name = s.name THEN '=' ELSE m.name END || chr(9) || CAST(mate_pos + 1 AS VARCHAR) || chr(9) || CAST(tlen AS VARCHAR) || chr(9) || seq || chr(9) || qual || chr(9) || replace(aux, '|', chr(9)) AS \"value\" FROM aln LEFT JOIN sq s ON aln.refid = s.refid LEFT JOIN sq m ON aln.mate_refid = m.refid")
def _(spark, sf_dir) -> DataFrame:
    return sam.to_lines(fixture.alignments(spark, sf_dir), fixture.references(spark, sf_dir))


@table_query("a1_sam_round_trip", "SELECT rank, flag, refid, pos, cigar, aux FROM aln")
def _(spark, sf_dir) -> DataFrame:
    a, sq = fixture.alignments(spark, sf_dir), fixture.references(spark, sf_dir)
    lines = sam.to_lines(a, sq)
    back = sam._with_rank(lines, sq)
    return back.select("rank", "flag", "refid", "pos", cigar.to_text(F.col("cigar")).alias("cigar"), tags_text())


@table_query("a12_valid_lines", f"SELECT count(*) AS n FROM aln LEFT JOIN sq USING (refid) WHERE flag & 4 <> 0 OR pos + {_REFLEN} <= 900")
def _(spark, sf_dir) -> DataFrame:
    a, sq = fixture.alignments(spark, sf_dir), fixture.references(spark, sf_dir)
    return sam.valid_lines(sam.to_lines(a, sq), sq.withColumn("length", F.lit(900))).agg(F.count("*").alias("n"))
