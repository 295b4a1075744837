"""Queries of row transforms and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import aux, cigar, flags, names, sequences
from readloom.operators import filters as D
from readloom.operators import transforms as C
from readloom.plans import fixture
from readloom.plans.registry import query, table_query



def tags_text() -> Column:
    return aux.to_text(F.col("aux")).alias("aux")


def cigar_text() -> Column:
    return cigar.to_text(F.col("cigar")).alias("cigar")


_REVCOMP = "translate(reverse(seq), 'ACGT', 'TGCA')"
_LIST = "string_split(aux, '|')"
_REFLEN = "CASE cigar WHEN '*' THEN 0 WHEN '4S20M2D8M' THEN 30 WHEN '10M3I19M' THEN 29 WHEN '12M5N20M' THEN 37 WHEN '2H3S24M5S' THEN 24 ELSE 32 END"
_KEPT_FLAG = "(flag & 3009) | 4 | (CASE WHEN flag & 1 <> 0 THEN 8 ELSE 0 END)"


@query("c1_mask_flags", "SELECT rank, CASE WHEN aux LIKE '%|MS:%' THEN flag & 3583 ELSE flag END AS flag, -1 AS mate_refid, -1 AS mate_pos FROM aln")
def _(a: DataFrame) -> DataFrame:
    return C.mask_flags(a, keep=0xFFFF, drop=0x200, with_any_tag=("MS",), reset_mate=True).select("rank", "flag", "mate_refid", "mate_pos")


@query("c2_reset", f"SELECT rank, qname, {_KEPT_FLAG} AS flag, -1 AS refid, -1 AS pos, 0 AS mapq, '*' AS cigar, CASE WHEN flag & 16 <> 0 THEN {_REVCOMP} ELSE seq END AS seq, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual, '' AS aux FROM aln WHERE flag & 2304 = 0")
def _(a: DataFrame) -> DataFrame:
    return C.reset(a).select("rank", "qname", "flag", "refid", "pos", "mapq", cigar_text(), "seq", "qual", tags_text())


@query("c3_filter_tags", f"SELECT rank, array_to_string(list_filter({_LIST}, lambda x: x[1:2] IN ('RG', 'MC')), '|') AS kept, array_to_string(list_filter({_LIST}, lambda x: x[1:2] NOT IN ('NM', 'AB')), '|') AS rest FROM aln")
def _(a: DataFrame) -> DataFrame:
    rest = C.filter_tags(a.withColumn("all", F.col("aux")), remove=("NM", "AB")).withColumn("rest", aux.to_text(F.col("aux")))
    return C.filter_tags(rest.withColumn("aux", F.col("all")), keep=("RG", "MC")).select("rank", aux.to_text(F.col("aux")).alias("kept"), "rest")


@query("c4_sort_tags", f"SELECT rank, array_to_string(list_sort({_LIST}), '|') AS aux FROM aln")
def _(a: DataFrame) -> DataFrame:
    return C.sort_tags(a).select("rank", tags_text())


@query("c5_drop_mate_cigar", f"SELECT rank, CASE WHEN flag & 8 <> 0 THEN array_to_string(list_filter({_LIST}, lambda x: x[1:2] <> 'MC'), '|') ELSE aux END AS aux FROM aln")
def _(a: DataFrame) -> DataFrame:
    return C.drop_mate_cigar_of_unmapped(a).select("rank", tags_text())


@query("c6_rank_to_tag", "SELECT rank, aux || '|zz:B:C,0,0,0,0,0,' || CAST(rank // 65536 AS VARCHAR) || ',' || CAST(rank // 256 % 256 AS VARCHAR) || ',' || CAST(rank % 256 AS VARCHAR) AS aux FROM aln")
def _(a: DataFrame) -> DataFrame:
    return C.rank_to_tag(a).select("rank", tags_text())


@query("c7_rank_to_name", "SELECT rank, CAST(rank AS VARCHAR) || '_' || qname AS qname, aux FROM aln")
def _(a: DataFrame) -> DataFrame:
    return C.rank_to_name(C.rank_to_tag(a)).select("rank", "qname", tags_text())


_PREFIX = "CAST(rank AS VARCHAR) || '_0' || CAST(rank + 1 AS VARCHAR) || '_' || qname"


@query("c8_split_pair_name", f"SELECT rank, CASE WHEN (flag & 64 <> 0) <> (flag & 128 <> 0) THEN CAST(CASE WHEN flag & 64 <> 0 THEN rank ELSE rank + 1 END AS VARCHAR) || '_' || qname ELSE {_PREFIX} END AS qname FROM aln")
def _(a: DataFrame) -> DataFrame:
    return C.split_pair_name(a.withColumn("qname", F.concat(F.col("rank"), F.lit("_0"), F.col("rank") + 1, F.lit("_"), "qname"))).select("rank", "qname")


@query("c9_strip_name_rank", "SELECT rank, qname FROM aln")
def _(a: DataFrame) -> DataFrame:
    return C.strip_name_rank(a.withColumn("qname", F.concat_ws("_", F.col("rank").cast("string"), "qname"))).select("rank", "qname")


@query("c10_clip_adapters")
def _(a: DataFrame) -> DataFrame:
    return C.clip_adapters(a).select("rank", "pos", cigar_text(), "seq", "qual", tags_text())


@query("c11_reinsert_clips")
def _(a: DataFrame) -> DataFrame:
    return C.reinsert_clips(C.clip_adapters(a)).select("rank", "pos", cigar_text(), "seq", "qual", tags_text())


_CLIPS = "SELECT rank, qname || '_front' AS qname, flag | 4 AS flag, -1 AS refid, '*' AS cigar, substr(seq, 1, 4) AS seq FROM aln WHERE cigar = '4S20M2D8M' UNION ALL SELECT rank, qname || '_back', flag | 4, -1, '*', right(seq, 5) FROM aln WHERE cigar = '2H3S24M5S' UNION ALL SELECT rank, qname, flag, refid, '*', seq FROM aln WHERE flag & 4 <> 0"


@query("c12_extract_clips", _CLIPS)
def _(a: DataFrame) -> DataFrame:
    return C.extract_clips(a, least=4).select("rank", "qname", "flag", "refid", cigar_text(), "seq")


_TURNED = f"(SELECT *, CASE WHEN flag & 16 <> 0 THEN {_REVCOMP} ELSE seq END AS s FROM aln WHERE flag & 2304 = 0) x"


@query("c13_front_and_back", f"SELECT rank, qname || '_front' AS qname, left(s, 20) AS seq FROM {_TURNED} UNION ALL SELECT rank, qname || '_back', right(s, 20) FROM {_TURNED}")
def _(a: DataFrame) -> DataFrame:
    return C.front_and_back(a).select("rank", "qname", "seq")


_NEW = "CASE WHEN len(list_filter({l}, lambda x: x LIKE '{old}:i:%')) > 0 THEN list_concat(list_filter({l}, lambda x: x NOT LIKE '{old}:i:%'), list_transform(list_filter({l}, lambda x: x LIKE '{old}:i:%'), lambda x: '{new}' || x[3:])) ELSE {l} END"


@query("c14_convert_tags", f"SELECT rank, array_to_string({_NEW.format(l='t', old='MC', new='mc')}, '|') AS aux FROM (SELECT rank, {_NEW.format(l=_LIST, old='MS', new='ms')} AS t FROM aln) x")
def _(a: DataFrame) -> DataFrame:
    return C.convert_tags(a).select("rank", tags_text())


@query("c15_tag_reference_interval", f"SELECT rank, CASE WHEN flag & 4 = 0 THEN aux || '|re:Z:[' || CAST(pos AS VARCHAR) || ',' || CAST(pos + {_REFLEN} AS VARCHAR) || ')' ELSE aux END AS aux FROM aln")
def _(a: DataFrame) -> DataFrame:
    return C.tag_reference_interval(a).select("rank", tags_text())


@query("c16_random_tag", "SELECT rank, aux || '|XX:A:' || CASE WHEN md5('0:' || CAST(rank AS VARCHAR)) < '8' THEN 'A' ELSE 'C' END AS aux FROM aln")
def _(a: DataFrame) -> DataFrame:
    return C.random_tag(a).select("rank", tags_text())


@query("c24_replace_read_groups", "SELECT rank, replace(replace(aux, 'RG:Z:rg0', 'RG:Z:lane0'), 'RG:Z:rg1', 'RG:Z:lane1') AS aux FROM aln")
def _(a: DataFrame) -> DataFrame:
    table = a.sparkSession.sql("SELECT * FROM VALUES ('rg0', 'lane0'), ('rg1', 'lane1') AS t(old, new)")
    return C.replace_read_groups(a, table).select("rank", tags_text())


@query("d1_by_mapping", "SELECT rank FROM aln WHERE (CASE WHEN flag & 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN flag & 8 = 0 THEN 1 ELSE 0 END) + (CASE WHEN flag & 2 <> 0 THEN 1 ELSE 0 END) BETWEEN 1 AND 2")
def _(a: DataFrame) -> DataFrame:
    return D.by_mapping(a, 1, 2, 30).select("rank")


@query("d2_without_flags", "SELECT rank, flag FROM aln WHERE flag & 772 = 0")
def _(a: DataFrame) -> DataFrame:
    return D.without_flags(a, "SECONDARY,UNMAP,QCFAIL").select("rank", "flag")


@query("d3_by_reference_length", f"SELECT rank FROM aln WHERE {_REFLEN} >= 30")
def _(a: DataFrame) -> DataFrame:
    return D.by_reference_length(a, 30).select("rank")


@table_query("d4_by_names", "SELECT rank, qname FROM aln WHERE qname IN (SELECT 'r' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0)")
def _(spark, sf_dir) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 = 0").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("qname"))
    return D.by_names(fixture.alignments(spark, sf_dir), wanted).select("rank", "qname")


@table_query("d5_by_references", "SELECT rank, refid FROM aln JOIN sq USING (refid) WHERE name IN ('chr1', 'chr3')")
def _(spark, sf_dir) -> DataFrame:
    wanted = spark.sql("SELECT * FROM VALUES ('chr1'), ('chr3') AS t(name)")
    return D.by_references(fixture.alignments(spark, sf_dir), fixture.references(spark, sf_dir), wanted).select("rank", "refid")


@query("d6_by_read_groups", "SELECT rank FROM aln WHERE aux LIKE 'RG:Z:rg0%' OR aux LIKE 'RG:Z:rg2%'")
def _(a: DataFrame) -> DataFrame:
    return D.by_read_groups(a, ("rg0", "rg2")).select("rank")


_USED = "u AS (SELECT refid, row_number() OVER (ORDER BY refid) - 1 AS n FROM sq WHERE refid IN (SELECT refid FROM aln WHERE flag & 4 = 0) OR refid IN (SELECT mate_refid FROM aln WHERE flag & 1 <> 0 AND {mate}))"
_HEAD = "SELECT rank, CAST(CASE WHEN flag & 4 = 0 THEN coalesce(a.n, -1) ELSE -1 END AS INT) AS refid, CAST(CASE WHEN flag & 1 <> 0 AND {mate} THEN coalesce(b.n, -1) ELSE -1 END AS INT) AS mate_refid FROM aln LEFT JOIN u a ON aln.refid = a.refid LEFT JOIN u b ON aln.mate_refid = b.refid"


def _header(mate: str) -> str:
    return ", " + _USED.format(mate=mate) + " " + _HEAD.format(mate=mate)


@table_query("d7_used_header", _header("flag & 8 = 0"))
def _(spark, sf_dir) -> DataFrame:
    return D.used_header(fixture.alignments(spark, sf_dir), fixture.references(spark, sf_dir))[0].select("rank", "refid", "mate_refid")


@table_query("d8_used_header_of_mapped", _header("flag & 4 = 0"))
def _(spark, sf_dir) -> DataFrame:
    return D.used_header(fixture.alignments(spark, sf_dir), fixture.references(spark, sf_dir), mate_of_mapped_only=True)[0].select("rank", "refid", "mate_refid")


_SAMPLED = f"CAST('0x' || substr(md5('7:' || qname), 1, 8) AS BIGINT) <= {int(0.3 * (2**32 - 1) + 0.5)}"


@query("d9_downsample", f"SELECT rank, qname FROM aln WHERE flag & 256 = 0 AND {_SAMPLED}")
def _(a: DataFrame) -> DataFrame:
    return D.downsample(a, 0.3, 7, "SECONDARY").select("rank", "qname")


@query("d10_downsample_all", f"SELECT rank, qname FROM aln WHERE {_SAMPLED}")
def _(a: DataFrame) -> DataFrame:
    return D.downsample(a, 0.3, 7).select("rank", "qname")


@query("d10_downsample_by_murmur")
def _(a: DataFrame) -> DataFrame:
    return D.downsample_by_murmur(a, 0.3, 7).select("rank", "qname")


@query("d12_by_pair_mapq", "SELECT rank FROM (SELECT rank, max(CASE WHEN flag & 4 = 0 THEN mapq END) OVER (PARTITION BY qname) AS best FROM aln) x WHERE best >= 55")
def _(a: DataFrame) -> DataFrame:
    return D.by_pair_mapq(a, 55).select("rank")


@query("d13_by_pair_read_group", "SELECT rank FROM (SELECT rank, min(CASE WHEN aux LIKE 'RG:Z:rg1%' OR aux LIKE 'RG:Z:rg2%' THEN 1 ELSE 0 END) OVER (PARTITION BY qname) AS k FROM aln) x WHERE k = 1")
def _(a: DataFrame) -> DataFrame:
    return D.by_pair_read_group(a, ("rg1", "rg2")).select("rank")


@query("d14_by_name_pattern", "SELECT rank, qname FROM aln WHERE regexp_matches(qname, '^r[0-9]*7$')")
def _(a: DataFrame) -> DataFrame:
    return D.by_name_pattern(a, "^r[0-9]*7$").select("rank", "qname")


@table_query("d16_violations", "SELECT rank, 'position' AS rule FROM aln JOIN sq USING (refid) WHERE pos >= 900 AND refid < 3 UNION ALL SELECT rank, 'reference' FROM aln WHERE refid = 3")
def _(spark, sf_dir) -> DataFrame:
    sq = fixture.references(spark, sf_dir).where("refid < 3").withColumn("length", F.lit(900))
    return D.violations(fixture.alignments(spark, sf_dir), sq)


@query("d17_order_breaks", "SELECT rank FROM (SELECT rank, CASE WHEN refid < 0 THEN 4294967296 ELSE refid END AS r, CASE WHEN pos < 0 THEN 4294967296 ELSE pos END AS p, lag(CASE WHEN refid < 0 THEN 4294967296 ELSE refid END) OVER (ORDER BY rank) AS lr, lag(CASE WHEN pos < 0 THEN 4294967296 ELSE pos END) OVER (ORDER BY rank) AS lp FROM aln) x WHERE r < lr OR (r = lr AND p < lp)")
def _(a: DataFrame) -> DataFrame:
    return D.order_breaks(a, "coordinate", blocks=512)


@query("j3_cigar_lengths", f"SELECT rank, {_REFLEN} AS reference, CASE cigar WHEN '*' THEN 0 ELSE 32 END AS query, CASE cigar WHEN '4S20M2D8M' THEN 4 WHEN '2H3S24M5S' THEN 5 ELSE 0 END AS front, CASE cigar WHEN '2H3S24M5S' THEN 5 ELSE 0 END AS back FROM aln")
def _(a: DataFrame) -> DataFrame:
    c = F.col("cigar")
    return a.select("rank", cigar.reference_length(c).alias("reference"), cigar.query_length(c).alias("query"), cigar.front_clip(c).alias("front"), cigar.back_clip(c).alias("back"))


@query("j4_unclipped_coordinate", f"SELECT rank, CASE WHEN flag & 16 <> 0 THEN pos + {_REFLEN} - 1 + (CASE cigar WHEN '2H3S24M5S' THEN 5 ELSE 0 END) ELSE pos - (CASE cigar WHEN '4S20M2D8M' THEN 4 WHEN '2H3S24M5S' THEN 5 ELSE 0 END) END AS five FROM aln WHERE flag & 4 = 0")
def _(a: DataFrame) -> DataFrame:
    return a.where("flag & 4 = 0").select("rank", cigar.unclipped_five_prime(F.col("cigar"), F.col("pos"), F.col("flag")).alias("five"))


@query("j6_reverse_complement", f"SELECT rank, {_REVCOMP} AS seq FROM aln")
def _(a: DataFrame) -> DataFrame:
    return a.select("rank", sequences.reverse_complement(F.col("seq")).alias("seq"))


@query("j7_natural_order", "SELECT DISTINCT qname, dense_rank() OVER (ORDER BY CAST(substr(qname, 2) AS BIGINT)) AS place FROM aln")
def _(a: DataFrame) -> DataFrame:
    from readloom.operators.orders import numbered

    unique = a.select("qname").distinct()
    bucket = F.floor(F.substring("qname", 2, 30).cast("long") / 1024)
    return numbered(unique, [names.natural_key(F.col("qname"))], bucket, "place").select("qname", (F.col("place") + 1).alias("place"))


@query("j8_rank_in_name", "SELECT rank, rank AS found FROM aln")
def _(a: DataFrame) -> DataFrame:
    return a.select("rank", names.rank_in_name(F.concat_ws("_", F.col("rank").cast("string"), "qname")).alias("found"))


@query("j9_kmer_poisson", "SELECT rank, round(pow(m, 2) / 2 * exp(-m), 9) AS p FROM (SELECT rank, (24 - mapq % 5 - mapq % 3) * pow(0.25, mapq % 5) * pow(0.3, mapq % 3) AS m FROM aln) x")
def _(a: DataFrame) -> DataFrame:
    counts = {"A": F.col("mapq") % 5, "C": F.col("mapq") % 3, "G": F.lit(0), "T": F.lit(0)}
    return a.select("rank", F.round(sequences.kmer_poisson(F.lit(23), counts, F.lit(2), {"A": 0.25, "C": 0.3, "G": 0.25, "T": 0.2}), 9).alias("p"))


@query("j19_simple_pair", "SELECT rank FROM aln WHERE flag & 12 = 0 AND refid = mate_refid AND (flag & 16 <> 0) <> (flag & 32 <> 0) AND CASE WHEN flag & 32 <> 0 THEN pos < mate_pos ELSE mate_pos < pos END")
def _(a: DataFrame) -> DataFrame:
    return a.where(flags.simple_pair()).select("rank")


@query("j11_digests", "SELECT rank, md5(seq) AS md5, sha1(seq) AS sha1, sha256(seq) AS sha256 FROM aln")
def _(a: DataFrame) -> DataFrame:
    return a.select("rank", F.md5("seq").alias("md5"), F.sha1("seq").alias("sha1"), F.sha2("seq", 256).alias("sha256"))
