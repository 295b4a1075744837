"""Duplicate marking.

Keys and scores follow the public convention: ends by unclipped 5' coordinate and strand; the best
sum of base qualities of 15 and more is kept, ties by rank; a fragment whose end a pair shares loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom import model as m
from readloom.functions import aux, cigar, flags, sequences

SKIPPED = m.SECONDARY | m.SUPPLEMENTARY | m.QCFAIL
OPTICAL_PIXELS = 100


def ends(df: DataFrame, library: Column | None = None, tag: str | None = None) -> DataFrame:
    """Rows that take part, with lib, five, strand, score, mark (tag of the read)."""
    lib = library if library is not None else F.coalesce(aux.value(F.col("aux"), "RG"), F.lit(""))
    mark = F.coalesce(aux.value(F.col("aux"), aux.check_tag(tag)), F.lit("")) if tag else F.lit("")
    return df.where(flags.lacks(SKIPPED) & flags.mapped() & (F.col("refid") >= 0)).select(
        "rank", "qname", "flag", lib.alias("lib"), "refid", cigar.unclipped_five_prime(F.col("cigar"), F.col("pos"), F.col("flag")).alias("five"),
        flags.has(m.REVERSE).cast("int").alias("strand"), sequences.quality_sum(F.col("qual")).cast("long").alias("score"), mark.alias("mark"),
    )


def duplicate_ranks(df: DataFrame, library: Column | None = None, tag: str | None = None, nucleotide_tag: str | None = None) -> DataFrame:
    """rank, qname, lib, kind (pair or fragment), kept (qname that stays) of each duplicate row.

    tag: reads of different tags are never duplicates of each other; nucleotide_tag: the same with
    everything but A, C, G, T left out of the tag.

    Narrow rows go through three shuffles: by name (each end of a template with exactly one mapped
    read 1 and read 2 learns both ends), by the pair's ends, and by the fragment's end. The flags
    come out of the same rows.
    """
    if tag and nucleotide_tag:
        raise ValueError("give either tag or nucleotide_tag")
    e = ends(df, library, tag or nucleotide_tag)
    if nucleotide_tag:
        e = e.withColumn("mark", F.regexp_replace(F.upper("mark"), "[^ACGT]", ""))
    n = flags.read_number()
    by_name = Window.partitionBy("qname")
    place = F.struct("refid", "five", "strand")
    end = F.struct("refid", "five", "strand", "rank")
    one, two = F.min(F.when(n == 1, F.struct(F.lit(0).alias("o"), end.alias("e"), "mark"))).over(by_name), F.min(F.when(n == 2, F.struct(F.lit(0).alias("o"), end.alias("e"), "mark"))).over(by_name)
    counts = {"_n1": F.count(F.when(n == 1, 1)).over(by_name), "_n2": F.count(F.when(n == 2, 1)).over(by_name), "_one": one, "_two": two, "_both": F.sum(F.when(n > 0, F.col("score"))).over(by_name), "_lib": F.min(F.when(n > 0, F.col("lib"))).over(by_name)}
    t = e.withColumns(counts).withColumn("in_pair", (n > 0) & (F.col("_n1") == 1) & (F.col("_n2") == 1))
    spot = lambda c: F.struct(f"{c}.e.refid", f"{c}.e.five", f"{c}.e.strand")
    # rows that are no pair's have a key of their own
    key = F.when(F.col("in_pair"), F.struct(F.col("_lib").alias("lib"), F.concat("_one.mark", F.lit("\0"), "_two.mark").alias("mark"), F.least(spot("_one"), spot("_two")).alias("l"), F.greatest(spot("_one"), spot("_two")).alias("r"), F.lit(-1).cast("long").alias("own"))).otherwise(
        F.struct(F.lit("").alias("lib"), F.lit("").alias("mark"), place.alias("l"), place.alias("r"), F.col("rank").alias("own"))
    )
    t = t.withColumns({"_key": key, "_first": F.least("_one.e.rank", "_two.e.rank")}).select("rank", "qname", "lib", "_lib", "mark", "refid", "five", "strand", "score", "in_pair", "_key", "_first", "_both")
    by_pair = Window.partitionBy("_key").orderBy(F.col("_both").desc(), "_first")
    t = t.withColumns({"_pair_place": F.dense_rank().over(by_pair), "_pair_kept": F.first("qname").over(by_pair)})
    # one end of a pair beats all fragments there; of the fragments else the best
    by_end = Window.partitionBy("lib", "mark", "refid", "five", "strand").orderBy(F.col("in_pair").desc(), F.col("score").desc(), "rank")
    t = t.withColumns({"_place": F.row_number().over(by_end), "_kept": F.first("qname").over(by_end)})
    lost = t.where(F.when(F.col("in_pair"), F.col("_pair_place") > 1).otherwise(F.col("_place") > 1))
    pick = lambda a, b: F.when(F.col("in_pair"), a).otherwise(b)
    return lost.select("rank", "qname", pick(F.col("_lib"), F.col("lib")).alias("lib"), pick(F.lit("pair"), F.lit("fragment")).alias("kind"), pick(F.col("_pair_kept"), F.col("_kept")).alias("kept"))


def mark_duplicates(df: DataFrame, remove: bool = False, **how) -> DataFrame:
    """Sets or clears the duplicate bit of every row; remove drops duplicates instead."""
    lost = duplicate_ranks(df, **how).select("rank", F.lit(True).alias("_dup"))
    rows = df.join(lost, "rank", "left")
    clean = F.col("flag").bitwiseAND(~m.DUPLICATE)
    if remove:
        return rows.where("_dup is null").withColumn("flag", clean).select(df.columns)
    return rows.withColumn("flag", F.when(F.col("_dup"), clean.bitwiseOR(m.DUPLICATE)).otherwise(clean)).select(df.columns)


def library_metrics(df: DataFrame, marked: DataFrame, library: Column | None = None, optical: DataFrame | None = None) -> DataFrame:
    """Per library: unmapped reads, unpaired and paired reads examined, and duplicates of each; with optical (of optical_duplicates) also the optical pairs."""
    lib = library if library is not None else F.coalesce(aux.value(F.col("aux"), "RG"), F.lit(""))
    both = flags.has(m.PAIRED) & flags.mapped() & flags.lacks(m.MATE_UNMAPPED)
    n = lambda c: F.count(F.when(c, 1))
    rows = df.where(flags.lacks(SKIPPED)).groupBy(lib.alias("lib")).agg(n(flags.has(m.UNMAPPED)).alias("unmapped_reads"), n(flags.mapped() & ~both).alias("unpaired_reads"), F.floor(n(both) / 2).alias("read_pairs"))
    lost = marked.groupBy("lib").agg(n(F.col("kind") == "fragment").alias("fragment_duplicates"), F.floor(n(F.col("kind") == "pair") / 2).alias("pair_duplicates"))
    if optical is not None:
        lost = lost.join(optical.groupBy("lib").agg(F.floor(F.count("*") / 2).alias("optical_pair_duplicates")), "lib", "left")
    zero = F.lit(0).cast("long")
    return rows.join(lost, "lib", "left").withColumns({c: F.coalesce(c, zero) for c in lost.columns if c != "lib"})


def set_sizes(marked: DataFrame) -> DataFrame:
    """lib, size, n: how many sets of duplicate pairs have so many pairs, the one that stays included."""
    sets = marked.where("kind = 'pair'").groupBy("lib", "kept").agg((F.floor(F.count("*") / 2) + 1).alias("size"))
    return sets.groupBy("lib", "size").agg(F.count("*").alias("n"))


def library_sizes(metrics: DataFrame) -> DataFrame:
    """lib, pairs, unique_pairs, library_size (distinct molecules, by Lander and Waterman) of library_metrics; size null where no pair is a duplicate.

    The size L solves unique / L = 1 - exp(-pairs / L), by halving between unique and a multiple of
    it. Optical duplicates don't count as pairs.
    """
    optical = F.col("optical_pair_duplicates") if "optical_pair_duplicates" in metrics.columns else F.lit(0)
    rows = metrics.select("lib", (F.col("read_pairs") - optical).alias("pairs"), (F.col("read_pairs") - F.col("pair_duplicates")).alias("unique_pairs"))
    over = lambda x: F.col("unique_pairs") / (x * F.col("unique_pairs")) - 1 + F.exp(-F.col("pairs") / (x * F.col("unique_pairs")))
    most = F.get(F.filter(F.transform(F.sequence(F.lit(2), F.lit(15)), lambda k: F.pow(F.lit(10.0), k)), lambda x: over(x) < 0), F.lit(0))
    start = F.struct(F.lit(1.0).alias("low"), most.alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = (at["low"] + at["high"]) / 2
        return F.struct(F.when(over(middle) > 0, middle).otherwise(at["low"]).alias("low"), F.when(over(middle) > 0, at["high"]).otherwise(middle).alias("high"))

    factor = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda at: (at["low"] + at["high"]) / 2)
    return rows.withColumn("library_size", F.when((F.col("unique_pairs") > 0) & (F.col("pairs") > F.col("unique_pairs")), F.floor(F.col("unique_pairs") * factor)))


def return_histogram(sizes: DataFrame, bins: int = 100) -> DataFrame:
    """lib, bin, value of library_sizes: how many times the unique pairs of today bin times the sequencing would give."""
    size = F.col("library_size")
    value = size * (1 - F.exp(-F.col("bin") * F.col("pairs") / size)) / F.col("unique_pairs")
    return sizes.where("library_size is not null").select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).select("lib", "bin", value.alias("value"))


def optical_duplicates(df: DataFrame, pixels: int = OPTICAL_PIXELS, **how) -> DataFrame:
    """rank, lib, kept: reads of duplicate pairs whose tile is that of the pair that stays and whose x and y are within pixels of it.

    Names end in tile:x:y. Each duplicate is compared with the kept read only, so groups of any size take linear work.
    """
    place = lambda c: F.struct(F.regexp_extract(c, r"(.*):\d+:\d+$", 1).alias("tile"), F.regexp_extract(c, r":(\d+):\d+$", 1).try_cast("long").alias("x"), F.regexp_extract(c, r":(\d+)$", 1).try_cast("long").alias("y"))
    lost = duplicate_ranks(df, **how).where("kind = 'pair'")
    lost = lost.withColumns({"_a": place(F.col("qname")), "_b": place(F.col("kept"))})
    near = (F.col("_a.tile") == F.col("_b.tile")) & (F.abs(F.col("_a.x") - F.col("_b.x")) <= pixels) & (F.abs(F.col("_a.y") - F.col("_b.y")) <= pixels)
    return lost.where(near).select("rank", "lib", "kept")


def tag_optical(df: DataFrame, tag: str = "od", pixels: int = OPTICAL_PIXELS, **how) -> DataFrame:
    """Tag od, the name of the read that stays, on optical duplicates."""
    found = optical_duplicates(df, pixels, **how).select("rank", F.col("kept").alias("_od"))
    return df.join(found, "rank", "left").withColumn("aux", aux.put(F.col("aux"), aux.check_tag(tag), "Z", F.col("_od"))).select(df.columns)
