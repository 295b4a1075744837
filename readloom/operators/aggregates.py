"""Counts, histograms, depth and pileup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom import model as m
from readloom.functions import aux, cigar, flags

count_if = lambda c: F.count(F.when(c, 1))


def pair_distribution(df: DataFrame) -> DataFrame:
    """kind, refid, mate_refid, n, n_mapq5, n_proper: pairs by reference, counted on primary read 1; single reads likewise.

    kinds: pair, first_only (mate unmapped), second_only, unmapped_pair, single, unmapped_single,
    skipped (mapped without a reference, or so its mate).
    """
    paired, own, mate = flags.has(m.PAIRED), flags.mapped(), flags.lacks(m.MATE_UNMAPPED)
    skipped = (own & (F.col("refid") < 0)) | (paired & mate & (F.col("mate_refid") < 0))
    counted = flags.primary() & (~paired | flags.has(m.READ1))
    kind = (
        F.when(skipped, "skipped")
        .when(~paired, F.when(own, "single").otherwise("unmapped_single"))
        .when(own & mate, "pair").when(own, "first_only").when(mate, "second_only").otherwise("unmapped_pair")
    )
    rows = df.where(skipped | counted).withColumn("kind", kind)
    one = F.when(F.col("kind").isin("pair", "first_only", "single"), F.col("refid")).otherwise(-1)
    two = F.when(F.col("kind").isin("pair", "second_only"), F.col("mate_refid")).otherwise(-1)
    is_pair = F.col("kind") == "pair"
    return rows.groupBy("kind", one.alias("refid"), two.alias("mate_refid")).agg(F.count("*").alias("n"), count_if(is_pair & (F.col("mapq") >= 5)).alias("n_mapq5"), count_if(is_pair & flags.has(m.PROPER)).alias("n_proper"))


def split_shares(distribution: DataFrame) -> DataFrame:
    """refid, n_split, share: split pairs (ends on different references) by reference of the first end, and their share of all split pairs. A header's worth of rows."""
    split = distribution.where((F.col("kind") == "pair") & (F.col("refid") != F.col("mate_refid"))).groupBy("refid").agg(F.sum("n").alias("n_split"))
    return split.withColumn("share", F.col("n_split") / F.sum("n_split").over(Window.partitionBy()))


def aligned_bases(df: DataFrame) -> DataFrame:
    """total, clipped and aligned bases of mapped rows."""
    c = F.col("cigar")
    total = F.sum((F.length("seq") + cigar.consumed(c, "H")).cast("long"))
    zero = lambda x, name: F.coalesce(x, F.lit(0).cast("long")).alias(name)
    return df.where(flags.mapped()).agg(zero(total, "total"), zero(F.sum(cigar.consumed(c, "SH").cast("long")), "clipped"), zero(F.sum(cigar.consumed(c, "MI=X").cast("long")), "aligned"))


def scrap_counts(df: DataFrame) -> DataFrame:
    """scrap (the character of tag sc, null for other rows), entries, bases."""
    return df.groupBy(aux.value(F.col("aux"), "sc", "A").alias("scrap")).agg(F.count("*").alias("entries"), F.sum(F.length("seq").cast("long")).alias("bases"))


def distance_histograms(pairs: DataFrame) -> DataFrame:
    """histogram, value, n: of rank distance, |tlen| and |tlen| of proper pairs, over pairs of two mapped ends (pairs.mated)."""
    rows = pairs.where((F.col("kind") == "pair") & flags.lacks(m.UNMAPPED, F.col("a.flag")) & flags.lacks(m.UNMAPPED, F.col("b.flag")))
    tlen = F.abs(F.col("a.tlen")).cast("long")
    values = F.filter(
        F.array(
            F.struct(F.lit("rank").alias("histogram"), F.abs(F.col("a.rank") - F.col("b.rank")).alias("value")),
            F.struct(F.lit("tlen").alias("histogram"), tlen.alias("value")),
            F.struct(F.lit("tlen_proper").alias("histogram"), F.when(flags.has(m.PROPER, F.col("a.flag")), tlen).alias("value")),
        ),
        lambda x: x["value"].isNotNull(),
    )
    return rows.select(F.inline(values)).groupBy("histogram", "value").agg(F.count("*").alias("n"))


def aligned_blocks(df: DataFrame) -> DataFrame:
    """refid, start, end of each stretch of M, = or X of mapped rows."""
    init = F.struct(F.col("pos").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("blocks"))

    def step(acc: Column, c: Column) -> Column:
        end = acc["at"] + F.when(c["op"].isin("M", "=", "X", "D", "N"), c["len"]).otherwise(0)
        block = F.when(c["op"].isin("M", "=", "X"), F.array(F.struct(acc["at"].alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(acc["blocks"], block).alias("blocks"))

    # skips in front of the first base don't move the start
    lead = F.aggregate("cigar", F.array().cast(m.CIGAR), lambda acc, c: F.when((F.size(acc) == 0) & c["op"].isin("D", "N", "P", "H"), acc).otherwise(F.concat(acc, F.array(c))))
    rows = df.where(flags.mapped() & (F.col("refid") >= 0))
    return rows.select("refid", F.inline(F.aggregate(lead, init, step, lambda acc: acc["blocks"])))


#: Reference positions of one task's share of a depth sweep.
TILE = 1 << 16


def depth(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """refid, pos, depth of each position that blocks (refid, start, end) cover.

    Blocks are cut at tile borders, so a deep or long reference is dealt out over many tasks, and
    within a tile only starts and ends are summed, not positions.
    """
    last = F.floor((F.col("end") - 1) / tile)
    cut = blocks.where("start < end").withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile), last)))
    cut = cut.select("refid", "tile", F.greatest("start", F.col("tile") * tile).cast("int").alias("start"), F.least("end", (F.col("tile") + 1) * tile).cast("int").alias("end"))
    events = cut.select("refid", "tile", F.inline(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).cast("long").alias("d")))))
    steps = events.groupBy("refid", "tile", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("refid", "tile").orderBy("pos")
    runs = steps.select("refid", "pos", F.sum("d").over(w).alias("depth"), F.lead("pos").over(w).alias("next"))
    return runs.where("depth > 0 and next is not null").select("refid", F.explode(F.sequence(F.col("pos"), F.col("next") - 1)).alias("pos"), "depth")


def span_depth_histogram(df: DataFrame) -> DataFrame:
    """depth, n: positions by how many reads with two mapped ends span them, gaps included."""
    rows = df.where(flags.mapped() & flags.lacks(m.MATE_UNMAPPED) & (F.col("refid") >= 0))
    spans = rows.select("refid", F.greatest("pos", F.lit(0)).alias("start"), (F.col("pos") + cigar.reference_length(F.col("cigar"))).alias("end"))
    return depth(spans).groupBy("depth").agg(F.count("*").alias("n"))


def quality_histogram(df: DataFrame, descending: bool = False, offset: int = 33) -> DataFrame:
    """quality, char, n, share, cumulative share (from the lowest quality on, or the highest). At most 94 rows are ordered."""
    chars = df.where(F.col("qual") != "*").select(F.explode(F.filter(F.split("qual", ""), lambda c: c != "")).alias("char")).groupBy("char").agg(F.count("*").alias("n"))
    rows = chars.withColumn("quality", F.ascii("char") - offset)
    total = F.sum("n").over(Window.partitionBy())
    order = Window.orderBy(F.col("quality").desc() if descending else F.col("quality"))
    return rows.select("quality", "char", "n", (F.col("n") / total).alias("share"), (F.sum("n").over(order) / total).alias("cumulative"))


def class_counts(classes: DataFrame) -> DataFrame:
    """class, n of pairs.classified rows."""
    return classes.groupBy("class").agg(F.count("*").alias("n"))


def comment_pairs(df: DataFrame) -> DataFrame:
    """name1, name2, n, reads: interval names (tag CO, 'a;b') that meet between read 1 and read 2 of a template.

    Each unordered pair counts once for each pair of rows; reads: the template names, sorted. Names of
    rows are paired within the rows, the counts of templates are added up, and reads are joined in
    pieces of one prefix, so that a pair of names is held as a few texts instead of a list of reads.
    """
    names_of = F.filter(F.split(aux.value(F.col("aux"), "CO"), ";"), lambda x: x != "")
    number = flags.read_number()
    side = lambda n, c: df.where(number == n).select("qname", F.array_distinct(names_of).alias(c)).where(F.size(c) > 0)
    both = F.flatten(F.transform("x", lambda x: F.transform(F.col("y"), lambda y: F.struct(F.least(x, y).alias("name1"), F.greatest(x, y).alias("name2")))))
    met = side(1, "x").join(side(2, "y"), "qname").select("qname", F.inline(F.array_distinct(both)))
    per = met.groupBy("name1", "name2", "qname").agg(F.count("*").alias("n"))
    prefix = F.substring("qname", 1, 6)
    pieces = per.groupBy("name1", "name2", prefix.alias("prefix")).agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list("qname")), ",").alias("reads"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "reads"))), lambda p: p["reads"]), ",")
    return pieces.groupBy("name1", "name2").agg(F.sum("n").alias("n"), joined.alias("reads"))


def pileup(df: DataFrame) -> DataFrame:
    """refid, pos, column, base, quality per base of mapped rows without QC failure.

    column 0 is the position itself (a deletion gives '*'); inserted bases stand before the position
    in columns -k to -1.
    """
    rows = df.where(flags.mapped() & flags.lacks(m.QCFAIL) & (F.col("refid") >= 0))
    kind = "array<struct<op:string,len:int,at:int,read:int>>"
    init = F.struct(F.col("pos").alias("at"), F.lit(1).alias("read"), F.array().cast(kind).alias("blocks"))

    def step(acc: Column, c: Column) -> Column:
        block = F.array(F.struct(c["op"].alias("op"), c["len"].alias("len"), acc["at"].alias("at"), acc["read"].alias("read")))
        return F.struct(
            (acc["at"] + F.when(c["op"].isin(*cigar.REFERENCE_OPS), c["len"]).otherwise(0)).alias("at"),
            (acc["read"] + F.when(c["op"].isin(*cigar.QUERY_OPS), c["len"]).otherwise(0)).alias("read"),
            F.when(c["op"].isin("M", "=", "X", "D", "I") & (c["len"] > 0), F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"),
        )

    # a row for each operation, then for each of its bases: plain generators, which are compiled
    blocks = rows.select("refid", "seq", "qual", F.inline(F.aggregate("cigar", init, step, lambda acc: acc["blocks"])))
    cells = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i"))
    inserted, gone = F.col("op") == "I", F.col("op") == "D"
    read = F.col("read") + F.col("i")
    base = F.when(gone, "*").otherwise(F.upper(F.col("seq").substr(read, F.lit(1))))
    quality = F.when(gone, F.lit(None)).otherwise(F.ascii(F.col("qual").substr(read, F.lit(1))) - 33)
    pos, column = F.col("at") + F.when(inserted, 0).otherwise(F.col("i")), F.when(inserted, F.col("i") - F.col("len")).otherwise(0)
    return cells.select("refid", pos.alias("pos"), column.alias("column"), base.alias("base"), quality.alias("quality"))


def consensus(cells: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """refid, pos, column, bases (sorted), depth, consensus: the symbol of most weight, N on a tie. Reads without an inserted base count as '*' in insert columns.

    Symbols are summed first, so a deep position is a handful of counts; then one row a position
    holds the counts of all its columns, and the rest is worked out inside of it.
    """
    counts = cells.groupBy("refid", "pos", "column", "base").agg(F.count("*").alias("n"))
    here = counts.groupBy("refid", "pos").agg(F.collect_list(F.struct("column", "base", "n")).alias("all"), F.sum(F.when(F.col("column") == 0, F.col("n"))).alias("cover"))
    column = F.explode(F.array_distinct(F.transform("all", lambda x: x["column"])))
    cols = here.select("refid", "pos", "cover", column.alias("column"), "all")
    held = F.sort_array(F.transform(F.filter("all", lambda x: x["column"] == F.col("column")), lambda x: F.struct(x["base"].alias("base"), x["n"].alias("n"))))
    cols = cols.select("refid", "pos", "column", "cover", held.alias("held"))
    lacking = F.coalesce("cover", F.lit(0)) - F.aggregate("held", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    # '*' sorts before letters
    star = F.array(F.struct(F.lit("*").alias("base"), lacking.alias("n")))
    cols = cols.select("refid", "pos", "column", F.when((F.col("column") < 0) & (lacking > 0), F.concat(star, "held")).otherwise(F.col("held")).alias("by"))

    def weight(x: Column) -> Column:
        w = F.lit(1)
        for b, k in (weights or {}).items():
            w = F.when(x["base"] == b, F.lit(k)).otherwise(w)
        return x["n"] * w

    top = F.array_max(F.transform("by", lambda x: F.struct(weight(x).alias("weight"), x["base"].alias("base"))))
    cols = cols.withColumn("top", top)
    tie = F.size(F.filter("by", lambda x: weight(x) == F.col("top.weight"))) > 1
    bases = F.array_join(F.transform("by", lambda x: F.repeat(x["base"], x["n"].cast("int"))), "")
    depth_ = F.aggregate("by", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return cols.select("refid", "pos", "column", bases.alias("bases"), depth_.alias("depth"), F.when(tie, "N").otherwise(F.col("top.base")).alias("consensus"))


def phred_consensus(cells: DataFrame) -> DataFrame:
    """refid, pos, base: of each position the base whose qualities give most probability of being right in sum (ties to the lower letter)."""
    weight = cells.where("column = 0 and base <> '*'").groupBy("refid", "pos", "base").agg(F.sum(1 - F.pow(F.lit(10.0), -F.col("quality") / 10)).alias("w"))
    best = F.min(F.struct((-F.round("w", 6)).alias("w"), "base"))
    return weight.groupBy("refid", "pos").agg(best.alias("b")).select("refid", "pos", F.col("b.base").alias("base"))
