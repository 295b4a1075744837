"""Sorting, ranks, merging, partitioned layout and consecutive chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom import model as m
from readloom.functions import aux, cigar, flags, names


def sort_keys(order: str = "coordinate", tag: str | None = None) -> list[Column]:
    """Sort columns of an order; rank comes last, so the sort is stable.

    coordinate; queryname (natural order, read 1 first); queryname_HI (then tag HI); hash (of the
    name, then the name); tag (natural order of the tag, then coordinate); template (rows of a name:
    paired, primary, not supplementary and read 1 first).
    """
    where = names.coordinate_key(F.col("refid"), F.col("pos"))
    by_name = [names.natural_key(F.col("qname")), flags.has(m.READ2)]
    if order == "coordinate":
        keys = where
    elif order == "queryname":
        keys = by_name
    elif order == "queryname_HI":
        keys = [*by_name, F.coalesce(aux.value(F.col("aux"), "HI").try_cast("int"), F.lit(-1))]
    elif order == "hash":
        keys = [F.xxhash64("qname"), *by_name]
    elif order == "tag":
        keys = [names.natural_key(F.coalesce(aux.value(F.col("aux"), aux.check_tag(tag or "")), F.lit(""))), *where]
    elif order == "template":  # paired, primary, not supplementary, read 1 first, within a name
        keys = [F.col("qname"), ~flags.has(m.PAIRED), flags.has(m.SECONDARY), flags.has(m.SUPPLEMENTARY), ~flags.has(m.READ1)]
    else:
        raise ValueError(f"unknown order {order}")
    return [*keys, F.col("rank")]


def sort_alignments(df: DataFrame, order: str = "coordinate", tag: str | None = None) -> DataFrame:
    """A global sort: Spark deals rows into ranges by a sample and sorts each range, with spills."""
    return df.orderBy(*sort_keys(order, tag))


def numbered(df: DataFrame, by: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """Adds name: the row's place from 0 in the order of by, of which bucket is a coarse monotone part.

    Rows are numbered within buckets and buckets by their counts, so that only the buckets' table is
    ordered in one place.
    """
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(*by))
    return rows.withColumn("_i", within).join(starts, "_b").withColumn(name, F.col("_s") + F.col("_i") - 1).drop("_b", "_i", "_n", "_s")


def rank_gaps(ranked: DataFrame, step: int = 2, blocks: int = 1 << 16) -> DataFrame:
    """rank, delta where the next group of equal numbers in names (rank_name) isn't step further: repair of nearly sorted input is a sort, and this is its check."""
    groups = ranked.select(names.rank_in_name(F.col("qname")).alias("rank")).where("rank is not null").distinct().withColumn("block", F.floor(F.col("rank") / blocks))
    inner = F.lag("rank").over(Window.partitionBy("block").orderBy("rank"))
    firsts = groups.groupBy("block").agg(F.max("rank").alias("last"))
    before = firsts.select("block", F.lag("last").over(Window.orderBy("block")).alias("before"))
    return groups.withColumn("prev", inner).join(before, "block").select("rank", (F.col("rank") - F.coalesce("prev", "before")).alias("delta")).where(F.col("delta") != step)


def merge(parts: list[tuple[DataFrame, DataFrame]], ordered: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(alignments, sq) of several inputs (alignments, sq): references are united by name in the order of first use, ids renumbered.

    Without an order rows are concatenated (columns file and rank tell their place); with one they are sorted.
    """
    heads = reduce(DataFrame.unionByName, [sq.select("name", "length", F.lit(i).alias("file"), "refid") for i, (_, sq) in enumerate(parts)])
    united = heads.groupBy("name").agg(F.min(F.struct("file", "refid")).alias("first"), F.max("length").alias("length"))
    # a header has a bounded number of references
    united = united.withColumn("new", (F.row_number().over(Window.orderBy("first")) - 1).cast("int"))
    ids = heads.join(united.select("name", "new"), "name").select("file", "refid", "new")
    rows = reduce(DataFrame.unionByName, [df.withColumn("file", F.lit(i)) for i, (df, _) in enumerate(parts)])
    own = ids.select("file", "refid", F.col("new").alias("_o"))
    mate = ids.select("file", F.col("refid").alias("mate_refid"), F.col("new").alias("_m"))
    out = rows.join(own, ["file", "refid"], "left").join(mate, ["file", "mate_refid"], "left")
    out = out.withColumns({"refid": F.coalesce("_o", F.lit(-1)), "mate_refid": F.coalesce("_m", F.lit(-1))}).select(*parts[0][0].columns, "file")
    out = out.orderBy(*sort_keys(ordered)[:-1], "file", "rank") if ordered else out
    return out, united.select(F.col("new").alias("refid"), "name", "length")


def chunks(df: DataFrame, n: int) -> DataFrame:
    """chunk: consecutive runs of n rows."""
    return df.withColumn("chunk", F.floor(F.col("rank") / n))


def dealt(df: DataFrame, n: int) -> DataFrame:
    """part: row by row in turn."""
    return df.withColumn("part", F.pmod("rank", F.lit(n)))


def exploded_files(df: DataFrame, least: int) -> DataFrame:
    """refid, file: a file ends when the reference changes and it has more than least rows. Rows are in coordinate order; only the counts per reference (a header's worth) are folded."""
    per = df.groupBy("refid").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("refid") < 0, F.lit(1 << 32)).otherwise(F.col("refid")).cast("long").alias("key"), "refid", "n"))).alias("refs"))
    kind = "array<struct<refid:int,file:int>>"
    start = F.struct(F.lit(0).alias("file"), F.lit(0).cast("long").alias("rows"), F.array().cast(kind).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        new = acc["rows"] > least
        file = acc["file"] + new.cast("int")
        return F.struct(file.alias("file"), (F.when(new, 0).otherwise(acc["rows"]) + r["n"]).cast("long").alias("rows"), F.concat(acc["out"], F.array(F.struct(r["refid"].alias("refid"), file.alias("file")))).alias("out"))

    return per.select(F.inline(F.aggregate("refs", start, step, lambda acc: acc["out"])))


def sparse_index(df: DataFrame, every: int = 1024) -> DataFrame:
    """Each every-th row's rank and coordinate."""
    return df.where(F.pmod("rank", F.lit(every)) == 0).select("rank", "refid", "pos")


def chains(df: DataFrame, gap: int = 20_000, tile: int = 1 << 16) -> DataFrame:
    """rank, refid, pos, end, offset, chain: the distance of mapped rows, in coordinate order, from the end of the row before on the reference; a chain starts without one or at gap or more.

    Rows are walked in tiles of the reference; only the tiles' last ends and numbers of chains are
    walked by reference, so a task holds a tile's rows.
    """
    end = F.col("pos") + cigar.reference_length(F.col("cigar")) - 1
    rows = df.where(flags.mapped() & (F.col("refid") >= 0)).select("rank", "refid", "pos", end.alias("end"), F.floor(F.col("pos") / tile).alias("tile"))
    ends = rows.groupBy("refid", "tile").agg(F.max_by("end", F.struct("pos", "rank")).alias("last"))
    by_ref = Window.partitionBy("refid").orderBy("tile")
    before = ends.select("refid", "tile", F.lag("last").over(by_ref).alias("before"))
    w = Window.partitionBy("refid", "tile").orderBy("pos", "rank")
    rows = rows.join(before, ["refid", "tile"]).withColumn("offset", F.col("pos") - F.coalesce(F.lag("end").over(w), "before"))
    rows = rows.withColumn("fresh", (F.col("offset").isNull() | (F.col("offset") >= gap)).cast("int"))
    counts = rows.groupBy("refid", "tile").agg(F.sum("fresh").alias("n"))
    earlier = counts.select("refid", "tile", F.coalesce(F.sum("n").over(by_ref.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return rows.join(earlier, ["refid", "tile"]).withColumn("chain", F.col("earlier") + F.sum("fresh").over(w)).select("rank", "refid", "pos", "end", "offset", "chain")


def longest_chain(chained: DataFrame) -> DataFrame:
    """refid, chain, length, members of the longest chain (sum of spans; ties to the first)."""
    sums = chained.groupBy("refid", "chain").agg(F.sum((F.col("end") - F.col("pos") + 1).cast("long")).alias("length"), F.count("*").alias("members"))
    return sums.orderBy(F.col("length").desc(), "refid", "chain").limit(1)


def partitioned_layout(df: DataFrame, path: str, partitions: int) -> None:
    """Coordinate-sorted Parquet by ranges, whose footers let range scans skip files: what an index is for."""
    keys = names.coordinate_key(F.col("refid"), F.col("pos"))
    df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys, "rank").write.parquet(path)


def range_scan(df: DataFrame, sq: DataFrame, ranges: str) -> DataFrame:
    """Rows that overlap 'chr', 'chr:from' or 'chr:from-to' (1-based, closed; several with spaces between)."""
    ids = {r["name"]: r.refid for r in sq.select("name", "refid").collect()}
    end = F.col("pos") + F.greatest(cigar.reference_length(F.col("cigar")), F.lit(1)) - 1
    tests = []
    for one in ranges.split():
        name, _, place = one.partition(":")
        low, _, high = place.partition("-")
        test = F.col("refid") == ids[name]
        if low:
            test &= end >= int(low) - 1
        if high:
            test &= F.col("pos") <= int(high) - 1
        tests.append(test)
    return df.where(reduce(lambda a, b: a | b, tests))
