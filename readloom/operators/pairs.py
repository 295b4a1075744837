"""Templates: collating mates, fixing their fields, routing, merging tags by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom import model as m
from readloom.functions import aux, cigar, flags, names, sequences
from readloom.operators import orders, transforms


def classified(df: DataFrame) -> DataFrame:
    """Adds class to primary rows: F, F2 (mates that are both there), O, O2 (mates alone), S (single). One shuffle, by name."""
    w = Window.partitionBy("qname")
    number = flags.read_number()
    one, two = F.max((number == 1).cast("int")).over(w), F.max((number == 2).cast("int")).over(w)
    both = (one + two) == 2
    kind = F.when(number == 0, "S").when(number == 1, F.when(both, "F").otherwise("O")).otherwise(F.when(both, "F2").otherwise("O2"))
    return df.where(flags.primary()).withColumn("class", kind)


def mated(df: DataFrame) -> DataFrame:
    """One row per template of classified mates: qname, a and b (whole rows of read 1 and read 2; the first by rank), kind pair, orphan1 or orphan2; singles one row each."""
    row = F.struct(*[F.col(c) for c in df.columns])
    number = flags.read_number()
    rows = df.where(flags.primary()).select("qname", number.alias("n"), "rank", row.alias("row"))
    mates = rows.where("n > 0").groupBy("qname").agg(F.min_by(F.when(F.col("n") == 1, F.col("row")), F.when(F.col("n") == 1, F.col("rank"))).alias("a"), F.min_by(F.when(F.col("n") == 2, F.col("row")), F.when(F.col("n") == 2, F.col("rank"))).alias("b"))
    kind = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "pair").when(F.col("a").isNotNull(), "orphan1").otherwise("orphan2")
    singles = rows.where("n = 0").select("qname", F.col("row").alias("a"), F.lit(None).cast(rows.schema["row"].dataType).alias("b"), F.lit("single").alias("kind"))
    return mates.select("qname", "a", "b", kind.alias("kind")).unionByName(singles)


def ranks_in_names(df: DataFrame) -> DataFrame:
    """Mates are named a_b_name by their ranks, orphans and singles a_a_name; tag ZR goes."""
    w = Window.partitionBy("qname")
    number = flags.read_number()
    rank_of = lambda n: F.min(F.when(number == n, F.col("rank"))).over(w)
    paired = (number > 0) & rank_of(1).isNotNull() & rank_of(2).isNotNull()
    first, second = F.when(paired, rank_of(1)).otherwise(F.col("rank")), F.when(paired, rank_of(2)).otherwise(F.col("rank"))
    return df.where(flags.primary()).withColumns({"_name": F.concat_ws("_", first.cast("string"), second.cast("string"), "qname"), "aux": aux.drop(F.col("aux"), ["ZR"])}).drop("qname").withColumnRenamed("_name", "qname").select(df.columns)


def uncollated(df: DataFrame, exclude: str = "SECONDARY,SUPPLEMENTARY", reset: bool = False) -> DataFrame:
    """Rows in their old order without those of any excluded flag; reset takes their mapping back and keeps their tags."""
    return transforms.reset(df, exclude, keep_tags=None) if reset else df.where(flags.lacks(m.parse_flags(exclude)))


def post_ranks(df: DataFrame, reset: bool = True) -> DataFrame:
    """Primary rows, mates next to each other, with rank the place in this order; names take these places, tag zz holds the old rank, tag ZR goes.

    Templates stand in the order of their first rows, read 1 before read 2. Mates are named a_b_name,
    orphans a_a_name, singles a_name. reset takes the mapping back and keeps the tags.
    """
    w = Window.partitionBy("qname")
    number = flags.read_number()
    first_of = lambda n, c: F.min(F.when(F.col("_number") == n, F.col(c))).over(w)
    rows = transforms.rank_to_tag(df.where(flags.primary())).withColumn("_number", number)
    rows = rows.withColumns({"_1": first_of(1, "rank"), "_2": first_of(2, "rank")})
    rows = rows.withColumn("_paired", (F.col("_number") > 0) & F.col("_1").isNotNull() & F.col("_2").isNotNull())
    rows = rows.withColumn("_first", F.when(F.col("_paired"), F.least("_1", "_2")).otherwise(F.col("rank")))
    placed = orders.numbered(rows, [F.col("_first"), F.col("_number"), F.col("rank")], F.floor(F.col("_first") / 4096), "_place")
    one, two = (F.when(F.col("_paired"), first_of(n, "_place")).otherwise(F.col("_place")).cast("string") for n in (1, 2))
    name = F.concat_ws("_", one, F.when(F.col("_number") > 0, two), "qname")
    named = placed.withColumns({"_name": name, "rank": F.col("_place").cast("long"), "aux": aux.drop(F.col("aux"), ["ZR"])}).drop("qname").withColumnRenamed("_name", "qname").select(df.columns)
    return transforms.reset(named, "", keep_tags=None) if reset else named


def fix_mate_coordinates(df: DataFrame, keep_others: bool = False) -> DataFrame:
    """Pairs with exactly one mapped end: both ends take its coordinate, as their own and as their mate's.

    Secondary and supplementary rows go; with keep_others (as for input sorted by name) they pass unchanged.
    """
    w = Window.partitionBy("qname")
    number = F.when(flags.primary(), flags.read_number()).otherwise(0)
    ends = F.count(F.when(number > 0, 1)).over(w)
    here = F.when((number > 0) & flags.mapped(), F.struct("refid", "pos"))
    n, at = F.count(here).over(w), F.min(here).over(w)
    rows = (df if keep_others else df.where(flags.primary())).withColumns({"_fix": (ends == 2) & (number > 0) & (n == 1), "_at": at})
    put = lambda c, f: F.when(F.col("_fix"), F.col(f"_at.{f}")).otherwise(F.col(c))
    return rows.withColumns({"refid": put("refid", "refid"), "pos": put("pos", "pos"), "mate_refid": put("mate_refid", "refid"), "mate_pos": put("mate_pos", "pos")}).select(df.columns)


def with_mates(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Adds _mate, a struct of fields of each primary row's mate (the first by rank of the other number), else null. One shuffle, by name."""
    w = Window.partitionBy("qname")
    number = flags.read_number()
    main = flags.primary() & (number > 0)
    side = F.struct("rank", *[c.alias(n) for n, c in fields.items()])
    of = lambda n: F.min_by(F.when(main & (number == n), side), F.when(main & (number == n), F.col("rank"))).over(w)
    return df.withColumn("_mate", F.when(main & (number == 1), of(2)).when(main & (number == 2), of(1)))


def fix_mates(df: DataFrame, support: bool = False, tag: str | None = None, nucleotides: bool = False) -> DataFrame:
    """Mate fields of pairs from the mate itself: refid, pos, strand, mapping, tlen, and its quality as tag MQ; other rows pass.

    tlen is the distance between the 5' ends of two ends on one reference, negative for the right one.

    support: also the tags by which duplicates can be marked read by read: ms (the mate's score), mc
    (its unclipped 5' coordinate, from 1) and MC (its cigar); where a tag is named, mt holds the mate's
    value of it (with nucleotides: only its letters A, C, G and T). A number in MC, as old tools
    wrote it, goes.
    """
    five = cigar.unclipped_five_prime(F.col("cigar"), F.col("pos"), F.col("flag"))
    fields = {"refid": F.col("refid"), "pos": F.col("pos"), "flag": F.col("flag"), "mapq": F.col("mapq"), "five": five}
    if support:
        own = aux.value(F.col("aux"), aux.check_tag(tag)) if tag else F.lit(None).cast("string")
        own = F.regexp_replace(F.upper(own), "[^ACGT]", "") if nucleotides else own
        fields |= {"score": sequences.quality_sum(F.col("qual")), "cigar": cigar.to_text(F.col("cigar")), "mark": own}
    rows = with_mates(df, fields)
    has = F.col("_mate").isNotNull()
    mate_flag = F.when(flags.has(m.UNMAPPED, F.col("_mate.flag")), m.MATE_UNMAPPED).otherwise(0).bitwiseOR(F.when(flags.has(m.REVERSE, F.col("_mate.flag")), m.MATE_REVERSE).otherwise(0))
    flag = F.col("flag").bitwiseAND(~(m.MATE_UNMAPPED | m.MATE_REVERSE)).bitwiseOR(mate_flag)
    mate_mapped = flags.lacks(m.UNMAPPED, F.col("_mate.flag"))
    together = flags.mapped() & mate_mapped & (F.col("refid") == F.col("_mate.refid"))
    gap = F.col("_mate.five") - five
    span = F.when(together, gap + F.when(gap > 0, 1).when(gap < 0, -1).otherwise(0)).otherwise(0)
    put = lambda new, c: F.when(has, new).otherwise(F.col(c)).alias(c)
    tags = aux.put(F.col("aux"), "MQ", "i", F.when(has, F.col("_mate.mapq")))
    if support:
        old = F.filter(tags, lambda t: ~((t["tag"] == "MC") & (t["type"] == "i")))
        tags = F.when(has, old).otherwise(tags)
        for name, kind, value in (("ms", "i", F.col("_mate.score")), ("mc", "i", F.when(mate_mapped, F.col("_mate.five") + 1)), ("MC", "Z", F.when(mate_mapped, F.col("_mate.cigar"))), ("mt", "Z", F.col("_mate.mark"))):
            tags = aux.put(tags, name, kind, F.when(has, value))
    new = {"flag": flag, "mate_refid": F.col("_mate.refid"), "mate_pos": F.col("_mate.pos"), "tlen": span.cast("int")}
    return rows.select(*[put(new[c], c) if c in new else tags.alias("aux") if c == "aux" else F.col(c) for c in df.columns])


def add_mate_cigars(df: DataFrame) -> DataFrame:
    """Tag MC, the mate's cigar, on primary rows whose mate is mapped."""
    rows = with_mates(df, {"flag": F.col("flag"), "cigar": cigar.to_text(F.col("cigar"))})
    value = F.when(F.col("_mate").isNotNull() & flags.lacks(m.UNMAPPED, F.col("_mate.flag")), F.col("_mate.cigar"))
    return rows.withColumn("aux", aux.put(F.col("aux"), "MC", "Z", value)).select(df.columns)


def routed(df: DataFrame) -> DataFrame:
    """Adds category: single, orphan, supplementary, unmapped, split, samestrand, improper or proper; 'inconsistent' where a template has no one primary per end or mixed proper bits.

    The tests go in this order: unpaired; only one end present; supplementary; then by the two primaries.
    """
    w = Window.partitionBy("qname")
    number = flags.read_number()
    main = flags.primary()
    count = lambda c: F.count(F.when(c, 1)).over(w)
    first = lambda n, c: F.min(F.when(main & (number == n), c)).over(w)
    df = df.withColumns({"_one": count(number == 1), "_two": count(number == 2), "_p1": count(main & (number == 1)), "_p2": count(main & (number == 2)), "_secondary": count(flags.has(m.SECONDARY)), "_f1": first(1, F.col("flag")), "_f2": first(2, F.col("flag")), "_r1": first(1, F.col("refid")), "_r2": first(2, F.col("refid"))})
    bit = lambda c, b: flags.has(b, F.col(c))
    category = (
        F.when(flags.lacks(m.PAIRED), "single")
        .when((F.col("_one") == 0) | (F.col("_two") == 0), "orphan")
        .when(flags.has(m.SUPPLEMENTARY), "supplementary")
        .when((F.col("_secondary") > 0) | (F.col("_p1") != 1) | (F.col("_p2") != 1) | (bit("_f1", m.PROPER) != bit("_f2", m.PROPER)), "inconsistent")
        .when(bit("_f1", m.UNMAPPED) | bit("_f2", m.UNMAPPED), "unmapped")
        .when(F.col("_r1") != F.col("_r2"), "split")
        .when(bit("_f1", m.REVERSE) == bit("_f2", m.REVERSE), "samestrand")
        .when(bit("_f1", m.PROPER), "proper")
        .otherwise("improper")
    )
    return df.withColumn("category", category).drop("_one", "_two", "_p1", "_p2", "_secondary", "_f1", "_f2", "_r1", "_r2")


#: Tags that only the primary row keeps when tags are merged.
ADAPTER_TAGS = ("qs", "qq", "as", "ah", "aa", "af", "ar", "a3")


def merge_tags_by_rank(aligned: DataFrame, original: DataFrame, reinsert: bool = False, old_rank_to_name: bool = False) -> DataFrame:
    """Aligned rows (names rank_name) take the tags that they lack, and QC failure, from the original row of that rank; the rank leaves the name.

    reinsert: clipped adapters, held in tags, go back into the rows; old_rank_to_name: the rank held
    in tag zz goes in front of the name.
    """
    other = original.select(F.col("rank").alias("_rank"), F.col("aux").alias("_aux"), F.col("flag").alias("_flag"))
    rows = aligned.withColumn("_rank", names.rank_in_name(F.col("qname"))).join(other, "_rank", "left")
    merged = F.when(F.col("_aux").isNull(), F.col("aux")).otherwise(aux.merge(F.col("aux"), F.col("_aux")))
    out = rows.withColumns(
        {
            "aux": F.when(flags.primary(), merged).otherwise(aux.drop(merged, ADAPTER_TAGS)),
            "flag": F.col("flag").bitwiseAND(~m.QCFAIL).bitwiseOR(F.coalesce(F.col("_flag"), F.col("flag")).bitwiseAND(m.QCFAIL)),
            "qname": F.regexp_replace("qname", r"^\d+_", ""),
        }
    ).select(aligned.columns)
    out = transforms.reinsert_clips(out) if reinsert else out
    return transforms.rank_to_name(out) if old_rank_to_name else out


def merge_tags_by_name(rows: DataFrame, tagged: DataFrame) -> DataFrame:
    """rows take the tags that they lack from the row of their name in tagged (one row a name)."""
    other = tagged.groupBy("qname").agg(F.min_by("aux", "rank").alias("_aux"))
    return rows.join(other, "qname", "left").withColumn("aux", F.when(F.col("_aux").isNull(), F.col("aux")).otherwise(aux.merge(F.col("aux"), F.col("_aux")))).select(rows.columns)


def fill_bases(rows: DataFrame, fasta: DataFrame) -> DataFrame:
    """Bases from a table of reads (id, seq) by name, reversed for reverse rows and without hard clips; all qualities become H. Rows without a read go."""
    read = fasta.select(F.col("id").alias("qname"), F.col("seq").alias("_read"))
    turned = F.when(flags.has(m.REVERSE), sequences.reverse_complement(F.col("_read"))).otherwise(F.col("_read"))
    front, back = cigar.front_clip(F.col("cigar"), "H"), cigar.back_clip(F.col("cigar"), "H")
    seq = turned.substr(front + 1, F.greatest(F.length("_read") - front - back, F.lit(0)))
    return rows.join(read, "qname").withColumn("seq", seq).withColumn("qual", F.repeat(F.lit("H"), F.length("seq"))).select(rows.columns)


