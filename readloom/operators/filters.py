"""Filters of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom import model as m
from readloom.functions import aux, cigar, flags, murmur, names

CLASSES = ("F", "F2", "O", "O2", "S")


def by_mapping(df: DataFrame, least: int = 0, most: int = 3, length: int = 0) -> DataFrame:
    """least <= self mapped + mate mapped + proper pair <= most, and length bases or more. The mate's bit counts as it is, for single reads too."""
    score = flags.mapped().cast("int") + flags.lacks(m.MATE_UNMAPPED).cast("int") + flags.has(m.PROPER).cast("int")
    return df.where(score.between(least, most) & (F.length("seq") >= length))


def without_flags(df: DataFrame, exclude: str) -> DataFrame:
    return df.where(flags.lacks(m.parse_flags(exclude)))


def by_reference_length(df: DataFrame, least: int) -> DataFrame:
    return df.where(cigar.reference_length(F.col("cigar")) >= least)


def by_names(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose name is in wanted (column qname); a list small enough is broadcast by the planner."""
    return df.join(wanted.select("qname"), "qname", "left_semi").select(df.columns)


def by_references(df: DataFrame, sq: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows on references whose names are in wanted (column name)."""
    ids = sq.join(wanted, "name", "left_semi").select("refid")
    return df.join(ids, "refid", "left_semi").select(df.columns)


def by_read_groups(df: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    return df.where(aux.value(F.col("aux"), "RG").isin(*groups))


def by_name_pattern(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(F.col("qname").rlike(pattern))


def by_class(df: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """df has the column class of pairs.classified."""
    return df.where(F.col("class").isin(*classes))


def by_pair_mapq(df: DataFrame, least: int) -> DataFrame:
    """Templates of which a mapped end has that quality or more."""
    best = F.max(F.when(flags.mapped(), F.col("mapq"))).over(Window.partitionBy("qname"))
    return df.withColumn("_best", best).where(F.col("_best") >= least).drop("_best")


def by_pair_read_group(df: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Templates all of whose rows are in one of groups."""
    inside = F.coalesce(aux.value(F.col("aux"), "RG").isin(*groups), F.lit(False))
    return df.withColumn("_all", F.bool_and(inside).over(Window.partitionBy("qname"))).where("_all").drop("_all")


def used_header(df: DataFrame, sq: DataFrame, mate_of_mapped_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(alignments with renumbered references, sq of those in use).

    In use: references of mapped rows and of mapped mates of paired rows; with mate_of_mapped_only
    only the mates of rows that are mapped themselves. Unmapped rows and mates get -1.
    """
    own = flags.mapped() & (F.col("refid") >= 0)
    mate = flags.has(m.PAIRED) & (flags.mapped() if mate_of_mapped_only else flags.lacks(m.MATE_UNMAPPED)) & (F.col("mate_refid") >= 0)
    seen = df.select(F.explode(F.filter(F.array(F.when(own, F.col("refid")), F.when(mate, F.col("mate_refid"))), lambda x: x.isNotNull())).alias("refid")).distinct()
    # a header has a bounded number of references
    kept = sq.join(seen, "refid", "left_semi").withColumn("new", (F.row_number().over(Window.orderBy("refid")) - 1).cast("int"))
    out = df.withColumns({"_own": F.when(own, F.col("refid")), "_mate": F.when(mate, F.col("mate_refid"))})
    out = out.join(kept.select(F.col("refid").alias("_own"), F.col("new").alias("_o")), "_own", "left").join(kept.select(F.col("refid").alias("_mate"), F.col("new").alias("_m")), "_mate", "left")
    out = out.withColumns({"refid": F.coalesce("_o", F.lit(-1)), "mate_refid": F.coalesce("_m", F.lit(-1))}).select(df.columns)
    return out, kept.select(F.col("new").alias("refid"), *[c for c in sq.columns if c != "refid"])


def downsample(df: DataFrame, share: float, seed: int = 0, exclude: str = "") -> DataFrame:
    """Whole templates, of which about share are kept: a hash of name and seed decides, so reruns agree."""
    limit = int(share * (2**32 - 1) + 0.5)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "qname")), 1, 8), 16, 10).cast("long")
    return without_flags(df, exclude).where(h <= limit)


def downsample_by_murmur(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Whole templates, of which about share are kept, by MurmurHash3 of the name, its words folded to 32 bits; no flags are excluded."""
    return df.where(murmur.folded(murmur.murmur3(F.col("qname"), seed)) <= int(share * (2**32 - 1) + 0.5))


def violations(df: DataFrame, sq: DataFrame) -> DataFrame:
    """rank and rule of each broken rule of a row; a valid file gives no rows."""
    with_length = df.join(sq.select("refid", F.col("length").alias("_length")), "refid", "left")
    rules = {
        "name": F.length("qname").between(1, 254),
        "reference": (F.col("refid") == -1) | F.col("_length").isNotNull(),
        "position": (F.col("pos") >= -1) & (F.col("_length").isNull() | (F.col("pos") < F.col("_length"))),
        "cigar": flags.has(m.UNMAPPED) | (F.size("cigar") == 0) | (cigar.query_length(F.col("cigar")) == F.length("seq")),
        "quality": (F.col("qual") == "*") | (F.length("qual") == F.length("seq")),
        "bases": F.col("seq").rlike(r"^(\*|[A-Za-z=.]*)$"),
    }
    broken = F.filter(F.array(*[F.when(~ok, F.lit(rule)) for rule, ok in rules.items()]), lambda x: x.isNotNull())
    return with_length.select("rank", F.explode(broken).alias("rule"))


def order_breaks(df: DataFrame, order: str = "coordinate", blocks: int = 1 << 16) -> DataFrame:
    """rank of each row that comes before its predecessor by rank, in the given order (coordinate or queryname).

    Neighbours are found within blocks of ranks and at their ends, so no task sees all rows.
    """
    if order == "coordinate":
        key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(names.coordinate_key(F.col("refid"), F.col("pos")))])
    else:
        key = F.struct(names.natural_key(F.col("qname")).alias("k0"), flags.has(m.READ2).alias("k1"))
    rows = df.select("rank", key.alias("key"), F.floor(F.col("rank") / blocks).alias("block"))
    before = F.lag("key").over(Window.partitionBy("block").orderBy("rank"))
    rows = rows.withColumn("before", before)
    ends = rows.groupBy("block").agg(F.max_by("key", "rank").alias("end")).select((F.col("block") + 1).alias("block"), "end")
    return rows.join(ends, "block", "left").where(F.col("key") < F.coalesce("before", "end")).select("rank")
