"""Row transforms of alignments: narrow plans without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import model as m
from readloom.functions import aux, cigar, flags, sequences

def _no_cigar() -> Column:
    return F.array().cast(m.CIGAR)


def mask_flags(df: DataFrame, keep: int = 0xFFFF, drop: int = 0, with_any_tag: tuple[str, ...] = (), reset_mate: bool = False) -> DataFrame:
    """flag & keep & ~drop, on all rows or on those with one of the tags; reset_mate clears all mate coordinates."""
    masked = F.col("flag").bitwiseAND(keep & ~drop)
    out = df.withColumn("flag", F.when(aux.has_any(F.col("aux"), with_any_tag), masked).otherwise(F.col("flag")) if with_any_tag else masked)
    return out.withColumns({"mate_refid": F.lit(-1), "mate_pos": F.lit(-1)}) if reset_mate else out


def reset(df: DataFrame, exclude: str = "SECONDARY,SUPPLEMENTARY", keep_tags: tuple[str, ...] | None = ()) -> DataFrame:
    """Takes the mapping back: raw reads in the orientation of the machine, unmapped.

    keep_tags: tags to keep; None keeps all. Of paired reads, the bits of pairing and of being
    read 1 or 2 stay, and the mate is unmapped. exclude is tested on the flags after that, where
    only pairing, unmapping, mate unmapping, the read number, QC failure, SECONDARY and SUPPLEMENTARY are left.
    """
    back = flags.has(m.REVERSE)
    keep = m.PAIRED | m.READ1 | m.READ2 | m.SECONDARY | m.SUPPLEMENTARY | m.QCFAIL
    flag = F.col("flag").bitwiseAND(keep).bitwiseOR(m.UNMAPPED).bitwiseOR(F.when(flags.has(m.PAIRED), m.MATE_UNMAPPED).otherwise(0))
    out = df.withColumns(
        {
            "seq": F.when(back, sequences.reverse_complement(F.col("seq"))).otherwise(F.col("seq")),
            "qual": F.when(back, F.reverse("qual")).otherwise(F.col("qual")),
            "flag": flag,
            "refid": F.lit(-1), "pos": F.lit(-1), "mapq": F.lit(0), "cigar": _no_cigar(),
            "mate_refid": F.lit(-1), "mate_pos": F.lit(-1), "tlen": F.lit(0),
        }
    )
    if keep_tags is not None:
        out = out.withColumn("aux", aux.keep(F.col("aux"), keep_tags) if keep_tags else F.array().cast(m.AUX))
    return out.where(flags.lacks(m.parse_flags(exclude)))


def filter_tags(df: DataFrame, keep: tuple[str, ...] | None = None, remove: tuple[str, ...] | None = None) -> DataFrame:
    if (keep is None) == (remove is None):
        raise ValueError("give either keep or remove")
    return df.withColumn("aux", aux.keep(F.col("aux"), keep) if keep is not None else aux.drop(F.col("aux"), remove))


def sort_tags(df: DataFrame) -> DataFrame:
    """Tags in the order of their names."""
    return df.withColumn("aux", F.sort_array("aux"))


def drop_mate_cigar_of_unmapped(df: DataFrame) -> DataFrame:
    return df.withColumn("aux", F.when(flags.has(m.MATE_UNMAPPED), aux.drop(F.col("aux"), ["MC"])).otherwise(F.col("aux")))


def rank_to_tag(df: DataFrame) -> DataFrame:
    """rank as tag zz: eight bytes, the highest first, in SAM's text form of a byte array."""
    bytes_of = F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0)), lambda i: F.pmod(F.floor(F.col("rank") / F.pow(F.lit(256.0), i)), F.lit(256))), ",")
    return df.withColumn("aux", aux.put(F.col("aux"), "zz", "B", F.concat(F.lit("C,"), bytes_of)))


def rank_to_name(df: DataFrame) -> DataFrame:
    """The rank held in tag zz goes in front of the name; the tag goes."""
    digits = F.split(aux.value(F.col("aux"), "zz"), ",")
    rank = F.aggregate(F.slice(digits, 2, 8), F.lit(0).cast("long"), lambda acc, d: acc * 256 + d.cast("long"))
    named = F.when(F.col("qname").isNotNull() & aux.has_any(F.col("aux"), ["zz"]), F.concat_ws("_", rank.cast("string"), "qname")).otherwise(F.col("qname"))
    return df.withColumns({"qname": named, "aux": aux.drop(F.col("aux"), ["zz"])})


def _number(digits: Column) -> Column:
    """digits without leading zeros; an empty run counts as 0."""
    return F.when(digits == "", "0").otherwise(F.regexp_replace(digits, r"^0+(?=\d)", ""))


def split_pair_name(df: DataFrame) -> DataFrame:
    """a_b_name becomes a_name for read 1 and b_name for read 2; other names stay."""
    shape = r"^(\d*)_(\d*)_(.*)$"
    one = flags.has(m.READ1)
    fits = F.col("qname").rlike(shape) & (one != flags.has(m.READ2))
    part = F.when(one, F.regexp_extract("qname", shape, 1)).otherwise(F.regexp_extract("qname", shape, 2))
    return df.withColumn("qname", F.when(fits, F.concat_ws("_", _number(part), F.regexp_extract("qname", shape, 3))).otherwise(F.col("qname")))


def strip_name_rank(df: DataFrame) -> DataFrame:
    """a_name becomes name for unpaired reads and for those that are either read 1 or read 2."""
    fits = flags.lacks(m.PAIRED) | (flags.has(m.READ1) != flags.has(m.READ2))
    return df.withColumn("qname", F.when(fits, F.regexp_replace("qname", r"^\d*_", "")).otherwise(F.col("qname")))


def extract_clips(df: DataFrame, least: int = 20) -> DataFrame:
    """Soft-clipped ends of mapped reads, of least bases or more, as unmapped reads name_front and name_back; unmapped rows stay, other rows go."""
    first, last = F.get("cigar", F.lit(0)), F.get("cigar", F.size("cigar") - 1)
    is_mapped = flags.mapped()
    front = is_mapped & (first["op"] == "S") & (first["len"] >= least)
    back = is_mapped & (F.size("cigar") > 1) & (last["op"] == "S") & (last["len"] >= least)
    end = lambda suffix, size, tail: F.struct(
        F.concat("qname", F.lit(suffix)).alias("qname"),
        (F.right("seq", size) if tail else F.left("seq", size)).alias("seq"),
        (F.right("qual", size) if tail else F.left("qual", size)).alias("qual"),
    )
    whole = F.struct("qname", "seq", "qual")
    pieces = F.filter(
        F.array(F.when(~is_mapped, whole), F.when(front, end("_front", first["len"], False)), F.when(back, end("_back", last["len"], True))), lambda x: x.isNotNull()
    )
    others = [c for c in df.columns if c not in ("qname", "seq", "qual")]
    out = df.select(*others, F.inline(pieces))
    return out.withColumns({"refid": F.when(flags.mapped(), -1).otherwise(F.col("refid")), "cigar": F.when(flags.mapped(), _no_cigar()).otherwise(F.col("cigar")), "flag": F.col("flag").bitwiseOR(m.UNMAPPED)}).select(df.columns)


def front_and_back(df: DataFrame, border: int = 20, exclude: str = "SECONDARY,SUPPLEMENTARY") -> DataFrame:
    """First and last border bases of each reset read that is longer than border, as name_front and name_back."""
    raw = reset(df, exclude).where(F.length("seq") > border)
    piece = lambda suffix, cut: F.struct(F.concat("qname", F.lit(suffix)).alias("qname"), cut("seq", F.lit(border)).alias("seq"), cut("qual", F.lit(border)).alias("qual"))
    others = [c for c in df.columns if c not in ("qname", "seq", "qual")]
    return raw.select(*others, F.inline(F.array(piece("_front", F.left), piece("_back", F.right)))).select(df.columns)


def convert_tags(df: DataFrame) -> DataFrame:
    """Mate tags of the old upper case names to the new ones: MS and numeric MC become integers ms and mc, MT a string mt, at the end."""
    tags = F.col("aux")
    for old, new, kind in (("MS", "ms", "i"), ("MC", "mc", "i"), ("MT", "mt", "Z")):

        def mine(a: Column) -> Column:
            return (F.upper(a["tag"]) == old) & (a["type"] == kind)  # noqa: B023

        def other(a: Column) -> Column:
            return ~mine(a)  # noqa: B023

        found = F.get(F.filter(tags, mine), F.lit(0))["value"]
        fresh = F.array(F.struct(F.lit(new).alias("tag"), F.lit(kind).alias("type"), found.alias("value")))
        tags = F.when(found.isNull(), tags).otherwise(F.concat(F.filter(tags, other), fresh))
    return df.withColumn("aux", tags)


def tag_reference_interval(df: DataFrame) -> DataFrame:
    """re:Z:[from,to) on mapped rows."""
    text = F.concat(F.lit("["), F.col("pos"), F.lit(","), F.col("pos") + cigar.reference_length(F.col("cigar")), F.lit(")"))
    return df.withColumn("aux", F.when(flags.mapped(), aux.put(F.col("aux"), "re", "Z", text)).otherwise(F.col("aux")))


def random_tag(df: DataFrame, tag: str = "XX", seed: int = 0) -> DataFrame:
    """A or C, decided by the rank and seed, so reruns agree."""
    coin = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("rank").cast("string"))), 1, 1) < "8"
    return df.withColumn("aux", aux.put(F.col("aux"), aux.check_tag(tag), "A", F.when(coin, "A").otherwise("C")))


def replace_read_groups(df: DataFrame, names: DataFrame) -> DataFrame:
    """RG renamed by a table of (old, new); unknown groups stay. The table is a header's worth of rows."""
    named = df.withColumn("_rg", aux.value(F.col("aux"), "RG")).join(names.select(F.col("old").alias("_rg"), F.col("new").alias("_new")).dropDuplicates(["_rg"]), "_rg", "left")
    swap = F.transform("aux", lambda a: F.when((a["tag"] == "RG") & F.col("_new").isNotNull(), F.struct(a["tag"].alias("tag"), a["type"].alias("type"), F.col("_new").alias("value"))).otherwise(a))
    return named.withColumn("aux", swap).select(df.columns)


def clip_adapters(df: DataFrame) -> DataFrame:
    """Cuts max(as, a3) bases off the 3' end; the bases and qualities go to tags qs and qq, the cigar gets a hard clip.

    Works where more than one base is left. The cut is taken from the 3' end of the cigar: whole
    operations, then part of one; reverse reads lose from the front, and pos moves by the reference
    bases cut off.
    """
    tag = lambda t: F.coalesce(aux.value(F.col("aux"), t).try_cast("int"), F.lit(0))
    cut = F.greatest(tag("as"), tag("a3"))
    df = df.withColumn("_cut", cut)
    acts = (F.col("_cut") > 0) & (F.length("seq") - F.col("_cut") > 1)
    back = flags.has(m.REVERSE)
    n = F.length("seq")
    # operations from the 3' end on
    inward = F.when(back, F.col("cigar")).otherwise(F.reverse("cigar"))
    start = F.struct(F.col("_cut").alias("left"), F.lit(0).alias("hard"), F.lit(0).alias("moved"), _no_cigar().alias("rest"))

    def step(acc: Column, c: Column) -> Column:
        outer = (c["op"] == "H") & (F.size(acc["rest"]) == 0)
        in_query, in_reference = c["op"].isin(*cigar.QUERY_OPS), c["op"].isin(*cigar.REFERENCE_OPS)
        active = acc["left"] > 0
        take = F.when(active & in_query, F.least(acc["left"], c["len"])).otherwise(0)
        gone = active & ~in_query & ~outer & in_reference
        kept = F.when(outer | gone, 0).otherwise(c["len"] - take)
        return F.struct(
            (acc["left"] - take).alias("left"),
            (acc["hard"] + F.when(outer, c["len"]).otherwise(0)).alias("hard"),
            (acc["moved"] + F.when(in_reference, F.when(gone, c["len"]).otherwise(take)).otherwise(0)).alias("moved"),
            F.when(kept > 0, F.concat(acc["rest"], F.array(F.struct(c["op"].alias("op"), kept.cast("int").alias("len"))))).otherwise(acc["rest"]).alias("rest"),
        )

    walked = F.aggregate(inward, start, step)
    df = df.withColumn("_w", walked)
    clip = F.array(F.struct(F.lit("H").alias("op"), (F.col("_cut") + F.col("_w.hard")).cast("int").alias("len")))
    new_cigar = F.when(back, F.concat(clip, F.col("_w.rest"))).otherwise(F.concat(F.reverse("_w.rest"), clip))
    keep = n - F.col("_cut")
    side = lambda c, mine: F.when(back, F.left(c, F.col("_cut")) if mine else F.right(c, keep)).otherwise(F.right(c, F.col("_cut")) if mine else F.left(c, keep))
    tags = aux.put(aux.put(F.col("aux"), "qs", "Z", side("seq", True)), "qq", "Z", side("qual", True))
    is_mapped = flags.mapped()
    out = {
        "aux": F.when(acts, tags).otherwise(F.col("aux")),
        "cigar": F.when(acts & is_mapped, new_cigar).otherwise(F.col("cigar")),
        "pos": F.when(acts & is_mapped & back, F.col("pos") + F.col("_w.moved")).otherwise(F.col("pos")),
        "seq": F.when(acts, side("seq", False)).otherwise(F.col("seq")),
        "qual": F.when(acts, side("qual", False)).otherwise(F.col("qual")),
    }
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns if c not in ("_cut", "_w")])


def reinsert_clips(df: DataFrame) -> DataFrame:
    """Puts qs and qq back at the 3' end as a soft clip inside the hard clips, where as or ah tells of an adapter; the tags go."""
    tags = F.col("aux")
    qs, qq = aux.value(tags, "qs"), aux.value(tags, "qq")
    acts = aux.has_any(tags, ["as", "ah"]) & qs.isNotNull() & qq.isNotNull()
    back = flags.has(m.REVERSE)
    inward = F.when(back, F.col("cigar")).otherwise(F.reverse("cigar"))
    hard = F.aggregate(inward, F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda a, c: F.struct((a["n"] + (a["open"] & (c["op"] == "H")).cast("int")).alias("n"), (a["open"] & (c["op"] == "H")).alias("open")), lambda a: a["n"])
    outer, inner = F.slice(inward, F.lit(1), hard), F.slice(inward, hard + 1, F.greatest(F.size(inward), F.lit(1)))
    soft = F.get(inner, F.lit(0))
    grown = F.when(soft["op"] == "S", F.concat(F.array(F.struct(F.lit("S").alias("op"), (soft["len"] + F.length(qs)).cast("int").alias("len"))), F.slice(inner, F.lit(2), F.greatest(F.size(inner), F.lit(1))))).otherwise(
        F.concat(F.array(F.struct(F.lit("S").alias("op"), F.length(qs).cast("int").alias("len"))), inner)
    )
    joined = F.concat(outer, grown)
    new_cigar = F.when(back, joined).otherwise(F.reverse(joined))
    return df.withColumns(
        {
            "cigar": F.when(acts & flags.mapped(), new_cigar).otherwise(F.col("cigar")),
            "seq": F.when(acts, F.when(back, F.concat(sequences.reverse_complement(qs), "seq")).otherwise(F.concat("seq", qs))).otherwise(F.col("seq")),
            "qual": F.when(acts, F.when(back, F.concat(F.reverse(qq), "qual")).otherwise(F.concat("qual", qq))).otherwise(F.col("qual")),
            "aux": F.when(acts, aux.drop(tags, ["qs", "qq"])).otherwise(tags),
        }
    )
