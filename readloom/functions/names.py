"""Read names: natural order, ranks in names, FASTQ name schemes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """Sorts digit runs as numbers of any length, before other characters; equal numbers by leading zeros."""
    runs = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0))

    def key(t: Column) -> Column:
        bare = F.regexp_replace(t, r"^0+(?=\d)", "")
        return F.when(t.rlike(r"^\d"), F.struct(F.lit(0).alias("kind"), F.length(bare).alias("size"), bare.alias("text"), F.length(t).alias("full"))).otherwise(
            F.struct(F.lit(1).alias("kind"), F.lit(0).alias("size"), t.alias("text"), F.lit(0).alias("full"))
        )

    return F.transform(runs, key)


def coordinate_key(refid: Column, pos: Column) -> list[Column]:
    """refid and pos as unsigned numbers, so -1 comes last."""
    unsigned = lambda c: F.when(c < 0, c.cast("long") + (1 << 32)).otherwise(c.cast("long"))
    return [unsigned(refid), unsigned(pos)]


def rank_in_name(name: Column) -> Column:
    """The number before the first '_', else null."""
    return F.regexp_extract(name, r"^(\d+)_", 1).try_cast("long")


def cut_at_space(name: Column) -> Column:
    """The first token."""
    return F.regexp_extract(name, r"^\s*(\S*)", 1)


def fastq_name(line: Column, scheme: str = "generic") -> Column:
    """struct(name, fragment): fragment is 1 or 2 for a mate, 0 for a single read, null where the line breaks the scheme.

    generic: the first token, whose /1 or /2 tells the mate. c18s, c18pe: two tokens with 6 and 3
    colons; for c18pe the second starts with the mate's number. pairedfiles: as generic, but the
    caller says which mate it is.
    """
    first = cut_at_space(line)
    if scheme in ("c18s", "c18pe"):
        second = F.regexp_extract(line, r"^\s*\S+\s+(\S*)", 1)
        ok = (F.regexp_count(first, F.lit(":")) == 6) & (F.regexp_count(second, F.lit(":")) == 3)
        mate = F.regexp_extract(second, r"^([12]):", 1).try_cast("int")
        return F.struct(first.alias("name"), F.when(ok, F.lit(0) if scheme == "c18s" else mate).alias("fragment"))
    if scheme not in ("generic", "pairedfiles"):
        raise ValueError(f"unknown name scheme {scheme}")
    mate = F.coalesce(F.regexp_extract(first, r"/([12])$", 1).try_cast("int"), F.lit(0))
    return F.struct(F.regexp_replace(first, r"/[12]$", "").alias("name"), mate.alias("fragment"))
