"""CIGAR strings as arrays of (op, len)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions import flags
from readloom import model as m

QUERY_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"


def parse(text: Column) -> Column:
    """'10M2I' as an array; '*' as an empty one."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.regexp_extract(p, r"^\d+", 0).cast("int").alias("len")))


def to_text(cigar: Column) -> Column:
    return F.when(F.size(cigar) > 0, F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")).otherwise("*")


def consumed(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of the operations in ops."""
    return F.aggregate(cigar, F.lit(0), lambda n, c: n + F.when(c["op"].isin(*ops), c["len"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    return consumed(cigar, REFERENCE_OPS)


def query_length(cigar: Column) -> Column:
    return consumed(cigar, QUERY_OPS)


def _edge(cigar: Column, ops: str) -> Column:
    """Length of the run of operations of ops at the start of cigar."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    step = lambda acc, c: F.struct((acc["n"] + F.when(acc["open"] & c["op"].isin(*ops), c["len"]).otherwise(0)).alias("n"), (acc["open"] & c["op"].isin(*ops)).alias("open"))
    return F.aggregate(cigar, start, step, lambda acc: acc["n"])


def front_clip(cigar: Column, ops: str = "SH") -> Column:
    return _edge(cigar, ops)


def back_clip(cigar: Column, ops: str = "SH") -> Column:
    return _edge(F.reverse(cigar), ops)


def unclipped_five_prime(cigar: Column, pos: Column, flag: Column) -> Column:
    """Where the read's 5' end would lie without clipping: before the start, or for reverse reads after the end."""
    return F.when(flags.has(m.REVERSE, flag), pos + reference_length(cigar) - 1 + back_clip(cigar)).otherwise(pos - front_clip(cigar))
