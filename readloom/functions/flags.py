"""Flag predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom import model as m


def has(bits: int, flag: str | Column = "flag") -> Column:
    """Any of bits is set."""
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(bits) != 0


def lacks(bits: int, flag: str | Column = "flag") -> Column:
    return ~has(bits, flag)


def mapped() -> Column:
    return lacks(m.UNMAPPED)


def primary() -> Column:
    return lacks(m.SECONDARY | m.SUPPLEMENTARY)


def read_number(flag: str = "flag") -> Column:
    """1 or 2 for a paired read with exactly one of the two bits, else 0."""
    one, two = has(m.READ1, flag), has(m.READ2, flag)
    return F.when(has(m.PAIRED, flag) & one & ~two, 1).when(has(m.PAIRED, flag) & two & ~one, 2).otherwise(0)


def simple_pair() -> Column:
    """A mapped read whose mate is mapped on the same reference, one forward and one reverse, the reverse one behind."""
    innie = F.when(has(m.MATE_REVERSE), F.col("pos") < F.col("mate_pos")).otherwise(F.col("mate_pos") < F.col("pos"))
    return lacks(m.UNMAPPED | m.MATE_UNMAPPED) & (F.col("refid") == F.col("mate_refid")) & (has(m.REVERSE) != has(m.MATE_REVERSE)) & innie


def matching_pair(a: str = "a", b: str = "b") -> Column:
    """Two rows (structs) that name each other as mates: both paired, one read 1 and one read 2, each at the other's mate's place."""
    bit = lambda row, x: has(x, F.col(f"{row}.flag")).cast("int")
    at = lambda x, y: (F.col(f"{x}.refid") == F.col(f"{y}.mate_refid")) & (F.col(f"{x}.pos") == F.col(f"{y}.mate_pos"))
    return (bit(a, m.PAIRED) + bit(b, m.PAIRED) == 2) & (bit(a, m.READ1) + bit(b, m.READ1) == 1) & (bit(a, m.READ2) + bit(b, m.READ2) == 1) & at(a, b) & at(b, a)
