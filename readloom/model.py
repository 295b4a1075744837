"""The row model of sequencing reads: flags, types and schemas.

Positions are 0-based; -1 stands for "none" in refid, pos and their mates, as ordering depends on it.
"""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
READ1, READ2, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800

#: Names of the flag bits in options.
FLAG_NAMES = {
    "PAIRED": PAIRED, "PROPER_PAIR": PROPER, "UNMAP": UNMAPPED, "MUNMAP": MATE_UNMAPPED, "REVERSE": REVERSE, "MREVERSE": MATE_REVERSE,
    "READ1": READ1, "READ2": READ2, "SECONDARY": SECONDARY, "QCFAIL": QCFAIL, "DUP": DUPLICATE, "SUPPLEMENTARY": SUPPLEMENTARY,
}

CIGAR = ArrayType(StructType([StructField("op", StringType()), StructField("len", IntegerType())]))
#: type is A, i, f, Z, H or B as in SAM text; value is the text after it.
AUX = ArrayType(StructType([StructField("tag", StringType()), StructField("type", StringType()), StructField("value", StringType())]))

ALIGNMENTS = StructType(
    [
        StructField("rank", LongType()),
        StructField("qname", StringType()),
        StructField("flag", IntegerType()),
        StructField("refid", IntegerType()),
        StructField("pos", IntegerType()),
        StructField("mapq", IntegerType()),
        StructField("cigar", CIGAR),
        StructField("mate_refid", IntegerType()),
        StructField("mate_pos", IntegerType()),
        StructField("tlen", IntegerType()),
        StructField("seq", StringType()),
        StructField("qual", StringType()),
        StructField("aux", AUX),
    ]
)


def parse_flags(names: str) -> int:
    """The bits of a comma-separated list of flag names ('' gives 0)."""
    bits = 0
    for name in filter(None, names.split(",")):
        if name not in FLAG_NAMES:
            raise ValueError(f"unknown flag {name}")
        bits |= FLAG_NAMES[name]
    return bits
