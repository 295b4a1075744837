"""FASTQ and FASTA: reading, conversion to and from rows, writing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom import model as m
from readloom.functions import aux, flags, names, sequences
from readloom.operators.pairs import classified


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """place, name (the whole name line), seq, qual of records of four lines; plain or gz, one file or many.

    A line's number in its file is the count of lines in the splits before its own, and its place in
    it; so records are told by numbers and never by what a line looks like. Those that lie wholly in
    a split are put together as they stream by, and only the few that a split's border cuts are
    shuffled. place: number of the file, in the order of paths, and of the record in it. Empty lines
    at the end of a file don't count; a record that lacks lines raises.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.max(F.when(F.col("value") != "", F.col("id"))).alias("last"), F.count("*").alias("n")).collect()
    # one row a split
    numbers = {f: i for i, f in enumerate(sorted({r.file for r in splits}))}
    table, before, full = [], {}, {}
    for r in sorted(splits, key=lambda r: (r.file, r.block)):
        start = before.get(r.file, 0)
        table.append((r.file, r.block, numbers[r.file], r.first, start, start + r.n))
        before[r.file] = start + r.n
        if r.last is not None:
            full[r.file] = start + r.last - r.first + 1
    if short := [f for f, n in full.items() if n % 4 and n + 1 < before[f] // 4 * 4 or n % 4 in (1, 2)]:
        raise ValueError(f"the last record of {short[0]} lacks lines")
    known = spark.createDataFrame([(*row, -(-full.get(row[0], 0) // 4) * 4) for row in table], "file string, block long, number int, first long, start long, end long, stop long")
    n = F.col("start") + F.col("id") - F.col("first")
    placed = lines.join(F.broadcast(known), ["file", "block"]).withColumn("n", n).where(F.col("n") < F.col("stop"))
    low, high = F.ceil(F.col("start") / 4) * 4, F.floor(F.col("end") / 4) * 4
    inner = (F.col("n") >= low) & (F.col("n") < high)
    place = F.shiftleft(F.col("number").cast("long"), 40) + F.floor(F.col("n") / 4)
    whole = placed.where(inner).select(place.alias("place"), "value").mapInArrow(_four_lines, "place long, name string, seq string, qual string")
    line = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    cut = placed.where(~inner).groupBy(place.alias("place")).agg(line(0).alias("name"), line(1).alias("seq"), F.coalesce(line(3), F.lit("")).alias("qual"))
    rows = whole.unionByName(cut)
    name = F.when(F.col("name").startswith("@"), F.col("name").substr(F.lit(2), F.length("name"))).otherwise(F.raise_error(F.concat(F.lit("not a name line: "), F.col("name"))))
    return rows.select("place", name.alias("name"), "seq", "qual")


def _four_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, four rows (place, value) each, one after another."""
    carry = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if carry is None else [carry, batch]).combine_chunks()
        k = rows.num_rows // 4 * 4
        at = lambda line: pa.array(range(line, k, 4))  # noqa: E731, B023
        place, value = rows.column("place").chunk(0), rows.column("value").chunk(0)
        if k:
            yield pa.record_batch([place.take(at(0)), *(value.take(at(line)) for line in (0, 1, 3))], ["place", "name", "seq", "qual"])
        rest = rows.slice(k).combine_chunks().to_batches()
        carry = rest[0] if rest else None


def to_alignments(records: DataFrame, scheme: str = "generic", group: str | None = None, offset: int = 33, highest: int = 41, mate: int | None = None) -> DataFrame:
    """Unmapped rows of FASTQ records (place, name, seq, qual): bases upper case, '.' becomes N.

    mate: the file is that of read 1 or 2 (two files, pairedfiles). Rows with qualities outside
    0 to highest, or whose names break the scheme, raise an error.
    """
    n = names.fastq_name(F.col("name"), scheme)
    rows = records.withColumn("_n", n).withColumn("_f", F.lit(mate) if mate else F.col("_n.fragment"))
    good = F.col("_f").isNotNull() & (F.length("seq") == F.length("qual")) & ~F.exists(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: ~F.ascii(c).between(offset, offset + highest))
    name = F.when(good, F.col("_n.name")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), F.coalesce("name", F.lit("")))))
    flag = F.when(F.col("_f") == 1, m.PAIRED | m.UNMAPPED | m.MATE_UNMAPPED | m.READ1).when(F.col("_f") == 2, m.PAIRED | m.UNMAPPED | m.MATE_UNMAPPED | m.READ2).otherwise(m.UNMAPPED)
    none = F.lit(-1)
    tags = F.array(F.struct(F.lit("RG").alias("tag"), F.lit("Z").alias("type"), F.lit(group).alias("value"))) if group else F.array()
    shifted = F.col("qual") if offset == 33 else F.array_join(F.transform(F.split("qual", ""), lambda c: F.when(c != "", F.char(F.ascii(c) - (offset - 33))).otherwise("")), "")
    return rows.select(
        F.col("place").alias("rank"), name.alias("qname"), flag.alias("flag"), none.alias("refid"), none.alias("pos"), F.lit(0).alias("mapq"), F.array().cast(m.CIGAR).alias("cigar"),
        none.alias("mate_refid"), none.alias("mate_pos"), F.lit(0).alias("tlen"), F.translate(F.upper("seq"), ".", "N").alias("seq"), shifted.alias("qual"), tags.cast(m.AUX).alias("aux"),
    )


def from_alignments(df: DataFrame, exclude: str = "SECONDARY,SUPPLEMENTARY", original_qualities: bool = False, ranks: bool = False, tags: tuple[str, ...] = (), fasta: bool = False) -> DataFrame:
    """class (F, F2, O, O2, S), rg, qname and record of each row: its text in FASTQ or FASTA, in the machine's orientation."""
    rows = classified(df.where(flags.lacks(m.parse_flags(exclude))))
    back = flags.has(m.REVERSE)
    seq = F.when(back, sequences.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    stored = F.coalesce(aux.value(F.col("aux"), "OQ"), F.col("qual")) if original_qualities else F.col("qual")
    qual = F.when(back, F.reverse(stored)).otherwise(stored)
    number = F.when(F.col("class").isin("F", "O"), "/1").when(F.col("class").isin("F2", "O2"), "/2").otherwise("")
    name = F.col("qname")
    if ranks:
        w = Window.partitionBy("qname")
        of = lambda k: F.min(F.when(F.col("class") == k, F.col("rank"))).over(w)
        both = F.col("class").isin("F", "F2")
        a, b = F.when(both, of("F")).otherwise(F.col("rank")), F.when(both, of("F2")).otherwise(F.col("rank"))
        rows = rows.withColumn("_ranked", F.concat_ws("_", a.cast("string"), b.cast("string"), "qname"))
        name = F.col("_ranked")
    note = reduce(F.concat, [F.when(aux.value(F.col("aux"), t).isNotNull(), F.concat(F.lit(f" {t}:"), aux.value(F.col("aux"), t))).otherwise("") for t in tags], F.lit(""))
    head = F.concat(F.lit(">" if fasta else "@"), name, number, note)
    record = F.concat_ws("\n", head, seq) if fasta else F.concat_ws("\n", head, seq, F.lit("+"), qual)
    return rows.select("rank", "class", F.coalesce(aux.value(F.col("aux"), "RG"), F.lit("")).alias("rg"), "qname", record.alias("record"))


def write_fastq(records: DataFrame, path: str, by_group: bool = False, per_file: int = 0, gz: bool = False) -> None:
    """One folder per class (and read group), files of at most per_file records."""
    by = ["rg", "class"] if by_group else ["class"]
    out = records.select(*by, F.col("record").alias("value")).write.partitionBy(*by).option("compression", "gzip" if gz else "none")
    (out.option("maxRecordsPerFile", per_file) if per_file else out).text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """place, id (first token), descr (the rest), seq without line ends."""
    parts = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "^>", "").alias("v"))
    head = F.regexp_extract("v", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.expr("substr(v, length(regexp_extract(v, '^([^\\n]*)', 1)) + 1)"), r"\s", "")
    return parts.where(F.trim("v") != "").select("place", names.cut_at_space(head).alias("id"), F.trim(F.regexp_replace(head, r"^\s*\S+", "")).alias("descr"), body.alias("seq"))


def wrapped(seq, columns: int = 80):
    """Sequence text in lines of that many characters."""
    return F.array_join(F.regexp_extract_all(seq, F.lit("(?s).{1," + str(columns) + "}"), F.lit(0)), "\n")


def normalised_fasta(records: DataFrame, columns: int = 80, upper: bool = False, shortest: int = 0, replace_seed: int | None = None) -> DataFrame:
    """place, id, record: rewrapped, without sequences shorter than shortest; replace_seed: other letters than ACGT become random ones, by place and position, so reruns agree."""
    seq = F.upper("seq") if upper else F.col("seq")
    rows = records.where(F.length("seq") >= shortest).withColumn("seq", seq)
    if replace_seed is not None:
        letters = F.split("seq", "")
        pick = lambda c, i: F.when(c.rlike("^([ACGTacgt]|)$"), c).otherwise(F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64("place", i, F.lit(replace_seed)), F.lit(4)) + 1).cast("int"), F.lit(1)))
        rows = rows.withColumn("seq", F.array_join(F.transform(letters, pick), ""))
    head = F.concat(F.lit(">"), "id", F.when(F.col("descr") != "", F.concat(F.lit(" "), "descr")).otherwise(""))
    return rows.select("place", "id", "seq", F.concat(head, F.lit("\n"), wrapped(F.col("seq"), columns)).alias("record"))


def fasta_index(records: DataFrame, columns: int = 80) -> DataFrame:
    """id, length, offset, bases per line, bytes per line of normalised records in the order of place. A reference's index has a bounded number of rows."""
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("record") + 1).over(w), F.lit(0))
    n = F.length("seq")
    return records.select("id", n.alias("length"), (before + F.length(F.regexp_extract("record", r"^([^\n]*)", 1)) + 1).alias("offset"), F.least(n, F.lit(columns)).alias("line_bases"), (F.least(n, F.lit(columns)) + 1).alias("line_bytes"))


def exploded_fasta(records: DataFrame, prefix: str = "fasta_", columns: int = 80) -> DataFrame:
    """file, id, record: each sequence's own file, upper case, numbered by place."""
    number = F.row_number().over(Window.orderBy("place")) - 1
    rows = records.withColumn("file", F.format_string(f"{prefix}%06d.fasta", number))
    return rows.select("file", "id", F.concat(F.lit(">"), "id", F.lit("\n"), wrapped(F.upper("seq"), columns)).alias("record"))
