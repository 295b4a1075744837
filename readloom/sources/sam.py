"""SAM text: reading lines into the row model, writing rows as lines."""

from __future__ import annotations

import hashlib
import os
from graphlib import CycleError, TopologicalSorter

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import model as m
from readloom.functions import aux, cigar, flags


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """refid, name, length of the @SQ lines, in their order in the file. A header has a bounded number of lines."""
    rows = [r.value for r in spark.read.text(path).where(F.col("value").startswith("@SQ\t")).collect()]
    fields = [dict(f.split(":", 1) for f in r.split("\t")[1:]) for r in rows]
    return spark.createDataFrame([(i, f["SN"], int(f["LN"])) for i, f in enumerate(fields)], "refid int, name string, length int")


def parse_lines(lines: DataFrame, sq: DataFrame) -> DataFrame:
    """value lines as rows of the model, without rank. Lines that don't parse give a row with a null flag."""
    f = F.split("value", "\t")
    number = lambda i: F.get(f, F.lit(i)).try_cast("int")
    tags = F.transform(F.slice(f, 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.substring(t, 4, 1).alias("type"), t.substr(F.lit(6), F.length(t)).alias("value")))
    rows = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        F.get(f, F.lit(0)).alias("qname"), number(1).alias("flag"), F.get(f, F.lit(2)).alias("_r"), (number(3) - 1).alias("pos"), number(4).alias("mapq"),
        cigar.parse(F.coalesce(F.get(f, F.lit(5)), F.lit("*"))).alias("cigar"), F.get(f, F.lit(6)).alias("_m"), (number(7) - 1).alias("mate_pos"), number(8).alias("tlen"),
        F.get(f, F.lit(9)).alias("seq"), F.get(f, F.lit(10)).alias("qual"), tags.alias("aux"),
    )
    rows = rows.withColumn("_m", F.when(F.col("_m") == "=", F.col("_r")).otherwise(F.col("_m")))
    ids = sq.select("refid", "name")
    out = rows.join(ids.select(F.col("name").alias("_r"), "refid"), "_r", "left").join(ids.select(F.col("name").alias("_m"), F.col("refid").alias("mate_refid")), "_m", "left")
    minus = F.lit(-1)
    return out.withColumns({"refid": F.coalesce("refid", minus), "mate_refid": F.coalesce("mate_refid", minus)}).select([c for c in m.ALIGNMENTS.names if c != "rank"])


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alignments, sq). rank orders rows by file and place: it is unique and ascending, not gapless."""
    sq = read_header(spark, path)
    lines = spark.read.text(path).withColumn("rank", F.monotonically_increasing_id())
    return _with_rank(lines.select("rank", "value"), sq), sq


def _with_rank(ranked: DataFrame, sq: DataFrame) -> DataFrame:
    """parse_lines with the rank carried through as a last tag."""
    marked = ranked.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.concat("value", F.lit("\tzr:i:"), F.col("rank").cast("string")).alias("value"))
    rows = parse_lines(marked, sq)
    return rows.withColumn("rank", aux.value(F.col("aux"), "zr").cast("long")).withColumn("aux", F.slice("aux", F.lit(1), F.size("aux") - 1)).select(m.ALIGNMENTS.names)


def to_lines(df: DataFrame, sq: DataFrame) -> DataFrame:
    """rank and value, the SAM line of each row."""
    ids = sq.select("refid", "name")
    rows = df.join(ids.select("refid", F.col("name").alias("_r")), "refid", "left").join(ids.select(F.col("refid").alias("mate_refid"), F.col("name").alias("_m")), "mate_refid", "left")
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    mate = F.when(F.col("_m").isNotNull() & (F.col("_m") == F.col("_r")), "=").otherwise(star("_m"))
    text = lambda c: c.cast("string")
    fixed = [F.col("qname"), text(F.col("flag")), star("_r"), text(F.col("pos") + 1), text(F.col("mapq")), cigar.to_text(F.col("cigar")), mate, text(F.col("mate_pos") + 1), text(F.col("tlen")), F.col("seq"), F.col("qual")]
    line = F.concat_ws("\t", *fixed)
    return rows.select("rank", F.when(F.size("aux") > 0, F.concat(line, F.lit("\t"), aux.to_text(F.col("aux"), "\t"))).otherwise(line).alias("value"))


def write(df: DataFrame, sq: DataFrame, path: str, order: str = "unknown") -> None:
    """A folder of text parts in the order of rank; the first part holds the header."""
    head = sq.select((F.col("refid").cast("long") - (1 << 40)).alias("rank"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    first = df.sparkSession.range(1).select(F.lit(-(1 << 41)).cast("long").alias("rank"), F.lit(f"@HD\tVN:1.6\tSO:{order}").alias("value"))
    first.unionByName(head).unionByName(to_lines(df, sq)).orderBy("rank").select("value").write.text(path)


def valid_lines(lines: DataFrame, sq: DataFrame) -> DataFrame:
    """Lines (value) that parse and, if mapped, end within their reference; headers stay."""
    f = F.split("value", "\t")
    head = F.col("value").startswith("@")
    kept = lines.withColumns({"_name": F.get(f, F.lit(2)), "_head": head}).join(sq.select(F.col("name").alias("_name"), "length"), "_name", "left")
    flag, pos = F.get(f, F.lit(1)).try_cast("int"), F.get(f, F.lit(3)).try_cast("int")
    ops, seq, qual = F.get(f, F.lit(5)), F.get(f, F.lit(9)), F.get(f, F.lit(10))
    c = cigar.parse(ops)
    shape = (F.size(f) >= 11) & flag.isNotNull() & pos.isNotNull() & ops.rlike(r"^(\*|(\d+[MIDNSHP=X])+)$") & seq.rlike(r"^(\*|[A-Za-z=.]+)$") & ((qual == "*") | (F.length(qual) == F.length(seq)))
    unmapped = flags.has(m.UNMAPPED, flag)
    inside = unmapped | (F.col("length").isNotNull() & (pos - 1 + cigar.reference_length(c) <= F.col("length")))
    return kept.where(F.col("_head") | F.coalesce(shape & inside, F.lit(False))).select("value")


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """gene, name, refname, from, to of a tab-separated file (plain or gz) of six columns or more; others go."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 6)
    return rows.select(f[0].alias("gene"), f[1].alias("name"), f[2].alias("refname"), f[4].try_cast("long").alias("from"), f[5].try_cast("long").alias("to")).where("`from` is not null and `to` is not null")


def name_list(spark: SparkSession, path: str, column: str = "qname") -> DataFrame:
    """One name a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias(column)).where(F.col(column) != "")


def rename_table(spark: SparkSession, path: str) -> DataFrame:
    """old, new of a two-column tab-separated file."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 2).select(f[0].alias("old"), f[1].alias("new"))


def reset_header(lines: DataFrame, text: str | None = None) -> DataFrame:
    """Lines (value) with the header of reads whose mapping is taken back: without @SQ lines, or text in the place of all header lines."""
    head = F.col("value").startswith("@")
    if text is None:
        return lines.where(~F.col("value").startswith("@SQ\t"))
    new = lines.sparkSession.createDataFrame([(x,) for x in text.splitlines()], "value string")
    return new.unionByName(lines.where(~head).select("value"))


def united_header(headers: list[str]) -> tuple[str, list[dict[str, dict[str, str]]]]:
    """(header, renamed) of several headers: renamed holds for each its new ids, as {"RG": {old: new}, "PG": ...}.

    References are united by name; one name with two lengths, or two names in two orders, is an
    error. Equal @RG and @PG lines are united; another line of a used id gets the id with a number
    behind it, and PP follows. Other lines come once each; the first header's @HD stands.
    """
    parsed = [[line.split("\t") for line in text.splitlines() if line] for text in headers]
    field = lambda line, key: next((f[len(key) + 1 :] for f in line[1:] if f.startswith(f"{key}:")), None)
    lengths: dict[str, str] = {}
    lines: dict[str, list[str]] = {}
    after: dict[str, set[str]] = {}
    for head in parsed:
        names = [field(line, "SN") for line in head if line[0] == "@SQ"]
        for before, name in zip(names, names[1:], strict=False):
            after.setdefault(before, set()).add(name)
        for line in head:
            if line[0] == "@SQ" and lengths.setdefault(field(line, "SN"), field(line, "LN")) != field(line, "LN"):
                raise ValueError(f"two lengths of reference {field(line, 'SN')}")
            if line[0] == "@SQ":
                lines.setdefault(field(line, "SN"), line)
    try:
        # sorted by what must come before; the order of first use decides the rest
        place = {name: i for i, name in enumerate(lines)}
        sorter = TopologicalSorter({name: {b for b, later in after.items() if name in later} for name in lines})
        sorter.prepare()
        references: list[str] = []
        ready = list(sorter.get_ready())
        while ready:
            ready.sort(key=place.get)
            references.append(ready.pop(0))
            sorter.done(references[-1])
            ready += sorter.get_ready()
    except CycleError as e:
        raise ValueError(f"references in two orders: {', '.join(e.args[1])}") from e
    top = next((line for head in parsed for line in head if line[0] == "@HD"), None)
    out = [top] if top else []
    out += [lines[name] for name in references]
    used: dict[str, dict[str, list[str]]] = {"RG": {}, "PG": {}}
    renamed: list[dict[str, dict[str, str]]] = []
    rest: list[list[str]] = []
    for head in parsed:
        new: dict[str, dict[str, str]] = {"RG": {}, "PG": {}}
        # a program's line names an earlier one, which may stand behind it
        for line in sorted((x for x in head if x[0] in ("@RG", "@PG")), key=lambda x, h=head: _depth(x, h)):
            kind, own = line[0][1:], field(line, "ID")
            moved = [f"PP:{new['PG'].get(f[3:], f[3:])}" if kind == "PG" and f.startswith("PP:") else f for f in line]
            name, i = own, 0
            with_id = lambda n, fields=moved: [f"ID:{n}" if f.startswith("ID:") else f for f in fields]
            while name in used[kind] and used[kind][name] != with_id(name):
                i += 1
                name = f"{own}.{i}"
            used[kind][name] = with_id(name)
            new[kind][own] = name
        renamed.append(new)
        rest += [line for line in head if line[0] not in ("@HD", "@SQ", "@RG", "@PG") and line not in rest]
    out += [*used["RG"].values(), *used["PG"].values(), *rest]
    return "".join("\t".join(line) + "\n" for line in out), renamed


def _depth(line: list[str], head: list[list[str]]) -> int:
    """How many programs of head ran before that of line."""
    before = {f[3:]: p[3:] for x in head if x[0] == "@PG" for f in x if f.startswith("ID:") for p in x if p.startswith("PP:")}
    at, n = next((f[3:] for f in line if f.startswith("ID:")), ""), 0
    while line[0] == "@PG" and at in before and n <= len(head):
        at, n = before[at], n + 1
    return n


def digest(folder: str, algorithm: str = "md5") -> str:
    """Hexadecimal digest of the bytes of a written folder (or one file), its parts in the order of their names. Read in pieces on the driver, as such a digest takes its bytes in one run."""
    store, top = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
    info = store.get_file_info(top)
    parts = [top] if info.is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(top)) if f.is_file and not f.base_name.startswith(("_", ".")))
    h = hashlib.new(algorithm)
    for part in parts:
        with store.open_input_stream(part) as f:
            while some := f.read(1 << 20):
                h.update(some)
    return h.hexdigest()
