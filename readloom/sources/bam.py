"""BAM: decoding and encoding by the public format specification, with zlib only."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import model as m

_BASES = "=ACMGRSVTWYHKDBN"
_CODE = {c: i for i, c in enumerate(_BASES)}
_OPS = "MIDNSHP=X"
_SCALARS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
BLOCK = 60_000
#: The empty block that ends a file.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def inflate(data: bytes) -> Iterator[bytes]:
    """The contents of the BGZF blocks of data, one after another."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        yield z.decompress(data[at:])
        at = len(data) - len(z.unused_data)
        if not z.eof:
            raise ValueError("the file is cut off")
        data, at = z.unused_data, 0


def deflate(data: bytes, level: int = 6) -> bytes:
    """data in BGZF blocks, without the end block."""
    out = []
    for i in range(0, len(data), BLOCK):
        part = data[i : i + BLOCK]
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def _tags(data: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(data):
        tag, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            size = struct.calcsize(_SCALARS[sub])
            values = struct.unpack_from(f"<{n}{_SCALARS[sub][1]}", data, at + 5)
            value, at = ",".join([sub, *map(str, values)]), at + 5 + n * size
        else:
            number = struct.unpack_from(_SCALARS[kind], data, at)[0]
            at += struct.calcsize(_SCALARS[kind])
            value, kind = (f"{number:g}", "f") if kind == "f" else (str(number), "i")
        out.append({"tag": tag, "type": kind, "value": value})
    return out


def _record(data: bytes) -> tuple:
    refid, pos, name_len, mapq, _bin, n_ops, flag, n_seq, mate_refid, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    name = data[at : at + name_len - 1].decode()
    at += name_len
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    packed = data[at : at + (n_seq + 1) // 2]
    at += (n_seq + 1) // 2
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq] or "*"
    qual = data[at : at + n_seq]
    at += n_seq
    text = "*" if not qual or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
    cigar = [{"op": _OPS[x & 15], "len": x >> 4} for x in ops]
    return name, flag, refid, pos, mapq, cigar, mate_refid, mate_pos, tlen, seq, text, _tags(data[at:])


def decode(content: bytes) -> tuple[list[tuple[str, int]], Iterator[tuple]]:
    """(references as (name, length), records) of one file."""
    blocks, buffer = inflate(content), b""

    def need(n: int) -> bool:
        nonlocal buffer
        while len(buffer) < n:
            more = next(blocks, None)
            if more is None:
                return False
            buffer += more
        return True

    def take(n: int) -> bytes:
        nonlocal buffer
        if not need(n):
            raise ValueError("the file is cut off")
        out, buffer = buffer[:n], buffer[n:]
        return out

    if take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    take(struct.unpack("<i", take(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        name = take(struct.unpack("<i", take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", take(4))[0]))

    def records() -> Iterator[tuple]:
        while need(4):
            yield _record(take(struct.unpack("<i", take(4))[0]))

    return refs, records()


def _bin_of(begin: int, end: int) -> int:
    """The smallest of the index's nested bins that holds [begin, end)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def _encode_tags(tags) -> bytes:
    out = []
    for t in tags:
        kind, value = t["type"], t["value"]
        head = t["tag"].encode()
        if kind in "ZH":
            out.append(head + kind.encode() + value.encode() + b"\0")
        elif kind == "A":
            out.append(head + b"A" + value.encode())
        elif kind == "B":
            sub, *values = value.split(",")
            numbers = [float(v) if sub == "f" else int(v) for v in values]
            out.append(head + b"B" + sub.encode() + struct.pack(f"<I{len(numbers)}{_SCALARS[sub][1]}", len(numbers), *numbers))
        elif kind == "f":
            out.append(head + b"f" + struct.pack("<f", float(value)))
        else:
            out.append(head + b"i" + struct.pack("<i", int(value)))
    return b"".join(out)


def encode_record(r) -> bytes:
    seq = "" if r.seq == "*" else r.seq
    codes = [_CODE.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    qual = bytes([255] * len(seq)) if r.qual == "*" else bytes(ord(c) - 33 for c in r.qual)
    span = sum(c["len"] for c in r.cigar if c["op"] in "MDN=X") or 1
    name = r.qname.encode() + b"\0"
    where = _bin_of(r.pos, r.pos + span) if r.pos >= 0 else 4680
    fixed = struct.pack("<iiBBHHHiiii", r.refid, r.pos, len(name), r.mapq, where, len(r.cigar), r.flag, len(seq), r.mate_refid, r.mate_pos, r.tlen)
    body = fixed + name + b"".join(struct.pack("<I", c["len"] << 4 | _OPS.index(c["op"])) for c in r.cigar) + packed + qual + _encode_tags(r.aux)
    return struct.pack("<i", len(body)) + body


def encode_header(refs: list[tuple[str, int]], order: str = "unknown") -> bytes:
    text = (f"@HD\tVN:1.6\tSO:{order}\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in refs)).encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    return out + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)


_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.ALIGNMENTS)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alignments, sq) of a BAM file or a folder of parts with one header.

    Files come through Spark's own reader, so any store does; each file (2 GB at most, as write()
    makes them) is one task. rank goes by the files' names, then by place.
    """
    files = spark.read.format("binaryFile").load(path)
    order = {r.path: i for i, r in enumerate(files.select("path").orderBy("path").collect())}
    first = files.orderBy("path").limit(1).select("content").first()
    refs, _ = decode(bytes(first.content))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"]):
                base, some = order[p] << 40, []
                for i, r in enumerate(decode(bytes(content))[1]):
                    some.append((base + i, *r))
                    if len(some) == 10_000:
                        yield pd.DataFrame(some, columns=m.ALIGNMENTS.names)
                        some = []
                yield pd.DataFrame(some, columns=m.ALIGNMENTS.names)

    sq = spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(refs)], "refid int, name string, length int")
    return files.select("path", "content").mapInPandas(rows, _SCHEMA), sq


def write(df: DataFrame, sq: DataFrame, folder: str, level: int = 6, order: str = "unknown", partitions: int | None = None) -> int:
    """One BAM file per partition of df sorted by rank, in a folder that all executors share; returns the number of rows."""
    refs = [(r["name"], r.length) for r in sq.orderBy("refid").collect()]
    os.makedirs(folder, exist_ok=True)
    header = encode_header(refs, order)
    dealt = df.repartitionByRange(partitions, "rank") if partitions else df.repartitionByRange("rank")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n, name = 0, os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.bam")
        with open(part := f"{name}.{os.getpid()}.part", "wb") as f:
            f.write(deflate(header, level))
            for frame in frames:
                n += len(frame)
                f.write(deflate(b"".join(encode_record(r) for r in frame.itertuples()), level))
            f.write(EOF_BLOCK)
        os.replace(part, name)  # whole or not at all
        yield pd.DataFrame({"n": [n]})

    return dealt.sortWithinPartitions("rank").mapInPandas(put, "n long").agg(F.sum("n")).first()[0]


def recompress(spark: SparkSession, source: str, folder: str, level: int) -> int:
    """The same rows with another compression level."""
    rows, sq = read(spark, source)
    return write(rows, sq, folder, level)
