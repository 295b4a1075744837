"""Training-order materialisation: fixed-length token sequences in a keyed pseudo-random global order.

Texts are packed one after another, each with an end token, and cut into sequences of equal length,
so that no record is padded but a task's last. Every sequence has an index (0 to N - 1, in the order
of the table) and a slot: a keyed Feistel permutation of the index, walked along its cycle until it
falls below N. Ranges of slots go to the partitions of one shuffle, which sort and write them as
shards of fixed-stride records. So record r of shard s is found by arithmetic alone, a reader goes
through a shard in sequence, and training resumes at any slot.

A folder of shards holds, besides shard-*.bin: manifest.json (key, sizes, counts), manifest (records and
CRC of each shard), parts (the first index of each part of the table) and documents (where each
document lies). The last three are Parquet, as they grow with the table.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.runtime import ship_code, text_batches, utf8_buffer
from readloom.llm.shingles import mix

#: Tokens of a sequence, sequences of a shard (17 MB of byte tokens).
SEQUENCE, SHARD = 1024, 1 << 14
#: A task sorts at most so many shards (2 GB of byte tokens, which Spark spills as it must).
RANGE_SHARDS = 128
KEY = 0x5EED
ROUNDS = 6
#: Byte tokens: the UTF-8 bytes, and 0xFF, which UTF-8 never uses, at the end of a text.
END = 0xFF


def token_type(end: int = END) -> np.dtype:
    """The narrowest unsigned type for tokens up to end, the highest one."""
    return np.dtype("<u1" if end < 1 << 8 else "<u2" if end < 1 << 16 else "<u4")


def record_type(sequence: int = SEQUENCE, end: int = END) -> np.dtype:
    """A record: index of the sequence, tokens used, then the tokens (the rest are end tokens)."""
    return np.dtype([("index", "<i8"), ("used", "<i8"), ("tokens", token_type(end).str, (sequence,))])


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, key: int, rounds) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in rounds:
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) % (1 << 64))
        left, right = right, left ^ (mix(right + salt) & mask)
    return (left << np.uint64(half)) | right


def slots_of(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots (a permutation of 0 .. n-1) of the given indices below n."""
    half = _half_bits(n)
    x = _feistel(index.astype(np.uint64), half, key, range(ROUNDS))
    while (out := x >= n).any():
        x[out] = _feistel(x[out], half, key, range(ROUNDS))
    return x.astype(np.int64)


def index_of(slots: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The inverse of slots_of."""
    half = _half_bits(n)
    swap = lambda v: ((v & np.uint64((1 << half) - 1)) << np.uint64(half)) | (v >> np.uint64(half))
    back = lambda v: swap(_feistel(swap(v), half, key, reversed(range(ROUNDS))))
    x = back(slots.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = back(x[out])
    return x.astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: part (the task's partition), doc_id, start (tokens before it in the part) and n of each document."""
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = start + np.cumsum(n)
        yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(ends - n), pa.array(n)], ["part", "doc_id", "start", "n"])
        start = int(ends[-1]) if len(n) else start


def _token_streams(batch: pa.RecordBatch, end: int) -> Iterator[np.ndarray]:
    """The tokens of a batch's documents, each with the end token behind it, in a few pieces."""
    if pa.types.is_list(batch.schema.field("tokens").type):
        col = batch.column("tokens")
        values, offsets = col.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(0 if v is None else v for v in col.value_lengths().to_pylist())])
        pieces = [(values, offsets)]
    else:
        pieces = (utf8_buffer(b.column("tokens")) for b in text_batches(batch, "tokens"))
    for values, offsets in pieces:
        n = len(offsets) - 1
        if len(values) and (values.min() < 0 or values.max() >= end):
            raise ValueError(f"tokens must lie below the end token, {end}")
        out = np.full(len(values) + n, end, token_type(end))
        inner = np.ones(len(out), bool)
        inner[offsets[1:] + np.arange(n)] = False
        out[inner] = values
        yield out


def _packed(starts, n: int, key: int, sequence: int, end: int):
    """Arrow function: slot and record of each sequence. starts: (first index, tokens) by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        index, want = starts.value.get(part, (0, 0))
        kind = record_type(sequence, end)
        seen, carry = 0, np.zeros(0, token_type(end))

        def records(tokens: np.ndarray, used: int) -> Iterator[pa.RecordBatch]:
            nonlocal index
            for at in range(0, len(tokens), 4096):
                rows = tokens[at : at + 4096]
                out = np.empty(len(rows), kind)
                out["index"], out["used"], out["tokens"] = np.arange(index, index + len(rows)), used, rows
                index += len(rows)
                offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(kind.itemsize))
                yield pa.record_batch([pa.array(slots_of(out["index"], n, key)), pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(out.tobytes())])], ["slot", "record"])

        for batch in batches:
            for tokens in _token_streams(batch, end):
                seen += len(tokens)
                if seen > want:
                    break
                stream = np.concatenate([carry, tokens]) if len(carry) else tokens
                whole = len(stream) // sequence * sequence
                yield from records(stream[:whole].reshape(-1, sequence), sequence)
                carry = stream[whole:].copy()
        if seen != want:
            raise ValueError(f"part {part} of the table has other rows than when its tokens were counted")
        if len(carry):
            yield from records(np.pad(carry, (0, sequence - len(carry)), constant_values=end)[None, :], len(carry))

    return run


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    folder = re.sub("^file:/+", "/", folder.rstrip("/"))
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def shard_name(number: int) -> str:
    return f"shard-{number:08d}.bin"


def _write_shards(folder: str, n: int, shard: int, stride: int):
    """Arrow function: writes whole shards from records that come in the order of slots; shard, records, crc32 of each. Holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        number, out, crc, done, name = -1, None, 0, 0, ""
        for batch in batches:
            slots, records = batch.column("slot").to_numpy(), batch.column("record")
            offsets = np.frombuffer(records.buffers()[1], np.int32)[records.offset :]
            data = records.buffers()[2]
            at = 0
            while at < len(slots):
                if out is None:
                    number, crc, done = int(slots[at]) // shard, 0, 0
                    # whole or not at all, so a task that is run again does no harm
                    name = f"{top}/{shard_name(number)}.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(name)
                first = number * shard + done
                size = min(shard, n - number * shard)
                take = min(len(slots) - at, size - done)
                if not np.array_equal(slots[at : at + take], np.arange(first, first + take)):
                    out.close()
                    raise ValueError(f"the slots of shard {number} have a gap or a repeat")
                some = data.slice(int(offsets[at]), take * stride)
                out.write(some)
                crc, done, at = zlib.crc32(some, crc), done + take, at + take
                if done == size:
                    out.close()
                    store.move(name, f"{top}/{shard_name(number)}")
                    yield pa.record_batch([pa.array([number]), pa.array([size]), pa.array([crc])], ["shard", "records", "crc32"])
                    out = None
        if out is not None:
            out.close()
            raise ValueError(f"shard {number} has {done} records only")

    return run


def write_training_order(docs: DataFrame, folder: str, key: int = KEY, sequence: int = SEQUENCE, shard: int = SHARD, ids: str | None = None, end: int = END) -> dict:
    """Writes docs (doc_id, text; more columns are ignored) to folder in training order and returns the manifest.

    folder: a path or URI that all executors share. Tokens are the UTF-8 bytes of text, and END; or,
    with ids (the name of a column array<int>), those ids and end, which must be above all of them.
    Null and empty texts have an end token only; null ids stay null in the table of documents.
    Repeated rows are documents of their own. An empty table gives a manifest without shards.

    docs is read twice and must give the same partitions both times, as files and checkpoints do; a
    part whose tokens differ from their count raises. The order is that of the table as it is read, so
    the same files, split alike, give the same shards. All tables on the driver go by partitions.
    """
    spark = docs.sparkSession
    ship_code(spark)
    store, top = _store(folder)
    store.create_dir(top)
    tokens = F.col(f"`{ids}`") if ids else F.coalesce("text", F.lit(""))
    size = (F.coalesce(F.size(tokens), F.lit(0)) if ids else F.octet_length(tokens)).cast("long") + 1
    if ids:
        size = F.greatest(size, F.lit(1))
    docs.select("doc_id", size.alias("n")).mapInArrow(_places, "part int, doc_id long, start long, n long").write.parquet(f"{folder}/documents")
    totals = spark.read.parquet(f"{folder}/documents").groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("tokens")).collect()
    starts, n = {}, 0
    for r in sorted(totals):
        starts[r.part] = (n, r.tokens)
        n += -(-r.tokens // sequence)
    spark.createDataFrame([(p, first, t) for p, (first, t) in starts.items()], "part int, first long, tokens long").coalesce(1).write.parquet(f"{folder}/parts")

    known = spark.sparkContext.broadcast(starts)
    packed = docs.select(tokens.alias("tokens")).mapInArrow(_packed(known, n, key, sequence, end), "slot long, record binary")
    n_shards = -(-n // shard)
    per_range = max(1, min(RANGE_SHARDS, n_shards // (4 * spark.sparkContext.defaultParallelism)))
    ranges = max(1, -(-n_shards // per_range))
    dealt = packed.repartitionById(ranges, F.floor(F.col("slot") / (shard * per_range)).cast("int")).sortWithinPartitions("slot")
    stride = record_type(sequence, end).itemsize
    dealt.mapInArrow(_write_shards(folder, n, shard, stride), "shard long, records long, crc32 long").write.parquet(f"{folder}/manifest")
    manifest = {"key": key, "sequence": sequence, "shard": shard, "stride": stride, "end": end, "total": n}
    with store.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    store, top = _store(folder)
    with store.open_input_stream(f"{top}/manifest.json") as f:
        return json.loads(f.read())


def records_from(folder: str, slot: int = 0, batch: int = 256) -> Iterator[np.ndarray]:
    """The records from a slot on, in batches, read in sequence: how training resumes."""
    manifest = read_manifest(folder)
    store, top = _store(folder)
    kind = record_type(manifest["sequence"], manifest["end"])
    while slot < manifest["total"]:
        number, at = divmod(slot, manifest["shard"])
        with store.open_input_file(f"{top}/{shard_name(number)}") as f:
            f.seek(at * kind.itemsize)
            while some := f.read(batch * kind.itemsize):
                rows = np.frombuffer(some, kind)
                slot += len(rows)
                yield rows


def fresh_folder(spark: SparkSession) -> str:
    """A new folder, as a URI, under the session's checkpoint folder, which all executors share; under a temporary one where that is unset and the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="readloom-shards-")
    store, top = _store(shared)
    name = f"training-shards-{uuid.uuid4().hex}"
    store.create_dir(f"{top}/{name}")
    return f"{shared.rstrip('/')}/{name}"


def _read_shards(folder: str, manifest: dict, batch: int = 1 << 10):
    """Arrow function: what the shards whose numbers come in hold, read from the files in sequence."""
    kind, shard = record_type(manifest["sequence"], manifest["end"]), manifest["shard"]

    def described(rows: np.ndarray, number: int, first: int) -> pa.RecordBatch:
        place = np.arange(first, first + len(rows), dtype=np.int64)
        crc = [zlib.crc32(t[:u]) for t, u in zip(rows["tokens"], rows["used"].tolist())]
        return pa.record_batch(
            [pa.array(place + number * shard), pa.array(np.full(len(rows), number, np.int64)), pa.array(place * rows.itemsize), pa.array(rows["index"]), pa.array(rows["used"]), pa.array(crc, pa.int64())],
            ["slot", "shard", "byte_offset", "index", "n_tokens", "tokens_crc32"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for numbers in batches:
            for number, want, crc in zip(*(numbers.column(c).to_pylist() for c in ("shard", "records", "crc32"))):
                at, found = 0, 0
                with store.open_input_stream(f"{top}/{shard_name(number)}") as f:
                    while some := f.read(batch * kind.itemsize):
                        found = zlib.crc32(some, found)
                        rows = np.frombuffer(some, kind)
                        yield described(rows, number, at)
                        at += len(rows)
                if at != want or found != crc:
                    raise ValueError(f"{shard_name(number)} is not the file of the manifest")

    return run


def written_contents(spark: SparkSession, folder: str) -> DataFrame:
    """slot, shard, byte_offset, index, n_tokens, tokens_crc32, doc_ids of each record of a folder.

    Each file is read in sequence and held against the manifest's counts and CRCs. doc_ids: the
    documents that the record holds some of, in order (at most one for each token; ids may be null).
    """
    ship_code(spark)
    manifest = read_manifest(folder)
    table = spark.read.parquet(f"{folder}/manifest")
    parts = max(1, min(-(-manifest["total"] // manifest["shard"]), 4 * spark.sparkContext.defaultParallelism))
    schema = "slot long, shard long, byte_offset long, index long, n_tokens long, tokens_crc32 long"
    records = table.repartition(parts).mapInArrow(_read_shards(folder, manifest), schema)
    long = F.lit(manifest["sequence"])
    docs = spark.read.parquet(f"{folder}/documents").join(spark.read.parquet(f"{folder}/parts").select("part", "first"), "part")
    low, high = F.floor(F.col("start") / long), F.floor((F.col("start") + F.col("n") - 1) / long)
    held = docs.select("doc_id", "start", F.explode(F.sequence(F.col("first") + low, F.col("first") + high)).alias("index"))
    lists = held.groupBy("index").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    # the planner takes records to be as small as the manifest, so it must be kept from broadcasting them
    return records.hint("merge").join(lists, "index").select("slot", "shard", "byte_offset", "index", "n_tokens", "tokens_crc32", "doc_ids")
