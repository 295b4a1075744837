"""Session plumbing shared by the text operators: checkpoints, code shipping, bounded bitmaps, memory of workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; longer texts are cut at white space.
SEGMENT_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, free: bool = False) -> DataFrame:
    """Write df once into the cluster's shared checkpoint folder and cut its lineage there.

    The folder is the session's spark.checkpoint.dir; only in a local session a temporary folder
    stands in where that is unset. free: the plan so far has shuffled much, whose files Spark deletes
    only when the driver has collected the plan as garbage, so this is done now.
    """
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="readloom-checkpoint-"))
    out = df.checkpoint(eager=True)
    if free:
        del df
        gc.collect()
        sc._jvm.System.gc()
    return out


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_readloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="readloom-code-")) / "readloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join("readloom", p.relative_to(root)))
    sc.addPyFile(str(target))
    sc._readloom_shipped = True


def release_memory() -> None:
    """Give what this process has freed back to the system, as Spark reuses its Python workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_batches(batch: pa.RecordBatch, text_field: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batch with at most limit bytes of text each (or one row), so that memory stays bounded."""
    col = batch.column(batch.schema.get_field_index(text_field))
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bits of a membership bitmap: 2^25 bits are 4 MB whatever the input.
BITMAP_BITS = 25


def key_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size with the low bits of all keys (hashes): a filter without false negatives.

    A full bitmap lets everything pass, so whoever uses it follows with an exact join.
    """
    slot = F.pmod(F.col(column), F.lit(1 << BITMAP_BITS))
    words = (
        keys.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 15).alias("page"))
        .agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(1 << 15))).alias("bits"))
    )
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    # at most 1024 pages of 4 KB, in one job
    for row in words.collect():
        out[row.page << 12 : (row.page + 1) << 12] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def bitmap_has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit hashes) may be in the bitmap."""
    slot = keys.astype(np.int64) & ((1 << BITMAP_BITS) - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
