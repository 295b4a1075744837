"""Document fingerprints by winnowing.

k-gram hashes of a text's code points roll along; of each window of w hashes the smallest is
chosen, the rightmost of equals, and kept with its position. Any passage of w + k - 1 code points
that two texts share gives them a common hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.runtime import checkpointed, ship_code, text_batches
from readloom.llm.shingles import mix

GRAM, SPAN = 20, 60
#: Neighbours in the order of ids are found in blocks of about so many rows, then among the blocks'
#: ends within families, then among the families.
BLOCK_ROWS, FAMILIES = 2048, 64

_STEP = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 20


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hashes of all k-grams (a rolling polynomial, then mixed); a shorter text is one gram."""
    if len(codes) == 0:
        return np.zeros(0, np.uint64)
    gram = min(gram, len(codes))
    out = []
    n = len(codes) - gram + 1
    back = np.uint64(pow(_STEP, -1, 1 << 64))
    for at in range(0, n, PIECE):
        part = codes[at : min(at + PIECE, n) + gram - 1].astype(np.uint64) + np.uint64(1)
        up = np.full(len(part), _STEP, np.uint64)
        up[0] = 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * np.multiply.accumulate(up), out=total[1:])
        down = np.full(len(part) - gram + 1, back, np.uint64)
        down[0] = 1
        out.append(mix((total[gram:] - total[:-gram]) * np.multiply.accumulate(down)) >> np.uint64(32))
    return np.concatenate(out)


def winnow(hashes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions of the chosen hashes, ascending: each window's smallest, the rightmost of equals."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    span = min(span, n)
    # one number that orders by hash, then from the right
    key = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, span)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - span + 1], left[span - 1 : n])
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


class Fingerprint:
    """Chosen hashes of one text and where they stand."""

    def __init__(self, codes: np.ndarray, gram: int = GRAM, span: int = SPAN):
        hashes = gram_hashes(codes, gram)
        self.positions = winnow(hashes, span)
        self.hashes = hashes[self.positions]
        self.distinct = np.unique(self.hashes)

    def text(self) -> str:
        """'hash@position' in hexadecimal, in the order of the text."""
        return " ".join(f"{h:08x}@{p:x}" for h, p in zip(self.hashes.tolist(), self.positions.tolist()))

    def likeness(self, other: Fingerprint) -> float:
        """Jaccard similarity of the hash sets; two empty texts are alike."""
        a, b = len(self.distinct), len(other.distinct)
        if not a or not b:
            return float(a == b)
        both = len(np.intersect1d(self.distinct, other.distinct, assume_unique=True))
        return both / (a + b - both)


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def edited(own: np.ndarray, following: np.ndarray) -> np.ndarray:
    """own with its last half replaced by as much of the start of following (or all)."""
    half = len(own) // 2
    return np.concatenate([own[: len(own) - half], following[:half]])


def _fingerprints(gram: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole, "text"):
                rows = []
                for text, following in zip(batch.column("text").to_pylist(), batch.column("next_text").to_pylist()):
                    own, after = _codes(text), _codes(following)
                    changed = edited(own, after)
                    a, b, c = Fingerprint(own, gram, span), Fingerprint(changed, gram, span), Fingerprint(after, gram, span)
                    digest = hashlib.sha256(changed.tobytes().decode("utf-32-le").encode()).hexdigest()
                    rows.append((len(own), digest, a.text(), b.text(), a.likeness(b), a.likeness(c)))
                names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", *names])

    return run


def _blocks(rows: DataFrame) -> tuple[Column, Column]:
    """(family, block) of a row of rows (doc_id, h: 53 bits of the text's hash): numbers that rise in the order of descending ids, nulls last, then h.

    Families are ranges of ids between quantiles of the table; within one, blocks are equal stretches
    of ids. An id that several quantiles fall on, and rows without id, are cut into blocks by h.
    """
    shares = [k / FAMILIES for k in range(FAMILIES + 1)]
    stats = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.percentile_approx("doc_id", shares, 10_000).alias("bounds")).first()
    bounds = [] if stats.bounds is None else stats.bounds
    edges = sorted(set(bounds))
    stretch = max(1, -(-stats.ids // (FAMILIES * BLOCK_ROWS)))
    loose = max(1, -(-(stats.n - stats.ids) // BLOCK_ROWS))
    cuts = {e: stretch * bounds.count(e) for e in edges if bounds.count(e) > 1}
    most = max([loose, *cuts.values()])

    def leaf(k: int) -> Column:
        """Ids in (edges[k - 1], edges[k]]."""
        low, high = float(edges[k - 1]) if k else float(edges[0]), float(edges[k])
        place = F.floor((F.col("doc_id").cast("double") - low) * (stretch / (high - low))).cast("long") if high > low else F.lit(0).cast("long")
        back = F.lit(stretch - 1) - F.least(F.greatest(place, F.lit(0).cast("long")), F.lit(stretch - 1).cast("long"))
        return F.struct(F.lit(len(edges) - 1 - k).cast("long").alias("family"), back.cast("long").alias("sub"))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return leaf(low)
        middle = (low + high) // 2
        return F.when(F.col("doc_id") <= edges[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    none = F.struct(F.lit(len(edges)).cast("long").alias("family"), F.lit(0).cast("long").alias("sub"))
    where = F.when(F.col("doc_id").isNull(), none).otherwise(tree(0, len(edges) - 1)) if edges else none
    pieces = F.when(F.col("doc_id").isNull(), F.lit(loose))
    for e, n in cuts.items():
        pieces = pieces.when(F.col("doc_id") == e, F.lit(n))
    piece = F.floor(F.col("h") * pieces.otherwise(F.lit(1)) / F.lit(float(1 << 53))).cast("long")
    return where["family"], (where["family"] * stretch + where["sub"]) * most + piece


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by descending id, cyclically.

    A window finds the next text within a block of rows; only a block's last row looks into the next
    block, found among the blocks of its family, and a family's last one into the next family, of
    which there are some dozens at any size. Texts are shuffled once. Of equal ids, the lower hash of
    the text comes first; null ids come last. Repeats of one row are in one block.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 11))
    family, block = _blocks(rows)
    rows = rows.withColumns({"family": family, "block": block})
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.negate(F.coalesce("doc_id", F.lit(0)).cast("decimal(20,0)")).alias("back"), "h", "text")
    firsts = checkpointed(rows.groupBy("family", "block").agg(F.min(rank).alias("least")).select("family", "block", F.col("least.text").alias("first_text")))
    inner = Window.partitionBy("family").orderBy("block")
    near = firsts.select("family", "block", F.lead("block").over(inner).alias("then"))
    heads = [tuple(r) for r in firsts.groupBy("family").agg(F.min("block").alias("head")).orderBy("family").collect()]
    after_family = [(f, heads[(i + 1) % len(heads)][1]) for i, (f, _) in enumerate(heads)]
    wrap = docs.sparkSession.createDataFrame(after_family, "family long, then_head long")
    chain = near.join(F.broadcast(wrap), "family").select("block", F.coalesce("then", "then_head").alias("then"))
    after = checkpointed(chain.join(firsts.select(F.col("block").alias("then"), "first_text"), "then").select("block", "first_text"))
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), "h", "text")
    joined = rows.withColumn("next_text", F.lead("text").over(order)).join(after, "block", "left")
    return joined.select("doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text"))


def winnowing_fingerprints(docs: DataFrame, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of docs (doc_id, text; more are ignored).

    edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document by descending doc_id, cyclically. A text shorter than gram is one gram; null and
    empty texts have an empty fingerprint and are wholly alike (1.0), and wholly unlike others (0.0).
    A table of one row is its own next. Repeated rows come back as often as they came in.
    """
    ship_code(docs.sparkSession)
    return with_next_text(docs).mapInArrow(_fingerprints(gram, span), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
