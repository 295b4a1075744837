"""MurmurHash3 (x64, 128 bits) of strings, for whole columns of an Arrow batch at a time."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def murmur3(text: Column, seed: int = 0) -> Column:
    """Both 64-bit halves as 32 hexadecimal digits, the first half first; null for null.

    Texts of one length are hashed together, block by block, in numpy.
    """

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def last_mix(x: np.ndarray) -> np.ndarray:
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))

    def of_length(texts: list[bytes], n: int) -> list[str]:
        c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
        padded = np.zeros((len(texts), n // 16 * 16 + 16), np.uint8)
        if n:
            padded[:, :n] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), n)
        words = padded.view("<u8").astype(np.uint64)
        h1 = h2 = np.full(len(texts), seed, np.uint64)
        for b in range(n // 16 + 1):
            k1, k2 = turn(words[:, 2 * b] * c1, 31) * c2, turn(words[:, 2 * b + 1] * c2, 33) * c1
            if b == n // 16:  # the rest, padded with zeros
                h1, h2 = h1 ^ k1, h2 ^ k2
            else:
                h1 = (turn(h1 ^ k1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
                h2 = (turn(h2 ^ k2, 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
        h1, h2 = h1 ^ np.uint64(n), h2 ^ np.uint64(n)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = last_mix(h1), last_mix(h2)
        h1 = h1 + h2
        h2 = h2 + h1
        return [f"{a:016x}{b:016x}" for a, b in zip(h1.tolist(), h2.tolist(), strict=True)]

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        places = defaultdict(list)
        data = [None if t is None else t.encode() for t in texts]
        for i, t in enumerate(data):
            if t is not None:
                places[len(t)].append(i)
        out: list[str | None] = [None] * len(data)
        for n, at in places.items():
            for i, h in zip(at, of_length([data[i] for i in at], n), strict=True):
                out[i] = h
        return pd.Series(out, dtype=object)

    return hashed(text)


def folded(digest: Column) -> Column:
    """The four 32-bit words of a 128-bit digest, each xor-ed into one."""
    word = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    return word(0).bitwiseXOR(word(1)).bitwiseXOR(word(2)).bitwiseXOR(word(3))
