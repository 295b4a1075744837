"""Vectorised word and shingle hashes over whole Arrow text columns (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np

from readloom.llm.runtime import SEGMENT_BYTES

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_JOIN = 0xD6E8FEB86659FD93
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z lower-cased, plus one so that a NUL byte counts too.
_VALUE = np.arange(256, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_VALUE += np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT_BYTES + 4096), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= SEGMENT_BYTES + 4096:
            _powers[str(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _segments(raw: np.ndarray, offsets: np.ndarray):
    """Spans of about SEGMENT_BYTES which end at a text's end or before white space, so no word is cut."""
    at, end = 0, len(raw)
    while at < end:
        to = min(at + SEGMENT_BYTES, end)
        if to < end:
            k = np.searchsorted(offsets, to)
            bound = int(offsets[k])
            while to < bound and not _GAP[raw[to]]:
                step = raw[to : min(to + 65536, bound)]
                gap = np.flatnonzero(_GAP[step])
                to += int(gap[0]) if len(gap) else len(step)
        yield at, to
        at = to


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word): words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased."""
    starts, hashes = [], []
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(raw))])
    for at, to in _segments(raw, offsets):
        seg = raw[at:to]
        word = ~_GAP[seg]
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        closes = word.copy()
        closes[:-1] &= ~word[1:]
        cuts = inner[(inner > at) & (inner < to)] - at
        opens[cuts] = word[cuts]
        closes[cuts - 1] = word[cuts - 1]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if len(s):
            total = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(_VALUE[seg] * _power(_BASE, len(seg)), out=total[1:])
            h = (total[e] - total[s]) * _power(_INVERSE, len(seg))[s]
            hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(_JOIN)))
            starts.append(s + at)
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of 1 to width-1 words is one shingle, no words none."""
    words, first = word_hashes(raw, offsets)
    m = [np.uint64(pow(_JOIN, k, 1 << 64)) for k in range(width)]
    if len(words) >= width:
        n = len(words) - width + 1
        rolled = words[:n].copy()
        for k in range(1, width):
            rolled += words[k : k + n] * m[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1].view(np.int64)))
        elif b > a:
            whole = b - a
            for w in words[a:b].tolist():
                whole = (whole * _JOIN + w) % (1 << 64)
            out.append(mix(np.array([whole], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
