"""BPE of many words at once: each round merges the best pair of every word in one numpy step."""

from __future__ import annotations

import json

import numpy as np

_NONE = np.iinfo(np.int32).max


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordMerger:
    """Encodes words (UTF-8, no white space, one pre-token each) by the merges of a tokenizers file."""

    LONGEST = 48
    ROWS = 4096

    def __init__(self, tokenizer_json: str):
        model = json.loads(tokenizer_json)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # two hash tables: what collides in the first goes to the second, whose factor makes it fit
        self.first, left = self._table(np.arange(len(pairs)), 20, 0x9E3779B97F4A7C15)
        for factor in range(0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93 + 2000, 2):
            self.second, over = self._table(left, 20, factor)
            if not len(over):
                self.factor = factor
                return
        raise ValueError("the merges don't fit the tables")

    def _slot(self, keys: np.ndarray, bits: int, factor: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

    def _table(self, ranks: np.ndarray, bits: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
        """(table of ranks, ranks that found their place taken)."""
        table = np.full(1 << bits, -1, np.int32)
        slot = self._slot(self.keys[ranks], bits, factor)
        table[slot[::-1]] = ranks[::-1]  # the best rank stays
        return table, ranks[table[slot] != ranks]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        out = np.full(key.shape, _NONE, np.int32)
        fine = b >= 0
        k = key[fine]
        r = self.first[self._slot(k, 20, 0x9E3779B97F4A7C15)]
        found = (r >= 0) & (self.keys[r] == k)
        other = self.second[self._slot(k, 20, self.factor)]
        also = ~found & (other >= 0) & (self.keys[other] == k)
        out[fine] = np.where(found, r, np.where(also, other, _NONE))
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; words are at most LONGEST bytes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        order = np.argsort(size, kind="stable")
        for at in range(0, len(words), self.ROWS):
            rows = order[at : at + self.ROWS]
            n = size[rows]
            width = int(n.max())
            flat = np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8)
            grid = np.full((len(rows), width + 1), -1, np.int32)
            grid[:, :width][np.arange(width) < n[:, None]] = self.inner[flat]
            grid[np.arange(len(rows)), n - 1] = self.last[flat[np.cumsum(n) - 1]]
            self._merge(grid, n)
            for i, row, k in zip(rows.tolist(), grid.tolist(), n.tolist()):
                out[i] = row[:k]
        return out

    def _merge(self, grid: np.ndarray, n: np.ndarray) -> None:
        """Merges in place the lowest ranked, leftmost pair of each row until no row has one; n: symbols of each row."""
        live = np.arange(len(grid))
        while len(live):
            width = int(n[live].max())
            part = grid[live, :width + 1]
            rank = self._ranks(part[:, :-1], part[:, 1:])
            best = rank.argmin(axis=1)
            r = rank[np.arange(len(live)), best]
            go = r != _NONE
            live, part, best, r = live[go], part[go], best[go], r[go]
            if not len(live):
                return
            place = np.arange(width + 1)
            source = np.minimum(place + (place > best[:, None]), width)
            part = np.take_along_axis(part, source, axis=1)
            part[:, -1] = -1
            part[np.arange(len(live)), best] = self.made[r]
            grid[live, :width + 1] = part
            n[live] -= 1
