"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash of 16 bytes cuts each text where the hash meets a mask, so equal passages in
different texts give equal chunks. A chunk is encoded once while it stays in the worker's bounded
table, up to the words that its ends cut. Each join of two chunks is repaired by re-encoding the
bytes around it, from the last white space of the left one to the first of the right one: at white
space both encodings agree for certain, as this tokenizer never merges, composes or matches
anything across it. A chunk without white space moves the join on to the next one.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm.bpe_words import WordMerger
from readloom.llm.runtime import release_memory, ship_code, text_batches, utf8_buffer
from readloom.llm.shingles import mix

#: A chunk ends where these bits of the rolling hash are zero: 512 bytes on average.
CUT_MASK = np.uint32(0xFF800000)
WINDOW = 16
#: Bounds of the tables that a worker keeps during a task (about 250 MB).
MAX_CHUNKS = 20_000
MAX_WORDS = 700_000
#: So many bytes of texts are encoded together (or one longer text).
PIECE_BYTES = 4 << 20

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
#: Plain texts have ASCII (without ', <, | and >, which can begin contractions and special tokens) and letters of
#: Latin-1 only. There, pre-tokens are the runs of letters, the single digits and the runs of other marks.
_LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_ASCII = bytes(c for c in range(0x20, 0x7F) if c not in b"'<|>") + b"\t\n\r\x0b\x0c"
_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
_PARTS = re.compile(_LETTER + rb"+|[0-9]|[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+")


def _plain(text: bytes) -> bool:
    return _LATIN.fullmatch(text.translate(None, _ASCII)) is not None


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Ends of the content-defined chunks of raw (without its own end)."""
    if len(raw) <= WINDOW:
        return np.zeros(0, np.int64)
    # sums of 2, 4, 8 and 16 shifted terms
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(2 * k))
    return np.flatnonzero((h[:-1] & CUT_MASK) == 0) + 1


class ChunkEncoder:
    """Encodes texts exactly as the tokenizer does with add_special_tokens=False."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merger = WordMerger(tokenizer_json)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.slots: dict[bytes, int] = {}
        self.clear()
        self.encoded_chunks = self.reused_chunks = 0

    def clear(self) -> None:
        """Forgets all parts, and the chunks made of them."""
        self.slots.clear()
        self.ids: list[tuple[int, ...]] = []
        self.counts: list[int] = []
        self.id_texts: list[str] = []
        self.token_texts: list[str] = []
        self.odd: set[bytes] = set()
        self.chunks: dict[bytes, list | None] = {}

    def learn(self, parts: set[bytes]) -> None:
        """Gives each part that has none a slot; a part without tokens gets -1."""
        new = [p for p in parts if p not in self.slots]
        short = [p for p in new if len(p) <= WordMerger.LONGEST and p not in self.odd]
        found = self.merger.encode([p.decode().lower().encode() for p in short])
        other = [p for p in new if len(p) > WordMerger.LONGEST or p in self.odd]
        found += [self.tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in other]
        for p, ids in zip(short + other, found):
            self.slots[p] = len(self.ids) if ids else -1
            if ids:
                self.ids.append(tuple(ids))
                self.counts.append(len(ids))
                self.id_texts.append(" ".join(map(self.digits.__getitem__, ids)))
                self.token_texts.append(" ".join(map(self.tokens.__getitem__, ids)))

    def _parts(self, text: bytes) -> list[bytes]:
        """The parts of a text that begins and ends at white space or a text's ends: pre-tokens, or whole words that aren't plain."""
        if _plain(text):
            return _PARTS.findall(text.lower())
        words = text.split()
        if len(words) == 1:
            self.odd.update(words)
            return words
        return list(chain.from_iterable(map(self._parts, words)))

    def _chunk(self, chunk: bytes) -> list | None:
        """[cut word in front, parts between, cut word at the end]; None without white space."""
        if chunk in self.chunks:
            self.reused_chunks += 1
            return self.chunks[chunk]
        self.encoded_chunks += 1
        head = chunk.split(None, 1)[0] if chunk[0] not in _SPACE else b""
        if len(head) == len(chunk):
            found = None
        else:
            tail = chunk.rsplit(None, 1)[-1] if chunk[-1] not in _SPACE else b""
            found = [head, self._parts(chunk[len(head) : len(chunk) - len(tail)]), tail]
            self.fresh.append(found)
        if len(self.chunks) >= MAX_CHUNKS:
            self.chunks.clear()
        self.chunks[chunk] = found
        return found

    def _read(self, raw: np.ndarray) -> list[list]:
        """A text's chunks and the repaired joins between them, in order."""
        out: list[list] = []
        bounds = [0, *cut_points(raw).tolist(), len(raw)]
        whole = raw.tobytes()
        carry: list[bytes] = []

        def joint(pieces: list[bytes]) -> None:
            entry = [b"", self._parts(b"".join(pieces)), b""]
            self.fresh.append(entry)
            out.append(entry)

        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            chunk = whole[a:b]
            found = self._chunk(chunk)
            if found is None:
                carry.append(chunk)
                continue
            head, _, tail = found
            if carry or head:
                joint([*carry, head])
            out.append(found)
            carry = [tail] if tail else []
        if carry:
            joint(carry)
        return out

    def encode(self, texts: list[np.ndarray]) -> list[list[int]]:
        """Slots of each text's parts in order; texts are given as UTF-8 bytes. New parts of all texts are learnt together."""
        if len(self.slots) > MAX_WORDS:
            self.clear()
        self.fresh: list[list] = []
        read = [self._read(t) for t in texts]
        missing: set[bytes] = set()
        for entry in self.fresh:
            missing.update(entry[1])
        self.learn(missing)
        for entry in self.fresh:
            slots = list(map(self.slots.__getitem__, entry[1]))
            entry[1] = [x for x in slots if x >= 0] if -1 in slots else slots
        self.fresh = []
        return [list(chain.from_iterable([e[1] for e in entries])) for entries in read]

    def count(self, slots: list[int]) -> int:
        return sum(map(self.counts.__getitem__, slots))

    def token_ids(self, slots: list[int]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.ids.__getitem__, slots)), np.int32)

    def id_text(self, slots: list[int]) -> str:
        return " ".join(map(self.id_texts.__getitem__, slots))

    def decode(self, slots: list[int]) -> str:
        """As the tokenizer's decode(ids, skip_special_tokens=False): it has no decoder, so tokens join by spaces."""
        return " ".join(map(self.token_texts.__getitem__, slots))


#: Output columns to choose from, with their types.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


_encoders: dict[int, ChunkEncoder] = {}


def _encoder(tokenizer_json: str) -> ChunkEncoder:
    """The worker's encoder, which serves all tasks that it runs; its tables last for one task."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(tokenizer_json)
    return _encoders[key]


def _encoded(encoder: ChunkEncoder, batches: Iterator[pa.RecordBatch], outputs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_batches(whole, "text", PIECE_BYTES):
            raw, off = utf8_buffer(batch.column("text"))
            rows: dict[str, list] = {k: [] for k in outputs}
            for slots in encoder.encode([raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]):
                decoded = encoder.decode(slots) if {"decoded", "decoded_sha256"} & rows.keys() else ""
                for k, out in rows.items():
                    if k == "n_tokens":
                        out.append(encoder.count(slots))
                    elif k == "ids":
                        out.append(encoder.token_ids(slots))
                    elif k == "decoded":
                        out.append(decoded)
                    else:
                        out.append(hashlib.sha256((encoder.id_text(slots) if k == "ids_sha256" else decoded).encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(rows[k], _ARROW[k]) for k in outputs)], ["doc_id", *outputs])


def _encode_batches(source, outputs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source.value)
        try:
            yield from _encoded(encoder, batches, outputs)
        finally:
            # Spark keeps the worker, and what it holds, beside the stages that come next
            encoder.clear()
            release_memory()

    return run


def vocabulary() -> str:
    """The tokenizer's file: READLOOM_VOCABULARY, or that of the installed collection."""
    if named := os.environ.get("READLOOM_VOCABULARY"):
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(docs: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the chosen OUTPUTS for each row of docs (doc_id long, text string; more columns are ignored).

    vocabulary: a tokenizers file of word-level BPE whose pre-tokens never span white space and
    which has no decoder. The file is read on the driver and sent to the executors (a few MB,
    whatever the input). Null and empty texts have no tokens and decode to ''. Repeated rows come
    back as often as they came in; doc_id may be null. No shuffle: each task keeps bounded tables of
    chunks and words, and frees them at its end.
    """
    ship_code(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = ", ".join(["doc_id long", *(f"{k} {OUTPUTS[k]}" for k in outputs)])
    return docs.select("doc_id", "text").mapInArrow(_encode_batches(source, tuple(outputs)), schema)
