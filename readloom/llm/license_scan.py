"""Licence scan: Aho-Corasick finds tags and notice phrases, a shunting-yard parser evaluates licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm.runtime import ship_code, text_batches, utf8_buffer

#: Phrases, as words, and their labels. Their places are counted.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notice phrases that add labels, as words.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "server side public license": "sspl",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: What stands before a licence expression in a text (lower case).
TAGS = ("spdx-license-identifier:", "license-expression:", "packagelicensedeclared:", "packagelicenseconcluded:")
#: Families of licence identifiers, and how free the reuse is that they allow, 0 to 1. The longest family that an identifier begins with counts.
FREEDOM = {
    "0bsd": 1.0, "afl": 0.9, "agpl": 0.3, "apache": 1.0, "artistic": 0.8, "blueoak": 1.0, "bsd": 1.0, "bsl": 1.0, "busl": 0.1, "cc-by": 0.9, "cc-by-nc": 0.3, "cc-by-nd": 0.3, "cc-by-sa": 0.6, "cc0": 1.0,
    "cddl": 0.6, "cecill": 0.5, "ecl": 0.9, "elastic": 0.1, "epl": 0.6, "eupl": 0.5, "gfdl": 0.4, "gpl": 0.4, "isc": 1.0, "lgpl": 0.6, "licenseref": 0.2, "mit": 1.0, "mpl": 0.7, "ms-pl": 0.8, "ms-rl": 0.6, "ncsa": 1.0,
    "odbl": 0.6, "ofl": 0.8, "openssl": 0.9, "osl": 0.5, "php": 0.9, "polyform": 0.1, "postgresql": 1.0, "psf": 1.0, "public-domain": 1.0, "python": 1.0, "reserved": 0.0, "ruby": 0.8, "sspl": 0.1, "unicode": 0.9, "unlicense": 1.0,
    "upl": 1.0, "vim": 0.9, "w3c": 0.9, "wtfpl": 1.0, "x11": 1.0, "zlib": 1.0, "zpl": 0.9,
}
#: An identifier of no family.
UNKNOWN = 0.2
#: An exception ("with") frees half of what is left.
EXCEPTION_GAIN = 0.5

_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


@lru_cache(1 << 16)
def family(label: str) -> str | None:
    """The family that an identifier belongs to: it begins with the family's name, and a mark or a digit follows, if anything."""
    ends = {len(label), *(m.start() for m in re.finditer(r"[^a-z]", label))}
    return max((k for k in FREEDOM if label.startswith(k) and (len(k) in ends)), key=len, default=None)


def freedom(label: str) -> float:
    """How free reuse is under one licence."""
    return FREEDOM.get(family(label), UNKNOWN)


def parse_expression(text: str, start: int = 0, end: int | None = None) -> tuple[list[str], int]:
    """(reverse Polish form, characters used) of the longest licence expression that text[start:end] starts with; ([], 0) without one.

    Operators by rank: with, and, or; all group to the left; brackets nest.
    """
    out: list[str] = []
    stack: list[str] = []
    # how much of out, the operators still open (of rising rank, as no bracket is open) and the end
    n, rest, used = 0, [], start
    at, depth, want = start, 0, True
    end = len(text) if end is None else end
    while m := _TOKEN.match(text, at, end):
        t = m[1]
        if t == "(" and want:
            stack.append(t)
            depth += 1
        elif t == ")" and not want and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif t in _RANK and not want:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            want = True
        elif want and t not in "()" and t not in _RANK:
            out.append(t)
            want = False
        else:
            break
        at = m.end()
        if not want and not depth:
            n, rest, used = len(out), stack[::-1], at
    return out[:n] + rest, used - start


def evaluate(rpn: list[str]) -> float:
    """How free reuse is: 'and' binds to the stricter side, 'or' lets one choose, 'with' loosens."""
    stack: list = []
    for t in rpn:
        if t not in _RANK:
            stack.append(t)
            continue
        b, a = stack.pop(), stack.pop()
        x = freedom(a) if isinstance(a, str) else a
        if t == "with":
            stack.append(x + (1 - x) * EXCEPTION_GAIN)
        else:
            y = freedom(b) if isinstance(b, str) else b
            stack.append(min(x, y) if t == "and" else max(x, y))
    return freedom(stack[0]) if isinstance(stack[0], str) else stack[0]


#: A-Z to a-z, and everything that is not part of a word to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_EXPRESSION_END = re.compile(r"[\r\n]")


class Scanner:
    def __init__(self):
        import ahocorasick

        # one character per byte, so offsets are those of the bytes
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in (BASE_PHRASES | NOTICES).items():
            self.phrases.add_word(f" {phrase} ", (phrase, label, phrase in BASE_PHRASES))
        for t in TAGS:
            self.tags.add_word(t, t)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, raw: bytes) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, expressions, score) of one text."""
        words = raw.translate(_WORDS).split()
        line = " " + b" ".join(words).decode("latin-1") + " "
        starts, base, labels, values = [], set(), set(), []
        seen_at = seen_words = 0
        for end, (phrase, label, counts) in self.phrases.iter(line):
            labels.add(label)
            if counts:
                # every word has a space before it
                upto = end - len(phrase) - 1
                if upto < seen_at:
                    seen_at = seen_words = 0
                seen_words += line.count(" ", seen_at, upto)
                seen_at = upto
                starts.append(seen_words)
                base.add(label)
            values.append(freedom(label))
        found = []
        lower = raw.lower().decode("latin-1")
        stop = -1
        for end, _ in self.tags.iter(lower):
            if stop <= end:
                line_end = _EXPRESSION_END.search(lower, end + 1)
                stop = line_end.start() if line_end else len(lower)
            rpn, _used = parse_expression(lower, end + 1, stop)
            if rpn:
                found.append(" ".join(rpn))
                labels.update(t for i, t in enumerate(rpn) if family(t) and not (i + 1 < len(rpn) and rpn[i + 1] == "with"))
                values.append(evaluate(rpn))
        score = min(values) if values else 0.0
        text = lambda x: ",".join(sorted(x))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), text(base), text(labels), sorted(set(found)), score


_COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "expressions": pa.list_(pa.string()), "score": pa.float64()}
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for whole in batches:
        for batch in text_batches(whole, "text"):
            raw, off = utf8_buffer(batch.column("text"))
            rows = [scanner.scan(raw[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_COLUMNS.values()))], ["doc_id", *_COLUMNS])


def license_scan(docs: DataFrame) -> DataFrame:
    """Licences that each text names: one row per row of docs (doc_id long, text string; more columns are ignored).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, A-Z lower-cased. n_base: places of BASE_PHRASES, which may
    overlap; first_word, last_word: their smallest and largest start (words from 0, else null);
    base_labels; labels: also those of NOTICES, and the identifiers of known families in the licence expressions after TAGS;
    expressions: these in reverse Polish form, each read up to its line's end; score: how free reuse is under the strictest of what was
    found (0 to 1; 0 without any). Labels are distinct, sorted and comma-joined, '' without any.

    Null and empty texts have no words and no labels; doc_id may be null; repeated rows come back as
    often as they came in. No shuffle.
    """
    ship_code(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, _SCHEMA)
