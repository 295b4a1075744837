"""Operators that need an ordered walk over a small group: best mapping sets, depth peaks, adapters."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom import model as m
from readloom.functions import aux, cigar, flags, sequences


def mapping_spans(df: DataFrame) -> DataFrame:
    """rank, qname, score (tag AS), refid and the closed-open spans on reference and read (in the machine's orientation) of mapped rows."""
    c = F.col("cigar")
    front = F.when(flags.has(m.REVERSE), cigar.back_clip(c)).otherwise(cigar.front_clip(c))
    used = cigar.consumed(c, "MI=X")
    score = F.coalesce(aux.value(F.col("aux"), "AS").try_cast("long"), F.lit(0).cast("long"))
    return df.where(flags.mapped() & (F.col("refid") >= 0)).select("rank", "qname", score.alias("score"), "refid", F.col("pos").alias("ref_from"), (F.col("pos") + cigar.reference_length(c)).alias("ref_to"), front.alias("read_from"), (front + used).alias("read_to"))


Mapping = namedtuple("Mapping", "rank score refid ref_from ref_to read_from read_to")


def _cluster(rows: list[Mapping]) -> list[int]:
    """Ranks that stay: best score per base first; a mapping stays if it overlaps none that stays."""
    kept: list[tuple[int, int]] = []
    out = []
    for r in sorted(rows, key=lambda r: (-r.score / max(1, r.read_to - r.read_from), r.rank)):
        if all(r.read_to <= a or r.read_from >= b for a, b in kept):
            kept.append((r.read_from, r.read_to))
            out.append(r.rank)
    return out


#: Gaps on read and reference between neighbours of a chain may differ by this factor of the smaller.
GAP_FACTOR = 1.3


def _chain(rows: list[Mapping]) -> list[int]:
    """Ranks of the run of colinear mappings, in the order of the reference, with the largest sum of scores."""
    best: list[int] = []
    best_score = None
    run: list[int] = []
    run_score = 0
    last = None
    for r in sorted(rows, key=lambda r: (r.refid, r.ref_from, r.ref_to, r.rank)):
        fits = last is not None and r.refid == last.refid and r.read_from >= last.read_to and r.ref_from >= last.ref_to
        if fits:
            a, b = r.read_from - last.read_to, r.ref_from - last.ref_to
            fits = abs(a - b) <= GAP_FACTOR * min(a, b)
        run, run_score = ([*run, r.rank], run_score + r.score) if fits else ([r.rank], r.score)
        if best_score is None or run_score > best_score:
            best, best_score = run, run_score
        last = r
    return best


def best_mappings(df: DataFrame, link: str = "chain") -> DataFrame:
    """The best set of mappings of each read: chain or cluster. Rows after the first are supplementary, and each row's mate is the next, the last one's the first.

    Rows stream in the order of names; only the mappings of one read are held.
    """
    walk = {"chain": _chain, "cluster": _cluster}[link]

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, []
        for frame in frames:
            kept: list[int] = []
            for qname, *row in frame.itertuples(index=False, name=None):
                if qname != name:
                    kept += walk(held)
                    name, held = qname, []
                held.append(Mapping(*row))
            yield pd.DataFrame({"rank": np.array(kept, np.int64)})
        yield pd.DataFrame({"rank": np.array(walk(held), np.int64)})

    spans = mapping_spans(df).select("qname", *Mapping._fields)
    kept = spans.repartition("qname").sortWithinPartitions("qname").mapInPandas(stream, "rank long")
    rows = df.join(kept, "rank")
    w = Window.partitionBy("qname").orderBy("refid", "pos", "rank")
    ring = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    later = F.row_number().over(w) > 1
    new = {"flag": F.col("flag").bitwiseAND(~m.SUPPLEMENTARY).bitwiseOR(F.when(later, m.SUPPLEMENTARY).otherwise(0)), "mate_refid": ring("refid"), "mate_pos": ring("pos")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def depth_peaks(depths: DataFrame, least: float = 1.0, narrowest: int = 1, widest: int = 1024, tile: int = 1 << 16) -> DataFrame:
    """refid, start, end, height of peaks of depth (refid, pos, depth).

    Biorthogonal spline wavelets of widths 1, 2, 4 .. widest: a rise of least or more followed by a
    fall of as much, of the same scale. Peaks inside another of no less height go. References are
    walked in tiles that overlap by twice the widest scale, so no task holds a reference.
    """
    margin = 2 * widest

    def walk(key, group: pd.DataFrame) -> pd.DataFrame:
        refid, t = key
        low, high = int(t) * tile, (int(t) + 1) * tile
        signal = np.zeros(tile + 2 * margin + 1)
        signal[group["pos"].to_numpy() - (low - margin)] = group["depth"].to_numpy()
        total = np.concatenate([[0.0], np.cumsum(signal)])
        found = []
        scale = narrowest
        while scale <= widest:
            mean = (total[scale:] - total[:-scale]) / scale
            edge = mean[scale:] - mean[:-scale]  # at i: mean of [i+scale, i+2 scale) less mean of [i, i+scale)
            inner = (edge[1:-1] >= edge[:-2]) & (edge[1:-1] > edge[2:]) & (edge[1:-1] >= least)
            outer = (edge[1:-1] <= edge[:-2]) & (edge[1:-1] < edge[2:]) & (edge[1:-1] <= -least)
            ups, downs = np.flatnonzero(inner) + 1 + scale, np.flatnonzero(outer) + 1 + scale
            after = np.searchsorted(downs, ups, side="right")
            for u, k in zip(ups.tolist(), after.tolist()):
                if k < len(downs) and downs[k] - u <= margin:
                    a, b = u + low - margin, int(downs[k]) + low - margin
                    if low <= a < high:
                        found.append((a, b, float(signal[u : int(downs[k])].max(initial=0.0))))
            scale *= 2
        found = sorted(set(found), key=lambda x: (-(x[1] - x[0]), x))
        kept: list[tuple[int, int, float]] = []
        for p in found:
            if not any(q[0] <= p[0] and p[1] <= q[1] and q[2] >= p[2] for q in kept):
                kept.append(p)
        kept.sort()
        return pd.DataFrame({"refid": np.full(len(kept), refid, np.int32), "start": np.array([p[0] for p in kept], np.int64), "end": np.array([p[1] for p in kept], np.int64), "height": [p[2] for p in kept]})

    spread = depths.withColumn("tile", F.explode(F.array_distinct(F.array(F.floor((F.col("pos") - margin) / tile), F.floor(F.col("pos") / tile), F.floor((F.col("pos") + margin) / tile)))))
    return spread.groupBy("refid", "tile").applyInPandas(walk, "refid int, start long, end long, height double")


def _by_length(*columns: pd.Series):
    """(places, byte matrix of each column) for the rows of equal lengths; nulls are empty."""
    texts = [c.fillna("").to_numpy() for c in columns]
    groups: dict[tuple[int, ...], list[int]] = {}
    for i, row in enumerate(zip(*texts)):
        groups.setdefault(tuple(map(len, row)), []).append(i)
    for lengths, places in groups.items():
        yield np.array(places), [np.frombuffer("".join(t[places]).encode("ascii", "replace"), np.uint8).reshape(len(places), n) for t, n in zip(texts, lengths)]


def _machine_bases() -> Column:
    """The read as the machine wrote it."""
    return F.when(flags.has(m.REVERSE), sequences.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))


def list_adapters(df: DataFrame, adapters: DataFrame, least_score: int = 16, least_share: float = 0.75, least_part: float = 0.8, seed: int = 12, seed_errors: int = 2, genome: int = 3_000_000_000, shares: dict[str, float] | None = None) -> DataFrame:
    """Tags as (bases from the match's start on), aa (the adapter's name), af (share of matching bases) and ar (probability that no such word stands in a random genome) of rows in which an adapter of a list (name, seq) is found.

    Reads are taken as the machine wrote them, adapters from either strand. An adapter may start
    anywhere; its first bases, up to seed, may have seed_errors mismatches. score: matches less
    mismatches; matches must be least_share of the adapter and least_part of the bases compared. The
    earliest match decides, then the better one. The list is a fixed table of some dozens.
    """
    turn = str.maketrans("ACGT", "TGCA")
    known = [(r["name"], s) for r in adapters.orderBy("name").collect() for s in (r.seq.upper(), r.seq.upper()[::-1].translate(turn))]

    def match(seq: pd.Series) -> pd.DataFrame:
        out = {"name": np.full(len(seq), None, object), "cut": np.zeros(len(seq), np.int32), "share": np.zeros(len(seq)), "word": np.full(len(seq), "", object)}
        for places, (reads,) in _by_length(seq):
            n_reads, length = reads.shape
            start, score = np.full(n_reads, length), np.zeros(n_reads, np.int64)
            for name, adapter in known:
                a = np.frombuffer(adapter.encode(), np.uint8)
                for i in range(length):
                    n = min(len(a), length - i)
                    if n < least_score or n < least_share * len(a):
                        break
                    same = reads[:, i : i + n] == a[:n]
                    hits = same.sum(axis=1)
                    now = 2 * hits - n
                    fits = ((~same[:, :seed]).sum(axis=1) <= seed_errors) & (now >= least_score) & (hits >= least_share * len(a)) & (hits >= least_part * n)
                    better = np.flatnonzero(fits & ((i < start) | ((i == start) & (now > score))))
                    start[better], score[better] = i, now[better]
                    at = places[better]
                    out["name"][at], out["cut"][at], out["share"][at], out["word"][at] = name, length - i, hits[better] / n, adapter[:n]
        return pd.DataFrame(out)

    found = F.pandas_udf(match, "name string, cut int, share double, word string")(_machine_bases())
    rows = df.withColumn("_a", found)
    counts = {b: F.regexp_count(F.col("_a.word"), F.lit(b)) for b in "ACGT"}
    chance = sequences.kmer_poisson(F.lit(genome), counts, F.lit(0), shares or dict.fromkeys("ACGT", 0.25))
    some = F.col("_a.name").isNotNull()
    tags = F.col("aux")
    for tag, kind, val in (("as", "i", F.col("_a.cut")), ("aa", "Z", F.col("_a.name")), ("af", "f", F.round(F.col("_a.share"), 6)), ("ar", "f", F.round(chance, 6))):
        tags = aux.put(tags, tag, kind, F.when(some, val))
    return rows.withColumn("aux", tags).drop("_a")


def overlap_adapters(pairs: DataFrame, seed: int = 12, percent: int = 10, least: int = 32, adapter: int = 12) -> DataFrame:
    """qname, overlap, cut1, cut2 of pairs (qname, seq1, seq2: as the machine wrote them) whose insert is shorter than the reads.

    The last bases of the reverse complement of read 2 are sought in read 1, from its end on; if the
    whole overlap has at most percent hundredths of mismatches, what lies beyond the insert is
    adapter: its first bases, up to adapter, must be alike on both reads, again but for percent hundredths.
    """

    def find(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        turn = np.arange(256, dtype=np.uint8)
        turn[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)
        out = np.full((len(one), 3), -1, np.int32)
        for places, (a, b) in _by_length(one, two):
            r = turn[b[:, ::-1]]
            left = np.ones(len(places), bool)
            for n in range(min(a.shape[1], b.shape[1] - 1), least - 1, -1):
                wrong = a[:, :n] != r[:, b.shape[1] - n :]
                s = min(seed, n)
                x, y = a[:, n : n + adapter], b[:, n : n + adapter]
                k = min(x.shape[1], y.shape[1])
                if k == 0:
                    continue
                ok = left & (wrong[:, n - s :].sum(axis=1) * 100 <= s * percent) & (wrong.sum(axis=1) * 100 <= n * percent) & ((x[:, :k] != y[:, :k]).sum(axis=1) * 100 <= k * percent)
                out[places[ok]] = n, a.shape[1] - n, b.shape[1] - n
                left &= ~ok
        return pd.DataFrame(out, columns=["overlap", "cut1", "cut2"])

    udf = F.pandas_udf(find, "overlap int, cut1 int, cut2 int")
    return pairs.select("qname", udf("seq1", "seq2").alias("x")).select("qname", "x.*").where("overlap >= 0")


def tag_overlap_adapters(df: DataFrame, **how) -> DataFrame:
    """Tags ah (1) and a3 (bases of adapter at the 3' end) on both mates of pairs in which overlap_adapters finds some."""
    number = flags.read_number()
    bases = df.where(flags.primary() & (number > 0)).select("qname", number.alias("_n"), "rank", _machine_bases().alias("_seq"))
    first = lambda n: F.min_by(F.when(F.col("_n") == n, F.col("_seq")), F.when(F.col("_n") == n, F.col("rank")))
    pairs = bases.groupBy("qname").agg(first(1).alias("seq1"), first(2).alias("seq2")).where("seq1 is not null and seq2 is not null")
    found = overlap_adapters(pairs, **how).select("qname", F.col("cut1").alias("_1"), F.col("cut2").alias("_2"))
    cut = F.when(flags.primary() & (number == 1), F.col("_1")).when(flags.primary() & (number == 2), F.col("_2"))
    rows = df.join(found, "qname", "left").withColumn("_cut", cut)
    tags = aux.put(aux.put(F.col("aux"), "ah", "i", F.when(F.col("_cut").isNotNull(), F.lit(1))), "a3", "i", F.col("_cut"))
    return rows.withColumn("aux", tags).select(df.columns)


def overlap_histogram(found: DataFrame, pairs: int) -> DataFrame:
    """overlap, n, percent (of all pairs) of what overlap_adapters finds."""
    return found.groupBy("overlap").agg(F.count("*").alias("n")).withColumn("percent", F.col("n") * 100 / F.lit(float(pairs)))


def covered_bases(df: DataFrame) -> DataFrame:
    """qname, covered: bases of each read under at least one of its mappings."""
    from readloom.operators.intervals import merged

    spans = mapping_spans(df).where("read_to > read_from").select("qname", F.col("read_from").alias("from"), (F.col("read_to") - 1).alias("to"))
    return merged(spans, ("qname",)).groupBy("qname").agg(F.sum((F.col("to") - F.col("from") + 1).cast("long")).alias("covered"))
