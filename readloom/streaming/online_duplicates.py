"""Duplicate marking of fragments on a stream in coordinate order.

State holds the reads of the keys that are still open. A key closes when the stream has moved more
than the longest read past it; its duplicates go out then. Positions stand in for event time: a
row behind a closed key is late. Late rows are not dropped: they come out as 'late', for
reconciliation with a batch run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LONGEST_READ = 500


def online_duplicates(ends: DataFrame, longest: int = LONGEST_READ) -> DataFrame:
    """rank, status of a stream of fragment ends (duplicates.ends): kept, duplicate or late.

    The stream is grouped by library, reference and strand; within a group rows of one batch are
    ordered by coordinate. A key's best score stays, ties by rank. Keys that are open when the
    stream ends stay in the state; a last row far beyond them (rank -1) closes them.
    """

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reached, held = state.get if state.exists else (-(1 << 40), [])
        groups: dict[int, list] = {}
        for five, score, rank in held:
            groups.setdefault(five, []).append((score, rank))
        out = []
        for frame in frames:
            for five, score, rank in zip(frame["five"].tolist(), frame["score"].tolist(), frame["rank"].tolist()):
                if five < reached - longest:
                    if rank >= 0:
                        out.append((rank, "late"))
                    continue
                if rank >= 0:
                    groups.setdefault(five, []).append((score, rank))
                else:
                    groups.setdefault(five, [])
        if groups:
            reached = max(reached, max(groups))
        for five in sorted(f for f in groups if f < reached - longest):
            reads = sorted(groups.pop(five), key=lambda x: (-x[0], x[1]))
            out += [(rank, "duplicate" if i else "kept") for i, (_, rank) in enumerate(reads)]
        state.update((reached, [(f, s, r) for f, reads in groups.items() for s, r in reads]))
        yield pd.DataFrame(out, columns=["rank", "status"])

    keyed = ends.select("lib", "refid", "strand", F.col("five").cast("long").alias("five"), "score", "rank")
    return keyed.groupBy("lib", "refid", "strand").applyInPandasWithState(
        walk, "rank long, status string", "reached long, held array<struct<five:long,score:long,rank:long>>", "append", GroupStateTimeout.NoTimeout
    )
