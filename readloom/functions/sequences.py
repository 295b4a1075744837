"""Bases, qualities and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def quality_sum(qual: Column, least: int = 15, offset: int = 33) -> Column:
    """Sum of the base qualities that are at least least."""
    return F.aggregate(F.split(qual, ""), F.lit(0), lambda n, c: n + F.when(F.ascii(c) - offset >= least, F.ascii(c) - offset).otherwise(0))


def right_probability(q: Column) -> Column:
    """Probability that a base of Phred quality q is right."""
    return 1 - F.pow(F.lit(10.0), -q / 10)


def kmer_poisson(length: Column, counts: dict[str, Column], n: Column, share: dict[str, float]) -> Column:
    """Probability of n places of a word with the given base counts in a random sequence of that length.

    The places are Poisson with mean (length + 1 - word length) * product of share^count, worked in
    logarithms; a word longer than the sequence has probability 0. The shares must sum to 1 (to 1e-4).
    """
    if abs(sum(share.values()) - 1) > 1e-4:
        raise ValueError("base shares must sum to 1")
    size = sum((counts[b] for b in "ACGT"), F.lit(0))
    log_mean = F.log((length + 1 - size).cast("double")) + sum((counts[b] * F.log(F.lit(share[b])) for b in "ACGT"), F.lit(0.0))
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))
    return F.when(size > length, 0.0).otherwise(F.exp(n * log_mean - log_factorial - F.exp(log_mean)))
