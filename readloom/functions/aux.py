"""Auxiliary tags as an ordered array of (tag, type, value)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_tag(tag: str) -> str:
    """tag, if it is one letter and one letter or digit."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]", tag):
        raise ValueError(f"not a tag: {tag!r}")
    return tag


def parse(text: Column) -> Column:
    """'NM:i:3|RG:Z:a' as an array ('' as an empty one)."""
    parts = F.filter(F.split(text, r"\|"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring(p, 1, 2).alias("tag"), F.substring(p, 4, 1).alias("type"), p.substr(F.lit(6), F.length(p)).alias("value")))


def to_text(aux: Column, sep: str = "|") -> Column:
    return F.array_join(F.transform(aux, lambda a: F.concat_ws(":", a["tag"], a["type"], a["value"])), sep)


def value(aux: Column, tag: str, kind: str | None = None) -> Column:
    """The value of the first tag of that name (and type), else null."""
    same = F.filter(aux, lambda a: (a["tag"] == tag) & (F.lit(True) if kind is None else a["type"] == kind))
    return F.get(same, F.lit(0))["value"]


def has_any(aux: Column, tags) -> Column:
    return F.exists(aux, lambda a: a["tag"].isin(*tags))


def keep(aux: Column, tags) -> Column:
    return F.filter(aux, lambda a: a["tag"].isin(*tags))


def drop(aux: Column, tags) -> Column:
    return F.filter(aux, lambda a: ~a["tag"].isin(*tags))


def put(aux: Column, tag: str, kind: str, val: Column) -> Column:
    """aux with the tag replaced, at the end; unchanged where val is null."""
    new = F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("type"), val.cast("string").alias("value"))
    return F.when(val.isNull(), aux).otherwise(F.concat(drop(aux, [tag]), F.array(new)))


def merge(winner: Column, other: Column) -> Column:
    """winner, then the tags of other that it lacks."""
    return F.concat(winner, F.filter(other, lambda o: ~F.exists(winner, lambda w: w["tag"] == o["tag"])))
