"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Base rules fail a text outright. Beyond them, each rule gives a text a badness (an integer), and a
text is rejected if any badness reaches the rule's cutoff in the text's stratum. Cutoffs come from
labelled rows: one half (by a hash of doc_id) says which cutoffs catch bad texts, the held-out
other half certifies them: the exact binomial tail bounds the share of good texts that a cutoff
rejects. With m tests in all, a cutoff counts as certified at level DELTA / m (Bonferroni), and each
of the R rules may reject ALPHA / R. So with probability 1 - DELTA, at most ALPHA of the good texts
of any stratum are rejected. Without enough labels nothing is certified and the base rules stand alone.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.runtime import checkpointed, let

WORDS = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: False rejections of good texts allowed per stratum, and the chance that some stratum exceeds them.
ALPHA, DELTA = 0.04, 0.05
#: A cutoff must be right on so many hundredths of the labelled texts that it rejects.
PRECISION_PERCENT = 90
LANGUAGES = ("de", "en", "es", "fr")
OTHER = "other"
#: rule: ((count, factor, size), candidate cutoffs); the badness is count * factor // (size + 1).
RULES = {
    "symbols": (("n_symbols", 1000, "word_chars"), (10, 20, 40, 80, 160)),
    "dup_lines": (("n_dup_lines", 1000, "n_lines"), (100, 200, 300, 400, 500)),
    "repeats": (("n_repeat_words", 1000, "n_words"), (25, 50, 75, 100, 150)),
    "long_words": (("word_chars", 10, "n_words"), (80, 90, 100, 120, 150)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_repeat_words")
LINE_COUNTS = ("n_dup_lines", "n_lines")
#: Bits of the filter by which unlabelled rows are passed over (1 MB).
LABEL_BITS = 1 << 23


def _columns() -> dict[str, Column]:
    return {c: F.col(c) for c in COUNTS + LINE_COUNTS}


def _badness(rule: str, of: dict[str, Column]) -> Column:
    """The rule's badness from the counts (all below 2^53 / factor, so the division is exact enough for its floor)."""
    count, factor, size = RULES[rule][0]
    return F.floor(of[count] * factor / (of[size] + 1)).cast("long")


def text_features(text: Column) -> list[Column]:
    """The counts that the rules use; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, GAPS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines"))).alias("lines"),
        let(words, repeated_words).alias("n_repeat_words"),
    ]


def repeated_words(words: Column) -> Column:
    """How many of words (an array) are in a window of WINDOW words that occurs twice or more in it.

    Windows are compared by hashes first; those whose hash repeats are then compared as they are.
    """
    last = F.size(words) - WINDOW
    places = F.when(last >= 1, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def repeats(ranked: Column, field: str) -> Column:
        """Of an array sorted by field, what shares it with a neighbour."""
        n = F.size(ranked)
        of = lambda i: F.get(ranked, i)[field]
        return F.filter(ranked, lambda x, i: ((i > 0) & (of(i - 1) == x[field])) | ((i < n - 1) & (of(i + 1) == x[field])))

    def covered(ranked: Column) -> Column:
        return let(F.sort_array(F.transform(repeats(ranked, "gram"), lambda x: x["at"])), lambda at: F.aggregate(
            at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
            lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).cast("long").alias("n"), (p + WINDOW).alias("end")),
            lambda acc: acc["n"],
        ))

    def as_they_are(by_hash: Column) -> Column:
        windows = F.transform(repeats(by_hash, "hash"), lambda x: F.struct(F.array_join(F.slice(words, x["at"] + 1, WINDOW), " ").alias("gram"), x["at"].alias("at")))
        return let(F.sort_array(windows), covered)

    def once_differ(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(by_hash, as_they_are))

    return let(F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])), once_differ)


def stratum(lang: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """lang if it is one of languages, else OTHER (null too): a fixed number of strata."""
    return F.when(lang.isin(*languages), lang).otherwise(OTHER)


def _fold(doc_id: Column) -> Column:
    """0: tuning, 1: holdout."""
    return F.when(F.substring(F.md5(doc_id.cast("string")), 1, 1) < "8", 0).otherwise(1)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly from logarithms; 1 where k >= n p (the tail is then near a half or more)."""
    odds = F.lit(p / (1 - p))
    start = n * F.log1p(F.lit(-p))
    walk = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")),
        F.struct(start.alias("log"), F.exp(start).alias("sum")),
        lambda acc, i: let(acc["log"] + F.log((n - i + 1) / i * odds), lambda x: F.struct(x.alias("log"), (acc["sum"] + F.when(i <= k, F.exp(x)).otherwise(0.0)).alias("sum"))),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * p, 1.0).otherwise(walk)


def certified_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """stratum, rule, cutoff: for each stratum and rule the lowest certified cutoff, if there is one.

    features: doc_id, stratum, base_failed and the rules' counts; labels: doc_id, quality (1: good).
    Rows without doc_id or quality don't count; several labels of one document count as its lowest.
    """
    votes = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = features.where("not base_failed").join(votes, "doc_id").select("stratum", _fold(F.col("doc_id")).alias("fold"), (F.col("quality") >= 1).alias("good"), *[_badness(r, _columns()).alias(r) for r in RULES])
    cells = [(r, c) for r, (_, cutoffs) in RULES.items() for c in cutoffs]
    tests = len(cells) * (len(languages) + 1)
    count = lambda cond: F.count(F.when(cond, 1))
    sums = [F.count(F.when((F.col("fold") == 1) & F.col("good"), 1)).alias("n")]
    for i, (r, c) in enumerate(cells):
        hit = F.col(r) >= c
        sums += [count(hit & (F.col("fold") == 0) & ~F.col("good")).alias(f"bad{i}"), count(hit & (F.col("fold") == 0) & F.col("good")).alias(f"good{i}"), count(hit & (F.col("fold") == 1) & F.col("good")).alias(f"k{i}")]
    wide = known.groupBy("stratum").agg(*sums)
    per = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"bad{i}").alias("bad"), F.col(f"good{i}").alias("good"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(cells)]))
    long = wide.select("stratum", "n", per.alias("c")).select("stratum", "n", "c.*")
    useful = (F.col("bad") > 0) & (F.col("bad") * 100 >= (F.col("bad") + F.col("good")) * PRECISION_PERCENT)
    sure = (F.col("n") > 0) & (binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= delta / tests)
    return long.where(useful & sure).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def _plan(docs: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """doc_id, stratum, the counts and base_failed for each row of docs."""
    wide = docs.select("doc_id", stratum(F.col("lang"), languages).alias("stratum"), *text_features(F.col("text"))).select("*", "lines.*").drop("lines")
    return wide.withColumn("base_failed", _failed(_columns()))


def _failed(f: dict[str, Column]) -> Column:
    """The base rules, on counts."""
    return (f["n_words"] < MIN_WORDS) | (f["n_repeat_words"] * 100 > f["n_words"] * MAX_REPEAT_PERCENT)


def _cutoff_map(cutoffs: DataFrame) -> Column:
    """The cutoffs as a constant: at most one for each rule and stratum."""
    rows = cutoffs.collect()
    return F.map_from_arrays(F.array(*[F.lit(f"{r.stratum}/{r.rule}") for r in rows]).cast("array<string>"), F.array(*[F.lit(r.cutoff) for r in rows]).cast("array<int>"))


def _reached(f: dict[str, Column], of_stratum: Column, table: Column) -> Column:
    """Whether a rule's certified cutoff in the row's stratum is reached."""
    reached = [_badness(r, f) >= F.element_at(table, F.concat(of_stratum, F.lit(f"/{r}"))) for r in RULES]
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in reached]), F.lit(False))


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept (and n_lines, stratum) per row of docs.

    docs: doc_id, text, lang; labels: doc_id, quality; more columns are ignored. Null and empty texts
    have no words and fail the base rules. A null or rare lang belongs to the stratum 'other'. Rows
    without doc_id are judged, but can't be labelled. Repeated rows come back as often as they came
    in; a repeated doc_id counts once for each row when cutoffs are chosen. Empty tables are fine.
    """
    features = checkpointed(_plan(docs, languages))
    cutoffs = checkpointed(certified_cutoffs(features, labels, alpha, delta, languages))
    return features.withColumn("kept", ~F.col("base_failed") & ~_reached(_columns(), F.col("stratum"), _cutoff_map(cutoffs)))


def _maybe_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose id may have a label: a filter of fixed size, which no labelled row fails, so texts aren't shuffled to be joined."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(LABEL_BITS))
    words = labels.where("doc_id is not null and quality is not null").groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("mask"))
    blank = docs.sparkSession.range(LABEL_BITS // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    dense = words.unionByName(blank).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    table = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("words")).scalar()
    return docs.where(F.getbit(F.get(table, F.floor(place / 64).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1)


def good_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; rows are judged as in quality_verdicts.

    Cutoffs need the counts of labelled rows only; those of all rows are worked out once.
    """
    names = docs.columns
    features = checkpointed(_plan(_maybe_labelled(docs.select("doc_id", "text", "lang"), labels), languages))
    cutoffs = checkpointed(certified_cutoffs(features, labels, alpha, delta, languages))
    held = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col("text").alias("text"), stratum(F.col("lang"), languages).alias("stratum"))
    table = _cutoff_map(cutoffs)

    def kept(f: Column) -> Column:
        counts = {c: f[c] for c in COUNTS} | {c: f["lines"][c] for c in LINE_COUNTS}
        return ~_failed(counts) & ~_reached(counts, F.col("stratum"), table)

    # one expression, so that the counts aren't worked out again for each rule
    return held.where(let(F.struct(*text_features(F.col("text"))), kept)).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])


def _oracle() -> str:
    cells = ", ".join(f"('{r}', {c}, {i})" for i, r in enumerate(RULES) for c in RULES[r][1])
    value = "CASE c.rule " + " ".join(f"WHEN '{r}' THEN {count} * {factor} // ({size} + 1)" for r, ((count, factor, size), _) in RULES.items()) + " END"
    tests = sum(len(c) for _, c in RULES.values()) * (len(LANGUAGES) + 1)
    p = ALPHA / len(RULES)
    words = WORDS.replace("\\x20", " ")
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang IN ({", ".join(f"'{x}'" for x in LANGUAGES)}), false) AS known, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{words}') AS words, row_number() OVER () AS rid FROM documents),
grams AS (SELECT rid, p, array_to_string(words[p:p+{WINDOW - 1}], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM w WHERE len(words) >= {WINDOW})),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + {WINDOW})) AS q FROM twice) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(DISTINCT x) AS d FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '{words}') GROUP BY rid),
f AS (SELECT w.doc_id, CASE WHEN known THEN lang ELSE '{OTHER}' END AS stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols, coalesce(l.n - l.d, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cover c USING (rid) LEFT JOIN lines l USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM f),
v AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
known AS (SELECT b.*, quality >= 1 AS good, md5(CAST(b.doc_id AS VARCHAR)) >= '8' AS held FROM b JOIN v USING (doc_id) WHERE NOT base_failed),
cells AS (SELECT * FROM (VALUES {cells}) AS t(rule, cutoff, i)),
tally AS (SELECT stratum, rule, cutoff, count(*) FILTER (held AND good) AS n, count(*) FILTER (NOT held AND NOT good AND hit) AS bad, count(*) FILTER (NOT held AND good AND hit) AS fine, count(*) FILTER (held AND good AND hit) AS k
  FROM (SELECT k.stratum, k.good, k.held, c.rule, c.cutoff, {value} >= c.cutoff AS hit FROM known k, cells c) GROUP BY ALL),
useful AS (SELECT * FROM tally WHERE bad > 0 AND bad * 100 >= (bad + fine) * {PRECISION_PERCENT} AND n > 0 AND k < n * {p}),
tail AS (SELECT stratum, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) AS risk FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM useful) GROUP BY ALL),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tail WHERE risk <= {DELTA} / {tests} GROUP BY ALL)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, stratum, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM cut c WHERE c.stratum = b.stratum AND {value} >= c.cutoff) AS kept FROM b
"""


#: The same rows in DuckDB's SQL.
ORACLE = _oracle()
