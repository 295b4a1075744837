"""Mixing sources to target weights by histograms of hash thresholds (DataFrame functions only).

A row's hash decides alone whether it is taken: of each source, rows below a threshold are taken
once more than the rest. The threshold comes from nested histograms: words by source and hash
bucket, the bucket in which the budget ends, the same again inside that bucket only. No rows are
sorted; what is shuffled are at most BUCKETS sums per source and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.runtime import checkpointed

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its words, and so does each of its rows.
MOST = 3
SEED = "mix-1"
#: Bits of the hash that one level of histograms splits by, and levels.
LEVEL_BITS, LEVELS = 10, 3
#: Thresholds of so many sources (about 5 MB) are sent to every executor; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def row_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """LEVELS * LEVEL_BITS bits which depend on doc_id, text and seed only, so rows without an id or of one id differ by their texts."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))), 1, 15)
    return F.shiftright(F.conv(digits, 16, 10).cast("long"), 60 - LEVELS * LEVEL_BITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, key, source_size (one row a source). Adds target: a share of the sum of all sizes.

    In code point order, null last, sources weigh weights, repeating. A target above most times the
    source's size stops there, and the excess goes to the others by weight, until none is above:
    target = min(most * size, level * weight), where the level is found in one pass over the sources
    in the order of most * size / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", w)
    t = t.withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0))
    t = t.withColumn("level", (F.sum("source_size").over(everything) - F.lit(most) * before("source_size")) / (F.sum("weight").over(everything) - before("weight")))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    t = t.withColumn("water", level)
    capped = F.lit(most) * F.col("source_size")
    return t.select("source", "key", "source_size", F.when(F.col("ratio") <= F.col("water"), capped.cast("double")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def mix_thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """key, source_size, target, epochs, threshold by source. sized: source, key, size, hash (one row a document).

    A row of hash below threshold is taken epochs + 1 times, the others epochs times.
    """
    per = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(per, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    state = targets.select("key", "source_size", "target", epochs.alias("epochs"))
    state = state.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("bucket_words", F.col("source_size"))
    state = checkpointed(state)
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * LEVEL_BITS
        bucket = F.shiftright("hash", shift)
        inside = sized.join(_small(state.select("key", "prefix")), "key").where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = sums.withColumn("upto", F.sum("words").over(running)).join(_small(state.select("key", "left")), "key").where(F.col("upto") > F.col("left"))
        boundary = ends.groupBy("key").agg(F.min(F.struct("bucket", "upto", "words")).alias("b"))
        state = state.join(boundary, "key", "left").select(
            "key", "source_size", "target", "epochs",
            (F.col("left") - F.coalesce(F.col("b.upto") - F.col("b.words"), F.lit(0))).alias("left"),
            F.coalesce("b.bucket", F.shiftleft("prefix", LEVEL_BITS)).alias("prefix"),
            F.coalesce("b.words", F.lit(0)).alias("bucket_words"),
        )
        state = checkpointed(state)
    # of the last bucket, all or none, whichever comes nearer
    whole = (F.col("bucket_words") > 0) & (F.col("left") * 2 >= F.col("bucket_words"))
    return state.select("key", "source_size", "target", "epochs", (F.col("prefix") + whole.cast("long")).alias("threshold"))


def _small(table: DataFrame) -> DataFrame:
    """table, marked for broadcasting if it is a checkpoint's few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(sized rows of docs, thresholds by source)."""
    sized = docs.select("doc_id", "source", _source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text"), seed).alias("hash"))
    sized = checkpointed(sized)
    return sized, checkpointed(mix_thresholds(sized, weights, most))


def _copies() -> Column:
    return F.col("epochs") + (F.col("hash") < F.col("threshold")).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for each row of docs (doc_id, text, source; more are ignored).

    size: words of the text (null or empty: 0); taken: size * copies. Null sources are a source of
    their own. Rows of equal doc_id (or none) and text share their hash and are taken alike; they come
    back as often as they came in. Reruns agree, as the hash depends on doc_id, text and seed only.
    """
    sized, thresholds = mix_plan(docs, weights, most, seed)
    return sized.join(_small(thresholds), "key").select("doc_id", "size", "source", "source_size", "target", _copies().alias("copies"), (F.col("size") * _copies()).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (not at all, or up to most times)."""
    _, thresholds = mix_plan(docs, weights, most, seed)
    names = docs.columns
    marked = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], _source_key(F.col("source")).alias("key"), row_hash(F.col("doc_id"), F.col("text"), seed).alias("hash"))
    taken = marked.join(_small(thresholds), "key").withColumn("copies", _copies()).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return taken.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], copies.alias("_copy")).drop("_copy")


#: The same rows in DuckDB's SQL.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) >> {60 - LEVELS * LEVEL_BITS} AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM per),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM placed),
rated AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM weighed),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - 3 * coalesce(sum(source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lev
  FROM rated WINDOW before AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT lev AS water FROM levels WHERE ratio >= lev ORDER BY ratio, place LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN ratio <= water THEN CAST(3 * source_size AS DOUBLE) ELSE water * weight END AS target FROM levels, water),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM targets),
groups AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
run AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM groups),
bound AS (SELECT r.source, min(r.h) AS h FROM run r JOIN budget b ON r.source IS NOT DISTINCT FROM b.source WHERE r.upto > b.target - b.epochs * b.source_size GROUP BY r.source),
cut AS (SELECT b.source, b.h + CASE WHEN r.words > 0 AND (g.target - g.epochs * g.source_size - (r.upto - r.words)) * 2 >= r.words THEN 1 ELSE 0 END AS threshold
  FROM bound b JOIN run r ON r.source IS NOT DISTINCT FROM b.source AND r.h = b.h JOIN budget g ON g.source IS NOT DISTINCT FROM b.source)
SELECT s.doc_id, s.size, s.source, g.source_size, g.target, CAST(g.epochs + CASE WHEN s.h < coalesce(c.threshold, 0) THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST(s.size * (g.epochs + CASE WHEN s.h < coalesce(c.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN budget g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
"""
