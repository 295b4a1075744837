"""Jaccard similarity join on word n-grams by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments; the
overlap of two texts is counted in each fragment by itself and summed per pair.

What keeps it far from all pairs:

1. Texts with equal n-gram sets form one class (a node); copies are never paired.
2. A class needs a share of the lowest part of its set to occur elsewhere too, and then of its
   whole set: links at the threshold are impossible otherwise. This drops nearly every text
   without a near copy, whatever passages it shares.
3. Classes that share an n-gram of their rare-first prefixes are compared with one pivot of that
   n-gram, in a few rounds; linked ones merge. What is left are pairs of different components
   under one prefix n-gram. All of those that their overlaps with the pivot don't rule out are
   compared. So no link between components is lost, and a group of k near copies costs about k
   comparisons, not k^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.components import components
from readloom.llm.runtime import bitmap_has, key_bitmap, ship_code, text_batches, utf8_buffer
from readloom.llm.runtime import checkpointed as written
from readloom.llm.shingles import mix, shingle_sets
from readloom.plans.registry import scratch

#: Every step frees the shuffle files of the steps before it, so that the disk holds one step's at a time.
checkpointed = partial(written, free=True)

#: Similarity in hundredths at which two texts link.
THRESHOLD = 80
#: Words in an n-gram.
WIDTH = 5
#: Fragments of the global n-gram order.
FRAGMENTS = 8
#: Besides the least part that linked sets must share a gram of, one SPARE-th of a set is looked at:
#: then that many of its grams must be shared.
SPARE = 10
#: Rounds of comparisons with pivots before the rest is compared in full.
PIVOT_ROUNDS = 3


def _least_overlap(n, threshold: int):
    """Shared n-grams that a set of n needs at least with any linked set: ceil(n * threshold / 100)."""
    return -((-n * threshold) // 100)


def _signature(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a sorted set; (0, 0) stands for the empty set, and no other has a 0."""
    if not len(grams):
        return 0, 0
    x = grams.view(np.uint64)
    mixed = mix(x)
    parts = np.array([[np.bitwise_xor.reduce(x * np.uint64(0x9E3779B97F4A7C15)), np.bitwise_xor.reduce(mixed * np.uint64(0xA24BAED4963EE407))], [np.add.reduce(mixed), np.add.reduce(mix(x ^ np.uint64(0x2545F4914F6CDD1D)))]], np.uint64)
    one, two = mix(mix(mix(parts[0]) + parts[1]) + np.uint64(len(x))).view(np.int64).tolist()
    return one or 1, two or 1


#: Sets that a task remembers, so that copies which meet in it are sent on once.
SEEN = 1 << 16


def _batches_of_sets(batches: Iterator[pa.RecordBatch], width: int, shared: frozenset[int] = frozenset()):
    """(batch, sets, nodes, second digests): a set's node is its first digest, or the second where different sets share the first."""
    for whole in batches:
        for batch in text_batches(whole, "text"):
            sets = shingle_sets(*utf8_buffer(batch.column("text")), width)
            digests = np.array([_signature(s) for s in sets], np.int64).reshape(-1, 2)
            nodes = np.where(np.isin(digests[:, 0], list(shared)), digests[:, 1], digests[:, 0]) if shared else digests[:, 0]
            yield batch, sets, nodes, digests[:, 1]


class _Once:
    """Tells sets that a task meets for the first time from those it has sent on already."""

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()

    def __call__(self, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        new = np.zeros(len(nodes), bool)
        for i, key in enumerate(zip(nodes.tolist(), others.tolist())):
            if key not in self.seen:
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen.add(key)
                new[i] = key[0] != 0
        return new


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _nodes(width: int, threshold: int):
    """Arrow function: size and digests of each text's set; its lowest part once for each set that the task meets, else nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, none = _Once(), np.zeros(0, np.int64)
        for batch, sets, nodes, others in _batches_of_sets(batches, width):
            n = [len(s) for s in sets]
            heads = [s[: k - _least_overlap(k, threshold) + k // SPARE + 1] if new else none for s, k, new in zip(sets, n, once(nodes, others).tolist())]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(nodes), pa.array(others), _lists(heads)],
                ["doc_id", "key", "n", "node", "other", "head"],
            )

    return run


def _held(common):
    """Arrow function: (node, gram) of those n-grams in the lowest parts that may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column("head")
            grams = heads.flatten().to_numpy(zero_copy_only=False)
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), heads.value_lengths().to_numpy(zero_copy_only=False))
            keep = bitmap_has(common.value, grams)
            yield pa.record_batch([pa.array(nodes[keep]), pa.array(grams[keep])], ["node", "gram"])

    return run


def _whole_sets(width: int, shared: frozenset[int], wanted):
    """Arrow function: (node, grams) of the texts whose keys may be in the bitmap, once for each set that the task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for whole in batches:
            some = whole.filter(pa.array(bitmap_has(wanted.value, whole.column("key").to_numpy(zero_copy_only=False))))
            for _, sets, nodes, others in _batches_of_sets(iter([some]), width, shared):
                rows = np.flatnonzero(once(nodes, others))
                yield pa.record_batch([pa.array(nodes[rows]), _lists([sets[i] for i in rows.tolist()])], ["node", "grams"])

    return run


def _fragment(gram: Column, fragments: int) -> Column:
    """The range of the global order (that of signed 64-bit hashes) which holds a gram, from 0."""
    return F.shiftright(F.shiftrightunsigned(gram.bitwiseXOR(F.lit(-(1 << 63))), 48) * fragments, 16)


def overlaps(pairs: DataFrame, sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """(a, b, shared): sizes of the intersections of the given pairs, counted fragment by fragment.

    pairs: distinct (a, b); sets: (node, grams array<bigint>). A fragment is a range of the global
    n-gram order, so each side's part of it is small and a pair's parts are counted apart.
    """
    piece = F.transform(
        F.sequence(F.lit(0), F.lit(fragments - 1)),
        lambda f: F.struct(f.alias("fragment"), F.filter("grams", lambda g: _fragment(g, fragments) == f).alias("grams")),
    )
    cut = sets.select("node", F.inline(piece)).where(F.size("grams") > 0)
    left = pairs.join(cut.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("grams_a")), "a")
    both = left.join(cut.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("grams_b")), ["b", "fragment"])
    return both.select("a", "b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part")).groupBy("a", "b").agg(F.sum("part").alias("shared"))


def _linked(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """The given pairs that reach the threshold, as links u, v."""
    found = overlaps(pairs, sets)
    found = found.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    return found.where(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _may_link(threshold: int) -> Column:
    """Sets a and b of n grams, c of them held by others too, can still link: neither their sizes nor their common grams rule it out.

    The intersection is at most the lesser c, and threshold hundredths of the union need it to be at
    least threshold / (100 + threshold) of n_a + n_b.
    """
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold
    return sizes & (F.least("c_a", "c_b") * (100 + threshold) >= (F.col("n_a") + F.col("n_b")) * threshold)


def ngram_jaccard_components(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row per row of docs (doc_id long, text string; more columns are ignored): doc_id, n_shingles, component_id.

    A text's set: distinct shingles of width words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased); fewer words are one
    shingle. Two texts link when 100 * intersection >= threshold * union. component_id: the smallest
    doc_id that links reach. Shingles are compared by 64-bit hashes, sets as wholes by 128 bits.

    Null and empty texts have no shingles and link with nothing (component_id is the own doc_id).
    Rows without doc_id take part; a component's id is the smallest that is not null, or null.
    Repeated rows come back as often as they came in. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship_code(spark)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    # written once, as Parquet, whose columns can be read apart; all but the sets of candidates comes from it
    path = scratch(spark)
    texts.mapInArrow(_nodes(width, threshold), "doc_id long, key long, n long, node long, other long, head array<bigint>").write.parquet(path)
    rows = spark.read.parquet(path)
    # different sets of one first digest: a handful in 10^10 texts
    clash = rows.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("node")
    shared = frozenset(r.node for r in clash.collect())
    if shared:
        rows = rows.withColumn("node", F.when(F.col("node").isin(*shared), F.col("other")).otherwise(F.col("node")))
    classes = checkpointed(rows.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.min("key").alias("key")))

    # Classes whose set has enough n-grams, in its lowest part, that another class has too.
    heads = rows.where(F.size("head") > 0).select("node", "head")
    twice = heads.select("node", F.explode("head").alias("gram")).groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("gram")
    twice = checkpointed(twice)
    held = heads.mapInArrow(_held(spark.sparkContext.broadcast(key_bitmap(twice, "gram"))), "node long, gram long").join(twice, "gram", "left_semi").distinct()
    common = held.groupBy("node").agg(F.count("*").alias("common"))
    alive = checkpointed(common.join(classes, "node").where(F.col("common") > F.floor(F.col("n") / SPARE)).select("node", "n", "key"))

    # Their whole sets, from one text of each; then those with at least threshold hundredths of it in common with others.
    wanted = spark.sparkContext.broadcast(key_bitmap(alive, "key"))
    full = texts.select("text", "key").mapInArrow(_whole_sets(width, shared, wanted), "node long, grams array<bigint>").join(alive.select("node"), "node", "left_semi")
    full = checkpointed(full.dropDuplicates(["node"]).select("node", "grams"))
    each = full.select("node", F.explode("grams").alias("gram"))
    counts = checkpointed(each.groupBy("gram").agg(F.count("*").alias("holders")).where("holders > 1"))
    ranked = each.join(counts, "gram").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "gram"))).alias("ranked"))
    ranked = ranked.join(alive, "node").where(F.size("ranked") * 100 >= F.col("n") * threshold)
    near = checkpointed(ranked.select("node", "n", F.transform("ranked", lambda x: x.gram).alias("grams")))

    sizes = near.select("node", "n")
    prefix = F.slice("grams", F.lit(1), F.greatest(F.lit(0), F.size("grams") - F.ceil(F.col("n") * threshold / 100) + 1).cast("int"))
    lists = checkpointed(near.select("node", "n", F.size("grams").alias("c"), F.explode(prefix).alias("gram")))
    labels = _merged_lists(lists, near, sizes, threshold)

    grouped = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "component").select("node", "component_id")
    return rows.select("doc_id", "n", "node").join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _merged_lists(lists: DataFrame, sets: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """(node, component) of the nodes that have links, by comparisons among the nodes that share a prefix n-gram."""
    labels = links = tried = None
    turn = 0
    while turn <= PIVOT_ROUNDS:
        now = lists.withColumn("component", F.col("node")) if labels is None else lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # n-grams under which more than one component is left
        open_grams = now.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("gram")
        # written first, so that the join's large keys can be split
        now = checkpointed(now.join(checkpointed(open_grams), "gram"))
        pairs = _pivot_pairs(now, turn, threshold) if turn < PIVOT_ROUNDS else _open_pairs(now, sets, threshold)
        pairs = checkpointed(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = checkpointed(_linked(pairs, sets, sizes, threshold))
        # without a new link the components stay, and only the full comparison can tell more
        fresh = not found.isEmpty()
        turn = PIVOT_ROUNDS if turn < PIVOT_ROUNDS and not fresh else turn + 1
        tried = pairs if tried is None else tried.unionByName(pairs)
        if fresh:
            links = found if links is None else links.unionByName(found)
            labels = checkpointed(components(links))
    return labels if labels is not None else sizes.sparkSession.createDataFrame([], "node long, component long")


def _pivot_pairs(now: DataFrame, turn: int, threshold: int) -> DataFrame:
    """Under each n-gram, one pivot against the nodes of other components.

    At first the pivot is the most central node (most of its set is held by others too); later it
    is that of the largest component but one.
    """
    best = F.max(F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("node")).alias("back"), "n", "c"))
    per = now.groupBy("gram", "component").agg(F.count("*").alias("members"), best.alias("best"))
    rank = F.struct("best") if turn == 0 else F.struct("members", "best")
    top = per.groupBy("gram").agg(F.max_by(F.struct("component", "best"), rank).alias("top"))
    if turn:
        per = per.join(top, "gram").where(F.col("component") != F.col("top.component")).drop("top")
        top = per.groupBy("gram").agg(F.max_by(F.struct("component", "best"), rank).alias("top"))
    pivot = top.select("gram", F.col("top.component").alias("other"), (-F.col("top.best.back")).alias("pivot"), F.col("top.best.n").alias("n_b"), F.col("top.best.c").alias("c_b"))
    rows = now.select("gram", "component", "node", F.col("n").alias("n_a"), F.col("c").alias("c_a"))
    pairs = rows.join(checkpointed(pivot), "gram").where((F.col("component") != F.col("other")) & _may_link(threshold))
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _open_pairs(now: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """All pairs of nodes of different components, under one n-gram, that can still link.

    What a and b share lies in the n-gram's pivot or outside it: their intersection is at most the
    lesser of their overlaps with the pivot, plus the n-grams outside the pivot that both hold. So
    a pair either fits by its overlaps with the pivot (tried on classes of nodes of equal component,
    size and overlap), or holds common n-grams outside it (found by an index of those only).
    """
    rank = F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("node")).alias("back"))
    pivots = now.groupBy("gram").agg((-F.max(rank)["back"]).alias("pivot"))
    member = checkpointed(now.join(pivots, "gram").select("pivot", "node", "component", "n").distinct())
    shared = overlaps(member.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")), sets)
    o = F.when(F.col("node") == F.col("pivot"), F.col("n")).otherwise(F.coalesce("shared", F.lit(0)))
    member = checkpointed(member.join(shared.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "shared"), ["node", "pivot"], "left").select("pivot", "node", "component", "n", o.alias("o")))

    def other(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"node": "node_b", "component": "component_b", "n": "n_b", "o": "o_b"})

    fits = lambda extra: (F.least("o", "o_b") + extra) * (100 + threshold) >= (F.col("n") + F.col("n_b")) * threshold
    kinds = member.select("pivot", "component", "n", "o").distinct()
    ways = kinds.join(other(kinds), "pivot").where((F.col("component") < F.col("component_b")) & fits(0))
    by_pivot = ways.join(member, ["pivot", "component", "n", "o"]).join(other(member), ["pivot", "component_b", "n_b", "o_b"]).select("node", "node_b")

    own, theirs = sets.select("node", "grams"), sets.select(F.col("node").alias("pivot"), F.col("grams").alias("pivot_grams"))
    outside = member.join(own, "node").join(theirs, "pivot").select("pivot", "node", "component", "n", "o", F.explode(F.array_except("grams", "pivot_grams")).alias("gram"))
    held = checkpointed(outside)
    met = held.join(other(held), ["pivot", "gram"]).where("component < component_b")
    by_rest = met.groupBy("pivot", "node", "node_b", "n", "n_b", "o", "o_b").agg(F.count("*").alias("extra")).where(fits(F.col("extra"))).select("node", "node_b")
    return by_pivot.unionByName(by_rest).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
