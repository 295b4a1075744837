"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut each conversation into turn-aligned spans; a window is the system
turn, a limited history repeated from before the span, and the span's turns. The loss mask covers
the assistant texts of the span only, so each is a target once.

Spans come from prefix sums alone: turns that lie wholly in one stretch of STRIDE tokens form a
span, and a turn that crosses a stretch's end is a span of its own. So a conversation of any length
is dealt out over many tasks, in blocks of turns, and a window never needs more than its budget
(but for a single turn that exceeds it by itself, which is kept whole).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.runtime import checkpointed, ship_code

#: Tokens of one span, and of the history repeated before it.
STRIDE, HISTORY = 768, 192
#: A turn's tokens are estimated: its marks, and one for so many characters.
TURN_TOKENS, TOKEN_CHARS = 4, 4
#: Turns of one block of the two-level prefix sums.
BLOCK_TURNS = 64

#: Control strings, split after their first character.
_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
#: A control string in a text gets a backslash after its first character, one more than it has.
_ESCAPE = rf"([<\[])(\\*){_CONTROL}"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*){_CONTROL}")
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    return [(unquote_plus(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _positions(rows: DataFrame) -> DataFrame:
    """Adds idx (place in the conversation) and s, e (tokens before and after), by sums within blocks and over blocks."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62)))
    rows = rows.withColumn("block", block)
    order = Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = rows.groupBy("key", "block").agg(F.count("*").alias("turns"), F.sum("tokens").alias("sum"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "block", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("tokens_before"))
    e = F.col("tokens_before") + F.col("upto")
    return rows.join(starts, ["key", "block"]).select("key", "conv_id", "role", "text", (F.col("turns_before") + F.col("i") - 1).alias("idx"), (e - F.col("tokens")).alias("s"), e.alias("e"))


def chat_windows(conversations: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text; more columns are ignored).

    conv_id, first_turn (place of the span's first turn), n_new (turns of the span), n_repeated
    (turns before them: the system turn and the history), text (the formatted window), loss (array of
    start, end: code points of the targets in it).

    Turns go by turn (nulls first), then role and text. Null roles and texts are empty. Rows of null
    conv_id are one conversation. Repeated rows are turns like others. The first turn is repeated
    in every window if its role is system.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    rows = conversations.select(key.alias("key"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.lit(TURN_TOKENS) + F.ceil(F.length("text") / TOKEN_CHARS))
    turns = checkpointed(_positions(rows))

    span = lambda x: F.floor(x / stride)
    crossing = span(F.col("s")) != span(F.col("e") - 1)
    turns = turns.withColumn("stretch", span(F.col("s"))).withColumn("crossing", crossing)
    spans = turns.groupBy("key", "stretch", "crossing").agg(F.min("s").alias("x"))
    # a turn is repeated before a span that starts at x if e <= x and s >= x - history
    near = F.explode(F.array_distinct(F.array(span(F.col("e")), span(F.col("s") + history))))
    places = ["key", "stretch", "crossing"]
    own = turns.select(*places, "conv_id", "idx", "role", "text", F.lit(True).alias("new"))
    earlier = turns.where("not (idx = 0 and role = 'system')").select("key", "conv_id", "idx", "role", "text", "s", "e", near.alias("stretch"))
    repeated = earlier.join(spans, ["key", "stretch"]).where((F.col("e") <= F.col("x")) & (F.col("s") >= F.col("x") - history))
    system = turns.where("idx = 0 and role = 'system'").select("key", "conv_id", "idx", "role", "text")
    systems = spans.where("x > 0").join(system, "key")
    new = F.lit(False).alias("new")
    placed = own.unionByName(repeated.select(*places, "conv_id", "idx", "role", "text", new)).unionByName(systems.select(*places, "conv_id", "idx", "role", "text", new))

    head = F.concat(F.lit("<|turn|>"), F.url_encode("role"), F.lit("\n"))
    parts = placed.select(*places, "conv_id", F.struct("idx", "new", F.col("role").eqNullSafe("assistant").alias("target"), head.alias("head"), escaped(F.col("text")).alias("body")).alias("turn"))
    grouped = parts.groupBy(*places).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("turn")).alias("turns"))
    tail = "<|end|>\n"
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def walk(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        mask = F.when(t["new"] & t["target"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(empty)
        return F.struct((end + len(tail)).alias("at"), F.concat(acc["loss"], mask).alias("loss"))

    loss = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), empty.alias("loss")), walk, lambda acc: acc["loss"])
    fresh = F.filter("turns", lambda t: t["new"])
    return grouped.select(
        "conv_id", F.get(fresh, F.lit(0))["idx"].alias("first_turn"), F.size(fresh).alias("n_new"),
        (F.size("turns") - F.size(fresh)).alias("n_repeated"), text.alias("text"), loss.alias("loss"),
    )


def _digest_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in the order of conversation and place, one conversation after another; constant memory."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    current: list | None = None

    def close() -> None:
        conv, n, turns, chars, loss, formatted = current
        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_new", "n_repeated", "text", "loss"))):
            conv, n_new, n_repeated, text, loss = row
            if current is None or current[0] != conv:
                if current is not None:
                    close()
                current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_turns(text)[n_repeated:]:
                current[1] += 1
                current[2].update(f"{role}\n{said}\n".encode())
            for span in loss:
                target = unescape(text[span["start"] : span["end"]])
                current[3] += len(target)
                current[4].update(target.encode())
            current[5] += len(text)
        if len(done) >= 4096:
            yield pa.record_batch([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
            done = []
    if current is not None:
        close()
    yield pa.record_batch([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)


def window_digests(windows: DataFrame) -> DataFrame:
    """What can be read back from chat_windows' output, by conversation.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars and
    loss_sha256 (unescaped texts under the loss mask, in order), formatted_chars. A sha256 reads its
    text in one run, so the windows of a conversation meet in one task; they stream through it.
    """
    ship_code(windows.sparkSession)
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    return ordered.mapInArrow(_digest_windows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
