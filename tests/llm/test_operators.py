"""Each text operator on hostile small tables, against brute force."""

import hashlib
import json
import math
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.llm import bpe_chunks, chat_windows, license_scan, mixing, ngram_join, quality_rules, queries, training_order, url_cascade, virtual_shards, winnowing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, gram string, key string, size int"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, texts, ids=None):
    """A documents table with nulls and columns whose names the operators use inside."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((ids[i] if ids else i, t, ["en", "de", None, "xx"][i % 4], ["a", "b", None, "ü"][i % 4], None if t is None else len(t), 7, "g", None, 3))
    return spark.createDataFrame(rows, DOCS).repartition(3)


def near_copies(seed=5, groups=6, size=9):
    """Groups of edited copies, chains of them, exact copies, common passages, odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    out = [None, "", " \n\t", "One two", "one TWO", "Ärger über alles in der Welt", "ärger über alles in der Welt", "x" * 5000]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(30, 160))]
        chain = list(base)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [word()]
            out.append(" ".join(copy))
            chain[rng.randrange(len(chain))] = word()
            out.append("  ".join(chain).upper())
        out.append(" ".join(base + passage))
        out.append(" ".join([word() for _ in range(50)] + passage))
    out += out[-30:]
    return out


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    up[root(a)] = root(b)
    least = {}
    for a, i in enumerate(ids):
        if i is not None:
            r = root(a)
            least[r] = min(least.get(r, i), i)
    return [(i, len(sets[a]), least.get(root(a)) if sets[a] else i) for a, i in enumerate(ids)]


@pytest.mark.parametrize("seed", [5, 6])
def test_ngram_join_against_all_pairs(spark, seed):
    texts = near_copies(seed)
    ids = list(range(100, 100 + len(texts)))
    ids[3] = None
    got = ngram_join.ngram_jaccard_components(table(spark, texts, ids)).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got) == order(brute_components(texts, ids))


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_jaccard_components(table(spark, ["a"]).where("doc_id < 0")).count() == 0


def test_open_pairs_keep_links_that_pivots_miss(spark):
    # two clusters far from the pivot of their common prefix, linked to each other only through late members
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(40):
        t = list(base)
        for at in rng.sample(range(120), 1 + k % 6):
            t[at] = f"e{k % 5}_{at}"
        texts.append(" ".join(t))
    got = ngram_join.ngram_jaccard_components(table(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_components(texts, list(range(40))))


def test_quality_rules_counts(spark):
    text = "a b c d e f a b c d e g\na b\n \na b\n\n# % x"
    rows = quality_rules.quality_verdicts(table(spark, [text, None, "", "w " * 9, "w " * 10, "\u00e9# 1 2 3 4 5 6 7 8 9"]), spark.createDataFrame([], "doc_id long, quality int, text string")).orderBy("doc_id").collect()
    first = rows[0]
    assert (first.n_words, first.word_chars, first.n_symbols, first.n_dup_lines, first.n_repeat_words) == (19, 19, 2, 1, 10)
    assert first.base_failed and not first.kept
    assert [r.base_failed for r in rows] == [True, True, True, True, True, False]
    assert rows[5].word_chars == 11 and rows[5].kept


def test_quality_rules_certify_only_what_labels_carry(spark):
    clean, junk = "some clean words that differ number {} and more of it so on", "| junk | {} | words | with | marks | all | over | it |"
    texts = [(junk if i % 4 == 0 else clean).format(i) for i in range(9000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(9000)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.quality_verdicts(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in rows)
    # too few labels: nothing can be certified, so only base rules reject
    few = quality_rules.quality_verdicts(docs, labels.where("doc_id < 400")).where("not kept").count()
    assert few == 0
    # labels that the scores don't explain
    blind = labels.withColumn("quality", F.when(F.xxhash64("doc_id") % 2 == 0, 1).otherwise(0))
    assert quality_rules.quality_verdicts(docs, blind).where("not kept").count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(n, k, p) for n in (1, 10, 300, 5000) for k in (0, 1, 5, 40) for p in (0.01, 0.05) if k < n * p]
    for n, k, p in cases:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n), F.lit(k), p).alias("x")).first().x
        assert got == pytest.approx(want, rel=1e-9)


def test_good_documents_keep_columns_and_rows(spark):
    docs = table(spark, [None, "one two three four five six seven eight nine ten", "short"])
    kept = quality_rules.good_documents(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1023, 4097])
def test_slots_are_a_permutation(n):
    slots = training_order.slots_of(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert (training_order.index_of(slots, n) == np.arange(n)).all()
    assert n < 100 or (slots != training_order.slots_of(np.arange(n), n, key=1)).any()


def rebuilt(spark, folder):
    """(doc_id, tokens) of all documents of a folder of shards, by brute force."""
    manifest = training_order.read_manifest(folder)
    records = np.concatenate([*training_order.records_from(folder, batch=3), np.zeros(0, training_order.record_type(manifest["sequence"], manifest["end"]))])
    assert len(records) == manifest["total"]
    assert (training_order.slots_of(records["index"], manifest["total"]) == np.arange(len(records))).all()
    by = {int(r["index"]): r for r in records}
    first = {r.part: r.first for r in spark.read.parquet(f"{folder}/parts").collect()}
    out, places = [], {}
    for d in spark.read.parquet(f"{folder}/documents").orderBy("part", "start").collect():
        length = manifest["sequence"]
        at = first[d.part] * length + d.start
        tokens = [int(by[k // length]["tokens"][k % length]) for k in range(at, at + d.n)]
        assert tokens[-1] == manifest["end"] and manifest["end"] not in tokens[:-1]
        for k in range(at // length, (at + d.n - 1) // length + 1):
            places.setdefault(k, []).append(d.doc_id)
        out.append((d.doc_id, tokens[:-1]))
    return out, by, places


@pytest.mark.parametrize("as_ids", [False, True])
def test_training_order_round_trip(spark, tmp_path, as_ids):
    texts = [None, "", "abc", "\u00e9" * 40, "x" * 16, "x" * 16, "long " * 300, "y" * 15, "z" * 5000]
    ids = [0, 1, 2, 3, 4, 4, None, -1, 7]
    rows = [(i, t, None if t is None else list(t.encode()), "k", 3) for i, t in zip(ids, texts)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, tokens array<int>, slot string, index int").repartition(3).write.parquet(path)
    docs, folder = spark.read.parquet(path), str(tmp_path / "out")
    how = {"ids": "tokens", "end": 50_000} if as_ids else {}
    manifest = training_order.write_training_order(docs, folder, sequence=16, shard=8, **how)
    out, by, places = rebuilt(spark, folder)
    assert sorted(map(str, out)) == sorted(str((i, list((t or "").encode()))) for i, t in zip(ids, texts))
    contents = {r.slot: r for r in training_order.written_contents(spark, folder).collect()}
    assert sorted(contents) == list(range(manifest["total"]))
    for slot, r in contents.items():
        record = by[r["index"]]
        assert training_order.slots_of(np.array([r["index"]]), manifest["total"])[0] == slot
        assert (r.shard, r.byte_offset, r.n_tokens, list(r.doc_ids)) == (slot // 8, slot % 8 * manifest["stride"], record["used"], places[r["index"]])
        assert r.tokens_crc32 == zlib.crc32(record["tokens"][: record["used"]].tobytes())
    assert next(training_order.records_from(folder, 13))["index"][0] == contents[13]["index"]
    again = str(tmp_path / "again")
    training_order.write_training_order(docs, again, sequence=16, shard=8, **how)
    assert [open(f"{folder}/{training_order.shard_name(k)}", "rb").read() == open(f"{again}/{training_order.shard_name(k)}", "rb").read() for k in range(manifest["total"] // 8)]
    with open(f"{folder}/{training_order.shard_name(0)}", "r+b") as f:
        f.seek(40)
        f.write(b"\1\2\3")
    with pytest.raises(Exception, match="not the file of the manifest"):
        training_order.written_contents(spark, folder).collect()


def test_training_order_of_long_texts_and_nothing(spark, tmp_path):
    texts = ["ab" * 3_000_000, None, "c"]
    table(spark, texts).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    manifest = training_order.write_training_order(docs, str(tmp_path / "out"), shard=512)
    tokens = sum(int(r["used"].sum()) for r in training_order.records_from(str(tmp_path / "out")))
    assert tokens == 6_000_000 + 1 + 3 and manifest["total"] == spark.read.parquet(str(tmp_path / "out/manifest")).agg(F.sum("records")).first()[0]
    assert training_order.write_training_order(docs.where("doc_id > 99"), str(tmp_path / "none"))["total"] == 0
    assert training_order.written_contents(spark, str(tmp_path / "none")).count() == 0 and list(training_order.records_from(str(tmp_path / "none"))) == []
    with pytest.raises(Exception, match="below the end token"):
        training_order.write_training_order(docs.selectExpr("doc_id", "array(300) AS ids"), str(tmp_path / "bad"), ids="ids")


def test_training_query_reads_what_it_wrote(spark, tmp_path):
    texts = [None, "", "abc", "\u00e9" * 4000, "x" * 1024, "long " * 900]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op2_training_order(spark, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in rows) == sum(len((t or "").encode()) + 1 for t in texts)
    assert {i for r in rows for i in r.doc_ids} == set(range(6)) and sorted(r.slot for r in rows) == list(range(len(rows)))


def test_sharding(spark, tmp_path):
    rng = random.Random(2)
    docs = table(spark, [None, ""] + ["x" * rng.randint(0, 300) for _ in range(1500)])
    rows = virtual_shards.sharded(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(16)) and len(rows) == 1502
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r["size"] for r in x) for x in by.values()]
    assert max(sizes) < 1.01 * min(sizes)
    size_of = {}
    for r in rows:
        size_of[r.virtual_slot] = size_of.get(r.virtual_slot, 0) + r["size"]
    first = virtual_shards.SlotMap.balanced(size_of, 16)
    grown = first.grown(size_of)
    moved = [(a, b) for a, b in zip(first.shards, grown.shards) if a != b]
    assert moved and all(b == 16 for _, b in moved) and grown.version == 2
    uneven = virtual_shards.SlotMap(1, 4, tuple(min(3, v % 7) for v in range(virtual_shards.VIRTUAL_SLOTS))).rebalanced(size_of)
    fill = [sum(size_of.get(v, 0) for v, s in enumerate(uneven.shards) if s == k) for k in range(4)]
    assert max(fill) - min(fill) <= 0.02 * sum(fill) / 4
    first.save(spark, str(tmp_path / "map"))
    grown.save(spark, str(tmp_path / "map"))
    assert virtual_shards.SlotMap.load(spark, str(tmp_path / "map")) == grown
    assert virtual_shards.SlotMap.load(spark, str(tmp_path / "map"), 1) == first
    assert virtual_shards.sharded(docs.where("doc_id < 0")).count() == 0


def test_chat_windows_round_trip(spark):
    rng = random.Random(3)
    odd = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\n", "<\\|end|>", "[\\\\INST]", "<<SYS>>", "", None, "a\n\nb", "<" * 9 + "|"]
    rows, want = [], {}
    for conv in [1, 2, 3, None]:
        turns = []
        if conv != 2:
            turns.append(("system", "be kind"))
        for k in range({1: 3, 2: 250, 3: 40}.get(conv, 5)):
            role = ["user", "assistant", None, "tool\nx"][k % 2 if k % 17 else k % 4]
            turns.append((role, rng.choice([*odd, "words " * rng.randint(1, 900)])))
        for i, (role, text) in enumerate(turns):
            rows.append((conv, i, role, text, "clash"))
        want[conv] = [(r or "", t or "") for r, t in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    windows = chat_windows.chat_windows(df)
    got = {r.conv_id: r for r in chat_windows.window_digests(windows).collect()}
    for conv, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(said), sha(said))
    for w in windows.collect():
        turns = chat_windows.read_turns(w.text)
        assert len(turns) == w.n_new + w.n_repeated
        if want[w.conv_id][0][0] == "system":
            assert turns[0] == ("system", "be kind")
        tokens = sum(4 + math.ceil(len(t) / 4) for _, t in turns[w.n_repeated :])
        assert w.n_new == 1 or tokens <= chat_windows.STRIDE
        control = re.sub(r"<\|turn\|>[^\n]*\n|<\|end\|>\n", "", w.text)
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", control)
    assert windows.where("n_repeated > 1").count() > 0
    assert chat_windows.window_digests(chat_windows.chat_windows(df.where("conv_id > 99"))).count() == 0


def test_license_scan(spark):
    texts = [
        None, "", "Licensed UNDER the MIT, license! cc by nc cc-by-nc", "SPDX-License-Identifier: (MIT or Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\nnext",
        "SPDX-License-Identifier: MIT AND\n", "the gnu general public license", "spdx-license-identifier: )(", "é apache license version 2 0",
    ]
    rows = license_scan.license_scan(table(spark, texts)).orderBy("doc_id").collect()
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (0, 0, None, "", 0.0)
    assert (rows[2].n_base, rows[2].first_word, rows[2].last_word, rows[2].base_labels) == (3, 1, 8, "cc-by-nc,mit")
    assert rows[3].labels == "apache-2.0,gpl-2.0,mit" and rows[3].expressions == ["mit apache-2.0 or gpl-2.0 classpath-exception-2.0 with and"]
    assert rows[3].score == pytest.approx(0.7)
    assert rows[4].labels == "mit" and rows[5].labels == "gpl" and rows[6].labels == ""
    assert (rows[7].first_word, rows[7].labels) == (1, "apache-2")
    rpn, used = license_scan.parse_expression("a or b and c with d) x")
    assert rpn == ["a", "b", "c", "d", "with", "and", "or"] and used == 19


def test_license_scan_reads_long_expressions(spark):
    names = [f"licenseref-lib{i}-1.{i}" for i in range(80)]
    texts = [
        "SPDX-License-Identifier: " + " OR ".join(names) + "\nAND not-this", "SPDX-License-Identifier: MIT OR " + " OR ".join(["mit"] * 300) + " and gpl-3.0",
        "License-Expression: (" + " and ".join(["mit"] * 300) + ") and gpl-2.0\r\nSPDX-License-Identifier: isc", "SPDX-License-Identifier: " + " OR ".join(["mit"] * 50000),
    ]
    rows = license_scan.license_scan(table(spark, texts)).orderBy("doc_id").collect()
    assert rows[0].labels == ",".join(sorted(names)) and len(rows[0].expressions[0].split()) == 159
    assert rows[1].labels == "gpl-3.0,mit" and rows[1].score == 1.0
    assert rows[2].labels == "gpl-2.0,isc,mit" and rows[2].score == pytest.approx(0.4) and len(rows[2].expressions) == 2
    assert len(rows[3].expressions[0].split()) == 99999 and rows[3].score == 1.0


def test_mixing(spark):
    rng = random.Random(4)
    big = ["word " * rng.randint(0, 30) for _ in range(1200)]
    rows = [(i, t, ["big", "big", "b", None, "ä"][i % 5] if i % 9 else "tiny") for i, t in enumerate(big)] + [(None, None, "zero"), (5000, "", "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    total = sum(r["size"] for r in got)
    by = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in by.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for s, t in by.values())
    for source, (size, target) in by.items():
        taken = sum(r.taken for r in got if r.source == source)
        assert abs(taken - target) <= 30, source
    order = sorted(x for x in by if x is not None) + [None]
    free = [s for s in order if by[s][1] < 3 * by[s][0] - 1e-6]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    levels = [by[s][1] / weight[s] for s in free]
    assert max(levels) == pytest.approx(min(levels))
    assert all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(docs.where("doc_id < 0")).count() == 0


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(6)
    letters = "abcXYZ éÉßÀ×÷ 's'<|endoftext|> .,;:!?09 \n\t \u00a0\u0301İΣσςア漢😀'd 're\x1c\x00ª½²'"
    texts = [None, "", "word", "a" * 3000, "é" * 2000 + " x", "ΑΣ ΑΣ.", "<|ENDOFTEXT|> <|startoftext|>b"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 700))) for _ in range(150)]
    passage = " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(600))
    texts += [f"{i} {passage} {i}" for i in range(5)] + [passage] * 2
    rows = bpe_chunks.bpe_encode(table(spark, texts), path, tuple(bpe_chunks.OUTPUTS)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, ids))), sha(r.decoded))
    encoder = bpe_chunks.ChunkEncoder(open(path, encoding="utf-8").read())
    encoder.encode([np.frombuffer((f"{i} {passage}").encode(), np.uint8) for i in range(9)])
    assert encoder.reused_chunks > encoder.encoded_chunks
    with open(path, encoding="utf-8") as f:
        assert json.load(f)["decoder"] is None


def test_bpe_frees_its_tables_when_a_task_ends():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = SimpleNamespace(value=f.read())
    run = bpe_chunks._encode_batches(source, ("n_tokens", "ids"))
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["some words of a text " * 50, "others"])], ["doc_id", "text"])
    encoder = bpe_chunks._encoder(source.value)
    first = list(run(iter([batch])))
    assert first[0].column("n_tokens").to_pylist()[0] >= 250
    assert not encoder.slots and not encoder.chunks and not encoder.ids and not encoder.token_texts
    assert list(run(iter([batch]))) == first and bpe_chunks._encoder(source.value) is encoder
    cut = run(iter([batch]))
    next(cut)
    assert encoder.slots
    cut.close()
    assert not encoder.slots and not encoder.chunks


def brute_winnow(text, gram, span):
    hashes = winnowing.gram_hashes(winnowing._codes(text), gram).tolist()
    span = min(span, len(hashes))
    out = []
    for i in range(len(hashes) - span + 1) if hashes else []:
        window = hashes[i : i + span]
        at = max(k for k in range(span) if window[k] == min(window)) + i
        if not out or out[-1] != at:
            out.append(at)
    return [(hashes[i], i) for i in out]


def test_winnowing(spark):
    rng = random.Random(7)
    texts = [None, "", "a", "ab" * 9, "aaaa" * 30, "é😀" * 50] + ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 500))) for _ in range(40)]
    ids = [k * k * 37 for k in range(len(texts) - 1)] + [None]
    rows = winnowing.winnowing_fingerprints(table(spark, texts, ids), 5, 8).collect()
    got = {r.doc_id: r for r in rows}
    order = sorted([i for i in ids if i is not None], reverse=True) + [None]
    text_of = {i: t or "" for i, t in zip(ids, texts)}
    for k, i in enumerate(order):
        own, after = text_of[i], text_of[order[(k + 1) % len(order)]]
        half = len(own) // 2
        changed = own[: len(own) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), sha(changed))
        show = lambda t: " ".join(f"{h:08x}@{p:x}" for h, p in brute_winnow(t, 5, 8))
        assert (r.fingerprint, r.edited_fingerprint) == (show(own), show(changed))
        a, b = {h for h, _ in brute_winnow(own, 5, 8)}, {h for h, _ in brute_winnow(after, 5, 8)}
        assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a and b else float(not a and not b))
    # the guarantee: a shared passage of span + gram - 1 characters gives a shared hash
    passage = "".join(rng.choice("abcdefghij") for _ in range(8 + 5 - 1))
    a, b = (winnowing.Fingerprint(winnowing._codes("".join(rng.choice("xyz") for _ in range(90)) + passage), 5, 8) for _ in range(2))
    assert a.likeness(b) > 0
    one = winnowing.winnowing_fingerprints(table(spark, ["same text here"], [3])).first()
    assert one.near_next == 1.0
    assert winnowing.winnowing_fingerprints(table(spark, ["x"]).where("doc_id < 0")).count() == 0


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org": ("notexample.org", "", None, "allow"),
        "x://a.com/de/#f://b": ("a.com", "/de/", "com/de/", "block"),
        "http://www.cheap-pills.example.com/en/1": ("www.cheap-pills.example.com", "/en/1", None, "block"),
        "http://cheap-pills.example.com/fr/1": ("cheap-pills.example.com", "/fr/1", "com/fr/", "allow"),
        "http://a.net?q=/x": ("a.net", "", None, "allow"),
    }
    rows = [(i, u, "<html>", "h", "k") for i, u in enumerate(cases)] * 2
    got = url_cascade.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string, host string, key string")).collect()
    want = list(cases.values())
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id]


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(30_000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"))
    listed = universe.where(F.xxhash64("key") % 7 == 0).unionByName(spark.range(99).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("key")))
    cascade = url_cascade.Cascade(universe, listed)
    assert cascade.parts == 1 and len(cascade.levels[0]) >= 2
    marked = universe.select("key", cascade.contains(F.col("key")).alias("hit"))
    assert marked.where("hit").exceptAll(listed.select("key", F.lit(True))).count() == 0
    assert marked.where("hit").count() == universe.join(listed, "key", "left_semi").count()


def test_cascade_in_parts_past_its_bits(spark):
    universe = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"))
    listed = universe.where(F.xxhash64("key") % 3 == 0)
    cascade = url_cascade.Cascade(universe, listed, max_bits=4096)
    assert cascade.parts == 2 and all(bits <= 4096 for levels in cascade.levels for _, bits in levels)
    hit = cascade.judged(universe, "key", "hit")
    assert hit.count() == 3000 and hit.where("hit").select("key").exceptAll(listed).count() == 0
    assert hit.where("hit").count() == listed.count()
    # far too few bits: more levels, still exact
    tight = url_cascade.Cascade(universe.where("length(key) < 4"), listed, max_bits=64)
    assert tight.judged(universe.where("length(key) < 4"), "key", "hit").where("hit").count() == listed.where("length(key) < 4").count()


def test_url_verdicts_of_nothing(spark):
    assert url_cascade.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_fragments_are_ranges_of_the_order(spark):
    grams = sorted([-(1 << 63), -(1 << 62), -1, 0, 1, 1 << 62, (1 << 63) - 1])
    got = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g long").coalesce(1).select(ngram_join._fragment(F.col("g"), 8)).collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 7 and got[2:4] == [3, 4]


def test_sets_of_one_first_digest_stay_apart():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1, 2]), pa.array(["a b c d e f", "g h"])], ["doc_id", "text"])
    (_, _, nodes, other), (_, _, apart, _) = next(ngram_join._batches_of_sets(iter([batch]), 5)), next(ngram_join._batches_of_sets(iter([batch]), 5, frozenset()))
    assert nodes.tolist() == apart.tolist() and len({*nodes.tolist(), *other.tolist()}) == 4
    (_, _, second, _) = next(ngram_join._batches_of_sets(iter([batch]), 5, frozenset([int(nodes[0])])))
    assert second.tolist() == [other[0], nodes[1]]


@pytest.mark.parametrize("kind", ["ids", "hashed", "none", "mixed"])
def test_next_text_by_families_and_blocks(spark, kind, monkeypatch):
    monkeypatch.setattr(winnowing, "BLOCK_ROWS", 3)
    monkeypatch.setattr(winnowing, "FAMILIES", 5)
    rng = random.Random(11)
    n = 150
    ids = {
        "ids": list(range(n)), "hashed": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)], "none": [None] * n,
        "mixed": [7 if i % 3 == 0 else None if i % 3 == 1 else rng.randrange(50) for i in range(n)],
    }[kind]
    texts = [f"t{rng.randrange(60)}" if i % 10 else None for i in range(n)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    got = winnowing.with_next_text(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t or "") for i, t in zip(ids, texts))
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for t in {t or "" for t in texts}], "text string").select("text", F.shiftrightunsigned(F.xxhash64("text"), 11).alias("h")).collect()}
    order = sorted(((i is None, -(i or 0), hashes[t or ""], t or "", i) for i, t in zip(ids, texts)), key=lambda x: x[:4])
    want = [(str(x[4]), x[3], order[(k + 1) % n][3]) for k, x in enumerate(order)]
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in got) == sorted(want)


def test_long_texts_cross_the_working_pieces(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    long = " ".join(word() for _ in range(700_000))  # 4.9 MB
    texts = [long, long.replace(long[:40], "other start"), "x" * 3_000_000, "under the mit license " + long, None]
    docs = table(spark, texts).cache()
    parts = {r.doc_id: r for r in ngram_join.ngram_jaccard_components(docs).collect()}
    w = long.split()
    assert parts[0].n_shingles == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) and parts[0].component_id == parts[1].component_id == parts[3].component_id == 0
    assert (parts[2].n_shingles, parts[2].component_id, parts[4].n_shingles) == (1, 2, 0)
    scan = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (scan[3].n_words, scan[3].base_labels, scan[0].n_words) == (700_004, "mit", 700_000)
    few = docs.where("doc_id in (2, 4)")
    print_of = {r.doc_id: r for r in winnowing.winnowing_fingerprints(few).collect()}
    assert print_of[2].n_chars == 3_000_000 and print_of[2].edited_sha256 == sha("x" * 1_500_000)


def test_sharding_without_ids_and_by_stored_maps(spark, tmp_path):
    rng = random.Random(13)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 400))) for _ in range(3000)]
    docs = table(spark, texts, [None if i % 2 else 5 for i in range(3000)])
    maps = str(tmp_path / "maps")
    rows = virtual_shards.sharded(docs, maps=maps).collect()
    want = sorted((str(5 if i % 2 == 0 else None), len(t) + 1, zlib.crc32(t.encode())) for i, t in enumerate(texts))
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    fill = {}
    for r in rows:
        fill[r.shard] = fill.get(r.shard, 0) + r["size"]
    assert len(fill) == 16 and max(fill.values()) <= 1.01 * min(fill.values())
    assert {r.map_version for r in rows} == {2} and virtual_shards.SlotMap.load(spark, maps, 1) == virtual_shards.SlotMap.dealt(16)
    # the same records and the stored map: nothing moves, and no version is added
    again = virtual_shards.sharded(docs, maps=maps).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    # one more shard: slots move only into it, but for the edit that evens sizes out afterwards
    more = virtual_shards.sharded(docs, 17, maps=maps)
    assert more.agg(F.count_distinct("shard")).first()[0] == 17 and more.first().map_version >= 3
    old, grown = virtual_shards.SlotMap.load(spark, maps, 2), virtual_shards.SlotMap.load(spark, maps, 3)
    assert all(b == 16 for a, b in zip(old.shards, grown.shards) if a != b)


def test_mixing_without_ids(spark):
    rng = random.Random(14)
    texts = ["w " * rng.randint(1, 40) + str(i) for i in range(4000)]
    docs = table(spark, texts, [None if i % 2 else 5 for i in range(4000)]).withColumnsRenamed({"gram": "threshold", "size": "epochs", "node": "hash"})
    by = {}
    for r in mixing.mix_sources(docs).collect():
        taken, _ = by.get(r.source, (0, 0))
        by[r.source] = (taken + r.taken, r.target)
    assert all(abs(taken - target) <= 50 for taken, target in by.values())


def brute_expression(tokens):
    """A licence expression's value by recursive descent."""
    def atom():
        t = tokens.pop(0)
        if t == "(":
            x = either()
            assert tokens.pop(0) == ")"
            return x
        x = license_scan.freedom(t)
        while tokens and tokens[0] == "with":
            tokens.pop(0)
            tokens.pop(0)
            x += (1 - x) * license_scan.EXCEPTION_GAIN
        return x

    def both():
        x = atom()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            x = min(x, atom())
        return x

    def either():
        x = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            x = max(x, both())
        return x

    return either()


def test_license_scan_against_brute_force(spark):
    rng = random.Random(15)
    names = ["mit", "apache-2.0", "gpl-3.0-or-later", "cc-by-nc-4.0", "hello", "mitre", "licenseref-own", "bsd-3-clause"]
    phrases = {**license_scan.BASE_PHRASES, **license_scan.NOTICES}
    texts, want = [None, ""], [(0, 0, None, None, "", "", 0.0)] * 2

    def expression(depth=0):
        if depth > 3 or rng.random() < 0.4:
            return [rng.choice(names), *(["with", "classpath-exception-2.0"] if rng.random() < 0.2 else [])]
        inner = [*expression(depth + 1), rng.choice(["and", "or"]), *expression(depth + 1)]
        return ["(", *inner, ")"] if rng.random() < 0.4 else inner

    for _ in range(300):
        parts, values, labels = [], [], set()
        for _ in range(rng.randint(0, 12)):
            k = rng.random()
            if k < 0.3:
                parts.append(rng.choice(list(phrases)).upper().replace(" ", rng.choice([" ", ", ", "\n"])))
            elif k < 0.5:
                tokens = expression()
                labels |= {t for i, t in enumerate(tokens) if license_scan.family(t) and (i == 0 or tokens[i - 1] != "with")}
                parts.append("\n" + rng.choice(["SPDX-License-Identifier:", "License-Expression:"]) + " " + " ".join(tokens).upper() + "\n")
                values.append(brute_expression(list(tokens)))
            else:
                parts.append(rng.choice(["\u00c4rger", "the", "under", "mit license", "x9", "..."]))
        text = " ".join(parts)
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        starts, base = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            if found:
                labels.add(label)
                values.append(license_scan.freedom(label))
            if found and phrase in license_scan.BASE_PHRASES:
                starts += found
                base.add(label)
        texts.append(text)
        want.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(values, default=0.0)))
    rows = license_scan.license_scan(table(spark, texts)).orderBy("doc_id").collect()
    for r, w in zip(rows, want):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == w[:6] and r.score == pytest.approx(w[6])
    assert license_scan.license_scan(table(spark, ["x"]).where("doc_id < 0")).count() == 0


def test_empty_tables(spark):
    import public_tokenizers

    none = table(spark, ["x"]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.quality_verdicts(none, labels).count() == 0 and quality_rules.good_documents(none, labels).count() == 0
    assert bpe_chunks.bpe_encode(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert mixing.mixed_documents(none).count() == 0


def test_good_documents_are_those_that_are_kept(spark):
    rng = random.Random(16)
    clean, junk = "some clean words that differ number {} and more of it so on", "| junk | {} | words | with | marks | all | over | it |"
    docs = table(spark, [(junk if rng.random() < 0.3 else clean).format(i) for i in range(9000)] + [None, "a b c d e f g h i j a b c d e"])
    labels = spark.createDataFrame([(r.doc_id, int("junk" not in r.text), 0) for r in docs.where("doc_id < 8000").collect()], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.quality_verdicts(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.good_documents(docs, labels).collect()} == kept and 5000 < len(kept) < 8000


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(17)
    texts = [" ".join(rng.choice("ab" if k % 3 else "abcdefgh") for _ in range(rng.randint(0, 60))) for k in range(200)]

    def brute(text):
        w = text.split()
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)})

    rows = quality_rules.quality_verdicts(table(spark, texts), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r.n_repeat_words == brute(texts[r.doc_id]) for r in rows)
