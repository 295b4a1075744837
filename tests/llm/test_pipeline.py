"""The corpus pipeline against a brute-force version of its stages."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from readloom.llm import queries as llm_queries
from tests.llm.test_operators import brute_components, near_copies, table


def test_every_operator_has_a_query():
    names = entry.queries()
    assert set(llm_queries.queries()) < set(names)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(llm_queries.oracle_sql()) <= set(names)


def test_stages_on_a_small_corpus(spark, tmp_path):
    texts = near_copies(8, groups=4, size=4)
    docs = table(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    held = {r.doc_id: r.text for r in kept.collect()}
    assert all(len(texts[i].split()) >= 10 for i in held) and len(held) > 20
    unique = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path))
    ids = sorted(held)
    want = {c for _, _, c in brute_components([held[i] for i in ids], ids)}
    assert {r.doc_id for r in unique.collect()} == want and unique.columns == docs.columns
    mixed = corpus_pipeline.mix(spark, unique, str(tmp_path))
    assert mixed.columns == docs.columns
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixed.collect())
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_one_row_of_each_group_stays(spark):
    base = [" ".join(f"{k}{i}" for i in range(60)) for k in "abcd"]
    near = base[0].replace("a59", "z")
    texts = [base[0], near, base[1], base[0], base[2], base[2], base[3], base[3], None, ""]
    ids = [5, 7, 7, None, None, None, 9, 9, None, None]
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(5, base[0]), (7, base[1]), (None, base[2]), (9, base[3]), (None, None), (None, "")]))


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = table(spark, ["x"]).where("doc_id < 0")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_token_ids_go_to_training_shards(spark, tmp_path):
    from readloom.llm import training_order

    docs = table(spark, ["one two three", None, "four"], [1, None, 1])
    rows = corpus_pipeline.encode(spark, docs, "")
    path = str(tmp_path / "ids")
    rows.write.parquet(path)
    folder = str(tmp_path / "shards")
    manifest = training_order.write_training_order(spark.read.parquet(path), folder, sequence=4, shard=2, ids="ids", end=49408)
    tokens = sorted(t for batch in training_order.records_from(folder) for r in batch for t in r["tokens"][: r["used"]].tolist())
    want = sorted([t for r in rows.collect() for t in r.ids] + [49408] * 3)
    assert tokens == want and manifest["stride"] == 16 + 2 * 4
