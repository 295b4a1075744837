"""Read operators: hand-checked cases, round trips, and the SQL twins on the smallest tables."""

import gzip
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from readloom import model as m
from readloom.functions import aux, cigar, murmur, names, sequences
from readloom.operators import aggregates, checksums, duplicates, filters, folds, intervals, orders, pairs, reference, transforms
from readloom.plans import catalog, fixture
from readloom.sources import bam, blast, fastq, sam

SF = "/root/testdata/sf0.001"


def reads(spark, rows):
    """Alignments from dicts with defaults; cigar and aux as text."""
    base = {"flag": 0, "refid": 0, "pos": 10, "mapq": 60, "cigar": "8M", "mate_refid": -1, "mate_pos": -1, "tlen": 0, "seq": "ACGTACGT", "qual": "IIIIIIII", "aux": ""}
    full = [{"rank": i, "qname": f"q{i}"} | base | r for i, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(r[c] for c in m.ALIGNMENTS.names) for r in full], "rank long, qname string, flag int, refid int, pos int, mapq int, cigar string, mate_refid int, mate_pos int, tlen int, seq string, qual string, aux string")
    return df.withColumns({"cigar": cigar.parse(F.col("cigar")), "aux": aux.parse(F.col("aux"))})


def text_of(df):
    return df.withColumns({"cigar": cigar.to_text(F.col("cigar")), "aux": aux.to_text(F.col("aux"))})


@pytest.mark.parametrize("text, query, ref", [("4S20M2D8M", 32, 30), ("10M3I19M", 32, 29), ("12M5N20M", 32, 37), ("*", 0, 0), ("2H3S5=1X4S1H", 13, 6)])
def test_cigar_lengths(spark, text, query, ref):
    c = cigar.parse(F.lit(text))
    row = spark.range(1).select(cigar.query_length(c).alias("q"), cigar.reference_length(c).alias("r"), cigar.to_text(c).alias("t")).first()
    assert tuple(row) == (query, ref, text)


def test_unclipped_coordinate_and_interval(spark):
    df = reads(spark, [{"cigar": "4S20M2D8M"}, {"cigar": "4S20M2D8M", "flag": 16}, {"cigar": "20M2S3H", "flag": 16}])
    five = cigar.unclipped_five_prime(F.col("cigar"), F.col("pos"), F.col("flag"))
    assert [r[0] for r in df.orderBy("rank").select(five).collect()] == [6, 39, 34]
    tagged = transforms.tag_reference_interval(df).orderBy("rank").select(aux.value(F.col("aux"), "re")).first()
    assert tagged[0] == "[10,40)"


def test_natural_order(spark):
    got = spark.createDataFrame([("A15",), ("B12",), ("A9",), ("A12",), ("A009",), ("",), ("A12b",)], "n string").orderBy(names.natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["", "A9", "A009", "A12", "A12b", "A15", "B12"]


def test_names_of_pairs(spark):
    df = reads(spark, [{"qname": "12_15_HS5", "flag": 65}, {"qname": "12_15_HS5", "flag": 129}, {"qname": "_007_x", "flag": 129}, {"qname": "plain", "flag": 65}, {"qname": "1_2_both", "flag": 193}])
    split = transforms.split_pair_name(df)
    assert [r.qname for r in split.orderBy("rank").collect()] == ["12_HS5", "15_HS5", "7_x", "plain", "1_2_both"]
    assert [r.qname for r in transforms.strip_name_rank(split).orderBy("rank").collect()] == ["HS5", "HS5", "x", "plain", "1_2_both"]


def test_kmer_poisson(spark):
    p = sequences.kmer_poisson(F.lit(10), {"A": F.lit(1), "C": F.lit(0), "G": F.lit(0), "T": F.lit(0)}, F.lit(0), dict.fromkeys("ACGT", 0.25))
    assert spark.range(1).select(p).first()[0] == pytest.approx(0.0820849986)


def test_adapter_clip_and_back(spark):
    rows = [
        {"aux": "as:i:3", "cigar": "8M"}, {"aux": "as:i:3", "cigar": "8M", "flag": 16}, {"aux": "as:i:3", "cigar": "2S4M2D2S1H"},
        {"aux": "as:i:3", "cigar": "1H3S5M", "flag": 16}, {"aux": "a3:i:7"}, {"aux": "as:i:2", "cigar": "*", "flag": 4}, {"aux": ""},
    ]
    clipped = text_of(transforms.clip_adapters(reads(spark, rows))).orderBy("rank").collect()
    assert [(r.cigar, r.pos, r.seq) for r in clipped] == [("5M3H", 10, "ACGTA"), ("3H5M", 13, "TACGT"), ("2S3M4H", 10, "ACGTA"), ("4H5M", 10, "TACGT"), ("8M", 10, "ACGTACGT"), ("*", 10, "ACGTAC"), ("8M", 10, "ACGTACGT")]
    assert "qs:Z:CGT" in clipped[0].aux and "qs:Z:ACG" in clipped[1].aux
    back = text_of(transforms.reinsert_clips(transforms.clip_adapters(reads(spark, rows)))).orderBy("rank").collect()
    assert [r.cigar for r in back[:3]] == ["5M3S3H", "3H3S5M", "2S3M3S4H"] and back[0].seq == "ACGTACGT" and "qs" not in back[0].aux


def test_reset_of_reverse_reads(spark):
    row = text_of(transforms.reset(reads(spark, [{"flag": 16, "seq": "AACG", "qual": "1234", "cigar": "4M", "aux": "NM:i:0"}]))).first()
    assert (row.flag, row.refid, row.pos, row.mapq, row.cigar, row.seq, row.qual, row.aux) == (4, -1, -1, 0, "*", "CGTT", "4321", "")
    df = reads(spark, [{"flag": 256}, {"flag": 1024}])
    assert transforms.reset(df).count() == 1 and transforms.reset(df, "UNMAP").count() == 0 and transforms.reset(df, "DUP").count() == 2


def test_fragment_duplicates_keep_the_best(spark):
    df = reads(spark, [{"qual": "!!!!!!!!"}, {}, {"qual": "00000000"}, {"pos": 11, "cigar": "1S7M"}, {"flag": 16}, {"refid": 1}, {"flag": 256}])
    marked = {r.rank: r.flag for r in duplicates.mark_duplicates(df).collect()}
    assert {k for k, f in marked.items() if f & 1024} == {0, 2, 3} and len(marked) == 7
    assert duplicates.mark_duplicates(df, remove=True).count() == 4


def test_pairs_beat_fragments_and_tags_divide(spark):
    pair = lambda name, tag: [{"qname": name, "flag": 65, "aux": f"RX:Z:{tag}"}, {"qname": name, "flag": 145, "pos": 50, "aux": f"RX:Z:{tag}"}]
    df = reads(spark, [*pair("a", "AC"), *pair("b", "GT"), {"qname": "c", "qual": "JJJJJJJJ"}])
    lost = lambda **k: {(r.rank, r.kind) for r in duplicates.duplicate_ranks(df, **k).collect()}
    assert lost() == {(2, "pair"), (3, "pair"), (4, "fragment")}
    assert lost(tag="RX") == set()
    with pytest.raises(ValueError):
        lost(tag="RX", nucleotide_tag="RX")


def test_reference_comparison(spark):
    ref = spark.createDataFrame([(0, "acgtacgtacgtacgt")], "refid int, seq string")
    rows = [{"pos": 0, "seq": "ACGAACGT"}, {"pos": 0, "cigar": "4M2D4M", "seq": "ACGTGTAC"}, {"pos": 2, "cigar": "2M1I5M", "seq": "GTTACGTA"}, {"pos": 12}, {"flag": 4, "cigar": "*"}, {"pos": 0, "cigar": "8=", "seq": "ACGTACGA"}]
    got = text_of(reference.mismatch_tags(reads(spark, rows), ref)).orderBy("rank").collect()
    assert [r.aux for r in got[:3]] == ["MD:Z:3T4|NM:i:1", "MD:Z:4^AC4|NM:i:2", "MD:Z:7|NM:i:1"]
    assert [r.aux for r in got[3:5]] == ["", ""]
    exact = text_of(reference.exact_cigars(reads(spark, rows), ref)).orderBy("rank").collect()
    assert [(r.rank, r.cigar) for r in exact] == [(0, "3=1X4="), (1, "4=2D4="), (2, "2=1I5="), (4, "*"), (5, "7=1X")]
    checked = text_of(reference.checked_alignments(reads(spark, rows), ref)).orderBy("rank").collect()
    assert [(r.rank, r.seq) for r in checked] == [(0, "===A===="), (1, "========"), (2, "==T====="), (4, "ACGTACGT")]


def brute_reference(row, ref):
    """(exact cigar, MD, NM) of a read with cigar, pos and seq, base by base."""
    q, r, ops, md, run, nm, gap = 0, row["pos"], [], "", 0, 0, False
    for n, op in re.findall(r"(\d+)([A-Z=])", row["cigar"]):
        for _ in range(int(n)):
            read = row["seq"][q] if op in "MIS=X" else ""
            base = ref[r] if op in "MDN=X" else ""
            q, r = q + len(read), r + len(base)
            if op in "M=X":
                ops.append("=" if read == base else "X")
                md, run, nm, gap = (md, run + 1, nm, False) if read == base else (md + f"{run}{base}", 0, nm + 1, False)
            else:
                ops.append(op)
                nm += op in "ID"
                if op == "D":
                    md, run, gap = md + ("" if gap else f"{run}^") + base, 0, True
    return "".join(f"{len(list(g))}{k}" for k, g in itertools.groupby(ops)), md + str(run), nm


def test_spans_over_several_pieces(spark):
    rng = random.Random(3)
    bases = "".join(rng.choice("ACGT") for _ in range(150_000))
    rows = []
    for pos, text in [(16_380, "4M60000N4M"), (0, "5M2D20000N3M1I2M"), (16_300, "40000M"), (149_992, "8M"), (149_993, "8M"), (100, "2S3M140000N3M")]:
        r, seq = pos, ""
        for n, op in re.findall(r"(\d+)([A-Z])", text):
            seq += bases[r : r + int(n)] if op == "M" else "T" * int(n) if op in "IS" else ""
            r += int(n) if op in "MDN" else 0
        rows.append({"pos": pos, "cigar": text, "seq": seq[:-2] + "A" + seq[-1:] if len(seq) > 7 else seq, "qual": "I" * len(seq)})
    ref = spark.createDataFrame([(0, bases.lower())], "refid int, seq string")
    want = {i: brute_reference(r, bases) for i, r in enumerate(rows) if i != 4}
    exact = text_of(reference.exact_cigars(reads(spark, rows), ref)).collect()
    assert {r["rank"]: r.cigar for r in exact} == {i: w[0] for i, w in want.items()}
    tags = text_of(reference.mismatch_tags(reads(spark, rows), ref)).collect()
    assert {r["rank"]: r.aux for r in tags} == {i: f"MD:Z:{want[i][1]}|NM:i:{want[i][2]}" if i in want else "" for i in range(len(rows))}
    assert sorted(r["rank"] for r in reference.checked_alignments(reads(spark, rows), ref).select("rank").collect()) == sorted(want)


def test_mismatch_tags_of_all_cigars(spark):
    made = [hashlib.md5(str(n).encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4)) * 35 for n in range(4)]
    rows = text_of(fixture.alignments(spark, SF)).select("rank", "refid", "pos", "cigar", "seq", "flag").collect()
    want = {r["rank"]: brute_reference(r.asDict(), made[r.refid])[1:] if r.refid >= 0 else (None, None) for r in rows}
    got = {r["rank"]: (r.md, r.nm) for r in catalog.QUERIES["c18_mismatch_tags"](spark, SF).collect()}
    assert got == want and len({r.cigar for r in rows}) == 6


def test_depth_over_tiles_and_gaps(spark):
    df = reads(spark, [{"cigar": "4M2D4M"}, {"pos": 12, "cigar": "2S3M3N3M"}])
    for tile in (2, 64):
        got = {r.pos: r.depth for r in aggregates.depth(aggregates.aligned_blocks(df), tile).collect()}
        assert got == {10: 1, 11: 1, 12: 2, 13: 2, 14: 1, 16: 1, 17: 1, 18: 2, 19: 2, 20: 1}


def test_consensus_with_inserts_and_ties(spark):
    df = reads(spark, [{"cigar": "2M2I4M", "seq": "ACTTGTAC"}, {"cigar": "8M", "seq": "ACGTACGT"}, {"cigar": "1M1D7M", "seq": "ATTTTTTT"}])
    got = {(r.pos, r.column): (r.bases, r.consensus) for r in aggregates.consensus(aggregates.pileup(df)).collect()}
    assert got[12, -2] == ("**T", "*") and got[11, 0] == ("*CC", "C") and got[10, 0] == ("AAA", "A") and got[12, 0] == ("GGT", "G")
    assert got[16, 0][1] == "N"


def test_intervals(spark):
    iv = spark.createDataFrame([("g", "a", 0, 17, 20), ("g", "b", 0, 0, 9), ("g", "c", 1, 0, 99), ("h", "d", 0, 5, 5000)], "gene string, name string, refid int, from int, to int")
    df = reads(spark, [{}, {"flag": 4, "cigar": "*"}])
    for width in (1, 4, 4096):
        assert sorted(r.name for r in intervals.overlaps(df, iv, width).collect()) == ["a", "d"]
    row = text_of(intervals.annotate(df, iv)).orderBy("rank").collect()
    assert [r.aux for r in row] == ["CO:Z:(h,d);(g,a)", ""]


def shuffled(spark, df):
    """(records, bytes) of the largest shuffle while df is run, without broadcasts."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._gateway.jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, none, None)
        return {s.stageId(): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in (found.apply(i) for i in range(found.size()))}

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = stages()
        df.write.format("noop").mode("overwrite").save()
        new = [v for k, v in stages().items() if k not in before]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    return max(r for r, _ in new), max(b for _, b in new)


def test_interval_overlaps_shuffle_little(spark, tmp_path):
    lineitem = spark.read.parquet(f"{SF}/lineitem.parquet")
    again = lineitem.where("l_orderkey % 3 = 0").withColumns({"l_extendedprice": F.col("l_extendedprice") / 2, "l_returnflag": F.lit("Z")})
    lineitem.unionByName(again).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")  # rows that only the last columns of the order tell apart
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for t in ("part", "region"):
        os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES["e10_interval_overlaps"](spark, str(tmp_path))
    found = con.execute(f"SELECT rank, gene, name FROM ({catalog.ORACLE_SQL['e10_interval_overlaps']}) x").fetchall()
    assert len(found) > 1000 and sorted(found) == sorted(tuple(r) for r in df.collect())
    rows, size = shuffled(spark, df)
    assert size < 30 * rows


def test_overlaps_deal_reads_in_order_of_their_spans(spark):
    iv = spark.createDataFrame([("g", "a", 0, 0, 499), ("g", "b", 0, 400, 2000)], "gene string, name string, refid int, from int, to int")
    df = reads(spark, [{}]).drop("rank").crossJoin(spark.range(20_000, numPartitions=2)).withColumns({"rank": F.col("id"), "pos": (F.col("id") * 7919 % 900).cast("int")})
    df = intervals.overlaps(df, iv).select("rank", "name")
    want = [(i, name) for i in range(20_000) for name, s, e in (("a", 0, 499), ("b", 400, 2000)) if i * 7919 % 900 <= e and i * 7919 % 900 + 7 >= s]
    assert sorted(tuple(r) for r in df.collect()) == want
    rows, size = shuffled(spark, df)
    assert rows >= 20_000 and size < 12 * rows


def test_rank_tag_holds_bytes_above_24_bits(spark):
    rows = [36_000_000, (1 << 24) - 1, 1 << 24, (1 << 40) + 258]
    df = transforms.rank_to_tag(reads(spark, [{"rank": r} for r in rows]))
    got = {r["rank"]: r.aux for r in text_of(df).collect()}
    assert got == {r: "zz:B:C," + ",".join(str(b) for b in r.to_bytes(8, "big")) for r in rows}
    assert {r.qname.split("_")[0] for r in transforms.rank_to_name(df).collect()} == {str(r) for r in rows}


def test_annotate_sends_notes_once_a_span(spark):
    iv = spark.createDataFrame([(f"g{i % 7}", f"n{i * 7919 % 1000}", 0, i % 10, 12 + i % 90) for i in range(400)], "gene string, name string, refid int, from int, to int")
    df = reads(spark, [{"aux": "AB:Z:x"}] * 300 + [{"flag": 4, "cigar": "*"}, {"refid": -1}, {"refid": 3}]).persist()
    text = ";".join(f"({r.gene},{r.name})" for r in sorted(iv.collect(), key=lambda r: (r["from"], r["to"], r.name)))
    assert [r.aux for r in text_of(intervals.annotate(df, iv)).orderBy("rank").collect()] == ["AB:Z:x|CO:Z:" + text] * 300 + [""] * 3
    assert shuffled(spark, intervals.annotate(df, iv))[1] < 100_000
    df.unpersist()


def test_comment_pairs_of_many_names(spark):
    names_ = ";".join(f"n{i:02d}" for i in range(30))
    df = reads(spark, [{"qname": f"template{i}", "flag": 1 + 64 * n, "aux": f"CO:Z:{names_};n00"} for i in range(20) for n in (1, 2)] + [{"qname": "template3", "flag": 65, "aux": "CO:Z:n07"}])
    got = {(r.name1, r.name2): (r.n, r.reads) for r in aggregates.comment_pairs(df).collect()}
    every = ",".join(sorted(f"template{i}" for i in range(20)))
    assert len(got) == 465 and got["n00", "n01"] == (20, every) and got["n07", "n09"] == (21, every)
    assert shuffled(spark, aggregates.comment_pairs(df))[0] < 3000


def test_comment_pairs_unite_intervals_of_a_gene(spark, monkeypatch):
    iv = spark.createDataFrame([(f"g{i % 2}", f"n{i}", i % 4, 0, 900 + i) for i in range(400)], "gene string, name string, refid int, from int, to int")
    monkeypatch.setattr(fixture, "intervals", lambda spark, sf_dir: iv)
    df = catalog.QUERIES["f15_comment_pairs"](spark, SF)
    assert {(r.name1, r.name2) for r in df.collect()} == {("g0", "g0"), ("g0", "g1"), ("g1", "g1")}
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        name = p.nodeName()
        rows = p.metrics().get("numOutputRows")
        most = max(most, rows.get().value()) if "Join" in name and rows.isDefined() else most
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else []
        plans += inner or [p.children().apply(i) for i in range(p.children().size())]
    assert 0 < most < 20_000  # of 6000 reads


def test_genes_of_reads(spark):
    iv = spark.createDataFrame([("g", "a", 0, 17, 20), ("g", "b", 0, 12, 17), ("g", "c", 0, 0, 9), ("h", "d", 0, 5, 5000), ("i", "e", 0, 15, 12), ("j", "f", 1, 0, 99)], "gene string, name string, refid int, from int, to int")
    got = intervals.annotate_genes(reads(spark, [{}, {"flag": 4, "cigar": "*"}, {"pos": 30}, {"pos": 9000}, {"refid": 1}]), iv)
    assert {r.rank: sorted(r.aux.removeprefix("CO:Z:").split(";")) for r in text_of(got).collect()} == {0: ["g", "h"], 2: ["h"], 4: ["j"]}


def test_chain_and_cluster(spark):
    rows = [{"qname": "r", "pos": 100, "cigar": "4M4S", "aux": "AS:i:4"}, {"qname": "r", "pos": 300, "cigar": "2S5M1S", "aux": "AS:i:9"}, {"qname": "r", "pos": 105, "cigar": "5S3M", "aux": "AS:i:6"}]
    chain = folds.best_mappings(reads(spark, rows), "chain").orderBy("rank").collect()
    assert [(r.rank, r.flag, r.mate_pos) for r in chain] == [(0, 0, 105), (2, 2048, 100)]
    kept = {r.rank for r in folds.best_mappings(reads(spark, rows), "cluster").collect()}
    assert kept == {0, 2}


def test_checksums_ignore_order_and_mapping(spark):
    df = reads(spark, [{"aux": "RG:Z:a"}, {"flag": 512, "seq": "AAAACCCC"}, {"flag": 256}])
    one = sorted(map(str, checksums.checksum_sums(df).collect()))
    assert one == sorted(map(str, checksums.checksum_sums(df.orderBy(F.desc("rank")).withColumn("pos", F.lit(3))).collect()))
    turned = df.withColumns({"flag": F.col("flag").bitwiseXOR(16), "seq": sequences.reverse_complement(F.col("seq")), "qual": F.reverse("qual")})
    assert sorted(map(str, checksums.checksum_products(df).collect())) == sorted(map(str, checksums.checksum_products(turned.repartition(3)).collect()))


def test_murmur(spark):
    def plain(data, seed=0):
        """Word by word with Python's numbers."""
        mask, c1, c2 = 2**64 - 1, 0x87C37B91114253D5, 0x4CF5AD432745937F
        turn = lambda x, n: (x << n | x >> 64 - n) & mask
        h1 = h2 = seed
        for at in range(0, len(data) + 1, 16):
            block = data[at : at + 16]
            k1, k2 = int.from_bytes(block[:8], "little"), int.from_bytes(block[8:], "little")
            k1, k2 = turn(k1 * c1 & mask, 31) * c2 & mask, turn(k2 * c2 & mask, 33) * c1 & mask
            if len(block) < 16:
                h1, h2 = h1 ^ k1, h2 ^ k2
                break
            h1 = ((turn(h1 ^ k1, 27) + h2) * 5 + 0x52DCE729) & mask
            h2 = ((turn(h2 ^ k2, 31) + h1) * 5 + 0x38495AB5) & mask
        h1, h2 = h1 ^ len(data), h2 ^ len(data)
        h1 = (h1 + h2) & mask
        h2 = (h2 + h1) & mask
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h1, h2 = (h1 ^ h1 >> 33) * factor & mask, (h2 ^ h2 >> 33) * factor & mask
        h1, h2 = h1 ^ h1 >> 33, h2 ^ h2 >> 33
        h1 = (h1 + h2) & mask
        return f"{h1:016x}{(h2 + h1) & mask:016x}"

    assert plain(b"hello") == "cbd8a7b341bd9b025b1e906a48ae1d19"  # the known value
    texts = ["", "hello", "a" * 15, "b" * 16, "c" * 17, "äöü" * 9, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for seed in (0, 7):
        got = df.select("t", murmur.murmur3(F.col("t"), seed).alias("h"), murmur.folded(murmur.murmur3(F.col("t"), seed)).alias("f")).collect()
        assert [r.h for r in got] == [None if t is None else plain(t.encode(), seed) for t in texts]
        words = [int(got[1].h[i : i + 8], 16) for i in (0, 8, 16, 24)]
        assert got[1].f == words[0] ^ words[1] ^ words[2] ^ words[3]
    kept = filters.downsample_by_murmur(reads(spark, [{"qname": f"n{i // 2}"} for i in range(400)]), 0.5, 1).groupBy("qname").count().collect()
    assert 60 < len(kept) < 140 and {r["count"] for r in kept} == {2}


def test_checksums_of_all_kinds(spark):
    rows = [{"aux": "RG:Z:a"}, {"aux": "RG:Z:b", "flag": 512, "seq": "AAAACCCC"}, {"aux": "RG:Z:b", "flag": 81, "seq": "AAAACCCC"}, {"flag": 256}]
    df = reads(spark, rows).repartition(3)
    texts = {"a": [(True, "0\0ACGTACGT")], "b": [(False, "0\0AAAACCCC"), (True, "65\0GGGGTTTT")]}
    number = {"crc32": lambda t: zlib.crc32(t), "md5": lambda t: int(hashlib.md5(t).hexdigest(), 16), "sha384": lambda t: int(hashlib.sha384(t).hexdigest(), 16), "sha512": lambda t: int(hashlib.sha512(t).hexdigest(), 16)}
    cases = {"crc32": ("crc32", None, 2**32), "md5": ("md5", None, 2**128), "sha384": ("sha384", None, 2**384), "sha512primesums": ("sha512", None, 2**521 - 1), "crc32prod": ("crc32", 2**31 - 1, None), "md5prime64": ("md5", 2**64 - 59, None), "sha512prime256": ("sha512", 2**256 - 189, None)}
    for name, (kind, prime, modulus) in cases.items():
        got = {(r.rg, r.pass_only): (r.n, int(r.b_seq, 16)) for r in checksums.checksums(df, name).collect()}
        want = {}
        for rg in ("a", "b", None):
            for only in (False, True):
                values = [number[kind](t.encode()) for g, rows_ in texts.items() if rg in (g, None) for ok, t in rows_ if ok or not only]
                want[rg, only] = (len(values), sum(values) % modulus if modulus else math.prod(values) % prime)
        assert got == want, name
    # the older form of the same products
    old = {(r.rg, r["pass"]): r.b_seq for r in checksums.checksum_products(df).collect()}
    assert old["a", True] == zlib.crc32(b"0\0ACGTACGT") % (2**31 - 1)
    with pytest.raises(ValueError):
        checksums.checksums(df, "md5prod")


def test_united_headers():
    one = "@HD\tVN:1.6\n@SQ\tSN:b\tLN:2\n@SQ\tSN:c\tLN:3\n@RG\tID:r\tSM:x\n@PG\tID:p\n"
    two = "@HD\tVN:1.5\n@SQ\tSN:a\tLN:1\n@SQ\tSN:b\tLN:2\n@RG\tID:r\tSM:y\n@PG\tID:q\tPP:p\n@PG\tID:p\tCL:z\n@CO\thi\n"
    head, renamed = sam.united_header([one, two])
    assert head.splitlines() == ["@HD\tVN:1.6", "@SQ\tSN:a\tLN:1", "@SQ\tSN:b\tLN:2", "@SQ\tSN:c\tLN:3", "@RG\tID:r\tSM:x", "@RG\tID:r.1\tSM:y", "@PG\tID:p", "@PG\tID:p.1\tCL:z", "@PG\tID:q\tPP:p.1", "@CO\thi"]
    assert renamed == [{"RG": {"r": "r"}, "PG": {"p": "p"}}, {"RG": {"r": "r.1"}, "PG": {"p": "p.1", "q": "q"}}]
    assert sam.united_header([one, one])[0] == one
    for bad in ("@SQ\tSN:c\tLN:3\n@SQ\tSN:b\tLN:2\n", "@SQ\tSN:b\tLN:9\n"):
        with pytest.raises(ValueError):
            sam.united_header([one, bad])


def test_library_sizes_and_returns(spark):
    rows = [("a", 1000, 200, 0), ("b", 50, 0, 0), ("c", 5000, 900, 100), ("d", 0, 0, 0)]
    metrics = spark.createDataFrame(rows, "lib string, read_pairs long, pair_duplicates long, optical_pair_duplicates long")
    sizes = {r.lib: r for r in duplicates.library_sizes(metrics).collect()}
    assert sizes["b"].library_size is None and sizes["d"].library_size is None
    for lib, pairs_, unique in (("a", 1000, 800), ("c", 4900, 4100)):
        size = sizes[lib].library_size
        # the equation changes its sign at the size
        sign = lambda x: unique / x - 1 + math.exp(-pairs_ / x)  # noqa: B023, E731
        assert sign(size - 1) > 0 > sign(size + 1)
    got = {(r.lib, r.bin): r.value for r in duplicates.return_histogram(duplicates.library_sizes(metrics), 3).collect()}
    assert set(got) == {(lib, b) for lib in "ac" for b in (1, 2, 3)}
    assert abs(got["a", 1] - 1) < 1e-2 and got["a", 2] == pytest.approx(sizes["a"].library_size * (1 - math.exp(-2000 / sizes["a"].library_size)) / 800)


def test_optical_duplicates_are_pairs(spark):
    pair = lambda name, q: [{"qname": name, "flag": 65, "qual": q * 8}, {"qname": name, "flag": 129, "pos": 90, "qual": q * 8}]
    rows = [*pair("t:1:10:10", "I"), *pair("t:1:50:60", "H"), *pair("t:1:500:10", "G"), *pair("t:2:10:10", "F"), {"qname": "t:1:11:11", "pos": 90}, {"qname": "t:1:12:12", "pos": 90}]
    df = reads(spark, rows)
    assert sorted(tuple(r) for r in duplicates.optical_duplicates(df).collect()) == [(2, "", "t:1:10:10"), (3, "", "t:1:10:10")]
    row = duplicates.library_metrics(df, duplicates.duplicate_ranks(df), optical=duplicates.optical_duplicates(df)).first()
    assert (row.pair_duplicates, row.optical_pair_duplicates, row.fragment_duplicates) == (3, 1, 2)
    assert [tuple(r) for r in duplicates.set_sizes(duplicates.duplicate_ranks(df)).collect()] == [("", 4, 1)]


def test_merged_tags_put_clips_back(spark):
    original = reads(spark, [{"aux": "as:i:3|qs:Z:TTT|qq:Z:###", "flag": 512}])
    aligned = reads(spark, [{"qname": "0_q0", "aux": "NM:i:0"}])
    row = text_of(pairs.merge_tags_by_rank(aligned, original, reinsert=True)).first()
    assert (row.qname, row.flag, row.cigar, row.seq, row.qual, row.aux) == ("q0", 512, "8M3S", "ACGTACGTTTT", "IIIIIIII###", "NM:i:0|as:i:3")
    tagged = transforms.rank_to_tag(reads(spark, [{}, {}])).where("rank = 1").withColumn("qname", F.lit("1_q1"))
    assert pairs.merge_tags_by_rank(tagged, reads(spark, [{}, {}]), old_rank_to_name=True).first().qname == "1_q1"


def test_post_ranks(spark):
    rows = [{"qname": "x", "flag": 65}, {"qname": "s", "flag": 0, "aux": "ZR:i:1"}, {"qname": "o", "flag": 129}, {"qname": "x", "flag": 145}, {"qname": "x", "flag": 321}]
    got = pairs.post_ranks(reads(spark, rows)).orderBy("rank").collect()
    assert [(r.rank, r.qname, r.flag, r.refid) for r in got] == [(0, "0_1_x", 77, -1), (1, "0_1_x", 141, -1), (2, "2_s", 4, -1), (3, "3_3_o", 141, -1)]
    assert [r.aux[-1].value for r in got] == [f"C,0,0,0,0,0,0,0,{i}" for i in (0, 3, 1, 2)]
    assert pairs.uncollated(reads(spark, rows), reset=True).count() == 4


def test_sam_and_bam_round_trips(spark, tmp_path):
    sq = spark.createDataFrame([(0, "chr1", 1000), (1, "chr2", 500)], "refid int, name string, length int")
    rows = [{"aux": "NM:i:3|RG:Z:a b|XA:A:c|XF:f:1.5|XB:B:s,1,-2", "cigar": "3S5M", "mate_refid": 1, "mate_pos": 7}, {"flag": 4, "refid": -1, "pos": -1, "cigar": "*", "qual": "*"}, {"seq": "ACGTN", "cigar": "5M", "qual": "!I~#5", "mate_refid": 0, "mate_pos": 99}]
    df = reads(spark, rows)
    plain = lambda d: sorted(str(r) for r in text_of(d).drop("rank").select(*m.ALIGNMENTS.names[1:]).collect())
    sam.write(df, sq, str(tmp_path / "x.sam"), "unknown")
    back, head = sam.read(spark, str(tmp_path / "x.sam"))
    assert plain(back) == plain(df) and sorted(map(tuple, head.collect())) == sorted(map(tuple, sq.collect()))
    assert bam.write(df, sq, str(tmp_path / "x.bam"), partitions=2) == 3
    again, head = bam.read(spark, str(tmp_path / "x.bam/*.bam"))
    assert plain(again) == plain(df) and head.count() == 2
    assert [r.qname for r in again.orderBy("rank").collect()] == ["q0", "q1", "q2"]
    with gzip.open(next(p for p in sorted((tmp_path / "x.bam").iterdir()))) as f:
        assert f.read(4) == b"BAM\1"


def test_fastq_loop(spark, tmp_path):
    text = "@A/1 x\nACGTACGT\n+\nHGFEDCBA\n@A/2\nAC.T\n+A/2\n@@@@\n@B\nTT\n+\n@I\n"
    path = tmp_path / "a.fq"
    path.write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    for name in ("a.fq", "b.fq.gz"):
        rows = fastq.to_alignments(fastq.read_fastq(spark, str(tmp_path / name)), group="g")
        assert [(r.qname, r.flag, r.seq, r.qual) for r in rows.orderBy("rank").collect()] == [("A", 77, "ACGTACGT", "HGFEDCBA"), ("A", 141, "ACNT", "@@@@"), ("B", 4, "TT", "@I")]
        out = fastq.from_alignments(rows).orderBy("rank").collect()
        assert [(r["class"], r.record.split("\n")[0]) for r in out] == [("F", "@A/1"), ("F2", "@A/2"), ("S", "@B")]
    with pytest.raises(Exception, match="bad record"):
        fastq.to_alignments(fastq.read_fastq(spark, str(path)), scheme="c18pe").collect()
    fastq.write_fastq(fastq.from_alignments(rows), str(tmp_path / "out"), by_group=True)
    assert (tmp_path / "out" / "rg=g" / "class=F").exists()


@pytest.mark.parametrize("split", [200, 333, 1 << 27])
def test_fastq_over_splits(spark, tmp_path, split):
    rng = random.Random(2)
    want = []
    for k, name in enumerate(("b.fq", "a.fq")):
        records = [(f"@r{k}_{i} note", "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))), rng.choice(["@", "+", "I"])) for i in range(200)]
        (tmp_path / name).write_text("".join(f"{n}\n{s}\n+\n{q * len(s)}\n" for n, s, q in records) + "\n" * k)
        want += [(n[1:], s, q * len(s)) for n, s, q in records]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        rows = fastq.read_fastq(spark, str(tmp_path)).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.name, r.seq, r.qual) for r in rows] == want[200:] + want[:200]


def test_fastq_that_lacks_lines(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nAC\n+\nII\n@b\nAC\n")
    with pytest.raises(ValueError, match="lacks lines"):
        fastq.read_fastq(spark, str(tmp_path / "x.fq"))
    (tmp_path / "y.fq").write_text("a\nAC\n+\nII\n")
    with pytest.raises(Exception, match="not a name line"):
        fastq.read_fastq(spark, str(tmp_path / "y.fq")).collect()
    (tmp_path / "z.fq").write_text("")
    assert fastq.read_fastq(spark, str(tmp_path / "z.fq")).count() == 0


def test_adapters_from_a_list(spark):
    a = "AGATCGGAAGAGCACACGTC"
    turned = a[::-1].translate(str.maketrans("ACGT", "TGCA"))
    wrong = "T" + a[1:5] + "A" + a[6:]
    seqs = ["C" * 10 + a + "TT", "C" * 10 + wrong, "C" * 40, "GG" + turned + "C" * 9, "C" * 20 + a[:12], ""]
    rows = [{"seq": s or "*", "flag": 0} for s in seqs] + [{"seq": ("C" * 10 + a).translate(str.maketrans("ACGT", "TGCA"))[::-1], "flag": 16}]
    adapters = spark.createDataFrame([("one", a), ("two", "GTGTGTGTCCAACCAACCAA")], "name string, seq string")
    got = [dict((t.tag, t.value) for t in r.aux) for r in folds.list_adapters(reads(spark, rows), adapters).orderBy("rank").collect()]
    assert [g.get("as") for g in got] == ["22", "20", None, "29", None, None, "20"]
    assert (got[0]["aa"], got[0]["af"], got[1]["af"]) == ("one", "1.0", "0.9") and 0.99 < float(got[0]["ar"]) <= 1


def test_adapters_from_overlaps(spark):
    rng = random.Random(3)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    insert, adapter = base(50), base(14)
    one, two = insert + adapter, turn(insert) + adapter
    rows = [{"qname": "p", "flag": 65, "seq": one}, {"qname": "p", "flag": 129 | 16, "seq": turn(two)}, {"qname": "n", "flag": 65, "seq": base(64)}, {"qname": "n", "flag": 129, "seq": base(64)}]
    got = text_of(folds.tag_overlap_adapters(reads(spark, rows))).orderBy("rank").collect()
    assert [r.aux for r in got] == ["ah:i:1|a3:i:14", "ah:i:1|a3:i:14", "", ""]
    found = folds.overlap_adapters(spark.createDataFrame([("p", one, two)], "qname string, seq1 string, seq2 string"))
    assert [tuple(r) for r in folds.overlap_histogram(found, 4).collect()] == [(50, 1, 25.0)]


def test_header_and_digest(spark, tmp_path):
    lines = spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:a\tLN:5",), ("q\t4",)], "value string")
    assert [r[0] for r in sam.reset_header(lines).collect()] == ["@HD\tVN:1.6", "q\t4"]
    assert [r[0] for r in sam.reset_header(lines, "@HD\tVN:1.5\n@CO\tx").collect()] == ["@HD\tVN:1.5", "@CO\tx", "q\t4"]
    lines.coalesce(1).write.text(str(tmp_path / "x"))
    assert sam.digest(str(tmp_path / "x"), "sha512") == hashlib.sha512(b"@HD\tVN:1.6\n@SQ\tSN:a\tLN:5\nq\t4\n").hexdigest()


def test_lists_and_tables(spark, tmp_path):
    (tmp_path / "names").write_text("a\n\n b \n")
    assert [r.qname for r in sam.name_list(spark, str(tmp_path / "names")).collect()] == ["a", "b"]
    (tmp_path / "groups").write_text("old\tnew\nx\n")
    assert [tuple(r) for r in sam.rename_table(spark, str(tmp_path / "groups")).collect()] == [("old", "new")]
    (tmp_path / "genes").write_text("g\tt\tchr1\t+\t5\t9\nshort\n")
    assert [tuple(r) for r in sam.intervals(spark, str(tmp_path / "genes")).collect()] == [("g", "t", "chr1", 5, 9)]


def test_mapping_counts_the_mate_of_single_reads(spark):
    df = reads(spark, [{"flag": 0}, {"flag": 8}, {"flag": 4}, {"flag": 12}])
    assert [r["rank"] for r in filters.by_mapping(df, 1, 1).orderBy("rank").collect()] == [1, 2]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nACGT\nNNac\n>two\nGG\n")
    rows = fastq.read_fasta(spark, str(tmp_path / "x.fa"))
    assert [(r.id, r.descr, r.seq) for r in rows.orderBy("place").collect()] == [("one", "first", "ACGTNNac"), ("two", "", "GG")]
    norm = fastq.normalised_fasta(rows, 5, upper=True)
    assert [r.record for r in norm.orderBy("place").collect()] == [">one first\nACGTN\nNAC", ">two\nGG"]
    assert [tuple(r) for r in fastq.fasta_index(norm, 5).collect()] == [("one", 8, 11, 5, 6), ("two", 2, 26, 2, 3)]
    assert [r.file for r in fastq.exploded_fasta(rows).orderBy("file").collect()] == ["fasta_000000.fasta", "fasta_000001.fasta"]
    filled = fastq.normalised_fasta(rows, 80, replace_seed=1).orderBy("place").first().seq
    assert filled[:4] == "ACGT" and set(filled) <= set("ACGTacgt") and len(filled) == 8


def test_blast_xml(spark, tmp_path):
    hsp = lambda score, qf, qt, hf, ht, frame, q, h: f"<Hsp><Hsp_num>1</Hsp_num><Hsp_bit-score>{score}</Hsp_bit-score><Hsp_score>{score}</Hsp_score><Hsp_evalue>0.1</Hsp_evalue><Hsp_query-from>{qf}</Hsp_query-from><Hsp_query-to>{qt}</Hsp_query-to><Hsp_hit-from>{hf}</Hsp_hit-from><Hsp_hit-to>{ht}</Hsp_hit-to><Hsp_query-frame>1</Hsp_query-frame><Hsp_hit-frame>{frame}</Hsp_hit-frame><Hsp_identity>4</Hsp_identity><Hsp_positive>4</Hsp_positive><Hsp_gaps>0</Hsp_gaps><Hsp_align-len>6</Hsp_align-len><Hsp_qseq>{q}</Hsp_qseq><Hsp_hseq>{h}</Hsp_hseq></Hsp>"
    body = hsp(10, 2, 6, 11, 15, 1, "CGT-AC", "CGTTAG") + hsp(6, 1, 4, 30, 27, -1, "ACGT", "ACGT") + hsp(2, 1, 4, 5, 8, 1, "ACGT", "ACGT")
    (tmp_path / "b.xml").write_text(f"<BlastOutput><BlastOutput_iterations><Iteration><Iteration_query-def>q1 rest</Iteration_query-def><Iteration_query-len>8</Iteration_query-len><Iteration_hits><Hit><Hit_def>chr1 x</Hit_def><Hit_hsps>{body}</Hit_hsps></Hit></Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>")
    queries = spark.createDataFrame([("q1", "ACGTACGT")], "id string, seq string")
    sq = spark.createDataFrame([(0, "chr1", 1000)], "refid int, name string, length int")
    got = text_of(blast.read(spark, str(tmp_path / "b.xml"), queries, sq, 0.5)).orderBy("rank").collect()
    assert [(r.flag, r.pos, r.cigar, r.seq) for r in got] == [(0, 10, "1S3=1D1=1X2S", "ACGTACGT"), (272, 26, "4S4=", "ACGTACGT")]
    assert "AS:i:10" in got[0].aux


def test_sorted_files_and_breaks(spark):
    df = reads(spark, [{"pos": 5}, {"pos": 9}, {"pos": 7}, {"refid": -1, "pos": -1, "flag": 4}, {"refid": 1, "pos": 0}])
    for blocks in (1, 2, 100):
        assert sorted(r.rank for r in filters.order_breaks(df, blocks=blocks).collect()) == [2, 4]
    assert [r.rank for r in orders.sort_alignments(df).collect()] == [0, 2, 1, 4, 3]
    assert pairs.classified(df).where("class = 'S'").count() == 5


def test_online_duplicates_equal_batch(spark, tmp_path):
    from readloom.streaming.online_duplicates import online_duplicates

    a = fixture.alignments(spark, SF).where("flag & 1 = 0")
    ends = duplicates.ends(a).select("lib", "refid", "strand", "five", "score", "rank")
    last = ends.select("lib", "refid", "strand").distinct().select("*", F.lit(10**7).alias("five"), F.lit(0).cast("long").alias("score"), F.lit(-1).cast("long").alias("rank"))
    ends.orderBy("five").coalesce(1).write.option("maxRecordsPerFile", 60).parquet(str(tmp_path / "in"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for i, p in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: (p.stat().st_mtime_ns, p.name))):
        os.utime(p, (10**9 + i, 10**9 + i))
    stream = spark.readStream.schema(ends.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online_duplicates(stream).writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.rank for r in spark.table("online").where("status = 'duplicate'").collect()}
    want = {r.rank for r in duplicates.duplicate_ranks(a).collect()}
    assert got == want and spark.table("online").count() == ends.count()


SOME = ["c2_reset", "c14_convert_tags", "d7_used_header", "d15_routed", "e6_fix_mates", "e10_annotate", "f1_pair_distribution", "f5_depth", "f14_library_metrics", "g1_mark_duplicates", "g8_chains", "h1_sort_queryname", "h5_merge", "b5_to_fastq", "e2_uncollated", "e2_post_ranks", "f10_checksums_md5", "f14_optical_metrics", "f14_set_sizes", "g3_optical_duplicates", "g3_optical_tags", "e7_merge_tags_by_rank"]


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "part", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLE_SQL[name]}) x").fetchall()
    assert sorted(map(str, found)) == sorted(str(tuple(r)) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect())


@pytest.mark.parametrize("name", ["g8_chains", "g8_longest_chain"])
def test_chains_of_all_rows(spark, name):
    test_queries_equal_their_sql(spark, name)
    mapped = fixture.alignments(spark, SF).where("flag & 4 = 0").count()
    df = catalog.QUERIES[name](spark, SF)
    assert mapped == (df.count() if name == "g8_chains" else orders.chains(fixture.alignments(spark, SF), 5).count())


def test_chains_break_at_the_gap(spark):
    df = reads(spark, [{"pos": 0}, {"pos": 11}, {"pos": 23}, {"refid": 1, "pos": 5}])
    assert [(r.offset, r.chain) for r in orders.chains(df, 5).orderBy("rank").collect()] == [(None, 1), (4, 1), (5, 2), (None, 1)]


@pytest.mark.parametrize("name", ["a9_bases_of", "d7_used_header", "d8_used_header_of_mapped", "j9_kmer_poisson"])
def test_queries_take_all_rows(spark, name):
    test_queries_equal_their_sql(spark, name)
    rows = fixture.alignments(spark, SF).where("refid >= 0") if name.startswith("a9") else fixture.alignments(spark, SF)
    assert catalog.QUERIES[name](spark, SF).count() == rows.count()


def test_header_leaves_out_unused_references(spark):
    sq = spark.createDataFrame([(i, f"chr{i}", 1000) for i in range(5)], "refid int, name string, length int")
    df = reads(spark, [{"refid": 2}, {"refid": 4, "flag": 1, "mate_refid": 2}, {"refid": -1, "flag": 5, "mate_refid": 0}])
    for only, names_, ids in ((False, ["chr0", "chr2", "chr4"], [(1, -1), (2, 1), (-1, 0)]), (True, ["chr2", "chr4"], [(0, -1), (1, 0), (-1, -1)])):
        rows, head = filters.used_header(df, sq, only)
        assert [r.name for r in head.orderBy("refid").collect()] == names_
        assert [(r.refid, r.mate_refid) for r in rows.orderBy("rank").collect()] == ids


def test_near_collisions_up_to_seven_bits(spark, monkeypatch):
    rng = random.Random(1)
    values = [rng.getrandbits(32) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(32), k)) for v in values for k in range(1, 9)]
    monkeypatch.setattr(checksums, "read_digests", lambda df: spark.createDataFrame([(v,) for v in values], "b_seq long"))
    got = {tuple(r) for r in catalog.QUERIES["f11_near_collisions"](spark, SF).select("a", "b", "distance").collect()}
    want = {(a, b, (a ^ b).bit_count()) for a in values for b in values if a < b and (a ^ b).bit_count() <= 7}
    assert got == want and {d for _, _, d in want} == set(range(1, 8))


def test_near_collisions_between_blocks_without_broadcast(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(32) for _ in range(60)] + [i << 16 | 5 for i in range(200)]
    values = sorted({*values, *(v ^ sum(1 << b for b in rng.sample(range(32), k)) for v in values[:60] for k in range(1, 9)), 0, (1 << 32) - 1})
    df = spark.createDataFrame([(v,) for v in values] * 2, "b_seq long")
    want = sorted((a, b, (a ^ b).bit_count()) for a in values for b in values if a < b and (a ^ b).bit_count() <= 7)
    few = checksums.near_collisions(spark.createDataFrame([(v,) for v in range(8)], "b_seq long"), block=1)
    assert few.count() == few.distinct().count() == 28
    for block in (100, 10**6):
        met = checksums.near_collisions(df, block=block)
        assert sorted(map(tuple, met.collect())) == want
    for rows in (1, 1000):
        vs = pa.RecordBatch.from_pydict({"vs": [[v - (1 << 31) for v in values]]}, pa.schema({"vs": pa.list_(pa.int32())}))
        assert sorted(t for b in checksums._near(7, rows)((pa.scalar(0), pa.scalar(0)), iter([vs])) for t in zip(*(c.to_pylist() for c in b.columns), strict=True)) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_depth_peaks_at_all_widths(spark, monkeypatch):
    spots = [(0, 500, 2)] + [(0, p, 5) for p in range(5000, 6000)]  # too low at width 4, too wide at width 64
    monkeypatch.setattr(aggregates, "depth", lambda blocks: spark.createDataFrame(spots, "refid int, pos int, depth int"))
    assert sorted((r.start, r.height) for r in catalog.QUERIES["f7_depth_peaks"](spark, SF).collect()) == [(500, 2.0), (5000, 5.0)]
    assert folds.depth_peaks(aggregates.depth(None), 1.0, 4, 64).count() == 0


def test_entry_and_keys(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(5).count() == 5
