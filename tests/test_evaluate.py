"""Analytics, sources, simulator and streaming on small inputs."""

from __future__ import annotations

import bz2
import gzip
import lzma
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.operators import evaluate, mapper, simulate, truth
from kmerloom.params import Params
from kmerloom.sources import fasta, paf
from kmerloom.streaming.live import map_stream

PAF = "qname string, qlen int, qstart int, qend int, strand string, tname string, tlen int, tstart int, tend int, mapq int, n long"


def rec(q, t, s, e, mapq=60, strand="+", n=0, tlen=1000):
    return (q, 100, 0, 90, strand, t, tlen, s, e, mapq, n)


def test_concordance_and_adjudication(spark):
    a = spark.createDataFrame([rec("x", "a", 0, 100), rec("y", "b", 0, 100), rec("z", "a", 500, 600)], PAF)
    b = spark.createDataFrame([rec("x", "a", 10, 110), rec("y", "a", 0, 100), rec("z", "a", 0, 100), rec("w", "a", 0, 1)], PAF)
    r = evaluate.concordance(a, b).first()
    assert (r["both_mapped"], r["concordant"], r["discordant_same_target"], r["discordant_other_target"], r["missed"], r["recall"]) == (3, 1, 1, 1, 1, 0.75)
    t = spark.createDataFrame([("y", "b", 0, 100), ("z", "a", 0, 100)], "qname string, tname string, tstart int, tend int")
    assert {x["verdict"]: x["n"] for x in evaluate.adjudicate(a, b, t).collect()} == {"subject right": 1, "reference right": 1}


def test_regions_selection_and_override(spark):
    p = spark.createDataFrame([rec("x", "a", 0, 100, 0), rec("y", "a", 90, 200, 5), rec("z", "a", 300, 400, 0), rec("s", "a", 700, 800, 60), rec("u", "a", 0, 9, 0, "*")], PAF)
    assert sorted(map(tuple, evaluate.merge_regions(p).select("start", "end").collect())) == [(0, 200), (300, 400)]
    reads = spark.createDataFrame([("s",), ("x",), ("absent",)], "query_id string")
    assert {r[0] for r in evaluate.select_reads(reads, p).collect()} == {"x", "absent"}
    two = spark.createDataFrame([rec("x", "a:300", 5, 50, 60, n=1), rec("x", "a:300", 7, 55, 60, n=2), rec("y", "a:0", 1, 2, 3, n=3)], PAF)
    got = {r["qname"]: (r["tstart"], r["replaced"]) for r in evaluate.override(p, two).collect()}
    assert got["x"] == (307, True) and got["y"] == (90, False)


def test_quantiles_fit_and_gate(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double").withColumn("g", F.lit(1))
    r = evaluate.nearest_rank(df, ["g"], "v", (0.25, 0.5, 0.75)).first()
    assert (r["q25"], r["q50"], r["q75"]) == (2.0, 4.0, 7.0)
    f = evaluate.fit(df.withColumn("y", F.col("v") * 3 + 1), ["g"], "v", "y").first()
    assert f["slope"] == pytest.approx(3) and f["intercept"] == pytest.approx(1) and f["r2"] == pytest.approx(1)
    flat = evaluate.fit(df.withColumn("x", F.lit(2.0)), ["g"], "x", "v").first()
    assert (flat["slope"], flat["intercept"], flat["r2"]) == (0.0, 4.5, 0.0)
    rows = lambda f: spark.createDataFrame([("B", m, t, 10.0 * f[m], 100.0) for m in f for t in (1, 2)], "benchmark string, metric string, threads int, wall_s double, rss_kb double")
    got = {r["metric"]: r["verdict"] for r in evaluate.gate(rows({"a": 1, "b": 1, "c": 1, "d": 1}), rows({"a": 1.0, "b": 1.05, "c": 1.2})).collect()}
    assert got == {"a": "ACCEPT", "b": "REVIEW", "c": "BLOCK", "d": "BLOCK"}


def test_invariants_and_truth(spark):
    p = spark.createDataFrame([rec("S1_1!a!0!100!+", "a", 0, 100), rec("S2_1!a!0!100!+", "b", 0, 100), rec("S3_1!a!0!100!+", "a", 900, 1000, 70)], PAF)
    assert {r["kind"]: r["n"] for r in evaluate.invariants(p).collect()} == {"target beyond segment": 1, "mapq range": 1}
    r = evaluate.truth_accuracy(p).first()
    assert (r["n"], r["ends_ok"], r["overlap_ok"], r["q60_bad"]) == (3, 1, 1, 1)
    assert spark.range(1).select(evaluate.truth_of(F.lit("a!b!c"))).first()[0] is None


def test_paf_and_sam(spark):
    lines = ["r1\t10\t0\t9\t+\ta\t100\t1\t5\t10\t10\t60\tJ:f:0.5", "r1\t10\t0\t9\t+\tb\t100\t1\t5\t10\t10\t60", "r2\t10\t0\t9\t+\ta\t100\t1\t5\t10\t10\t60\ttp:A:S", "bad", "r3\t10\t0\t9\t+\ta\tx\tx\t5\t10\t10\t60"]
    got = paf.parse(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()
    assert [(r["qname"], r["tname"], r["tags"]) for r in got] == [("r1", "a", "J:f:0.5")]
    sam = ["@SQ\tSN:c\tLN:500", "q\t16\tc\t11\t60\t5S20M3I10M7H\t*\t0\t0\t*\t*\tNM:i:4", "u\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*", "s\t256\tc\t1\t0\t10M\t*\t0\t0\t*\t*"]
    got = {r["qname"]: r for r in paf.sam_to_paf(spark.createDataFrame([(x,) for x in sam], "value string")).collect()}
    q = got["q"]
    assert (q["qlen"], q["qstart"], q["qend"], q["tstart"], q["tend"], q["strand"], q["nmatch"], q["blen"], q["tlen"]) == (45, 7, 40, 10, 40, "-", 29, 33, 500)
    assert got["s"]["tags"] == "tp:A:S" and "u" not in got


def test_fasta(spark, tmp_path):
    plain = b"junk\n>a desc\r\nACGT\r\nGGTT\r\n>b\tx\nTT\nTT"
    want = [("a", "ACGTGGTT"), ("b", "TTTT")]
    for name, data in {"x.fa": plain, "x.fa.gz": gzip.compress(plain), "x.fa.bz2": bz2.compress(plain), "x.fa.xz": lzma.compress(plain)}.items():
        (tmp_path / name).write_bytes(data)
        assert [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / name)).orderBy("segm_id").select("name", "seq").collect()] == want
    (tmp_path / "y.fq").write_bytes(b"@r1 z\nACGT\n+\n!!!!\n@r2\nGG\n+\n!!\n")
    assert list(fasta.records(iter((tmp_path / "y.fq").read_bytes().splitlines(True))))[0] == ("r1", "ACGT")
    assert [tuple(r) for r in fasta.read_fasta_lines(spark, str(tmp_path / "x.fa")).orderBy("segm_id").select("name", "seq").collect()] == want


def test_simulated_reads_map_back(spark, tmp_path):
    rng = random.Random(5)
    seq = "".join(rng.choice("ACGT") for _ in range(20000))
    segments = spark.createDataFrame([(0, "a", len(seq), seq)], "segm_id long, name string, sz int, seq string")
    reads = simulate.simulate(segments, 30, 500, sub=0.005, ins=0.002, dele=0.002, error_sd=0.3, run_bias=3.0)
    assert reads.count() == 30
    p = Params(k=15, h_frac=0.2, theta=0.4)
    m = mapper.map_reads(mapper.Corpus(segments, reads), p)
    r = evaluate.truth_accuracy(paf.core(m.mappings)).first()
    assert r["n"] >= 28 and r["overlap_ok"] >= 0.95 * r["n"]
    index = mapper.build_index(segments, p)
    hits = mapper.bucket_hits(mapper.read_seeds(reads, index, p).where("hits > 0"), index.hits, reads, p)
    assert truth.truth_summary(truth.truth_scores(hits, reads, segments, index.sketch), p.theta).where("max_c > 0.4").count() >= 28
    reads.write.parquet(str(tmp_path / "in"))
    q = map_stream(spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in")), segments, p, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == r["n"]


def test_mutation_rates():
    rng = np.random.default_rng(0)
    seq = "ACGT" * 5000
    assert simulate.mutate(seq, 0, 0, 0, rng) == seq
    out = simulate.mutate(seq, 0, 0, 0.1, rng)
    assert 0.88 < len(out) / len(seq) < 0.92


def test_entry_without_llm(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"map_containment", "concordance", "sketch_documents"} <= names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_truth_windows_cover_all_documents(spark, tmp_path):
    """Every document has a row, also without a benchmark item of its id, and over its whole text."""
    from kmerloom.plans import catalog
    from kmerloom.operators.sketch import sketch_array, text_bases

    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (900, 3000, 2500)]
    docs = [(7, texts[0]), (8, texts[1]), (900, texts[2]), (901, texts[2]), (902, None), (903, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, texts[0][:300])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["read_idx"]: (r["max_j"], r["max_c"]) for r in catalog.truth_windows(spark, str(tmp_path)).collect()}
    assert set(got) == {7, 8, 900, 901}
    p = catalog.PARAMS
    whole = lambda t: len(sketch_array(text_bases(t), p.k, p.h_frac)[0])
    assert whole(texts[1]) > whole(texts[1][:400])
    assert all(j == c == 1.0 for j, c in got.values())  # a whole text shares all of its sketch with itself
    # the true segment only, or all segments: the same scores
    segments = catalog.corpus(spark, str(tmp_path)).segments
    reads = segments.where("seq is not null").select(F.col("segm_id").alias("read_idx"), F.concat_ws("!", F.lit("S1_1"), "name", F.lit("0"), F.col("sz").cast("string"), F.lit("+")).alias("query_id"), F.col("sz").alias("read_len"), "seq")
    index = mapper.build_index(segments, p, True)
    seeds = mapper.read_seeds(reads, index, p, True).where("hits > 0")
    rows = [sorted(map(tuple, truth.truth_scores(mapper.bucket_hits(seeds, index.hits, reads, p, w), reads, segments, index.sketch).collect())) for w in (None, truth.true_segments(reads, segments))]
    assert rows[0] == rows[1] and rows[0]


def test_simulated_reads_are_as_many_as_asked(spark):
    """Segments with far less than a read's share each get theirs of n reads, in proportion to their bases."""
    rng = random.Random(4)
    rows = [(i, f"s{i}", n, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([40] * 2000 + [20000])]
    segments = spark.createDataFrame(rows, "segm_id long, name string, sz int, seq string").repartition(5)
    got = [r[0] >> 32 for r in simulate.simulate(segments, 500, 20).select("read_idx").collect()]
    assert len(got) == 500
    assert abs(sum(i < 2000 for i in got) - 400) < 50 and len(set(got)) > 300
    assert simulate.simulate(segments, length=20, depth=0.1).count() == 500
    again = simulate.simulate(segments.repartition(2), 500, 20)
    assert sorted(got) == sorted(r[0] >> 32 for r in again.select("read_idx").collect())
