"""The mapping plan against published facts and brute force."""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from kmerloom.functions import hashing
from kmerloom.operators import mapper, refine
from kmerloom.operators.sketch import sequence_bases, sketch, sketch_array, sketch_sql
from kmerloom.params import Params
from kmerloom.sources import paf

REF = "ACGT" * 41
GOLDEN = [
    "read1\t56\t0\t47\t+\tref\t164\t7\t55\t56\t56\t0\tp:i:49\ts:i:49\tI:i:49\tI2:i:49\tIdiff:i:0\tIsdiff:f:0.00000\tJ:f:1.00000\tJ2:f:1.00000\tJdiff:f:0.00000\tsh:f:1.00000\tstrand:i:25\tb:s:(0,0)\tb2:s:(0,1)\tk:i:8\tgt_J:f:-1.000\tgt_C:f:-1.000\tgt_C_bucket:f:-1.000\tseeds:i:46\tmax_seed_matches:i:79\tseed_matches:i:157\ttotal_matches:i:157\tmatch_inefficiency:f:3.204\tseeded_buckets:i:4\tfinal_buckets:i:3\tFPTP:f:-1.000",
    "read2\t55\t0\t46\t+\tref\t164\t7\t54\t55\t55\t0\tp:i:48\ts:i:48\tI:i:48\tI2:i:48\tIdiff:i:0\tIsdiff:f:0.00000\tJ:f:1.00000\tJ2:f:1.00000\tJdiff:f:0.00000\tsh:f:1.00000\tstrand:i:24\tb:s:(0,0)\tb2:s:(0,1)\tk:i:8\tgt_J:f:-1.000\tgt_C:f:-1.000\tgt_C_bucket:f:-1.000\tseeds:i:45\tmax_seed_matches:i:79\tseed_matches:i:157\ttotal_matches:i:157\tmatch_inefficiency:f:3.271\tseeded_buckets:i:4\tfinal_buckets:i:3\tFPTP:f:-1.000",
]


def corpus(spark, segments, reads):
    s = spark.createDataFrame([(i, n, len(x), x) for i, (n, x) in enumerate(segments)], "segm_id long, name string, sz int, seq string")
    r = spark.createDataFrame([(i, n, len(x), x) for i, (n, x) in enumerate(reads)], "read_idx long, query_id string, read_len int, seq string")
    return mapper.Corpus(s, r)


def test_golden(spark):
    c = corpus(spark, [("ref", REF)], [("read1", REF[:56]), ("read2", REF[1:56])])
    m = mapper.map_reads(c, Params(k=8, h_frac=1.0, theta=0.1))
    assert [r["line"] for r in paf.lines(m.mappings).orderBy("read_idx").collect()] == GOLDEN
    folded = mapper.map_reads(c, Params(k=8, h_frac=1.0, theta=0.1, max_matches=1000))
    assert [r["line"] for r in paf.lines(folded.mappings).orderBy("read_idx").collect()] == GOLDEN


def direct_hash(seq: str, k: int) -> list[int]:
    rot = lambda x, n: ((x << n % 64) | (x >> (64 - n % 64))) & (2**64 - 1) if n % 64 else x
    out = []
    for i in range(len(seq) - k + 1):
        f = r = 0
        for j, b in enumerate(seq[i : i + k].upper()):
            f ^= rot(hashing.BASE.get(b, 0), k - 1 - j)
            r ^= rot(hashing.BASE.get(hashing.COMPLEMENT.get(b, ""), 0), j)
        out.append((f ^ r, f > r))
    return out


@pytest.mark.parametrize("k", [1, 4, 15, 64, 70])
def test_hash_is_direct(k):
    rng = random.Random(k)
    seq = "".join(rng.choice("ACGTacgtN") for _ in range(300))
    h, strand = hashing.kmer_hashes(sequence_bases(seq), k)
    assert list(zip(h.tolist(), strand.tolist())) == direct_hash(seq, k)


def test_chunks_and_expressions_agree(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    whole = sketch_array(sequence_bases(seq), 7, 0.5)
    for chunk in (1, 2, 13, 500, 2999, 3000):
        assert all((a == b).all() for a, b in zip(whole, sketch_array(sequence_bases(seq), 7, 0.5, chunk)))
    df = spark.createDataFrame([(0, seq[:400]), (1, "AC"), (2, None)], "id long, seq string")
    rows = lambda x: sorted(map(tuple, x.select("owner", "tpos", "r", "h", "strand").collect()))
    assert rows(sketch(df, "id", "seq", 7, 0.5)) == rows(sketch_sql(df.where("seq is not null"), "id", "seq", 7, 0.5))


def test_reverse_complement_is_mirrored():
    a, _ = hashing.kmer_hashes(sequence_bases("ACGGT"), 4)
    b, _ = hashing.kmer_hashes(sequence_bases("ACCGT"), 4)
    assert a.tolist() == b.tolist()[::-1]


def test_index_counts(spark):
    c = corpus(spark, [("a", "ACCAGTACCA"), ("b", "GGACCA")], [("r", "ACCA")])
    p = Params(k=4, h_frac=1.0)
    at = mapper.build_index(c.segments, p)
    counts = [r["hits_in_t"] for r in at.sketch.where("segm_id = 0").join(at.freq, "h").orderBy("r").collect()]
    assert counts == [3, 1, 1, 1, 1, 1, 3]
    s = mapper.index_stats(c.segments, p).first()
    assert (s["indexed_hits"], s["indexed_kmers"], s["segments"], s["total_nucls"]) == (10, 8, 2, 16)
    assert mapper.index_stats(c.segments, replace(p, max_matches=1)).first()["blacklisted_hits"] == 3


def test_short_sketch_is_unmapped(spark):
    c = corpus(spark, [("ref", REF[:60] + "GATTACA" * 9)], [(f"n{n}", ("GATTACA" * 9)[:n]) for n in range(7, 16)])
    m = mapper.map_reads(c, Params(k=8, h_frac=1.0, theta=0.1))
    assert {r["query_id"] for r in m.mappings.collect()} == {f"n{n}" for n in range(12, 16)}
    assert all(x["line"].split("\t")[4] == "*" for x in paf.unmapped_lines(m.unmapped).collect())


def brute(ref: list[tuple], own: list[tuple], jaccard: bool, b: int) -> tuple:
    """Best window of one bucket by trying all: (score, t_l, t_r, intersection, strand)."""
    m, occ, strand = len(own), Counter(h for _, h, _ in own), {}
    for _, h, s in own:
        strand.setdefault(h, s)
    begin, end = b * m, min((b + 2) * m, len(ref))
    best = (-1.0,)
    for l in range(begin, end):
        r = min(l + m, end)
        inside = Counter(h for _, h, _ in ref[l:r] if h in occ)
        i = sum(min(occ[h], c) for h, c in inside.items())
        s = sum(1 if strand[h] == st else -1 for _, h, st in ref[l:r] if h in occ)
        score = i / (m + (r - l) - i) if jaccard else i / m
        if score > best[0]:
            best = (score, ref[l][0], ref[r - 1][0], i, s)
    return best


@pytest.mark.parametrize("metric", ["Containment", "Jaccard"])
def test_windows_by_brute_force(spark, metric):
    rng = random.Random(7)
    seqs = ["".join(rng.choice("AC") for _ in range(n)) for n in (60, 45, 30)]
    reads = ["".join(rng.choice("AC") for _ in range(n)) for n in (14, 20)]
    c = corpus(spark, [(f"s{i}", x) for i, x in enumerate(seqs)], [(f"r{i}", x) for i, x in enumerate(reads)])
    p = Params(k=4, h_frac=1.0, theta=0.05, min_diff=0.0, metric=metric)
    index = mapper.build_index(c.segments, p)
    live, seeds, _, hits = mapper.candidates(c, index, p)
    got = refine.score(live, hits, seeds, index, p).collect()
    assert got
    sk = lambda x: list(zip(*(a.tolist() for a in sketch_array(sequence_bases(x), 4, 1.0))))
    for g in got:
        e = brute(sk(seqs[g["segm_id"]]), sk(reads[g["read_idx"]]), metric == "Jaccard", g["b"])
        assert (g["score"], g["t_l"], g["t_r"], g["intersection"], g["same_strand"]) == e


def test_options_run(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    c = corpus(spark, [("a", seq), ("b", seq[1000:1400])], [("x", seq[1000:1300]), ("y", "ACGT" * 50)])
    for o in ({}, {"metric": "bucket_SH"}, {"metric": "bucket_LCS"}, {"no_pruning": True}, {"one_sweep": True}, {"absolute_positions": True}, {"rarity_weight": 1.0}, {"rarity_tiebreak": 0.1}, {"max_matches": 3}):
        m = mapper.map_reads(c, Params(k=11, h_frac=0.5, theta=0.5, **o)).mappings.collect()
        assert any(r["query_id"] == "x" and abs(r["t_l"] - 1000) < 320 for r in m if r["segment"] == "a") or any(r["segment"] == "b" for r in m), o


def test_lis():
    assert refine.lis([1, 3, 2, 3, 5, 4]) == 4
    assert refine.lis([]) == 0
    assert refine.lis([3, 3, 3]) == 1


def test_params_are_checked():
    for bad in ({"k": 0}, {"h_frac": 0}, {"theta": 2}, {"metric": "x"}, {"rarity_weight": 1, "metric": "Jaccard"}, {"max_matches": 0}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert np.uint64(hashing.threshold(0.01)) == 184467440737095520


def _simulated(spark):
    """Segments with copies, near copies and repeats, and reads of them."""
    import random

    from kmerloom.operators import simulate

    rng = random.Random(3)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randint(500, 1500))) for _ in range(14)]
    unit = "".join(rng.choice("ACGT") for _ in range(40))
    texts = base + base[:4] + [b[:300] + unit * 12 + b[300:] for b in base[4:9]]
    texts += ["".join(c if rng.random() > 0.03 else rng.choice("ACGT") for c in b) for b in base[9:]] + ["ACGTN" * 3, None, "N" * 600]
    segments = spark.createDataFrame([(i, f"d{i}", len(t) if t else None, t) for i, t in enumerate(texts)], "segm_id long, name string, sz int, seq string")
    reads = simulate.simulate(segments.where("seq is not null"), length=200, depth=2.0, sub=0.03, ins=0.01, dele=0.01, error_sd=0.5, run_bias=5.0)
    return segments, reads.cache()


def test_many_reads_are_mapped_as_single_ones(spark):
    from kmerloom.operators import many, mapper
    from kmerloom.params import Params
    from kmerloom.sources import paf

    segments, reads = _simulated(spark)
    p = Params(k=11, h_frac=0.2, theta=0.3, min_diff=0.075, max_overlap=0.3)
    want, got = (sorted(map(tuple, paf.core(x).collect())) for x in (mapper.map_reads(mapper.Corpus(segments, reads), p).mappings, many.map_many(segments, reads, p)))
    assert len(want) > 200 and got == want


def test_simulated_reads_meet_few_places_of_a_small_vocabulary(spark, tmp_path):
    """Texts of few words: hits grow with the square of the texts, places that are scored with the texts."""
    import random

    import __spark_entry__
    from kmerloom.operators import many

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(14)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scored, plain = [], many._verify

    def counted(found, *rest):
        scored.append(found.count())
        return plain(found, *rest)

    many._verify = counted
    try:
        row = __spark_entry__.queries()["map_simulated"](spark, str(tmp_path)).first()
    finally:
        many._verify = plain
    assert row["n"] > 300 and row["overlap_ok"] > 0.9 * row["n"]
    assert 0 < sum(scored) < 20 * row["n"]
