"""The mapping plan: sketch, index, seeds, buckets, bound, refinement, best and second best, mapping quality.

Everything is keyed by (read_idx, segm_id, b): a seed meets the index by one equi-join on the hash, each hit
counts for the two overlapping buckets of its place, and from there on all steps are grouped aggregations and
windows over a read.  Buckets whose bound cannot reach the least threshold any later step may ask for are left
out before the remaining seeds are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.hashing import unsigned
from kmerloom.operators import refine
from kmerloom.operators.sketch import sketch
from kmerloom.params import Params


@dataclass
class Corpus:
    """segments (segm_id, name, sz, seq) and reads (read_idx, query_id, read_len, seq)."""

    segments: DataFrame
    reads: DataFrame
    text: bool = False  # sequences are texts, read as bases by code point


@dataclass
class Index:
    sketch: DataFrame  # segm_id, tpos, r, h, strand of all kept k-mers
    hits: DataFrame  # those that may be looked up
    freq: DataFrame  # h, hits_in_t
    sizes: DataFrame  # segm_id, n_kmers


def build_index(segments: DataFrame, p: Params, text: bool = False, keep: bool = False) -> Index:
    """The sketch of the reference, with the hits per hash; hashes of more than max_matches hits have none.

    With ``keep`` the sketch, which several steps read, stays in the executors (spilling to disk; what is lost
    with an executor is made again).
    """
    sk = sketch(segments, "segm_id", "seq", p.k, p.h_frac, text).withColumnRenamed("owner", "segm_id")
    if keep:
        sk = sk.persist(StorageLevel.MEMORY_AND_DISK)
    freq = sk.groupBy("h").agg(F.count("*").alias("hits_in_t"))
    hits = sk
    if p.max_matches >= 0:
        freq = freq.where(F.col("hits_in_t") <= p.max_matches)
        hits = sk.join(freq.select("h"), "h", "left_semi")
    sizes = sk.groupBy("segm_id").agg(F.count("*").cast("int").alias("n_kmers"))
    return Index(sk, hits, freq, sizes)


def index_stats(segments: DataFrame, p: Params, text: bool = False) -> DataFrame:
    """Counts of the index; with a limit on hits, stored hits are capped at two more than it."""
    sk = sketch(segments, "segm_id", "seq", p.k, p.h_frac, text)
    freq = sk.groupBy("h").agg(F.count("*").alias("c"))
    if p.max_matches >= 0:
        freq = freq.withColumn("c", F.least("c", F.lit(p.max_matches + 2)))
        over = F.col("c") > p.max_matches
    else:
        over = F.lit(False)
    counted = freq.agg(
        F.count("*").alias("indexed_kmers"),
        F.sum("c").alias("indexed_hits"),
        F.coalesce(F.max(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("indexed_highest_freq_kmer"),
        F.count_if(over).alias("blacklisted_kmers"),
        F.coalesce(F.sum(F.when(over, F.col("c"))), F.lit(0)).alias("blacklisted_hits"),
    )
    whole = segments.agg(F.count("*").alias("segments"), F.sum(F.length("seq")).cast("long").alias("total_nucls"))
    return whole.crossJoin(counted)  # one row each


def read_seeds(reads: DataFrame, index: Index, p: Params, text: bool = False) -> DataFrame:
    """Distinct k-mers of reads: read_idx, m, h, strand (of the first), occs, pmatches, hits, seed_num, budget.

    ``seeds_before`` sums the occurrences of rarer seeds; ``in_budget`` marks the seeds that are looked up first.
    """
    sk = sketch(reads, "read_idx", "seq", p.k, p.h_frac, text).withColumnRenamed("owner", "read_idx")
    seeds = sk.groupBy("read_idx", "h").agg(
        F.count("*").cast("int").alias("occs"),
        F.min_by("strand", "r").alias("strand"),
        F.reverse(F.array_sort(F.collect_list("r"))).alias("pmatches"),
    )
    seeds = seeds.join(index.freq, "h", "left").withColumn("hits", F.coalesce("hits_in_t", F.lit(0)).cast("int")).drop("hits_in_t")
    read = Window.partitionBy("read_idx")
    by_hash, rarest = read.orderBy(unsigned(F.col("h"))), read.orderBy("hits", unsigned(F.col("h")))
    seeds = seeds.withColumn("m", F.sum("occs").over(read).cast("int")).withColumn("seed_num", (F.row_number().over(by_hash) - 1).cast("int"))
    before = F.sum("occs").over(rarest.rowsBetween(Window.unboundedPreceding, 0)) - F.col("occs")
    if p.one_sweep:
        budget: Column = F.count("*").over(read).cast("int")
    else:
        budget = ((F.lit(1.0) - F.lit(p.theta2)) * F.col("m")).cast("int") + 1
    seeds = seeds.withColumn("seeds_before", before.cast("int")).withColumn("budget", budget)
    return seeds.withColumn("in_budget", F.col("seeds_before") < F.col("budget"))


def read_stats(reads: DataFrame, seeds: DataFrame) -> DataFrame:
    """Counters of every read, also of those without a sketch."""
    per = seeds.groupBy("read_idx").agg(
        F.first("m").alias("m"),
        F.count("*").alias("kmers_unique"),
        F.first("budget").alias("budget"),
        F.sum("hits").alias("possible_matches"),
        (F.sum("occs") - F.sum(F.when(F.col("hits") > 0, F.col("occs")).otherwise(0))).alias("kmers_notmatched"),
        F.sum(F.when(F.col("in_budget"), F.col("hits")).otherwise(0)).alias("seed_matches"),
        F.coalesce(F.max(F.when(F.col("in_budget"), F.col("hits"))), F.lit(0)).alias("max_seed_matches"),
        F.sum(F.when(F.col("in_budget"), F.col("occs")).otherwise(0)).cast("int").alias("seeds_consumed"),
    )
    return reads.select("read_idx", "query_id", "read_len").join(per, "read_idx", "left").na.fill(0)


def _half(p: Params) -> Column:
    return F.col("read_len") if p.absolute_positions else F.col("m")


def bucket_hits(seeds: DataFrame, hits: DataFrame, reads: DataFrame, p: Params, wanted: DataFrame | None = None) -> DataFrame:
    """Hits of seeds, once for each bucket they count for: read_idx, segm_id, b, h, occs, tpos, r, same.

    With ``wanted`` (read_idx, segm_id) a read meets only its own segments, so that copies don't meet each other.
    """
    at = seeds.join(reads.select("read_idx", "read_len"), "read_idx") if p.absolute_positions else seeds
    at = at.select("read_idx", "h", "occs", F.col("strand").alias("own"), _half(p).alias("hl"), "seed_num", "m")
    at = at.where(F.col("hl") >= p.min_sketch)
    met = at.join(hits, "h") if wanted is None else at.join(wanted, "read_idx").join(hits, ["segm_id", "h"])
    pos = F.col("r") if p.absolute_positions else F.col("tpos")
    b = F.floor(pos / F.col("hl")).cast("int")
    met = met.withColumn("b0", b).withColumn("b", F.explode(F.when(F.col("b0") > 0, F.array(F.col("b0"), F.col("b0") - 1)).otherwise(F.array("b0"))))
    return met.select("read_idx", "segm_id", "b", "h", "occs", "seed_num", "m", "hl", "tpos", "r", F.when(F.col("own") == F.col("strand"), 1).otherwise(-1).alias("same"))


def bucket_content(hits: DataFrame) -> DataFrame:
    """Per bucket: matches (clamped per seed), codirection, r_min, r_max. Two levels: seed, then bucket."""
    per_seed = hits.groupBy("read_idx", "segm_id", "b", "h").agg(
        F.least(F.first("occs"), F.count("*")).alias("matches"), F.sum("same").alias("codirection"), F.min("r").alias("r_min"), F.max("r").alias("r_max")
    )
    return per_seed.groupBy("read_idx", "segm_id", "b").agg(
        F.sum("matches").cast("int").alias("matches"), F.sum("codirection").cast("int").alias("codirection"), F.min("r_min").alias("r_min"), F.max("r_max").alias("r_max")
    )


def bound(matches: Column, seeds: Column, m: Column) -> Column:
    """Upper bound of a bucket's score after the given seeds."""
    return F.lit(1.0) - (seeds - matches) / m.cast("double")


@dataclass
class Mapped:
    mappings: DataFrame
    unmapped: DataFrame
    stats: DataFrame
    scored: DataFrame


def candidates(corpus: Corpus, index: Index, p: Params) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scored buckets in order, seeds, stats, hits of the candidates)."""
    seeds = read_seeds(corpus.reads, index, p, corpus.text).persist(StorageLevel.MEMORY_AND_DISK)
    stats = read_stats(corpus.reads, seeds)
    first = bucket_content(bucket_hits(seeds.where("in_budget and hits > 0"), index.hits, corpus.reads, p)).withColumnRenamed("matches", "seed_phase")
    first = first.select("read_idx", "segm_id", "b", "seed_phase").join(stats.select("read_idx", "m", "read_len", "seeds_consumed"), "read_idx")
    order = Window.partitionBy("read_idx").orderBy(F.desc("seed_phase"), "segm_id", "b")
    first = first.withColumn("place", F.row_number().over(order)).withColumn("seeded_buckets", F.count("*").over(Window.partitionBy("read_idx")))
    least = p.theta * (1.0 - p.min_diff)
    live = first if p.no_pruning else first.where(bound(F.col("seed_phase"), F.col("seeds_consumed"), F.col("m")) >= least - 1e-9)
    wanted = live.select("read_idx", "segm_id", "b")
    # windows are read off the whole sketch, bounds off what may be looked up
    hits = bucket_hits(seeds, index.sketch, corpus.reads, p).join(wanted, ["read_idx", "segm_id", "b"], "left_semi")
    looked_up = hits if p.max_matches < 0 else hits.join(index.freq.select("h"), "h", "left_semi")
    if p.no_pruning:
        looked_up = looked_up.join(seeds.where("in_budget").select("read_idx", "h"), ["read_idx", "h"], "left_semi")
    content = bucket_content(looked_up)
    live = live.join(content, ["read_idx", "segm_id", "b"])
    live = live.withColumn("sh", F.lit(1.0) if p.no_pruning else bound(F.col("matches"), F.col("m"), F.col("m")))
    if not p.no_pruning:
        live = live.where(F.col("sh") >= least)
    live = live.join(index.sizes, "segm_id")
    return live, seeds, stats, hits


def map_reads(corpus: Corpus, p: Params, index: Index | None = None) -> Mapped:
    """One row per mapped read with all fields of its mapping, the rest as unmapped."""
    index = index or build_index(corpus.segments, p, corpus.text, keep=True)
    live, seeds, stats, hits = candidates(corpus, index, p)
    scored = refine.score(live, hits, seeds, index, p).persist(StorageLevel.MEMORY_AND_DISK)  # read for the best and the second best
    chosen = refine.choose(scored, p)
    out = chosen.join(stats.select("read_idx", "query_id", "budget", "max_seed_matches", "seed_matches", F.col("read_len").alias("len"), "possible_matches", "kmers_unique"), "read_idx")
    out = out.join(corpus.segments.select("segm_id", F.col("name").alias("segment"), F.col("sz").alias("segm_sz")), "segm_id")
    out = out.select(
        "read_idx", "query_id", F.col("len").alias("read_len"),
        F.lit(0).alias("p_start"), (F.col("len") - (p.k if p.metric in ("Containment", "Jaccard") else 0) - 1).cast("int").alias("p_end"),
        F.when(F.col("same_strand") > 0, "+").otherwise("-").alias("strand"), "segment", "segm_sz", "t_l", "t_r", "mapq",
        F.col("m").alias("p_sz"), "s_sz", "intersection", "intersection2", (F.col("intersection") - F.col("intersection2")).alias("i_diff"), "sigmas_diff",
        "score", "score2", (F.col("score") - F.col("score2")).alias("score_diff"), "sh", "same_strand", "segm_id", "b", "segm_id2", "b2",
        F.lit(p.k).alias("k"), F.col("budget").alias("seeds"), "max_seed_matches", "seed_matches", F.col("seed_matches").alias("total_matches"),
        (F.col("seed_matches") / F.col("intersection").cast("double")).alias("match_inefficiency"), "seeded_buckets", "final_buckets", "possible_matches", "kmers_unique",
    )
    unmapped = stats.join(out.select("read_idx"), "read_idx", "left_anti")
    return Mapped(out, unmapped, stats, scored)
