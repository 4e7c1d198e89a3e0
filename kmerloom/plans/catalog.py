"""All queries of the engine by name, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import evaluate, many, mapper, refine, simulate, truth
from kmerloom.operators.sketch import sketch
from kmerloom.params import Params
from kmerloom.plans import oracle
from kmerloom.plans.inputs import PARAMS, corpus, records, records_sql, table
from kmerloom.sources import paf

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


SK, SEEDS, BUCKETS = oracle.sketch_ctes(), oracle.seed_ctes(), oracle.bucket_ctes()
REF_ONLY = oracle.sketch_ctes(tables=(("ref", "documents", "doc_id"),))
MAP_FIELDS = ["read_idx", "segm_id", "b", "t_l", "t_r", "s_sz", "intersection", "same_strand", "score", "sh", "p_sz", "seeded_buckets", "intersection2", "score2", "segm_id2", "b2", "mapq"]


@query("sketch_documents", f"WITH {REF_ONLY} SELECT owner, tpos, r, h, strand FROM ref_sketch")
def sketch_documents(spark: SparkSession, d: str) -> DataFrame:
    return sketch(table(spark, d, "documents"), "doc_id", "text", PARAMS.k, PARAMS.h_frac, True)


@query("sketch_sizes", f"WITH {REF_ONLY} SELECT owner, count(*) AS n, CAST(sum(CASE WHEN strand THEN 1 ELSE 0 END) AS BIGINT) AS reverse FROM ref_sketch GROUP BY owner")
def sketch_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sketch_documents(spark, d).groupBy("owner").agg(F.count("*").alias("n"), F.sum(F.col("strand").cast("int")).alias("reverse"))


@query("index_histogram", f"WITH {REF_ONLY}, f AS (SELECT h, count(*) AS hits FROM ref_sketch GROUP BY h) SELECT hits, count(*) AS kmers FROM f GROUP BY hits")
def index_histogram(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return mapper.build_index(c.segments, PARAMS, True).freq.groupBy(F.col("hits_in_t").alias("hits")).agg(F.count("*").alias("kmers"))


@query(
    "index_stats",
    f"""WITH {REF_ONLY}, f AS (SELECT h, count(*) AS c FROM ref_sketch GROUP BY h)
SELECT (SELECT count(*) FROM documents) AS segments, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS total_nucls, count(*) AS indexed_kmers, CAST(sum(c) AS BIGINT) AS indexed_hits,
  coalesce(max(CASE WHEN c > 1 THEN c END), 0) AS indexed_highest_freq_kmer, 0::BIGINT AS blacklisted_kmers, 0::BIGINT AS blacklisted_hits FROM f""",
)
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    out = mapper.index_stats(corpus(spark, d).segments, PARAMS, True)
    return out.select(*(F.col(c).cast("long").alias(c) for c in out.columns))


@query("index_blacklist", f"WITH {REF_ONLY}, f AS (SELECT h, count(*) AS hits FROM ref_sketch GROUP BY h) SELECT h, hits AS hits_in_t FROM f WHERE hits <= 4")
def index_blacklist(spark: SparkSession, d: str) -> DataFrame:
    return mapper.build_index(corpus(spark, d).segments, replace(PARAMS, max_matches=4), True).freq


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return mapper.read_seeds(c.reads, mapper.build_index(c.segments, PARAMS, True), PARAMS, True)


@query("seed_table", oracle.query([SK, SEEDS], "SELECT read_idx, h, strand, occs, hits, seed_num, m, array_to_string(pmatches, ',') AS places FROM seeds"))
def seed_table(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d).select("read_idx", "h", "strand", "occs", "hits", "seed_num", "m", F.array_join("pmatches", ",").alias("places"))


@query("seed_budget", oracle.query([SK, SEEDS], "SELECT read_idx, h, seeds_before, budget FROM budgeted WHERE seeds_before < budget"))
def seed_budget(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d).where("in_budget").select("read_idx", "h", "seeds_before", "budget")


def _parts(spark: SparkSession, d: str, p: Params = PARAMS):
    c = corpus(spark, d)
    index = mapper.build_index(c.segments, p, True)
    return c, index, mapper.read_seeds(c.reads, index, p, True)


@query("hit_join", oracle.query([SK, SEEDS, BUCKETS], "SELECT read_idx, segm_id, b, count(*) AS hits, CAST(sum(same) AS BIGINT) AS codirection FROM hits GROUP BY ALL"))
def hit_join(spark: SparkSession, d: str) -> DataFrame:
    c, index, seeds = _parts(spark, d)
    hits = mapper.bucket_hits(seeds.where("hits > 0"), index.hits, c.reads, PARAMS)
    return hits.groupBy("read_idx", "segm_id", "b").agg(F.count("*").alias("hits"), F.sum("same").alias("codirection"))


@query("bucket_content", oracle.query([SK, SEEDS, BUCKETS], "SELECT * FROM early_bucket"))
def bucket_content(spark: SparkSession, d: str) -> DataFrame:
    c, index, seeds = _parts(spark, d)
    return mapper.bucket_content(mapper.bucket_hits(seeds.where("in_budget and hits > 0"), index.hits, c.reads, PARAMS))


@query("bucket_bounds", oracle.query([SK, SEEDS, BUCKETS], "SELECT read_idx, segm_id, b, matches, sh, place FROM live"))
def bucket_bounds(spark: SparkSession, d: str) -> DataFrame:
    c, index, _ = _parts(spark, d)
    return mapper.candidates(c, index, PARAMS)[0].select("read_idx", "segm_id", "b", "matches", "sh", "place")


@query("best_windows", oracle.query([SK, SEEDS, BUCKETS, oracle.window_ctes()], "SELECT read_idx, segm_id, b, score, intersection, same_strand, t_l, t_r, s_sz FROM scored"))
def best_windows(spark: SparkSession, d: str) -> DataFrame:
    c, index, _ = _parts(spark, d)
    live, seeds, _, hits = mapper.candidates(c, index, PARAMS)
    return refine.score(live, hits, seeds, index, PARAMS).select("read_idx", "segm_id", "b", "score", "intersection", "same_strand", "t_l", "t_r", "s_sz")


def _mapped(metric: str, **options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return mapper.map_reads(corpus(spark, d), replace(PARAMS, metric=metric, **options)).mappings.select(*MAP_FIELDS)

    return run


FINAL = f"SELECT {', '.join(MAP_FIELDS)} FROM final"
JACCARD = replace(PARAMS, metric="Jaccard")
query("map_containment", oracle.query([SK, SEEDS, BUCKETS, oracle.window_ctes(), oracle.chosen()], FINAL))(_mapped("Containment"))
query("map_jaccard", oracle.query([SK, SEEDS, BUCKETS, oracle.window_ctes(JACCARD), oracle.chosen(JACCARD)], FINAL))(_mapped("Jaccard"))
query("map_bucket_sh", oracle.query([SK, SEEDS, BUCKETS, oracle.bound_ctes(), oracle.chosen()], FINAL))(_mapped("bucket_SH"))
query("map_bucket_lcs")(_mapped("bucket_LCS"))
query("map_rarity_weight")(_mapped("Containment", rarity_weight=1.0))
query("map_rarity_tiebreak")(_mapped("Containment", rarity_tiebreak=0.05))
for name, option in (("map_no_pruning", {"no_pruning": True}), ("map_one_sweep", {"one_sweep": True})):
    own = replace(PARAMS, **option)
    query(name, oracle.query([SK, oracle.seed_ctes(own), oracle.bucket_ctes(own), oracle.window_ctes(own), oracle.chosen(own)], FINAL))(_mapped("Containment", **option))
query("map_absolute")(_mapped("Containment", absolute_positions=True))
query("map_max_matches")(_mapped("Containment", max_matches=50))


@query("unmapped", oracle.query([SK, SEEDS, BUCKETS, oracle.window_ctes(), oracle.chosen()], "SELECT 'i' || item_id || chr(9) || length(text) || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || repeat(chr(9) || '0', 6) AS line FROM benchmark ANTI JOIN (SELECT read_idx AS item_id FROM final) USING (item_id)"))
def unmapped(spark: SparkSession, d: str) -> DataFrame:
    return paf.unmapped_lines(mapper.map_reads(corpus(spark, d), PARAMS).unmapped).select("line")


@query("paf_lines")
def paf_lines(spark: SparkSession, d: str) -> DataFrame:
    return paf.lines(mapper.map_reads(corpus(spark, d), PARAMS).mappings)


@query(
    "read_stats",
    oracle.query(
        [SK, SEEDS],
        """SELECT i.item_id AS read_idx, coalesce(m, 0) AS m, coalesce(kmers_unique, 0) AS kmers_unique, coalesce(possible_matches, 0) AS possible_matches, coalesce(kmers_notmatched, 0) AS kmers_notmatched,
  coalesce(seed_matches, 0) AS seed_matches, coalesce(max_seed_matches, 0) AS max_seed_matches FROM benchmark i LEFT JOIN (SELECT read_idx, any_value(m) AS m, count(*) AS kmers_unique, CAST(sum(hits) AS BIGINT) AS possible_matches,
  CAST(sum(CASE WHEN hits = 0 THEN occs ELSE 0 END) AS BIGINT) AS kmers_notmatched, CAST(sum(CASE WHEN seeds_before < budget THEN hits ELSE 0 END) AS BIGINT) AS seed_matches, max(CASE WHEN seeds_before < budget THEN hits END) AS max_seed_matches
  FROM budgeted GROUP BY read_idx) s ON s.read_idx = i.item_id""",
    ),
)
def read_stats(spark: SparkSession, d: str) -> DataFrame:
    c, _, seeds = _parts(spark, d)
    return mapper.read_stats(c.reads, seeds).select("read_idx", "m", "kmers_unique", "possible_matches", "kmers_notmatched", "seed_matches", "max_seed_matches")


@query("run_counters")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    c, _, seeds = _parts(spark, d)
    return evaluate.run_counters(mapper.read_stats(c.reads, seeds))


@query("sampled_reads", "SELECT item_id AS read_idx, length(text) AS read_len FROM benchmark WHERE item_id % 3 = 0")
def sampled_reads(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).reads.where("read_idx % 3 = 0").select("read_idx", F.col("read_len").cast("long").alias("read_len"))


@query("kmer_survival", oracle.query([SK], "SELECT count(*) AS reads, avg(s) AS mean_survival, 1 - pow(avg(s), 1.0 / 15) AS error_rate FROM (SELECT owner, avg(CASE WHEN h IN (SELECT h FROM ref_sketch) THEN 1 ELSE 0 END) AS s FROM own_sketch GROUP BY owner)"))
def kmer_survival(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    own = sketch(c.reads, "read_idx", "seq", PARAMS.k, PARAMS.h_frac, True)
    out = evaluate.kmer_survival(own, sketch(c.segments, "segm_id", "seq", PARAMS.k, PARAMS.h_frac, True), PARAMS.k)
    return out


S, R = records_sql("subject"), records_sql("reference")
MET = f"""s AS ({S}), r AS ({R}), met AS (SELECT r.qname, r.ts, r.tname AS rt, s.tname AS st, r.tstart AS rs, r.tend AS re, s.tstart AS ss, s.tend AS se,
  coalesce(s.tname = r.tname AND least(s.tend, r.tend) > greatest(s.tstart, r.tstart) AND (least(s.tend, r.tend) - greatest(s.tstart, r.tstart)) / (greatest(s.tend, r.tend) - least(s.tstart, r.tstart))::DOUBLE > 0.7, false) AS agree
  FROM r LEFT JOIN s USING (qname))"""


@query(
    "concordance",
    f"""WITH {MET} SELECT count(*) AS reference_mapped, count(st) AS both_mapped, count(*) FILTER (agree) AS concordant, count(*) FILTER (st IS NOT NULL AND NOT agree AND st = rt) AS discordant_same_target,
  count(*) FILTER (st IS NOT NULL AND NOT agree AND st <> rt) AS discordant_other_target, count(*) FILTER (st IS NULL) AS missed, (SELECT count(*) FROM s) AS subject_mapped, count(st) / count(*)::DOUBLE AS recall,
  count(*) FILTER (agree) / count(st)::DOUBLE AS agreement, count(*) FILTER (agree) / count(*)::DOUBLE AS good, 0.7::DOUBLE AS min_overlap FROM met""",
)
def concordance(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.concordance(records(spark, d, "subject"), records(spark, d, "reference"), 0.7)


@query("top_pairs", f"WITH {MET} SELECT rt AS reference_target, st AS subject_target, count(*) AS n FROM met WHERE st <> rt GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 15")
def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.top_pairs(records(spark, d, "subject"), records(spark, d, "reference"))


def _truth(df: DataFrame) -> DataFrame:
    return df.withColumn("t", evaluate.truth_of(F.col("qname"))).select("qname", F.col("t.segment").alias("tname"), F.col("t.start").alias("tstart"), F.col("t.end").alias("tend"))


@query(
    "adjudicate",
    f"""WITH {MET}, v AS (SELECT *, (st = 'segA' AND 300 - abs(ss - ts) > 0 AND (300 - abs(ss - ts)) / (300 + abs(ss - ts))::DOUBLE > 0.7) AS s_ok, (300 - abs(rs - ts) > 0 AND (300 - abs(rs - ts)) / (300 + abs(rs - ts))::DOUBLE > 0.7) AS r_ok
  FROM met WHERE st IS NOT NULL AND NOT agree) SELECT CASE WHEN s_ok AND r_ok THEN 'both right' WHEN s_ok THEN 'subject right' WHEN r_ok THEN 'reference right' ELSE 'both wrong' END AS verdict, count(*) AS n FROM v GROUP BY 1""",
)
def adjudicate(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d, "reference")
    return evaluate.adjudicate(records(spark, d, "subject"), r, _truth(r), 0.7)


@query(
    "paf_invariants",
    f"""WITH s AS ({S}), v AS (SELECT qname, unnest([CASE WHEN NOT (qstart >= 0 AND qstart < qend AND qend <= qlen) THEN 'query coords' END, CASE WHEN NOT (tstart >= 0 AND tstart <= tend) THEN 'target coords' END,
  CASE WHEN tend >= tlen THEN 'target beyond segment' END, CASE WHEN strand NOT IN ('+', '-') THEN 'strand' END, CASE WHEN mapq NOT BETWEEN 0 AND 60 THEN 'mapq range' END, CASE WHEN tend - tstart + 1 > 10 * qlen THEN 'span over ten reads' END]) AS kind FROM s)
SELECT kind, count(*) AS n, min(qname) AS first_read FROM v WHERE kind IS NOT NULL GROUP BY kind""",
)
def paf_invariants(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.invariants(records(spark, d, "subject"))


@query(
    "truth_accuracy",
    f"""WITH s AS ({S}), v AS (SELECT mapq, tname = 'segA' AND abs(tstart - ts) <= qlen AS e, tname = 'segA' AND 300 - abs(tstart - ts) > 0 AND (300 - abs(tstart - ts)) / (300 + abs(tstart - ts))::DOUBLE > 0.5 AS o FROM s)
SELECT count(*) AS n, count(*) FILTER (e) AS ends_ok, count(*) FILTER (NOT e) AS ends_bad, count(*) FILTER (o) AS overlap_ok, count(*) FILTER (NOT o) AS overlap_bad, count(*) FILTER (o AND mapq = 60) AS q60_ok, count(*) FILTER (NOT o AND mapq = 60) AS q60_bad FROM v""",
)
def truth_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.truth_accuracy(records(spark, d, "subject"), 0.5)


REGIONS = f"""s AS ({S}), a AS (SELECT tname, greatest(0, tstart - 10) AS s0, least(tlen, tend + 10) AS e0 FROM s WHERE strand <> '*' AND mapq < 60),
i AS (SELECT *, CASE WHEN s0 <= max(e0) OVER (PARTITION BY tname ORDER BY s0, e0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM a),
g AS (SELECT *, sum(new) OVER (PARTITION BY tname ORDER BY s0, e0 ROWS UNBOUNDED PRECEDING) AS isl FROM i)"""


@query("merge_regions", f"WITH {REGIONS} SELECT tname, min(s0) AS start, max(e0) AS \"end\" FROM g GROUP BY tname, isl")
def merge_regions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.merge_regions(records(spark, d, "subject"), pad=10)


def _second(spark: SparkSession, d: str) -> DataFrame:
    s = records(spark, d, "reference")
    return s.withColumn("tname", F.lit("segA:1000")).withColumn("tstart", F.col("tstart") - 1000).withColumn("tend", F.col("tend") - 1000)


@query("override_merge", f"WITH s AS ({S}), r AS ({R}), w AS (SELECT qname, tstart, tend, strand, mapq FROM r WHERE strand <> '*' AND mapq >= 60) SELECT s.qname, coalesce(w.tstart, s.tstart) AS tstart, coalesce(w.tend, s.tend) AS tend, CASE WHEN w.qname IS NULL THEN s.tname ELSE 'segA' END AS tname, coalesce(w.mapq, s.mapq) AS mapq, w.qname IS NOT NULL AS replaced FROM s LEFT JOIN w USING (qname)")
def override_merge(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.override(records(spark, d, "subject"), _second(spark, d)).select("qname", "tstart", "tend", "tname", "mapq", "replaced")


@query("select_reads", f"WITH s AS ({S}) SELECT o_orderkey AS n FROM orders WHERE o_orderkey NOT IN (SELECT n FROM s WHERE mapq >= 60)")
def select_reads(spark: SparkSession, d: str) -> DataFrame:
    reads = table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("query_id"))
    p = records(spark, d, "subject").withColumn("qname", F.col("n").cast("string"))
    return evaluate.select_reads(reads, p).select("n")


@query("multiset_shared", f"WITH s AS (SELECT tname, tstart % 100 AS x FROM ({S})), r AS (SELECT tname, tstart % 100 AS x FROM ({R})) SELECT count(*) AS shared FROM (SELECT * FROM s INTERSECT ALL SELECT * FROM r)")
def multiset_shared(spark: SparkSession, d: str) -> DataFrame:
    a, b = (records(spark, d, w).select("tname", (F.col("tstart") % 100).alias("x")) for w in ("subject", "reference"))
    return evaluate.multiset_shared(a, b)


@query("nearest_rank", "WITH r AS (SELECT l_returnflag, l_quantity, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)) SELECT l_returnflag, any_value(n) AS n, max(CASE WHEN i = CAST(round_even(0.25 * (n - 1), 0) AS BIGINT) THEN l_quantity END) AS q25, max(CASE WHEN i = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) THEN l_quantity END) AS q50, max(CASE WHEN i = CAST(round_even(0.75 * (n - 1), 0) AS BIGINT) THEN l_quantity END) AS q75 FROM r GROUP BY l_returnflag")
def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", (0.25, 0.5, 0.75))


@query("fit_lines", "SELECT l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_linestatus")
def fit_lines(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.fit(table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice")
    return out.select("l_linestatus", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("log_bins", "WITH l AS (SELECT l_returnflag, log10(l_extendedprice) AS x FROM lineitem WHERE l_extendedprice > 0), b AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM l WINDOW w AS (PARTITION BY l_returnflag)) SELECT l_returnflag, least(17, CAST(trunc((x - lo) / ((hi - lo) / 18)) AS INT)) AS bin, count(*) AS n FROM b GROUP BY ALL")
def log_bins(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.log_bins(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice").groupBy("l_returnflag", "bin").agg(F.count("*").alias("n"))


def _runs(spark: SparkSession, d: str, factor: float) -> DataFrame:
    li = table(spark, d, "lineitem")
    wall = F.sum(F.col("l_quantity") * (1 + F.lit(factor) * F.col("l_discount")))
    return li.groupBy(F.col("l_returnflag").alias("benchmark"), F.col("l_linestatus").alias("metric"), F.col("l_linenumber").alias("threads")).agg(wall.alias("wall_s"), F.sum(F.col("l_extendedprice") * (1 + F.lit(factor) * F.col("l_tax"))).alias("rss_kb"))


def _runs_sql(factor: float) -> str:
    return f"SELECT l_returnflag AS benchmark, l_linestatus AS metric, l_linenumber AS threads, sum(l_quantity * (1 + {factor} * l_discount)) AS wall_s, sum(l_extendedprice * (1 + {factor} * l_tax)) AS rss_kb FROM lineitem GROUP BY ALL"


@query(
    "gate",
    f"""WITH b AS ({_runs_sql(0.0)}), c AS ({_runs_sql(1.5)}), p AS (SELECT benchmark, metric, count(c.wall_s) AS n, exp(avg(ln(c.wall_s / b.wall_s))) AS w, median(c.rss_kb / b.rss_kb) AS m FROM b JOIN c USING (benchmark, metric, threads) GROUP BY ALL)
SELECT benchmark, metric, n, round(w, 6) AS wall_ratio, round(m, 6) AS rss_ratio, CASE WHEN n >= 2 AND w - 1 > 0.1 THEN 'BLOCK' WHEN n >= 2 AND (w - 1 > 0.03 OR m - 1 > 0.05) THEN 'REVIEW' ELSE 'ACCEPT' END AS verdict FROM p""",
)
def gate(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.gate(_runs(spark, d, 0.0), _runs(spark, d, 1.5))
    return out.select("benchmark", "metric", "n", F.round("wall_ratio", 6).alias("wall_ratio"), F.round("rss_ratio", 6).alias("rss_ratio"), "verdict")


@query("stage_shares", "SELECT l_shipmode_ AS region, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS share_A, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS share_N, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS share_R FROM (SELECT *, l_linenumber AS l_shipmode_ FROM lineitem) GROUP BY 1")
def stage_shares(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("region", F.col("l_linenumber"))
    out = evaluate.stage_shares(li, "region", "l_returnflag", "l_quantity", ["A", "N", "R"])
    return out.select("region", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


SAM_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS qname, CAST(100 + o_orderkey % 9 + o_orderkey % 4 AS INT) AS qlen, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 ELSE o_orderkey % 4 END AS INT) AS qstart, CAST(o_orderkey % 1000 AS INT) AS tstart, CAST(o_orderkey % 1000 + 102 AS INT) AS tend, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(102 - o_orderkey % 3 AS INT) AS nmatch, 5000 AS tlen FROM orders"


@query("sam_to_paf", SAM_SQL)
def sam_to_paf(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    cigar = F.concat(clip(k % 9), F.lit("40M2D60M"), clip(k % 4))
    tab = F.lit("\t")
    rec = F.concat(k.cast("string"), tab, F.when(k % 2 == 0, "0").otherwise("16"), tab, F.lit("chr1"), tab, (k % 1000 + 1).cast("string"), tab, F.lit("60"), tab, cigar, F.lit("\t*\t0\t0\t*\t*\tNM:i:"), (k % 3).cast("string"))
    lines = table(spark, d, "orders").select(rec.alias("value")).unionByName(spark.range(1).select(F.lit("@SQ\tSN:chr1\tLN:5000").alias("value")))
    out = paf.sam_to_paf(lines)
    return out.select("qname", "qlen", "qstart", "tstart", "tend", "strand", "nmatch", "tlen")


@query("simulate_reads")
def simulate_reads(spark: SparkSession, d: str) -> DataFrame:
    return simulate.simulate(corpus(spark, d).segments, length=200, depth=1.0, sub=0.01, ins=0.005, dele=0.005, error_sd=0.5, run_bias=5.0, text=True)


@query("map_simulated")
def map_simulated(spark: SparkSession, d: str) -> DataFrame:
    mappings = many.map_many(corpus(spark, d).segments, simulate_reads(spark, d), replace(PARAMS, theta=0.3), segments_text=True)
    return evaluate.truth_accuracy(paf.core(mappings))


@query("truth_windows")
def truth_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every document is its own read, over its whole text."""
    segments = corpus(spark, d).segments
    length = F.coalesce("sz", F.lit(0))
    reads = segments.select(F.col("segm_id").alias("read_idx"), F.concat_ws("!", F.lit("S1_1"), "name", F.lit("0"), length.cast("string"), F.lit("+")).alias("query_id"), length.alias("read_len"), "seq")
    index = mapper.build_index(segments, PARAMS, True)
    seeds = mapper.read_seeds(reads, index, PARAMS, True)
    hits = mapper.bucket_hits(seeds.where("hits > 0"), index.hits, reads, PARAMS, truth.true_segments(reads, segments))
    return truth.truth_summary(truth.truth_scores(hits, reads, segments, index.sketch), PARAMS.theta)


FLAGSHIP = QUERIES["map_containment"]
