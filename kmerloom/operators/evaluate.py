"""Analytics over mapping output: validity, concordance, truth, regions, fits, quantiles, regression gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_overlap(c1: Column, s1: Column, e1: Column, c2: Column, s2: Column, e2: Column, least: float) -> Column:
    """Whether two intervals on one target share more than ``least`` of their joint span."""
    lo1, hi1, lo2, hi2 = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    inter = F.least(hi1, hi2) - F.greatest(lo1, lo2)
    span = F.greatest(hi1, hi2) - F.least(lo1, lo2)
    return (c1 == c2) & (inter > 0) & (span > 0) & (F.try_divide(inter.cast("double"), span.cast("double")) > least)


def _met(subject: DataFrame, reference: DataFrame, least: float) -> DataFrame:
    s = subject.select("qname", F.col("tname").alias("s_t"), F.col("tstart").alias("s_s"), F.col("tend").alias("s_e"))
    r = reference.select("qname", F.col("tname").alias("r_t"), F.col("tstart").alias("r_s"), F.col("tend").alias("r_e"))
    met = r.join(s, "qname", "left")
    return met.withColumn("agree", F.coalesce(interval_overlap(F.col("s_t"), F.col("s_s"), F.col("s_e"), F.col("r_t"), F.col("r_s"), F.col("r_e"), least), F.lit(False)))


def concordance(subject: DataFrame, reference: DataFrame, least: float = 0.1) -> DataFrame:
    """How the mappings of one table agree with those of another, both one row per read."""
    met = _met(subject, reference, least)
    both = F.col("s_t").isNotNull()
    out = met.agg(
        F.count("*").alias("reference_mapped"),
        F.count_if(both).alias("both_mapped"),
        F.count_if(F.col("agree")).alias("concordant"),
        F.count_if(both & ~F.col("agree") & (F.col("s_t") == F.col("r_t"))).alias("discordant_same_target"),
        F.count_if(both & ~F.col("agree") & (F.col("s_t") != F.col("r_t"))).alias("discordant_other_target"),
        F.count_if(~both).alias("missed"),
    )
    n = F.greatest(F.col("reference_mapped"), F.lit(1)).cast("double")
    out = out.crossJoin(subject.agg(F.count("*").alias("subject_mapped")))  # one row each
    return out.withColumns(
        {
            "recall": F.col("both_mapped") / n,
            "agreement": F.coalesce(F.try_divide(F.col("concordant").cast("double"), F.col("both_mapped").cast("double")), F.lit(0.0)),
            "good": F.col("concordant") / n,
            "min_overlap": F.lit(least),
        }
    )


def adjudicate(subject: DataFrame, reference: DataFrame, truth: DataFrame, least: float = 0.1) -> DataFrame:
    """Verdict counts of the reads on which two tables disagree; truth has qname, tname, tstart, tend."""
    met = _met(subject, reference, least).where(F.col("s_t").isNotNull() & ~F.col("agree"))
    t = truth.select("qname", F.col("tname").alias("t_t"), F.col("tstart").alias("t_s"), F.col("tend").alias("t_e"))
    met = met.join(t, "qname", "left")

    def right(x: str) -> Column:
        return F.coalesce(interval_overlap(F.col(f"{x}_t"), F.col(f"{x}_s"), F.col(f"{x}_e"), F.col("t_t"), F.col("t_s"), F.col("t_e"), least), F.lit(False))

    verdict = F.when(F.col("t_t").isNull(), "no truth").when(right("s") & right("r"), "both right").when(right("s"), "subject right").when(right("r"), "reference right").otherwise("both wrong")
    return met.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def top_pairs(subject: DataFrame, reference: DataFrame, n: int = 15, least: float = 0.1) -> DataFrame:
    """The most frequent pairs of different targets among disagreements."""
    met = _met(subject, reference, least).where(F.col("s_t").isNotNull() & (F.col("s_t") != F.col("r_t")))
    return met.groupBy(F.col("r_t").alias("reference_target"), F.col("s_t").alias("subject_target")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reference_target", "subject_target").limit(n)


def invariants(paf: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Violations of what every record must satisfy, by kind: n and the first read. paf may have j, j2, sh."""
    c = F.col
    rules = {
        "query coords": ~((c("qstart") >= 0) & (c("qstart") < c("qend")) & (c("qend") <= c("qlen"))),
        "target coords": ~((c("tstart") >= 0) & (c("tstart") <= c("tend"))),
        "target beyond segment": c("tend") >= c("tlen"),
        "strand": ~c("strand").isin("+", "-"),
        "mapq range": ~c("mapq").between(0, 60),
        "span over ten reads": c("tend") - c("tstart") + 1 > 10 * c("qlen"),
    }
    if sizes is not None:
        paf = paf.join(sizes.select("tname", F.col("tlen").alias("own_tlen")), "tname", "left")
        rules["segment length mismatch"] = c("own_tlen") != c("tlen")
    if {"j", "j2", "sh"} <= set(paf.columns):
        rules |= {"score range": ~c("j").between(-0.001, 1.001), "second over best": c("j2") > c("j") + 1e-9, "bound below score": c("sh") + 1e-9 < c("j")}
    broken = F.filter(F.array(*(F.when(r, F.lit(k)) for k, r in rules.items())), lambda x: x.isNotNull())
    return paf.select("qname", F.explode(broken).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.min("qname").alias("first_read"))


def truth_of(qname: Column) -> Column:
    """(segment, start, end, strand) that a simulated read's name carries, else null."""
    p = F.split(qname, "!")
    t = F.struct(F.get(p, F.lit(1)).alias("segment"), F.get(p, F.lit(2)).cast("int").alias("start"), F.get(p, F.lit(3)).cast("int").alias("end"), F.get(p, F.lit(4)).alias("strand"))
    return F.when(F.size(p) == 5, t)


def truth_accuracy(paf: DataFrame, least: float = 0.1) -> DataFrame:
    """Right and wrong mappings by two rules: an end within a read length, and shared span over the joint span."""
    t = paf.withColumn("t", truth_of(F.col("qname"))).where(F.col("t").isNotNull())
    same = F.col("tname") == F.col("t.segment")
    ends = same & (F.least(F.abs(F.col("tstart") - F.col("t.start")), F.abs(F.col("tend") - F.col("t.end"))) <= F.col("qlen"))
    inter = F.least("tend", "t.end") - F.greatest("tstart", "t.start")
    union = F.greatest("tend", "t.end") - F.least("tstart", "t.start")
    over = same & (inter > 0) & (union > 0) & (F.try_divide(inter.cast("double"), union.cast("double")) > least)
    top = F.col("mapq") == 60
    return t.agg(F.count("*").alias("n"), F.count_if(ends).alias("ends_ok"), F.count_if(~ends).alias("ends_bad"), F.count_if(over).alias("overlap_ok"), F.count_if(~over).alias("overlap_bad"), F.count_if(top & over).alias("q60_ok"), F.count_if(top & ~over).alias("q60_bad"))


def merge_regions(paf: DataFrame, pad: int = 0, below: int = 60) -> DataFrame:
    """Joined, padded target intervals of placed reads below a mapping quality: gaps and islands."""
    placed = paf.where(F.col("strand") != "*")
    sizes = placed.groupBy("tname").agg(F.max("tlen").alias("own"))
    at = placed.where(F.col("mapq") < below).join(sizes, "tname")
    at = at.select("tname", F.greatest(F.lit(0), F.col("tstart") - pad).alias("s"), F.least("own", F.col("tend") + pad).alias("e"))
    before = Window.partitionBy("tname").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("new", F.coalesce(F.col("s") > F.max("e").over(before), F.lit(True)).cast("int"))
    at = at.withColumn("island", F.sum("new").over(Window.partitionBy("tname").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy("tname", "island").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("island")


def mini_reference(regions: DataFrame, segments: DataFrame) -> DataFrame:
    """The sequence of each region, named target:start."""
    met = regions.join(segments.select(F.col("name").alias("tname"), "seq"), "tname")
    out = met.select(F.concat_ws(":", "tname", F.col("start").cast("string")).alias("name"), F.substring(F.col("seq"), F.col("start") + 1, F.col("end") - F.col("start")).alias("seq"))
    return out.where("seq <> ''")


def select_reads(reads: DataFrame, paf: DataFrame, least: int = 60) -> DataFrame:
    """Reads without a confident record: those below the quality and those that are absent."""
    sure = paf.where(F.col("mapq") >= least).select(F.col("qname").alias("query_id")).distinct()
    return reads.join(sure, "query_id", "left_anti")


def override(first: DataFrame, second: DataFrame, least: int = 60) -> DataFrame:
    """First-pass rows with core columns of the second pass where it is confident, moved back by its region."""
    sizes = first.where("strand <> '*'").groupBy("tname").agg(F.max("tlen").alias("own"))
    s = second.where((F.col("strand") != "*") & (F.col("mapq") >= least) & F.col("tname").contains(":"))
    s = s.withColumn("chrom", F.regexp_extract("tname", "^(.*):([^:]*)$", 1)).withColumn("off", F.regexp_extract("tname", "^(.*):([^:]*)$", 2).cast("int"))
    s = s.join(sizes.withColumnRenamed("tname", "chrom"), "chrom")
    moved = ["strand", "tname", "tlen", "tstart", "tend", "mapq"]
    s = s.groupBy("qname").agg(F.max_by(F.struct("strand", F.col("chrom").alias("tname"), F.col("own").alias("tlen"), (F.col("tstart") + F.col("off")).alias("tstart"), (F.col("tend") + F.col("off")).alias("tend"), "mapq"), F.struct("n")).alias("w"))
    both = first.join(s, "qname", "left")
    return both.select(*[F.coalesce(F.col(f"w.{c}"), F.col(c)).alias(c) if c in moved else F.col(c) for c in first.columns], F.col("w").isNotNull().alias("replaced"))


def multiset_shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many equal rows two tables share, repeats counting."""
    return a.intersectAll(b).agg(F.count("*").alias("shared"))


def nearest_rank(df: DataFrame, by: list[str], value: str, qs: tuple[float, ...], name: str = "q") -> DataFrame:
    """Quantiles without interpolation: the value at rank round(q (n - 1)), halves to even."""
    w = Window.partitionBy(*by)
    at = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    picks = [F.max(F.when(F.col("_i") == F.bround(F.lit(q) * (F.col("_n") - 1)).cast("int"), F.col(value))).alias(f"{name}{round(q * 100)}") for q in qs]
    return at.groupBy(*by).agg(F.count("*").alias("n"), *picks)


def fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line: zeros below three points, slope 0 where x does not vary."""
    a = df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.regr_r2(y, x).alias("r"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"))
    few, flat = F.col("n") < 3, F.col("sxx") == 0
    return a.select(
        *by, "n", F.when(few | flat, 0.0).otherwise(F.col("s")).alias("slope"), F.when(few, 0.0).when(flat, F.col("my")).otherwise(F.col("i")).alias("intercept"), F.when(few | flat, 0.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r2")
    )


def log_bins(df: DataFrame, by: list[str], x: str, bins: int = 18) -> DataFrame:
    """Adds ``bin``: equal widths of log10 x between the least and the largest of its group."""
    w = Window.partitionBy(*by)
    at = df.where(F.col(x) > 0).withColumn("_l", F.log10(x))
    lo, hi = F.min("_l").over(w), F.max("_l").over(w)
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    return at.withColumn("bin", F.least(F.lit(bins - 1), ((F.col("_l") - lo) / width).cast("int"))).drop("_l")


def binned_medians(df: DataFrame, by: list[str], x: str, y: str, least: int = 25) -> DataFrame:
    """Median x, and quartiles of y, of log bins with at least so many points."""
    at = log_bins(df, by, x)
    return nearest_rank(at, [*by, "bin"], x, (0.5,), "x").where(F.col("n") >= least).join(nearest_rank(at, [*by, "bin"], y, (0.25, 0.5, 0.75), "y").drop("n"), [*by, "bin"])


def geometric_mean(c: Column) -> Column:
    return F.exp(F.avg(F.log(c)))


def gate(base: DataFrame, cand: DataFrame, review: float = 0.03, block: float = 0.10, rss: float = 0.05, least: int = 2) -> DataFrame:
    """ACCEPT, REVIEW or BLOCK for each (benchmark, metric) by time and memory ratios over thread counts.

    Tables have benchmark, metric, threads, wall_s, rss_kb. A configuration that the candidate lacks blocks.
    """
    key = ["benchmark", "metric", "threads"]
    b = base.select(*key, F.col("wall_s").alias("b_wall"), F.col("rss_kb").alias("b_rss"))
    c = cand.select(*key, F.col("wall_s").alias("c_wall"), F.col("rss_kb").alias("c_rss"))
    both = b.join(c, key, "full")
    both = both.withColumn("wall", F.try_divide("c_wall", "b_wall")).withColumn("mem", F.try_divide("c_rss", "b_rss"))
    per = both.groupBy("benchmark", "metric").agg(
        F.count("wall").alias("n"), F.count_if(F.col("b_wall").isNotNull() & F.col("c_wall").isNull()).alias("absent"), F.count_if(F.col("b_wall").isNull()).alias("added"),
        geometric_mean(F.col("wall")).alias("wall_ratio"), F.median("mem").alias("rss_ratio"), F.max("mem").alias("rss_max"),
    )
    slow, big = F.col("wall_ratio") - 1, F.col("rss_ratio") - 1
    enough = F.col("n") >= least
    verdict = F.when((F.col("absent") > 0) | (enough & (slow > block)), "BLOCK").when(enough & ((slow > review) | (big > rss)), "REVIEW").otherwise("ACCEPT")
    return per.withColumn("verdict", verdict)


def stage_shares(times: DataFrame, by: str, stage: str, value: str, stages: list[str]) -> DataFrame:
    """A row per ``by`` with the share of each stage."""
    wide = times.groupBy(by).pivot(stage, stages).agg(F.sum(value))
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"`{s}`"), F.lit(0.0)) for s in stages))
    return wide.select(by, *(F.try_divide(F.coalesce(F.col(f"`{s}`"), F.lit(0.0)), total).alias(f"share_{s}") for s in stages))


def signature(lines: DataFrame, line: str = "line") -> DataFrame:
    """Count, and a digest that does not depend on order, of text rows."""
    return lines.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(line)).alias("digest"))


def run_counters(stats: DataFrame) -> DataFrame:
    """Sums of the counters over reads, with ratios (null where nothing is divided)."""
    cols = ["m", "kmers_unique", "budget", "possible_matches", "seed_matches", "max_seed_matches", "kmers_notmatched"]
    out = stats.agg(F.count("*").alias("reads"), F.sum("read_len").alias("read_len"), *(F.sum(c).alias(c) for c in cols))
    return out.withColumn("used_share", F.try_divide(F.col("seed_matches").cast("double"), F.col("possible_matches").cast("double")))


def warnings(reads: Column, mapped: Column, possible: Column, total: Column, q60: Column, q0: Column) -> Column:
    """What looks wrong with a run, as an array of texts."""
    rules = [
        (F.try_divide(mapped.cast("double"), reads.cast("double")) < 0.95, "fewer than 95% of reads mapped"),
        (F.try_divide(possible.cast("double"), total.cast("double")) < 10, "seeds save less than a factor of 10"),
        (q60 < q0, "more mappings without than with confidence"),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in rules)), lambda x: x.isNotNull())


def kmer_survival(reads_sketch: DataFrame, reference_sketch: DataFrame, k: int) -> DataFrame:
    """Share of read k-mers that the reference has, and the error rate that it implies."""
    known = reference_sketch.select("h").distinct().withColumn("hit", F.lit(1))
    met = reads_sketch.join(known, "h", "left").groupBy("owner").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("survival"))
    return met.agg(F.count("*").alias("reads"), F.avg("survival").alias("mean_survival")).withColumn("error_rate", 1 - F.pow("mean_survival", F.lit(1.0 / k)))
