"""Scores of candidate buckets, the best and second best of each read, and mapping quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.params import Params
from kmerloom.session import ship

KEY = ["read_idx", "segm_id", "b"]


def jaccard(i: Column, m: Column, s: Column) -> Column:
    return i / (m + s - i).cast("double")


def containment(i: Column, m: Column) -> Column:
    return i / m.cast("double")


def windows(live: DataFrame, hits: DataFrame, sketch: DataFrame, p: Params) -> DataFrame:
    """The best window of m k-mers in each bucket, by a sweep over events instead of places.

    A hit at place x counts for the windows that begin in (place of the hit occs earlier, x] and hold x; so it
    is two events, and the intersection of any window is a running sum.  It changes at events only, where
    the windows are looked at; the first of the best wins.
    """
    absolute = p.absolute_positions
    at = hits.groupBy(*KEY, "h").agg(F.first("occs").alias("occs"), F.array_sort(F.collect_list(F.struct("tpos", "same", "r"))).alias("a"))
    spans = live.select(*KEY, "m", "n_kmers", "read_len")
    if absolute:  # buckets are measured in bases: the sweep covers the k-mers that they hold
        inside = hits.groupBy(*KEY).agg(F.min("tpos").alias("begin"), (F.max("tpos") + 1).alias("end"))
        spans = spans.join(inside, KEY)
    else:
        spans = spans.withColumn("begin", F.col("b") * F.col("m")).withColumn("end", F.least((F.col("b") + 2) * F.col("m"), F.col("n_kmers")))
    at = at.join(spans, KEY)
    weight = F.lit(0.0)
    if p.alpha > 0:
        at = at.join(hits.groupBy("read_idx", "h").agg(F.first("weight").alias("weight")), ["read_idx", "h"])
        weight = F.col("weight")

    def events(x: Column, i: Column) -> Column:
        place = x["tpos"]
        before = F.when(i >= F.col("occs"), F.get(F.col("a"), i - F.col("occs"))["tpos"]).otherwise(F.lit(-1))
        first = F.greatest(F.col("begin"), place - F.col("m") + 1)
        low = F.greatest(first, before + 1)

        def event(l: Column, di: Column, ds: Column, dw: Column) -> Column:
            return F.struct(l.cast("int").alias("l"), di.cast("int").alias("di"), ds.cast("int").alias("ds"), dw.cast("double").alias("dw"))

        zero, one = F.lit(0), F.lit(1)
        strand = [event(first, zero, x["same"], zero), event(place + 1, zero, -x["same"], zero)]
        count = [event(low, one, zero, weight), event(place + 1, -one, zero, -weight)]
        extra = [event(place, zero, zero, zero)] if p.metric == "Jaccard" else []
        return F.when(low <= place, F.array(*strand, *count, *extra)).otherwise(F.array(*strand, *extra))

    moved = at.select(*KEY, "m", "begin", "end", F.explode(F.flatten(F.transform("a", events))).alias("e"))
    moved = moved.groupBy(*KEY, "e.l").agg(F.first("m").alias("m"), F.first("begin").alias("begin"), F.first("end").alias("end"), F.sum("e.di").alias("di"), F.sum("e.ds").alias("ds"), F.sum("e.dw").alias("dw"))
    run = Window.partitionBy(*KEY).orderBy("l").rowsBetween(Window.unboundedPreceding, 0)
    moved = moved.select(*KEY, "l", "m", "begin", "end", F.sum("di").over(run).cast("int").alias("i"), F.sum("ds").over(run).cast("int").alias("same_strand"), F.sum("dw").over(run).alias("support"))
    moved = moved.where((F.col("l") >= F.col("begin")) & (F.col("l") < F.col("end"))).withColumn("right", F.least(F.col("l") + F.col("m"), F.col("end")))
    if p.rarity_weight > 0:
        moved = moved.join(hits.groupBy("read_idx").agg(F.first("m_weight").alias("m_weight")), "read_idx")
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide("support", "m_weight"), F.lit(0.0))))
    elif p.metric == "Jaccard":
        score = jaccard(F.col("i"), F.col("m"), F.col("right") - F.col("l"))
    else:
        score = containment(F.col("i"), F.col("m"))
    best = moved.withColumn("score", score).groupBy(*KEY).agg(F.min(F.struct((-F.col("score")).alias("neg"), "l", "right", "i", "same_strand", "support")).alias("w"))
    best = best.select(*KEY, (-F.col("w.neg")).alias("score"), F.col("w.l").alias("l"), (F.col("w.right") - 1).alias("last"), F.col("w.i").alias("intersection"), F.col("w.same_strand").alias("same_strand"), F.col("w.support").alias("support"))
    ends = sketch.select("segm_id", F.col("tpos").alias("at"), "r")
    best = best.join(ends.select("segm_id", F.col("at").alias("l"), F.col("r").alias("t_l")), ["segm_id", "l"])
    best = best.join(ends.select("segm_id", F.col("at").alias("last"), F.col("r").alias("t_r")), ["segm_id", "last"])
    return best.withColumn("s_sz", F.col("t_r") - F.col("t_l") + 1).drop("l", "last")


def lis(values: list[int]) -> int:
    """Length of the longest strictly increasing subsequence."""
    import bisect

    tails: list[int] = []
    for x in values:
        i = bisect.bisect_left(tails, x)
        tails[i : i + 1] = [x]
    return len(tails)


def lcs(live: DataFrame, hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per bucket the longest run of read places that follows its k-mers forwards or backwards, over m."""
    ship(live.sparkSession)

    @F.pandas_udf("int")
    def longest(places: pd.Series) -> pd.Series:
        return pd.Series([max(lis(list(x)), lis(list(x)[::-1])) for x in places], dtype=np.int32)

    own = seeds.select("read_idx", "h", "pmatches")
    lists = hits.join(own, ["read_idx", "h"]).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("tpos", "pmatches"))).alias("a"))
    lists = lists.select(*KEY, longest(F.flatten(F.transform("a", lambda x: x["pmatches"]))).alias("lcs"))
    return live.join(lists, KEY).withColumn("score", containment(F.col("lcs"), F.col("m")))


def score(live: DataFrame, hits: DataFrame, seeds: DataFrame, index, p: Params) -> DataFrame:
    """Candidate buckets with score, coordinates, intersection, strand sum and support."""
    if p.metric in ("bucket_SH", "bucket_LCS"):
        out = lcs(live, hits, seeds) if p.metric == "bucket_LCS" else live.withColumn("score", F.col("sh"))
        return out.select(
            *KEY, "m", "place", "sh", "seeded_buckets", "score", F.col("r_min").alias("t_l"), F.col("r_max").alias("t_r"),
            F.col("matches").alias("intersection"), F.col("codirection").alias("same_strand"), (F.col("r_max") - F.col("r_min")).alias("s_sz"), F.lit(0.0).alias("support"),
        )
    if p.alpha > 0:
        w = F.pow(F.greatest(F.col("hits"), F.lit(1)).cast("double"), F.lit(-p.alpha))
        weights = seeds.select("read_idx", "h", w.alias("weight"), F.sum(w * F.col("occs")).over(Window.partitionBy("read_idx")).alias("m_weight"))
        hits = hits.join(weights, ["read_idx", "h"])
    best = windows(live, hits, index.sketch, p)
    return live.select(*KEY, "m", "place", "sh", "seeded_buckets").join(best, KEY)


def overlap(a_l: Column, a_r: Column, a_segm: Column, b_l: Column, b_r: Column, b_segm: Column) -> Column:
    """Shared part of two reference spans; null (so never below a limit) where both are one same place."""
    cap = F.greatest(F.lit(0), F.least(a_r, b_r) - F.greatest(a_l, b_l))
    cup = F.greatest(a_r, b_r) - F.least(a_l, b_l)
    return F.when(a_segm != b_segm, F.lit(-0.0)).otherwise(F.try_divide(cap.cast("double"), cup.cast("double")))


_FIELDS = ("segm_id", "b", "score", "sh", "t_l", "t_r", "intersection", "same_strand", "s_sz", "support")


def _order_free(scored: DataFrame, p: Params) -> DataFrame:
    """Best and second best by ranking; holds where no score exceeds its bucket's bound."""
    read = Window.partitionBy("read_idx")
    before = read.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    top = read.orderBy(F.desc("score"), "place")
    one = scored.where((F.col("sh") >= p.theta) & (F.col("score") > p.theta))
    one = one.withColumn("bar", F.greatest(F.lit(p.theta), F.coalesce(F.max("score").over(before), F.lit(p.theta))))
    one = one.withColumn("n1", F.sum((F.col("score") > F.col("bar")).cast("int")).over(read)).withColumn("rank", F.row_number().over(top)).where("rank = 1")
    best = one.select("read_idx", "m", "seeded_buckets", "n1", *_FIELDS)
    own = best.select("read_idx", *(F.col(c).alias(f"{c}1") for c in ("segm_id", "t_l", "t_r", "score")))
    two = scored.join(own, "read_idx").withColumn("thr2", F.col("score1") * (1.0 - p.min_diff))
    two = two.where((F.col("sh") >= F.col("thr2")) & (F.col("score") > F.col("thr2")))
    far = overlap(F.col("t_l"), F.col("t_r"), F.col("segm_id"), F.col("t_l1"), F.col("t_r1"), F.col("segm_id1")) < p.max_overlap
    two = two.withColumn("free", F.coalesce(far, F.lit(False)))
    allowed = F.when(F.col("free"), F.col("score"))
    two = two.withColumn("bar", F.greatest("thr2", F.coalesce(F.max(allowed).over(before), F.col("thr2"))))
    two = two.withColumn("n2", F.sum((F.col("score") > F.col("bar")).cast("int")).over(read))
    counts = two.groupBy("read_idx").agg(F.first("n2").alias("n2"))
    second = two.where("free").withColumn("rank", F.row_number().over(top)).where("rank = 1")
    second = second.select("read_idx", F.col("segm_id").alias("segm_id2"), F.col("b").alias("b2"), F.col("score").alias("second"), F.col("intersection").alias("i2"))
    return best.join(counts, "read_idx", "left").join(second, "read_idx", "left").withColumn("final_buckets", F.col("n1") + F.coalesce("n2", F.lit(0)))


def _folded(scored: DataFrame, p: Params) -> DataFrame:
    """The same by an ordered fold, for options under which a score may exceed its bound or ties are weighed."""
    cols = ["place", *_FIELDS]
    per = scored.groupBy("read_idx").agg(F.first("m").alias("m"), F.first("seeded_buckets").alias("seeded_buckets"), F.array_sort(F.collect_list(F.struct(*cols))).alias("all"))
    band = p.rarity_tiebreak
    none = F.lit(None).cast(f"struct<{', '.join(f'{n}:{t}' for n, t in scored.select(*cols).dtypes)}>")

    def fold(start: Column, forbidden: Column | None) -> Column:
        def step(acc: Column, x: Column) -> Column:
            thr, cur = acc["thr"], acc["best"]
            seen = (x["sh"] >= thr) & (x["score"] > thr - band * F.abs(thr))
            free = F.lit(True)
            if forbidden is not None:
                free = F.coalesce(overlap(x["t_l"], x["t_r"], x["segm_id"], forbidden["t_l"], forbidden["t_r"], forbidden["segm_id"]) < p.max_overlap, F.lit(False))
            tied = F.lit(band > 0) & (F.abs(x["score"] - cur["score"]) <= band * F.abs(cur["score"]))
            better = cur["score"].isNull() | F.when(tied, x["support"] > cur["support"]).otherwise(x["score"] > cur["score"])
            take = seen & free & F.coalesce(better, F.lit(True))
            return F.struct(
                F.when(take, F.greatest(thr, x["score"])).otherwise(thr).alias("thr"),
                F.when(take, x).otherwise(cur).alias("best"),
                (acc["n"] + F.when(seen, 1).otherwise(0)).alias("n"),
            )

        return F.aggregate("all", F.struct(start.cast("double").alias("thr"), none.alias("best"), F.lit(0).alias("n")), step)

    one = per.withColumn("one", fold(F.lit(p.theta), None)).where("one.best is not null")
    two = one.withColumn("two", fold(F.col("one.best.score") * (1.0 - p.min_diff), F.col("one.best")))
    return two.select(
        "read_idx", "m", "seeded_buckets", *(F.col(f"one.best.{c}").alias(c) for c in _FIELDS), (F.col("one.n") + F.col("two.n")).alias("final_buckets"),
        F.col("two.best.segm_id").alias("segm_id2"), F.col("two.best.b").alias("b2"), F.col("two.best.score").alias("second"), F.col("two.best.intersection").alias("i2"),
    )


def mapq(score1: Column, score2: Column, same_strand: Column, intersection: Column, p: Params) -> Column:
    """0 without a clear lead, 5 where strands disagree, else 60."""
    mixed = F.abs(same_strand) < F.floor(intersection / 2)
    lead = F.lit(1.0) - score2 / score1 > p.min_diff
    return F.when(~lead, 0).when(mixed, 5).otherwise(60).cast("int")


def choose(scored: DataFrame, p: Params) -> DataFrame:
    fold = p.metric == "bucket_LCS" or p.rarity_weight > 0 or p.rarity_tiebreak > 0 or p.max_matches >= 0 or p.no_pruning
    out = _folded(scored, p) if fold else _order_free(scored, p)
    i2, i1 = F.coalesce("i2", F.lit(-1)), F.col("intersection")
    out = out.withColumn("intersection2", i2).withColumn("segm_id2", F.coalesce("segm_id2", F.lit(-1))).withColumn("b2", F.coalesce("b2", F.lit(-1)))
    out = out.withColumn("sigmas_diff", F.when(F.col("second").isNull(), F.lit(-1.0)).otherwise(F.abs(i2 - i1) / F.sqrt((i2 + i1).cast("double"))))
    out = out.withColumn("score2", F.greatest(F.coalesce("second", F.lit(-1.0)), F.lit(p.theta2)))
    return out.withColumn("mapq", mapq(F.col("score"), F.col("score2"), F.col("same_strand"), i1, p))
