"""Windows of matches around a read's true place, for reads whose names carry it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.evaluate import truth_of
from kmerloom.session import ship


def best_windows(tpos: np.ndarray, r: np.ndarray, seed: np.ndarray, occs: np.ndarray, width: int, m: int) -> tuple[float, float]:
    """Best Jaccard and containment over windows from each match to those at most ``width`` bases on."""
    left = dict(zip(seed.tolist(), occs.tolist()))
    shared, best_j, best_c, end = 0, -1.0, -1.0, 0
    for a in range(len(r)):
        while end < len(r) and r[end] <= r[a] + width:
            left[seed[end]] -= 1
            shared += left[seed[end]] >= 0
            end += 1
        if end > 0:
            size = int(tpos[end - 1] - tpos[a] + 1)
            best_j, best_c = max(best_j, shared / (m + size - shared)), max(best_c, shared / m)
        left[seed[a]] += 1
        shared -= left[seed[a]] >= 1
    return best_j, best_c


def true_segments(reads: DataFrame, segments: DataFrame) -> DataFrame:
    """(read_idx, segm_id) of the segment that each read's name gives."""
    t = reads.select("read_idx", truth_of(F.col("query_id")).getField("segment").alias("name"))
    return t.join(segments.select("segm_id", "name"), "name").select("read_idx", "segm_id")


def truth_scores(hits: DataFrame, reads: DataFrame, segments: DataFrame, sketch: DataFrame) -> DataFrame:
    """Per read and bucket at its true place (offset -1, 0, 1): best Jaccard and containment of its windows.

    hits are bucket hits of all seeds. A read whose name carries no truth raises an error.
    """
    ship(hits.sparkSession)
    t = reads.withColumn("t", truth_of(F.col("query_id")))
    t = t.select("read_idx", "read_len", F.when(F.col("t").isNull(), F.raise_error(F.concat(F.lit("no truth in read name "), F.col("query_id")))).otherwise(F.col("t")).alias("t"))
    t = t.select("read_idx", "read_len", F.col("t.segment").alias("name"), F.col("t.start").alias("start")).join(segments.select("segm_id", "name"), "name")
    first = t.join(sketch.select("segm_id", "tpos", "r"), "segm_id").where("r >= start").groupBy("read_idx", "segm_id", "read_len").agg(F.min("tpos").alias("at"))
    near = hits.join(first, ["read_idx", "segm_id"]).withColumn("offset", F.col("b") - F.floor(F.col("at") / F.col("hl"))).where("offset between -1 and 1")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("tpos")
        j, c = best_windows(f["tpos"].to_numpy(), f["r"].to_numpy(), f["h"].to_numpy(), f["occs"].to_numpy(), int(f["read_len"].iloc[0]), int(f["m"].iloc[0]))
        return pd.DataFrame([(f["read_idx"].iloc[0], f["segm_id"].iloc[0], f["b"].iloc[0], f["offset"].iloc[0], j, c)], columns=["read_idx", "segm_id", "b", "offset", "jaccard", "containment"])

    cols = near.select("read_idx", "segm_id", "b", F.col("offset").cast("int").alias("offset"), "tpos", "r", "h", "occs", "read_len", "m")
    return cols.groupBy("read_idx", "segm_id", "b").applyInPandas(run, "read_idx long, segm_id long, b int, offset int, jaccard double, containment double")


def truth_summary(scores: DataFrame, theta: float) -> DataFrame:
    return scores.groupBy("read_idx").agg(F.max("jaccard").alias("max_j"), F.max("containment").alias("max_c"), F.count_if(F.col("jaccard") >= theta).alias("buckets_j"), F.count_if(F.col("containment") >= theta).alias("buckets_c"))
