"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ascending list of the k least distinct 64-bit hashes of a document's five-word shingles, kept as
little-endian bytes; a document with fewer than five words has its whole word sequence as one shingle, one
without words an empty sketch.  Sketches of parts merge into the sketch of the union, and give estimates of
resemblance, containment and the number of distinct shingles.

Null texts count as empty, repeated rows give repeated results, equal ids are ordered by their texts, null ids
come first, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K, WORDS = 128, 5


def sketch(text: str | None, hashes: common.WordHashes, k: int = K, words: int = WORDS) -> np.ndarray:
    h = common.shingle_hashes(common.hashed_words(common.ascii_words(text), hashes), words)
    if len(h) > 8 * k:  # repeats can hide among the least, so take more than k before looking for them
        part = np.unique(np.partition(h, 4 * k)[: 4 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of a document made of both parts (shingles across the seam belong to a part of their own)."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact while the union has at most k shingles. Two empty sketches: 1."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return float(len(np.intersect1d(np.intersect1d(a, b, True), union, True))) / len(union)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has (1 for an empty a)."""
    if not len(a):
        return 1.0
    r, union = resemblance(a, b, k), distinct_count(merge(a, b, k), k)
    return min(1.0, r * union / distinct_count(a, k))


def as_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype="<u8")


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many first code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rank(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value: a search in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    m = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + m] for i in range(0, len(cuts), m)]
    last = F.array(*(F.lit(g[-1]) for g in groups if len(g) == m))
    group = F.size(F.filter(last, lambda c: c <= value))
    within = F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group)
    return group * m + F.coalesce(F.size(F.filter(within, lambda c: c <= value)), F.lit(0))


def with_next(df: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows (bucket, halo, k, doc_id, text) such that each bucket, sorted, ends with its successor as halo row.

    Buckets are ranges of ids between quantiles, so neighbours meet without one global order; what crosses
    a boundary is one row for each bucket.
    """
    spark = df.sparkSession
    least = -(2**63)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(least)))
    cuts = sorted(set(map(int, docs.select("k").approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)))) if parts > 1 else []
    docs = docs.withColumn("bucket", _rank(F.col("k"), cuts).cast("int"))
    firsts = sorted((r["bucket"], r["k"]) for r in docs.groupBy("bucket").agg(F.min("k").alias("k")).collect())
    if not firsts:
        return docs.withColumn("halo", F.lit(0))
    moved = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)]  # the first of all follows the last bucket
    to = spark.createDataFrame(moved, "bucket int, k long")
    heads = docs.drop("bucket").join(F.broadcast(to), "k").groupBy("bucket", "k", "doc_id").agg(F.min("text").alias("text"))
    cols = ["bucket", "halo", "k", "doc_id", "text"]
    both = docs.withColumn("halo", F.lit(0)).select(cols).unionByName(heads.withColumn("halo", F.lit(1)).select(cols))
    return both.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "halo", "k", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = common.WordHashes()
    before = None  # bucket, doc_id, text, sketch
    for batch in common.slices(batches):
        out: list[tuple] = []
        for bucket, halo, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text"))):
            own = sketch(text, hashes)
            if before is not None and before[0] == bucket:
                _, b_id, b_text, b_sketch = before
                changed = edited(b_text, text)
                c_sketch = b_sketch if changed == b_text else sketch(changed, hashes)
                sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((b_id, len(b_text), sha, as_text(b_sketch), as_text(c_sketch), resemblance(b_sketch, c_sketch), resemblance(b_sketch, own)))
            before = None if halo else (bucket, doc_id, text, own)
        yield common.arrow(_ARROW, list(zip(*out)) if out else [[]] * len(_ARROW))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every text and of its edited form, with their likeness and that to the next document's."""
    common.prepare(df.sparkSession)
    parts = common.shuffle_partitions(df.sparkSession)
    rows = with_next(df, id_col, text_col, parts).select("bucket", "halo", "doc_id", "text")
    return rows.mapInArrow(_compare, SCHEMA)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_fingerprint": op9_fingerprint}
ORACLE_SQL: dict[str, str] = {}
