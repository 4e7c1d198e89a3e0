"""Inputs of the catalogue's queries: documents as reference, benchmark items as reads, orders as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators.mapper import Corpus
from kmerloom.params import Params

PARAMS = Params(k=15, h_frac=0.05, theta=0.4, min_diff=0.075, max_overlap=0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    segments = docs.select(F.col("doc_id").alias("segm_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.length("text").cast("int").alias("sz"), F.col("text").alias("seq"))
    reads = items.select(F.col("item_id").alias("read_idx"), F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("query_id"), F.length("text").cast("int").alias("read_len"), F.col("text").alias("seq"))
    return Corpus(segments, reads, text=True)


def records(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Orders as mapping records; ``subject`` and ``reference`` place some of them differently."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    shift = {"subject": (k % 7) * 40, "reference": (k % 5) * 40}[which]
    target = F.when(k % 11 == 0, "segB").otherwise("segA") if which == "subject" else F.lit("segA")
    start = ((k * 37) % 100000 + shift).cast("int")
    o = o.where(k % 13 != 0) if which == "subject" else o.where(k % 17 != 0)
    truth = ((k * 37) % 100000).cast("int")
    return o.select(
        F.concat_ws("!", F.concat(F.lit("S"), k.cast("string"), F.lit("_1")), F.lit("segA"), truth.cast("string"), (truth + 300).cast("string"), F.lit("+")).alias("qname"),
        F.lit(300).alias("qlen"), F.lit(0).alias("qstart"), F.when(k % 101 == 0, 301).otherwise(284).alias("qend"), F.when(k % 97 == 0, "*").otherwise("+").alias("strand"), target.alias("tname"), F.lit(100100).alias("tlen"),
        start.alias("tstart"), (start + 300).alias("tend"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 5).otherwise(60).alias("mapq"), k.alias("n"),
    )


def records_sql(which: str) -> str:
    """The same in SQL."""
    shift, keep = ("(o_orderkey % 7) * 40", "o_orderkey % 13 <> 0") if which == "subject" else ("(o_orderkey % 5) * 40", "o_orderkey % 17 <> 0")
    target = "CASE WHEN o_orderkey % 11 = 0 THEN 'segB' ELSE 'segA' END" if which == "subject" else "'segA'"
    return f"""SELECT 'S' || o_orderkey || '_1!segA!' || (o_orderkey * 37) % 100000 || '!' || ((o_orderkey * 37) % 100000 + 300) || '!+' AS qname, 300 AS qlen, 0 AS qstart,
      CASE WHEN o_orderkey % 101 = 0 THEN 301 ELSE 284 END AS qend, CASE WHEN o_orderkey % 97 = 0 THEN '*' ELSE '+' END AS strand, {target} AS tname, 100100 AS tlen,
      CAST((o_orderkey * 37) % 100000 + {shift} AS INT) AS tstart, CAST((o_orderkey * 37) % 100000 + {shift} + 300 AS INT) AS tend,
      CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 60 END AS mapq, o_orderkey AS n, (o_orderkey * 37) % 100000 AS ts FROM orders WHERE {keep}"""
