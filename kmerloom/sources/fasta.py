"""FASTA and FASTQ files, plain or compressed (gzip, bzip2, xz, zstandard by their first bytes).

Files are read by Spark's own reader, so any file system works, and each is parsed on an executor.  A plain
file that can be split is read by lines instead, whatever its size, if ``by_lines`` is asked for.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.session import ship


def opened(data: bytes) -> io.BufferedIOBase:
    if data[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=io.BytesIO(data))
    if data[:3] == b"BZh":
        return bz2.BZ2File(io.BytesIO(data))
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMAFile(io.BytesIO(data))
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)))
    return io.BytesIO(data)


def records(lines: Iterator[bytes]) -> Iterator[tuple[str, str]]:
    """(name, sequence): names end at white space, lines join, what stands before the first header is dropped."""
    name, parts = None, []
    lines = iter(lines)
    for line in lines:
        line = line.rstrip(b"\r\n")
        if line[:1] == b"@" and name is None:
            seq = next(lines, b"").strip()
            next(lines, b"")
            next(lines, b"")
            yield _name(line), seq.decode("latin-1")
        elif line[:1] == b">":
            if name is not None:
                yield name, b"".join(parts).decode("latin-1")
            name, parts = _name(line), []
        elif name is not None:
            parts.append(line.strip())
    if name is not None:
        yield name, b"".join(parts).decode("latin-1")


def _name(line: bytes) -> str:
    return line[1:].replace(b"\t", b" ").split(b" ")[0].decode("latin-1")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """segm_id (order of files and records), name, sz, seq."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"]):
                rows = [(p, i, n, s) for i, (n, s) in enumerate(records(opened(content)))]
                yield pd.DataFrame(rows, columns=["path", "i", "name", "seq"])

    got = files.mapInPandas(run, "path string, i long, name string, seq string")
    counts = got.groupBy("path").agg(F.count("*").alias("c"))
    before = counts.withColumn("first", F.sum("c").over(Window.orderBy("path")) - F.col("c")).select("path", "first")  # one row per file
    return got.join(F.broadcast(before), "path").select((F.col("first") + F.col("i")).alias("segm_id"), "name", F.length("seq").cast("int").alias("sz"), "seq")


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for one large plain file, split by lines over tasks; a record's number is a running count of headers."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.rtrim("value").alias("v"))
    lines = lines.select("n", F.shiftright("n", 33).alias("split"), "v", F.col("v").startswith(">").cast("int").alias("head"))
    per = lines.groupBy("split").agg(F.sum("head").alias("c"))
    before = per.select("split", (F.sum("c").over(Window.orderBy("split")) - F.col("c")).alias("before"))  # one row per input split
    run = Window.partitionBy("split").orderBy("n")
    numbered = lines.join(F.broadcast(before), "split").withColumn("segm_id", F.col("before") + F.sum("head").over(run) - 1).where("segm_id >= 0")
    heads = numbered.where("head = 1").select("segm_id", F.regexp_extract("v", r"^>([^ \t]*)", 1).alias("name"))
    body = numbered.where("head = 0").groupBy("segm_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]), "").alias("seq"))
    out = heads.join(body, "segm_id", "left").withColumn("seq", F.coalesce("seq", F.lit("")))
    return out.select("segm_id", "name", F.length("seq").cast("int").alias("sz"), "seq")


def as_reads(segments: DataFrame) -> DataFrame:
    return segments.select(F.col("segm_id").alias("read_idx"), F.col("name").alias("query_id"), F.col("sz").alias("read_len"), "seq")


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", order: str = "segm_id") -> None:
    df.orderBy(order).select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)
