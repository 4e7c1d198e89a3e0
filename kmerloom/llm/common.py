"""Helpers that the operators of this subpackage share: tables, the shared folder, words and hashes."""

from __future__ import annotations

import ctypes
import os
import platform
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from kmerloom.session import ship

U64 = np.uint64
_LIBC = ctypes.CDLL("libc.so.6") if platform.libc_ver()[0] == "glibc" else None
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Odd multipliers of a 64-bit mixer.
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """The package on the executors."""
    ship(spark)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what Python makes of them stays small; the session decides on the rest.

    A worker process that begins a task first gives back the memory that earlier tasks have freed.
    """
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def workdir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only in local mode (tests) a local folder is taken where the setting is unset; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "kmerloom-work")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stash(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    Python workers get small batches while it is written; the session's setting is put back.
    """
    spark = df.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "512")
    try:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder that nothing will read again."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_KEPT: dict = {}


def kept(key, make):
    """What a worker process keeps from task to task, until work that asks for ``released`` begins in it."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def released() -> None:
    """Let go of what earlier work of other kinds has kept in this worker process."""
    _KEPT.clear()


class WordHashes(dict):
    """64-bit hashes of byte words, remembered for up to a fixed number of words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit
        released()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8 (null: none)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def hashed_words(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words in order, repeats kept; fewer words: the whole sequence as one."""
    m = len(word_hashes)
    if m == 0:
        return word_hashes
    if m < n:
        n, salt = m, U64(m)
    else:
        salt = U64(0)
    out = np.full(m - n + 1, salt, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = mix(out * GOLDEN + word_hashes[j : m - n + 1 + j])
    return out


def arrow(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
