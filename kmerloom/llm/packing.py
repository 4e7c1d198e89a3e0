"""Lexical retrieval packing.

Texts become token ids plus an end id.  Whole windows of a longer document are sequences of their own; what
remains of every document (less than a window) goes to a shard of lexically close documents.  A shard holds an
inverted index with BM25 weights (document frequencies and mean length over the whole corpus); the first
unused document is the seed of a window, its unused neighbours fill the window in order of score, those that
fit whole first, and the best one that does not fit is cut to close it.  Only a shard's last window is padded.

Shards are runs of at most ``SHARD_DOCS`` documents in the order of their two largest token ids (merges come
in order of frequency, so these are rare tokens): copies and close texts meet whatever the size of the corpus, and
no group of copies need meet in one task.

Null texts count as empty (just the end id), repeated rows are packed as often as they stand, an empty table
gives no rows, other columns are ignored, ties of score go to the earlier document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import WordTokens, shared

WINDOW = 2048
SHARD_DOCS = 512
K1, B = 1.2, 0.75
I64 = pa.int64()
_PIECES = [("doc_id", I64), ("start", I64), ("length", I64), ("ids_crc32", I64), ("doc_tokens", I64), ("sequence_id", I64), ("offset", I64)]
_OUT = pa.schema(_PIECES)
OUT = ", ".join(f"{n} long" for n, _ in _PIECES)
_ROWS = pa.schema([("kind", pa.int32()), *_PIECES, ("payload", pa.binary()), ("place", I64)])
_BLOCK = 4096


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenized(tokenizer: str, end_id: int, window: int, remembered: int):
    """Kind 0: whole windows; 1: remainders with their ids; 2: document frequencies, documents and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared(WordTokens, tokenizer, remembered)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        df, docs, total = np.zeros(1 << 16, dtype=np.int64), 0, 0
        for batch in common.slices(batches, 512):
            rows: list[tuple] = []
            for doc_id, own in zip(batch.column(0).to_pylist(), tokens.ids_of(batch.column(1).to_pylist())):
                if len(own) and int(own.max()) >> 16:
                    raise ValueError("token ids are kept in 16 bits")
                ids = np.append(own, end_id).astype("<u2")
                n = len(ids)
                distinct = np.unique(ids)
                df[distinct] += 1
                docs, total = docs + 1, total + n
                whole = n // window * window
                for start in range(0, whole, window):
                    rows.append((0, doc_id, start, window, crc(ids[start : start + window]), n, sequence, 0, None, None))
                    sequence += 1
                if whole < n:
                    rows.append((1, doc_id, whole, n - whole, None, n, None, None, ids[whole:].tobytes(), int(distinct[-1]) << 16 | int(distinct[-min(2, len(distinct))])))
            if rows:
                yield common.arrow(_ROWS, list(zip(*rows)))
        if docs:
            blocks = [(2, b, docs if b == 0 else 0, total if b == 0 else 0, None, None, None, None, zlib.compress(df[b * _BLOCK : (b + 1) * _BLOCK].tobytes(), 1), None) for b in range(16)]
            yield common.arrow(_ROWS, list(zip(*blocks)))

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(p), dtype=np.int64) for p in table.column("payload").to_pylist())
    rows = {"block": table.column("doc_id").to_pylist()[:1], "docs": [sum(table.column("start").to_pylist())], "total": [sum(table.column("length").to_pylist())], "payload": [total.tobytes()]}
    return pa.table(rows, schema=pa.schema([("block", I64), ("docs", I64), ("total", I64), ("payload", pa.binary())]))


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean_length: float):
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        keys = np.repeat(np.arange(len(pieces), dtype=np.uint32) << np.uint32(16), length) | np.concatenate(pieces).astype(np.uint32)
        keys, tf = np.unique(keys, return_counts=True)
        doc, term = (keys >> np.uint32(16)).astype(np.int64), (keys & np.uint32(0xFFFF)).astype(np.int64)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean_length))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.n = doc[order], weight[order], len(pieces)
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, len(pieces))))
        self.first = np.searchsorted(term[order], np.arange((1 << 16) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for the distinct tokens of the seed."""
        lo, hi = self.first[self.terms[seed]], self.first[self.terms[seed] + 1]
        sizes = hi - lo
        at = np.arange(int(sizes.sum())) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_shard(pieces: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, from, to), every id once."""
    index = Index(pieces, idf, mean_length)
    at = np.zeros(len(pieces), dtype=np.int64)
    left = np.array([len(p) for p in pieces], dtype=np.int64)
    seed = 0
    while True:
        while seed < len(pieces) and not left[seed]:
            seed += 1
        if seed == len(pieces):
            return
        room, out = window, []

        def take(i: int, n: int) -> None:
            nonlocal room
            out.append((i, int(at[i]), int(at[i]) + n))
            at[i] += n
            left[i] -= n
            room -= n

        take(seed, int(min(left[seed], window)))
        if room:
            score = index.scores(seed)
            order = np.argsort(-score, kind="stable")
            order = order[left[order] > 0]
            for i, n in zip(order.tolist(), left[order].tolist()):  # room only shrinks, so what did not fit need not be tried again
                if n <= room:
                    take(i, n)
            order = order[left[order] > 0]
            if room and len(order):
                take(int(order[0]), room)
        yield out


def _packed(model, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean_length = model.value
        common.released()
        context = TaskContext.get()
        sequence = (1 << 62) + ((context.partitionId() if context else 0) << 32)
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal sequence
            pieces = [np.frombuffer(x[3], dtype="<u2") for x in held]
            rows = []
            for seq in pack_shard(pieces, idf, mean_length, window):
                offset = 0
                for i, a, b in seq:
                    doc_id, start, n, _ = held[i]
                    rows.append((doc_id, start + a, b - a, crc(pieces[i][a:b]), n, sequence, offset))
                    offset += b - a
                sequence += 1
            held.clear()
            return common.arrow(_OUT, list(zip(*rows)))

        for batch in common.slices(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "payload"))):
                held.append(row)
                if len(held) >= SHARD_DOCS:
                    yield close()
        if held:
            yield close()

    return run


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", remembered: int = 300_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A worker remembers the ids of up to ``remembered`` distinct word pieces (some 150 bytes each); results don't depend on it.

    Token ids are kept in 16 bits, so the vocabulary may have up to 65,536 entries.
    """
    spark = df.sparkSession
    common.prepare(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = common.workdir(spark)
    rows = common.stash(docs.mapInArrow(_tokenized(tokenizer, end_id, window, remembered), f"kind int, {OUT}, payload binary, place long"), f"{path}/pieces", "kind")
    sums = rows.where("kind = 2").select("doc_id", "start", "length", "payload").groupBy("doc_id").applyInArrow(_summed, "block long, docs long, total long, payload binary").collect()  # 16 rows
    n_docs, total = (sum(r[c] for r in sums) for c in ("docs", "total"))
    counts = np.zeros(1 << 16)
    for r in sums:
        counts[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["payload"], dtype=np.int64)
    model = spark.sparkContext.broadcast((np.log1p((n_docs - counts + 0.5) / (counts + 0.5)), total / max(n_docs, 1)))
    keyed = rows.where("kind = 1").select("doc_id", "start", "doc_tokens", "payload", "place")
    order = [F.col("place"), F.xxhash64("payload"), F.col("doc_id")]
    keyed = keyed.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("place")
    names = [n for n, _ in _PIECES]
    return rows.where("kind = 0").select(*names).unionByName(keyed.mapInArrow(_packed(model, window), OUT))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path(), remembered=1_000_000)


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
