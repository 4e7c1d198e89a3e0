"""Token ids in a binary file format: Simple-8b words with escapes and per-block offsets.

A 64-bit word holds a selector in its top four bits and as many ids as fit its width in the other sixty.
Ids are coded in blocks of ``BLOCK``; each block lists its number of ids, where its words begin and where its
escapes begin, so blocks decode independently and with array operations.  An id that needs more than 60 bits
is coded as 0 and listed with its place as an escape.

A shard is one self-contained byte string::

    magic 'S8BW' | u32 blocks | u64 ids | u64 words | u64 escapes
    | u32 ids per block | u64 first word per block | u64 first escape per block
    | u64 words | u32 escape places in their block | u64 escaped ids          (all little-endian)

Shards are rows of a Parquet dataset in the shared folder (so writing is atomic per task, works on any file
system that Spark can write, and survives lost executors), next to the ids and lengths of their documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import ByteTokens, shared

#: Fixed values of the code: (ids in a word, bits of each) by selector.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 4096
U64 = np.uint64
_COUNTS = np.array([c for c, _ in SELECTORS], dtype=np.int64)
_HEAD = struct.Struct("<4sIQQQ")


def encode(ids: np.ndarray) -> bytes:
    """A shard of the ids (any unsigned 64-bit values)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, BLOCK), dtype=np.uint64)
    grid.reshape(-1)[:n] = ids
    sizes = np.full(blocks, BLOCK, dtype=np.int64)
    if blocks:
        sizes[-1] = n - (blocks - 1) * BLOCK
    over = grid >> U64(60) != 0 if n and int(ids.max()) >> 60 else np.zeros(grid.shape, dtype=bool)
    esc_block, esc_at = np.nonzero(over)
    esc_values = grid[over]
    grid[over] = 0
    # best[b, i]: the selector with most ids that can start at place i; beyond a block's end anything fits
    best = np.full((blocks, BLOCK), 15, dtype=np.int8)
    most = int(grid.max()) if n else 0
    light = grid.astype(np.uint32) if most < 1 << 32 else grid
    small = np.ones((blocks, BLOCK + SELECTORS[0][0]), dtype=bool)
    for s in range(14, -1, -1):  # more and more ids in a word
        count, bits = SELECTORS[s]
        if most >> bits:
            np.less(light, 1 << bits, out=small[:, :BLOCK])
            if n:
                small[-1, sizes[-1] :] = True
            fits, width = small, 1
            while width < count:  # all of the next ``width`` ids are small
                step = min(width, count - width)
                fits = fits[:, :-step] & fits[:, step:]
                width += step
            np.copyto(best, s, where=fits[:, :BLOCK])
        else:
            best[:] = s
    # walk all blocks in step, a word of each at a time
    at, rows, found = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    live = rows
    while len(live):
        here = at[live]
        sel = best[live, here]
        found.append((live, here, sel))
        at[live] = here + _COUNTS[sel]
        live = live[at[live] < sizes[live]]
    if found:
        blk, pos, sel = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(blk, kind="stable")  # within a block the walk is in order
        blk, pos, sel = blk[order], pos[order], sel[order]
    else:
        blk = pos = sel = np.zeros(0, dtype=np.int64)
    words = sel.astype(np.uint64) << U64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        if bits and len(mine := np.nonzero(sel == s)[0]):
            cols = pos[mine][:, None] + np.arange(count)
            values = np.where(cols < BLOCK, grid[blk[mine][:, None], np.minimum(cols, BLOCK - 1)], U64(0))
            words[mine] |= np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * U64(bits)), axis=1)
    starts = np.searchsorted(blk, rows)
    esc_starts = np.searchsorted(esc_block, rows)
    parts = (sizes.astype("<u4"), starts.astype("<u8"), esc_starts.astype("<u8"), words.astype("<u8"), esc_at.astype("<u4"), esc_values.astype("<u8"))
    return _HEAD.pack(b"S8BW", blocks, n, len(words), len(esc_values)) + b"".join(p.tobytes() for p in parts)


def decode(shard: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive) of a shard."""
    magic, blocks, _, n_words, n_esc = _HEAD.unpack_from(shard)
    if magic != b"S8BW":
        raise ValueError("not a Simple-8b shard")
    at = _HEAD.size
    fields = []
    for kind, count in (("<u4", blocks), ("<u8", blocks), ("<u8", blocks), ("<u8", n_words), ("<u4", n_esc), ("<u8", n_esc)):
        fields.append(np.frombuffer(shard, dtype=kind, count=count, offset=at))
        at += fields[-1].nbytes
    sizes, starts, esc_starts, words, esc_at, esc_values = fields
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, dtype=np.uint64)
    w0, w1 = int(starts[first]), int(starts[last]) if last < blocks else n_words
    e0, e1 = int(esc_starts[first]), int(esc_starts[last]) if last < blocks else n_esc
    words = words[w0:w1]
    sel = (words >> U64(60)).astype(np.int64)
    ends = np.cumsum(_COUNTS[sel])
    begins = ends - _COUNTS[sel]
    out = np.zeros(int(ends[-1]), dtype=np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        if bits and len(mine := np.nonzero(sel == s)[0]):
            shifts = np.arange(count, dtype=np.uint64) * U64(bits)
            out[begins[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shifts) & U64((1 << bits) - 1)
    # padding stands only after the last id of a block
    own = sizes[first:last].astype(np.int64)
    from_ = begins[starts[first:last].astype(np.int64) - w0]
    goes = np.cumsum(own) - own
    ids = out[np.arange(int(own.sum())) + np.repeat(from_ - goes, own)]
    if e1 > e0:
        of = np.searchsorted(esc_starts[first:last], np.arange(e0, e1), side="right") - 1
        ids[goes[of] + esc_at[e0:e1]] = esc_values[e0:e1]
    return ids


_SHARDS = "part int, shard int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
_SHARDS_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 500_000) -> DataFrame:
    """Encode all texts in ascending order of id and write the shards; returns the dataset.

    A shard closes at the document with which it reaches shard_ids, so memory is bounded by that and the
    longest document.  Ties of the id are ordered by the hash of the text, null ids come first, null texts are
    empty (they still have the end id), repeated rows are repeated, an empty table gives an empty dataset.
    """
    spark = df.sparkSession
    common.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared(ByteTokens, tokenizer)
        context = TaskContext.get()
        part, shard = context.partitionId() if context else 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            return common.arrow(_SHARDS_ARROW, [[part], [shard], [sum(lengths)], [names], [lengths], [encode(np.concatenate(ids))]])

        for batch in common.slices(batches, 512):
            texts = batch.column(1).to_pylist()
            for doc_id, own in zip(batch.column(0).to_pylist(), tokens.ids_of(texts)):
                ids.append(np.append(own, end_id).astype(np.uint32))
                names.append(doc_id)
                lengths.append(len(ids[-1]))
                held += lengths[-1]
                if held >= shard_ids:
                    yield close()
                    shard += 1
                    ids, names, lengths, held = [], [], [], 0
        if ids:
            yield close()

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    docs = docs.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    return common.stash(docs.mapInArrow(run, _SHARDS), path)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the shards: id, number of ids before it, number of ids, their CRC-32."""
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before = per_part.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = shards.select("part", "shard", within.alias("within")).join(before, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 4):
            for start, names, lengths, payload in zip(*(batch.column(c).to_pylist() for c in range(4))):
                ids = decode(payload).astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths)]
                yield common.arrow(_DOCS_ARROW, [names, start + ends - lengths, lengths, crcs])

    return shards.join(starts, ["part", "shard"]).select("start", "doc_ids", "lengths", "payload").mapInArrow(run, _DOCS)


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{common.workdir(spark)}/ids"
    return read_shards(write_shards(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2))


QUERIES = {"op1_token_file": op1_token_file}
ORACLE_SQL: dict[str, str] = {}
