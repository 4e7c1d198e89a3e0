"""Benchmark decontamination with SimHash windows.

Words are lower-cased runs of letters and digits; shingles are five words (an item with fewer is one shingle).
For every benchmark item a document is read in windows of the item's size, at every word.  A window's 64-bit
SimHash is the sign of its summed shingle bits, repeats counting as often as they stand.  Fingerprints are
looked up by multi-index blocks: of 4 blocks of 16 bits at least one differs in at most RADIUS // 4 bits when the
whole differs in at most RADIUS, so bucket lists of the items by all values near their blocks hold every item within
the radius.  Those of the window's size that are within it are verified by the exact weighted similarity of their
shingles: sum of least counts over sum of largest, at least ``threshold``.  A similarity of 0.8 means an angle of 27
degrees, so 9.7 differing bits in the mean and more than RADIUS in some three cases of a hundred; equal windows differ in none.

Windows that share no shingle with an item have similarity 0 to it; where a text shares none with any item of a
size, no windows of that size are fingerprinted.  The benchmark is a query set: up to PASS * ITEMS items are met in one
pass over the documents, whose words are hashed once in it; a larger benchmark takes several passes.

Every item is its own row: null and equal ids, and equal texts, give a result each.  Null and empty texts and items
without words match nothing; repeated rows give repeated results; a document shorter than the window is one window;
empty tables give no rows; other columns are ignored (find) or kept (clean).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, THRESHOLD, RADIUS = 5, 0.8, 15
#: Items of one index (17 kB of bucket lists each) and indexes that are broadcast for one pass.
ITEMS, PASS = 2048, 4
BLOCKS, BITS = 4, 16
U64 = np.uint64
_WORD = re.compile(r"[^\W_]+")
_BITS = np.arange(64, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text.lower())] if text else []


def bits_of(h: np.ndarray) -> np.ndarray:
    """Shingles by bits, as +1 and -1."""
    return (((h[:, None] >> _BITS) & U64(1)).astype(np.int32) << 1) - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int32)


class Items:
    """Some benchmark items with their shingles, fingerprints and bucket lists by blocks of these."""

    def __init__(self, rows: list[tuple[int | None, str | None]], words: int = WORDS, radius: int = RADIUS):
        hashes = common.WordHashes()
        self.radius = radius
        self.ids, self.counts = [], []
        prints, self.group, groups = [], [], {}
        by_n: dict[int, tuple[list, list]] = {}
        for item_id, text in rows:
            w = common.hashed_words(words_of(text), hashes)
            if not len(w):
                continue
            n = min(words, len(w))
            h = common.shingle_hashes(w, n)
            self.ids.append(item_id)
            self.counts.append(np.unique(h, return_counts=True))
            self.group.append(groups.setdefault((n, len(h)), len(groups)))
            prints.append(bits_of(h).sum(axis=0))
            tokens, sizes = by_n.setdefault(n, ([], []))
            tokens.append(self.counts[-1][0])
            sizes.append(np.full(len(tokens[-1]), len(h)))
        self.groups = groups  # by words in a shingle and shingles in a window
        self.group = np.array(self.group, dtype=np.int64)
        self.prints = simhash(np.array(prints)) if prints else np.zeros(0, dtype=U64)
        every = np.arange(1 << BITS, dtype=np.uint64)
        near = every[popcount(every) <= radius // BLOCKS]
        self.buckets = []
        for b in range(BLOCKS):
            values = ((self.block(self.prints, b)[:, None]) ^ near).ravel().astype(np.int64)
            order = np.argsort(values, kind="stable")
            first = np.searchsorted(values[order], np.arange((1 << BITS) + 1)).astype(np.int32)
            self.buckets.append((first, (order // len(near)).astype(np.int32)))
        self.by_n = {}
        for n, (tokens, sizes) in by_n.items():
            tokens, sizes = np.concatenate(tokens), np.concatenate(sizes)
            order = np.lexsort((sizes, tokens))
            tokens, sizes = tokens[order], sizes[order]
            new = np.r_[True, (tokens[1:] != tokens[:-1]) | (sizes[1:] != sizes[:-1])]
            quick = np.zeros(1 << 20, dtype=bool)
            quick[(tokens >> U64(44)).astype(np.int64)] = True
            self.by_n[n] = {"tokens": tokens[new], "sizes": sizes[new], "quick": quick}

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> U64(BITS * b)) & U64((1 << BITS) - 1)

    def candidates(self, group: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of a group within the radius, from the bucket lists of the windows' blocks."""
        found = []
        for b, (first, items) in enumerate(self.buckets):
            v = self.block(prints, b).astype(np.int64)
            lo, sizes = first[v], first[v + 1] - first[v]
            window = np.repeat(np.arange(len(prints)), sizes)
            item = items[np.arange(len(window)) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)]
            own = self.group[item] == group
            window, item = window[own], item[own]
            own = popcount(prints[window] ^ self.prints[item]) <= self.radius
            found.append(item[own].astype(np.int64) * len(prints) + window[own])
        both = np.unique(np.concatenate(found))
        return both % len(prints), both // len(prints)


def find_in(words: np.ndarray, items: Items, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int]]:
    """(item, similarity, first word, words) of the best window of each item that the text holds."""
    out: list[tuple[int, float, int, int]] = []
    for n, own in items.by_n.items():
        if len(words) < n:
            continue
        h = common.shingle_hashes(words, n)
        maybe = np.flatnonzero(own["quick"][(h >> U64(44)).astype(np.int64)])
        if not len(maybe):
            continue
        lo = np.searchsorted(own["tokens"], h[maybe], side="left")
        hi = np.searchsorted(own["tokens"], h[maybe], side="right")
        maybe, lo, hi = maybe[hi > lo], lo[hi > lo], hi[hi > lo]
        for size in {int(s) for a, b in zip(lo, hi) for s in own["sizes"][a:b]}:
            width = min(size, len(h))
            at = maybe[[size in own["sizes"][a:b] for a, b in zip(lo, hi)]]
            starts = np.unique(np.clip((at[:, None] - np.arange(width)).ravel(), 0, len(h) - width))
            # runs of neighbouring starts share their sums
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
                first, last = int(run[0]), int(run[-1]) + width
                part, rel = h[first:last], run - first
                sums = np.zeros((len(part) + 1, 64), dtype=np.int32)
                np.cumsum(bits_of(part), axis=0, out=sums[1:])
                windows, met = items.candidates(items.groups[n, size], simhash(sums[rel + width] - sums[rel]))
                for j in np.unique(met).tolist():
                    unique, count = items.counts[j]
                    at_item = np.minimum(np.searchsorted(unique, part), len(unique) - 1)
                    seen = np.zeros((len(part) + 1, len(unique)), dtype=np.int32)
                    same = unique[at_item] == part
                    seen[1:][np.flatnonzero(same), at_item[same]] = 1
                    seen = np.cumsum(seen, axis=0)
                    starts_j = rel[windows[met == j]]
                    both = np.minimum(seen[starts_j + width] - seen[starts_j], count).sum(axis=1)
                    similarity = both / (width + size - both)
                    k = int(np.argmax(similarity))
                    if similarity[k] >= threshold:
                        out.append((j, float(similarity[k]), first + int(starts_j[k]), width + n - 1))
    best: dict = {}
    for x in out:
        if x[0] not in best or (-x[1], x[2]) < (-best[x[0]][1], best[x[0]][2]):
            best[x[0]] = x
    return [(items.ids[j], *x) for j, *x in best.values()]


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def passes_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[Items]]:
    """The items in indexes of at most some ITEMS, PASS of them at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    blocks = max(1, -(-rows.count() // ITEMS))
    held: list[Items] = []
    for b in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        found = [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").toLocalIterator()]
        held += [Items(found[i : i + ITEMS]) for i in range(0, max(len(found), 1), ITEMS)]
        while len(held) >= PASS or held and b + 1 == blocks:
            yield held[:PASS]
            held = held[PASS:]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of the best window of each item in each document."""
    spark = docs.sparkSession
    common.prepare(spark)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def searched(indexes: list[Items]) -> DataFrame:
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = common.WordHashes()
            for batch in common.slices(batches):
                words = [common.hashed_words(words_of(t), hashes) for t in batch.column(1).to_pylist()]
                rows = [(d, *x) for d, w in zip(batch.column(0).to_pylist(), words) for items in shared.value for x in find_in(w, items, threshold)]
                if rows:
                    yield common.arrow(_ARROW, list(zip(*rows)))

        return cols.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, map(searched, passes_of(benchmark, item_col, item_text_col)))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no benchmark item."""
    spark = docs.sparkSession
    common.prepare(spark)
    at = docs.columns.index(text_col)
    for indexes in passes_of(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes = common.WordHashes()
            for batch in common.slices(batches):
                words = [common.hashed_words(words_of(t), hashes) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([not any(find_in(w, items, threshold) for items in shared.value) for w in words], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLE_SQL: dict[str, str] = {}
