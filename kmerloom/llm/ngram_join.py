"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the groups that its links form.

Documents are sets of distinct n-word shingles, kept as 64-bit hashes; equal sets are one node (identified by a
64-bit hash of the set), so copies cost nothing further.  Shingles are put in one global order, rarest first, by
a frequency sketch of bounded size (at most 2^24 counters of a byte on a log scale); a coarse estimate costs
time only, never a link.

A set of size n must share ``need = ceil(t n)`` shingles with any partner, so partners share at least l
shingles within their first ``n - need + l``, for each l.  Every document picks the l of least estimated cost
(candidates met, plus candidates left after asking for l matches, which are verified) and emits its prefix, each
shingle with the first l for which it counts; two documents are candidates if they share min(l, l') shingles
that count for min(l, l').  A candidate is also left out if what can still be shared from where it meets its partner
is too little for their sizes.  Candidates are verified on their whole sets.

Only the groups are asked for, so links within a group already found are not needed: each list of a shingle
first gives a star around one member, its pivot, whose distances to the others (sizes of symmetric differences)
are taken on whole sets.  What the verified stars join is one group.  After that only pairs of a list that stand
in different groups matter, and most of these are ruled out by their differences D from the list's pivot P: at
most x of the |D| shingles by which a member differs from P are differences of other members too, so
d(i, j) >= |D_i| + |D_j| - 2 min(x_i, x_j).  With t = (100 - percent) / (100 + percent), i and j link when
d(i, j) <= t (n_i + n_j); so for f = |D| - t n and g = 2 x - f they can only link when f_j <= g_i and f_i <= g_j.
A member that no member of another group can meet by this, or by its size, leaves the list, which takes three
numbers for each list and group.  Of the others, those pairs are met whose differences can overlap enough by
their counts in SLOTS slots.  So near copies that are edited independently, linked or not, cost work nearly in
proportion to their number.  While many pairs remain, other pivots are taken; what is met in the end is verified
on whole sets if it shares enough.

Documents without words have an empty set and no link; null texts count as empty; rows with one id and
different texts are separate rows; a null id takes part and never names a group unless all are null; repeated
rows are repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_L = 6
#: Cost of verifying a candidate, in candidates met.
VERIFY = 30.0
MOST_BITS = 24
#: Bits of the map of shingles that several prefixes have: 16 MB, whatever the size of the corpus.
SEEN_BITS = 27
#: Members of one star that are verified by one task, and members of a list that one task holds.
STAR, LIST = 64, 4096
#: Slots in which differences from a pivot are counted.
SLOTS = 64
#: Rows of a table of ids and hashes up to which it is broadcast (some 30 MB).
SMALL = 500_000
#: Rounds of stars, at most; what they leave is met pair by pair.
ROUNDS = 2
_BLOCK = 1 << 14
_FAR = 1 << 60
I64, I32 = pa.int64(), pa.int32()
_ROWS = pa.schema([("kind", I32), ("doc_id", I64), ("text_hash", I64), ("n", I64), ("node", I64), ("payload", pa.binary())])
_NODES = pa.schema([("node", I64), ("n", I32), ("ell", I32), ("rank", I32), ("tokens", pa.list_(I64))])
NODES = "node long, n int, ell int, rank int, tokens array<long>"
_POSTS = pa.schema([("token", I64), ("node", I64), ("n", I32), ("pos", I32), ("tier", I32), ("ell", I32), ("most", I32), ("rank", I32)])
POSTS = "token long, node long, n int, pos int, tier int, ell int, most int, rank int"
_PAIRS = pa.schema([("a", I64), ("b", I64), ("c", I32), ("need", I32), ("rest", I64), ("total", I64)])
_SHARED = pa.schema([("a", I64), ("b", I64), ("na", I64), ("nb", I64), ("both", I64), ("diff", pa.list_(I64))])
SHARED = "a long, b long, na long, nb long, both long, diff array<long>"


def shingle_set(text: str | None, n: int, hashes: common.WordHashes) -> np.ndarray:
    return np.unique(common.shingle_hashes(common.hashed_words(common.ascii_words(text), hashes), n))


def node_of(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)))


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets, ascending and not empty."""
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _scan(n: int, bits: int):
    """Rows of kind 0: id, hash of the text, set size, node. Of kind 1: blocks of the task's counts by leading bits of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = common.WordHashes(), np.zeros(1 << bits, dtype=np.uint16)
        waiting: list[np.ndarray] = []
        held = 0

        def add() -> None:
            slots, times = np.unique(np.concatenate(waiting) >> np.uint64(64 - bits), return_counts=True)
            counts[slots] = np.minimum(counts[slots].astype(np.int64) + times, 65535)
            waiting.clear()

        for batch in common.slices(batches):
            sizes, nodes = [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, n, hashes)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                waiting.append(s)
                held += len(s)
            if held > 500_000:
                add()
                held = 0
            m = batch.num_rows
            yield common.arrow(_ROWS, [[0] * m, batch.column(0), batch.column(1), sizes, nodes, [None] * m])
        if waiting:
            add()
        for block in range(0, 1 << bits, _BLOCK):
            part = counts[block : block + _BLOCK]
            if part.any():
                yield common.arrow(_ROWS, [[1], [None], [None], [block // _BLOCK], [None], [zlib.compress(part.tobytes(), 1)]])

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    block = 0
    for batch in batches:
        for block, payload in zip(batch.column("n").to_pylist(), batch.column("payload").to_pylist()):
            part = np.frombuffer(zlib.decompress(payload), dtype=np.uint16).astype(np.int64)
            total = part if total is None else total + part
    if total is not None:
        log = np.minimum(np.round(8 * np.log2(total + 1.0)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], I64), pa.array([log.tobytes()], pa.binary())], names=["n", "payload"])


def choose_l(df_first: np.ndarray, base: int, most: int) -> int:
    """The l of least cost: df_first holds the estimated frequencies of the longest prefix, in order."""
    met = np.cumsum(np.maximum(df_first - 1, 0))
    best, least = 1, math.inf
    for ell in range(1, most + 1):
        generated = float(met[base + ell - 2])
        cost = generated + VERIFY * generated / ell**2
        if cost < least:
            best, least = ell, cost
    return best


def _prefixes(n: int, percent: int, bits: int, sketch):
    """Per text its node, set size, l, prefix in order, and how frequent the shingles of the least prefix are in the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, log = common.WordHashes(), sketch.value
        for batch in common.slices(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, n, hashes)
                size = len(s)
                if not size:
                    continue
                need = -(-percent * size // 100)
                base, most = size - need + 1, min(MAX_L, need)
                rank = log[s >> np.uint64(64 - bits)]
                order = np.lexsort((s, rank))[: base + most - 1]
                ell = choose_l(np.exp2(rank[order] / 8.0) - 1, base, most)
                rows.append((node_of(s), size, ell, int(16 * rank[order[:base]].mean()), s[order[: base + ell - 1]].view(np.int64)))
            if rows:
                yield common.arrow(_NODES, list(zip(*rows)))

    return run


def _posts(percent: int, seen):
    """Prefix shingles that other prefixes may have too, each with what can still be shared from it on.

    A shingle that no other prefix has is in no partner that is met at a later shingle of this prefix, for
    what partners share before the shingle at which they meet stands in both prefixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seen.value
        for batch in common.slices(batches, 4096):
            lists = batch.column("tokens")
            ends = lists.offsets.to_numpy()
            tokens = lists.values.to_numpy()[ends[0] : ends[-1]]
            sizes, starts = np.diff(ends), (ends - ends[0])[:-1]
            slot = tokens.view(np.uint64) >> np.uint64(64 - SEEN_BITS)
            alone = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 0
            sums = np.cumsum(alone)
            before = sums[starts] - alone[starts]
            node, n, ell, rank = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "n", "ell", "rank"))
            pos = np.arange(len(tokens)) - np.repeat(starts, sizes)
            most = n - (sums - np.repeat(before, sizes))
            base = np.repeat(sizes, sizes) - ell + 1
            keep = ~alone & (100 * most >= percent * n.astype(np.int64))
            yield common.arrow(_POSTS, [x[keep] for x in (tokens, node, n, pos, np.maximum(pos - base + 2, 1), ell, most, rank)])

    return run


def _lists(batches: Iterator[pa.RecordBatch], key: list[str], columns: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Runs of whole lists (equal keys) of rows that are sorted by key: the first row of each, and the columns."""
    carry: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in key + columns]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols[: len(key)]], axis=0)])
        if last := int(first[-1]):
            yield first[:-1], [c[:last] for c in cols]
        carry = [c[last:] for c in cols]
    if carry is not None:
        yield np.zeros(1, dtype=np.int64), carry


def _counted(differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows' differences from the pivot are known, and their counts by slots."""
    known = np.array([x is not None for x in differ], dtype=bool)
    sizes = np.array([0 if x is None else len(x) for x in differ])
    counts = np.zeros(len(differ) * SLOTS, dtype=np.int32)
    if sizes.any():
        np.add.at(counts, np.repeat(np.arange(len(differ)) * SLOTS, sizes) + np.concatenate([x for x in differ if x is not None]), 1)
    return known, counts.reshape(-1, SLOTS)


def _all_pairs(percent: int, far: list[str]):
    """Pairs of members in different groups: lists where they meet, matches that they need, what can follow, both sizes."""

    def summed(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        a, b, need, rest, total = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((rest, b, a))
        first = np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        at = order[first]
        return common.arrow(_PAIRS, [a[at], b[at], np.diff(np.r_[first, len(order)]), np.minimum.reduceat(need[order], first), rest[at], total[at]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for first, cols in _lists(batches, ["token", "x", "y"], ["own", "node", "n", "pos", "tier", "ell", "most", "grp", *far]):
            _, x, y, own, node, n, pos, tier, ell, most, group = cols[:11]
            rounds = [(f, g, d, *_counted(differ)) for f, g, d, differ in zip(*(cols[11 + k :: 4] for k in range(4)))]
            ends = np.r_[first[1:], len(node)]
            # rows of a list are sorted by n: each row meets those after it, a step of distance at a time
            last = np.repeat(ends, ends - first)
            n = n.astype(np.int64)
            after = n - pos - 1
            upto = most - after
            i = np.arange(len(node))
            step = 1
            while len(i):
                i = i[i + step < last[i]]
                j = i + step
                near = 100 * n[i] >= percent * n[j]
                i, j = i[near], j[near]  # later rows are larger still
                need = np.minimum(ell[i], ell[j])
                ok = (group[i] != group[j]) & ((x[i] == y[i]) | (own[i] != own[j])) 
                for f, g, _, _, _ in rounds:
                    ok &= (f[j] <= g[i]) & (f[i] <= g[j])
                # up to here they share no more than either has of shingles that others have, and then what follows
                both = np.minimum(upto[i], upto[j]) + np.minimum(after[i], after[j])
                ok &= (np.maximum(tier[i], tier[j]) <= need) & ((100 + percent) * both >= percent * (n[i] + n[j]))
                p, q, need = i[ok], j[ok], need[ok]
                for _, _, d, known, counts in rounds:
                    if len(p):
                        common_ = np.minimum(counts[p], counts[q]).sum(axis=1, dtype=np.int64)
                        ok = ~(known[p] & known[q]) | ((100 + percent) * (d[p] + d[q] - 2 * common_) <= (100 - percent) * (n[p] + n[q]))
                        p, q, need = p[ok], q[ok], need[ok]
                if len(p):
                    held.append([np.minimum(node[p], node[q]), np.maximum(node[p], node[q]), need, np.minimum(after[p], after[q]), n[p] + n[q]])
                    rows += len(p)
                    if rows > 200_000:
                        yield summed(held)
                        held, rows = [], 0
                step += 1
        if held:
            yield summed(held)

    return run


def _verify(n: int, diffs: bool):
    """Rows of (a, part) with a's own text first: what a shares with each of the others, and by what they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, a, own = common.WordHashes(), None, None
        for batch in common.slices(batches):
            found: list[tuple] = []
            for x, y, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text"))):
                s = shingle_set(text, n, hashes)
                if x == y:
                    a, own = x, s
                elif a == x:
                    both = in_both(own, s)
                    close = diffs and 3 * both >= len(own) + len(s) - both  # those far off would list nearly all they have
                    found.append((x, y, len(own), len(s), both, np.setxor1d(own, s, assume_unique=True).view(np.int64) if close else None))
            if found:
                yield common.arrow(_SHARED, list(zip(*found)))

    return run


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, grp) of all nodes in links (a, b); grp is the least node that links reach.

    Alternating large and small stars: every pass writes its edges to the shared folder, until they stay.
    """
    spark = links.sparkSession
    edges = common.stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{path}/0")
    seen, i = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        i += 1
        edges = common.stash(small.where("u <> v").distinct(), f"{path}/{i}")
        common.remove(spark, f"{path}/{i - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("grp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("grp")).distinct())


class _Join:
    def __init__(self, df: DataFrame, n: int, percent: int, id_col: str, text_col: str):
        self.spark, self.n, self.percent = df.sparkSession, n, percent
        self.docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
        self.path = common.workdir(self.spark)
        self.round = 0

    def scan(self) -> None:
        """Members (every row with its node), nodes' representatives, and the posts."""
        common.prepare(self.spark)
        chars = self.docs.agg(F.sum(F.length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(16, math.ceil(math.log2(chars / 50 + 1))))
        schema = "kind int, doc_id long, text_hash long, n long, node long, payload binary"
        rows = common.stash(self.docs.mapInArrow(_scan(self.n, bits), schema), f"{self.path}/scan", "kind")
        self.members = rows.where("kind = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node")
        blocks = rows.where("kind = 1").select("n", "payload").groupBy("n").applyInArrow(_sum_blocks_group, "n long, payload binary")
        log = np.zeros(1 << bits, dtype=np.uint8)
        for row in blocks.toLocalIterator():  # at most 2^24 bytes in all
            log[row["n"] * _BLOCK : (row["n"] + 1) * _BLOCK] = np.frombuffer(row["payload"], dtype=np.uint8)
        sketch = self.spark.sparkContext.broadcast(log)
        # a node's id is the least of its rows' ids; its text is that of the least row that has one
        self.reps = self.members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_hash")).alias("row"))
        prefixes = self.docs.select("text").mapInArrow(_prefixes(self.n, self.percent, bits, sketch), NODES)
        nodes = common.stash(prefixes.dropDuplicates(["node"]), f"{self.path}/nodes")
        shared = nodes.select(F.explode("tokens").alias("token"), "node").groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
        shared = common.stash(shared.where("lo <> hi").select("token"), f"{self.path}/shared")
        slot = F.shiftrightunsigned("token", 64 - SEEN_BITS) + 1
        maps = shared.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        seen = np.zeros(1 << (SEEN_BITS - 3), dtype=np.uint8)
        for row in maps.toLocalIterator():  # 2^27 bits in all
            seen[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
        seen = self.spark.sparkContext.broadcast(seen)
        posts = nodes.mapInArrow(_posts(self.percent, seen), POSTS).join(shared, "token", "left_semi")
        self.posts = common.stash(posts.withColumn("grp", F.col("node")), f"{self.path}/posts-0")
        for held in (sketch, seen):
            held.unpersist()
        common.remove(self.spark, f"{self.path}/nodes", f"{self.path}/shared")

    def shared(self, pairs: DataFrame, diffs: bool) -> DataFrame:
        """(a, b, na, nb, both, diff) of pairs (a, b): set sizes, what they share and by what they differ, on whole texts."""
        self.round += 1
        path = f"{self.path}/verify-{self.round}"
        per = pairs.groupBy("a").agg(F.count("*").alias("c"))
        pairs = pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("c") / STAR))).cast("int").alias("part"))
        pairs = common.stash(pairs, f"{path}/pairs")
        legs = pairs.select(F.col("b").alias("node"), "a", "part").unionByName(pairs.select(F.col("a").alias("node"), "a", "part").distinct())
        legs = common.stash(legs.join(self.reps.select("node", "row.*"), "node"), f"{path}/legs")
        small = legs.count() <= SMALL  # beyond, both sides are shuffled
        wanted = F.broadcast(legs) if small else legs
        texts = self.docs.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
        rows = texts.join(wanted, (texts["h"] == wanted["text_hash"]) & texts["d"].eqNullSafe(wanted["doc_id"])).select("a", "part", F.col("node").alias("b"), "text")
        if self.repeated():
            rows = rows.dropDuplicates(["a", "part", "b"])
        rows = rows.repartition(common.shuffle_partitions(self.spark), "a", "part")
        rows = rows.sortWithinPartitions("a", "part", F.col("a") != F.col("b")).select("a", "b", "text")
        found = common.stash(rows.mapInArrow(_verify(self.n, diffs), SHARED), f"{path}/shared")
        common.remove(self.spark, f"{path}/pairs", f"{path}/legs")
        return found

    def repeated(self) -> bool:
        """Whether some row stands several times, so that a node's text may be met more than once."""
        if not hasattr(self, "_repeated"):
            self._repeated = bool(self.members.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count())
        return self._repeated

    def pivots(self) -> DataFrame:
        """For each list a pivot outside of the last one's group, if there is one; of these that whose least prefix
        is most frequent, for a text that others are edits of has no rare shingles of its own."""
        order = F.struct(*["near"] * bool(self.round), (-F.col("rank")).alias("rank"), F.xxhash64("node").alias("o"), F.col("node").alias("pivot"))
        return self.posts.groupBy("token").agg(F.min(order).alias("p")).select("token", "p.pivot")

    def active(self, at: DataFrame) -> DataFrame:
        """The rows of lists that may link to a row of another group in their list.

        For each list the least f, least n and largest g of a group, and the best and second best of all groups.
        """
        at = at.withColumns({"f": F.col(f"f{self.round}"), "g": F.col(f"g{self.round}")})
        own = at.groupBy("token", "grp").agg(F.min("f").alias("f"), F.min("n").cast("long").alias("n"), F.max("g").alias("g"))
        best = [F.min(F.struct("f", "grp")).alias("_f1"), F.min(F.struct("n", "grp")).alias("_n1"), F.max(F.struct("g", "grp")).alias("_g1")]
        first = own.groupBy("token").agg(F.count("*").alias("groups"), *best).where("groups > 1")
        first = first.select("token", *(F.col(f"_{k}1.{c}").alias(f"_{k}1{c}") for k in "fng" for c in (k, "grp")))
        second = {k: F.when(F.col("grp") != F.col(f"_{k}1grp"), F.col(k)) for k in "fng"}
        second = own.join(first, "token").groupBy("token").agg(F.min(second["f"]).alias("_f2"), F.min(second["n"]).alias("_n2"), F.max(second["g"]).alias("_g2"))
        other = {k: F.when(F.col("grp") == F.col(f"_{k}1grp"), F.col(f"_{k}2")).otherwise(F.col(f"_{k}1{k}")) for k in "fng"}
        meets = (other["f"] <= F.col("g")) & (F.col("f") <= other["g"]) & (self.percent * (F.col("n") + other["n"]) <= (100 + self.percent) * F.col("most").cast("long"))
        return at.join(first.join(second, "token"), "token").where(meets).select(at.drop("f", "g").columns)

    def left(self) -> int:
        """Pairs of members of different groups that stand in one list, over all lists."""
        per = self.posts.groupBy("token", "grp").agg(F.count("*").alias("c"))
        return per.groupBy("token").agg(((F.sum("c") ** 2 - F.sum(F.col("c") ** 2)) / 2).alias("p")).agg(F.sum("p")).first()[0] or 0

    def differences(self, shared: DataFrame) -> DataFrame:
        """(pivot, node, d, x, o) of those that are not far apart: their distance d, how many of the differences other
        such members of the star have too, and the slots of these."""
        one = shared.where("diff is not null").select("a", "b", F.explode("diff").alias("token"))
        several = one.groupBy("a", "token").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").select("a", "token")
        others = one.join(several, ["a", "token"], "left_semi").groupBy("a", "b").agg(F.collect_list(F.pmod(F.xxhash64("token"), F.lit(SLOTS)).cast("int")).alias("o"))
        out = shared.where("diff is not null").join(others, ["a", "b"], "left")
        o = F.coalesce("o", F.array().cast("array<int>"))
        return out.select(F.col("a").alias("pivot"), F.col("b").alias("node"), (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("d"), F.size(o).cast("long").alias("x"), o.alias("o"))

    def stars(self, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Lists' rows with their pivots, and (a, b, na, nb, both) of pivots with the members that they meet often enough."""
        at = common.stash(self.posts.join(self.pivots(), "token"), f"{self.path}/at-{self.round}")
        base = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1
        pairs = at.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), base.alias("base"))
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("base").alias("base")).where("4 * c >= base or c >= 6").select("a", "b")
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = self.shared(pairs, True)
        return at, found if known is None else known.unionByName(found)

    def pairs(self) -> DataFrame:
        """Every pair of different groups that shares as many prefix shingles as it must.

        Lists of more than LIST rows are split into blocks, and each pair of blocks is a task's.
        """
        per = self.posts.groupBy("token").agg(F.ceil(F.count("*") / LIST).cast("int").alias("k"))
        at = self.posts.join(per, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        at = at.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("x", F.least("own", "with")).withColumn("y", F.greatest("own", "with"))
        at = at.repartition(common.shuffle_partitions(self.spark), "token", "x", "y").sortWithinPartitions("token", "x", "y", "n", "node")
        far = [f"{c}{r}" for r in range(1, self.round + 1) for c in "fgdo"]
        met = at.select("token", "x", "y", "own", "node", "n", "pos", "tier", "ell", "most", "grp", *far).mapInArrow(_all_pairs(self.percent, far), "a long, b long, c int, need int, rest long, total long")
        met = met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("need").alias("need"), F.min("rest").alias("rest"), F.first("total").alias("total"))
        # what they share is at most their matches and what follows the last of these in both
        return met.where("c >= need").where((100 + self.percent) * (F.col("c") + F.col("rest")) >= self.percent * F.col("total")).select("a", "b")

    def linked(self, shared: DataFrame) -> DataFrame:
        return shared.where((100 + self.percent) * F.col("both") >= self.percent * (F.col("na") + F.col("nb"))).select("a", "b")

    def grouped(self, shared: DataFrame, name: str) -> DataFrame:
        groups = common.stash(components(self.linked(shared), f"{self.path}/cc-{name}"), f"{self.path}/groups-{name}")
        common.remove(self.spark, f"{self.path}/cc-{name}")
        return groups

    def run(self) -> DataFrame:
        self.scan()
        shared, bound = None, 4 * self.posts.count()
        while True:
            at, shared = self.stars(shared)
            groups = self.grouped(shared, str(self.round))
            t, u = 100 - self.percent, 100 + self.percent
            far, k = common.stash(self.differences(shared), f"{self.path}/far-{self.round}"), self.round
            at = at.drop("grp", "near").join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
            own = groups.select(F.col("node").alias("pivot"), F.col("grp").alias("pivot_grp"))
            at = at.join(own, "pivot", "left").withColumn("near", (F.col("grp") == F.coalesce("pivot_grp", "pivot")).cast("int"))
            at = at.join(far.drop("o"), ["pivot", "node"], "left").withColumns({c: F.when(F.col("pivot") == F.col("node"), 0).otherwise(F.col(c)) for c in "dx"})
            f, alone = u * F.col("d") - t * F.col("n"), F.col("n") - F.col("most")
            g = 2 * u * F.least("x", F.greatest(F.col("d") - alone, F.lit(0))) - f
            at = at.withColumns({f"f{k}": F.coalesce(f, F.lit(-_FAR)), f"g{k}": F.coalesce(g, F.lit(_FAR)), f"d{k}": F.coalesce("d", F.lit(0))}).drop("d", "x", "pivot_grp")
            at = self.active(common.stash(at, f"{self.path}/marked-{k}"))
            at = at.join(far.select("pivot", "node", F.col("o").alias(f"o{k}")), ["pivot", "node"], "left").drop("pivot")
            self.posts = common.stash(at, f"{self.path}/posts-{k}")
            common.remove(self.spark, *(f"{self.path}/{x}-{self.round - 1}" for x in ("at", "posts")), f"{self.path}/marked-{k}", f"{self.path}/far-{k}")
            if self.round == ROUNDS or self.left() <= bound:
                break
        met = shared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = common.stash(self.pairs().join(met, ["a", "b"], "left_anti"), f"{self.path}/pairs")
        shared = shared.unionByName(self.shared(rest, False))
        groups = self.grouped(shared, "all")
        labelled = groups.join(self.reps, "node")
        named = labelled.groupBy("grp").agg(F.min("rep").alias("component_id"))
        named = groups.join(named, "grp").select("node", "component_id")
        own = self.reps.join(named, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
        out = self.members.join(own, "node", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _sum_blocks_group(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_sum_blocks(iter(table.to_batches()))))


def near_groups(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id that links reach) of every row."""
    return _Join(df, n, percent, id_col, text_col).run()


def one_of_each(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, without the documents that link to one of a lesser id.

    Of repeated rows one stays; a row without id stays; an id stays if any of its texts does.
    """
    groups = near_groups(df, n, percent, id_col, text_col)
    groups = common.stash(groups, f"{common.workdir(df.sparkSession)}/groups")
    gone = groups.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("rows"))
    repeated = bool(gone.where("rows > 1 and doc_id is not null").limit(1).count())
    gone = gone.where("stays = 0").select(F.col("doc_id").alias(id_col))
    small = gone.count() <= 1_000_000  # 8 MB; beyond, both sides are shuffled
    kept = df.join(F.broadcast(gone) if small else gone, id_col, "left_anti").select(*df.columns)
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents"), n=3, percent=90)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS ss FROM w
), e AS (SELECT doc_id, unnest(ss) AS x FROM s),
df AS (SELECT x, count(*) AS c FROM e GROUP BY x HAVING count(*) > 1),
size AS (SELECT doc_id, len(ss) AS n FROM s),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM (SELECT e.* FROM e JOIN df USING (x)) a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM met JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)
), sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS v, doc_id AS r FROM size UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.v AND reach.r < sym.b)
SELECT size.doc_id, CAST(n AS BIGINT) AS n_shingles, min(r) AS component_id FROM size JOIN reach ON reach.v = size.doc_id GROUP BY size.doc_id, n
"""

QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLE_SQL = {"op10_ngram_join": OP10_SQL}
