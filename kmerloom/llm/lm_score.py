"""Language-model scoring with a hierarchical Pitman-Yor model over words.

Every word that precedes another is a context restaurant; all context restaurants share one parent, the
restaurant of single words, whose base is uniform over the V training words and one unknown word.  A
restaurant's customers are the tokens of the training documents that follow its word; each table that it opens
sends one customer to the parent.  Seating is drawn by Gibbs sweeps: all customers of a dish are taken up and
seated anew given the other tables of the restaurant and the parent's probability of the dish.  Only the number
of tables per dish enters predictions, so that number is what is drawn: exactly, from its full conditional
(generalised Stirling numbers), for dishes of up to ``EXACT`` customers; beyond, customers are seated in turn
in leaps of five per cent.  Predictive probabilities average the tables of the sweeps after burn-in.

Distribution: documents are read in chunks of bounded size.  A chunk sends its distinct word pairs to parts by
context (contexts with a large share of all tokens are split further by following word), the parts count in how many
contexts each word stands over all of them, a part seats the restaurants that it got given these shares and answers each chunk with the pairs' counts and tables; single words go the same way
once the tables are known.  Nothing but sums of a few numbers and the frequent contexts (at most four times the
number of parts) reaches the driver.  Words are 64-bit hashes; within restaurants 48 bits of them.

A chunk is what a scan task reads in order; the last stage reads the same chunks again and fails loudly if
one differs from that which sent the pairs.

Null texts are empty (just the end token), a null id counts as empty text for the split into training and
held-out, repeated rows give repeated results, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK_TOKENS = 3_000_000
EXACT = 32
SWEEPS, BURN_IN = 6, 3
#: Discount and strength of the word restaurant and of the context restaurants.
D1, THETA1 = 0.7, 1.0
D2, THETA2 = 0.85, 1.0
U64, LOW48 = np.uint64, np.uint64((1 << 48) - 1)
I64, BIN = pa.int64(), pa.binary()
#: The end token, which no text can hold.
END = b" "


class _Local(dict):
    """Words of a chunk to numbers in order of appearance; the end token is 0."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


@dataclass
class Chunk:
    number: int
    doc_ids: list
    held: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    vocab: np.ndarray

    def contexts(self) -> np.ndarray:
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[:1] = 0
        return before  # every document ends with the end token, which is the context of the next one's first

    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 24
    local, parts, ids, held, n = _Local({END: 0}), [], [], [], 0

    def close() -> Chunk:
        vocab = np.fromiter((common.xxhash.xxh64_intdigest(w) for w in local), dtype=np.uint64, count=len(local))
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        return Chunk(number, ids, np.array(held), sizes, np.concatenate(parts), vocab)

    for batch in common.slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = common.ascii_words(text)
            words.append(END)
            parts.append(np.fromiter(map(local.__getitem__, words), dtype=np.int32, count=len(words)))
            ids.append(doc_id)
            held.append(is_held_out(doc_id))
            n += len(words)
            if n >= CHUNK_TOKENS:
                yield close()
                number += 1
                local, parts, ids, held, n = _Local({END: 0}), [], [], [], 0
    if ids:
        yield close()


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _pack(*arrays: bytes) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], dtype="<u4").tobytes(), *arrays])


def _unpack(b: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(b, dtype="<u4", count=n)
    ends = 4 * n + np.cumsum(sizes)
    return [b[int(e - s) : int(e)] for s, e in zip(sizes, ends)]


def _z(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(x.astype(kind).tobytes(), 1)


def _unz(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=kind)


@dataclass
class Pairs:
    """A chunk's distinct pairs, by part, context and word."""

    u: np.ndarray  # local numbers
    w: np.ndarray
    count: np.ndarray  # in training documents
    part: np.ndarray
    of_token: np.ndarray  # place of each token's pair in these


def pairs_of(chunk: Chunk, parts: int, hot: dict[int, int]) -> Pairs:
    size = len(chunk.vocab)
    codes = chunk.contexts().astype(np.int64) * size + chunk.tokens
    distinct, inverse = np.unique(codes, return_inverse=True)
    count = np.bincount(inverse[chunk.trained()], minlength=len(distinct))
    u, w = distinct // size, distinct % size
    key = chunk.vocab & LOW48
    by_u = common.mix(key)
    part = by_u[u] % U64(parts)
    split = np.array([hot.get(int(k), 0) for k in key.tolist()], dtype=np.uint64) if hot else np.zeros(size, dtype=np.uint64)
    many = split[u] > 1
    part[many] = (by_u[u[many]] + common.mix(key[w[many]] ^ U64(0x5BD1E995)) % split[u[many]]) % U64(parts)
    order = np.lexsort((key[w], key[u], part))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return Pairs(u[order], w[order], count[order], part[order].astype(np.int64), place[inverse])


def _slices(p: Pairs, chunk: Chunk) -> Iterator[tuple[int, slice, np.ndarray]]:
    """(part, its pairs, starts of its contexts within them)."""
    starts = np.flatnonzero(np.r_[True, p.part[1:] != p.part[:-1]]) if len(p.part) else []
    for a, b in zip(starts, [*starts[1:], len(p.part)]):
        own = slice(int(a), int(b))
        yield int(p.part[a]), own, np.flatnonzero(np.r_[True, p.u[own][1:] != p.u[own][:-1]])


_SENT = pa.schema([("part", pa.int32()), ("chunk", I64), ("payload", BIN)])
SENT = "part int, chunk long, payload binary"


def _heavy(parts: int):
    """Words with at least a share of 1 / 2 parts of a chunk's tokens; the sum of all as word -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", I64), ("c", I64)])
        counts: Counter = Counter()
        n = 0

        def close() -> pa.RecordBatch:
            found = [(int(np.int64(U64(common.xxhash.xxh64_intdigest(w)) & LOW48)), c) for w, c in counts.items() if 2 * parts * c >= n]
            return common.arrow(schema, list(zip(*[*found, (-1, n)])))

        for batch in common.slices(batches):
            for text in batch.column(0).to_pylist():
                words = common.ascii_words(text)
                counts.update(words)
                counts[END] += 1
                n += len(words) + 1
                if n >= CHUNK_TOKENS:
                    yield close()
                    counts, n = Counter(), 0
        if n:
            yield close()

    return run


def _send_pairs(parts: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            p, key, rows = pairs_of(chunk, parts, hot.value), chunk.vocab & LOW48, []
            for part, own, first in _slices(p, chunk):
                runs = np.diff(np.r_[first, own.stop - own.start])
                rows.append((part, chunk.number, _pack(_six(key[p.u[own][first]]), _z(runs, "<u4"), _six(key[p.w[own]]), _z(p.count[own], "<u4"))))
            yield common.arrow(_SENT, list(zip(*rows)))

    return run


def _word_parts(chunk: Chunk, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, local numbers of its words)."""
    part = common.mix(chunk.vocab & LOW48) % U64(parts)
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    for a, b in zip(starts, [*starts[1:], len(order)]):
        yield int(part[order[a]]), order[a:b]


def _send_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            count = np.bincount(chunk.tokens[chunk.trained()], minlength=len(chunk.vocab))
            rows = [(part, chunk.number, _pack(chunk.vocab[own].astype("<u8").tobytes(), _z(count[own], "<u4"))) for part, own in _word_parts(chunk, parts)]
            yield common.arrow(_SENT, list(zip(*rows)))

    return run


def log_stirling(most: int, d: float) -> np.ndarray:
    """log S_d(c, t): weights of seating c customers at t tables (c, t from 1)."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    with np.errstate(invalid="ignore", divide="ignore"):
        for c in range(1, most):
            t = np.arange(1, c + 2)
            s[c + 1, t] = np.logaddexp(s[c, t - 1], np.log(np.maximum(c - d * t, 0)) + s[c, t])
    return s


_STIRLING: dict[float, np.ndarray] = {}


def seat(c: np.ndarray, others: np.ndarray, p: np.ndarray, theta: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers, given the other tables of their restaurants and parent's probability."""
    if d not in _STIRLING:
        _STIRLING[d] = log_stirling(EXACT, d)
    t = np.ones(len(c))
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    for part in np.array_split(few, max(1, len(few) // 50_000)):
        j = np.arange(EXACT)
        weights = np.cumsum(np.log(theta + d * (others[part, None] + j)), axis=1) + (j + 1) * np.log(p[part, None]) + _STIRLING[d][c[part].astype(np.int64), 1:]
        t[part] = 1 + np.argmax(weights + rng.gumbel(size=weights.shape), axis=1)
    many = np.flatnonzero(c > EXACT)
    at = np.ones(len(many))
    live = np.arange(len(many))
    while len(live):
        i = many[live]
        to = np.minimum(c[i], np.floor(at[live] * 1.05) + 1)
        a = (theta + d * (others[i] + t[i])) * p[i]
        mean = (to - at[live]) * a / (a + np.maximum((to + at[live] - 1) / 2 - d * t[i], 1e-9))
        t[i] += np.minimum(rng.poisson(mean), to - at[live])
        at[live] = to
        live = live[to < c[i]]
    return t


_MADE = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", I64), ("payload", BIN), ("a", pa.float64()), ("b", pa.float64()), ("c", I64), ("d", I64)])
MADE = "kind int, part int, chunk long, payload binary, a double, b double, c long, d long"


_TOLD = pa.schema([("part", pa.int32()), ("chunk", I64), ("payload", BIN), ("c", I64)])
TOLD = "part int, chunk long, payload binary, c long"


def tell_words(table: pa.Table, parts: int) -> pa.Table:
    """For each part of the words: in how many contexts of this part (as chunk) each of its words was trained, and
    the number of this part's trained pairs."""
    number = table.column("part")[0].as_py()
    us, ws = [], []
    for b in table.column("payload").to_pylist():
        u, runs, w, c = _unpack(b, 4)
        trained = _unz(c, "<u4") > 0
        us.append(np.repeat(_from_six(u), _unz(runs, "<u4"))[trained])
        ws.append(_from_six(w)[trained])
    words, w = np.unique(np.concatenate(ws), return_inverse=True)
    _, u = np.unique(np.concatenate(us), return_inverse=True)
    cells = np.sort(w << 32 | u)
    cells = cells[np.r_[True, cells[1:] != cells[:-1]]] if len(cells) else cells
    seen = np.bincount(cells >> 32, minlength=len(words))
    to = common.mix(words) % U64(parts)
    rows = [(part, number, _pack(_six(words[own]), _z(seen[own], "<u4")), len(cells)) for part in range(parts) for own in [to == U64(part)]]
    return pa.Table.from_batches([common.arrow(_TOLD, list(zip(*rows)))])


def answer_words(table: pa.Table) -> pa.Table:
    """To every part that told of words: in how many contexts of all parts each of them was trained, and all pairs."""
    cells = sum(table.column("c").to_pylist())
    told = [(part, *_unpack(b, 2)) for part, b in zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist())]
    words, inverse = np.unique(np.concatenate([_from_six(w) for _, w, _ in told]), return_inverse=True)
    seen = np.bincount(inverse, weights=np.concatenate([_unz(c, "<u4") for _, _, c in told]), minlength=len(words)).astype(np.int64)
    rows, at = [], 0
    for part, w, _ in told:
        own = inverse[at : at + len(w) // 6]
        at += len(own)
        rows.append((part, -1, _pack(w, _z(seen[own], "<u4")), cells))
    return pa.Table.from_batches([common.arrow(_TOLD, list(zip(*rows)))])


def seat_pairs(table: pa.Table, answers: pa.Table, parts: int, hot: dict[int, int]) -> pa.Table:
    """Kind 0: for each chunk the tables of its contexts and the mass of shared pairs; 1: words' lost customers.

    The answers hold in how many contexts of all parts words were trained, and the number of all trained pairs.
    """
    number = table.column("part")[0].as_py()
    order = np.argsort(table.column("chunk").to_numpy())
    names = table.column("chunk").to_numpy()[order].tolist()
    sent = []
    for i in order:
        u, runs, w, c = _unpack(table.column("payload")[int(i)].as_py(), 4)
        u, runs = _from_six(u), _unz(runs, "<u4").astype(np.int64)
        sent.append((u, runs, np.repeat(u, runs), _from_six(w), _unz(c, "<u4").astype(np.int64)))
    u_all, w_all, c_all = (np.concatenate([s[k] for s in sent]) for k in (2, 3, 4))
    order = np.lexsort((w_all, u_all))
    us, ws = u_all[order], w_all[order]
    new_u = np.r_[True, us[1:] != us[:-1]]
    new = new_u | np.r_[True, ws[1:] != ws[:-1]]
    first = np.flatnonzero(new)
    count = np.add.reduceat(c_all[order], first)
    cell_of = np.empty(len(order), dtype=np.int64)
    cell_of[order] = np.cumsum(new) - 1
    cu, cw = us[first], ws[first]
    context = np.cumsum(new_u[first]) - 1
    context_u = cu[np.r_[True, cu[1:] != cu[:-1]]]
    shards = np.array([hot.get(int(k), 1) for k in context_u.tolist()], dtype=np.float64) if hot else np.ones(len(context_u))
    live = count > 0
    # the parent's first probability: in how many contexts of all parts a word was seen
    p = np.full(len(cw), 1.0)
    if live.any():
        parted = [_unpack(b, 2) for b in answers.column("payload").to_pylist()]
        told, seen = np.concatenate([_from_six(w) for w, _ in parted]), np.concatenate([_unz(c, "<u4") for _, c in parted])
        by_word = np.argsort(told)
        p[live] = seen[by_word][np.searchsorted(told[by_word], cw[live])] / answers.column("c")[0].as_py()
    t = live.astype(np.float64)
    again = np.flatnonzero(count > 1)
    rng = np.random.default_rng([number, 4])
    t_mean, tables_mean, kept = np.zeros(len(t)), np.zeros(len(context_u)), 0
    for sweep in range(SWEEPS):
        tables = np.bincount(context, weights=t, minlength=len(context_u)) * shards
        t[again] = seat(count[again], tables[context[again]] - t[again], p[again], THETA2, D2, rng)
        if sweep >= BURN_IN:
            kept += 1
            t_mean += t
            tables_mean += np.bincount(context, weights=t, minlength=len(context_u)) * shards
    t_mean /= kept
    tables_mean /= kept
    mass = count - D2 * t_mean
    rows = []
    at = 0
    for name, (u, runs, _, _, c) in zip(names, sent):
        cells = cell_of[at : at + len(c)]
        at += len(c)
        known = np.flatnonzero((count[cells] > 0) & ((count[cells] != c) | (c > 1)))
        starts = np.cumsum(runs) - runs
        gaps = np.diff(np.r_[0, known])
        body = _pack(_z(tables_mean[context[cells[starts]]], "<f4"), _z(gaps, "<u4"), _z(mass[cells[known]], "<f4"))
        rows.append((0, number, name, body, None, None, None, None))
    lost = (count - t)[again].astype(np.int64)
    gone, inverse = np.unique(cw[again], return_inverse=True)
    by_word = np.bincount(inverse, weights=lost, minlength=len(gone)).astype(np.int64)
    keep = by_word > 0
    gone, by_word = gone[keep], by_word[keep]
    to = common.mix(gone) % U64(parts)
    for part in np.unique(to).tolist():
        own = to == U64(part)
        rows.append((1, part, -1, _pack(_six(gone[own]), _z(by_word[own], "<u4")), None, None, None, None))
    return pa.Table.from_batches([common.arrow(_MADE, list(zip(*rows)))])


def seat_words(table: pa.Table) -> pa.Table:
    """Kind 2: for each chunk its words' training counts and masses; 3: sums over this part's words."""
    number = table.column("part")[0].as_py()
    sent, lost_w, lost_c = [], [], []
    order = np.argsort(table.column("chunk").to_numpy(), kind="stable")
    for i in order:
        chunk, a, b = table.column("chunk")[int(i)].as_py(), *_unpack(table.column("payload")[int(i)].as_py(), 2)
        if chunk < 0:
            lost_w.append(_from_six(a))
            lost_c.append(_unz(b, "<u4").astype(np.int64))
        else:
            sent.append((chunk, np.frombuffer(a, dtype="<u8"), _unz(b, "<u4").astype(np.int64)))
    if not sent:
        return pa.Table.from_batches([common.arrow(_MADE, [[]] * len(_MADE))])
    words, inverse = np.unique(np.concatenate([s[1] for s in sent]), return_inverse=True)
    count = np.bincount(inverse, weights=np.concatenate([s[2] for s in sent]), minlength=len(words)).astype(np.int64)
    key = words & LOW48
    by_key = np.argsort(key)
    lost = np.zeros(len(words), dtype=np.int64)
    if lost_w:
        at = np.minimum(np.searchsorted(key[by_key], np.concatenate(lost_w)), len(words) - 1)
        np.add.at(lost, by_key[at], np.concatenate(lost_c))
    customers = np.maximum(count - lost, count > 0).astype(np.float64)
    live = customers > 0
    v = int(live.sum())
    t = live.astype(np.float64)
    again = np.flatnonzero(customers > 1)
    rng = np.random.default_rng([number, 5])
    mean, kept = np.zeros(len(t)), 0
    for sweep in range(SWEEPS):
        t[again] = seat(customers[again], t.sum() - t[again], np.full(len(again), 1.0 / (v + 1)), THETA1, D1, rng)
        if sweep >= BURN_IN:
            kept += 1
            mean += t
    mean /= kept
    mass = customers - D1 * mean
    rows, at = [], 0
    for chunk, own, _ in sent:
        cells = inverse[at : at + len(own)]
        at += len(own)
        rows.append((2, number, chunk, _pack(_z(count[cells], "<u4"), _z(np.where(live[cells], mass[cells], 0), "<f4")), None, None, None, None))
    rows.append((3, number, -1, None, float(customers.sum()), float(mean.sum()), int(count.sum()), v))
    return pa.Table.from_batches([common.arrow(_MADE, list(zip(*rows)))])


_READ = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", I64), ("payload", BIN), ("doc_ids", pa.list_(I64)), ("sizes", pa.list_(I64)), ("vocab", BIN)])
READ = "kind int, part int, chunk long, payload binary, doc_ids array<long>, sizes array<long>, vocab binary"


def _send_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        yield common.arrow(_READ, [[9], [0], [chunk.number], [_z(chunk.tokens, "<i4")], [chunk.doc_ids], [chunk.sizes], [chunk.vocab.tobytes()]])


_SCORES = pa.schema([("doc_id", I64), ("held_out", pa.bool_()), ("n_tokens", I64), ("n_known", I64), ("train_tokens", I64), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(table: pa.Table, parts: int, hot: dict[int, int], customers: float, tables: float, n: int, v: int) -> pa.Table:
    rows = {(k, p): i for i, (k, p) in enumerate(zip(table.column("kind").to_pylist(), table.column("part").to_pylist()))}
    own = rows[9, 0]
    ids = table.column("doc_ids")[own].as_py()
    held = np.array([is_held_out(x) for x in ids])
    chunk = Chunk(table.column("chunk")[own].as_py(), ids, held, np.array(table.column("sizes")[own].as_py()), _unz(table.column("payload")[own].as_py(), "<i4"), np.frombuffer(table.column("vocab")[own].as_py(), dtype=np.uint64))
    size = len(chunk.vocab)
    count, mass1 = np.zeros(size, dtype=np.int64), np.zeros(size)
    for part, mine in _word_parts(chunk, parts):
        c, m = _unpack(table.column("payload")[rows[2, part]].as_py(), 2)
        count[mine], mass1[mine] = _unz(c, "<u4"), _unz(m, "<f4")
    p1 = (mass1 + (THETA1 + D1 * tables) / (v + 1)) / (THETA1 + customers)
    p = pairs_of(chunk, parts, hot)
    mass = np.where(p.count > 0, 1 - D2, 0.0)  # what is not answered was met once, here
    opened, heard = np.zeros(size), np.zeros(size)
    for part, mine, first in _slices(p, chunk):
        t, gaps, m = _unpack(table.column("payload")[rows[0, part]].as_py(), 3)
        t = _unz(t, "<f4")
        if len(t) != len(first):
            raise RuntimeError(f"chunk {chunk.number} is not the one that sent its pairs")
        opened[p.u[mine][first]] += t
        heard[p.u[mine][first]] += 1
        mass[mine.start + np.cumsum(_unz(gaps, "<u4").astype(np.int64))] = _unz(m, "<f4")
    opened /= np.maximum(heard, 1)
    u, w = p.u, p.w
    probability = (mass + (THETA2 + D2 * opened[u]) * p1[w]) / (THETA2 + count[u])
    firsts = np.cumsum(chunk.sizes) - chunk.sizes
    score = np.add.reduceat(np.log10(probability)[p.of_token], firsts)
    base = np.add.reduceat(np.log10((count + 0.5) / (n + 0.5 * (v + 1)))[chunk.tokens], firsts)
    known = np.add.reduceat((count > 0)[chunk.tokens].astype(np.int64), firsts)
    return pa.Table.from_batches([common.arrow(_SCORES, [ids, held, chunk.sizes, known, [n] * len(ids), base, score, 10 ** (-score / chunk.sizes)])])


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the log10 probability of its text, a unigram base and counts."""
    spark = df.sparkSession
    common.prepare(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = common.shuffle_partitions(spark)
    path = common.workdir(spark)
    heavy = docs.select("text").mapInArrow(_heavy(parts), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))
    heavy = common.stash(heavy, f"{path}/heavy")
    total = heavy.where("word = -1").agg(F.sum("c")).first()[0] or 0
    frequent = heavy.where((F.col("word") >= 0) & (F.col("c") * 4 * parts >= total)).collect()  # 4 x parts at most
    hot = {r["word"]: min(parts, math.ceil(4 * parts * r["c"] / max(total, 1))) for r in frequent}
    shared = spark.sparkContext.broadcast(hot)
    pairs = docs.mapInArrow(_send_pairs(parts, shared), SENT)
    told = pairs.groupBy("part").applyInArrow(lambda t: tell_words(t, parts), TOLD)
    shares = told.groupBy("part").applyInArrow(answer_words, TOLD)
    seats = pairs.groupBy("part").cogroup(shares.groupBy("part"))  # both read one exchange of the pairs
    made = common.stash(seats.applyInArrow(lambda t, u: seat_pairs(t, u, parts, shared.value), MADE), f"{path}/pairs", "kind")
    words = docs.mapInArrow(_send_words(parts), SENT).unionByName(made.where("kind = 1").select("part", "chunk", "payload"))
    seated = common.stash(words.groupBy("part").applyInArrow(seat_words, MADE), f"{path}/words", "kind")
    customers, tables, n, v = seated.where("kind = 3").agg(F.sum("a"), F.sum("b"), F.sum("c"), F.sum("d")).first()
    if n is None:
        return spark.createDataFrame([], SCORES)
    answers = made.where("kind = 0").unionByName(seated.where("kind = 2")).select("kind", "part", "chunk", "payload")
    read = docs.mapInArrow(_send_tokens, READ).unionByName(answers, allowMissingColumns=True)
    return read.groupBy("chunk").applyInArrow(lambda t: _score(t, parts, shared.value, customers, tables, n, v), SCORES)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_lm_score": op4_lm_score}
ORACLE_SQL: dict[str, str] = {}
