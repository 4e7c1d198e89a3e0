"""Toxicity by a classifier chain.

Categories are predicted in order.  Each link is a linear (logistic) model over hashed words plus the
probabilities that earlier links give; while training, those probabilities are out of fold, so a later link
never sees an earlier one's answer for a row it was fitted on.

The models are fitted on at most ``max_rows`` labelled documents (those with the least hash of id and text), a
documented bound on what the driver holds: a few hundred features a row, 12 bytes each.  Every document is
then scored, over its whole text.

A feature is a word or the start of a longer word, whether it occurs once or often, so a few telling words count
as much in a long text as in a short one.

Null and empty texts have no words and get the models' bias; rows with a null label are not trained on; equal
ids that are labelled several times count several times; without labels, or with one class only, a category's
probability is the share of its positives (0 without labels); repeated rows give repeated results; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 20
FOLDS = 4
MAX_ROWS = 12_000
THRESHOLD = 0.5


class _Slots(dict):
    """Feature slots of words, stripped of ASCII punctuation at their ends."""

    def __init__(self):
        super().__init__()
        common.released()

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word.strip(b".,;:!?\"'()[]{}*#$%&-_")) >> (32 - BITS)
        return value


def features(text: str | None, slots: _Slots) -> np.ndarray:
    """The distinct feature slots of a text, ascending: its words, and the first five bytes of longer ones."""
    words = common.ascii_words(text)
    whole = np.fromiter(map(slots.__getitem__, words), dtype=np.int32, count=len(words))
    starts = {w[:5] for w in words if len(w) > 5}
    return np.unique(np.concatenate([whole, np.fromiter((slots[s + b"~"] for s in starts), dtype=np.int32, count=len(starts))]))


@dataclass
class Link:
    """One linear model: weights of slots, of earlier categories' log-odds, and a bias."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def scores(self, slots: np.ndarray, rows: np.ndarray, n: int, odds: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=self.weights[slots], minlength=n) + odds @ self.earlier + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(slots: np.ndarray, rows: np.ndarray, y: np.ndarray, odds: np.ndarray, steps: int = 150, l2: float = 1e-5, least_chi2: float = 25.0) -> Link:
    """Logistic regression by Adam over the whole sample, in sums over sparse rows.

    Only words whose spread over the two classes is no accident (chi-square) take part, each with the size of
    its log-ratio as value, so rare telling words learn as fast as frequent ones.
    """
    n, share = len(y), float(y.mean()) if len(y) else 0.0
    link = Link(np.zeros(1 << BITS, dtype=np.float32), np.zeros(odds.shape[1]), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if n == 0 or y.min() == y.max():
        return link
    all_df = np.bincount(slots, minlength=1 << BITS).astype(float)
    in_pos = np.bincount(slots, weights=y[rows], minlength=1 << BITS)
    pos, neg, in_neg = y.sum(), n - y.sum(), all_df - in_pos
    chi2 = n * (in_pos * neg - in_neg * pos) ** 2 / np.maximum(pos * neg * all_df * (n - all_df), 1)
    ratio = np.abs(np.log((in_pos + 0.5) / (pos + 0.5)) - np.log((in_neg + 0.5) / (neg + 0.5)))
    used = np.nonzero((chi2 >= least_chi2) & (all_df >= 3))[0]
    number = np.full(1 << BITS, -1, dtype=np.int64)
    number[used] = np.arange(len(used))
    keep = number[slots] >= 0
    at, rows, value = number[slots[keep]], rows[keep], ratio[slots[keep]]
    w = np.zeros(len(used) + odds.shape[1] + 1)
    w[-1] = link.bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=value * w[at], minlength=n) + odds @ w[len(used) : -1] + w[-1]
        error = (_sigmoid(z) - y) / n
        g = np.concatenate([np.bincount(at, weights=value * error[rows], minlength=len(used)) + l2 * w[: len(used)], odds.T @ error + l2 * w[len(used) : -1], [error.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    link.weights[used] = w[: len(used)] * ratio[used]
    link.earlier, link.bias = w[len(used) : -1], float(w[-1])
    return link


def fit_chain(slots: np.ndarray, rows: np.ndarray, labels: np.ndarray, folds: np.ndarray, n_folds: int = FOLDS) -> list[Link]:
    """A link for each column of labels, in order; earlier categories enter as out-of-fold log-odds."""
    n, odds, chain = len(labels), np.zeros((len(labels), 0)), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        chain.append(_fit(slots, rows, y, odds))
        if c + 1 < labels.shape[1]:
            out = np.zeros(n)
            for f in range(n_folds):
                inside, number = folds != f, np.cumsum(folds != f) - 1
                keep = inside[rows]
                link = _fit(slots[keep], number[rows[keep]], y[inside], odds[inside])
                held = ~inside
                number = np.cumsum(held) - 1
                keep = held[rows]
                out[held] = link.scores(slots[keep], number[rows[keep]], int(held.sum()), odds[held])
            odds = np.column_stack([odds, np.clip(out, -8, 8)])
    return chain


def apply_chain(chain: list[Link], slots: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Probabilities (n, categories)."""
    odds = np.zeros((n, 0))
    for link in chain:
        odds = np.column_stack([odds, np.clip(link.scores(slots, rows, n, odds), -8, 8)])
    return _sigmoid(odds)


def _sparse(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(x) for x in found]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int32), np.repeat(np.arange(len(found)), sizes)


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = _Slots()
    for batch in common.slices(batches):
        found = [features(t, slots) for t in batch.column("text").to_pylist()]
        yield batch.drop_columns(["text"]).append_column("slots", pa.array(found, pa.list_(pa.int32())))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> list[Link]:
    """The chain over categories (name to a boolean expression over labels, in chain order)."""
    marked = labels.select(F.col(id_col).alias("doc_id"), *(c.cast("int").alias(f"c{i}") for i, c in enumerate(categories.values()))).dropna()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = [f"c{i}" for i in range(len(categories))]
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id", *marks).limit(max_rows)
    rows = texts.join(F.broadcast(sample), "doc_id")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    schema = f"fold int, {', '.join(f'{c} int' for c in marks)}, slots array<int>"
    got = rows.select("fold", *marks, "text").mapInArrow(_with_features, schema)
    got = got.orderBy(F.xxhash64("slots"), "fold").limit(2 * max_rows).toArrow()  # more only where ids repeat
    lists = got.column("slots").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    slots, of = lists.flatten().to_numpy(), np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()))
    y = np.column_stack([got.column(c).to_numpy() for c in marks]) if got.num_rows else np.zeros((0, len(marks)))
    return fit_chain(slots, of, y, got.column("fold").to_numpy())


def score(docs: DataFrame, chain: list[Link], names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a probability p_<category> of every document."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(chain)  # 4 MB a category, whatever the size of the corpus
    schema = pa.schema([("doc_id", pa.int64()), *((f"p_{n}", pa.float64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in common.slices(batches):
            found, of = _sparse([features(t, slots) for t in batch.column(1).to_pylist()])
            p = apply_chain(model.value, found, of, batch.num_rows)
            yield common.arrow(schema, [batch.column(0), *(p[:, i] for i in range(len(names)))])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, f"doc_id long, {', '.join(f'p_{n} double' for n in names)}")


def categories() -> dict[str, Column]:
    """The chain's order: low quality first, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic of all docs, by a chain fitted on the labelled documents of sf_dir."""
    common.prepare(spark)
    cats = categories()
    chain = train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), cats)
    return score(docs, chain, list(cats)).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the chain does not call toxic."""
    common.prepare(spark)
    model = spark.sparkContext.broadcast(train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), categories()))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in common.slices(batches):
            found, of = _sparse([features(t, slots) for t in batch.column(at).to_pylist()])
            p = apply_chain(model.value, found, of, batch.num_rows)
            yield batch.filter(pa.array(p[:, -1] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, common.table(spark, sf_dir, "documents"), sf_dir)


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
