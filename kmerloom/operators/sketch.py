"""Sketches: the k-mers of sequences whose hash is at most a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import hashing
from kmerloom.session import ship

CHUNK = 1 << 22
SCHEMA = "owner long, tpos int, r int, h long, strand boolean"
_ARROW = pa.schema([("owner", pa.int64()), ("tpos", pa.int32()), ("r", pa.int32()), ("h", pa.int64()), ("strand", pa.bool_())])
_BASES = np.frombuffer(b"ACGT", dtype=np.uint8)


def text_bases(text: str) -> np.ndarray:
    """A text as bases: each code point by its value modulo 4."""
    return _BASES[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") % 4]


def sequence_bases(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)


def sketch_array(seq: np.ndarray, k: int, h_frac: float, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, hashes, strands) of the kept k-mers; a long sequence is read in chunks that overlap by k - 1."""
    most = np.uint64(hashing.threshold(h_frac))
    rs, hs, ss = [], [], []
    for at in range(0, max(len(seq) - k + 1, 0), chunk):
        h, strand = hashing.kmer_hashes(seq[at : at + chunk + k - 1], k, at)
        keep = np.flatnonzero(h <= most)
        rs.append(keep + at + k - 1)
        hs.append(h[keep])
        ss.append(strand[keep])
    if not rs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    return np.concatenate(rs), np.concatenate(hs), np.concatenate(ss)


def sketch(df: DataFrame, owner: str, seq: str, k: int, h_frac: float, text: bool = False) -> DataFrame:
    """One row per kept k-mer: owner, tpos (its number in the sketch), r (place of its last base), h, strand.

    With ``text`` the sequence is any text, read as bases by code point; else characters other than ACGT (either
    case) count as no base. A null or short sequence has no rows.
    """
    ship(df.sparkSession)
    as_bases = text_bases if text else sequence_bases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, parts = [], []
            for o, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s:
                    part = sketch_array(as_bases(s), k, h_frac)
                    parts.append((np.arange(len(part[0])), *part))
                    owners.append(np.full(len(part[0]), o, dtype=np.int64))
            if parts:
                tpos, r, h, strand = (np.concatenate(x) for x in zip(*parts))
                cols = [np.concatenate(owners), tpos.astype(np.int32), r.astype(np.int32), h.view(np.int64), strand]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    return df.select(F.col(owner).cast("long"), F.col(seq)).mapInArrow(run, SCHEMA)


def sketch_sql(df: DataFrame, owner: str, seq: str, k: int, h_frac: float) -> DataFrame:
    """The same from expressions only: bases as rows and running XORs. For short sequences."""
    bases = df.select(F.col(owner).cast("long").alias("owner"), F.posexplode(F.split(F.col(seq), "")).alias("r", "base")).where("base <> ''")
    hashed = hashing.with_hashes(bases, "owner", "r", "base", k)
    most = hashing.threshold(h_frac)
    kept = hashed.where(hashing.unsigned(F.col("h")) <= F.lit(most - 2**63).cast("long"))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("owner").orderBy("r")) - 1
    return kept.select("owner", number.cast("int").alias("tpos"), F.col("r").cast("int").alias("r"), "h", "strand")
