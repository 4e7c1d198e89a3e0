"""The rolling k-mer hash: a XOR of rotated base constants over a window, on columns and on arrays.

Rotation is linear over XOR, so the hash of every window follows from one running XOR of constants rotated by
their place, rotated back by the window's place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The hash constants of the bases.
BASE = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}
U64 = np.uint64


def threshold(h_frac: float) -> int:
    """The largest hash that is kept (unsigned, inclusive)."""
    return min(int(h_frac * 2.0**64), 2**64 - 1) if h_frac < 1 else 2**64 - 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    forward, reverse = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.uint64)
    for base, value in BASE.items():
        for c in (base, base.lower()):
            forward[ord(c)] = value
            reverse[ord(c)] = BASE[COMPLEMENT[base]]
    return forward, reverse


FORWARD, REVERSE = _tables()


def rotl(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = n.astype(np.uint64) & U64(63)
    return (x << n) | (x >> ((U64(64) - n) & U64(63)))


def kmer_hashes(seq: np.ndarray, k: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, strands) of all windows of k bytes; ``first`` is the place of seq[0] in its sequence."""
    n = len(seq)
    if k < 1 or n < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    place = np.arange(first, first + n, dtype=np.int64)
    run_f = np.bitwise_xor.accumulate(rotl(FORWARD[seq], -place))
    run_r = np.bitwise_xor.accumulate(rotl(REVERSE[seq], place))

    def windows(run: np.ndarray) -> np.ndarray:
        out = run[k - 1 :].copy()
        out[1:] ^= run[: n - k]
        return out

    forward = rotl(windows(run_f), place[k - 1 :])
    reverse = rotl(windows(run_r), -(place[k - 1 :] - (k - 1)))
    return forward ^ reverse, forward > reverse


def rotl_col(x: Column, n: Column) -> Column:
    """Rotation of a 64-bit column by n bits, n taken modulo 64."""
    n = F.pmod(n, F.lit(64)).cast("int")
    left = F.call_function("shiftleft", x, n)
    return F.when(n == 0, x).otherwise(left.bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(64) - n)))


def base_col(c: Column, reverse: bool = False) -> Column:
    """The constant of a base, or of its complement; 0 for anything else."""
    out = F.lit(0).cast("long")
    for base, value in BASE.items():
        value = BASE[COMPLEMENT[base]] if reverse else value
        out = F.when(F.upper(c) == base, F.lit(value - (1 << 64) if value >> 63 else value).cast("long")).otherwise(out)
    return out


def unsigned(h: Column) -> Column:
    """A key whose signed order is the unsigned order of h."""
    return h.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def with_hashes(bases, owner: str, place: str, base: str, k: int):
    """A table of bases (owner, place, base) with h and strand of the window that ends at each place.

    The relational form of kmer_hashes: two running XORs over a frame of k rows.
    """
    frame = Window.partitionBy(owner).orderBy(place).rowsBetween(-(k - 1), 0)
    p = F.col(place)
    forward = rotl_col(F.bit_xor(rotl_col(base_col(F.col(base)), -p)).over(frame), p)
    reverse = rotl_col(F.bit_xor(rotl_col(base_col(F.col(base), True), p)).over(frame), -(p - (k - 1)))
    out = bases.withColumn("_f", forward).withColumn("_r", reverse).withColumn("_n", F.count("*").over(frame))
    out = out.where(F.col("_n") == k)
    return out.withColumn("h", F.col("_f").bitwiseXOR(F.col("_r"))).withColumn("strand", unsigned(F.col("_f")) > unsigned(F.col("_r"))).drop("_f", "_r", "_n")
