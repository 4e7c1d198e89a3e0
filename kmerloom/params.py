"""Options of the mapper, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

METRICS = ("Containment", "Jaccard", "bucket_SH", "bucket_LCS")


@dataclass(frozen=True)
class Params:
    k: int = 15  # bases in a k-mer
    h_frac: float = 0.05  # share of hashes that a sketch keeps
    max_matches: int = -1  # k-mers with more hits are left out of the index; -1: none
    theta: float = 0.9  # least score
    min_diff: float = 0.02  # least lead over the second best for a confident mapping
    max_overlap: float = 0.5  # mappings that overlap the best as much are no second best
    metric: str = "Containment"
    no_pruning: bool = False
    one_sweep: bool = False
    absolute_positions: bool = False
    rarity_weight: float = 0.0
    rarity_alpha: float = 0.0
    rarity_tiebreak: float = 0.0
    sample: int = 0  # every n-th read for the statistics of reads; 0: none
    min_sketch: int = 5  # reads with a smaller bucket half length are not mapped

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.k >= 1, "k must be at least 1")
        need(0 < self.h_frac <= 1, "h_frac must be in (0, 1]")
        need(self.max_matches == -1 or self.max_matches >= 1, "max_matches must be positive")
        need(0 <= self.theta <= 1, "theta must be in [0, 1]")
        need(0 <= self.min_diff <= 1, "min_diff must be in [0, 1]")
        need(0 <= self.max_overlap <= 1, "max_overlap must be in [0, 1]")
        need(self.metric in METRICS, f"metric must be one of {METRICS}")
        need(min(self.rarity_weight, self.rarity_alpha, self.rarity_tiebreak) >= 0, "rarity options must not be negative")
        need(not self.rarity_weight or self.metric == "Containment", "rarity_weight works with Containment only")
        need(self.sample >= 0, "sample must not be negative")

    @property
    def theta2(self) -> float:
        return self.theta - self.min_diff

    @property
    def alpha(self) -> float:
        return self.rarity_alpha or self.rarity_weight or (1.0 if self.rarity_tiebreak else 0.0)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def to_tsv(self) -> str:
        d = asdict(self)
        return "\t".join(d) + "\n" + "\t".join(map(str, d.values())) + "\n"
