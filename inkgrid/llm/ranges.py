"""Ranges of ids for partitions whose cuts the driver knows.

Spark's range partitioner samples the rows that it deals, so texts would be encoded twice; these cuts
come from the id column alone. A row finds its partition by binary search. An id that fills
several ranges is split among them by ``tie``, a 64-bit hash, and order by (id, tie) still holds
across partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ranges:
    """Ascending cuts, repeated where one id fills several ranges."""

    cuts: np.ndarray

    @classmethod
    def of(cls, keys: DataFrame, parts: int) -> Ranges:
        """About equal ranges of the one non-null long column ``key``; the driver gets one number a range."""
        probs = [i / parts for i in range(1, parts)]
        found = keys.select(F.percentile_approx("key", probs, max(20_000, 2 * parts))).first()[0] if probs else None
        return cls(np.sort(np.array(found or [], np.int64)))

    @property
    def parts(self) -> int:
        return len(self.cuts) + 1

    @property
    def splits_ids(self) -> bool:
        """Whether some id fills more than one range, so that places need the tie."""
        return bool((self.cuts[1:] == self.cuts[:-1]).any())

    def place(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        first = np.searchsorted(self.cuts, keys, side="left")
        room = np.maximum(np.searchsorted(self.cuts, keys, side="right") - first, 1)
        share = (ties.astype(np.float64) + 2.0**63) / 2.0**64
        return (first + np.minimum((share * room).astype(np.int64), room - 1)).astype(np.int32)
