"""A bitmap of fixed size as a filter ahead of a shuffle.

It holds every given 64-bit id and, by chance, some others, so it only ever saves rows that an exact join
would drop later. It is filled in tasks; the driver and the tasks see at most ``BITS / 8`` bytes of it,
however many ids there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

BITS = 1 << 26


class Bitmap:
    def __init__(self, ids: DataFrame):
        (name,) = ids.columns
        bit = f"pmod({name}, {BITS})"
        words = ids.selectExpr(f"shiftright({bit}, 5) as w", f"shiftleft(1L, int({bit} % 32)) as m").where(
            "w is not null").groupBy("w").agg({"m": "bit_or"}).toArrow()
        self.words = np.zeros(BITS // 32, dtype=np.uint32)
        self.words[words.column(0).to_numpy()] = words.column(1).to_numpy()

    def holds(self, ids: np.ndarray) -> np.ndarray:
        """Whether each of the ids, 64-bit integers of either sign, may be held."""
        bit = ids.view(np.uint64) % np.uint64(BITS)
        return (self.words[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32) & 1).astype(bool)
