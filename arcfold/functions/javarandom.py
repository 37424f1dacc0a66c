"""The public linear congruential generator of java.util.Random, for factors that start as the reference's do."""

from __future__ import annotations

import numpy as np

MASK = (1 << 48) - 1


class JavaRandom:
    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & MASK

    def next_float(self) -> np.float32:
        self.state = (self.state * 0x5DEECE66D + 0xB) & MASK
        return np.float32((self.state >> 24) / (1 << 24))
