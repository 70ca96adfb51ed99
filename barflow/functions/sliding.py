"""Order statistics of a sliding window, kept sorted: a row costs two places in a short list, not a sort."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque


class Sorted:
    """The last ``size`` rows' values in order; rows without a value take a place but hold none."""

    def __init__(self, size: int):
        self.rows: deque = deque()
        self.size, self.values = size, []

    def push(self, x: float | None) -> None:
        self.rows.append(x)
        if x is not None:
            insort(self.values, x)
        if len(self.rows) > self.size and (old := self.rows.popleft()) is not None:
            del self.values[bisect_left(self.values, old)]

    def median(self) -> float:
        v, n = self.values, len(self.values)
        return (v[(n - 1) // 2] + v[n // 2]) / 2

    def _distance(self, m: float, k: int) -> float:
        """The k-th least distance from ``m``, counted from 0: the nearest k + 1 values lie side by side."""
        v, low, high = self.values, 0, len(self.values) - k - 1
        while low < high:
            mid = (low + high) // 2
            if m - v[mid] > v[mid + k + 1] - m:
                low = mid + 1
            else:
                high = mid
        return max(m - v[low], v[low + k] - m)

    def deviation(self, m: float) -> float:
        """The median distance from ``m``."""
        n = len(self.values)
        middle = self._distance(m, n // 2)
        return middle if n % 2 else (self._distance(m, n // 2 - 1) + middle) / 2
