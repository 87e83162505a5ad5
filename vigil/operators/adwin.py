"""ADWIN: an adaptive window over one series, in memory that grows with the logarithm of its length.

Written from the published description (Bifet & Gavaldà, 2007).  The window is kept as an
exponential histogram: row ``i`` has at most ``ROW`` buckets of ``2 ** i`` values each, newest
first, with their sum and their sum of squared deviations; a row that is full merges its two
oldest buckets into the next row.  Every ``clock`` values the window is tested at every border
between buckets: it is cut where the means of both sides differ by

    sqrt(2 v ln(2 / d') / m) + 2 ln(2 / d') / (3 m),   d' = delta / ln(n),

m the harmonic mean of the sides' lengths and v the variance of the window; the oldest
buckets go until no border is left that differs.
"""

from __future__ import annotations

import json
import math

ROW = 5
CLOCK = 32
GRACE = 10
LEAST_SIDE = 5
DELTA = 0.002


class Adwin:
    """``add`` values one at a time; ``dumps``/``loads`` carry the state over restarts."""

    def __init__(self, delta: float = DELTA, clock: int = CLOCK):
        self.delta, self.clock = delta, clock
        self.rows: list[list[tuple[float, float]]] = []   # rows[i]: (sum, squared deviations) of buckets of 2 ** i values, newest first
        self.seen = self.width = self.changes = 0
        self.last_change = -1                             # number of the value (from 0) at which a change was last seen

    def dumps(self) -> str:
        return json.dumps([self.delta, self.clock, self.rows, self.seen, self.width, self.changes, self.last_change])

    @classmethod
    def loads(cls, text: str) -> Adwin:
        delta, clock, rows, *rest = json.loads(text)
        out = cls(delta, clock)
        out.rows = [[tuple(b) for b in row] for row in rows]
        out.seen, out.width, out.changes, out.last_change = rest
        return out

    def _push(self, level: int, bucket: tuple[float, float]) -> None:
        if level == len(self.rows):
            self.rows.append([])
        row = self.rows[level]
        row.insert(0, bucket)
        if len(row) > ROW:
            (s1, d1), (s0, d0) = row.pop(), row.pop()
            n = 2 ** level
            self._push(level + 1, (s0 + s1, d0 + d1 + (s0 - s1) ** 2 / (2 * n)))

    def _oldest_first(self) -> list[tuple[int, float, float]]:
        return [(2 ** i, s, d) for i in range(len(self.rows) - 1, -1, -1) for s, d in reversed(self.rows[i])]

    def _drop_oldest(self) -> None:
        self.rows[-1].pop()
        self.width -= 2 ** (len(self.rows) - 1)
        while self.rows and not self.rows[-1]:
            self.rows.pop()

    def mean(self) -> float:
        return sum(s for row in self.rows for s, _ in row) / self.width if self.width else 0.0

    def _cut_found(self) -> bool:
        n, buckets = self.width, self._oldest_first()
        total = sum(s for _, s, _ in buckets)
        mean = total / n
        spread = sum(d + k * (s / k - mean) ** 2 for k, s, d in buckets) / n
        log = math.log(2.0 * math.log(n) / self.delta)
        n0 = s0 = 0
        for k, s, _ in buckets:
            n0, s0 = n0 + k, s0 + s
            n1 = n - n0
            if n1 < LEAST_SIDE:
                return False
            if n0 >= LEAST_SIDE:
                m = 1.0 / (1.0 / n0 + 1.0 / n1)
                if abs(s0 / n0 - (total - s0) / n1) >= math.sqrt(2.0 * spread * log / m) + 2.0 * log / (3.0 * m):
                    return True
        return False

    def add(self, value: float) -> bool:
        """Takes the next value; True if the window was cut."""
        self._push(0, (float(value), 0.0))
        self.seen += 1
        self.width += 1
        changed = False
        if self.seen >= GRACE and self.seen % self.clock == 0:
            while self.width >= 2 * LEAST_SIDE and self._cut_found():
                self._drop_oldest()
                changed = True
        if changed:
            self.changes += 1
            self.last_change = self.seen - 1
        return changed
