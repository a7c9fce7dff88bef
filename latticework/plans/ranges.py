"""Ranges of a key: rows dealt so that their order by the key is the order of ranges and then of the rows in each.

The bounds are quantiles of the key, so keys in clusters, far outliers and keys
at both ends of the 64-bit range make even ranges; a key that holds more rows
than a cell between two quantiles gets a cell of its own. Each cell is cut
evenly once more, so that the number of ranges grows with the rows while the
driver sees ``CELLS`` bounds whatever the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantiles that the driver asks for, and their precision as a part of the rows.
CELLS, PRECISION = 1024, 20_000
#: Most ranges in a cell.
MOST = 1 << 30


@dataclass
class KeyRanges:
    """``bounds`` of the cells, ascending, the rows of the table, and how many of them each cell has, about."""

    bounds: list[int]
    hot: dict[int, int]
    rows: int
    last: int

    def range_of(self, key: Column, together: int, spread: Column | None = None) -> Column:
        """The number of the key's range, a long, for ranges of ``together`` rows on average; null for a null key.

        Greater keys have no smaller numbers. A key with a cell of its own is cut
        by ``spread``, a number from 0 up to but not including 1, in descending
        order of it; without ``spread`` it stays one range.
        """
        if not self.bounds:
            return F.lit(None).cast("long")
        # Of few rows fewer bounds will do, but for those around keys with many rows.
        step = max(1, len(self.bounds) * together // max(1, self.rows))
        kept = [b for k, b in enumerate(self.bounds) if k % step == 0 or b in self.hot or b - 1 in self.hot]
        n, bounds = len(kept), _longs(kept)
        # The last bound that isn't above the key: its bits from the highest to the lowest.
        steps = [1 << b for b in reversed(range(n.bit_length()))]
        found = F.aggregate(_longs(steps), F.lit(0).cast("long"), lambda at, step: F.when((at + step < n) & (F.get(bounds, (at + step).cast("int")) <= key), at + step).otherwise(at))
        share = max(1, self.rows // n)
        within = max(1, min(MOST, share // together))
        ends = _longs([*kept[1:], self.last])

        def place(at: Column) -> Column:
            lo, hi = (F.get(x, at.cast("int")).cast("double") for x in (bounds, ends))
            # Doubles can't overflow, and rounding keeps their order.
            even = F.floor((key.cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * within)
            if self.hot and spread is not None:
                parts = _longs([max(1, min(MOST, self.hot.get(b, 0) * self.rows // together // CELLS)) for b in kept])
                count = F.get(parts, at.cast("int"))
                own = F.get(bounds, at.cast("int")) == key
                even = F.when(own & (count > 1), count - 1 - F.floor(spread * count)).otherwise(even)
            return at * F.lit(MOST * 2).cast("long") + F.least(F.greatest(even, F.lit(0)), F.lit(MOST)).cast("long")

        return F.when(key.isNotNull(), F.transform(F.array(found), place)[0])


def _longs(values: list[int]) -> Column:
    """A literal array; one literal however many values it has."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def key_ranges(df: DataFrame, key: str) -> KeyRanges:
    """The ranges of a whole-numbered key, by one pass over that column alone."""
    points = [k / CELLS for k in range(CELLS)]
    rows, last, found = df.agg(F.count(F.lit(1)), F.max(key), F.percentile_approx(key, points, PRECISION)).first()
    if last is None:
        return KeyRanges([], {}, rows, 0)
    times: dict[int, int] = {}
    for b in found:
        times[b] = times.get(b, 0) + 1
    hot = {b: n for b, n in times.items() if n > 1}
    # A hot key's cell ends with it; the greatest key of 64 bits has nothing after it.
    after = {b + 1 for b in hot if b < (1 << 63) - 1}
    return KeyRanges(sorted(set(found) | after), hot, rows, last)
