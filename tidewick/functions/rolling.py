"""Column helpers over the bars of a symbol, in the order of their dates.

Windows count rows, not days, and a rolling value is null until its window is full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("d")


def back(column: str | Column, n: int = 1) -> Column:
    return F.lag(column, n).over(by_symbol())


def ahead(column: str | Column, n: int = 1) -> Column:
    return F.lead(column, n).over(by_symbol())


def roll(f: Callable[[Column], Column], column: str | Column, n: int, end: int = 0) -> Column:
    """f over the n rows that end `end` rows before this one (0: with this one); null unless n values are there."""
    column = F.col(column) if isinstance(column, str) else column
    frame = by_symbol().rowsBetween(-(n - 1) - end, -end)
    return F.when(F.count(column).over(frame) == n, f(column).over(frame))


#: What a pass over a symbol can make of a window: how two of its values become one.
_MERGED = {"avg": np.add, "sum": np.add, "min": np.minimum, "max": np.maximum}


class Together:
    """roll() of long windows as columns that one pass over a symbol makes together, where windows would go through n rows for each row.

    It is called like roll() before the pass, which then finds in `asked` what it has to make, and after it. Short
    windows and other functions stay windows.
    """

    def __init__(self):
        self.asked: dict[tuple, tuple[str, Column]] = {}

    def __call__(self, f: Callable[[Column], Column], column: str | Column, n: int, end: int = 0) -> Column:
        if f.__name__ not in _MERGED or n < 10:
            return roll(f, column, n, end)
        column = F.col(column) if isinstance(column, str) else column
        key = (f.__name__, str(column), n, end)
        return F.col(self.asked.setdefault(key, (f"__roll{len(self.asked)}", column.cast("double")))[0])

    def values(self) -> dict[str, Column]:
        """The columns that the windows go over, by the name of what is made of them."""
        return dict(self.asked.values())

    def windows(self) -> dict[str, tuple[str, int, int]]:
        """What the pass has to make: rolled()'s f, n and end by name."""
        return {name: (f, n, end) for (f, _, n, end), (name, _) in self.asked.items()}


def rolled(f: str, values: np.ndarray, n: int, end: int) -> np.ndarray:
    """roll() of an array in the order of dates, its values taken up in their order; NaN where the window is not full."""
    out, m = np.full(len(values), np.nan), len(values) - n + 1 - end
    if m > 0:
        x = values[:m].copy()
        for j in range(1, n):
            _MERGED[f](x, values[j : j + m], out=x)
        out[n - 1 + end :] = x / n if f == "avg" else x
    return out


def true(condition: Column) -> Column:
    """condition, false where it is null."""
    return F.coalesce(condition, F.lit(False))


def r6(column: str | Column) -> Column:
    """Rounded to 6 digits, as values are given out."""
    return F.round(column, 6)
