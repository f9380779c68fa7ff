"""A table function over rays for ad-hoc SQL (the operators do not need it)."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def _touch(v: float) -> list[int]:
    near = round(v)
    return [near - 1, near] if abs(v - near) <= 1e-9 else [math.floor(v)]


class TraversedCells:
    """(row, col, enter_t, leave_t) of the cells that a ray in grid coordinates touches."""

    def eval(self, c0: float, r0: float, c1: float, r1: float):
        cuts = {0.0, 1.0}
        for a, b in ((c0, c1), (r0, r1)):
            if a != b:
                cuts.update(t for i in range(math.ceil(min(a, b)), math.floor(max(a, b)) + 1) if 0 < (t := (i - a) / (b - a)) < 1)
        order = sorted(cuts)
        spans = [(t, t) for t in order] + list(zip(order, order[1:], strict=False))
        found: dict[tuple[int, int], list[float]] = {}
        for a, b in spans:
            m = (a + b) / 2
            for row in _touch(r0 + m * (r1 - r0)):
                for col in _touch(c0 + m * (c1 - c0)):
                    at = found.setdefault((row, col), [a, b])
                    at[0], at[1] = min(at[0], a), max(at[1], b)
        for (row, col), (a, b) in sorted(found.items()):
            yield row, col, a, b


def register(spark: SparkSession) -> None:
    spark.udtf.register("traversed_cells", udtf(TraversedCells, returnType="row int, col int, enter_t double, leave_t double"))
