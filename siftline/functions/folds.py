"""Folds over long lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner fold takes.
BLOCK = 256


def collecting(items: str, state: Column, step: Callable[[Column, Column], Column], out: str = "out") -> Column:
    """The list ``out`` that a fold adds one element to at every step.

    Adding to a list copies it, so a fold that carries all of it costs the square of the list's length. Here blocks of the list are
    folded with a list of their own, which is then added to the whole: of n elements each is copied about ``BLOCK / 2 + n / (2 * BLOCK)`` times.
    """
    blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))

    def block(s: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(F.col(items), b * BLOCK + 1, F.lit(BLOCK)), s.withField(out, F.array().cast("array<int>")), step)
        # bound by a list of one, so that the inner fold runs once
        return F.get(F.transform(F.array(inner), lambda x: x.withField(out, F.concat(s[out], x[out]))), F.lit(0))

    return F.aggregate(blocks, state, block, lambda s: s[out])
