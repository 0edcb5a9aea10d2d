"""Table layouts: which columns are categories and which are numbers, and their resolution."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Categories (strings) in prefix order, numbers (whole) with a base each, and the number of levels.

    ``masks`` lists the sets of kept number positions; None means all non-empty ones.  ``collapsed`` drops
    the category prefix before the last.
    """

    cats: tuple[str, ...]
    nums: tuple[str, ...]
    bases: tuple[int, ...]
    levels: int
    masks: tuple[tuple[int, ...], ...] | None = None
    collapsed: bool = False
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if len(self.bases) != len(self.nums) or any(b < 1 for b in self.bases):
            raise ValueError("a base of 1 or more is needed for each number")
        if set(self.cats) & set(self.nums):
            raise ValueError("a column has one role")

    @property
    def columns(self) -> tuple[str, ...]:
        return self.cats + self.nums

    def prefixes(self) -> list[int]:
        """Lengths of the category prefixes that are kept."""
        m = len(self.cats)
        return [k for k in range(m + 1) if not (self.collapsed and k == m - 1 and m > 1)]

    def kept_masks(self) -> list[tuple[int, ...]]:
        return list(self.masks) if self.masks is not None else full_masks(len(self.nums))

    def grouping_id(self, prefix: int, mask: tuple[int, ...]) -> int:
        """Bit 1 for each column that is a wildcard, the first column highest."""
        bits = [0 if i < prefix else 1 for i in range(len(self.cats))] + [0 if i in mask else 1 for i in range(len(self.nums))]
        return int("".join(map(str, bits)) or "0", 2)

    def merges_with(self, other: Layout) -> bool:
        return self == other


def full_masks(d: int) -> list[tuple[int, ...]]:
    """All non-empty sets of kept positions."""
    return [c for k in range(d, 0, -1) for c in combinations(range(d), k)]


def near_full_masks(d: int, wildcards: int = 2) -> list[tuple[int, ...]]:
    """The sets of kept positions with at most ``wildcards`` left out."""
    return [c for k in range(d, max(d - wildcards, 0) - 1, -1) for c in combinations(range(d), k)]


def best_mask(masks: list[tuple[int, ...]], wanted: set[int]) -> tuple[int, ...]:
    """The smallest stored mask that keeps all ``wanted`` positions, the first of equals."""
    fit = [m for m in masks if wanted <= set(m)]
    if not fit:
        raise ValueError(f"no stored mask keeps {sorted(wanted)}")
    return min(fit, key=len)


def grouping_sets(layout: Layout, level: int) -> list[tuple[int, tuple[int, ...]]]:
    """(prefix, mask) of the grouping sets of a level; the all-wildcard mask belongs to the top level alone."""
    masks = layout.kept_masks() + ([()] if level == layout.levels - 1 else [])
    return list(product(layout.prefixes(), masks))


def floor_div(value: Column, w: Column | int) -> Column:
    """floor(value / w) of longs, towards minus infinity and exact for all of them; ``w`` is 1 or more."""
    w = F.lit(w) if isinstance(w, int) else w
    return F.call_function("div", value.cast("long"), w) - F.when(value % w < 0, 1).otherwise(0)


def level_index(value: Column, base: int, level: int) -> Column:
    """floor(value / base**level) on whole numbers, towards minus infinity and exact for all longs."""
    w = base**level
    if w >= 1 << 63:  # one block on each side of 0
        return F.when(value < 0, -1).when(value >= 0, 0).cast("long")
    return value if w == 1 else floor_div(value, w)


def canonical(df: DataFrame, layout: Layout) -> DataFrame:
    """The layout's columns as strings and longs."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in layout.cats], *[F.col(c).cast("long").alias(c) for c in layout.nums])
