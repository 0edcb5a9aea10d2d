"""Covers of integer ranges by blocks [base**level * idx, base**level * (idx + 1))."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubetally.plans.schema import floor_div


def cover(base: int, lo: int, hi: int, cap: int | None = None) -> list[tuple[int, int]]:
    """The minimal (level, idx) blocks of [lo, hi], by first value; ``cap`` is the highest level allowed."""
    if base == 1:
        return [(0, v) for v in range(lo, hi + 1)]
    out: list[tuple[int, int]] = []
    level = 0
    while True:
        w = base**level
        first, last = -(-lo // w), (hi + 1) // w - 1
        if first > last:
            break
        up = w * base
        p_first, p_last = -(-lo // up), (hi + 1) // up - 1
        if p_first > p_last or level == cap:
            out += [(level, i) for i in range(first, last + 1)]
            break
        out += [(level, i) for i in range(first, p_first * base)] + [(level, i) for i in range((p_last + 1) * base, last + 1)]
        level += 1
    return sorted(out, key=lambda r: r[1] * base ** r[0])


def boxes(ranges: list[tuple[int, int, int]], cap: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(level, [(first, last) index a dimension]) for the cover of a box given as (base, lo, hi) a dimension.

    Each combination of one-dimensional blocks is the box of cubes at its lowest level.
    """
    covers = [cover(b, lo, hi, cap) for b, lo, hi in ranges]
    out = []
    for combo in product(*covers):
        m = min(level for level, _ in combo)
        out.append((m, [(i * b ** (level - m), (i + 1) * b ** (level - m) - 1) for (level, i), (b, _, _) in zip(combo, ranges, strict=True)]))
    return out


def aligned(base: int, lo: int, hi: int, level: int) -> tuple[int, int]:
    """A range rounded to multiples of base**level (an approximation of the query itself)."""
    w = base**level
    return round(lo / w) * w, max(round(lo / w) * w, round((hi + 1) / w) * w - 1)


def cover_table(ranges: DataFrame, levels: int) -> DataFrame:
    """(…, lvl, idx) of the cover of each row's (base, lo, hi), base 2 or more, as column expressions.

    At each level the blocks inside the range are an interval, and those whose parent is inside too are a
    sub-interval; what is left is at most base - 1 blocks at either end.
    """
    df = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("lvl"))
    w = F.pow(F.col("base"), F.col("lvl")).cast("long")
    up = w * F.col("base")
    inside = lambda width: (-floor_div(-F.col("lo"), width), floor_div(F.col("hi") + 1, width) - 1)
    first, last = inside(w)
    p_first, p_last = inside(up)
    top = F.col("lvl") == levels - 1
    whole = (p_first > p_last) | top
    seq = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    parts = F.when(whole, seq(first, last)).otherwise(F.concat(seq(first, p_first * F.col("base") - 1), seq((p_last + 1) * F.col("base"), last)))
    return df.select("*", F.explode(parts).alias("idx"))


def lowered(blocks: DataFrame, to: int) -> DataFrame:
    """Blocks (base, lvl, idx) as their blocks at level ``to``; a block below that level is an error."""
    s = F.pow(F.col("base"), F.col("lvl") - to).cast("long")
    down = F.when(F.col("lvl") < to, F.raise_error(F.lit("a block cannot be raised to a higher level"))).otherwise(F.sequence(F.col("idx") * s, F.col("idx") * s + s - 1))
    return blocks.select("*", F.explode(down).alias("low_idx"))
