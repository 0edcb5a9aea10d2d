"""Sizes, update costs and memory budgets of sketches; all on the driver."""

from __future__ import annotations

import math

from cubetally.operators.countmin import dimensions
from cubetally.operators.membership import bloom_dimensions
from cubetally.plans.schema import Layout

LEAST_WIDTH = 1000


def updates(layout: Layout) -> dict[str, int]:
    """Updates a row: category prefixes, number cells, regions."""
    cat = len(layout.prefixes())
    num = len(layout.kept_masks()) * layout.levels + 1
    return {"cat": cat, "num": num, "region": cat * num}


def sizes(width: int, depth: int, bits: int, side: int) -> dict[str, int]:
    """Bytes of one structure of each kind; an exact node set counts none."""
    return {"count_min": 4 * width * depth, "bloom": math.ceil(bits / 8), "bitmap": math.ceil(2 * side / 8), "node_set": 0}


def reduced(width: int, factor: float) -> int:
    return max(LEAST_WIDTH, int(width * factor))


def uniform_levels(layout: Layout, rel_eps: float, delta: float, sparse: int = 0) -> list[tuple[str, int, int]]:
    """(kind, width, depth) of each level; the error target is shared by the regions of a row, the first ``sparse`` levels are filters."""
    w, d = dimensions(rel_eps / updates(layout)["region"], delta)
    return [("bloom" if l < sparse else "count_min", w, d) for l in range(layout.levels)]


def decreasing_levels(layout: Layout, width: int, depth: int, beta: float) -> list[tuple[str, int, int]]:
    """Widths shrink by (product of bases**level)**beta."""
    return [("count_min", max(1, math.ceil(width / math.prod(b**l for b in layout.bases) ** beta)), depth) for l in range(layout.levels)]


def budget(total_bytes: int, layout: Layout, rows: int, share: float = 0.25, most_hashes: int = 7) -> dict[str, int]:
    """Bytes and hashes: a quarter to counters, the rest split over number and region index by their updates."""
    u = updates(layout)
    counters = int(total_bytes * share)
    rest = total_bytes - counters
    num = rest * u["num"] // (u["num"] + u["region"])
    bits = 8 * num
    k = min(most_hashes, max(1, round(bits / (rows * u["num"]) * math.log(2))))
    return {"count_min": counters, "num_index": num, "region_index": rest - num, "hashes": k}


def filter_for(values: int, p: float) -> tuple[int, int]:
    return bloom_dimensions(values, p)
