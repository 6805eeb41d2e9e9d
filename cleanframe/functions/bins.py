"""Bin edges and their labels. Bins are open on the left and closed on the right."""

from __future__ import annotations

import math

import numpy as np

# Fixed value: share of the range by which the lowest edge is lowered so that the minimum falls inside.
MARGIN = 0.001


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    if bins < 1:
        raise ValueError("at least one bin is needed")
    low, high = float(low), float(high)
    single = low == high
    if single:
        reach = MARGIN * abs(low) if low else MARGIN
        low, high = low - reach, high + reach
    edges = [low + i * ((high - low) / bins) for i in range(bins)] + [high]
    if not single:
        edges[0] -= MARGIN * (high - low)
    return edges


def check_increasing(edges: list[float]) -> None:
    if len(edges) < 2:
        raise ValueError("at least two edges are needed")
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("the bin edges are not strictly increasing")


def _rounded(x, digits: int):
    """Round to `digits` decimals, or to `digits` significant ones below 1."""
    if x == 0 or not math.isfinite(x):
        return x
    if abs(x) < 1:
        digits += -int(math.floor(math.log10(abs(x)))) - 1
    return x if isinstance(x, int) or digits > 300 else float(np.around(x, digits))


def labels(edges: list[float], digits: int) -> list[str]:
    """'(lo, hi]' per bin, with as many digits from `digits` on as keep the edges apart."""
    shown = [_rounded(e, digits) for e in edges]
    for more in range(digits, 20):
        attempt = [_rounded(e, more) for e in edges]
        if len(set(attempt)) == len(set(edges)):
            shown = attempt
            break
    return [f"({lo}, {hi}]" for lo, hi in zip(shown, shown[1:])]
