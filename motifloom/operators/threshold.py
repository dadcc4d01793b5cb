"""Score cutoffs: absolute, relative to the best score, or for a p-value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

#: Fixed value: scores are rounded to so many steps between the lowest and the highest weight.
STEPS = 1000.0


def p_value_cutoff(weights: np.ndarray, p: float, background: Sequence[float] = (0.25,) * 4) -> float:
    """The lowest score that background sequences reach with probability p at most; infinite if there is none.

    The distribution of rounded scores is exact; the cutoff lies half-way (rounded down) between the score that exceeds p
    and the next one above it that occurs.
    """
    spread = float(weights.max() - weights.min())
    if spread == 0:
        return float("inf")
    scale = STEPS / spread
    scaled = weights * scale
    steps = (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(int)
    share = np.asarray(background, float) / sum(background)
    low = steps.min(axis=0)
    dist = np.ones(1)
    for j in range(steps.shape[1]):
        wide = np.zeros(len(dist) + int(steps[:, j].max() - low[j]))
        for b in range(4):
            at = steps[b, j] - low[j]
            wide[at : at + len(dist)] += share[b] * dist
        dist = wide
    top = int(steps.max(axis=0).sum())
    above, total = 2 * (top + 1), 0.0
    for score in range(top, top - len(dist), -1):
        here = dist[score - (top - len(dist) + 1)]
        total += here
        if total > p:
            return _half(score + 1 + above) / scale
        if here > 0:
            above = score
    return float("inf")


def _half(x: int) -> int:
    """x / 2 without its fraction, toward zero."""
    return int(x / 2)


def cutoffs(weights: Mapping[str, np.ndarray], kind: str, value: float, background: Sequence[float] = (0.25,) * 4) -> dict[str, float]:
    """A cutoff for each motif. kind: absolute (9.0 by custom), relative (0.1 of the best likelihood) or pvalue (1e-6)."""
    if kind == "absolute":
        return dict.fromkeys(weights, float(value))
    if kind == "relative":
        return {m: float(np.log2(value) + w.max(axis=0).sum()) for m, w in weights.items()}
    if kind == "pvalue":
        return {m: p_value_cutoff(w, value, background) for m, w in weights.items()}
    raise ValueError(f"unknown kind of cutoff: {kind}")


def sequences_above(weights: np.ndarray, limit: float) -> list[tuple[str, float]]:
    """All sequences that score limit or more, best first at every position (branch and bound)."""
    best_after = np.r_[np.cumsum(weights.max(axis=0)[::-1])[::-1][1:], 0.0]
    out: list[tuple[str, float]] = []
    stack: list[tuple[int, str, float]] = [(0, "", 0.0)]
    while stack:
        i, made, score = stack.pop()
        if i == weights.shape[1]:
            out.append((made, score))
            continue
        for b in np.argsort(weights[:, i], kind="stable"):
            new = score + float(weights[b, i])
            if new + best_after[i] >= limit:
                stack.append((i + 1, made + "ACGT"[b], new))
    return out
