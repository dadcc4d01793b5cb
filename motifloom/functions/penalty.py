"""The score of a chain of sites: a bonus for each column, a penalty for each step."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    lam: float = 2.0  # bonus of a site's score
    mu: float = 0.5  # distance
    nu: float = 1.0  # difference of distances
    xi: float = 1.0  # twist
    rotation: float = 10.4  # nucleotides a turn


def folded_angle(x, rotation: float):
    """The angle of x nucleotides, folded to 0..pi. x: a number or array."""
    turn = np.abs(x) * (2 * math.pi / rotation) % (2 * math.pi)
    return np.minimum(turn, 2 * math.pi - turn)


def step_penalty(x, y, w: Weights):
    """The penalty of gaps x and y between two columns; none for two empty gaps. Numbers or arrays."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    s = x + y
    safe = np.where(s > 0, s, 1)
    return np.where(s > 0, w.mu * s / 2 + (w.nu * (x - y) ** 2 + w.xi * folded_angle(x - y, w.rotation) ** 2) / safe, 0.0)


def step_penalty_column(x: Column, y: Column, w: Weights = Weights()) -> Column:
    """The same as a column expression."""
    s = x + y
    turn = F.abs(x - y) * F.lit(2 * math.pi / w.rotation)
    turn = turn - F.lit(2 * math.pi) * F.floor(turn / F.lit(2 * math.pi))
    angle = F.least(turn, F.lit(2 * math.pi) - turn)
    terms = F.lit(w.mu) * s / 2 + F.lit(w.nu) * (x - y) * (x - y) / s + F.lit(w.xi) * angle * angle / s
    return F.when(s > 0, terms).otherwise(F.lit(0.0))


def general_penalty(gaps: np.ndarray, w: Weights) -> np.ndarray:
    """The penalty of many gaps at once (steps x sequences), about their mean."""
    mean, total = gaps.mean(axis=1), gaps.sum(axis=1)
    off = gaps - mean[:, None]
    safe = np.where(total > 0, total, 1)
    bent = (w.nu * (off**2).sum(axis=1) + w.xi * (folded_angle(off, w.rotation) ** 2).sum(axis=1)) / safe
    return np.where(total > 0, w.mu * mean + bent, 0.0)
