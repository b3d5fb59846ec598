"""Temporal bases and stimulus tunings as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def raised_cosine(lag: Column, k: int, count: int, first: float, last: float, stretch: float) -> Column:
    """Bump k of ``count`` over log-stretched lags, with peaks evenly spaced from ``first`` to ``last``."""
    low, high = math.log(first + stretch), math.log(last + stretch)
    step = (high - low) / (count - 1)
    at = (F.log(lag + stretch) - (low + k * step)) * (math.pi / step / 2)
    return (F.cos(F.greatest(F.lit(-math.pi), F.least(F.lit(math.pi), at))) + 1) / 2


def raised_cosine_at(lag: float, k: int, count: int, first: float, last: float, stretch: float) -> float:
    """The same of one number."""
    low, high = math.log(first + stretch), math.log(last + stretch)
    step = (high - low) / (count - 1)
    at = (math.log(lag + stretch) - (low + k * step)) * math.pi / step / 2
    return (math.cos(max(-math.pi, min(math.pi, at))) + 1) / 2


def spline_weights(u: Column, tension: float = 0.5) -> list[Column]:
    """Cardinal spline weights of the knots before, at, after and past the segment that holds u in 0..1."""
    s, u2, u3 = tension, u * u, u * u * u
    return [-s * u + 2 * s * u2 - s * u3, 1 + (s - 3) * u2 + (2 - s) * u3, s * u + (3 - 2 * s) * u2 + (s - 2) * u3, s * u3 - s * u2]


def cosine_tuning(direction: Column, directions: int) -> list[Column]:
    angle = direction * (2 * math.pi / directions)
    return [F.cos(angle), F.sin(angle)]


def one_hot(direction: Column, directions: int) -> list[Column]:
    return [(direction == d).cast("double") for d in range(directions)]


def contrast(direction: Column, directions: int) -> Column:
    """+1 for the first half of the directions, -1 for the second."""
    return F.when(direction < directions // 2, 1.0).otherwise(-1.0)
