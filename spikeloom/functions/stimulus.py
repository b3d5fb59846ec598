"""Stimulus designs: features of each direction in the sample and the test period, and the covariance of their coefficients.

A design is a small table (direction, period, feature, value), one row for each direction, so bins get their features by a gather. The prior's covariance is
M K M' over the coefficients: each piece of K has its own log scale, and columns of M say which coefficients it moves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

SAMPLE, TEST = 0, 1
BOTH = (SAMPLE, TEST)


@dataclass
class Piece:
    """One block of independent or smooth (over angles) effects: name, loads [features, effects], angles between effects for a smooth one."""

    name: str
    loads: np.ndarray
    angles: np.ndarray | None = None
    shares: str | None = None  # the name of a piece with the same log scale

    @property
    def hypers(self) -> int:
        return 0 if self.shares else 1 if self.angles is None else 2


@dataclass
class Design:
    """values [directions, features, 2 periods], names of features, pieces of the prior (the first moves all features of a contrast together)."""

    values: np.ndarray
    names: list[str]
    pieces: list[Piece] = field(default_factory=list)

    @property
    def hypers(self) -> int:
        return sum(p.hypers for p in self.pieces)

    def stacked(self) -> np.ndarray:
        """Rows of the sample's directions, then of the test's: the table that a bin's feature index points into."""
        return np.concatenate([self.values[:, :, SAMPLE], self.values[:, :, TEST]])


def design(degrees: np.ndarray, category: np.ndarray, tuning: str = "cosine", same_direction: bool = True, with_category: bool = True, with_period: bool = True) -> Design:
    """tuning: "cosine" (sine and cosine of the angle), "none", or "full" (a feature for each direction).

    same_direction: one tuning for both periods, else one for each. with_category: a feature for each category; with_period: categories (or the
    onset, without categories) differ between periods. Full tuning holds the categories of the sample itself, so there only the test's differ.
    """
    degrees, category = np.asarray(degrees, float), np.asarray(category)
    kinds, columns, blocks = np.unique(category), [], {}

    def add(block: str, name: str, periods: tuple[int, ...], values: np.ndarray) -> None:
        blocks.setdefault(block, []).append(len(columns))
        columns.append((name, periods, np.asarray(values, float)))

    each = [(SAMPLE,), (TEST,)]
    if tuning in ("cosine", "none"):
        for periods in each if with_period else [BOTH]:
            for c in kinds if with_category else [None]:
                add("categories" if with_category else "offsets", f"category {c}" if with_category else "onset", periods, category == c if with_category else np.ones(len(degrees)))
        if tuning == "cosine":
            for periods in [BOTH] if same_direction else each:
                add("sine/cosine", "sine", periods, np.sin(np.radians(degrees)))
                add("sine/cosine", "cosine", periods, np.cos(np.radians(degrees)))
    elif tuning == "full":
        if same_direction and with_period:
            for c in kinds if with_category else [None]:
                add("categories of the test" if with_category else "offsets", f"category {c}" if with_category else "onset", (TEST,), category == c if with_category else np.ones(len(degrees)))
        for block, periods in [("directions", BOTH)] if same_direction else [("directions", each[0]), ("directions of the test", each[1])]:
            for k, d in enumerate(degrees):
                add(block, f"direction {d:g}", periods, np.arange(len(degrees)) == k)
    else:
        raise ValueError(f"no such tuning: {tuning}")

    values = np.zeros((len(degrees), len(columns), 2))
    for j, (_, periods, v) in enumerate(columns):
        for p in periods:
            values[:, j, p] = v
    return Design(values, [n for n, *_ in columns], prior_pieces(blocks, len(columns), degrees, category))


def prior_pieces(blocks: dict[str, list[int]], n: int, degrees: np.ndarray, category: np.ndarray) -> list[Piece]:
    common = np.zeros((n, 1))
    out = [Piece("contrast", common)]
    if n == 1:
        common[:] = 1.0
        return out
    kinds, eye = np.unique(category), np.eye(n)
    for block in ("offsets", "categories", "sine/cosine"):
        if block in blocks:
            out.append(Piece(block, eye[:, blocks[block]]))
            if block != "sine/cosine":
                common[blocks[block]] = 1.0
    for block in ("directions", "directions of the test"):
        if block in blocks:
            at, also = blocks[block], None if block == "directions" else "directions"
            common[at] = 1.0
            by_category, wave = np.zeros((n, len(kinds))), np.zeros((n, 2))
            by_category[at] = category[:, None] == kinds
            wave[at] = np.column_stack([np.sin(np.radians(degrees)), np.cos(np.radians(degrees))])
            apart = np.arccos(np.clip(np.cos(np.radians(degrees[:, None] - degrees)), -1, 1))
            for name, loads, angles in (("categories", by_category, None), ("waves", wave, None), ("smooth", eye[:, at], apart)):
                out.append(Piece(f"{name} of {block}", loads, angles, also and f"{name} of {also}"))
    if "categories of the test" in blocks:  # takes the place of the sample's category effect
        loads = eye[:, blocks["categories of the test"]]
        base = next((p for p in out if p.name == "categories of directions"), None)
        if base is not None:
            base.loads[blocks["categories of the test"]] = -np.eye(len(kinds))
        out.append(Piece("categories of the test", loads, None, base and base.name))
    return out


def covariance(pieces: list[Piece], h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The coefficients' covariance and its derivatives by the hyperparameters: log scales, and for a smooth piece the log of how fast it falls with the angle."""
    n, at, where = len(pieces[0].loads), 0, {}
    total, slopes = np.zeros((n, n)), [np.zeros((n, n)) for _ in range(sum(p.hypers for p in pieces))]
    for p in pieces:
        if not p.shares:
            where[p.name] = at
            at += p.hypers
        i = where[p.shares or p.name]
        size, live = math.exp(min(20.0, 2 * h[i])), float(2 * h[i] < 20)
        if p.angles is None:
            k = np.eye(p.loads.shape[1])
        else:  # polar kernel: (1 + t x)(1 - x)^t for x = angle / pi and t >= 4
            fast = math.exp(min(20.0, h[i + 1]))
            t, x = fast + 4, p.angles / math.pi
            left = np.maximum(0.0, 1 - x)
            k = (1 + t * x) * left**t
            by = fast * float(h[i + 1] < 20) * (x * left**t + k * np.log(np.where(left > 0, left, 1.0)))
            slopes[i + 1] += size * p.loads @ by @ p.loads.T
        full = size * p.loads @ k @ p.loads.T
        total += full
        slopes[i] += 2 * live * full
    return total, slopes


def contrast_design(degrees: np.ndarray, category: np.ndarray, subcategory: np.ndarray | None = None, with_period: bool = True) -> np.ndarray:
    """[directions, features, 2]: onset, +-1 contrasts of category (and of subcategory inside it), period contrast, sine and cosine; each scaled to a root mean square of 1."""
    degrees = np.asarray(degrees, float)
    kinds = np.unique(category)
    columns = [np.ones(len(degrees)), np.where(np.asarray(category) == kinds[0], 1.0, -1.0)]
    if subcategory is not None:
        for c in kinds:
            sub = np.asarray(subcategory)
            columns.append(np.where(np.asarray(category) == c, np.where(sub == np.unique(sub)[0], 1.0, -1.0), 0.0))
    columns += [np.sin(np.radians(degrees)), np.cos(np.radians(degrees))]
    out = np.repeat(np.stack(columns, axis=1)[:, :, None], 2, axis=2)
    if with_period:
        out = np.concatenate([out, np.broadcast_to(np.array([1.0, -1.0]), (len(degrees), 1, 2))], axis=1)
    size = np.sqrt((out**2).mean(axis=(0, 2), keepdims=True))
    return out / np.where(size > 0, size, 1.0)
