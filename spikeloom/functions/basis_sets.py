"""Basis sets of a recording session: small matrices on the driver, which gathers by time offset turn into regressors.

A basis has ``times`` (bin offsets from the event), ``raw`` (its functions) and ``matrix`` (orthonormal columns of the same span, or the raw ones).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Basis:
    times: np.ndarray
    raw: np.ndarray
    matrix: np.ndarray

    def table(self) -> list[list[float]]:
        return self.matrix.tolist()


def orthonormal(m: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the column space."""
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    return u[:, s > max(m.shape) * np.finfo(float).eps * s[0]] if s.size and s[0] > 0 else m[:, :0]


def raised_cosines(count: int, step: float, first: float, last: float, stretch: float, start: str = "plain", refractory: float = 0.0, symmetric: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(times, functions): cosine bumps over log-stretched time whose peaks are evenly spaced from ``first`` to ``last``.

    start: "plain"; "flat" holds the first bump at 1 before its peak; "refractory" makes the first function an indicator of times below
    ``refractory`` and sets the bumps (one fewer) to 0 there. With ``symmetric`` times go as far below zero.
    """
    if stretch <= 0:
        raise ValueError("stretch must be positive")
    bumps = count - (start == "refractory")
    low, high = math.log(first + stretch), math.log(last + stretch)
    gap = (high - low) / (bumps - 1)
    end = math.exp(high + 2 * gap) - stretch
    begin = -end if symmetric else 0.0
    times = begin + step * np.arange(int(math.floor((end - begin) / step + 1e-9)) + 1)
    at = np.log(np.maximum(times + stretch, 1e-20))[:, None] - (low + gap * np.arange(bumps))
    out = (np.cos(np.clip(at * math.pi / gap / 2, -math.pi, math.pi)) + 1) / 2
    if start == "flat":
        out[times <= first, 0] = 1.0
    elif start == "refractory":
        early = times < refractory
        out[early] = 0.0
        out = np.column_stack([early.astype(float), out])
    return times, out


def cardinal_spline(times: np.ndarray, knots: list[float], tension: float = 0.5, zero_first: bool = False, zero_last: bool = False) -> np.ndarray:
    """Modified cardinal spline: Hermite segments between knots, whose slopes are differences of the neighbours' values; flat at both ends.

    A time belongs to the segment of the last knot strictly below it. A column for each knot; the first and last ones can be left out. Slopes of inner segments are
    by the distance of the knots, those at the ends by that distance in lengths of the segment, as the published method's matrices have it.
    """
    k, n = np.asarray(knots, float), len(knots)
    i = np.searchsorted(k, times, side="left") - 1
    if (i < 0).any() or (i > n - 2).any():
        raise ValueError("times must lie behind the first knot and not behind the last")
    long = k[i + 1] - k[i]
    u = (times - k[i]) / long
    h00, h10, h01, h11 = 2 * u**3 - 3 * u**2 + 1, u**3 - 2 * u**2 + u, 3 * u**2 - 2 * u**3, u**3 - u**2
    out, row = np.zeros((len(times), n)), np.arange(len(times))
    np.add.at(out, (row, i), h00)
    np.add.at(out, (row, i + 1), h01)
    inner = (i > 0) & (i < n - 2)
    for side, h, has in ((0, h10, i > 0), (1, h11, i < n - 2)):  # the slope at each end of the segment
        below, above = np.maximum(i - 1 + side, 0), np.minimum(i + 1 + side, n - 1)
        span = (k[above] - k[below]) / np.where(inner, 1.0, long)
        slope = np.where(has, tension * h / np.where(span > 0, span, 1.0), 0.0)
        np.add.at(out, (row, above), slope)
        np.add.at(out, (row, below), -slope)
    return out[:, int(zero_first) : n - int(zero_last)]


def mean_norm(eigenvalues: np.ndarray) -> float:
    """E of the square root of sum_i l_i z_i^2 over standard normal z, from its Laplace transform."""
    t = np.exp(np.arange(-60, 60, 0.02))
    keep = eigenvalues[eigenvalues > 1e-14 * max(eigenvalues.max(), 1e-300)]
    transform = np.exp(-0.5 * np.log1p(2 * t[:, None] * keep).sum(axis=1))
    return float(((1 - transform) / np.sqrt(t)).sum() * 0.02 / (2 * math.sqrt(math.pi)))


def scaled(basis: Basis, goal: float) -> Basis:
    """Scaled so that a random filter's standard deviation over time, times the size of a standard normal, is 1 / goal on average."""
    centred = basis.matrix - basis.matrix.mean(axis=0)
    spread = mean_norm(np.linalg.eigvalsh(centred.T @ centred)) / math.sqrt(max(1, len(centred) - 1)) * math.sqrt(2 / math.pi)
    return Basis(basis.times, basis.raw, basis.matrix / (goal * spread) if spread > 0 else basis.matrix)


def cosine_set(step_ms: float = 5.0, length_ms: float = 1500.0, count: int = 24, after_response: int = 10) -> dict[str, Basis]:
    """stim, response (the stimulus bumps up to 300 ms, reversed and shifted, so it leads up to the event) and history (single bins
    for 10 ms, then six bumps to 200 ms)."""
    dt = step_ms / 1e3
    _, bumps = raised_cosines(count, dt, 0.0, length_ms / 1e3, 0.2, symmetric=True)
    bumps = bumps[max(0, int(np.argmax(bumps[:, 0] > 0)) - 1) :]  # starts near zero: a stimulus takes time to arrive
    stim = Basis(np.arange(len(bumps)), bumps, orthonormal(bumps))
    peaks = bumps.argmax(axis=0) + 1
    short = int(np.argmax(peaks > 300 / step_ms)) + 1 if (peaks > 300 / step_ms).any() else count
    shift = after_response + round(20 / step_ms)
    reverse = bumps[::-1, :short]
    times = np.arange(len(reverse)) - len(reverse) + shift
    used = (orthonormal(reverse) ** 2).sum(axis=1) > 1e-8
    response = Basis(times[used], reverse[used], orthonormal(reverse)[used])
    single = math.ceil(10e-3 / dt - 1e-9)
    _, late = raised_cosines(6, dt, single * 1e-3, 0.2, 0.05)
    late[:single] = 0.0
    early = np.eye(len(late), single)
    history = Basis(np.arange(1, len(late) + 1), np.column_stack([early, late]), np.column_stack([early, orthonormal(late)]))
    return {"stim": stim, "response": response, "history": history}


#: Knots in milliseconds.
HISTORY_KNOTS = [0, 2, 5, 10, 20, 40, 60, 80, 120, 160, 240, 320, 401]
RESPONSE_KNOTS = [-301, -250, -200, -150, -100, -60, -40, -20, 0, 20, 40, 51]


def spline_set(step_ms: float = 5.0, stimulus_ms: float = 550.0, delay_ms: float = 1200.0, fine_on_ms: float = 200.0, fine_off_ms: float = 200.0, orthogonal: bool = True, rescale: bool = True) -> dict[str, Basis]:
    """stim, stim_test, response and history as splines whose knots are dense after stimuli go on and off."""
    off, end = stimulus_ms + delay_ms, 2 * stimulus_ms + delay_ms + 50

    def grid(a, b, d):
        return np.arange(a, b + 1e-9, d)

    def knots(*parts):
        k = np.unique(np.concatenate(parts))
        k[0], k[-1] = k[0] - 1, k[-1] + 1
        return k.tolist()

    stim = knots(grid(0, fine_on_ms, 25), grid(fine_on_ms, stimulus_ms, 50), grid(stimulus_ms, stimulus_ms + fine_off_ms, 25), grid(stimulus_ms + fine_off_ms, off, 50), np.linspace(off, end, 3))
    test = knots(grid(0, fine_on_ms, 25), grid(fine_on_ms, stimulus_ms, 50), grid(stimulus_ms, stimulus_ms + 50, 25))
    out = {}
    for name, first, last, k, no_first, goal in (("history", step_ms, 400, HISTORY_KNOTS, False, 10.0), ("stim", 0, end, stim, True, 1.0), ("stim_test", 0, stimulus_ms + 50, test, True, 1.0), ("response", -300, 50, RESPONSE_KNOTS, False, 1.0)):
        times = grid(first, last, step_ms)
        raw = cardinal_spline(times, k, zero_first=no_first)
        basis = Basis(np.floor(times / step_ms + 1e-9).astype(int), raw, orthonormal(raw) if orthogonal else raw)
        out[name] = scaled(basis, goal) if rescale else basis
    return out
