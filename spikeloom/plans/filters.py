"""Gaussian priors of filters with hyperparameters, composed of parts by name.

A part is a block of coefficients whose covariance is a function of some hyperparameters (log standard deviations and shapes), repeated for each column of a basis. Parts are put
together to the prior of a linear model's whole weight vector (``Composed``: for ``fits.Evidence`` and fits), or to the prior of a multilinear model by its blocks
(``structured``: each named mode has its part, with the hyperparameters in H). Half-t densities of standard deviations are the hyperpriors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from spikeloom.functions import stimulus
from spikeloom.plans.fits import precision_of
from spikeloom.plans.gmlm import Params, Prior, Spec
from spikeloom.plans.horseshoe import half_t


@dataclass(frozen=True)
class Part:
    """size coefficients (before repetition), or without a covariance coefficients of no prior. nus: degrees of freedom of each hyperparameter's half-t density, None for no density."""

    name: str
    size: int
    hypers: int = 0
    covariance: Callable[[np.ndarray], tuple[np.ndarray, list[np.ndarray]]] | None = None
    repeat: int = 1
    nus: tuple[float | None, ...] = ()

    @property
    def length(self) -> int:
        return self.size * self.repeat

    def precision(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], float, int]:
        """Precision, its derivatives, log determinant and rank; a coefficient's repetitions follow each other."""
        if self.covariance is None:
            return np.zeros((self.length, self.length)), [], 0.0, 0
        p, slopes, logdet, rank = precision_of(self.covariance)(h)
        one = np.eye(self.repeat)
        return np.kron(p, one), [np.kron(d, one) for d in slopes], self.repeat * logdet, self.repeat * rank

    def hyper(self, h: np.ndarray) -> tuple[float, np.ndarray]:
        lp, d = 0.0, np.zeros(self.hypers)
        for i, nu in enumerate(self.nus):
            if nu is not None:
                value, slope = half_t(h[i : i + 1], nu)
                lp, d[i] = lp + value, slope[0]
        return lp, d


def free(name: str, size: int) -> Part:
    return Part(name, size)


def standard(name: str, size: int, repeat: int = 1) -> Part:
    """Independent N(0, 1)."""
    return Part(name, size, 0, lambda h: (np.eye(size), []), repeat)


def independent(name: str, size: int, nu: float | None = 4.0) -> Part:
    """Independent N(0, exp(2 h))."""
    def covariance(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        s = math.exp(min(20.0, max(-20.0, 2 * h[0])))
        return s * np.eye(size), [2 * s * np.eye(size) * float(abs(2 * h[0]) < 20)]

    return Part(name, size, 1, covariance, 1, (nu,))


def stimuli(name: str, pieces: list[stimulus.Piece], repeat: int = 1, nu: float | None = 4.0) -> Part:
    """The pieces of a stimulus design (``functions.stimulus``), each coefficient once for every column of a temporal basis."""
    return Part(name, len(pieces[0].loads), sum(p.hypers for p in pieces), lambda h: stimulus.covariance(pieces, h), repeat, (nu,) * sum(p.hypers for p in pieces))


class Composed:
    """The prior of a weight vector that is made of parts, in their order."""

    def __init__(self, parts: list[Part]):
        self.parts, self.hypers, self.length = parts, sum(p.hypers for p in parts), sum(p.length for p in parts)

    def places(self):
        """(part, slice of weights, slice of hyperparameters)."""
        w = h = 0
        for p in self.parts:
            yield p, slice(w, w + p.length), slice(h, h + p.hypers)
            w, h = w + p.length, h + p.hypers

    def precision(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], float, int]:
        """Block by block; each hyperparameter's derivative of the precision is zero outside its part."""
        whole, slopes, logdet, rank = np.zeros((self.length, self.length)), [], 0.0, 0
        for p, at, own in self.places():
            block, ds, ld, r = p.precision(np.asarray(h[own]))
            whole[at, at] = block
            for d in ds:
                slopes.append(np.zeros_like(whole))
                slopes[-1][at, at] = d
            logdet, rank = logdet + ld, rank + r
        return whole, slopes, logdet, rank

    def log_prior(self, w: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log density of weights and hyperparameters, and the derivatives by both."""
        p, slopes, logdet, rank = self.precision(h)
        lp = -0.5 * w @ p @ w + 0.5 * logdet - 0.5 * rank * math.log(2 * math.pi)
        root = np.linalg.pinv(p)
        dh = np.array([-0.5 * w @ d @ w + 0.5 * np.trace(root @ d) for d in slopes])
        for part, _, own in self.places():
            value, slope = part.hyper(np.asarray(h[own]))
            lp, dh[own] = lp + value, dh[own] + slope
        return float(lp), -p @ w, dh


def all_filters(pieces: list[stimulus.Piece], columns: int, lever: int, history: int = 0, nu: float = 4.0) -> Composed:
    """Of a full linear model: stimulus filters on ``columns`` basis functions, a lever filter, with ``history`` a spike history filter, and a constant without a prior."""
    return Composed([stimuli("stimulus", pieces, columns, nu), independent("lever", lever, nu), *([independent("history", history, nu)] if history else []), free("constant", 1)])


def structured(spec: Spec, parts: dict[str, Part | None], first: int = 0) -> tuple[Prior, int]:
    """(prior, number of its hyperparameters in H from ``first`` on) of a multilinear model.

    parts: by block (``g.T0``, ``B`` ...); each column of the block has the part's density, None stands for no prior. Loads and modes that aren't named are N(0, 1), W and B have none.
    """
    known = spec.shapes()
    for k, p in parts.items():
        if k not in known or (p is not None and p.length != known[k][0]):
            raise ValueError(f"block {k} has no part of its size")
    unnamed = [k for k in known if "." in k and k not in parts]
    where, at = {}, first
    for k, p in parts.items():
        if p is not None:
            where[k] = slice(at, at + p.hypers)
            at += p.hypers

    def prior(params: Params) -> tuple[float, Params]:
        lp, out, dh = 0.0, {}, np.zeros(spec.hyper)
        for k in unnamed:
            x = params[k]
            lp -= 0.5 * float((x * x).sum()) + 0.5 * x.size * math.log(2 * math.pi)
            out[k] = -x
        for k, own in where.items():
            one, h, x = Composed([parts[k]]), params["H"][own], params[k].reshape(len(params[k]), -1)
            hyper, slope = parts[k].hyper(h)
            found = [one.log_prior(x[:, i], h) for i in range(x.shape[1])]
            lp += sum(f[0] for f in found) - (len(found) - 1) * hyper
            out[k] = np.stack([f[1] for f in found], axis=1).reshape(params[k].shape) if found else np.zeros_like(params[k])
            dh[own] += sum((f[2] for f in found), np.zeros(parts[k].hypers)) - (len(found) - 1) * slope
        return float(lp), out | {"H": dh}

    return prior, at - first
