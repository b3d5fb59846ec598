"""Horseshoe priors of tensor groups, of weights and of linear coefficients, for the models of ``plans.gmlm``.

Hyperparameters are logs of positive scales in the block H. A *scaling* turns standard coefficients into natural ones (forward) and takes derivatives back
(backward), so the sampler moves in the non-centred space; the matching prior has N(0, 1) coefficients and half-t or inverse-gamma scales.
Everything here is as large as the parameters: bins are never touched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from spikeloom.plans.gmlm import Group, Params, Spec


def half_t(log_x: np.ndarray, nu: float, log_scale: np.ndarray | float = 0.0) -> tuple[float, np.ndarray]:
    """Sum of log densities of half-t scales given by their logs (with the Jacobian), and the derivatives by them; those by log_scale are minus that."""
    z = 2 * (log_x - log_scale) - math.log(nu)
    const = math.log(2) + math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * nu)
    p = 1 / (1 + np.exp(-np.clip(z, -90, 90)))
    return float((const - log_scale - (nu + 1) / 2 * np.logaddexp(0, z) + log_x).sum()), 1 - (nu + 1) * p


def inverse_gamma(log_x: float, a: float, b: float) -> tuple[float, float]:
    r = b * math.exp(-log_x)
    return a * math.log(b) - math.lgamma(a) - a * log_x - r, r - a


@dataclass
class Scales:
    """Layout in H of one group: log c^2 of the slab, the global scale, one scale for each component, then local scales by V and mode, row (or row group) and component."""

    spec: Spec
    group: Group
    first: int = 0
    tied: dict[str, np.ndarray] = field(default_factory=dict)  # block -> the row group of each row: rows of one group share a local scale
    hierarchical: bool = False  # local scales spread around their component's, which spread around the global one
    nu: float = 3.0
    slab: tuple[float, float] = (2.0, 2.0)
    offset: float = 0.0  # log of a constant scale

    @property
    def blocks(self) -> list[str]:
        return [f"{self.group.name}.V", *(f"{self.group.name}.T{s}" for s in range(len(self.group.modes)))]

    def rows(self, block: str) -> np.ndarray:
        return self.tied.get(block, np.arange(self.spec.shapes()[block][0]))

    @property
    def size(self) -> int:
        return 2 + self.group.rank + sum((int(self.rows(b).max(initial=-1)) + 1) * self.group.rank for b in self.blocks)

    def split(self, h: np.ndarray) -> tuple[float, float, np.ndarray, dict[str, np.ndarray]]:
        """log c^2, log global, log component scales [R], log local scales [rows, R] by block."""
        h, r = h[self.first : self.first + self.size], self.group.rank
        out, at = {}, 2 + r
        for b in self.blocks:
            n = int(self.rows(b).max(initial=-1)) + 1
            out[b] = h[at : at + n * r].reshape(n, r, order="F")
            at += n * r
        return float(h[0]), float(h[1]), h[2 : 2 + r], out

    def log_sd(self, h: np.ndarray, block: str) -> tuple[np.ndarray, np.ndarray]:
        """Log standard deviations [rows, R] of a block's coefficients, and the slab's share in them: sd^2 = s^2 c^2 / (s^2 + c^2)."""
        c2, tau, phi, local = self.split(h)
        log_s2 = 2 * (self.offset + (0.0 if self.hierarchical else tau + phi) + local[block])[self.rows(block)]
        return 0.5 * (log_s2 + c2 - np.logaddexp(c2, log_s2)), 1 / (1 + np.exp(np.clip(c2 - log_s2, -90, 90)))

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        """Hyperparameters from near their prior's middle."""
        h = 0.1 * rng.standard_normal(self.size)
        h[0] = math.log(self.slab[1] / (self.slab[0] + 1))
        return h

    def pulled(self, h: np.ndarray, by: Params) -> np.ndarray:
        """Derivatives by H out of those by the log standard deviations of coefficients."""
        r, at = self.group.rank, 2 + self.group.rank
        out = np.zeros(self.spec.hyper)
        part = out[self.first : self.first + self.size]
        for b in self.blocks:
            n = int(self.rows(b).max(initial=-1)) + 1
            if b in by:
                slab = self.log_sd(h, b)[1]
                local = np.zeros((n, r))
                np.add.at(local, self.rows(b), by[b] * (1 - slab))
                part[0] += 0.5 * (by[b] * slab).sum()
                if not self.hierarchical:
                    part[1] += local.sum()
                    part[2 : 2 + r] += local.sum(axis=0)
                part[at : at + n * r] += local.ravel(order="F")
            at += n * r
        return out

    # the non-centred form

    def forward(self, params: Params) -> Params:
        return params | {b: params[b] * np.exp(self.log_sd(params["H"], b)[0]) for b in self.blocks}

    def backward(self, params: Params, grads: Params) -> Params:
        """Derivatives by standard coefficients and H out of those by natural ones."""
        out = {b: grads[b] * np.exp(self.log_sd(params["H"], b)[0]) for b in self.blocks if b in grads}
        dh = grads.get("H", 0.0) + self.pulled(params["H"], {b: g * params[b] for b, g in out.items()})
        return {**grads, **out, "H": dh}

    def prior(self, params: Params) -> tuple[float, Params]:
        """Log density of standard coefficients and scales."""
        h, r = params["H"], self.group.rank
        c2, tau, phi, local = self.split(h)
        part = np.zeros(self.size)
        lp, part[0] = inverse_gamma(c2, *self.slab)
        v, d = half_t(np.array([tau]), self.nu)
        lp, part[1] = lp + v, part[1] + d[0]
        v, d = half_t(phi, self.nu, tau if self.hierarchical else 0.0)
        lp += v
        part[2 : 2 + r] += d
        if self.hierarchical:
            part[1] -= d.sum()
        out, at = {}, 2 + r
        for b in self.blocks:
            v, d = half_t(local[b], self.nu, np.broadcast_to(phi, local[b].shape) if self.hierarchical else 0.0)
            lp += v - 0.5 * float((params[b] ** 2).sum()) - params[b].size * 0.5 * math.log(2 * math.pi)
            part[at : at + d.size] += d.ravel(order="F")
            if self.hierarchical:
                part[2 : 2 + r] -= d.sum(axis=0)
            at += d.size
            out[b] = -params[b]
        dh = np.zeros(self.spec.hyper)
        dh[self.first : self.first + self.size] = part
        return lp, out | {"H": dh}

    # the centred form

    def centred(self, params: Params) -> tuple[float, Params]:
        """Log density of natural coefficients and scales, with derivatives by both."""
        sd = {b: self.log_sd(params["H"], b)[0] for b in self.blocks}
        standard = params | {b: params[b] * np.exp(-sd[b]) for b in self.blocks}
        lp, grads = self.prior(standard)
        dh = grads["H"] + self.pulled(params["H"], {b: standard[b] ** 2 - 1 for b in self.blocks})
        return lp - sum(float(v.sum()) for v in sd.values()), {b: grads[b] * np.exp(-sd[b]) for b in self.blocks} | {"H": dh}


@dataclass
class BlockScale:
    """Non-centred N(0, exp(2 h)) of one block (history weights B, or W around a mean), with one log scale for each row group in H; half-t scales."""

    spec: Spec
    block: str
    first: int
    tied: np.ndarray | None = None
    nu: float = 4.0
    mean: bool = False  # the block's first hyperparameter is the mean of all coefficients

    @property
    def rows(self) -> np.ndarray:
        return self.tied if self.tied is not None else np.zeros(self.spec.shapes()[self.block][0], int)

    @property
    def size(self) -> int:
        return int(self.rows.max(initial=-1)) + 1 + self.mean

    def _h(self, params: Params) -> tuple[float, np.ndarray]:
        h = params["H"][self.first : self.first + self.size]
        spread = h[int(self.mean) :][self.rows]
        return float(h[0]) if self.mean else 0.0, spread.reshape(-1, *[1] * (params[self.block].ndim - 1))

    def forward(self, params: Params) -> Params:
        mean, h = self._h(params)
        return params | {self.block: mean + params[self.block] * np.exp(h)}

    def backward(self, params: Params, grads: Params) -> Params:
        dh, out = grads.get("H", np.zeros(self.spec.hyper)).copy(), dict(grads)
        if self.block in grads:
            _, h = self._h(params)
            out[self.block] = grads[self.block] * np.exp(h)
            by = (out[self.block] * params[self.block]).reshape(len(self.rows), -1).sum(axis=1)
            np.add.at(dh, self.first + int(self.mean) + self.rows, by)
            if self.mean:
                dh[self.first] += grads[self.block].sum()
        return out | {"H": dh}

    def prior(self, params: Params) -> tuple[float, Params]:
        h = params["H"][self.first : self.first + self.size]
        lp, d = half_t(h[int(self.mean) :], self.nu)
        dh = np.zeros(self.spec.hyper)
        dh[self.first + int(self.mean) : self.first + self.size] = d
        if self.mean:  # N(0, 1) on the mean
            lp -= 0.5 * h[0] ** 2 + 0.5 * math.log(2 * math.pi)
            dh[self.first] = -h[0]
        x = params[self.block]
        return lp - 0.5 * float((x**2).sum()) - x.size * 0.5 * math.log(2 * math.pi), {self.block: -x, "H": dh}


def chain(scalings: list) -> tuple:
    """(forward, backward) of several scalings of different blocks."""
    def forward(params: Params) -> Params:
        for s in scalings:
            params = s.forward(params)
        return params

    def backward(params: Params, grads: Params) -> Params:
        for s in scalings:
            grads = s.backward(params, grads)
        return grads

    return forward, backward


def group_priors(spec: Spec, covariances: dict[str, np.ndarray]) -> list:
    """Priors of named groups: a mode with a covariance gets it, all other modes, loads, weights and linear coefficients are N(0, 1)."""
    from spikeloom.plans.gmlm import covariance_prior, gaussian_prior

    plain = {k: 0.0 for k in spec.shapes() if k not in covariances and k != "H"}
    return [gaussian_prior(plain), *(covariance_prior(k, c) for k, c in covariances.items())]
