"""Fits of generalized linear and multilinear models.

Two execution modes share the small kernels below. *Distributed*: every step is one job whose partial sums (gradient and
Hessian, a few numbers) reach the driver. *Fit in task*: units (a neuron, a fold, a chain) have few bins, and one
job runs the whole optimizer or chain of every unit; a unit's Poisson sums only depend on distinct regressor rows, so equal bins
are counted first and a unit's group stays small.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.functions.likelihood import terms, third
from spikeloom.operators import model
from spikeloom.plans.by_neuron import ascent
from spikeloom.plans.gmlm import lbfgs, lockstep, log_det


def solve(hessian: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(-hessian, gradient, rcond=None)[0]


def distinct_rows(rows: DataFrame, regressors: list[Column], keys: list[str] = ()) -> DataFrame:
    """Distinct (keys, y, r0, r1, ...) with their number n, so equal bins count once; counted before the shuffle."""
    names = [f"r{i}" for i in range(len(regressors))]
    return rows.select(*keys, F.col("y").cast("double").alias("y"), *(r.cast("double").alias(n) for r, n in zip(regressors, names, strict=True))).groupBy(*keys, "y", *names).agg(F.count(F.lit(1)).cast("double").alias("n"))


def newton(rows: DataFrame, regressors: list[Column], kind: str, ridge: float = 0.0, steps: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """(parameter, estimate, se, converged) of one model for all rows: a job per step, at most regressors^2 numbers each."""
    n = len(regressors)
    data = distinct_rows(rows, regressors).persist()
    at, w, move, converged = [F.col(f"r{i}") for i in range(n)], np.zeros(n), np.zeros(n), False
    last = -np.inf
    upper = np.triu_indices(n)
    try:
        for _ in range(steps):
            value, dll, d2ll = terms(kind, model.linear(at, w.tolist()), F.col("y"))
            own = data.withColumns({"ll": value * F.col("n"), "dll": dll * F.col("n"), "d2ll": d2ll * F.col("n")})
            sums = [s or 0.0 for s in own.agg(F.sum("ll"), *(F.sum(F.col("dll") * a) for a in at), *(F.sum(F.col("d2ll") * at[i] * at[j]) for i, j in zip(*upper, strict=True))).first()]
            post = sums[0] - 0.5 * ridge * w @ w
            if not post >= last - 1e-9 * (1 + abs(last)):  # too far (or not finite): back half of the way
                move = move / 2
                w = w - move
                continue
            last, gradient, hessian = post, np.array(sums[1 : 1 + n]) - ridge * w, np.zeros((n, n))
            hessian[upper] = sums[1 + n :]
            hessian = hessian + np.triu(hessian, 1).T - ridge * np.eye(n)
            move = ascent(hessian, gradient)
            w = w + move
            if np.abs(move).max() < tolerance:
                converged = True
                break
        se = np.sqrt(np.maximum(0.0, np.diag(np.linalg.pinv(-hessian))))
    finally:
        data.unpersist()
    return rows.sparkSession.createDataFrame([(i, float(a), float(b), converged) for i, (a, b) in enumerate(zip(w, se, strict=True))], "parameter int, estimate double, se double, converged boolean")


def unit_rows(rows: DataFrame, regressors: list[Column], keys: list[str]) -> DataFrame:
    """Distinct (unit, y, regressors) with their number; counted before the shuffle."""
    return distinct_rows(rows.where("y >= 0"), regressors, keys)


def poisson(w: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Log posterior (Poisson with log rate x w, Gaussian prior), gradient and Hessian."""
    z = np.clip(x @ w, -90, 90)
    r = np.exp(z) * n
    ll = float((n * y * z - r).sum()) - 0.5 * precision * float(w @ w)
    return ll, x.T @ (n * y - r) - precision * w, -(x * r[:, None]).T @ x - precision * np.eye(len(w))


def maximum(x, y, n, precision: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """Newton with step halving."""
    w = np.zeros(x.shape[1])
    ll, g, h = poisson(w, x, y, n, precision)
    for _ in range(steps):
        move, t = solve(h, g), 1.0
        while t > 1e-6 and poisson(w + t * move, x, y, n, precision)[0] < ll:
            t /= 2
        w = w + t * move
        last, (ll, g, h) = ll, poisson(w, x, y, n, precision)
        if abs(ll - last) < 1e-10 * (1 + abs(ll)):
            break
    return w, ll, h


def _per_unit(rows: DataFrame, regressors: list[Column], keys: list[str], fit, schema: str) -> DataFrame:
    own, names = unit_rows(rows, regressors, keys), [f"r{i}" for i in range(len(regressors))]
    types = dict(own.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit(pdf[names].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy(), key)
        for name, value in zip(reversed(keys), reversed(key), strict=True):
            out.insert(0, name, value)
        return out

    return own.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema)


def unit_fits(rows: DataFrame, regressors: list[Column], keys: list[str], precision: float = 0.1) -> DataFrame:
    """Maximum a posteriori weights of every unit: (unit, parameter, estimate, log_post)."""
    def fit(x, y, n, key):
        w, ll, _ = maximum(x, y, n, precision)
        return pd.DataFrame({"parameter": np.arange(len(w)), "estimate": w, "log_post": ll})

    return _per_unit(rows, regressors, keys, fit, "parameter bigint, estimate double, log_post double")


def cross_validate(rows: DataFrame, regressors: list[Column], fold: str, folds: int, precision: float = 1e-3, steps: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """(held, train_ll, test_ll, converged): each fold is left out once. Rows with a null fold take no part.

    All fits go side by side: a step is one job that sums every fit's gradient and curvature over the rows of the other folds, where they lie. Log
    posteriors are those of ``poisson``.
    """
    k = len(regressors)
    data = distinct_rows(rows.where(F.col(fold).isNotNull() & (F.col("y") >= 0)), regressors, [fold]).persist()
    w, open_, scale = np.zeros((folds, k)), set(range(folds)), np.ones(folds)
    last, moves, converged = np.full(folds, -np.inf), np.zeros((folds, k)), np.zeros(folds, bool)

    def sums_of(fits: list[int], more: bool) -> np.ndarray:
        """For each fit the log likelihood of the rows it sees and of the others, and with ``more`` gradient and curvature; a task sums its rows first."""
        weights = w[fits]

        def run(batches):
            total = np.zeros((len(fits), 2 + (k + k * k) * more))
            for b in batches:
                at, y, *x, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                x = np.stack(x, axis=1)
                for i, h in enumerate(fits):
                    z = np.clip(x @ weights[i], -90, 90)
                    r, seen = np.exp(z) * n, at != h
                    ll = n * y * z - r
                    total[i, :2] += ll[seen].sum(), ll[~seen].sum()
                    if more:
                        own = x[seen]
                        total[i, 2 : 2 + k] += own.T @ (n * y - r)[seen]
                        total[i, 2 + k :] += ((own * r[seen, None]).T @ own).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

        own = data.select(F.col(fold).cast("double"), "y", *(f"r{i}" for i in range(k)), "n")
        found = own.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy()
        return found.reshape(len(fits), -1) if len(found) else np.zeros((len(fits), 2 + (k + k * k) * more))

    try:
        for _ in range(steps):
            fits = sorted(open_)
            if not fits:
                break
            for h, s in zip(fits, sums_of(fits, True), strict=True):
                post = s[0] - 0.5 * precision * w[h] @ w[h]
                if post < last[h] - 1e-9 * (1 + abs(last[h])):  # too far: back half of the way
                    scale[h] /= 2
                    w[h] -= scale[h] * moves[h]
                    continue
                if post - last[h] < tolerance * (1 + abs(post)):
                    open_.discard(h)
                    converged[h] = True
                last[h], scale[h] = post, 1.0
                moves[h] = solve(-s[2 + k :].reshape(k, k) - precision * np.eye(k), s[2 : 2 + k] - precision * w[h])
                if h in open_:
                    w[h] = w[h] + moves[h]
        found = sums_of(list(range(folds)), False)
    finally:
        data.unpersist()
    out = [(h, float(found[h, 0] - 0.5 * precision * w[h] @ w[h]), float(found[h, 1]), bool(converged[h])) for h in range(folds)]
    return rows.sparkSession.createDataFrame(out, "held bigint, train_ll double, test_ll double, converged boolean")


def evidence(rows: DataFrame, regressors: list[Column], keys: list[str], grid: int = 13) -> DataFrame:
    """(unit, precision, log_evidence): the Gaussian prior's precision with the greatest Laplace evidence, by a golden section."""
    def fit(x, y, n, key):
        def value(h: float) -> float:
            w, lp, hess = maximum(x, y, n, np.exp(h))
            return lp + 0.5 * len(w) * h - 0.5 * log_det(-hess)

        a, b, g = -4.0, 6.0, (np.sqrt(5) - 1) / 2
        c, d = b - g * (b - a), a + g * (b - a)
        fc, fd = value(c), value(d)
        for _ in range(grid):
            if fc > fd:
                b, d, fd = d, c, fc
                c = b - g * (b - a)
                fc = value(c)
            else:
                a, c, fc = c, d, fd
                d = a + g * (b - a)
                fd = value(d)
        return pd.DataFrame({"precision": [float(np.exp((a + b) / 2))], "log_evidence": [max(fc, fd)]})

    return _per_unit(rows, regressors, keys, fit, "precision double, log_evidence double")


#: Gives a prior's covariance for hyperparameters h, and its derivatives by each of them.
Covariance = Callable[[np.ndarray], tuple[np.ndarray, list[np.ndarray]]]


def group_covariance(sizes: list[int]) -> Covariance:
    """Independent coefficients, each group of columns with its own log standard deviation."""
    of = np.repeat(np.arange(len(sizes)), sizes)

    def covariance(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        s = np.diag(np.exp(2 * h[of]))
        return s, [2 * s * (of == g) for g in range(len(sizes))]

    return covariance


def precision_of(covariance: Covariance) -> Callable:
    """h -> (precision, its derivatives, log determinant, rank) of a covariance; a singular one counts on its range."""
    def precision(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], float, int]:
        s, slopes = covariance(h)
        values, vectors = np.linalg.eigh(s)
        kept = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
        inverse = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T
        return inverse, [-inverse @ d @ inverse for d in slopes], -float(np.log(values[kept]).sum()), int(kept.sum())

    return precision


class Evidence:
    """Laplace evidence of a model of any likelihood under a Gaussian prior whose covariance has hyperparameters, and its gradient by them.

    The inner fit is a distributed Newton; one more job gives what the curvature's own change with the mode adds, by the likelihood's third derivative, so the gradient is
    exact. ``covariance`` gives covariance and derivatives, or has a method ``precision`` (as ``filters.Composed``), where coefficients may be without a prior.
    """

    def __init__(self, rows: DataFrame, regressors: list[Column], covariance: Covariance, kind: str = "poiss_exp", dt: float = 1.0, scale: float = 0.5):
        self.k, self.kind, self.dt, self.scale = len(regressors), kind, dt, scale
        self.precision = getattr(covariance, "precision", None) or precision_of(covariance)
        self.data = distinct_rows(rows if kind == "sq_err" else rows.where("y >= 0"), regressors).persist()
        self.at, self.w = [F.col(f"r{i}") for i in range(self.k)], np.zeros(self.k)
        self.upper = np.triu_indices(self.k)

    def close(self) -> None:
        self.data.unpersist()

    def _sums(self, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        ll, slope, bend = terms(self.kind, model.linear(self.at, w.tolist()), F.col("y"), self.dt, self.scale)
        own = self.data.withColumns({"ll": ll * F.col("n"), "slope": slope * F.col("n"), "bend": -bend * F.col("n")})
        got = [v or 0.0 for v in own.agg(F.sum("ll"), *(F.sum(F.col("slope") * a) for a in self.at), *(F.sum(F.col("bend") * self.at[i] * self.at[j]) for i, j in zip(*self.upper, strict=True))).first()]
        curve = np.zeros((self.k, self.k))
        curve[self.upper] = got[1 + self.k :]
        return got[0], np.array(got[1 : 1 + self.k]), curve + np.triu(curve, 1).T

    def fit(self, h: np.ndarray, steps: int = 50, tolerance: float = 1e-10) -> tuple[np.ndarray, float, np.ndarray]:
        """Maximum a posteriori weights, the log posterior there, and the log likelihood's curvature."""
        prior, _, logdet, rank = self.precision(h)
        constant = 0.5 * logdet - 0.5 * rank * np.log(2 * np.pi)
        w, last, move = self.w, -np.inf, np.zeros(self.k)
        for _ in range(steps):
            ll, g, curve = self._sums(w)
            post = ll - 0.5 * w @ prior @ w + constant
            if not post >= last - 1e-9 * (1 + abs(last)):
                move = move / 2
                w = w - move
                continue
            if post - last < tolerance * (1 + abs(post)):
                break
            last, move = post, ascent(-curve - prior, g - prior @ w)
            w = w + move
        self.w = w  # the next fit starts here
        return w, post, curve

    def value(self, h: np.ndarray) -> tuple[float, np.ndarray]:
        prior, slopes, _, _ = self.precision(h)
        w, post, curve = self.fit(h)
        whole = np.linalg.inv(curve + prior)
        evidence = post + 0.5 * self.k * np.log(2 * np.pi) - 0.5 * log_det(curve + prior)
        moves = [-whole @ b @ w for b in slopes]  # of the mode
        leverage = sum((float(whole[i, j]) * self.at[i] * self.at[j] for i in range(self.k) for j in range(self.k)), F.lit(0.0))
        change = -third(self.kind, model.linear(self.at, w.tolist()), F.col("y"), self.dt) * F.col("n")
        own = self.data.withColumn("change", change * leverage)
        bends = own.agg(*(F.sum(F.col("change") * model.linear(self.at, m.tolist())) for m in moves)).first() if moves else []
        root = np.linalg.pinv(prior)
        grad = [0.5 * np.trace(root @ b) - 0.5 * w @ b @ w - 0.5 * np.trace(whole @ b) - 0.5 * (bend or 0.0) for b, bend in zip(slopes, bends, strict=True)]
        return float(evidence), np.array(grad)

    def maximum(self, h: np.ndarray, **options) -> dict:
        """Hyperparameters of the greatest evidence: h, value, steps, converged, and the weights there."""
        found = lockstep([lbfgs(h, **options)], lambda _, points: [self.value(x) for x in points])[0]
        w, *_ = self.fit(found["x"])
        return {"h": found["x"], "value": found["value"], "steps": found["steps"], "converged": found["converged"], "w": w}


def evidence_cross_validated(rows: DataFrame, regressors: list[Column], covariance: Covariance, h: np.ndarray, fold: str, folds: int, kind: str = "poiss_exp", **options) -> list[dict]:
    """For each fold the evidence's hyperparameters and weights without it, and its held-out log likelihood. Rows without a fold take no part."""
    out = []
    for k in range(folds):
        own = Evidence(rows.where(F.col(fold).isNotNull() & (F.col(fold) != k)), regressors, covariance, kind)
        held = Evidence(rows.where(F.col(fold) == k), regressors, covariance, kind)
        try:
            found = own.maximum(h, **options)
            out.append({"held": k, **found, "test_ll": float(held._sums(found["w"])[0])})
        finally:
            own.close()
            held.close()
    return out


def hmc(rows: DataFrame, regressors: list[Column], keys: list[str], warmup: int = 60, keep: int = 40, precision: float = 0.1, seed: int = 1) -> DataFrame:
    """(unit, iter, parameter, value, accepted): Hamiltonian draws of every unit's weights, a chain per task.

    The mass matrix is the curvature at the mode; the step size adapts by dual averaging while warming up. Streams are keyed by
    seed and unit, so results don't depend on partitions.
    """
    def fit(x, y, n, key):
        rng = np.random.Generator(np.random.Philox(key=[seed, zlib.crc32(repr(tuple(map(str, key))).encode())]))
        w, _, h = maximum(x, y, n, precision)
        root = np.linalg.inv(np.linalg.cholesky(-h)).T  # w = mode + root q, near unit scale
        mode, q = w, np.zeros(len(w))

        def post(q):
            lp, g, _ = poisson(mode + root @ q, x, y, n, precision)
            return lp, root.T @ g

        lp, g = post(q)
        mu, bar, hbar, eps, out = np.log(2.0), 0.0, 0.0, 0.2, []
        for it in range(warmup + keep):
            p = rng.standard_normal(len(q))
            a, lp2, g2, energy = q.copy(), lp, g, lp - 0.5 * p @ p
            for _ in range(min(50, int(np.ceil(1.5 / eps)))):
                p = p + 0.5 * eps * g2
                a = a + eps * p
                lp2, g2 = post(a)
                p = p + 0.5 * eps * g2
            change = lp2 - 0.5 * p @ p - energy
            rate = min(1.0, np.exp(min(0.0, change))) if np.isfinite(change) and abs(change) < 1e3 else 0.0
            if took := rng.random() < rate:
                q, lp, g = a, lp2, g2
            if it < warmup:
                hbar += (0.8 - rate - hbar) / (it + 11)
                log_eps = mu - np.sqrt(it + 1) / 0.05 * hbar
                weight = (it + 1) ** -0.75
                bar = weight * log_eps + (1 - weight) * bar
                eps = float(np.exp(np.clip(log_eps if it + 1 < warmup else bar, -7, 1)))
            else:
                out.append((it - warmup, mode + root @ q, took))
        return pd.DataFrame({"iter": np.repeat([o[0] for o in out], len(w)), "parameter": np.tile(np.arange(len(w)), len(out)), "value": np.concatenate([o[1] for o in out]), "accepted": np.repeat([bool(o[2]) for o in out], len(w))})

    return _per_unit(rows, regressors, keys, fit, "iter bigint, parameter bigint, value double, accepted boolean")


def alternating_rank1(rows: DataFrame, events: DataFrame, times: int, features: int, sweeps: int = 30, ridge: float = 1.0, tolerance: float = 1e-4) -> DataFrame:
    """(mode, ix, value, converged): rank-one tensor group t[ix] u[feature] on top of the log rate x, by alternating Poisson Newton steps.

    Each conditional model is a GLM with a one-hot regressor, whose gradient and diagonal curvature are sums by index; a job for
    each half step. After each sweep the magnitude is spread evenly over both modes. Ends when no value moves by more than ``tolerance``.
    """
    keys = ["neuron", "trial", "bin"]
    own = events.where("ix >= 0").select(*keys, "ix", "feature")
    joined = rows.join(own.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ix", "feature"))).alias("e")), keys)
    data = joined.groupBy("x", "y", "e").agg(F.count(F.lit(1)).alias("n")).persist()  # equal bins count once
    modes, converged = {"ix": np.full(times, 0.1), "feature": np.full(features, 0.1)}, False
    try:
        for _ in range(sweeps):
            before = {m: v.copy() for m, v in modes.items()}
            for mine, other in (("ix", "feature"), ("feature", "ix")):
                def value(m, i):
                    return F.get(F.array(*(F.lit(float(v)) for v in modes[m])), i)

                rate = F.col("x") + F.aggregate("e", F.lit(0.0), lambda a, s: a + value("ix", s["ix"]) * value("feature", s["feature"]))
                spread = data.withColumn("r", F.exp(F.least(rate, F.lit(30.0)))).select("n", "y", "r", F.explode("e").alias("s"))
                weight = value(other, F.col(f"s.{other}"))
                sums = spread.groupBy(F.col(f"s.{mine}").alias("i")).agg(F.sum(F.col("n") * (F.col("y") - F.col("r")) * weight).alias("g"), F.sum(F.col("n") * F.col("r") * weight * weight).alias("h")).toPandas()
                at = sums["i"].to_numpy(int)
                modes[mine][at] += np.clip((sums["g"] - ridge * modes[mine][at]) / (sums["h"] + ridge), -0.5, 0.5)
            a, b = (float(np.linalg.norm(m)) for m in modes.values())
            if a > 0 and b > 0:
                modes["ix"] *= np.sqrt(b / a)
                modes["feature"] *= np.sqrt(a / b)
            if max(np.abs(modes[m] - before[m]).max() for m in modes) < tolerance:
                converged = True
                break
    finally:
        data.unpersist()
    found = [(m, i, float(v), converged) for m, values in modes.items() for i, v in enumerate(values)]
    return rows.sparkSession.createDataFrame(found, "mode string, ix int, value double, converged boolean")
