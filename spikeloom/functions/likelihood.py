"""Log likelihoods of a bin's count given its log rate, with first and second derivatives, as columns.

x is the log rate, y the count, dt the bin width. A negative count is censored: it adds nothing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clamp of exponents, where softplus turns linear, where the truncated model turns linear.
CLAMP, LINEAR, TINY = 90.0, 30.0, -30.0


def bounded_exp(x: Column) -> Column:
    return F.exp(F.least(F.lit(CLAMP), F.greatest(F.lit(-CLAMP), x)))


def safe_exp(x: Column, most: float = CLAMP) -> Column:
    """exp, bounded above only."""
    return F.exp(F.least(F.lit(most), x))


def safe_expm1(x: Column, most: float = CLAMP) -> Column:
    return F.expm1(F.least(F.lit(most), x))


def softplus(x: Column) -> Column:
    return F.when(x > LINEAR, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(LINEAR)))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + bounded_exp(-x))


#: log(n!) of small whole numbers.
LOG_FACTORIAL = [math.lgamma(n + 1.0) for n in range(32)]


def log_gamma(x: Column) -> Column:
    """log Gamma of x >= 32, by Stirling's series (its error there is below 1e-15)."""
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))


def lgamma_count(y: Column) -> Column:
    """log(y!) of a whole number, in constant time: Spark has no log-gamma."""
    n = F.floor(F.greatest(y, F.lit(0.0))).cast("double")
    small = F.get(F.array(*(F.lit(v) for v in LOG_FACTORIAL)), F.least(n, F.lit(31.0)).cast("int"))
    return F.when(n < len(LOG_FACTORIAL), small).otherwise(log_gamma(F.greatest(n, F.lit(31.0)) + 1))


def _poisson(x, y, dt):
    z, k = x + F.log(dt), F.floor(y).cast("double")
    r = bounded_exp(z)
    return k * z - r, k - r, -r


def _softplus(x, y, dt):
    k, s, p = F.floor(y).cast("double"), softplus(x), sigmoid(x)
    slope = p * (1 - p)
    return k * (F.log(s) + F.log(dt)) - s * dt, p * (k / s - dt), slope * (k / s - dt) - k * (p / s) * (p / s)


def _truncated(x, y, dt):
    z = x + F.log(dt)
    r = bounded_exp(z)
    ratio = F.when(z <= TINY, F.lit(1.0)).otherwise(r / F.expm1(r))
    hit = F.when(z <= TINY, z).otherwise(F.log(-F.expm1(-r)))
    some = y >= 1
    second = F.when(z <= TINY, F.lit(0.0)).otherwise(ratio * (1 - r - ratio))
    return F.when(some, hit).otherwise(-r), F.when(some, ratio).otherwise(-r), F.when(some, second).otherwise(-r)


def _refractory(x, y, dt):
    z, k = x + F.log(dt), F.floor(y).cast("double")
    r = (1 - k / 2) * bounded_exp(z)
    return k * z - r, k - r, -r


def _squared(x, y, dt, scale: float = 0.5):
    return -scale * (x - y) * (x - y), 2 * scale * (y - x), F.lit(-2.0 * scale)


LIKELIHOODS = {"poiss_exp": _poisson, "poiss_softrec": _softplus, "trunc_poiss": _truncated, "sq_err": _squared, "poiss_refractory": _refractory}


def terms(kind: str, x: Column, y: Column, dt: float = 1.0, scale: float = 0.5) -> tuple[Column, Column, Column]:
    """(log likelihood, derivative, second derivative) by x. Only counts can be censored: squared errors take any y.

    ``scale`` is the factor of squared errors: a half for tensor models, one for linear models.
    """
    if kind == "sq_err":
        return _squared(x, y, dt, scale)
    return tuple(F.when(y >= 0, t).otherwise(0.0) for t in LIKELIHOODS[kind](x, y, F.lit(float(dt))))


def third(kind: str, x: Column, y: Column, dt: float = 1.0) -> Column:
    """Third derivative of the log likelihood by x; censored counts have none."""
    if kind == "sq_err":
        return F.lit(0.0)
    k, z = F.floor(y).cast("double"), x + math.log(dt)
    if kind == "poiss_softrec":
        s, p = softplus(x), sigmoid(x)
        q, t = p * (1 - p), p / s
        out = q * (1 - 2 * p) * (k / s - dt) - 3 * k * t * q / s + 2 * k * t * t * t
    else:
        r = bounded_exp(z)
        out = -r
        if kind == "poiss_refractory":
            out = -(1 - k / 2) * r
        if kind == "trunc_poiss":
            ratio = r / F.expm1(r)
            bend = ratio * (1 - r - ratio)
            out = F.when(y >= 1, F.when(z <= TINY, F.lit(0.0)).otherwise(bend * (1 - r - ratio) - ratio * (r + bend))).otherwise(out)
    return F.when(y >= 0, out).otherwise(0.0)


def curvature(kind: str, x: np.ndarray, y: np.ndarray, dt: float = 1.0) -> np.ndarray:
    """Second derivative of arrays, as in ``terms``."""
    if kind == "sq_err":
        return np.full(len(x), -1.0)
    k, z = np.floor(y), x + math.log(dt)
    if kind == "poiss_softrec":
        s, p = np.where(x > LINEAR, x, np.log1p(np.exp(np.minimum(x, LINEAR)))), 1 / (1 + np.exp(np.clip(-x, -CLAMP, CLAMP)))
        out = p * (1 - p) * (k / s - dt) - k * (p / s) ** 2
    else:
        r = np.exp(np.clip(z, -CLAMP, CLAMP))
        out = -r * (1 - k / 2) if kind == "poiss_refractory" else -r
        if kind == "trunc_poiss":
            safe = np.where(z <= TINY, 1.0, np.minimum(r, 700.0))
            ratio = safe / np.expm1(safe)
            out = np.where(y >= 1, np.where(z <= TINY, 0.0, ratio * (1 - safe - ratio)), -r)
    return np.where(y >= 0, out, 0.0)


def numeric(kind: str, x: np.ndarray, y: np.ndarray, dt: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood and derivative of arrays, for blocks of bins inside a task; as in ``terms``."""
    if kind == "sq_err":
        return -0.5 * (x - y) ** 2, y - x
    k, z = np.floor(y), x + math.log(dt)
    if kind == "poiss_softrec":
        s, p = np.where(x > LINEAR, x, np.log1p(np.exp(np.minimum(x, LINEAR)))), 1 / (1 + np.exp(np.clip(-x, -CLAMP, CLAMP)))
        ll, dll = k * (np.log(s) + math.log(dt)) - s * dt, p * (k / s - dt)
    else:
        r = np.exp(np.clip(z, -CLAMP, CLAMP))
        if kind == "trunc_poiss":
            tiny = z <= TINY
            safe = np.where(tiny, 1.0, np.minimum(r, 700.0))
            hit, slope = np.where(tiny, z, np.log(-np.expm1(-safe))), np.where(tiny, 1.0, r / np.expm1(safe))
            ll, dll = np.where(y >= 1, hit, -r), np.where(y >= 1, slope, -r)
        else:
            r = r * (1 - k / 2) if kind == "poiss_refractory" else r
            ll, dll = k * z - r, k - r
    seen = y >= 0
    return np.where(seen, ll, 0.0), np.where(seen, dll, 0.0)
