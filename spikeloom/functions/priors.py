"""Log densities of priors with their derivatives, as columns.

Positive parameters are given by their logs, and their densities have the Jacobian of the log. Every function returns the log density
and its derivatives in the order of its arguments; a table of parameters (or of draws of them) so gets its prior and gradient in one projection, and
sums over components are group-bys (``total``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.functions.likelihood import sigmoid, softplus

#: Fixed value: clamp of the log variance.
MOST = 20.0


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def gaussian_terms(x: Column, log_sd: Column | float = 0.0, mean: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """N(mean, exp(2 log_sd)): (log density, d/dx, d/dlog_sd). Only in the variance the log is clamped."""
    h, e = _lit(log_sd), x - _lit(mean)
    inside = F.abs(2 * h) < MOST
    precision = F.exp(-F.greatest(F.lit(-MOST), F.least(F.lit(MOST), 2 * h)))
    square = e * e * precision
    return -0.5 * square - 0.5 * math.log(2 * math.pi) - h, -e * precision, F.when(inside, square).otherwise(0.0) - 1


def gaussian(x: Column, log_sd: Column | float = 0.0) -> Column:
    return gaussian_terms(x, log_sd)[0]


def half_t_terms(log_x: Column, nu: float, log_scale: Column | float = 0.0) -> tuple[Column, Column, Column, Column]:
    """Half-t density of x = exp(log_x): (log density, d/dlog_x, second d/dlog_x, d/dlog_scale); the tail is linear in log_x, without overflow."""
    const = math.log(2) + math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * nu)
    s = _lit(log_scale)
    z = 2 * (log_x - s) - math.log(nu)
    p = sigmoid(z)
    slope = 1 - (nu + 1) * p
    return const - s - (nu + 1) / 2 * softplus(z) + log_x, slope, -2 * (nu + 1) * p * (1 - p), -slope


def half_t(log_x: Column, nu: float, scale: float) -> Column:
    return half_t_terms(log_x, nu, math.log(scale))[0]


def inverse_gamma_terms(log_x: Column, a: float, b: float) -> tuple[Column, Column, Column]:
    """Inverse gamma density of x = exp(log_x): (log density, d/dlog_x, second d/dlog_x)."""
    r = b * F.exp(-log_x)
    return a * math.log(b) - math.lgamma(a) - a * log_x - r, r - a, -r


def inverse_gamma(log_x: Column, a: float, b: float) -> Column:
    return inverse_gamma_terms(log_x, a, b)[0]


def inverse_gaussian_terms(log_x: Column, mean: float, shape: float) -> tuple[Column, Column, Column]:
    """Inverse Gaussian density of x = exp(log_x): (log density, d/dlog_x, second d/dlog_x)."""
    x = F.exp(log_x)
    up, down = shape / (2 * mean * mean) * x, shape / 2 * F.exp(-log_x)
    return 0.5 * (math.log(shape) - math.log(2 * math.pi)) - 0.5 * log_x - up + shape / mean - down, -0.5 - up + down, -up - down


def slab_scale(log_local: Column, log_slab: Column | float) -> tuple[Column, Column, Column]:
    """Log standard deviation of a regularized horseshoe component, c l / sqrt(c^2 + l^2), and its derivatives by log l and log c."""
    l, c = log_local, _lit(log_slab)
    p = sigmoid(2 * (l - c))  # share of the slab
    return l - 0.5 * softplus(2 * (l - c)), 1 - p, p


def horseshoe_terms(x: Column, log_global: Column, log_mode: Column, log_local: Column, log_slab: Column | float, nu: float = 3.0) -> dict[str, Column]:
    """Regularized horseshoe of a tensor component's coefficient x, centred: N(0, sd^2) with sd the slabbed product of a global, a
    mode's and a local scale. The log density of x only; derivatives by x and all log scales.
    """
    log_sd, by_local, by_slab = slab_scale(log_global + log_mode + log_local, log_slab)
    lp, dx, dh = gaussian_terms(x, log_sd)
    return {"lp": lp, "d_x": dx, "d_global": dh * by_local, "d_mode": dh * by_local, "d_local": dh * by_local, "d_slab": dh * by_slab}


def rescaled(z: Column, log_global: Column, log_mode: Column, log_local: Column, log_slab: Column | float) -> tuple[Column, Column, Column, Column]:
    """Non-centred horseshoe: the natural coefficient z sd of a standard normal z, and its derivatives by z, by any of the log scales and by the log slab."""
    log_sd, by_local, by_slab = slab_scale(log_global + log_mode + log_local, log_slab)
    x = z * F.exp(log_sd)
    return x, F.exp(log_sd), x * by_local, x * by_slab


def hierarchical_half_t(log_local: Column, log_mode: Column, log_global: Column, nu: float = 3.0) -> dict[str, Column]:
    """Centred hierarchy of scales: local ~ t+(mode), mode ~ t+(global); the log densities' sum and derivatives by each log scale."""
    low, d_low, _, s_low = half_t_terms(log_local, nu, log_mode)
    high, d_high, _, s_high = half_t_terms(log_mode, nu, log_global)
    return {"lp": low + high, "d_local": d_low, "d_mode": s_low + d_high, "d_global": s_high}


#: Variance structures of scaled Gaussian components: which keys share a scale.
SCALE_KEYS = {"all_group": [], "group": ["component"], "std": ["mode"], "all_independent": ["component", "mode", "row"]}


def scaled_gaussian(coefficients: DataFrame, scales: DataFrame, structure: str, value: str = "x", keys: list[str] | None = None) -> DataFrame:
    """``coefficients`` (component, mode, row, ``value``) with lp, d_x, d_h of a Gaussian whose log scale h is shared as ``structure`` says.

    scales: the structure's keys and h. Scales are few (a row for each key), so they are broadcast below the session's size limit and shuffled above.
    """
    on = [*(keys or []), *SCALE_KEYS[structure]]
    joined = coefficients.join(scales.select(*on, "h"), on) if on else coefficients.crossJoin(F.broadcast(scales.select("h").limit(1)))
    lp, dx, dh = gaussian_terms(F.col(value), F.col("h"))
    return joined.withColumns({"lp": lp, "d_x": dx, "d_h": dh})


def total(terms: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sums of log densities and derivatives by ``keys``."""
    return terms.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))
