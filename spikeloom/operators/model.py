"""Rates, likelihood sums and gradients of the generalized linear and multilinear models, as one plan each.

Parameters are small dense arrays that become literals of the plan, so products with them happen before any join: a
factor's rows are a table by index, gathered by an equality join (or by element of an array), and an index out of range
gives 0. Gradients are partial sums, aggregated before the small products that the driver adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.functions.likelihood import lgamma_count, terms

TRIAL = ["neuron", "trial"]


def linear(columns: list[Column], weights: list[float]) -> Column:
    return sum((c * float(w) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))


def gather(index: Column, rows: list[float]) -> Column:
    """Element ``index`` (0-based) of a factor's column; 0 out of range."""
    return F.when((index >= 0) & (index < len(rows)), F.get(F.array(*(F.lit(float(v)) for v in rows)), index)).otherwise(0.0)


def with_terms(rows: DataFrame, kind: str, dt: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    ll, dll, d2ll = terms(kind, F.col(x), F.col(y), dt)
    return rows.withColumns({"ll": ll, "dll": dll, "d2ll": d2ll})


def trial_sums(rows: DataFrame, kind: str, what: str = "ll", dt: float = 1.0, normalize: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Sum over the bins of each trial; ``normalize`` adds -log(y!) for the Poisson kinds."""
    term = F.col(what)
    if normalize:
        term = term - F.when(F.col("y") >= 0, lgamma_count(F.col("y"))).otherwise(0.0)
    return with_terms(rows, kind, dt).groupBy(*(keys or TRIAL)).agg(F.sum(term).alias(what))


def weighted(sums: DataFrame, weights: DataFrame, what: str = "ll") -> DataFrame:
    """Trial sums times trial weights; a trial without a weight has 1, one with weight 0 is left out."""
    return sums.join(weights, TRIAL, "left").withColumn("w", F.coalesce("w", F.lit(1.0))).where("w <> 0").withColumn(what, F.col(what) * F.col("w"))


def gradient(rows: DataFrame, regressors: list[Column], keys: list[str]) -> DataFrame:
    """g0, g1, ...: sums of dll times each regressor by ``keys``; needs dll."""
    return rows.groupBy(*keys).agg(*(F.sum(F.col("dll") * r).alias(f"g{i}") for i, r in enumerate(regressors)))


def hessian(rows: DataFrame, regressors: list[Column]) -> DataFrame:
    """(i, j, h): sums of d2ll times products of regressors, one row per pair; needs d2ll."""
    n = len(regressors)
    sums = rows.agg(*(F.sum(F.col("d2ll") * regressors[i] * regressors[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)))
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"h{min(i, j)}_{max(i, j)}").alias("h")) for i in range(n) for j in range(n)))
    return sums.select(F.explode(pairs).alias("p")).select("p.*")

