"""Model comparison over draws of trial log likelihoods."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spikeloom.sources.trials import shared_folder


def log_sum_exp(rows: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """lse and lme (log of sum and mean of exponentials) by ``keys``; NaN and null are left out, maxima are shifted out."""
    own = rows.where(F.col(x).isNotNull() & ~F.isnan(x)).withColumn("_max", F.max(x).over(W.partitionBy(*keys)))
    out = own.groupBy(*keys).agg(F.max("_max").alias("m"), F.sum(F.exp(F.col(x) - F.col("_max"))).alias("s"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, (F.col("m") + F.log("s")).alias("lse"), (F.col("m") + F.log(F.col("s") / F.col("n"))).alias("lme"))


def log_sum_exp_pair(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)); one missing side leaves the other."""
    both = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    return F.coalesce(F.when(a == b, a + math.log(2)).otherwise(both), a, b)


def log_mean_exp(values: Column) -> Column:
    """Of an array."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)) / F.size(values))


def waic(draws: DataFrame, ll: str, keys: list[str]) -> DataFrame:
    """- log mean exp(ll) + var(ll) of each unit, out of one group-by; null for a single draw, which has no variance."""
    own = draws.groupBy(*keys).agg(F.collect_list(ll).alias("_all"), F.var_samp(ll).alias("_v"))
    return own.select(*keys, (F.col("_v") - log_mean_exp(F.col("_all"))).alias("waic"))


#: Values of a unit that are ordered in one place.
FEW = 4096
#: Bins of a unit in each round of ``ranked_values``.
BINS = 256


def percentiles(rows: DataFrame, x: str, keys: list[str], qs: list[float], few: int = FEW) -> DataFrame:
    """q0, q1, ...: quantiles by ``keys`` where the k-th of n values is the quantile (k - 0.5) / n, linear between, constant outside.

    Equal values are counted first. Units of up to ``few`` different values are ordered by a window; if there are larger ones, the values at the ranks in question are found by
    counts in bins (``ranked_values``), so no row or task holds a unit's values. Both are exact.
    """
    values = rows.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    totals = values.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_many"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    at = [F.greatest(F.lit(1.0), F.least(F.col("_total").cast("double"), q * F.col("_total") + 0.5)) for q in qs]
    low = [F.floor(a).cast("bigint") for a in at]
    high = [F.least(b + 1, F.col("_total")) for b in low]
    if (totals.agg(F.max("_many")).first()[0] or 0) <= few:
        unit = W.partitionBy(*keys)
        upto = values.select(*keys, "_x", F.sum("_n").over(unit).alias("_total"), F.sum("_n").over(unit.orderBy("_x")).alias("_upto"))
        ranks = [F.min(F.when(F.col("_upto") >= r, F.col("_x"))).alias(f"_{n}{i}") for n, rs in (("b", low), ("t", high)) for i, r in enumerate(rs)]
        own = upto.groupBy(*keys, "_total").agg(*ranks)
        pairs = [(F.col(f"_b{i}"), F.col(f"_t{i}")) for i in range(len(qs))]
    else:
        wanted = F.explode(F.array_distinct(F.array(*low, *high))).alias("_rank")
        found = ranked_values(values, totals.select(*keys, "_low", "_high", wanted), keys)
        own = totals.join(found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at")), keys)  # two entries a quantile
        pairs = [(F.element_at("_at", b), F.element_at("_at", t)) for b, t in zip(low, high, strict=True)]
    return own.select(*keys, *((v + (u - v) * (a - b)).alias(f"q{i}") for i, (a, b, (v, u)) in enumerate(zip(at, low, pairs, strict=True))))


def ranked_values(values: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, _rank, _x): the values at wanted ranks. values: ``keys``, _x, _n (how often). wanted: ``keys``, _rank, _low, _high (of the unit).

    Each round counts the values between a rank's bounds in BINS bins, whose one that has the rank gives the next bounds; when BINS different values are left at most, they are ordered.
    """
    spark, place = values.sparkSession, [*keys, "_rank"]
    wanted = wanted.withColumn("_before", F.lit(0).cast("bigint"))
    while True:
        inside = values.join(wanted, keys).where(F.col("_x").between(F.col("_low"), F.col("_high")))
        size = F.col("_high") - F.col("_low")
        b = F.when(size > 0, F.least(F.lit(BINS - 1), F.floor((F.col("_x") - F.col("_low")) / size * BINS))).otherwise(0).cast("int")
        counted = inside.groupBy(*place, "_before", b.alias("_bin")).agg(F.sum("_n").alias("_c"), F.count(F.lit(1)).alias("_many"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        before = F.col("_before") + F.sum("_c").over(W.partitionBy(*place).orderBy("_bin")) - F.col("_c")  # over BINS rows at most
        hit = counted.select(*place, before.alias("_before"), "_c", "_many", "_low", "_high").where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_c"))).drop("_c")
        hit.write.parquet(path := shared_folder(spark, "ranks"))
        wanted = spark.read.schema(hit.schema).parquet(path)
        if (wanted.agg(F.max("_many")).first()[0] or 0) <= BINS:
            break
        wanted = wanted.drop("_many")
    inside = values.join(wanted.drop("_many"), keys).where(F.col("_x").between(F.col("_low"), F.col("_high")))
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*place).orderBy("_x"))
    return inside.select(*place, "_x", upto.alias("_upto")).where(F.col("_upto") >= F.col("_rank")).groupBy(*place).agg(F.min("_x").alias("_x"))


def ellipse(cc: Column, cs: Column, ss: Column) -> dict[str, Column]:
    """Axes, area and angle (degrees, of the longer axis in the plane of cosine and sine) of c cos + s sin, from the inner products of the vectors c and s."""
    middle, spread = (cc + ss) / 2, F.sqrt((cc - ss) * (cc - ss) / 4 + cs * cs)
    major, minor = F.sqrt(middle + spread), F.sqrt(F.greatest(middle - spread, F.lit(0.0)))
    return {"major": major, "minor": minor, "area": math.pi * major * minor, "angle": F.degrees(F.atan2(2 * cs, cc - ss)) / 2}


def tail_size(n: int) -> int:
    return math.ceil(min(0.2 * n, 3 * math.sqrt(n)))


def tail(draws: DataFrame, ll: str, keys: list[str], n: int) -> DataFrame:
    """The draws with the largest importance log weights lw = -ll; ties go to the smaller draw."""
    lw = -F.col(ll)
    order = W.partitionBy(*keys).orderBy(F.desc(F.round(lw, 9)), "draw")
    return draws.withColumn("lw", lw).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= tail_size(n)).drop("_k")


def circular_mean(rows: DataFrame, angle: Column, weight: Column, keys: list[str]) -> DataFrame:
    """Mean direction in degrees; units without any direction are left out."""
    out = rows.groupBy(*keys).agg(F.sum(weight * F.sin(angle)).alias("s"), F.sum(weight * F.cos(angle)).alias("c"))
    return out.where(F.abs("s") + F.abs("c") > 1e-6).select(*keys, F.degrees(F.atan2("s", "c")).alias("angle"))


def pareto_fit(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalized Pareto distribution of ascending x > 0, by the profile-posterior mean of Zhang and Stephens."""
    n = len(x)
    m = 30 + int(math.sqrt(n))
    b = 1 / x[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * x[max(0, int(n / 4 + 0.5) - 1)])
    k = np.log1p(-b[:, None] * x).mean(axis=1)
    profile = n * (np.log(-b / k) - k - 1)
    weight = 1 / np.exp(np.clip(profile[None, :] - profile[:, None], -700, 700)).sum(axis=1)
    weight[weight < 10 * np.finfo(float).eps] = 0.0
    best = (b * weight).sum() / weight.sum()
    shape = np.log1p(-best * x).mean()
    return float((n * shape + 5) / (n + 10)), float(-shape / best)


def smoothed(lw: np.ndarray) -> tuple[np.ndarray, float]:
    """Pareto-smoothed log weights (normalized) and the tail's shape. The tail are the weights strictly above the largest one outside the
    tail's nominal size, so draws that tie with it (as repeats after rejected proposals do) stay out; tails of four or fewer stay as they are
    (shape infinite)."""
    lw = lw - lw.max()
    order = np.argsort(lw, kind="stable")
    edge = max(lw[order[-min(tail_size(len(lw)), len(lw) - 1) - 1]], math.log(np.finfo(float).tiny))
    top = order[lw[order] > edge]
    size, k = len(top), math.inf
    if size > 4:
        k, scale = pareto_fit(np.exp(lw[top]) - math.exp(edge))
        if k >= 1 / 3:
            p = (np.arange(size) + 0.5) / size
            quantile = scale * np.expm1(-k * np.log1p(-p)) / k
            lw = lw.copy()
            lw[top] = np.minimum(np.log(quantile + math.exp(edge)), 0.0)
    return lw - (lw.max() + math.log(np.exp(lw - lw.max()).sum())), k


def psis_loo(draws: DataFrame, ll: str, keys: list[str]) -> DataFrame:
    """loo and pareto_k of each unit. A unit's draws (as many as the sampler keeps) are one array in one row; a unit needs two draws."""
    own = draws.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(ll).cast("double"))).alias("_all"))
    schema = T.StructType([*(own.schema[k] for k in keys), T.StructField("loo", T.DoubleType()), T.StructField("pareto_k", T.DoubleType())])

    def one(values: np.ndarray) -> tuple[float, float]:
        if len(values) < 2:
            raise ValueError("a unit has fewer than two draws")
        weights, k = smoothed(-values)
        total = weights + values
        return total.max() + math.log(np.exp(total - total.max()).sum()), k

    def run(batches):
        for b in batches:
            ends, flat = b.column(len(keys)).offsets.to_numpy(), b.column(len(keys)).values.to_numpy(zero_copy_only=False)
            found = [one(flat[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return own.mapInArrow(run, schema)


def loo_summary(found: DataFrame, bad: float = 0.7) -> DataFrame:
    """Sum of loo, the number of units whose shape is ``bad`` or worse, and the number of units."""
    return found.agg(F.sum("loo").alias("loo"), F.count_if(F.col("pareto_k") >= bad).alias("bad"), F.count(F.lit(1)).alias("units"))
