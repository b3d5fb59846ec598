"""Regressors of binned trials: windows, event indices, history, stimulus and design matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TRIAL = ["neuron", "trial"]


def direction(neuron: Column | str = "neuron", directions: int = 8) -> Column:
    return F.pmod(F.col(neuron) if isinstance(neuron, str) else neuron, F.lit(directions)).cast("int")


def window(timed: DataFrame, before: int = 0, after: int = 3, length: int = 6) -> DataFrame:
    """Bins (with sample, test, lever) from ``before`` the sample to ``after`` the lever, or to ``length + after`` past the test where no lever is."""
    last = F.coalesce(F.col("lever") + after, F.col("test") + length + after)
    return timed.where((F.col("bin") >= F.col("sample") - before) & (F.col("bin") <= last))


def event_index(event: str, offset: int = 0, size: int | None = None) -> Column:
    """0-based index of a bin in the event's basis; -1 outside it or without the event."""
    i = F.col("bin") - F.col(event) - offset
    inside = i >= 0 if size is None else (i >= 0) & (i < size)
    return F.when(inside, i).otherwise(-1)


def two_events(directions: int = 8, size: int = 12) -> list[tuple[Column, Column]]:
    """(timing index, feature index) of the sample, and of the test with its directions after those of the sample; needs bin, sample, test, neuron.

    Where the timing index is invalid the feature index is, too.
    """
    out = []
    for k, event in enumerate(("sample", "test")):
        ix = event_index(event, 0, size)
        out.append((ix, F.when(ix >= 0, direction() + k * directions).otherwise(-1)))
    return out


def event_union(timed: DataFrame, directions: int = 8, size: int = 12) -> DataFrame:
    """Two rows for each bin of ``timed`` (neuron, trial, bin, y, sample, test): event, ix, feature."""
    at = F.array(*(F.struct(F.lit(k).alias("event"), ix.alias("ix"), feature.alias("feature")) for k, (ix, feature) in enumerate(two_events(directions, size))))
    return timed.select(*TRIAL, "bin", "y", F.explode(at).alias("e")).select(*TRIAL, "bin", "y", "e.event", "e.ix", "e.feature")


def history(bins: DataFrame, lags: int) -> DataFrame:
    """Counts 1..lags bins before (h1, h2, ...), 0 before the trial; strictly causal. One shuffle by trial."""
    w = W.partitionBy(*TRIAL).orderBy("bin")
    return bins.select("*", *(F.coalesce(F.lag("y", j).over(w), F.lit(0.0)).alias(f"h{j}") for j in range(1, lags + 1)))


def history_basis(bins: DataFrame, basis: list[list[float]]) -> DataFrame:
    """x0, x1, ...: the history convolved with the columns of ``basis`` [lag][column]."""
    rows = history(bins, len(basis))
    columns = [sum((F.col(f"h{j + 1}") * float(row[b]) for j, row in enumerate(basis)), F.lit(0.0)).alias(f"x{b}") for b in range(len(basis[0]))]
    return rows.select(*bins.columns, *columns)


def knots(bins: DataFrame, at: list[int]) -> DataFrame:
    """The nearest knot at or below each bin and the position within its segment."""
    below = F.array_max(F.filter(F.array(*map(F.lit, at)), lambda k: k <= F.col("bin")))
    above = F.array_min(F.filter(F.array(*map(F.lit, at)), lambda k: k > F.col("bin")))
    return bins.withColumn("knot", below).withColumn("u", (F.col("bin") - below) / (above - below))


def kron(a: list[Column], b: list[Column]) -> list[Column]:
    """Kronecker product of two rows; the second varies fastest."""
    return [x * y for x in a for y in b]
