"""Model rows from binned trials: regressors and indices of stimulus, response and spike-history groups as columns of the bin.

Bins come with their trial's event times and the trial's counts before them (``sources.trials.binned``), so everything here is a
projection; the only join gives neurons their dense index.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spikeloom.functions.basis_sets import Basis
from spikeloom.operators import design
from spikeloom.plans.gmlm import Factor, Group, Spec


def history_columns(basis: np.ndarray) -> list[Column]:
    """The counts h1, h2, ... before a bin times the basis [lags, functions]."""
    return [sum((F.col(f"h{j + 1}") * float(v) for j, v in enumerate(column)), F.lit(0.0)) for column in np.asarray(basis).T]


def event_rows(basis: Basis, event: str) -> Column:
    """Row of the basis at a bin for an event; -1 outside it or without the event."""
    return design.event_index(event, int(basis.times[0]), len(basis.times))


def basis_at(basis: Basis, ix: Column) -> list[Column]:
    """The basis' functions at a row index, 0 outside."""
    return [F.when(ix >= 0, F.get(F.array(*(F.lit(float(v)) for v in column)), ix)).otherwise(0.0) for column in basis.matrix.T]


def neuron_index(rows: DataFrame) -> DataFrame:
    """(neuron, neuron_ix): dense numbers by position. Ranges of ids are counted, then ranked inside each range.

    Joins with it are hash joins of shuffled rows: Spark takes bins and products of sizes for far smaller or larger than they are, and would gather all bins on the driver to broadcast them.
    """
    ids = rows.select("neuron", F.floor(F.col("neuron") / 4096).alias("part")).distinct()
    before = ids.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part")) - F.col("count"))
    inside = ids.withColumn("n", F.row_number().over(W.partitionBy("part").orderBy("neuron")) - 1)
    return inside.hint("shuffle_hash").join(before, "part").select("neuron", (F.col("before") + F.col("n")).cast("bigint").alias("neuron_ix"))


def gmlm_rows(timed: DataFrame, history: np.ndarray, stim: Basis, response: Basis, directions: int, onsets: bool = False, weight: Column | None = None) -> DataFrame:
    """Rows of ``plans.gmlm``: x_lin (history, with ``onsets`` also the stimulus basis at sample and test), stim_ix and dir_ix [sample, test],
    resp_ix [lever], hist [1][functions] for groups whose kernel is the history."""
    pairs = [(event_rows(stim, e), design.direction("neuron", directions) + k * directions) for k, e in enumerate(("sample", "test"))]
    linear = history_columns(history)
    if onsets:
        linear += [c for ix, _ in pairs for c in basis_at(stim, ix)]
    return timed.join(neuron_index(timed).hint("shuffle_hash"), "neuron").select(
        "neuron", "trial", "bin", "neuron_ix", "y", (weight if weight is not None else F.lit(1.0)).alias("w"), F.array(*linear).alias("x_lin"),
        F.array(*(ix.cast("bigint") for ix, _ in pairs)).alias("stim_ix"), F.array(*(F.when(ix >= 0, d).otherwise(-1).cast("bigint") for ix, d in pairs)).alias("dir_ix"),
        F.array(event_rows(response, "lever").cast("bigint")).alias("resp_ix"), F.array(F.array(*history_columns(history))).alias("hist"))


def gmlm_spec(neurons: int, history: np.ndarray, stim: Basis, response: Basis, features: np.ndarray, ranks: dict[str, int], onsets: bool = False, kind: str = "poiss_exp", dt: float = 1.0) -> Spec:
    """The structure for gmlm_rows(). features: [2 directions, features] of sample, then test. ranks: by group (stimulus, response, stimulus_history, response_history); groups without one are left out."""
    k, t, d, r = np.asarray(history).shape[1], stim.matrix.shape[1], features.shape[1], response.matrix.shape[1]
    every = {
        "stimulus": ((t, d), (0, 1), (Factor("stim_ix", stim.matrix), Factor("dir_ix", features)), 2),
        "response": ((r,), (0,), (Factor("resp_ix", response.matrix),), 1),
        "stimulus_history": ((k, t, d), (0, 1, 2), (Factor("hist"), Factor("stim_ix", stim.matrix), Factor("dir_ix", features)), 2),
        "response_history": ((k, r), (0, 1), (Factor("hist"), Factor("resp_ix", response.matrix)), 1),
    }
    groups = tuple(Group(name, modes, of, factors, ranks[name], events) for name, (modes, of, factors, events) in every.items() if name in ranks)
    return Spec(neurons, k + 2 * t * onsets, groups, kind, dt)


def glm_design(timed: DataFrame, history: np.ndarray, stim: Basis, response: Basis, features: np.ndarray, directions: int) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """(neuron, trial, bin, y, x), and the (offset, size) of the groups of x: stimulus (features x stimulus basis, sample and test added), response, history, constant."""
    stimulus = [F.lit(0.0)] * (features.shape[1] * stim.matrix.shape[1])
    for k, event in enumerate(("sample", "test")):
        at, rows = basis_at(stim, event_rows(stim, event)), features[k * directions : (k + 1) * directions]
        loads = [F.get(F.array(*(F.lit(float(v)) for v in column)), design.direction("neuron", directions)) for column in rows.T]
        stimulus = [a + b for a, b in zip(stimulus, design.kron(loads, at), strict=True)]
    parts = {"stimulus": stimulus, "response": basis_at(response, event_rows(response, "lever")), "history": history_columns(history), "constant": [F.lit(1.0)]}
    where, at = {}, 0
    for name, columns in parts.items():
        where[name] = (at, len(columns))
        at += len(columns)
    return timed.select("neuron", "trial", "bin", "y", F.array(*(c for columns in parts.values() for c in columns)).alias("x")), where


def cosine_table(steps: int, functions: int, first: int = 0) -> Basis:
    """A basis in closed form, cos((t + 1)(k + 1)) / 4, over ``steps`` offsets from ``first``."""
    m = np.array([[math.cos((t + 1) * (k + 1)) / 4 for k in range(functions)] for t in range(steps)])
    return Basis(np.arange(first, first + steps), m, m)
