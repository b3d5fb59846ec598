"""Binned trials from event tables.

A neuron is a user, a trial one day of a user with events, a bin an hour; y counts the events and hours without
events are filled with 0.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names for the cluster; a session of one process may do without and gets a temporary one."""
    top = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spikeloom-")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def event_bins(events: DataFrame) -> DataFrame:
    """neuron, trial (date text), bin, event_type, value of each event."""
    return events.select(F.col("user_id").alias("neuron"), F.date_format("ts", "yyyy-MM-dd").alias("trial"), F.hour("ts").alias("bin"), "event_type", "value")


def counts(events: DataFrame) -> DataFrame:
    return event_bins(events).groupBy("neuron", "trial", "bin").agg(F.count(F.lit(1)).cast("double").alias("y"))


def trial_rows(events: DataFrame, bins: int = BINS) -> DataFrame:
    """A row for each trial: ys (counts of all bins), sample, test and lever (first bins of a view, click, purchase). One scan and one shuffle."""
    def first(kind):
        return F.min(F.when(F.col("event_type") == kind, F.col("bin")))

    counted = [F.count(F.when(F.col("bin") == b, 1)).cast("double").alias(f"y{b}") for b in range(bins)]
    rows = event_bins(events).groupBy("neuron", "trial").agg(*counted, first("view").alias("sample"), first("click").alias("test"), first("purchase").alias("lever"))
    return rows.select("neuron", "trial", F.array(*(f"y{b}" for b in range(bins))).alias("ys"), "sample", "test", "lever")


def binned(events: DataFrame, lags: int = 0, bins: int = BINS) -> DataFrame:
    """A row for each trial and bin: neuron, trial, bin, y, h1.. (counts 1..lags bins before, 0 before the trial), sample, test, lever.

    Counts before a bin come out of the trial's array, so no window, sort or further shuffle is needed.
    """
    rows = trial_rows(events, bins).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    history = [F.coalesce(F.when(F.col("bin") >= j, F.get("ys", F.col("bin") - j)), F.lit(0.0)).alias(f"h{j}") for j in range(1, lags + 1)]
    return rows.select("neuron", "trial", "bin", F.get("ys", "bin").alias("y"), *history, "sample", "test", "lever")


def dense(events: DataFrame, bins: int = BINS) -> DataFrame:
    """One row per trial and bin: neuron, trial, bin, y. One shuffle."""
    return binned(events, 0, bins).select("neuron", "trial", "bin", "y")


def check(bins: DataFrame, counts: bool = True) -> dict[str, int]:
    """Numbers of broken rows by rule, in one pass; ``validated`` raises if there are any.

    Rules: no null key, no null or non-finite y, with ``counts`` only whole y (negative ones are censored), at least one observed bin in each trial
    and no bin twice.
    """
    missing = {"y", "trial", "bin", "neuron"} - set(bins.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    y = F.col("y").cast("double")
    per_trial = bins.groupBy("neuron", "trial").agg(
        F.count_if(F.col("neuron").isNull() | F.col("trial").isNull() | F.col("bin").isNull()).alias("null_key"),
        F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).alias("bad_y"),
        F.count_if(F.lit(counts) & (y != F.floor(y))).alias("fraction"),
        (F.count_if(y >= 0) == 0).cast("bigint").alias("unobserved") if counts else F.lit(0).cast("bigint").alias("unobserved"),
        (F.count(F.lit(1)) - F.count_distinct("bin")).alias("repeated"))
    return per_trial.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("null_key", "bad_y", "fraction", "unobserved", "repeated"))).first().asDict()


def validated(bins: DataFrame, counts: bool = True) -> DataFrame:
    broken = {k: v for k, v in check(bins, counts).items() if v}
    if broken:
        raise ValueError(f"rows break rules: {broken}")
    return bins


def event_times(events: DataFrame) -> DataFrame:
    """First bins of the sample (view), test (click) and lever (purchase) event of each trial, null where there is none."""
    return trial_rows(events, 0).select("neuron", "trial", "sample", "test", "lever")


def write_draws(draws: DataFrame, path: str, mode: str = "append") -> None:
    """Parameter draws (iter, block, row, col, value) to Parquet, a folder for each thousand iterations."""
    draws.withColumn("part", F.floor(F.col("iter") / 1000)).write.mode(mode).partitionBy("part").parquet(path)


def read_draws(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """Draws after the warm-up; whole folders of it aren't read."""
    return spark.read.parquet(path).where((F.col("part") >= after // 1000) & (F.col("iter") > after)).drop("part")
