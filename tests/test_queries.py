"""Every registered model query against its SQL, and the fits against NumPy."""

import math
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spikeloom import queries
from spikeloom.functions.likelihood import LIKELIHOODS, terms
from spikeloom.operators import design, model
from spikeloom.plans import compare, fits
from spikeloom.sources import trials

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def comparable(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if pd.isna(v) else float(v) + 0.0 if isinstance(v, (int, float, np.number)) else v for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, tables, name):
    got, want = comparable(queries.QUERIES[name](spark, SF).toPandas()), comparable(tables.sql(queries.SQL[name]).df())
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_registry_works_without_the_optional_part(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "spikeloom", tmp_path / "spikeloom", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from spikeloom import queries as q; assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.SQL); print('whole')"
    alone = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "whole" in alone.stdout, alone.stderr
    assert not [p for p in (root / "spikeloom").rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("kind", sorted(LIKELIHOODS))
def test_derivatives_by_finite_differences(spark, kind):
    h, grid = 1e-5, [(x, y) for x in (-40.0, -3.0, -0.5, 0.1, 1.5, 3.0) for y in (0.0, 1.0, 2.0)]
    if kind == "poiss_softrec":
        grid = [(x, y) for x, y in grid if x > -40]
    rows = spark.createDataFrame(grid, "x double, y double")
    at = {s: terms(kind, F.col("x") + s * h, F.col("y"), 0.5) for s in (-1, 0, 1)}
    for r in rows.select(*(at[s][i].alias(f"t{i}_{s + 1}") for s in at for i in range(3))).collect():
        assert (r["t0_2"] - r["t0_0"]) / (2 * h) == pytest.approx(r["t1_1"], rel=1e-4, abs=1e-6)
        assert (r["t1_2"] - r["t1_0"]) / (2 * h) == pytest.approx(r["t2_1"], rel=1e-4, abs=1e-6)


def test_censoring_and_weights(spark):
    rows = spark.createDataFrame([(1, "a", -1.0, 0.3), (1, "a", 2.0, 0.1), (2, "a", 1.0, 0.0)], "neuron int, trial string, y double, x double")
    sums = {r["neuron"]: r["ll"] for r in model.trial_sums(rows, "poiss_exp").collect()}
    assert sums[1] == pytest.approx(0.2 - np.exp(0.1)) and sums[2] == pytest.approx(-1.0)
    weights = spark.createDataFrame([(1, "a", 2.0), (2, "a", 0.0)], "neuron int, trial string, w double")
    assert [(r["neuron"], r["ll"]) for r in model.weighted(model.trial_sums(rows, "poiss_exp"), weights).collect()] == [(1, pytest.approx(2 * sums[1]))]


def test_repartitioning_changes_nothing(spark):
    one = comparable(queries.QUERIES["gmlm_trial_ll"](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert comparable(queries.QUERIES["gmlm_trial_ll"](spark, SF).toPandas()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_history_is_causal(spark):
    rows = spark.createDataFrame([(1, "a", b, float(b * b)) for b in range(5)], "neuron int, trial string, bin int, y double")
    got = design.history_basis(rows, [[1.0], [10.0]]).orderBy("bin").collect()
    assert [r["x0"] for r in got] == [0.0, 0.0, 1.0, 14.0, 49.0]


def design_matrix(spark):
    rows = design.history(trials.dense(trials.table(spark, SF, "events")), 3)
    pdf = rows.toPandas()
    return rows, np.stack([np.ones(len(pdf)), pdf["h1"], pdf["h2"], np.cos(pdf["bin"] * np.pi / 12)], axis=1), pdf


def test_newton_reaches_the_maximum(spark):
    rows, x, pdf = design_matrix(spark)
    got = fits.newton(rows, [F.lit(1.0), *queries.regressors()], "poiss_exp", steps=20).orderBy("parameter").toPandas()
    w = got["estimate"].to_numpy()
    assert np.abs(x.T @ (pdf["y"].to_numpy() - np.exp(x @ w))).max() < 1e-4 and (got["se"] > 0).all()


def test_folds_are_not_leaked(spark):
    rows, x, pdf = design_matrix(spark)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("neuron", "trial"), F.lit(3)))
    held = rows.toPandas()
    got = {r["held"]: r for r in fits.cross_validate(rows, [F.lit(1.0), *queries.regressors()], "fold", 3).collect()}
    design_of = lambda p: np.stack([np.ones(len(p)), p["h1"], p["h2"], np.cos(p["bin"] * np.pi / 12)], axis=1)
    for k in range(3):
        train, test = held[held["fold"] != k], held[held["fold"] == k]
        w, ll, _ = fits.maximum(design_of(train), train["y"].to_numpy(), np.ones(len(train)))
        assert got[k]["converged"] and got[k]["train_ll"] == pytest.approx(ll) and got[k]["test_ll"] == pytest.approx(fits.poisson(w, design_of(test), test["y"].to_numpy(), np.ones(len(test)))[0])


def test_evidence_and_its_gradient(spark):
    rows = timed_rows(spark)
    own = fits.Evidence(rows, [F.lit(1.0), *queries.regressors()], fits.group_covariance([1, 2, 1]))
    h, step = np.array([0.3, -1.0, -0.5]), 1e-4
    value, grad = own.value(h)
    for i in range(3):
        up, down = (own.value(h + s * step * (np.arange(3) == i))[0] for s in (1, -1))
        assert grad[i] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-5)
    found = own.maximum(h, steps=40)
    assert found["converged"] and found["value"] >= value and np.abs(own.value(found["h"])[1]).max() < 0.1
    own.close()


def timed_rows(spark):
    return queries.timed(spark, SF, 3)


def test_evidence_of_folds_is_not_leaked(spark):
    rows = timed_rows(spark).withColumn("fold", F.pmod(F.xxhash64("neuron", "trial"), F.lit(2)))
    args = ([F.lit(1.0), *queries.regressors()], fits.group_covariance([1, 3]), np.zeros(2), "fold", 2)
    one = fits.evidence_cross_validated(rows, *args, steps=6)
    other = fits.evidence_cross_validated(rows.withColumn("y", F.when(F.col("fold") == 0, F.col("y") + 3).otherwise(F.col("y"))), *args, steps=6)
    assert np.allclose(one[0]["w"], other[0]["w"]) and one[0]["value"] == pytest.approx(other[0]["value"]) and one[0]["test_ll"] != other[0]["test_ll"]


def test_sampler_finds_a_known_posterior(spark):
    rows = spark.createDataFrame([(1, float(y)) for y in np.random.default_rng(0).poisson(3.0, 400)], "neuron int, y double")
    draws = fits.hmc(rows, [F.lit(1.0)], ["neuron"], warmup=200, keep=600, precision=1e-3).toPandas()
    y = np.array([r["y"] for r in rows.collect()])
    assert draws["value"].mean() == pytest.approx(np.log(y.mean()), abs=0.02)
    assert draws["value"].std() == pytest.approx(1 / np.sqrt(y.sum()), rel=0.3) and draws["accepted"].mean() > 0.5


def test_alternating_fit_raises_the_likelihood(spark):
    rows = queries.lin(spark, SF).select("neuron", "trial", "bin", "y", "x")
    both = design.event_union(queries.timed(spark, SF), 8, 12)
    value = {(r["mode"], r["ix"]): r["value"] for r in fits.alternating_rank1(rows, both, 12, 16).collect()}
    pdf, cells = rows.toPandas(), both.where("ix >= 0").toPandas()
    cells["v"] = [value["ix", a] * value["feature", b] for a, b in zip(cells["ix"], cells["feature"], strict=True)]
    pdf = pdf.merge(cells.groupby(["neuron", "trial", "bin"])["v"].sum().reset_index(), how="left").fillna({"v": 0.0})
    ll = lambda x: float((pdf["y"] * x - np.exp(x)).sum())
    assert ll(pdf["x"] + pdf["v"]) > ll(pdf["x"])


def test_registered_samples(spark):
    draws = queries.QUERIES["gmlm_sampler_draws"](spark, SF).toPandas()
    assert set(draws["iter"]) == set(range(1, 11)) and set(draws["chain"]) == {0, 1} and np.isfinite(draws["natural"]).all()
    assert np.allclose(draws.loc[draws["block"] == "W", "value"], draws.loc[draws["block"] == "W", "natural"])
    gig = queries.QUERIES["gig_draws"](spark, SF).toPandas().groupby("neuron")["variance"].mean()
    want = queries.QUERIES["sse_precision_posterior"](spark, SF).toPandas().set_index("neuron")
    assert np.allclose(gig, (want["rate"] / (want["shape"] - 2))[gig.index], rtol=0.2)
    shares = queries.QUERIES["dirichlet_draws"](spark, SF).toPandas()
    assert np.allclose(shares.filter(like="share_").sum(axis=1), 1.0)


def test_psis_on_a_conjugate_model():
    rng = np.random.default_rng(1)
    y = rng.normal(0, 1, 30)
    mean, var = y.sum() / (len(y) + 1), 1 / (len(y) + 1)  # N(0, 1) prior, unit noise
    draws = rng.normal(mean, np.sqrt(var), 4000)
    for v in y[:5]:
        values = -0.5 * np.log(2 * np.pi) - 0.5 * (v - draws) ** 2
        weights, k = compare.smoothed(-values)
        m, s = (y.sum() - v) / len(y), 1 / len(y) + 1
        exact = -0.5 * np.log(2 * np.pi * s) - 0.5 * (v - m) ** 2 / s
        assert np.logaddexp.reduce(weights + values) == pytest.approx(exact, abs=0.02) and k < 0.7


def test_psis_with_ties(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(0, 1, 400)
    _, k = compare.smoothed(-values)
    order = np.argsort(values)
    size = compare.tail_size(400)
    tied = values.copy()
    tied[order[size - 1]] = tied[order[size]]  # the tail's last draw repeats the cutoff, as after a rejected proposal
    weights, k_tied = compare.smoothed(-tied)
    assert math.isfinite(k) and math.isfinite(k_tied) and abs(k - k_tied) < 0.1
    assert np.exp(weights).sum() == pytest.approx(1.0)
    assert compare.smoothed(np.zeros(50))[1] == math.inf and compare.smoothed(np.array([0.0, -1.0]))[1] == math.inf
    rows = spark.createDataFrame([(u, i, float(v)) for u, vs in (("a", values), ("b", tied)) for i, v in enumerate(vs)], "unit string, draw int, ll double")
    got = {r["unit"]: r for r in compare.psis_loo(rows, "ll", ["unit"]).collect()}
    assert got["a"]["pareto_k"] == pytest.approx(k) and got["b"]["pareto_k"] == pytest.approx(k_tied)
    assert compare.psis_loo(rows.limit(0), "ll", ["unit"]).count() == 0


def test_dataset_rules(spark):
    good = [(1, "a", b, float(b % 2)) for b in range(4)] + [(1, "b", 0, -1.0), (1, "b", 1, 0.0)]
    broken = {"null_key": (None, "a", 9, 1.0), "bad_y": (1, "a", 9, float("nan")), "fraction": (1, "a", 9, 0.5), "unobserved": (2, "a", 0, -1.0), "repeated": (1, "a", 0, 1.0)}
    schema = "neuron int, trial string, bin int, y double"
    assert trials.validated(spark.createDataFrame(good, schema)).count() == 6
    for rule, row in broken.items():
        assert trials.check(spark.createDataFrame([*good, row], schema))[rule] == 1
        with pytest.raises(ValueError, match=rule):
            trials.validated(spark.createDataFrame([*good, row], schema))
    with pytest.raises(ValueError, match="missing"):
        trials.check(spark.createDataFrame(good, schema).drop("bin"))
    assert trials.check(spark.createDataFrame([(1, "a", 0, 0.5)], schema), counts=False)["fraction"] == 0


@pytest.mark.parametrize("name", ["gaussian_terms", "half_t_terms", "inverse_gamma_terms", "inverse_gaussian_terms"])
def test_prior_derivatives(spark, name):
    from spikeloom.functions import priors

    f = getattr(priors, name)
    args = {"gaussian_terms": lambda x, h: (x, h), "half_t_terms": lambda x, h: (x, 3.0, h), "inverse_gamma_terms": lambda x, h: (x, 2.5, 1.5), "inverse_gaussian_terms": lambda x, h: (x, 1.2, 0.7)}[name]
    h = 1e-5
    rows = spark.createDataFrame([(x, s) for x in (-3.0, -0.4, 0.0, 0.7, 2.5) for s in (-1.0, 0.3)], "x double, s double")
    at = {(i, j): f(*args(F.col("x") + i * h, F.col("s") + j * h)) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}
    for r in rows.select(*(c.alias(f"v{i}_{j}_{k}") for (i, j), cs in at.items() for k, c in enumerate(cs))).collect():
        dx = (r["v1_0_0"] - r["v-1_0_0"]) / (2 * h)
        assert dx == pytest.approx(r["v0_0_1"], rel=1e-5, abs=1e-6)
        if name in ("inverse_gamma_terms", "inverse_gaussian_terms", "half_t_terms"):
            assert (r["v1_0_1"] - r["v-1_0_1"]) / (2 * h) == pytest.approx(r["v0_0_2"], rel=1e-5, abs=1e-6)
        if name in ("gaussian_terms", "half_t_terms"):
            ds = (r["v0_1_0"] - r["v0_-1_0"]) / (2 * h)
            assert ds == pytest.approx(r["v0_0_3" if name == "half_t_terms" else "v0_0_2"], rel=1e-5, abs=1e-6)


def test_half_t_has_a_tail(spark):
    from spikeloom.functions import priors

    r = spark.range(1).select(priors.half_t(F.lit(800.0), 3.0, 1.0).alias("a"), priors.half_t(F.lit(801.0), 3.0, 1.0).alias("b"), priors.half_t(F.lit(-800.0), 3.0, 1.0).alias("c")).first()
    assert r["a"] - r["b"] == pytest.approx(3.0) and math.isfinite(r["c"])


def test_log_factorial_is_exact_and_fast(spark):
    from spikeloom.functions.likelihood import lgamma_count

    ys = [0.0, 1.0, 5.0, 31.0, 32.0, 33.0, 100.0, 1e5, 1e9]
    got = [r[0] for r in spark.createDataFrame([(y,) for y in ys], "y double").select(lgamma_count(F.col("y"))).collect()]
    assert got == [pytest.approx(math.lgamma(y + 1), rel=1e-13, abs=1e-13) for y in ys]


def test_draws_round_trip(spark, tmp_path):
    draws = spark.range(2500).select(F.col("id").alias("iter"), F.lit("w").alias("block"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.rand(1).alias("value"))
    trials.write_draws(draws, str(tmp_path / "draws"))
    assert trials.read_draws(spark, str(tmp_path / "draws"), 1499).count() == 1000


def test_stream_of_bins(spark, tmp_path):
    from spikeloom.streaming.bins import stream_bins

    events = trials.table(spark, SF, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = stream_bins(stream).writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bins").agg(F.sum("y")).first()[0] == events.count()


def test_bins_are_never_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # Spark's estimates would have bins or the index sent to the driver
    try:
        rows = queries.QUERIES["gmlm_builder"](spark, SF)
        assert len(rows.collect()) and "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in queries.general(spark, SF)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
