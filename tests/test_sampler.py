"""Priors, scalings and the sampler against finite differences and known posteriors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.functions import basis_sets, stimulus
from spikeloom.plans import gmlm, horseshoe, sampler


def spec_of(hyper):
    return gmlm.Spec(3, 2, (gmlm.Group("g", (4, 3), (0, 1), (gmlm.Factor("a", 4), gmlm.Factor("b", 3)), 2),), hyper=hyper)


def check(f, params, rel=1e-5):
    _, grads = f(params)
    for k, g in grads.items():
        for at in np.ndindex(params[k].shape):
            h = 1e-6
            up, down = ({**params, k: params[k] + s * h * (np.arange(params[k].size).reshape(params[k].shape) == np.ravel_multi_index(at, params[k].shape))} for s in (1, -1))
            assert g[at] == pytest.approx((f(up)[0] - f(down)[0]) / (2 * h), rel=rel, abs=1e-6), (k, at)


@pytest.mark.parametrize("hierarchical", [False, True])
@pytest.mark.parametrize("tied", [False, True])
def test_horseshoe(hierarchical, tied):
    groups = {"g.T0": np.array([0, 0, 1, 1])} if tied else {}
    size = horseshoe.Scales(spec_of(0), spec_of(0).groups[0], tied=groups).size
    spec = spec_of(size + 1)
    own = horseshoe.Scales(spec, spec.groups[0], 1, groups, hierarchical)
    rng = np.random.default_rng(0)
    params = gmlm.random_params(spec, 1, 1.0) | {"H": 0.5 * rng.standard_normal(spec.hyper)}
    params["g.V"][0, 0] = 0.0
    check(own.prior, params)
    check(own.centred, params)
    weights = {b: rng.standard_normal(params[b].shape) for b in own.blocks}

    def through(p):  # any function of natural coefficients
        natural = own.forward(p)
        value = sum(float((weights[b] * natural[b] ** 2).sum()) for b in own.blocks)
        return value, own.backward(p, {b: 2 * weights[b] * natural[b] for b in own.blocks})

    check(through, params)
    # the centred density is that of the standard coefficients with the Jacobian
    natural = own.forward(params)
    jacobian = sum(float(own.log_sd(params["H"], b)[0].sum()) for b in own.blocks)
    assert own.centred(natural)[0] == pytest.approx(own.prior(params)[0] - jacobian)
    assert len(own.draw(rng)) == own.size


def test_block_scales_and_chains():
    spec = spec_of(4)
    w, b = horseshoe.BlockScale(spec, "W", 0, mean=True), horseshoe.BlockScale(spec, "B", 2, np.array([0, 1]))
    params = gmlm.random_params(spec, 2, 1.0) | {"H": np.array([0.3, -0.2, 0.1, 0.4])}
    for one in (w, b):
        check(one.prior, params)
    forward, backward = horseshoe.chain([w, b])

    def through(p):
        n = forward(p)
        return float((n["W"] ** 2).sum() + (n["B"] ** 3).sum()), backward(p, {"W": 2 * n["W"], "B": 3 * n["B"] ** 2})

    check(through, params)


def test_group_priors_cover_every_block():
    spec = spec_of(0)
    priors = horseshoe.group_priors(spec, {"g.T1": np.diag([1.0, 2.0, 3.0])})
    check(lambda p: gmlm.prior_sum(priors, p), gmlm.random_params(spec, 3, 1.0))


@pytest.mark.parametrize("tuning", ["cosine", "none", "full"])
@pytest.mark.parametrize("same", [True, False])
def test_stimulus_design_and_covariance(tuning, same):
    degrees, category = np.arange(0, 360, 60), np.array([0, 0, 0, 1, 1, 1])
    for with_category in (True, False):
        for with_period in (True, False):
            d = stimulus.design(degrees, category, tuning, same, with_category, with_period)
            assert d.values.shape == (6, len(d.names), 2) and d.stacked().shape == (12, len(d.names)) and all(p.loads.shape[0] == len(d.names) for p in d.pieces)
            assert (np.abs(d.values).sum(axis=(0, 2)) > 0).all()
            h = np.linspace(-0.5, 0.7, d.hypers)
            cov, slopes = stimulus.covariance(d.pieces, h)
            assert np.allclose(cov, cov.T) and np.linalg.eigvalsh(cov).min() > -1e-9 and len(slopes) == d.hypers
            for i in range(d.hypers):
                step = 1e-6 * (np.arange(d.hypers) == i)
                assert np.allclose(slopes[i], (stimulus.covariance(d.pieces, h + step)[0] - stimulus.covariance(d.pieces, h - step)[0]) / 2e-6, rtol=1e-5, atol=1e-7)
    if tuning == "cosine" and not same:
        assert sum("sine" in n for n in stimulus.design(degrees, category, tuning, same).names) == 4


def test_contrast_design_is_scaled():
    x = stimulus.contrast_design(np.arange(0, 360, 45), np.repeat([0, 1], 4), np.tile([0, 0, 1, 1], 2))
    assert x.shape == (8, 7, 2) and np.allclose((x**2).mean(axis=(0, 2)), 1.0)


def test_basis_sets():
    for made in (basis_sets.cosine_set(), basis_sets.spline_set(rescale=False), basis_sets.spline_set()):
        for name, b in made.items():
            assert len(b.times) == len(b.raw) == len(b.matrix) and np.linalg.matrix_rank(b.raw) == b.matrix.shape[1]
            gram = b.matrix.T @ b.matrix
            if made is not None and np.isclose(gram[0, 0], 1.0):
                assert np.allclose(gram, np.eye(len(gram)), atol=1e-8), name
    cosine = basis_sets.cosine_set()
    assert cosine["stim"].raw[0].max() < 0.05 and cosine["response"].times.min() < 0 < cosine["response"].times.max() and cosine["history"].times[0] == 1
    rng = np.random.default_rng(1)
    b = basis_sets.spline_set()["response"].matrix
    draws = (b @ rng.standard_normal((b.shape[1], 20_000))) * rng.standard_normal(20_000)
    assert draws.std(axis=0, ddof=1).mean() == pytest.approx(1.0, rel=0.03)


def test_splines_interpolate_and_sum_to_one():
    knots, times = [0.0, 2.0, 5.0, 9.0, 14.0, 20.0], np.linspace(0.01, 20, 400)
    b = basis_sets.cardinal_spline(times, knots)
    assert np.allclose(b.sum(axis=1), 1.0)
    at = basis_sets.cardinal_spline(np.array(knots[1:]), knots)
    assert np.allclose(at, np.eye(6)[1:])
    assert basis_sets.cardinal_spline(times, knots, zero_first=True, zero_last=True).shape[1] == 4
    with pytest.raises(ValueError):
        basis_sets.cardinal_spline(np.array([0.0]), knots)


@pytest.mark.parametrize("start", ["plain", "flat", "refractory"])
def test_raised_cosines(start):
    t, b = basis_sets.raised_cosines(5, 0.01, 0.05, 0.5, 0.1, start, 0.03)
    assert b.shape == (len(t), 5) and b.min() >= 0 and b.max() <= 1 + 1e-12
    if start == "flat":
        assert (b[t <= 0.05, 0] == 1).all()
    if start == "refractory":
        assert (b[t < 0.03, 1:] == 0).all() and (b[:, 0] == (t < 0.03)).all()
    t, _ = basis_sets.raised_cosines(5, 0.01, 0.05, 0.5, 0.1, symmetric=True)
    assert t[0] == pytest.approx(-t[-1], abs=0.01)


def test_settings_by_warmup():
    assert sampler.settings().schedule == [(11, 4_000), (4_001, 7_000), (22_001, 25_000)] and sampler.settings(debug=True).warmup == 1_500
    for n in (500, 4_000, 9_000, 12_000, 22_000, 36_000, 61_000):
        own = sampler.settings(n, 10)
        assert all(a <= b <= n for a, b in own.schedule) and all(a <= b <= n for a, b in own.mass)


def normal_model(spark, n=240, neurons=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i % 12, i % neurons, float(rng.normal(1.0 + i % neurons, 1.0)), 1.0) for i in range(n)]
    frame = spark.createDataFrame(rows, "trial bigint, neuron_ix bigint, y double, w double").repartition(2)
    return gmlm.Model(frame, gmlm.Spec(neurons, 0, kind="sq_err"), [gmlm.gaussian_prior({"W": 1.0})]), np.array([np.mean([r[2] for r in rows if r[1] == p]) for p in range(neurons)]), rows


def test_sampler_resumes_and_finds_the_posterior(spark, tmp_path):
    model, means, _ = normal_model(spark)
    own = sampler.settings(60, 60, schedule=[(2, 50)], mass=[(20, 50)], block=40, length=0.4, most_steps=6, first_step=0.02)
    short = sampler.settings(40, 0, **{k: getattr(own, k) for k in ("schedule", "mass", "block", "length", "most_steps", "first_step")})
    start = [{"W": np.zeros(2)}, {"W": np.ones(2)}]
    start = [gmlm.empty_params(model.spec) | s for s in start]
    sampler.sample(model, start, short, str(tmp_path / "a"), ["neuron_ix", "trial"])
    out = sampler.sample(model, start, own, str(tmp_path / "a"), ["neuron_ix", "trial"])  # goes on after the 40 draws
    draws = out["draws"].toPandas()
    assert sorted(draws.loc[draws["chain"] == 0, "iter"].unique()) == list(range(1, 121))
    kept = draws[(draws["iter"] > 60) & (draws["block"] == "W")]
    precision = 120 + math.exp(-2.0)
    for p in range(2):
        own_draws = kept.loc[kept["row"] == p, "value"]
        assert own_draws.mean() == pytest.approx(means[p] * 120 / precision, abs=0.06) and 0.03 < own_draws.std() < 0.2
    assert out["trial_ll"].count() == 2 * 60 * 12 and out["iterations"].where("iter > 60").agg(F.avg(F.col("accepted").cast("int"))).first()[0] > 0.3
    at = draws[(draws["iter"] == 100) & (draws["chain"] == 1) & (draws["block"] == "W")].sort_values("row")["natural"].to_numpy()
    want = gmlm.trial_ll(model.rows, model.spec, {"W": at, "B": np.zeros((0, 2)), "H": np.zeros(0)}, ["neuron_ix", "trial"]).toPandas()["ll"].sum()
    assert out["trial_ll"].where("iter = 100 AND chain = 1").agg(F.sum("ll")).first()[0] == pytest.approx(want)
    model.close()


def test_noise_step_draws_the_precision(spark):
    model, means, rows = normal_model(spark)
    rng = np.random.default_rng(3)
    drawn = [sampler.noise_step(model)(rng, gmlm.empty_params(model.spec) | {"W": means})["noise"] for _ in range(8)]
    for p in range(2):
        sse = sum((r[2] - means[p]) ** 2 for r in rows if r[1] == p)
        assert np.mean([d[p] for d in drawn]) == pytest.approx((2 + 60) / (1 + sse / 2), rel=0.2)
    weighted = gmlm.evaluate(model.rows, model.spec, [gmlm.empty_params(model.spec) | {"W": means, "noise": np.array([2.0, 3.0])}], ["W"])[0]
    plain = gmlm.evaluate(model.rows, model.spec, [gmlm.empty_params(model.spec) | {"W": means}], ["W"])[0]
    assert weighted[0] < plain[0]
    model.close()


def test_noise_reaches_every_evaluation(spark, tmp_path, monkeypatch):
    model, means, rows = normal_model(spark)
    model.priors.append(sampler.noise_prior())
    seen, real = [], gmlm.evaluate
    monkeypatch.setattr(gmlm, "evaluate", lambda r, s, sets, *a: seen.extend("noise" in p for p in sets) or real(r, s, sets, *a))
    own = sampler.settings(20, 60, schedule=[(2, 20)], mass=[], block=30, length=0.3, most_steps=3, first_step=0.05, jumps=(1,))
    start = [gmlm.empty_params(model.spec)]
    sampler.sample(model, start, sampler.settings(20, 10, **{k: getattr(own, k) for k in ("schedule", "mass", "block", "length", "most_steps", "first_step", "jumps")}), str(tmp_path / "n"), ["neuron_ix", "trial"], [sampler.noise_step(model)])
    first = len(seen)
    run = sampler.sample(model, start, own, str(tmp_path / "n"), ["neuron_ix", "trial"], [sampler.noise_step(model)])  # the noise is part of the state
    assert all(seen[first + 1 :]) and sum(seen) > 100
    draws = run["draws"].where("iter > 20 AND block = 'noise'").toPandas()
    assert len(draws) == 2 * 60
    for p in range(2):
        y = np.array([r[2] for r in rows if r[1] == p])
        want = (2 + (len(y) - 1) / 2) / (1 + ((y - y.mean()) ** 2).sum() / 2)
        assert draws.loc[draws["row"] == p, "value"].mean() == pytest.approx(want, rel=0.12)
    # trial log likelihoods are normal log densities under the draw's precision
    at = run["draws"].where("iter = 50").toPandas().set_index(["block", "row"])["natural"]
    ll = run["trial_ll"].where("iter = 50").toPandas().set_index(["neuron_ix", "trial"])["ll"]
    y = np.array([r[2] for r in rows if r[1] == 1 and r[0] == 3])
    tau, w = at["noise", 1], at["W", 1]
    assert ll[1, 3] == pytest.approx(float((0.5 * np.log(tau / (2 * np.pi)) - 0.5 * tau * (y - w) ** 2).sum()))
    model.close()


def test_summary_of_a_stored_run(spark, tmp_path):
    import duckdb

    from spikeloom.plans import compare

    model, *_ = normal_model(spark)
    own = sampler.settings(10, 30, schedule=[(2, 10)], mass=[], block=15, length=0.2, most_steps=3, first_step=0.03)
    path = str(tmp_path / "s")
    run = sampler.sample(model, [gmlm.empty_params(model.spec), gmlm.empty_params(model.spec) | {"W": np.ones(2)}], own, path, ["neuron_ix", "trial"])
    found = sampler.summary(run, ["neuron_ix", "trial"], 10).first().asDict()
    con = duckdb.connect()
    want = con.sql(f"""WITH ll AS (SELECT * FROM '{path}/trial_ll/*/*.parquet' WHERE iter > 10), it AS (SELECT * FROM '{path}/iterations/*/*.parquet' WHERE iter > 10)
      SELECT (SELECT avg(w) FROM (SELECT -ln(avg(exp(ll))) + var_pop(ll) AS w FROM ll GROUP BY neuron_ix, trial)) AS waic, (SELECT count(*) FROM (SELECT DISTINCT neuron_ix, trial FROM ll)) AS trials,
      avg(accepted::INT) AS accept_rate, sum(lost::INT) AS early_rejects, avg(lost::INT) AS early_reject_share, count(*) AS draws, count(DISTINCT chain) AS chains FROM it""").df().iloc[0].to_dict()
    for k, v in want.items():
        assert found[k] == pytest.approx(v), k
    loo = compare.psis_loo(run["trial_ll"].where("iter > 10"), "ll", ["neuron_ix", "trial"]).toPandas()
    assert found["loo"] == pytest.approx(loo["loo"].sum()) and found["bad"] == (loo["pareto_k"] >= 0.7).sum()
    rate = sampler.trailing_acceptance(run, 5).toPandas().sort_values(["chain", "iter"])
    acc = run["iterations"].toPandas().sort_values(["chain", "iter"])
    assert np.allclose(rate["rate"], acc.groupby("chain")["accepted"].transform(lambda v: v.astype(float).rolling(5, min_periods=1).mean()))
    model.close()


def test_sinks_hold_many_parameters(spark):
    rng = np.random.default_rng(0)
    drawn = [(c, it, {"W": rng.normal(size=5), "g.V": rng.normal(size=(3, 2)), "H": np.zeros(0)}, {"W": rng.normal(size=5), "g.V": rng.normal(size=(3, 2))}) for c in range(2) for it in range(1, 4)]
    rows = {tuple(r)[:5]: tuple(r)[5:] for r in sampler.draw_rows(spark, drawn).collect()}
    assert len(rows) == 2 * 3 * 11
    for c, it, params, natural in drawn:
        for k in ("W", "g.V"):
            for (i, j), v in np.ndenumerate(params[k].reshape(len(params[k]), -1)):
                assert rows[c, it, k, i, j] == (v, natural[k].reshape(len(params[k]), -1)[i, j])
    big = [(0, it, {"W": np.zeros(100_000)}, {"W": np.ones(100_000)}) for it in range(20)]
    assert sampler.draw_rows(spark, big).agg(F.count("value"), F.sum("natural")).first()[:] == (2_000_000, 2_000_000.0)


@pytest.mark.parametrize("warmup", [500, 4_000, 10_000, 15_000, 20_000, 25_000, 30_000, 35_000, 40_000, 50_000, 60_000])
def test_schedules(warmup):
    own = sampler.settings(warmup, 100)
    adapting = {d for a, b in own.schedule for d in (a, b)}
    assert all(not sampler.scaled_at(d, own) for d in adapting) and all(sampler.scaled_at(d, own) for d in (warmup + 1, warmup + 100))
    for a, b in own.scale_ranges:
        assert a <= b <= warmup and sampler.scaled_at(a, own) and sampler.scaled_at(b, own)
        assert not any(x <= d <= y for x, y in own.schedule for d in (a, b))
    assert sampler.settings(debug=True).jumps == (100, 1_000) and own.jumps == ()


def test_jumps_reach_the_mode_and_leave_hyperparameters(spark, tmp_path):
    model, means, _ = normal_model(spark)
    own = sampler.settings(1, 0, schedule=[], block=5, length=1e-6, most_steps=1, first_step=1e-9, least_step=1e-9, jumps=(1,))
    run = sampler.sample(model, [gmlm.empty_params(model.spec) | {"W": np.array([5.0, -5.0])}], own, str(tmp_path / "j"), ["neuron_ix"])
    at = run["draws"].where("block = 'W'").orderBy("row").toPandas()["value"].to_numpy()
    assert np.allclose(at, means * 120 / (120 + math.exp(-2.0)), atol=1e-3)
    model.close()


def test_hyperparameters_of_the_mode(spark):
    model, _, rows = normal_model(spark)
    spec = gmlm.Spec(2, 0, kind="sq_err", hyper=1)
    scale = horseshoe.BlockScale(spec, "W", 0)
    own = gmlm.Model(model.rows, spec, [scale.prior], horseshoe.chain([scale]))
    start = gmlm.empty_params(spec) | {"W": np.array([0.3, -0.2]), "H": np.array([0.2])}
    best = own.fit([start], prior=True, hyper=True, tolerance=1e-12)[0]
    found = own.log_posterior(best["params"])
    assert best["converged"] and found["log_posterior"] == pytest.approx(best["value"]) and max(np.abs(found["gradient"][k]).max() for k in ("W", "H")) < 1e-2
    assert best["params"]["H"][0] != 0.2 and best["value"] > own.fit([start], prior=True)[0]["value"]

    def value(p):
        out = own.log_posterior(p)
        return out["log_posterior"], {k: out["gradient"][k] for k in ("W", "H")}

    check(value, start, rel=1e-4)
    hessian = own.hessian(best["params"])
    assert hessian.shape == (3, 3) and np.linalg.eigvalsh(hessian).max() < 0
    own.close()
    model.close()


def test_scaling_step_keeps_rates_and_the_prior():
    spec = gmlm.Spec(3, 0, (gmlm.Group("g", (4,), (0,), (gmlm.Factor("a", 4),), 1),))
    priors = [gmlm.gaussian_prior({"g.V": 0.0, "g.T0": 0.0})]
    rng = np.random.default_rng(0)
    step = sampler.scaling_step(spec, 0, priors, width=0.5)
    norms = []
    for _ in range(400):  # draws from the prior stay draws from it
        p = gmlm.empty_params(spec) | {"g.V": rng.standard_normal((3, 1)), "g.T0": rng.standard_normal((4, 1))}
        q = step(rng, p)
        assert np.allclose(q["g.T0"] @ q["g.V"].T, p["g.T0"] @ p["g.V"].T)
        norms.append(float((q["g.V"] ** 2).sum()))
    assert np.mean(norms) == pytest.approx(3.0, abs=0.45)


@pytest.mark.parametrize(("p", "a", "b"), [(2.0, 3.0, 0.0), (-2.5, 0.0, 3.0), (0.5, 2.0, 3.0), (-1.5, 1.0, 0.2), (3.0, 0.5, 4.0), (0.0, 1.0, 1.0), (0.1, 0.01, 0.02)])
def test_generalized_inverse_gaussian(p, a, b):
    rng = np.random.default_rng(4)
    x = np.array([sampler.generalized_inverse_gaussian(rng, p, a, b) for _ in range(8000)])
    t = np.linspace(-30, 30, 60_001)
    density = np.exp(p * t - 0.5 * (a * np.exp(t) + b * np.exp(-t)))
    logs = (t * density).sum() / density.sum()
    spread = math.sqrt((t * t * density).sum() / density.sum() - logs**2)
    assert np.log(x).mean() == pytest.approx(logs, abs=5 * spread / math.sqrt(len(x))) and np.log(x).std() == pytest.approx(spread, rel=0.06)


def test_unit_draws_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, 1.0 + i, 2.0) for i in range(20)], "unit int, a double, b double")
    make = lambda rng, a, b: sampler.dirichlet(rng, np.array([a, b]))
    one, two = (sorted(map(tuple, sampler.unit_draws(rows.repartition(k), ["unit"], ["a", "b"], 3, make, ["p", "q"]).collect())) for k in (1, 5))
    assert one == two and len(one) == 60 and all(r[2] + r[3] == pytest.approx(1.0) for r in one)


def test_sinks_come_out_of_chunks(spark, tmp_path, monkeypatch):
    """A run reads its rows once, when they are packed; a trial's bins are summed before they leave a task."""
    rows = spark.createDataFrame([(p, t, float((p * t + b) % 3), 1.0) for p in range(2) for t in range(5) for b in range(40)], "neuron_ix bigint, trial int, y double, w double")
    seen, run = [], sampler.gmlm.unit_sums
    model = gmlm.Model(rows, gmlm.Spec(2, 0), [gmlm.gaussian_prior({"W": 0.0})], keys=["neuron_ix", "trial"])
    monkeypatch.setattr(sampler.gmlm, "unit_sums", lambda chunks, *a: seen.append(chunks is model.chunks) or run(chunks, *a))
    monkeypatch.setattr(sampler.gmlm, "rates", lambda *a: pytest.fail("a job read the rows"))
    own = sampler.settings(2, 3, schedule=[(1, 2)], mass=[], block=5, first_step=0.01, least_step=0.01, length=0.02, most_steps=2)
    found = sampler.sample(model, [gmlm.empty_params(model.spec)] * 2, own, str(tmp_path / "c"), ["neuron_ix", "trial"])
    assert seen == [True] and found["trial_ll"].count() == 2 * 3 * 10
    last = {r["row"]: r["value"] for r in found["draws"].where("chain = 1 AND iter = 5 AND block = 'W'").collect()}
    lls = {(r["neuron_ix"], r["trial"]): r["ll"] for r in found["trial_ll"].where("chain = 1 AND iter = 5").collect()}
    for p in range(2):
        for t in range(5):
            y = np.array([(p * t + b) % 3 for b in range(40)])
            assert lls[p, t] == pytest.approx((y * last[p] - np.exp(last[p])).sum())
    model.close()


def test_noise_steps_read_distinct_bins(spark):
    rows = spark.range(4000).selectExpr("id % 3 AS neuron_ix", "cast(id % 10 AS double) AS y", "1.0D AS w").coalesce(1)
    model = gmlm.Model(rows, gmlm.Spec(3, 0, kind="sq_err"), [gmlm.gaussian_prior({"W": 3.0}), sampler.noise_prior()], keys=["neuron_ix"])
    import pyarrow as pa

    held = [gmlm.Packed.loaded(pa.scalar(r["packed"], pa.binary())) for r in model.chunks.collect()]
    assert sum(len(h.block.y) for h in held) <= 30 and sum(len(h.bin) for h in held) <= 30
    n, s = gmlm.squared_errors(model.chunks, model.spec, gmlm.empty_params(model.spec) | {"W": np.array([1.0, 2.0, 3.0])})
    y, p = np.arange(4000) % 10, np.arange(4000) % 3
    assert np.allclose(n, np.bincount(p)) and np.allclose(s, np.bincount(p, weights=(y - p - 1.0) ** 2))
    model.close()
