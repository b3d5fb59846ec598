"""The multilinear model against a loop over bins and finite differences, over all structures and likelihoods."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from spikeloom.functions.likelihood import LIKELIHOODS
from spikeloom.plans import gmlm

#: factor of each mode, shared?, identity?, local depth one?
SCENARIOS = [([0], "T", "F", "F"), ([0], "F", "F", "F"), ([0, 1], "FT", "FF", "FF"), ([0, 1], "FT", "FT", "FF"), ([0, 0, 1, 1], "FT", "FF", "FF"), ([0, 0, 1, 1], "FT", "FT", "FF"),
             ([0, 0, 0, 1], "FT", "FF", "FF"), ([0, 0, 1, 1], "FT", "FF", "TF"), ([0, 1], "FT", "FF", "TF"), ([0, 1], "FF", "FF", "TF"), ([0, 1, 2, 3], "FFTT", "FFFT", "TFFF")]


def made(scenario, kind, rank=3, seed=0, n=60, neurons=4, events=2, linear=2):
    factor_of, shared, identity, shallow = scenario
    rng = np.random.default_rng(seed)
    modes = tuple(int(x) for x in rng.integers(1, 4, len(factor_of)))
    factors, values = [], {}
    for d in range(len(shared)):
        size = int(np.prod([t for t, k in zip(modes, factor_of) if k == d]))
        table = None if shared[d] == "F" else size if identity[d] == "T" else rng.normal(size=(9, size)) / np.sqrt(size)
        factors.append(gmlm.Factor(f"f{d}", table))
        rows = size if isinstance(table, int) else 9
        values[f"f{d}"] = rng.integers(-3, rows + 4, (n, events)) if table is not None else rng.normal(size=(n, 1 if shallow[d] == "T" else events, size)) / np.sqrt(size)
    spec = gmlm.Spec(neurons, linear, (gmlm.Group("g", modes, tuple(factor_of), tuple(factors), rank, events),), kind, 0.5)
    block = gmlm.Block(rng.integers(0, 3, n).astype(float), rng.integers(0, neurons, n), rng.uniform(0, 2, n), rng.normal(size=(n, linear)) / 2, values)
    block.y[:3] = -1.0
    params = {k: v * 0.4 for k, v in gmlm.random_params(spec, seed, 1.0).items()}
    if kind == "sq_err":
        block.y[:3] = 0.5
    return spec, block, params


def slow_rate(spec, block, params):
    out = []
    for i in range(len(block.y)):
        p = block.neuron[i]
        x = params["W"][p] + block.x_lin[i] @ params["B"][:, p]
        for g in spec.groups:
            for r, a in itertools.product(range(g.rank), range(g.events)):
                v = params[f"{g.name}.V"][p, r]
                for d, f in enumerate(g.factors):
                    column = np.ones(1)
                    for s in range(len(g.modes)):
                        if g.factor_of[s] == d:
                            column = np.kron(params[f"{g.name}.T{s}"][:, r], column)
                    value = block.factors[f.column][i]
                    if f.table is None:
                        v *= value[a if len(value) > 1 else 0] @ column
                    else:
                        table = np.eye(f.table) if isinstance(f.table, int) else f.table
                        v *= table[value[a]] @ column if 0 <= value[a] < len(table) else 0.0
                x += v
        out.append(x)
    return np.array(out)


@pytest.mark.parametrize("kind", sorted(LIKELIHOODS))
@pytest.mark.parametrize("scenario", range(len(SCENARIOS)))
def test_rates_and_derivatives(scenario, kind):
    for rank in (3, 0):
        spec, block, params = made(SCENARIOS[scenario], kind, rank, seed=scenario)
        assert np.allclose(gmlm.Prepared(spec, params).rate(block)[0], slow_rate(spec, block, params))
        blocks = {k for k in spec.shapes() if k != "H"}
        sums = {k: np.zeros(spec.shapes()[k]) for k in blocks}
        gmlm.Prepared(spec, params).add(block, sums, blocks)
        flat, got, h = gmlm.vectorize(spec, params), gmlm.vectorize(spec, sums, blocks), 1e-5
        value = lambda w: gmlm.Prepared(spec, gmlm.devectorize(spec, w)).add(block, {}, set())
        for i in range(0, len(flat), 3):
            step = np.zeros(len(flat))
            step[i] = h
            want = (45 * (value(flat + step) - value(flat - step)) - 9 * (value(flat + 2 * step) - value(flat - 2 * step)) + value(flat + 3 * step) - value(flat - 3 * step)) / (60 * h)
            assert got[i] == pytest.approx(want, rel=1e-6, abs=1e-7)


def test_jacobian_of_the_product():
    rng = np.random.default_rng(1)
    modes = [rng.normal(size=(t, 2)) for t in (3, 2, 4)]
    for s in range(3):
        jac = gmlm.khatri_rao_jacobian(modes, s)
        assert np.allclose(np.einsum("ftr,tr->fr", jac, modes[s]), gmlm.khatri_rao(modes))


def frame(spark, spec, block, extra=()):
    columns = {"trial": [i // 6 for i in range(len(block.y))], "neuron_ix": block.neuron.tolist(), "y": block.y.tolist(), "w": block.w.tolist(), "x_lin": block.x_lin.tolist(), **{c: v.tolist() for c, v in block.factors.items()}, **dict(extra)}
    schema = ["trial bigint", "neuron_ix bigint", "y double", "w double", "x_lin array<double>", *(f"{c} array<{'bigint' if v.ndim == 2 else 'array<double>'}>" for c, v in block.factors.items()), *(f"{k} bigint" for k in dict(extra))]
    return spark.createDataFrame([*zip(*columns.values())], ", ".join(schema)).repartition(3)


def test_jobs_agree_with_blocks(spark):
    spec, block, params = made(SCENARIOS[10], "poiss_exp")
    block.w[5:9] = 0.0
    rows = frame(spark, spec, block, {"fold": (np.arange(60) % 3).tolist()})
    blocks = {k for k in spec.shapes() if k != "H"}
    other = {k: v * 0.5 for k, v in params.items()}
    found = gmlm.evaluate(rows, spec, [params, other], None, [1, None])
    for (ll, grads), p, seen in ((found[0], params, np.arange(60) % 3 != 1), (found[1], other, np.ones(60, bool))):
        own = gmlm.Block(block.y[seen], block.neuron[seen], block.w[seen], block.x_lin[seen], {c: v[seen] for c, v in block.factors.items()})
        sums = {k: np.zeros(spec.shapes()[k]) for k in blocks}
        assert ll == pytest.approx(gmlm.Prepared(spec, p).add(own, sums, blocks))
        assert all(np.allclose(grads[k], sums[k]) for k in blocks)
    some = gmlm.evaluate(rows, spec, [params], ["W"])[0]
    assert set(some[1]) == {"W"}
    sums = gmlm.trial_ll(rows, spec, params, ["trial"]).toPandas()
    assert sums["ll"].sum() == pytest.approx(gmlm.evaluate(rows, spec, [params], [])[0][0])
    assert gmlm.evaluate(rows.limit(0), spec, [params])[0][0] == 0.0


def test_fits_and_folds(spark):
    spec, block, truth = made(SCENARIOS[3], "poiss_exp", rank=1, n=600)
    block.w[:] = 1.0
    rng = np.random.default_rng(2)
    block.y = rng.poisson(np.exp(gmlm.Prepared(spec, truth).rate(block)[0]) * spec.dt).astype(float)
    rows = frame(spark, spec, block, {"fold": (np.arange(600) // 6 % 3).tolist()})
    model = gmlm.Model(rows, spec, [gmlm.gaussian_prior({k: 1.0 for k in spec.shapes() if k != "H"})])
    start = gmlm.random_params(spec, 5)
    mle, again = model.fit([start, gmlm.random_params(spec, 6)])
    at_truth = model.log_likelihood(truth, [])[0]
    assert mle["converged"] and max(mle["value"], again["value"]) > at_truth
    assert model.log_likelihood(mle["params"], [])[0] == pytest.approx(mle["value"])  # normalization changes no rate
    best = model.fit([start], prior=True, tolerance=1e-10)[0]
    free = [k for k in spec.shapes() if k != "H"]
    found = model.log_posterior(best["params"])
    gradient = gmlm.vectorize(spec, found["gradient"], free)
    # the result is the mode itself, and the value is its own
    assert best["value"] <= mle["value"] and np.abs(gradient).max() < 1e-3 * abs(best["value"]) and found["log_posterior"] == pytest.approx(best["value"], rel=1e-9)
    hessian, x = model.hessian(best["params"]), gmlm.vectorize(spec, best["params"], free)
    assert np.linalg.eigvalsh(hessian).max() < 1e-3
    values, vectors = model.lanczos(best["params"], steps=len(x))
    assert values.min() == pytest.approx(np.linalg.eigvalsh(hessian).min(), rel=1e-3) and vectors.shape[0] == len(x)
    for kind in ("combinations", "all"):
        turned = model.alternate(start, prior=True, sweeps=4, kind=kind, steps=20)
        assert turned["value"] > best["value"] - 20
    assert {frozenset(t) for t in model.schedule("combinations")} == {frozenset({"W", "B", k}) for k in ("g.V", "g.T0", "g.T1")}
    turns = model.alternate(start, sweeps=6, steps=20)
    assert turns["value"] > model.log_likelihood(start, [])[0] and turns["value"] > at_truth - 30
    scored = model.cross_validate(start, 3, ["trial"], prior=True, steps=8).toPandas()
    assert len(scored) == 100 and set(scored["fold"]) == {0, 1, 2}
    # a fold's fit doesn't see the fold: other counts there change nothing
    alone = model.fit([start], True, None, [1], steps=8)[0]["params"]
    block.y[(np.arange(600) // 6 % 3) == 1] = 7.0
    other = gmlm.Model(frame(spark, spec, block, {"fold": (np.arange(600) // 6 % 3).tolist()}), spec, model.priors).fit([start], True, None, [1], steps=8)[0]["params"]
    assert all(np.allclose(alone[k], other[k]) for k in alone)
    model.close()


def test_normalization_and_loadings():
    spec, block, params = made(SCENARIOS[4], "poiss_exp")
    for into_v in (False, True):
        flat = gmlm.normalize(spec, params, into_v)
        assert np.allclose(gmlm.Prepared(spec, flat).rate(block)[0], gmlm.Prepared(spec, params).rate(block)[0])
        norms = np.array([np.linalg.norm(flat[k], axis=0) for k in flat if k.startswith("g.")])
        assert np.allclose(norms[1:], 1.0) if into_v else np.allclose(norms, norms[0])
    g = spec.groups[0]
    tensor = np.einsum("pr,ar,br,cr,dr->pabcd", *(params[k] for k in ("g.V", *(f"g.T{s}" for s in range(4)))))
    for axis, (u, s) in enumerate(gmlm.loadings(spec, params, 0)):
        want = np.linalg.svd(np.moveaxis(tensor, axis, 0).reshape(tensor.shape[axis], -1), compute_uv=False)
        assert np.allclose(s[: len(want)], want[: len(s)], atol=1e-9)
    one = gmlm.Spec(4, 0, (gmlm.Group("m", (5,), (0,), (gmlm.Factor("f", 5),), 3),))
    p = gmlm.random_params(one, 3, 1.0)
    q = gmlm.normalize(one, p, True)
    assert np.allclose(q["m.T0"] @ q["m.V"].T, p["m.T0"] @ p["m.V"].T)


def test_models_check_their_rows(spark):
    spec = gmlm.Spec(2, 1)
    good = [(0, 1.0, 1.0, [0.5]), (1, -1.0, 0.0, [0.5])]
    schema = "neuron_ix bigint, y double, w double, x_lin array<double>"
    gmlm.Model(spark.createDataFrame(good, schema), spec).close()
    for rule, row in (("y", (0, float("nan"), 1.0, [0.5])), ("count", (0, 0.5, 1.0, [0.5])), ("weight", (0, 1.0, None, [0.5])), ("neuron", (2, 1.0, 1.0, [0.5])), ("linear", (0, 1.0, 1.0, []))):
        assert gmlm.broken_rows(spark.createDataFrame([*good, row], schema), spec) == {rule: 1}
        with pytest.raises(ValueError):
            gmlm.Model(spark.createDataFrame([*good, row], schema), spec)


def test_loadings_of_stored_draws(spark):
    spec, _, _ = made(SCENARIOS[2], "poiss_exp", rank=2, neurons=9)
    blocks = ["g.V", "g.T0", "g.T1"]
    sets = [gmlm.random_params(spec, k, 1.0) for k in range(3)]
    rows = [(d, k, i, j, float(v)) for d, p in enumerate(sets) for k in blocks for (i, j), v in np.ndenumerate(p[k])]
    found = gmlm.loadings_table(spark.createDataFrame(rows, "draw int, block string, row int, col int, value double").repartition(3), ["draw"], 2).toPandas()
    for d, p in enumerate(sets):
        for k, (u, s) in zip(blocks, gmlm.loadings(spec, p, 0), strict=True):
            own = found[(found["draw"] == d) & (found["block"] == k)]
            for r in range(min(2, len(s))):
                mine = own[own["component"] == r].sort_values("row")
                assert np.allclose(mine["singular_value"], s[r], atol=1e-7)
                if s[r] > 1e-6:
                    assert np.allclose(mine["loading"], u[:, r] * np.sign(u[:, r].sum()), atol=1e-6)


def test_specs_and_parameters_are_checked():
    with pytest.raises(ValueError, match="columns"):
        gmlm.Spec(1, 0, (gmlm.Group("g", (3,), (0,), (gmlm.Factor("f", 4),), 1),))
    with pytest.raises(ValueError, match="mode"):
        gmlm.Spec(1, 0, (gmlm.Group("g", (3, 2), (0,), (gmlm.Factor("f", 3),), 1),))
    spec = gmlm.Spec(2, 1)
    with pytest.raises(ValueError, match="B"):
        gmlm.verify(spec, {**gmlm.empty_params(spec), "B": np.zeros((2, 2))})
    v = np.arange(4.0)
    assert np.array_equal(gmlm.vectorize(spec, gmlm.devectorize(spec, v)), v)
    assert gmlm.log_det(np.diag([2.0, 3.0])) == pytest.approx(np.log(6)) and gmlm.log_det(np.zeros((2, 2))) == pytest.approx(np.log(1e-20))


def test_priors_of_blocks():
    spec, _, params = made(SCENARIOS[3], "poiss_exp")
    rng = np.random.default_rng(0)
    n = spec.groups[0].modes[0]
    a = rng.normal(size=(n, n))
    for prior, block in ((gmlm.gaussian_prior({"g.V": 0.3}), "g.V"), (gmlm.covariance_prior("g.T0", a @ a.T + np.eye(n)), "g.T0")):
        lp, grads = prior(params)
        h = 1e-6
        for at in np.ndindex(params[block].shape):
            up, down = ({**params, block: params[block] + s * h * (np.arange(params[block].size).reshape(params[block].shape) == np.ravel_multi_index(at, params[block].shape))} for s in (1, -1))
            assert grads[block][at] == pytest.approx((prior(up)[0] - prior(down)[0]) / (2 * h), rel=1e-5, abs=1e-6)


def test_blocks_read_arrow_lists():
    batch = pa.RecordBatch.from_pydict({"y": [1.0, 2.0], "neuron_ix": [0, 1], "w": [1.0, 1.0], "x_lin": [[1.0, 2.0], [3.0, 4.0]], "f0": [[[1.0], [2.0]], [[3.0], [4.0]]]})
    spec = gmlm.Spec(2, 2, (gmlm.Group("g", (1,), (0,), (gmlm.Factor("f0"),), 1, 2),))
    block = gmlm.to_block(batch.slice(1), spec)
    assert block.x_lin.tolist() == [[3.0, 4.0]] and block.factors["f0"].tolist() == [[[3.0], [4.0]]]


def test_fit_by_neuron(spark, monkeypatch):
    from spikeloom.plans import by_neuron

    DataFrame = type(spark.range(1))
    monkeypatch.setattr(by_neuron, "SHARE", 60)  # neurons of several salts
    spec, block, truth = made(SCENARIOS[3], "poiss_exp", rank=1, n=800)
    block.w[:] = 1.0
    block.y = np.random.default_rng(2).poisson(np.exp(gmlm.Prepared(spec, truth).rate(block)[0]) * spec.dt).astype(float)
    block.y[:5] = -1.0
    rows = frame(spark, spec, block)
    ridge = {"W": 0.1, "B": 0.2, "g.V": 0.5, "g.T0": 0.5, "g.T1": 0.5}
    model = gmlm.Model(rows, spec, [gmlm.gaussian_prior({k: -0.5 * np.log(v) for k, v in ridge.items()})])
    start = gmlm.random_params(spec, 5)
    constant = gmlm.prior_sum(model.priors, gmlm.empty_params(spec))[0]
    best = model.fit([start, truth], prior=True, tolerance=1e-12, steps=500)
    sizes = []
    collect, pandas = DataFrame.collect, DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "collect", lambda self: sizes.append(len(out := collect(self))) or out)
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: sizes.append(len(out := pandas(self))) or out)
    own = by_neuron.Fit(rows, spec, start, precision=ridge)
    found = own.run(25, 1e-9)
    assert max(sizes) <= 1 + max(n + n * n for n in (truth[k].size for k in own.modes))  # nothing by neuron
    monkeypatch.undo()
    assert found["converged"] and found["value"] + constant == pytest.approx(max(b["value"] for b in best), rel=1e-6)
    table = own.parameters().toPandas()
    params = gmlm.empty_params(spec)
    for block_, i, j, v in table.itertuples(index=False):
        params[block_][(i, j) if params[block_].ndim == 2 else i] = v
    assert model.log_posterior(params)["log_posterior"] == pytest.approx(found["value"] + constant, rel=1e-9)
    before = own.sums(None)[0]
    own.normalize()
    assert own.sums(None)[0] == pytest.approx(before, rel=1e-9)
    own.close()
    model.close()


@pytest.mark.parametrize("scenario", range(len(SCENARIOS)))
@pytest.mark.parametrize("kind", ["poiss_softrec", "sq_err"])
def test_regressors_of_neurons_and_modes(scenario, kind):
    from spikeloom.plans import by_neuron

    spec, block, params = made(SCENARIOS[scenario], kind)
    theta = np.concatenate([params["W"][:, None], params["B"].T, params["g.V"]], axis=1)[block.neuron]
    z, parts = by_neuron.features(spec, params, block)
    x = gmlm.Prepared(spec, params).rate(block)[0]
    assert np.allclose((z * theta).sum(axis=1), x)
    from spikeloom.functions.likelihood import numeric

    sums = {k: np.zeros(s) for k, s in spec.shapes().items()}
    gmlm.Prepared(spec, params).add(block, sums, set(sums))
    _, slope = numeric(kind, x, block.y, spec.dt)
    for s in range(len(spec.groups[0].modes)):
        m = by_neuron.mode_features(spec, params, block, parts, theta, 0, s)
        assert np.allclose((m.T @ (slope * block.w)).reshape(sums[f"g.T{s}"].shape, order="F"), sums[f"g.T{s}"])


def test_fit_by_neuron_broadcasts_no_bins(spark):
    from spikeloom.plans import by_neuron

    spec, block, truth = made(SCENARIOS[3], "poiss_exp", rank=1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        own = by_neuron.Fit(frame(spark, spec, block), spec, truth)
        own.neurons(True)
        plan = own.joined()
        assert len(plan.collect()) and "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
        own.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chunks_hold_each_kind_of_bin_once(spark):
    spec, block, params = made(SCENARIOS[3], "poiss_exp")
    block.w[5:9] = 0.0
    fold = [None if i % 7 == 0 else i % 3 for i in range(60)]
    rows = frame(spark, spec, block, {"fold": fold})
    rows = rows.unionByName(rows).unionByName(rows.withColumn("w", rows["w"] * 2))
    chunks = gmlm.packed(rows, spec, ["trial"], True, chunk=50).persist()
    held = [1, None]
    for known in (None, held):
        for (a, g), (b, h) in zip(gmlm.evaluate(rows, spec, [params, params], None, known), gmlm.evaluate(chunks, spec, [params, params], None, known), strict=True):
            assert a == pytest.approx(b) and all(np.allclose(g[k], h[k]) for k in g)
    whole = gmlm.packed(rows.coalesce(1), spec, ["trial"], True).collect()
    assert len(gmlm.Packed.loaded(pa.scalar(whole[0]["packed"], pa.binary())).block.y) <= 56
    sums = {r["trial"]: r["ll"] for r in gmlm.unit_sums(chunks, spec, [params], ["trial"], ["bigint"]).collect()}
    want = {r["trial"]: r["ll"] for r in gmlm.trial_ll(rows, spec, params, ["trial"]).collect()}
    assert sums == pytest.approx(want)
    chunks.unpersist()


@pytest.mark.parametrize("values", [[0.0, 3.0], [0.5, 1.0], [-0.0, 1.0], [np.nan, 1.0], [2.0**40, 0.0], [200.0, -1.0], [70000.0, 1.0]])
def test_lean_arrays_come_back(values):
    a, kind = gmlm.lean(np.array(values))
    out = a if kind is None else a.astype(kind)
    assert out.dtype == np.float64 and out.tobytes() == np.array(values).tobytes()


def test_scales_are_inverse_blocks_of_the_hessian(spark):
    spec, block, params = made(SCENARIOS[3], "poiss_exp", rank=2, n=400)
    block.w[:] = 1.0
    model = gmlm.Model(frame(spark, spec, block), spec, [gmlm.gaussian_prior({k: 0.0 for k in spec.shapes() if k != "H"})])
    for blocks in ({"W", "B", "g.V"}, {"g.T0"}, {"g.T1"}):  # given the rest, each is a linear model: the scale is the whole inverse
        hessian = model.hessian(params, blocks=blocks)
        scale = model.scales([params], blocks, None, True)[0]
        found = np.stack([scale(e) for e in np.eye(len(hessian))])
        assert np.allclose(found @ -hessian, np.eye(len(hessian)), atol=1e-3)
    model.close()


def test_fits_in_turn_take_few_jobs(spark, monkeypatch):
    spec, block, truth = made(SCENARIOS[3], "poiss_exp", rank=1, n=600)
    block.w[:] = 1.0
    block.y = np.random.default_rng(2).poisson(np.exp(gmlm.Prepared(spec, truth).rate(block)[0]) * spec.dt).astype(float)
    model = gmlm.Model(frame(spark, spec, block), spec, [gmlm.gaussian_prior({k: 1.0 for k in spec.shapes() if k != "H"})])
    calls, evaluate = [], gmlm.evaluate
    monkeypatch.setattr(gmlm, "evaluate", lambda *a: calls.append(1) or evaluate(*a))
    turned = model.alternate(gmlm.random_params(spec, 5), prior=True, sweeps=2, steps=20, tolerance=1e-9)
    few = len(calls)
    plain = model.alternate(gmlm.random_params(spec, 5), prior=True, sweeps=2, steps=20, tolerance=1e-9, scaled=False)
    assert few < 0.7 * (len(calls) - few) and turned["value"] > plain["value"] - 0.5
    model.close()


def test_folds_are_scored_in_one_pass(spark, monkeypatch):
    spec, block, _ = made(SCENARIOS[3], "poiss_exp", rank=1)
    block.w[:] = 1.0
    rows = frame(spark, spec, block, {"fold": (np.arange(60) // 6 % 3).tolist()})
    model = gmlm.Model(rows, spec, [gmlm.gaussian_prior({k: 0.0 for k in spec.shapes() if k != "H"})], keys=["trial"])
    start = gmlm.random_params(spec, 5)
    monkeypatch.setattr(gmlm, "rates", lambda *a: pytest.fail("a job read the rows"))
    found = {r["trial"]: (r["fold"], r["ll"]) for r in model.cross_validate(start, 3, ["trial"], prior=True, steps=0).collect()}
    ll, _ = gmlm.numeric(spec.kind, gmlm.Prepared(spec, start).rate(block)[0], block.y, spec.dt)
    want = np.bincount(np.arange(60) // 6, weights=ll)
    assert all(found[t] == (t % 3, pytest.approx(want[t])) for t in range(10))
    model.close()


def test_joint_fits_begin_with_blocks(spark, monkeypatch):
    spec, block, truth = made(SCENARIOS[3], "poiss_exp", rank=1, n=600)
    block.w[:] = 1.0
    block.y = np.random.default_rng(2).poisson(np.exp(gmlm.Prepared(spec, truth).rate(block)[0]) * spec.dt).astype(float)
    model = gmlm.Model(frame(spark, spec, block), spec, [gmlm.gaussian_prior({k: 0.0 for k in spec.shapes() if k != "H"})])
    asked, curvatures = [], gmlm.curvatures
    monkeypatch.setattr(gmlm, "curvatures", lambda rows, spec, sets, blocks, *a: asked.append(frozenset(blocks)) or curvatures(rows, spec, sets, blocks, *a))
    start = gmlm.random_params(spec, 5)
    best = model.fit([start], prior=True, steps=60, tolerance=1e-9)[0]
    assert best["converged"] and asked[0] == {"W", "B", "g.V"} and frozenset({"W", "B", "g.V", "g.T0", "g.T1"}) in asked
    assert best["value"] > model.fit([start], prior=True, steps=60, tolerance=1e-9, scaled=False)[0]["value"] - 0.1
    model.close()
