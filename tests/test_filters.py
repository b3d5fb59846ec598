"""Composed priors, third derivatives and the evidence of all likelihoods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.functions import likelihood, stimulus
from spikeloom.plans import filters, fits, gmlm


def slope(f, x, step=1e-5):
    return np.array([(f(x + step * e) - f(x - step * e)) / (2 * step) for e in np.eye(len(x))])


def parts():
    degrees, category = np.arange(0, 360, 60), np.array([0, 0, 0, 1, 1, 1])
    return stimulus.design(degrees, category, "cosine", True).pieces


def test_composed_prior_and_its_derivatives():
    pieces = parts()
    own = filters.all_filters(pieces, 2, 3, 4)
    rng = np.random.default_rng(0)
    w, h = rng.standard_normal(own.length), 0.3 * rng.standard_normal(own.hypers)
    assert own.hypers == sum(p.hypers for p in pieces) + 2 and own.length == 2 * len(pieces[0].loads) + 3 + 4 + 1
    lp, dw, dh = own.log_prior(w, h)
    assert np.allclose(slope(lambda x: own.log_prior(x, h)[0], w), dw, rtol=1e-5, atol=1e-6)
    p, slopes, logdet, rank = own.precision(h)
    assert p[-1].any() == False and rank <= own.length - 1  # noqa: E712  the constant has no prior
    if rank == own.length - 1:
        assert np.allclose(slope(lambda x: own.log_prior(w, x)[0], h), dh, rtol=1e-4, atol=1e-5)
        for i, e in enumerate(np.eye(own.hypers)):
            assert np.allclose((own.precision(h + 1e-6 * e)[0] - own.precision(h - 1e-6 * e)[0]) / 2e-6, slopes[i], rtol=1e-4, atol=1e-5)
        assert logdet == pytest.approx(np.linalg.slogdet(p[:-1, :-1])[1])
    blocks = [q for q, *_ in own.places()]
    assert [b.name for b in blocks] == ["stimulus", "lever", "history", "constant"] and "history" not in [b.name for b in filters.all_filters(pieces, 2, 3).parts]


def test_structured_prior_has_hyperparameters_by_mode():
    pieces = parts()
    n = len(pieces[0].loads)
    groups = (gmlm.Group("s", (3, n), (0, 1), (gmlm.Factor("a", 3), gmlm.Factor("b", n)), 2), gmlm.Group("r", (4,), (0,), (gmlm.Factor("c", 4),), 1))
    named = {"s.T1": filters.stimuli("stimulus", pieces), "r.T0": filters.independent("lever", 4), "B": filters.independent("history", 2), "s.T0": None}
    hypers = sum(p.hypers for p in named.values() if p)
    spec = gmlm.Spec(3, 2, groups, hyper=hypers + 1)
    prior, size = filters.structured(spec, named, first=1)
    assert size == hypers
    params = gmlm.random_params(spec, 1, 1.0) | {"H": np.linspace(-0.3, 0.4, spec.hyper)}
    _, grads = prior(params)
    assert "s.T0" not in grads and grads["H"][0] == 0
    for k, g in grads.items():
        flat = slope(lambda v, k=k: prior(params | {k: v.reshape(params[k].shape)})[0], params[k].ravel())
        assert np.allclose(flat, g.ravel(), rtol=1e-4, atol=1e-5), k
    with pytest.raises(ValueError):
        filters.structured(spec, {"r.T0": filters.independent("lever", 3)})


@pytest.mark.parametrize("kind", sorted(likelihood.LIKELIHOODS))
def test_third_derivatives_and_arrays(spark, kind):
    rows = [(float(x), float(y)) for x in np.linspace(-4, 4, 17) for y in ((-1, 0, 1, 3) if kind != "sq_err" else (-1.5, 0.2, 3))]
    x, step = F.col("x"), 1e-4
    at = lambda d: likelihood.terms(kind, x + d, F.col("y"), 0.5)[2]
    found = spark.createDataFrame(rows, "x double, y double").select("x", "y", at(0.0).alias("second"), likelihood.third(kind, x, F.col("y"), 0.5).alias("third"), ((at(step) - at(-step)) / (2 * step)).alias("want")).toPandas()
    assert np.allclose(found["third"], found["want"], rtol=1e-5, atol=1e-6)
    assert np.allclose(likelihood.curvature(kind, found["x"].to_numpy(), found["y"].to_numpy(), 0.5), found["second"], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("kind", sorted(likelihood.LIKELIHOODS))
def test_evidence_gradient_of_every_likelihood(spark, kind):
    rng = np.random.default_rng(3)
    z = rng.integers(-2, 3, 200) / 2
    y = rng.normal(0.3 + 0.5 * z) if kind == "sq_err" else rng.poisson(np.exp(0.1 + 0.4 * z)).clip(0, 1 if kind == "poiss_refractory" else 9).astype(float)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(z, np.round(y, 1), strict=True)], "z double, y double").coalesce(1)
    prior = filters.Composed([filters.independent("slope", 1), filters.free("constant", 1)]) if kind in ("poiss_exp", "sq_err") else fits.group_covariance([2])
    own = fits.Evidence(rows, [F.col("z"), F.lit(1.0)], prior, kind)
    h, step = np.array([-0.4]), 1e-3
    value, gradient = own.value(h)
    up, down = own.value(h + step)[0], own.value(h - step)[0]
    assert np.isfinite(value) and gradient[0] == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=1e-4)
    own.close()


def test_percentiles_without_a_units_values_in_a_row(spark):
    from spikeloom.plans import compare

    rng = np.random.default_rng(4)
    rows = [(0, float(v)) for v in rng.normal(size=5000)] + [(1, float(v)) for v in np.exp(20 * rng.normal(size=3000))] + [(2, float(v)) for v in rng.integers(0, 5, 400)] + [(3, 7.5), (4, None), (5, 1.0), (5, 2.0)]
    frame = spark.createDataFrame(rows, "unit int, x double").repartition(3)
    qs = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    some = {r["unit"]: r[1:] for r in compare.percentiles(frame, "x", ["unit"], qs, few=10_000).collect()}
    binned = {r["unit"]: r[1:] for r in compare.percentiles(frame, "x", ["unit"], qs, few=1).collect()}
    assert set(some) == set(binned) == {0, 1, 2, 3, 5}
    for u in some:
        x = np.sort([v for k, v in rows if k == u])
        want = np.interp(np.array(qs) * len(x) + 0.5, np.arange(1, len(x) + 1), x)
        assert np.allclose(some[u], want, rtol=1e-12) and np.allclose(binned[u], want, rtol=1e-12)
