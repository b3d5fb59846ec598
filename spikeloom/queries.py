"""Registered queries of the model operators over the event tables, with their SQL.

Parameters are closed forms, so that SQL can rebuild them: W[p] = -1 + 0.05 (p mod 7), history weights 0.1, -0.05 and
a daily cosine for the linear part; T[t,r] = cos((t+1)(r+1))/4, U[d,r] = sin(d+1+r)/2 and V[p,r] = 0.1 (1 + p mod 3) -
0.05 r for the tensor group.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spikeloom.functions import bases, basis_sets, likelihood, priors, stimulus
from spikeloom.functions.likelihood import LIKELIHOODS
from spikeloom.operators import builders, design, model
from spikeloom.plans import by_neuron, compare, filters, fits, gmlm, horseshoe, sampler
from spikeloom.sources import trials

TRIAL = ["neuron", "trial"]
RANK, STEPS, DIRECTIONS, FOLDS, DRAWS = 2, 12, 8, 5, 40
QUERIES: dict = {}
SQL: dict[str, str] = {}

BINS_SQL = """
WITH ev AS (SELECT user_id AS neuron, strftime(ts, '%Y-%m-%d') AS trial, cast(extract(hour FROM ts) AS INT) AS bin, event_type, value FROM events),
cn AS (SELECT neuron, trial, bin, count(*)::DOUBLE AS y FROM ev GROUP BY ALL),
bins AS (SELECT t.neuron, t.trial, h.b::INT AS bin, coalesce(c.y, 0)::DOUBLE AS y FROM (SELECT DISTINCT neuron, trial FROM ev) t CROSS JOIN range(24) h(b) LEFT JOIN cn c ON c.neuron = t.neuron AND c.trial = t.trial AND c.bin = h.b),
times AS (SELECT neuron, trial, min(CASE WHEN event_type = 'view' THEN bin END) AS sample, min(CASE WHEN event_type = 'click' THEN bin END) AS test, min(CASE WHEN event_type = 'purchase' THEN bin END) AS lever FROM ev GROUP BY ALL),
hist AS (SELECT *, coalesce(lag(y, 1) OVER w, 0) AS h1, coalesce(lag(y, 2) OVER w, 0) AS h2, coalesce(lag(y, 3) OVER w, 0) AS h3 FROM bins WINDOW w AS (PARTITION BY neuron, trial ORDER BY bin)),
lin AS (SELECT *, -1 + 0.05 * (neuron % 7) + 0.1 * h1 - 0.05 * h2 + 0.2 * cos(bin * pi() / 12) AS x FROM hist),
eu0 AS (SELECT b.neuron, b.trial, b.bin, b.y, 0 AS event, CASE WHEN b.bin - t.sample BETWEEN 0 AND 11 THEN b.bin - t.sample ELSE -1 END AS ix, (b.neuron % 8)::INT AS f FROM bins b JOIN times t USING (neuron, trial)
  UNION ALL SELECT b.neuron, b.trial, b.bin, b.y, 1, CASE WHEN b.bin - t.test BETWEEN 0 AND 11 THEN b.bin - t.test ELSE -1 END, (b.neuron % 8 + 8)::INT FROM bins b JOIN times t USING (neuron, trial)),
eu AS (SELECT neuron, trial, bin, y, event, ix, CASE WHEN ix >= 0 THEN f ELSE -1 END AS feature FROM eu0),
prod AS (SELECT *, CASE WHEN ix >= 0 THEN cos((ix + 1) * 1) / 4 * sin(feature + 1) / 2 ELSE 0 END AS a0, CASE WHEN ix >= 0 THEN cos((ix + 1) * 2) / 4 * sin(feature + 2) / 2 ELSE 0 END AS a1 FROM eu),
grp AS (SELECT neuron, trial, bin, sum(a0) AS a0, sum(a1) AS a1 FROM prod GROUP BY ALL),
gm AS (SELECT l.neuron, l.trial, l.bin, l.y, l.x + (0.1 * (1 + l.neuron % 3)) * g.a0 + (0.1 * (1 + l.neuron % 3) - 0.05) * g.a1 AS x, g.a0, g.a1 FROM lin l JOIN grp g USING (neuron, trial, bin)),
gd AS (SELECT *, y - exp(x) AS dll FROM gm),
fold AS (SELECT neuron, trial, (neuron + day(strptime(trial, '%Y-%m-%d'))) % 5 AS fold FROM times)
"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql if sql.lstrip().startswith("WITH") else BINS_SQL + sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.table(spark, sf_dir, "events")


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.dense(events(spark, sf_dir))


def timed(spark: SparkSession, sf_dir: str, lags: int = 0) -> DataFrame:
    """Bins with their trial's event times."""
    return trials.binned(events(spark, sf_dir), lags)


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.event_times(events(spark, sf_dir))


def baseline() -> Column:
    return -1 + 0.05 * F.pmod("neuron", F.lit(7))


def regressors() -> list[Column]:
    return [F.col("h1"), F.col("h2"), F.cos(F.col("bin") * (math.pi / 12))]


def lin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins with three lags and the linear log rate x."""
    return timed(spark, sf_dir, 3).withColumn("x", baseline() + model.linear(regressors(), [0.1, -0.05, 0.2]))


def load(r: int) -> Column:
    return 0.1 * (1 + F.pmod("neuron", F.lit(3))) - 0.05 * r


def timing(ix: Column, r: int) -> Column:
    return model.gather(ix, [math.cos((t + 1) * (r + 1)) / 4 for t in range(STEPS)])


def tuning(feature: Column, r: int) -> Column:
    return model.gather(feature, [math.sin(d + 1 + r) / 2 for d in range(2 * DIRECTIONS)])


def factor(r: int) -> tuple[Column, Column]:
    """Gathered rows of the timing and the direction factor."""
    return timing(F.col("ix"), r), tuning(F.col("feature"), r)


def both_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.event_union(timed(spark, sf_dir), DIRECTIONS, STEPS)


def event_products(r: int) -> list[Column]:
    return [timing(ix, r) * tuning(feature, r) for ix, feature in design.two_events(DIRECTIONS, STEPS)]


def with_group(rows: DataFrame) -> DataFrame:
    """a0, a1: the group's products, both events summed in the row."""
    return rows.withColumns({f"a{r}": sum(event_products(r), F.lit(0.0)) for r in range(RANK)})


def group_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_group(timed(spark, sf_dir)).select(*TRIAL, "bin", *(f"a{r}" for r in range(RANK)))


def tensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_group(lin(spark, sf_dir))
    rows = rows.withColumn("x", F.col("x") + sum((load(r) * F.col(f"a{r}") for r in range(RANK)), F.lit(0.0)))
    return model.with_terms(rows, "poiss_exp")


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times(spark, sf_dir).select(*TRIAL, F.pmod(F.col("neuron") + F.dayofmonth(F.to_date("trial")), F.lit(FOLDS)).alias("fold"))


# ---- trials and indices

@query("bin_counts", "SELECT * FROM cn")
def bin_counts(spark, sf_dir):
    return trials.counts(events(spark, sf_dir))


@query("bin_counts_dense", "SELECT * FROM bins")
def bin_counts_dense(spark, sf_dir):
    return bins(spark, sf_dir)


def rates(spark, sf_dir):
    return bins(spark, sf_dir).groupBy("neuron").agg((F.log(F.sum("y")) - F.log(F.count(F.lit(1)).cast("double"))).alias("w"))


RATES_SQL = "(SELECT neuron, ln(sum(y)) - ln(count(*)) AS w FROM bins GROUP BY neuron)"


@query("mean_log_rate", f"SELECT neuron, round(w, 6) AS w FROM {RATES_SQL}")
def mean_log_rate(spark, sf_dir):
    return rounded(rates(spark, sf_dir))


@query("mean_log_rate_summary", f"SELECT round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS sd FROM {RATES_SQL}")
def mean_log_rate_summary(spark, sf_dir):
    return rounded(rates(spark, sf_dir).agg(F.avg("w").alias("mean"), F.stddev_samp("w").alias("sd")))


@query("constant_rate_trial_ll", f"SELECT neuron, trial, round(sum(y * w - exp(w) - lgamma(y + 1)), 6) AS ll FROM bins JOIN {RATES_SQL} USING (neuron) GROUP BY ALL")
def constant_rate_trial_ll(spark, sf_dir):
    """The flagship slice: bins with zeros, a constant-rate Poisson model per neuron, its log likelihood per trial."""
    rows = bins(spark, sf_dir)
    return rounded(model.trial_sums(rows.join(rates(spark, sf_dir).withColumnRenamed("w", "x"), "neuron"), "poiss_exp", normalize=True))


@query("neuron_index", "SELECT neuron, (row_number() OVER (ORDER BY neuron) - 1)::BIGINT AS ix FROM (SELECT DISTINCT neuron FROM ev)")
def neuron_index(spark, sf_dir):
    """Dense index by position: ranges of ids are counted, then ranked inside each range."""
    ids = trials.event_bins(events(spark, sf_dir)).select("neuron", F.floor(F.col("neuron") / 4096).alias("part")).distinct()
    before = ids.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part")) - F.col("count"))
    inside = ids.withColumn("n", F.row_number().over(W.partitionBy("part").orderBy("neuron")) - 1)
    return inside.join(before, "part").select("neuron", (F.col("before") + F.col("n")).cast("bigint").alias("ix"))


@query("trial_lengths", "SELECT neuron, trial, count(*) AS n, sum(y) AS spikes FROM bins GROUP BY ALL")
def trial_lengths(spark, sf_dir):
    return bins(spark, sf_dir).groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("spikes"))


@query("trial_offsets", "SELECT neuron, trial, (sum(n) OVER (PARTITION BY neuron ORDER BY trial) - n)::BIGINT AS first FROM (SELECT neuron, trial, count(*) AS n FROM bins GROUP BY ALL)")
def trial_offsets(spark, sf_dir):
    own = W.partitionBy("neuron").orderBy("trial")
    return trial_lengths(spark, sf_dir).select(*TRIAL, (F.sum("n").over(own) - F.col("n")).cast("bigint").alias("first"))


@query("event_times", "SELECT * FROM times")
def event_times(spark, sf_dir):
    return times(spark, sf_dir)


@query("trial_window", "SELECT b.neuron, b.trial, b.bin, b.y FROM bins b JOIN times t USING (neuron, trial) WHERE b.bin >= t.sample AND b.bin <= coalesce(t.lever + 3, t.test + 9)")
def trial_window(spark, sf_dir):
    return design.window(timed(spark, sf_dir)).select(*TRIAL, "bin", "y")


@query("event_time_index", "SELECT neuron, trial, bin, CASE WHEN bin >= sample THEN bin - sample ELSE -1 END AS ix FROM bins JOIN times USING (neuron, trial)")
def event_time_index(spark, sf_dir):
    return timed(spark, sf_dir).select(*TRIAL, "bin", design.event_index("sample").alias("ix"))


@query("event_union", "SELECT neuron, trial, bin, event, ix, f AS feature FROM eu0 WHERE ix >= 0")
def event_union(spark, sf_dir):
    rows = both_events(spark, sf_dir)
    return rows.where("ix >= 0").select(*TRIAL, "bin", "event", "ix", "feature")


@query("event_cross_mask", "SELECT neuron, event, feature, count(*) AS n FROM eu GROUP BY ALL")
def event_cross_mask(spark, sf_dir):
    rows = both_events(spark, sf_dir)
    return rows.groupBy("neuron", "event", "feature").agg(F.count(F.lit(1)).alias("n"))


# ---- regressors

@query("spike_history_lag", "SELECT neuron, trial, bin, y, h1, h2, h3 FROM hist")
def spike_history_lag(spark, sf_dir):
    return timed(spark, sf_dir, 3).drop("sample", "test", "lever")


@query("spike_history_basis", "SELECT neuron, trial, round(sum(h1 * cos(1) + h2 * cos(2) + h3 * cos(3)), 6) AS x0, round(sum(h1 * sin(1) + h2 * sin(2) + h3 * sin(3)), 6) AS x1 FROM hist GROUP BY ALL")
def spike_history_basis(spark, sf_dir):
    """The counts before a bin come out of its trial's array, without a window."""
    rows = timed(spark, sf_dir, 3)
    return rounded(rows.groupBy(*TRIAL).agg(*(F.sum(sum(wave(j) * F.col(f"h{j}") for j in (1, 2, 3))).alias(f"x{i}") for i, wave in enumerate((math.cos, math.sin)))))


@query("raised_cosine_basis", """, k AS (SELECT b.neuron, b.trial, b.y, b.bin - t.sample AS lag, i.k FROM bins b JOIN times t USING (neuron, trial) CROSS JOIN range(4) i(k) WHERE b.bin >= t.sample),
a AS (SELECT *, (ln(lag + 1.5) - (ln(1.5) + k * (ln(13.5) - ln(1.5)) / 3)) * pi() / ((ln(13.5) - ln(1.5)) / 3) / 2 AS ang FROM k)
SELECT neuron, k::INT AS k, round(sum(y * (cos(greatest(-pi(), least(pi(), ang))) + 1) / 2), 6) AS s FROM a GROUP BY ALL""")
def raised_cosine_basis(spark, sf_dir):
    rows = timed(spark, sf_dir).where(F.col("bin") >= F.col("sample")).withColumn("lag", (F.col("bin") - F.col("sample")).cast("double"))
    bumps = F.array(*(F.struct(F.lit(k).alias("k"), bases.raised_cosine(F.col("lag"), k, 4, 0.0, 12.0, 1.5).alias("v")) for k in range(4)))
    rows = rows.select("neuron", "y", F.explode(bumps).alias("b"))
    return rounded(rows.groupBy("neuron", F.col("b.k").alias("k")).agg(F.sum(F.col("y") * F.col("b.v")).alias("s")))


@query("spline_knot_asof", """, kn(knot) AS (VALUES (0), (3), (7), (12), (18), (24)), seg AS (SELECT knot, lead(knot) OVER (ORDER BY knot) AS above FROM kn),
u AS (SELECT b.neuron, s.knot, b.y, (b.bin - s.knot) / (s.above - s.knot)::DOUBLE AS u FROM bins b ASOF JOIN seg s ON b.bin >= s.knot)
SELECT neuron, knot, round(sum(y * (-0.5 * u + u * u - 0.5 * u * u * u)), 6) AS w0, round(sum(y * (1 - 2.5 * u * u + 1.5 * u * u * u)), 6) AS w1, round(sum(y * (0.5 * u + 2 * u * u - 1.5 * u * u * u)), 6) AS w2, round(sum(y * (0.5 * u * u * u - 0.5 * u * u)), 6) AS w3 FROM u GROUP BY ALL""")
def spline_knot_asof(spark, sf_dir):
    rows = design.knots(bins(spark, sf_dir), [0, 3, 7, 12, 18, 24])
    return rounded(rows.groupBy("neuron", "knot").agg(*(F.sum(F.col("y") * w).alias(f"w{i}") for i, w in enumerate(bases.spline_weights(F.col("u"))))))


@query("stim_cosine_design", "SELECT neuron, trial, round(sum(y * cos(neuron % 8 * pi() / 4)), 6) AS c, round(sum(y * sin(neuron % 8 * pi() / 4)), 6) AS s FROM bins GROUP BY ALL")
def stim_cosine_design(spark, sf_dir):
    cos, sin = bases.cosine_tuning(design.direction(), DIRECTIONS)
    rows = bins(spark, sf_dir).groupBy(*TRIAL).agg(F.sum("y").alias("y"))
    return rounded(rows.select(*TRIAL, (F.col("y") * cos).alias("c"), (F.col("y") * sin).alias("s")))


@query("stim_onehot_design", "SELECT neuron, trial, " + ", ".join(f"sum(CASE WHEN neuron % 8 = {d} THEN y ELSE 0 END)::DOUBLE AS d{d}" for d in range(8)) + " FROM bins GROUP BY ALL")
def stim_onehot_design(spark, sf_dir):
    return bins(spark, sf_dir).groupBy(*TRIAL).agg(*(F.sum(F.col("y") * c).alias(f"d{d}") for d, c in enumerate(bases.one_hot(design.direction(), DIRECTIONS))))


@query("stim_contrast_design", "SELECT neuron, trial, sum(CASE WHEN neuron % 8 < 4 THEN y ELSE -y END) AS c FROM bins GROUP BY ALL")
def stim_contrast_design(spark, sf_dir):
    return bins(spark, sf_dir).groupBy(*TRIAL).agg(F.sum(F.col("y") * bases.contrast(design.direction(), DIRECTIONS)).alias("c"))


@query("glm_design_kron", """, d AS (SELECT neuron, trial, y, cos(neuron % 8 * pi() / 4) AS c, sin(neuron % 8 * pi() / 4) AS s, CASE WHEN bin >= sample AND bin - sample < 12 THEN cos((bin - sample + 1) * 1) / 4 ELSE 0 END AS t0, CASE WHEN bin >= sample AND bin - sample < 12 THEN cos((bin - sample + 1) * 2) / 4 ELSE 0 END AS t1 FROM bins JOIN times USING (neuron, trial))
SELECT neuron, trial, round(sum(y * c * t0), 6) AS x0, round(sum(y * c * t1), 6) AS x1, round(sum(y * s * t0), 6) AS x2, round(sum(y * s * t1), 6) AS x3 FROM d GROUP BY ALL""")
def glm_design_kron(spark, sf_dir):
    rows = timed(spark, sf_dir).withColumn("ix", design.event_index("sample", 0, STEPS))
    x = design.kron(bases.cosine_tuning(design.direction(), DIRECTIONS), [factor(r)[0] for r in range(RANK)])
    return rounded(rows.groupBy(*TRIAL).agg(*(F.sum(F.col("y") * c).alias(f"x{i}") for i, c in enumerate(x))))


# ---- likelihoods

SOFT, SIG, CAP = "ln(1 + exp(x))", "(1 / (1 + exp(-x)))", "exp(x)"
TERMS_SQL = {
    "poiss_exp": (f"y * x - {CAP}", f"y - {CAP}", f"-{CAP}"),
    "poiss_softrec": (f"y * ln({SOFT}) - {SOFT}", f"{SIG} * (y / {SOFT} - 1)", f"{SIG} * (1 - {SIG}) * (y / {SOFT} - 1) - y * ({SIG} / {SOFT}) * ({SIG} / {SOFT})"),
    "trunc_poiss": (f"CASE WHEN y >= 1 THEN ln(1 - exp(-{CAP})) ELSE -{CAP} END", f"CASE WHEN y >= 1 THEN {CAP} / (exp({CAP}) - 1) ELSE -{CAP} END", f"CASE WHEN y >= 1 THEN {CAP} / (exp({CAP}) - 1) * (1 - {CAP} - {CAP} / (exp({CAP}) - 1)) ELSE -{CAP} END"),
    "sq_err": ("-0.5 * (x - y) * (x - y)", "y - x", "-1.0"),
    "poiss_refractory": (f"y * x - (1 - y / 2) * {CAP}", f"y - (1 - y / 2) * {CAP}", f"-(1 - y / 2) * {CAP}"),
}


def _register_terms(kind: str, what: str, term: str) -> None:
    @query(f"{what}_{kind}", f"SELECT neuron, trial, round(sum({term})::DOUBLE, 6) AS {what} FROM lin GROUP BY ALL")
    def run(spark, sf_dir):
        return rounded(model.trial_sums(lin(spark, sf_dir), kind, what))


for _kind in LIKELIHOODS:
    for _what, _term in zip(("ll", "dll", "d2ll"), TERMS_SQL[_kind], strict=True):
        _register_terms(_kind, _what, _term)


@query("trial_ll", "SELECT neuron, trial, round(sum(y * x - exp(x) - lgamma(y + 1)), 6) AS ll FROM lin GROUP BY ALL")
def trial_ll(spark, sf_dir):
    return rounded(model.trial_sums(lin(spark, sf_dir), "poiss_exp", normalize=True))


WEIGHT_SQL = "(SELECT neuron, trial, (neuron % 4) / 2.0::DOUBLE AS w FROM times WHERE neuron % 5 <> 0)"


@query("trial_ll_weighted", f"SELECT neuron, trial, round(sum(y * x - exp(x)) * any_value(coalesce(w, 1)), 6) AS ll FROM lin LEFT JOIN {WEIGHT_SQL} USING (neuron, trial) WHERE coalesce(w, 1) <> 0 GROUP BY ALL")
def trial_ll_weighted(spark, sf_dir):
    weights = times(spark, sf_dir).where("neuron % 5 <> 0").select(*TRIAL, (F.col("neuron") % 4 / 2.0).alias("w"))  # some trials have none
    return rounded(model.weighted(model.trial_sums(lin(spark, sf_dir), "poiss_exp"), weights).select(*TRIAL, "ll"))


@query("censored_ll", "SELECT neuron, trial, round(sum(CASE WHEN bin % 6 = 0 THEN 0 ELSE y * x - exp(x) END), 6) AS ll FROM lin GROUP BY ALL")
def censored_ll(spark, sf_dir):
    rows = lin(spark, sf_dir).withColumn("y", F.when(F.col("bin") % 6 == 0, -1.0).otherwise(F.col("y")))
    return rounded(model.trial_sums(rows, "poiss_exp"))


@query("lineitem_sq_err", "WITH m AS (SELECT l_suppkey, l_orderkey, l_extendedprice / 1e4 - (0.15 * l_quantity - 0.5 * l_discount) AS e FROM lineitem) SELECT l_suppkey AS neuron, round(sum(-0.5 * e * e), 5) AS ll, round(sum(e), 5) AS dll FROM m GROUP BY 1")
def lineitem_sq_err(spark, sf_dir):
    rows = trials.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("neuron"), (F.col("l_extendedprice") / 1e4).alias("y"), (0.15 * F.col("l_quantity") - 0.5 * F.col("l_discount")).alias("x"))
    rows = model.with_terms(rows, "sq_err")
    return rounded(rows.groupBy("neuron").agg(F.sum("ll").alias("ll"), F.sum("dll").alias("dll")), 5)


# ---- gradients

@query("grad_w", "SELECT neuron, round(sum(y - exp(x)), 6) AS dw FROM lin GROUP BY ALL")
def grad_w(spark, sf_dir):
    return rounded(model.with_terms(lin(spark, sf_dir), "poiss_exp").groupBy("neuron").agg(F.sum("dll").alias("dw")))


G_SQL = "round(sum((y - exp(x)) * h1), 6) AS g0, round(sum((y - exp(x)) * h2), 6) AS g1, round(sum((y - exp(x)) * cos(bin * pi() / 12)), 6) AS g2"


@query("grad_b", f"SELECT neuron, {G_SQL} FROM lin GROUP BY ALL")
def grad_b(spark, sf_dir):
    return rounded(model.gradient(model.with_terms(lin(spark, sf_dir), "poiss_exp"), regressors(), ["neuron"]))


@query("glm_gradient", f"SELECT {G_SQL.replace(', 6)', ', 4)')} FROM lin")
def glm_gradient(spark, sf_dir):
    return rounded(model.gradient(model.with_terms(lin(spark, sf_dir), "poiss_exp"), regressors(), []), 4)


@query("glm_hessian", ", d AS (SELECT -exp(x) AS h, [h1, h2, cos(bin * pi() / 12)] AS v FROM lin) SELECT i.i::INT AS i, j.j::INT AS j, round(sum(h * v[i.i + 1] * v[j.j + 1]), 4) AS h FROM d CROSS JOIN range(3) i(i) CROSS JOIN range(3) j(j) GROUP BY ALL")
def glm_hessian(spark, sf_dir):
    return rounded(model.hessian(model.with_terms(lin(spark, sf_dir), "poiss_exp"), regressors()), 4)


@query("log_rate_linear", "SELECT neuron, trial, bin, round(x, 6) AS x FROM lin")
def log_rate_linear(spark, sf_dir):
    return rounded(lin(spark, sf_dir).select(*TRIAL, "bin", "x"))


@query("shared_gather", "SELECT neuron, trial, event, round(sum(CASE WHEN ix >= 0 THEN cos((ix + 1) * 1) / 4 ELSE 0 END), 6) AS t0, round(sum(CASE WHEN feature >= 0 THEN sin(feature + 1) / 2 ELSE 0 END), 6) AS u0 FROM eu GROUP BY ALL")
def shared_gather(spark, sf_dir):
    rows = both_events(spark, sf_dir)
    t, u = factor(0)
    return rounded(rows.groupBy(*TRIAL, "event").agg(F.sum(t).alias("t0"), F.sum(u).alias("u0")))


@query("group_rate_rank2", "SELECT neuron, trial, bin, round(a0, 6) AS a0, round(a1, 6) AS a1 FROM grp")
def group_rate_rank2(spark, sf_dir):
    return rounded(group_rate(spark, sf_dir))


@query("khatri_rao_factor", """, k AS (SELECT neuron, event, ix, feature, ix + 12 * feature AS cell, count(*) AS n FROM eu WHERE ix >= 0 GROUP BY ALL)
SELECT neuron, cell, round(sum(n * cos((ix + 1) * 1) / 4 * sin(feature + 1) / 2), 6) AS f0, round(sum(n * cos((ix + 1) * 2) / 4 * sin(feature + 2) / 2), 6) AS f1 FROM k GROUP BY ALL""")
def khatri_rao_factor(spark, sf_dir):
    """Two modes as one: the first mode's index runs fastest."""
    rows = both_events(spark, sf_dir).where("ix >= 0").withColumn("cell", F.col("ix") + STEPS * F.col("feature"))
    flat = [[math.cos((t + 1) * (r + 1)) / 4 * math.sin(d + 1 + r) / 2 for d in range(2 * DIRECTIONS) for t in range(STEPS)] for r in range(RANK)]
    used = rows.groupBy("neuron", "cell").agg(F.count(F.lit(1)).alias("n"))
    return rounded(used.select("neuron", "cell", *((F.col("n") * model.gather(F.col("cell"), flat[r])).alias(f"f{r}") for r in range(RANK))))


@query("gmlm_trial_ll", "SELECT neuron, trial, round(sum(y * x - exp(x)), 6) AS ll FROM gm GROUP BY ALL")
def gmlm_trial_ll(spark, sf_dir):
    return rounded(tensor_rows(spark, sf_dir).groupBy(*TRIAL).agg(F.sum("ll").alias("ll")))


@query("grad_v", "SELECT neuron, round(sum(dll * a0), 6) AS g0, round(sum(dll * a1), 6) AS g1 FROM gd GROUP BY ALL")
def grad_v(spark, sf_dir):
    return rounded(model.gradient(tensor_rows(spark, sf_dir), [F.col("a0"), F.col("a1")], ["neuron"]))


@query("grad_t_shared", """SELECT p.ix, round(sum(d.dll * (0.1 * (1 + d.neuron % 3)) * sin(p.feature + 1) / 2), 5) AS g0, round(sum(d.dll * (0.1 * (1 + d.neuron % 3) - 0.05) * sin(p.feature + 2) / 2), 5) AS g1 FROM gd d JOIN eu p USING (neuron, trial, bin) WHERE p.ix >= 0 GROUP BY ALL""")
def grad_t_shared(spark, sf_dir):
    """Derivative by the timing mode: rates are done before events are spread, and events that aren't there go before they are weighted."""
    pairs = design.two_events(DIRECTIONS, STEPS)
    flat = tensor_rows(spark, sf_dir).select("dll", *(load(r).alias(f"v{r}") for r in range(RANK)), *(c.alias(f"{n}{e}") for e, pair in enumerate(pairs) for n, c in zip(("ix", "f"), pair, strict=True)))
    at = F.explode(F.array(*(F.struct(F.col(f"ix{e}").alias("ix"), F.col(f"f{e}").alias("f")) for e in range(len(pairs)))))
    rows = flat.select("dll", *(f"v{r}" for r in range(RANK)), at.alias("e")).where("e.ix >= 0").groupBy("e.ix", "e.f").agg(*(F.sum(F.col("dll") * F.col(f"v{r}")).alias(f"s{r}") for r in range(RANK)))
    return rounded(rows.groupBy("ix").agg(*(F.sum(F.col(f"s{r}") * tuning(F.col("f"), r)).alias(f"g{r}") for r in range(RANK))), 5)


EMB_SQL = "WITH e AS (SELECT vec_id, label, embedding, (vec_id % 3)::DOUBLE AS y, list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * sin(i + 1))) / 8 AS a FROM embeddings), d AS (SELECT *, y - exp(-0.5 + 0.2 * a) AS dll FROM e) "


def local_rows(spark, sf_dir):
    a = sum((F.get("embedding", F.lit(i)).cast("double") * math.sin(i + 1) for i in range(64)), F.lit(0.0)) / 8
    rows = trials.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", (F.col("vec_id") % 3).cast("double").alias("y"), a.alias("a"))
    return model.with_terms(rows.withColumn("x", -0.5 + 0.2 * F.col("a")), "poiss_exp")


@query("log_rate_local", EMB_SQL + "SELECT label, round(sum(-0.5 + 0.2 * a), 5) AS x, round(sum(y * (-0.5 + 0.2 * a) - exp(-0.5 + 0.2 * a)), 5) AS ll FROM d GROUP BY 1")
def log_rate_local(spark, sf_dir):
    return rounded(local_rows(spark, sf_dir).groupBy("label").agg(F.sum("x").alias("x"), F.sum("ll").alias("ll")), 5)


@query("grad_t_local", EMB_SQL + "SELECT i.i::INT AS ix, round(sum(dll * 0.2 * embedding[i.i + 1]::DOUBLE / 8), 5) AS g FROM d CROSS JOIN range(64) i(i) GROUP BY 1")
def grad_t_local(spark, sf_dir):
    rows = local_rows(spark, sf_dir).select("dll", F.posexplode("embedding").alias("ix", "v"))
    return rounded(rows.groupBy("ix").agg(F.sum(F.col("dll") * 0.2 * F.col("v").cast("double") / 8).alias("g")), 5)


POP_SQL = """, pt AS (SELECT trial, min(sample) AS s FROM times GROUP BY trial),
pa AS (SELECT b.trial, b.bin, any_value(CASE WHEN b.bin - s BETWEEN 0 AND 11 THEN cos((b.bin - s + 1) * 1) / 4 ELSE 0 END) AS a0, any_value(CASE WHEN b.bin - s BETWEEN 0 AND 11 THEN cos((b.bin - s + 1) * 2) / 4 ELSE 0 END) AS a1 FROM (SELECT DISTINCT trial, bin FROM bins) b JOIN pt USING (trial) GROUP BY ALL),
pm AS (SELECT b.neuron, b.trial, b.bin, b.y, -1 + 0.05 * (b.neuron % 7) + (0.1 * (1 + b.neuron % 3)) * a0 + (0.1 * (1 + b.neuron % 3) - 0.05) * a1 AS x FROM bins b JOIN pa USING (trial, bin)) """


def population(spark, sf_dir):
    """All neurons share a day's regressors: the factor's product is made once for each (trial, bin), then joined."""
    day = times(spark, sf_dir).groupBy("trial").agg(F.min("sample").alias("sample"))
    shared = day.select("trial", "sample", F.explode(F.sequence(F.lit(0), F.lit(trials.BINS - 1))).alias("bin")).withColumn("ix", design.event_index("sample", 0, STEPS))
    shared = shared.select("trial", "bin", *(factor(r)[0].alias(f"a{r}") for r in range(RANK)))
    rows = bins(spark, sf_dir).join(shared, ["trial", "bin"])
    return model.with_terms(rows.withColumn("x", baseline() + sum((load(r) * F.col(f"a{r}") for r in range(RANK)), F.lit(0.0))), "poiss_exp")


@query("gmlm_pop_trial_ll", POP_SQL + "SELECT neuron, trial, round(sum(y * x - exp(x)), 6) AS ll FROM pm GROUP BY ALL")
def gmlm_pop_trial_ll(spark, sf_dir):
    return rounded(population(spark, sf_dir).groupBy(*TRIAL).agg(F.sum("ll").alias("ll")))


@query("gmlm_pop_grad", POP_SQL + "SELECT trial, bin, round(sum((y - exp(x)) * (0.1 * (1 + neuron % 3))), 6) AS g0, round(sum((y - exp(x)) * (0.1 * (1 + neuron % 3) - 0.05)), 6) AS g1 FROM pm GROUP BY ALL")
def gmlm_pop_grad(spark, sf_dir):
    """Neurons are summed before any factor is touched."""
    return rounded(model.gradient(population(spark, sf_dir), [load(r) for r in range(RANK)], ["trial", "bin"]))


# ---- folds

@query("cv_folds", "SELECT * FROM fold")
def cv_folds(spark, sf_dir):
    return folds(spark, sf_dir)


@query("cv_train_test_split", ", s AS (SELECT f.fold, k.k::INT AS k, n FROM (SELECT fold, count(*) AS n FROM fold GROUP BY 1) f CROSS JOIN range(5) k(k)) SELECT k, sum(CASE WHEN fold <> k THEN n ELSE 0 END)::BIGINT AS train, sum(CASE WHEN fold = k THEN n ELSE 0 END)::BIGINT AS test FROM s GROUP BY 1")
def cv_train_test_split(spark, sf_dir):
    by_fold = folds(spark, sf_dir).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    rows = by_fold.select("fold", "n", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("k"))
    return rows.groupBy("k").agg(F.sum(F.when(F.col("fold") != F.col("k"), F.col("n")).otherwise(0)).alias("train"), F.sum(F.when(F.col("fold") == F.col("k"), F.col("n")).otherwise(0)).alias("test"))


@query("cv_test_ll", """, t AS (SELECT b.neuron, f.fold, sum(y) AS y, count(*) AS n FROM bins b JOIN fold f USING (neuron, trial) GROUP BY ALL),
a AS (SELECT neuron, sum(y) AS ay, sum(n) AS an FROM t GROUP BY 1), w AS (SELECT t.neuron, t.fold, y, n, ln((ay - y + 0.5) / (an - n + 1)) AS w FROM t JOIN a USING (neuron))
SELECT fold, round(sum(y * w - n * exp(w)), 4) AS ll FROM w GROUP BY 1""")
def cv_test_ll(spark, sf_dir):
    """Held-out log likelihood of constant rates: training sums are all sums less the fold's, so no fold reads the trials again."""
    own = bins(spark, sf_dir).join(folds(spark, sf_dir), TRIAL).groupBy("neuron", "fold").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    every = W.partitionBy("neuron")
    rate = F.log((F.sum("y").over(every) - F.col("y") + 0.5) / (F.sum("n").over(every) - F.col("n") + 1))
    rows = own.withColumn("w", rate)
    return rounded(rows.groupBy("fold").agg(F.sum(F.col("y") * F.col("w") - F.col("n") * F.exp("w")).alias("ll")), 4)


@query("semi_included_trials", "SELECT neuron, trial, round(sum(y * x - exp(x)), 6) AS ll FROM lin SEMI JOIN (SELECT * FROM fold WHERE fold <> 0) f USING (neuron, trial) GROUP BY ALL")
def semi_included_trials(spark, sf_dir):
    kept = folds(spark, sf_dir).where("fold <> 0")
    return rounded(model.trial_sums(lin(spark, sf_dir).join(kept, TRIAL, "left_semi"), "poiss_exp"))


@query("anti_heldout_trials", "SELECT neuron, trial, round(sum(y * x - exp(x)), 6) AS ll FROM lin ANTI JOIN (SELECT * FROM fold WHERE fold = 0) f USING (neuron, trial) GROUP BY ALL")
def anti_heldout_trials(spark, sf_dir):
    held = folds(spark, sf_dir).where("fold = 0")
    return rounded(model.trial_sums(lin(spark, sf_dir).join(held, TRIAL, "left_anti"), "poiss_exp"))


# ---- priors and norms

@query("prior_gaussian", f"SELECT neuron, round(-0.5 * w * w - 0.5 * ln(2 * pi()), 6) AS lp FROM {RATES_SQL}")
def prior_gaussian(spark, sf_dir):
    return rounded(rates(spark, sf_dir).select("neuron", priors.gaussian(F.col("w")).alias("lp")))


@query("prior_half_t", f"SELECT neuron, round(ln(2) + lgamma(2.5) - lgamma(2) - 0.5 * ln(pi() * 4) - ln(2) - 2.5 * ln(1 + exp(2 * (w - ln(2))) / 4) + w, 6) AS lp FROM {RATES_SQL}")
def prior_half_t(spark, sf_dir):
    return rounded(rates(spark, sf_dir).select("neuron", priors.half_t(F.col("w"), 4.0, 2.0).alias("lp")))


@query("prior_inverse_gamma", f"SELECT neuron, round(3 * ln(2) - lgamma(3) - 3 * w - 2 * exp(-w), 6) AS lp FROM {RATES_SQL}")
def prior_inverse_gamma(spark, sf_dir):
    return rounded(rates(spark, sf_dir).select("neuron", priors.inverse_gamma(F.col("w"), 3.0, 2.0).alias("lp")))


@query("log_sum_exp", ", m AS (SELECT neuron, max(x) AS m FROM lin GROUP BY 1) SELECT neuron, round(any_value(m) + ln(sum(exp(x - m))), 6) AS lse, round(any_value(m) + ln(sum(exp(x - m)) / count(*)), 6) AS lme FROM lin JOIN m USING (neuron) GROUP BY 1")
def log_sum_exp(spark, sf_dir):
    return rounded(compare.log_sum_exp(lin(spark, sf_dir), "x", ["neuron"]))


@query("normalize_tensor_norms", ", c AS (SELECT neuron, sqrt(sum(a0 * a0)) AS n0, sqrt(sum(a1 * a1)) AS n1 FROM grp GROUP BY 1) SELECT neuron, round(n0, 6) AS n0, round(n1, 6) AS n1, round(sqrt(n0 * abs(0.1 * (1 + neuron % 3))), 6) AS s0, round(sqrt(n1 * abs(0.1 * (1 + neuron % 3) - 0.05)), 6) AS s1 FROM c")
def normalize_tensor_norms(spark, sf_dir):
    """Norms of the components and the magnitude each of two modes gets when it is spread evenly."""
    norms = group_rate(spark, sf_dir).groupBy("neuron").agg(*(F.sqrt(F.sum(F.col(f"a{r}") * F.col(f"a{r}"))).alias(f"n{r}") for r in range(RANK)))
    return rounded(norms.select("neuron", "n0", "n1", *(F.sqrt(F.col(f"n{r}") * F.abs(load(r))).alias(f"s{r}") for r in range(RANK))))


@query("component_order", ", c AS (SELECT neuron, sqrt(sum(a0 * a0)) * (0.1 * (1 + neuron % 3)) AS m0, sqrt(sum(a1 * a1)) * (0.1 * (1 + neuron % 3) - 0.05) AS m1 FROM grp GROUP BY 1) SELECT neuron, CASE WHEN round(m0, 9) >= round(m1, 9) THEN 0 ELSE 1 END AS largest FROM c")
def component_order(spark, sf_dir):
    norms = group_rate(spark, sf_dir).groupBy("neuron").agg(*(F.sqrt(F.sum(F.col(f"a{r}") * F.col(f"a{r}"))).alias(f"n{r}") for r in range(RANK)))
    size = [F.round(F.col(f"n{r}") * load(r), 9) for r in range(RANK)]
    return norms.select("neuron", F.when(size[0] >= size[1], 0).otherwise(1).alias("largest"))


@query("reconstruct_tensor", """, c AS (SELECT DISTINCT neuron, ix, feature FROM eu WHERE ix >= 0)
SELECT neuron, ix, feature, round((0.1 * (1 + neuron % 3)) * cos((ix + 1) * 1) / 4 * sin(feature + 1) / 2 + (0.1 * (1 + neuron % 3) - 0.05) * cos((ix + 1) * 2) / 4 * sin(feature + 2) / 2, 6) AS v FROM c""")
def reconstruct_tensor(spark, sf_dir):
    """The group's tensor at the cells that the data visit."""
    cells = both_events(spark, sf_dir).where("ix >= 0").select("neuron", "ix", "feature").distinct()
    return rounded(cells.select("neuron", "ix", "feature", sum((load(r) * factor(r)[0] * factor(r)[1] for r in range(RANK)), F.lit(0.0)).alias("v")))


# ---- draws

DRAW_SQL = """, st AS (SELECT neuron, trial, sum(y) AS y, count(*) AS n FROM bins GROUP BY ALL),
dr AS (SELECT neuron, trial, s.s::INT AS draw, y * (-3 + 0.3 * sin(s.s + 1)) - n * exp(-3 + 0.3 * sin(s.s + 1)) AS ll FROM st CROSS JOIN range(40) s(s)) """


def draws(spark, sf_dir):
    """Trial log likelihoods under DRAWS parameter draws (closed forms). Sums of a trial suffice, so a trial's bins are read once."""
    sums = bins(spark, sf_dir).groupBy(*TRIAL).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    rows = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw")).withColumn("w", -3 + 0.3 * F.sin(F.col("draw") + 1))
    return rows.select(*TRIAL, "draw", (F.col("y") * F.col("w") - F.col("n") * F.exp("w")).alias("ll"))


@query("waic", DRAW_SQL + "SELECT neuron, trial, round(-(max(ll) + ln(sum(exp(ll - m)) / count(*))) + var_samp(ll), 6) AS waic FROM (SELECT *, max(ll) OVER (PARTITION BY neuron, trial) AS m FROM dr) GROUP BY ALL")
def waic(spark, sf_dir):
    return rounded(compare.waic(draws(spark, sf_dir), "ll", TRIAL))


@query("psis_tail_select", DRAW_SQL + "SELECT neuron, trial, draw, round(-ll, 6) AS lw FROM (SELECT *, row_number() OVER (PARTITION BY neuron, trial ORDER BY round(-ll, 9) DESC, draw) AS k FROM dr) WHERE k <= 8")
def psis_tail_select(spark, sf_dir):
    """The largest ceil(min(0.2 n, 3 sqrt n)) importance weights of each trial."""
    return rounded(compare.tail(draws(spark, sf_dir), "ll", TRIAL, DRAWS).select(*TRIAL, "draw", "lw"))


@query("draw_variance_mass", DRAW_SQL + "SELECT neuron, trial, round(1 / var_samp(ll), 6) AS mass FROM dr GROUP BY ALL")
def draw_variance_mass(spark, sf_dir):
    """Null for draws without any spread."""
    return rounded(draws(spark, sf_dir).groupBy(*TRIAL).agg(F.try_divide(F.lit(1.0), F.var_samp("ll")).alias("mass")))


@query("posterior_quantiles", DRAW_SQL + "SELECT neuron, round(quantile_cont(ll, 0.025), 6) AS q0, round(quantile_cont(ll, 0.5), 6) AS q1, round(quantile_cont(ll, 0.975), 6) AS q2 FROM dr GROUP BY 1")
def posterior_quantiles(spark, sf_dir):
    return rounded(draws(spark, sf_dir).groupBy("neuron").agg(*(F.percentile("ll", F.lit(q)).alias(f"q{i}") for i, q in enumerate((0.025, 0.5, 0.975)))))


@query("posterior_median", DRAW_SQL + "SELECT neuron, trial, round(median(ll), 6) AS m FROM dr GROUP BY ALL")
def posterior_median(spark, sf_dir):
    return rounded(draws(spark, sf_dir).groupBy(*TRIAL).agg(F.median("ll").alias("m")))


@query("circular_mean", "SELECT neuron, round(degrees(atan2(sum(y * sin(bin * pi() / 12)), sum(y * cos(bin * pi() / 12)))), 4) AS angle FROM bins GROUP BY 1 HAVING abs(sum(y * sin(bin * pi() / 12))) + abs(sum(y * cos(bin * pi() / 12))) > 1e-6")
def circular_mean(spark, sf_dir):
    return rounded(compare.circular_mean(bins(spark, sf_dir), F.col("bin") * (math.pi / 12), F.col("y"), ["neuron"]), 4)


@query("mean_sem_band", "SELECT neuron, bin, round(avg(y), 6) AS mean, round(2 * stddev_samp(y) / sqrt(count(*)), 6) AS band FROM bins GROUP BY ALL")
def mean_sem_band(spark, sf_dir):
    return rounded(bins(spark, sf_dir).groupBy("neuron", "bin").agg(F.avg("y").alias("mean"), (2 * F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))).alias("band")))


@query("acceptance_trailing", "SELECT neuron, trial, bin, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY neuron ORDER BY trial, bin ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS rate FROM bins")
def acceptance_trailing(spark, sf_dir):
    last = W.partitionBy("neuron").orderBy("trial", "bin").rowsBetween(-99, 0)
    return rounded(bins(spark, sf_dir).select(*TRIAL, "bin", F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0)).over(last).alias("rate")))


def sse_posterior(spark, sf_dir):
    error = F.col("y") - F.col("x")
    return lin(spark, sf_dir).groupBy("neuron").agg((2 + F.count(F.lit(1)) / 2.0).alias("shape"), (1 + 0.5 * F.sum(error * error)).alias("rate"))


@query("sse_precision_posterior", "SELECT neuron, round(2 + count(*) / 2.0, 6) AS shape, round(1 + 0.5 * sum((y - x) * (y - x)), 6) AS rate FROM lin GROUP BY 1")
def sse_precision_posterior(spark, sf_dir):
    """Gamma posterior of each neuron's noise precision under a Gamma(2, 1) prior."""
    return rounded(sse_posterior(spark, sf_dir))


@query("param_combinations", ", u AS (SELECT DISTINCT neuron FROM ev) SELECT neuron, a.a::INT AS a, b.b::INT AS b FROM u CROSS JOIN range(3) a(a) CROSS JOIN range(2) b(b)")
def param_combinations(spark, sf_dir):
    """Every combination of mixed-radix settings, for each neuron to fit."""
    units = trials.event_bins(events(spark, sf_dir)).select("neuron").distinct()
    return units.select("neuron", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("neuron", (F.col("i") % 3).cast("int").alias("a"), F.floor(F.col("i") / 3).cast("int").alias("b"))


@query("dataset_rules", "SELECT 0::BIGINT AS null_key, sum((y IS NULL OR isnan(y))::INT)::BIGINT AS bad_y, sum((y <> floor(y))::INT)::BIGINT AS fraction, (SELECT count(*) FROM (SELECT neuron, trial FROM bins GROUP BY ALL HAVING count(*) FILTER (y >= 0) = 0)) AS unobserved, (count(*) - count(DISTINCT (neuron, trial, bin)))::BIGINT AS repeated FROM bins")
def dataset_rules(spark, sf_dir):
    """Numbers of rows that break the rules of a model's data set."""
    found = trials.check(bins(spark, sf_dir))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} bigint" for k in found))


@query("incidence", """, off AS (SELECT neuron, trial, sum(n) OVER (PARTITION BY neuron ORDER BY trial) - n AS first FROM (SELECT neuron, trial, count(*) AS n FROM bins GROUP BY ALL)) SELECT neuron, ix, (first + bin)::BIGINT AS observation, event FROM eu JOIN off USING (neuron, trial) WHERE ix >= 0""")
def incidence(spark, sf_dir):
    """The sparse matrix of a shared factor: for each index the observations (numbered within the neuron) that have it."""
    return both_events(spark, sf_dir).where("ix >= 0").join(trial_offsets(spark, sf_dir), TRIAL).select("neuron", "ix", (F.col("first") + F.col("bin")).alias("observation"), "event")


@query("ll_sq_err_linear", "SELECT neuron, trial, round(sum(-(x - y) * (x - y)), 6) AS ll, round(sum(2 * (y - x)), 6) AS dll FROM lin GROUP BY ALL")
def ll_sq_err_linear(spark, sf_dir):
    """Squared errors by the linear models' convention, without the half."""
    ll, dll, _ = likelihood.terms("sq_err", F.col("x"), F.col("y"), scale=1.0)
    return rounded(lin(spark, sf_dir).groupBy(*TRIAL).agg(F.sum(ll).alias("ll"), F.sum(dll).alias("dll")))


# ---- the general model

def closed_form(spec: gmlm.Spec, ids: list[int]) -> gmlm.Params:
    """The parameters of the head of this module, in the general model's blocks."""
    p, out = np.array(ids), gmlm.empty_params(spec)
    out["W"] = -1 + 0.05 * (p % 7)
    out["B"] = np.tile([[0.1], [-0.05], [0.2]], (1, len(p)))
    out["g.V"] = np.stack([0.1 * (1 + p % 3) - 0.05 * r for r in range(RANK)], axis=1)
    out["g.T0"] = np.array([[math.cos((t + 1) * (r + 1)) / 4 for r in range(RANK)] for t in range(STEPS)])
    out["g.T1"] = np.array([[math.sin(d + 1 + r) / 2 for r in range(RANK)] for d in range(2 * DIRECTIONS)])
    return out


def general(spark, sf_dir) -> tuple[DataFrame, gmlm.Spec, gmlm.Params]:
    """Rows, structure and parameters of the general model with one group of two shared factors."""
    rows = timed(spark, sf_dir, 3)
    pairs = design.two_events(DIRECTIONS, STEPS)
    rows = rows.join(builders.neuron_index(rows).hint("shuffle_hash"), "neuron").withColumn("fold", F.pmod(F.col("neuron") + F.dayofmonth(F.to_date("trial")), F.lit(FOLDS)))
    rows = rows.select(*TRIAL, "bin", "neuron_ix", "y", "fold", F.lit(1.0).alias("w"), F.array(*regressors()).alias("x_lin"), F.array(*(ix.cast("bigint") for ix, _ in pairs)).alias("ix"), F.array(*(d.cast("bigint") for _, d in pairs)).alias("feature"))
    ids = [r["neuron"] for r in builders.neuron_index(events(spark, sf_dir).select(F.col("user_id").alias("neuron"))).orderBy("neuron_ix").collect()]  # the model's units
    spec = gmlm.Spec(len(ids), 3, (gmlm.Group("g", (STEPS, 2 * DIRECTIONS), (0, 1), (gmlm.Factor("ix", STEPS), gmlm.Factor("feature", 2 * DIRECTIONS)), RANK, 2),))
    return rows, spec, closed_form(spec, ids)


@query("log_rate_block", "SELECT neuron, trial, bin, round(x, 6) AS x FROM gm")
def log_rate_block(spark, sf_dir):
    rows, spec, params = general(spark, sf_dir)
    return rounded(gmlm.rates(rows, spec, params, [*TRIAL, "bin"]).select(*TRIAL, "bin", "x"))


@query("gmlm_trial_ll_block", "SELECT neuron, trial, round(sum(y * x - exp(x)), 6) AS ll FROM gm GROUP BY ALL")
def gmlm_trial_ll_block(spark, sf_dir):
    rows, spec, params = general(spark, sf_dir)
    return rounded(gmlm.trial_ll(rows, spec, params, TRIAL))


GRAD_SQL = """, nix AS (SELECT neuron, (row_number() OVER (ORDER BY neuron) - 1)::INT AS i FROM (SELECT DISTINCT neuron FROM ev)), gr AS (SELECT d.*, x.i, h.h1, h.h2 FROM gd d JOIN nix x USING (neuron) JOIN hist h USING (neuron, trial, bin)),
gp AS (SELECT d.dll, d.neuron, p.ix, p.feature FROM gd d JOIN eu p USING (neuron, trial, bin) WHERE p.ix >= 0),
ga AS (SELECT 'W' AS block, i AS row, 0 AS col, sum(dll) AS value FROM gr GROUP BY i
  UNION ALL SELECT 'B', 0, i, sum(dll * h1) FROM gr GROUP BY i UNION ALL SELECT 'B', 1, i, sum(dll * h2) FROM gr GROUP BY i UNION ALL SELECT 'B', 2, i, sum(dll * cos(bin * pi() / 12)) FROM gr GROUP BY i
  UNION ALL SELECT 'g.V', i, 0, sum(dll * a0) FROM gr GROUP BY i UNION ALL SELECT 'g.V', i, 1, sum(dll * a1) FROM gr GROUP BY i
  UNION ALL SELECT 'g.T0', ix, 0, sum(dll * (0.1 * (1 + neuron % 3)) * sin(feature + 1) / 2) FROM gp GROUP BY ix UNION ALL SELECT 'g.T0', ix, 1, sum(dll * (0.1 * (1 + neuron % 3) - 0.05) * sin(feature + 2) / 2) FROM gp GROUP BY ix
  UNION ALL SELECT 'g.T1', feature, 0, sum(dll * (0.1 * (1 + neuron % 3)) * cos(ix + 1) / 4) FROM gp GROUP BY feature UNION ALL SELECT 'g.T1', feature, 1, sum(dll * (0.1 * (1 + neuron % 3) - 0.05) * cos((ix + 1) * 2) / 4) FROM gp GROUP BY feature) """


@query("gmlm_gradient", GRAD_SQL + "SELECT block, row, col, round(value, 4) AS value FROM ga WHERE abs(value) > 1e-9")
def gmlm_gradient(spark, sf_dir):
    """Log likelihood and every derivative, out of one job."""
    rows, spec, params = general(spark, sf_dir)
    _, grads = gmlm.evaluate(rows, spec, [params])[0]
    return gmlm.as_table(spark, spec, {**grads, "H": np.zeros(0)}).where("abs(value) > 1e-9").withColumn("value", F.round("value", 4))


@query("gmlm_derivative_selection", GRAD_SQL + "SELECT block, row, col, round(value, 4) AS value FROM ga WHERE block = 'g.V' AND abs(value) > 1e-9")
def gmlm_derivative_selection(spark, sf_dir):
    """Only the loads' derivatives are computed."""
    rows, spec, params = general(spark, sf_dir)
    _, grads = gmlm.evaluate(rows, spec, [params], ["g.V"])[0]
    return gmlm.as_table(spark, spec, {**gmlm.empty_params(spec), **grads}).where("abs(value) > 1e-9").withColumn("value", F.round("value", 4))


@query("gmlm_log_posterior", """, nn AS (SELECT DISTINCT neuron FROM ev), pr AS (SELECT sum(-0.5 * v * v - 0.5 * ln(2 * pi())) AS lp FROM (
  SELECT 0.1 * (1 + neuron % 3) - 0.05 * r.r AS v FROM nn CROSS JOIN range(2) r(r) UNION ALL SELECT cos((t.t + 1) * (r.r + 1)) / 4 FROM range(12) t(t) CROSS JOIN range(2) r(r) UNION ALL SELECT sin(d.d + 1 + r.r) / 2 FROM range(16) d(d) CROSS JOIN range(2) r(r)))
SELECT round(ll, 3) AS log_likelihood, round(lp, 3) AS log_prior, round(ll + lp, 3) AS log_posterior FROM (SELECT sum(y * x - exp(x)) AS ll FROM gm), pr""")
def gmlm_log_posterior(spark, sf_dir):
    rows, spec, params = general(spark, sf_dir)
    model = gmlm.Model(rows, spec, [gmlm.gaussian_prior({"g.V": 0.0, "g.T0": 0.0}), gmlm.gaussian_prior({"g.T1": 0.0})])
    try:
        found = model.log_posterior(params, ["W"])
    finally:
        model.close()
    return spark.createDataFrame([tuple(round(found[k], 3) for k in ("log_likelihood", "log_prior", "log_posterior"))], "log_likelihood double, log_prior double, log_posterior double")


@query("gmlm_constant_mle", "SELECT (row_number() OVER (ORDER BY neuron) - 1)::INT AS row, round(ln(sum(y)) - ln(count(*)), 3) AS value FROM bins GROUP BY neuron")
def gmlm_constant_mle(spark, sf_dir):
    """The optimizer on a model whose maximum is known: only weights are free, the rest is 0."""
    rows, spec, _ = general(spark, sf_dir)
    model = gmlm.Model(rows, gmlm.Spec(spec.neurons, 0))
    try:
        found = model.fit([gmlm.empty_params(model.spec) | {"W": np.full(spec.neurons, -1.0)}], blocks={"W"}, tolerance=1e-12)[0]
    finally:
        model.close()
    return gmlm.as_table(spark, model.spec, found["params"]).where("block = 'W'").select("row", F.round("value", 3).alias("value"))


def fitted(spark, sf_dir, work, folds: bool = False):
    rows, spec, params = general(spark, sf_dir)
    start = gmlm.random_params(spec, 1) | {k: params[k] for k in ("W", "B")}
    model = gmlm.Model(rows, spec, horseshoe.group_priors(spec, {}), keys=TRIAL) if folds else gmlm.Model(rows.drop("fold"), spec, horseshoe.group_priors(spec, {}))  # folds and trials apart, more bins are alike
    try:
        return work(model, start)
    finally:
        model.close()


def fit_table(spark, model, found):
    out = gmlm.as_table(spark, model.spec, found["params"])
    return out.withColumns({"value_at": F.lit(found["value"]), "converged": F.lit(found["converged"])})


@query("gmlm_mle")
def gmlm_mle(spark, sf_dir):
    """Neurons' parameters are fitted where they lie; only the modes are on the driver."""
    rows, spec, _ = general(spark, sf_dir)
    own = by_neuron.Fit(rows, spec, gmlm.random_params(spec, 1), precision={"B": 1e-4, "g.V": 1e-4})  # counts of a few bins don't fix all coefficients of a neuron
    try:
        found = own.run(12, 1e-6)
        own.normalize()
    finally:
        own.close()
    return own.parameters().withColumns({"value_at": F.lit(found["value"]), "converged": F.lit(found["converged"])})


@query("gmlm_map")
def gmlm_map(spark, sf_dir):
    """From two starts side by side; the better one."""
    def work(model, start):
        return fit_table(spark, model, max(model.fit([start, gmlm.random_params(model.spec, 2, mean=-1.0)], prior=True, steps=300), key=lambda f: f["value"]))

    return fitted(spark, sf_dir, work)


@query("gmlm_alternating_fit")
def gmlm_alternating_fit(spark, sf_dir):
    return fitted(spark, sf_dir, lambda model, start: fit_table(spark, model, model.alternate(start, prior=True, sweeps=8, steps=8, tolerance=1e-5)))


@query("gmlm_cv")
def gmlm_cv(spark, sf_dir):
    """Held-out log likelihoods of trials; the fits of all folds go side by side."""
    return fitted(spark, sf_dir, lambda model, start: cut_rows(spark, model.cross_validate(start, FOLDS, TRIAL, prior=True, steps=60, tolerance=1e-5)), folds=True)


def cut_rows(spark, df: DataFrame) -> DataFrame:
    """``df`` as it is now, in a table, so that the rows it was made from may be let go."""
    df.write.parquet(path := trials.shared_folder(spark, "rows"))
    return spark.read.schema(df.schema).parquet(path)


#: Runs of this process, by application and folder: a run's queries read the same sinks.
RUNS: dict[tuple, str] = {}


def sampled(spark, sf_dir) -> dict[str, DataFrame]:
    """Two chains of the general model under a regularized horseshoe, with scaling steps; a short run, cut into two blocks and gone on with."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in RUNS:
        return sampler.stored(spark, RUNS[key])
    rows, spec, params = general(spark, sf_dir)
    size = horseshoe.Scales(spec, spec.groups[0]).size
    spec = dataclasses.replace(spec, hyper=size)
    scales = horseshoe.Scales(spec, spec.groups[0])
    priors_ = [scales.prior, gmlm.gaussian_prior({"W": 0.0, "B": 0.0})]
    model = gmlm.Model(rows.drop("fold"), spec, priors_, horseshoe.chain([scales]), TRIAL)
    starts = [gmlm.random_params(spec, k) | {"W": params["W"], "B": params["B"], "H": scales.draw(np.random.default_rng(k))} for k in range(2)]
    own = sampler.settings(6, 4, schedule=[(1, 6)], mass=[], block=5, first_step=0.005, least_step=0.005, length=0.02, most_steps=4)
    path = trials.shared_folder(spark, "chains")
    try:
        found = sampler.sample(model, starts, own, path, TRIAL, [sampler.scaling_step(spec, 0, priors_)])
    finally:
        model.close()
    RUNS[key] = path
    return found


@query("gmlm_sampler_draws")
def gmlm_sampler_draws(spark, sf_dir):
    """Draws of all parameters, scaled and natural, as the sink holds them."""
    return sampled(spark, sf_dir)["draws"]


@query("gmlm_sampler_trial_ll")
def gmlm_sampler_trial_ll(spark, sf_dir):
    """The sink of trial log likelihoods under the draws after the warm-up."""
    return sampled(spark, sf_dir)["trial_ll"]


@query("gmlm_sampler_summary")
def gmlm_sampler_summary(spark, sf_dir):
    """WAIC, PSIS-LOO with its diagnostics, acceptance and early rejections of the stored run."""
    return sampler.summary(sampled(spark, sf_dir), TRIAL, 6)


@query("gmlm_sampler_acceptance")
def gmlm_sampler_acceptance(spark, sf_dir):
    return sampler.trailing_acceptance(sampled(spark, sf_dir))


@query("gmlm_sampler_magnitudes")
def gmlm_sampler_magnitudes(spark, sf_dir):
    """Components' magnitudes in every draw."""
    return sampler.magnitudes(sampled(spark, sf_dir), "g")


def line_model(spark, sf_dir, priors_, **more) -> gmlm.Model:
    """A constant for each line number with normal errors: quantities in tens."""
    lines = trials.table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_returnflag").alias("trial"), (F.col("l_linenumber") - 1).cast("bigint").alias("neuron_ix"), (F.col("l_quantity").cast("double") / 10).alias("y"), F.lit(1.0).alias("w"))
    return gmlm.Model(rows, gmlm.Spec(7, 0, kind="sq_err", **more), priors_, keys=["neuron_ix"])


@query("noise_sampler", "WITH s AS (SELECT l_linenumber - 1 AS row, count(*) AS n, count(*) * var_pop(l_quantity::DOUBLE / 10) AS ss FROM lineitem GROUP BY 1) SELECT row::INT AS row, round((2 + (n - 1) / 2.0) / (1 + ss / 2), 5) AS conjugate_mean, 1.0::DOUBLE AS ratio FROM s")
def noise_sampler(spark, sf_dir):
    """Means of constants drawn by Hamiltonian steps with noise precisions drawn by Gibbs steps, beside the precision's conjugate mean; their ratio to one digit."""
    model = line_model(spark, sf_dir, [gmlm.gaussian_prior({"W": 3.0}), sampler.noise_prior()])
    own = sampler.settings(6, 24, schedule=[(2, 6)], mass=[], block=30, first_step=0.01, least_step=0.005, length=0.03, most_steps=3, jumps=(1,))
    try:
        run = sampler.sample(model, [gmlm.empty_params(model.spec)], own, trials.shared_folder(spark, "chains"), ["neuron_ix"], [sampler.noise_step(model)])
        y, n = F.col("y"), F.count(F.lit(1))
        exact = model.rows.groupBy(F.col("neuron_ix").cast("int").alias("row")).agg(((2 + (n - 1) / 2) / (1 + n * F.var_pop(y) / 2)).alias("conjugate_mean"))
        drawn = run["draws"].where("block = 'noise' AND iter > 6").groupBy("row").agg(F.avg("value").alias("mean"))
        return cut_rows(spark, exact.join(drawn, "row").select("row", F.round("conjugate_mean", 5).alias("conjugate_mean"), F.round(F.col("mean") / F.col("conjugate_mean"), 1).alias("ratio")))
    finally:
        model.close()


@query("map_conjugate", "SELECT (l_linenumber - 1)::INT AS row, round(sum(l_quantity::DOUBLE / 10) / (count(*) + 0.25), 4) AS estimate, round(-(count(*) + 0.25), 2) AS curvature FROM lineitem GROUP BY 1")
def map_conjugate(spark, sf_dir):
    """A posteriori mode and the Hessian's diagonal there of a model with closed form."""
    model = line_model(spark, sf_dir, [gmlm.gaussian_prior({"W": math.log(2.0)})])
    try:
        best = model.fit([gmlm.empty_params(model.spec)], prior=True, tolerance=1e-14)[0]["params"]
        curvature = np.diag(model.hessian(best, blocks={"W"}))
    finally:
        model.close()
    return spark.createDataFrame([(i, round(float(v), 4), round(float(c), 2)) for i, (v, c) in enumerate(zip(best["W"], curvature, strict=True))], "row int, estimate double, curvature double")


EVIDENCE_AT = (-1.0, -0.25, 0.5)


@query("evidence_squared_error", "WITH s AS (SELECT count(*)::DOUBLE AS n, sum(l_discount::DOUBLE * 100) AS g, sum((l_discount::DOUBLE * 100) * (l_discount::DOUBLE * 100)) AS q FROM lineitem), h AS (SELECT h, exp(2 * h) AS s FROM (VALUES (-1.0::DOUBLE), (-0.25), (0.5)) t(h)) "
       "SELECT h, round(-0.5 * q + 0.5 * g * g / (n + 1 / s) - 0.5 * ln(1 + s * n), 2) AS log_evidence, round(2 * s * (0.5 * g * g / (s * s) / ((n + 1 / s) * (n + 1 / s)) - 0.5 * n / (1 + s * n)), 4) AS gradient FROM s, h")
def evidence_squared_error(spark, sf_dir):
    """Evidence and its gradient of a constant with normal errors, whose closed form is known."""
    lines = trials.table(spark, sf_dir, "lineitem").select((F.col("l_discount").cast("double") * 100).alias("y"))
    own = fits.Evidence(lines, [F.lit(1.0)], fits.group_covariance([1]), "sq_err")
    try:
        found = [(h, *own.value(np.array([h]))) for h in EVIDENCE_AT]
    finally:
        own.close()
    return spark.createDataFrame([(h, round(v, 2), round(float(g[0]), 4)) for h, v, g in found], "h double, log_evidence double, gradient double")


@query("prior_composed_filters", ", w AS (SELECT neuron, avg(y) AS a, avg(h1) AS b, avg(h2) AS c, avg(h3) AS d, avg(y * y) AS e FROM hist GROUP BY 1) SELECT neuron, round(-0.5 * (a * a + b * b) * exp(-0.4) - 0.4 - ln(2 * pi()) - 0.5 * (c * c + d * d) * exp(1.0) + 1.0 - ln(2 * pi()), 6) AS lp, round(-a * exp(-0.4), 6) AS d_lever, round(-c * exp(1.0), 6) AS d_history, round((a * a + b * b) * exp(-0.4) - 2, 6) AS h_lever FROM w")
def prior_composed_filters(spark, sf_dir):
    """Log density and derivatives of each neuron's five weights under a composed prior: two parts with a scale of their own, and a constant without any."""
    import pyarrow as pa

    own = filters.Composed([filters.independent("lever", 2, None), filters.independent("history", 2, None), filters.free("constant", 1)])
    rows = timed(spark, sf_dir, 3).groupBy("neuron").agg(*(F.avg(c).alias(n) for n, c in zip("abcde", (F.col("y"), F.col("h1"), F.col("h2"), F.col("h3"), F.col("y") * F.col("y")), strict=True)))
    h = np.array([0.2, -0.5])

    def run(batches):
        for b in batches:
            found = [own.log_prior(np.array(w), h) for w in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            columns = [[f[0] for f in found], [f[1][0] for f in found], [f[1][2] for f in found], [f[2][0] for f in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in columns)], names=["neuron", "lp", "d_lever", "d_history", "h_lever"])

    return rounded(rows.mapInArrow(run, f"neuron {rows.schema['neuron'].dataType.simpleString()}, lp double, d_lever double, d_history double, h_lever double"))


@query("noise_precision_draws")
def noise_precision_draws(spark, sf_dir):
    """Conjugate draws of each neuron's noise precision."""
    rows = sse_posterior(spark, sf_dir)
    return sampler.unit_draws(rows, ["neuron"], ["shape", "rate"], 20, lambda rng, shape, rate: np.array([rng.gamma(shape, 1 / rate)]), ["precision"])


@query("gig_draws")
def gig_draws(spark, sf_dir):
    """Generalized inverse Gaussian draws of a variance for each neuron: p from its bins, a = 1, b from its squared errors."""
    rows = sse_posterior(spark, sf_dir).select("neuron", (1.0 - F.col("shape")).alias("p"), F.lit(1.0).alias("a"), (2 * F.col("rate")).alias("b"))
    return sampler.unit_draws(rows, ["neuron"], ["p", "a", "b"], 20, lambda rng, p, a, b: np.array([sampler.generalized_inverse_gaussian(rng, p, a, b)]), ["variance"])


@query("dirichlet_draws")
def dirichlet_draws(spark, sf_dir):
    """Shares of event types by neuron, under a uniform prior."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    counted = trials.event_bins(events(spark, sf_dir)).groupBy("neuron").agg(*((1 + F.count_if(F.col("event_type") == k)).alias(k) for k in kinds))
    return sampler.unit_draws(counted, ["neuron"], kinds, 10, lambda rng, *n: sampler.dirichlet(rng, np.array(n)), [f"share_{k}" for k in kinds])


@query("tensor_loadings")
def tensor_loadings(spark, sf_dir):
    """Higher-order singular vectors of the group's tensor in every draw of the sampler's sink."""
    own = sampled(spark, sf_dir)["draws"].where(F.col("block").startswith("g."))
    return gmlm.loadings_table(own.withColumn("value", F.col("natural")), ["chain", "iter"], RANK)


# ---- builders and bases

STIM, RESPONSE, HISTORY = builders.cosine_table(STEPS, 2), builders.cosine_table(6, 2, -2), np.array([[math.cos(j), math.sin(j)] for j in (1, 2, 3)])
TUNING = stimulus.design(np.arange(8) * 45.0, np.arange(8) // 4, "cosine", True, True, True)
BUILD_SQL = """, bd0 AS (SELECT h.neuron, h.trial, h.bin, h.y, t.sample, t.test, t.lever, (h.neuron % 8)::INT AS d, h1 * cos(1) + h2 * cos(2) + h3 * cos(3) AS k0, h1 * sin(1) + h2 * sin(2) + h3 * sin(3) AS k1 FROM hist h JOIN times t USING (neuron, trial)),
bd AS (SELECT *, CASE WHEN bin - sample BETWEEN 0 AND 11 THEN bin - sample ELSE -1 END AS s_ix, CASE WHEN bin - test BETWEEN 0 AND 11 THEN bin - test ELSE -1 END AS t_ix, CASE WHEN bin - lever + 2 BETWEEN 0 AND 5 THEN bin - lever + 2 ELSE -1 END AS r_ix FROM bd0) """
AT_SQL = "CASE WHEN {ix} >= 0 THEN cos(({ix} + 1) * {k}) / 4 ELSE 0 END"


def model_rows(spark, sf_dir, onsets=False):
    return builders.gmlm_rows(timed(spark, sf_dir, 3), HISTORY, STIM, RESPONSE, DIRECTIONS, onsets)


@query("gmlm_builder", BUILD_SQL + "SELECT neuron, trial, bin, y, round(k0, 6) AS k0, round(k1, 6) AS k1, s_ix, t_ix, CASE WHEN s_ix >= 0 THEN d ELSE -1 END AS s_dir, CASE WHEN t_ix >= 0 THEN d + 8 ELSE -1 END AS t_dir, r_ix FROM bd")
def gmlm_builder(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return rows.select(*TRIAL, "bin", "y", *(F.round(F.get("x_lin", F.lit(i)), 6).alias(f"k{i}") for i in range(2)), *(F.get(c, F.lit(i)).alias(n) for n, c, i in (("s_ix", "stim_ix", 0), ("t_ix", "stim_ix", 1), ("s_dir", "dir_ix", 0), ("t_dir", "dir_ix", 1), ("r_ix", "resp_ix", 0))))


@query("gmlm_builder_onsets", BUILD_SQL + "SELECT neuron, trial, " + ", ".join(f"round(sum(y * {e}), 6) AS x{i}" for i, e in enumerate(["k0", "k1", *(AT_SQL.format(ix=ix, k=k) for ix in ("s_ix", "t_ix") for k in (1, 2))])) + " FROM bd GROUP BY ALL")
def gmlm_builder_onsets(spark, sf_dir):
    rows = model_rows(spark, sf_dir, True)
    return rounded(rows.groupBy(*TRIAL).agg(*(F.sum(F.col("y") * F.get("x_lin", F.lit(i))).alias(f"x{i}") for i in range(6))))


CAT_SQL, SIN_SQL, COS_SQL = "CASE WHEN d {op} 4 THEN 1 ELSE 0 END", "sin(d * pi() / 4)", "cos(d * pi() / 4)"
GLM_X = [" + ".join(f"({CAT_SQL.format(op=op)} * {AT_SQL.format(ix=ix, k=k)})" for ix in [ixs]) for ixs in ("s_ix", "t_ix") for op in ("<", ">=") for k in (1, 2)]
GLM_X += [f"{w} * ({AT_SQL.format(ix='s_ix', k=k)} + {AT_SQL.format(ix='t_ix', k=k)})" for w in (SIN_SQL, COS_SQL) for k in (1, 2)]
GLM_X += [AT_SQL.format(ix="r_ix", k=k) for k in (1, 2)] + ["k0", "k1", "1"]


@query("glm_design_full", BUILD_SQL + "SELECT neuron, trial, " + ", ".join(f"round(sum((y + 1) * ({e})), 5) AS x{i}" for i, e in enumerate(GLM_X)) + " FROM bd GROUP BY ALL")
def glm_design_full(spark, sf_dir):
    rows, groups = builders.glm_design(timed(spark, sf_dir, 3), HISTORY, STIM, RESPONSE, TUNING.stacked(), DIRECTIONS)
    n = sum(size for _, size in groups.values())
    return rounded(rows.groupBy(*TRIAL).agg(*(F.sum((F.col("y") + 1) * F.get("x", F.lit(i))).alias(f"x{i}") for i in range(n))), 5)


DYN_SQL = BUILD_SQL + """, dy AS (SELECT neuron, trial, bin, y, (0.1 * (1 + neuron % 3)) * ((k0 + 0.5 * k1) * ({sd} * {s} + {td} * {t}) + (k0 - k1) * {r}) AS x FROM bd) """.format(s=AT_SQL.format(ix="s_ix", k=1), t=AT_SQL.format(ix="t_ix", k=1), r=AT_SQL.format(ix="r_ix", k=2), sd="sin(d + 1)", td="sin(d + 9)")


@query("dynamic_history_rate", DYN_SQL + "SELECT neuron, trial, round(sum(x), 6) AS x FROM dy GROUP BY ALL")
def dynamic_history_rate(spark, sf_dir):
    """Groups whose kernel is the spike history: by the stimulus' timing and direction, and by the response's timing."""
    rows = model_rows(spark, sf_dir)
    ids = [r["neuron"] for r in rows.select("neuron", "neuron_ix").distinct().orderBy("neuron_ix").collect()]  # the model's units
    spec = builders.gmlm_spec(len(ids), HISTORY, STIM, RESPONSE, np.eye(16), {"stimulus_history": 1, "response_history": 1})
    params, load_ = gmlm.empty_params(spec), 0.1 * (1 + np.array(ids) % 3)[:, None]
    params |= {"stimulus_history.V": load_, "stimulus_history.T0": np.array([[1.0], [0.5]]), "stimulus_history.T1": np.array([[1.0], [0.0]]), "stimulus_history.T2": np.sin(np.arange(16) + 1.0)[:, None]}
    params |= {"response_history.V": load_, "response_history.T0": np.array([[1.0], [-1.0]]), "response_history.T1": np.array([[0.0], [1.0]])}
    return rounded(gmlm.rates(rows, spec, params, TRIAL).groupBy(*TRIAL).agg(F.sum("x").alias("x")))


@query("spline_basis_ends", """, kn(i, k) AS (VALUES (0, -1.0::DOUBLE), (1, 3.1), (2, 7.3), (3, 12.7), (4, 18.9), (5, 24)), sg AS (SELECT i, k, lead(k) OVER w AS k1, lag(k) OVER w AS kp, lead(k, 2) OVER w AS k2 FROM kn WINDOW w AS (ORDER BY i)),
us AS (SELECT b.neuron, b.y, s.*, (b.bin - k) / (k1 - k) AS u FROM bins b JOIN sg s ON b.bin > s.k AND b.bin <= s.k1), hs AS (SELECT *, u * u * u - 2 * u * u + u AS h10, u * u * u - u * u AS h11 FROM us),
sp AS (SELECT neuron, i AS j, y * (2 * u * u * u - 3 * u * u + 1) AS v FROM hs UNION ALL SELECT neuron, i + 1, y * (3 * u * u - 2 * u * u * u) FROM hs
  UNION ALL SELECT neuron, i + g, y * g * 0.5 * h10 / ((k1 - kp) / CASE WHEN i = 4 THEN k1 - k ELSE 1 END) FROM hs CROSS JOIN (VALUES (1), (-1)) q(g) WHERE i > 0
  UNION ALL SELECT neuron, i + 1 + g, y * g * 0.5 * h11 / ((k2 - k) / CASE WHEN i = 0 THEN k1 - k ELSE 1 END) FROM hs CROSS JOIN (VALUES (1), (-1)) q(g) WHERE i < 4)
SELECT neuron, j::INT AS j, round(sum(v), 4) AS s FROM sp GROUP BY ALL""")
def spline_basis_ends(spark, sf_dir):
    """Spline regressors with their flat ends: counts by bin first, then the basis. The knots lie between bins, where no sum ends on a rounding tie."""
    basis = basis_sets.cardinal_spline(np.arange(trials.BINS, dtype=float), [-1.0, 3.1, 7.3, 12.7, 18.9, 24.0])
    by_bin = bins(spark, sf_dir).groupBy("neuron", "bin").agg(F.sum("y").alias("y"))
    parts = F.array(*(F.struct(F.lit(j).alias("j"), (F.col("y") * model.gather(F.col("bin"), column.tolist())).alias("v")) for j, column in enumerate(basis.T)))
    return rounded(by_bin.select("neuron", F.explode(parts).alias("p")).groupBy("neuron", F.col("p.j").alias("j")).agg(F.sum("p.v").alias("s")), 4)


@query("cosine_basis_set")
def cosine_basis_set(spark, sf_dir):
    """Each neuron's event-triggered counts on the stimulus and response bases of a recording in hours."""
    return on_bases(spark, sf_dir, basis_sets.cosine_set(100.0, 1500.0, 5, 2))


@query("spline_basis_set")
def spline_basis_set(spark, sf_dir):
    return on_bases(spark, sf_dir, basis_sets.spline_set(100.0))


def on_bases(spark, sf_dir, sets):
    parts = []
    for name, event in (("stim", "sample"), ("response", "lever")):
        b = sets[name]
        parts += [F.struct(F.lit(name).alias("basis"), F.lit(k).alias("k"), (F.col("y") * v).alias("v")) for k, v in enumerate(builders.basis_at(b, builders.event_rows(b, event)))]
    rows = timed(spark, sf_dir).select("neuron", F.explode(F.array(*parts)).alias("p"))
    return rounded(rows.groupBy("neuron", "p.basis", "p.k").agg(F.sum("p.v").alias("s")))


@query("stim_design_cosine", BUILD_SQL + "SELECT neuron, trial, " + ", ".join(f"round(sum(y * {e}), 6) AS f{i}" for i, e in enumerate(["CASE WHEN s_ix >= 0 AND d < 4 THEN 1 ELSE 0 END", "CASE WHEN s_ix >= 0 AND d >= 4 THEN 1 ELSE 0 END", "CASE WHEN t_ix >= 0 AND d < 4 THEN 1 ELSE 0 END", "CASE WHEN t_ix >= 0 AND d >= 4 THEN 1 ELSE 0 END", "sin(d * pi() / 4) * ((s_ix >= 0)::INT + (t_ix >= 0)::INT)", "cos(d * pi() / 4) * ((s_ix >= 0)::INT + (t_ix >= 0)::INT)"])) + " FROM bd GROUP BY ALL")
def stim_design_cosine(spark, sf_dir):
    """Features of both periods: categories of each, one sine and cosine."""
    table_, pairs = TUNING.stacked(), design.two_events(DIRECTIONS, STEPS)
    features = [sum((model.gather(d, column.tolist()) for _, d in pairs), F.lit(0.0)) for column in table_.T]
    return rounded(timed(spark, sf_dir).groupBy(*TRIAL).agg(*(F.sum(F.col("y") * f).alias(f"f{i}") for i, f in enumerate(features))))


@query("stim_contrast_scaled", "SELECT neuron, trial, round(sum(y), 6) AS f0, round(sum(CASE WHEN neuron % 8 < 4 THEN y ELSE -y END), 6) AS f1, round(sum(y * sin(neuron % 8 * pi() / 4)) * sqrt(2), 6) AS f2, round(sum(y * cos(neuron % 8 * pi() / 4)) * sqrt(2), 6) AS f3 FROM bins GROUP BY ALL")
def stim_contrast_scaled(spark, sf_dir):
    """Contrast coding, each feature with a root mean square of one over directions."""
    x = stimulus.contrast_design(np.arange(8) * 45.0, np.arange(8) // 4, None, False)[:, :, 0]
    sums = bins(spark, sf_dir).groupBy(*TRIAL).agg(F.sum("y").alias("y"))
    return rounded(sums.select(*TRIAL, *((F.col("y") * model.gather(design.direction(), column.tolist())).alias(f"f{i}") for i, column in enumerate(x.T))))


# ---- priors with derivatives, over tables of coefficients

COEF_SQL = f""", co AS (SELECT neuron, neuron % 2 AS component, neuron % 3 AS mode, w AS x, -0.3 AS g, 0.1 * (neuron % 3) AS m, 0.2 * sin(neuron) AS l FROM {RATES_SQL}) """


def coefficients(spark, sf_dir):
    """A coefficient for each neuron with log scales in closed form: global, of its mode, and its own."""
    p = F.col("neuron")
    return rates(spark, sf_dir).select("neuron", F.pmod(p, F.lit(2)).alias("component"), F.pmod(p, F.lit(3)).alias("mode"), F.col("w").alias("x"), F.lit(-0.3).alias("g"), (0.1 * F.pmod(p, F.lit(3))).alias("m"), (0.2 * F.sin(p)).alias("l"))


def named(columns: dict) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


@query("prior_gaussian_gradient", COEF_SQL + "SELECT neuron, round(-0.5 * x * x * exp(-2 * l) - 0.5 * ln(2 * pi()) - l, 6) AS lp, round(-x * exp(-2 * l), 6) AS dx, round(x * x * exp(-2 * l) - 1, 6) AS dh FROM co")
def prior_gaussian_gradient(spark, sf_dir):
    return rounded(coefficients(spark, sf_dir).select("neuron", *named(dict(zip(("lp", "dx", "dh"), priors.gaussian_terms(F.col("x"), F.col("l")), strict=True)))))


HALF_T_SQL = "(ln(2) + lgamma(2) - lgamma(1.5) - 0.5 * ln(3 * pi()) - ({s}) - 2 * ln(1 + exp(2 * (({x}) - ({s}))) / 3) + ({x}))"
HALF_T_DX = "(1 - 4 / (1 + 3 * exp(-2 * (({x}) - ({s})))))"


@query("prior_half_t_gradient", COEF_SQL + f"SELECT neuron, round({HALF_T_SQL.format(x='x', s='m')}, 6) AS lp, round({HALF_T_DX.format(x='x', s='m')}, 6) AS dx, round(-{HALF_T_DX.format(x='x', s='m')}, 6) AS ds FROM co")
def prior_half_t_gradient(spark, sf_dir):
    lp, dx, _, ds = priors.half_t_terms(F.col("x"), 3.0, F.col("m"))
    return rounded(coefficients(spark, sf_dir).select("neuron", *named({"lp": lp, "dx": dx, "ds": ds})))


@query("prior_inverse_gamma_gradient", COEF_SQL + "SELECT neuron, round(3 * ln(2) - lgamma(3) - 3 * x - 2 * exp(-x), 5) AS lp, round(2 * exp(-x) - 3, 5) AS dx FROM co")
def prior_inverse_gamma_gradient(spark, sf_dir):
    lp, dx, _ = priors.inverse_gamma_terms(F.col("x"), 3.0, 2.0)
    return rounded(coefficients(spark, sf_dir).select("neuron", *named({"lp": lp, "dx": dx})), 5)


@query("prior_inverse_gaussian", COEF_SQL + "SELECT neuron, round(0.5 * ln(2) - 0.5 * ln(2 * pi()) - 0.5 * x - (exp(x) - 1.5) * (exp(x) - 1.5) / (1.5 * 1.5 * exp(x)), 5) AS lp, round(-0.5 - exp(x) / 2.25 + exp(-x), 5) AS dx FROM co")
def prior_inverse_gaussian(spark, sf_dir):
    lp, dx, _ = priors.inverse_gaussian_terms(F.col("x"), 1.5, 2.0)
    return rounded(coefficients(spark, sf_dir).select("neuron", *named({"lp": lp, "dx": dx})), 5)


SD_SQL = "(g + m + l - 0.5 * ln(1 + exp(2 * (g + m + l - 0.4))))"


@query("prior_horseshoe", COEF_SQL + f", hs AS (SELECT *, {SD_SQL} AS h, 1 / (1 + exp(-2 * (g + m + l - 0.4))) AS q FROM co) SELECT neuron, round(-0.5 * x * x * exp(-2 * h) - 0.5 * ln(2 * pi()) - h, 5) AS lp, round(-x * exp(-2 * h), 5) AS d_x, round((x * x * exp(-2 * h) - 1) * (1 - q), 5) AS d_local, round((x * x * exp(-2 * h) - 1) * q, 5) AS d_slab FROM hs")
def prior_horseshoe(spark, sf_dir):
    found = priors.horseshoe_terms(F.col("x"), F.col("g"), F.col("m"), F.col("l"), 0.4)
    return rounded(coefficients(spark, sf_dir).select("neuron", *named({k: found[k] for k in ("lp", "d_x", "d_local", "d_slab")})), 5)


@query("prior_horseshoe_rescaled", COEF_SQL + f", hs AS (SELECT *, {SD_SQL} AS h, 1 / (1 + exp(-2 * (g + m + l - 0.4))) AS q FROM co) SELECT neuron, round(x * exp(h), 6) AS x, round(exp(h), 6) AS by_z, round(x * exp(h) * (1 - q), 6) AS by_scale, round(x * exp(h) * q, 6) AS by_slab FROM hs")
def prior_horseshoe_rescaled(spark, sf_dir):
    """Non-centred draws brought to their natural scale, and the chain rule back."""
    found = priors.rescaled(F.col("x"), F.col("g"), F.col("m"), F.col("l"), 0.4)
    return rounded(coefficients(spark, sf_dir).select("neuron", *named(dict(zip(("x", "by_z", "by_scale", "by_slab"), found, strict=True)))))


@query("prior_horseshoe_hierarchical", COEF_SQL + f"SELECT mode, round(sum({HALF_T_SQL.format(x='l', s='m')} + {HALF_T_SQL.format(x='m', s='g')}), 5) AS lp, round(sum({HALF_T_DX.format(x='l', s='m')}), 5) AS d_local, round(sum({HALF_T_DX.format(x='m', s='g')} - {HALF_T_DX.format(x='l', s='m')}), 5) AS d_mode, round(sum(-{HALF_T_DX.format(x='m', s='g')}), 5) AS d_global FROM co GROUP BY mode")
def prior_horseshoe_hierarchical(spark, sf_dir):
    found = priors.hierarchical_half_t(F.col("l"), F.col("m"), F.col("g"))
    rows = coefficients(spark, sf_dir).select("mode", *named(found))
    return rounded(priors.total(rows, ["mode"], list(found)), 5)


@query("prior_scaled_gaussian", COEF_SQL + """, g1 AS (SELECT component, mode, count(*) AS n, sum(x * x) AS xx FROM co GROUP BY ALL), sc AS (SELECT 'all_group' AS structure, 0.2 AS h, * FROM g1 UNION ALL SELECT 'group', 0.2 + 0.1 * component, * FROM g1 UNION ALL SELECT 'std', 0.2 - 0.1 * mode, * FROM g1)
SELECT structure, component, round(sum(-0.5 * xx * exp(-2 * h) - n * (0.5 * ln(2 * pi()) + h)), 4) AS lp, round(sum(xx * exp(-2 * h) - n), 4) AS d_h FROM sc GROUP BY ALL""")
def prior_scaled_gaussian(spark, sf_dir):
    """Variance structures: one scale for all, one for each component, one for each mode."""
    own, out = coefficients(spark, sf_dir), None
    for structure, key, h in (("all_group", [], F.lit(0.2)), ("group", ["component"], 0.2 + 0.1 * F.col("component")), ("std", ["mode"], 0.2 - 0.1 * F.col("mode"))):
        scales = own.select(*key, h.alias("h")).distinct()
        terms_ = priors.scaled_gaussian(own, scales, structure).withColumn("structure", F.lit(structure))
        sums = priors.total(terms_, ["structure", "component"], ["lp", "d_h"])
        out = sums if out is None else out.unionByName(sums)
    return rounded(out, 4)


@query("prior_fixed_variance", COEF_SQL + "SELECT mode, count(*) AS n, round(sum(-0.5 * x * x * exp(-0.5) - 0.5 * ln(2 * pi()) - 0.25), 5) AS lp, round(exp(0.5), 6) AS variance FROM co GROUP BY mode")
def prior_fixed_variance(spark, sf_dir):
    """A Gaussian of fixed scale on whole modes, with the modes' variance."""
    rows = coefficients(spark, sf_dir).withColumn("lp", priors.gaussian(F.col("x"), 0.25))
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lp"), 5).alias("lp"), F.round(F.lit(math.exp(0.5)), 6).alias("variance"))


@query("prior_stimulus_gaussian", f""", cv AS (SELECT neuron, w AS a, w * cos(neuron) AS b FROM {RATES_SQL}) SELECT neuron, round(-0.5 * (1.25 * a * a - 2 * 0.5 * a * b + 1.0 * b * b) / (1.25 * 1.0 - 0.25) - ln(2 * pi()) - 0.5 * ln(1.25 * 1.0 - 0.25), 5) AS lp, round(-(1.25 * a - 0.5 * b), 5) AS d0, round(-(b - 0.5 * a), 5) AS d1 FROM cv""")
def prior_stimulus_gaussian(spark, sf_dir):
    """Correlated coefficients: N(0, S) with S = [[1, 0.5], [0.5, 1.25]]; its inverse root is applied in the row."""
    cov = np.array([[1.0, 0.5], [0.5, 1.25]])
    inverse, logdet = np.linalg.inv(cov), gmlm.log_det(cov)
    x = [F.col("w"), F.col("w") * F.cos("neuron")]
    pulled = [sum((float(inverse[i, j]) * x[j] for j in range(2)), F.lit(0.0)) for i in range(2)]
    lp = -0.5 * (x[0] * pulled[0] + x[1] * pulled[1]) - math.log(2 * math.pi) - 0.5 * logdet
    return rounded(rates(spark, sf_dir).select("neuron", lp.alias("lp"), (-pulled[0]).alias("d0"), (-pulled[1]).alias("d1")), 5)


KERNEL_SQL = "(exp(2 * -0.2) * (1 + (exp(0.1) + 4) * x) * pow(1 - x, exp(0.1) + 4))"


@query("prior_polar_kernel", f", dp AS (SELECT (neuron % 8) AS i, sum(y) AS y FROM bins GROUP BY 1), ang AS (SELECT a.i, b.i AS j, a.y AS ya, b.y AS yb, least(abs(a.i - b.i), 8 - abs(a.i - b.i)) / 4.0 AS x FROM dp a JOIN dp b ON true) SELECT i::INT AS direction, round(sum(yb * {KERNEL_SQL}), 4) AS smooth FROM ang GROUP BY 1")
def prior_polar_kernel(spark, sf_dir):
    """Counts by direction, smoothed with the polar kernel that the directions' prior has."""
    angles = np.arange(8) * math.pi / 4
    piece = stimulus.Piece("smooth", np.eye(8), np.arccos(np.clip(np.cos(angles[:, None] - angles), -1, 1)))
    kernel, _ = stimulus.covariance([piece], np.array([-0.2, 0.1]))
    by_direction = bins(spark, sf_dir).groupBy(design.direction().alias("d")).agg(F.sum("y").alias("y"))
    parts = F.array(*(F.struct(F.lit(i).alias("direction"), (F.col("y") * model.gather(F.col("d"), kernel[i].tolist())).alias("v")) for i in range(8)))
    return rounded(by_direction.select(F.explode(parts).alias("p")).groupBy("p.direction").agg(F.sum("p.v").alias("smooth")), 4)


# ---- fits and sampling (iterative: checked by tests, without SQL)

@query("glm_newton_fit")
def glm_newton_fit(spark, sf_dir):
    return fits.newton(timed(spark, sf_dir, 3), [F.lit(1.0), *regressors()], "poiss_exp")


@query("glm_unit_fits")
def glm_unit_fits(spark, sf_dir):
    return fits.unit_fits(timed(spark, sf_dir, 3), [F.lit(1.0), *regressors()], ["neuron"])


@query("cv_fit")
def cv_fit(spark, sf_dir):
    rows = timed(spark, sf_dir, 3).withColumn("fold", F.pmod(F.col("neuron") + F.dayofmonth(F.to_date("trial")), F.lit(FOLDS)))
    return fits.cross_validate(rows, [F.lit(1.0), *regressors()], "fold", FOLDS)


@query("evidence_optimization")
def evidence_optimization(spark, sf_dir):
    return fits.evidence(timed(spark, sf_dir, 3), [F.lit(1.0), *regressors()], ["neuron"])


@query("evidence_by_group")
def evidence_by_group(spark, sf_dir):
    """Log standard deviations of the constant, history and cosine weights with the greatest Laplace evidence."""
    own = fits.Evidence(timed(spark, sf_dir, 3), [F.lit(1.0), *regressors()], fits.group_covariance([1, 2, 1]))
    try:
        found = own.maximum(np.zeros(3), steps=40)
    finally:
        own.close()
    return spark.createDataFrame([(i, float(h), found["value"], found["converged"]) for i, h in enumerate(found["h"])], "hyperparameter int, h double, log_evidence double, converged boolean")


@query("evidence_cv")
def evidence_cv(spark, sf_dir):
    rows = timed(spark, sf_dir, 3).withColumn("fold", F.pmod(F.col("neuron") + F.dayofmonth(F.to_date("trial")), F.lit(FOLDS)))
    found = fits.evidence_cross_validated(rows, [F.lit(1.0), *regressors()], fits.group_covariance([1, 3]), np.zeros(2), "fold", FOLDS, steps=20)
    return spark.createDataFrame([(f["held"], f["value"], f["test_ll"], f["converged"]) for f in found], "held int, log_evidence double, test_ll double, converged boolean")


@query("gmlm_alternating_rank1")
def gmlm_alternating_rank1(spark, sf_dir):
    rows = lin(spark, sf_dir).select(*TRIAL, "bin", "y", "x")
    events_ = both_events(spark, sf_dir)
    return fits.alternating_rank1(rows, events_, STEPS, 2 * DIRECTIONS)


@query("hmc_draws")
def hmc_draws(spark, sf_dir):
    return fits.hmc(timed(spark, sf_dir, 3), [F.lit(1.0), *regressors()], ["neuron"])


PSIS_SQL = DRAW_SQL + """, z0 AS (SELECT neuron, trial, list(ll ORDER BY ll DESC) AS lls, list(-ll ORDER BY ll DESC) AS raw, count(*) AS n FROM dr GROUP BY ALL),
z1 AS (SELECT *, list_transform(raw, lambda v: v - raw[n]) AS lw FROM z0), z2 AS (SELECT *, greatest(lw[n - 8], ln(2.2250738585072014e-308)) AS edge FROM z1),
z3 AS (SELECT *, list_transform(list_filter(lw, lambda v: v > edge), lambda v: exp(v) - exp(edge)) AS x FROM z2), z4 AS (SELECT *, len(x) AS k, 30 + floor(sqrt(len(x)))::INT AS m FROM z3),
z5 AS (SELECT *, CASE WHEN k > 4 THEN list_transform(range(1, m + 1), lambda j: 1 / x[k] + (1 - sqrt(m / (j - 0.5))) / (3 * x[floor(k / 4 + 0.5)::INT])) END AS b FROM z4),
z6 AS (SELECT *, list_transform(b, lambda c: list_avg(list_transform(x, lambda v: ln(1 - c * v)))) AS s FROM z5),
z7 AS (SELECT *, list_transform(range(1, m + 1), lambda i: k * (ln(-b[i] / s[i]) - s[i] - 1)) AS l FROM z6 WHERE k > 4),
z8 AS (SELECT *, list_transform(l, lambda a: 1 / list_sum(list_transform(l, lambda c: exp(least(700, greatest(-700, c - a)))))) AS w FROM z7),
z9 AS (SELECT *, list_sum(list_transform(range(1, m + 1), lambda i: b[i] * w[i])) / list_sum(w) AS best FROM z8),
z10 AS (SELECT *, list_avg(list_transform(x, lambda v: ln(1 - best * v))) AS shape FROM z9), z11 AS (SELECT *, (k * shape + 5) / (k + 10) AS kk, -shape / best AS scale FROM z10),
z12 AS (SELECT neuron, trial, lls, lw, edge, n, kk, CASE WHEN kk >= 1 / 3.0 THEN list_transform(range(1, n + 1), lambda i: CASE WHEN i <= n - k THEN lw[i] ELSE least(0, ln(scale * (pow(1 - (i - (n - k) - 0.5) / k, -kk) - 1) / kk + exp(edge))) END) ELSE lw END AS lw2 FROM z11
  UNION ALL SELECT neuron, trial, lls, lw, edge, n, 'inf'::DOUBLE, lw FROM z4 WHERE k <= 4),
loo AS (SELECT neuron, trial, kk AS pareto_k, ln(list_sum(list_transform(range(1, n + 1), lambda i: exp(lw2[i] + lls[i] - lls[1])))) + lls[1] - ln(list_sum(list_transform(lw2, lambda v: exp(v)))) AS loo FROM z12) """


@query("psis_loo", PSIS_SQL + "SELECT neuron, trial, round(loo, 4) AS loo, round(pareto_k, 4) AS pareto_k FROM loo")
def psis_loo(spark, sf_dir):
    return rounded(compare.psis_loo(draws(spark, sf_dir), "ll", TRIAL), 4)


@query("loo_diagnostics", PSIS_SQL + "SELECT round(sum(loo), 2) AS loo, count(*) FILTER (pareto_k >= 0.7) AS bad, count(*) AS units FROM loo")
def loo_diagnostics(spark, sf_dir):
    return rounded(compare.loo_summary(compare.psis_loo(draws(spark, sf_dir), "ll", TRIAL)), 2)


@query("waic_mean", DRAW_SQL + "SELECT round(avg(waic), 5) AS waic FROM (SELECT -(max(ll) + ln(sum(exp(ll - m)) / count(*))) + var_samp(ll) AS waic FROM (SELECT *, max(ll) OVER (PARTITION BY neuron, trial) AS m FROM dr) GROUP BY neuron, trial)")
def waic_mean(spark, sf_dir):
    return rounded(compare.waic(draws(spark, sf_dir), "ll", TRIAL).agg(F.avg("waic").alias("waic")), 5)


@query("draw_variance_moments", DRAW_SQL + "SELECT neuron, trial, round(avg(ll), 6) AS mean, round(var_pop(ll), 6) AS v FROM dr GROUP BY ALL")
def draw_variance_moments(spark, sf_dir):
    """E[x^2] - E[x]^2, without its cancellation."""
    return rounded(draws(spark, sf_dir).groupBy(*TRIAL).agg(F.avg("ll").alias("mean"), F.var_pop("ll").alias("v")))


@query("posterior_percentiles", DRAW_SQL + """, o AS (SELECT neuron, list(ll ORDER BY ll) AS v, count(*) AS n FROM dr GROUP BY 1), a AS (SELECT *, [greatest(1.0::DOUBLE, least(n::DOUBLE, q * n + 0.5)) FOR q IN [0.005::DOUBLE, 0.025, 0.5, 0.975, 0.995]] AS ats FROM o)
SELECT neuron, """ + ", ".join(f"round(v[floor(ats[{i + 1}])::INT] + (v[least(n, floor(ats[{i + 1}])::INT + 1)] - v[floor(ats[{i + 1}])::INT]) * (ats[{i + 1}] - floor(ats[{i + 1}])), 6) AS q{i}" for i in range(5)) + " FROM a")
def posterior_percentiles(spark, sf_dir):
    """Percentiles by the midpoint definition, (k - 0.5) / n."""
    return rounded(compare.percentiles(draws(spark, sf_dir), "ll", ["neuron"], [0.005, 0.025, 0.5, 0.975, 0.995]))


@query("log_sum_exp_pair", "SELECT neuron, round(sum(greatest(x, 0.1 * y) + ln(1 + exp(-abs(x - 0.1 * y)))), 6) AS s FROM lin GROUP BY 1")
def log_sum_exp_pair(spark, sf_dir):
    return rounded(lin(spark, sf_dir).groupBy("neuron").agg(F.sum(compare.log_sum_exp_pair(F.col("x"), 0.1 * F.col("y"))).alias("s")))


@query("safe_exponentials", "SELECT neuron, round(sum(exp(least(90, x))), 6) AS e, round(sum(exp(least(20, x)) - 1), 6) AS m FROM lin GROUP BY 1")
def safe_exponentials(spark, sf_dir):
    return rounded(lin(spark, sf_dir).groupBy("neuron").agg(F.sum(likelihood.safe_exp(F.col("x"))).alias("e"), F.sum(likelihood.safe_expm1(F.col("x"), 20.0)).alias("m")))


SUBSPACE_SQL = """, sd AS (SELECT b.neuron, b.bin, f.fold, y, day(strptime(b.trial, '%Y-%m-%d')) % 8 AS d FROM bins b JOIN fold f USING (neuron, trial)),
cs AS (SELECT neuron, k.k AS draw, bin, sum(y * cos(d * pi() / 4)) AS c, sum(y * sin(d * pi() / 4)) AS s, sum(CASE WHEN d < 4 THEN y ELSE -y END) AS g FROM sd CROSS JOIN range(5) k(k) WHERE fold <> k.k GROUP BY ALL),
gr AS (SELECT neuron, draw, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sqrt(sum(g * g)) AS category FROM cs GROUP BY ALL), ax AS (SELECT *, (cc + ss) / 2 AS mid, sqrt((cc - ss) * (cc - ss) / 4 + cs * cs) AS spread FROM gr),
el AS (SELECT neuron, draw, sqrt(mid + spread) AS major, sqrt(greatest(mid - spread, 0)) AS minor, pi() * sqrt(mid + spread) * sqrt(greatest(mid - spread, 0)) AS area, category FROM ax) """


def subspace(spark, sf_dir):
    """For each neuron and draw (all folds but one): the plane that cosine and sine tuning to the day's direction span over the bins, and the norm of the category's contrast."""
    rows = bins(spark, sf_dir).withColumn("d", F.dayofmonth(F.to_date("trial")) % DIRECTIONS).withColumn("fold", F.pmod(F.col("neuron") + F.dayofmonth(F.to_date("trial")), F.lit(FOLDS)))
    cos, sin = bases.cosine_tuning(F.col("d"), DIRECTIONS)
    sums = {"c": F.col("y") * cos, "s": F.col("y") * sin, "g": F.col("y") * bases.contrast(F.col("d"), DIRECTIONS)}
    by_fold = rows.groupBy("neuron", "bin", "fold").agg(*(F.sum(v).alias(n) for n, v in sums.items()))  # before the folds are spread to draws
    draws_ = by_fold.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).where("fold <> draw").groupBy("neuron", "draw", "bin").agg(*(F.sum(n).alias(n) for n in sums))
    products = draws_.groupBy("neuron", "draw").agg(F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("c") * F.col("s")).alias("cs"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("category"))
    return products.select("neuron", "draw", *(v.alias(n) for n, v in compare.ellipse(F.col("cc"), F.col("cs"), F.col("ss")).items()), "category")


@query("subspace_metrics", SUBSPACE_SQL + "SELECT neuron, draw::INT AS draw, round(major, 5) AS major, round(minor, 4) AS minor, round(area, 4) AS area, round(category, 5) AS category FROM el")
def subspace_metrics(spark, sf_dir):
    return subspace(spark, sf_dir).select("neuron", "draw", F.round("major", 5).alias("major"), F.round("minor", 4).alias("minor"), F.round("area", 4).alias("area"), F.round("category", 5).alias("category"))


@query("subspace_percentiles", SUBSPACE_SQL + ", o AS (SELECT neuron, list(major ORDER BY major) AS v FROM el GROUP BY 1 HAVING count(*) = 5) SELECT neuron, round(v[1], 5) AS q0, round(v[3], 5) AS q1, round(v[5], 5) AS q2 FROM o")
def subspace_percentiles(spark, sf_dir):
    own = subspace(spark, sf_dir)
    every = own.groupBy("neuron").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == FOLDS)
    return rounded(compare.percentiles(own.join(every, "neuron", "left_semi"), "major", ["neuron"], [0.025, 0.5, 0.975]), 5)


@query("neuron_filters", """, u AS (SELECT DISTINCT neuron FROM ev) SELECT neuron, t.t::INT AS t, round(sum((0.1 * (1 + neuron % 3) - 0.05 * r.r) * cos((k.k + 1) * (r.r + 1)) / 4 * (cos(greatest(-pi(), least(pi(), (ln(t.t + 1.5) - (ln(1.5) + k.k * (ln(13.5) - ln(1.5)) / 3)) * pi() / ((ln(13.5) - ln(1.5)) / 3) / 2))) + 1) / 2), 6) AS v
FROM u CROSS JOIN range(12) t(t) CROSS JOIN range(4) k(k) CROSS JOIN range(2) r(r) GROUP BY ALL""")
def neuron_filters(spark, sf_dir):
    """The timing filters B T of each component, weighted by the neuron's loads: the trace that a fit is shown by."""
    weights = [[math.cos((k + 1) * (r + 1)) / 4 for k in range(4)] for r in range(RANK)]
    curve = [[sum(bases.raised_cosine_at(t, k, 4, 0.0, 12.0, 1.5) * weights[r][k] for k in range(4)) for t in range(STEPS)] for r in range(RANK)]  # B T before any row is touched
    units = trials.event_bins(events(spark, sf_dir)).select("neuron").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    return rounded(units.select("neuron", "t", sum((load(r) * model.gather(F.col("t"), curve[r]) for r in range(RANK)), F.lit(0.0)).alias("v")))
