"""Hamiltonian Monte Carlo for the models of ``plans.gmlm``, with adaptation schedules, Gibbs steps, sinks and resumption.

Chains go in lockstep: each leapfrog step of all chains is one job. A run is cut into blocks of draws. After a block its draws (scaled and natural) and the
trials' log likelihoods under them are written as Parquet, and each chain's state with its random generator as one JSON row, the two last
ones in turn; a run that is called again goes on from the last block whose state is whole. Streams are keyed by seed and chain, so results don't depend on
partitions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Generator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spikeloom.plans import compare, gmlm
from spikeloom.plans.gmlm import Params, devectorize, lockstep, vectorize

#: By the least number of warm-up draws the ranges in which the step size adapts, (from, at) of the mass estimate, and the ranges in which steps
#: are scaled at random besides those behind the warm-up.
SCHEDULES = [
    (60_000, [(11, 10_000), (10_001, 25_000), (55_001, 60_000)], [(25_001, 55_000)], [(25_001, 55_000)]),
    (50_000, [(11, 10_000), (10_001, 25_000), (45_001, 50_000)], [(25_001, 45_000)], [(25_001, 45_000)]),
    (40_000, [(11, 10_000), (10_001, 15_000), (35_001, 40_000)], [(15_001, 35_000)], [(15_001, 35_000)]),
    (35_000, [(11, 10_000), (10_001, 20_000), (32_001, 35_000)], [(20_001, 32_000)], [(20_001, 32_000)]),
    (30_000, [(11, 15_000), (15_001, 25_000)], [], [(25_001, 30_000)]),
    (25_000, [(11, 4_000), (4_001, 7_000), (22_001, 25_000)], [(10_001, 22_000)], [(7_001, 22_000)]),
    (20_000, [(2, 7_500), (7_501, 15_000)], [], [(15_001, 20_000)]),
    (15_000, [(11, 7_500), (7_501, 14_000)], [], [(14_001, 15_000)]),
    (10_000, [(11, 7_000)], [], [(7_001, 10_000)]),
]


@dataclass
class Settings:
    warmup: int = 25_000
    samples: int = 50_000
    schedule: list = field(default_factory=list)
    mass: list = field(default_factory=list)
    first_step: float = 1e-4
    least_step: float = 1e-3
    most_step: float = 0.25
    targets: tuple = (0.8, 0.9)
    gamma: float = 0.05
    kappa: float = 0.75
    delay: int = 10
    length: float = 1.0
    most_steps: int = 100
    scales: tuple = (1.0, 0.5, 0.1)
    scale_shares: tuple = (0.9, 0.06, 0.04)
    scale_ranges: list = field(default_factory=list)  # (first, last draw); steps behind the warm-up are always scaled
    most_errors: int = 100
    block: int = 1_000
    jumps: tuple = ()  # draws at whose start a chain goes to the posterior's mode, given its hyperparameters
    jump_steps: int = 1_000
    held_bytes: int = 32 << 20  # of draws on the driver; a block ends earlier where they would be more


def settings(warmup: int | None = None, samples: int | None = None, debug: bool = False, **changes) -> Settings:
    """Defaults by the length of the warm-up; a debug run is short."""
    warmup = (1_500 if debug else 25_000) if warmup is None else warmup
    samples = (500 if debug else 50_000) if samples is None else samples
    if debug:
        own = Settings(warmup, samples, [(2, 500), (501, 1_400)], [(101, 500), (501, 1_000)], length=0.5, block=200, jumps=(100, 1_000))
    else:
        short = (0, [(11, warmup - 2_000)], [], [(warmup - 1_999, warmup)]) if warmup >= 4_000 else (0, [(2, warmup)], [], [])
        _, schedule, mass, scaled = next((s for s in SCHEDULES if warmup >= s[0]), short)
        own = Settings(warmup, samples, schedule, mass, scale_ranges=scaled)
    return Settings(**(asdict(own) | changes))


@dataclass
class State:
    """A chain between two draws."""

    x: list
    generator: dict
    draw: int = 0
    step: float = 1e-4
    log_bar: float = math.log(1e-3)
    misses: float = 0.0
    mass: list = field(default_factory=list)
    errors: int = 0
    count: int = 0  # of draws since the mass estimate began
    mean: list = field(default_factory=list)
    square: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)  # blocks that only Gibbs steps draw (a noise precision by neuron)

    def rng(self) -> np.random.Generator:
        bits = np.random.Philox()
        s = self.generator
        bits.state = {**s, "state": {k: np.array(v, np.uint64) for k, v in s["state"].items()}, "buffer": np.array(s["buffer"], np.uint64)}
        return np.random.Generator(bits)

    def keep(self, rng: np.random.Generator) -> None:
        s = rng.bit_generator.state
        self.generator = {**s, "state": {k: [int(i) for i in v] for k, v in s["state"].items()}, "buffer": [int(i) for i in s["buffer"]]}


def start_state(x: np.ndarray, seed: int, chain: int, own: Settings) -> State:
    out = State(list(map(float, x)), {}, step=own.first_step, log_bar=math.log(own.least_step), mass=[1.0] * len(x))
    out.keep(np.random.Generator(np.random.Philox(key=[seed, chain])))
    return out


def adapt(s: State, log_rate: float, own: Settings) -> None:
    """Dual averaging of the step size inside the ranges of the schedule, frozen between and after them."""
    at = next((i for i, (a, b) in enumerate(own.schedule) if a <= s.draw <= b), None)
    if at is None:
        if s.draw >= max((b for _, b in own.schedule), default=0):
            s.step = math.exp(s.log_bar)
        return
    t = s.draw - own.schedule[at][0] + 1
    if t == 1:
        s.misses = 0.0
    rate = min(1.0, math.exp(min(0.0, log_rate))) if math.isfinite(log_rate) else 0.0
    s.misses += (own.targets[min(at, len(own.targets) - 1)] - rate - s.misses) / (t + own.delay)
    log_step = min(math.log(own.most_step), math.log(10 * own.least_step) - math.sqrt(t) / own.gamma * s.misses)
    weight = t**-own.kappa
    s.log_bar = weight * log_step + (1 - weight) * s.log_bar
    s.step = math.exp(s.log_bar if s.draw == own.schedule[at][1] else log_step)


def mass_update(s: State, own: Settings) -> None:
    """Inverse variances of the draws since ``first``, taken over at ``at``; sums run along, so no draw is held."""
    for first, at in own.mass:
        if first <= s.draw <= at:
            x = np.array(s.x)
            if s.draw == first or not s.mean:
                s.count, s.mean, s.square = 0, [0.0] * len(x), [0.0] * len(x)
            mean, square = np.array(s.mean), np.array(s.square)
            s.count += 1
            gap = x - mean
            mean = mean + gap / s.count
            square = square + gap * (x - mean)
            s.mean, s.square = mean.tolist(), square.tolist()
            if s.draw == at and s.count > 1:
                s.mass = (1 / np.maximum(square / (s.count - 1), 1e-12)).tolist()


#: A Gibbs step takes natural random numbers and parameters to parameters; it may run jobs of its own, and may draw blocks that the model's vector doesn't have.
Gibbs = Callable[[np.random.Generator, Params], Params]


def scaled_at(draw: int, own: Settings) -> bool:
    """Whether the step size of a draw is scaled at random: behind all adaptation, and in the ranges of the settings."""
    behind = max([own.warmup, *(b for _, b in own.schedule)])
    return draw > behind or any(a <= draw <= b for a, b in own.scale_ranges)


def chain(s: State, draws: int, own: Settings, spec: gmlm.Spec, base: Params, blocks: set[str], gibbs: list[Gibbs]) -> Generator:
    """``draws`` draws of one chain; asks for (log posterior, gradient) of points. Returns the state and rows (draw, x, accepted, log posterior, step, lost, extra).

    What Gibbs steps draw beyond the vector goes into ``base``, which whoever answers reads, into the state and into the rows.
    """
    rng, out = s.rng(), []
    base.update({k: np.array(v) for k, v in s.extra.items()})
    x = np.array(s.x)
    lp, g = yield x
    for _ in range(draws):
        s.draw += 1
        if s.draw in own.jumps:
            free = np.concatenate([np.zeros(0, bool), *(np.full(math.prod(n), k != "H") for k, n in spec.shapes().items() if k in blocks)])
            climb = gmlm.lbfgs(x[free], steps=own.jump_steps)
            ask, point = next(climb), x.copy()
            while True:
                point = point.copy()
                point[free] = ask
                value, slope = yield point
                try:
                    ask = climb.send((value, slope[free]))
                except StopIteration as e:
                    x = point.copy()
                    x[free] = e.value["x"]
                    break
            lp, g = yield x
        if gibbs:
            params = devectorize(spec, x, base, blocks)
            for step in gibbs:
                params = step(rng, params)
            moved, drawn = vectorize(spec, params, blocks), {k: v for k, v in params.items() if k not in spec.shapes()}
            if drawn or not np.array_equal(moved, x):
                x = moved
                base.update(drawn)
                s.extra = {k: v.tolist() for k, v in drawn.items()}
                lp, g = yield x
        mass = np.array(s.mass)
        size = s.step * (rng.choice(own.scales, p=own.scale_shares) if scaled_at(s.draw, own) else 1.0)
        p = rng.standard_normal(len(x)) * np.sqrt(mass)
        start = lp - 0.5 * (p * p / mass).sum()
        y, ly, gy, lost = x.copy(), lp, g, False
        for _ in range(max(1, min(own.most_steps, math.ceil(own.length / max(size, 1e-12))))):
            p = p + 0.5 * size * gy
            y = y + size * p / mass
            ly, gy = yield y
            p = p + 0.5 * size * gy
            if not (math.isfinite(ly) and np.isfinite(gy).all()):
                lost = True
                break
        change = ly - 0.5 * float((p * p / mass).sum()) - start if not lost else math.nan
        lost = lost or not math.isfinite(change) or abs(change) > 1e3
        accepted = not lost and math.log(max(rng.random(), 1e-300)) < change
        if accepted:
            x, lp, g = y, ly, gy
        s.errors = s.errors + 1 if lost else 0
        s.x = x.tolist()
        adapt(s, math.nan if lost else change, own)
        mass_update(s, own)
        out.append((s.draw, x, bool(accepted), float(lp), float(s.step), bool(lost), {k: np.array(v) for k, v in s.extra.items()}))
        if s.errors >= own.most_errors:
            break
    s.keep(rng)
    return s, out


def scaling_step(spec: gmlm.Spec, group: int, priors: list, width: float = 0.2, times: int = 5) -> Gibbs:
    """Metropolis-Hastings walk along the directions that leave rates alone: each component's V and modes are rescaled so that their product stays.

    Only the prior changes, so no job is run. Priors must have mean zero. The proposal is a normal walk on the modes' log norms; a
    block of n rows has the volume factor of its n - 1 directions and its norm.
    """
    g = spec.groups[group]
    names = [*(f"{g.name}.T{s}" for s in range(len(g.modes))), f"{g.name}.V"]

    def step(rng: np.random.Generator, params: Params) -> Params:
        lp = gmlm.prior_sum(priors, params)[0]
        for _ in range(times):
            for r in range(g.rank):
                logs = rng.standard_normal(len(names) - 1) * width
                logs = np.append(logs, -logs.sum())
                new = dict(params)
                for n, v in zip(names, logs, strict=True):
                    new[n] = params[n].copy()
                    new[n][:, r] *= math.exp(v)
                lp2 = gmlm.prior_sum(priors, new)[0]
                volume = sum(len(params[n]) * v for n, v in zip(names, logs, strict=True))
                if math.log(max(rng.random(), 1e-300)) < lp2 - lp + volume:
                    params, lp = new, lp2
        return params

    return step


def noise_step(model: gmlm.Model, shape: float = 2.0, rate: float = 1.0) -> Gibbs:
    """Conjugate gamma draw of each neuron's noise precision in squared-error models; one job sums squared errors by neuron. Parameters get the block noise,
    which weights the neuron's errors in all evaluations from then on."""
    def step(rng: np.random.Generator, params: Params) -> Params:
        n, s = gmlm.squared_errors(model.chunks, model.spec, model.forward(params))
        return params | {"noise": rng.gamma(shape + n / 2, 1 / (rate + s / 2))}

    return step


def noise_prior(shape: float = 2.0, rate: float = 1.0) -> gmlm.Prior:
    """Log gamma density of the noise precisions, for the log posterior of a run with ``noise_step``; nothing before the first draw."""
    def prior(params: Params) -> tuple[float, Params]:
        x = params.get("noise", np.zeros(0))
        return float((shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * np.log(x) - rate * x).sum()), {}

    return prior


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def draw_rows(spark: SparkSession, drawn: list[tuple[int, int, Params, Params]]) -> DataFrame:
    """(chain, iter, block, row, col, value, natural) of draws (chain, iter, parameters, natural parameters).

    Blocks leave the driver as arrays, column by column, and Spark makes the rows.
    """
    import pyarrow as pa

    found = [(c, it, k, v, natural.get(k, v)) for c, it, params, natural in drawn for k, v in params.items() if v.size]
    flat = [np.concatenate([np.zeros(0), *(f[at].ravel(order="F") for f in found)]) for at in (3, 4)]
    ends = pa.array(np.r_[0, np.cumsum([f[3].size for f in found], dtype=np.int64)].astype(np.int32))
    table = pa.table({"chain": pa.array([f[0] for f in found], pa.int32()), "iter": pa.array([f[1] for f in found], pa.int64()), "block": pa.array([f[2] for f in found], pa.string()), "rows": pa.array([len(f[3]) for f in found], pa.int32()),
                      "value": pa.ListArray.from_arrays(ends, pa.array(flat[0])), "natural": pa.ListArray.from_arrays(ends, pa.array(flat[1]))})
    spread = spark.createDataFrame(table).select("chain", "iter", "block", "rows", F.posexplode(F.arrays_zip("value", "natural")).alias("at", "v"))
    return spread.select("chain", "iter", "block", (F.col("at") % F.col("rows")).alias("row"), F.floor(F.col("at") / F.col("rows")).cast("int").alias("col"), "v.value", "v.natural")


def sample(model: gmlm.Model, starts: list[Params], own: Settings, path: str, keys: list[str], gibbs: list[Gibbs] = (), seed: int = 1, blocks: set[str] | None = None) -> dict[str, DataFrame]:
    """Runs a chain for each start up to ``warmup + samples`` draws, or goes on with the run at ``path`` (a folder that the cluster shares).

    Returns draws (chain, iter, block, row, col, value, natural), trial_ll (chain, iter, ``keys``, ll), states of iterations (chain, iter, accepted,
    log_post, step, lost). Blocks that only Gibbs steps draw are among the draws. A chain that diverges ``most_errors`` times in a row stops its run, which may be called again.
    """
    spark, spec = model.rows.sparkSession, model.spec
    blocks = blocks or {k for k, s in spec.shapes().items() if math.prod(s)}
    base = [dict(p) for p in starts]
    states, done = _resume(spark, path), 0
    if states is None:
        states = [start_state(vectorize(spec, p, blocks), seed, c, own) for c, p in enumerate(base)]
    else:
        done = states[0].draw
    trial_keys = [(k, model.rows.schema[k].dataType.simpleString()) for k in keys]
    turn = 0 if not done else 1 - _newest(spark, path)
    while done < own.warmup + own.samples:
        most = max(1, own.held_bytes // (16 * max(1, len(states[0].x)) * len(states)))
        n = min(own.block, most, own.warmup + own.samples - done)
        answer = model.answer(base, blocks, None, True)
        found = lockstep([chain(s, n, own, spec, b, blocks, list(gibbs)) for s, b in zip(states, base, strict=True)], answer)
        states = [f[0] for f in found]
        info, drawn = [], []
        for c, (_, rows) in enumerate(found):
            for it, x, accepted, lp, step, lost, extra in rows:
                params = devectorize(spec, x, base[c], blocks)
                natural = model.forward(params)
                drawn.append((c, it, {k: params[k] for k in spec.shapes() if k in blocks} | extra, natural | extra))
                info.append((c, it, accepted, lp, step, lost))
        part = f"part={done + 1}"
        draw_rows(spark, drawn).write.mode("overwrite").parquet(f"{path}/draws/{part}")
        _frame(spark, info, "chain int, iter bigint, accepted boolean, log_post double, step double, lost boolean").write.mode("overwrite").parquet(f"{path}/iterations/{part}")
        sets = [(c, it, natural) for c, it, _, natural in drawn if it > own.warmup]
        scored = trial_lls(model, sets, keys) if sets else _frame(spark, [], ", ".join(["chain int, iter bigint", *(f"{k} {t}" for k, t in trial_keys), "ll double"]))
        scored.write.mode("overwrite").parquet(f"{path}/trial_ll/{part}")
        done = states[0].draw
        _frame(spark, [(json.dumps([asdict(s) for s in states]),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state-{turn}")
        turn = 1 - turn
        if any(s.errors >= own.most_errors for s in states):
            break
    return stored(spark, path)


def stored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sinks of a run."""
    return {k: spark.read.parquet(f"{path}/{k}").drop("part") for k in ("draws", "iterations", "trial_ll")}


def trial_table(run: dict[str, DataFrame], keys: list[str], warmup: int) -> DataFrame:
    """``keys``, waic, loo, pareto_k of each trial under all chains' draws after the warm-up. A trial's draws (as many as the run keeps) are one row; variances are those of the draws, not of a sample."""
    kept = run["trial_ll"].where(F.col("iter") > warmup)
    spread = kept.groupBy(*keys).agg((F.var_samp("ll") - F.var_pop("ll")).alias("less"))
    return compare.waic(kept, "ll", keys).join(spread, keys).select(*keys, (F.col("waic") - F.col("less")).alias("waic")).join(compare.psis_loo(kept, "ll", keys), keys)


def summary(run: dict[str, DataFrame], keys: list[str], warmup: int, bad: float = 0.7) -> DataFrame:
    """One row of a stored run: waic (mean over trials), loo (sum), bad (trials whose tail shape is ``bad`` or worse), trials; and of the iterations after the warm-up
    accept_rate, early_rejects, early_reject_share, draws, chains."""
    trials = trial_table(run, keys, warmup).agg(F.avg("waic").alias("waic"), F.sum("loo").alias("loo"), F.count_if(F.col("pareto_k") >= bad).alias("bad"), F.count(F.lit(1)).alias("trials"))
    lost = F.col("lost").cast("int")
    steps = run["iterations"].where(F.col("iter") > warmup).agg(F.avg(F.col("accepted").cast("int")).alias("accept_rate"), F.sum(lost).alias("early_rejects"), F.avg(lost).alias("early_reject_share"), F.count(F.lit(1)).alias("draws"), F.count_distinct("chain").alias("chains"))
    return trials.crossJoin(steps)  # one row each


def trailing_acceptance(run: dict[str, DataFrame], width: int = 100) -> DataFrame:
    """(chain, iter, rate): share of accepted draws among the last ``width`` ones of a chain, whose draws are one window."""
    last = W.partitionBy("chain").orderBy("iter").rowsBetween(1 - width, 0)
    return run["iterations"].select("chain", "iter", F.avg(F.col("accepted").cast("double")).over(last).alias("rate"))


def magnitudes(run: dict[str, DataFrame], group: str, warmup: int = 0) -> DataFrame:
    """(chain, iter, component, magnitude): the product of the norms of a component's natural loads and modes, of every draw."""
    own = run["draws"].where((F.col("iter") > warmup) & F.col("block").startswith(f"{group}."))
    norms = own.groupBy("chain", "iter", "block", F.col("col").alias("component")).agg(F.sqrt(F.sum(F.col("natural") * F.col("natural"))).alias("norm"))
    return norms.groupBy("chain", "iter", "component").agg(F.product("norm").alias("magnitude"))


def _states(spark: SparkSession, path: str, turn: int) -> list[State] | None:
    try:
        found = json.loads(spark.read.parquet(f"{path}/state-{turn}").first()["state"])
    except Exception as e:  # not there, or its writing was cut off
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    return [State(**s) for s in found]


def _newest(spark: SparkSession, path: str) -> int:
    draws = [s[0].draw if (s := _states(spark, path, k)) else -1 for k in (0, 1)]
    return draws.index(max(draws))


def _resume(spark: SparkSession, path: str) -> list[State] | None:
    """The states that have gone farthest among those that are whole."""
    return _states(spark, path, _newest(spark, path))


def trial_lls(model: gmlm.Model, sets: list[tuple[int, int, Params]], keys: list[str]) -> DataFrame:
    """(chain, iter, ``keys``, ll) for all parameter sets in one job: every bin's rates under each set, summed by trial. With noise precisions they are log densities of normal errors."""
    labels = model.rows.sparkSession.createDataFrame([(i, c, it) for i, (c, it, _) in enumerate(sets)], "set int, chain int, iter bigint")
    return model.unit_ll([p for _, _, p in sets], keys).join(F.broadcast(labels), "set").select("chain", "iter", *keys, "ll")


# ---- random variables

def generalized_inverse_gaussian(rng: np.random.Generator, p: float, a: float, b: float) -> float:
    """A draw with density proportional to x^(p - 1) exp(-(a x + b / x) / 2), by Devroye's rejection from a log-concave density's three-piece hat."""
    if a > 0 and b == 0 and p > 0:  # the limits are gamma and inverse gamma
        return float(rng.gamma(p, 2 / a))
    if b > 0 and a == 0 and p < 0:
        return float(1 / rng.gamma(-p, 2 / b))
    if a <= 0 or b <= 0:
        raise ValueError("a and b must be positive, or one of them 0 with p on the other's side")
    lam, omega = abs(p), math.sqrt(a * b)
    alpha = math.sqrt(omega * omega + lam * lam) - lam

    def psi(x):
        return -alpha * (math.cosh(x) - 1) - lam * (math.expm1(x) - x)

    def slope(x):
        return -alpha * math.sinh(x) - lam * math.expm1(x)

    def cut(drop, small, large):
        return 1.0 if 0.5 <= drop <= 2 else math.sqrt(small) if drop > 2 else large

    t = cut(-psi(1.0), 2 / (alpha + lam), math.log(4 / (alpha + 2 * lam)))
    down = -psi(-1.0)
    s = 1.0 if 0.5 <= down <= 2 else math.sqrt(4 / (alpha * math.cosh(1) + lam)) if down > 2 else min(1 / lam if lam else math.inf, math.log1p(1 / alpha + math.sqrt(1 / alpha**2 + 2 / alpha)))
    eta, zeta, theta, xi = -psi(t), -slope(t), -psi(-s), slope(-s)
    left, right = 1 / xi, 1 / zeta
    t2, s2 = t - right * eta, s - left * theta
    middle = t2 + s2
    while True:
        u, v, w = rng.random(3)
        if u < middle / (middle + left + right):
            x, hat = -s2 + middle * v, 0.0
        elif u < (middle + right) / (middle + left + right):
            x = t2 - right * math.log(1 - v)
            hat = -eta - zeta * (x - t)
        else:
            x = -s2 + left * math.log(1 - v)
            hat = -theta + xi * (x + s)
        if math.log(max(w, 1e-300)) + hat <= psi(x):
            break
    x = (lam / omega + math.sqrt(1 + (lam / omega) ** 2)) * math.exp(x)
    return (1 / x if p < 0 else x) * math.sqrt(b / a)


def dirichlet(rng: np.random.Generator, weights: np.ndarray) -> np.ndarray:
    g = rng.gamma(weights)
    return g / g.sum()


def unit_draws(rows: DataFrame, keys: list[str], columns: list[str], draws: int, make: Callable, names: list[str], seed: int = 1) -> DataFrame:
    """(``keys``, draw, ``names``): make(rng, *columns) ``draws`` times for each row; streams are keyed by seed and the row's keys."""
    import zlib

    import pyarrow as pa
    from pyspark.sql import types as T

    own = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
    schema = T.StructType([*(own.schema[k] for k in keys), T.StructField("draw", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches):
        for b in batches:
            rows_, found = [], []
            values = zip(*(c.to_pylist() for c in b.columns[len(keys) :]), strict=True)
            for i, (key, v) in enumerate(zip(zip(*(c.to_pylist() for c in b.columns[: len(keys)]), strict=True), values, strict=True)):
                rng = np.random.Generator(np.random.Philox(key=[seed, zlib.crc32(repr(key).encode())]))
                for d in range(draws):
                    rows_.append((i, d))
                    found.append(np.atleast_1d(make(rng, *v)))
            at = pa.array([r[0] for r in rows_], pa.int64())
            columns_ = np.array(found, float).reshape(len(rows_), len(names))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[: len(keys)]), pa.array([r[1] for r in rows_], pa.int32()), *(pa.array(columns_[:, j]) for j in range(len(names)))], names=schema.names)

    return own.mapInArrow(run, schema)
