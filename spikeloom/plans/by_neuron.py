"""Fits of general models whose parameters by neuron never reach the driver.

W, B and V of a neuron are one row of a table; the modes and their curvature are the only arrays of the driver. Given the modes, a neuron's parameters are those of a
linear model of its own: one job joins bins with the table, sums value, gradient and curvature by neuron (partial sums leave a task) and takes a Newton step
in place, halved where a neuron's own value fell. Given the table, each mode is a linear model of all bins: one job sums its gradient and
curvature, and the driver solves a system of as many unknowns as the mode has. The table is written after each step, so lineage stays short.

Bins of a neuron that has very many are dealt to salts, and its row is copied to them, so no neuron's bins need to meet in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.functions.likelihood import curvature, numeric
from spikeloom.plans.gmlm import Block, Params, Prepared, Spec, khatri_rao_jacobian, to_block
from spikeloom.sources.trials import shared_folder

#: Bins of a neuron for each salt.
SHARE = 1 << 20
#: Bins whose regressors are held at once.
HELD = 4096


def layout(spec: Spec) -> list[str]:
    """A neuron's parameters in the order of its row."""
    return ["W", *(f"B{i}" for i in range(spec.linear)), *(f"{g.name}.V{r}" for g in spec.groups for r in range(g.rank))]


def features(spec: Spec, modes: Params, block: Block) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """[n, k] regressors of the neurons' own models, and the factors' parts by group."""
    one = Prepared(spec, modes)
    own, parts = [np.ones((len(block.y), 1)), block.x_lin], []
    for j, g in enumerate(spec.groups):
        parts.append(one.parts(block, j) if g.rank else [])
        if g.rank:
            own.append(np.broadcast_to(math.prod(parts[j][1:], start=parts[j][0]), (len(block.y), g.events, g.rank)).sum(axis=1))
    return np.concatenate(own, axis=1), parts


def mode_features(spec: Spec, modes: Params, block: Block, parts: list, theta: np.ndarray, j: int, s: int) -> np.ndarray:
    """[n, T * R] regressors of mode ``s`` of group ``j``, column by column of the mode."""
    g, at = spec.groups[j], 1 + spec.linear + sum(h.rank for h in spec.groups[:j])
    load = theta[:, None, at : at + g.rank]
    d = g.factor_of[s]
    mine = [k for k in range(len(g.modes)) if g.factor_of[k] == d]
    slope = khatri_rao_jacobian([modes[f"{g.name}.T{k}"] for k in mine], mine.index(s))  # [F, T, R]
    others = np.broadcast_to(math.prod((x for k, x in enumerate(parts[j]) if k != d), start=load), (len(load), g.events, g.rank))
    f, v = g.factors[d], block.factors[g.factors[d].column]
    if f.table is None:
        by = np.einsum("naf,ftr->natr", np.broadcast_to(v, (len(v), g.events, v.shape[2])), slope)
    else:
        rows = slope if isinstance(f.table, int) else np.einsum("kf,ftr->ktr", f.table, slope)
        inside = (v >= 0) & (v < len(rows))
        by = np.where(inside[:, :, None, None], rows[np.where(inside, v, 0)], 0.0)
    z = np.einsum("nar,natr->nrt", others, by)
    return z.reshape(len(z), -1)


def blocks(batches, spec: Spec):
    """(block, theta) of at most HELD bins."""
    for whole in batches:
        for i in range(0, whole.num_rows, HELD):
            b = whole.slice(i, HELD)
            theta = b.column(b.schema.names.index("theta")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield to_block(b, spec), theta


class Fit:
    """A fit over rows (as in ``plans.gmlm``); ``precision`` by block (W, B, g.V, g.T0 ...) adds independent normal priors of mean zero."""

    def __init__(self, rows: DataFrame, spec: Spec, modes: Params, table: DataFrame | None = None, precision: dict[str, float] | None = None):
        """modes: the blocks T of the start. table: (neuron_ix, theta); by default log rates start at 0 and loads at small numbers of each neuron's own."""
        self.spec, self.modes, self.spark = spec, {k: v.copy() for k, v in modes.items() if ".T" in k}, rows.sparkSession
        self.precision, self.k, self.folder, self.step = precision or {}, len(layout(spec)), shared_folder(rows.sparkSession, "neurons"), 0
        needed = ["y", "neuron_ix", "w", *(["x_lin"] if spec.linear else []), *sorted({f.column for g in spec.groups for f in g.factors})]
        counted = rows.where("w <> 0").groupBy("neuron_ix").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("salts"))
        self.salts = self.kept(counted)
        own = rows.where("w <> 0").select(*needed).join(self.salts.hint("shuffle_hash"), "neuron_ix")
        salted = self.kept(own.withColumn("salt", F.floor(F.rand(7) * F.col("salts")).cast("int")).drop("salts"))  # written, so that no row's salt changes
        self.rows = salted.repartition("neuron_ix", "salt").persist()
        if table is None:
            small = [(F.pmod(F.xxhash64("neuron_ix", F.lit(i)), F.lit(1000)) / 5000.0 - 0.1) if ".V" in name else F.lit(0.0) for i, name in enumerate(layout(spec))]
            table = self.salts.select("neuron_ix", F.array(*(c.cast("double") for c in small)).alias("theta"))
        self.table = self.kept(table.select("neuron_ix", "theta", F.lit(None).cast("array<double>").alias("move"), F.lit(-math.inf).alias("last")))

    def close(self) -> None:
        self.rows.unpersist()

    def kept(self, df: DataFrame) -> DataFrame:
        self.step += 1
        path = f"{self.folder}/{self.step}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def joined(self) -> DataFrame:
        own = self.table.join(self.salts.hint("shuffle_hash"), "neuron_ix").select("neuron_ix", "theta", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        return self.rows.join(own.hint("shuffle_hash"), ["neuron_ix", "salt"]).drop("salt")  # files of bins are small for their rows, so Spark would broadcast them

    def ridge(self) -> np.ndarray:
        return np.array([self.precision.get(n if n == "W" else "B" if n.startswith("B") else n.rstrip("0123456789"), 0.0) for n in layout(self.spec)])

    def neurons(self, fresh: bool) -> None:
        """A Newton step of every neuron; ``fresh`` after a step of the modes, when values are no longer comparable."""
        spec, modes, k, ridge = self.spec, self.modes, self.k, self.ridge()
        upper = np.triu_indices(k)
        sums = [f"s{i}" for i in range(1 + k + len(upper[0]))]

        def add(batches):
            for block, theta in blocks(batches, spec):
                z, _ = features(spec, modes, block)
                x = (z * theta).sum(axis=1)
                ll, dll = numeric(spec.kind, x, block.y, spec.dt)
                d2 = curvature(spec.kind, x, block.y, spec.dt) * block.w
                ids, at = np.unique(block.neuron, return_inverse=True)
                per = [ll * block.w, *(z * (dll * block.w)[:, None]).T, *((z[:, i] * z[:, j] * d2) for i, j in zip(*upper, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.bincount(at, weights=p, minlength=len(ids))) for p in per)], names=["neuron_ix", *sums])

        def solve(batches):
            for b in batches:
                n = b.num_rows
                found = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4, 4 + len(sums))], axis=1)
                theta = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, k)
                moves, last = b.column(2).to_pylist(), b.column(3).to_numpy(zero_copy_only=False)
                out, kept, value = np.empty((n, k)), [], np.empty(n)
                for i in range(n):
                    post = found[i, 0] - 0.5 * ridge @ theta[i] ** 2
                    if not fresh and post < last[i] - 1e-9 * (1 + abs(last[i])) and moves[i] is not None and np.abs(moves[i]).max() > 1e-12:  # too far: back half of the way
                        move = np.array(moves[i]) / 2
                        out[i], value[i] = theta[i] - move, last[i]
                        kept.append(move.tolist())
                        continue
                    h = np.zeros((k, k))
                    h[upper] = found[i, 1 + k :]
                    h = h + np.triu(h, 1).T - np.diag(ridge)
                    move = ascent(h, found[i, 1 : 1 + k] - ridge * theta[i])
                    out[i], value[i] = theta[i] + move, post
                    kept.append(move.tolist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out)), pa.array(kept, pa.list_(pa.float64())), pa.array(value)], names=["neuron_ix", "theta", "move", "last"])

        kind = self.table.schema["neuron_ix"].dataType.simpleString()
        partial = self.joined().mapInArrow(add, f"neuron_ix bigint, {', '.join(f'{c} double' for c in sums)}")
        summed = partial.groupBy(F.col("neuron_ix").cast(kind).alias("neuron_ix")).agg(*(F.sum(c).alias(c) for c in sums))
        self.table = self.kept(self.table.select("neuron_ix", "theta", "move", "last").hint("shuffle_hash").join(summed, "neuron_ix").mapInArrow(solve, f"neuron_ix {kind}, theta array<double>, move array<double>, last double"))

    def sums(self, name: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of all bins, and gradient and curvature by the mode ``name``; as many numbers as the mode's unknowns and their pairs."""
        spec, modes = self.spec, self.modes
        at = next(((j, s) for j, g in enumerate(spec.groups) for s in range(len(g.modes)) if f"{g.name}.T{s}" == name), None)
        n = modes[name].size if name else 0

        def add(batches):
            ll, g, h = 0.0, np.zeros(n), np.zeros((n, n))
            for block, theta in blocks(batches, spec):
                z, parts = features(spec, modes, block)
                x = (z * theta).sum(axis=1)
                value, slope = numeric(spec.kind, x, block.y, spec.dt)
                ll += float((value * block.w).sum())
                if n:
                    m = mode_features(spec, modes, block, parts, theta, *at)
                    g += m.T @ (slope * block.w)
                    h += (m * (curvature(spec.kind, x, block.y, spec.dt) * block.w)[:, None]).T @ m
            flat = np.r_[ll, g, h.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

        found = self.joined().mapInArrow(add, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy()
        found = found if len(found) else np.zeros(1 + n + n * n)
        return float(found[0]), found[1 : 1 + n], found[1 + n :].reshape(n, n)

    def mode(self, name: str, tries: int = 8) -> float:
        """A Newton step of one mode, halved until the value doesn't fall; returns the value before it."""
        ridge = self.precision.get(name, 0.0)
        before, g, h = self.sums(name)
        old = self.modes[name]
        flat = old.ravel(order="F")
        move = ascent(h - ridge * np.eye(len(flat)), g - ridge * flat)
        post = before - 0.5 * ridge * flat @ flat
        for t in 0.5 ** np.arange(tries):
            new = flat + t * move
            self.modes[name] = new.reshape(old.shape, order="F")
            if self.sums(None)[0] - 0.5 * ridge * new @ new >= post:
                return before
        self.modes[name] = old
        return before

    def prior(self) -> float:
        """Log prior up to a constant; the neurons' part is one sum of squares for each kind of parameter."""
        ridge, at = self.ridge(), [F.get("theta", F.lit(i)) for i in range(self.k)]
        squares = np.array([v or 0.0 for v in self.table.agg(*(F.sum(a * a) for a in at)).first()])
        return float(-0.5 * ridge @ squares - 0.5 * sum(self.precision.get(n, 0.0) * (v * v).sum() for n, v in self.modes.items()))

    def run(self, sweeps: int = 50, tolerance: float = 1e-8) -> dict:
        """Sweeps over neurons and modes until the value gains less than ``tolerance`` of itself: value, steps, converged. Modes and table are in the fit."""
        value, converged, sweep = -math.inf, False, 0
        for sweep in range(1, sweeps + 1):
            self.neurons(True)
            self.neurons(False)
            for g in self.spec.groups:
                for s in range(len(g.modes) if g.rank else 0):
                    self.mode(f"{g.name}.T{s}")
            last, value = value, self.sums(None)[0] + (self.prior() if self.precision else 0.0)
            if value - last <= tolerance * (1 + abs(value)):
                converged = True
                break
        return {"value": value, "steps": sweep, "converged": converged}

    def normalize(self) -> None:
        """Each component's magnitude spread evenly over its loads and modes, components ordered by it; rates stay as they are. Norms of loads are sums over the table."""
        theta = [F.get("theta", F.lit(i)) for i in range(self.k)]
        at = 1 + self.spec.linear
        for g in self.spec.groups:
            own = theta[at : at + g.rank]
            if g.rank:
                gram = np.array([v or 0.0 for v in self.table.agg(*(F.sum(a * b) for a in own for b in own)).first()]).reshape(g.rank, g.rank)
                names = [f"{g.name}.T{s}" for s in range(len(g.modes))]
                turn = np.eye(g.rank)  # loads are multiplied by it
                if len(names) == 1:  # a matrix: its singular vectors are the components
                    t = self.modes[names[0]]
                    values, u = np.linalg.eigh(t @ gram @ t.T)
                    u = u[:, ::-1][:, : g.rank]
                    turn = np.zeros((g.rank, g.rank))
                    turn[:, : u.shape[1]] = t.T @ u
                    self.modes[names[0]] = np.zeros_like(t)
                    self.modes[names[0]][:, : u.shape[1]] = u
                    gram = turn.T @ gram @ turn
                norms = np.stack([np.sqrt(np.maximum(np.diag(gram), 0)), *(np.linalg.norm(self.modes[n], axis=0) for n in names)])
                size = norms.prod(axis=0)
                share = size ** (1 / len(norms))
                factor = np.where(size > 0, share / np.where(norms > 0, norms, 1.0), 0.0)
                order = np.argsort(-size, kind="stable")
                for n, f in zip(names, factor[1:], strict=True):
                    self.modes[n] = (self.modes[n] * f)[:, order]
                turn = (turn * factor[0])[:, order]
                for r in range(g.rank):
                    theta[at + r] = sum((float(turn[q, r]) * own[q] for q in range(g.rank)), F.lit(0.0))
            at += g.rank
        self.table = self.kept(self.table.select("neuron_ix", F.array(*theta).alias("theta"), F.lit(None).cast("array<double>").alias("move"), F.lit(-math.inf).alias("last")))

    def parameters(self) -> DataFrame:
        """(block, row, col, value) of all parameters; those of neurons come out of the table."""
        places = [("W", None)] + [("B", i) for i in range(self.spec.linear)] + [(f"{g.name}.V", r) for g in self.spec.groups for r in range(g.rank)]
        ix = F.col("neuron_ix").cast("int")
        rows = [F.struct(F.lit(b).alias("block"), (F.lit(i).cast("int") if b == "B" else ix).alias("row"), (ix if b == "B" else F.lit(i or 0).cast("int")).alias("col"), F.get("theta", F.lit(n)).alias("value")) for n, (b, i) in enumerate(places)]
        own = self.table.select(F.explode(F.array(*rows)).alias("p")).select("p.*")
        modes = [(k, i, r, float(v[i, r])) for k, v in self.modes.items() for i, r in np.ndindex(v.shape)]
        return own.unionByName(self.spark.createDataFrame(modes, "block string, row int, col int, value double")) if modes else own


def ascent(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Newton's move to a maximum; directions of wrong or no curvature go by the gradient, shortened, so the move always ascends."""
    values, vectors = np.linalg.eigh(-h)
    top = max(float(values.max(initial=0.0)), 1e-12)
    return vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-8 * top))
