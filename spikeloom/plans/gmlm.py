"""Generalized multilinear models with any groups, modes and ranks, evaluated by Spark jobs.

The log rate of a bin is W[p] + x_lin . B[:, p] + sum over groups, ranks and events of V[p, r] times the product of the group's factors. A factor is
shared (an index into rows of a table, out of range: 0) or local (a vector of the bin for each event); its coefficients are the Khatri-Rao product of
the modes that belong to it, the first mode running fastest.

A model's rows are read once, into chunks of bins without their repetitions (``packed``): jobs take a chunk's arrays as they are, and bins of a neuron that
differ in nothing are one bin with their weights' sum.

One job evaluates any number of parameter sets: chains, folds and restarts go in lockstep, each asking for the next point
(``lockstep``). Parameters are broadcast (they are the model, whose size the data don't set, but for a row of V, W and B for each neuron); a
task sums log likelihoods and derivatives of its bins block by block, and only the parameters' sums are shuffled and reach the driver.
Tables are multiplied by their coefficients before any bin is touched, and derivatives are summed by index before they are multiplied back.

Rows: neuron_ix (0-based), y, w (weight; rows with weight 0 are left out before anything is computed), x_lin (array<double>), a column for each factor,
and for trial sums the trial's keys. Negative counts are censored.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Callable, Generator, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.functions.likelihood import curvature, numeric
from spikeloom.sources.trials import shared_folder

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class Factor:
    """column: array<int> of indices by event (shared), or array<array<double>> [event][F] (local; of length one: the same for all events).

    table: rows [n, F] of a shared factor, a number n for the identity of n rows, None for a local factor.
    """

    column: str
    table: np.ndarray | int | None = None


@dataclass(frozen=True)
class Group:
    name: str
    modes: tuple[int, ...]
    factor_of: tuple[int, ...]
    factors: tuple[Factor, ...]
    rank: int
    events: int = 1


@dataclass(frozen=True)
class Spec:
    neurons: int
    linear: int
    groups: tuple[Group, ...] = ()
    kind: str = "poiss_exp"
    dt: float = 1.0
    hyper: int = 0

    def __post_init__(self):
        for g in self.groups:
            if len(g.modes) != len(g.factor_of) or set(g.factor_of) != set(range(len(g.factors))):
                raise ValueError(f"group {g.name}: each mode needs a factor and each factor a mode")
            for d, f in enumerate(g.factors):
                size = math.prod(t for t, k in zip(g.modes, g.factor_of, strict=True) if k == d)
                if f.table is not None and size != (f.table if isinstance(f.table, int) else f.table.shape[1]):
                    raise ValueError(f"group {g.name}: factor {d} has {size} coefficients, not as many as its table has columns")

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Blocks of parameters in the order of vectors: W, B, then V and the modes of each group, then hyperparameters."""
        out: dict[str, tuple[int, ...]] = {"W": (self.neurons,), "B": (self.linear, self.neurons)}
        for g in self.groups:
            out[f"{g.name}.V"] = (self.neurons, g.rank)
            out |= {f"{g.name}.T{s}": (t, g.rank) for s, t in enumerate(g.modes)}
        return out | {"H": (self.hyper,)}


# ---- parameters

def empty_params(spec: Spec) -> Params:
    return {k: np.zeros(s) for k, s in spec.shapes().items()}


def random_params(spec: Spec, seed: int = 0, scale: float = 0.1, mean: float = 0.0) -> Params:
    """Orthonormal modes where they have rows enough, Gaussian loads and weights."""
    rng, out = np.random.Generator(np.random.Philox(seed)), {}
    for k, shape in spec.shapes().items():
        x = rng.standard_normal(shape)
        if ".T" in k and shape[1]:
            x = np.linalg.qr(x)[0] if shape[0] >= shape[1] else x / np.maximum(np.linalg.norm(x, axis=0), 1e-12)
        out[k] = x if ".T" in k else x * scale + (mean if k == "W" else 0.0)
    return out


def verify(spec: Spec, params: Params) -> Params:
    for k, shape in spec.shapes().items():
        if k not in params or params[k].shape != shape or not np.isfinite(params[k]).all():
            raise ValueError(f"parameter block {k} needs finite numbers of shape {shape}")
    return params


def vectorize(spec: Spec, params: Params, blocks: Iterable[str] | None = None) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(params[k].ravel(order="F") for k in spec.shapes() if blocks is None or k in blocks)])


def devectorize(spec: Spec, vector: np.ndarray, params: Params | None = None, blocks: Iterable[str] | None = None) -> Params:
    """Blocks out of a vector; the others from ``params``."""
    out, at = dict(params or {}), 0
    for k, shape in spec.shapes().items():
        if blocks is None or k in blocks:
            n = math.prod(shape)
            out[k] = vector[at : at + n].reshape(shape, order="F")
            at += n
    return out


def as_table(spark, spec: Spec, params: Params) -> DataFrame:
    """(block, row, col, value) of all parameters."""
    rows = [(k, i, j, float(v)) for k in spec.shapes() for (i, j), v in np.ndenumerate(params[k] if params[k].ndim == 2 else params[k][:, None])]
    return spark.createDataFrame(rows, "block string, row int, col int, value double")


def normalize(spec: Spec, params: Params, into_v: bool = False) -> Params:
    """Each component's magnitude spread evenly over V and its modes, or put into V; components ordered by it. Rates stay as they are."""
    out = {k: v.copy() for k, v in params.items()}
    for g in spec.groups:
        names = [f"{g.name}.V", *(f"{g.name}.T{s}" for s in range(len(g.modes)))]
        if not g.rank:
            continue
        if len(g.modes) == 1:  # a matrix: its singular vectors are the components
            u, s, vt = np.linalg.svd(out[names[1]] @ out[names[0]].T, full_matrices=False)
            r = min(g.rank, len(s))
            out[names[1]][:], out[names[0]][:] = 0.0, 0.0
            out[names[1]][:, :r], out[names[0]][:, :r] = u[:, :r], vt[:r].T * s[:r]
        norms = np.stack([np.linalg.norm(out[n], axis=0) for n in names])
        size = norms.prod(axis=0)
        share = np.ones_like(norms)
        share[0] = size
        if not into_v:
            share = np.tile(size ** (1 / len(names)), (len(names), 1))
        order = np.argsort(-size, kind="stable")
        for n, norm, to in zip(names, norms, share, strict=True):
            out[n] = (out[n] * np.where(size > 0, to / np.where(norm > 0, norm, 1.0), 0.0))[:, order]
    return out


def loadings(spec: Spec, params: Params, group: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Higher-order singular vectors: for the neurons and each mode the left singular vectors and values of the tensor's unfolding,
    from Gram matrices of the components, without the tensor."""
    g = spec.groups[group]
    names = [f"{g.name}.V", *(f"{g.name}.T{s}" for s in range(len(g.modes)))]
    out = []
    for n in names:
        rest = math.prod((params[m].T @ params[m] for m in names if m != n), start=np.ones((g.rank, g.rank)))  # elementwise
        values, vectors = np.linalg.eigh(rest)
        u, s, _ = np.linalg.svd(params[n] @ (vectors * np.sqrt(np.maximum(values, 0))), full_matrices=False)
        out.append((u, s))
    return out


def loadings_table(rows: DataFrame, keys: list[str], rank: int) -> DataFrame:
    """(``keys``, block, row, component, loading, singular_value): higher-order singular vectors of a tensor's unfoldings, as ``loadings``, for every value of ``keys`` (draws, chains).

    rows: ``keys``, block (the loads and the modes of one group), row, col, value. Blocks meet as sums of products only, rank^2 numbers each, so loads of any number of
    neurons stay where they are. A vector's sign makes its sum positive.
    """
    vectors = rows.groupBy(*keys, "block", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda v: v["value"]).alias("x"))  # ``rank`` numbers
    at = [F.get("x", F.lit(r)) for r in range(rank)]
    sums = vectors.groupBy(*keys, "block").agg(F.array(*(F.sum(a * b) for a in at for b in at)).alias("gram"), F.array(*(F.sum(a) for a in at)).alias("sum"))
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "gram", "sum"))).alias("blocks"))  # as many as the group has blocks
    own = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def turns(batches):
        for b in batches:
            at, names, matrix, size = [], [], [], []
            for i, blocks in enumerate(b.column(len(keys)).to_pylist()):
                grams = [np.array(x["gram"]).reshape(rank, rank) for x in blocks]
                for k, x in enumerate(blocks):
                    values, basis = np.linalg.eigh(math.prod((g for j, g in enumerate(grams) if j != k), start=np.ones((rank, rank))))
                    root = basis * np.sqrt(np.maximum(values, 0))
                    squares, turn = np.linalg.eigh(root.T @ grams[k] @ root)
                    squares, turn = np.maximum(squares[::-1], 0), turn[:, ::-1]
                    s = np.sqrt(squares)
                    m = root @ turn * np.where(s > 1e-12 * max(s.max(), 1e-300), 1 / np.maximum(s, 1e-300), 0.0)
                    m = m * np.where(np.array(x["sum"]) @ m < 0, -1.0, 1.0)
                    at.append(i), names.append(x["block"]), matrix.append(m.ravel().tolist()), size.append(s.tolist())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[: len(keys)]), pa.array(names, pa.string()), pa.array(matrix, pa.list_(pa.float64())), pa.array(size, pa.list_(pa.float64()))], names=[*keys, "block", "m", "s"])

    turned = packed.mapInArrow(turns, f"{own + ', ' if own else ''}block string, m array<double>, s array<double>")
    found = [F.struct(F.lit(r).alias("component"), sum((F.get("x", F.lit(q)) * F.get("m", F.lit(q * rank + r)) for q in range(rank)), F.lit(0.0)).alias("loading"), F.get("s", F.lit(r)).alias("singular_value")) for r in range(rank)]
    return vectors.join(turned, [*keys, "block"]).select(*keys, "block", "row", F.explode(F.array(*found)).alias("f")).select(*keys, "block", "row", "f.*")


# ---- one block of bins

def khatri_rao(modes: list[np.ndarray]) -> np.ndarray:
    """Columnwise Kronecker product; the first mode's index runs fastest."""
    out = modes[0]
    for t in modes[1:]:
        out = (t[:, None, :] * out[None, :, :]).reshape(len(t) * len(out), out.shape[1])
    return out


def khatri_rao_jacobian(modes: list[np.ndarray], s: int) -> np.ndarray:
    """[F, T_s, R]: derivative of the product's rows by the rows of mode ``s`` (column by column)."""
    parts = [np.broadcast_to(np.eye(len(t))[:, :, None], (len(t), len(t), t.shape[1])) if k == s else t[:, None, :] for k, t in enumerate(modes)]
    out = parts[0]
    for p in parts[1:]:
        out = (p[:, None] * out[None, :]).reshape(-1, max(p.shape[1], out.shape[1]), out.shape[2])
    return out


@dataclass
class Block:
    """Arrays of some bins: y, neuron, w [n], x_lin [n, B], factors by column ([n, A] indices or [n, A or 1, F]).

    With ``at`` [n] the regressors, x_lin and factors, are those of patterns, and ``at`` is each bin's pattern.
    """

    y: np.ndarray
    neuron: np.ndarray
    w: np.ndarray
    x_lin: np.ndarray
    factors: dict[str, np.ndarray]
    fold: np.ndarray | None = None
    at: np.ndarray | None = None

    def of(self, v: np.ndarray) -> np.ndarray:
        """Numbers of the bins out of those of their patterns."""
        return v if self.at is None else v[self.at]

    def by(self, v: np.ndarray) -> np.ndarray:
        """Sums by pattern of the bins' numbers [n, R]."""
        return v if self.at is None else np.stack([np.bincount(self.at, weights=c, minlength=len(self.x_lin)) for c in v.T], axis=1) if v.shape[1] else np.zeros((len(self.x_lin), 0))

    def unheld(self, fold) -> Block:
        """The bins of all folds but ``fold``."""
        return self.some(np.flatnonzero(~pd.isna(self.fold) & ((self.fold != fold) if fold is not None else True)))

    def some(self, seen: np.ndarray) -> Block:
        """The bins at ``seen``."""
        if self.at is not None:
            return Block(self.y[seen], self.neuron[seen], self.w[seen], self.x_lin, self.factors, at=self.at[seen])
        return Block(self.y[seen], self.neuron[seen], self.w[seen], self.x_lin[seen], {c: v[seen] for c, v in self.factors.items()})


@dataclass
class Prepared:
    """A parameter set with its factors' coefficients, made once for all blocks of a task; parts and products of factors are those of patterns where a block has them."""

    spec: Spec
    params: Params
    modes: list[list[list[np.ndarray]]] = field(default_factory=list)
    coefficients: list[list[np.ndarray]] = field(default_factory=list)
    projected: list[list[np.ndarray | None]] = field(default_factory=list)

    def __post_init__(self):
        for g in self.spec.groups:
            modes = [[self.params[f"{g.name}.T{s}"] for s in range(len(g.modes)) if g.factor_of[s] == d] for d in range(len(g.factors))]
            flat = [khatri_rao(m) for m in modes]
            self.modes.append(modes)
            self.coefficients.append(flat)
            self.projected.append([c if isinstance(f.table, int) else None if f.table is None else f.table @ c for f, c in zip(g.factors, flat, strict=True)])

    def parts(self, block: Block, j: int) -> list[np.ndarray]:
        """[n, A or 1, R] of each factor of group ``j``."""
        out = []
        for f, c, rows in zip(self.spec.groups[j].factors, self.coefficients[j], self.projected[j], strict=True):
            v = block.factors[f.column]
            if rows is None:
                out.append(v @ c)
            else:
                inside = (v >= 0) & (v < len(rows))
                out.append(np.where(inside[:, :, None], rows[np.where(inside, v, 0)], 0.0))
        return out

    def rate(self, block: Block) -> tuple[np.ndarray, list[tuple[list[np.ndarray], np.ndarray]]]:
        """Log rates, and for each group its factors' parts and their product summed over events [n, R]."""
        x = self.params["W"][block.neuron]
        for b in range(self.spec.linear):
            x = x + block.of(block.x_lin[:, b]) * self.params["B"][b][block.neuron]
        groups = []
        for j, g in enumerate(self.spec.groups):
            parts = self.parts(block, j) if g.rank else []
            a = np.broadcast_to(math.prod(parts[1:], start=parts[0]), (len(block.x_lin), g.events, g.rank)).sum(axis=1) if g.rank else np.zeros((len(block.x_lin), 0))
            for r in range(g.rank):
                x = x + block.of(a[:, r]) * self.params[f"{g.name}.V"][:, r][block.neuron]
            groups.append((parts, a))
        return x, groups

    def weighted(self, block: Block, ll: np.ndarray) -> np.ndarray:
        """The bins' log likelihoods with their weights; with noise precisions as log densities of normal errors."""
        return block.w * self.noisy(block, ll)

    def noisy(self, block: Block, ll: np.ndarray) -> np.ndarray:
        if "noise" not in self.params:
            return ll
        noise = self.params["noise"][block.neuron]
        return noise * ll + 0.5 * np.log(noise / (2 * math.pi))

    def terms(self, block: Block) -> np.ndarray:
        """The bins' log likelihoods without weights."""
        return self.noisy(block, numeric(self.spec.kind, self.rate(block)[0], block.y, self.spec.dt)[0])

    def add(self, block: Block, sums: dict[str, np.ndarray], blocks: set[str]) -> float:
        """The block's log likelihood; derivatives are added to ``sums``, those of ``blocks`` alone."""
        x, groups = self.rate(block)
        ll, dll = numeric(self.spec.kind, x, block.y, self.spec.dt)
        w = block.w if "noise" not in self.params else block.w * self.params["noise"][block.neuron]
        dll = dll * w
        p = self.spec.neurons
        if "W" in blocks:
            sums["W"] += np.bincount(block.neuron, weights=dll, minlength=p)
        if "B" in blocks:
            for b in range(self.spec.linear):
                sums["B"][b] += np.bincount(block.neuron, weights=dll * block.of(block.x_lin[:, b]), minlength=p)
        for j, g in enumerate(self.spec.groups):
            parts, a = groups[j]
            if f"{g.name}.V" in blocks:
                for r in range(g.rank):
                    sums[f"{g.name}.V"][:, r] += np.bincount(block.neuron, weights=dll * block.of(a[:, r]), minlength=p)
            if not g.rank or not blocks & {f"{g.name}.T{s}" for s in range(len(g.modes))}:
                continue
            load = block.by(dll[:, None] * self.params[f"{g.name}.V"][block.neuron])[:, None, :]
            for d, f in enumerate(g.factors):
                mine = [s for s in range(len(g.modes)) if g.factor_of[s] == d]
                if not blocks & {f"{g.name}.T{s}" for s in mine}:
                    continue
                others = np.broadcast_to(math.prod((x for k, x in enumerate(parts) if k != d), start=load), (len(load), g.events, g.rank))
                v = block.factors[f.column]
                if f.table is None:
                    by = np.einsum("nf,nr->fr", v[:, 0], others.sum(axis=1)) if v.shape[1] == 1 else np.einsum("naf,nar->fr", v, others)
                else:  # sums by index first
                    rows = len(self.projected[j][d])
                    inside = (v >= 0) & (v < rows)
                    at, kept = v[inside], others[inside]
                    by = np.stack([np.bincount(at, weights=kept[:, r], minlength=rows) for r in range(g.rank)], axis=1)
                    by = by if isinstance(f.table, int) else f.table.T @ by
                for k, s in enumerate(mine):
                    if f"{g.name}.T{s}" in blocks:
                        sums[f"{g.name}.T{s}"] += np.einsum("ftr,fr->tr", khatri_rao_jacobian(self.modes[j][d], k), by)
        return float(self.weighted(block, ll).sum())


def to_block(batch: pa.RecordBatch, spec: Spec, fold: bool = False) -> Block:
    n = batch.num_rows

    def of(name):
        return batch.column(batch.schema.names.index(name))

    def nested(name):
        c, shape = of(name), [n]
        while pa.types.is_list(c.type):
            c = c.flatten()
            shape.append(len(c) // math.prod(shape) if len(c) else 0)
        return c.to_numpy(zero_copy_only=False).reshape(shape)

    columns = {f.column for g in spec.groups for f in g.factors}
    return Block(of("y").to_numpy(zero_copy_only=False), of("neuron_ix").to_numpy(zero_copy_only=False).astype(np.int64), of("w").to_numpy(zero_copy_only=False), nested("x_lin") if spec.linear else np.zeros((n, 0)), {c: nested(c) for c in columns}, of("fold").to_numpy(zero_copy_only=False) if fold else None)


# ---- jobs

#: Bins that are packed at once.
CHUNK = 1 << 18


def regressor_columns(spec: Spec) -> list[str]:
    return ["y", "neuron_ix", "w", *(["x_lin"] if spec.linear else []), *sorted({f.column for g in spec.groups for f in g.factors})]


def distinct_rows(columns: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of row and every row's kind, of ``n`` rows of columns."""
    code = np.zeros(n, np.int64)
    for c in columns:
        own, values = pd.factorize(c, use_na_sentinel=False)
        code = pd.factorize(code * max(1, len(values)) + own)[0]
    kinds = int(code.max(initial=-1)) + 1
    first = np.empty(kinds, np.int64)
    first[code[::-1]] = np.arange(n - 1, -1, -1)
    return first, code


@dataclass
class Packed:
    """A chunk's distinct bins; with keys the pairs of a bin and a unit (a trial) it is in, their weights, and the units' keys."""

    block: Block
    bin: np.ndarray | None = None
    unit: np.ndarray | None = None
    w: np.ndarray | None = None
    keys: pa.Table | None = None

    def dumped(self) -> bytes:
        b = self.block
        return pickle.dumps(([lean(a) for a in (b.y, b.neuron, b.w, b.x_lin, b.fold, b.at)], {c: lean(v) for c, v in b.factors.items()}, [lean(a) for a in (self.bin, self.unit, self.w)], self.keys), pickle.HIGHEST_PROTOCOL)

    @staticmethod
    def loaded(x: pa.Scalar) -> Packed:
        own, factors, rest, keys = pickle.loads(x.as_buffer())
        y, neuron, w, x_lin, fold, at = (a if kind is None else a.astype(kind) for a, kind in own)
        block = Block(y, neuron, w, x_lin, {c: a if kind is None else a.astype(kind) for c, (a, kind) in factors.items()}, fold, at)
        return Packed(block, *(a if kind is None else a.astype(kind) for a, kind in rest), keys)


def lean(a: np.ndarray | None) -> tuple | None:
    """An array in the smallest whole numbers that hold it, and its own type."""
    if a is None or not a.size or a.dtype.kind not in "if" or (a.dtype.kind == "f" and not (np.isfinite(a).all() and np.abs(a).max() < 1 << 31 and (a == np.floor(a)).all() and not (np.signbit(a) & (a == 0)).any())):
        return a, None
    least, most = int(a.min()), int(a.max())
    kind = next((k for k in (np.int8, np.int16, np.int32) if np.iinfo(k).min <= least and most <= np.iinfo(k).max), None)
    return (a, None) if kind is None else (a.astype(kind), a.dtype)


def merged(b: pa.RecordBatch, spec: Spec, keys: list[str], fold: bool) -> Packed:
    """The rows of a chunk without repetitions. Weights are summed, so every sum over bins is as before but for rounding."""
    one = to_block(b, spec, fold)
    n = len(one.y)
    flat = [c for v in (one.x_lin, *one.factors.values()) for c in v.reshape(n, -1).T] if n else []
    patterns, pattern = distinct_rows(flat, n)
    first, code = distinct_rows([pattern, one.neuron, one.y, *([one.fold] if fold else [])], n)
    block = Block(one.y[first], one.neuron[first], np.bincount(code, weights=one.w, minlength=len(first)), one.x_lin[patterns], {c: v[patterns] for c, v in one.factors.items()}, one.fold[first] if fold else None, pattern[first])
    if not keys:
        return Packed(block)
    own = [b.column(f"key_{i}") for i in range(len(keys))]
    units, unit = distinct_rows([k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in own], n)
    pairs, pair = distinct_rows([code, unit], n)
    return Packed(block, code[pairs].astype(np.int32), unit[pairs].astype(np.int32), np.bincount(pair, weights=one.w, minlength=len(pairs)), pa.table([k.take(pa.array(units)) for k in own], names=keys))


def packed(rows: DataFrame, spec: Spec, keys: Iterable[str] = (), fold: bool = False, chunk: int | None = None) -> DataFrame:
    """(packed, bad): the rows with weights in chunks, as ``Packed`` writes them, and the number of rows that break each of RULES; a chunk with such rows isn't packed."""
    keys, size = list(keys), chunk or CHUNK
    typed = {"y": F.col("y").cast("double"), "w": F.col("w").cast("double"), "neuron_ix": F.col("neuron_ix").cast("bigint")}
    needed = [*regressor_columns(spec), *(["fold"] if fold else [])]

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= size:
                yield pack(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held))

    def pack(table):
        bad, out = broken_numbers(table, spec), None
        if not any(bad):
            table = table.filter(pc.not_equal(table.column("w"), 0.0)).combine_chunks()
            if table.num_rows:
                out = merged(table.to_batches()[0], spec, keys, fold).dumped()
        return pa.RecordBatch.from_arrays([pa.array([out], pa.binary()), pa.array([bad], pa.list_(pa.int64()))], names=["packed", "bad"])

    return rows.select(*(typed.get(c, F.col(c)).alias(c) for c in needed), *(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys))).mapInArrow(run, "packed binary, bad array<bigint>")


RULES = ["y", "weight", "neuron", "count", "linear"]


def broken_numbers(b: pa.Table, spec: Spec) -> list[int]:
    """As ``broken_rows``, of a chunk."""
    def numbers(name):
        return b.column(name).combine_chunks().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)

    y, w, ix = (numbers(c) for c in ("y", "w", "neuron_ix"))
    bad = [~np.isfinite(y), ~np.isfinite(w), ~((ix >= 0) & (ix < spec.neurons)), np.isfinite(y) & (y != np.floor(y)) if spec.kind != "sq_err" else np.zeros(len(y), bool)]
    if spec.linear:
        bad.append(pc.fill_null(pc.list_value_length(b.column("x_lin")), -1).to_numpy() != spec.linear)
    return [int(x.sum()) for x in bad] + [0] * (len(RULES) - len(bad))


def bins_of(b: pa.RecordBatch, spec: Spec, fold: bool = False) -> Iterable[Block]:
    """The blocks of a batch of rows or of chunks."""
    if "packed" not in b.schema.names:
        yield from [to_block(b, spec, fold)] if b.num_rows else []
    else:
        for x in b.column(b.schema.names.index("packed")):
            if x.is_valid:
                yield Packed.loaded(x).block


def inputs(rows: DataFrame, spec: Spec, more: Iterable[str] = ()) -> DataFrame:
    """What jobs read of rows with weights, or of chunks."""
    if "packed" in rows.columns:
        return rows.select("packed")
    return rows.where("w <> 0").select(*dict.fromkeys([*more, *regressor_columns(spec)]))


def evaluate(rows: DataFrame, spec: Spec, sets: list[Params], blocks: Iterable[str] | None = None, held: list[int | None] | None = None) -> list[tuple[float, Params]]:
    """(log likelihood, derivatives by ``blocks``) of each parameter set, in one job over rows or chunks (``packed``).

    held: for each set a value of the column fold whose rows it doesn't see; rows without a fold are seen by no set then.
    """
    wanted = {k for k, s in spec.shapes().items() if k != "H" and (blocks is None or k in blocks)}
    shipped = rows.sparkSession.sparkContext.broadcast((sets, held))
    shapes = spec.shapes()

    def run(batches):
        params, out = shipped.value
        ready = [Prepared(spec, p) for p in params]
        sums = [{k: np.zeros(shapes[k]) for k in wanted} for _ in params]
        lls = np.zeros(len(params))
        for b in batches:
            for whole in bins_of(b, spec, bool(out)):
                for i, one in enumerate(ready):
                    block = whole.unheld(out[i]) if out else whole
                    lls[i] += one.add(block, sums[i], wanted)
        for i, one in enumerate(sums):
            yield partial_sums(i, np.stack([own_column(one, *c) for c in own], axis=1) if own else np.zeros((0, width)), np.concatenate([lls[i : i + 1], *(one[k].ravel(order="F") for k in modes)]))

    own, modes = own_columns(spec, wanted), [k for k in shapes if ".T" in k and k in wanted]
    width, neurons = len(own) or 8, spec.neurons if own else 0
    data = inputs(rows.where("fold IS NOT NULL") if held and "fold" in rows.columns else rows, spec, ["fold"] if held else [])
    found = total_sums(data.mapInArrow(run, partial_schema(width)), width, len(sets), neurons, 1 + sum(math.prod(shapes[k]) for k in modes))
    shipped.unpersist()
    out = []
    for by_neuron, rest in found:
        grads, at = {k: np.zeros(shapes[k]) for k in wanted}, 1
        for i, c in enumerate(own):
            own_column(grads, *c)[:] = by_neuron[:, i]
        for k in modes:
            grads[k] = rest[at : at + math.prod(shapes[k])].reshape(shapes[k], order="F")
            at += math.prod(shapes[k])
        out.append((float(rest[0]), grads))
    return out


def own_column(params: Params, k: str, j: int, c: int) -> np.ndarray:
    """A column of ``own_columns`` as a view."""
    return params[k] if k == "W" else params[k][c] if k == "B" else params[k][:, c]


def partial_schema(width: int) -> str:
    return "set int, at bigint, " + ", ".join(f"v{i} double" for i in range(width))


def partial_sums(i: int, by_neuron: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """A task's sums of set ``i``: a row for each neuron it has, and behind them the numbers of the rest, as many in a row."""
    width = by_neuron.shape[1]
    at = np.flatnonzero((by_neuron != 0).any(axis=1))
    v = np.concatenate([by_neuron[at], np.pad(rest, (0, -len(rest) % width)).reshape(-1, width)])
    places = np.r_[at, len(by_neuron) + np.arange(len(v) - len(at))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(places.astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in v.T)], names=["set", "at", *(f"v{k}" for k in range(width))])


def total_sums(partial: DataFrame, width: int, sets: int, neurons: int, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each set the sums by neuron and the rest, of all tasks; a row of them for each neuron comes to the driver, as Arrow."""
    table = partial.groupBy("set", "at").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(width))).toArrow()
    out = np.zeros((sets, neurons - (-size // width), width))
    out[table.column("set").to_numpy(), table.column("at").to_numpy()] = np.stack([table.column(f"v{i}").to_numpy() for i in range(width)], axis=1)
    return [(v[:neurons], v[neurons:].ravel()[:size]) for v in out]


def summed(partial: DataFrame, keys: list[str]) -> dict[str, np.ndarray]:
    """Columns of the sums of v by ``keys``, as many rows as there are parameters; they come as Arrow."""
    table = partial.groupBy(*keys).agg(F.sum("v").alias("v")).toArrow()
    return {c: table.column(c).to_numpy() for c in (*keys, "v")}


def unit_sums(rows: DataFrame, spec: Spec, sets: list[Params], keys: list[str], types: list[str], held: list[int] | None = None) -> DataFrame:
    """(set, ``keys``, ll): weighted log likelihoods of units (trials) under each parameter set, out of chunks with these keys; a task sums a unit's bins before anything is shuffled.

    held: for each set the fold whose bins alone are scored. With noise precisions they are log densities of normal errors.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(sets)

    def run(batches):
        ready = [Prepared(spec, p) for p in shipped.value]
        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    chunk = Packed.loaded(x)
                    for i, one in enumerate(ready):
                        seen = np.arange(len(chunk.bin)) if held is None else np.flatnonzero(chunk.block.fold[chunk.bin] == held[i])
                        unit = chunk.unit[seen]
                        ll = np.bincount(unit, weights=chunk.w[seen] * one.terms(chunk.block)[chunk.bin[seen]], minlength=chunk.keys.num_rows)
                        units = np.flatnonzero(np.bincount(unit, minlength=len(ll)))
                        own = chunk.keys.take(pa.array(units)).combine_chunks()
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(units), i, np.int32)), *(own.column(k).combine_chunks() for k in keys), pa.array(ll[units])], names=["set", *keys, "ll"])

    schema = ", ".join(["set int", *(f"{k} {t}" for k, t in zip(keys, types, strict=True)), "ll double"])
    return rows.select("packed").mapInArrow(run, schema).groupBy("set", *keys).agg(F.sum("ll").alias("ll"))


def curvatures(rows: DataFrame, spec: Spec, sets: list[Params], blocks: set[str], held: list[int | None] | None = None) -> list[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Second derivatives of the log likelihood of each parameter set, in one job: by each neuron's own parameters among ``blocks`` (in the order of ``own_columns``), [neurons, k, k], and by each mode among them."""
    from spikeloom.plans.by_neuron import mode_features

    own = own_columns(spec, blocks)
    upper = np.triu_indices(len(own))
    modes = [(j, s, f"{g.name}.T{s}") for j, g in enumerate(spec.groups) for s in range(len(g.modes)) if g.rank and f"{g.name}.T{s}" in blocks]
    shipped = rows.sparkSession.sparkContext.broadcast((sets, held))

    def run(batches):
        params, out = shipped.value
        ready = [Prepared(spec, p) for p in params]
        by_neuron = [np.zeros((len(upper[0]), spec.neurons)) for _ in params]
        by_mode = [{name: np.zeros((spec.shapes()[name][0] * spec.groups[j].rank,) * 2) for j, _, name in modes} for _ in params]
        for b in batches:
            for whole in bins_of(b, spec, bool(out)):
                for i, one in enumerate(ready):
                    block = whole.unheld(out[i]) if out else whole
                    x, groups = one.rate(block)
                    noise = one.params["noise"][block.neuron] if "noise" in one.params else 1.0
                    d2 = curvature(spec.kind, x, block.y, spec.dt) * block.w * noise
                    z = [np.ones(len(x)) if k == "W" else block.of(block.x_lin[:, c]) if k == "B" else block.of(groups[j][1][:, c]) for k, j, c in own]
                    for u, (p, q) in enumerate(zip(*upper, strict=True)):
                        by_neuron[i][u] += np.bincount(block.neuron, weights=d2 * z[p] * z[q], minlength=spec.neurons)
                    for j, s, name in modes:
                        rank, load = spec.groups[j].rank, one.params[f"{spec.groups[j].name}.V"][block.neuron]
                        slope = mode_features(spec, one.params, block, [g[0] for g in groups], np.ones((len(block.x_lin), 1 + spec.linear + sum(g.rank for g in spec.groups))), j, s)
                        slope = slope.reshape(len(slope), rank, -1)
                        pairs = [(r, q) for r in range(rank) for q in range(r, rank)]
                        weight = block.by(np.stack([d2 * load[:, r] * load[:, q] for r, q in pairs], axis=1))
                        n, h = slope.shape[2], by_mode[i][name]
                        for (r, q), v in zip(pairs, weight.T, strict=True):
                            part = (slope[:, r] * v[:, None]).T @ slope[:, q]
                            h[r * n : (r + 1) * n, q * n : (q + 1) * n] += part
                            if q > r:
                                h[q * n : (q + 1) * n, r * n : (r + 1) * n] += part.T
        for i in range(len(params)):
            yield partial_sums(i, by_neuron[i].T if own else np.zeros((0, width)), np.concatenate([np.zeros(1), *(v.ravel() for v in by_mode[i].values())]))

    width, neurons = len(upper[0]) or 8, spec.neurons if own else 0
    sizes = [spec.shapes()[name][0] * spec.groups[j].rank for j, _, name in modes]
    data = inputs(rows, spec, ["fold"] if held else [])
    found = total_sums(data.mapInArrow(run, partial_schema(width)), width, len(sets), neurons, 1 + sum(n * n for n in sizes))
    shipped.unpersist()
    out = []
    for flat, rest in found:
        h, at, by_mode = np.zeros((spec.neurons, len(own), len(own))), 1, {}
        if own:
            h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = flat
        for (_, _, name), n in zip(modes, sizes, strict=True):
            by_mode[name] = rest[at : at + n * n].reshape(n, n)
            at += n * n
        out.append((h, by_mode))
    return out


def squared_errors(rows: DataFrame, spec: Spec, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights and of weighted squared errors by neuron."""
    shipped = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches):
        one, out = Prepared(spec, shipped.value), np.zeros((2, spec.neurons))
        for b in batches:
            for block in bins_of(b, spec):
                for v, w in zip(out, (block.w, block.w * (block.y - one.rate(block)[0]) ** 2), strict=True):
                    v += np.bincount(block.neuron, weights=w, minlength=spec.neurons)
        at = np.flatnonzero(out[0])
        for k, v in enumerate(out):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int64)), pa.array(at.astype(np.int64)), pa.array(v[at])], names=["block", "at", "v"])

    found = summed(inputs(rows, spec).mapInArrow(run, "block bigint, at bigint, v double"), ["block", "at"])
    shipped.unpersist()
    out = np.zeros((2, spec.neurons))
    out[found["block"], found["at"]] = found["v"]
    return out[0], out[1]


def own_columns(spec: Spec, blocks: set[str]) -> list[tuple[str, int, int]]:
    """(block, group, row or component) of a neuron's parameters among ``blocks``."""
    return [*([("W", 0, 0)] if "W" in blocks else []), *(("B", 0, b) for b in range(spec.linear) if "B" in blocks), *((f"{g.name}.V", j, r) for j, g in enumerate(spec.groups) for r in range(g.rank) if f"{g.name}.V" in blocks)]


def rates(rows: DataFrame, spec: Spec, params: Params, keys: list[str]) -> DataFrame:
    """``keys``, y, w, x (log rate), ll (unweighted) of every bin: the block path of the log rate."""
    shipped = rows.sparkSession.sparkContext.broadcast(params)
    data = rows.where("w <> 0")
    schema = ", ".join([*(f"{k} {data.schema[k].dataType.simpleString()}" for k in keys), "y double, w double, x double, ll double"])

    def run(batches):
        one = Prepared(spec, shipped.value)
        for b in batches:
            if b.num_rows:
                block = to_block(b, spec)
                x, _ = one.rate(block)
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(k)) for k in keys), pa.array(block.y), pa.array(block.w), pa.array(x), pa.array(numeric(spec.kind, x, block.y, spec.dt)[0])], names=[*keys, "y", "w", "x", "ll"])

    return inputs(rows, spec, keys).mapInArrow(run, schema)


def trial_ll(rows: DataFrame, spec: Spec, params: Params, keys: list[str]) -> DataFrame:
    """Weighted log likelihoods of trials."""
    return rates(rows, spec, params, keys).groupBy(*keys).agg(F.sum(F.col("w") * F.col("ll")).alias("ll"))


# ---- posterior

#: A prior gives the log density of parameters and its derivatives by block.
Prior = Callable[[Params], tuple[float, Params]]


def gaussian_prior(blocks: dict[str, float]) -> Prior:
    """Independent N(0, exp(2 log_sd)) on whole blocks, by block."""
    def prior(params: Params) -> tuple[float, Params]:
        lp, out = 0.0, {}
        for k, h in blocks.items():
            precision = math.exp(-max(-20.0, min(20.0, 2 * h)))
            lp += float(-0.5 * precision * (params[k] ** 2).sum() - params[k].size * (0.5 * math.log(2 * math.pi) + h))
            out[k] = -precision * params[k]
        return lp, out

    return prior


def covariance_prior(block: str, covariance: np.ndarray) -> Prior:
    """Each column of a block N(0, covariance); a singular covariance is used on its range (by its eigenvectors)."""
    values, vectors = np.linalg.eigh(covariance)
    kept = values > 1e-10 * max(values.max(), 1e-300)
    root, logdet = vectors[:, kept] / np.sqrt(values[kept]), float(np.log(values[kept]).sum())

    def prior(params: Params) -> tuple[float, Params]:
        z = root.T @ params[block]
        columns = params[block].shape[1]
        return float(-0.5 * (z * z).sum() - 0.5 * columns * (logdet + kept.sum() * math.log(2 * math.pi))), {block: -root @ z}

    return prior


def prior_sum(priors: Iterable[Prior], params: Params) -> tuple[float, Params]:
    lp, out = 0.0, {}
    for prior in priors:
        v, grads = prior(params)
        lp += v
        for k, g in grads.items():
            out[k] = out.get(k, 0.0) + g
    return lp, out


def log_det(matrix: np.ndarray) -> float:
    """Of a positive definite matrix by Cholesky; of others log max(1e-20, det)."""
    try:
        return float(2 * np.log(np.diag(np.linalg.cholesky(matrix))).sum())
    except np.linalg.LinAlgError:
        return float(np.log(max(1e-20, np.linalg.det(matrix))))


# ---- optimizers in lockstep

Asks = Generator[np.ndarray, tuple[float, np.ndarray], dict]


@dataclass
class Scale:
    """What an optimizer yields to be sent a function that multiplies by about the inverse of the negative Hessian at ``x``."""

    x: np.ndarray


#: Steps before which the inverse Hessian is estimated anew.
RESCALED = (0, 2, 5, 10, 20, 40, 80, 160)
#: Rounds of blocks in turn before all parameters move at once, and steps of a block.
WARM = 3
#: Bytes of an optimizer's steps that the driver holds.
HELD_PAIRS = 48 << 20


def lbfgs(x: np.ndarray, steps: int = 100, tolerance: float = 1e-6, memory: int = 10, restarts: int = 4, scaled: bool = False) -> Asks:
    """Maximizes; yields points and is sent (value, gradient). Returns x, value, steps, converged; starts anew from the steepest ascent when a line search fails.

    ``scaled``: yields a ``Scale`` now and then, too; with the answer, steps begin as Newton's by blocks of parameters, so that there are far fewer of them.
    """
    f, g = yield x
    scale = None
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    converged, left, it = False, restarts, 0
    while it < steps:
        if scaled and it in RESCALED:
            scale = yield Scale(x)
        it += 1
        q, coefficients = g.copy(), []
        for s, y in reversed(pairs):
            c = (s @ q) / (s @ y)
            coefficients.append(c)
            q -= c * y
        if scale:
            q = scale(q)
        else:
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(g).max())
        for (s, y), c in zip(pairs, reversed(coefficients), strict=True):
            q += (c - (y @ q) / (s @ y)) * s
        slope, t = q @ g, 1.0
        if slope <= 0:
            q, pairs = scale(g) if scale else g / max(1.0, np.abs(g).max()), []
            slope = q @ g
        while True:
            new = x + t * q
            f2, g2 = yield new
            if np.isfinite(f2) and f2 >= f + 1e-4 * t * slope:
                break
            fall = f + t * slope - f2  # a parabola's maximum, within bounds
            t *= min(0.5, max(0.1, t * slope / (2 * fall))) if np.isfinite(fall) and fall > 0 else 0.1
            if t < 1e-8:
                break
        if t < 1e-8:
            if not pairs or not left:
                converged = bool(np.abs(g).max() <= 1e-3 * max(1.0, abs(f)))
                break
            left, pairs = left - 1, []
            continue
        s, y = new - x, g - g2  # of the negative function
        gain, x, f, g = f2 - f, new, f2, g2
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs[-memory + 1 :], (s, y)]
        if gain <= tolerance * (1 + abs(f)) or np.abs(g).max() <= tolerance * max(1.0, abs(f)):
            converged = True
            break
    return {"x": x, "value": f, "steps": it, "converged": converged}


def lockstep(asking: list[Generator], answer: Callable[[list[int], list[np.ndarray]], list[tuple[float, np.ndarray]]]) -> list:
    """Runs generators side by side; each round all their points are answered at once. Returns what they return."""
    out, open_ = [None] * len(asking), {}
    for i, a in enumerate(asking):
        try:
            open_[i] = next(a)
        except StopIteration as e:
            out[i] = e.value
    while open_:
        at = sorted(open_)
        for i, found in zip(at, answer(at, [open_[i] for i in at]), strict=True):
            try:
                open_[i] = asking[i].send(found)
            except StopIteration as e:
                out[i] = e.value
                del open_[i]
    return out


def broken_rows(rows: DataFrame, spec: Spec) -> dict[str, int]:
    """Numbers of rows by the rule they break: y finite, and whole where it counts (negative ones are censored); a finite weight; a neuron of the model; as many linear regressors as it has."""
    def finite(c):
        x = F.col(c).cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)

    y, ix = F.col("y").cast("double"), F.col("neuron_ix")
    rules = {"y": finite("y"), "weight": finite("w"), "neuron": ix.isNotNull() & (ix >= 0) & (ix < spec.neurons), "count": F.lit(spec.kind == "sq_err") | ~finite("y") | (y == F.floor(y))}
    if spec.linear:
        rules["linear"] = F.coalesce(F.size("x_lin") == spec.linear, F.lit(False))
    return {k: v for k, v in rows.agg(*(F.count_if(~ok).alias(k) for k, ok in rules.items())).first().asDict().items() if v}


class Model:
    """A model over rows, which it checks and packs once; the chunks are held in memory and on the executors' disks until ``close``."""

    def __init__(self, rows: DataFrame, spec: Spec, priors: Iterable[Prior] = (), scaling: tuple | None = None, keys: Iterable[str] = ()):
        """scaling: (forward, backward) between the parameters that are fitted or sampled and the natural ones, as ``horseshoe.chain`` makes it. keys: columns of the units (trials) whose log likelihoods will be asked for."""
        self.spec, self.priors, self.scaling, self.rows, self.keys = spec, list(priors), scaling, rows, list(keys)
        self.forward, self.backward = scaling or (lambda p: p, lambda p, g: g)
        own = packed(rows, spec, self.keys, "fold" in rows.columns)
        own.write.parquet(path := shared_folder(rows.sparkSession, "chunks"))  # plans of jobs stay small
        self.chunks = rows.sparkSession.read.schema(own.schema).parquet(path).persist()
        found = self.chunks.agg(*(F.coalesce(F.sum(F.get("bad", F.lit(i))), F.lit(0)).alias(k) for i, k in enumerate(RULES))).first().asDict()
        if broken := {k: v for k, v in found.items() if v}:
            self.close()
            raise ValueError(f"rows break rules: {broken}")

    def close(self) -> None:
        self.chunks.unpersist()

    def unit_ll(self, sets: list[Params], keys: list[str], held: list[int] | None = None) -> DataFrame:
        """(set, ``keys``, ll) of natural parameter sets, as ``unit_sums``."""
        types = [self.rows.schema[k].dataType.simpleString() for k in keys]
        chunks = self.chunks if keys == self.keys else packed(self.rows, self.spec, keys, "fold" in self.rows.columns)
        return unit_sums(chunks, self.spec, sets, keys, types, held)

    def log_likelihood(self, params: Params, blocks: Iterable[str] | None = None) -> tuple[float, Params]:
        """Value and the derivatives by ``blocks`` (by default all)."""
        return evaluate(self.chunks, self.spec, [verify(self.spec, params)], blocks)[0]

    def log_posterior(self, params: Params, blocks: Iterable[str] | None = None) -> dict:
        ll, grads = self.log_likelihood(self.forward(params), blocks)
        grads = self.backward(params, grads)
        lp, more = prior_sum(self.priors, params)
        return {"log_likelihood": ll, "log_prior": lp, "log_posterior": ll + lp, "gradient": {k: grads[k] + more.get(k, 0.0) for k in grads}}

    def answer(self, starts: list[Params], blocks: set[str], held: list | None, prior: bool):
        """What lockstep() asks: values and gradients by the chosen blocks of the vectors, of the i-th fit in turn; and scales."""
        def values(at, sets):
            found = evaluate(self.chunks, self.spec, [self.forward(p) for p in sets], None if "H" in blocks else blocks, [held[i] for i in at] if held else None)
            out = []
            for p, (ll, grads) in zip(sets, found, strict=True):
                grads = self.backward(p, grads)
                lp, more = prior_sum(self.priors, p) if prior else (0.0, {})
                full = {k: grads.get(k, np.zeros(self.spec.shapes()[k])) + more.get(k, 0.0) for k in blocks}
                out.append((ll + lp, vectorize(self.spec, full, blocks)))
            return out

        def scales(at, sets):
            return self.scales(sets, blocks, [held[i] for i in at] if held else None, prior)

        def run(at, points):
            out = [None] * len(points)
            for asked, work in ((True, scales), (False, values)):
                if own := [k for k, x in enumerate(points) if isinstance(x, Scale) == asked]:
                    sets = [devectorize(self.spec, points[k].x if asked else points[k], starts[at[k]], blocks) for k in own]
                    for k, found in zip(own, work([at[k] for k in own], sets), strict=True):
                        out[k] = found
            return out

        return run

    def scales(self, sets: list[Params], blocks: set[str], held: list | None, prior: bool) -> list[Callable]:
        """For each parameter set a product of vectors by ``blocks`` with the inverse of the negative Hessian's blocks: of each neuron's own parameters, and of each mode.

        Priors come in by differences of their gradients, as if parameters were independent in them. Directions of wrong curvature count as of right one.
        """
        own, column = own_columns(self.spec, blocks), own_column

        def inverse(h):
            values, vectors = np.linalg.eigh(h)
            values = np.abs(values)
            top = values.max(axis=-1, keepdims=True, initial=0.0)
            return np.einsum("...ij,...j,...kj->...ik", vectors, 1 / np.maximum(values, np.where(top > 0, 1e-8 * top, 1.0)), vectors)

        out = []
        for params, (h, modes) in zip(sets, curvatures(self.chunks, self.spec, sets, blocks, held), strict=True):
            bend = {k: np.zeros(self.spec.shapes()[k]) for k in blocks}
            if prior:
                (_, here), (_, there) = (prior_sum(self.priors, params | {k: params[k] + e for k in blocks}) for e in (0.0, 1e-3))
                bend |= {k: np.maximum(np.nan_to_num((here[k] - there[k]) / 1e-3), 0.0) for k in blocks & set(here)}
            by_neuron = -h
            for i, (k, j, c) in enumerate(own):
                by_neuron[:, i, i] += column(bend, k, j, c)
            by_neuron = inverse(by_neuron)
            by_mode = {name: inverse(np.diag(bend[name].ravel(order="F")) - m) for name, m in modes.items()}

            def apply(q, by_neuron=by_neuron, by_mode=by_mode):
                turned = {k: v.copy() for k, v in devectorize(self.spec, q, None, blocks).items()}
                if own:
                    moved = np.einsum("pij,pj->pi", by_neuron, np.stack([column(turned, *at) for at in own], axis=1))
                    for i, at in enumerate(own):
                        column(turned, *at)[:] = moved[:, i]
                for name, m in by_mode.items():
                    turned[name] = (m @ turned[name].ravel(order="F")).reshape(turned[name].shape, order="F")
                return vectorize(self.spec, turned, blocks)

            out.append(apply)
        return out

    def fit(self, starts: list[Params], prior: bool = False, blocks: Iterable[str] | None = None, held: list | None = None, hyper: bool = False, **options) -> list[dict]:
        """Maximum likelihood (or with ``prior`` a posteriori) fits from several starts or for several held folds, side by side: params, value, steps, converged.

        A few steps of blocks in turn go before those of all parameters. With ``hyper`` the hyperparameters H are fitted, too. Only maximum likelihood fits of all natural parameters are normalized: under a prior the point itself is the result.
        """
        chosen = {k for k in self.spec.shapes() if (k != "H" and (blocks is None or k in blocks)) or (k == "H" and hyper and self.spec.hyper)}
        options = {"scaled": self.scaling is None} | options
        if options["scaled"]:  # loads and modes bend together, in about as many directions as modes have numbers
            options = {"memory": int(max(10, min(40, HELD_PAIRS // (16 * sum(math.prod(self.spec.shapes()[k]) for k in chosen) + 1))))} | options
        starts = [verify(self.spec, p) for p in starts]
        turns = [t & chosen for t in self.schedule("modes") if t & chosen]
        for t in turns * (WARM if options["scaled"] and len(turns) > 1 else 0):  # far from the maximum, steps of factors of one product would multiply
            found = lockstep([lbfgs(vectorize(self.spec, p, t), **options | {"steps": min(WARM, options.get("steps", WARM))}) for p in starts], self.answer(starts, t, held, prior))
            starts = [devectorize(self.spec, f["x"], p, t) for f, p in zip(found, starts, strict=True)]
        found = lockstep([lbfgs(vectorize(self.spec, p, chosen), **options) for p in starts], self.answer(starts, chosen, held, prior))
        free = not prior and blocks is None and self.scaling is None
        points = [devectorize(self.spec, f.pop("x"), p, chosen) for f, p in zip(found, starts, strict=True)]
        return [{"params": normalize(self.spec, p) if free else p, **f} for f, p in zip(found, points, strict=True)]

    def curvature(self, params: Params, directions: np.ndarray, prior: bool = True, blocks: Iterable[str] | None = None, step: float = 1e-4, at_once: int = 64) -> np.ndarray:
        """Products of the Hessian of the log posterior (or likelihood) by ``blocks`` with directions [m, n], by central differences of gradients.

        A job answers ``at_once`` points; each direction has two.
        """
        chosen = {k for k in self.spec.shapes() if (blocks is None or k in blocks) and (k != "H" or self.spec.hyper)}
        x = vectorize(self.spec, verify(self.spec, params), chosen)
        size = step * np.maximum(1.0, np.abs(x).max(initial=0.0)) / np.maximum(np.abs(directions).max(axis=1, initial=1e-300), 1e-300)
        points = [x + sign * h * d for d, h in zip(directions, size, strict=True) for sign in (1, -1)]
        answer, slopes = self.answer([params] * len(points), chosen, None, prior), []
        for i in range(0, len(points), at_once):
            part = list(range(i, min(i + at_once, len(points))))
            slopes += [g for _, g in answer(part, [points[k] for k in part])]
        return np.array([(slopes[2 * i] - slopes[2 * i + 1]) / (2 * h) for i, h in enumerate(size)]).reshape(len(directions), len(x))

    def hessian(self, params: Params, prior: bool = True, blocks: Iterable[str] | None = None, **options) -> np.ndarray:
        """Estimate of the whole Hessian, made symmetric: for models of some thousand parameters; larger ones take products (``curvature``) or ``lanczos``."""
        chosen = {k for k in self.spec.shapes() if (blocks is None or k in blocks) and (k != "H" or self.spec.hyper)}
        h = self.curvature(params, np.eye(sum(math.prod(self.spec.shapes()[k]) for k in chosen)), prior, chosen, **options)
        return (h + h.T) / 2

    def lanczos(self, params: Params, steps: int = 20, prior: bool = True, blocks: Iterable[str] | None = None, seed: int = 0, **options) -> tuple[np.ndarray, np.ndarray]:
        """Ritz values and vectors [n, k] of the Hessian, whose extreme ones come near its own; a product for each step, with full reorthogonalization."""
        chosen = {k for k in self.spec.shapes() if (blocks is None or k in blocks) and (k != "H" or self.spec.hyper)}
        n = sum(math.prod(self.spec.shapes()[k]) for k in chosen)
        q = np.random.default_rng(seed).standard_normal(n)
        basis, diagonal, beside = [q / np.linalg.norm(q)], [], []
        for k in range(min(steps, n)):
            w = self.curvature(params, basis[k][None], prior, chosen, **options)[0]
            diagonal.append(float(w @ basis[k]))
            for _ in range(2):
                w = w - np.array(basis).T @ (np.array(basis) @ w)
            size = float(np.linalg.norm(w))
            if size < 1e-8 * max(1.0, max(map(abs, diagonal))) or k + 1 == min(steps, n):
                break
            beside.append(size)
            basis.append(w / size)
        values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
        return values, np.array(basis).T @ vectors

    def schedule(self, kind: str = "modes", hyper: bool = False) -> list[set[str]]:
        """Blocks that are fitted in turn: "all" at once; "modes": weights and loads, then each mode; "combinations": for every choice of one mode (or the loads) of each
        group, these with W and B, so that each conditional model is a linear one. Hyperparameters come last."""
        spec = self.spec
        names = [[f"{g.name}.V", *(f"{g.name}.T{s}" for s in range(len(g.modes)))] for g in spec.groups if g.rank]
        if kind == "all":
            turns = [{k for k in spec.shapes() if k != "H"}]
        elif kind == "modes":
            turns = [{"W", "B", *(n[0] for n in names)}, *({m} for n in names for m in n[1:])]
        elif kind == "combinations":
            turns = [{"W", "B", *choice} for choice in itertools.product(*names)]
        else:
            raise ValueError(f"no schedule {kind}")
        return turns + [{"H"}] * bool(hyper and spec.hyper)

    def alternate(self, start: Params, prior: bool = False, sweeps: int = 10, tolerance: float = 1e-6, kind: str = "modes", hyper: bool = False, **options) -> dict:
        """Fits the blocks of a ``schedule`` in turn."""
        params, value, converged = verify(self.spec, start), -math.inf, False
        options = {"scaled": self.scaling is None} | options
        for sweep in range(sweeps):
            before = value
            for blocks in self.schedule(kind, hyper):
                found = lockstep([lbfgs(vectorize(self.spec, params, blocks), **options)], self.answer([params], blocks, None, prior))[0]
                params, value = devectorize(self.spec, found["x"], params, blocks), found["value"]
            if value - before <= tolerance * (1 + abs(value)):
                converged = True
                break
        params = params if prior or self.scaling is not None else normalize(self.spec, params)
        return {"params": params, "value": value, "steps": sweep + 1, "converged": converged}

    def cross_validate(self, start: Params, folds: int, keys: list[str], prior: bool = False, **options) -> DataFrame:
        """``keys``, fold, ll of every trial under the fit that hasn't seen its fold (column fold); all fits go side by side."""
        fits = self.fit([start] * folds, prior, None, list(range(folds)), **options)
        scored = self.unit_ll([self.forward(f["params"]) for f in fits], keys, list(range(folds)))
        return scored.select(*keys, F.col("set").cast(self.rows.schema["fold"].dataType).alias("fold"), "ll")
