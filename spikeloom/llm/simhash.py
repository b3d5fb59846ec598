"""SimHash near-dedup with vantage-point trees.

A document's fingerprint has one bit for each bit position of its shingle hashes, set if more than half of the
hashes have it. Documents whose fingerprints differ in at most ``radius`` bits are linked; a component is what
links reach.

1. Equal fingerprints are grouped first, so copies cost one row each afterwards.
2. A vantage-point tree is grown on the driver from a bounded sample of the distinct fingerprints: a node
   has a vantage fingerprint and a distance mu; fingerprints within mu are inside. Its leaves are shards. Among a few
   vantages and distances the tree takes the split with the least work, and doesn't split
   where the triangle bound would prune too little.
3. Every fingerprint has one home shard. It also visits the inside of each node where it lies outside by at most
   ``radius`` (mu < d <= mu + radius): by the triangle inequality no other shard holds a partner that doesn't
   in turn visit the fingerprint's home. So each linked pair meets in the home of one of the two.
4. The rows of a shard, visitors too, are hashed to blocks of about ``block`` rows, and each pair of blocks is a group of its own, so a group
   holds at most two blocks however crowded a region is. A group finds its exact pairs and returns a spanning
   forest of them, at most one link for each fingerprint, not all pairs.
5. Components of those links are found by star joins and joined back to the documents.

With ``least`` a link is a pair within ``radius`` whose texts' shingle sets have at least that Jaccard similarity. A second sketch beside the fingerprint, ROUNDS * 64
minimum hashes of one bit each, estimates a pair's similarity: pairs whose estimate is more than SPREADS standard deviations below ``least``
(at that similarity one pair in some hundred thousand) can't be links. What the other pairs join is a family: the groups return spanning forests of them, so every link lies in one family.
Then a family's shingle sets meet, each sent once (families of more than BLOCK_ROWS rows or BLOCK_SHINGLES shingles are cut into blocks, and after the blocks themselves
pairs of blocks meet), and all its pairs that no link has joined yet are compared exactly, those of its middle first, where the copies of one text meet. A spanning forest of the links comes
out, so no pair that could join two components is passed over, and no table of pairs is written. With ``size_ratio`` pairs must also have shingle counts within that ratio: fingerprints are
dealt to logarithmic size bands first, and visit the bands below that the ratio reaches. Without pruning (a large radius) the work is quadratic within a
band, spread evenly over tasks.

Edge cases: null, empty and wordless texts have the zero fingerprint and link like any other. Fewer words than
a shingle: the whole sequence is one. Null ids are ignored as component names. Repeated rows get a result row each.
Extra input columns are ignored. Empty tables give empty results. Very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.llm.common import cut, join_unique
from spikeloom.llm.components import components


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Further 64 bits of hashes, by the finalizer of SplitMix64."""
    z = h + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, width: int, seeds: tuple[int, ...]) -> np.ndarray:
    """[shingles, seeds]: XXH64 of the space-joined shingles, repeats included, with the first seed; the others mix it further."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros((0, len(seeds)), np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(width, len(words))
    at = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest, first = xxhash.xxh64_intdigest, seeds[0]
    h = np.fromiter((digest(joined[s:e], first) for s, e in at), np.uint64, len(words) - k + 1)
    return np.stack([h, *(mixed(h, seed) for seed in seeds[1:])], axis=1)


#: Hash rounds of the second sketch, each with 64 bins; how far below the wanted similarity an estimate may lie, in standard deviations.
ROUNDS, SPREADS = 8, 4.5
#: Fingerprints of a group by which the middle of its families is found.
CENTRES = 256


def minimum_sketch(h: np.ndarray) -> bytes:
    """Of distinct shingle hashes: for each round, 64 bins' lowest bits of the least hash in them, and which bins have any."""
    out = np.zeros(2 * ROUNDS, np.uint64)
    if len(h):
        for r in range(ROUNDS):
            z = mixed(h, 1000 + r)
            at, least = (z >> np.uint64(58)).astype(np.int64), np.full(64, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, at, z)
            full = np.zeros(64, bool)
            full[at] = True
            out[r], out[ROUNDS + r] = (np.packbits(x).view(">u8")[0] for x in ((least & np.uint64(1)).astype(bool) & full, full))
    return out.astype("<u8").tobytes()


def estimated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarities of sketches [n, 2 * ROUNDS], and the variances of the estimates at 0.8. Bins that both have agree where the least hashes do, and in half of the others."""
    both = a[:, ROUNDS:] & b[:, ROUNDS:]
    shared = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    equal = np.bitwise_count(~(a[:, :ROUNDS] ^ b[:, :ROUNDS]) & both).sum(axis=1, dtype=np.int64)
    any_ = np.maximum(1, np.bitwise_count(a[:, ROUNDS:] | b[:, ROUNDS:]).sum(axis=1, dtype=np.int64))
    return (2 * equal - shared) / any_, 0.36 / any_


def likely(a: np.ndarray, b: np.ndarray, sketch: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs may have the similarity ``least``."""
    found, variance = estimated(sketch[a], sketch[b])
    return found >= least - SPREADS * np.sqrt(variance)


def centrality(fps: np.ndarray, order: np.ndarray, radius: int) -> np.ndarray:
    """Mean distance of each fingerprint to CENTRES fixed ones of the group, none counting for more than just outside the radius: low in the middle of a family that is a large part of its group."""
    centres = fps[np.argsort(order, kind="stable")[:CENTRES]]
    out = np.zeros(len(fps))
    for i in range(0, len(fps), 1 << 12):
        out[i : i + (1 << 12)] = np.minimum(distance(fps[i : i + (1 << 12), None], centres[None]), radius + 1).mean(axis=1)
    return out


def fingerprint(text: str | None, width: int, seeds: tuple[int, ...] = (42,), distinct: bool = False) -> tuple[list[int], int, int, bytes]:
    """The signed 64-bit words of the fingerprint, one for each seed, the number of shingles, and with ``distinct``, where each
    shingle counts once, a hash of their set (else 0) and their second sketch (else nothing)."""
    h = shingle_hashes(text, width, seeds)
    if not len(h):
        return [0] * len(seeds), 0, 0, bytes(16 * ROUNDS if distinct else 0)
    of_set, sketch = 0, b""
    if distinct:
        once, at = np.unique(h[:, 0], return_index=True)
        h, of_set = h[at], int(np.uint64(xxhash.xxh64_intdigest(once.tobytes())).astype(np.int64))
        sketch = minimum_sketch(once)
    votes = np.zeros(64 * len(seeds), np.int64)
    for i in range(0, len(h), 16384):
        votes += np.unpackbits(h[i : i + 16384].byteswap().view(np.uint8).reshape(-1, 8 * len(seeds)), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(h)).view(">i8").tolist(), len(h), of_set, sketch


def fingerprints(docs: DataFrame, width: int, seeds: tuple[int, ...] = (42,), id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """doc_id, text_key, f0, f1, ... (the words of the fingerprint as bigint), n_shingles, set_key, and with ``distinct`` sketch."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
    schema = T.StructType([*src.schema.fields[:2], *(T.StructField(f"f{w}", T.LongType()) for w in range(len(seeds))), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.LongType()), *([T.StructField("sketch", T.BinaryType())] if distinct else [])])

    def run(batches):
        for b in batches:
            got = [fingerprint(x.as_py(), width, seeds, distinct) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([g[0][w] for g in got], pa.int64()) for w in range(len(seeds))), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), *([pa.array([g[3] for g in got], pa.binary())] if distinct else [])], names=schema.names)

    return src.mapInArrow(run, schema)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints [..., words]."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def grow(sample: np.ndarray, total: int, radius: int, leaf: int, seed: int = 0) -> list[tuple]:
    """Tree as a list of nodes: (vantage, mu, inside, outside), or the number of a leaf.

    sample: distinct fingerprints [n, words] out of ``total``. A node splits while it stands for more
    than ``leaf`` fingerprints and the split saves at least a tenth of the comparisons.
    """
    rng, nodes, leaves = np.random.default_rng(seed), [], 0
    todo, scale = [(sample, 0, None, None)], total / max(1, len(sample))
    while todo:
        own, visitors, parent, side = todo.pop()
        at, best = len(nodes), None
        if parent is not None:
            nodes[parent][side] = at
        if len(own) * scale > leaf and len(own) >= 8:
            for v in own[rng.choice(len(own), min(8, len(own)), replace=False)]:
                d = distance(own, v)
                near, over = np.bincount(d, minlength=1), None
                inside = np.cumsum(near)
                for mu in range(len(near) - 1):
                    a, b = inside[mu], len(own) - inside[mu]
                    over = inside[min(mu + radius, len(inside) - 1)] - inside[mu]
                    if min(a, b) * 8 >= len(own):
                        work = a * (a / 2 + over) + b * b / 2
                        if best is None or work < best[0]:
                            best = (work, v, mu, d)
        if best is not None and best[0] < 0.9 * len(own) ** 2 / 2:
            _, v, mu, d = best
            nodes.append([v, mu, None, None])
            todo += [(own[d <= mu], 0, at, 2), (own[d > mu], 0, at, 3)]
        else:
            nodes.append(leaves)
            leaves += 1
    return nodes


def shards(nodes: list, fps: np.ndarray, radius: int, at_home: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) for the home of each fingerprint and all shards it visits; without ``at_home`` it only visits."""
    rows, where, homes = [], [], []
    todo = [(0, np.arange(len(fps)), np.full(len(fps), at_home))]
    while todo:
        k, at, home = todo.pop()
        if not len(at):
            continue
        node = nodes[k]
        if isinstance(node, int):
            rows.append(at), where.append(np.full(len(at), node)), homes.append(home)
            continue
        v, mu, inside, outside = node
        d = distance(fps[at], v)
        # a visitor may have partners on both sides, within the radius
        low = d <= mu + radius
        high = (d > mu) | (~home & (d > mu - radius))
        todo.append((inside, at[low], home[low] & (d[low] <= mu)))
        todo.append((outside, at[high], home[high]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, where, homes))


def within(fps: np.ndarray, home: np.ndarray, radius: int, size: np.ndarray | None = None, ratio: float | None = None, side: np.ndarray | None = None):
    """Yields (a, b, distance) of the pairs (home, any) within ``radius``, each home's in one piece.

    Pairs lie within the rows, or with ``side`` (0 or 1 for each row) between rows of different sides; a row and itself are a pair of the former.
    """
    for own_side in (None,) if side is None else (0, 1):
        others = np.arange(len(fps)) if side is None else np.flatnonzero(side != own_side)
        own = np.flatnonzero(home if side is None else home & (side == own_side))
        if ratio:
            others, own = others[np.argsort(size[others], kind="stable")], own[np.argsort(size[own], kind="stable")]
        ranked, sizes, n = fps[others], size[others] if ratio else None, len(others)
        step = max(1, (1 << 20) // max(1, n))
        for i in range(0, len(own) if n else 0, step):
            rows = own[i : i + step]
            lo, hi = 0, n
            if ratio:  # only fingerprints whose sizes are within the ratio
                lo = int(np.searchsorted(sizes, np.floor(size[rows[0]] * ratio)))
                hi = int(np.searchsorted(sizes, np.ceil(size[rows[-1]] / ratio), side="right"))
            near = np.bitwise_count(fps[rows, None, 0] ^ ranked[None, lo:hi, 0])
            for w in range(1, fps.shape[1]):
                near += np.bitwise_count(fps[rows, None, w] ^ ranked[None, lo:hi, w])
            x, y = np.nonzero(near <= radius)
            a, b, d = rows[x], others[y + lo], near[x, y]
            if ratio:
                fits = np.minimum(size[a], size[b]) >= ratio * np.maximum(size[a], size[b])
                a, b, d = a[fits], b[fits], d[fits]
            yield a, b, d


#: Pairs that are taken up at once, so that later ones of joined rows need no test.
PIECE = 1 << 14


def forest(n: int, pairs, test=None) -> np.ndarray:
    """For each of ``n`` rows the index of its component's representative, over the pairs of within() that ``test`` (of a, b) lets pass."""
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for all_a, all_b, _ in pairs:
        for i in range(0, len(all_a), PIECE):
            a, b = all_a[i : i + PIECE], all_b[i : i + PIECE]
            apart = root[a] != root[b]
            if test is not None and apart.any():
                apart[apart] = test(a[apart], b[apart])
            if apart.any():
                for p, q in np.unique(np.stack([root[a[apart]], root[b[apart]]], axis=1), axis=0).tolist():
                    p, q = find(p), find(q)
                    root[max(p, q)] = min(p, q)
                while not np.array_equal(flat := root[root], root):
                    root[:] = flat
    return root


#: Size bands for each factor of ``size_ratio``.
BANDS = 2
#: Of a block of a family whose pairs are compared exactly.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 19
GROUP = ["shard", "low", "high"]


def deal_out(distinct: DataFrame, radius: int, words: int, sample_rows: int = 1 << 20, leaf: int = 4096, block: int = 65536, size_ratio: float | None = None) -> DataFrame:
    """key, f0, f1, ..., size, (sketch,) shard, low, high, own, home: in the groups (shard, low, high) every pair within ``radius`` meets at the home of one of the two.

    A shard's rows are hashed to blocks of about ``block`` rows, and each pair of blocks (low <= high) is a group; own is the row's block. Pairs of rows count
    in the group of their two blocks only, and so once. distinct: key (unique), f0, f1, ... (bigint words), size (bigint). The tree
    is grown from fingerprints that a hash picks, one in 16, at most ``sample_rows`` of them; every fingerprint takes part in the search.
    """
    spark, fp = distinct.sparkSession, [f"f{w}" for w in range(words)]
    total = distinct.count()
    share = min(1 / 16, sample_rows / max(1, total))
    picked = distinct.where(F.shiftrightunsigned(F.xxhash64("key"), 11) < share * float(1 << 53)).select("key", *fp).toPandas().sort_values("key", kind="stable")
    tree = spark.sparkContext.broadcast(grow(picked[fp].to_numpy(np.int64).view(np.uint64), total, radius, leaf))  # fewer nodes than the sample has rows
    more = ["sketch"] * ("sketch" in distinct.columns)
    names, schema = ["key", *fp, "size", *more], f"key {distinct.schema['key'].dataType.simpleString()}, {', '.join([*(f'{c} bigint' for c in [*fp, 'size']), *(f'{c} binary' for c in more)])}"

    def deal(batches):
        for b in batches:
            fps = np.stack([b.column(1 + w).to_numpy(zero_copy_only=False) for w in range(words)], axis=1).view(np.uint64)
            parts = [(*shards(tree.value, fps, radius), 0)]
            if size_ratio:  # a partner is at most BANDS bands away: the smaller one is at home
                visits = shards(tree.value, fps, radius, at_home=False)
                parts += [(*visits, k) for k in range(1, BANDS + 1)]
            for rows, where, homes, back in parts:
                taken = b.take(pa.array(rows))
                band = np.zeros(len(rows), np.int64)
                if size_ratio:
                    size = taken.column(words + 1).to_numpy(zero_copy_only=False)
                    band = np.floor(np.log(np.maximum(size, 1)) * BANDS / -np.log(size_ratio)).astype(np.int64) - back
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(band << 32 | where), pa.array(homes)], names=[*names, "shard", "home"])

    dealt = cut(distinct.select(*names).mapInArrow(deal, f"{schema}, shard bigint, home boolean"))
    blocks = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.max("home").alias("used")).where("used").drop("used")
    spread = dealt.join(blocks, "shard").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(*names, "shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "home")


def pairs_in(pdf: pd.DataFrame, fp: list[str], radius: int, size_ratio: float | None):
    """The pairs of one group of deal_out()."""
    side = None if pdf["low"].iloc[0] == pdf["high"].iloc[0] else (pdf["own"].to_numpy() == pdf["high"].to_numpy()).astype(np.int8)
    return within(pdf[fp].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool), radius, pdf["size"].to_numpy(), size_ratio, side)


def link(distinct: DataFrame, radius: int, words: int, size_ratio: float | None = None, least: float | None = None, **options) -> DataFrame:
    """Links (a, b) of keys that span the components of the fingerprints within ``radius``; ``distinct`` and options as in deal_out(). With ``least`` only pairs count whose
    sketches don't exclude that similarity."""
    fp, kind = [f"f{w}" for w in range(words)], distinct.schema["key"].dataType.simpleString()

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        keys, test = pdf["key"].to_numpy(), None
        if least:
            sketch = np.frombuffer(b"".join(pdf["sketch"]), "<u8").reshape(len(pdf), -1)
            test = lambda a, b: likely(a, b, sketch, least)
        to = forest(len(pdf), pairs_in(pdf, fp, radius, size_ratio), test)
        return pd.DataFrame({"a": keys, "b": keys[to]})[to != np.arange(len(to))]

    spread = deal_out(distinct, radius, words, size_ratio=size_ratio, **options)
    return spread.groupBy(*GROUP).applyInPandas(span, f"a {kind}, b {kind}").where("a <> b").distinct()


def alike(fps: np.ndarray, size: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], radius: int, ratio: float | None, least: float, root: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links of rows that join all components of ``root`` which pairs within ``radius`` and the size ratio join whose shingle sets have a similarity of at least ``least``.

    Pairs of rows of one side count, if there is but one side, else pairs of rows of different sides.
    """
    order = np.argsort(centrality(fps, np.arange(len(fps)), radius), kind="stable")
    fps, size, sketch, root, side = fps[order], size[order], sketch[order], np.unique(root[order], return_inverse=True)[1], side[order]
    lengths = np.array([len(sets[i]) for i in order.tolist()])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    distinct, ids = np.unique(np.concatenate([sets[i] for i in order.tolist()]), return_inverse=True)
    mask, two_sided, out = np.zeros(len(distinct), bool), side.any() and not side.all(), []
    for i in range(len(fps) - 1):
        to = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        if two_sided:
            to = to[side[to] != side[i]]
        to = to[distance(fps[to], fps[i]) <= radius]
        if ratio:
            to = to[np.minimum(size[to], size[i]) >= ratio * np.maximum(size[to], size[i])]
        if not len(to):
            continue
        to = to[likely(np.full(len(to), i), to, sketch, least)]
        many = lengths[to]
        upto = np.cumsum(many)
        mask[ids[starts[i] : ends[i]]] = True
        hits = np.r_[0, np.cumsum(mask[ids[np.repeat(starts[to] - upto + many, many) + np.arange(many.sum())]])]
        mask[ids[starts[i] : ends[i]]] = False
        shared = hits[upto] - hits[upto - many]
        to = to[shared / np.maximum(1, lengths[i] + many - shared) >= least]
        if len(to):
            joined, first = np.unique(root[to], return_index=True)
            out += [(int(order[i]), int(order[k])) for k in to[first].tolist()]
            root[np.isin(root, joined)] = root[i]
    return out


def checked_links(groups: DataFrame, docs: DataFrame, width: int, radius: int, words: int, least: float, size_ratio: float | None = None, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """Links (a, b) of keys that span the components of the pairs within ``radius`` whose texts have a Jaccard similarity of at least ``least``.

    groups: key, f0, f1, ..., size, sketch, rep (doc_id, text_key), the document that stands for a fingerprint. docs: doc_id, text.
    """
    fp, kind = [f"f{w}" for w in range(words)], groups.schema["key"].dataType.simpleString()
    families = cut(components(link(groups.select("key", *fp, "size", "sketch"), radius, words, size_ratio, least, **options)).toDF("key", "family"))
    rows = cut(families.join(groups.select("key", *fp, "size", "sketch"), "key").join(sets_of(families.select("key"), groups, docs, width), "key"))
    blocks = rows.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_rows, F.sum(F.length("shingles")) / (8 * BLOCK_SHINGLES))).cast("int").alias("blocks"), F.sum(F.length("shingles")).alias("bytes"))
    blocks = cut(blocks)
    total, most = (x or 0 for x in blocks.agg(F.sum("bytes"), F.max("blocks")).first())
    # small families share a group of the size of a block
    bins = 1 + total // (8 * BLOCK_SHINGLES)
    dealt = rows.join(blocks.drop("bytes"), "family").withColumns({"bin": F.pmod(F.xxhash64("family"), F.lit(bins)), "own": F.pmod(F.xxhash64("key"), F.greatest("blocks", F.lit(1))).cast("int")})

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.sort_values(["family", "key"], kind="stable").groupby("family", sort=False):
            if len(own) > 1:
                keys, sketch = own["key"].to_list(), np.frombuffer(b"".join(own["sketch"]), "<u8").reshape(len(own), -1)
                sets = [np.frombuffer(x, "<u8") for x in own["shingles"]]
                found = alike(own[fp].to_numpy(np.int64).view(np.uint64), own["size"].to_numpy(), sketch, sets, radius, size_ratio, least, pd.factorize(own["root"])[0], own["own"].to_numpy() == own["high"].iloc[0])
                out += [(keys[a], keys[b]) for a, b in found]
        return pd.DataFrame(out, columns=["a", "b"])

    def checked(rows: DataFrame) -> DataFrame:
        return cut(rows.select("family", "key", *fp, "size", "sketch", "shingles", "bin", "low", "high", "own", "root").groupBy("bin", "low", "high").applyInPandas(check, f"a {kind}, b {kind}"))

    kept = checked(dealt.withColumns({"low": F.col("own"), "high": F.col("own"), "root": F.col("key")}))
    if most > 1:  # pairs of blocks, whose rows know what their own block has joined
        roots = cut(components(kept).toDF("key", "_root"))
        pairs = dealt.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> own")
        pairs = pairs.join(roots, "key", "left").withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "root": F.coalesce("_root", "key")})
        kept = kept.union(checked(pairs))
    return kept


def shingle_set(text: str | None, width: int) -> set[int]:
    return set(shingle_hashes(text, width, (42,))[:, 0].tolist())


def likeness(x: set[int], y: set[int]) -> float:
    return len(x & y) / len(x | y) if x or y else 1.0


def jaccard(a: str | None, b: str | None, width: int) -> float:
    return likeness(shingle_set(a, width), shingle_set(b, width))


def sets_of(keys: DataFrame, groups: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(key, shingles) of fingerprints: the distinct hashes of the text that stands for each, 8 bytes each."""
    reps = groups.join(keys, "key").select("key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_text"))
    texts = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.xxhash64("text") == F.col("rep_text")))
    once = texts.groupBy("key").agg(F.any_value("text").alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(x.as_py(), width, (42,))).astype("<u8").tobytes() for x in b.column(1)], pa.binary())], names=["key", "shingles"])

    return once.select("key", "text").mapInArrow(run, f"key {groups.schema['key'].dataType.simpleString()}, shingles binary")


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 46, seeds: tuple[int, ...] = (42, 43, 44), size_ratio: float | None = 0.8, least: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text_key, f0, f1, ... (the fingerprint's words), n_shingles, component (a key, never null), component_id (its least id).

    With ``least`` links are checked against the texts, and only those with that Jaccard similarity count; repeats of a shingle
    don't count then, in fingerprints, n_shingles and sizes, and texts with the same shingle set are one.
    """
    fp = [f"f{w}" for w in range(len(seeds))]
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = cut(fingerprints(src, width, seeds, distinct=bool(least)))
    same = [*fp, "n_shingles", "set_key"] if least else [*fp, "n_shingles"] if size_ratio else fp
    # one row for each distinct fingerprint, with the least id it occurs with
    groups = prints.groupBy(*same).agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count(F.lit(1)).alias("rows"), *([F.any_value("sketch").alias("sketch")] if least else []))
    whole = F.concat(*(F.unhex(F.lpad(F.hex(c), 16, "0")) for c in same))  # all words: nothing is told apart by a shorter hash
    groups = cut(groups.withColumn("key", whole if len(same) > 1 else F.col("f0")))
    sized = groups.withColumn("size", F.col("n_shingles" if size_ratio else "rows"))
    if least:
        links = checked_links(sized, src, width, radius, len(seeds), least, size_ratio, **options)
    else:
        links = link(sized.select("key", *fp, "size"), radius, len(seeds), size_ratio=size_ratio, **options)
    named = groups.join(components(links), F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("root", "key"))
    linked = named.where("node IS NOT NULL")
    least_id = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = linked.join(least_id, "root").select(*same, "rows", "component", "component_id").union(named.where("node IS NULL").select(*same, "rows", "component", "first"))
    return join_unique(prints.drop("sketch", *{"set_key"} - {*same}), cut(classes), same, "rows").select("doc_id", "text_key", *fp, "n_shingles", "component", "component_id")
