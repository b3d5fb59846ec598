import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spikeloom.llm import plane_clusters, queries


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 27), st.integers(0, 2**32 - 1))
def test_products_of_planes(width, seed):
    rng = np.random.default_rng(seed)
    low, high = -(1 << width - 1), (1 << width - 1) - 1
    a, b = (rng.choice([low, high, 0, -1, int(rng.integers(low, high + 1))], (5, 64)) for _ in range(2))
    pa, pb = plane_clusters.pack(a, width), plane_clusters.pack(b, width)
    assert (plane_clusters.weights(width) @ plane_clusters.unpack(pa).astype(np.int64) == a).all()
    exact = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    assert plane_clusters.dots(pa, pb).tolist() == exact
    assert plane_clusters.squares(pa).tolist() == [sum(int(x) ** 2 for x in u) for u in a]
    if width <= 27:
        to, d = plane_clusters.nearest(pa, pb)
        all_ = [[sum((int(x) - int(y)) ** 2 for x, y in zip(u, v, strict=True)) for v in b] for u in a]
        assert d.tolist() == [min(x) for x in all_] and to.tolist() == [x.index(min(x)) for x in all_]


def brute(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((i, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centroids)):
            if mine := [v for _, to, _, v in own if to == c]:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own, by = assign(), {}
    for _, c, d, _ in own:
        by[c] = by.get(c, 0) + d
    return sorted(((i, c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d, _ in own), key=str)


@pytest.mark.parametrize("case", ["some", "hot", "few", "none"])
def test_clusters_against_brute_force(spark, tmp_path, case):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=64).round(3).tolist()) for i in range({"few": 5, "none": 0}.get(case, 150))]
    rows += [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] + [0.5] * 63), (904, [0.5] * 63 + [float("inf")]), (905, [])]
    if case == "hot":  # a vector, an id and a null id that many rows have
        rows += [(7, rows[7][1])] * 60 + [(i, [0.25] * 64) for i in range(1000, 1080)] + [(None, [x / 8 for x in range(64)])] * 3 + [(None, [-0.01] * 64), (5000, [1000.0, -1000.0] * 32)]
    schema = "vec_id bigint, embedding array<float>, cluster string, distance int, c int"  # columns with names of the operator's own
    spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op13_plane_clusters(spark, str(tmp_path)).collect()
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((tuple(r[c] for c in columns) for r in found), key=str) == brute(as_float)


def test_magnitudes_beyond_the_bound_are_an_error(spark):
    with pytest.raises(ValueError):
        plane_clusters.cluster(spark.createDataFrame([(1, [2.0**20] + [0.0] * 63)], "vec_id bigint, embedding array<double>"))
