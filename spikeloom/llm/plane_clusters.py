"""Centroid clustering of quantized vectors by bit planes.

Components become integers floor(scale * x). A vector of ``components`` integers is packed by bit planes: plane j is one unsigned 64-bit word
(for 64 components) that holds bit j of each component in two's complement. A dot product is then exact and needs no multiplication of components:
the sum over pairs of planes of popcount(plane i AND plane j), weighted by 2^(i + j), negative where one of the two is a sign plane. Squared distances
follow from dot products, and sums of vectors from counts of set bits.

1. One aggregate finds the greatest magnitude, which sets the number of planes, and the vectors are packed once into a table.
2. Centroids start as the vectors whose salted hash of the id is least; they alone (k rows) are on the driver.
3. A round reads the packed table: each task assigns its vectors and sums them by cluster; at most k * components partial sums leave a task.
   Centroids become floors of means in whole numbers, so results don't depend on partitions or on the order of summation.
4. After the last round the vectors are assigned once more, and inertias are summed.

No step shuffles vectors, so neither a cluster nor an id that holds most rows makes a large task.

Edge cases: vectors that are null, of another length, or that have null or non-finite components are left out. A null id counts as the empty text in the hash, ties of the hash
are broken by the components; repeated rows are vectors of their own. With fewer vectors than ``k`` there are as many centroids as vectors; without any the result
is empty. Components of 2^20 and more in magnitude raise an error, because exact squared distances would leave 64 bits. Extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.llm.common import cut

#: Components at most this large have distances within 64 bits.
LARGEST = 2.0**20
#: Vectors handled at once.
BLOCK = 8192


def pack(ints: np.ndarray, width: int) -> np.ndarray:
    """[n, width] words of the bit planes of integers [n, 64]; component 0 is the highest bit of a word."""
    bits = (ints[:, None, :] >> np.arange(width)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def unpack(planes: np.ndarray) -> np.ndarray:
    """[n, width, 64] bits of planes [n, width]."""
    return np.unpackbits(planes.astype(">u8")[:, :, None].view(np.uint8), axis=2)


def weights(width: int) -> np.ndarray:
    """Of the planes: powers of two, the sign plane's negative."""
    return np.array([1 << j for j in range(width - 1)] + [-(1 << width - 1)], np.int64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[n, k] exact dot products of packed vectors [n, width] with packed vectors [k, width]."""
    w, out = weights(a.shape[1]), np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            out += np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(np.int64) * (w[i] * w[j])
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """[n] exact squared norms."""
    w, out = weights(a.shape[1]), np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        out += np.bitwise_count(a[:, i]).astype(np.int64) * (w[i] * w[i])
        for j in range(i):
            out += np.bitwise_count(a[:, i] & a[:, j]).astype(np.int64) * (2 * w[i] * w[j])
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the first among equals, and its squared distance."""
    d = squares(planes)[:, None] - 2 * dots(planes, centroids) + squares(centroids)[None, :]
    at = d.argmin(axis=1)
    return at, d[np.arange(len(d)), at]


def planes_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), width)


def usable(vectors: DataFrame, components: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (array of double) of the vectors that take part."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.size("vector") == components)
    return own.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)))


def packed(own: DataFrame, width: int, scale: float) -> DataFrame:
    """vec_id and planes (binary, ``width`` little-endian words)."""
    schema = T.StructType([own.schema["vec_id"], T.StructField("planes", T.BinaryType())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                raw = pack(np.floor(scale * x).astype(np.int64), width).astype("<u8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in raw], pa.binary())], names=schema.names)

    return own.mapInArrow(run, schema)


def sums(table: DataFrame, centroids: np.ndarray, components: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sums of their components, by nearest centroid; of clusters that have any."""
    k, width = centroids.shape

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, components), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                planes = planes_of(b.column(0).slice(at, BLOCK), width)
                to, _ = nearest(planes, centroids)
                for c in np.unique(to):
                    own = unpack(planes[to == c]).sum(axis=0, dtype=np.int64)
                    n[c] += (to == c).sum()
                    total[c] += weights(width) @ own
        c, i = np.repeat(np.flatnonzero(n), components), np.tile(np.arange(components), (n > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(n[c]), pa.array(total[c, i])], names=["c", "i", "n", "total"])

    found = table.select("planes").mapInArrow(run, "c int, i int, n bigint, total bigint").groupBy("c", "i").agg(F.sum("n"), F.sum("total")).collect()  # at most k * components rows
    out: dict[int, tuple[int, list[int]]] = {}
    for c, i, n, total in found:
        out.setdefault(c, (n, [0] * components))[1][i] = total
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: float = 64.0, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia; and the final centroids, integers by component.

    Vectors have 64 components. A centroid that is nearest to no vector stays where it is.
    """
    spark, components = vectors.sparkSession, 64
    own = usable(vectors, components, id_col, vector_col)
    most = own.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    if most >= LARGEST:
        raise ValueError(f"a component of magnitude {most:g} is beyond {LARGEST:g}")
    width = (math.floor(scale * most) + 1).bit_length() + 1
    table = cut(packed(own, width, scale))
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    if not (start := own.select(by_hash.alias("h"), F.transform("vector", lambda x: F.floor(F.lit(scale) * x)).alias("x")).orderBy("h", "x").limit(k).collect()):
        return table.select("vec_id", *(F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint")))), []
    centroids = [[int(v) for v in r["x"]] for r in start]
    for _ in range(rounds):
        for c, (n, total) in sums(table, pack(np.array(centroids), width), components).items():
            centroids[c] = [t // n for t in total]
    at = pack(np.array(centroids), width)
    schema = T.StructType([table.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def assign(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                to, d = nearest(planes_of(part.column(1), width), at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(to, pa.int32()), pa.array(d)], names=schema.names)

    assigned = cut(table.mapInArrow(assign, schema))
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    by_cluster = spark.createDataFrame([(c, s, sum(inertia.values())) for c, s in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint")
    return assigned.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
