"""Helpers that the operators share: table access, lineage cuts and per-worker caches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names for the cluster.

    Where it is unset, a single-process session (``local[...]``, as in tests) gets a temporary folder; on a cluster that is an
    error, because executors couldn't read each other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spikeloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there; a table takes less disk than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def join_unique(big: DataFrame, unique: DataFrame, keys: list[str], rows: str, share: int = 1000) -> DataFrame:
    """``big`` joined with ``unique``, whose keys are unique and whose column ``rows`` says how many rows of ``big`` have them.

    Keys with more than 1/share of all rows (fewer than ``share`` keys, whatever the data) are broadcast, so that no
    task has to take such a key; the other keys are shuffled.
    """
    most = F.lit((unique.agg(F.sum(rows)).first()[0] or 0) // share)
    hot, rest = unique.where(F.col(rows) > most).drop(rows), unique.where(F.col(rows) <= most).drop(rows)
    spread = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return big.join(F.broadcast(hot), keys).unionByName(spread)


class WorkerCache(dict):
    """Bounded memo of a pure function; two generations, so that frequent keys stay.

    It lives as long as the Python worker, so later tasks of the same worker find it filled. Keys longer than LONGEST are computed
    each time, so ``limit`` bounds its bytes, too.
    """

    LONGEST = 64

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.compute(key)
        got = self.old.get(key)
        if got is None:
            got = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


_workers: dict = {}


def per_worker(key, make, most: int = 1):
    """``make()`` once for each Python worker and key; a worker holds the ``most`` last used ones, so stages don't pile up their tools."""
    found = _workers.pop(key, None)
    if found is None:
        found = make()
    while len(_workers) >= most:
        _workers.pop(next(iter(_workers)))
        gc.collect()  # tools and their memos hold each other
    _workers[key] = found
    return found
