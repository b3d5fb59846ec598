"""URL filters: a blocked Bloom filter in front of an exact join.

A rule lists a canonical URL prefix (host, path, verdict). It fits a URL whose host is the rule's host or a
subdomain of it and whose path starts with the rule's path; the longest rule wins. A URL that no rule fits
gets the default verdict of the method: it isn't listed, so it is allowed.

A URL has few candidate keys: each suffix of its host at a label boundary, combined with each prefix of its
path whose length occurs among the rules. The keys of all rules fill a blocked Bloom filter (one 512-bit
block and eight bits for each key) that is built in parts and OR-ed, at most ``max_filter_bytes`` long, so
its broadcast is bounded. URLs without a candidate that passes are judged at once and never shuffled. Candidates that pass go to an exact
hash join with the rules, which removes the false positives. Few rules are broadcast for that join; more are replicated ``salts`` times and shuffled with
salted candidates, so a rule that fits a third of all URLs doesn't meet one task.

Edge cases: a null URL or one without ``://`` has an empty host and path and no rule. Rules with null host or path are
ignored; repeated rules count once, with block before allow. Equally long rules: the longer host wins, then
block. Ties among repeated URL rows: each row is judged by itself. Extra input
columns are kept, whatever their names (columns named host, path, rule or verdict are replaced). Very long URLs are judged whole.
Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.llm.common import cut, join_unique

WORDS = 8  # 64-bit words in a block
MULTIPLIERS = np.array([2 * i * 0x1E3779B97F4A7C15 + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for i in range(WORDS)], np.uint64)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #``, lower-cased A-Z; then up to ``? #``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def bloom_bits(h: np.ndarray) -> np.ndarray:
    """The masks [n, WORDS] of hashes: one bit in each word of the block."""
    with np.errstate(over="ignore"):
        return np.uint64(1) << ((h[:, None] * MULTIPLIERS[None, :]) >> np.uint64(58))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def build_bloom(keys: DataFrame, blocks: int) -> np.ndarray:
    """keys: one bigint column of key hashes. Returns words [blocks, WORDS]; partial filters are OR-ed by block."""
    def partial(batches):
        words, used = np.zeros((blocks, WORDS), np.uint64), np.zeros(blocks, bool)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = block_of(h, blocks)
            np.bitwise_or.at(words, at, bloom_bits(h))
            used[at] = True
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(words[at, i].view(np.int64)) for i in range(WORDS))], names=names)

    names = ["block", *(f"w{i}" for i in range(WORDS))]
    parts = keys.mapInArrow(partial, T.StructType([T.StructField(n, T.LongType()) for n in names]))
    words = np.zeros((blocks, WORDS), np.uint64)
    got = parts.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names[1:])).toPandas()
    words[got["block"].to_numpy(np.int64)] = got[names[1:]].to_numpy(np.int64).view(np.uint64)
    return words


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_filter_bytes: int = 1 << 24, broadcast_rules: int = 100_000, salts: int = 32) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    rules: host, path, verdict (block or allow), hosts in lower case.
    """
    spark = pages.sparkSession
    listed = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.max(F.col("verdict")).alias("verdict"))
    n_rules, lengths = listed.count(), sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())  # as many as path lengths
    depths = sorted(r[0] for r in listed.select(F.size(F.split("host", r"\.")).alias("d")).distinct().collect())  # as many as label counts
    host, path = split_url(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    out = pages.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"))
    named = [F.col("row").getField(c).alias(c) for c in kept]
    unlisted = F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
    if not n_rules:
        return out.select(*named, "host", "path", *unlisted)
    blocks = max(1, min(max_filter_bytes // (8 * WORDS), 1 << int(np.ceil(np.log2(max(1, n_rules / 32))))))
    shipped = spark.sparkContext.broadcast(build_bloom(listed.select(F.xxhash64("host", "path").alias("h")), blocks))

    @F.pandas_udf("array<boolean>")
    def may_contain(hashes):
        words = shipped.value
        sizes = hashes.str.len().to_numpy()
        h = (np.concatenate(hashes.to_list()) if len(hashes) else np.empty(0)).astype(np.int64).view(np.uint64)
        mask = bloom_bits(h)
        ok = ((words[block_of(h, blocks)] & mask) == mask).all(axis=1)
        return type(hashes)(np.split(ok, np.cumsum(sizes)[:-1])) if len(sizes) else hashes

    # only suffixes of as many labels as some rule has, so a host of very many labels stays cheap
    parts = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    suffixes = F.filter(F.array(*(F.when(parts >= d, F.substring_index("host", ".", -d)) for d in depths)), lambda s: s.isNotNull())
    prefixes = F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.when(F.col("host") != "", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("k_host"), p.alias("k_path"))))))
    keys = F.coalesce(keys, F.array().cast("array<struct<k_host:string,k_path:string>>"))
    tried = out.withColumn("keys", keys).withColumn("ok", may_contain(F.transform("keys", lambda k: F.xxhash64(k["k_host"], k["k_path"]))))
    hits = F.transform(F.filter(F.arrays_zip("keys", "ok"), lambda z: z["ok"]), lambda z: z["keys"])
    tried = cut(tried.select("row", "host", "path", hits.alias("hits")))
    plain = tried.where(F.size("hits") == 0).select(*named, "host", "path", *unlisted)  # never shuffled

    # the exact join works on distinct (host, path); map-side counting absorbs repeated URLs
    possible = tried.where(F.size("hits") > 0)
    urls = cut(possible.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"), F.any_value("hits").alias("hits")))
    passed = urls.select("host", "path", F.explode("hits").alias("k")).select("host", "path", "k.*")
    exact = listed.select(F.col("host").alias("k_host"), F.col("path").alias("k_path"), "verdict")
    if n_rules <= broadcast_rules:
        found = passed.join(F.broadcast(exact), ["k_host", "k_path"])
    else:
        salted = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = passed.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")).join(salted, ["k_host", "k_path", "salt"])
    rank = F.struct((F.length("k_host") + F.length("k_path")).alias("n"), F.length("k_host").alias("h"), "verdict", F.concat("k_host", "k_path").alias("rule"))
    best = cut(urls.drop("hits").join(found.groupBy("host", "path").agg(F.max(rank).alias("best")), ["host", "path"], "left"))
    judged = join_unique(possible.drop("hits"), best, ["host", "path"], "rows")  # a common page is broadcast, so it meets no single task
    judged = judged.select(*named, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(plain)
