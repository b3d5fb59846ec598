"""Packing of tokenized documents into fixed-length sequences by cutting-stock column generation.

1. Each document becomes token ids and an end id, cut into full pieces of ``capacity`` and a remainder. Full pieces
   are sequences of their own.
2. The remainders' lengths, rounded up to ``unit`` tokens, make a histogram of at most capacity / unit
   classes, which one small task gets. A linear program over cutting patterns is solved by column generation: a
   revised simplex method holds the master problem, and a knapsack dynamic program over the
   capacity prices new patterns with the dual values.
3. Pattern counts are rounded down; the few remainders left over are packed by first fit decreasing. The driver gets the patterns only.
4. Documents are ranked within their class (by length, then id) and the rank says which pattern, sequence and
   slot they get. Ranks come from hash buckets of bounded size with running offsets, so a class that holds a
   third of all rows isn't sorted in one task.

A sequence is padded to ``capacity`` unless its tokens are a power of two in number.

Edge cases: a null or empty text is the end id alone. Repeated rows are packed one by one. Very long texts give many
full pieces. Extra input columns are ignored by ``pieces`` and kept by ``pack``. An empty table gives an empty result. A text that
spells a special token has that token's id, as the tokenizers library gives it.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spikeloom.llm.common import WorkerCache, cut, per_worker

#: Code points on which all lower-casing, normalizing and splitting rules in use agree and whose white space is ASCII.
PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ſ]")
#: Among them, what the tokenizer splits off: runs of letters, single numerals, runs of others (without apostrophes, which join some endings).
LETTERS, NUMERALS = ("".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == kind) for kind in "LN")
SPLIT = re.compile(f"[{LETTERS}]+|[{NUMERALS}]|[^{LETTERS}{NUMERALS}\t-\r ]+").findall


#: The tokenizer's model takes bytes as characters: printable ones as they are, the others from 256 on.
BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by a tokenizer that never joins words across white space.

    What the tokenizer's model gives for a pre-token (or, in texts with apostrophes, the tokenizer for a chunk between white
    space) is kept in a bounded memo. Texts with code points outside PLAIN or with added tokens go to the tokenizer as they are.
    """

    def __init__(self, definition: str, memo: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.model = self.own.model
        self.memo, self.chunks = WorkerCache(self.piece, memo), WorkerCache(self.whole, memo // 10)

    def whole(self, text: str, chunk: bool = True) -> bytes:
        self.own.encode_special_tokens = chunk  # lower-casing a chunk must not make special tokens
        return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        own = text if text.isascii() else text.encode().decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.model.tokenize(own)]).tobytes()

    def encode(self, text: str) -> bytes:
        if PLAIN.search(text) or "<" in text and any(t in text for t in self.special):
            return self.whole(text, chunk=False)
        if "'" in text:
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        return b"".join(map(self.memo.__getitem__, SPLIT(text.lower())))


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and (with ``keep_ids``) the ids of each piece."""
    with open(path) as f:
        definition = f.read()  # a fixed vocabulary of a few megabytes
    shipped = docs.sparkSession.sparkContext.broadcast(definition)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    longs = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([src.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in longs), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tool = per_worker(("words", hash(definition_of := shipped.value)), lambda: WordTokenizer(definition_of))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, out, ids = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    raw = tool.encode(text or "") + end
                    for s in range(0, len(raw), 4 * capacity):
                        p = raw[s : s + 4 * capacity]
                        rows.append(i)
                        out.append((s // 4, len(p) // 4, zlib.crc32(p), len(raw) // 4))
                        if keep_ids:
                            ids.append(np.frombuffer(p, "<u4").astype(np.int32))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in columns), *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])], names=schema.names)

    return src.mapInArrow(run, schema)


#: Buckets of a class whose offsets are summed together.
OFFSETS = 4096


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern (count of each size 1..capacity) of greatest value, by dynamic programming."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        got = value[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(got.argmax())
        best[c], take[c] = (got[k], k + 1) if got[k] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        pattern[take[c]] += take[c] > 0
        c -= take[c] or 1
    return float(best[capacity]), pattern


def patterns(demand: np.ndarray, capacity: int, tolerance: float = 1e-6, rounds: int = 20_000) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often each is cut, covering ``demand`` (number of items of each size 0..capacity).

    Column generation from one-size patterns; stops when no pattern prices below its cost or the bound is met.
    """
    sizes = np.flatnonzero(demand[1:]) + 1
    m = len(sizes)
    if not m:
        return []
    n = demand[sizes].astype(float)
    columns = [np.eye(m)[i] * (capacity // s) for i, s in enumerate(sizes)]
    cost = np.ones(m)
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    for turn in range(rounds):
        if turn % 200 == 199:
            inverse = np.linalg.inv(np.stack(columns, axis=1))
        x, dual = inverse @ n, cost @ inverse
        if dual.min() < -1e-9:  # a size is covered too well: let it have a surplus
            enter, price = np.zeros(m), 0.0
            enter[int(dual.argmin())] = -1.0
        else:
            value = np.zeros(capacity + 1)
            value[sizes] = dual
            gain, pattern = best_pattern(value, capacity)
            if gain <= 1 + 1e-9 or dual @ n - (dual @ n) / gain <= tolerance * (dual @ n):
                break
            enter, price = pattern[sizes].astype(float), 1.0
        d = inverse @ enter
        ratio = np.full(m, np.inf)
        ratio[d > 1e-9] = np.maximum(x, 0)[d > 1e-9] / d[d > 1e-9]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[out], cost[out] = enter, price
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
    x = np.linalg.inv(np.stack(columns, axis=1)) @ n
    chosen, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-x, kind="stable"):
        whole = int(np.floor(x[k] + 1e-6))
        if cost[k] and whole > 0:
            full = np.zeros(capacity + 1, np.int64)
            full[sizes] = columns[k].astype(np.int64)
            chosen.append((whole, full))
            left -= whole * full
    bins: list[list[int]] = []
    for s in range(capacity, 0, -1):  # what rounding left over: first fit decreasing
        for _ in range(max(0, int(left[s]))):
            fit = next((b for b in bins if sum(b) + s <= capacity), None)
            if fit is None:
                bins.append([s])
            else:
                fit.append(s)
    return chosen + [(1, np.bincount(b, minlength=capacity + 1)) for b in bins]


def pack(pieces: DataFrame, capacity: int = 2048, unit: int = 8, bucket_rows: int = 500) -> DataFrame:
    """``pieces`` with sequence_id and offset. Needs doc_id, start and length; other columns are kept, whatever their names, but for
    columns named sequence_id or offset, which are replaced.

    ``capacity`` is a multiple of ``unit``.
    """
    spark, classes = pieces.sparkSession, capacity // unit
    kind = F.when(F.col("length") == capacity, classes + 1).otherwise(F.ceil(F.col("length") / unit)).cast("int")
    # the number of a row is written with it, so it stays the same when a task runs again; it spreads repeated rows and breaks ties
    sized = cut(pieces.select(F.struct(*pieces.columns).alias("row"), F.col("doc_id").alias("_id"), "start", "length", kind.alias("_class"), F.monotonically_increasing_id().alias("_number")))
    histogram = cut(sized.groupBy("_class").agg(F.count(F.lit(1)).alias("n")))

    counted = [0] * (classes + 2)
    for r in histogram.collect():  # at most classes + 1 rows
        counted[r["_class"]] = r["n"]

    def solve(frames):  # at most `classes` rows, in one task with one thread
        demand = np.zeros(classes + 1, np.int64)
        for pdf in frames:
            demand[pdf["_class"]] = pdf["n"]
        for i, (times, pattern) in enumerate(patterns(demand, classes)):
            at = np.flatnonzero(pattern)
            yield pd.DataFrame({"pattern": i, "times": times, "size": at, "each": pattern[at]})

    solved = histogram.where(F.col("_class") <= classes).repartition(1).mapInPandas(solve, "pattern bigint, times bigint, size bigint, each bigint").toPandas()
    cutting = [(int(g["times"].iloc[0]), dict(zip(g["size"].tolist(), g["each"].tolist(), strict=True))) for _, g in solved.groupby("pattern")]
    slots: dict[int, list[list[int]]] = {k: [[], [], [], []] for k in range(1, classes + 2)}  # by class: first rank, slots a sequence, first sequence, first slot
    first, used = 0, np.zeros(classes + 2, np.int64)
    for times, pattern in cutting:
        at = 0
        for k, each in sorted(pattern.items(), reverse=True):
            for to, v in zip(slots[k], (int(used[k]), each, first, at), strict=True):
                to.append(v)
            used[k] += times * each
            at += each
        first += times
    for to, v in zip(slots[classes + 1], (0, 1, first, 0), strict=True):
        to.append(v)
    shipped = spark.sparkContext.broadcast({k: [np.array(x, np.int64) for x in v] for k, v in slots.items() if v[0]})

    # as many buckets for a class as its rows need
    buckets = F.array(*(F.lit(max(1, -(-n // bucket_rows))) for n in counted))
    dealt = sized.withColumn("_bucket", F.pmod(F.xxhash64("_number"), F.get(buckets, F.col("_class"))))
    before = dealt.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    # offsets in two levels, so that no class's buckets are one window
    before = before.withColumn("_block", F.floor(F.col("_bucket") / OFFSETS))
    blocks = before.groupBy("_class", "_block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("_class", "_block", (F.sum("m").over(W.partitionBy("_class").orderBy("_block")) - F.col("m")).alias("_base"))
    inside = F.sum("n").over(W.partitionBy("_class", "_block").orderBy("_bucket")) - F.col("n")
    before = before.withColumn("_inside", inside).join(blocks, ["_class", "_block"]).select("_class", "_bucket", (F.col("_base") + F.col("_inside")).alias("_before"))
    order = W.partitionBy("_class", "_bucket").orderBy(F.desc("length"), "_id", "start", "_number")
    # only slim rows are ranked; what a piece carries (its ids) is joined at the end, by the row's number
    dealt = dealt.select("_id", "start", "length", "_class", "_number", "_bucket")
    ranked = dealt.withColumn("_n", F.row_number().over(order)).join(before, ["_class", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_n") - 1)

    @F.pandas_udf("sequence_id bigint, slot bigint")
    def place(kind, rank):
        kind, rank = kind.to_numpy(), rank.to_numpy()
        sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
        for k in np.unique(kind):
            of = kind == k
            start, each, first, at = shipped.value[int(k)]
            p = np.searchsorted(start, rank[of], side="right") - 1
            past = rank[of] - start[p]
            sequence[of], slot[of] = first[p] + past // each[p], at[p] + past % each[p]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    placed = ranked.withColumn("_at", place("_class", "_rank")).select("_number", "length", "_class", "_at.sequence_id", "_at.slot")
    alone = placed.where(F.col("_class") == classes + 1).withColumn("offset", F.lit(0).cast("bigint"))
    shared = placed.where(F.col("_class") <= classes)
    in_order = W.partitionBy("sequence_id").orderBy("slot")
    shared = shared.withColumn("offset", F.sum("length").over(in_order) - F.col("length"))
    laid = alone.unionByName(shared).select("_number", "sequence_id", "offset")
    kept = [F.col("row").getField(c).alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")]
    return sized.select("_number", "row").join(laid, "_number").select(*kept, "sequence_id", "offset")
