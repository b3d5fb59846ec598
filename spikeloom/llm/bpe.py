"""Byte-level BPE encoding and decoding with two tiers.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens that are tokens themselves.
Tier two: other pre-tokens are merged by a heap of candidate pairs over a doubly linked list of bytes, always the
pair of lowest rank and, among equals, the leftmost. Texts are cut at white space first; what a
chunk gives is kept in a bounded per-worker memo, so frequent words are resolved once.

Edge cases: a null or empty text has no ids and decodes to no bytes. Text that spells a special token is
ordinary text. Very long pre-tokens take n log n steps. Repeated rows are encoded one by one; extra input
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.llm.common import WorkerCache, per_worker

#: The code points with the Unicode property White_Space, as in a character class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = -1  # no token


class PerfectHash:
    """Hash and displace: n keys to n slots; ``slot`` sends any other key to some slot, too."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        where = (h % np.uint64(self.buckets)).astype(np.int64)
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        members = np.split(np.argsort(where, kind="stable"), np.cumsum(np.bincount(where, minlength=self.buckets))[:-1])
        shift, taken, slots, free = [0] * self.buckets, np.zeros(n, bool), np.zeros(n, np.int64), None
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own, at, tries = members[b], 0, 16
            while len(own):
                d = np.arange(at, at + tries, dtype=np.uint64)
                put = ((low[own] + (d[:, None] >> np.uint64(20)) * high[own] + (d[:, None] & np.uint64(0xFFFFF))) % np.uint64(n)).astype(np.int64)
                fits = ~taken[put].any(axis=1)
                if len(own) > 1:
                    ranked = np.sort(put, axis=1)
                    fits &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if fits.any():
                    i = int(fits.argmax())
                    shift[b], slots[own] = at + i, put[i]
                    taken[put[i]] = True
                    break
                at, tries = at + tries, min(4096, tries * 2)
        self.shift, self.order = shift, slots

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return ((h & 0xFFFFFFFF) + (d >> 20) * (h >> 32) + (d & 0xFFFFF)) % self.n


class Vocabulary:
    """Ranks by token bytes, with the perfect hash over them."""

    def __init__(self, lines: list[bytes]):
        ranked = [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in lines if x.strip())]
        self.hash = PerfectHash([k for k, _ in ranked])
        self.by_slot: list[tuple[bytes, int]] = [(b"", -1)] * len(ranked)
        for (k, r), s in zip(ranked, self.hash.order.tolist(), strict=True):
            self.by_slot[s] = (k, r)
        del self.hash.order
        self.bytes_of = {r: k for k, r in ranked}

        self.seen = WorkerCache(self.lookup, 400_000)  # of the perfect hash; frequent byte strings are asked for again and again

    def lookup(self, key: bytes) -> int:
        """The rank of a token, NONE for other byte strings."""
        k, r = self.by_slot[self.hash.slot(key)]
        return r if k == key else NONE

    def rank(self, key: bytes) -> int | None:
        r = self.seen[key]
        return None if r == NONE else r

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that isn't a token: heap of pairs over linked bytes."""
        n, rank = len(piece), self.seen.__getitem__
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # node i covers piece[i:end[i]]; end[i] is the next node
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != e:  # one of the two nodes has changed
                continue
            end[i], end[j] = e, -1
            if e < n:
                before[e] = i
                if (r := rank(piece[i : end[e]])) != NONE:
                    heapq.heappush(heap, (r, i, end[e]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:e])) != NONE:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : end[i]]))
            i = end[i]
        return out


class Encoder:
    def __init__(self, lines: list[bytes], pattern: str, memo: int = 200_000):
        self.vocabulary = Vocabulary(lines)
        # white space is the Unicode property in each engine
        own = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.pieces = regex.compile(own).findall
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.memo, self.ids_of = WorkerCache(self.chunk, memo), WorkerCache(self.piece, memo)
        self.names = [str(i) for i in range(max(self.vocabulary.bytes_of, default=-1) + 1)]
        self.bytes_at = [self.vocabulary.bytes_of.get(i, b"") for i in range(len(self.names))]

    def chunk(self, text: str) -> tuple[int, ...]:
        if text[text[0] == " " :].isalpha():  # one pre-token
            return self.piece(text)
        return tuple(chain.from_iterable(map(self.ids_of.__getitem__, self.pieces(text))))

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode()
        r = self.vocabulary.lookup(raw)
        return tuple(self.vocabulary.merge(raw)) if r == NONE else (r,)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.chunks(text)))) if text else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_at.__getitem__, ids))


def load(spark, path: str) -> list[bytes]:
    """Lines of a rank file (a fixed vocabulary of about a megabyte), read by the driver."""
    with open(path, "rb") as f:
        return f.read().splitlines()


def encoder(lines: list[bytes], pattern: str) -> Encoder:
    return per_worker(("bpe", len(lines), hash(lines[-1]), pattern), lambda: Encoder(lines, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id and ids (array of int); with ``digests`` instead of the ids their number and hash, and the hash of the decoded bytes."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))  # the vocabulary, of fixed size
    own = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([src.schema["doc_id"], *own])

    def digest(tool: Encoder, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(" ".join(map(tool.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()

    def run(batches):
        tool = encoder(shipped.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):  # short blocks bound the ids held at once
                part = b.slice(at, 512)
                encoded = (tool.encode(x.as_py()) for x in part.column(1))
                if digests:
                    columns = zip(*(digest(tool, ids) for ids in encoded), strict=True)
                    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
                else:
                    arrays = [pa.array(list(encoded), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=schema.names)

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded (binary) of arrays of ids; null ids decode to no bytes."""
    src = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    shipped = encoded.sparkSession.sparkContext.broadcast(load(encoded.sparkSession, path))
    schema = T.StructType([src.schema["doc_id"], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        tool = encoder(shipped.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tool.decode(x.as_py() or ()) for x in b.column(1)], pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)
