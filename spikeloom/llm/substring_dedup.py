"""Removal of repeated passages: windows of words that repeat across documents, found by level-wise doubling.

A window is ``least`` consecutive words of one document. Windows that occur in two documents at least are repeated; windows of twice that length whose two halves are repeated are looked at
next, and so on until none survives. Words covered by a window of the first length that also starts in a document with a smaller id are removed.

1. Documents are put into bundles of about BUNDLE words, one row each, with the texts compressed; a bundle stays as it is from then on.
2. Tasks hash words and windows of a bundle as arrays. What repeats within the bundle is merged there, so a passage that many documents share leaves a bundle once.
   The windows' hashes are dealt to buckets, as one sorted array for each bundle and bucket.
3. A bucket tells each array which of its windows occur in other arrays, one bit a window, and the bits go back to the bundle.
4. First level: a filter of 31 bits within the bucket, which a window that repeats always passes; those that pass are compared by a second hash of 64 bits, beside
   the bits of the bucket, with the least id of the bundle's documents that hold it. Further levels compare the second hash alone.
5. State between levels is the passages that surviving windows cover, with a bit for each word where one begins, written as a table.

A bucket holds at most an entry for each bundle and window, so no window, passage or copied text makes a large group. Buckets are 128 Ki windows up to 256 buckets, then grow to 4 Mi windows,
then their number grows; an array shrinks to a row of a few entries at some hundred TB.

Edge cases: null, empty and wordless texts have no words and the hash of the empty text. Texts of fewer than ``least`` words lose nothing. A null id counts as greater than all others. Rows with the same id are
not smaller than each other: repeated rows keep what only they share. Very long texts are read whole, a longer one than BUNDLE is a bundle of its own. Extra input columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.llm.common import cut, per_worker

#: Words of a bundle; windows of a bucket, at least and at most.
BUNDLE, SMALL_BUCKET, LARGE_BUCKET, MANY = 1 << 20, 1 << 17, 1 << 22, 256
NO_ID = (1 << 63) - 1
#: Bytes of a word that the table of places has; longer words are hashed one by one.
LONGEST = 64


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Words:
    """Hashes of words and of windows of any length, in arrays."""

    def __init__(self):
        rng = np.random.Generator(np.random.Philox(11))
        self.byte, self.place = (rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in (256, LONGEST))
        self.bases = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of words of lines, the words' numbers by line, the line of each word, where it begins and its bytes. Words are parted by one space or line end."""
        raw = np.frombuffer(data, np.uint8)
        gap = np.r_[-1, np.flatnonzero((raw == 32) | (raw == 10)), len(raw)]
        start, size = gap[:-1] + 1, np.diff(gap) - 1
        line_end = np.r_[raw[gap[1:-1]] == 10, True]
        line = np.cumsum(line_end) - line_end
        own = size > 0  # lines without words have an empty piece
        start, size, line = start[own], size[own], line[own]
        if not len(size):
            return np.zeros(0, np.uint64), np.zeros(int(line_end.sum()), np.int64), line, start, size
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)  # of a byte in its word
        h = np.add.reduceat(self.byte[raw[np.repeat(start, size) + at]] * self.place[at % LONGEST], first)
        h = mixed(h + size.astype(np.uint64) * np.uint64(self.bases[0]))
        for i in np.flatnonzero(size > LONGEST).tolist():
            h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
        return h, np.bincount(line, minlength=int(line_end.sum())), line, start, size

    def windows(self, h: np.ndarray, length: int, which: int) -> np.ndarray:
        """Of all windows of ``length`` words, by differences of prefix sums."""
        base = self.bases[which]
        if len(self.powers[which][0]) <= len(h):
            back = pow(base, -1, 1 << 64)
            self.powers[which] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(len(h) + 1, b, np.uint64)]) for b in (base, back))
        up, down = self.powers[which]
        sums = np.r_[np.uint64(0), np.cumsum(h * down[: len(h)])]
        return mixed((sums[length:] - sums[:-length]) * up[: len(h) - length + 1])


def tool() -> Words:
    return per_worker(("windows",), Words)


def bundles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bundle, n_words, ids, data: words joined by spaces, a line for each document, compressed."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        ids, lines, n = [], [], 0
        press = zstandard.ZstdCompressor(level=1)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([press.compress(b"\n".join(lines))], pa.binary())], names=["bundle", "n_words", "ids", "data"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                ids.append(i)
                lines.append(b" ".join(words))
                n += len(words)
                if n >= BUNDLE or len(lines) >= BUNDLE:
                    yield row()
                    ids, lines, n = [], [], 0
        if lines:
            yield row()

    return src.mapInArrow(run, "bundle string, n_words bigint, ids array<bigint>, data binary")


class Level:
    """The windows of one length of a bundle: distinct ones by bucket and value, and where they are.

    stage: "filter" (31 bits and one that says whether documents of the bundle share the window), "first" (64 bits, least ids and the same bit) or "further" (64 bits, the bit).
    """

    def __init__(self, data: bytes, ids: np.ndarray, alive: np.ndarray | None, length: int, buckets: int, stage: str):
        own = tool()
        self.h, self.sizes, line, self.start, self.bytes = own.words(data)
        self.data = data
        self.line, self.ids, self.length = line, ids, length
        n = len(self.h) - length + 1
        at = np.flatnonzero(line[:n] == line[length - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if alive is not None:
            half = length // 2 if stage == "further" else 0
            at = at[alive[at] & alive[at + half]]
        self.at = at
        if not len(at):
            self.bucket, self.value, self.least, self.many, self.of = (np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, bool, np.int64))
            return
        w = own.windows(self.h, length, 0)[at]
        bucket = (w >> np.uint64(32)) % np.uint64(buckets)
        value = w & np.uint64(0x7FFFFFFF) if stage == "filter" else own.windows(self.h, length, 1)[at]
        if stage == "filter":
            order = np.argsort(bucket << np.uint64(32) | value, kind="stable")
        else:
            order = np.lexsort((value, bucket))
        b, v = bucket[order], value[order]
        new = np.r_[True, (b[1:] != b[:-1]) | (v[1:] != v[:-1])]
        first = np.flatnonzero(new)
        self.of = np.empty(len(at), np.int64)
        self.of[order] = np.cumsum(new) - 1  # the distinct window of each place
        owner = ids[line[at]][order]
        self.least = np.minimum.reduceat(owner, first)
        self.many = np.maximum.reduceat(owner, first) > self.least if stage != "further" else np.maximum.reduceat(line[at][order], first) > np.minimum.reduceat(line[at][order], first)
        self.bucket, self.value = b[first].astype(np.int64), v[first]

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that have windows, and where each begins."""
        return np.unique(self.bucket, return_index=True)


ENTRIES = "bundle string, bucket bigint, value binary, least binary, many binary"
ANSWERS = "bundle string, bucket bigint, again binary, later binary"
STATE = "bundle string, level int, ids array<bigint>, docs array<int>, places array<int>, sizes array<int>, data binary, alive binary, removed binary"


def numbers(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def entries(state: DataFrame, length: int, buckets: int, stage: str) -> DataFrame:
    """The distinct windows of each bundle, an array for each bucket."""
    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                own = level_of(r, unpress, length, buckets, stage)
                there, at = own.cuts()
                ends = [*at[1:], len(own.value)]
                value = (own.value << np.uint64(1) | own.many).astype("<u4") if stage == "filter" else own.value
                ends = ends[: len(at)]
                blobs = [[x[s:e].tobytes() for s, e in zip(at, ends, strict=True)] for x in (value, own.least)]
                many = [np.packbits(own.many[s:e]).tobytes() for s, e in zip(at, ends, strict=True)]
                none = pa.nulls(len(there), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r["bundle"]] * len(there), pa.string()), pa.array(there, pa.int64()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary()) if stage == "first" else none, none if stage == "filter" else pa.array(many, pa.binary())], names=["bundle", "bucket", "value", "least", "many"])

    return state.mapInArrow(run, ENTRIES)


def level_of(r: dict, unpress, length: int, buckets: int, stage: str) -> Level:
    data = unpress.decompress(r["data"])
    alive = None
    if stage != "filter":
        alive = np.unpackbits(np.frombuffer(r["alive"], np.uint8)).astype(bool)
    return Level(data, np.array([NO_ID if i is None else i for i in r["ids"]], np.int64), alive, length, buckets, stage)


def answers(found: DataFrame, stage: str) -> DataFrame:
    """For each array one bit a window: whether documents share it, and (first stage) whether another bundle has it with a smaller id."""
    def run(table: pa.Table) -> pa.Table:
        values = numbers(table["value"], "<u4" if stage == "filter" else np.uint64)
        sizes = [len(v) for v in values]
        value = np.concatenate(values)
        if stage == "filter":
            many, value = (value & 1).astype(bool), value >> 1
        else:
            many = np.concatenate([np.unpackbits(m, count=n).astype(bool) for m, n in zip(numbers(table["many"], np.uint8), sizes, strict=True)])
        order = np.argsort(value, kind="stable")
        v = value[order]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        of = np.empty(len(v), np.int64)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(v)]))
        again, later = np.logical_or.reduceat(many[order], first), None
        if stage == "first":
            least = np.concatenate(numbers(table["least"], np.int64))
            low, high = np.minimum.reduceat(least[order], first), np.maximum.reduceat(least[order], first)
            again, later = again | (low < high), low[of] < least
        else:
            again = again | (np.diff(np.r_[first, len(v)]) > 1)
        ends = np.cumsum(sizes)
        bits = [[np.packbits(x[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)] for x in ([again[of]] if later is None else [again[of], later])]
        return pa.table([table["bundle"], table["bucket"], pa.array(bits[0], pa.binary()), pa.array(bits[1], pa.binary()) if later is not None else pa.nulls(len(sizes), pa.binary())], names=["bundle", "bucket", "again", "later"])

    return found.groupBy("bucket").applyInArrow(run, ANSWERS)


def covering(at: np.ndarray, length: int, words: int) -> np.ndarray:
    """Whether each word is in a window that begins at one of the places ``at``."""
    steps = np.bincount(at, minlength=words + 1) - np.bincount(at + length, minlength=words + 1)
    return np.cumsum(steps)[:words] > 0


def marked(state: DataFrame, found: DataFrame, length: int, buckets: int, stage: str) -> DataFrame:
    """The next state: the passages that surviving windows cover, by document and place; after the first stage, too, which of their words are removed."""
    lists = [("ids", pa.int64()), ("docs", pa.int32()), ("places", pa.int32()), ("sizes", pa.int32())]
    schema = pa.schema([("bundle", pa.string()), ("level", pa.int32()), *((c, pa.list_(t)) for c, t in lists), ("data", pa.binary()), ("alive", pa.binary()), ("removed", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        r = left.to_pylist()[0]
        own = level_of(r, zstandard.ZstdDecompressor(), length, buckets, stage)
        there, at = own.cuts()
        size = dict(zip(there.tolist(), np.diff(np.r_[at, len(own.value)]).tolist(), strict=True))
        start = dict(zip(there.tolist(), at.tolist(), strict=True))
        again, later = np.zeros(len(own.value), bool), np.zeros(len(own.value), bool)
        for bucket, x, y in zip(right["bucket"].to_pylist(), right["again"].to_pylist(), right["later"].to_pylist(), strict=True):
            s, n = start[bucket], size[bucket]
            again[s : s + n] = np.unpackbits(np.frombuffer(x, np.uint8), count=n)
            if y is not None:
                later[s : s + n] = np.unpackbits(np.frombuffer(y, np.uint8), count=n)
        places = own.at[again[own.of]]
        if not len(places):
            return schema.empty_table()
        alive = np.zeros(len(own.h), bool)
        alive[places] = True
        kept = covering(places, length, len(own.h))
        word = np.flatnonzero(kept)
        new = np.r_[True, (np.diff(word) > 1) | (np.diff(own.line[word]) > 0)]  # where a passage begins
        first, last = word[new], word[np.r_[new[1:], True]]
        line = own.line[first]
        inside = first - (np.cumsum(own.sizes) - own.sizes)[line]
        docs, base = (np.array(r[c], np.int64) for c in ("docs", "places")) if "docs" in r else (np.arange(len(own.sizes)), np.zeros(len(own.sizes), np.int64))
        removed = None
        if stage == "first":
            gone = own.at[later[own.of] | (own.ids[own.line[own.at]] > own.least[own.of])]
            removed = np.packbits(covering(gone, length, len(own.h))[kept]).tobytes()
        ends = own.start[last] + own.bytes[last]
        data = b"\n".join([own.data[s:e] for s, e in zip(own.start[first].tolist(), ends.tolist(), strict=True)])
        ids = [r["ids"][k] for k in line.tolist()]
        row = {"bundle": r["bundle"], "level": length, "ids": ids, "docs": docs[line].tolist(), "places": (base[line] + inside).tolist(), "sizes": (last - first + 1).tolist(), "data": zstandard.ZstdCompressor(level=1).compress(data), "alive": np.packbits(alive[kept]).tobytes(), "removed": removed}
        return pa.Table.from_pylist([row], schema=schema)

    return state.groupBy("bundle").cogroup(found.groupBy("bundle")).applyInArrow(run, STATE)


def number_of_buckets(words: int) -> int:
    return max(1, min(math.ceil(words / SMALL_BUCKET), max(MANY, math.ceil(words / LARGE_BUCKET))))


def levels(docs: DataFrame, least: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """The bundles, and for each level from ``least`` on a table of them: passages that windows of that length cover (number of the document, place, size), and at the first level their removed words."""
    whole = cut(bundles(docs, id_col, text_col))
    buckets = number_of_buckets(whole.agg(F.sum("n_words")).first()[0] or 0)

    def step(state, length, stage):
        return cut(marked(state, answers(entries(state, length, buckets, stage), stage), length, buckets, stage))

    state = step(whole, least, "filter")
    out, length, stage = [], least, "first"
    while True:
        state = step(state, length, stage)
        out.append(state)
        if state.isEmpty():
            return whole, out
        length, stage = 2 * length, "further"


def dedup(docs: DataFrame, least: int = 13, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (or with ``texts`` kept, the words that stay, joined by spaces), longest of every document.

    longest: the greatest level (``least``, twice that, ...) at which the document shares a window with another one, 0 for none.
    """
    whole, found = levels(docs, least, id_col, text_col)
    marks = found[0]
    for f in found[1:]:
        marks = marks.unionByName(f)
    name, kind = ("kept", pa.string()) if texts else ("kept_sha256", pa.string())
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_removed")] + [T.StructField(name, T.StringType()), T.StructField("longest", T.LongType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        lines = zstandard.ZstdDecompressor().decompress(r["data"]).split(b"\n")
        sizes = [line.count(b" ") + 1 if line else 0 for line in lines]
        removed, longest = {}, [0] * len(lines)
        for m in right.to_pylist():
            bits, at = np.unpackbits(np.frombuffer(m["removed"] or b"", np.uint8)), 0
            for k, place, size in zip(m["docs"], m["places"], m["sizes"], strict=True):
                longest[k] = max(longest[k], m["level"])
                if m["removed"] is not None:
                    removed.setdefault(k, np.zeros(sizes[k], np.uint8))[place : place + size] |= bits[at : at + size]
                    at += size
        rows = []
        for k, line in enumerate(lines):
            gone = int(removed[k].sum()) if k in removed else 0
            kept = line if not gone else b" ".join([w for w, g in zip(line.split(b" "), removed[k].tolist(), strict=True) if not g])
            rows.append((sizes[k], gone, kept.decode() if texts else hashlib.sha256(kept).hexdigest(), longest[k]))
        n, gone, kept, longest = zip(*rows, strict=True)
        return pa.table([pa.array(r["ids"], pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, kind), pa.array(longest, pa.int64())], names=schema.names)

    return whole.groupBy("bundle").cogroup(marks.select("bundle", "level", "docs", "places", "sizes", "removed").groupBy("bundle")).applyInArrow(run, schema)
