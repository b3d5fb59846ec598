"""Alignment of two tokenizers' tokens, and document counts of linked token pairs under a minimal perfect hash.

Both tokenizers cut the same bytes. Where both cut, a group ends; a token of one is linked with each token of the other whose bytes overlap its own. Texts fall
into chunks at spaces behind a character that isn't white space, and at signs behind a letter, where both tokenizers always cut (the vocabulary is asked), so what a chunk gives is kept in a bounded memo of the worker.

1. The documents are encoded once into a table. First pass: tasks align their documents and count, for each pair of ids, the documents that hold it linked. A task's counts leave it as sorted arrays, one for each of
   PARTS parts of the pairs.
2. Parts are united in a tree of groups of FAN arrays, and each part's distinct pairs get a minimal perfect hash: level by level the pairs that are alone in their slot of a
   bit table keep it, the others go on; a pair's number is the rank of its bit. The pair that owns a number is kept, so that others are told apart.
3. Each array becomes a dense vector of counts indexed by the hash, and the vectors are summed in the same tree.
4. Second pass: the documents are aligned anew and their links' counts looked up. A table of at most MOST_PAIRS pairs is broadcast; if there are more, parts are grouped into
   tables of that size, and the documents, with their sums so far, are written between tables.

Sizes: there are no more pairs than the vocabularies' product, so a part has at most that over PARTS; the greatest count by id of the first tokenizer is a row for each id of
its vocabulary. No row holds a list of documents.

Edge cases: a null or empty text has no tokens; so has a text whose tokens of either kind don't spell a space and the text (one with the piece
model's space sign in it). A text that spells a special token is ordinary text. Very long texts are read whole; one without spaces is one chunk. Repeated rows are documents of
their own, null ids are kept. Extra input columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import uuid
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.llm.common import WorkerCache, cut, per_worker
from spikeloom.llm.packing import BYTES

#: The piece model's sign for a space; the seeds of the part and level hashes derive from this odd number.
SPACE_SIGN, ODD = "▁", 0x9E3779B97F4A7C15
PARTS = 256
FAN = 64
MOST_PAIRS = 1 << 22
#: Documents that are aligned at once.
BATCH = 256
COUNTS, SUMS = ["n_a", "n_b", "n_groups", "n_links"], ["n_best", "count_sum"]
#: A letter before chunks without a space, letters behind which chunks may begin, chunks of which all engines agree on letters, numerals and white space, and the byte-level sign for a space.
STOP, LETTER = "z", "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PLAIN, BLANK = re.compile("[\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch, chr(BYTES[32])
#: Distinct pairs that a task holds before it lets them go.
HELD = 1 << 20


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    z = keys + np.uint64((seed + 1) * ODD & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def part_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, -1) % np.uint64(PARTS)).astype(np.int64)


# ---- minimal perfect hash

def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys: the sizes of the levels' bit tables, their bits, and the keys in the order of their numbers."""
    sizes, bits, ordered, level = [], [], [], 0
    while len(keys):
        size = 2 * len(keys) + 1
        at = (mixed(keys, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        own = np.argsort(at[mine], kind="stable")
        sizes.append(size), bits.append(alone), ordered.append(keys[mine][own])
        keys, level = keys[~mine], level + 1
    return np.array(sizes, np.int64), np.concatenate([np.zeros(0, bool), *bits]), np.concatenate([np.zeros(0, np.uint64), *ordered])


class Hash:
    """The hashes of several parts as one: bit tables side by side, numbers by rank."""

    def __init__(self, parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        levels = max((len(s) for s, _, _ in parts.values()), default=0)
        self.size, self.start = np.zeros((PARTS, levels), np.int64), np.zeros((PARTS, levels), np.int64)
        at = 0
        for p, (sizes, _, _) in parts.items():
            for level, size in enumerate(sizes.tolist()):
                self.size[p, level], self.start[p, level] = size, at
                at += size
        bits = np.concatenate([*(b for _, b, _ in parts.values()), np.zeros(-at % 64 + 64, bool)])
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.rank = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        self.keys = np.concatenate([*(k for _, _, k in parts.values()), np.zeros(0, np.uint64)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for keys that aren't among those of the hash."""
        out, part, todo = np.full(len(keys), -1), part_of(keys), np.arange(len(keys))
        for level in range(self.size.shape[1]):
            size = self.size[part[todo], level]
            todo, size = todo[size > 0], size[size > 0]
            at = self.start[part[todo], level] + (mixed(keys[todo], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit & np.uint64(1)) == 1
            out[todo[there]] = (self.rank[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))))[there]
            todo = todo[~there]
        found = out >= 0
        out[found] = np.where(self.keys[out[found]] == keys[found], out[found], -1)
        return out


# ---- alignment

def width_of(*sizes: int) -> str:
    """Kind of the unsigned words that hold ids: 16 bits if they are enough."""
    return "H" if max(sizes) <= 1 << 16 else "I"


class Encoders:
    """Ids of both tokenizers. definition: of the byte-level tokenizer; model: of the piece model.

    Ids of chunks up to LONGEST characters stay in two generations of a memo of about ``memo`` chunks each.
    """

    LONGEST = 64

    def __init__(self, definition: str, model: bytes, pattern: str, memo: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(definition), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        alphabet = {chr(BYTES.get(b, b)): b for b in range(256)}
        names = {i: t for t, i in self.a.get_vocab().items()}
        special = {i for i in self.a.get_added_tokens_decoder()}
        self.bytes_a = [b"" if i not in names else names[i].encode() if i in special else bytes(alphabet[c] for c in names[i]) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(SPACE_SIGN)
        self.stop = len(self.b.encode(STOP))
        self.kind = width_of(len(self.bytes_a), len(self.bytes_b))
        # a piece with a space behind something else could cross chunks, and so could one with a sign behind a letter
        self.chunked = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)
        own = [p for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        inside = {y for p in own for x, y in zip(p, p[1:], strict=False) if x.isalpha()}
        signs = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in inside))
        self.split = re.compile(rf"(?<=\S)(?= )|(?<=[{LETTER}])(?=[{signs}])" if signs else r"(?<=\S)(?= )").split
        self.pieces, self.model = regex.compile(pattern).findall, self.a.model
        self.memo, self.now, self.old = memo, ({}, {}), ({}, {})
        self.piece_memo = WorkerCache(self.piece, memo)

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of the first tokenizer for one of its pre-tokens."""
        return tuple([t.id for t in self.model.tokenize(text.replace(" ", BLANK) if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(BYTES))])

    def first_ids(self, text: str) -> list[int]:
        """The chunk's ids; pre-tokens of other than plain letters and marks are left to the tokenizer, which knows its own white space and letters."""
        if text[text[0] == " " :].isalpha():
            return self.piece(text)
        if PLAIN(text):
            return list(chain.from_iterable(map(self.piece_memo.__getitem__, self.pieces(text))))
        return self.a.encode(text, add_special_tokens=False).ids

    def pieces_of(self, chunks: list[str]) -> list[list[int]]:
        """Ids of the piece model, which puts a space before whatever it gets; of a chunk without one, those behind the space and a letter of its own."""
        found = self.b.encode([c[1:] if c[0] == " " else f"{STOP}{c}" for c in chunks], num_threads=1)
        return [ids if c[0] == " " and len(c) > 1 else [self.space] if c == " " else ids[self.stop :] for c, ids in zip(chunks, found, strict=True)]

    def checked(self, text: str, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        """Both kinds of ids as bytes, None if they spell something else."""
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return array(self.kind, a).tobytes(), array(self.kind, b).tobytes()

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text both kinds of ids; none of either for texts without tokens."""
        if len(self.now[0]) > self.memo:
            self.old, self.now = self.now, ({}, {})
        (now_a, now_b), (old_a, old_b) = self.now, self.old
        cut_up = [self.split(" " + t) if t and SPACE_SIGN not in t and self.chunked else None for t in texts]  # the sign would be taken for a space
        new, odd = [], set()
        for c in set(chain.from_iterable(filter(None, cut_up))):
            if c not in now_a:
                if c in old_a:
                    now_a[c], now_b[c] = old_a[c], old_b[c]
                else:
                    new.append(c)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids_b = self.pieces_of(part)
            ids_a = list(map(self.first_ids, part))
            raw = "".join(part).encode()
            fine = all(b"".join(map(own.__getitem__, chain.from_iterable(ids))) == raw for own, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
            for c, a, b in zip(part, ids_a, ids_b, strict=True):
                now_a[c], now_b[c] = array(self.kind, a).tobytes(), array(self.kind, b).tobytes()
                if not fine and self.checked(c, a, b) is None:
                    odd.add(c)
        out = []
        for t, chunks in zip(texts, cut_up, strict=True):
            if not t or SPACE_SIGN in t:
                out.append((b"", b""))
            elif chunks is None or odd and not odd.isdisjoint(chunks):
                out.append(self.checked(" " + t, self.a.encode(" " + t, add_special_tokens=False).ids, self.b.encode(t)) or (b"", b""))
            else:
                out.append((b"".join(map(now_a.__getitem__, chunks)), b"".join(map(now_b.__getitem__, chunks))))
        for c in [*odd, *(c for c in new if len(c) > self.LONGEST)]:
            now_a.pop(c, None), now_b.pop(c, None)
        return out


class Names:
    """Lengths of tokens, and their ids as they are listed in groups, behind which stands one sign or another."""

    def __init__(self, length_a: np.ndarray, length_b: np.ndarray):
        self.length_a, self.length_b, self.kind = length_a, length_b, np.dtype(width_of(len(length_a), len(length_b)))
        self.listed = [f"{i}{sign}".encode() for n, signs in ((len(length_a), ",|"), (len(length_b), ",;")) for sign in signs for i in range(n)]


@dataclass
class Aligned:
    """Some documents' tokens, with offsets by document (n + 1 of them): links, groups' ends, and what the alignment is made of."""

    keys: np.ndarray  # of the links: a * 2^32 + b
    links_at: np.ndarray
    groups_at: np.ndarray | None
    codes: np.ndarray | None  # of names, in the order of the groups
    codes_at: np.ndarray | None


def align(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, names: Names, codes_too: bool = True) -> Aligned:
    """a, b: ids of all documents, which spell the same bytes document by document; n_a, n_b: their numbers by document. The order of groups may be left out."""
    end_a, end_b = np.cumsum(names.length_a[a]), np.cumsum(names.length_b[b])
    size = int(end_a[-1]) if len(a) else 0
    cut_a, cut_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    cut_a[end_a], cut_b[end_b] = True, True
    ends = np.flatnonzero(cut_a | cut_b)  # each stretch between cuts is one link
    both = cut_a[ends] & cut_b[ends]
    i, j = ((np.cumsum(c) - c)[ends] for c in (cut_a, cut_b))
    keys = a[i].astype(np.uint64) << np.uint64(32) | b[j].astype(np.uint64)
    at_a, at_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
    doc_ends = np.r_[0, end_a][at_a]
    links_at = np.searchsorted(ends, doc_ends, side="right")
    group_ends = ends[both]
    if not codes_too:
        return Aligned(keys, links_at, None, None, None)
    # tokens by group: those of a, then those of b
    group_a, group_b = np.searchsorted(group_ends, end_a), np.searchsorted(group_ends, end_b)
    last_a = np.r_[group_a[1:] != group_a[:-1], True][: len(a)]
    last_b = np.r_[group_b[1:] != group_b[:-1], True][: len(b)]
    upto_a, upto_b = np.r_[0, np.cumsum(np.bincount(group_a, minlength=len(group_ends)))], np.r_[0, np.cumsum(np.bincount(group_b, minlength=len(group_ends)))]
    codes = np.zeros(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + upto_b[group_a]] = a + last_a * len(names.length_a)
    codes[np.arange(len(b)) + upto_a[group_b + 1]] = 2 * len(names.length_a) + b + last_b * len(names.length_b)
    return Aligned(keys, links_at, np.searchsorted(group_ends, doc_ends, side="right"), codes, at_a + at_b)


def listing(found: Aligned, names: Names) -> list[bytes]:
    """For each document its groups, as a1,a2|b1;a3|b2."""
    parts = list(map(names.listed.__getitem__, found.codes.tolist()))
    return [b"".join(parts[s:e])[:-1] for s, e in zip(found.codes_at[:-1].tolist(), found.codes_at[1:].tolist(), strict=True)]


@dataclass(frozen=True)
class Tokenizers:
    """Paths of the byte-level tokenizer's definition and of the piece model, fixed vocabularies that the driver reads; pattern: of the former's pre-tokens."""

    a: str
    b: str
    pattern: str

    def ship(self, spark):
        with open(self.a) as f, open(self.b, "rb") as g:
            return spark.sparkContext.broadcast((f.read(), g.read(), self.pattern))


def encoders(shipped) -> Encoders:
    own = shipped.value
    return per_worker(("encoders", hash(own)), lambda: Encoders(*own))


def encoded(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a, b: the ids of both kinds as unsigned words (``width_of``)."""
    src, shipped = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizers.ship(docs.sparkSession)
    schema = T.StructType([src.schema["doc_id"], *(T.StructField(c, T.BinaryType()) for c in "ab")])

    def run(batches):
        tool = encoders(shipped)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                found = tool.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[k] for f in found], pa.binary()) for k in (0, 1))], names=schema.names)

    return src.mapInArrow(run, schema)


def ship_names(tokenizers: Tokenizers, spark):
    """Token lengths of both vocabularies, for all tasks."""
    with open(tokenizers.a) as f, open(tokenizers.b, "rb") as g:
        tool = Encoders(f.read(), g.read(), tokenizers.pattern)
    return spark.sparkContext.broadcast(tuple(np.array(list(map(len, x)), np.int64) for x in (tool.bytes_a, tool.bytes_b)))


def names_of(shipped) -> Names:
    own = shipped.value
    return per_worker(("names", *(hash(x.tobytes()) for x in own)), lambda: Names(*own))


def align_rows(a: pa.Array, b: pa.Array, names: Names, codes_too: bool = True) -> tuple[Aligned, np.ndarray, np.ndarray]:
    """Of rows of ``encoded``; with the numbers of tokens."""
    (raw_a, raw_b), (n_a, n_b) = (a.to_pylist(), b.to_pylist()), ((pc.binary_length(x).to_numpy(zero_copy_only=False) // names.kind.itemsize).astype(np.int64) for x in (a, b))
    ids = [np.frombuffer(b"".join(x), names.kind).astype(np.int64) for x in (raw_a, raw_b)]
    return align(*ids, n_a, n_b, names, codes_too), n_a, n_b


def aligned(table: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (a1,a2|b1;a3|b2) of the documents of ``encoded``."""
    shipped = ship_names(tokenizers, table.sparkSession)
    schema = T.StructType([table.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("groups", T.StringType())])

    def run(batches):
        names = names_of(shipped)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                found, n_a, n_b = align_rows(part.column(1), part.column(2), names)
                counts = (n_a, n_b, np.diff(found.groups_at), np.diff(found.links_at))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in counts), pa.array([x.decode() for x in listing(found, names)])], names=schema.names)

    return table.select("doc_id", "a", "b").mapInArrow(run, schema)


# ---- counts

def counted(table: DataFrame, shipped) -> DataFrame:
    """part, salt, keys, counts: sorted pairs and the numbers of documents that hold them linked, from one task each."""
    def run(batches):
        names, found, held, known = names_of(shipped), [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def taken():
            keys, counts = (np.concatenate(x) for x in zip(known, *found, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)

        def rows():
            keys, counts = known
            part = part_of(keys)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(PARTS + 1))
            there = [p for p in range(PARTS) if cuts[p] < cuts[p + 1]]
            blocks = [[x[by][cuts[p] : cuts[p + 1]].tobytes() for p in there] for x in (keys, counts)]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(pa.array(x, pa.binary()) for x in blocks)], names=["part", "keys", "counts"])

        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                own, *_ = align_rows(b.column(0).slice(at, BATCH), b.column(1).slice(at, BATCH), names, codes_too=False)
                for s, e in zip(own.links_at[:-1].tolist(), own.links_at[1:].tolist(), strict=True):
                    if s < e:
                        found.append((keys := np.unique(own.keys[s:e]), np.ones(len(keys), np.int64)))
                        held += len(keys)
                if held >= HELD:
                    known, found, held = taken(), [], 0
                    if len(known[0]) >= HELD:
                        yield rows()
                        known = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        known = taken()
        yield rows()

    return table.select("a", "b").mapInArrow(run, "part int, keys binary, counts binary").withColumn("salt", F.xxhash64("keys", "counts"))


def of_bytes(column: pa.ChunkedArray, kind=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def in_tree(rows: DataFrame, salts: int, schema: str, unite) -> DataFrame:
    """``unite`` over all rows of a part, FAN at a time: rows of the same part and salt are one group."""
    while True:
        rows = rows.withColumn("salt", F.pmod("salt", F.lit(salts))).groupBy("part", "salt").applyInArrow(unite, schema)
        if salts == 1:
            return rows
        salts = math.ceil(salts / FAN)


def first_of(table: pa.Table) -> list[pa.Array]:
    return [pa.array(table[c].to_pylist()[:1], table.schema.field(c).type) for c in ("part", "salt")]


def pair_table(table: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """part, sizes, bits, keys, counts (all binary but part): each part's hash, its pairs in the order of their numbers, and their counts among documents of ``encoded``."""
    seen = cut(counted(table, ship_names(tokenizers, table.sparkSession)))
    rows = seen.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, math.ceil(rows / FAN))

    def union(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(of_bytes(table["keys"])))
        return pa.table([*first_of(table), pa.array([keys.tobytes()], pa.binary())], names=["part", "salt", "keys"])

    def hashed(batches):
        for b in batches:
            for part, raw in zip(b.column(0), b.column(1), strict=True):
                sizes, bits, keys = build(np.frombuffer(raw.as_py(), np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, np.packbits(bits), keys))], names=["part", "sizes", "bits", "keys"])

    distinct = in_tree(seen.drop("counts"), salts, "part int, salt bigint, keys binary", union)
    hashes = cut(distinct.select("part", "keys").mapInArrow(hashed, "part int, sizes binary, bits binary, keys binary"))

    def dense(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The sum of dense vectors of the arrays of a part and salt."""
        own = loaded(right.to_pylist())
        total = np.zeros(len(own.keys), np.int64)
        for keys, counts in zip(of_bytes(left["keys"]), of_bytes(left["counts"], np.int64), strict=True):
            total[own.find(keys)] += counts
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "salt", "counts"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table([*first_of(table), pa.array([np.sum(of_bytes(table["counts"], np.int64), axis=0).tobytes()], pa.binary())], names=["part", "salt", "counts"])

    for_all = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    vectors = seen.withColumn("salt", F.pmod("salt", F.lit(salts))).groupBy("part", "salt").cogroup(for_all.groupBy("part", "salt")).applyInArrow(dense_of_some(dense), "part int, salt bigint, counts binary")
    if salts > 1:
        vectors = in_tree(vectors, math.ceil(salts / FAN), "part int, salt bigint, counts binary", add)
    return cut(hashes.join(vectors.drop("salt"), "part"))


def dense_of_some(dense):
    """A salt without arrays has no vector."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["part", "salt", "counts"])
        return dense(key, left, right)

    return run


def loaded(rows: list[dict]) -> Hash:
    parts = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        sizes = np.frombuffer(r["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: sizes.sum()].astype(bool)
        parts[r["part"]] = (sizes, bits, np.frombuffer(r["keys"], np.uint64))
    return Hash(parts)


def pairs(table: DataFrame) -> DataFrame:
    """a, b, n_docs of every linked pair, out of a ``pair_table``."""
    def run(batches):
        for b in batches:
            for raw, counts in zip(b.column(0), b.column(1), strict=True):
                keys = np.frombuffer(raw.as_py(), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int64)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(np.frombuffer(counts.as_py(), np.int64))], names=["a", "b", "n_docs"])

    return table.select("keys", "counts").mapInArrow(run, "a bigint, b bigint, n_docs bigint")


def looked_up(table: DataFrame, tokenizers: Tokenizers, most: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of the documents of ``encoded``, a table that is read twice.

    count_sum adds the counts of documents of the links' pairs; n_best counts links whose pair is the most frequent one of its first id, ties included.
    """
    spark = table.sparkSession
    counts, shipped = pair_table(table, tokenizers), ship_names(tokenizers, spark)
    top = pairs(counts).groupBy("a").agg(F.max("n_docs").alias("n")).toPandas()  # a row for each id of the first vocabulary at most
    best = np.zeros(int(top["a"].max()) + 1 if len(top) else 0, np.int64)
    best[top["a"].to_numpy(np.int64)] = top["n"]
    tables, held = [[]], 0
    for part, n in sorted(counts.select("part", F.length("counts") / 8).collect()):  # a row for each part
        if held and held + n > most:
            tables.append([])
            held = 0
        tables[-1].append(part)
        held += n
    now = table.select("doc_id", "a", "b", *(F.lit(0).cast("bigint").alias(c) for c in SUMS))
    for number, own in enumerate(tables):
        last = number == len(tables) - 1
        ready = spark.sparkContext.broadcast((uuid.uuid4().hex, counts.where(F.col("part").isin(own)).toPandas().to_dict("records"), best))  # at most ``most`` pairs, or one part
        middle = [T.StructField(c, T.LongType()) for c in COUNTS] if last else [T.StructField(c, T.BinaryType()) for c in "ab"]
        schema = T.StructType([now.schema["doc_id"], *middle, *(T.StructField(c, T.LongType()) for c in SUMS), *([T.StructField("groups_sha256", T.StringType())] if last else [])])

        def run(batches, ready=ready, last=last, schema=schema):
            names, (hash_, n_docs, top) = names_of(shipped), table_of(ready)
            for b in batches:
                for at in range(0, b.num_rows, BATCH):
                    part = b.slice(at, BATCH)
                    found, n_a, n_b = align_rows(part.column(1), part.column(2), names, last)
                    slot = hash_.find(found.keys)
                    n = np.where(slot >= 0, np.r_[n_docs, 0][slot], 0)
                    most_frequent = (slot >= 0) & (top[(found.keys >> np.uint64(32)).astype(np.int64)] == n)
                    sums = [np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][found.links_at]) + part.column(3 + i).to_numpy() for i, x in enumerate((most_frequent, n))]
                    own, digests = [part.column(1), part.column(2)], []
                    if last:
                        own = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, np.diff(found.groups_at), np.diff(found.links_at))]
                        digests = [pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in listing(found, names)], pa.string())]
                    yield pa.RecordBatch.from_arrays([part.column(0), *own, *map(pa.array, sums), *digests], names=schema.names)

        now = now.mapInArrow(run, schema)
        now = now if last else cut(now)
    return now


_tables: dict = {}


def table_of(ready) -> tuple[Hash, np.ndarray, np.ndarray]:
    """A worker's hash, counts and greatest counts of the last broadcast table."""
    name, rows, best = ready.value
    if name not in _tables:
        _tables.clear()
        _tables[name] = (loaded(rows), np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["part"]))]), best)
    return _tables[name]
