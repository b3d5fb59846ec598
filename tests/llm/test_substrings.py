import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spikeloom.llm import queries, substring_dedup


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(rows, least=13):
    rank = lambda i: (i is None, i or 0)
    held = {}
    for n, (i, t) in enumerate(rows):
        w = words(t)
        for k in range(len(w) - least + 1):
            held.setdefault(tuple(w[k : k + least]), set()).add((rank(i), n))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - least + 1):
            if min(held[tuple(w[k : k + least])])[0] < rank(i):
                gone.update(range(k, k + least))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def longest(rows, least=13):
    out, length = {}, least
    while True:
        held = {}
        for n, (_, t) in enumerate(rows):
            w = words(t)
            for k in range(len(w) - length + 1):
                held.setdefault(tuple(w[k : k + length]), set()).add(n)
        hit = {n for v in held.values() if len(v) > 1 for n in v}
        if not hit:
            return out
        out.update(dict.fromkeys(hit, length))
        length *= 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "x" * 70, "y" * 64, "longer-word"]), max_size=20).map(" ".join), max_size=6), st.integers(1, 9))
def test_hashes_of_windows(lines, length):
    own = substring_dedup.Words()
    h, sizes, line, *_ = own.words("\n".join(lines).encode())
    flat = [w for x in lines for w in x.split()]
    assert sizes.tolist() == [len(x.split()) for x in lines] or not lines and len(h) == 0
    assert len(h) == len(flat) == len(line)
    assert len({*zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))
    if len(flat) >= length:
        for which in (0, 1):
            found = own.windows(h, length, which).tolist()
            spelled = [tuple(flat[k : k + length]) for k in range(len(flat) - length + 1)]
            assert len({*zip(spelled, found, strict=True)}) == len(set(spelled)) == len(set(found))


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "x" * 90]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, long = text(60), text(700)
    rows = [(i, text(int(rng.integers(1, 60)))) for i in range(30)]
    rows += [(100 + i, f"{text(20)}\n{passage}\t {text(5)}") for i in range(25)]  # a passage that many share
    rows += [(200 + i % 4, long if i % 2 else f"{long} {text(3)}") for i in range(12)]  # long copies, repeated ids
    rows += [(300, passage), (50, "  " + passage), (None, passage), (None, long), (None, text(40)), (7, None), (8, ""), (9, " \n\t"), (10, "a " * 13), (11, "a " * 12), (12, "a " * 40), (-5, text(14))]
    return rows


@pytest.mark.parametrize("bundle", [1 << 20, 150])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, bundle):
    monkeypatch.setattr(substring_dedup, "BUNDLE", bundle)
    monkeypatch.setattr(substring_dedup, "SMALL_BUCKET", 500)
    rows = corpus(np.random.default_rng(5))
    rows += rows[30:34]  # repeated rows
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, bundle string, data int")  # names of the operator's own
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_substring_dedup(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in found), key=str) == brute(rows)
    most = longest(rows)
    assert sorted(r["longest"] for r in found) == sorted(most.get(n, 0) for n in range(len(rows)))


def test_empty_table_and_kept_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x a b c"), (3, "c d e")], "doc_id bigint, text string")
    assert substring_dedup.dedup(docs.limit(0)).collect() == []
    found = {r["doc_id"]: (r["kept"], r["n_removed"]) for r in substring_dedup.dedup(docs, least=2, texts=True).collect()}
    assert found == {1: ("a b c d", 0), 2: ("x", 3), 3: ("e", 2)}
