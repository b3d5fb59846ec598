import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spikeloom.llm import queries, token_alignment

P = pytest.importorskip("public_tokenizers")
TOKENIZERS = token_alignment.Tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
PARTS_OF_TEXTS = ["a", "the", " ", "  ", "\n", " \n", "'s", "é", " ", "　", "１", "23", "<s>", "<|endoftext|>", "<0x41>", "ﬁ", "😀", "\x00", "\x1c", "\x85", "!", "ing", " of", "\r\n", "▁", "b́", "가", "²", "ª", "b#", "é.", "z*(", "²."]


@pytest.fixture(scope="module")
def tool():
    with open(TOKENIZERS.a) as f, open(TOKENIZERS.b, "rb") as g:
        return token_alignment.Encoders(f.read(), g.read(), P.PATTERN)


def tokens(tool, text):
    """Whole texts by the libraries themselves."""
    if not text:
        return [], []
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    raw = (" " + text).encode()
    return (a, b) if b"".join(tool.bytes_a[i] for i in a) == raw == b"".join(tool.bytes_b[i] for i in b) else ([], [])


def brute(tool, text):
    a, b = tokens(tool, text)
    ranges = []
    for ids, size in ((a, tool.bytes_a), (b, tool.bytes_b)):
        ends = np.cumsum([len(size[i]) for i in ids]).tolist()
        ranges.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)) if ids else [])
    links = [(x[2], y[2]) for x in ranges[0] for y in ranges[1] if x[0] < y[1] and y[0] < x[1]]
    cuts, groups = sorted({x[1] for x in ranges[0]} & {y[1] for y in ranges[1]}), []
    for s, e in zip([0, *cuts[:-1]], cuts, strict=True) if cuts else ():
        groups.append("|".join(",".join(str(x[2]) for x in r if s < x[1] <= e) for r in ranges))
    return len(a), len(b), groups, links


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS_OF_TEXTS), max_size=12).map("".join), min_size=1, max_size=5))
def test_ids_and_groups_of_any_texts(tool, texts):
    import pyarrow as pa

    found = tool.encode([*texts, None])
    names = token_alignment.Names(*(np.array(list(map(len, x))) for x in (tool.bytes_a, tool.bytes_b)))
    own, *_ = token_alignment.align_rows(*(pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)), names)
    for k, text in enumerate([*texts, None]):
        assert tuple(np.frombuffer(x, tool.kind).tolist() for x in found[k]) == tokens(tool, text)
        _, _, groups, links = brute(tool, text)
        assert token_alignment.listing(own, names)[k].decode() == ";".join(groups)
        assert sorted(own.keys[own.links_at[k] : own.links_at[k + 1]].tolist()) == sorted(a << 32 | b for a, b in links)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=3000), st.sets(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=40, deadline=None)
def test_minimal_perfect_hash(own, others):
    keys = np.array(sorted(own), np.uint64)
    part = token_alignment.part_of(keys)
    hash_ = token_alignment.Hash({int(p): token_alignment.build(keys[part == p]) for p in np.unique(part)})
    assert sorted(hash_.find(keys).tolist()) == list(range(len(keys)))
    strange = np.array(sorted(others - own), np.uint64)
    assert (hash_.find(strange) == -1).all()


TEXTS = ["the cat sat", "the cat sat on  the mat", "", None, "it's 12345 ｗｉｄｅ 가나\n\n x", "a▁b", "<|endoftext|> <s>", " ", "x" * 3000 + " the", "the cat sat"]


@pytest.mark.parametrize("most", [1 << 22, 3])
def test_query_against_brute_force(spark, tool, tmp_path, monkeypatch, most):
    rows = [(i % 7, t) for i, t in enumerate(TEXTS + ["the hot text"] * 40)] + [(None, "null id")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, a int, groups int, n_best int")  # names of the operator's own
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(token_alignment, "FAN", 2)  # trees of several levels
    if most == 3:  # many tables
        encoded = token_alignment.cut(token_alignment.encoded(docs.repartition(6), TOKENIZERS))
        found = token_alignment.looked_up(encoded, TOKENIZERS, most=60)
    else:
        found = queries.op12_token_alignment(spark, str(tmp_path))
    made = [(i, brute(tool, t)) for i, t in rows]
    count = Counter(p for _, (_, _, _, links) in made for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    expected = [(i, na, nb, len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for i, (na, nb, g, links) in made]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_tables_of_pairs_and_groups(spark, tool):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the cats"), (3, None)], "doc_id bigint, text string")
    encoded = token_alignment.encoded(docs, TOKENIZERS)
    made = [brute(tool, t) for t in ("the cat", "the cats", None)]
    count = Counter(p for *_, links in made for p in set(links))
    assert {(r["a"], r["b"]): r["n_docs"] for r in token_alignment.pairs(token_alignment.pair_table(encoded, TOKENIZERS)).collect()} == dict(count)
    assert [r["groups"] for r in token_alignment.aligned(encoded, TOKENIZERS).orderBy("doc_id").collect()] == [";".join(m[2]) for m in made]
    none = docs.limit(0)
    assert token_alignment.looked_up(token_alignment.encoded(none, TOKENIZERS), TOKENIZERS).collect() == []
