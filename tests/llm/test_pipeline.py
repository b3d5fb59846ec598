"""The pipeline's stages against brute force."""

import numpy as np

import corpus_pipeline
from spikeloom.llm import simhash

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def linked(texts, least=0.8, width=5):
    """The least index of each text's component, over all pairs."""
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if not sets[i] and not sets[j] or both >= least * (len(sets[i] | sets[j]) or 1) and both:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))]


def family(n, edits, seed=11, size=300):
    """Variants of one text, some of them linked by one another only."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, size)]
    out = []
    for k in range(n):
        c = list(base)
        for at in rng.choice(size, edits, replace=False).tolist():
            c[at] = f"v{rng.integers(0, 3)}"
        out.append(" ".join(c))
    return out


def test_family_of_variants_keeps_its_links(spark):
    texts = family(400, 5) + family(100, 3, seed=12)
    want = linked(texts)
    assert 20 < len(set(want)) < 480
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), radius=80)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_pairs_of_a_crowded_family_are_not_written(spark, monkeypatch):
    """Variants under and just over 0.8, all within the radius: each is compared with all others, but no table grows with their pairs."""
    texts = family(200, 6) + family(100, 3, seed=12)
    want, sizes = linked(texts), []
    assert len(set(want)) > 50
    cut = simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    for block_rows in (4096, 60):  # whole families, and blocks and pairs of them
        found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), radius=80, block_rows=block_rows)
        got = {r["doc_id"]: r["component_id"] for r in found.collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert max(sizes) <= 4 * len(texts)


def test_repeated_passages_and_the_radius(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(20):  # a text, the same with a third of it again and again, and one at a similarity of just over 0.8
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        cut = w[:-20] + [f"z{x}" for x in rng.integers(0, 5000, 20)]
        texts += [" ".join(w), " ".join(w + w[:66] * 3), " ".join(cut)]
    want = linked(texts)
    assert len(set(want)) == 20
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_null_and_repeated_ids_keep_clean_documents(spark):
    a, near_a, b, c, d, e = family(1, 0, 1) + family(1, 1, 1) + [family(1, 0, k)[0] for k in (2, 3, 4, 5)]
    rows = [(None, a, "en", "s", 1), (None, near_a, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "de", "s", 1),
            (7, c, None, None, None), (7, d, "en", "s", 2), (3, e, "en", "s", 3), (None, e, "en", "s", 3), (9, None, None, "s", 0), (None, "", "en", "s", 0)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    by_text = {r["text"]: r for r in kept}
    assert len(kept) == 6 and {b, c, d, e, None} <= {*by_text} and (a in by_text) != (near_a in by_text)
    assert tuple(by_text[b]) == (None, b, "de", "s", 1) and tuple(by_text[c]) == rows[5] and by_text[e]["doc_id"] == 3


def test_pack_keeps_token_ids(spark):
    import zlib

    rows = [(1, "one two three " * 2000, "en", "s", 1), (None, None, None, None, None), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)]
    found = corpus_pipeline.pack(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert len(found) > 4 and all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in found)


def test_recall_of_near_pairs(spark):
    """Over a thousand pairs of a similarity from 0.8 up, nearly all are joined, and nothing else is."""
    rng = np.random.default_rng(9)
    rows, near, apart = [], [], []
    for i in range(1600):
        w = [f"w{x}" for x in rng.integers(0, 9000, rng.integers(60, 200))]
        c = list(w)
        for at in rng.choice(len(c), rng.integers(1, 4), replace=False).tolist():
            c[at] = f"v{i}"
        rows += [(i, " ".join(w)), (10_000 + i, " ".join(c))]
        (near if simhash.jaccard(rows[-2][1], rows[-1][1], 5) >= 0.8 else apart).append(i)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(near) > 1000 and len(apart) > 50
    assert sum(found[10_000 + i] == i for i in near) >= 0.99 * len(near) and all(found[10_000 + i] == 10_000 + i for i in apart)


def test_groups_of_a_crowded_shard_are_bounded(spark):
    rng = np.random.default_rng(10)
    rows = [(k, int(a), int(b), int(s)) for k, (a, b, s) in enumerate(zip(rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(95, 105, 3000)))]
    spread = simhash.deal_out(spark.createDataFrame(rows, "key bigint, f0 bigint, f1 bigint, size bigint"), 36, 2, block=200, size_ratio=0.8).toPandas()
    sizes = spread.groupby(["shard", "low", "high"]).size()
    assert sizes.max() <= 2 * 200 * 1.5 and len(sizes) > 100  # hashed blocks are even but for chance
    pairs = set()
    for _, g in spread.groupby(["shard", "low", "high"]):
        a, b = g[g["own"] == g["low"].iloc[0]], g[g["own"] == g["high"].iloc[0]]
        pairs |= {(x, y) for x, h in zip(a["key"], a["home"]) for y, k in zip(b["key"], b["home"]) if h or k}
    keys = spread["key"].unique()
    assert all((x, y) in pairs or (y, x) in pairs for x in keys[:60] for y in keys[:60] if x < y)
