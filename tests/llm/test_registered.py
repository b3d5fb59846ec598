"""The registered queries without SQL, and whole runs of the pipeline, against brute force over a small folder of tables."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from spikeloom.llm import langid, queries, quality_rules, site_quality

WORDS = {
    "en": "the quick brown fox jumps over the lazy dog while seven wizards mix potions near old stone bridges every single night and nobody sees them go home".split(),
    "de": "der schnelle braune fuchs springt ueber den faulen hund waehrend sieben zauberer nachts alte traenke mischen und niemand sieht sie nach hause gehen".split(),
}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h64(text, seed=42):
    return xxhash.xxh64_intdigest(text.encode(), seed)


def signed(x):
    return x - (x >> 63 << 64)


def documents():
    rng = np.random.default_rng(21)
    rows = []
    for i in range(160):
        lang = ["en", "de"][i % 2]
        lines = [". ".join(" ".join(rng.choice(WORDS[lang], rng.integers(5, 12))) for _ in range(4)) + "." for _ in range(rng.integers(1, 5))]
        rows.append((i, "\n".join(lines), lang if i % 17 else None, f"site{i % 7 if i % 3 else 0}", None))
    rows += [(200, rows[0][1], "en", "site1", None), (201, rows[4][1].replace("fox", "cat", 1), "en", "site1", None), (202, "", "en", None, 0), (203, None, None, "site2", None), (204, "!!! 123", "de", "site2", None),
             (205, rows[2][1] + ' password = "abcdefghijkl0123" end', "en", "site3", None), (206, "# $ " * 60 + rows[6][1], "en", "site3", None), (207, rows[8][1] * 40, "en", "site4", None)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 160, 2)] + [(206, 0, 0), (0, 0, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def fold(i, n):
    import zlib

    return zlib.crc32(str(i).encode()) % n


def test_op1(spark, folder):
    got = {r["doc_id"]: r for r in queries.op1_simhash(spark, folder).collect()}
    prints = {}
    for i, text, *_ in documents():
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                p, q = root[i], root[j]
                root = {k: min(p, q) if v in (p, q) else v for k, v in root.items()}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def brute_language(rows, text, sample_docs=256, dict_bytes=262_144):
    """(language, score) by plain compression, with dictionaries that are made anew."""
    def made(sample):
        out = []
        for lang in sorted({s[0] for s in sample}):
            d = zstandard.ZstdCompressionDict(b"\n".join(raw for x, _, raw in sample if x == lang), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((lang, zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return out

    def sizes(tools, t):
        raw = t.lower().encode()
        return [(sum(len(c.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096)), lang) for lang, c in tools]

    sample = []
    for lang in ("de", "en"):
        own = sorted({t for _, t, x, *_ in rows if x == lang and t and len(t.lower().encode()) <= dict_bytes}, key=lambda t: (h64(t) >> 11, signed(h64(t))))
        before = 0
        for n, t in enumerate(own[:sample_docs], 1):
            if before < dict_bytes:
                sample.append((lang, n, t.lower().encode()))
            before += len(t.lower().encode())
    halves = [made([s for s in sample if s[1] % 2 == k]) for k in (0, 1)]
    kept = [s for s in sample if s[0] not in dict(halves[1 - s[1] % 2]) or min(sizes(halves[1 - s[1] % 2], s[2].decode()), key=lambda x: x[0])[1] == s[0]]
    tools = made(kept)
    out = []
    for t in text:
        if t is None or not any(map(str.isalpha, t)):
            out.append(("und", 0.0))
            continue
        found, raw = sizes(tools, t), t.lower().encode()
        least = min(s for s, _ in found)
        out.append((next(x for s, x in found if s == least), 1 / sum(2.0 ** max(-60.0, (least - s) * 4096 / max(4096, len(raw))) for s, _ in found)))
    return out


def test_op3(spark, folder):
    rows = documents()
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, folder).collect()}
    want = brute_language([r for r in rows if fold(r[0], 3) != 1], [r[1] for r in rows])
    for (i, *_), (lang, score) in zip(rows, want, strict=True):
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (lang, fold(i, 3) == 1) and got[i]["score"] == pytest.approx(score)


def test_languages_are_learned_from_whole_texts_and_never_lost(spark):
    rare = " ".join(WORDS["de"] * 3)
    rows = [(i, " ".join(np.random.default_rng(i).permutation(WORDS["en"])), "en", None, None) for i in range(8)] + [(9, rare, "de", None, None)]
    content = langid.learn(spark.createDataFrame(rows, SCHEMA))
    assert set(content) == {"en", "de"} and content["de"] == rare.encode()
    long = [(i, f"{i} " + " ".join(np.random.default_rng(i).choice(WORDS["en"], 1500)), "en", None, None) for i in range(60)]
    content = langid.learn(spark.createDataFrame(long, SCHEMA), dict_bytes=50_000)["en"]
    assert 50_000 <= len(content) < 70_000 and all(part.decode() in {t.lower() for _, t, *_ in long} for part in content.split(b"\n"))
    other = [(-i, *r[1:]) for i, r in enumerate(long)]
    assert langid.learn(spark.createDataFrame(other, SCHEMA), dict_bytes=50_000)["en"] == content  # ids play no part


def test_long_and_contradicted_texts_are_learned(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(WORDS["en"])), "en", None, None) for i in range(8)]
    rows += [(20 + i, " ".join(np.random.default_rng(i).choice(WORDS["de"], 60_000)), "de", None, None) for i in range(5)]  # all longer than a dictionary
    content = langid.learn(spark.createDataFrame(rows, SCHEMA))
    assert set(content) == {"en", "de"} and len(content["de"]) < 2 * 262_144
    wrong = rows[:8] + [(40 + i, " ".join(np.random.default_rng(50 + i).permutation(WORDS["en"])), "xx", None, None) for i in range(4)]
    assert "xx" in langid.learn(spark.createDataFrame(wrong, SCHEMA))  # contradicted throughout, not lost
    many = rows + [(100 + i, f"word {i}", f"l{i}", None, None) for i in range(30)]
    assert len(langid.learn(spark.createDataFrame(many, SCHEMA), most_langs=2)) == 2 and set(langid.learn(spark.createDataFrame(many, SCHEMA), most_langs=2)) == {"en", "de"}


def brute_fingerprint(text):
    import re

    lanes = [0] * 69
    for p in re.split(r"\n+|(?<=[.!?])\x20+", text):
        if p:
            bits, a, b = h64(p), h64_chain(p, 1), h64_chain(p, 2)
            for k, v in enumerate([1, a & 0xFFFFFFFF, a >> 32, b & 0xFFFFFFFF, b >> 32]):
                lanes[k] = (lanes[k] + v) % (1 << 32)
            for k in range(32):
                lanes[5 + k] += bits >> k & 1
                lanes[37 + k] += bits >> (k + 32) & 1
    return lanes


def h64_chain(text, second):
    """Spark's xxhash64(text, second): the second value, an int, is hashed with the first one's hash as its seed."""
    return xxhash.xxh64_intdigest(int(second).to_bytes(4, "little"), h64(text))


def brute_likeness(a, b):
    if a == b or a[0] + b[0] == 0:
        return 1.0
    d = sum((2 * x - a[0] - 2 * y + b[0]) ** 2 for x, y in zip(a[5:], b[5:], strict=True)) / 64
    d = min(max(d, abs(a[0] - b[0])), a[0] + b[0])
    return (a[0] + b[0] - d) / (a[0] + b[0] + d)


def test_op7(spark, folder):
    got = {r["doc_id"]: r for r in queries.op7_multiset_hash(spark, folder).collect()}
    rows = sorted((i, t or "") for i, t, *_ in documents())
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        part = len(t) // 4
        edited = t[: len(t) - part] + after[:part]
        f, e, n = map(brute_fingerprint, (t, edited, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in f) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in e)
        assert r["near_edited"] == pytest.approx(brute_likeness(f, e)) and r["near_next"] == pytest.approx(brute_likeness(f, n))


@pytest.mark.parametrize("ids", ["sparse", "clustered", "null"])
def test_successors_of_any_ids(spark, ids):
    from spikeloom.llm import multiset_hash

    rng = np.random.default_rng(4)
    values = {"sparse": rng.integers(-(1 << 62), 1 << 62, 400).tolist(), "clustered": [*range(300), *(10**12 + k for k in range(100))], "null": [None] * 200 + list(range(50))}[ids]
    rows = [(v, f"t{k}", signed(h64(f"t{k}"))) for k, v in enumerate(values)]
    got = {r["text"]: r["next"]["text"] for r in multiset_hash.successors(spark.createDataFrame(rows, "doc_id bigint, text string, tie bigint"), ["text"], tie="tie", width=16).collect()}
    order = [t for _, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]
    assert got == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}


def test_op8(spark, folder):
    got = {r["doc_id"]: r for r in queries.op8_site_quality(spark, folder).collect()}
    rows, good = documents(), defaultdict(lambda: 1)
    labels = [(i, int(i % 5 != 0)) for i in range(0, 160, 2)] + [(206, 0), (0, 0)]
    for i, q in labels:
        good[i] = min(good[i], q)
    counts = {i: dict(zip(quality_rules.COUNTS, quality_rules.counts(t), strict=True)) for i, t, *_ in rows}

    def features(c):
        share = lambda a, b: min(1.0, c[a] / max(c[b], 1))
        return [1.0, share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_capitals", "n_letters"), share("n_marks", "n_words"),
                math.log1p(c["n_words"]) / 10, min(c["word_chars"] / max(c["n_words"], 1), 20.0) / 10, float(c["n_words"] < 20)]

    x = np.array([features(counts[i]) for i in good])
    w = site_quality.logistic(x, np.array([float(good[i]) for i in good]))
    p = {i: 1 / (1 + math.exp(-float(np.dot(w, features(counts[i]))))) for i, *_ in rows}
    e = {i: float(good[i]) if i in good else p[i] for i, *_ in rows}
    site = {i: (s or "", lang or "") for i, _, lang, s, _ in rows}
    mean = sum(e.values()) / len(e)
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, (h, q) in site.items():
        hosts[h].append(i), paths[h, q].append(i)

    def strength(groups, center):
        spread = sum(len(g) * (sum(e[i] for i in g) / len(g) - center(k)) ** 2 for k, g in groups.items())
        between = max(0.0, spread / len(e) - mean * (1 - mean) * len(groups) / len(e))
        return min(1e4, max(1.0, mean * (1 - mean) / between - 1 if between > 0 else 1e4))

    k_host = strength(hosts, lambda _: mean)
    host_mean = {h: (k_host * mean + sum(e[i] for i in g)) / (k_host + len(g)) for h, g in hosts.items()}
    k_path = strength(paths, lambda k: host_mean[k[0]])
    logit = lambda v: math.log(v / (1 - v))
    for i, (h, q) in site.items():
        host = (k_host * mean + sum(e[j] for j in hosts[h]) - e[i]) / (k_host + len(hosts[h]) - 1)
        path = (k_path * host + sum(e[j] for j in paths[h, q]) - e[i]) / (k_path + len(paths[h, q]) - 1)
        quality = 1 / (1 + math.exp(-(logit(p[i]) + logit(path) - logit(mean))))
        r = got[i]
        assert (r["host"], r["path"], r["kept"]) == (h, q, quality >= 0.5)
        assert [r[c] for c in ("p_document", "host_posterior", "path_posterior", "p_quality")] == pytest.approx([p[i], host, path, quality], rel=1e-4)


def test_hosts_keep_their_characters(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "a\tb", 1)], SCHEMA)
    r = site_quality.classify(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).first()
    assert (r["host"], r["path"]) == ("a\tb", "en")


def brute_cutoffs(rows, labels, risk=0.05, level=0.05, most=2):
    bins = {}
    for i, text, lang, *_ in rows:
        c = dict(zip(quality_rules.COUNTS, quality_rules.counts(text), strict=True))
        if c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"] or i not in labels:
            continue
        share = lambda a, b: min(200, math.ceil(min(1.0, c[a] / max(c[b], 1)) * 200))
        at = [share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_capitals", "n_letters"), share("n_marks", "n_words")]
        k = (text, lang)
        had = bins.get(k, (1, at))
        bins[k] = (min(had[0], labels[i]), max(had[1], at))
    halves = [[(lang, g, at) for (t, lang), (g, at) in bins.items() if signed(h64(t)) % 2 == k] for k in (0, 1)]

    def split(half, lang, r):
        return [[at[r] for x, g, at in half if x == lang and g == q] for q in (1, 0)]

    chosen = []
    for lang in {x for x, *_ in halves[0]}:
        gains = []
        for r, name in enumerate(quality_rules.RULES):
            good, bad = split(halves[0], lang, r)
            gain = max(sum(b > t for b in bad) / max(1, len(bad)) - 10 * sum(g > t for g in good) / max(1, len(good)) for t in range(1, 201))
            if gain > 1e-12:
                gains.append((-gain, name, r))
        gains = sorted(gains)[:most]
        chosen += [(lang, name, r, risk / len(gains)) for _, name, r in gains]
    out = {}
    for lang, name, r, part in chosen:
        good, bad = split(halves[1], lang, r)
        best, gain = None, 0.0
        for t in range(199, 0, -1):
            k = sum(g > t for g in good)
            if not good or k > part * len(good) or sum(math.comb(len(good), j) * part**j * (1 - part) ** (len(good) - j) for j in range(k + 1)) > level / len(chosen):
                break
            got = sum(b > t for b in bad) / max(1, len(bad)) - 10 * k / len(good)
            if got > gain + 1e-12:
                best, gain = t / 200, got
        if best is not None:
            out[lang, name] = best
    return out


def test_op10_certifies_like_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], {}
    for i in range(1400):
        lang = ["en", "de", None][min(i % 5, 2)]
        words = rng.permutation(WORDS["en"] + WORDS["de"]).tolist()
        bad = rng.random() < 0.2
        for k in range(0, len(words), 3) if bad and rng.random() < 0.9 else range(int(rng.random() < 0.004)):
            words[k] += " ###"
        rows.append((i, " ".join(words), lang, None, None))
        labels[i] = int(not bad)
    rows += [(5000 + i, rows[1][1], rows[1][2], None, None) for i in range(200)]  # copies are no evidence
    labels |= {5000 + i: labels[1] for i in range(200)}
    docs = spark.createDataFrame(rows, SCHEMA)
    measured = quality_rules.measure(docs)
    found = quality_rules.calibrate(measured, spark.createDataFrame([*labels.items()], "doc_id bigint, quality int")).collect()
    want = brute_cutoffs(rows, labels)
    assert {(r["stratum"], r["rule"]): r["cutoff"] for r in found} == pytest.approx(want) and len(want) >= 2


def test_op10_verdicts(spark, folder):
    got = {r["doc_id"]: r for r in queries.op10_quality_rules(spark, folder).collect()}
    labels = {i: int(i % 5 != 0) for i in range(0, 160, 2)} | {206: 0, 0: 0}
    cutoffs = brute_cutoffs(documents(), labels)
    for i, text, lang, *_ in documents():
        c = dict(zip(quality_rules.COUNTS, quality_rules.counts(text), strict=True))
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        scores = dict(zip(quality_rules.RULES, (c["n_symbols"] / max(c["n_words"], 1), c["n_dup_lines"] / max(c["n_lines"], 1), c["n_repeat_words"] / max(c["n_words"], 1), c["n_capitals"] / max(c["n_letters"], 1), c["n_marks"] / max(c["n_words"], 1)), strict=True))
        rejected = [r for r, s in scores.items() if (lang, r) in cutoffs and math.ceil(min(1.0, s) * 200) / 200 > cutoffs[lang, r]]
        assert got[i]["base_failed"] == failed and got[i]["rejected_by"] == rejected and got[i]["kept"] == (not failed and not rejected)


def test_pipeline_runs(spark, folder):
    rows = {r[0]: r for r in documents()}
    stages = {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
        stages[name] = {r["doc_id"]: r for r in docs.collect()}
    language = brute_language(documents(), [r[1] for r in documents()])
    pred = {i: x for i, (x, _) in zip(rows, language, strict=True)}
    assert not {202, 203, 204} & set(stages["language"]) and all(r["lang"] == pred[i] and r["text"] == rows[i][1] for i, r in stages["language"].items())
    assert len(stages["language"]) >= 150
    # a text of less than 20 words or with too many repeats goes; what is left is as before
    assert 207 not in stages["rules"] and all(len(r["text"].split()) >= 20 for r in stages["rules"].values()) and len(stages["rules"]) > 100
    ids = list(stages["rules"])
    from test_pipeline import linked

    root = linked([stages["rules"][i]["text"] for i in ids])
    assert set(stages["near_duplicates"]) == {min(ids[k] for k in range(len(ids)) if root[k] == r) for r in set(root)} and not {200, 201} & set(stages["near_duplicates"])
    for i, r in stages["secrets"].items():
        assert r["text"] == (rows[2][1] + " [REDACTED]\" end" if i == 205 else rows[i][1])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(stages["secrets"]) and all(len(r["ids"]) == r["length"] for r in packed)
    tokens = defaultdict(int)
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    assert all(r["doc_tokens"] == tokens[r["doc_id"]] for r in packed)


def test_pipeline_on_nothing_and_on_clashing_columns(spark, nothing, folder):
    assert corpus_pipeline.run(spark, nothing).count() == 0
    names = ["row", "key", "component", "spans", "blob", "stratum", "text_key", "lang_pred", "size"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    for c in names:
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and all(r[c] == "clash" for r in out.collect() for c in names), name
    packed = corpus_pipeline.pack(spark, docs, folder)
    assert packed.count() >= 40


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_on_empty_tables(spark, nothing, name):
    if name == "op2_url_filter":
        spark.createDataFrame([], "page_id bigint, url string, html string").write.mode("overwrite").parquet(f"{nothing}/pages.parquet")
    assert queries.queries()[name](spark, nothing).count() == 0
