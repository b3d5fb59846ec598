"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.llm import bpe, context_mixing, langid, multiset_hash, packing, plane_clusters, quality_rules, secret_scan, simhash, site_quality, substring_dedup, token_alignment, url_filter
from spikeloom.llm.common import cut, fold, table

#: The rules of the URL query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2, seeds=(42,), size_ratio=None, least=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP2_SQL = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hits AS (SELECT page_id, host, path, r_host || r_path AS rule, r_verdict FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n FROM hits)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM ranked WHERE n = 1
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = langid.learn(docs.where(fold(F.col("doc_id"), 3) != 1))
    return langid.predict(docs, content).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut_up = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packing.pack(cut_up)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = secret_scan.scan(docs.where(fold(F.col("doc_id"), 2) == 0))  # a first version of the corpus is in the ledger already
    found, _ = secret_scan.scan(docs, ledger)  # the whole of it: only blobs that the ledger doesn't have are scanned
    n = {kind: secret_scan.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind, *_ in secret_scan.RULES}
    listing = secret_scan.listing(F.col("spans"))
    return found.select("doc_id", *n.values(), F.sha2(listing, 256).alias("base_sha256"), listing.alias("spans"))


OP6_SQL = r"""
WITH k(kind, rank, pat, g, least) AS (VALUES ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12), ('access', 1, 'AKIA[A-Z0-9]+', 0, 18), ('hex', 2, '[0-9a-f]{16,}', 0, 16)),
m AS (SELECT doc_id, kind, rank, least, list_transform(string_split_regex(coalesce(text, ''), pat), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(coalesce(text, ''), pat), lambda x: length(x)) AS n,
  list_transform(CASE WHEN g = 2 THEN regexp_extract_all(coalesce(text, ''), pat, 2) ELSE regexp_extract_all(coalesce(text, ''), pat) END, lambda x: length(x)) AS held FROM documents CROSS JOIN k),
s AS (SELECT doc_id, kind, rank, (list_sum(gaps[1:i]) + coalesce(list_sum(n[1:i - 1]), 0))::BIGINT AS first, n[i] AS len FROM m, unnest(range(1, len(n) + 1)) u(i) WHERE held[i] >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || first || ':' || (first + len), ',' ORDER BY first, rank) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id)
"""


def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    mh = multiset_hash
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = mh.successors(docs.withColumn("tie", F.xxhash64("text")), ["text"], tie="tie")
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - part), F.substring("next.text", F.lit(1), part))
    rows = rows.select("doc_id", "text", F.col("next.text").alias("next"), edited.alias("edited"), n.cast("bigint").alias("n_chars"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(mh.fingerprint(F.col(c)).alias(f"_{c}") for c in ("text", "edited", "next")))
    likeness = [mh.likeness(F.col("_text"), F.col(f"_{c}")).alias(f"near_{c}") for c in ("edited", "next")]
    return rows.select("doc_id", "n_chars", "edited_sha256", mh.as_text(F.col("_text")).alias("fingerprint"), mh.as_text(F.col("_edited")).alias("edited_fingerprint"), *likeness)


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 1
    return context_mixing.score(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(quality_rules.measure(table(spark, sf_dir, "documents")))
    cutoffs = quality_rules.calibrate(measured, table(spark, sf_dir, "labels"))
    return quality_rules.judge(measured, cutoffs).select("doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept", "rejected_by")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def _op11_sql(least: int = 13, levels: int = 12) -> str:
    """Windows as texts at the first level, as pairs of hashes of halves at the others."""
    steps = [f"l0 AS MATERIALIZED (SELECT doc_id, i, hash(s) AS id FROM g), r0 AS MATERIALIZED (SELECT * FROM l0 WHERE id IN (SELECT id FROM l0 GROUP BY id HAVING count(DISTINCT doc_id) > 1)), n0 AS (SELECT DISTINCT doc_id, {least} AS n FROM r0)"]
    for k in range(1, levels):
        step = least << k - 1
        steps.append(f"l{k} AS MATERIALIZED (SELECT a.doc_id, a.i, hash(a.id, b.id) AS id FROM r{k - 1} a JOIN r{k - 1} b ON a.doc_id = b.doc_id AND b.i = a.i + {step}), r{k} AS MATERIALIZED (SELECT * FROM l{k} WHERE id IN (SELECT id FROM l{k} GROUP BY id HAVING count(DISTINCT doc_id) > 1)), n{k} AS (SELECT DISTINCT doc_id, {2 * step} AS n FROM r{k})")
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {least - 1}], ' ') AS s FROM d, unnest(range(1, len(w) - {least - 2})) u(i)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
gone AS MATERIALIZED (SELECT DISTINCT g.doc_id, g.i + k AS p FROM g JOIN m USING (s), range({least}) r(k) WHERE least < doc_id),
words AS (SELECT doc_id, w[p] AS word, p FROM d, unnest(range(1, len(w) + 1)) u(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
{", ".join(steps)},
most AS (SELECT doc_id, max(n) AS n FROM ({" UNION ALL ".join(f"SELECT * FROM n{k}" for k in range(levels))}) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(m.n, 0)::BIGINT AS longest
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed r USING (doc_id) LEFT JOIN most m USING (doc_id)
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizers = token_alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return token_alignment.looked_up(cut(token_alignment.encoded(table(spark, sf_dir, "documents"), tokenizers)), tokenizers)


def op13_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = plane_clusters.cluster(table(spark, sf_dir, "embeddings"))
    names = spark.createDataFrame([(c, plane_clusters.digest(x)) for c, x in enumerate(centroids)], "cluster int, centroid_sha256 string")  # a row for each centroid
    return found.join(F.broadcast(names), "cluster")


def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT c, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{r}, range(1, 65) t(i) GROUP BY c, i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS x FROM m{r} GROUP BY c UNION ALL SELECT c, x FROM c{r} WHERE c NOT IN (SELECT c FROM m{r}))")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < {k}),
{", ".join(steps)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_language_id, op4_byte_bpe, op5_packing, op6_secret_scan, op7_multiset_hash, op8_site_quality, op9_context_mixing, op10_quality_rules, op11_substring_dedup, op12_token_alignment, op13_plane_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op6_secret_scan": OP6_SQL, "op11_substring_dedup": _op11_sql(), "op13_plane_clusters": _op13_sql()}
