"""Corpus pipeline: language, quality rules, near-duplicates, secrets, packing.

Each stage takes what the one before kept, as Parquet. Language ID corrects ``lang`` and drops what it rejects; the rules
drop what they reject; of near-duplicates the document with the least id stays (a null id is the greatest; then the
least text hash decides, then the least row); secrets are redacted in the text; packing
returns pieces of token sequences with their ids.

Edge cases of all stages: null and empty texts have no letter and go in the first stage; a stage that gets them all the same keeps one
of them as near duplicates of each other, and packs an end id for each. Null and repeated ids are told apart by their texts. Repeated rows are near duplicates. Ties of ids and
texts are broken by the whole row. Extra columns are kept, whatever their names. Very long texts are read whole. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.llm import langid, packing, quality_rules, secret_scan, simhash
from spikeloom.llm.common import cut, shared_folder, table

#: Compression, fingerprints and packing have no SQL equivalent; stages and whole runs are tested against brute force.
ORACLE_SQL = None


def whole(docs: DataFrame) -> DataFrame:
    """Each row as one struct, ``row``, so that no extra column clashes with those of an operator."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def back(found: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` out of ``row``, some of them changed."""
    return found.select(*((changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(whole(docs), langid.learn(docs), text_col="row.text", carry=["row"]).where("accepted")
    return back(found, docs, lang=F.col("lang_pred"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cutoffs = quality_rules.calibrate(cut(quality_rules.measure(docs)), table(spark, sf_dir, "labels"))
    measured = quality_rules.measure(whole(docs), text_col="row.text", stratum_col="row.lang", carry=["row"])
    return back(quality_rules.judge(measured, cutoffs).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # sets of five-word shingles; 192 bits, of which 29 +- 5 differ at a Jaccard similarity of 0.8, so a radius of 46 loses one pair in some thousands there; links are then checked exactly
    found = simhash.near_duplicates(docs)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (text_key == F.col("first_key")), "left_semi")
    return back(kept.groupBy("doc_id", text_key.alias("text_key")).agg(F.min(F.struct(*docs.columns)).alias("row")), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(whole(docs).withColumn("text", F.col("row.text")))
    clean = secret_scan.redact(F.col("row.text"), F.col("spans"))
    return back(found, docs, text=clean, n_chars=F.when(F.size("spans") > 0, F.length(clean).cast("bigint")).otherwise(F.col("row.n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", language), ("rules", rules), ("near_duplicates", near_duplicates), ("secrets", secrets), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
