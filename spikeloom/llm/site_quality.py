"""Quality classifier with hierarchical empirical Bayes over sites.

1. Document evidence: a logistic regression over rule scores and length, fitted on a bounded sample of labelled rows (the
   ``fit_rows`` with the smallest hash). It gives p_document.
2. Host and path evidence: grouped sums of the labels, or of p_document where there is no label, by host and by
   (host, path). A host's posterior shrinks to the global mean m with a strength that the method of moments
   estimates from the spread of host means; a path's posterior shrinks to its host's in the same way. Sparse sites so stay near
   the prior. A document's own share is taken out of its path's and host's sums.
3. Both are combined as odds: logit p = logit p_document + logit path - logit m.

Edge cases: a null host or path counts as the empty one. A null text has no words, so it is judged by its length alone.
Labels with null quality are left out; repeated label rows count once (bad wins). Without labels p_document is the
constant 0.5. Repeated rows are judged one by one. Hosts with a large part of all rows are joined by broadcast, others by
shuffle. Extra input columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.llm import quality_rules
from spikeloom.llm.common import cut, join_unique


def features() -> list[Column]:
    """Columns over the counts of ``quality_rules.measure``."""
    size = F.log1p(F.col("n_words").cast("double"))
    longish = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return [F.lit(1.0), *quality_rules.scores().values(), size / 10, F.least(longish, F.lit(20.0)) / 10, F.when(F.col("n_words") < 20, 1.0).otherwise(0.0)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * len(y) * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)), grad)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame, fit_rows: int = 20_000) -> np.ndarray:
    """Weights of the features; labelled has the counts and ``good``. One task gets at most ``fit_rows`` rows."""
    xs = [f"x{i}" for i in range(len(features()))]
    sample = labelled.orderBy(F.xxhash64("text_key", "doc_id"), "good").limit(fit_rows)
    sample = sample.select(*(c.cast("double").alias(n) for c, n in zip(features(), xs, strict=True)), F.col("good").cast("double"))

    def run(frames):
        pdf = pd.concat([pd.DataFrame(columns=[*xs, "good"], dtype=float), *frames])
        yield pd.DataFrame({"i": range(len(xs)), "w": logistic(pdf[xs].to_numpy(float), pdf["good"].to_numpy(float)) if len(pdf) else np.zeros(len(xs))})

    return sample.repartition(1).mapInPandas(run, "i bigint, w double").orderBy("i").toPandas()["w"].to_numpy()


def strength(groups: DataFrame, center: Column | str, mean: float) -> float:
    """Prior strength by moments, from groups with n, s (sum of evidence) and the mean they shrink to."""
    m = F.col("s") / F.col("n")
    around = F.col(center) if isinstance(center, str) else center
    total, number, spread = groups.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.col("n") * (m - around) ** 2)).first()
    if not total:
        return 1.0
    noise = mean * (1 - mean)
    between = max(0.0, spread / total - noise * number / total)
    return float(np.clip(noise / between - 1 if between > 0 else 1e4, 1.0, 1e4))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, p_document, host_posterior, path_posterior, p_quality, kept."""
    host, path = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host_col, path_col))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), host.alias("host"), path.alias("path"))
    measured = quality_rules.measure(own, stratum_col="path", carry=["doc_id", "host", "path"])
    judged = labels.where(F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(good_col).alias("good"))
    rows = cut(measured.drop("stratum").join(judged, "doc_id", "left"))
    w = fit(rows.where(F.col("good").isNotNull()))
    p = 1 / (1 + F.exp(-sum((float(a) * c for a, c in zip(w, features(), strict=True)), F.lit(0.0))))
    rows = rows.select("doc_id", "host", "path", p.alias("p_document"), F.coalesce(F.col("good").cast("double"), p).alias("e"))

    paths = cut(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total, good = (x or 0 for x in hosts.agg(F.sum("n"), F.sum("s")).first())
    mean = float(np.clip(good / total, 1e-6, 1 - 1e-6)) if total else 0.5
    k_host = strength(hosts, F.lit(mean), mean)
    named = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    named = named.withColumn("host_mean", (k_host * mean + F.col("host_s")) / (k_host + F.col("host_n")))
    k_path = strength(named, "host_mean", mean)
    own = join_unique(rows, cut(named.withColumn("rows", F.col("n"))), ["host", "path"], "rows")
    own = own.withColumn("host_posterior", (k_host * mean + F.col("host_s") - F.col("e")) / (k_host + F.col("host_n") - 1))
    own = own.withColumn("path_posterior", (k_path * F.col("host_posterior") + F.col("s") - F.col("e")) / (k_path + F.col("n") - 1))
    z = logit(F.col("p_document")) + logit(F.col("path_posterior")) - logit(F.lit(mean))
    out = own.withColumn("p_quality", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "host", "path", "p_document", "host_posterior", "path_posterior", "p_quality", (F.col("p_quality") >= threshold).alias("kept"))
