"""Quality rules whose cutoffs are certified on labelled documents.

Each document gets a handful of counts (words, symbols, repeated lines, repeated 8-word windows) and from
them five scores between 0 and 1. The labelled documents are dealt into two halves by the hash of their text. For
every stratum (language) the first half selects up to ``most_rules`` rules that tell bad documents from good ones. The second half,
which the selection hasn't seen, certifies cutoffs from a fixed grid: a cutoff is *certified* when an exact binomial test on
its good documents shows that the rule rejects at most its share of ``risk`` (``risk`` / selected rules of the stratum).
Cutoffs are tested from the most lenient to the strictest and testing stops at the first failure (fixed-sequence testing, so the
grid costs no correction); the level is divided by the number of selected rules of all strata (Bonferroni). By the union
bound all rules together reject at most ``risk`` of a stratum's good documents, in every stratum at once, with
confidence ``1 - level``. Among the certified cutoffs the one with the best separation is taken; without gain the rule stays off.

With the default risk and level, four strata of two rules need 200 good labelled documents of the second half for the first
cutoff to be certified (0.975^n <= 0.05 / 8), one rule each 86. With fewer, only the base rule acts.

The bound is about good documents that pass the base rule; those that fail it are rejected whatever their label. Equal texts count
once in a sample, since copies are no independent evidence (bad wins among their labels).

Edge cases: a null or empty text has no words and fails the base rule. A null stratum is a stratum of its
own. A stratum without enough labelled good documents gets no cutoff and only the base rule. Repeated
label rows of a document count once (bad wins). Repeated document rows are judged one by one. Very long texts are read whole. Extra input
columns are ignored by ``measure`` (or carried) and kept by ``judge``. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.llm.common import WORD_SPACE, cut

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
RULES = ("symbols", "duplicate_lines", "repeated_words", "capitals", "exclamations")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_marks")
BINS = 200


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside any ``width``-word window that occurs at least twice in ``words``."""
    n = len(words)
    if n <= width:
        return 0
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, had = np.fromiter(map(names.__getitem__, words), np.int64, n), 1
    while had < width:  # windows of twice the size have the pair of both halves' numbers; equal numbers are equal words
        step = min(had, width - had)
        pairs = ids[: len(ids) - step] * n + ids[step:]
        _, ids, times = np.unique(pairs, return_inverse=True, return_counts=True)
        if times.max() == 1:
            return 0
        had += step
    steps = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(times[ids] > 1)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return int((np.cumsum(steps[:n]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one whole text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    codes = np.frombuffer(raw, np.uint8)
    capitals = int(((codes >= 65) & (codes <= 90)).sum())
    letters = capitals + int(((codes >= 97) & (codes <= 122)).sum())
    return (
        len(words), len(text) - sum(text.count(c) for c in WORD_SPACE), sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)), repeated_words(words), len(lines), letters, capitals, text.count("!"),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """stratum, text_key (the text's hash), the COUNTS and base_failed beside the columns ``carry``, by default the id as doc_id.

    ``carry`` must not have those names; a struct of all columns avoids that.
    """
    beside = [F.col(id_col).alias("doc_id")] if carry is None else [F.col(c) for c in carry]
    src = docs.select(*beside, F.col(stratum_col).cast("string").alias("stratum"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches):
        for b in batches:
            rows = [counts(x.as_py()) for x in b.columns[-1]]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return src.mapInArrow(run, schema).withColumn("base_failed", failed)


def scores() -> dict:
    """The score of each rule, 0 to 1, as a column over the COUNTS; larger is worse."""
    def share(a, b):
        return F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))

    return dict(zip(RULES, (share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_capitals", "n_letters"), share("n_marks", "n_words")), strict=True))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding."""
    if k >= n:
        return 1.0
    at = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(at)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in at))


def separation(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """By cutoff 0..BINS: the share of bad documents above it less ten times the share of good ones."""
    above = [np.append(np.cumsum(x[::-1])[::-1][1:], 0)[: BINS + 1] / max(1, x.sum()) for x in (good, bad)]
    return above[1] - 10 * above[0]


def certified_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> float | None:
    """Cutoff t (reject scores above t) from histograms over bins 0..BINS, or None.

    good, bad: documents by bin. Tests t from BINS-1 downward until the exact test first fails.
    """
    n, best, gain, gains = int(good.sum()), None, 0.0, separation(good, bad)
    if not n:
        return None
    rejected = np.cumsum(good[::-1])[::-1]
    for t in range(BINS - 1, 0, -1):
        k = int(rejected[t + 1])
        if k > risk * n or binomial_tail(k, n, risk) > level:
            break
        if gains[t] > gain + 1e-12:
            best, gain = t / BINS, gains[t]
    return best


def histograms(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    good[pdf["bin"]], bad[pdf["bin"]] = pdf["good"], pdf["bad"]
    return good, bad


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05, most_rules: int = 2, id_col: str = "doc_id", good_col: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff) of all certified cutoffs.

    labels: id, good_col (1 good, 0 bad; null rows are left out). Two halves x rules x BINS counts of a stratum meet.
    """
    judged = labels.where(F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(good_col).alias("good"))
    bins = F.array(*(F.least(F.lit(BINS), F.ceil(s * BINS)).cast("int") for s in scores().values()))
    held = measured.where(~F.col("base_failed")).join(judged, "doc_id").groupBy("text_key", "stratum").agg(F.min("good").alias("good"), F.max(bins).alias("bins"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col("bins")[i].alias("bin")) for i, r in enumerate(RULES)))).alias("x")
    held = held.select("stratum", F.pmod("text_key", F.lit(2)).cast("int").alias("half"), "good", rules)
    histogram = cut(held.groupBy("stratum", "half", "x.rule", "x.bin").agg(F.sum((F.col("good") == 1).cast("long")).alias("good"), F.sum((F.col("good") == 0).cast("long")).alias("bad")))

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        gains = sorted(((-float(separation(*histograms(own))[1:].max()), rule) for rule, own in pdf.groupby("rule")))
        chosen = [rule for gain, rule in gains if gain < -1e-12][:most_rules]
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]] * len(chosen), "rule": chosen, "share": [risk / max(1, len(chosen))] * len(chosen)}).astype({"stratum": object, "rule": object, "share": float})  # empty ones, too

    selected = cut(histogram.where("half = 0").groupBy("stratum").applyInPandas(select, "stratum string, rule string, share double"))
    tests = max(1, selected.count())

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        cutoff = certified_cutoff(*histograms(pdf), pdf["share"].iloc[0], level / tests)
        return pdf[["stratum", "rule"]].head(1).assign(cutoff=cutoff)

    named = selected.select(F.col("stratum").alias("s"), F.col("rule").alias("r"), "share")
    held_out = histogram.where("half = 1").join(named, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r"))).drop("s", "r")
    return held_out.groupBy("stratum", "rule").applyInPandas(pick, "stratum string, rule string, cutoff double").where("cutoff IS NOT NULL")


def judge(measured: DataFrame, cutoffs: DataFrame, broadcast_rows: int = 10_000) -> DataFrame:
    """``measured`` with rejected_by (names of the rules that reject) and kept."""
    by_stratum = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut"))
    by_stratum = cut(by_stratum)
    if by_stratum.count() <= broadcast_rows:  # at most so many strata; beyond, Spark joins by the stratum
        by_stratum = F.broadcast(by_stratum)
    hits = F.array_compact(F.array(*(F.when(F.ceil(s * BINS) / BINS > F.try_element_at("_cut", F.lit(r)), F.lit(r)) for r, s in scores().items())))
    out = measured.join(by_stratum, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    out = out.withColumn("rejected_by", hits).drop("_cut", "_stratum")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
