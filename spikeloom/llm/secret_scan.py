"""Secret scans over an incremental ledger of blobs, in DataFrame operations only.

Every version of a text is content-addressed by its SHA-256. A ledger holds the findings of each scanned
(blob, rule version). A scan takes the distinct blobs of its input, leaves out the pairs that the ledger
already has, scans each remaining blob once and joins the findings back to every path that carries
the blob. ``scan`` returns the findings by path and the rows to append to the ledger; ``unseen`` and ``findings`` are its two halves, for
versions of a corpus that are scanned one after the other.

Positions: for one rule, ``split`` gives the texts between matches and ``regexp_extract_all`` the matches;
the running sum of both lengths is where a match starts. Offsets count code points, ends are exclusive.

Edge cases: a null text counts as empty and has no findings. Repeated rows keep their own result row; equal
texts are scanned once. Extra input columns are kept, but for columns named blob or spans, which are replaced. Empty tables give empty
results. A path with several versions has one row per version. Very long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import cut

#: Kinds, patterns, the group whose length counts, its least length. The least
#: lengths of access and hex stand in the pattern, because a run that is too short holds no longer one.
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 0),
    ("hex", r"[0-9a-f]{16,}", 0, 0),
]
RULE_VERSION = "base-1"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """The spans of one rule, in order of their start."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    checked = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: F.length(g))
    rows = F.arrays_zip(F.transform(found, lambda m: F.length(m)).alias("n"), checked.alias("g"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, m):
        at = acc["at"] + m["gap"]
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + m["n"]).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((at + m["n"]).alias("at"), F.when(m["g"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(rows, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def all_spans(text: Column, rules=RULES) -> Column:
    """The spans of all rules by start, then rule."""
    return F.array_sort(F.concat(*(spans_of(text, i, *r) for i, r in enumerate(rules))))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def known(ledger: DataFrame, version: str) -> DataFrame:
    return ledger.where(F.col("version") == version).groupBy("blob").agg(F.any_value("spans").alias("spans"))


def unseen(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules=RULES, version: str = RULE_VERSION) -> DataFrame:
    """(blob, version, spans) of the blobs of ``docs`` that the ledger doesn't have for this rule version: the only ones that are scanned."""
    texts = docs.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # one text for each blob; equal texts meet before the shuffle, and the ledger is taken out where they lie
    texts = texts.groupBy("blob").agg(F.any_value("_text").alias("_text"))
    if ledger is not None:
        texts = texts.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    return texts.select("blob", F.lit(version).alias("version"), all_spans(F.col("_text"), rules).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, text_col: str = "text", version: str = RULE_VERSION, share: int = 1000) -> DataFrame:
    """``docs`` without the text, with blob and spans out of the ledger.

    Only blobs with findings are joined back. Blobs with more than 1/share of all paths (fewer than ``share`` blobs, whatever the data) are cut
    into as many salts as their paths need.
    """
    found = known(ledger, version).where(F.size("spans") > 0)
    kept = [c for c in docs.columns if c not in (text_col, "blob", "spans")]
    row = F.struct(*kept) if kept else F.struct(F.lit(0))
    keyed = docs.select(row.alias("_row"), blob_id(F.col(text_col)).alias("blob"))
    counted = cut(keyed.groupBy("blob").agg(F.count(F.lit(1)).alias("n")))
    most = (counted.agg(F.sum("n")).first()[0] or 0) // share
    hot = counted.where(F.col("n") > most).select("blob", F.ceil(F.col("n") * 4 / max(1, most)).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    salted = found.join(F.broadcast(hot), "blob", "left").select("blob", "spans", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = keyed.join(F.broadcast(hot), "blob", "left").select("_row", "blob", F.pmod(F.monotonically_increasing_id(), salts).cast("int").alias("salt"))
    out = dealt.join(salted, ["blob", "salt"], "left")
    return out.select(*(F.col("_row").getField(c).alias(c) for c in kept), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules=RULES, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(docs without the text, with blob and spans; the new ledger rows, stored: blob, version, spans).

    ledger: rows of earlier scans, of any rule versions.
    """
    fresh = cut(unseen(docs, ledger, text_col, rules, version))
    return findings(docs, fresh if ledger is None else ledger.unionByName(fresh), text_col, version), fresh


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def listing(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
