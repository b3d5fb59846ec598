"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of labelled texts. A text is cut into chunks,
every chunk is compressed with every dictionary, and the language with the smallest total wins. The
prediction is rejected (``accepted`` is false) when the runner-up is nearly as small.

Training uses a bounded sample of labelled rows. Texts are cut into pieces of at most PIECE characters, so that very long ones take part, and for each language at most
``sample_docs`` distinct pieces are taken, those with the smallest hash, as long as those before hold less than ``dict_bytes``. The ``most_langs`` languages with the most
distinct pieces are learned, so a dirty column makes no more dictionaries than that. Pieces whose label the other half of the sample contradicts are left out, unless the other half
hasn't that language; of a language whose pieces are all contradicted the least contradicted half stays. The sample is chosen by hashes alone, then its texts are fetched. Only texts and languages are learned from,
never ids or sources. Prediction reads whole texts.

Edge cases: a null text or one without any letter is ``und``, score 0, rejected. Without any labelled row
everything is ``und``. Ties go to the language first in order. Repeated rows are predicted one by one. Extra
columns of the input are ignored; null languages are never learned.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spikeloom.llm.common import per_worker

UNDETERMINED = "und"
#: Characters of a piece of a training text.
PIECE = 16_384


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 256, dict_bytes: int = 262_144, level: int = 6, most_langs: int = 256) -> dict[str, bytes]:
    """Dictionary content by language, from a bounded sample of labelled rows."""
    text = F.lower(text_col)
    cuts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PIECE).cast("int"))
    pieces = F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.transform(cuts, lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE))))
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.explode(pieces).alias("text"))
    rows = rows.select("lang", F.xxhash64("text").alias("key"), F.octet_length("text").alias("size"), "text")
    # a threshold on the hash leaves about four times the sample for each language, wherever its rows lie
    there = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)  # a row for each language
    share = F.least(F.lit(1.0), 4.0 * sample_docs / F.col("n"))
    some = rows.drop("text").join(F.broadcast(there), "lang").where(F.shiftrightunsigned("key", 11) < share * float(1 << 53)).groupBy("lang", "key").agg(F.max("size").alias("size"))
    order = W.partitionBy("lang").orderBy(F.shiftrightunsigned("key", 11), "key")
    chosen = some.withColumn("n", F.row_number().over(order)).withColumn("before", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)))
    chosen = chosen.where((F.col("n") <= sample_docs) & (F.coalesce("before", F.lit(0)) < dict_bytes)).select("lang", "key", "n")
    texts = rows.drop("size").join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "n").agg(F.min("text").alias("text"))
    sample = sorted((r["lang"], r["n"], r["text"].encode()) for r in texts.collect())  # languages x sample_docs texts, of 2 dict_bytes in all each
    # labels err: a sample text stays if the dictionary from the other half of the sample agrees with its label
    halves = [_content(sample, half) for half in (0, 1)]
    tools = [compressors(h, level) for h in halves]
    kept, against = [], {}
    for lang, n, raw in sample:
        other = tools[1 - n % 2]
        best, sizes = smallest(raw, other)
        if lang not in halves[1 - n % 2] or best == lang:
            kept.append((lang, n, raw))
        else:
            against.setdefault(lang, []).append((sizes[[x for x, _ in other].index(lang)] / min(sizes), n, raw))
    for lang in against.keys() - {k[0] for k in kept}:
        kept += [(lang, n, raw) for _, n, raw in sorted(against[lang])[: (len(against[lang]) + 1) // 2]]
    return _content(sorted(kept))


def _content(sample: list[tuple[str, int, bytes]], half: int | None = None) -> dict[str, bytes]:
    out: dict[str, list[bytes]] = {}
    for lang, n, raw in sample:
        if half is None or n % 2 == half:
            out.setdefault(lang, []).append(raw)
    return {lang: b"\n".join(raws) for lang, raws in out.items()}


def smallest(raw: bytes, tools: list, chunk_bytes: int = 4096) -> tuple[str | None, list[int]]:
    """The language with the smallest total over the chunks of ``raw``, and all totals."""
    chunks = [raw[i : i + chunk_bytes] for i in range(0, len(raw), chunk_bytes)]
    sizes = [sum(len(c.compress(x)) for x in chunks) for _, c in tools]
    return (tools[sizes.index(min(sizes))][0] if sizes else None), sizes


def compressors(content: dict[str, bytes], level: int):
    def make():
        out = []
        for lang in sorted(content):
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return out

    return per_worker(("langid", level, hash(tuple(sorted(content.items())))), make)


def predict(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = 6, chunk_bytes: int = 4096, min_margin: float = 0.005, carry: list[str] | None = None) -> DataFrame:
    """lang_pred, score (0 to 1), margin (relative excess of the runner-up) and accepted beside the columns ``carry``, by default the id as doc_id.

    ``carry`` must not have those four names; a struct of all columns avoids that.
    """
    kept = [F.col(id_col).alias("doc_id")] if carry is None else [F.col(c) for c in carry]
    src = docs.select(*kept, F.col(text_col).alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    shipped = docs.sparkSession.sparkContext.broadcast(content)  # languages x dict_bytes

    def one(text: str | None, tools) -> tuple:
        if text is None or not tools or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, False
        raw = text.lower().encode()
        lang, sizes = smallest(raw, tools, chunk_bytes)
        least, *others = sorted(sizes)
        weights = [2.0 ** max(-60.0, (least - s) * chunk_bytes / max(chunk_bytes, len(raw))) for s in sizes]
        margin = (others[0] - least) / least if others else 1.0
        return lang, 1.0 / sum(weights), margin, margin >= min_margin

    def run(batches):
        tools = compressors(shipped.value, level)
        for b in batches:
            rows = [one(x.as_py(), tools) for x in b.columns[-1]]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True))], names=schema.names)

    return src.mapInArrow(run, schema)
