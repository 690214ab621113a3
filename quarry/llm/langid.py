"""Language identification by compression: the language whose dictionary compresses a text best.

For each language a raw-content zstandard dictionary of at most `dictionary_bytes` is filled from a bounded sample: of the labelled
documents outside the held-out fifth, the one with the smallest hash in each of `samples` hash classes, with its first `sample_bytes` characters.
Texts and samples are read in lower case with every run of other
characters than letters as one space. A whole text is encoded once per language; the smallest result wins (ties go to the language whose dictionary shares more of the text's
words, then to the first by name). Where the two best differ by less than `margin` of the larger, `rejected` is set. A null text, or one
without any letter, is `und` with score 0; very long texts are encoded whole. Repeated rows are judged alike; other columns are ignored,
whatever their names; nothing labelled means all `und`; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_text

LEVEL = 3
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The letters of a text in lower case, words parted by one space."""
    return _OTHER.sub(" ", text.lower()).strip().encode()


def fit(docs: DataFrame, samples: int = 64, sample_bytes: int = 1 << 14, dictionary_bytes: int = 1 << 16) -> dict[str, bytes]:
    """language -> dictionary content; at most samples * sample_bytes characters of each language come to the driver."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    h = F.xxhash64(F.col("doc_id").cast("string"))
    picked = known.groupBy("lang", F.pmod(h, F.lit(samples)).alias("class")).agg(F.min(F.struct(h.alias("h"), F.col("doc_id").cast("string").alias("id"))).alias("least"))
    ids = picked.select("lang", F.col("least.h").alias("h"), F.col("least.id").alias("id")).collect()
    if not ids:
        return {}
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r["id"],) for r in ids], "id string").distinct())  # at most samples rows a language
    texts = known.select(F.col("doc_id").cast("string").alias("id"), "lang", F.substring("text", 1, sample_bytes).alias("text")).join(chosen, "id", "left_semi").groupBy("lang", "id").agg(F.min("text").alias("text")).collect()
    out: dict[str, bytes] = {}
    order = {(r["lang"], r["id"]): r["h"] for r in ids}
    for r in sorted(texts, key=lambda r: (r["lang"], order.get((r["lang"], r["id"]), 0), r["id"])):
        if len(out.get(r["lang"], b"")) < dictionary_bytes:
            out[r["lang"]] = (out.get(r["lang"], b"") + letters(r["text"]) + b" ")[:dictionary_bytes]
    return out


def classifier(dictionaries: dict[str, bytes], margin: float = 0.01):
    import zstandard

    names = sorted(dictionaries)
    state: list = []

    def predict(column) -> list[pa.Array]:
        if not state:
            for n in names:
                d = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                state.append((zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False), set(dictionaries[n].split())))
        lang, score, rejected = [], [], []
        for text in column.to_pylist():
            if not names or not text or not any(map(str.isalpha, text)):
                lang.append("und"), score.append(0.0), rejected.append(True)
                continue
            raw = letters(text)
            size = [len(c.compress(raw)) for c, _ in state]
            best = min(size)
            tied = [k for k, s in enumerate(size) if s == best]
            if len(tied) > 1:
                own = raw.split()
                tied.sort(key=lambda k: (-sum(w in state[k][1] for w in own), k))
            k = tied[0]
            second = min((s for j, s in enumerate(size) if j != k), default=best * 2)
            lang.append(names[k])
            score.append(float(1 / np.exp((best - np.array(size, float)) / 8).sum()))
            rejected.append((second - best) < margin * second)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return predict


def languages(docs: DataFrame, margin: float = 0.01, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1, from the differences in bytes), rejected."""
    predict = classifier(fit(docs, **bounds), margin)
    out = map_text(docs.select("doc_id", "text"), predict, "lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
