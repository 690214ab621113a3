"""Quality scores: a regularised quadratic discriminant over transformed statistics of a document.

Every whole text gives the statistics of `STATISTICS` (shares of kinds of characters and words, lengths, repetition), each carried to a
scale on which it is roughly normal: shares by the logit with half a count added, counts and lengths by the logarithm. For each label the
mean and covariance are summed up by Spark over all labelled documents outside the held-out fifth, no sample; what comes to the driver is
one row for each pair of statistics and label. A class covariance is shrunk: `pooled` of it comes from both classes together, `ridge` from
its own variances. A text's score is the logistic function of the difference of the two log densities plus the log odds of the labels.
Each log density is a Mahalanobis distance, solved through the class's Cholesky factor, which is computed once and broadcast with the means.

A null or empty text has the statistics of no words, and a score from them; very long texts are read whole. Repeated rows count each and
score alike; a document with both labels counts as the lower; a null doc_id has no label and isn't held out. Without labels of both kinds
the score is 0, or 1 where all are 1. Other columns are carried along; one named like a result gives way to it. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, map_text, slices
from .kernel import SPACED, Words

STATISTICS = (
    "words", "word_length", "word_length_spread", "letters", "digits", "symbols", "capitals", "stops", "no_letter_words", "distinct_words", "same_as_before",
    "distinct_pairs", "commonest_word", "short_words", "odd_ends", "lines",
)
_UPPER, _LETTER, _DIGIT, _STOP, _SYMBOL = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True  # a byte of a longer character counts as a letter's
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".,;:'\"?-()"]] = True
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT | _STOP)


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _per_text(key: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of keys by text: how many differ in each text, and how often its commonest one occurs."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, text))
    k, t = key[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, t[at], np.diff(np.append(at, len(k))))
    return np.bincount(t[at], minlength=n).astype(float), most


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, len(STATISTICS)) of a slice of texts."""
    n = len(off) - 1
    total = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind)])[off]).astype(float)
    w = Words(buf, off, SPACED)
    words, text, length = w.counts().astype(float), w.text(), (w.end - w.start).astype(float)
    of = lambda flag: np.bincount(text, weights=flag, minlength=n)
    letters, digits, stops, symbols = total(_LETTER[buf]), total(_DIGIT[buf]), total(_STOP[buf]), total(_SYMBOL[buf])
    ascii_letters = total(_LETTER[buf] & (buf < 128))
    marks = letters + digits + stops + symbols
    has_letter = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    distinct, most = _per_text(w.hash, text, n)
    pair, ok = w.grams(2)
    pairs, _ = _per_text(pair[ok], text[: len(pair)][ok], n)
    same = np.zeros(len(length), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    mean = of(length) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(of(length**2) / np.maximum(words, 1) - mean**2, 0))
    odd = _SYMBOL[buf[w.end - 1]] if len(length) else np.zeros(0, bool)
    return np.stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), _logit(letters, marks), _logit(digits, marks), _logit(symbols, marks), _logit(total(_UPPER[buf]), ascii_letters), np.log((stops + 0.5) / (words + 1)),
        _logit(of(has_letter[w.end] == has_letter[w.start]), words), np.log((distinct + 0.5) / (words + 1)), _logit(of(same), words), np.log((pairs + 0.5) / (words + 0.5)), _logit(most, words), _logit(of(length <= 3), words),
        _logit(of(odd), words), np.log((total(buf == 10) + 0.5) / (words + 1)),
    ], axis=1)


def _describe(column) -> list[pa.Array]:
    rows = [statistics(buf, off) for _, _, buf, off in slices(column)]
    flat = np.concatenate([r.ravel() for r in rows]) if rows else np.zeros(0)
    d = len(STATISTICS)
    return [pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d), pa.int32()), pa.array(flat))]


def moments(labelled: DataFrame, column: str = "statistics") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label -> (documents, mean, covariance) from (label, statistics); partial sums are formed by the tasks."""
    d = len(STATISTICS)

    def partial(batches):
        sums: dict = {}
        for b in batches:
            x = np.array(b.column(1).flatten(), float).reshape(-1, d)
            y = np.array(b.column(0))
            for label in np.unique(y):
                own = np.concatenate([np.ones((int((y == label).sum()), 1)), x[y == label]], axis=1)
                sums[label] = sums.get(label, 0) + own.T @ own
        for label, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, label), pa.int32()), pa.array(np.arange(s.size), pa.int32()), pa.array(s.ravel())], names=["label", "at", "sum"])

    rows = labelled.select(F.col("label").cast("int"), column).mapInArrow(partial, "label int, at int, sum double").groupBy("label", "at").agg(F.sum("sum").alias("sum")).collect()
    out = {}
    for label in sorted({r["label"] for r in rows}):
        s = np.zeros((d + 1) ** 2)
        for r in rows:
            if r["label"] == label:
                s[r["at"]] = r["sum"]
        s = s.reshape(d + 1, d + 1)
        mean = s[0, 1:] / s[0, 0]
        out[label] = float(s[0, 0]), mean, s[1:, 1:] / s[0, 0] - np.outer(mean, mean)
    return out


def discriminant(classes: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.2, ridge: float = 0.02) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For labels 0 and 1: mean, inverse of the Cholesky factor of the shrunk covariance, and the constant of the log density."""
    n = {y: c[0] for y, c in classes.items()}
    both = sum(n[y] * classes[y][2] for y in (0, 1)) / (n[0] + n[1])
    out = []
    for y in (0, 1):
        _, mean, own = classes[y]
        cov = (1 - pooled) * own + pooled * both
        cov = (1 - ridge) * cov + ridge * np.diag(np.diag(cov)) + 1e-6 * np.eye(len(mean))
        factor = np.linalg.cholesky(cov)
        out.append((mean, np.linalg.inv(factor), float(np.log(n[y] / (n[0] + n[1])) - np.log(np.diag(factor)).sum())))
    return out


def log_odds(x: np.ndarray, model) -> np.ndarray:
    """Log density of label 1 less that of label 0, with the odds of the labels."""
    part = [constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, constant in model]
    return part[1] - part[0]


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep: bool = False, **shrinkage) -> DataFrame:
    """Columns of docs (text with keep), then held_out, score, predicted, statistics (in the order of STATISTICS)."""
    described = map_text(docs, _describe, "statistics array<double>", keep=keep)
    seen = cut(described) if not keep else described  # the text is read once where it isn't returned
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("string").alias("_id")).agg(F.min("quality").alias("label"))
    classes = moments(seen.select(F.col("doc_id").cast("string").alias("_id"), "statistics").join(known, "_id").select("label", "statistics"))
    if set(classes) == {0, 1}:
        model = discriminant(classes, **shrinkage)
        # two means and two triangular factors
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def score(batches):
            for b in batches:
                x = np.array(b.column(1).flatten(), float).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(log_odds(x, shared.value), -700, 700))))], names=["row", "score"])

        packed = seen.select(F.struct(*(F.col(f"`{c}`") for c in seen.columns)).alias("row"), "statistics")
        out = packed.mapInArrow(score, f"row {packed.schema['row'].dataType.simpleString()}, score double")
        names = [c for c in seen.columns if c.lower() not in ("score", "held_out", "predicted", "statistics")]
        out = out.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.col("row.statistics").alias("statistics"), "score")
    else:
        names = [c for c in seen.columns if c.lower() not in ("score", "held_out", "predicted", "statistics")]
        out = seen.select(*(F.col(f"`{c}`") for c in names), "statistics", F.lit(1.0 if set(classes) == {1} else 0.0).alias("score"))
    return out.select(*(F.col(f"`{c}`") for c in names), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "statistics")
