"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, modulo 2**bits, of its words, its pairs of neighbours and its pairs with one word between
(words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased). The model is fitted on a bounded sample: for each label, the labelled
document outside the held-out fifth with the smallest hash in each of `samples` hash classes, in order of hash as far as `sample_bytes`
of text go, one at least. Per-coordinate rates and L1 leave few weights, which are broadcast; the intercept is corrected to the label's
share among all labelled documents.

A null or empty text has the intercept only; very long texts are scored whole. Repeated rows score alike; of several texts of one doc_id
the first by code points is fitted on; conflicting labels of a document count as toxic; with no labels every score is 0. Other columns
are carried along; one named like a result gives way to it. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_text, slices
from .kernel import ALNUM, Words, chain

BITS = 20


def _features(w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram and skip-gram of a slice, with repetitions."""
    text, ends, n = w.text(), w.ends(), len(w.start)
    parts = [(text, w.hash)]
    if n > 1:
        ok = np.arange(2, n + 1) <= ends[: n - 1]
        parts.append((text[: n - 1][ok], chain(w.hash, 2, 3)[ok]))
    if n > 2:
        ok = np.arange(3, n + 1) <= ends[: n - 2]
        pair = w.hash[: n - 2] * np.uint64(0x9E3779B97F4A7C15) ^ (w.hash[2:] + np.uint64(0x1000193))
        parts.append((text[: n - 2][ok], pair[ok]))
    return np.concatenate([p[0] for p in parts]), (np.concatenate([p[1] for p in parts]) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression with binary features; coordinate 2**bits is the intercept."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 30.0, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def fit(docs: DataFrame, labels: DataFrame, samples: int = 4096, sample_bytes: int = 32 << 20, epochs: int = 16, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers with a weight, those weights, and the intercept; at most samples documents or sample_bytes of text a label are fitted on."""
    docs = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    size = F.octet_length("text").cast("long")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max("toxic").alias("toxic"))
    there = docs.select("id", size.alias("size")).join(known, "id").groupBy("id", "toxic").agg(F.max("size").alias("size"))
    h = F.xxhash64("id")
    rows = there.groupBy("toxic", F.pmod(h, F.lit(samples)).alias("class")).agg(F.count("*").alias("n"), F.min(F.struct(h.alias("h"), "id", "size")).alias("least")).collect()
    share = {y: sum(r["n"] for r in rows if r["toxic"] == y) for y in (0, 1)}
    if not share[0] or not share[1]:
        return np.zeros(0, np.int64), np.zeros(0), -np.inf if not share[1] else np.inf
    picked = []
    for y in (0, 1):
        left = sample_bytes
        for r in sorted((r["least"] for r in rows if r["toxic"] == y), key=lambda r: (r["h"], r["id"])):
            if left >= r["size"] or left == sample_bytes:
                picked.append((r["id"], y, r["h"]))
                left -= min(left - 1, r["size"])
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, "id string, toxic int, h long"))  # at most 2 * samples rows

    def describe(column):
        out = []
        for i, j, buf, off in slices(column):
            t, f = _features(Words(buf, off, ALNUM, lower=True), bits)
            o = np.argsort(t, kind="stable")
            out += [np.unique(x).astype(np.int32).tobytes() for x in np.split(f[o], np.searchsorted(t[o], np.arange(1, j - i)))]
        return [pa.array(out, pa.binary())]

    texts = docs.join(chosen, "id").groupBy("id", "h", "toxic").agg(F.min("text").alias("text"))
    sample = map_text(texts, describe, "features binary").collect()
    model, one = Ftrl(bits), 1 << bits
    sample.sort(key=lambda r: (r["h"], r["id"]))
    data = []
    while sample:  # each row goes as it is read
        r = sample.pop()
        data.append((np.append(np.frombuffer(r["features"], np.int32), np.int32(one)), r["toxic"]))
    data.reverse()
    for _ in range(epochs):
        for x, y in data:
            model.learn(x, y)
    w = model.weights()
    n = {y: max(1, sum(1 for _, t in data if t == y)) for y in (0, 1)}
    at = np.flatnonzero(w[:one])
    return at, w[at], float(w[one] + np.log(share[1] / share[0]) - np.log(n[1] / n[0]))


def scorer(at: np.ndarray, weights: np.ndarray, intercept: float, bits: int = BITS):
    dense: list = []

    def score(column) -> list[pa.Array]:
        if not dense:
            dense.append(np.zeros(1 << bits))
            dense[0][at] = weights
        out = []
        for i, j, buf, off in slices(column):
            t, f = _features(Words(buf, off, ALNUM, lower=True), bits)
            hit = np.flatnonzero(dense[0][f])
            pairs = np.unique(t[hit].astype(np.int64) << bits | f[hit])  # each feature once a text
            s = np.bincount(pairs >> bits, weights=dense[0][pairs & (1 << bits) - 1], minlength=j - i)
            out.append(1 / (1 + np.exp(-np.clip(s + intercept, -700, 700))))
        return [pa.array(np.concatenate([*out, np.zeros(0)]))]

    return score


def toxicity(docs: DataFrame, labels: DataFrame, keep: bool = False, **bounds) -> DataFrame:
    """Columns of docs (text with keep), then held_out, score, predicted."""
    at, weights, intercept = fit(docs, labels, **bounds)
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast((at, weights, intercept))  # at most 2**bits weights; L1 leaves a few hundred
    state: list = []

    def score(column):
        if not state:
            state.append(scorer(*model.value, bits=bounds.get("bits", BITS)))
        return state[0](column)

    out = map_text(docs, score, "score double", keep=keep)
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
