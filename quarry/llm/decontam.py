"""Benchmark decontamination by winnowed fingerprints.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is 13 consecutive words of an item, or all words of a
shorter one. Of each run of 7-word grams that spans a window the minimum hash is a fingerprint, on both sides, so a shared window always
shares one. Where a document's fingerprint is among the benchmark's, the hit is extended to the windows around it, which are compared
word by word. Shorter items are looked up by the hash of all their words.

The benchmark's fingerprints are broadcast while its texts and rows stay under `broadcast_bytes`; a larger benchmark is joined by
fingerprint in shuffles. A null text has no words, a very long one is read whole; an item without words has no window; repeated item_ids
are one item; a null item_id is ignored. Rows with a null doc_id and repeated rows are judged like all others. Other columns are carried
along; one named like a result gives way to it. Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text, shared_dir, slices, without
from .kernel import ALNUM, Words, covered, member, winnow

WINDOW, GRAM = 13, 7
BROADCAST_BYTES = 16 << 20


def _windows(w: Words, a: int, b: int, window: int):
    """(first word, length) of each window of the item whose words are a..b."""
    return [(i, window) for i in range(a, b - window + 1)] if b - a >= window else ([(a, b - a)] if b > a else [])


class Benchmark:
    """Fingerprints, and windows by length and hash with the items they are in."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.windows: dict[bytes, int] = {}
        self.items_of: list[set] = []
        hashes: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        prints = [np.zeros(0, np.uint64)]
        for item, text in items:
            raw = text.encode()
            w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM, lower=True)
            n = len(w.start)
            if n >= window:
                g, ok = w.grams(gram)
                prints.append(g[winnow(g, ok, window - gram + 1)])
            for length, starts in ((window, range(n - window + 1)) if n >= window else (n, range(1)),) if n else ():
                g, _ = w.grams(length)
                for s in starts:
                    key = b" ".join(w.word(k) for k in range(s, s + length))
                    at = self.windows.setdefault(key, len(self.windows))
                    if at == len(self.items_of):
                        self.items_of.append(set())
                        hashes[length][int(g[s])].append(at)
                    self.items_of[at].add(item)
        self.prints = np.unique(np.concatenate(prints))
        self.hashes = {n: (np.array(sorted(d), np.uint64), dict(d)) for n, d in hashes.items()}

    def find(self, w: Words):
        """Of a slice of texts: for each word whether it is hit, and the items met in each text."""
        n = len(w.start)
        hit, items = np.zeros(n, bool), defaultdict(set)
        text = w.text()
        for length, (keys, at) in self.hashes.items():
            g, ok = w.grams(length)
            if not len(g):
                continue
            if length == self.window:
                f, whole = w.grams(self.gram)
                p = np.flatnonzero(winnow(f, whole, self.window - self.gram + 1))
                p = p[member(f[p], self.prints)]
                back = self.window - self.gram
                start = np.flatnonzero(covered(np.maximum(p - back, 0), np.minimum(p, back) + 1, len(g)) & ok) if len(p) else p
            else:
                start = np.flatnonzero(ok)
            start = start[member(g[start], keys)]
            good = []
            for s in start:
                words = b" ".join(w.word(k) for k in range(s, s + length))
                for k in at[int(g[s])]:
                    if self.windows.get(words) == k:
                        good.append(s)
                        items[int(text[s])] |= self.items_of[k]
            if good:
                hit |= covered(np.array(good), length, n)
        return hit, items


def _per_text(bench: Benchmark, column) -> list[pa.Array]:
    words, hits, names = [], [], []
    for i, j, buf, off in slices(column):
        w = Words(buf, off, ALNUM, lower=True)
        hit, items = bench.find(w)
        total = np.r_[0, np.cumsum(hit)]
        words.append(w.counts())
        hits.append(total[w.first[1:]] - total[w.first[:-1]])
        names += [sorted(items.get(t, ())) for t in range(j - i)]
    none = np.zeros(0, np.int64)
    return [pa.array(np.concatenate([*words, none])), pa.array(np.concatenate([*hits, none])), pa.array(names, pa.list_(pa.string()))]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES, keep: bool = False) -> DataFrame:
    """Columns of docs (text with keep), then n_words, n_hit, items (sorted), contaminated (20 * n_hit >= n_words > 0 hits)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    shared_dir(docs.sparkSession)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + F.octet_length("item_id") + 64), F.lit(0))).first()[0]
    find = _broadcast if size <= broadcast_bytes else _shuffled
    out = find(docs, items, window, gram, keep)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _broadcast(docs: DataFrame, items: DataFrame, window: int, gram: int, keep: bool) -> DataFrame:
    texts = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.collect()])
    state: list[Benchmark] = []

    def find(column):
        if not state:
            state.append(Benchmark(texts.value, window, gram))
        return _per_text(state[0], column)

    return map_text(docs, find, "n_words long, n_hit long, items array<string>", keep=keep)


def _item_windows(window: int, gram: int):
    def f(batches):
        for b in batches:
            for i, _, buf, off in slices(b.column(1)):
                w = Words(buf, off, ALNUM, lower=True)
                first, rows = w.first, []
                prints = np.zeros(0, bool)
                g, ok = w.grams(gram)
                prints = winnow(g, ok, window - gram + 1)
                for t in range(len(first) - 1):
                    for s, n in _windows(w, first[t], first[t + 1], window):
                        words = b" ".join(w.word(k) for k in range(s, s + n))
                        near = [int(x) for x in g[s : s + n - gram + 1][prints[s : s + n - gram + 1]].view(np.int64)] if n == window else [int(w.grams(n)[0][s : s + 1].view(np.int64)[0])]
                        rows.append((b.column(0)[i + t].as_py(), n, hashlib.md5(words).digest(), near))
                names = ("item_id", "length", "words", "prints")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], names=names)

    return f


def _doc_prints(window: int, gram: int, lengths: list[int]):
    """Fingerprints of a text: winnowed grams, and the whole-item hashes of each shorter length."""

    def f(column):
        out = []
        for i, j, buf, off in slices(column):
            w = Words(buf, off, ALNUM, lower=True)
            g, ok = w.grams(gram)
            keep = [(w.text()[: len(g)][m], g[m]) for m in [winnow(g, ok, window - gram + 1)]]
            for n in lengths:
                x, whole = w.grams(n)
                keep.append((w.text()[: len(x)][whole], x[whole]))
            t, h = np.concatenate([k[0] for k in keep]), np.concatenate([k[1] for k in keep])
            o = np.argsort(t, kind="stable")
            out += np.split(h[o].view(np.int64), np.searchsorted(t[o], np.arange(1, j - i)))
        return [pa.array([np.unique(x) for x in out], pa.list_(pa.int64()))]

    return f


def _doc_windows(window: int, gram: int, lengths: list[int]):
    """(row, start, length, words) of the windows around the fingerprints met."""

    def f(batches):
        for b in batches:
            met = b.column(2).to_pylist()
            for i, j, buf, off in slices(b.column(1)):
                w = Words(buf, off, ALNUM, lower=True)
                rows = []
                grams = {n: w.grams(n)[0] for n in (gram, *lengths)}
                for t in range(j - i):
                    a, e, keys = w.first[t], w.first[t + 1], np.unique(np.array(met[i + t] or [], np.int64).view(np.uint64))
                    if e - a >= window:
                        p = a + np.flatnonzero(member(grams[gram][a : e - gram + 1], keys))
                        starts = {s for x in p for s in range(max(a, x - window + gram), min(x, e - window) + 1)}
                        rows += [(i + t, s, window) for s in starts]
                    for n in lengths:
                        if e - a >= n:
                            rows += [(i + t, s, n) for s in a + np.flatnonzero(member(grams[n][a : e - n + 1], keys))]
                ids = b.column(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r].as_py() for r, _, _ in rows], pa.string()), pa.array([int(s - w.first[r - i]) for r, s, _ in rows], pa.int64()), pa.array([n for _, _, n in rows], pa.int32()),
                     pa.array([hashlib.md5(b" ".join(w.word(k) for k in range(s, s + n))).digest() for _, s, n in rows], pa.binary())],
                    names=["row", "start", "length", "words"],
                )

    return f


def _shuffled(docs: DataFrame, items: DataFrame, window: int, gram: int, keep: bool) -> DataFrame:
    """The same by joins. A row is known by its doc_id and a digest of its text, so that equal rows share one search."""
    bench = cut(items.select("item_id", "text").mapInArrow(_item_windows(window, gram), "item_id string, length int, words binary, prints array<long>"))
    lengths = [r["length"] for r in bench.where(F.col("length") < window).select("length").distinct().collect()]  # at most window - 1
    row = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    back = without([c for c in docs.columns if keep or c != "text"], ("n_words", "n_hit", "items"))
    others = F.struct(*(F.col(f"`{c}`") for c in back)) if back else F.lit(None).cast("int")
    named = docs.select(row.alias("_row"), F.col("text").cast("string").alias("text"), others.alias("_others"))  # no column of docs can clash
    texts = named.select("_row", "text").dropDuplicates(["_row"])
    prints = map_text(texts, _doc_prints(window, gram, lengths), "print array<long>", keep=False).select("_row", F.explode("print").alias("print"))
    known = bench.select(F.explode("prints").alias("print")).distinct()
    met = prints.join(known, "print", "left_semi").groupBy("_row").agg(F.collect_list("print").alias("met"))
    spans = texts.join(met, "_row").select("_row", "text", "met").mapInArrow(_doc_windows(window, gram, lengths), "row string, start long, length int, words binary")
    hits = cut(spans.join(bench.select("words", "length").distinct(), ["words", "length"], "left_semi"))
    places = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    # windows by row, then their items: one row for each document and item
    found = hits.select("row", "words", "length").distinct().join(bench.select("words", "length", "item_id").distinct(), ["words", "length"])
    met_items = found.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    counted = map_text(named, lambda c: [pa.array(np.concatenate([*(Words(buf, off, ALNUM, lower=True).counts() for _, _, buf, off in slices(c)), np.zeros(0, np.int64)]))], "n_words long")
    joined = counted.join(places.withColumnRenamed("row", "_row"), "_row", "left").join(met_items.withColumnRenamed("row", "_row"), "_row", "left")
    return joined.select(*(F.col(f"_others.`{c}`").alias(c) for c in back), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
