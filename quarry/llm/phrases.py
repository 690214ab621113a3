"""Phrase collocations by suffixes: words that occur together more often than their parts would by chance.

Texts are lower-cased (A-Z), split into pieces at `[.,;:!?\\x0A-\\x0D]` and these into words `[^\\x20\\x09]+`; everything is counted per
language. A first pass counts words, and pairs of neighbours in a fixed number of hashed counters: a pair whose counter stays below
`min_count` is rarer than that, so no frequent phrase holds it. A second pass counts so the triples of which both pairs are left. A third pass
writes from each word on the suffix of at most `max_n` words, which ends early at a rare pair or triple, the end of a piece or of the text.
Equal suffixes are counted, in each task first, so that a suffix which all texts have is a row a task; what is left are little more than
the different frequent phrases, and the prefixes of these are added up in the same way. Parts of phrases are joined afterwards.

Keys are 64-bit hashes of (language, word); should two words share one, the words are counted anew with another seed. The counters take
at most 2**27 places (a bitmap of 16 MB is broadcast); they only spare work, so a corpus that fills them is counted as exactly.

A null text is empty, a null language is `und`; very long texts are taken whole, repeated rows count each, other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, slices, text_bytes
from .kernel import Words, chain, mix

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False
#: Bytes of text a step takes, and counters in one row.
STEP, CHUNK = 1 << 22, 1 << 12
MAX_BITS = 27


def _steps(batches, seed: int):
    """For slices of (lang, text) batches: the words, each one's key, its text's language, and whether the next word follows it in its piece."""
    salts: dict[str, int] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for i, j, buf, off in slices(b.column(1), STEP):
            w = Words(buf, off, _WORD, lower=True)
            if not len(w.start):
                continue
            for name in set(langs[i:j]) - salts.keys():
                salts[name] = int.from_bytes(hashlib.blake2b(f"{seed}/{name}".encode(), digest_size=8).digest(), "big")
            text = w.text()
            keys = mix(w.hash + np.array([salts[x] for x in langs[i:j]], np.uint64)[text])
            pieces = np.cumsum(_BREAK[buf])[w.start]
            yield w, keys, text, langs[i:j], (text[1:] == text[:-1]) & (pieces[1:] == pieces[:-1])


def _bytes_of(w: Words, at: np.ndarray) -> pa.Array:
    """The words with the given numbers as strings."""
    size = w.end[at] - w.start[at]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = w.buf[np.repeat(w.start[at] - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.string())


def _bucket(keys: np.ndarray, bits: int, k: int = 2) -> np.ndarray:
    """The counter of the k words from each word on."""
    return (chain(keys, k) >> _U(64 - bits)).astype(np.int64)


def _chunks(counters: np.ndarray):
    """(numbers, bytes) of a task's counters, some rows at a time."""
    for k in range(0, len(counters), CHUNK * 1024):
        rows = [counters[c : c + CHUNK].tobytes() for c in range(k, min(k + CHUNK * 1024, len(counters)), CHUNK)]
        yield pa.array(np.arange(len(rows)) + k // CHUNK, pa.int32()), pa.array(rows, pa.binary())


def _counts(texts: DataFrame, bits: int, seed: int) -> DataFrame:
    """Rows (key, lang, word, n) of slices' words, and rows (chunk, counters) of tasks' pairs."""

    def count(batches):
        pairs = np.zeros(1 << bits, np.uint16)
        for w, keys, text, langs, follows in _steps(batches, seed):
            u, first, n = np.unique(keys, return_index=True, return_counts=True)
            names = pa.array(langs, pa.string()).take(pa.array(text[first]))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), names, _bytes_of(w, first), pa.array(n.astype(np.int64)), pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.binary())], names=list(names_))
            if len(keys) > 1:
                at, n = np.unique(_bucket(keys, bits)[follows], return_counts=True)
                pairs[at] = np.minimum(pairs[at] + n.astype(np.int64), 65535)
        for number, raw in _chunks(pairs):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(raw), pa.int64()), pa.nulls(len(raw), pa.string()), pa.nulls(len(raw), pa.string()), pa.nulls(len(raw), pa.int64()), number, raw], names=list(names_))

    names_ = ("key", "lang", "word", "n", "chunk", "counters")
    return texts.mapInArrow(count, "key long, lang string, word string, n long, chunk int, counters binary")


def _follow(keys: np.ndarray, follows: np.ndarray, bitmaps: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """For each bitmap (pairs, then triples): whether the two (three) words from each word on may be frequent together."""
    out, before = [], np.concatenate([follows, [False]])
    for k, bitmap in enumerate(bitmaps, 2):
        at, ok = _bucket(keys, bits, k), np.zeros(len(keys), bool)
        ok[: len(at)] = before[: len(at)] & (bitmap[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        out.append(ok)
        before = ok & np.concatenate([ok[1:], [False]])
    return out


def _triples(texts: DataFrame, pairs: np.ndarray, bits: int, seed: int) -> DataFrame:
    """Rows (chunk, counters) of tasks' triples of which both pairs may be frequent."""
    shared = texts.sparkSession.sparkContext.broadcast(pairs)

    def count(batches):
        triples = np.zeros(1 << bits, np.uint16)
        for _, keys, _, _, follows in _steps(batches, seed):
            if len(keys) > 2:
                ok = _follow(keys, follows, [shared.value], bits)[0]
                at, n = np.unique(_bucket(keys, bits, 3)[ok[:-2] & ok[1:-1]], return_counts=True)
                triples[at] = np.minimum(triples[at] + n.astype(np.int64), 65535)
        for number, raw in _chunks(triples):
            yield pa.RecordBatch.from_arrays([number, raw], names=["chunk", "counters"])

    return texts.mapInArrow(count, "chunk int, counters binary")


def _frequent(counts: DataFrame, bits: int, min_count: int) -> np.ndarray:
    """A bit for each counter that reaches min_count over all tasks (at most 2**MAX_BITS bits come to the driver)."""

    def add(batches):
        now, total = None, None
        done: list = []
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(raw.as_buffer(), np.uint16).astype(np.int64)
                if chunk == now:
                    total += own
                else:
                    if now is not None:
                        done.append((now, total))
                    now, total = chunk, own
            yield from out(done)
            done = []
        yield from out([(now, total)] if now is not None else [])

    def out(done):
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int32()), pa.array([np.packbits(t >= least).tobytes() for _, t in done], pa.binary())], names=["chunk", "bits"])

    least = min(min_count, 65535)
    rows = counts.where("chunk is not null").select("chunk", "counters").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, bits binary")
    bitmap = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in rows.toLocalIterator():
        bitmap[r["chunk"] * CHUNK // 8 : r["chunk"] * CHUNK // 8 + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bitmap


def _suffixes(texts: DataFrame, bitmaps: list[np.ndarray], bits: int, seed: int, max_n: int) -> DataFrame:
    """(suffix): from each word on, the keys of two to max_n words, eight bytes each."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)

    def cut_up(batches):
        for _, keys, _, _, follows in _steps(batches, seed):
            if len(keys) < 2:
                continue
            pairs, *triples = (np.concatenate([x, np.zeros(max_n, bool)]) for x in _follow(keys, follows, shared.value, bits))
            start = np.flatnonzero(pairs)
            size, alive = np.full(len(start), 2), np.ones(len(start), bool)
            for k in range(max_n - 2):
                alive = alive & (triples[0] if triples else pairs[1:])[start + k]
                size += alive
            words = keys[np.minimum(start[:, None] + np.arange(max_n), len(keys) - 1)]
            raw = words.astype(">u8").view(np.uint8).reshape(len(start), 8 * max_n)[np.arange(8 * max_n) < 8 * size[:, None]]
            ends = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])], names=["suffix"])

    return texts.mapInArrow(cut_up, "suffix binary")


def _prefixes(suffixes: DataFrame, min_count: int) -> DataFrame:
    """(phrase, n) for every prefix of two words or more that occurs min_count times."""
    each = suffixes.groupBy("suffix").agg(F.count("*").alias("n"))
    size = (F.octet_length("suffix") / 8).cast("int")
    prefixes = each.select("n", F.explode(F.sequence(F.lit(2), size)).alias("k"), "suffix").select(F.expr("substring(suffix, 1, 8 * k)").alias("phrase"), "n")
    return prefixes.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def frequent(docs: DataFrame, max_n: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """All words (key, lang, word, n), and the phrases (phrase: their words' keys one after another, n) of two words or more that occur min_count times."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    bits = min(MAX_BITS, max(12, (text_bytes(texts) // 128).bit_length()))
    for seed in range(8):
        to = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"
        _counts(texts, bits, seed).write.option("compression", "zstd").parquet(to)
        counts = spark.read.parquet(to)
        key = F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("key")
        words = cut(counts.where("key is not null").groupBy("key").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n"), (F.min("word") != F.max("word")).alias("a"), (F.min("lang") != F.max("lang")).alias("b")).select(key, "lang", "word", "n", (F.col("a") | F.col("b")).alias("shared")))
        if words.where("shared").isEmpty():
            break
    bitmaps = [_frequent(counts, bits, min_count)]
    if max_n > 2:
        to = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"
        _triples(texts, bitmaps[0], bits, seed).write.option("compression", "zstd").parquet(to)
        bitmaps.append(_frequent(spark.read.parquet(to), bits, min_count))
    return words.drop("shared"), cut(_prefixes(_suffixes(texts, bitmaps, bits, seed, max_n), min_count))


def collocations(docs: DataFrame, max_n: int = 5, min_count: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases.

    a is the phrase's count; of its cuts into two parts with counts l and r the one with the lowest floor(1000 a n / (l r)) counts, the
    first of equal ones. A phrase inside a longer one with at least `share` percent of its count is dropped.
    """
    words, phrases = frequent(docs, max_n, min_count)
    known = phrases.select(F.col("phrase").alias("part"), F.col("n").alias("f")).union(words.where(F.col("n") >= min_count).select("key", "n"))
    size = (F.octet_length("phrase") / 8).cast("int")
    of = lambda start, length: F.expr(f"substring(phrase, {start}, {length})")
    # one word more is enough: what lies inside a longer phrase lies inside one of those between, which is at least as frequent
    inside = phrases.where(size > 2).select("n", F.explode(F.array(of(1, "octet_length(phrase) - 8"), of(9, "octet_length(phrase)"))).alias("phrase")).groupBy("phrase").agg(F.max("n").alias("longer"))
    own = phrases.withColumnRenamed("n", "a").join(inside, "phrase", "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    first = words.where(F.col("n") >= min_count).select(F.col("key").alias("head"), "lang").join(totals, "lang")
    cuts = own.select("phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    scored = (
        cuts.select("phrase", "a", "k", of(1, "8 * k").alias("first"), of("8 * k + 1", "octet_length(phrase)").alias("rest"))
        .join(known.select(F.col("part").alias("first"), F.col("f").alias("l")), "first").join(known.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
        .select("phrase", "a", "k", "l", "r", of(1, 8).alias("head")).join(first, "head")
        .withColumn("score", F.expr("(1000 * cast(a as decimal(20, 0)) * cast(n as decimal(20, 0))) div (cast(l as decimal(20, 0)) * cast(r as decimal(20, 0)))"))
        .groupBy("phrase", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    )
    scored = scored.select("phrase", "lang", "a", "best.l", "best.r", "n", "best.score")
    near = cut(scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place"))
    spelled = (
        near.select("phrase", F.explode(F.sequence(F.lit(0), size - 1)).alias("at")).select("phrase", "at", of("8 * at + 1", 8).alias("key")).join(words.select("key", "word"), "key")
        .groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("phrase", F.array_join("w.word", " ").alias("text"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")
    out = near.join(spelled, "phrase").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
