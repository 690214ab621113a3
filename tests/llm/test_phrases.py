"""Phrases against plain counting of all n-grams, over many slices and ranges."""

import random
import re
from collections import Counter

from quarry.llm import phrases as P


def plain(rows, max_n, min_count, share, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: n for p, n in f.items() if len(p) > 2 and n >= min_count}
    gone = {(p[0], *p[i : i + m]) for p, n in found.items() for m in range(2, len(p) - 1) for i in range(1, len(p) - m + 1) if 100 * n >= share * f[(p[0], *p[i : i + m])]}
    out = []
    for lang in total:
        mine = []
        for p in found.keys() - gone:
            if p[0] == lang:
                best = min((1000 * f[p] * total[lang] // (f[p[:k]] * f[(lang, *p[k:])]), k) for k in range(2, len(p)))
                mine.append((best[0], f[p], " ".join(p[1:]), f[p[: best[1]]], f[(lang, *p[best[1] :])]))
        mine.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, t, a, x, y, total[lang], s) for i, (s, a, t, x, y) in enumerate(mine[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed, n=150):
    rng, out = random.Random(seed), []
    fixed = "Über the quick\tbrown fox, jumps é over; the lazy dog the the the the the the"
    for i in range(n):
        words = [rng.choice(["The", "the", "of", "a", "naïve", "x", "日本", "dog", "fox"]) + rng.choice(["", "", "", ",", ".\n", "!", "  "]) for _ in range(rng.randrange(0, 60))]
        out.append((rng.choice(["en", "fr", None, "", "und"]), " ".join(words) + (fixed if i % 3 == 0 else "")))
    return out + [("en", None), (None, ""), ("xx", " \t "), ("en", "the " * 3000)] + out[:5]


def test_phrases_against_plain_counts(spark, monkeypatch):
    """Slices of 300 bytes; thresholds, shares of longer phrases and lengths; rows with other columns."""
    monkeypatch.setattr(P, "STEP", 300)
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], "lang string, text string, key int, word string").repartition(5)
    for max_n, least, share, top in ((5, 20, 100, 2000), (3, 5, 60, 10), (2, 2, 100, 50)):
        assert rows_of(P.collocations(docs, max_n, least, share, top)) == plain(rows, max_n, least, share, top)


def test_ranges_that_cut_prefixes(spark):
    """Counts over many ranges of suffixes are those over one."""
    docs = spark.createDataFrame(corpus(2), "lang string, text string")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert rows_of(P.collocations(docs, 4, 10)) == plain(corpus(2), 4, 10, 100, 2000)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_suffixes_end_at_rare_triples(spark):
    """Pairs a b and b c are frequent, the triple a b c is not: no suffix is written for it, however many pairs there are."""
    rows = [("en", "a b")] * 30 + [("en", "b c")] * 30 + [("en", "a b c")] * 2 + [("en", "x y z")] * 20
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    bits = 12
    pairs = P._frequent(P._counts(texts, bits, 0), bits, 20)
    triples = P._frequent(P._triples(texts, pairs, bits, 0), bits, 20)
    sizes = Counter(len(r["suffix"]) // 8 for r in P._suffixes(texts, [pairs, triples], bits, 0, 5).collect())
    assert sizes == {2: 30 + 30 + 2 * 2 + 20, 3: 20}
    assert rows_of(P.collocations(texts, 5, 20)) == plain(rows, 5, 20, 100, 2000)


def test_words_that_share_a_key(spark, monkeypatch):
    """With a seed under which all words share one key, the words are counted anew."""
    real, seeds = P._steps, []

    def steps(batches, seed):
        for w, keys, *rest in real(batches, seed):
            yield (w, keys if seed else keys * 0, *rest)

    monkeypatch.setattr(P, "_steps", steps)
    counts = P._counts
    monkeypatch.setattr(P, "_counts", lambda texts, bits, seed: (seeds.append(seed), counts(texts, bits, seed))[1])
    docs = spark.createDataFrame([("en", "a b"), ("en", "a b"), ("fr", "c")], "lang string, text string").repartition(3)
    assert rows_of(P.collocations(docs, 5, 2)) == [("en", 1, "a b", 2, 2, 2, 4, 2000)] and seeds == [0, 1]


def test_no_phrases(spark):
    for rows in ([], [("en", None)], [("en", "a, b"), ("en", "a")]):
        assert rows_of(P.collocations(spark.createDataFrame(rows, "lang string, text string"), 5, 2)) == []
