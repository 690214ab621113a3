"""The quality classifier against a plain discriminant, its statistics against plain counts, and its edge cases."""

import math
import random
import zlib

import numpy as np

from quarry.llm import quality as Q


def plain_statistics(text):
    raw = (text or "").encode()
    words = [w for w in raw.translate(bytes(32 if 9 <= b <= 13 else b for b in range(256))).split(b" ") if w]
    letter = lambda b: chr(b).isalpha() and b < 128 or b >= 128
    letters, digits = sum(map(letter, raw)), sum(48 <= b < 58 for b in raw)
    stops = sum(b in b".,;:'\"?-()" for b in raw)
    symbols = sum(32 < b < 127 and not letter(b) and not 48 <= b < 58 and b not in b".,;:'\"?-()" for b in raw)
    marks, n, length = letters + digits + stops + symbols, len(words), [len(w) for w in words]
    mean = sum(length) / max(n, 1)
    logit = lambda a, b: math.log((a + 0.5) / (max(b - a, 0) + 0.5))
    return [
        math.log1p(n), math.log1p(mean), math.log1p(math.sqrt(max(sum(x * x for x in length) / max(n, 1) - mean**2, 0))), logit(letters, marks), logit(digits, marks), logit(symbols, marks),
        logit(sum(65 <= b < 91 for b in raw), sum(letter(b) and b < 128 for b in raw)), math.log((stops + 0.5) / (n + 1)), logit(sum(not any(map(letter, w)) for w in words), n), math.log((len(set(words)) + 0.5) / (n + 1)),
        logit(sum(a == b for a, b in zip(words, words[1:])), n), math.log((len(set(zip(words, words[1:]))) + 0.5) / (n + 0.5)), logit(max((words.count(w) for w in set(words)), default=0), n), logit(sum(x <= 3 for x in length), n),
        logit(sum(33 <= w[-1] < 127 and not letter(w[-1]) and not 48 <= w[-1] < 58 and w[-1] not in b".,;:'\"?-()" for w in words), n), math.log((raw.count(b"\n") + 0.5) / (n + 1)),
    ]


TEXTS = ["", None, "a", "été Été 12 %% ok!!\nok ok ok!! (x)", "A b c a b c, a b c; a b.", " \t\n", "x" * 5000 + " y" * 5000, "| a | b | c"]


def test_statistics_against_plain_counts(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["the", "Of", "x1", "é!", "|", "word."]) for _ in range(rng.randrange(60))) for _ in range(40)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["statistics"] for r in Q.quality(got, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain_statistics(t)), t


def test_scores_against_a_plain_discriminant(spark):
    """Densities by determinants and inverses of the shrunk covariances, from all labelled rows outside the held-out fifth."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(300):
        good = i % 3 > 0
        text = " ".join(rng.choice(["alpha", "beta", "of", "it.", "Gamma", "x7", "d", "épsilon"]) + ("" if good or rng.random() < 0.5 else "%%") for _ in range(rng.randrange(3, 80)))
        rows.append((i, text)), labels.append((i, int(good)))
    rows += [(7, "repeated row"), (7, "repeated row"), (None, "no id")]
    labels += [(11, 0), (12, None), (None, 1), (13, 5)]
    got = Q.quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    known = {}
    for k, y in labels:
        if k is not None and y in (0, 1) and zlib.crc32(str(k).encode()) % 5:
            known[k] = min(known.get(k, 1), y)
    x = {y: np.array([plain_statistics(t) for k, t in rows if known.get(k) == y]) for y in (0, 1)}
    cov = {y: np.cov(x[y].T, bias=True) for y in (0, 1)}
    both = sum(len(x[y]) * cov[y] for y in (0, 1)) / sum(map(len, x.values()))
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3)
    for k, t in rows[:60] + rows[-3:]:
        at, dens = np.array(plain_statistics(t)), []
        for y in (0, 1):
            c = 0.8 * cov[y] + 0.2 * both
            c = 0.98 * c + 0.02 * np.diag(np.diag(c)) + 1e-6 * np.eye(len(at))
            v = at - x[y].mean(0)
            dens.append(math.log(len(x[y])) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * v @ np.linalg.inv(c) @ v)
        want = 1 / (1 + math.exp(-max(-700, min(700, dens[1] - dens[0]))))
        assert all(abs(r["score"] - want) < 1e-6 for r in got if r["doc_id"] == k and r["statistics"] == [*r["statistics"]] and np.allclose(r["statistics"], at))


def test_quality_edges(spark):
    """Clashing names give way, empty tables give none, one kind of label decides alone, the text comes back with keep."""
    docs = spark.createDataFrame([(1, "a b", "mine", 5.0, "en"), (2, None, "mine", 6.0, "fr")], "doc_id long, text string, score string, Predicted double, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.quality(docs, none, keep=True)
    assert out.columns == ["doc_id", "text", "lang", "held_out", "score", "predicted", "statistics"] and {(r["text"], r["score"], r["predicted"]) for r in out.collect()} == {("a b", 0.0, 0), (None, 0.0, 0)}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in Q.quality(docs, ones).collect()} == {1.0}
    assert Q.quality(docs.limit(0), ones).count() == 0


def test_held_out_accuracy(spark):
    from quarry.llm.queries import op12_quality

    d = "/root/testdata/sf0.01"
    rows = op12_quality(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
