"""The fitted operators against plain versions of the same models, and what extra columns, nulls and empty tables do to every operator."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.llm import html as H
from quarry.llm import toxicity as T
from quarry.llm.decontam import contamination
from quarry.llm.kernel import ALNUM, Words
from quarry.llm.langid import classifier, fit, languages
from quarry.llm.license import licenses
from quarry.llm.minhash import near_duplicates
from quarry.llm.mixing import mix
from quarry.llm.search import search
from quarry.llm.substring import remove_repeats
from quarry.llm.urlfilter import url_verdicts

VOCAB = [f"w{i}" for i in range(200)]


def prose(rng, n, vocab=VOCAB):
    return " ".join(rng.choice(vocab) for _ in range(n))


def features(text, bits):
    raw = (text or "").encode()
    t, f = T._features(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM, lower=True), bits)
    return sorted(set(f.tolist()))


def test_features_are_ngrams_and_skipgrams():
    """A feature for every word, neighbouring pair and pair with one word between, however they stand in the text."""
    of = lambda t: set(features(t, 30))
    assert of("a b c") == of("A, b c!") and len(of("a b c")) == 3 + 2 + 1
    assert of("a") < of("a b") and of("a b c") - of("a b") - of("b c") == of("a x c") - of("a x") - of("x c")
    assert not of("") and not of(None)


def test_toxicity_against_a_plain_fit(spark):
    """The same FTRL-proximal steps with dictionaries, one coordinate at a time."""
    rng, bits, rows, labels = random.Random(6), 14, [], []
    for i in range(160):
        rows.append((i, prose(rng, rng.randrange(3, 25)) + (" vile awful" if i % 3 == 0 else "")))
        labels.append((i, int(i % 3 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.toxicity(docs, known, samples=64, epochs=3, bits=bits).collect()}
    # the sample, as documented: the smallest hash in each class
    hashed = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    train = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5]
    least = {}
    for k, y in train:
        least[(y, hashed[k] % 64)] = min(least.get((y, hashed[k] % 64), (1 << 63, 0)), (hashed[k], k))
    data = sorted((h, k, y) for (y, _), (h, k) in least.items())
    z, n, alpha, beta, l1, l2 = {}, {}, 1.0, 1.0, 30.0, 0.01

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[i])) / alpha + l2)

    text, one = dict(rows), 1 << bits
    for _ in range(3):
        for _, k, y in data:
            x = [*features(text[k], bits), one]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in x:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / alpha * w[i]
                n[i] = was + g * g
    share, used = [sum(y == v for _, y in train) for v in (0, 1)], [sum(y == v for _, _, y in data) for v in (0, 1)]
    b = weight(one) + math.log(share[1] / share[0]) - math.log(used[1] / used[0])
    for k, t in rows:
        want = 1 / (1 + math.exp(-sum(weight(i) for i in features(t, bits)) - b))
        assert abs(got[k]["score"] - want) < 1e-9 and got[k]["predicted"] == (want >= 0.5)


def test_toxicity_sample_bytes(spark):
    """The byte bound leaves one document a label at least; of several texts of one id the first is fitted on."""
    rows = [(i, prose(random.Random(i), 30) + (" vile" if i % 2 else "")) for i in range(60)] + [(1, "zzz")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    at, w, b = T.fit(docs, known, sample_bytes=1, epochs=1)
    assert np.isfinite(b) and T.fit(docs.repartition(7), known.repartition(3), sample_bytes=1, epochs=1)[2] == b


LANGS = {"en": ["the", "of", "and", "thing", "house"], "fr": ["les", "des", "pour", "être", "leur"], "de": ["der", "und", "über", "haus", "wenn"]}


def test_languages_against_plain_compression(spark):
    """Sizes by a compressor and a dictionary made anew for each text and language; ties, long texts, repeated rows, clashing names."""
    rng, rows = random.Random(8), []
    for i in range(120):
        lang = rng.choice(list(LANGS))
        rows.append((i, prose(rng, rng.randrange(1, 40), LANGS[lang]), lang))
    rows += [(200, prose(rng, 30000, LANGS["fr"]), None), (201, "qq qq", "en"), (201, "qq qq", "en"), (202, "٠ 1 -", "de"), (203, None, None), (204, "HAUS 7 haus!", None)]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    dictionaries = fit(docs)
    assert set(dictionaries) == set(LANGS)
    got = languages(docs).select("doc_id", "lang_pred", "score", "rejected").collect()
    assert len(got) == len(rows)

    def plain(text):
        letters = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip().encode()
        if not letters:
            return "und", 0.0
        sizes = {}
        for name, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[name] = len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(letters))
        best = min(sizes.values())
        known = {n: sum(w in dictionaries[n].split() for w in letters.split()) for n in sizes}
        name = min((n for n in sizes if sizes[n] == best), key=lambda n: (-known[n], n))
        return name, 1 / sum(math.exp((best - s) / 8) for s in sizes.values())

    want = {r[0]: plain(r[1]) for r in rows}
    assert all(r["lang_pred"] == want[r["doc_id"]][0] and abs(r["score"] - want[r["doc_id"]][1]) < 1e-6 for r in got)
    assert want[200][0] == "fr" and want[202] == ("und", 0.0) and want[204][0] == "de"
    only_long = spark.createDataFrame([(i, prose(rng, 20000, LANGS["de"]), "de") for i in range(4)], "doc_id long, text string, lang string")
    assert set(fit(only_long)) == {"de"}
    assert languages(docs.limit(0)).count() == 0 and classifier({})


def test_region_is_the_greatest_sum():
    """The scan against all spans."""
    rng, scores = random.Random(3), H.Scores(H.LABELLED)
    for _ in range(200):
        seq = [("text", prose(rng, rng.randrange(1, 4))) if rng.random() < 0.5 else ("tag", rng.choice(["div", "li", "p", "td", "ul"])) for _ in range(rng.randrange(0, 14))]
        v = H.values(seq, scores)
        best = max((sum(v[i:j]) for i in range(len(v)) for j in range(i + 1, len(v) + 1)), default=0)
        lo, hi = H.region(seq, scores)
        assert abs(sum(v[lo:hi]) - max(best, 0)) < 1e-9


PLAIN_PAGES = [
    ("<body><div><ul>{links}</ul></div><div><h1>Title of it</h1>{prose}</div><div><ul>{links}</ul></div></body>", "Title of it"),
    ("<body><table><tr><td>{links}</td><td>{prose}</td></tr></table><div>{links}</div></body>", None),
    ("<body><div>{links}</div><section>{prose}<ul><li>Short one</li><li>Short two</li></ul>{prose}</section></body>", "Short one"),
    ("<html><body><p>{links}</p><div><div>{prose}</div></div><p>{links}</p></body></html>", None),
]


@pytest.mark.parametrize("page, part", PLAIN_PAGES)
def test_pages_without_any_marks(page, part):
    """No class, id or telling element: only the scan parts the text from lists of links, and without it these would stay."""
    links = "".join(f"<li><a href='/{i}'>Some place {i}</a></li>" for i in range(12))
    text = " ".join(["Some words of a long text."] * 40)
    page, scores = page.format(links=links, prose=f"<p>{text}</p>"), H.Scores(H.LABELLED)
    got = H.extract(page, scores)
    assert text in got and "Some place" not in got and (part is None or part in got)
    seq = H.tokens(page)
    assert any("Some place" in v for k, v in seq if k == "text")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("toxic", "h", "id", "kept", "_row", "items", "n_hit", "n_words", "n_removed", "carried", "chunk", "size", "target", "taken", "position", "score", "rank", "matches", "component_id", "n_shingles", "class", "Predicted", "row", "key")


@pytest.mark.parametrize("empty", [False, True])
def test_extra_columns_with_clashing_names(spark, empty):
    """Every operator on nulls in all columns, repeated rows and columns named like its own: one row for each, each name once."""
    text = " ".join(f"q{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1), (2, text, "en", None, 1), (None, text, None, "b", None), (4, None, None, None, None), (4, None, None, None, None), (5, "", "en", "a", 0), (5, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(7).alias(n) for n in CLASH))
    docs = docs.where("false") if empty else docs
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    bench = spark.createDataFrame([("1", " ".join(text.split()[:20]), 1)], "item_id string, text string, n_hit int")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.com/x").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), *(F.lit(1).alias(n) for n in ("rule", "host", "tokens", "best", "text", "n_chars_")))
    results = {
        "toxicity": T.toxicity(docs, labels, keep=True), "contamination": contamination(docs, bench, keep=True), "shuffled": contamination(docs, bench, broadcast_bytes=0, keep=True),
        "languages": languages(docs), "repeats": remove_repeats(docs), "licenses": licenses(docs), "near": near_duplicates(docs), "mix": mix(docs, keep=True),
        "urls": url_verdicts(pages, [("com", "/", "block")]), "joined urls": url_verdicts(pages, [("com", "/", "block")], broadcast_rules=0), "text": H.main_text(pages),
    }
    for name, out in results.items():
        got = out.collect()
        assert len(got) == (0 if empty else len(rows)), name
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
    if not empty:
        assert {r["doc_id"]: r["n_removed"] for r in results["repeats"].collect()} == {1: 0, 2: 40, None: 40, 4: 0, 5: 0}
        assert {r["doc_id"]: r["contaminated"] for r in results["shuffled"].collect()} == {1: True, 2: True, None: True, 4: False, 5: False}
        assert {r["doc_id"]: r["component_id"] for r in results["near"].collect()} == {1: 1, 2: 1, None: 1, 4: 4, 5: 5}
    assert search(docs, docs.where("doc_id = 1"), 3).count() == (0 if empty else 2)
