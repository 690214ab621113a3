"""Each stage of the pipeline against a brute-force version on the output of the one before."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm.toxicity import fit, scorer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"
VOCAB = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, d = random.Random(12), str(tmp_path_factory.mktemp("sf"))
    base, shared, bench = prose(rng, 90), prose(rng, 30), prose(rng, 40)
    texts = [None, "", base, base, base.replace(base.split()[40], "zz", 1), "vile " * 4 + prose(rng, 20), f"{prose(rng, 25)} {shared}", f"{shared} {prose(rng, 25)}", f"{prose(rng, 10)} {bench}", bench, prose(rng, 3000)]
    texts += [prose(rng, rng.randrange(1, 50)) + (" vile vile" if i % 4 == 0 else "") for i in range(120)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile" in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("b", bench), ("n", None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows):
    sets, root = {k: shingles(t) for k, t in rows.items()}, {k: k for k in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {k: t for k, t in rows.items() if root[k] == k}


def brute_cut(rows, n=13):
    first, out = {}, {}
    for k in sorted(rows):
        w = (rows[k] or "").split()
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), k)
    for k, t in rows.items():
        w = (t or "").split()
        gone = {p for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < k for p in range(i, i + n)}
        out[k] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
    return out


def brute_clean(rows, items, n=13):
    windows = {tuple(w[i : i + n]) for t in items if t for w in [t.split()] for i in range(len(w) - n + 1)}
    out = {}
    for k, t in rows.items():
        w = (t or "").split()
        hit = {p for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[k] = t
    return out


def test_stages(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    score = scorer(*fit(docs, labels))
    import pyarrow as pa

    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = dict(zip(rows, score(pa.array(list(rows.values()), pa.string()))[0].to_pylist(), strict=True))
    want = {k: t for k, t in rows.items() if scores[k] < 0.5}
    brutes = (lambda r: want, brute_near, brute_cut, lambda r: brute_clean(r, items))
    for (name, stage), brute in zip(pipeline.STAGES[:-1], brutes, strict=True):
        kept = stage(spark, docs, tables)
        assert kept.columns == docs.columns, name
        rows, out = brute(rows), {r["doc_id"]: r for r in kept.collect()}
        assert {k: r["text"] for k, r in out.items()} == rows, name
        assert all(r["note"] == "x" and r["n_chars"] == len(r["text"] or "") for r in out.values()), name
        docs = spark.createDataFrame([tuple(r) for r in out.values()], docs.schema)
    assert len(rows) < len(want) < 131 and 5 not in rows and 3 not in rows and 4 not in rows and 9 not in rows
    mixed = pipeline.STAGES[-1][1](spark, docs, tables).collect()
    taken, target = defaultdict(int), {}
    for r in mixed:
        assert r["size"] == len((rows[r["doc_id"]] or "").split()) and r["text"] == rows[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(mixed) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_stages_on_nothing(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    none = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, tables).count() == 0, name


def test_null_and_repeated_rows(spark, tables):
    """Rows without id are nobody's copy but lose repeated passages; rows that share an id stay or go together."""
    pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"q{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "a", 1, "x"), (1, text, "en", "a", 1, "x"), (2, text, None, None, None, None), (2, text, None, None, None, None), (None, text, None, None, None, None)], SCHEMA)
    stages = dict(pipeline.STAGES)
    near = stages["minhash_near_dedup"](spark, docs, tables)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "1", "None"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in stages["substring_dedup"](spark, near, tables).collect()) == [("1", text), ("1", text), ("None", "")]
    assert stages["mixing"](spark, docs, tables).agg(F.sum("size")).first()[0] == 200


def test_stages_keep_columns_named_like_results(spark, tables):
    """Columns of documents that have the names of operators' results come out of every stage as they went in."""
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ("score", "kept", "_text", "items", "size", "n_words", "held_out", "predicted", "row", "text_as_it_was", "row_of_documents", "_")
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("*", *(F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        assert all(r[n] == f"{n} of {r['doc_id']}" for r in out.collect() for n in names), name
