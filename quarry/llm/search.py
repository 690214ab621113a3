"""Exact top-k search: BM25 over an inverted index with block-max pruning, per shard, merged by global statistics.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. A query is a whole text: the score of a document is the sum over the
query's distinct words of (occurrences in the query) * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl /
avgdl)), with N, df and avgdl of all documents.

The index is built once and written to the shared folder: a row holds some MB of documents as blocks of 32, each block its posting lists
in order of term. All statistics come from it. A task is a shard. A query's pivot is the next block where the maxima of its lists sum up
to the query's current k-th score; the blocks before it are skipped. The pivots' documents are scored in single precision, and those in
full that reach the k-th score within its error. Rare lists are so short that their exact sums take the place of their maxima. Shards send
packed lists of k, which are merged by query.

Queries go in blocks of at most about `query_terms` words' weights and `block_queries` queries; one block after another is broadcast, run,
written and released. Scores are rounded to six digits, ties go to the smaller doc_id, documents that share no word with a query are not
returned. A null or empty text is found by no query and as a query finds nothing; rows with a null doc_id are left out; of repeated ids
the best score counts; very long texts are indexed whole. Other columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_text, shared_dir, slices
from .kernel import ALNUM, Words

K1, B = 1.2, 0.75
#: Lists that more than this share of documents is in are bounded by block maxima, the others scored at once.
FREQUENT, BLOCK, STEP = 0.07, 32, 512
#: A step takes whole blocks, as many as keep it to this number of (query, document) cells and of weighted postings.
CELLS = 1 << 19
#: Weighted postings that are summed at once.
PART = 1 << 17
#: Scores of a row of the index that a task keeps before they are merged with the best so far.
FOUND = 1 << 15
#: Bytes of text in a row of the index; a longer text makes a row of its own.
ROW_BYTES = 1 << 20
#: Rows are large: a file of the index is cut after each few MB (else after a hundred rows at the earliest), and a task is sent few rows or texts at once.
_FILES = {"parquet.block.size": str(8 << 20), "parquet.page.size": str(1 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
ROWS_AT_ONCE, TEXTS_AT_ONCE = 4, 2000
#: A list has one posting at least and 32 at most; tf takes four bytes in a row where some word occurs more than 255 times in a text.
_INDEX = {"ids": np.int64, "lengths": np.int64, "terms": np.uint64, "list_term": np.int32, "list_n": np.uint8, "block_at": np.int32, "docs": np.uint8, "tf": np.uint8}
_FOUND = "query_id long, docs binary, scores binary"


def _terms(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of a slice, sorted."""
    t, h = w.text(), w.hash
    o = np.lexsort((h, t))
    t, h = t[o], h[o]
    at = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(t) else np.zeros(0, np.int64)
    return t[at], h[at], np.diff(np.r_[at, len(t)])


def _index(batches):
    """Documents -> rows of the index: block b has the lists block_at[b]..block_at[b + 1], and list l the next list_n[l] postings."""
    for batch in batches:
        ids = np.asarray(batch.column(0)).astype(np.int64)
        for i, j, buf, off in slices(batch.column(1), ROW_BYTES):
            w = Words(buf, off, ALNUM, lower=True)
            t, h, tf = _terms(w)
            terms, at = np.unique(h, return_inverse=True)
            block = t // BLOCK
            o = np.lexsort((t, at, block))
            block, at, t, tf = block[o], at[o], t[o], tf[o]
            new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (at[1:] != at[:-1])]) if len(o) else np.zeros(0, np.int64)
            row = (ids[i:j], w.counts(), terms, at[new], np.diff(np.r_[new, len(o)]), np.searchsorted(block[new], np.arange(-(-(j - i) // BLOCK) + 1)), t % BLOCK, tf)
            kinds = _INDEX | ({"tf": np.int32} if len(tf) and tf.max() > 255 else {})
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(row, kinds.values(), strict=True)], names=list(_INDEX))


def _read(batch: pa.RecordBatch, *names: str):
    for row in zip(*(batch.column(n) for n in names), strict=True):
        out = [np.frombuffer(x.as_buffer(), _INDEX[n]) for x, n in zip(row, names, strict=True)]
        if "tf" in names and len(out[-1]) > len(out[-2]):
            out[-1] = out[-1].view(np.int32)
        yield out


def _statistics(batches):
    """Documents with each term, once a task; under no term, the documents and their words."""
    terms, counts, n_docs, n_words = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
    for b in batches:
        for lengths, own, list_term, list_n in _read(b, "lengths", "terms", "list_term", "list_n"):
            n_docs, n_words = n_docs + len(lengths), n_words + int(lengths.sum())
            here = np.bincount(list_term, list_n, len(own)).astype(np.int64)
            terms, at = np.unique(np.concatenate([terms, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, here]), len(terms)).astype(np.int64)
    no_term = np.r_[True, np.zeros(len(terms), bool)]
    columns = np.r_[np.int64(0), terms.view(np.int64)], np.r_[np.int64(n_docs), counts], np.r_[np.int64(n_words), np.zeros(len(terms), np.int64)]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], mask=no_term), pa.array(columns[1]), pa.array(columns[2])], names=["term", "n", "words"])


def _query_terms(column) -> list[pa.Array]:
    sizes, terms, counts = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, buf, off in slices(column):
        t, h, n = _terms(Words(buf, off, ALNUM, lower=True))
        sizes.append(np.bincount(t, minlength=j - i))
        terms.append(h.view(np.int64))
        counts.append(n)
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(terms)), pa.array(np.concatenate(counts))], names=["term", "n"])
    return [pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pairs)]


class Shard:
    """The current k best documents of each query of a block, over the rows of the index added so far."""

    def __init__(self, queries: list, n_docs: int, mean: float, k: int):
        self.ids = np.array([q[0] for q in queries], np.int64)
        self.vocabulary, at = np.unique(np.concatenate([np.frombuffer(q[1], np.int64).view(np.uint64) for q in queries]), return_inverse=True)
        at = at.astype(np.int32)
        df = np.concatenate([np.frombuffer(q[3], np.int64) for q in queries]).astype(np.float64)
        share = np.zeros(len(self.vocabulary))
        share[at] = df / max(n_docs, 1)
        weight = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        del df
        weight *= np.concatenate([np.frombuffer(q[2], np.int64) for q in queries])
        owner = np.repeat(np.arange(len(queries), dtype=np.int32), [len(q[1]) // 8 for q in queries])
        self.is_frequent = share > FREQUENT
        self.frequent = np.cumsum(self.is_frequent) - 1
        dense = self.is_frequent[at]
        self.q = np.zeros((len(queries), int(self.is_frequent.sum())))
        self.q[owner[dense], self.frequent[at[dense]]] = weight[dense]
        self.q32 = np.ascontiguousarray(self.q.T.astype(np.float32))
        at, owner, weight = at[~dense], owner[~dense], weight[~dense]
        o = np.argsort(at, kind="stable")
        self.rare_query, self.rare_weight, at = owner[o].astype(np.int64), weight[o], at[o]
        self.rare_at = np.searchsorted(at, np.arange(len(self.vocabulary) + 1))
        self.mean, self.k = max(mean, 1e-9), k
        self.score, self.doc = np.zeros((len(queries), k)), np.full((len(queries), k), np.iinfo(np.int64).max)
        self.low = np.zeros(len(queries))  # the k-th best score is no lower
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # not merged yet
        self.scored = self.blocks = 0

    def add(self, ids, lengths, terms, list_term, list_n, block_at, docs, tf) -> None:
        blocks = len(block_at) - 1
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        place = np.where(self.vocabulary[at] == terms, at, -1)[list_term]  # of each list among the words asked
        n, block = list_n.astype(np.int64), np.repeat(np.arange(blocks), np.diff(block_at))
        list_at = np.cumsum(n) - n
        known = np.flatnonzero(place >= 0)
        if not len(known):
            return
        place, block, n, start = place[known], block[known], n[known], list_at[known]
        of = np.repeat(np.arange(len(known)), n)  # the list of each posting
        p = np.arange(n.sum()) + np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n)
        doc = block[of] * BLOCK + docs[p]
        tf = tf[p].astype(np.float64)
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / self.mean))
        most = np.maximum.reduceat(impact, np.r_[0, np.cumsum(n)[:-1]])  # block maxima
        cuts = np.searchsorted(block, np.arange(blocks + 1))
        posting = np.r_[0, np.cumsum(n)]
        weighted = np.r_[0, np.cumsum(np.where(self.is_frequent[place], 0, self.rare_at[place + 1] - self.rare_at[place]) * n)][cuts]
        steps = max(1, min(STEP, CELLS // len(self.ids)) // BLOCK)
        a = 0
        while a < blocks:
            b = min(max(a + 1, int(np.searchsorted(weighted, weighted[a] + CELLS, "right")) - 1), a + steps, blocks)
            lo, hi = cuts[a], cuts[b]
            if hi > lo:
                x, y = posting[lo], posting[hi]
                self._step(ids[a * BLOCK : b * BLOCK], b - a, place[lo:hi], block[lo:hi] - a, most[lo:hi], place[of[x:y]], doc[x:y] - a * BLOCK, impact[x:y])
            a = b
        if self.found:
            self._merge()

    def _step(self, ids, blocks: int, list_place, list_block, most, place, doc, impact) -> None:
        nq, nd, width = len(self.ids), blocks * BLOCK, self.q.shape[1]
        is_list = self.is_frequent[list_place]
        maxima = np.zeros((blocks, width), np.float32)
        maxima[list_block[is_list], self.frequent[list_place[is_list]]] = most[is_list]
        dense = self.is_frequent[place]
        r_place, r_doc, r_impact = place[~dense], doc[~dense], impact[~dense]
        a = self.rare_at[r_place]
        n = self.rare_at[r_place + 1] - a
        rare = np.empty((nd, nq))  # of one document all queries side by side, as its postings come together
        ends = np.searchsorted(r_doc // BLOCK, np.arange(blocks + 1))
        before = np.r_[0, np.cumsum(n)]
        x = 0
        while x < blocks:  # a part takes whole blocks, so few that what it makes stays in the processor's own memory
            z = min(max(x + 1, int(np.searchsorted(before[ends], before[ends[x]] + PART, "right")) - 1), blocks)
            p = slice(ends[x], ends[z])
            times, first = n[p], before[p]
            at = np.arange(first[0], before[ends[z]]) if len(times) else np.zeros(0, np.int64)
            at += np.repeat(a[p] - first, times)
            weights = self.rare_weight[at]
            weights *= np.repeat(r_impact[p], times)
            cell = self.rare_query[at]
            cell += np.repeat((r_doc[p] - x * BLOCK) * nq, times)
            rare[x * BLOCK : z * BLOCK] = np.bincount(cell, weights, (z - x) * BLOCK * nq).reshape(-1, nq)
            x = z
        # sums of half the digits first: all terms are positive, so they are off by as many roundings as there are terms at most
        off = np.float32((width + 64) * 2.0**-22)
        low = (self.low * (1 - off) - 1e-5).astype(np.float32)
        bound = maxima @ self.q32 + rare.reshape(blocks, BLOCK, nq).max(1)
        pivot = (bound > 0) & (bound * (1 + off) >= low)
        self.scored, self.blocks = self.scored + int(pivot.sum()), self.blocks + pivot.size
        some = np.flatnonzero(pivot.any(1))
        if not len(some):
            return
        d = np.zeros((nd, width))
        d[doc[dense], self.frequent[place[dense]]] = impact[dense]
        if len(some) < blocks:
            cols = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            cols = cols[cols < len(ids)]
            near = d[cols].astype(np.float32) @ self.q32
            near += rare[cols]
        else:
            cols = np.arange(nd)
            near = d.astype(np.float32) @ self.q32
            near += rare
        hit = near >= np.maximum(low, np.float32(1e-30))
        if np.count_nonzero(hit) > nq * self.k // 4 and len(cols) > self.k and len(np.unique(ids)) == len(ids):
            # many are still as good: the k-th best of these documents, if all are different, bounds the k-th best of all
            self.low = np.maximum(self.low, np.partition(near, -self.k, axis=0)[-self.k] * (1 - off))
            low = (self.low * (1 - off) - 1e-5).astype(np.float32)
            hit = near >= np.maximum(low, np.float32(1e-30))
        j, query = np.nonzero(hit)
        j = cols[j]
        score = rare[j, query]
        for x in range(0, len(j), 4096):
            y = slice(x, x + 4096)
            score[y] += np.einsum("ij,ij->i", self.q[query[y]], d[j[y]])
        self.found.append((query, ids[j], np.round(score, 6)))
        if sum(len(f[0]) for f in self.found) > FOUND:
            self._merge()

    def _merge(self) -> None:
        query, doc, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found = []
        keep = (score > 0) & (score >= self.score[query, -1])
        query, doc, score = query[keep], doc[keep], score[keep]
        changed = np.unique(query)
        query = np.concatenate([query, np.repeat(changed, self.k)])
        doc, score = np.concatenate([doc, self.doc[changed].ravel()]), np.concatenate([score, self.score[changed].ravel()])
        self.doc[changed], self.score[changed] = best(query, doc, score, changed, self.k)
        self.low = np.maximum(self.low, self.score[:, -1])

    def rows(self):
        for i in np.flatnonzero(self.score[:, 0] > 0):
            n = int((self.score[i] > 0).sum())
            yield int(self.ids[i]), self.doc[i, :n].tobytes(), self.score[i, :n].tobytes()


def best(query: np.ndarray, doc: np.ndarray, score: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, then smaller doc) of each query; a document once."""
    docs, scores = np.full((len(queries), k), np.iinfo(np.int64).max), np.zeros((len(queries), k))
    if not len(query):
        return docs, scores
    o = np.lexsort((-score, doc, query))
    o = o[np.r_[True, (query[o][1:] != query[o][:-1]) | (doc[o][1:] != doc[o][:-1])]]
    o = o[np.lexsort((doc[o], -score[o], query[o]))]
    at = np.searchsorted(query[o], queries)
    place = np.arange(len(o)) - at[np.searchsorted(queries, query[o])]
    o, place = o[place < k], place[place < k]
    row = np.searchsorted(queries, query[o])
    docs[row, place], scores[row, place] = doc[o], score[o]
    return docs, scores


def _pack(batches):
    for b in batches:
        t = b.column(1)
        off, v = t.offsets.to_numpy(), t.values
        cols = [np.ascontiguousarray(v.field(c).to_numpy()).astype(np.int64) for c in range(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([c[a:e].tobytes() for a, e in zip(off[:-1], off[1:], strict=True)], pa.binary()) for c in cols), b.column(2).cast(pa.int64())], names=["query_id", "term", "n", "df", "block"])


@contextlib.contextmanager
def _at_once(spark: SparkSession, n: int):
    """What is run meanwhile sends at most n rows to a task's Python at once."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def _scored(index: DataFrame, rows, n_docs: int, mean: float, k: int) -> DataFrame:
    """The k best of each query of a block in each shard."""

    def run(batches):
        shard = Shard(rows.value, n_docs, mean, k)
        for b in batches:
            for row in _read(b, *_INDEX):
                shard.add(*row)
        out = list(shard.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], names=["query_id", "docs", "scores"])

    return index.mapInArrow(run, _FOUND)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, query_terms: int = 600_000, block_queries: int = 1 << 13) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best documents for each row of queries(doc_id, text)."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    with _at_once(spark, TEXTS_AT_ONCE):
        texts.mapInArrow(_index, ", ".join(f"{c} binary" for c in _INDEX)).write.options(**_FILES).parquet(f"{folder}/index")
    index = spark.read.schema(", ".join(f"{c} binary" for c in _INDEX)).parquet(f"{folder}/index")
    with _at_once(spark, ROWS_AT_ONCE):
        counts = cut(index.select("lengths", "terms", "list_term", "list_n").mapInArrow(_statistics, "term long, n long, words long").groupBy("term").agg(F.sum("n").alias("df"), F.sum("words").alias("words")))
    n_docs, n_words = counts.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    asked = queries.select(F.col("doc_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).where("query_id is not null")
    asked = asked.groupBy("query_id").agg(F.min("text").alias("text"))  # of several texts of one id, the first by code points
    asked = map_text(asked, _query_terms, "terms array<struct<term:bigint,n:bigint>>").select("query_id", F.explode("terms").alias("t")).select("query_id", "t.term", "t.n")
    with _at_once(spark, TEXTS_AT_ONCE):
        weighed = cut(asked.join(counts.select("term", "df"), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "n", "df")).alias("terms")))
    n_queries, n_terms = weighed.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n_terms // query_terms), -(-n_queries // block_queries))
    packed = cut(weighed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).mapInArrow(_pack, "query_id long, term binary, n binary, df binary, block long"))
    for block in range(blocks):
        rows = [tuple(r)[:4] for r in packed.where(F.col("block") == block).collect()]  # bounded by query_terms and block_queries
        if rows:
            held = spark.sparkContext.broadcast(rows)
            with _at_once(spark, ROWS_AT_ONCE):
                _scored(index, held, n_docs, n_words / max(n_docs, 1), k).write.mode("append").parquet(f"{folder}/found")
            held.destroy()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    found = spark.read.schema(_FOUND).parquet(f"{folder}/found")
    groups = max(1, found.count() // 50_000)

    def merge(table: pa.Table) -> pa.Table:
        d = [np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()]
        s = [np.frombuffer(x, np.float64) for x in table.column("scores").to_pylist()]
        q = np.repeat(table.column("query_id").to_numpy(), [len(x) for x in d])
        ids = np.unique(q)
        doc, score = best(q, np.concatenate(d), np.concatenate(s), ids, k)
        i, j = np.nonzero(score > 0)
        return pa.table({"query_id": ids[i], "rank": pa.array(j + 1, pa.int32()), "doc_id": doc[i, j], "score": score[i, j]})

    return found.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g")).applyInArrow(merge, "query_id long, rank int, doc_id long, score double")
