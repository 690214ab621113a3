"""Substring deduplication with a log-structured index of window fingerprints.

A window is `window` consecutive words `[^\\x20\\x09-\\x0D]+`. A word goes if a window over it also starts in a document with a smaller
doc_id. Fingerprints are winnowed: the minimum hash of each run of 7-word grams that spans one window, so that two equal windows always
share one. They form sorted immutable runs, one for each bucket of hashes and task, in order of chunk (a share of the documents); runs of
the batch and of the index are merged per bucket, and fingerprints met twice lead each chunk to the windows over them. Those are verified by 96-bit hashes of all their words,
again merged per bucket, and only then removed. Chunks and buckets are dealt by leading bits of hashes and hold about `chunk_bytes` of
text each, however often a passage occurs: a chunk sends each fingerprint or window once.

Null texts have no words, very long ones are read whole; a null doc_id counts as larger than any other; rows that share a doc_id are one
document to each other, so neither loses words to the other. Other columns are carried along; one named like a result gives way to it.
Repeated rows are judged alike; empty tables give no rows.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, slices, text_bytes, without
from .kernel import SPACED, Words, chain_at, covered, member, winnow

WINDOW, GRAM = 13, 7
CHUNK_BYTES = 4 << 20
#: An id no document has: what a null doc_id counts as.
LAST = np.iinfo(np.int64).max
#: Fingerprints that a task holds before it writes a run.
RUN_KEYS = 1 << 22
_RUN = "bucket int, shift int, chunks binary, counts binary, keys binary, twice binary"
NEW = ("kept", "n_words", "n_removed")


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits: with more of them a bucket falls apart into whole ones."""
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _parts(b: np.ndarray):
    """The buckets of sorted bucket numbers with their spans."""
    if not len(b):
        return []
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    return [(int(b[lo]), int(lo), int(hi)) for lo, hi in zip(at, [*at[1:], len(b)], strict=True)]


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().fill_null(LAST)).astype(np.int64) if len(column) else np.zeros(0, np.int64)


def _bits(x: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool) if x else np.zeros(n, bool)


def _run_table(h: np.ndarray, chunk: np.ndarray, twice: np.ndarray, bits: int, shift: int = 0) -> pa.RecordBatch:
    """Rows of _RUN, one for each bucket: its keys in order of chunk and hash, with the number of each chunk's."""
    b = _bucket(h, bits)
    o = np.lexsort((h, chunk, b))
    h, chunk, twice, rows = h[o], chunk[o].astype(np.int32), twice[o], []
    for bucket, lo, hi in _parts(b[o]):
        at = np.flatnonzero(np.r_[True, chunk[lo + 1 : hi] != chunk[lo : hi - 1]])
        rows.append((bucket, shift, chunk[lo:hi][at].tobytes(), np.diff(np.r_[at, hi - lo]).astype(np.int32).tobytes(), h[lo:hi].tobytes(), np.packbits(twice[lo:hi]).tobytes()))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "shift", "chunks", "counts", "keys", "twice"])


def _flat(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, chunk, whether of two documents, shift) of all keys of some rows of _RUN."""
    get = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
    hs, chunks, counts = get("keys", np.uint64), get("chunks", np.int32), get("counts", np.int32)
    h, none = np.concatenate([*hs, np.zeros(0, np.uint64)]), np.zeros(0, np.int32)
    twice = np.concatenate([*(_bits(x, len(k)) for x, k in zip(table.column("twice").to_pylist(), hs, strict=True)), np.zeros(0, bool)])
    shift = np.repeat(np.array(table.column("shift").to_pylist(), np.int32), [len(k) for k in hs]) if hs else none
    return h, np.concatenate([*(np.repeat(c, n) for c, n in zip(chunks, counts, strict=True)), none]), twice, shift


def _distinct(h: np.ndarray, chunk: np.ndarray, twice: np.ndarray):
    """Each key of a chunk once; of two documents if marked so or there more than once."""
    o = np.lexsort((h, chunk))
    h, chunk, twice = h[o], chunk[o], twice[o]
    at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (chunk[1:] != chunk[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[at], chunk[at], (np.logical_or.reduceat(twice, at) if len(h) else twice) | (np.diff(np.r_[at, len(h)]) > 1)


def _runs_of(window: int, gram: int, bits: int):
    """The documents of a task -> its sorted run of fingerprints for each bucket; those in two documents of a chunk are marked."""

    def f(batches):
        held, size = [], 0
        for batch in batches:
            docs, chunks = np.asarray(batch.column(0).fill_null(LAST)).astype(np.int64), np.asarray(batch.column(2)).astype(np.int32)
            for i, _, buf, off in slices(batch.column(1)):
                w = Words(buf, off, SPACED)
                g, ok = w.grams(gram)
                at = np.flatnonzero(winnow(g, ok, window - gram + 1))
                h, row = g[at], i + w.text()[at]
                o = np.lexsort((docs[row], chunks[row], h))  # a document's own repetitions don't count
                h, d, c = h[o], docs[row][o], chunks[row][o]
                new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
                held.append(_distinct(h[new], c[new], np.zeros(int(new.sum()), bool)))
                size += len(held[-1][0])
                if size > RUN_KEYS:  # merge what is held; write it if that doesn't help
                    held = [_distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if 2 * size > RUN_KEYS:
                        yield _run_table(*held.pop(), bits)
                        size = 0
        if held:
            yield _run_table(*_distinct(*(np.concatenate(x) for x in zip(*held, strict=True))), bits)

    return f


def _resplit(bits: int):
    """Runs of fewer buckets -> the same for 2**bits buckets."""

    def f(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                h, chunk, twice, shift = _flat(row)
                yield _run_table(h, chunk, twice, bits, int(shift[0]) if len(shift) else 0)

    return f


def _merge_runs(table: pa.Table) -> pa.Table:
    """The runs of one bucket -> for each chunk, the fingerprints that another chunk has too, or two of its documents have."""
    h, chunk, twice, shift = _flat(table)
    o = np.argsort(h, kind="stable")  # runs are sorted: a merge
    h, chunk, twice, shift = h[o], chunk[o], twice[o], shift[o]
    same = h[1:] == h[:-1]
    mark = twice | np.r_[False, same] | np.r_[same, False] if len(h) else twice
    if (chunk < 0).any():  # what only the index has is settled
        mark &= member(h, np.unique(h[mark & (chunk >= 0)]))
    h, chunk, shift, out = h[mark], chunk[mark], shift[mark], []
    o = np.lexsort((h, shift, chunk))
    h, chunk, shift = h[o], chunk[o], shift[o]
    for c, lo, hi in _parts(chunk.astype(np.int64) << 6 | shift):
        c, s, keys = c >> 6, c & 63, np.unique(h[lo:hi]).tobytes()
        # a chunk of an older table stands for all those it has fallen apart into since
        out += [(c, keys)] if c >= 0 else [(-1 - x, keys) for x in range((-1 - c) << s, (-c) << s)]
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "keys": pa.array([x for _, x in out], pa.binary())})


def _windows_of(window: int, gram: int, bits: int):
    """A chunk's documents and its repeated fingerprints -> the windows over those for each bucket, each once with its smallest doc_id; those of two documents are marked."""

    def f(docs_table: pa.Table, keys_table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in keys_table.column("keys").to_pylist()] or [np.zeros(0, np.uint64)]))
        hs, ls, ds = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if len(keys) and docs_table.num_rows:
            docs = _ids(docs_table.column("doc_id"))
            for i, _, buf, off in slices(docs_table.column("text")):
                w = Words(buf, off, SPACED)
                g, ok = w.grams(gram)
                hit = np.flatnonzero(ok)
                hit = hit[member(g[hit], keys)]
                n = len(w.start) - window + 1
                if n <= 0 or not len(hit):
                    continue
                back = window - gram
                start = np.flatnonzero(covered(np.maximum(hit - back, 0), np.minimum(hit, back) + 1, n))
                start = start[start + window <= w.ends()[start]]
                hs.append(chain_at(w.hash, start, window))
                ls.append((chain_at(w.hash, start, window, 2) >> np.uint64(32)).astype(np.uint32))
                ds.append(docs[i + w.text()[start]])
        h, low, d = np.concatenate(hs), np.concatenate(ls), np.concatenate(ds)
        o = np.lexsort((d, low, h))
        h, low, d = h[o], low[o], d[o]
        new = np.r_[True, (h[1:] != h[:-1]) | (low[1:] != low[:-1])] if len(h) else np.zeros(0, bool)
        last = np.r_[np.flatnonzero(new)[1:], len(h)] - 1 if len(h) else np.zeros(0, np.int64)
        h, low, twice, d = h[new], low[new], d[new] < d[last], d[new]
        b = _bucket(h, bits)
        o = np.lexsort((d, b))
        h, low, d, twice = h[o], low[o], d[o], twice[o]
        parts = _parts(b[o])
        runs = [np.flatnonzero(np.r_[True, d[lo + 1 : hi] != d[lo : hi - 1]]) for _, lo, hi in parts]
        chunk = (docs_table if docs_table.num_rows else keys_table).column("chunk")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in parts], pa.int32()), "chunk": pa.array([chunk] * len(parts), pa.int32()),
                "hi": pa.array([h[lo:hi].tobytes() for _, lo, hi in parts], pa.binary()), "lo": pa.array([low[lo:hi].tobytes() for _, lo, hi in parts], pa.binary()),
                "twice": pa.array([np.packbits(twice[lo:hi]).tobytes() for _, lo, hi in parts], pa.binary()),
                "docs": pa.array([d[lo:hi][r].tobytes() for (_, lo, hi), r in zip(parts, runs, strict=True)], pa.binary()),
                "counts": pa.array([np.diff(np.r_[r, hi - lo]).astype(np.int32).tobytes() for (_, lo, hi), r in zip(parts, runs, strict=True)], pa.binary()),
            }
        )

    return f


def _merge_windows(table: pa.Table) -> pa.Table:
    """The windows of one bucket -> for each chunk of the batch, those that start in a smaller document: of another chunk, or (own) only of its own."""
    get = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
    his, los, docs, counts = get("hi", np.uint64), get("lo", np.uint32), get("docs", np.int64), get("counts", np.int32)
    at = np.cumsum([0, *map(len, his)])
    hi, lo = np.concatenate([*his, np.zeros(0, np.uint64)]), np.concatenate([*los, np.zeros(0, np.uint32)])
    twice = np.concatenate([*(_bits(x, len(k)) for x, k in zip(table.column("twice").to_pylist(), his, strict=True)), np.zeros(0, bool)])
    d = np.concatenate([*(np.repeat(x, c) for x, c in zip(docs, counts, strict=True)), np.zeros(0, np.int64)])
    o = np.lexsort((lo, hi))
    new = np.r_[True, (hi[o][1:] != hi[o][:-1]) | (lo[o][1:] != lo[o][:-1])] if len(hi) else np.zeros(0, bool)
    first = np.minimum.reduceat(d[o], np.flatnonzero(new)) if len(hi) else d
    later = np.zeros(len(hi), bool)
    later[o] = first[np.cumsum(new) - 1] < d[o] if len(hi) else False
    chunk, gone, out = table.column("chunk").to_pylist(), later | twice, []
    for c, a, b in zip(chunk, at[:-1], at[1:], strict=True):
        if c >= 0 and gone[a:b].any():
            g = gone[a:b]
            out.append((c, hi[a:b][g].tobytes(), lo[a:b][g].tobytes(), np.packbits(~later[a:b][g]).tobytes()))
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int32()), **{n: pa.array([x[k] for x in out], pa.binary()) for k, n in ((1, "hi"), (2, "lo"), (3, "own"))}})


def _gone(w: Words, d: np.ndarray, hi: np.ndarray, lo: np.ndarray, window: int):
    """(start, place among hi and lo) of each window of a slice that is among those; d: a document for each word."""
    h, ok = w.grams(window)
    start = np.flatnonzero(ok)
    start = start[member(h[start], hi)] if len(hi) else start[:0]
    low = (chain_at(w.hash, start, window, 2) >> np.uint64(32)).astype(np.uint32)
    at = np.searchsorted(hi, h[start])
    same = np.zeros(len(start), bool)
    while True:  # more than once only where 64-bit hashes collide
        same |= lo[np.minimum(at, len(lo) - 1)] == low if len(lo) else same
        more = ~same & (at + 1 < len(hi)) & (hi[np.minimum(at + 1, len(hi) - 1)] == h[start]) if len(hi) else same & False
        if not more.any():
            return start[same], at[same]
        at = at + more


def _nullable(t: pa.DataType) -> pa.DataType:
    """The type with nulls allowed everywhere, as a schema in words has it."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in t])
    if pa.types.is_list(t):
        return pa.list_(pa.field(t.value_field.name, _nullable(t.value_type)))
    if pa.types.is_map(t):
        return pa.map_(pa.field(t.key_field.name, _nullable(t.key_type), False), pa.field(t.item_field.name, _nullable(t.item_type)))
    return t


def _remove(window: int):
    """A chunk's documents and the windows that start earlier -> what is kept of each text."""

    def f(docs_table: pa.Table, gone_table: pa.Table) -> pa.Table:
        get = lambda c, t: np.concatenate([*(np.frombuffer(x, t) for x in gone_table.column(c).to_pylist()), np.zeros(0, t)])
        hi, lo = get("hi", np.uint64), get("lo", np.uint32)
        own = np.concatenate([*(_bits(x, len(h) // 8) for x, h in zip(gone_table.column("own").to_pylist(), gone_table.column("hi").to_pylist(), strict=True)), np.zeros(0, bool)])
        o = np.lexsort((lo, hi))
        hi, lo, own = hi[o], lo[o], own[o]
        docs, parts = _ids(docs_table.column("doc_id")), []
        least = np.full(len(hi), LAST)  # of a window that only this chunk has: its smallest document
        for i, j, buf, off in slices(docs_table.column("text")):
            w = Words(buf, off, SPACED)
            d = docs[i + w.text()]
            start, at = _gone(w, d, hi, lo, window)
            np.minimum.at(least, at, d[start])
            parts.append((i, j, w, start, at, d[start]))
        kept, total, removed = [], [], []
        for i, j, w, start, at, d in parts:
            out = covered(start[~own[at] | (d > least[at])], window, len(w.start))
            lost = np.add.reduceat(np.r_[out, False].astype(np.int64), w.first[:-1]) * (w.counts() > 0) if j > i else np.zeros(0, np.int64)
            total.append(w.counts())
            removed.append(lost)
            raw, clean = w.buf.tobytes(), bytearray(w.buf.tobytes())
            for t in np.flatnonzero(lost):  # blank the removed words, then join what is left
                a, b = w.first[t], w.first[t + 1]
                edge = np.flatnonzero(np.diff(np.r_[False, out[a:b], False].astype(np.int8)))
                for x, y in edge.reshape(-1, 2):
                    p, q = int(w.start[a + x]), int(w.end[a + y - 1])
                    clean[p:q] = b" " * (q - p)
            for t in range(j - i):
                p, q = int(w.start[w.first[t]]) if total[-1][t] else 0, int(w.end[w.first[t + 1] - 1]) if total[-1][t] else 0
                kept.append(b" ".join((clean if lost[t] else raw)[p:q].split()).decode("utf-8"))
        none = np.zeros(0, np.int64)
        new_cols = {"kept": pa.array(kept, pa.string()), "n_words": pa.array(np.concatenate([*total, none]), pa.int64()), "n_removed": pa.array(np.concatenate([*removed, none]), pa.int64())}
        carried = docs_table.column("carried")
        return pa.table({"doc_id": docs_table.column("doc_id"), "carried": carried.cast(_nullable(carried.type)), **new_cols})

    return f


class FingerprintIndex:
    """Sorted immutable runs of fingerprints of the documents seen so far: Parquet tables beside a manifest.

    Each batch adds a table of runs; `compact` merges all runs of a bucket into one, as a new table. Every change appends a line
    to the manifest, of which the last one holds, so another process that opens the folder finds the same index, and tables that a
    failed writer left behind are never read. Batches may have different numbers of chunks and buckets (both powers of two, by the
    bytes seen so far): leading bits deal both, so older runs are split as they are read.
    """

    def __init__(self, spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, window: int = WINDOW, gram: int = GRAM):
        self.spark, self.path, self.chunk_bytes, self.window, self.gram = spark, path, chunk_bytes, window, gram
        self.version, self.bytes, self.tables = 0, 0, []  # tables: (name, chunk bits, bucket bits)
        try:
            last = spark.read.schema("version long, state string").json(f"{path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        if last:
            state = json.loads(last["state"])
            if (state["window"], state["gram"]) != (window, gram):
                raise ValueError(f"the index has windows of {state['window']} words and grams of {state['gram']}")
            self.version, self.bytes, self.tables = last["version"], state["bytes"], [tuple(t) for t in state["tables"]]

    def _commit(self, tables, total: int) -> None:
        state = json.dumps({"window": self.window, "gram": self.gram, "bytes": total, "tables": tables})
        self.spark.createDataFrame([(self.version + 1, state)], "version long, state string").coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        self.version, self.bytes, self.tables = self.version + 1, total, tables

    def _write(self, df: DataFrame, n: int) -> str:
        name = f"run-{self.version + 1}-{uuid.uuid4().hex[:12]}"
        df.repartition(n, "bucket").sortWithinPartitions("bucket").write.parquet(f"{self.path}/{name}")
        return name

    def runs(self, tables, bucket_bits: int) -> DataFrame:
        """The runs of some tables, for 2**bucket_bits buckets."""
        out = None
        for name, _, bits in tables:
            here = self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}")
            here = here if bits == bucket_bits else here.mapInArrow(_resplit(bucket_bits), _RUN)
            out = here if out is None else out.unionByName(here)
        return out

    def append(self, docs: DataFrame) -> tuple[int, int]:
        """Add a batch's runs; the leading bits of its chunks and buckets."""
        size = text_bytes(docs)
        chunk_bits, bucket_bits = _sizes(self.bytes + size, self.chunk_bytes)
        chunk_bits, bucket_bits = max([chunk_bits, *(t[1] for t in self.tables)]), max([bucket_bits, *(t[2] for t in self.tables)])
        runs = _fingerprints(docs, chunk_bits, self.window, self.gram, bucket_bits)
        self._commit([*self.tables, (self._write(runs, max(partitions(self.spark), 1 << bucket_bits)), chunk_bits, bucket_bits)], self.bytes + size)
        return chunk_bits, bucket_bits

    def compact(self) -> None:
        """Merge all tables into one. A table with fewer chunks than the newest keeps its own run of each."""
        if len(self.tables) < 2:
            return
        bits = max(t[2] for t in self.tables)

        def merge(table: pa.Table) -> pa.Table:
            h, chunk, twice, _ = _flat(table)
            return pa.Table.from_batches([_run_table(*_distinct(h, chunk, twice), bits)])

        tables = []
        for chunk_bits in sorted({t[1] for t in self.tables}):
            own = [t for t in self.tables if t[1] == chunk_bits]
            tables.append((self._write(self.runs(own, bits).groupBy("bucket").applyInArrow(merge, _RUN), max(partitions(self.spark), 1 << bits)), chunk_bits, bits))
        self._commit(tables, self.bytes)


def _sizes(total: int, chunk_bytes: int) -> tuple[int, int]:
    """Leading bits of chunks and buckets for so many bytes of text."""
    return max(0, total // chunk_bytes).bit_length(), max(0, total // (4 * chunk_bytes)).bit_length()


def _as_old(shift: int, bits: int):
    """Runs of the index: their chunks get negative numbers, and marks of two documents are settled."""

    def f(batches):
        for batch in batches:
            h, chunk, twice, _ = _flat(batch)
            yield _run_table(h, -1 - chunk, twice & False, bits, shift)

    return f


def _fingerprints(docs: DataFrame, chunk_bits: int, window: int, gram: int, bucket_bits: int) -> DataFrame:
    return _chunked(docs.select("doc_id", "text"), chunk_bits).select("doc_id", "text", "chunk").mapInArrow(_runs_of(window, gram, bucket_bits), _RUN)


def _chunked(docs: DataFrame, bits: int, old: bool = False) -> DataFrame:
    """doc_id, text, carried, chunk; the chunks of earlier documents are numbered -1, -2 and so on."""
    others = [] if old else without([c for c in docs.columns if c not in ("doc_id", "text")], NEW)
    carried = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("int")
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))  # rows without id are spread by their texts
    chunk = F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("carried"), (-1 - chunk if old else chunk).alias("chunk"))


def remove_repeats(docs: DataFrame, index: FingerprintIndex | None = None, history: DataFrame | None = None, window: int = WINDOW, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns of docs but text, then kept (text of the words left, joined by one space), n_words, n_removed.

    With an index and the earlier documents it was built from (history), their windows count as well, by doc_id as ever; the batch's runs
    are added to the index first. To verify, the earlier documents are read and shuffled again.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    if index is None:
        chunk_bits, bucket_bits = _sizes(text_bytes(docs), chunk_bytes)
    else:
        earlier, window, gram = index.tables, index.window, index.gram
        chunk_bits, bucket_bits = index.append(docs)
    n = max(partitions(spark), (1 << chunk_bits) // 8)
    mine = _chunked(docs, chunk_bits).repartition(n, "chunk")  # one shuffle of the texts for all readers
    if index is None:
        runs = _fingerprints(docs, chunk_bits, window, gram, bucket_bits)
    else:
        runs = index.runs(index.tables[-1:], bucket_bits)
        for t in earlier:
            runs = runs.unionByName(index.runs([t], bucket_bits).mapInArrow(_as_old(chunk_bits - t[1], bucket_bits), _RUN))
    repeated = runs.groupBy("bucket").applyInArrow(_merge_runs, "chunk int, keys binary")
    met_schema = "bucket int, chunk int, hi binary, lo binary, twice binary, docs binary, counts binary"
    met = mine.groupBy("chunk").cogroup(repeated.where("chunk >= 0").groupBy("chunk")).applyInArrow(_windows_of(window, gram, bucket_bits), met_schema)
    if index is not None and earlier and history is not None:
        past = _chunked(history, chunk_bits, True).repartition(n, "chunk")
        met = met.unionByName(past.groupBy("chunk").cogroup(repeated.where("chunk < 0").groupBy("chunk")).applyInArrow(_windows_of(window, gram, bucket_bits), met_schema))
    gone = met.groupBy("bucket").applyInArrow(_merge_windows, "chunk int, hi binary, lo binary, own binary")
    carried = mine.schema["carried"].dataType
    out = mine.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(_remove(window), f"doc_id long, carried {carried.simpleString()}, kept string, n_words long, n_removed long")
    others = [F.col(f"carried.`{f}`").alias(f) for f in (carried.names if hasattr(carried, "names") else [])]
    return out.select("doc_id", *others, *NEW)


def remove_repeats_in_batches(docs: DataFrame, path: str, batches: int, chunk_bytes: int = CHUNK_BYTES, columns: tuple = ("*",)) -> DataFrame:
    """columns of remove_repeats(docs) by way of an index in `path`: ranges of doc_id, the smallest first, come in as batches.

    Each batch's columns are written before the next one begins, so a job that stops can go on from the index.
    """
    spark = docs.sparkSession
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    index, low, out = FingerprintIndex(spark, f"{path}/index", chunk_bytes), F.lit(True), None
    for k, end in enumerate([*cuts, None]):
        high = F.col("doc_id") <= int(end) if end is not None else F.lit(True)
        batch = docs.where(low & high if end is not None else low)
        remove_repeats(batch, index, docs.where(~F.coalesce(low, F.lit(True))) if k else None).select(*columns).write.parquet(f"{path}/kept-{k}")
        if k + 1 < batches and len(index.tables) > 1:
            index.compact()
        low = F.coalesce(F.col("doc_id") > int(end), F.lit(True)) if end is not None else low
        here = spark.read.parquet(f"{path}/kept-{k}")
        out = here if out is None else out.unionByName(here)
    return out
