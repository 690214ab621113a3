"""MinHash near-deduplication with HyperMinHash registers, banding, collision-corrected estimates and exact verification.

Rows: a text's set holds its distinct shingles of five words (A-Z lower-cased; fewer words make one shingle; no words or a null text
make an empty set, linked with nothing). Rows with equal sets form one class through an aggregate. Between classes, candidates share
a band of registers and have estimates near or above the threshold; candidates that hang together are compared on their full sets. Both
steps work in blocks and contract what hangs together, so that no bucket or group has to fit one task or grows with its square, and
return spanning forests of links, never all pairs. The estimate takes off the collisions expected of the two sets' sizes.

Repeated rows and repeated ids are one class; a row with a null doc_id takes part in no link and is kept; very long texts are read whole.
Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .components import components
from .kernel import Words, chain, mix

_U = np.uint64
#: HyperMinHash: 2**7 buckets, six bits of leading-zero count and ten of mantissa in each register.
BUCKET_BITS, MANTISSA_BITS = 7, 10
REGISTERS = 1 << BUCKET_BITS
EMPTY = 0xFFFF
#: 32 bands of four registers: a pair at 0.75 is missed with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
SHINGLE = 5
#: Texts compared at once in one task; larger groups are split into pairs of blocks.
BLOCK = 768
#: Registers compared at once in one task; fuller buckets are split into pairs of blocks.
BUCKET = 2048
#: Groups of up to so many blocks are searched in pairs of blocks; larger ones are contracted block by block.
FEW = 16


def shingles(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    g, _ = words.grams(size)
    first, out = words.first, []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            out.append(chain(words.hash[a:b], b - a, SHINGLE - (b - a) + 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: per bucket of the leading bits, the minimum's leading-zero count and next mantissa bits."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(s):
        low_bits = 64 - BUCKET_BITS
        b = (s >> _U(low_bits)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])  # the set is sorted, so the first of a bucket is its minimum
        rest = (s[at] << _U(BUCKET_BITS)) | _U(1 << (BUCKET_BITS - 1))
        zeros = (64 - np.frexp(rest.astype(np.float64))[1]).clip(0, 62).astype(np.uint64)
        mantissa = (rest << (zeros + _U(1))) >> _U(64 - MANTISSA_BITS)
        out[b[at]] = ((zeros << _U(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    return out


def band_keys(r: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band with a filled register; the band's number is part of the key."""
    x = r.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + x[:, j])
    return key[(r.reshape(BANDS, ROWS) != EMPTY).any(1)].view(np.int64)


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that different minima of sets of n and m elements fill alike.

    The minima of a bucket are about exponential with rates n and m; a register is a cell of width 2**-mantissa of its value's power
    of two, on the average 0.72 of the value itself, so the share is the integral of both densities times that width.
    """
    n, m = n.astype(np.float32), m.astype(np.float32)
    return np.float32(0.72 * 2.0**-MANTISSA_BITS) * n * m / np.maximum(n + m, 1) ** 2


def likely(rows: np.ndarray, all_: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Pairs whose estimated Jaccard similarity doesn't rule out the threshold.

    The share of equal registers among those filled in either, less the collisions expected of sets of these sizes, estimates the
    similarity; five standard deviations below the threshold still pass.
    """
    equal = np.zeros((len(rows), len(all_)), np.int16)
    fr, fa = rows != EMPTY, all_ != EMPTY
    for k in range(rows.shape[1]):
        equal += (rows[:, k, None] == all_[None, :, k]) & fr[:, k, None]
    both = fr.astype(np.float32) @ fa.astype(np.float32).T
    return _passes(equal, fr.sum(1, dtype=np.float32)[:, None] + fa.sum(1, dtype=np.float32)[None, :] - both, collisions(sizes[0][:, None], sizes[1][None, :]), threshold)


def _passes(equal: np.ndarray, filled: np.ndarray, chance: np.ndarray, threshold: float) -> np.ndarray:
    f = np.maximum(filled, 1).astype(np.float32)
    estimate = (equal / f - chance) / (1 - chance)
    return estimate >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / f) - 1 / f


class Union:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, pairs) -> list[tuple[int, int]]:
        """Those of the pairs that join two sets."""
        out = []
        for u, v in pairs:
            a, b = self.root(u), self.root(v)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                out.append((u, v))
        return out


def bucket_forest(reg: np.ndarray, size: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Spanning forest of a bucket's pairs that the estimate lets pass, across the two sides if there are two."""
    union, out, n = Union(len(reg)), [], len(reg)
    one = side.min() == side.max()
    for a in range(0, n, 256):
        may = likely(reg[a : a + 256], reg, (size[a : a + 256], size), threshold) & (np.arange(a, min(a + 256, n))[:, None] < np.arange(n)[None, :])
        if not one:
            may &= side[a : a + 256, None] != side[None, :]
        out += union.join((a + int(i), int(j)) for i, j in np.argwhere(may))
    return out


def forest(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links (100 * intersection >= percent * union) among texts, across the two sides if there are two."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    reg = np.stack([registers(s) for s in sets])
    one = len(np.unique(side)) < 2
    groups = Union(n)
    out: list[tuple[int, int]] = []
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    # shingles of a single text can't be in an intersection
    ids, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    column = (np.cumsum(count > 1) - 1)[inverse]
    width = int((count > 1).sum())
    by_text = np.split(column[shared], np.searchsorted(owner[shared], np.arange(1, n)))
    step = 128
    columns = 1 << 14

    for a in range(0, n, step):
        rows = np.arange(a, min(a + step, n))
        may = likely(reg[rows], reg, (size[rows], size), percent / 100)
        may &= (np.minimum(size[rows, None], size[None, :]) * 100 >= percent * np.maximum(size[rows, None], size[None, :])) & (rows[:, None] < np.arange(n)[None, :])
        if not one:
            may &= side[rows, None] != side[None, :]
        others = np.flatnonzero(may.any(0))
        if not len(others):
            continue
        both = np.zeros((len(rows), len(others)), np.float32)
        for lo in range(0, width, columns):  # exact intersections: products of 0/1 rows over the shared shingles
            x, y = np.zeros((len(rows), min(columns, width - lo)), np.float32), np.zeros((len(others), min(columns, width - lo)), np.float32)
            for m, who in ((x, rows), (y, others)):
                for i, t in enumerate(who):
                    c = by_text[t]
                    m[i, c[(c >= lo) & (c < lo + columns)] - lo] = 1
            both += x @ y.T
        union = size[rows, None] + size[None, others] - both
        linked = np.argwhere(may[:, others] & (100 * both >= percent * union))
        out += groups.join((int(rows[i]), int(others[j])) for i, j in linked)
    return out


def _describe(batches):
    """doc_id, number of shingles, 128-bit key of the set, registers."""
    for b in batches:
        text = b.column(1)
        for i, j, buf, off in slices(text):
            sets = shingles(Words(buf, off, lower=True))
            k1, k2, keys = [], [], []
            for s in sets:
                k1.append(int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                k2.append(int(mix(s + _U(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                keys.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "registers"],
            )


def _bands(batches):
    for b in batches:
        keys = [band_keys(np.frombuffer(x, np.uint16)) for x in b.column(1).to_pylist()]
        ids = np.repeat(np.asarray(b.column(0)), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(ids)], names=["band", "rep"])


def _parts(table: pa.Table):
    """The table sorted by (group, i, j, rep), its columns, and the spans of equal (group, i, j)."""
    d = table.sort_by([("group", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")])
    cols = {c: d.column(c).to_numpy() for c in ("group", "i", "j", "side", "rep")}
    cuts = np.flatnonzero(np.r_[True, np.any([cols[c][1:] != cols[c][:-1] for c in ("group", "i", "j")], axis=0)]) if d.num_rows else np.zeros(0, np.int64)
    return d, cols, np.r_[cuts, d.num_rows]


def _edges(a, b) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _estimator(percent: int):
    """Buckets of bands -> pairs that the estimate lets pass, a spanning forest for each bucket."""

    def estimate(table: pa.Table) -> pa.Table:
        d, cols, cuts = _parts(table)
        reg = np.frombuffer(b"".join(d.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        size, rep, n_shingles = np.diff(cuts), cols["rep"], d.column("n_shingles").to_numpy()
        a, b = [], []
        two = cuts[:-1][size == 2]  # most buckets: all at once
        for k in range(0, len(two), 4096):
            x, y = reg[two[k : k + 4096]], reg[two[k : k + 4096] + 1]
            chance = collisions(n_shingles[two[k : k + 4096]], n_shingles[two[k : k + 4096] + 1])
            ok = _passes(((x == y) & (x != EMPTY)).sum(1), ((x != EMPTY) | (y != EMPTY)).sum(1), chance, percent / 100)
            a.append(rep[two[k : k + 4096][ok]])
            b.append(rep[two[k : k + 4096][ok] + 1])
        for lo, n in zip(cuts[:-1], size, strict=True):
            if n > 2:
                pairs = np.array(bucket_forest(reg[lo : lo + n], n_shingles[lo : lo + n], cols["side"][lo : lo + n], percent / 100), np.int64).reshape(-1, 2)
                a.append(rep[lo + pairs[:, 0]])
                b.append(rep[lo + pairs[:, 1]])
        none = np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate([*a, none]), np.concatenate([*b, none])]), axis=1)
        return _edges(pairs[0], pairs[1])

    return estimate


def _linker(percent: int):
    """Groups of texts -> their links, a spanning forest for each group or pair of blocks."""

    def link(table: pa.Table) -> pa.Table:
        d, cols, cuts = _parts(table)
        sets = [s for _, _, buf, off in slices(d.column("text")) for s in shingles(Words(buf, off, lower=True))]
        a, b = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for u, v in forest(sets[lo:hi], cols["side"][lo:hi], percent):
                a.append(cols["rep"][lo + u])
                b.append(cols["rep"][lo + v])
        return _edges(a, b)

    return link


_TASK = ("task", "group", "i", "j", "side", "rep")


def _within(members: DataFrame, total: int, block: int, few: int) -> DataFrame:
    """_TASK of members(group, rep, n): groups of up to block members whole, several a task; up to few blocks in pairs of blocks; larger ones in blocks, each for itself."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    split = members.withColumn("mine", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    split = split.withColumn("other", F.explode(F.when(blocks <= few, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("mine"))))
    split = split.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    task = F.when(F.col("n") <= block, F.pmod(F.xxhash64("group"), F.lit(max(1, total // block)))).otherwise(F.xxhash64("group", "i", "j"))
    return split.select(task.alias("task"), "group", "i", "j", F.when(blocks <= few, F.col("mine")).otherwise(0).alias("side"), "rep")


def _across(members: DataFrame, block: int) -> DataFrame:
    """_TASK of members(group, rep, component): pairs of blocks that hold different components of a group.

    A component of more than block members has blocks of its own, which are not compared with one another; the small ones share theirs.
    """
    sizes = members.groupBy("group", "component").agg(F.count("*").alias("s"))
    kind = F.when(F.col("s") > block, F.col("component").cast("string")).otherwise("small")
    kinds = cut(sizes.groupBy("group", kind.alias("kind")).agg(F.ceil(F.sum("s") / block).cast("int").alias("blocks")))
    own = F.when(F.col("s") > block, F.xxhash64("rep")).otherwise(F.xxhash64("component"))
    placed = members.join(sizes, ["group", "component"]).select("group", "rep", kind.alias("kind"), own.alias("h"))
    placed = cut(placed.join(kinds, ["group", "kind"]).select("group", "rep", "kind", F.pmod("h", "blocks").cast("int").alias("at")))
    x, y = (kinds.select("group", F.col("kind").alias(f"k{n}"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(f"a{n}")) for n in "xy")
    tasks = x.join(y, "group").where("kx < ky or (kx = 'small' and ky = 'small' and ax <= ay)")
    tasks = tasks.withColumn("i", F.xxhash64("kx", "ax")).withColumn("j", F.xxhash64("ky", "ay")).withColumn("task", F.xxhash64("group", "i", "j"))
    left = placed.join(tasks.withColumnsRenamed({"kx": "kind", "ax": "at"}), ["group", "kind", "at"]).select(*(F.lit(0).alias(c) if c == "side" else F.col(c) for c in _TASK))
    right = placed.join(tasks.where("kx <> ky or ax <> ay").withColumnsRenamed({"ky": "kind", "ay": "at"}), ["group", "kind", "at"]).select(*(F.lit(1).alias(c) if c == "side" else F.col(c) for c in _TASK))
    return left.unionByName(right)


def _searched(members: DataFrame, data: DataFrame, kernel, block: int, few: int) -> DataFrame:
    """Edges (a, b) that hold together what the kernel links in each group of members(group, rep); data has the kernel's input by rep.

    Groups of up to block members are searched whole, those of up to few blocks in pairs of blocks. A larger one is searched in blocks,
    what hangs together in a block is contracted to one member, these are dealt anew, and so on; at last members of still different
    components are compared, whichever block they are in. So a large group of near copies costs in proportion to its members, and no
    link is lost.
    """
    sizes = cut(members.groupBy("group").agg(F.count("*").alias("n")))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    run = lambda tasks: tasks.join(data, "rep").groupBy("task").applyInArrow(kernel, "a long, b long")
    small = run(_within(members.join(sizes.where(F.col("n") <= few * block), "group"), total, block, few))
    if most <= few * block:
        return small
    small, large = cut(small), cut(members.join(sizes.where(F.col("n") > few * block), "group"))
    edges, left, before = cut(run(_within(large, total, block, few))), None, None
    while True:
        named = large.join(components(edges).withColumnRenamed("id", "rep"), "rep", "left").select("group", "rep", F.coalesce("component", "rep").alias("component"))
        counts = named.groupBy("group").agg(F.countDistinct("component").alias("n")).where("n > 1")
        left = cut(named.join(counts, "group"))
        firsts = left.groupBy("group", "component", "n").agg(F.min("rep").alias("rep"))
        now = firsts.count()
        if not now or (before is not None and 2 * now > before):
            break
        before = now
        edges = cut(edges.unionByName(run(_within(firsts.select("group", "rep", "n"), now, block, few))))
    edges = small.unionByName(edges)
    return edges.unionByName(cut(run(_across(left.drop("n"), block)))) if now else edges


def near_duplicates(docs: DataFrame, percent: int = 75, block: int = BLOCK, bucket: int = BUCKET, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least percent % Jaccard similarity), kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    desc = cut(texts.mapInArrow(_describe, "doc_id long, n_shingles long, k1 long, k2 long, registers binary"))
    sets = desc.where("n_shingles > 0 and doc_id is not null")
    # equal sets: one class, its smallest doc_id stands for it
    classes = cut(sets.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep")))
    firsts = desc.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "registers")
    # buckets: classes that share a band
    bands = firsts.select("rep", "registers").mapInArrow(_bands, "band long, rep long")
    full = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(bands.join(full, "band").select(F.col("band").alias("group"), "rep"))
    near = _searched(met, firsts, _estimator(percent), bucket, few)
    # groups of candidates, and the links in them
    groups = components(near).select(F.col("component").alias("group"), F.col("id").alias("rep"))
    found = _searched(groups, texts.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text"), _linker(percent), block, few)
    linked = components(found)
    named = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("n_shingles", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = desc.select("doc_id", "n_shingles", "k1", "k2").join(named, ["n_shingles", "k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
