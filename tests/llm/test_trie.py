"""The prefix trie against a plain one, running values over many ranges, and edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import trie as T
from quarry.llm.scan import running


@pytest.fixture
def ranges(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_running_values_over_ranges(spark, ranges):
    """One group over all ranges, many small ones between; a value that isn't a sum (a running text)."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", "hot"]), i, rng.randrange(9)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, i int, x int").repartition(5)
    out = running(df, ["g"], [F.col("i").desc()], "", lambda v, r: v + str(r[2]), lambda a, b: a + b, lambda before, after, r: (r[0], r[1], before, after) if r[1] % 7 else None, "g string, i int, before string, after string")
    want, texts = set(), defaultdict(str)
    for g, i, x in sorted(rows, key=lambda r: -r[1]):
        if i % 7:
            want.add((g, i, texts[g], texts[g] + str(x)))
        texts[g] += str(x)
    assert {tuple(r) for r in out.collect()} == want


def plain(rows, every=5, longest=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % longest
        base = c - int(abs(c) % every * (1 if c >= 0 else -1))
        seqs[c] = tuple(own.get(base, [])[:h] + w[h:])
    members = defaultdict(set)
    for c, w in seqs.items():
        for d in range(len(w) + 1):
            members[w[:d]].add(c)
    out = {}
    for n, cs in members.items():
        below = [m for m in members if m[: len(n)] == n]
        childless = lambda m: not any(len(x) == len(m) + 1 and x[:-1] == m for x in members)
        ends = ",".join(str(c) for c in sorted(cs) if seqs[c] == n)
        out[n] = (
            min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), sum(len(x) == len(n) + 1 and x[:-1] == n for x in members), sum(map(childless, below)),
            sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def result(spark, rows):
    turns = T.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size string, node int").repartition(3))
    nodes, ends = T.prefix_trie(T.rebuilt(turns), turns)
    none = hashlib.sha256(b"").hexdigest()
    return nodes, sorted((tuple(r) for r in nodes.join(T.ends_digest(ends), "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none))).collect()), key=str)


def dialogue(seed):
    """Shared openings, exact copies, nulls, ties, negative and missing first conversations, conversations that end up without turns."""
    rng, rows = random.Random(seed), []
    for c in [*range(-7, 40), 1000, 10**12 + 3]:
        if c % 5 == 0 and rng.random() < 0.3:
            continue
        for t in range(rng.choice([1, 1, 2, 4, 11, 25])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", None, "bot"]), rng.choice(["a", "é", "", None, "long text"]), "x", 1))
    return rows + rows[:4] + [(None, 1, "user", "nobody", "x", 1)]


def test_trie_against_a_plain_one(spark, ranges, monkeypatch):
    monkeypatch.setattr(T, "BLOB", 9)
    for seed in (1, 2):
        rows = dialogue(seed)
        want = plain([r[:4] for r in rows])
        assert any(not d for d in want) and any(v[7] != hashlib.sha256(b"").hexdigest() and not v[1] for v in want.values())
        assert result(spark, rows)[1] == sorted(want.values(), key=str)


def test_large_copies_and_one_long_conversation(spark, ranges, monkeypatch):
    """Many members end at one node; a conversation longer than all others is one path over several ranges."""
    monkeypatch.setattr(T, "BLOB", 30)
    rows = [(5 * c, t, "user", f"t{t}", "x", 1) for c in range(60) for t in range(3)] + [(1000, t, "bot", str(t), "x", 1) for t in range(150)]
    nodes, got = result(spark, rows)
    assert got == sorted(plain([r[:4] for r in rows]).values(), key=str)
    texts = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in T.last_turns(nodes, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x string, y int")).collect()}
    assert len(texts) == len(got) and texts[(0, 0)] == (None, None) and texts[(0, 2)] == ("user", "t1") and texts[(1000, 77)] == ("bot", "76")


def test_no_conversations(spark):
    assert result(spark, [])[1] == [] and result(spark, [(None, 1, "a", "b", "x", 1)])[1] == []
