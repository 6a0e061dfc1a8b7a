from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from triagemill.llm import simhash
from triagemill.llm.queries import QUERIES
from triagemill.llm.simhash import fingerprints, plant, search, simhash_groups

SF = "/root/testdata/sf0.01"


def one_print(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [one_print(t) for _, t in rows]
    names = sorted(set(prints))
    values = np.array(names, np.uint64)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 2).tolist():
            x, y = sorted((find(a), find(b)))
            root[y] = x
    at = {p: i for i, p in enumerate(names)}
    low = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            low[find(at[p])] = min(low.get(find(at[p]), i), i)
    return sorted((str(i), f"{p:016x}", str(low.get(find(at[p])))) for (i, _), p in zip(rows, prints))


def got(df):
    return sorted((str(r[0]), r[1], str(r[2])) for r in df.collect())


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op13_simhash_dedup"](spark, SF)) == brute(rows)


def test_long_texts_in_segments(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"W{x}é" for x in rng.integers(0, 50, n)) + "\n" for n in (0, 1, 2, 3, 4, 700)]
    want = [one_print(t) for t in texts]
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "_SEGMENT", size)
        monkeypatch.setattr(simhash, "_HASHES", max(3, size // 5))
        assert fingerprints(texts).tolist() == want


@pytest.mark.parametrize("reach", [0, 1, 2, 5])
def test_tree_loses_no_pair(reach):
    rng = np.random.default_rng(reach)
    prints = rng.integers(0, 2**64, 3000, np.uint64)
    near = prints[rng.integers(0, 300, 2000)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    prints = np.unique(np.concatenate([prints, near]))
    tree = plant(prints[::4], len(prints), 64, reach)
    row, shard, home = tree.shards(prints, reach)
    assert np.bincount(row[home]).tolist() == [1] * len(prints)
    pairs = set()
    for s in np.unique(shard):
        own = prints[row[(shard == s) & home]]
        for a, b in search(own, prints[row[shard == s]], reach):
            pairs |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = set()
    for a in range(len(prints)):
        for b in np.flatnonzero(np.bitwise_count(prints[a + 1 :] ^ prints[a]) <= reach):
            want.add((int(prints[a]), int(prints[a + 1 + b])))
    assert pairs == want
    assert reach < 2 or len(want) > 100


@pytest.mark.parametrize("part_rows", [1 << 16, 30])
def test_hot_groups(spark, monkeypatch, part_rows):
    """Copies in a third of all rows, near copies in another, and parts of a large shard."""
    monkeypatch.setattr(simhash, "PART_ROWS", part_rows)
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 900)]
    rows = []
    for i in range(200):
        own = list(base)
        for j in rng.integers(0, 900, i % 9):
            own[j] = f"z{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base)) for i in range(200)]
    rows += [(2000 + i, " ".join(f"q{x}" for x in rng.integers(0, 10**6, 20))) for i in range(200)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, print string, n int")
    assert got(simhash_groups(df, shard_rows=64)) == brute(rows)


def test_edges(spark, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert got(simhash_groups(edge_docs)) == brute(rows)
    assert simhash_groups(edge_docs.limit(0)).count() == 0
    more = [(None, "alone with no key"), (None, "same text here"), (5, "same text HERE"), (5, "x"), (6, "퟿ É é")]
    df = spark.createDataFrame([(i, t, i) for i, t in more], "doc_id long, text string, component_id long")
    assert got(simhash_groups(df)) == brute(more)
