from __future__ import annotations

import re

import numpy as np
import pytest

from triagemill.llm import graph, jaccard
from triagemill.llm.jaccard import jaccard_join, keep_first, least_matches, shingle_sets


def runs(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    """(doc_id, class_id, n_links, n_copies) by comparing all pairs."""
    texts, ids = {}, {}
    for i, t in rows:
        ids.setdefault(t or "", set()).add(i)
    names = sorted(ids, key=lambda t: min(ids[t]))
    sets = [runs(t) for t in names]
    at = {}
    for n, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(n)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(names)
    for a, s in enumerate(sets):
        common = {}
        for x in s:
            for b in at[x]:
                if b > a:
                    common[b] = common.get(b, 0) + 1
        for b, n in common.items():
            if n / (len(s) + len(sets[b]) - n) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    low = {}
    for n, t in enumerate(names):
        low[find(n)] = min(low.get(find(n), 10**9), min(ids[t]))
    return sorted(
        (i, low[find(n)], links[n], len(ids[t])) for n, t in enumerate(names) for i in ids[t]
    )


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_sets_are_those_of_words():
    texts = ["a b c d e f", "a b c d e f a b c d e f", "x", " x\n", "", "é ü\tñ", "a b c d", "a  b c d e"]
    flat, sizes = shingle_sets(texts)
    assert sizes.tolist() == [len(runs(t)) for t in texts]
    sets = [set(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert sets[2] == sets[3] and sets[0] < sets[1] and not sets[5] & sets[6]


def test_posterior():
    assert least_matches(32, 0.8, 1e-6) < least_matches(128, 0.8, 1e-6) < 0.8 * 128
    assert least_matches(128, 0.8, 1e-2) > least_matches(128, 0.8, 1e-6)


def test_whole_table(spark, documents):
    assert got(jaccard_join(documents)) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


@pytest.mark.parametrize("block", [8, 512])
def test_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SETS", block)
    monkeypatch.setattr(graph, "HOT_ROWS", block)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 80)]
    rows = []
    for i in range(60):
        own = list(base)
        for j in rng.integers(0, 80, i % 5):
            own[j] = f"z{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(200 + i, "") for i in range(5)] + [(300, None), (301, "one two"), (302, "one two "), (303, "one  two")]
    rows += [(400, " ".join(f"q{x}" for x in range(20_000))), (401, " ".join(f"q{x}" for x in range(20_500)))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, root string")
    assert got(jaccard_join(df)) == brute(rows)


def test_edges(spark, edge_docs):
    want = brute(sorted({(r["doc_id"], r["text"]) for r in edge_docs.collect()}, key=str))
    assert got(jaccard_join(edge_docs)) == want
    assert jaccard_join(edge_docs.limit(0)).count() == 0
    kept = keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    # the row that is repeated whole stays once
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c, *_ in want if i == c)


def test_repeated_keys(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (3, "a"), (3, "a text of its own")]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, _later long, digest string")
    assert got(jaccard_join(df)) == [(1, 1, 0, 2), (2, 2, 0, 1), (3, 1, 0, 2), (3, 3, 0, 1)]
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert got(kept.select("doc_id", "text")) == [(1, "a"), (2, "b"), (3, "a text of its own")]
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(5, near), (5, near + " x"), (7, near + " y"), (None, "no key"), (None, "no key")]
    kept = [tuple(r) for r in keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 3 and kept.count((None, "no key")) == 2 and {i for i, _ in kept} == {5, None}
