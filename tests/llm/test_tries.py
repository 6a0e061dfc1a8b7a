from __future__ import annotations

import hashlib
import zlib

import pytest

from triagemill.llm.tries import conversation_paths, forked_paths, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int"


def brute(rows, forked=True):
    """All nodes by walking every prefix of every conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if forked else 0
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members, children = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                children.setdefault(turns[: d - 1], set()).add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in below) or 1
        bytes_ = len(node[-1][1].encode()) if node else 0
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * bytes_
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else -1, len(m),
            len(children.get(node, ())), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(node)))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def got(df):
    return sorted(
        (r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect()
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)


def test_whole_table(spark):
    from triagemill.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_prefix_trie"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("turns", [1 << 16, 2000])
def test_hot_groups(spark, turns):
    """A third of all conversations are equal, another third starts alike, one is very long."""
    rows = []
    for c in range(400):
        if c % 3 == 0:
            rows += [(c, t, "user", f"same {t}") for t in range(4)]
        elif c % 3 == 1:
            rows += [(c, t, "user", "hello" if t == 0 else f"{c % 7} {t * c % 5}") for t in range(c % 6)]
        else:
            rows += [(c, t, "ab"[t % 2], f"{c * t % 11}") for t in range(1 + c % 9)]
    rows += [(5000, t, "user", f"long {t % 3}") for t in range(700)]
    rows += [(5005 + k, t, "user", f"long {t % 3}") for k in range(3) for t in range(600 + k)]
    for forked in (True, False):
        paths = conversation_paths(frame(spark, rows).repartition(5))
        paths = forked_paths(paths) if forked else paths
        assert got(prefix_trie(paths, turns)) == brute(rows, forked)


def test_edges(spark):
    rows = [
        (None, 0, "user", "no id"), (1, None, None, None), (1, 0, "user", "x"), (2, 0, "user", None),
        (2, 0, "user", None), (3, 5, "a", "bc"), (3, 5, "a", "bc"), (8, 1, "ab", "c"), (9, 1, "a", "bc"),
        (12, 2, "é", "日本語"), (12, 1, None, "y" * 50_000), (10, 0, "user", "base"), (-7, 0, "user", "x"),
    ]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    df = frame(spark, rows)
    assert got(prefix_trie(forked_paths(conversation_paths(df)))) == brute(rows)
    assert got(prefix_trie(conversation_paths(df))) == brute(rows, forked=False)
    assert prefix_trie(conversation_paths(df.limit(0))).count() == 0
    assert prefix_trie(conversation_paths(df.filter("conv_id is null"))).count() == 0
