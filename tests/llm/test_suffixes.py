from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from triagemill.llm.suffixes import _alike, _bucket, _coded, _pieces, first_owners, remove_repeats, suffix_array, window_runs
from triagemill.llm.queries import QUERIES
from tests.llm.conftest import SF


def brute(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) with a table of all windows."""
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if i is not None and (w not in first or i < first[w]):
                first[w] = i
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p, x in enumerate(gone) if x and not (p and gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abc", max_size=60).map(str.encode))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_arrays_of_long_runs():
    rng = random.Random(5)
    for text in [b"y" * 500, b"ab" * 300, bytes(rng.randrange(256) for _ in range(2000)), b"abcd" * 50 + b"abce" * 50]:
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_first_owners():
    rng = random.Random(1)
    pieces = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(6, 14))) for _ in range(40)})
    owners = np.array(rng.sample(range(100), len(pieces)))
    found = first_owners(pieces, owners, 6)
    for p, own in zip(pieces, found):
        want = [min(o for q, o in zip(pieces, owners) if p[i : i + 6] in q) for i in range(len(p) - 5)]
        assert own.tolist() == want


def test_runs_cover_every_window():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 10, 49, 50, 51, 300, 4000)] + [b"y" * 700]
    text, start, windows, name = window_runs(texts)
    seen, names = set(), {}
    for t, s, w, h in zip(text.tolist(), start.tolist(), windows.tolist(), name.tolist()):
        for p in range(s, s + w):
            assert (t, p) not in seen
            seen.add((t, p))
            assert names.setdefault(texts[t][p : p + 50], h) == h
    assert seen == {(i, p) for i, b in enumerate(texts) for p in range(len(b) - 49)}


def test_pieces_with_a_common_window_are_grouped():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(60, 200))) for _ in range(30)]
    texts += [texts[i % 30][: rng.randrange(60)] + texts[(i + 7) % 30] + texts[i % 30][5:80] for i in range(60)]
    text, start, windows, name = window_runs(texts)
    pieces, holders = {}, {}
    for t, s, w, h in zip(text.tolist(), start.tolist(), windows.tolist(), name.tolist()):
        pieces.setdefault((h, texts[t][s : s + w + 49]), len(pieces))
    group = _alike(np.array([h for h, _ in pieces], np.uint64), [p for _, p in pieces])
    for (_, p), i in pieces.items():
        for x in range(len(p) - 49):
            holders.setdefault(p[x : x + 50], set()).add(int(group[i]))
    assert all(len(g) == 1 for g in holders.values()) and len(set(group.tolist())) > 30


def test_whole_table(spark, documents):
    assert got(QUERIES["op2_suffix_array_dedup"](spark, SF)) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_edges(spark, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert got(remove_repeats(edge_docs)) == brute(rows)
    assert remove_repeats(edge_docs.limit(0)).count() == 0


def test_planted(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(12)
    rows = [(i, f"{text(20)} {passage} {text(30)}\n{line}") for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(3, rows[0][1]), (3, passage)]
    rows += [(200, passage[:49]), (201, passage[1:51]), (202, "é" * 400), (203, "é" * 30), (204, "yé" * 3000), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(df.repartition(5))) == brute(rows)


def _shared_passage(n):
    rng = random.Random(8)
    letters = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = letters(60)
    return [(i, f"{letters(40)}{passage}{letters(rng.randrange(40, 60))}") for i in range(n)]


def test_pieces_of_a_hot_name_are_dealt_out():
    """No bucket holds more than a few windows of a passage that each text ends differently."""
    texts = [t.encode() for _, t in _shared_passage(300)]
    _, _, _, names = window_runs(texts)
    name, n = Counter(names.tolist()).most_common(1)[0]
    packed = _coded(np.array([name], np.uint64), _bucket(np.array([name], np.uint64), 48)).tobytes()
    largest = {}
    for hot in ([], [packed]):
        columns = [pa.array(texts, pa.binary()), pa.array(range(300)), pa.array(range(300)), pa.array([[packed]] * 300), pa.array([hot] * 300, pa.list_(pa.binary()))]
        batch = pa.RecordBatch.from_arrays(columns, names=["text", "key", "digest", "names", "hot"])
        sizes = {r["bucket"]: len(r["pieces"]) for b in _pieces(48, 50)([batch]) for r in b.to_pylist()}
        largest[bool(hot)] = max(sizes.values()) / sum(sizes.values())
    assert n == 300 and largest[False] == 1 and largest[True] < 0.1


def test_hot_names(spark):
    rows = _shared_passage(120) + [(500 + i, "y" * (60 + i)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(df.repartition(3), hot_texts=20)) == brute(rows)


def test_short_lengths_share_a_lane():
    """Windows of 32 bytes with 7 bytes beyond the name on each side are still linked."""
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(200)) for _ in range(20)]
    texts += [texts[i][:50] + texts[i + 1][60 : 60 + 32 + i % 8] + texts[i + 2][50:90] for i in range(18)]
    for length in (32, 40, 48):
        text, start, windows, name = window_runs(texts, length)
        pieces, holders = {}, {}
        for t, s, w, h in zip(text.tolist(), start.tolist(), windows.tolist(), name.tolist()):
            pieces.setdefault((h, texts[t][s : s + w + length - 1]), len(pieces))
        group = _alike(np.array([h for h, _ in pieces], np.uint64), [p for _, p in pieces], length)
        for (_, p), i in pieces.items():
            for x in range(len(p) - length + 1):
                holders.setdefault(p[x : x + length], set()).add(int(group[i]))
        assert all(len(g) == 1 for g in holders.values())


def test_length_32(spark):
    rng = random.Random(10)
    letters = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    shared = [letters(32 + i % 8) for i in range(20)]
    rows = [(i, letters(30) + shared[i % 20] + letters(30)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(df, length=32)) == brute(rows, 32)
