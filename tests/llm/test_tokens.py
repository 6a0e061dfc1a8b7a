from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from triagemill.llm.huffman import (
    MAX_BITS, canonical_codes, code_lengths, decode_frame, decode_table, encode_frame, read_ids,
    write_ids,
)
from triagemill.llm.packing import pack
from triagemill.llm.queries import QUERIES
from triagemill.llm.token_counts import token_counts
from triagemill.llm.tokens import count_spliced, encoder
from tests.llm.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def lib_ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=" \n\tab'sé1.<|endoftxt> \u0085\x1c\xa0ǅ²-–’日🙂", max_size=60))
def test_ids_are_those_of_the_library(text):
    assert encoder(PATH).ids(text) == lib_ids(text)


def test_every_latin_character():
    enc = encoder(PATH)
    for code in [*range(0x24F + 1), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        for text in (f"a{chr(code)}b", f" {chr(code)} 1{chr(code)}{chr(code)} ", f"{chr(code)}'s\n"):
            assert enc.ids(text) == lib_ids(text), hex(code)


def test_special_strings():
    for text in ["a <|endoftext|> b<|endoftext|>c", "x\n<|endoftext|>", "it's\nwe'll go\n", "<|endo ftext|>"]:
        assert encoder(PATH).ids(text) == lib_ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n ab'sé1. 日🙂", max_size=200), st.integers(8, 30), st.integers(3, 7))
def test_spliced_counts(text, chunk, overlap):
    assert count_spliced(LIB, text, chunk, overlap)[0] == len(lib_ids(text))


def test_splice_widens_without_boundary():
    text = "ab" * 400 + " tail word " + "cd" * 300 + " <|endoftext|> end"
    n, _, widened = count_spliced(LIB, text, 64, 8)
    assert n == len(lib_ids(text)) and widened > 0


def test_counts_of_edge_rows(edge_docs):
    got = token_counts(edge_docs, PATH, limit=512, chunk=1000, overlap=16).collect()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    assert len(got) == edge_docs.count()
    for r in got:
        n = len(lib_ids(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"]) == (n, len((texts[r["doc_id"]] or "").encode()))
        assert r["over_limit"] == (n > 512)


@pytest.mark.parametrize("name", ["op7_token_counts", "op8_packing", "op10_huffman_ids"])
def test_whole_tables(spark, documents, name):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = QUERIES[name](spark, SF).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    if name.startswith("op7"):
        assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted(
            (k, len(lib_ids(t))) for k, t in rows.items()
        )
    elif name.startswith("op10"):
        at, want = 0, []
        for k in sorted(rows):
            ids = lib_ids(rows[k]) + [2]
            want.append((k, at, len(ids), crc(ids)))
            at += len(ids)
        assert sorted((r[0], r[1], r[2], r[3]) for r in got) == want
    else:
        check_packed(got, {k: lib_ids(t) + [1] for k, t in rows.items()}, 2048)


def check_packed(got, ids, window):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[k])
    assert set(by_doc) == set(ids)
    last = max(by_sequence)
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or s == last


def test_packs_edge_rows(spark, edge_docs):
    got = pack(edge_docs.filter("doc_id <> 7"), PATH, 1, window=32).collect()
    ids = {r["doc_id"]: lib_ids(r["text"]) + [1] for r in edge_docs.collect() if r["doc_id"] != 7}
    check_packed(got, ids, 32)
    assert all(r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in got)
    assert pack(edge_docs.limit(0), PATH, 1).count() == 0
    doubled = pack(edge_docs.filter("doc_id = 7"), PATH, 1, window=32)
    assert doubled.count() == 2


def test_huffman_edge_rows(spark, edge_docs, tmp_path):
    path = write_ids(edge_docs, PATH, end_id=2, path=f"{tmp_path}/ids")
    # a session that knows nothing but the folder
    got = read_ids(spark.newSession(), path).collect()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    assert len(got) == edge_docs.count()
    assert all(r["ids"] == lib_ids(texts[r["doc_id"]]) + [2] for r in got)
    path = write_ids(edge_docs.limit(0), PATH, end_id=2)
    assert read_ids(spark, path).count() == 0
    nulls = edge_docs.selectExpr("cast(null as long) as doc_id", "text")
    assert read_ids(spark, write_ids(nulls, PATH, end_id=2)).count() == edge_docs.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=60), st.integers(6, 12))
def test_code_lengths(counts, max_bits):
    lengths = code_lengths(np.array(counts), max_bits)
    used = np.array(counts) > 0
    assert ((lengths > 0) == used).all() and lengths.max(initial=0) <= max_bits
    if used.sum() > 1:
        assert sum(2.0 ** -int(n) for n in lengths[used]) == 1.0
        import heapq

        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        best = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            best += a + b
            heapq.heappush(heap, a + b)
        cost = int((np.array(counts) * lengths).sum())
        assert cost >= best and (cost == best or lengths.max() == max_bits)


def test_frames_round_trip():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.zipf(1.3, 20_000), 3000))
    lengths = code_lengths(counts, MAX_BITS)
    ids = np.repeat(np.arange(len(counts)), counts)
    rng.shuffle(ids)
    docs = np.split(ids, np.sort(rng.integers(0, len(ids), 30)))
    frame = encode_frame(docs, lengths, canonical_codes(lengths))
    back = decode_frame(frame, decode_table(lengths, MAX_BITS))
    assert len(back) == len(docs) and all((a == b).all() for a, b in zip(back, docs))
    with pytest.raises(ValueError):
        decode_frame(frame[:-1], decode_table(lengths, MAX_BITS))
