from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline
from corpus_pipeline import STAGES
from triagemill.llm.toxicity import fit_toxicity, score_toxicity
from triagemill.session import materialize
from tests.llm.conftest import SF
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import lib_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, documents):
    """Input and output of every stage."""
    docs, out = documents, {}
    for name, stage in STAGES:
        made = materialize(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def test_columns(steps, documents):
    for name, _ in STAGES[:-1]:
        assert steps[name][1].columns == documents.columns


def test_toxicity(spark, steps):
    docs, kept = steps["toxicity"]
    model = fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in score_toxicity(docs, model).filter("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_near_duplicates(steps):
    docs, kept = steps["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, c, *_ in brute(rows) if i == c]


def test_pii(steps):
    docs, made = steps["pii"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in made.collect()}
    assert set(before) == set(after)
    private = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}|[a-z]+\.\d\d@mail\d\.example\.com|\b\d{1,3}(?:\.\d{1,3}){3}\b")
    for i, text in before.items():
        assert not set(private.findall(text)) & set(private.findall(after[i]["text"]))
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_mixing(steps):
    docs, made = steps["mixing"]
    size, source = {}, {}
    for r in docs.collect():
        size[r["doc_id"]], source[r["doc_id"]] = len(WORD.findall(r["text"])), r["source"]
    taken, by_source = Counter(), Counter()
    for r in made.collect():
        n = len(WORD.findall(r["text"]))
        taken[r["doc_id"]] += n
        by_source[r["source"]] += n
    assert all(taken[i] <= 2 * size[i] for i in taken)
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    target = targets(dict(totals))
    for s, t in target.items():
        assert abs(by_source[s] - t) <= max(64, 0.02 * t)


def targets(totals, weights=(3, 1, 2)):
    names = sorted(totals)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, want = {}, set(names), 1.5 * sum(totals.values())
    while left:
        share = (want - sum(out.values())) / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * share >= 2 * totals[s]}
        if not full:
            return out | {s: weight[s] * share for s in left}
        out |= {s: 2 * totals[s] for s in full}
        left -= full
    return out


def test_packing(steps):
    docs, pieces = steps["packing"]
    rows = docs.collect()
    total = sum(len(lib_ids(r["text"])) + 1 for r in rows)
    got = pieces.collect()
    assert sum(r["length"] for r in got) == total
    single = {i for i, n in Counter(r["doc_id"] for r in rows).items() if n == 1}
    ids = {r["doc_id"]: lib_ids(r["text"]) + [1] for r in rows if r["doc_id"] in single}
    for r in got:
        if r["doc_id"] in single:
            assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps["packing"][1].count()
