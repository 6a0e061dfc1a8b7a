from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from triagemill.llm.mixing import apply_mix, mix, seats


def by_hand(votes, total):
    won = [0] * len(votes)
    for _ in range(total if sum(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(0, 60))
def test_highest_quotients(spark, votes, total):
    rows = spark.createDataFrame([(0, i, v, total) for i, v in enumerate(votes)], "g int, i int, v long, t long")
    got = {r["i"]: r["seats"] for r in seats(rows, ["g"], ["i"], "v", "t").collect()}
    assert [got[i] for i in range(len(votes))] == by_hand(votes, total)


def test_edges(spark, edge_docs):
    got = mix(edge_docs).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert mix(edge_docs.limit(0)).count() == 0 and apply_mix(edge_docs.limit(0)).count() == 0
    nulls = edge_docs.selectExpr("cast(null as long) doc_id", "text", "cast(null as string) source")
    taken = [(r["size"], r["taken"]) for r in mix(nulls).collect()]
    assert abs(sum(t for _, t in taken) - 1.5 * sum(s for s, _ in taken)) < 64


def test_rows_that_repeat_a_key_and_columns_without_order(spark):
    rows = [(i % 3, " ".join(f"w{j}" for j in range(20 + i)), "s", {"k": i}) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>")
    mixed = apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() >= 9
    total = sum(r["size"] for r in mix(docs).collect())
    assert abs(sum(len(r["text"].split()) for r in mixed.collect()) - 1.5 * total) < 64


def test_no_dependence_on_partitions(spark, documents):
    one = sorted(map(tuple, mix(documents.coalesce(1)).collect()))
    assert one == sorted(map(tuple, mix(documents.repartition(13)).collect()))


def test_columns_with_internal_names(spark):
    own = ["_size", "_own", "_times", "_text", "_some", "_start", "_prime", "_row", "_src", "c1"]
    rows = [(i, f"w{i} " * 40, "s", *[f"{n}{i}" for n in own]) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *own])
    mixed = apply_mix(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in own)


def test_partial_texts_are_runs(spark):
    """A source cut to half its words keeps whole documents but at the ends of a shard's run."""
    texts = {i: " ".join(f"d{i}w{j}" for j in range(200)) for i in range(60)}
    rows = [(i, t, "a" if i < 5 else "b") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = [(r["doc_id"], r["text"]) for r in apply_mix(docs, weights=(1, 1), share=0.5).collect()]
    assert all(t in texts[i] for i, t in mixed)
    assert sum(t != texts[i] for i, t in mixed) <= 4
    taken = {r["doc_id"]: r["taken"] for r in mix(docs, weights=(1, 1), share=0.5).collect()}
    assert abs(sum(len(t.split()) for _, t in mixed) - sum(taken.values())) < 64
