from __future__ import annotations

import re

import numpy as np

from tests.llm.conftest import SF
from triagemill.llm.quality import quality_rules, ratio_weights
from triagemill.llm.queries import QUERIES
from triagemill.llm.toxicity import _present, drop_toxic, fit_toxicity, score_toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = QUERIES["op4_toxicity"](spark, d).join(labels, "doc_id").filter("held_out").toPandas()
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert hit / (rows.predicted == 1).sum() >= 0.95 and hit / (rows.toxic == 1).sum() >= 0.7
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()


def test_ngrams_against_slices():
    texts = ["Abcab", "", "zz", "héé\n😀"]
    every = np.arange(1 << 20)
    row, bucket = _present(texts, every, (3, 4, 5), 20)
    want = []
    for t in texts:
        p = f"  {t.lower()}  "
        want.append(len({p[i : i + n] for n in (3, 4, 5) for i in range(len(p) - n + 1)}))
    assert [(row == i).sum() for i in range(len(texts))] == want
    again = _present([texts[3]], every, (3, 4, 5), 20)[1]
    assert sorted(bucket[row == 3]) == sorted(again)


def test_edges(spark, edge_docs):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(20)] + [(3, None), (None, 1), (6, 1)], "doc_id long, toxic int"
    )
    model = fit_toxicity(edge_docs, labels)
    got = score_toxicity(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = drop_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in got)
    alone = fit_toxicity(edge_docs, labels.filter("toxic = 0"))
    assert len({r["score"] for r in score_toxicity(edge_docs, alone).collect()}) == 1
    assert score_toxicity(edge_docs.limit(0), fit_toxicity(edge_docs.limit(0), labels.limit(0))).count() == 0


def repeat_words(words):
    seen, hit = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + j for i in at for j in range(5)}
    return len(hit)


def test_quality_edges(spark, edge_docs):
    extra = [(50, "a b c d e f a b c d e x a b c d e"), (51, "l1\nl1\n \n\nl2 $#\nl1\r\n"), (52, "r " * 30)]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    weights = ratio_weights(docs, edge_docs.select("doc_id").limit(3))
    got = {r["doc_id"]: r for r in quality_rules(docs, weights).collect()}
    for r in docs.collect():
        t = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        own = got[r["doc_id"]]
        n_repeat = repeat_words(words)
        assert own["n_words"] == len(words) and own["word_chars"] == sum(map(len, words))
        assert own["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert own["n_dup_lines"] == len(lines) - len(set(lines)) and own["n_repeat_words"] == n_repeat
        assert own["base_failed"] == (len(words) < 10 or 100 * n_repeat > 20 * len(words))
        assert not (own["kept"] and own["base_failed"])
    assert quality_rules(docs.limit(0), weights).count() == 0
    assert len(weights) == 8192 and ratio_weights(docs.limit(0), docs.limit(0)) == [0.0] * 8192


def test_junk_goes_and_prose_stays(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op3_quality_rules"](spark, SF).join(labels, "doc_id").toPandas()
    prose = rows[(rows.quality == 1) & ~rows.base_failed]
    assert prose.kept.mean() > 0.95 and rows[rows.quality == 0].kept.mean() < 0.3
