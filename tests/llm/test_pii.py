from __future__ import annotations

import datetime
import itertools
import re

import pytest
from pyspark.sql import functions as F

from triagemill.llm.pii import feistel, permute_digits, pseudonymize

KEY = "test-key"


def run(spark, texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii_counts string")
    return {r["doc_id"]: r for r in pseudonymize(rows, KEY).collect()}


def luhn_ok(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_feistel_is_a_permutation(spark):
    pairs = spark.createDataFrame(list(itertools.product(range(7), range(11))), "x long, y long")
    out = pairs.select(
        feistel(F.col("x"), F.col("y"), F.lit(7).cast("long"), F.lit(11).cast("long"), KEY, F.lit("t")).alias("s")
    ).collect()
    assert {(r["s"]["l"], r["s"]["r"]) for r in out} == set(itertools.product(range(7), range(11)))
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = [r[0] for r in numbers.select(permute_digits(F.col("d"), KEY, "t")).collect()]
    assert len(set(got)) == 1000 and all(re.fullmatch(r"\d{3}", x) for x in got)


SHAPES = {
    "card": ("4337166598464399", r"4\d{15}"),
    "phone": ("+1 (988) 555-2485", r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}"),
    "ip": ("42.144.35.254", r"\d{1,3}(\.\d{1,3}){3}"),
    "date": ("2021-02-28", r"\d{4}-\d\d-\d\d"),
    "ssn": ("123-45-6789", r"\d{3}-\d\d-\d{4}"),
    "email": ("bosbt.42@mail8.example.com", r"u[0-9a-f]{16}@mail8\.example\.com"),
    "secret": ("1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae", r"[0-9a-f]{40}"),
}


@pytest.mark.parametrize("kind", SHAPES)
def test_each_kind(spark, kind):
    old, shape = SHAPES[kind]
    lead = 'token = "' if kind == "secret" else "see "
    got = run(spark, [f"{lead}{old} and.", f"é {lead}{old}"])
    new = [re.search(shape, got[i]["text"])[0] for i in (0, 1)]
    assert new[0] == new[1] != old
    assert got[0]["text"] == f"{lead}{new[0]} and." and got[1]["text"] == f"é {lead}{new[0]}"
    assert got[0]["pii_counts"][kind] == 1 and sum(got[0]["pii_counts"]) == 1
    if kind == "card":
        assert luhn_ok(new[0])
    if kind == "ip":
        assert all(int(x) < 256 for x in new[0].split("."))
    if kind == "date":
        datetime.date.fromisoformat(new[0])


def test_formats_stay(spark):
    texts = ["4111-1111-1111-1111", "4111 1111 1111 1111", "25.12.1999", "12/25/1999", "25/12/1999",
             "+49 30 1234567", "212-555-0199", "(212) 555-0199", "2020/02/29"]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        new = got[i]["text"]
        assert new != t and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", t), (t, new)
    assert luhn_ok(re.sub(r"\D", "", got[0]["text"]))
    assert re.sub(r"\D", "", got[0]["text"]) == re.sub(r"\D", "", got[1]["text"])
    datetime.datetime.strptime(got[2]["text"], "%d.%m.%Y")
    datetime.datetime.strptime(got[3]["text"], "%m/%d/%Y")
    datetime.datetime.strptime(got[4]["text"], "%d/%m/%Y")


def test_others_stay(spark):
    texts = [None, "", "x", "4111111111111112", "999.1.1.1", "1.2.3", "2021-02-30", "000-12-3456",
             "(112) 555-0199", "a @ b", "12345", "beef" * 12, "1" * 40, "x@y", "9" * 20_000, "ab" * 50_000]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i]["text"] == t and sum(got[i]["pii_counts"]) == 0, t


def test_different_values_stay_apart(spark):
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(i) for i in range(0, 3000)]
    got = run(spark, [d.isoformat() for d in days] + [f"10.0.{i}.7" for i in range(256)])
    assert len({r["text"] for r in got.values()}) == len(days) + 256


def test_whole_table_and_empty(spark, documents):
    out = pseudonymize(documents, KEY)
    assert out.filter("text is null").count() == 0
    assert out.count() == documents.count() and pseudonymize(documents.limit(0), KEY).count() == 0
    seen = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in out.collect():
        for m in re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|[a-z]+\.\d\d@mail\d\.example\.com", seen[r["doc_id"]]):
            assert m not in r["text"]
        same = re.sub(r"\S*[\d@]\S*", "", seen[r["doc_id"]]) == re.sub(r"\S*[\d@]\S*", "", r["text"])
        assert same


def test_beside_other_numbers(spark):
    """(text, kept before, the value, kept after): invalid joined numbers hide no valid one."""
    cases = [
        ("card", "", "4111 1111 1111 1111", " 12/25"), ("card", "", "4111111111111111", " 123"),
        ("ssn", "1234 ", "123-45-6789", ""), ("phone", "", "555-223-4567", " 123"),
        ("date", "12345 ", "2021-03-04", ""), ("card", "", "4111 1111 1111 1111", " 12"),
        ("card", "1234 ", "4111 1111 1111 1111", ""), ("card", "+1 ", "4111 1111 1111 1111", ""),
        ("phone", "1111 2222 3333 4445 ", "555 223 4567", ""), ("card", "45/45/", "3782 822463 10005", ""),
        ("card", "2021-02-30 ", "4111-1111-1111-1111", ""), ("card", "", "3056 930902 5904", " 7"),
    ]
    got = run(spark, [a + v + b for _, a, v, b in cases])
    for i, (kind, a, v, b) in enumerate(cases):
        new = got[i]["text"]
        assert new.startswith(a) and new.endswith(b), (cases[i], new)
        own = new[len(a) : len(new) - len(b)]
        assert own != v and re.sub(r"\d", "9", own) == re.sub(r"\d", "9", v), (cases[i], new)
        assert got[i]["pii_counts"][kind] == 1 and sum(got[i]["pii_counts"]) == 1, cases[i]
        if kind == "card":
            assert luhn_ok(re.sub(r"\D", "", own))


def test_unrelated_numbers_are_no_card(spark):
    for t in ["41111 11111 11111 1", "411 1111 1111 11111", "4111 1111-1111 1111"]:
        assert luhn_ok(re.sub(r"\D", "", t))
        assert run(spark, [t])[0]["text"] == t


def test_phone_stops_before_a_card(spark):
    new = run(spark, ["+49 30 1234567 4111 1111 1111 1111"])[0]
    assert (new["pii_counts"]["phone"], new["pii_counts"]["card"]) == (1, 1)


def test_dates_are_those_of_the_calendar(spark):
    tests = [f"{y:04}-{m:02}-{d:02}" for y in (1599, 1600, 1700, 1900, 2000, 2023, 2024, 9999) for m in range(0, 14) for d in range(0, 33)]
    got = run(spark, tests)
    for i, t in enumerate(tests):
        try:
            good = datetime.date.fromisoformat(t).year >= 1600
        except ValueError:
            good = False
        assert got[i]["pii_counts"]["date"] == good, t


def test_columns_with_internal_names(spark):
    rows = [(1, "mail a.b@example.com", "s", "m", "c"), (2, None, "s2", "m2", "c2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _shapes string, _made string, c1 string")
    made = pseudonymize(docs, KEY)
    assert made.columns == [*docs.columns, "pii_counts"]
    got = {r["doc_id"]: (r["_shapes"], r["_made"], r["c1"], r["text"]) for r in made.collect()}
    assert got[1][:3] == ("s", "m", "c") and "a.b@example.com" not in got[1][3]
    assert got[2] == ("s2", "m2", "c2", None)


def test_key_is_a_setting(spark):
    from triagemill.llm.queries import PII_KEY, PII_KEY_SETTING, pii_key

    assert pii_key(spark) == PII_KEY
    spark.conf.set(PII_KEY_SETTING, "other")
    try:
        assert pii_key(spark) == "other"
    finally:
        spark.conf.unset(PII_KEY_SETTING)
