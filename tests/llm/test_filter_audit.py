"""The audit of filters against a plain count of every document in every order."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.filter_audit import Copies, filter_audit, judged

GOOD = " ".join(f"word{i}" for i in range(120))
TEXTS = [
    GOOD, GOOD, GOOD + " $5", GOOD.upper(), "ab " * 150, None, "", "", "Ab\x0bcd\x1cEF", "short", "short", GOOD + "|", "É" * 3 + " AAA", GOOD + " x", "* " * 200,
]


def brute(rows, labels):
    first, marks = {}, {}
    for i, t, *_ in rows:
        first.setdefault(t or "", set()).add(np.inf if i is None else i)
    for i, q, x in labels:
        old = marks.get(i, (False, False))
        marks[i] = (old[0] or q == 1, old[1] or x == 1)
    fails = []
    for i, t, part, *_ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = min(first[t]) < (np.inf if i is None else i)
        fails.append((part or "", {k for k, v in own.items() if v}, marks.get(i, (False, False)) if i is not None else (False, False)))
    out = {}
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {p for p, _, _ in fails}:
        own = [(f, m) for p, f, m in fails if p == part]
        shapley = {x: 0 for x in "ABCDE"}
        for order in orders:
            left = own
            for step, x in enumerate(order, 1):
                removed = [(f, m) for f, m in left if x in f]
                left = [(f, m) for f, m in left if x not in f]
                shapley[x] += len(removed)
                redundant = sum(x in f for f, _ in own) - len(removed)
                out[part, order, step] = [len(left), len(removed), redundant, sum(f == {x} for f, _ in own), sum(m[0] for _, m in removed), sum(m[1] for _, m in removed)]
        for order in orders:
            for step, x in enumerate(order, 1):
                out[part, order, step].append(shapley[x])
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some_rows():
    rows = [(i, t, (None, "en", "de")[i % 3], "x", 1) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, GOOD + " copy", "en", "x", 1) for i in range(300)]
    rows += [(400 - i, f"{GOOD} {i % 7}", "de", "x", 1) for i in range(60)]
    return [*rows, (None, GOOD, "en", "x", 1), (None, "alone", "en", "x", 1), (None, "alone", "en", "x", 1), (0, GOOD, "en", "x", 1), (100, GOOD + " copy", "fr", "x", 1)]


def test_equals_a_plain_count(spark, many_ranges):
    rows = some_rows()
    labels = [(i, i % 2, int(i % 5 == 0), "y") for i in range(0, 420, 3)] + [(3, 1, None, "y"), (3, 0, 1, "y"), (None, 1, 1, "y"), (9999, 1, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, mask int").repartition(5)
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, mask string")
    found = filter_audit(docs, labels_df, F.col("lang"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == brute(rows, [x[:3] for x in labels])
    assert filter_audit(docs.limit(0), labels_df, F.col("lang")).collect() == []
    assert filter_audit(docs, labels_df.limit(0), F.col("lang")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_copies_over_the_edges_of_ranges(spark, many_ranges):
    rows = [(i, GOOD, "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    found = judged(docs, F.col("lang")).where("mask & 16 = 0")
    assert [r.doc_id for r in found.collect()] == [0]


def test_equal_fingerprints_of_other_texts():
    copies = Copies()
    assert copies.of(np.array([5, 5, 5, 5]), ["a", "a", "b", "b"], np.array([1, 2, 1, 1])).tolist() == [False, True, False, False]
    assert copies.of(np.array([5, 5, 6]), ["b", "b", "b"], np.array([1, 3, 4])).tolist() == [False, True, False]
    assert copies.of(np.array([], np.int64), [], np.array([], np.int64)).tolist() == []
