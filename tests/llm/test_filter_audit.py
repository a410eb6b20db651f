"""The filter audit against every order walked through document by document."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import difference, duck
from plaudit.llm import filter_audit as fa
from plaudit.llm.queries import ORACLES, QUERIES

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SIZES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text, doc, rows):
    words = re.findall("[^\x20\x09-\x0D]+", text)
    found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
             "D": bool(re.search("[#$%&*|]", text)),
             "E": doc is not None and any(other is not None and other < doc and (body or "") == text for other, body, _ in rows)}
    return {name for name, fails in found.items() if fails}


def walked(rows, labels):
    good, toxic = ({doc for doc, *marks in labels if marks[at] == 1} for at in range(2))
    judged = [(lang or "", failed(text or "", doc, rows), doc in good and doc is not None, doc in toxic and doc is not None) for doc, text, lang in rows]
    result, shapley = {}, Counter()
    for part in {row[0] for row in judged}:
        own = [row for row in judged if row[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                lost, kept = [row for row in left if name in row[1]], [row for row in left if name not in row[1]]
                failing = [row for row in own if name in row[1]]
                shapley[part, name] += len(lost)
                result[part, "".join(order), step] = [len(kept), len(lost), len(failing) - len(lost), sum(row[1] == {name} for row in own),
                                                      sum(row[2] for row in lost), sum(row[3] for row in lost)]
                left = kept
    return {key: (*sizes, shapley[key[0], key[1][key[2] - 1]]) for key, sizes in result.items()}


def made_up(seed, count):
    rng = random.Random(seed)
    texts = [None, "", " ".join(f"w{at}" for at in range(220)), "THE " * 250, "x " * 199 + "X|", "a\x0bb\x1cc " * 90]
    rows = [(rng.choice([at, at, at // 2, None]), rng.choice([*texts, f"text {at} " + "word " * rng.randrange(300)]), rng.choice(["en", "de", None])) for at in range(count)]
    return rows + rows[:9] * 3


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_every_order(spark, batch):
    rows, labels = made_up(1, 120), [(at, at % 2, at % 3 % 2) for at in range(0, 120, 2)] + [(4, 1, None), (None, 1, 1), (4, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"part": F.lit("own"), "n": F.lit(5), "key": F.lit("k")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = fa.filter_interactions(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    expected = walked(rows, labels)
    assert len(found) == len(expected)
    assert {(row.part, row.filter_order, row.step): tuple(row[name] for name in SIZES) for row in found} == expected


def test_posting_lists():
    rng = np.random.default_rng(2)
    for _ in range(100):
        lists = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(rng.integers(1, 6))]
        assert fa.union(lists).tolist() == sorted(set().union(*(ids.tolist() for ids in lists)))
        for other in lists:
            assert fa.difference(lists[0], other).tolist() == sorted(set(lists[0].tolist()) - set(other.tolist()))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.filter_interactions(spark, spark.createDataFrame([], "doc_id long, text string, lang string"), none).collect() == []
    one = fa.filter_interactions(spark, spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), none).collect()
    assert len(one) == 600 and {row.part for row in one} == {""} and sum(row.removed for row in one) == 120


def test_a_third_of_copies(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text", "'en' as lang")
    found = fa.filter_interactions(spark, rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert found.where("filter_order = 'EABCD' and step = 1").select("removed", "kept").collect() == [(999, 2001)]


@pytest.mark.parametrize("folder", [SMALL, MORE])
def test_counterpart(spark, folder):
    assert difference(QUERIES["op12_filter_audit"](spark, folder), duck(folder), ORACLES["op12_filter_audit"]) is None
