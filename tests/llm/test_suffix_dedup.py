"""Repeated passages against a table of all windows, suffix arrays against sorting."""

import hashlib
import random

import numpy as np
import pytest

from compare import difference, duck
from plaudit.llm import suffix_arrays, suffix_dedup as sd
from plaudit.llm.queries import ORACLES, QUERIES

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("few", [2, 256])
def test_suffix_arrays(few, monkeypatch):
    monkeypatch.setattr(suffix_arrays, "FEW_NAMES", few)
    rng = np.random.default_rng(1)
    for trial in range(300):
        text = np.r_[rng.integers(1, rng.integers(2, 7), rng.integers(0, 200)), 0]
        if trial % 3 == 0:
            text = np.r_[np.tile(np.maximum(text[:5], 1), 20), 0]
        listed = text.tolist()
        order = suffix_arrays.suffix_array(text, int(text.max()) + 1)
        expected = sorted(range(len(listed)), key=lambda at: listed[at:])
        assert order.tolist() == expected
        shared, previous = suffix_arrays.common_prefixes(text, order, 20)
        for before, at in zip(expected, expected[1:]):
            same = next((k for k in range(21) if k == 20 or listed[at + k:at + k + 1] != listed[before + k:before + k + 1]), 20)
            assert (shared[at], previous[at]) == (same, before)


def brute_force(rows, match):
    """Rows ``(doc_id, tie, data)`` in document order: spans by a table of the first place of each window."""
    first, result = {}, []
    for doc, data in rows:
        covered = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - match + 1):
            if first.setdefault(data[at:at + match], (doc, at)) != (doc, at):
                covered[at:at + match] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~covered[:-1]])
        edges = np.flatnonzero(np.diff(np.r_[False, covered].astype(int)))
        result.append((doc, len(data), int(covered.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return result


def digests(found):
    return sorted((row.doc_id, row.n_bytes, sum(span.stop - span.start for span in row.spans), len(row.spans),
                   hashlib.sha256(bytes(row.kept)).hexdigest()) for row in found.collect())


def made_up(seed, count):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma ", "delta", "é", "ue\n", "zeta  ", "eta", "theta", "kappa"]
    passage = " ".join(rng.choice(words) for _ in range(80))
    base = [rng.choice(words) for _ in range(300)]
    texts = []
    for at in range(count):
        kind = rng.randrange(8)
        own = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(120))]
        if kind == 0:
            texts.append(" ".join(own))
        elif kind == 1:
            near = list(base)
            near[rng.randrange(300)] = f"edit{at}"
            texts.append(" ".join(near))
        elif kind == 2:
            texts.append(" ".join(own) + passage + " ".join(own[::-1]))
        elif kind == 3:
            texts.append("a" * rng.randrange(400))
        elif kind == 4:
            texts.append(" ".join(own) * 3)
        elif kind == 5:
            texts.append(passage[rng.randrange(100):][:rng.randrange(90, 300)])
        elif kind == 6:
            texts.append(rng.choice(["", "short", None]))
        else:
            texts.append("#" * rng.randrange(150) + " ".join(base[50:90]))
    return texts


OPTIONS = [sd.DedupOptions(), sd.DedupOptions(part_bytes=300, shard_bytes=500, hot_contexts=3), sd.DedupOptions(part_bytes=2000, hot_contexts=0),
           sd.DedupOptions(match=40, anchor=8, part_bytes=777, shard_bytes=4000)]


@pytest.mark.parametrize("options", OPTIONS)
def test_spans_equal_a_table_of_windows(spark, options):
    texts = made_up(3, 150)
    rows = spark.createDataFrame([(at * 3, text, "own", 1) for at, text in enumerate(texts)], "doc_id long, text string, tie string, pos long")
    found = digests(sd.deduplicated(spark, rows, options))
    assert found == brute_force([(at * 3, (text or "").encode()) for at, text in enumerate(texts)], options.match)


def test_null_and_repeated_ids(spark):
    """Null ids come last; equal rows are one document; of several texts of one id each is judged against the others."""
    line = "".join(f"word{at} " for at in range(40))
    rows = [(None, line), (5, line + "x"), (5, line + "x"), (9, line), (7, "short"), (None, None), (5, "y" + line)]
    found = digests(sd.deduplicated(spark, spark.createDataFrame([(doc if doc is not None else None, text) for doc, text in rows], "doc_id long, text string")).na.fill(-1, ["doc_id"]))
    removed = {}
    for doc, size, gone, *_ in found:
        removed.setdefault(doc, []).append((size, gone))
    size = len(line)
    assert removed[9] == [(size, size)] and removed[7] == [(5, 0)] and sorted(removed[-1]) == [(0, 0), (size, size)]
    assert sorted(gone for _, gone in removed[5]) in ([0, 0, size], [0, size, size])


def test_copies_of_a_third_of_the_rows(spark):
    rows = spark.range(1200).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('the same passage again ', 9), concat('text ', sha2(string(id), 512), sha2(concat('x', id), 512))) as text")
    found = digests(sd.deduplicated(spark, rows))
    assert all(gone == (size if doc % 3 == 0 and doc else 0) for doc, size, gone, *_ in found if doc)


def test_no_documents(spark):
    assert sd.deduplicated(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("folder", [SMALL])
def test_query_on_whole_tables(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = sorted(tuple(row) for row in QUERIES["op13_suffix_dedup"](spark, folder).collect())
    assert found == brute_force([(row.doc_id, (row.text or "").encode()) for row in rows], 100)
