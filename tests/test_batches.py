import hashlib
import random
from collections import Counter
from dataclasses import replace

import pytest

from plaudit.config import DEFAULTS
from plaudit.operators.batching import assign_batches, bucket_counts, bucket_reviews, row_hash, sentiment_batches, span_digits
from plaudit.operators.ordinals import position_in_order, running_position
from plaudit.plans.prompts import analysis_prompts, categorise_prompts
from plaudit.sources.exports import rated_text, read_export
from test_exports import export


def brute_force(rows, size):
    """Batches in one list per sentiment: month, hash of the row."""
    result = []
    for sentiment in {row[0] for row in rows}:
        own = sorted((row for row in rows if row[0] == sentiment),
                     key=lambda row: (row[1], hashlib.md5("\x1f".join(value or "" for value in row).encode()).hexdigest()))
        result += [(*row, at // size + 1, -(-len(own) // size), at + 1) for at, row in enumerate(own)]
    return Counter(result)


@pytest.mark.parametrize("size", [1, 7, 150])
def test_batches_equal_brute_force_with_a_third_of_copies(spark, size):
    random.seed(3)
    rows = [(random.choice(["pos", "neg"]), random.choice(["2026-01", "2026-02"]), f"R{at}", f"text {at}") for at in range(400)]
    rows += [("pos", "2026-02", "COPY", "same text")] * 250 + [("neg", "2026-01", None, "no id")] * 3
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "sentiment string, month string, review_id string, review string")
    batches = assign_batches(frame, ["sentiment"], ["month"], size)
    assert Counter(tuple(row) for row in batches.collect()) == brute_force(rows, size)


def test_rows_without_id_are_spread(spark):
    """100,000 rows without an id, cut into spans of bounded size; the number of digits changes nothing else."""
    frame = spark.range(100_000).selectExpr("'pos' as sentiment", "'2026-01' as month", "cast(null as string) as review_id", "string(id) as review")
    hashed = frame.select(row_hash(frame.columns).alias("hash"))
    assert hashed.groupBy(hashed.hash.substr(1, 4)).count().agg({"count": "max"}).first()[0] < 20
    few = frame.limit(300)
    assert {tuple(row) for row in assign_batches(few, ["sentiment"], ["month"], 7, 1).collect()} == {
        tuple(row) for row in assign_batches(few, ["sentiment"], ["month"], 7, 4).collect()}


def test_grouping_by_batch_needs_no_further_shuffle(spark):
    frame = spark.createDataFrame([("pos", "2026-01", "R1", "x")], "sentiment string, month string, review_id string, review string")
    grouped = sentiment_batches(frame).groupBy("sentiment", "batch_no").count()
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    top = plan.split("Exchange", 1)[0]
    assert top.count("HashAggregate") == 2 and "REPARTITION_BY_COL" in plan.split("Exchange", 2)[1]


def exchanges_with(frame, names):
    """The shuffles of a plan that carry a column of one of the names."""
    found, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(at) for at in range(children.size())]
        if node.nodeName() == "Exchange":
            own = node.output()
            found += any(own.apply(at).name() in names for at in range(own.size()))
    return found


def test_texts_cross_two_shuffles(spark):
    """A text meets its position and then its batch; ``first`` and ``row`` are names it has on the way."""
    rows = spark.range(1000).selectExpr("string(id) as review_id", "'2026-01' as month", "'neg' as sentiment", "concat('text ', id) as review",
                                        "'S' as source", "1.0D as rating", "'A' as author", "'T' as title")
    texts = {"review", "block", "first", "row", "rows"}  # by name, or in the struct that is gathered per hash
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for prompts in (analysis_prompts(rows), categorise_prompts(rows.select("sentiment", "month", "review_id", "review"))):
            assert exchanges_with(prompts, texts) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_batches_without_keys(spark):
    rows = [(f"R{at % 300}", f"text {at % 300}") for at in range(500)] + [(None, None)] * 40
    found = sorted(assign_batches(spark.createDataFrame(rows, "review_id string, review string"), [], [], 50).collect(), key=lambda row: row.row_no)
    expected = sorted(rows, key=lambda row: hashlib.md5("\x1f".join(value or "" for value in row).encode()).hexdigest())
    assert [(row.review_id, row.review) for row in found] == expected
    assert [(row.row_no, row.batch_no, row.total_batches) for row in found] == [(at + 1, at // 50 + 1, 11) for at in range(540)]


def test_null_and_empty_values_stay_apart(spark):
    rows = [("a", None), ("a", ""), ("a", ""), (None, "a"), ("a\x1fb", "c"), ("a", "b\x1fc")]
    found = assign_batches(spark.createDataFrame(rows, "review_id string, review string"), [], [], 4).collect()
    assert Counter((row.review_id, row.review) for row in found) == Counter(rows)
    assert sorted(row.row_no for row in found) == [1, 2, 3, 4, 5, 6]


def test_spans_follow_the_number_of_rows(spark):
    rows = spark.range(70_000).toDF("id")
    digits = [rows.limit(1).select(span_digits(rows, size)).first()[0] for size in (100_000, 1, 16)]
    assert digits == [4, 5, 4]


def test_buckets(spark, rows_of):
    rows = [("R1", "2026-01", 5.0, "old"), ("R2", "2026-02", 4.0, "x" * 600), ("R3", "2026-03", 3.9, "bad")]
    frame = spark.createDataFrame(rows, "review_id string, month string, rating double, review string")
    buckets = bucket_reviews(frame)
    assert rows_of(buckets) == [("neg", "2026-03", "R3", "bad"), ("pos", "2026-02", "R2", "x" * 500)]
    assert rows_of(bucket_counts(buckets)) == [("neg", "2026-03", 1), ("pos", "2026-02", 1)]


def test_running_position_equals_a_plain_count(spark):
    random.seed(5)
    rows = [(random.choice("ab"), at // 10, at % 10, at) for at in range(300)]
    frame = spark.createDataFrame(rows, "grp string, span int, pos int, id int")
    found = {row.id: (row.place, row.group_rows) for row in running_position(frame, ["grp"], ["span"], ["pos"], "place").collect()}
    for name in "ab":
        own = [row[3] for row in rows if row[0] == name]
        assert [found[at] for at in own] == [(nth, len(own)) for nth in range(1, len(own) + 1)]


def test_batches_in_the_order_of_files(spark, tmp_path):
    """Rows of many files, repeated ones among them, with line breaks inside, in ranges of a few lines."""
    rng, rows = random.Random(8), []
    for at in range(6):
        own = [(f"f{at}r{rng.randrange(9)}", f"2026-0{rng.choice('12')}-03", rng.choice(["1", "5"]), rng.choice(["same", f"text\n{rng.random()}"])) for _ in range(25)]
        export(tmp_path, *(f'{key},{day},A,S,{stars},t,"{text}",u' for key, day, stars, text in own), name=f"part-{at}.csv")
        rows += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = sentiment_batches(bucket_reviews(rated_text(read_export(spark, str(tmp_path), positions=True))), replace(DEFAULTS, batch_size=7)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for side, stars in (("pos", "5"), ("neg", "1")):
        own = sorted((row for row in rows if row[2] == stars), key=lambda row: row[1][:7])     # stable: file order within a month
        batches = sorted((row for row in found if row.sentiment == side), key=lambda row: row.row_no)
        assert [(row.review_id, row.month, row.review) for row in batches] == [(key, day[:7], text) for key, day, _, text in own]
        assert [(row.row_no, row.batch_no, row.total_batches) for row in batches] == [(at + 1, at // 7 + 1, -(-len(own) // 7)) for at in range(len(own))]


def test_position_in_any_order(spark):
    names = [f"source {random.Random(at).randrange(10**6)}-{at}" for at in range(700)]
    found = position_in_order(spark.createDataFrame([(name,) for name in names], "name string").repartition(5), ["name"], "place").collect()
    assert {row.name: row.place for row in found} == {name: at for at, name in enumerate(sorted(names), 1)}
