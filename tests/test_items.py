import random


from plaudit.config import ACTIONABLE_LABELS, DEFAULTS
from plaudit.operators import items as it
from plaudit.operators.joins import bucketed_lookup, latest_per_key, lookup_join

GROUPS = {
    "Login/Auth Issue": "Core Issues", "Verification Code Failure": "Core Issues", "Payment Error": "Billing/Payments",
    "Account Access": "Core Issues", "App Crash": "Core Issues", "Order/Shipping Issue": "Order/Shipping",
    "Slow Shipping": "Order/Shipping", "Missing Delivery": "Order/Shipping", "Return/Refund Blocked": "Return/Refund",
    "Unauthorized Charge": "Billing/Payments", "Credit Reporting Failure": "Credit",
    "Direct Deposit Not Recognized": "Billing/Payments", "Defective/Counterfeit Product": "Order/Shipping",
    "Fraudulent Account Opened": "Fraud/Identity", "Credit Limit Not Updating": "Credit",
    "Gig Worker Eligibility Rejected": "Core Issues", "Subscription/Fee Dispute": "Billing/Payments",
    "Customer Service Issue": "Customer Service", "Order return": "Order/Shipping", "Coffee machine": "Billing/Payments",
    "": "Core Issues", None: "Core Issues",
}
ITEM = "batch_no long, pos int, review_id string, score int, category string, reason string"
REVIEW = "review_id string, published string, author string, source string, rating double, review string, url string"


def test_groups(spark):
    assert set(ACTIONABLE_LABELS) < set(GROUPS)
    frame = spark.createDataFrame([(label,) for label in GROUPS], "category string")
    assert {row.category: row.group_name for row in it.assign_group(frame).collect()} == GROUPS


def make(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def test_positions_equal_a_sort(spark):
    random.seed(11)
    labels = list(ACTIONABLE_LABELS)
    rows = [(batch, pos, f"R{batch}-{pos}", random.choice([None, 0, 1, 2, 3, 4, 5]), random.choice(labels), "r")
            for batch in range(1, 40) for pos in range(7)]
    found = it.item_ordinals(make(spark, rows), batches_per_span=3).collect()
    order = sorted(rows, key=lambda row: (-(row[3] or 0), row[0], row[1]))
    assert {row.review_id: row.item_no for row in found} == {row[2]: nth for nth, row in enumerate(order, 1)}
    for name in set(GROUPS.values()):
        own = [row for row in order if GROUPS[row[4]] == name]
        assert {row.review_id: row.group_item_no for row in found if row.group_name == name} == {
            row[2]: nth for nth, row in enumerate(own, 1)}


def test_scores_out_of_range_are_told_apart(spark):
    frame = make(spark, [(1, 0, "a", 6, "x", "r"), (1, 1, "b", 5, "x", "r"), (1, 2, "c", None, "x", "r"), (1, 3, "d", -1, "x", "r")])
    assert [row.review_id for row in frame.filter(it.in_score_range()).collect()] == ["b", "c"]
    assert [row.review_id for row in it.actionable(frame.filter(it.in_score_range())).collect()] == ["b"]
    assert [row.review_id for row in it.ranked(frame).orderBy("item_no").collect()] == ["a", "b", "c", "d"]


def test_top_item_takes_the_first_of_the_best(spark, rows_of):
    rows = [(1, 0, "a", 3, "App Crash", "r"), (1, 1, "b", 5, "App Crash", "r"), (2, 0, "c", 5, "App Crash", "r"),
            (1, 2, "d", None, "Slow Shipping", "r"), (2, 1, "e", None, "Slow Shipping", "r")]
    assert rows_of(it.top_item_per_group(make(spark, rows)), "group_name", "review_id") == [
        ("Core Issues", "b"), ("Order/Shipping", "d")]


def test_latest_review_of_an_id_is_shown(spark, rows_of):
    reviews = spark.createDataFrame(
        [("R1", "2026-01-01", "old", "GP", 1.0, "old text", "u"), ("R1", "2026-02-01", "new", "BBB", 2.0, "n" * 300, None),
         ("R2", None, None, None, 3.0, "t", None), (None, "2026-01-01", "x", "x", 1.0, "x", "x")], REVIEW)
    items = make(spark, [(1, 0, "R1", 5, "c", "r"), (1, 1, "R1", 4, "c", "r"), (1, 2, "R2", 4, "c", "r"),
                         (1, 3, "X", 4, "c", "r"), (1, 4, None, 4, "c", "r")])
    joined = it.with_reviews(items, reviews)
    assert rows_of(joined, "pos", "matched", "author", "source") == [
        (0, True, "new", "BBB"), (1, True, "new", "BBB"), (2, True, None, None), (3, False, None, None), (4, False, None, None)]
    assert max(len(row.review or "") for row in joined.collect()) == DEFAULTS.snippet_chars + 1


def test_frequent_keys_are_spread_without_changing_the_result(spark, rows_of):
    random.seed(2)
    keys = ["hot"] * 300 + [None] * 100 + [f"k{random.randrange(60)}" for _ in range(200)]
    rows = spark.createDataFrame([(at, key) for at, key in enumerate(keys)], "id int, key string")
    table = spark.createDataFrame([("hot", "H")] + [(f"k{at}", f"v{at}") for at in range(0, 60, 2)], "key string, value string")
    joined = lookup_join(rows, table, "key", ["id"], at_least=5, shares=8)
    values = {"hot": "H", **{f"k{at}": f"v{at}" for at in range(0, 60, 2)}}
    assert rows_of(joined, "id", "value", "matched") == [(at, values.get(key), key in values) for at, key in enumerate(keys)]
    for at_least in (5, 100_000):
        joined = bucketed_lookup(rows, lambda used: table.join(used, "key", "left_semi"), "key", ["id"], at_least=at_least, shares=8)
        assert rows_of(joined, "id", "value", "matched") == [(at, values.get(key), key in values) for at, key in enumerate(keys)]


def test_a_written_lookup_is_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, table = spark.range(5000).selectExpr("id", "string(id % 700) as key"), spark.range(900).selectExpr("string(id) as key", "id * 2 as value")
        plan = bucketed_lookup(rows, lambda used: table.join(used, "key", "left_semi"), "key", ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_rank_limit_works_before_the_shuffle(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2)], "key string, n int")
    plan = latest_per_key(frame, "key", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
