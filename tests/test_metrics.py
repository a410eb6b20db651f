import json

from pyspark.sql import functions as F

from plaudit.functions.numbers import exact_mean
from plaudit.operators import categories, metrics, months
from plaudit.plans import charts
from plaudit.sources.exports import coerced


def ratings(spark, rows):
    return spark.createDataFrame(rows, "month string, rating double, source string")


def test_platform_stats_count_unrated_and_leave_the_middle_out(spark, rows_of):
    rows = [("GP", value) for value in ("3.5", "3", "4", "0", "5", None, "x")] + [(None, "5"), ("NA", "1")]
    raw = spark.createDataFrame(rows, "source string, rating_raw string").withColumns(
        {name: F.lit("2026-01-01") for name in ("review_id", "published", "author", "title", "review", "url")})
    stats = metrics.platform_stats(coerced(raw))
    assert rows_of(stats) == [("GP", 7, 3.1, 2, 29, 2, 29)]
    assert metrics.negative_total(coerced(raw)).first()[0] == 3
    total = metrics.export_stats(coerced(raw)).first()
    assert (total.total, total.analysed) == (9, 7)


def test_nothing_rated(spark):
    raw = spark.createDataFrame([("GP", None)], "source string, rating_raw string").withColumns(
        {name: F.lit("junk") for name in ("review_id", "published", "author", "title", "review", "url")})
    assert tuple(metrics.platform_stats(coerced(raw)).first()) == ("GP", 1, None, 0, 0, 0, 0)
    assert metrics.export_stats(coerced(raw)).first().first_ts is None


def test_latest_month_is_taken_over_all_sources(spark, rows_of):
    rated = ratings(spark, [("2026-01", 5.0, "GP"), ("2026-02", 4.0, "BBB"), ("2026-01", 1.0, "GP")])
    assert rows_of(metrics.latest_sentiment(rated)) == [("neg", None, 0), ("pos", None, 0)]
    assert rows_of(metrics.monthly_metrics(rated)) == [("2026-01", 3.0, 1, 1), ("2026-02", None, 0, 0)]
    more = rated.union(ratings(spark, [("2026-02", 5.0, ""), ("2026-02", 3.9, "GP"), ("2026-02", 2.0, "GP")]))
    assert rows_of(metrics.latest_sentiment(more)) == [("neg", 0.67, 2), ("pos", 0.33, 1)]


def test_recent_months(spark, rows_of):
    rated = ratings(spark, [(month, 5.0, "GP") for month in ("2026-01", "2026-03", "2026-02", "2026-03")])
    assert rows_of(months.recent_months(rated, 2)) == [("2026-02",), ("2026-03",)]
    assert rows_of(months.in_recent_months(rated, 2), "month") == [("2026-02",), ("2026-03",), ("2026-03",)]
    single = rated.filter("month = '2026-01'")
    assert months.in_recent_months(single, 2).count() == 1
    assert months.in_recent_months(rated.filter("false"), 2).count() == 0
    # A date that is none gives a month that sorts last and counts as recent.
    junk = rated.union(ratings(spark, [("not a d", 1.0, "GP")]))
    assert rows_of(months.recent_months(junk, 2)) == [("2026-03",), ("not a d",)]


def test_source_breakdown_keeps_blank_and_excluded_sources(spark, rows_of):
    rated = ratings(spark, [("2026-01", 1.0, "GP"), ("2026-02", 5.0, "BBB"), ("2026-02", 4.5, ""), ("2026-03", 2.0, "BBB")])
    assert rows_of(metrics.source_breakdown(rated)) == [
        ("", "2026-02", 4.5, 1), ("BBB", "2026-02", 5.0, 1), ("BBB", "2026-03", 2.0, 1)]


def test_metrics_document(spark):
    rated = ratings(spark, [("2026-01", 5.0, "GP"), ("2026-02", 4.0, "GP"), ("2026-02", 1.0, "iOS"), ("2026-02", 3.0, "BBB")])
    merged = {}
    for row in metrics.metrics_document(rated).collect():
        fragment = json.loads(row.document)
        assert list(fragment) == [row.part] and list(fragment[row.part]) == [row.key]
        merged.setdefault(row.part, {}).update(fragment[row.part])
    assert merged == {
        "months": {"2026-01": {"avg_rating": 5.0, "pos": 1, "neg": 0}, "2026-02": {"avg_rating": 2.5, "pos": 1, "neg": 1}},
        "sentiment_breakdown": {"positive": {"pct": 0.5, "vol": 1}, "negative": {"pct": 0.5, "vol": 1}},
        "source_breakdown": {"BBB": [{"month": "2026-02", "avg_rating": 3.0, "vol": 1}],
                             "GP": [{"month": "2026-01", "avg_rating": 5.0, "vol": 1}, {"month": "2026-02", "avg_rating": 4.0, "vol": 1}],
                             "iOS": [{"month": "2026-02", "avg_rating": 1.0, "vol": 1}]}}


def test_averages_do_not_depend_on_the_layout(spark, rows_of):
    rows = [("2026-01", at % 41 / 10 + 1, "GP") for at in range(20_000)]
    results = {str(rows_of(ratings(spark, rows).repartition(parts).groupBy("month").agg(exact_mean(F.col("rating")).alias("mean"))))
               for parts in (1, 3, 7, 16)}
    assert len(results) == 1
    odd = ratings(spark, [("2026-01", 4.0, "GP"), ("2026-01", 1e300, "GP"), ("2026-01", None, "GP")])
    assert odd.agg(exact_mean(F.col("rating"))).first()[0] == 4.0


def test_two_sources_are_matched_by_month(spark, rows_of):
    rated = ratings(spark, [("2026-01", 5.0, "Google Play"), ("2026-02", 4.0, "iOS App Store"),
                            ("2026-02", 1.0, "iOS App Store"), ("2026-03", 2.0, "BBB")])
    assert rows_of(charts.chart_two_sources(rated), "month", "ios_vol", "ios_rating", "google_play_vol", "google_play_rating") == [
        ("2026-02", 2, 2.5, 0, None), ("2026-03", 0, None, 0, None)]


def counts(spark, rows):
    return spark.createDataFrame(rows, "sentiment string, month string, category string, n long")


def test_category_months(spark, rows_of):
    table = counts(spark, [("pos", "2026-01", "a", 2), ("pos", "2026-02", "b", 3), ("pos", "2026-03", "c", 4), ("neg", "2026-02", "a", 1)])
    assert rows_of(categories.month_pairs(table)) == [
        ("neg", "a", "2026-02", None, 1, 0), ("pos", "a", "2026-01", "2026-02", 2, 0),
        ("pos", "b", "2026-01", "2026-02", 0, 3), ("pos", "c", "2026-01", "2026-02", 0, 0)]
    assert rows_of(categories.category_grid(table)) == [
        ("neg", "a", "2026-02", 1), ("pos", "a", "2026-01", 2), ("pos", "a", "2026-02", 0), ("pos", "a", "2026-03", 0),
        ("pos", "b", "2026-01", 0), ("pos", "b", "2026-02", 3), ("pos", "b", "2026-03", 0),
        ("pos", "c", "2026-01", 0), ("pos", "c", "2026-02", 0), ("pos", "c", "2026-03", 4)]
    assert rows_of(charts.chart_categories(table, "neg")) == [("a", "A", "Feb 2026", 1, None, 0)]


def test_category_pick(spark, rows_of):
    rows = [("a", 0, "x", 71), ("a", 1, "y", 70), ("b", 0, "x", 70), ("b", 1, "y", 60), ("c", 1, "y", 90), ("c", 0, "x", 90)]
    candidates = spark.createDataFrame(rows, "review_id string, ord int, category string, confidence int")
    assert rows_of(categories.pick_category(candidates)) == [("a", "x"), ("b", "other"), ("c", "x")]
    seeded = [rows_of(categories.pick_category(candidates, tie_seed=seed)) for seed in range(12)]
    assert {dict(picks)["c"] for picks in seeded} == {"x", "y"}
    assert seeded[3] == rows_of(categories.pick_category(candidates, tie_seed=3))


def test_category_validity(spark, rows_of):
    rows = spark.createDataFrame([("pos", "good products"), ("neg", "good products"), ("neg", "pricing"), ("pos", None)],
                                 "sentiment string, category string")
    assert rows_of(categories.category_valid(rows)) == [
        ("neg", "good products", False), ("neg", "pricing", True), ("pos", None, False), ("pos", "good products", True)]
