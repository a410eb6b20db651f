import pytest
from pyspark.sql import functions as F

from plaudit.sources.exports import (
    analysable, coerced, rated, rated_text, read_export, rejected_ratings, write_export)
from plaudit.sources.staging import read_staged, write_staged

HEADER = "Review ID, Published ,Author,Source,Rating,Title,Review,URL\n"


def export(folder, *lines, header=HEADER, name="export.csv", bom=True):
    path = folder / name
    path.write_text(("\ufeff" if bom else "") + header + "\n".join(lines) + "\n", encoding="utf-8", newline="")
    return str(path)


DIRTY = (
    'r1,2026-01-02,Ann,BBB,5,N/A,"first line\nsecond ""quoted"" \\ line",http://a',
    "r2,2026-01-03,Bob,Google Play,4.5,None,fine,http://b",
    "r3,2026-01-04,Cy,,5d,t,text,",
    "r4,2026-01-05,Di,NA,abc,t,text,",
    "",
    "r5,2026-01-06,Ed,Trustpilot,nan,t,text,",
    "r6,2026-01-07,Flo,Trustpilot, 5 ,t,\u00a0 ,",
    "r7,2026-01-08,Gus,Trustpilot,1_0,t,NA,",
    'r8,2026-01-09,Hal,Trustpilot,"",t,text,',
    "r9,2026-01-10",
)


def test_tolerant_dialect(spark, tmp_path, rows_of):
    reviews = coerced(read_export(spark, export(tmp_path, *DIRTY)))
    assert rows_of(reviews, "review_id", "rating") == [
        ("r1", 5.0), ("r2", 4.5), ("r3", None), ("r4", None), ("r5", None), ("r6", 5.0), ("r7", None), ("r8", None), ("r9", None)]
    by_id = {row.review_id: row for row in reviews.collect()}
    assert by_id["r1"].title is None and by_id["r2"].title is None
    assert by_id["r1"].review == 'first line\nsecond "quoted" \\ line'
    assert by_id["r3"].source is None and by_id["r4"].source is None and by_id["r7"].review is None
    assert by_id["r9"].review is None and by_id["r9"].published == "2026-01-10"
    assert rows_of(analysable(reviews), "review_id") == [("r1",), ("r2",)]


def test_rejected_ratings(spark, tmp_path, rows_of):
    raw = read_export(spark, export(tmp_path, *DIRTY))
    assert rows_of(rejected_ratings(raw), "review_id") == [("r3",), ("r4",), ("r7",)]


def test_strict_dialect(spark, tmp_path, rows_of):
    lines = (DIRTY[0], "r2,2026-01-03,Bob,NA,4.5,None,  None ,u", 'r8,2026-01-09,Hal,,"",t,text,',
             "r6,2026-01-07,Flo,Trustpilot, 5 ,t,\u00a0 ,", "r9,2026-02-10,Ida,,3,t, ,")
    raw = read_export(spark, export(tmp_path, *lines))
    assert rows_of(rated_text(raw), "review_id", "review", "rating", "month") == [
        ("r1", 'first line\nsecond "quoted" \\ line', 5.0, "2026-01"), ("r2", "None", 4.5, "2026-01")]
    assert rows_of(rated(raw)) == [("2026-01", 4.5, "NA"), ("2026-01", 5.0, "BBB"), ("2026-01", 5.0, "Trustpilot"),
                                   ("2026-02", 3.0, "")]


def test_strict_dialect_fails_on_bad_ratings(spark, tmp_path):
    raw = read_export(spark, export(tmp_path, "r1,2026-01-02,A,B,abc,t,text,u"))
    for strict in (rated_text, rated):
        with pytest.raises(Exception, match="rating is not a number: abc"):
            strict(raw).collect()
    # Without a text the rating is not parsed; the ratings-only rows parse it all the same.
    raw = read_export(spark, export(tmp_path, "r1,2026-01-02,A,B,abc,t, ,u", name="blank.csv"))
    assert rated_text(raw).collect() == []
    with pytest.raises(Exception, match="rating is not a number"):
        rated(raw).collect()


def test_junk_months_can_be_left_out(spark, tmp_path, rows_of):
    raw = read_export(spark, export(tmp_path, "r1,2026-01-02,A,B,4,t,text,u", "r2,not a date,A,B,4,t,text,u", "r3,,A,B,4,t,text,u"))
    for strict in (rated, rated_text):
        assert rows_of(strict(raw), "month") == [("",), ("2026-01",), ("not a d",)]
        assert rows_of(strict(raw, validate_month=True), "month") == [("2026-01",)]


def test_columns_go_by_name_and_files_must_agree(spark, tmp_path, rows_of):
    swapped = "Published,Review ID,Author,Source,Rating,Title,Review,URL,Extra\n"
    path = export(tmp_path, "2026-01-02,r1,A,B,4,t,text,u,x", header=swapped, bom=False)
    assert rows_of(read_export(spark, path), "review_id", "published") == [("r1", "2026-01-02")]
    other = export(tmp_path, "r2,2026-01-02,A,B,4,t,text,u", name="other.csv")
    with pytest.raises(Exception, match="CSV header"):
        read_export(spark, [path, other]).collect()


def test_written_exports_read_back_unchanged(spark, tmp_path, rows_of):
    texts = ['a "b" c', " lead", "trail ", "line\nbreak", "back\\slash", "comma, semi;", "\ttab", "\r\nreturn", "'", '"']
    raw = spark.createDataFrame([(f"r{at}", text) for at, text in enumerate(texts)], "review_id string, review string")
    for name in ("published", "author", "source", "rating_raw", "title", "url"):
        raw = raw.withColumn(name, F.lit("x"))
    write_export(raw, str(tmp_path / "out"))
    assert rows_of(read_export(spark, str(tmp_path / "out")), "review_id", "review") == rows_of(raw, "review_id", "review")


def test_staged_reviews_equal_the_export(spark, tmp_path, rows_of):
    lines = [*DIRTY, "r10,,Ida,BBB,3,t,NA,u"]
    raw = read_export(spark, export(tmp_path, *lines))
    write_staged(raw, str(tmp_path / "staged"))
    staged = read_staged(spark, str(tmp_path / "staged"))
    assert rows_of(coerced(staged).drop("known_text")) == rows_of(coerced(raw))
    assert rows_of(analysable(coerced(staged)), "review_id") == rows_of(analysable(coerced(raw)), "review_id")
    valid = "review_id in ('r1', 'r2', 'r6', 'r8', 'r9', 'r10')"
    for strict in (rated, rated_text):
        assert rows_of(strict(staged.filter(valid))) == rows_of(strict(raw.filter(valid)))


def scans(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.split("FileScan parquet")[1:]


def test_staged_reviews_prune_months_and_texts(spark, tmp_path, rows_of):
    from plaudit.operators.batching import bucket_counts, bucket_reviews

    lines = [f"r{at},2026-0{1 + at % 4}-02,A,B,{at % 5 + 1},t,text {at},u" for at in range(40)]
    raw = read_export(spark, export(tmp_path, *lines))
    write_staged(raw, str(tmp_path / "staged"))
    staged = read_staged(spark, str(tmp_path / "staged"))
    assert dict(staged.dtypes)["month"] == "string"
    buckets = bucket_reviews(rated_text(staged))
    assert rows_of(buckets) == rows_of(bucket_reviews(rated_text(raw)))
    assert {row.month for row in buckets.collect()} == {"2026-03", "2026-04"}
    assert any("PartitionFilters: [(coalesce(month" in scan for scan in scans(buckets))
    counting = scans(bucket_counts(buckets))
    assert counting and not any("review:string" in scan for scan in counting)
