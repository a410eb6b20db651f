"""Nested JSON documents: categorised reviews and metrics, plus text and message output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CATEGORISED = "map<string,array<struct<review_id:string,category:string>>>"
CATEGORISED_DOCUMENT = f"pos {CATEGORISED}, neg {CATEGORISED}"


def read_categorised(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``(sentiment, month, item_no, review_id, category)`` of ``{"pos": {month: [...]}, "neg": ...}``.

    ``multi_line`` reads one document per file; without it, one per line as ``write_lines`` leaves them.
    """
    documents = spark.read.schema(CATEGORISED_DOCUMENT).json(path, multiLine=multi_line)
    return explode_document(documents)


def explode_document(documents: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(side).alias("sentiment"), F.col(side).alias("months"))
                      for side in ("pos", "neg")])
    return (documents.select(F.inline(sides))
            .select("sentiment", F.explode("months").alias("month", "rows"))
            .select("sentiment", "month", F.posexplode("rows").alias("item_no", "row"))
            .select("sentiment", "month", "item_no", "row.review_id", "row.category"))


def month_map(rows):
    """``map<month, array<struct>>`` of an array of structs ``(month, row)`` already in order."""
    months = F.array_distinct(F.transform(rows, lambda entry: entry["month"]))
    return F.map_from_entries(F.transform(months, lambda month: F.struct(
        month,
        F.transform(F.filter(rows, lambda entry: entry["month"] == month), lambda entry: entry["row"]))))


def categorised_document(categorised: DataFrame) -> DataFrame:
    """JSON fragments ``(sentiment, batch_no, document)``, one per batch of at most a batch size.

    ``categorised`` has ``sentiment, batch_no, row_no, month, review_id, category``. The fragments of
    one export merge to the reference's single document, which would not fit a row at scale.
    """
    entry = F.struct("row_no", "month", F.struct("review_id", "category").alias("row"))
    batches = (categorised.groupBy("sentiment", "batch_no")
               .agg(F.array_sort(F.collect_list(entry)).alias("rows")))
    body = F.map_from_arrays(F.array("sentiment"), F.array(month_map(F.col("rows"))))
    return batches.select("sentiment", "batch_no", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def write_lines(lines: DataFrame, column: str, path: str, order: list[str], mode: str = "error") -> None:
    """Text files in order: a range-partitioned sort, so no single task holds all lines."""
    lines.orderBy(*order).select(column).write.mode(mode).text(path)


def write_messages(messages: DataFrame, path: str, mode: str = "error") -> None:
    """Message rows as JSON lines in posting order, for whatever delivers them."""
    (messages.orderBy("group_ord", "item_ord")
     .write.mode(mode).option("ignoreNullFields", "false").json(path))
