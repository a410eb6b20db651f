"""Left joins to a table of unique keys that stay balanced when some keys are very frequent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.sources.staging import written, written_buckets


def latest_per_key(rows: DataFrame, key: str, latest: list[str | Column]) -> DataFrame:
    """One row per key, the first in ``latest`` order.

    The rank limit is applied before the shuffle as well, so copies of one key do not pile up.
    """
    position = Window.partitionBy(key).orderBy(*latest)
    return rows.withColumn("nth", F.row_number().over(position)).filter("nth = 1").drop("nth")


def lookup_join(rows: DataFrame, table: DataFrame, key: str, spread: list[str],
                at_least: int = 100_000, shares: int = 1_000) -> DataFrame:
    """``rows`` left join ``table`` on ``key``, with ``matched``; ``table`` has a key once.

    The keys of ``rows`` are counted first and the table is reduced to them. A key is frequent if it has
    ``at_least`` rows and one of ``shares`` equal shares of all rows; so there are ``shares`` such keys at
    most, and their list is small enough to be sent to all tasks. Rows of a frequent key, and rows without a
    key, are spread over salts by the columns ``spread``, as many salts as the key has shares; the
    table's row of the key is repeated once per salt.
    """
    known = rows.filter(F.col(key).isNotNull())
    counts = known.groupBy(key).agg(F.count("*").alias("uses"))
    share = F.greatest(F.ceil(known.agg(F.count("*")).scalar() / shares), F.lit(at_least))
    sized = counts.withColumn("salts", F.when(F.col("uses") >= share, F.ceil(F.col("uses") / share) + 1).otherwise(F.lit(1)))
    frequent = sized.filter("salts > 1").select(key, "salts")
    none = F.lit(0).cast("long")
    salts = F.coalesce("salts", F.when(F.col(key).isNull(), F.lit(shares)), F.lit(1))
    salted = rows.join(F.broadcast(frequent), key, "left").withColumn(
        "salt", F.pmod(F.xxhash64(*spread), salts.cast("long"))).drop("salts")
    repeated = table.join(sized, key).withColumn(
        "salt", F.explode(F.sequence(none, (F.col("salts") - 1).cast("long")))).drop("uses", "salts")
    return (salted.join(repeated.withColumn("matched", F.lit(True)), [key, "salt"], "left")
            .withColumn("matched", F.coalesce("matched", F.lit(False))).drop("salt"))


def bucketed_lookup(rows: DataFrame, table_of: Callable[[DataFrame], DataFrame], key: str, spread: list[str],
                    at_least: int = 100_000, shares: int = 1_000) -> DataFrame:
    """``rows`` left join a table that is made for the keys in use, with ``matched``; both are read once.

    ``table_of`` gets the distinct keys of ``rows`` and returns the table, a row per key at most. It is written in buckets by
    key, so the join shuffles the rows alone. The rows of the few frequent keys (see ``lookup_join``) take theirs from
    a copy of these table rows that is sent to all tasks, ``shares`` at most; they and rows without a key are spread by the columns ``spread``.
    """
    spark = rows.sparkSession
    uses = written(spark, rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("uses")), "uses")
    table = written_buckets(spark, table_of(uses.select(key)).withColumn("matched", F.lit(True)), "lookup", key)
    values = [name for name in table.columns if name != key]
    limit = max(at_least, -(-(uses.agg(F.sum("uses")).first()[0] or 0) // shares))
    frequent = uses.filter(F.col("uses") >= limit).select(key)
    hot = None
    if not frequent.isEmpty():
        few = table.join(F.broadcast(frequent), key).select(key, F.struct(*values).alias("hot"))
        rows = rows.join(F.broadcast(few), key, "left")
        hot = F.col("hot")
    spread_key = F.concat(F.lit("\0"), F.md5(F.concat_ws("\x1f", *(F.col(name).cast("string") for name in spread))))
    known = F.col(key) if hot is None else F.when(hot.isNull(), F.col(key))
    found = (rows.withColumn("at_key", F.coalesce(known.cast("string"), spread_key))
             .join(table.withColumnRenamed(key, "at_key"), "at_key", "left").drop("at_key"))
    if hot is not None:
        found = found.withColumns({name: F.coalesce(F.col(name), hot[name]) for name in values}).drop("hot")
    return found.withColumn("matched", F.coalesce("matched", F.lit(False)))
