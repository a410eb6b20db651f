"""Connected components of a graph given as a table of edges, by contraction.

Every round maps each node to the neighbour (or itself) of least random rank, follows that map twice,
renames the ends of the edges and drops loops and repeats. Ranks change from round to round, so
paths shrink by a constant share as well. Each round is a written table, so nothing is computed
again and a lost executor costs one round; nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.llm.common import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``id, root`` for every node of ``edges (a, b)``; equal roots for connected nodes.

    Loops and repeated edges are allowed; no edges give no rows.
    """
    both = edges.select("a", "b").where("a <> b").distinct()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    left, names = written(spark, both, "edges"), written(spark, nodes.select("id", F.col("id").alias("root")), "names")
    turn = 0
    while not left.isEmpty():
        turn += 1

        def rank(column: str):
            return F.struct(F.xxhash64(column, F.lit(turn)), F.col(column).alias("id"))

        ends = left.union(left.select("b", "a")).toDF("node", "other")
        parent = written(spark, ends.groupBy("node").agg(F.min(rank("other")).alias("best")).select(
            "node", F.when(F.col("best") < rank("node"), F.col("best.id")).otherwise(F.col("node")).alias("parent")), "parents")
        # Parents have lesser ranks, so following the map from parent to parent ends without a cycle.
        up = parent.toDF("parent", "grandparent")
        parent = parent.join(up, "parent").select("node", F.col("grandparent").alias("parent"))
        parent = written(spark, parent, "parents")
        for end in ("a", "b"):
            left = (left.join(parent.withColumnRenamed("node", end), end)
                    .select(F.col("parent").alias(end), "b" if end == "a" else "a"))
        left = written(spark, left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        names = written(spark, names.join(parent.withColumnRenamed("node", "root"), "root", "left")
                        .select("id", F.coalesce("parent", "root").alias("root")), "names")
    return names
