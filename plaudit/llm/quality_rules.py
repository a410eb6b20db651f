"""Quality rules: fixed limits on words and repeats, then an isolation forest on rule statistics.

A tree isolates a point by random splits of one statistic after another; rows in sparse regions have short
paths. The splits lie inside the box spanned by all labelled rows, so that regions only unclean texts reach are
empty and isolate at once. Random splits need no rows: all trees are split to the full depth first, every clean
labelled row is counted in its leaf of every tree, and a branch ends where the clean rows in it are few enough to count
as one of ``subsample``. The limit on the anomaly value comes from all labelled rows: the one with the best difference
between the unclean rows caught and the clean rows lost, among those that lose at most ``max_clean_loss`` of the clean ones.

Statistics are computed before they are joined to labels, so that no text is shuffled; box, leaves and limit are
aggregates of a size that the options fix. Every document is judged, on its whole text.

Cases: a null or empty text has no words, so it fails the base rules; a repeated row is judged as often as
it stands there; rows with a null id or label are judged, not learnt from; several labels of one document count with
their minimum. Without clean labelled rows there is no forest and the base rules decide alone.
Further columns are passed through by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plaudit.llm.common import documents, fresh_name, labels, one_per_id, written
from plaudit.llm.text_stats import SHAPES, matrix, statistics_of

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30


@dataclass(frozen=True)
class ForestOptions:
    trees: int = 128
    subsample: int = 256            # rows a tree is grown for; a branch with this share of all clean rows holds one
    max_depth: int = 10
    max_clean_loss: float = 0.005
    margin: float = 0.1             # the box of splits reaches this share beyond the labelled rows
    limits: int = 1 << 16           # steps of the anomaly value between which a limit is sought
    seed: int = 20240611


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth at which a search in a random tree of ``n`` points ends."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """All trees as arrays: statistic and split value of a node, its left child (the right one follows), path length of a leaf."""
    roots: np.ndarray
    statistic: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    subsample: int
    limit: float = np.inf

    def anomaly(self, values: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): towards 1 for rows that isolate early."""
        total = np.zeros(len(values))
        at_row = np.arange(len(values))
        for root in self.roots:
            node = np.full(len(values), root)
            while (inner := self.child[node] >= 0).any():
                right = values[at_row, self.statistic[node]] >= self.split[node]
                node = np.where(inner, self.child[node] + right, node)
            total += self.path[node]
        return 2.0 ** (-total / len(self.roots) / max(float(average_path(self.subsample)), 1e-9))


class Splits:
    """Random splits of a box by all trees to the full depth; the nodes of a tree stand level by level."""

    def __init__(self, low: np.ndarray, high: np.ndarray, options: ForestOptions) -> None:
        rng = np.random.default_rng(options.seed)
        reach = options.margin * (high - low)
        low, high = low - reach, high + reach
        movable = np.flatnonzero(high > low)
        self.options, self.depth = options, options.max_depth if len(movable) else 0
        shape = (options.trees, (1 << self.depth) - 1)
        self.statistic, self.split = np.zeros(shape, np.int64), np.zeros(shape)
        floor, ceiling = (np.broadcast_to(edge, (options.trees, 1, len(low))) for edge in (low, high))
        for level in range(self.depth):
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            which = rng.choice(movable, (options.trees, 1 << level))
            at = which[:, :, None]
            value = rng.uniform(np.take_along_axis(floor, at, 2), np.take_along_axis(ceiling, at, 2))
            self.statistic[:, nodes], self.split[:, nodes] = which, value[:, :, 0]
            floor, ceiling = np.repeat(floor, 2, axis=1), np.repeat(ceiling, 2, axis=1)
            np.put_along_axis(ceiling[:, 0::2], at, value, 2)
            np.put_along_axis(floor[:, 1::2], at, value, 2)

    def leaf_counts(self, values: np.ndarray) -> np.ndarray:
        """How many rows end in each leaf of each tree."""
        counts = np.zeros((self.options.trees, 1 << self.depth), np.int64)
        at_row = np.arange(len(values))
        for tree, (statistic, split) in enumerate(zip(self.statistic, self.split)):
            node = np.zeros(len(values), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (values[at_row, statistic[node]] >= split[node])
            counts[tree] = np.bincount(node - ((1 << self.depth) - 1), minlength=1 << self.depth)
        return counts

    def forest(self, counts: np.ndarray) -> Forest:
        """The trees up to the nodes that the clean rows, counted by leaf, hardly reach."""
        trees, total = len(counts), int(counts[0].sum())
        size = min(self.options.subsample, total)
        levels = [counts]
        while levels[0].shape[1] > 1:
            levels.insert(0, levels[0].reshape(trees, -1, 2).sum(axis=2))
        held = np.concatenate(levels, axis=1) * (size / total)       # of ``size`` rows, how many a node holds on average
        inner = (held > 1) & (np.arange(held.shape[1]) < self.split.shape[1])
        there = np.ones_like(inner)
        for level in range(self.depth):
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            inner[:, nodes] &= there[:, nodes]
            there[:, nodes.stop:2 * nodes.stop + 1] = np.repeat(inner[:, nodes], 2, axis=1)
        number = np.cumsum(there).reshape(there.shape) - 1
        tree, node = np.nonzero(there)
        is_inner = inner[tree, node]
        statistic, split, child = np.zeros(len(node), np.int64), np.zeros(len(node)), np.full(len(node), -1)
        own = tree[is_inner], node[is_inner]
        statistic[is_inner], split[is_inner], child[is_inner] = self.statistic[own], self.split[own], number[own[0], 2 * own[1] + 1]
        depth = np.repeat(np.arange(self.depth + 1), 1 << np.arange(self.depth + 1))[node]
        path = np.where(is_inner, 0.0, depth + average_path(np.rint(held[tree, node])))
        return Forest(number[:, 0].copy(), statistic, split, child, path, size)


def grow(clean: np.ndarray, everything: np.ndarray, options: ForestOptions) -> Forest:
    """The forest of rows at hand, without a limit."""
    splits = Splits(everything.min(axis=0), everything.max(axis=0), options)
    return splits.forest(splits.leaf_counts(clean))


def calibrated_limit(least: np.ndarray, most: np.ndarray, clean: np.ndarray, unclean: np.ndarray, max_clean_loss: float) -> float:
    """The anomaly value from which a row is rejected; without unclean rows, one that loses no clean row.

    Rows come as groups of ascending values: the least and most in each, and how many clean and unclean rows there are.
    """
    if not unclean.sum():
        return float(most[-1]) + 0.02
    limits = np.r_[(least[1:] + most[:-1]) / 2, most[-1] + 1e-6]
    lost = 1 - np.cumsum(clean) / clean.sum()
    caught = 1 - np.cumsum(unclean) / unclean.sum()
    allowed = lost <= max_clean_loss
    return float(limits[allowed][np.argmax((caught - lost)[allowed])])


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEATED_PERCENT * stats["n_words"])


KINDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
         "base_failed": pa.bool_(), "anomaly": pa.float64(), "kept": pa.bool_()}
RESULT = (T.StructType().add("n_words", "long").add("word_chars", "long").add("n_symbols", "long").add("n_dup_lines", "long")
          .add("n_repeat_words", "long").add("base_failed", "boolean").add("anomaly", "double").add("kept", "boolean"))
MEASURED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
STATISTICS = "doc_id long, tie long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, stats array<double>"


def verdicts(found: dict[str, np.ndarray], values: np.ndarray, forest: Forest | None) -> dict[str, np.ndarray]:
    """Anomaly and verdict of rows with the given counts and the matrix of their statistics."""
    failed = found["base_failed"]
    anomaly = forest.anomaly(values) if forest and len(failed) else np.zeros(len(failed))
    return found | {"anomaly": anomaly, "kept": ~failed & (anomaly < (forest.limit if forest else np.inf))}


def measured(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts and statistics of all documents, a few numbers for each text, written."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics_of(batch.column("text"))
            stats["base_failed"] = base_failed(stats)
            values = matrix(stats)
            shapes = pa.ListArray.from_arrays(np.arange(0, values.size + 1, len(SHAPES), dtype=np.int32), pa.array(values.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("tie"), *(pa.array(stats[name], KINDS[name]) for name in MEASURED), shapes],
                ["doc_id", "tie", *MEASURED, "stats"])

    return written(spark, docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(measure, STATISTICS), "rule-statistics")


def fit_on(spark: SparkSession, table: DataFrame, marks: DataFrame, options: ForestOptions = ForestOptions()) -> Forest | None:
    """The forest of all labelled documents among those ``measured``, each id once."""
    usable = (marks.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").cast("double").alias("label")))
    known = written(spark, one_per_id(table.join(usable, "doc_id"), ["label", "stats", "base_failed"])
                    .where("not base_failed").select((F.col("label") > 0).alias("clean"), "stats"), "labelled-statistics")
    box = known.agg(F.count_if("clean").alias("n"), *(F.min(F.col("stats")[at]).alias(f"low{at}") for at in range(len(SHAPES))),
                    *(F.max(F.col("stats")[at]).alias(f"high{at}") for at in range(len(SHAPES)))).first()
    if not box["n"]:
        return None
    splits = Splits(*(np.array([box[f"{edge}{at}"] for at in range(len(SHAPES))]) for edge in ("low", "high")), options)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sum(splits.leaf_counts(np.stack(batch["stats"])) for batch in batches if len(batch))
        if not isinstance(counts, int):
            tree, leaf = np.nonzero(counts)
            yield pd.DataFrame({"tree": tree, "leaf": leaf, "n": counts[tree, leaf]})

    leaves = (known.where("clean").select("stats").mapInPandas(counted, "tree int, leaf int, n long")
              .groupBy("tree", "leaf").agg(F.sum("n").alias("n")).toPandas())  # at most trees x 2 ** max_depth rows, whatever the data
    counts = np.zeros((options.trees, 1 << splits.depth), np.int64)
    counts[leaves["tree"], leaves["leaf"]] = leaves["n"]
    forest = splits.forest(counts)

    def valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"clean": batch["clean"], "value": forest.anomaly(np.stack(batch["stats"])) if len(batch) else np.zeros(0)})

    steps = (known.mapInPandas(valued, "clean boolean, value double").groupBy(F.floor(F.col("value") * options.limits).alias("step"))
             .agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count_if("clean").alias("clean"),
                  F.count_if(~F.col("clean")).alias("unclean")).orderBy("step").toPandas())  # at most ``limits`` rows
    forest.limit = calibrated_limit(*(steps[name].to_numpy() for name in ("least", "most", "clean", "unclean")), options.max_clean_loss)
    return forest


def fit(spark: SparkSession, docs: DataFrame, marks: DataFrame, options: ForestOptions = ForestOptions()) -> Forest | None:
    return fit_on(spark, measured(spark, docs), marks, options)


def judged(docs: DataFrame, forest: Forest | None, column: str = "rules") -> DataFrame:
    """All columns of ``docs`` and a new struct ``column`` with counts and verdict, row by row."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics_of(batch.column("text"))
            found = verdicts({"base_failed": base_failed(stats)} | {name: stats[name] for name in MEASURED if name in stats}, matrix(stats), forest)
            rules = pa.StructArray.from_arrays([pa.array(found[name], kind) for name, kind in KINDS.items()], list(KINDS))
            yield pa.RecordBatch.from_arrays([*batch.columns, rules], [*batch.schema.names, column])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField(column, RESULT)]))


def judged_by_statistics(table: DataFrame, forest: Forest | None) -> DataFrame:
    """``doc_id`` and the columns of ``RESULT`` of documents that are ``measured``."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in MEASURED}
            values = batch.column("stats").flatten().to_numpy().reshape(-1, len(SHAPES))
            found = verdicts(counts, values, forest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[name], kind) for name, kind in KINDS.items())], ["doc_id", *KINDS])

    return table.select("doc_id", *MEASURED, "stats").mapInArrow(judge, T.StructType([table.schema["doc_id"], *RESULT.fields]))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str, options: ForestOptions = ForestOptions()) -> DataFrame:
    """The documents that the rules do not reject, with their columns."""
    column = fresh_name(docs, "rules")
    return judged(docs, fit(spark, docs, labels(spark, sf_dir), options), column).where(F.col(column)["kept"]).drop(column)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = measured(spark, documents(spark, sf_dir))
    return judged_by_statistics(table, fit_on(spark, table, labels(spark, sf_dir)))
