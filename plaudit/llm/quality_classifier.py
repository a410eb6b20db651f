"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel over the statistics of ``text_stats``. Their normal
equations are summed partition by partition and fold by fold, so one pass over the labelled rows gives
the final weights and, from all folds but one, a score for every labelled row that its own label had no
part in. These scores are calibrated by isotonic regression over bins.

Only a sample of the labelled rows is used to fit, of about ``FitOptions.max_rows`` rows; every
document is scored, on its whole text, in one pass without a shuffle.

Cases: a null text counts as empty; an empty text is scored as any other; rows without a label, with a
null label or a null id are scored, not learnt from; a repeated row is scored as often as it stands
there; a document with contradicting labels counts with their mean. Without any usable label all
scores are 0.5, which keeps all documents. Further columns are passed through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plaudit.llm.common import crc_fold, documents, fresh_name, labels, one_per_id, sample_of, texts_of, written
from plaudit.llm.text_stats import SHAPES, matrix, statistics, statistics_of

HELD_OUT_FOLDS = 5
KEEP_FROM = 0.3


@dataclass(frozen=True)
class FitOptions:
    max_rows: int = 20_000          # labelled documents to learn from, at most about so many
    n_features: int = 256           # random Fourier features
    width: float = 4.0              # of the kernel, in standard deviations of a statistic
    ridge: float = 1e-3             # per labelled row
    folds: int = 4                  # for the scores that calibrate
    bins: int = 512                 # of raw scores, for the isotonic step
    partitions: int = 16            # that sum normal equations
    seed: int = 20240607


@dataclass
class QualityModel:
    """Weights and calibration; a few hundred kilobytes whatever the data."""
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    raw_points: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    scores: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def features(self, values: np.ndarray) -> np.ndarray:
        """One column of ones and the Fourier features of standardised statistics."""
        clipped = np.clip((values - self.centre) / self.scale, -6, 6)
        waves = np.cos(clipped @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(values), 1)), waves])

    def raw(self, values: np.ndarray) -> np.ndarray:
        return self.features(values) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(values):
            return np.full(len(values), 0.5)
        return np.clip(np.interp(self.raw(values), self.raw_points, self.scores), 0, 1)


def isotonic(points: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the blocks that pooling adjacent violators leaves, points ascending."""
    blocks: list[list[float]] = []
    for point, count, total in zip(points, counts, sums):
        blocks.append([point * count, count, total])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return (np.array([block[0] / block[1] for block in blocks]), np.array([block[2] / block[1] for block in blocks]))


def labelled_statistics(docs: DataFrame, marks: DataFrame, options: FitOptions) -> DataFrame:
    """fold, label and statistics of the documents to learn from: at most about ``max_rows`` small rows, one per id."""
    usable = (marks.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .where(crc_fold("doc_id", HELD_OUT_FOLDS) != 0)
              .groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label")))
    chosen = sample_of(usable, "doc_id", options.max_rows)
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows small rows
            .select("doc_id", "text", "label", F.xxhash64("text").alias("tie"),
                    F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(options.folds)).alias("fold")))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(stats=list(matrix(statistics(texts_of(batch["text"])))))

    found = rows.mapInPandas(measured, "doc_id long, label double, tie long, fold long, stats array<double>")
    return one_per_id(found, ["fold", "label", "stats"]).drop("doc_id")


def fit(spark: SparkSession, docs: DataFrame, marks: DataFrame, options: FitOptions = FitOptions()) -> QualityModel:
    rng = np.random.default_rng(options.seed)
    width = len(SHAPES)
    model = QualityModel(np.zeros(width), np.ones(width),
                         rng.normal(size=(width, options.n_features)) / options.width,
                         rng.uniform(0, 2 * np.pi, options.n_features))
    table = written(spark, labelled_statistics(docs, marks, options), "quality-statistics")
    moments = table.agg(F.count("*").alias("n"), *(F.avg(F.col("stats")[at]).alias(f"m{at}") for at in range(width)),
                        *(F.stddev_pop(F.col("stats")[at]).alias(f"s{at}") for at in range(width))).first()
    if not moments["n"]:
        return model
    model.centre = np.array([moments[f"m{at}"] for at in range(width)])
    model.scale = np.maximum([moments[f"s{at}"] for at in range(width)], 1e-3)

    size = options.n_features + 2  # the last column is the label

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, rows in batch.groupby("fold"):
                full = np.hstack([model.features(np.stack(rows["stats"])), rows[["label"]].to_numpy()])
                sums[fold] = sums.get(fold, 0) + full.T @ full
        for fold, total in sums.items():
            yield pd.DataFrame({"fold": fold, "line": np.arange(size), "sums": list(total)})

    def added(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": batch["fold"][:1], "line": batch["line"][:1], "sums": [np.sum(list(batch["sums"]), axis=0)]})

    schema = "fold long, line long, sums array<double>"
    spread = table.repartition(options.partitions)  # bounds the number of partial sums
    totals = spread.mapInPandas(summed, schema).groupBy("fold", "line").applyInPandas(added, schema).collect()
    by_fold: dict[int, np.ndarray] = {}
    for row in totals:  # folds x features lines, whatever the data
        by_fold.setdefault(row["fold"], np.zeros((size, size)))[row["line"]] = row["sums"]
    everything = sum(by_fold.values())

    def solved(total: np.ndarray) -> np.ndarray:
        penalty = options.ridge * max(total[0, 0], 1) * np.eye(size - 1)
        penalty[0, 0] = 1e-9
        return np.linalg.solve(total[:-1, :-1] + penalty, total[:-1, -1])

    model.weights = solved(everything)
    without = {fold: solved(everything - total) if len(by_fold) > 1 else model.weights for fold, total in by_fold.items()}
    bins = options.bins

    def cross_scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = model.features(np.stack(batch["stats"])) if len(batch) else np.zeros((0, size - 1))
            raw = np.array([value @ without[fold] for value, fold in zip(values, batch["fold"])])
            yield pd.DataFrame({"bin": np.clip(np.floor((raw + 0.5) * bins / 2), 0, bins - 1).astype(np.int64),
                                "raw": raw, "label": batch["label"]})

    binned = (table.mapInPandas(cross_scored, "bin long, raw double, label double").groupBy("bin")
              .agg(F.avg("raw").alias("raw"), F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect())
    model.raw_points, model.scores = isotonic(*(np.array([row[name] for row in binned], float) for name in ("raw", "n", "good")))
    return model


def scored(docs: DataFrame, model: QualityModel, column: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score as a new ``column``, row by row."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(matrix(statistics_of(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, options: FitOptions = FitOptions()) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    column = fresh_name(docs, "quality_score")
    return scored(docs, fit(spark, docs, labels(spark, sf_dir), options), column).where(F.col(column) >= KEEP_FROM).drop(column)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(spark, docs, labels(spark, sf_dir))
    return scored(docs, model).select(
        "doc_id", F.coalesce(crc_fold("doc_id", HELD_OUT_FOLDS) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP_FROM).cast("int").alias("predicted"))
