"""Language identification by a byte convolutional network, trained and applied with numpy.

A text is cut into windows of fixed length (zero-padded at its end). Bytes are embedded, filters of several widths
slide over them, each filter keeps its maximum over the window, and a softmax over these gives the
languages. A document has the mean of the probabilities of all its windows, so whole texts count.

For prediction the trained filters are turned into tables over single bytes and pairs of bytes, so a
window costs a few table lookups per byte.

The network is trained in the driver on windows of a sample of about ``TrainOptions.max_documents``
documents, at most ``windows_each`` of each, spread over its whole text; all documents are predicted.

Cases: null texts and texts without a letter are ``und`` with score 0, as is everything when no row can be
learnt from; rows with null language or id are predicted, not learnt from; repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.llm.common import chunks, crc_fold, documents, one_per_id, texts_of

HELD_OUT_FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"


@dataclass(frozen=True)
class TrainOptions:
    max_documents: int = 3_000
    least_documents: int = 100      # of each language, where there are as many
    windows_each: int = 4
    window: int = 256               # bytes
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16               # of each width
    epochs: int = 4
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


def windows_of(data: bytes, window: int) -> np.ndarray:
    """All windows of a text as rows of bytes; an empty text has one of zeros."""
    n = max(1, -(-len(data) // window))
    out = np.zeros(n * window, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, window)


class ByteNetwork:
    def __init__(self, languages: list[str], options: TrainOptions) -> None:
        rng = np.random.default_rng(options.seed)
        self.languages, self.options = languages, options
        self.values = {"embedding": rng.normal(0, 0.5, (256, options.embedding)),
                       "out": rng.normal(0, 0.1, (len(options.widths) * options.filters, len(languages))), "bias": np.zeros(len(languages))}
        for width in options.widths:
            fan = width * options.embedding
            self.values[f"w{width}"] = rng.normal(0, np.sqrt(2 / fan), (fan, options.filters))
            self.values[f"b{width}"] = np.zeros(options.filters)
        self.values = {name: value.astype(np.float32) for name, value in self.values.items()}

    def _slides(self, windows: np.ndarray, width: int) -> np.ndarray:
        """Bytes under a filter at each place: (windows, places, width)."""
        return np.lib.stride_tricks.sliding_window_view(windows, width, axis=1)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; only the place of each maximum takes part."""
        values, options, n = self.values, self.options, len(windows)
        each, pooled, seen = np.arange(n)[:, None], [], []
        for width in options.widths:
            under = self._slides(windows, width)
            inputs = values["embedding"][under].reshape(n, under.shape[1], -1)
            response = inputs @ values[f"w{width}"] + values[f"b{width}"]
            best = response.argmax(axis=1)
            pooled.append(np.take_along_axis(response, best[:, None, :], axis=1)[:, 0, :])
            seen.append((under[each, best], inputs[each, best]))        # (windows, filters, width), (windows, filters, fan)
        features = np.maximum(np.hstack(pooled), 0)
        error = self.softmax(features @ values["out"] + values["bias"])
        error[np.arange(n), target] -= 1
        error /= n
        slopes = {"out": features.T @ error, "bias": error.sum(axis=0), "embedding": np.zeros_like(values["embedding"])}
        back = (error @ values["out"].T) * (features > 0)
        for at, width in enumerate(options.widths):
            pull = back[:, at * options.filters:(at + 1) * options.filters]
            under, inputs = seen[at]
            slopes[f"w{width}"] = np.einsum("nf,nfk->kf", pull, inputs)
            slopes[f"b{width}"] = pull.sum(axis=0)
            down = (pull[:, :, None] * values[f"w{width}"].T[None]).reshape(n, options.filters, width, -1)
            np.add.at(slopes["embedding"], under.ravel(), down.reshape(-1, options.embedding))
        return slopes

    def train(self, windows: np.ndarray, target: np.ndarray) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(self.options.seed)
        first = {name: np.zeros_like(value) for name, value in self.values.items()}
        second = {name: np.zeros_like(value) for name, value in self.values.items()}
        total, turn = self.options.epochs * -(-len(windows) // self.options.batch), 0
        for _ in range(self.options.epochs):
            order = rng.permutation(len(windows))
            for begin in range(0, len(order), self.options.batch):
                rows = order[begin:begin + self.options.batch]
                turn += 1
                rate = self.options.rate * (1 - 0.9 * turn / total)
                for name, slope in self.gradients(windows[rows], target[rows]).items():
                    first[name] = 0.9 * first[name] + 0.1 * slope
                    second[name] = 0.99 * second[name] + 0.01 * slope**2
                    step = rate * (first[name] / (1 - 0.9**turn)) / (np.sqrt(second[name] / (1 - 0.99**turn)) + 1e-8)
                    self.values[name] = (self.values[name] - step).astype(np.float32)

    @staticmethod
    def softmax(values: np.ndarray) -> np.ndarray:
        values = np.exp(values - values.max(axis=1, keepdims=True))
        return values / values.sum(axis=1, keepdims=True)

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Per width: tables over the pairs of bytes (and a last single byte) under the filter, with their places."""
        out = {}
        for width in self.options.widths:
            weights = self.values[f"w{width}"].reshape(width, self.options.embedding, self.options.filters)
            single = [self.values["embedding"] @ weights[at] for at in range(width)]
            single[0] = single[0] + self.values[f"b{width}"]
            out[width] = [(at, (single[at][:, None, :] + single[at + 1][None]).reshape(65536, -1).astype(np.float32))
                          if at + 1 < width else (at, single[at].astype(np.float32)) for at in range(0, width, 2)]
        return out

    def probabilities(self, windows: np.ndarray, tables: dict, step: int = 256) -> np.ndarray:
        """Rows of probabilities; ``step`` windows at a time stay in the cache."""
        out = np.zeros((len(windows), len(self.languages)), np.float32)
        for begin in range(0, len(windows), step):
            some = windows[begin:begin + step].astype(np.int64)
            pairs = some[:, :-1] * 256 + some[:, 1:]
            pooled = []
            for width, own in tables.items():
                places = some.shape[1] - width + 1
                response = None
                for at, table in own:
                    part = np.take(table, (pairs if len(table) > 256 else some)[:, at:at + places], axis=0)
                    response = part if response is None else np.add(response, part, out=response)
                while response.shape[1] > 1:  # halves, for long vector operations
                    half = response.shape[1] // 2
                    response = np.maximum(response[:, :response.shape[1] - half], response[:, half:])
                pooled.append(response[:, 0])
            out[begin:begin + step] = self.softmax(np.maximum(np.hstack(pooled), 0) @ self.values["out"] + self.values["bias"])
        return out


def training_windows(docs: DataFrame, options: TrainOptions) -> pd.DataFrame:
    """Windows of about ``max_documents`` ids and of ``least_documents`` more of each rarer language; one text of an id."""
    known = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null").where(
        crc_fold("doc_id", HELD_OUT_FOLDS) != HELD_OUT)
    sizes = {row["lang"]: row["count"] for row in known.select("doc_id", "lang").distinct().groupBy("lang").count().collect()}  # a row per language
    share = options.max_documents / max(1, sum(sizes.values()))
    wanted = [(lang, int((1 << 30) * min(1.0, max(share, options.least_documents / size)))) for lang, size in sizes.items()]
    limits = docs.sparkSession.createDataFrame(wanted, "lang string, hash_limit long")
    chosen = (known.join(F.broadcast(limits), "lang")
              .where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.col("hash_limit"))
              .select("doc_id", "lang", "text", F.xxhash64("text").alias("tie")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            windows = []
            for text in batch["text"]:
                every = windows_of(text.encode("utf-8", "replace"), options.window)
                n = min(len(every), options.windows_each)
                windows.append([row.tobytes() for row in every[np.linspace(0, len(every) - 1, n).round().astype(int)]])
            yield batch.drop(columns="text").assign(windows=windows)

    found = one_per_id(chosen.mapInPandas(cut, "doc_id long, lang string, tie long, windows array<binary>"), ["lang", "windows"])
    return found.select("lang", F.explode("windows").alias("bytes")).toPandas()  # windows_each for each id chosen


def train(docs: DataFrame, options: TrainOptions = TrainOptions()) -> ByteNetwork | None:
    found = training_windows(docs, options).sort_values(["lang", "bytes"])
    if not len(found):
        return None
    languages = sorted(found["lang"].unique())
    network = ByteNetwork(languages, options)
    network.train(np.stack([np.frombuffer(row, np.uint8) for row in found["bytes"]]), np.searchsorted(languages, found["lang"]))
    return network


def predicted(docs: DataFrame, network: ByteNetwork | None, part_chars: int = 2_000_000) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = network.tables() if network else {}
        for batch in batches:
            texts, found, sure = texts_of(batch["text"]), [], []
            for part in chunks(texts, part_chars):
                some = texts[part]
                lettered = [bool(network) and any(sign.isalpha() for sign in text) for text in some]
                cut = [windows_of(text.encode("utf-8", "replace"), network.options.window) for text, has in zip(some, lettered) if has]
                if cut:
                    n = np.array([len(rows) for rows in cut])
                    mean = np.add.reduceat(network.probabilities(np.concatenate(cut), tables), np.cumsum(n) - n, axis=0) / n[:, None]
                    results = iter(zip(mean.argmax(axis=1), mean.max(axis=1)))
                for has in lettered:
                    best, score = next(results) if has else (None, 0.0)
                    found.append(network.languages[best] if has else UNDETERMINED)
                    sure.append(min(1.0, float(score)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": found, "score": sure})

    return docs.select("doc_id", "text").mapInPandas(predict, "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    result = predicted(docs, train(docs))
    return result.select("doc_id", F.coalesce(crc_fold("doc_id", HELD_OUT_FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
