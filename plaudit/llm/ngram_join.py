"""N-gram Jaccard join: MinHash bands propose pairs, full n-gram sets decide.

1. One pass over the texts turns each into the set of hashes of its word n-grams, a key of that set, and
   one hash per band of its MinHash signature. Texts of equal sets form a *copy class*; only its first
   document goes on, weighted by the number of copies.
2. Band hashes are shuffled. A class that meets others joins the *home* of its most crowded
   band bucket; homes are cut into blocks of bounded weight. Buckets then only tell which blocks meet,
   so a group of n near copies costs (n / block size)^2 small rows instead of n^2 pairs.
3. Each pair of blocks that meet is one group: the n-gram sets of its members, read again from the texts,
   are compared by matrix products over the n-grams that occur twice, and every link of Jaccard similarity
   ``threshold`` or more is counted. What leaves a group is one row per linked class: its links and its
   root in a local forest. These rows are joined to components.

Counting all links of a group of near copies that all differ takes time in the square of its size, inside numpy, and sends the
n-gram sets of each block once for each block it meets; memory stays in proportion. Exact copies cost nothing of that kind.

Cases: words are runs of other characters than the six ASCII blanks; a text of fewer words than the n-gram length has one
n-gram, all its words; texts without words (null, empty, blank) have no n-grams and no links, each is a
class of its own; a repeated row of one id counts as a copy; rows with null ids are kept, as classes of
their own text. Ties: a class is named by its least document id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.llm.common import documents, texts_of, written
from plaudit.llm.components import components

WORD = re.compile("[^ \t-\r]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JoinOptions:
    words: int = 5
    threshold: float = 0.8
    recall: float = 0.999           # wanted at the threshold itself
    max_hashes: int = 400           # of a signature
    block_texts: int = 256          # a block has about so many classes at most
    block_ngrams: int = 1 << 18     # and about so many n-grams
    broadcast_rows: int = 200_000   # candidate ids (16 bytes each) up to which they are broadcast, not shuffled


def band_plan(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """Bands and rows: the most rows per band (fewest false meetings) whose bands reach ``recall`` within ``max_hashes``."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-chance))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def ngram_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    words = WORD.findall(text)
    if not words:
        return np.zeros(0, np.uint64)
    # hash_array is the same on every worker, unlike Python's own hash of a text.
    codes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = min(n, len(words))
    joined = codes[:len(codes) - n + 1].copy()
    for at in range(1, n):
        joined = joined * _ODD + codes[at:len(codes) - n + 1 + at]
    return np.unique(_mixed(joined))


def set_key(grams: np.ndarray) -> bytes:
    """128 bits that tell n-gram sets apart."""
    return np.array([grams.sum(dtype=np.uint64), _mixed(grams).sum(dtype=np.uint64)]).tobytes()


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.mix = rng.integers(0, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        self.salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        small = (grams >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(small), 1024):  # stays in the cache
            part = small[start:start + 1024, None] * self.factor
            part += self.shift
            np.minimum(low, part.min(axis=0), out=low)
        wide = low.reshape(self.bands, self.rows).astype(np.uint64)
        return _mixed((wide * self.mix).sum(axis=1, dtype=np.uint64) + self.salt)


def signed(docs: DataFrame, options: JoinOptions) -> DataFrame:
    """``doc_id, tie, key, n_grams, bands``: per row a hash of its text, the key of its n-gram set and its band hashes."""
    signer = Signer(*band_plan(options.threshold, options.recall, options.max_hashes))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, sizes, bands = [], [], []
            for text in texts_of(batch["text"]):
                grams = ngram_set(text, options.words)
                sizes.append(len(grams))
                if len(grams):
                    keys.append(set_key(grams))
                    bands.append(signer.band_hashes(grams).view(np.int64))
                else:
                    keys.append(None)
                    bands.append(None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tie": batch["tie"], "key": keys, "n_grams": sizes, "bands": bands})

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInPandas(sign, "doc_id long, tie long, key binary, n_grams long, bands array<long>")


def blocks(spark: SparkSession, classes: DataFrame, options: JoinOptions) -> tuple[DataFrame, DataFrame]:
    """``id, block`` of the classes that share a band bucket with others, and ``block, other``: the blocks that meet."""
    member = classes.select("id", "n_grams", F.explode("bands").alias("bucket"))
    crowded = member.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    met = written(spark, member.join(crowded, "bucket"), "buckets")
    home = met.groupBy("id").agg(F.max(F.struct("crowd", "bucket")).alias("best"), F.first("n_grams").alias("n_grams")).select(
        "id", "n_grams", F.col("best.bucket").alias("home"))
    weight = home.groupBy("home").agg(F.count("*").alias("n"), F.sum("n_grams").alias("total")).select(
        "home", F.greatest(F.ceil(F.col("n") / options.block_texts), F.ceil(F.col("total") / options.block_ngrams)).alias("cuts"))
    placed = written(spark, home.join(weight, "home").select(
        "id", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("cuts"))).alias("block")), "blocks")
    in_bucket = met.select("id", "bucket").join(placed, "id").groupBy("bucket", "block").agg(F.count("*").alias("n"))
    # A block meets itself only where two of its classes share a bucket.
    alone = in_bucket.where("n > 1").select("block", F.col("block").alias("other"))
    other = in_bucket.select("bucket", F.col("block").alias("other"))
    across = in_bucket.select("bucket", "block").join(other, "bucket").where("block < other").select("block", "other")
    return placed, written(spark, alone.union(across).distinct(), "meetings")


def _links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (left, right) of sets with that Jaccard similarity or more."""
    sides = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.r_[sides[0], sides[1]])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.r_[True, flat[1:] != flat[:-1]]
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1      # n-grams of one set alone join nothing
    owner, number = owner[shared], number[shared]
    number = np.cumsum(np.r_[True, number[1:] != number[:-1]]) - 1 if len(number) else number
    common = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + step + 1, step))
    for begin, end in zip(cuts[:-1], cuts[1:]):
        if end > begin:
            grid = np.zeros((len(left) + len(right), step), np.float32)
            grid[owner[begin:end], number[begin:end] % step] = 1
            common += grid[:len(left)] @ grid[len(left):].T
    # Compare by whole numbers: common / (a + b - common) >= threshold.
    union = sides[0][:, None] + sides[1][None, :] - common.astype(np.int64)
    return np.nonzero(common.astype(np.float64) >= threshold * union - 1e-9)


def linked(members: DataFrame, threshold: float) -> DataFrame:
    """``id, links, texts, root`` from rows ``block, other, side, id, copies, grams``, one group per pair of blocks."""
    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.drop_duplicates(["side", "id"]).sort_values("id")  # repeated rows of one document
        same = (batch["block"] == batch["other"]).all()
        sides = [batch[batch["side"] == 0], batch if same else batch[batch["side"] == 1]]
        sets = [[np.frombuffer(grams, np.uint64) for grams in side["grams"]] for side in sides]
        rows, columns = _links(*sets, threshold)
        ids, copies = [side["id"].to_numpy() for side in sides], [side["copies"].to_numpy() for side in sides]
        if same:
            rows, columns = rows[rows < columns], columns[rows < columns]
        a, b = ids[0][rows], ids[1][columns]
        names, number = np.unique(np.r_[a, b], return_inverse=True)
        begin, end = number[:len(a)], number[len(a):]
        root = np.arange(len(names))
        while True:  # least place over the links, then over the roots, until nothing moves
            before = root.copy()
            least = np.minimum(root[begin], root[end])
            np.minimum.at(root, begin, least)
            np.minimum.at(root, end, least)
            root = root[root]
            if (root == before).all():
                break
        return pd.DataFrame({
            "id": names, "root": names[root] if len(names) else names, "texts": np.bincount(number, minlength=len(names)),
            "links": np.bincount(number, np.r_[copies[1][columns], copies[0][rows]], len(names)).astype(np.int64)})

    return members.groupBy("block", "other").applyInPandas(compare, "id long, root long, texts long, links long")


def near_duplicates(spark: SparkSession, docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """``doc_id, tie, copy_id, class_id, copies, n_links, n_linked_texts`` per row of ``docs``.

    ``class_id`` is the least id of the documents joined by links, directly or by way of others;
    ``copy_id`` that of the documents with the same n-gram set, ``copies`` their number; ``n_links`` counts the other
    documents whose similarity is the threshold or more, ``n_linked_texts`` the other sets among them.
    """
    rows = written(spark, signed(docs, options), "signed")
    # A class is known by half of its key: document ids may repeat with other texts.
    classes = written(spark, rows.where("key is not null and doc_id is not null").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
        .withColumn("id", F.xxhash64("key")), "classes")
    placed, meetings = blocks(spark, classes, options)
    wanted = placed.join(classes.select("id", "doc_id", "key", "copies"), "id")
    if placed.count() <= options.broadcast_rows:
        wanted = F.broadcast(wanted)

    def with_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [ngram_set(text, options.words) for text in texts_of(batch["text"])]
            right = [set_key(own) == bytes(key) for own, key in zip(grams, batch["key"])]  # not another text of a repeated id
            batch["grams"] = [own.tobytes() for own in grams]
            yield batch.loc[right, ["id", "block", "copies", "grams"]]

    candidates = written(spark, docs.select("doc_id", "text").join(wanted, "doc_id").select("id", "block", "copies", "key", "text")
                         .mapInPandas(with_grams, "id long, block long, copies long, grams binary"), "candidates")
    left = candidates.join(meetings, "block").select("block", "other", F.lit(0).alias("side"), "id", "copies", "grams")
    right = (candidates.withColumnRenamed("block", "other").join(meetings.where("block <> other"), "other")
             .select("block", "other", F.lit(1).alias("side"), "id", "copies", "grams"))
    found = written(spark, linked(left.union(right), options.threshold), "links")
    roots = components(spark, found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    named = roots.join(classes.select("id", "doc_id"), "id")
    named = named.join(named.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("id", "class_id")
    result = (classes.select("key", "id", "doc_id", "copies").join(sums.join(named, "id"), "id", "left")
              .select("key", F.col("doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"), "copies",
                      (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("texts", F.lit(0)).alias("n_linked_texts")))
    result = written(spark, result, "classes")
    return rows.select("doc_id", "tie", "key").join(result, "key", "left").select(
        "doc_id", "tie", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_linked_texts", F.lit(0)).alias("n_linked_texts"))


def keep_one(spark: SparkSession, docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """One document of each class of near duplicates, that with the least id, with its columns.

    Of repeated rows of that id with the same text one stays; rows with a null id stay.
    """
    found = written(spark, near_duplicates(spark, docs, options).select("doc_id", "tie", "class_id"), "found")
    def the_row(of: DataFrame):  # ids may repeat with other texts
        return (docs["doc_id"] == of["gone_id"]) & (F.xxhash64(docs["text"]) == of["gone_tie"])

    name = [F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")]
    gone = found.where("doc_id <> class_id").select(*name).distinct()
    kept = docs.join(gone, the_row(gone), "left_anti")
    again = found.where("doc_id = class_id").groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1").select(*name)
    if again.isEmpty():
        return kept
    return kept.join(again, the_row(again), "left_anti").union(
        kept.join(again, the_row(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir)).drop("tie")
