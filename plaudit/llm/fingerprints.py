"""Document fingerprints: a homomorphic multiset hash of paragraphs, as DataFrame expressions.

A fingerprint is a wide vector of counters that are sums over the parts of a text, each modulo a power of
two. Adding a part is adding its vector, deleting it is subtracting, and the order of parts does not matter.

- Exact counters, modulo 2^30, are sums of hashes of whole paragraphs (lines): texts of the same paragraphs have
  equal ones, other texts hardly ever.
- Signed counters, modulo 2^20, count one hash bit each over the pieces of the paragraphs: runs of up to eight words
  that end at a punctuation mark. Twice a count less the number of pieces is a sum of signs, and products of
  such sums estimate how many pieces two texts share. Their likeness is 2 xy / (xx + yy), cut to 0..1,
  with a standard error of about 0.09.

Several counters lie in one 64-bit number with a free bit above each, and are masked after every addition.

Cases: a null text counts as empty; the empty text is one blank paragraph without pieces; two texts without pieces have likeness 1
if they are equal and else 0, as have a text with and one without pieces; repeated rows have the same next document, the next of
other id or text; rows with null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plaudit.llm.common import documents, written

SHIFTS = 21                                     # a number holds the counters of bits s, s + 21, s + 42 of a hash
BITS = 1 | 1 << 21 | 1 << 42
COUNTER = (1 << 20) - 1
SIGNED = COUNTER | COUNTER << 21 | COUNTER << 42
HASHES = 2
EXACT_NUMBERS = 4
EXACT = (1 << 30) - 1 | ((1 << 30) - 1) << 32
NUMBERS = EXACT_NUMBERS + 1 + HASHES * SHIFTS    # exact counters, the count of pieces, signed counters
MASKS = [EXACT] * EXACT_NUMBERS + [COUNTER] + [SIGNED] * (HASHES * SHIFTS)
PIECE = r"(?:[^\s]*[^\s.,;:!?][\x20\t]+){0,7}[^\s]+"
NO_ID = -(1 << 63)


def _total(parts: Column, vector: list, masks: list[int]) -> Column:
    """The masked sums over ``parts`` of the numbers that the functions in ``vector`` make of a part."""
    names = [f"n{at}" for at in range(len(vector))]
    nothing = F.struct(*(F.lit(0).cast("long").alias(name) for name in names))
    return F.aggregate(parts, nothing, lambda sums, part: F.struct(*(
        (sums[name] + number(part)).bitwiseAND(F.lit(mask)).alias(name) for name, number, mask in zip(names, vector, masks))),
        lambda sums: F.array(*(sums[name] for name in names)))


def fingerprint(text: Column) -> Column:
    """The vector of a text (not null) as an array of ``NUMBERS`` longs."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.array(*(F.xxhash64(line, F.lit(seed)) for seed in range(EXACT_NUMBERS))))
    exact = _total(lines, [lambda part, at=at: part[at].bitwiseAND(F.lit(EXACT)) for at in range(EXACT_NUMBERS)], MASKS[:EXACT_NUMBERS])
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)),
                         lambda piece: F.struct(*(F.xxhash64(piece, F.lit(100 + seed)).alias(f"h{seed}") for seed in range(HASHES))))
    signed = _total(pieces, [lambda part: F.lit(1).cast("long")] + [
        lambda part, seed=seed, shift=shift: F.shiftrightunsigned(part[f"h{seed}"], shift).bitwiseAND(F.lit(BITS))
        for seed in range(HASHES) for shift in range(SHIFTS)], MASKS[EXACT_NUMBERS:])
    return F.concat(exact, signed)


def _combined(left: Column, right: Column, sign: int) -> Column:
    # Subtracting is adding the complement: mask + 1 in every counter, which the masking cuts off again.
    return F.array(*(((left[at] + (right[at] if sign > 0 else F.lit(mask).bitwiseXOR(right[at]))).bitwiseAND(F.lit(mask))
                      + (F.lit(0) if sign > 0 else F.lit(_ones(mask)))).bitwiseAND(F.lit(mask)) for at, mask in enumerate(MASKS)))


def _ones(mask: int) -> int:
    return {EXACT: 1 | 1 << 32, COUNTER: 1, SIGNED: BITS}[mask]


def inserted(vector: Column, part: Column) -> Column:
    """The fingerprint after the paragraphs of another one are added."""
    return _combined(vector, part, 1)


def deleted(vector: Column, part: Column) -> Column:
    """The fingerprint after the paragraphs of another one are taken away."""
    return _combined(vector, part, -1)


def written_out(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda number: F.lpad(F.lower(F.hex(number)), 16, "0")), "")


def signs(vector: Column) -> Column:
    """The 126 sums of signs, centred around 0 in their modulus."""
    half = (COUNTER + 1) // 2
    counters = F.flatten(F.transform(F.slice(vector, EXACT_NUMBERS + 2, HASHES * SHIFTS), lambda number: F.array(*(
        F.shiftrightunsigned(number, at).bitwiseAND(F.lit(COUNTER)) for at in (0, 21, 42)))))
    return F.transform(counters, lambda count: (
        (2 * count - vector[EXACT_NUMBERS] + half).bitwiseAND(F.lit(COUNTER)) - half).cast("double"))


def likeness(left: Column, right: Column) -> Column:
    """Of two arrays of ``signs``."""
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, value: total + value)
    both = product(left, left) + product(right, right)
    return F.when(both == 0, (left == right).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * product(left, right) / both)))


def next_rows(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """``doc_key, tie, n_chars, next_key, next_tie`` of the distinct rows; the first row follows the last.

    Ranges of keys become buckets, whose rows are ordered by a window each; one row per bucket links them.
    """
    ranged = written(spark, keyed.select("doc_key", "tie", "n_chars").repartitionByRange("doc_key")
                     .withColumn("bucket", F.spark_partition_id()), "ranges").distinct()
    here = F.struct("doc_key", "tie")
    firsts = ranged.groupBy("bucket").agg(F.min(here).alias("first"))
    chain = Window.orderBy("first")
    links = firsts.select("bucket", F.coalesce(F.lead("first").over(chain), F.min("first").over(
        chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    following = F.coalesce(F.lead(here).over(Window.partitionBy("bucket").orderBy("doc_key", "tie")), F.col("after"))
    found = ranged.join(links, "bucket").select("doc_key", "tie", "n_chars", following.alias("next"))
    return written(spark, found.select("doc_key", "tie", "n_chars", F.col("next.doc_key").alias("next_key"), F.col("next.tie").alias("next_tie")), "next")


def compared(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: its fingerprint, that of its edited text, and their likenesses.

    The texts are shuffled once, by id; the heads of next documents follow in a second, smaller shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    following = next_rows(spark, keyed.withColumn("n_chars", F.char_length("text").cast("long")))
    marked = keyed.withColumn("vector", fingerprint(F.col("text")))
    key = ["doc_key", "tie"]
    takes = following.select(F.col("doc_key").alias("for_key"), F.col("tie").alias("for_tie"), "n_chars",
                             F.col("next_key").alias("doc_key"), F.col("next_tie").alias("tie"))
    heads = marked.join(takes, key).select(
        F.col("for_key").alias("doc_key"), F.col("for_tie").alias("tie"), "n_chars",
        F.expr("substring(text, 1, cast(n_chars div 4 as int))").alias("head"), F.col("vector").alias("next_vector"))
    if following.count() < docs.count():  # repeated rows would multiply
        heads = heads.dropDuplicates(key)
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), F.col("head"))
    rows = marked.join(heads, key).select("doc_key", "n_chars", "vector", "next_vector", edited.alias("edited"))
    rows = rows.select("*", F.sha2(F.col("edited"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_vector"))
    sums = rows.select("*", *(signs(F.col(name)).alias(f"{name}_signs") for name in ("vector", "edited_vector", "next_vector")))
    own = F.col("vector_signs")
    return sums.select(
        F.when(F.col("doc_key") != NO_ID, F.col("doc_key")).alias("doc_id"), "n_chars", "edited_sha256",
        written_out(F.col("vector")).alias("fingerprint"), written_out(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(own, F.col("edited_vector_signs")).alias("near_edited"), likeness(own, F.col("next_vector_signs")).alias("near_next"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, documents(spark, sf_dir).select("doc_id", "text"))
