"""Secret scans: fixed patterns and a battery of randomness tests, as DataFrame expressions.

Three patterns always count: assignments to names such as ``token``, access keys, and long runs of hex digits. Beyond
them every run of token characters that mixes digits and letters is a candidate, also the value in ``name=value``. Its encoding is inferred from the
characters it uses (hex, base 32, base 36, base 64), and three tests ask whether it looks like random digits
of that encoding: chi-squared uniformity over the alphabet, the number of runs above and below the middle, and
the serial correlation of neighbours. Each is taken to a two-sided p-value by its normal approximation, the smallest
times three is the p-value of the candidate.

Random strings have p-values spread evenly over 0..1, made-up names and numbered words have tiny ones. So in each class of length
the number of random strings follows from the candidates above the middle, and the least p-value from which
candidates count as secrets is the one where the expected share of others among them is at most ``rate``: a
false-discovery control that weighs short, weakly testable strings by how many of their length there are. The counts behind it
are over the distinct strings of all documents; the limit then applies to every occurrence.

Cases: a null text counts as empty; spans are code points with an exclusive end; an added span inside a span of the
patterns is not repeated; repeated rows are scanned and counted each; an empty table gives no limits and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plaudit.llm.common import documents

# The base kinds in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"      # 20 characters of a run that begins with the letters
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "random")

# '=' ends a run, as in name=value, unless it pads the run's end; 20 characters with the padding.
RUN = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])"
       r"(?:[A-Za-z0-9+/_-]{20,}|(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]+(?==+(?![A-Za-z0-9+/_=-])))(?:=+(?![A-Za-z0-9+/_=-]))?")
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ENCODINGS = (  # name, characters, alphabet in the order of its values; the first that fits is taken
    ("hex", "[0-9a-f]+", "0123456789abcdef"),
    ("hex_upper", "[0-9A-F]+", "0123456789ABCDEF"),
    ("base32", "[A-Z2-7]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "[0-9A-Z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "[A-Za-z0-9+/]+=*", B64 + "+/"),
    ("base64url", "[A-Za-z0-9_-]+=*", B64 + "-_"),
)


@dataclass(frozen=True)
class ScanOptions:
    rate: float = 0.02              # wanted share of other strings among the added ones
    bins: int = 100                 # of p-values


FOUND = "array<struct<start:int,kind:int,end:int>>"
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda sum_, value: sum_ + value)


def sums_before(values: Column) -> Column:
    """For each element the sum of those before it; blocks keep long arrays from taking time in their square.

    ``values`` must be bound (a column or a ``let``), as every element looks at it.
    """
    sum_of = lambda part: F.aggregate(part, F.lit(0), lambda sum_, value: sum_ + value)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))),
                         lambda at: sum_of(F.slice(values, at * BLOCK + 1, BLOCK)))
    bases = F.aggregate(blocks, F.array(F.lit(0)), lambda out, value: F.concat(out, F.array(F.element_at(out, -1) + value)))
    return let(bases, lambda base: F.transform(values, lambda _, at: F.get(base, F.floor(at / BLOCK).cast("int")) + sum_of(
        F.slice(values, F.floor(at / BLOCK).cast("int") * BLOCK + 1, at % BLOCK))))


def located(text: Column, pattern: str) -> Column:
    """``start, end, value`` of the matches of a pattern, leftmost and non-overlapping, from the texts between them."""
    def placed(both: Column) -> Column:
        steps = F.transform(both, lambda row: row["gap"] + F.char_length(row["value"]))
        return F.zip_with(both, let(steps, sums_before), lambda row, at: F.struct(
            (at + row["gap"]).alias("start"), (at + row["gap"] + F.char_length(row["value"])).alias("end"), row["value"].alias("value")))

    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # There is one gap more than there are matches.
    both = F.filter(F.zip_with(gaps, values, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value"))), lambda row: row["value"].isNotNull())
    return let(both, placed)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind (a place in ``KINDS``)."""
    none = F.array().cast(FOUND)

    def of_kind(kind: int, pattern: str, keep=None) -> Column:
        spans = located(text, pattern)
        if keep is not None:
            spans = F.filter(spans, keep)
        spans = F.transform(spans, lambda span: F.struct(span["start"].alias("start"), F.lit(kind).alias("kind"), span["end"].alias("end")))
        return F.when(text.rlike(pattern), spans).otherwise(none)

    long_enough = lambda span: F.char_length(F.regexp_extract(span["value"], ASSIGN, 2)) >= ASSIGN_MIN
    return F.array_sort(F.concat(of_kind(0, ASSIGN, long_enough), of_kind(1, ACCESS), of_kind(2, HEX)))


def tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal value (rational approximation, absolute error below 1e-6)."""
    def of(size: Column) -> Column:
        return let(1 / (1 + 0.2316419 * size), lambda t: 2 * 0.3989422804014327 * F.exp(-size * size / 2) * t * (
            0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), let(F.abs(z), of)))


def battery(value: Column, alphabet: Column) -> Column:
    """p-value of a string as random digits of an alphabet: the least of three tests, corrected for their number."""
    k = F.char_length(alphabet).cast("double")
    digits = F.transform(F.split(value, "", -1), lambda char: F.call_function("locate", char, alphabet).cast("double") - 1)
    counts = F.transform(F.split(alphabet, "", -1), lambda char: (F.char_length(value) - F.char_length(F.replace(value, char, F.lit("")))).cast("double"))

    def of_digits(bound: Column) -> Column:
        digit, n, middle = bound["digits"], bound["n"], (bound["k"] - 1) / 2
        squares = total(F.transform(bound["counts"], lambda count: count * count))
        uniform = tail((squares * bound["k"] / n - n - (bound["k"] - 1)) / F.sqrt(2.0 * (bound["k"] - 1) * (n - 1) / n))
        after = F.slice(digit, 2, F.size(digit))
        before = F.slice(digit, 1, F.size(digit) - 1)
        above = total(F.transform(digit, lambda d: (d > middle).cast("double")))
        turns = total(F.zip_with(before, after, lambda a, b: ((a > middle) != (b > middle)).cast("double")))
        spread = lambda product: product * (product - n) / (n * n * (n - 1))
        runs = let(let(above, lambda up: 2 * up * (n - up)), lambda product: F.when(
            spread(product) > 0, tail((turns - product / n) / F.sqrt(spread(product)))).otherwise(F.lit(0.0)))
        serial = let(total(digit) / n, lambda mean: let(
            total(F.transform(digit, lambda d: (d - mean) * (d - mean))), lambda power: F.when(power > 0, tail((total(
                F.zip_with(before, after, lambda a, b: (a - mean) * (b - mean))) / power + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))))
        return 1 - F.pow(1 - F.least(uniform, runs, serial), F.lit(3.0))

    return let(F.struct(digits.alias("digits"), counts.alias("counts"), k.alias("k"), F.char_length(value).cast("double").alias("n")), of_digits)


def length_class(n: Column) -> Column:
    """Half octaves of the length."""
    return F.floor(2 * F.log2(n.cast("double"))).cast("int")


def candidates(text: Column) -> Column:
    """``start, end, value, class, p`` of the runs of token characters whose encoding is known."""
    def alphabet(value: Column) -> Column:
        choice = F.lit(None).cast("string")
        for _, characters, letters in reversed(ENCODINGS):
            choice = F.when(value.rlike(f"^{characters}$"), F.lit(letters)).otherwise(choice)
        return choice

    def tested(value: Column) -> Column:
        return let(F.struct(F.regexp_replace(value, "=+$", "").alias("bare"), alphabet(value).alias("letters")),
                   lambda bound: F.when(bound["letters"].isNotNull(), battery(bound["bare"], bound["letters"])))

    rows = F.transform(located(text, RUN), lambda span: F.struct(
        span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"), length_class(F.char_length(span["value"])).alias("class"),
        tested(span["value"]).alias("p")))
    known = F.filter(rows, lambda row: row["p"].isNotNull())
    return F.when(text.rlike(RUN), known).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,class:int,p:double>>"))


def limits(docs: DataFrame, options: ScanOptions) -> dict[int, float]:
    """Per length class the p-value from which candidates are secrets; classes without one are left out.

    The estimate holds for independent strings, so equal strings (by their hash) count once, however often they are copied. The histogram
    has at most ``bins`` rows for each of the few dozen classes, whatever the data.
    """
    row = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("row")).select("row.*")
    strings = row.select("class", F.least(F.floor(F.col("p") * options.bins), F.lit(options.bins - 1)).alias("bin"), F.xxhash64("value").alias("string")).distinct()
    hist = strings.groupBy("class", "bin").agg(F.count("*").alias("n"))
    upward = Window.partitionBy("class").orderBy(F.col("bin").desc())
    everything = Window.partitionBy("class")
    random = 2 * F.sum(F.when(F.col("bin") >= options.bins // 2, F.col("n")).otherwise(0)).over(everything)
    share = hist.select("class", "bin", F.sum("n").over(upward).alias("reported"), random.alias("random"))
    others = 1 - F.least(F.lit(1.0), (1 - F.col("bin") / options.bins) * F.col("random") / F.col("reported"))
    allowed = share.where((F.col("random") > 0) & (F.col("bin") > 0) & (others <= options.rate)).groupBy("class").agg(F.min("bin").alias("bin"))
    return {row["class"]: row["bin"] / options.bins for row in allowed.collect()}


def all_spans(text: Column, limit: dict[int, float]) -> Column:
    """A struct of ``base`` spans and ``every`` span: the base ones and the candidates from their limit on that lie in none of them."""
    if not limit:
        return let(base_spans(text), lambda base: F.struct(base.alias("base"), base.alias("every")))
    least = F.create_map(*(F.lit(value) for pair in limit.items() for value in pair))
    good = F.filter(candidates(text), lambda row: row["p"] >= F.coalesce(least[row["class"]], F.lit(2.0)))

    def joined(base: Column) -> Column:
        added = F.filter(good, lambda row: ~F.exists(base, lambda span: (span["start"] <= row["start"]) & (row["end"] <= span["end"])))
        random = F.transform(added, lambda row: F.struct(row["start"].alias("start"), F.lit(3).alias("kind"), row["end"].alias("end")))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, random)).alias("every"))

    return let(base_spans(text), joined)


def written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(
        ":", F.get(F.array(*map(F.lit, KINDS)), span["kind"]), span["start"], span["end"])), ",")


def scanned(docs: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """All columns of ``docs`` and a struct ``spans`` of ``base`` and ``every`` span as arrays of start, kind, end."""
    return docs.withColumn("spans", all_spans(F.coalesce("text", F.lit("")), limits(docs, options)))


def redacted(docs: DataFrame, mark: str = "[SECRET]", options: ScanOptions = ScanOptions()) -> DataFrame:
    """The documents with each secret (spans that overlap count as one) replaced by ``mark``; ``n_chars`` follows the text."""
    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        piece = F.concat(F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"),
                        F.when(fresh, F.concat(state["parts"], F.array(piece))).otherwise(state["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.aggregate("spans", start, step, lambda state: F.concat(
        F.array_join(state["parts"], ""), F.substring(F.col("text"), state["at"] + 1, F.char_length(F.col("text")))))
    found = all_spans(F.coalesce("text", F.lit("")), limits(docs, options))["every"]
    clean = docs.select("text", "n_chars", F.struct("*").alias("row"), found.alias("spans"))
    fixed = clean.select("row", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("text"), (F.size("spans") > 0).alias("hit"), "n_chars")
    return fixed.select(*(F.when(F.col("hit"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
                          if name == "n_chars" else F.col("text") if name == "text" else F.col("row")[name].alias(name) for name in docs.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = scanned(docs).select("doc_id", F.col("spans.base").alias("base"), F.col("spans.every").alias("every"))
    count = lambda kind: F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("every")).alias("spans"))
