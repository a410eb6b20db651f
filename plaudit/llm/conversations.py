"""Conversation structure repair: the cheapest edits that give the roles ``(s?(ua)+)?``, by Hirschberg's method.

A conversation is in one of four states: nothing yet, after a system turn, after a user turn, after an assistant turn. A row
(with the insertions before it) is a transfer: a 4 x 4 matrix of costs, and for each start the order of the cheapest audits
to the four ends. Transfers can be joined, so they stand for rows as well as for runs of rows. To find the edits, a forward
vector of four costs (from the start) and a backward vector (to the end) meet in the middle; of the optimal crossing states
the one with the least audit so far is taken, and both halves follow in the same way: no table of all states is kept. Audits
of different crossings end with the same row, so none begins another and their order can be kept as ranks.

Rows are put in order as a few bytes each (state code, number of copies) by ranges of (conversation, turn, role, hash). A task
cuts its range into runs of ``run_rows`` rows. A conversation within one run is repaired there; the runs of longer ones, and
those at the ends of a range, are joined by groups of ``fan`` runs, groups of groups and so on, and the crossings are handed
down the same levels: a conversation of any length is spread over tasks. Texts move once, by conversation, for the digest
alone, which streams through them (SHA-256 is sequential by definition) and holds one batch.

Defined cases: null role, text, id or turn count as one blank where text is made of them; rows of null conversations form one;
null turns come first; rows of one turn go by role, then by the MD5 of role and text, equal ones adjacent; the edits of a
conversation are as long as it is, in one value. A role that is empty or starts with another letter than s, u, a cannot be
kept. No conversations give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from plaudit.llm.common import written

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
TRUNCATED, DELETED = 4, 8                       # bits of a row's code beside the class of its role
KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
NEVER = 1 << 60
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}      # the role an insertion or a new role must have
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
CLOSING = ("", "II", "I", "")
Transfer = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]   # costs and ranks, [start][end]


@dataclass(frozen=True)
class RepairOptions:
    run_rows: int = 4096
    fan: int = 512


def ranks(keys: list) -> tuple[int, ...]:
    """Places of the four keys in their order; equal only where a state cannot be reached."""
    order = sorted(set(keys))
    return tuple(order.index(key) for key in keys)


@cache
def row_edits(code: int) -> tuple[tuple[tuple[int, str], ...], ...]:
    """``[start][end]``: cost and letters of the cheapest edits of a row, insertions before it included."""
    role, late = code & 3, MEND if code & TRUNCATED else 0
    table = []
    for start in STATES:
        best: dict[int, tuple[int, str]] = {}
        state, letters = start, ""
        while True:                              # a state met twice would only add insertions
            steps = [("D", state, DELETE)]
            if not code & DELETED:
                steps.append(("R", FOLLOWS[state], REROLE + late))
                if role == FOLLOWS[state] or (role == SYSTEM and state == START):
                    steps.append(("K", role, KEEP + late))
            for letter, end, cost in steps:
                found = (len(letters) * INSERT + cost, letters + letter)
                best[end] = min(best.get(end, found), found)
            if len(letters) == 2:
                break
            state, letters = FOLLOWS[state], letters + "I"
        table.append(tuple(best.get(end, (NEVER, "~")) for end in STATES))
    return tuple(table)


@cache
def row_transfer(code: int) -> Transfer:
    edits = row_edits(code)
    return (tuple(tuple(cost for cost, _ in ends) for ends in edits), tuple(ranks([letters for _, letters in ends]) for ends in edits))


def forward(vector: tuple, transfer: Transfer) -> tuple:
    """Costs and ranks of the four states after a transfer, given those before it."""
    before, order = vector
    costs, own = transfer
    best = [min((before[mid] + costs[mid][end], order[mid], own[mid][end]) for mid in STATES) for end in STATES]
    return tuple(min(cost, NEVER) for cost, *_ in best), ranks([(cost >= NEVER, *key) if cost < NEVER else (True,) for cost, *key in best])


def begin(start: int) -> tuple:
    return tuple(0 if state == start else NEVER for state in STATES), tuple(int(state != start) for state in STATES)


def backward(transfer: Transfer, after: tuple) -> tuple:
    """Costs to the end from the four states before a transfer."""
    costs, _ = transfer
    return tuple(min(min(costs[state][mid] + after[mid] for mid in STATES), NEVER) for state in STATES)


def joined(transfers: list[Transfer]) -> Transfer:
    rows = []
    for start in STATES:
        vector = begin(start)
        for transfer in transfers:
            vector = forward(vector, transfer)
        rows.append(vector)
    return tuple(costs for costs, _ in rows), tuple(order for _, order in rows)


def best_crossing(vector: tuple, rest: tuple) -> int:
    """Of the states that make the cost least, the one with the least audit so far."""
    costs, order = vector
    return min(STATES, key=lambda state: (costs[state] + rest[state], order[state]))


def closing_costs() -> tuple:
    return tuple(len(letters) * INSERT for letters in CLOSING)


def crossings(transfers: list[Transfer], start: int, end: int | None) -> list[int]:
    """The states between the transfers, both ends included; without ``end`` the best one is taken.

    The halves still to be done are on a stack of logarithmic size.
    """
    states = [start] + [-1] * len(transfers)
    if end is None:
        vector = begin(start)
        for transfer in transfers:
            vector = forward(vector, transfer)
        end = best_crossing(vector, closing_costs())
    states[-1] = end
    open_parts = [(0, len(transfers))]
    while open_parts:
        low, high = open_parts.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        vector = begin(states[low])
        for at in range(low, middle):
            vector = forward(vector, transfers[at])
        rest = tuple(0 if state == states[high] else NEVER for state in STATES)
        for at in range(high - 1, middle - 1, -1):
            rest = backward(transfers[at], rest)
        states[middle] = best_crossing(vector, rest)
        open_parts += [(middle, high), (low, middle)]
    return states


@lru_cache(50_000)
def edits(codes: bytes, start: int = START, end: int | None = None) -> tuple[int, str]:
    """Cost and letters for a run of rows; without ``end`` the conversation ends here."""
    states = crossings([row_transfer(code) for code in codes], start, end)
    found = [row_edits(code)[states[at]][states[at + 1]] for at, code in enumerate(codes)]
    close = CLOSING[states[-1]] if end is None else ""
    return sum(cost for cost, _ in found) + len(close) * INSERT, "".join(letters for _, letters in found) + close


def illegal_pairs(codes: bytes) -> int:
    return sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))


# Spark ----------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the damage that the crc of id and turn decides."""
    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


PLACE = ["conv_id", "turn", "role", "key"]


def row_key():
    """MD5 of role and text; the length tells where the role ends."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("key")


def coded(rows: DataFrame) -> DataFrame:
    """``PLACE, code, n``: equal rows as one with their number, ``DELETED`` set where also the first of them must go.

    The first place of each text is sent to its own row by a second grouping, so that no text of a conversation,
    however often it comes, is in one place.
    """
    ending = F.rtrim("text", F.lit(BLANKS))
    first = F.left("role", F.lit(1))
    code = (F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)
            + F.when(ending == "", DELETED).when(F.right(ending, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED))
    packed = (rows.select("conv_id", "turn", "role", row_key(), code.alias("code"), "copies")
              .groupBy(*PLACE).agg(F.first("code").alias("code"), F.sum("copies").alias("n")))
    places = packed.groupBy("conv_id", "role", "key").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn")).alias("least")).select("conv_id", "least.turn", "role", "key")
    both = packed.withColumn("earliest", F.lit(False)).unionByName(places.withColumns(
        {"code": F.lit(None).cast("int"), "n": F.lit(None).cast("long"), "earliest": F.lit(True)}))
    found = both.groupBy(*PLACE).agg(F.max("code").alias("code"), F.max("n").alias("n"), F.max("earliest").alias("earliest"))
    return found.withColumn("blank", F.col("code").bitwiseAND(F.lit(DELETED)) != 0).withColumn(
        "code", F.when(F.col("earliest"), F.col("code")).otherwise(F.col("code").bitwiseOR(F.lit(DELETED))))


def row_counts(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated``; turn by turn first, so that long conversations stay spread."""
    blank, gone = F.col("blank"), F.col("code").bitwiseAND(F.lit(DELETED)) != 0
    late = F.col("code").bitwiseAND(F.lit(TRUNCATED)) != 0
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).otherwise(F.col("n") - F.when(gone, 0).otherwise(1))).alias("duplicate"),
        F.sum(F.when(late & ~gone, 1).otherwise(0)).alias("truncated"))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(name).cast("long").alias(name) for name in ("blank", "duplicate", "truncated")))


def run_schema(rows: DataFrame) -> T.StructType:
    kept = [rows.schema[name] for name in PLACE]
    return T.StructType(kept + T.StructType.fromDDL(
        "run long, codes binary, cost long, letters string, illegal long, head int, tail int, transfer array<long>").fields)


def cut_runs(rows: DataFrame, options: RepairOptions) -> DataFrame:
    """Runs of the ranges' rows. ``letters`` are there for a conversation within one run, else ``transfer``."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, codes, place, run, ordinal = None, None, bytearray(), None, 0, 0

        def finished(is_open: bool) -> dict:
            own = bytes(codes)
            cost, letters = (None, None) if is_open else edits(own)
            flat = [value for part in joined([row_transfer(code) for code in own]) for ends in part for value in ends] if is_open else None
            return dict(zip(PLACE, place), run=run, codes=own if is_open else None, cost=cost, letters=letters,
                        illegal=illegal_pairs(own), head=own[0] & 3, tail=own[-1] & 3, transfer=flat)

        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(name) for name in PLACE] + [
                ("run", pa.int64()), ("codes", pa.binary()), ("cost", pa.int64()), ("letters", pa.string()), ("illegal", pa.int64()),
                ("head", pa.int32()), ("tail", pa.int32()), ("transfer", pa.list_(pa.int64()))])
            out = []
            for *here, code, n in zip(*(batch.column(name).to_pylist() for name in [*PLACE, "code", "n"])):
                if codes and held != here[0]:
                    out.append(finished(ordinal == 0 or run > 0))    # the first of a range may have begun in the one before
                    codes.clear()
                    run, ordinal = 0, ordinal + 1
                elif codes and len(codes) >= options.run_rows:
                    out.append(finished(True))
                    codes.clear()
                    run += 1
                held = here[0]
                while n:
                    if len(codes) >= options.run_rows:
                        out.append(finished(True))
                        codes.clear()
                        run += 1
                    place = place if codes else here
                    more = min(n, options.run_rows - len(codes))
                    codes += bytes([code]) + bytes([code | DELETED]) * (more - 1)
                    code, n = code | DELETED, n - more
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if codes:
            yield pa.RecordBatch.from_pylist([finished(True)], schema)

    ranged = rows.select(*PLACE, "code", "n").repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
    return ranged.mapInArrow(runs, run_schema(rows))


def unpacked(flat) -> Transfer:
    table = [tuple(int(value) for value in flat[at * 4:at * 4 + 4]) for at in range(8)]
    return tuple(table[:4]), tuple(table[4:])


def joined_by_levels(spark: SparkSession, runs: DataFrame, options: RepairOptions) -> DataFrame:
    """``run_id, start, end`` of the numbered runs of conversations that lie in several (``end`` null: it ends there)."""
    def combined(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("no")
        whole = joined([unpacked(flat) for flat in own["transfer"]])
        return pd.DataFrame({"conv": own["conv"].iloc[:1], "no": own["no"].iloc[:1] // options.fan,
                             "transfer": [[value for part in whole for ends in part for value in ends]]})

    def handed_down(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("no")
        start, end = int(own["start"].iloc[0]), own["end"].iloc[0]
        states = crossings([unpacked(flat) for flat in own["transfer"]], start, None if pd.isna(end) else int(end))
        ends = [float(state) for state in states[1:]]
        if pd.isna(end):
            ends[-1] = None
        return pd.DataFrame({"conv": own["conv"], "no": own["no"], "start": states[:-1], "end": pd.array(ends, dtype="Int32")})

    levels = [runs.select("conv", "no", "transfer")]
    while (levels[-1].agg(F.max("no")).first()[0] or 0) >= options.fan:
        higher = levels[-1].groupBy("conv", F.floor(F.col("no") / options.fan).alias("parent")).applyInPandas(
            combined, "conv string, no long, transfer array<long>")
        levels.append(written(spark, higher, "level"))
    above = levels[-1].select("conv", F.lit(0).cast("long").alias("parent")).distinct().withColumns(
        {"start": F.lit(START), "end": F.lit(None).cast("int")})
    for level in reversed(levels):
        children = level.withColumn("parent", F.floor(F.col("no") / options.fan)).join(above, ["conv", "parent"])
        states = children.groupBy("conv", "parent").applyInPandas(handed_down, "conv string, no long, start int, end int")
        above = written(spark, states, "states").withColumnRenamed("no", "parent")
    return above.withColumnRenamed("parent", "no")


def pieces(spark: SparkSession, rows: DataFrame, options: RepairOptions) -> DataFrame:
    """``PLACE, no, cost, letters, illegal``: the edits of each run, placed where the run begins."""
    runs = written(spark, cut_runs(rows, options), "runs")
    whole = runs.where("letters is not null").select(*PLACE, F.lit(0).cast("long").alias("no"), "cost", "letters", "illegal")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "key", "run")
    # Open runs: a few for each range, and one for each 4,096 rows of long conversations.
    parts = runs.where("letters is null").withColumns({
        "no": (F.row_number().over(order) - 1).cast("long"), "before": F.lag("tail").over(order),
        "conv": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))})
    numbered = written(spark, parts, "numbered")
    states = joined_by_levels(spark, numbered, options)
    legal = F.concat("before", F.lit("-"), "head").isin([f"{a}-{b}" for a, b in LEGAL])
    border = F.when(F.col("before").isNotNull() & ~legal, 1).otherwise(0)
    solved = F.udf(lambda codes, start, end: edits(bytes(codes), start, end), "cost long, letters string", useArrow=True)
    found = numbered.join(states, ["conv", "no"]).withColumn("found", solved("codes", "start", "end"))
    return whole.unionByName(found.select(
        *PLACE, "no", "found.cost", "found.letters", (F.col("illegal") + border).alias("illegal")))


ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}
CLASSES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


class Repair:
    """Rows and edits of one conversation as they come, the repaired ``role:text`` lines as they are known."""

    def __init__(self) -> None:
        self.letters, self.at, self.state = "", 0, START

    def more(self, letters: str) -> None:
        self.letters, self.at = self.letters[self.at:] + letters, 0

    def inserted(self) -> Iterator[str]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            self.state = FOLLOWS[self.state]
            yield f"{ROLE_NAMES[self.state]}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            self.state = FOLLOWS[self.state] if letter == "R" else CLASSES[role[:1]]
            yield f"{role if letter == 'K' else ROLE_NAMES[self.state]}:{text}"


def streamed(rows: DataFrame, edits_of: DataFrame) -> DataFrame:
    """Edits and rows of each conversation in order: a piece of edits comes before the rows it is for."""
    told = edits_of.select(*PLACE, F.lit(0).alias("kind"), "no", "letters", F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"))
    texts = rows.select("conv_id", "turn", "role", row_key(), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("no"),
                        F.lit(None).cast("string").alias("letters"), "text", "copies")
    order = [*PLACE, "kind", "no"]
    return told.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).select(
        "conv_id", "role", "letters", "text", "copies")


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, line)`` per repaired line and ``(conv_id, None)`` at the end of each conversation."""
    held, repair = None, None
    for batch in batches:
        for conv, role, letters, text, copies in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "letters", "text", "copies"))):
            if repair is None or conv != held:
                if repair is not None:
                    yield from ((held, line) for line in repair.inserted())
                    yield held, None
                held, repair = conv, Repair()
            if letters is not None:
                repair.more(letters)
            for _ in range(copies):
                yield from ((conv, line) for line in repair.row(role, text))
    if repair is not None:
        yield from ((held, line) for line in repair.inserted())
        yield held, None


def repaired_turns(spark: SparkSession, conversations: DataFrame, options: RepairOptions = RepairOptions()) -> DataFrame:
    """``conv_id, turn, line``: the repaired conversations, lines ``role:text`` numbered from 0."""
    rows = damaged(conversations)
    stream = streamed(rows, written(spark, pieces(spark, written(spark, coded(rows), "codes"), options), "edits"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        out, turn = [], 0
        for conv, line in conversations_of(batches):
            if line is None:
                turn = 0
                continue
            out.append((conv, turn, line))
            turn += 1
            if len(out) == 256:
                yield arrow(out)
                out = []
        yield arrow(out)

    kind = conversations.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    def arrow(out: list) -> pa.RecordBatch:
        ids, turns, texts = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(turns, pa.int64()), pa.array(texts, pa.string())],
                                          ["conv_id", "turn", "line"])

    return stream.mapInArrow(lines, T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("turn long, line string").fields]))


def digests(stream: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: a hash is fed line by line, so that no conversation is held."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        digest, lines, ids, found = hashlib.sha256(), 0, [], []
        for conv, line in conversations_of(typed()):
            if line is not None:
                digest.update(f"\n{line}".encode() if lines else line.encode())
                lines += 1
                continue
            ids.append(conv)
            found.append(digest.hexdigest())
            digest, lines = hashlib.sha256(), 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])

    return stream.mapInArrow(hashed, T.StructType([stream.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))


def repaired(spark: SparkSession, conversations: DataFrame, options: RepairOptions = RepairOptions()) -> DataFrame:
    """Per conversation: faults found, the cheapest edits, their cost and the digest of the result."""
    rows = damaged(conversations)
    codes = written(spark, coded(rows), "codes")
    edits_of = written(spark, pieces(spark, codes, options), "edits")
    audits = edits_of.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "letters"))), lambda piece: piece["letters"]), "").alias("audit"))
    found = (conversations.select("conv_id").distinct()
             .unionByName(row_counts(codes), allowMissingColumns=True).unionByName(audits, allowMissingColumns=True)
             .unionByName(digests(streamed(rows, edits_of)), allowMissingColumns=True))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.groupBy("conv_id").agg(
        *(F.coalesce(F.max(name), F.lit(0)).cast("long").alias(name) for name in counts),
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
