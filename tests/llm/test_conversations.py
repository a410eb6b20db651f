"""Conversation repair against an exhaustive search, in one run and over many runs and levels."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from compare import difference, duck
from plaudit.llm import conversations as cv
from plaudit.llm.queries import ORACLES, QUERIES

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if value is None else value for value in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return sorted(out, key=lambda row: (row[0] is not None, row[0] or 0, row[1],
                                        hashlib.md5(f"{len(row[1])}:{row[1]}{row[2]}".encode()).digest()))


def judge(rows):
    seen, found = set(), []
    for _, role, text in rows:
        blank, again = not text.strip(BLANKS), (role, text) in seen
        seen.add((role, text))
        found.append("blank" if blank else "duplicate" if again else "" if text.strip(BLANKS)[-1] in ".!?" else "truncated")
    return found


def cheapest(rows, faults):
    """All edits, by the roles so far: cost, audit, lines."""
    @cache
    def rest(at, state, inserts):
        found = []
        if at == len(rows):
            if state in "0a":
                found.append((0, "", ()))
        else:
            _, role, text = rows[at]
            late = 3 * (faults[at] == "truncated")
            cost, audit, lines = rest(at + 1, state, 0)
            found.append((cost + 4, "D" + audit, lines))
            if faults[at] not in ("blank", "duplicate"):
                for letter, new in [("K", role), ("R", "user"), ("R", "assistant")]:
                    if (state, new[:1]) in {("0", "s"), ("0", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        cost, audit, lines = rest(at + 1, new[:1], 0)
                        found.append((cost + late + 3 * (letter == "R"), letter + audit, (f"{new}:{text}", *lines)))
        if inserts < 3:
            for new in ("user", "assistant"):
                if (state, new[0]) in {("0", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    cost, audit, lines = rest(at, new[0], inserts + 1)
                    found.append((cost + 3, "I" + audit, (f"{new}:", *lines)))
        return min(found) if found else (10**9, "", ())
    return rest(0, "0", 0)


def expected(rows):
    result = {}
    for conv in {row[0] for row in rows}:
        own = damage([row for row in rows if row[0] == conv])
        faults = judge(own)
        cost, audit, lines = cheapest(own, faults)
        turns = [turn for turn, _, _ in own if turn is not None]
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(own, own[1:])]
        result[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(name) for name in ("blank", "duplicate", "truncated")),
                        sum(pair not in ("su", "ua", "au") for pair in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def made_up(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randrange(most)):
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                         rng.choice(["Fine.", "Is it?", "Well! \n", "cut off", "", " \t", "same text.", None, f"text {turn}.", "é\U0001F600 x"])))
    return rows + rows[::7]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("options", [cv.RepairOptions(), cv.RepairOptions(run_rows=1, fan=2), cv.RepairOptions(run_rows=3, fan=2)])
def test_repair_equals_exhaustive_search(spark, options):
    rows = made_up(1, 60, 12)
    found = cv.repaired(spark, spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as no", "'x' as cost"), options).collect()
    assert {row.conv_id: tuple(row[name] for name in COLUMNS) for row in found} == expected(rows)


def test_a_long_conversation_lies_in_many_runs(spark):
    """One conversation with most of all rows, a third of them the same row, over four levels."""
    rng = random.Random(4)
    rows = [(7, turn, rng.choice(["user", "assistant"]), rng.choice([f"text {turn}.", f"text {turn}", "same."])) for turn in range(600)]
    rows += [(7, 90, "user", "copied.")] * 300 + [(conv, 0, "user", "Hello.") for conv in range(20)]
    found = {row.conv_id: tuple(row[name] for name in COLUMNS) for row in cv.repaired(
        spark, spark.createDataFrame(rows, SCHEMA), cv.RepairOptions(run_rows=10, fan=3)).collect()}
    import sys
    sys.setrecursionlimit(20_000)
    assert found == expected(rows)
    lines = cv.repaired_turns(spark, spark.createDataFrame(rows, SCHEMA), cv.RepairOptions(run_rows=10, fan=3)).where("conv_id = 7").collect()
    assert [row.turn for row in lines] == list(range(len(lines)))
    assert hashlib.sha256("\n".join(row.line for row in lines).encode()).hexdigest() == found[7][-1]


def test_crossings_keep_no_table():
    """The edits of a run equal a plain walk that keeps the best audit of every state."""
    rng = random.Random(5)
    for _ in range(200):
        codes = bytes(rng.choice([0, 1, 2, 3, 2, 3, 6, 7, 10, 11]) for _ in range(rng.randrange(1, 40)))
        best = {cv.START: (0, "")}
        for code in codes:
            after = {}
            for state, (cost, letters) in best.items():
                for end, (more, text) in enumerate(cv.row_edits(code)[state]):
                    if more < cv.NEVER:
                        after[end] = min(after.get(end, (cv.NEVER, "")), (cost + more, letters + text))
            best = after
        assert cv.edits(codes) == min((cost + 3 * len(cv.CLOSING[state]), letters + cv.CLOSING[state]) for state, (cost, letters) in best.items())


def test_nothing_to_repair(spark):
    assert cv.repaired(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(conv for conv in range(10_000) if zlib.crc32(f"{conv}:0".encode()) % 20 == 0)
    row = cv.repaired(spark, spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


@pytest.mark.parametrize("folder", [SMALL, MORE])
def test_counterpart(spark, folder):
    assert difference(QUERIES["op11_conversation_repair"](spark, folder), duck(folder), ORACLES["op11_conversation_repair"]) is None
