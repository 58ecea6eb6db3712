"""The search against all edits of short conversations, parts against wholes, and the query against SQL."""

import functools
import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brookframe.llm import queries, turn_repair
from brookframe.llm.turn_repair import START, Survivors, _search_parts, code, moves, ways_through


sys.setrecursionlimit(20_000)


def cheapest(letters):
    """Cost and edits by trying all edits of all suffixes, up to three inserted turns anywhere."""

    @functools.cache
    def best(i, state, inserted):
        options = []
        if i == len(letters) and state in (0, 3):
            options.append((0, ""))
        onward = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        if inserted < 3:
            c, e = best(i, onward, inserted + 1)
            options.append((c + 2, "I" + e))
        if i < len(letters):
            fault, role = divmod(ord(letters[i]) - 65, 4)
            c, e = best(i + 1, state, 0)
            options.append((c + 3, "D" + e))
            if fault < 2:
                c, e = best(i + 1, onward, 0)
                options.append((c + 2 + fault, "R" + e))
                if (role == 0 and state == 0) or role + 1 == onward and role in (1, 2):
                    c, e = best(i + 1, role + 1, 0)
                    options.append((c + fault, "K" + e))
        return min(options, default=(10**9, ""))

    return best(0, 0, 0)


def searched(parts):
    """By ways through each part, then over the parts."""
    rows = [{"conv": "c", "part": i, "letters": p, "ways": [dict(zip(("p", "q", "cost", "edits"), w)) for w in ways_through(p, i == 0)]} for i, p in enumerate(parts)]
    out = [r for b in _search_parts(iter([pa.RecordBatch.from_pylist(rows[:1]), pa.RecordBatch.from_pylist(rows[1:])] if rows[1:] else [pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    assert [r["part"] for r in out] == list(range(len(parts)))
    return sum(r["cost"] for r in out), "".join(r["edits"] for r in out), [t["role"] for r in out for t in r["turns"]]


def test_search_against_all_edits():
    rng = random.Random(3)
    for _ in range(4000):
        weights = rng.choice([[1] * 16, [9, 9, 9, 0, 1, 1, 1, 0, 1, 0, 0, 0, 1, 1, 0, 0], [1, 0, 9, 5, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0]])
        letters = "".join(rng.choices([chr(65 + i) for i in range(16)], weights, k=rng.randint(1, 9)))
        cuts = sorted(rng.sample(range(1, len(letters)), rng.randint(0, min(3, len(letters) - 1))))
        parts = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)])]
        cost, edits, _ = searched(parts)
        assert (cost, edits) == cheapest(letters), (letters, parts)
        assert searched([letters]) == searched(parts)


def test_memory_is_bounded_by_what_is_undecided():
    rng = random.Random(5)
    paths, decided, most = Survivors(), [], 0
    letters = [code(rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(4)) for _ in range(20_000)]
    for letter in letters:
        decided += paths.step(moves(letter))
        most = max(most, len(letters[: len(decided)]) and sum(1 for _ in branches(paths)))
    assert most < 200
    _, rest, _ = paths.close()
    assert len(decided) + len(rest) == len(letters)


def branches(paths):
    seen = set()
    for _, _, branch in paths.heads:
        while branch is not paths.root and id(branch) not in seen:
            seen.add(id(branch))
            yield branch
            branch = branch.parent


def brute(rows):
    """The query's result by its description, row by row."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = by_conv[conv]
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if x:
            text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
            kept += [(turn, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)
    out = set()
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        letters, seen, count = "", set(), [0, 0, 0, 0]
        for _, role, text in kept:
            words = text.strip(" \t\n\v\f\r")
            fault = 2 if not words else 3 if (role, text) in seen else 1 if words[-1] not in ".!?" else 0
            seen.add((role, text))
            count[fault] += 1
            letters += code(fault, {"s": 0, "u": 1, "a": 2}.get(role[:1], 3))
        roles = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(letters)
        left, state, i = [], "", 0
        for e in audit:
            following = "assistant" if state == "u" else "user"
            if e == "I":
                left.append(f"{following}:")
            else:
                _, role, text = kept[i]
                i += 1
                if e == "D":
                    continue
                left.append(f"{role if e == 'K' else following}:{text}")
            state = left[-1][0]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in left))
        out.add((conv, gaps, count[2], count[3], count[1], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def test_whole_table_against_brute_force(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert {tuple(r) for r in queries.op12_turn_repair(spark, sf).collect()} == brute(rows)


def test_whole_table_against_sql(spark, sf, con):
    got = queries.op12_turn_repair(spark, sf)
    assert {tuple(r) for r in got.collect()} == set(con.execute(turn_repair.SQL).df()[got.columns].astype(object).itertuples(index=False, name=None))


def test_edges(spark):
    long = "word " * 50_000
    rows = [
        (1, None, None, None), (1, None, None, None), (1, 2, "tool", "Fine."), (2, 1, "user", ""), (3, 0, "system", long), (3, 1, "user", long + "?"), (3, 5, "assistant", long + "!"), (3, -4, "assistant", "é漢。"),
        (None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, 3, "assistant", "Hi."), (4, None, "user", "a"), (5, 7, "", "x."), (6, 0, "assistant", "No."),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    assert {tuple(r) for r in turn_repair.repair_digest(df).collect()} == brute(rows)
    assert not turn_repair.repair_digest(df.limit(0)).collect()


@pytest.mark.parametrize("bits", [2, 16])
def test_one_conversation_with_most_rows(spark, bits, monkeypatch):
    """Cut into parts of 4 rows, and into one."""
    monkeypatch.setattr(turn_repair, "PART_BITS", bits)
    rng = random.Random(7)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "assistant", "tool"]), rng.choice(["Yes.", f"No {i}.", f"And {i}", f"So {i}!"])) for i in range(300)]
    rows += [(2, i, "user", "Same.") for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in turn_repair.repair_digest(df).collect()} == brute(rows)
