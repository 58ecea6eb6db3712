"""Repairs the order of turns in conversations by the cheapest edits, found by a Viterbi search whose survivors coalesce.

Rows of a conversation, in order, are kept, rerolled, deleted or preceded by inserted turns so that the roles read
``(system? (user assistant)+)?``. Blank rows and repeats of an earlier role and text must go. Costs: reroling and inserting 2,
deleting 3, and 1 for each truncated row that stays. Of equally cheap repairs the one whose edits, written as their
initials, come first in ASCII is taken.

A survivor is the best path into one of four states. Paths are leaves of a tree of backpointers with reference
counts: branches without a survivor go, and what all survivors have in common is emitted, so only what is undecided
is held. Two paths into different states differ before their ends, so their order, kept from step to step, compares
the whole of their undecided parts. A survivor that another beats whatever follows goes too.

A conversation is cut into parts of at most ``PART`` rows, found by a range sort of all rows without their texts.
Parts are searched on their own, from each state that they can begin in, and give the best way from state to state;
a second search of the same kind runs over the parts of each conversation. So the rows of one conversation are
spread over tasks like any others, and a task holds one part, or what is undecided of one conversation.

Rows go by turn, null turns first; rows of one turn by a hash of role and text, equal rows side by side. A null role
or text is one space. Conversations with a null id are one conversation. Texts of any length only move with the
repaired rows. Other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookframe.llm import checksums
from brookframe.llm.scratch import Scratch, cut

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: What an inserted turn or a role of one's choice leads to, by state.
ONWARD = (USER, USER, ASSISTANT, USER)
#: The most that following state q can cost less than following state p, as WORSE[p][q]: the edits that lead from p to what q could do.
WORSE = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
#: A row's code is a letter: four roles (system, user, assistant, other) times what is wrong with it.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
PART_BITS = 16
PART = 1 << PART_BITS
#: What a non-blank character is, and that a text's last one doesn't end a sentence.
WORD, CUT = r"[^\x20\x09-\x0D]", r"(?s)[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"

Moves = list[tuple[int, int, int, str]]


def code(fault: int, role: int) -> str:
    return chr(65 + 4 * fault + role)


@functools.cache
def moves(letter: str) -> Moves:
    """The best way from state to state over one row: (from, to, cost, edits)."""
    fault, role = divmod(ord(letter) - 65, 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in range(4):
        options = [(state, DELETE, "D")]
        at, cost, edits = state, 0, ""
        for _ in range(3 if fault < BLANK else 0):  # no, one or two turns inserted before the row
            stays = cost + (CUT_SHORT if fault == TRUNCATED else 0)
            if (role == 0 and at == START) or (role in (1, 2) and ONWARD[at] == role + 1):
                options.append((role + 1, stays, f"{edits}K"))
            options.append((ONWARD[at], stays + REROLE, f"{edits}R"))
            at, cost, edits = ONWARD[at], cost + INSERT, f"{edits}I"
        for to, cost, edits in options:
            best[state, to] = min(best.get((state, to), (cost, edits)), (cost, edits))
    return [(p, q, *found) for (p, q), found in best.items()]


#: What closes a conversation in each state.
CLOSING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


class _Branch:
    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent: _Branch | None, edits: str):
        self.parent, self.edits, self.children = parent, edits, []
        if parent:
            parent.children.append(self)


class Survivors:
    """The best path into each state so far. ``step`` and ``close`` return the edits of steps that are decided, oldest first."""

    def __init__(self, state: int = START):
        self.root = _Branch(None, "")
        #: (state, cost, branch), in the order of the paths' edits.
        self.heads = [(state, 0, self.root)]

    def _drop(self, branch: _Branch) -> None:
        """Removes a leaf, and what only led to it."""
        while branch is not self.root and not branch.children:
            branch.parent.children.remove(branch)
            branch = branch.parent

    def _decided(self) -> list[str]:
        """While all paths go through one branch, it is decided."""
        out = []
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            out.append(self.root.edits)
        return out

    def step(self, ways: Moves) -> list[str]:
        best: dict[int, tuple[int, int, str]] = {}
        by_state = {state: (order, cost) for order, (state, cost, _) in enumerate(self.heads)}
        for p, q, cost, edits in ways:
            if p in by_state:
                order, before = by_state[p]
                option = (before + cost, order, edits)
                if q not in best or option < best[q]:
                    best[q] = option
        alive = {q: x for q, x in best.items() if not any(y[0] + WORSE[p][q] < x[0] for p, y in best.items())}
        old = self.heads
        self.heads = [(q, cost, _Branch(old[order][2], edits)) for q, (cost, order, edits) in sorted(alive.items(), key=lambda x: x[1][1:])]
        for _, _, branch in old:
            self._drop(branch)
        return self._decided()

    def close(self) -> tuple[int, list[str], str]:
        """The cost of all, the edits of the steps not yet decided, and those after the last."""
        cost, _, branch, last = min((cost + CLOSING[state][0], order, branch, CLOSING[state][1]) for order, (state, cost, branch) in enumerate(self.heads))
        out = []
        while branch is not self.root:
            out.append(branch.edits)
            branch = branch.parent
        return cost, out[::-1], last


@functools.lru_cache(1 << 14)
def ways_through(letters: str, whole: bool) -> Moves:
    """The best ways from state to state over the rows of a part; a conversation's first part begins at the start only."""
    out: Moves = []
    for begin in (START,) if whole else range(4):
        paths, decided = Survivors(begin), []
        for letter in letters:
            decided += paths.step(moves(letter))
        head = "".join(decided)
        for state, cost, branch in paths.heads:
            tail = []
            while branch is not paths.root:
                tail.append(branch.edits)
                branch = branch.parent
            out.append((begin, state, cost, head + "".join(reversed(tail))))
    return out


def turns_out(letters: str, edits: str, state: int) -> tuple[list[tuple[int | None, str]], int]:
    """The turns that edits leave of a part's rows, as (place among the rows that could stay, or None if inserted; role initial), and the state after them."""
    out: list[tuple[int | None, str]] = []
    rows = iter(letters)
    live = 0
    for edit in edits:
        if edit == "I":
            state = ONWARD[state]
            out.append((None, "ua"[state - USER]))
            continue
        fault, role = divmod(ord(next(rows)) - 65, 4)
        if edit == "K":
            state = role + 1
            out.append((live, ""))
        elif edit == "R":
            state = ONWARD[state]
            out.append((live, "ua"[state - USER]))
        live += fault < BLANK
    return out, state


def illegal_neighbours(letters: str) -> int:
    """Pairs of rows next to each other whose roles aren't system-user, user-assistant or assistant-user."""
    roles = [(ord(x) - 65) % 4 for x in letters]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(roles, roles[1:]))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after each row has been damaged as a checksum of its id and turn says: dropped, emptied, without sentence ends, twice, or from the user."""
    fate = F.crc32(F.concat(_text(F.col("conv_id")), F.lit(":"), _text(F.col("turn"))).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"), fate.alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the conversation as a text that is never null, and 128-bit hashes of what is said and of the whole row."""
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    rows = rows.withColumn("conv", conv).withColumn("said", F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")))
    return rows.withColumn("row", F.md5(F.concat_ws("\0", "conv", F.coalesce(F.col("turn").cast("string"), F.lit("")), "said").cast("binary")))


class Repair:
    """The results of a repair as DataFrames: ``summary`` (a row for each conversation that has rows), ``edits`` (``conv, part, edits``)
    and ``turns`` (``conv, part, place, role, text``: what is left and inserted, in order). They rest on tables in ``scratch``."""

    def __init__(self, scratch: Scratch, rows: DataFrame):
        """``rows``: ``conv_id, turn, role, text`` and ``copies``, how many of each row there are side by side."""
        keyed = _keyed(rows)
        initial = F.substring("role", 1, 1)
        slim = keyed.select(
            "conv", "conv_id", "turn", "said", "row", "copies", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
            F.when(~F.col("text").rlike(WORD), BLANK).when(F.col("text").rlike(CUT), TRUNCATED).otherwise(FINE).alias("fault"),
        )
        slim = scratch.save(slim.groupBy("row", "conv", "turn", "said").agg(F.first("conv_id").alias("conv_id"), F.first("initial").alias("initial"), F.first("fault").alias("fault"), F.sum("copies").alias("copies")))
        # a row says something first if it is the first of those that say it; asked by row, so that a text that all say is spread as well
        first = slim.groupBy("conv", "said").agg(F.min(F.struct("turn", "row")).alias("f")).select(F.col("f.row").alias("row"), F.lit(True).alias("first"))
        slim = slim.join(first, "row", "left")
        fault = F.when((F.col("fault") == BLANK) | F.col("first"), F.col("fault")).otherwise(DUPLICATE)
        again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)

        def letter(kind: Column) -> Column:
            return F.chr(65 + 4 * kind + F.col("initial"))

        letters = F.concat(letter(fault), F.repeat(letter(again), (F.col("copies") - 1).cast("int")))
        ranged = slim.select("conv", "conv_id", "turn", "row", "copies", letters.alias("letters"), fault.alias("fault")).repartitionByRange("conv", "turn", "row").sortWithinPartitions("conv", "turn", "row")
        ordered = scratch.save(ranged.withColumn("at", F.monotonically_increasing_id()))
        part = ordered.groupBy("conv", F.shiftright("at", PART_BITS).alias("part")).agg(
            F.sort_array(F.collect_list(F.struct("at", "letters", "row", "fault"))).alias("rows"), F.first("conv_id").alias("conv_id"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        )
        whole = F.row_number().over(Window.partitionBy("conv").orderBy("part")) == 1  # parts of one conversation, not rows
        live = F.transform(F.filter("rows", lambda r: r["fault"] < BLANK), lambda r: r["row"])
        self._parts = scratch.save(part.select("conv", "part", "conv_id", F.array_join(F.transform("rows", lambda r: r["letters"]), "").alias("letters"), live.alias("live"), whole.alias("whole")))
        self._found = scratch.save(self._searched())
        counts = ordered.groupBy("conv").agg(
            F.first("conv_id").alias("conv_id"), F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("distinct_turns"),
            F.sum(F.when(F.col("fault") == BLANK, F.col("copies")).otherwise(0)).alias("blank"), F.count_if(F.col("fault") == TRUNCATED).alias("truncated"),
            F.sum(F.when(F.col("fault") == DUPLICATE, F.col("copies")).when(F.col("fault") < BLANK, F.col("copies") - 1).otherwise(0)).alias("duplicate"),
        )
        costs = self._found.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct_turns"), F.lit(0))
        self.summary = counts.join(costs, "conv").select("conv", "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")
        self.edits = self._found.select("conv", "part", "edits")
        out = self._found.select("conv", "part", F.posexplode("turns").alias("place", "t")).select("conv", "part", "place", "t.live", "t.role")
        named = out.join(self._parts.select("conv", "part", F.col("live").alias("names")), ["conv", "part"]).select("conv", "part", "place", F.get("names", F.col("live")).alias("row"), F.col("role").alias("given"))
        texts = keyed.select("row", F.col("role").alias("own"), "text").groupBy("row").agg(F.first("own").alias("own"), F.first("text").alias("text"))
        role = F.when(F.col("given") == "u", "user").when(F.col("given") == "a", "assistant").otherwise(F.col("own"))
        kept = named.filter("row is not null").join(texts, "row").select("conv", "part", "place", role.alias("role"), "text")
        self.turns = kept.unionByName(named.filter("row is null").select("conv", "part", "place", role_of("given").alias("role"), F.lit("").alias("text")))

    def _searched(self) -> DataFrame:
        """The edits of each part: all its ways first, then the search over the parts of each conversation."""

        def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
            for batch in batches:
                ways = [[dict(zip(("p", "q", "cost", "edits"), w)) for w in ways_through(letters, whole)] for letters, whole in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ways, kind)], ["conv", "part", "letters", "ways"])

        ways = self._parts.select("conv", "part", "letters", "whole").mapInArrow(through, "conv string, part long, letters string, ways array<struct<p: int, q: int, cost: long, edits: string>>")
        return ways.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_search_parts, FOUND)


FOUND = "conv string, part long, edits string, cost long, illegal long, turns array<struct<live: int, role: string>>"


def role_of(initial: str) -> Column:
    return F.when(F.col(initial) == "u", "user").otherwise("assistant")


def _search_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`FOUND` from parts with their ways, sorted by conversation and part; a part is let go as soon as its edits are decided."""
    turns = pa.list_(pa.struct([("live", pa.int32()), ("role", pa.string())]))
    schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("edits", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("turns", turns)])

    def rows() -> Iterable[dict]:
        conv, paths, state = None, Survivors(), START
        held: deque[tuple[int, str, int]] = deque()
        pending: deque[str] = deque()

        def told(edits: str, cost: int = 0, last: str = "") -> dict:
            nonlocal state
            part, letters, illegal = held.popleft()
            out, state = turns_out(letters, edits + last, state)
            return {"conv": conv, "part": part, "edits": edits + last, "cost": cost, "illegal": illegal, "turns": [{"live": i, "role": r} for i, r in out]}

        def closed() -> Iterable[dict]:
            cost, rest, last = paths.close()
            pending.extend(rest)
            while pending:
                edits = pending.popleft()
                yield told(edits) if pending else told(edits, cost, last)

        before = ""
        for batch in batches:
            for row in batch.to_pylist():
                if row["conv"] != conv:
                    if held:
                        yield from closed()
                    conv, paths, state, before = row["conv"], Survivors(), START, ""
                held.append((row["part"], row["letters"], illegal_neighbours(before + row["letters"])))
                before = row["letters"][-1]
                decided = paths.step([(w["p"], w["q"], w["cost"], w["edits"]) for w in row["ways"]])
                pending.extend(decided)
                while pending and len(held) > 1:  # the last part waits for the end, which it tells the cost of
                    yield told(pending.popleft())
        if held:
            yield from closed()

    found: list[dict] = []
    for row in rows():
        found.append(row)
        if len(found) == 4096:
            yield pa.RecordBatch.from_pylist(found, schema)
            found = []
    if found:
        yield pa.RecordBatch.from_pylist(found, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv, repaired_sha256`` of turns sorted by conversation, as they come by."""
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    conv = digest = None
    for batch in batches:
        done = []
        for c, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if c != conv:
                if digest:
                    done.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                conv, digest = c, hashlib.sha256(f"{role}:".encode())
            else:
                digest.update(f"\n{role}:".encode())
            digest.update(text.as_buffer())
        yield pa.RecordBatch.from_pylist(done, schema)
    if digest:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """Per original conversation, counts of what the damage did to it, and its repair by cost, edits and a hash of the repaired turns.

    The hash of a conversation and the text of its edits are single values over all of its rows, so here, and only
    here, a task reads all repaired turns of a conversation, one after another.
    """
    empty = hashlib.sha256(b"").hexdigest()
    with Scratch(conversations.sparkSession) as scratch:
        repair = Repair(scratch, damaged(conversations))
        audits = repair.edits.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "edits"))).alias("e")).select("conv", F.array_join(F.transform("e", lambda x: x["edits"]), "").alias("audit"))
        hashes = repair.turns.repartition("conv").sortWithinPartitions("conv", "part", "place").select("conv", "role", "text").mapInArrow(_hashed, "conv string, repaired_sha256 string")
        found = repair.summary.join(audits, "conv").join(hashes, "conv", "left").drop("conv").withColumn("there", F.lit(True))
        every = conversations.select("conv_id").distinct()
        out = every.join(found, every["conv_id"].eqNullSafe(found["conv_id"]), "left").drop(found["conv_id"])
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return cut(out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")))


def _with(path: str, cost: str | int, edits: str, turn: str = "''") -> str:
    """SQL of a path (its cost in nine digits, edits, the character 1, repaired turns) with more of each."""
    return f"printf('%09d', left({path}, 9)::BIGINT + {cost}) || substr({path}, 10, strpos({path}, chr(1)) - 10) || '{edits}' || substr({path}, strpos({path}, chr(1))) || {turn}"


def _inserted(path: str, role: str) -> str:
    return _with(path, INSERT, "I", f"chr(10) || '{role}:'")


def _row_sql() -> str:
    """The best path into each state (start, system, user, assistant as s, y, u, a) over one row, by recursion."""
    stay, own = "(fault = 1)::INT", "chr(10) || role || ':' || text"
    kept = lambda p, initial: f"CASE WHEN fault < 2 AND initial = '{initial}' THEN {_with(p, stay, 'K', own)} END"
    rerolled = lambda p, role: f"CASE WHEN fault < 2 THEN {_with(p, stay + f' + {REROLE}', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"
    to_user = ", ".join(f"{kept(p, 'u')}, {rerolled(p, 'user')}" for p in ("s", "y", "a2"))
    step = f"{_with('s', DELETE, 'D')} AS s, least({_with('y', DELETE, 'D')}, {kept('s', 's')}) AS y, least({_with('u', DELETE, 'D')}, {to_user}) AS u, least({_with('a', DELETE, 'D')}, {kept('u2', 'a')}, {rerolled('u2', 'assistant')}) AS a"
    once = f"SELECT *, least(u, {_inserted('s', 'user')}, {_inserted('y', 'user')}, {_inserted('a', 'user')}) AS u1, least(a, {_inserted('u', 'assistant')}) AS a1 FROM v JOIN numbered r ON r.conv IS NOT DISTINCT FROM v.c AND r.n = v.seen + 1"
    twice = f"SELECT *, least(u1, {_inserted('a1', 'user')}) AS u2, least(a1, {_inserted('u1', 'assistant')}) AS a2 FROM ({once})"
    return f"v AS (SELECT DISTINCT conv AS c, 0::BIGINT AS seen, '000000000' || chr(1) AS s, NULL::VARCHAR AS y, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM numbered UNION ALL SELECT c, seen + 1, {step} FROM ({twice}))"


#: What the query returns: the same search row by row, each path with all of its edits and turns.
SQL = f"""WITH RECURSIVE {checksums.TABLE},
given AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS x FROM conversations),
fated AS (SELECT conv, turn, role, text, {checksums.crc32("x")} % 20 AS fate FROM given, crc),
damaged AS (SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM fated WHERE fate <> 0),
numbered AS (SELECT conv, turn, role, text, CASE left(role, 1) WHEN 's' THEN 's' WHEN 'u' THEN 'u' WHEN 'a' THEN 'a' ELSE 'x' END AS initial, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS n,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 2 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 3 WHEN regexp_matches(text, '[^\\x20\\x09-\\x0D.!?][\\x20\\x09-\\x0D]*$') THEN 1 ELSE 0 END AS fault FROM damaged),
faults AS (SELECT *, n > 1 AND (lag(initial) OVER w || initial) NOT IN ('su', 'ua', 'au') AS clash FROM numbered WINDOW w AS (PARTITION BY conv ORDER BY n)),
counts AS (SELECT conv, max(n) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 2) AS blank, count(*) FILTER (WHERE fault = 3) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated, count(*) FILTER (WHERE clash) AS illegal FROM faults GROUP BY conv),
{_row_sql()},
done AS (SELECT c, least(s, a, {_inserted("u", "assistant")}, {_with("y", 2 * INSERT, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'")}) AS path FROM v JOIN counts ON conv IS NOT DISTINCT FROM c AND seen = n_rows)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(path, 9)::BIGINT, 0) AS cost,
  coalesce(substr(path, 10, strpos(path, chr(1)) - 10), '') AS audit, sha256(coalesce(substr(path, strpos(path, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts k ON k.conv IS NOT DISTINCT FROM d.conv_id LEFT JOIN done ON done.c IS NOT DISTINCT FROM d.conv_id"""
