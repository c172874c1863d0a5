"""Repair of conversation structure by depth-first branch and bound.

A repaired conversation has an optional system turn and then pairs of a user and an assistant turn.  Each row is kept,
given another role, or deleted, and empty turns may be put in; the cheapest edits win, of equal costs the least audit
(the edits' initials in order).  Blank and repeated rows can only go, so they never branch.

Rows travel to the search as digests and flags, not as texts.  They are dealt out by ranges of (conversation, turn, role,
digest), so a conversation of any length is spread over tasks.  A task cuts it into segments and searches each from every
state that can precede it: explicit stack, suffix lower bounds, incumbent (cost, audit) and a table that holds the best
prefix of every node.  Segments chain by cost, then by the order of what came before, then by their own audit.  What is
left of conversations that cross tasks chains the same way, a row per task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import small
from quillspan.session import cut_lineage

# Fixed values of the contract: what separates words, what ends a turn, legal neighbours, costs.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")
DAMAGES = 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States between two turns: nothing yet, after system, after user, after assistant; and what may close a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
CLOSING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Two states' cheapest ways on differ by no more than this, so an exit that costs more is never of use.
STATE_GAP = 7
#: Rows of a segment that may branch; sets the work of one search, not the result.
SEGMENT_ROWS = 64

Row = tuple[str, bool]  # role initial, truncated


def suffix_bounds(rows: tuple[Row, ...]) -> list[int]:
    """For every suffix of ``rows`` a cost that no repair of it undercuts.

    A truncated row costs at least its fee, a row of another role at least an edit; of two neighbours that are illegal
    side by side one must be edited or an insert put between, and such pairs count as long as they share no row.
    """
    least = [
        min(REROLE + TRUNCATED * cut, DELETE) if role and role not in "sua" else min(TRUNCATED * cut, DELETE) for role, cut in rows
    ]
    bounds = [0] * (len(rows) + 2)
    for i in range(len(rows) - 1, -1, -1):
        bounds[i] = least[i] + bounds[i + 1]
        if i + 1 < len(rows):
            (left, cut), (right, other_cut) = rows[i], rows[i + 1]
            if left and right and left in "sua" and right in "sua" and left + right not in LEGAL:
                more = DELETE - TRUNCATED if cut or other_cut else min(INSERT, REROLE)
                bounds[i] = max(bounds[i], least[i] + least[i + 1] + more + bounds[i + 2])
    return bounds[:-1]


def after(state: int, initial: str) -> int | None:
    """State after a kept turn with this role initial, None where it may not stand; a role without letters changes nothing."""
    if not initial:
        return state
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def other(state: int) -> int:
    """State after a turn whose role is free to choose between user and assistant."""
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=1 << 16)
def search(rows: tuple[Row, ...], entry: int, closing: bool) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from ``entry`` over all rows, by exit state; with ``closing`` only the closed whole, as NOTHING.

    Inserts stand before the row they serve; after the last row they are made only when closing.
    """
    bounds, size = suffix_bounds(rows), len(rows)
    nodes: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    found: dict[int, tuple[int, str]] = {}
    limit, stack = float("inf"), [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if nodes[(at, state)] != (cost, audit) or cost + bounds[at] > limit:
            continue  # a better prefix has come since, or the incumbent is out of reach
        steps = []
        if at == size:
            done = state if not closing else NOTHING
            if not closing or state in (NOTHING, ASSISTANT):
                if done not in found or (cost, audit) < found[done]:
                    found[done] = (cost, audit)
                    limit = min(limit, cost + (0 if closing else STATE_GAP))
        else:
            role, cut = rows[at]
            fee, kept = TRUNCATED * cut, after(state, role)
            steps.append((at + 1, state, cost + DELETE, audit + "D"))
            steps.append((at + 1, other(state), cost + fee + REROLE, audit + "R"))
            if kept is not None:
                steps.append((at + 1, kept, cost + fee, audit + "K"))
        if at < size or closing:
            steps.append((at, other(state), cost + INSERT, audit + "I"))
        steps.sort(key=lambda step: (step[2] + bounds[step[0]], step[3]), reverse=True)  # the most promising on top
        for step in steps:
            place, now, spent, letters = step
            known = nodes.get((place, now))
            if spent + bounds[place] <= limit and (known is None or (spent, letters) < known):
                nodes[(place, now)] = (spent, letters)
                stack.append(step)
    return found


def chain(tables: list[dict[tuple[int, int], tuple[int, object]]], entry: int) -> dict[int, tuple[int, list]]:
    """Cheapest way from ``entry`` through all tables, by exit: (cost, the piece of each table).

    A table maps (entry, exit) to (cost, piece).  Of equal costs the least sequence of pieces wins; the pieces of two ways
    that part at a table have the same entry there and differ, so their order is the order of the ways.
    """
    reached, ways = {entry: (0, 0)}, []
    for table in tables:
        best: dict[int, tuple] = {}
        for (start, end), (cost, piece) in table.items():
            if start in reached:
                way = (reached[start][0] + cost, reached[start][1], piece, start)
                if end not in best or way[:3] < best[end][:3]:
                    best[end] = way
        order = sorted(best, key=lambda end: best[end][1:3])
        reached = {end: (best[end][0], order.index(end)) for end in best}
        ways.append(best)
    out = {}
    for end, (cost, _) in reached.items():
        pieces, state = [], end
        for best in reversed(ways):
            pieces.append(best[state][2])
            state = best[state][3]
        out[end] = (cost, pieces[::-1])
    return out


def closed(ways: dict[int, tuple[int, list]]) -> tuple[int, list, int]:
    """(cost, pieces, inserts at the end) of the best of the ways, by exit, once each is closed."""
    cost, pieces, end = min((cost + INSERT * CLOSING[end], pieces, end) for end, (cost, pieces) in ways.items())
    return cost, pieces, CLOSING[end]


def spliced(audit: str, forced: list[int]) -> str:
    """The audit with ``forced[k]`` deletions after ``k`` of its rows; they come before inserts, as D is less than I."""
    if not any(forced):
        return audit
    out, k = ["D" * forced[0]], 0
    for piece in re.findall("I*[DKR]|I+$", audit):
        out.append(piece)
        if piece[-1] != "I":
            k += 1
            out.append("D" * forced[k])
    return "".join(out)


class Run:
    """The rows of one conversation that one task sees, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.forced = conv_id, [], [0]
        self.counts = dict.fromkeys(("n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns"), 0)
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role: str, copies: int, blank: bool, first: bool, cut: bool) -> None:
        if not copies:
            return
        counts, initial = self.counts, role[:1]
        counts["illegal"] += copies - 1 + (self.last is not None and self.last + initial not in LEGAL)
        counts["n_rows"] += copies
        if turn is not None:
            counts["n_turns"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.first is None else self.first, initial
        free = int(first and not blank)
        if free:
            counts["truncated"] += cut
            self.rows.append((initial, cut))
            self.forced.append(0)
        self.forced[-1] += copies - free
        counts["blank" if blank else "duplicate"] += copies - free

    def result(self, whole: bool) -> dict:
        """Counts and edits; of a part (not ``whole``) the edits for each pair of entry and exit state, four by four."""
        out = {"conv_id": self.conv_id, "whole": whole, "first": self.first, "last": self.last, "low": self.low, "high": self.high}
        fixed = DELETE * sum(self.forced)
        segments = [tuple(self.rows[k:k + SEGMENT_ROWS]) for k in range(0, len(self.rows), SEGMENT_ROWS)]
        if whole and len(segments) < 2:
            cost, audit = search(tuple(self.rows), NOTHING, True)[NOTHING]
            return out | self.counts | {"costs": [cost + fixed], "ranks": [0], "audits": [spliced(audit, self.forced)]}
        tables = [
            {(start, end): way for start in range(4) for end, way in search(rows, start, False).items()} for rows in segments
        ]
        if whole:
            cost, pieces, more = closed(chain(tables, NOTHING))
            return out | self.counts | {
                "costs": [cost + fixed], "ranks": [0], "audits": [spliced("".join(pieces) + "I" * more, self.forced)]
            }
        costs, ranks, audits = [None] * 16, [None] * 16, [None] * 16
        for start in range(4):
            ways = chain(tables, start)
            order = sorted(ways, key=lambda end: ways[end][1])
            for end, (cost, pieces) in ways.items():
                at = 4 * start + end
                costs[at], ranks[at], audits[at] = cost + fixed, order.index(end), spliced("".join(pieces), self.forced)
        return out | self.counts | {"costs": costs, "ranks": ranks, "audits": audits}


RUNS = (
    "conv_id bigint, whole boolean, first string, last string, low bigint, high bigint, n_rows bigint, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, n_turns bigint, costs array<bigint>, ranks array<int>, audits array<string>, part int"
)
COUNTS = "n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def prepared(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (1): nulls in role and text become one space; ids and turns stay null."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), space("role"), space("text"), F.lit(1).cast("bigint").alias("copies")
    )


def damage(turns: DataFrame) -> DataFrame:
    """``prepared`` rows with faults by a hash of conversation and turn (null: one space); dropped rows have no copies."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % DAMAGES
    return prepared(turns).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _mark(role="role", text="text"):
    """Digest of role and text: what makes a row a duplicate, and the last key of its order."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)).cast("binary")))


def _order(*before):
    return [*before, F.col("turn").asc_nulls_first(), "role", "mark"]


def flagged(turns: DataFrame) -> DataFrame:
    """One row for each distinct (conversation, turn, role, text): digest and flags in place of the text, and its copies."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    blank = last == ""
    light = turns.select("conv_id", "turn", "role", "copies", blank.alias("blank"), (~blank & ~last.isin(*ENDS)).alias("cut"), _mark().alias("mark"))
    rows = light.groupBy("conv_id", "turn", "role", "mark").agg(
        F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut")
    )
    earliest = light.where("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))).alias("_first")
    )
    joined = rows.join(earliest, rows["conv_id"].eqNullSafe(earliest["_conv"]) & (rows["mark"] == earliest["_mark"]), "left")
    return joined.select(
        "conv_id", "turn", "role", "mark", "copies", "blank", F.col("turn").eqNullSafe(F.col("_first.turn")).alias("first"), "cut"
    )


def solved_runs(rows: DataFrame) -> DataFrame:
    """``RUNS`` of the rows of ``flagged``: the first and the last conversation of a task may go on elsewhere."""
    columns = ["turn", "role", "copies", "blank", "first", "cut"]

    def table(results: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(results, schema=pa.schema([
            ("conv_id", pa.int64()), ("whole", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()),
            ("high", pa.int64()), *((c, pa.int64()) for c in ("n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns")),
            ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("part", pa.int32()),
        ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, opened, results = TaskContext.get().partitionId(), None, 0, []
        for batch in small(batches, 4096):
            for conv_id, *values in zip(batch.column("conv_id").to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        results.append(now.result(opened > 1) | {"part": part})
                    now, opened = Run(conv_id), opened + 1
                now.add(*values)
            if len(results) >= 1024:
                yield table(results)
                results = []
        if now is not None:
            results.append(now.result(False) | {"part": part})
        if results:
            yield table(results)

    keys = _order("conv_id")
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, RUNS)


def _joined_runs(group: pd.DataFrame) -> pd.DataFrame:
    """Counts of a conversation from its runs, and for each run which of its sixteen audits holds."""
    runs = group.sort_values("part").to_dict("records")
    total = {c: sum(r[c] for r in runs) for c in ("n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns")}
    last = low = high = None
    for r in runs:
        if r["n_rows"]:
            total["illegal"] += last is not None and last + r["first"] not in LEGAL
            last = r["last"]
        if not pd.isna(r["low"]):
            total["n_turns"] -= high is not None and high == r["low"]
            low, high = r["low"] if low is None else low, r["high"]
    tables = [
        {(at // 4, at % 4): (int(cost), (int(rank), at)) for at, (cost, rank) in enumerate(zip(r["costs"], r["ranks"])) if not pd.isna(cost)}
        for r in runs
    ]
    cost, picks, more = closed(chain(tables, NOTHING))
    gaps = 0 if low is None else int(high) - int(low) + 1 - total["n_turns"]
    return pd.DataFrame({
        "conv_id": [runs[0]["conv_id"]], **{c: [total[c]] for c in ("n_rows", "blank", "duplicate", "truncated", "illegal")}, "gaps": [gaps],
        "cost": [cost], "parts": [[r["part"] for r in runs]], "picks": [[at for _, at in picks]], "more": [more],
    })


def repairs(turns: DataFrame) -> DataFrame:
    """conv_id, ``COUNTS`` and audit of every conversation of ``turns`` (as ``damage`` gives them).

    Rows stand by turn (null first), then role, then a digest of role and text; equal rows are adjacent.  A conversation
    whose rows are all dropped has zeros and an empty audit; a null conv_id is a conversation of its own; an empty table
    gives an empty table.  Columns besides the five are not read.
    """
    rows = cut_lineage(flagged(turns), "repair-rows")
    runs = cut_lineage(solved_runs(rows), "repair-runs")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0))
    whole = runs.where("whole").select(
        "conv_id", "n_rows", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit")
    )
    parts = runs.where("not whole")
    joined = cut_lineage(parts.drop("audits", "whole").groupBy("conv_id").applyInPandas(
        _joined_runs, f"conv_id bigint, {COUNTS}, parts array<int>, picks array<int>, more int"
    ), "repair-joined")
    chosen = joined.select("conv_id", F.explode(F.arrays_zip("parts", "picks")).alias("p")).select(
        F.col("conv_id").alias("_conv"), F.col("p.parts").alias("part"), F.col("p.picks").alias("pick")
    )
    pieces = parts.join(chosen, parts["conv_id"].eqNullSafe(chosen["_conv"]) & (parts["part"] == chosen["part"])).groupBy("_conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(chosen["part"], F.expr("audits[pick]").alias("audit")))), lambda p: p["audit"]), "").alias("_audit")
    )
    crossing = joined.join(pieces, joined["conv_id"].eqNullSafe(pieces["_conv"])).select(
        "conv_id", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("_audit", F.repeat(F.lit("I"), F.col("more"))).alias("audit")
    )
    return whole.unionByName(crossing)


class Replay:
    """Applies an audit to the rows of its conversation as they come."""

    def __init__(self, conv_id, audit: str):
        self.conv_id, self.audit, self.at, self.state, self.place = conv_id, audit, 0, NOTHING, 0

    def _turn(self, role: str | None, text: str, edit: str) -> tuple[str, str, str]:
        """The next repaired turn; without a role it takes the one that may stand here."""
        self.state = other(self.state) if role is None else after(self.state, role[:1])
        return role if role is not None else ("assistant" if self.state == ASSISTANT else "user"), text, edit

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._turn(None, "", "I")

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += copies  # further copies are duplicates and go
        if edit == "K":
            yield self._turn(role, text, "K")
        elif edit == "R":
            yield self._turn(None, text, "R")


def _replayed(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's row of ``found`` and then its turns in order, in the task that its id hashes to."""
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.unhex(F.lit("")).alias("mark"),
        F.lit("").alias("text"), F.lit(0).cast("bigint").alias("copies"), "audit",
    )
    rows = turns.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", _mark().alias("mark"), "text", "copies", F.lit("").alias("audit")
    )
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*_order("conv_id", "kind"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Replay, tuple[str, str, str] | None]]:
    """(conversation, repaired turn) in order, and (conversation, None) at the end of each one."""
    now = None
    for batch in small(batches, 1024):
        for conv_id, kind, role, text, copies, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "copies", "audit"))):
            if kind == 0:
                if now is not None:
                    yield from ((now, turn) for turn in now.inserts())
                    yield now, None
                now = Replay(conv_id, audit)
                continue
            for _ in range(copies):
                yield from ((now, turn) for turn in now.row(role, text, 1))
    if now is not None:
        yield from ((now, turn) for turn in now.inserts())
        yield now, None


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text, edit (K, R or I): the turns of the repaired conversations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        for now, turn in _walk(batches):
            if turn is not None:
                rows.append({"conv_id": now.conv_id, "place": now.place, "role": turn[0], "text": turn[1], "edit": turn[2]})
                now.place += 1
            if len(rows) >= 512:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _replayed(turns, found).mapInArrow(run, "conv_id bigint, place bigint, role string, text string, edit string")


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: SHA-256 of the repaired turns as ``role:text`` lines joined by newlines.

    The digest of a conversation is one byte stream, so its turns pass through one task, one at a time; nothing is gathered.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, sha = [], [], hashlib.sha256()
        names = ["conv_id", "repaired_sha256"]
        for now, turn in _walk(batches):
            if turn is not None:
                sha.update(("\n" * (now.place > 0) + f"{turn[0]}:{turn[1]}").encode())
                now.place += 1
                continue
            ids.append(now.conv_id)
            digests.append(sha.hexdigest())
            sha = hashlib.sha256()
            if len(ids) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests)], names)
                ids, digests = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names)

    return _replayed(turns, found).mapInArrow(run, "conv_id bigint, repaired_sha256 string")
