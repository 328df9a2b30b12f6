"""Repair of the order of roles in conversations, by least cost: which rows to keep, to give another role, to delete, and
where to insert a turn, so that the roles' initials read `(s?(ua)+)?`.

A conversation of n rows and the four states of that pattern make a grid of (n + 1) x 4 nodes, whose arcs are the edits.
Two passes over the sorted rows give each node its least cost from the end and from the start; an arc is tight if what
leads to it, its own cost and what follows add up to the least cost of all, and the tight arcs hold all cheapest repairs
and nothing else. A walk over sets of nodes takes the least edit letter that a tight arc out of the set has.

Rows are shuffled once, by conversation, and sorted within partitions by Spark, which spills: each pass reads rows in
order and holds one row's four costs, so that a conversation of any length needs no more memory. The repaired text of a
conversation is hashed in order, so one conversation is one task's work by its definition.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small_batches

#: What edits cost, and what a truncated row adds that is not deleted.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: What counts as white space, and how a text must end.
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
_INF = 1 << 60
# states: nothing yet, after s, after u, after a; the state that a user or assistant turn leads to, and its role
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_LAST = (0, 3)


def _kept(state: int, initial: str) -> int:
    """The state after a row of this initial, or -1."""
    if initial == "s":
        return 1 if state == 0 else -1
    return _NEXT[state] if initial == _ROLE[state][0] else -1


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs to the end of four nodes of one place, from those without an insertion there."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
    return costs


_END = _with_inserts([0 if q in _LAST else _INF for q in range(4)])


def _arcs(state: int, initial: str, must_go: bool, truncated: bool):
    """(letter, next state, cost) of the edits that use up a row."""
    yield "D", state, DELETE
    if not must_go:
        added = TRUNCATED * truncated
        if (to := _kept(state, initial)) >= 0:
            yield "K", to, KEEP + added
        yield "R", _NEXT[state], REROLE + added


def damaged(rows: DataFrame, kinds: int = 20) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults put in, by the hash of `conv_id:turn`: of `kinds` values 0 drops a row,
    1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it a user's. A null is one space wherever a
    text of it is needed."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % kinds
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(part("text"), ENDS, "")).otherwise(part("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(part("role"))
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def _blank(text: str) -> Column:
    return F.trim(F.col(text), F.lit(WHITE)) == ""


def faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) dealt by conversation, with `fault`: blank, duplicate (role and text seen earlier
    in the conversation), truncated (the last character but white space ends no sentence) or null, the first that holds."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"))
    # dealt by conversation once; the window's keys hold the conversation, so that it only sorts
    rows = rows.repartition(F.col("conv_id"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    ended = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1).isin(*ENDS)
    return rows.withColumn("seen", seen).select("*", F.when(_blank("text"), "blank").when(F.col("seen"), "duplicate").when(~ended, "truncated").alias("fault")).drop("seen")


def _backward(batches):
    """Adds to rows in descending order the costs to the end of the four nodes before the row, of those after it, and how
    many rows are behind it."""
    conv, costs, first, behind = None, _END, True, 0
    for b in batches:
        out = []
        for c, role, fault in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["fault"].to_pylist()):
            if first or c != conv:
                conv, costs, first, behind = c, _END, False, -1
            after, behind = costs, behind + 1
            gone = fault in ("blank", "duplicate")
            costs = _with_inserts([min(cost + after[to] for _, to, cost in _arcs(q, role[:1], gone, fault == "truncated")) for q in range(4)])
            out.append([*costs, *after, behind])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], [*b.schema.names, "costs"])


class _Walk:
    """The walk over one conversation's tight arcs, place by place."""

    def __init__(self, total: int):
        self.total = total
        self.start = [0, _INF, _INF, _INF]
        self.at = {0}
        self.step = 0

    def _inserts(self):
        """Costs from the start, with insertions at this place."""
        for _ in range(3):
            for q in range(4):
                to = _NEXT[q]
                self.start[to] = min(self.start[to], self.start[q] + INSERT)

    def _tight_inserts(self, ahead: list[int]) -> set[int]:
        return {_NEXT[q] for q in self.at if self.start[q] + INSERT + ahead[_NEXT[q]] == self.total}

    def row(self, role: str, fault: str | None, ahead: list[int], after: list[int]):
        """(letter, role) of the edits up to this row and of the row."""
        self._inserts()
        gone, cut = fault in ("blank", "duplicate"), fault == "truncated"
        while True:
            arcs: dict[str, set[int]] = {}
            for q in self.at:
                for letter, to, cost in _arcs(q, role[:1], gone, cut):
                    if self.start[q] + cost + after[to] == self.total:
                        arcs.setdefault(letter, set()).add(to)
            if inserted := self._tight_inserts(ahead):
                arcs["I"] = inserted
            letter = min(arcs)
            state = min(self.at)
            self.at = arcs[letter]
            self.step += 1
            if letter == "I":
                yield "I", _ROLE[state]
                continue
            before, self.start = self.start, [_INF] * 4
            for q in range(4):
                for _, to, cost in _arcs(q, role[:1], gone, cut):
                    self.start[to] = min(self.start[to], before[q] + cost)
            yield letter, {"D": None, "K": role, "R": _ROLE[state]}[letter]
            return

    def end(self):
        """(letter, role) of the insertions behind the last row. A repair that may end here is less than a longer one."""
        self._inserts()
        while not any(q in _LAST and self.start[q] == self.total for q in self.at):
            state, self.at = min(self.at), self._tight_inserts(_END)
            self.step += 1
            yield "I", _ROLE[state]


_EDITS = "conv_id long, step long, edit string, role string, text string, turn long, from_role string, fault string, cost long"
_NAMES = [x.split()[0] for x in _EDITS.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _forward(batches):
    """The edits of each conversation, in order, from rows in ascending order."""
    conv, walk = None, None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), _TYPES)], _NAMES)

    for b in batches:
        out = []
        for c, turn, role, text, fault, costs in zip(*(b[x].to_pylist() for x in ("conv_id", "turn", "role", "text", "fault", "costs"))):
            if walk is None or c != conv:
                if walk is not None:
                    out += [(conv, walk.step, letter, r, "", None, None, None, walk.total) for letter, r in walk.end()]
                conv, walk = c, _Walk(costs[0])
            for letter, r in walk.row(role, fault, costs[:4], costs[4:8]):
                out.append((c, walk.step, letter, r, "", None, None, None, walk.total) if letter == "I" else (c, walk.step, letter, r, text, turn, role, fault, walk.total))
        if out:
            yield batch(out)
    if walk is not None and (out := [(conv, walk.step, letter, r, "", None, None, None, walk.total) for letter, r in walk.end()]):
        yield batch(out)


def repair(rows: DataFrame) -> DataFrame:
    """One row per edit of the cheapest repair of each conversation, those of one conversation behind each other in one
    partition: conv_id, step (from 1), edit (K, R, D or I), role and text (as repaired; role is null where the row goes),
    turn, from_role and fault (of the row; null for an insertion), cost (of the whole repair).

    Rows are taken by turn, nulls first; rows of one turn by role and text. A null role or text is one space; rows of a
    null conv_id are one conversation; repeated rows are duplicates; other columns are ignored; no rows, no edits.
    """
    small_batches(rows.sparkSession)
    marked = faults(rows)
    # of rows that are alike in all else, that which is no duplicate comes first
    again = F.coalesce(F.col("fault") == "duplicate", F.lit(False))
    down = [F.col("conv_id"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), again.desc()]
    schema = "conv_id long, turn long, role string, text string, fault string, costs array<long>"
    priced = marked.sortWithinPartitions(*down).mapInArrow(_backward, schema)
    return priced.sortWithinPartitions("conv_id", F.col("costs")[8].desc()).mapInArrow(_forward, _EDITS)


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


class _Digest:
    def __init__(self, conv):
        self.conv, self.cost, self.counts = conv, 0, {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.turn = self.last = None
        self.turns = self.illegal = 0
        self.audit, self.hash, self.kept = [], hashlib.sha256(), 0

    def add(self, edit, role, text, turn, before, fault, cost):
        self.cost = cost
        self.audit.append(edit)
        if role is not None:
            self.hash.update((("\n" if self.kept else "") + f"{role}:{text}").encode())
            self.kept += 1
        if edit == "I":
            return
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            self.turns += self.turn is None or turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if self.last is not None:
            self.illegal += self.last + before[:1] not in _LEGAL
        self.last = before[:1]

    def row(self):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _digests(batches):
    now, out = None, []
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), types)], names)

    for b in batches:
        for c, *rest in zip(*(b[x].to_pylist() for x in ("conv_id", "edit", "role", "text", "turn", "from_role", "fault", "cost"))):
            if now is None or c != now.conv:
                if now is not None:
                    out.append(now.row())
                now = _Digest(c)
            now.add(*rest)
        if len(out) > 1000:
            yield batch()
            out = []
    if now is not None:
        out.append(now.row())
        yield batch()


def summaries(original: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per conversation of original(conv_id, ...): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, out of edits as `repair` gives them. A conversation without edits gets zeros, an empty audit and the
    hash of nothing."""
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    found = edits.mapInArrow(_digests, _DIGEST).withColumnRenamed("conv_id", "found")
    ids = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").select("conv_id", *(F.coalesce(F.col(c), F.lit(v)).cast("string" if isinstance(v, str) else "long").alias(c) for c, v in none.items()))
