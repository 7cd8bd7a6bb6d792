"""Repair of conversation structure by depth-first branch and bound.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``: nothing, or
an optional system turn and then user and assistant turns in pairs.  The edits of a turn are
Keep (0), Rerole to user or assistant (2) and Delete (3); an empty user or assistant turn may
be Inserted anywhere (2).  A turn that is blank, or whose role and text stood earlier in the
conversation, must be deleted; one that does not end in ``.``, ``!`` or ``?`` costs 1 more
unless deleted.  Of the cheapest repairs the one whose audit, the initials of its edits in
order, is least in ASCII order counts.

A node of the search is a place between turns and what the repaired turns so far call for
(``START``, ``AFTER_SYSTEM``, ``WANT_ASSISTANT``, ``WANT_USER``).  The search keeps an explicit
stack and tries edits in ASCII order, so prefixes come in order of their audits:

* *suffix lower bounds*: the cheapest way on from a node if the conversation might end
  anywhere from where it can still be completed; what the completion costs is not counted;
* *incumbent*: (cost, audit) of the best whole repair so far, first that of a dive along the
  bounds; a prefix goes when its cost and its bound exceed the incumbent's cost;
* *dominance*: every node notes the least cost at which it was reached; a later prefix that
  is not cheaper is worse, its audit being greater.

The bounds miss at most the cost of two insertions, so a node is met a few times at most and
the search is linear in the turns.  Conversations of more than ``SEGMENT`` turns are searched
segment by segment between every pair of states, and the results are chained; the first and
last edit of a chain are exact because a cheapest prefix to each state is kept.

Two passes: the first sees a flag byte and a hash for each turn and makes one row for each
conversation; the second streams the turns once, sorted, and applies the audit.  No task
holds the texts of a conversation, only some bytes for each of its turns.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

START, AFTER_SYSTEM, WANT_ASSISTANT, WANT_USER = range(4)
_STATES = 4
_AFTER_INSERT = (WANT_ASSISTANT, WANT_ASSISTANT, WANT_USER, WANT_ASSISTANT)
_COMPLETE = (START, WANT_USER)
_NEVER = 1 << 60
_DELETE, _INSERT, _REROLE, _CUT_SHORT = 3, 2, 2, 1
# Turns of one search; longer conversations are chained from several.
SEGMENT = 4096

PLAN = "conv_id long, n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN_ARROW = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in "n_turns gaps blank duplicate truncated illegal cost".split()] + [("audit", pa.string())])
REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"
_REPAIRED_ARROW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _kept_state(symbol: str, state: int) -> int | None:
    """Where keeping a turn leads; None where its role does not fit."""
    if symbol == "s":
        return AFTER_SYSTEM if state == START else None
    if symbol == "u":
        return None if state == WANT_ASSISTANT else WANT_ASSISTANT
    if symbol == "a":
        return WANT_USER if state == WANT_ASSISTANT else None
    return None


def _edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, state after) of the edits that use up a turn, in ASCII order.

    ``d`` is a turn that must go, a capital letter one that is cut short.
    """
    found = [("D", _DELETE, state)]
    if symbol != "d":
        more = _CUT_SHORT if symbol.isupper() else 0
        kept = _kept_state(symbol.lower(), state)
        if kept is not None:
            found.append(("K", more, kept))
        found.append(("R", _REROLE + more, _AFTER_INSERT[state]))
    return found


_EDITS = {(symbol, state): _edits(symbol, state) for symbol in "suaxSUAXd" for state in range(_STATES)}


def suffix_bounds(symbols: str, goals: tuple[int, ...]) -> list[int]:
    """Entry ``4 * place + state``: no repair of the turns from there on is cheaper.

    Insertions after the last turn are left out of the count; states that cannot reach a goal
    by them are barred.
    """
    n = len(symbols)
    bounds = [_NEVER] * (_STATES * (n + 1))
    for state in range(_STATES):
        reached = {state, _AFTER_INSERT[state], _AFTER_INSERT[_AFTER_INSERT[state]]}
        if reached & set(goals):
            bounds[_STATES * n + state] = 0
    for place in range(n - 1, -1, -1):
        after = _STATES * (place + 1)
        plain = [min(cost + bounds[after + to] for _, cost, to in _EDITS[symbols[place], state]) for state in range(_STATES)]
        for state in range(_STATES):
            one = _AFTER_INSERT[state]
            bounds[_STATES * place + state] = min(plain[state], _INSERT + plain[one], 2 * _INSERT + plain[_AFTER_INSERT[one]])
    return bounds


def _dive(symbols: str, entry: int, goals: tuple[int, ...], bounds: list[int]) -> tuple[int, str]:
    """A first incumbent: at each node the edit with the least cost and bound."""
    place, state, cost, path = 0, entry, 0, []
    while place < len(symbols) or state not in goals:
        choices = [(_INSERT, "I", _AFTER_INSERT[state], place)]
        if place < len(symbols):
            choices += [(paid, name, to, place + 1) for name, paid, to in _EDITS[symbols[place], state]]
        paid, name, state, place = min(choices, key=lambda c: (c[0] + bounds[_STATES * c[3] + c[2]], c[1] == "I", c[1]))
        cost += paid
        path.append(name)
    return cost, "".join(path)


def cheapest(symbols: str, entry: int = START, goals: tuple[int, ...] = _COMPLETE) -> tuple[int, str] | None:
    """(cost, audit) of the best repair that begins in ``entry`` and ends in a state of ``goals``."""
    bounds = suffix_bounds(symbols, goals)
    if bounds[entry] >= _NEVER:
        return None
    best_cost, best_audit = _dive(symbols, entry, goals, bounds)
    n = len(symbols)
    least = [_NEVER] * len(bounds)
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]
    while stack:
        place, state, cost, depth, name = stack.pop()
        node = _STATES * place + state
        if cost >= least[node] or cost + bounds[node] > best_cost:
            continue
        least[node] = cost
        if depth:
            path[depth - 1 :] = [name]
        if place == n and state in goals:
            audit = "".join(path[:depth])
            if (cost, audit) < (best_cost, best_audit):
                best_cost, best_audit = cost, audit
        # The last one pushed is tried first: D, I, K, R.
        uses = [(place + 1, to, cost + paid, depth + 1, edit) for edit, paid, to in _EDITS[symbols[place], state]] if place < n else []
        stack.extend(reversed(uses[1:]))
        stack.append((place, _AFTER_INSERT[state], cost + _INSERT, depth + 1, "I"))
        stack.extend(uses[:1])
    return best_cost, best_audit


# Most conversations are short and alike; equal ones are searched once in a worker.
_whole = functools.lru_cache(maxsize=1 << 16)(cheapest)


class Search:
    """The best repair of one conversation whose turns come one by one."""

    def __init__(self, segment: int = SEGMENT):
        self.segment = segment
        self.held: list[str] = []
        # For each state: cost and audit of the best prefix, as (prefix before the segment, part).
        self.prefixes: dict[int, tuple[int, tuple | None]] = {START: (0, None)}
        self.segments = 0

    def add(self, symbol: str) -> None:
        self.held.append(symbol)
        if len(self.held) >= self.segment:
            self._close([(state,) for state in range(_STATES)])

    def _close(self, goals: list[tuple[int, ...]]) -> None:
        symbols, self.held = "".join(self.held), []
        after: dict[int, tuple[int, tuple | None]] = {}
        for goal in goals:
            for entry, (cost, chain) in self.prefixes.items():
                found = cheapest(symbols, entry, goal)
                if found is None:
                    continue
                here = (cost + found[0], (chain, found[1]))
                if goal[0] not in after or _sooner(here, after[goal[0]]):
                    after[goal[0]] = here
        self.prefixes = after
        self.segments += 1

    def result(self) -> tuple[int, str]:
        if not self.segments:
            return _whole("".join(self.held))
        self._close([_COMPLETE])
        cost, chain = self.prefixes[_COMPLETE[0]]
        parts = []
        while chain is not None:
            chain, part = chain
            parts.append(part)
        return cost, "".join(reversed(parts))


def _sooner(one: tuple, other: tuple) -> bool:
    """Cheaper, or as cheap with a lesser audit; chains of equal length are compared from where they part."""
    if one[0] != other[0]:
        return one[0] < other[0]
    a, b, left, right = one[1], other[1], [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _turns(df: DataFrame, present: Column | None) -> DataFrame:
    """conv_id, turn, role, text, there, key: what both passes read, in one order for equal turns."""
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("there"),
    )
    return rows.withColumn("key", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _flag() -> Column:
    """One letter for a turn: its role's initial (x: none of s, u, a), capital if cut short, d if blank."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(last == "", "d").when(last.isin(".", "!", "?"), letter).otherwise(F.upper(letter))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list]]:
    """(first of its conversation, row) for sorted rows, conv_id in front."""
    before: object = object()
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            yield row[0] != before, row
            before = row[0]


def plans(df: DataFrame, present: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation of ``df`` (conv_id, turn, role, text): counts, cost and audit.

    Returns ``PLAN``.  Turns are taken by turn, nulls first; turns of equal number by the hash
    of role and text.  A null role or text is one space, a null conv_id a conversation of its
    own.  Each turn's first fault counts: blank, duplicate, truncated.  ``gaps`` are the numbers
    missing between the least and the greatest turn; ``illegal`` counts neighbours whose
    initials are not su, ua or au.  A role without a legal initial, the empty one included, can
    only be reroled or deleted.  Rows where ``present`` does not hold are not turns, but their
    conversation gets a row (zeros and an empty audit when it has no turns).  An empty table
    gives no rows; other columns are left behind.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv: dict | None = None

        def closed(c: dict) -> tuple:
            cost, audit = c["search"].result()
            gaps = c["last"] - c["first"] + 1 - c["numbers"] if c["numbers"] else 0
            return (c["id"], c["turns"], gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLAN_ARROW)], schema=_PLAN_ARROW)

        for opens, (conv_id, turn, there, flag, initial, key) in _by_conversation(batches):
            if opens:
                if conv is not None:
                    out.append(closed(conv))
                    if len(out) >= 4096:
                        yield batch_of(out)
                        out = []
                conv = dict(id=conv_id, turns=0, numbers=0, first=0, last=None, blank=0, duplicate=0, truncated=0, illegal=0, seen=set(), initial=None, search=Search(segment))
            if not there:
                continue
            conv["turns"] += 1
            if turn is not None and turn != conv["last"]:
                conv["first"] = turn if conv["last"] is None else conv["first"]
                conv["last"] = turn
                conv["numbers"] += 1
            if conv["initial"] is not None and conv["initial"] + initial not in ("su", "ua", "au"):
                conv["illegal"] += 1
            conv["initial"] = initial
            again = key in conv["seen"]
            conv["seen"].add(key)
            if flag == "d":
                conv["blank"] += 1
            elif again:
                conv["duplicate"] += 1
            elif flag.isupper():
                conv["truncated"] += 1
            conv["search"].add("d" if again else flag)
        if conv is not None:
            out.append(closed(conv))
        if out:
            yield batch_of(out)

    flags = _turns(df, present).select("conv_id", "turn", "there", _flag().alias("flag"), F.substring("role", 1, 1).alias("initial"), "key")
    ordered = flags.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "key")
    return ordered.mapInArrow(searched, PLAN)


def _edited(df: DataFrame, found: DataFrame, present: Column | None) -> DataFrame:
    """Turns and, before those of each conversation, its audit, sorted: the input of the second pass."""
    turns = _turns(df, present).filter("there").select("conv_id", F.lit(1).alias("kind"), "turn", "key", "role", "text")
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text")
    )
    both = turns.unionByName(heads).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "key").select("conv_id", "kind", "turn", "role", "text")


class _Applied:
    """Follows an audit: ``take`` gives the (edit, turn, role, text) that end with a turn, ``rest`` those after the last."""

    def __init__(self, conv_id: int | None, audit: str):
        self.conv_id, self.audit, self.at, self.state = conv_id, audit, 0, START

    def _new(self, edit: str, turn: int | None, text: str) -> tuple:
        role = "assistant" if self.state == WANT_ASSISTANT else "user"
        self.state = _AFTER_INSERT[self.state]
        return edit, turn, role, text

    def rest(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._new("I", None, "")

    def take(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        yield from self.rest()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._new("R", turn, text)
        elif edit == "K":
            self.state = _kept_state(role[:1], self.state)
            yield "K", turn, role, text
        else:
            yield "D", turn, role, text


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Applied, tuple | None]]:
    """Each conversation's edits in order; (conversation, None) where one ends."""
    now: _Applied | None = None
    for batch in batches:
        _, offsets = common.bytes_of(batch.column(4))
        for first, last in common.slices(offsets):
            part = batch.slice(first, last - first)
            for conv_id, kind, turn, role, text in zip(*[c.to_pylist() for c in part.columns]):
                if kind == 0:
                    if now is not None:
                        yield from ((now, e) for e in now.rest())
                        yield now, None
                    now = _Applied(conv_id, text)
                else:
                    yield from ((now, e) for e in now.take(turn, role, text))
    if now is not None:
        yield from ((now, e) for e in now.rest())
        yield now, None


def repaired(df: DataFrame, found: DataFrame | None = None, present: Column | None = None, deleted: bool = False) -> DataFrame:
    """The repaired turns of all conversations: ``REPAIRED``, one row for each turn.

    ``place`` counts them from 0 in a conversation.  ``deleted`` adds the turns that went, with
    edit D and a null place.  ``found`` are the :func:`plans` of ``df``, made here if not given.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, place = 0, 0
        for conv, edit in _followed(batches):
            if edit is None:
                place = 0
                continue
            if edit[0] != "D":
                out.append((conv.conv_id, place, *edit))
                place += 1
            elif deleted:
                out.append((conv.conv_id, None, *edit))
            held += len(edit[3]) + 64
            if held >= common.SLICE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REPAIRED_ARROW)], schema=_REPAIRED_ARROW)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REPAIRED_ARROW)], schema=_REPAIRED_ARROW)

    return _edited(df, plans(df, present) if found is None else found, present).mapInArrow(rows, REPAIRED)


def digest(df: DataFrame, present: Column | None = None) -> DataFrame:
    """:func:`plans` with the sha256 of the repaired ``role:text`` of each conversation, joined by newlines."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums = [], []
        running, some = hashlib.sha256(), False
        for conv, edit in _followed(batches):
            if edit is None:
                ids.append(conv.conv_id)
                sums.append(running.hexdigest())
                running, some = hashlib.sha256(), False
                if len(ids) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums)], ["conv_id", "repaired_sha256"])
                    ids, sums = [], []
            elif edit[0] != "D":
                running.update(f"{chr(10) if some else ''}{edit[2]}:{edit[3]}".encode())
                some = True
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums)], ["conv_id", "repaired_sha256"])

    found = common.stored(plans(df, present))
    sums = _edited(df, found, present).mapInArrow(hashed, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "of")
    joined = found.join(sums, found["conv_id"].eqNullSafe(sums["of"]))
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(df: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults planted by crc32(``conv_id:turn``) mod 20, and what tells turns from dropped ones.

    0 drops the turn, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it,
    4 makes its role user.  Nulls count as one space.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        F.pmod(F.crc32(name), F.lit(20)).alias("harm"),
    )
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("harm") != 0)))
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("there")), F.col("there")
