"""Repair of conversation structure by a weighted automaton, determinised lazily.

A conversation's rows, in order, are symbols (what must be deleted; else the role's initial and whether the text breaks off). Edits keep, re-role, delete or insert rows
until the roles read ``(s?(ua)+)?``; the least cost of finishing from each of the automaton's four states is a vector. Less its minimum that vector is a state of the determinised
automaton: a table holds, for each state and symbol met so far, the next state and the cost taken off. A scan of the table from the last row to the first gives all costs, and a trace
against the scan's direction, along arcs whose cost is tight, gives the edits; of tight arcs the one of the least initial, so the first of all cheapest audits.

Rows are dealt by a range sort over (conversation, turn, ...), so a long conversation lies in several partitions, in pieces of bounded size. Each piece is first summed up by a 4 x 4
matrix (cost from state to state), then, once the vector at its end is known, by the state it leaves for each state it is entered in; both are folded over the pieces of a
conversation in order, as streams. Only then are its edits traced.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed values: what edits cost, and what a row adds that breaks off and stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_ENDS = ".!?"
_BLANK = r"^[\x20\x09-\x0D]*$"
_BROKEN = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$"
#: A piece of a conversation holds at most so many rows, or characters and one row; a range partition some so many rows.
PIECE_ROWS = 4096
PIECE_CHARS = 1 << 22
ROWS_PER_TASK = 1 << 17

#: States: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a. Symbols: 0 must go, else 1 + 2 * initial (s, u, a, other) + broken.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_TURN = {0: 2, 1: 2, 3: 2, 2: 3}  # where an inserted or re-roled row leads: u behind nothing, s and a; a behind u
_ROLE = {2: "user", 3: "assistant"}
_INITIALS = ("s", "u", "a", "")
_FAR = 1 << 40


class Repairer:
    """The determinised automaton as far as it has been needed. Its states are few: finite costs in a vector differ by some units at most."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.table: dict[int, tuple[int, int]] = {}
        self.moves: dict[tuple[int, int, int], tuple[str, int, tuple[int, ...]]] = {}
        end, _ = self.state(self._closed([0, _FAR, _FAR, 0]))
        self.end = end

    @staticmethod
    def _closed(v: list[int]) -> list[int]:
        """With the rows that may be inserted first."""
        for _ in range(3):
            v = [min(v[q], INSERT + v[_TURN[q]]) for q in range(4)]
        return [min(x, _FAR) for x in v]

    def state(self, v) -> tuple[int, int]:
        """The id of a vector less its minimum, and that minimum."""
        low = min(v)
        key = tuple(x - low if x < _FAR else _FAR for x in v)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
        return self.ids[key], low

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before a row of ``symbol`` whose end is ``state``, and the cost taken off."""
        got = self.table.get(state * 9 + symbol)
        if got is None:
            h = self.vectors[state]
            v = [DELETE + h[q] for q in range(4)]
            if symbol:
                extra, keep = TRUNCATED * ((symbol - 1) & 1), _NEXT.get(_INITIALS[(symbol - 1) >> 1], {})
                for q in range(4):
                    v[q] = min(v[q], REROLE + extra + h[_TURN[q]], extra + h[keep[q]] if q in keep else _FAR)
            got = self.table[state * 9 + symbol] = self.state(self._closed(v))
        return got

    def scan(self, symbols: bytes, state: int) -> tuple[list[int], int]:
        """The state at each row's start and at the end, and the cost taken off in all."""
        out, total = [state], 0
        for x in reversed(symbols):
            state, off = self.step(state, x)
            out.append(state)
            total += off
        out.reverse()
        return out, total

    def move(self, after: int, symbol: int, q: int) -> tuple[str, int, tuple[int, ...]]:
        """From state ``q`` before a row of ``symbol``: the initials of its cheapest, least edits, the state behind it, the states inserted on the way."""
        key = (after, symbol, q)
        if key not in self.moves:
            before, off = self.step(after, symbol)
            h, v = self.vectors[after], [off + x for x in self.vectors[before]]
            extra, keep = TRUNCATED * ((symbol - 1) & 1), _NEXT.get(_INITIALS[(symbol - 1) >> 1], {}) if symbol else {}
            word, new = "", []
            while True:
                if v[q] == DELETE + h[q]:
                    word += "D"
                    break
                if v[q] == INSERT + v[_TURN[q]]:
                    word, q = word + "I", _TURN[q]
                    new.append(q)
                    continue
                if q in keep and v[q] == extra + h[keep[q]]:
                    word, q = word + "K", keep[q]
                    break
                word, q = word + "R", _TURN[q]
                break
            self.moves[key] = word, q, tuple(new)
        return self.moves[key]

    def trace(self, symbols: bytes, states: list[int], q: int):
        """The move of each row from state ``q`` at the start on, by the states of ``scan``."""
        for i, x in enumerate(symbols):
            got = self.move(states[i + 1], x, q)
            yield got
            q = got[1]

    def tail(self, q: int) -> list[int]:
        """The states inserted behind the last row."""
        out = []
        while q in (1, 2):
            q = _TURN[q]
            out.append(q)
        return out

    def matrix(self, symbols: bytes) -> list[int]:
        """The costs from each state before the rows (first index) to each behind them."""
        columns = []
        for end in range(4):
            state, low = self.state([0 if q == end else _FAR for q in range(4)])
            states, off = self.scan(symbols, state)
            columns.append([min(_FAR, x + low + off) for x in self.vectors[states[0]]])
        return [columns[b][a] for a in range(4) for b in range(4)]


_machines: list[Repairer] = []


def machine() -> Repairer:
    """This worker's automaton, filled as it goes."""
    if not _machines:
        _machines.append(Repairer())
    return _machines[0]


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults planted by a hash of conversation and turn: dropped, emptied, broken off, repeated, taken for the user's; nulls read as one space.

    The result has a row for each distinct row, with its number of copies, so that no key is hot by repetition.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fault = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text_of("text"), _ENDS, "")).otherwise(text_of("text"))
    out = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(fault == 4, F.lit("user")).otherwise(text_of("role")).alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("n"), fault.alias("fault"))
    return out.where("fault <> 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _ordered(rows: DataFrame, ids: DataFrame, tasks: int) -> DataFrame:
    """A header for each of ``ids`` and every copy of ``rows``, range sorted by conversation, turn (nulls first), role and text; texts and faults only with first copies.

    A row's first appearance is told by a mark that sorts right before it: the least turn of each (conversation, role, text), found by a grouping without texts. Marks and
    rows of one place have equal range keys, so they share a partition.
    """
    head, key = F.substring("text", 1, 64), F.md5(F.concat_ws("\x00", "role", "text"))
    null = lambda kind: F.lit(None).cast(kind)  # noqa: E731
    rows = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", head.alias("head"), key.alias("key"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy"), "text")
    blank, broken = F.col("text").rlike(_BLANK), F.col("text").rlike(_BROKEN)
    rows = rows.withColumns({"blank": blank, "broken": broken, "text": F.when((F.col("copy") == 0) & ~blank, F.col("text"))})
    marks = rows.where("copy = 0").groupBy("conv_id", "key", "role", "head").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    marks = marks.select("conv_id", F.lit(1).alias("part"), "turn", "role", "head", "key", F.lit(-1).cast("bigint").alias("copy"), null("string").alias("text"), null("boolean").alias("blank"), null("boolean").alias("broken"))
    heads = ids.select("conv_id", F.lit(0).alias("part"), null("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("head"), F.lit("").alias("key"), F.lit(-1).cast("bigint").alias("copy"), null("string").alias("text"), null("boolean").alias("blank"), null("boolean").alias("broken"))
    place = ["conv_id", "part", F.asc_nulls_first("turn"), "role", "head", "key"]
    return rows.unionByName(marks).unionByName(heads).repartitionByRange(tasks, *place, F.greatest("copy", F.lit(0).cast("bigint"))).sortWithinPartitions(*place, "copy")


_STATS = "n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first string, last string"
_PIECE = f"seq bigint, whole boolean, {_STATS}, symbols binary, roles array<string>, texts array<string>"
_LEGAL = frozenset(("su", "ua", "au"))


class _Run:
    """The rows of one conversation that a partition has met and not yet passed on."""

    def __init__(self, conv, opened: bool):
        self.conv, self.opened, self.cut = conv, opened, False
        self.clear()

    def clear(self):
        self.symbols, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.seen = None

    def add(self, turn, role, text, blank, broken, first):
        kind = _INITIALS.index(role[:1]) if role[:1] in ("s", "u", "a") else 3
        if blank:
            self.blank += 1
        elif not first:
            self.duplicate += 1
        else:
            self.truncated += broken
        gone = blank or not first
        if self.roles:
            self.illegal += self.roles[-1][:1] + role[:1] not in _LEGAL
        self.symbols.append(0 if gone else 1 + 2 * kind + broken)
        self.roles.append(role)
        self.texts.append(None if gone else text)
        self.size += len(role) + (0 if gone else len(text))
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, seq: int, whole: bool) -> dict:
        ends = (self.roles[0][:1], self.roles[-1][:1]) if self.roles else (None, None)
        return dict(conv_id=self.conv, seq=seq, whole=whole, n_rows=len(self.symbols), blank=self.blank, duplicate=self.duplicate, truncated=self.truncated, illegal=self.illegal, turns=self.turns, low=self.low, high=self.high, first=ends[0], last=ends[1], symbols=bytes(self.symbols), roles=self.roles, texts=self.texts)


def _pieces(ordered: DataFrame) -> DataFrame:
    """Rows of one piece each: its symbols, roles and texts, and what is counted of it. ``whole`` is a conversation in one piece; others come in the order of ``seq``."""
    kind = ordered.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {_PIECE}"

    def run(batches):
        base, n, now, mark, out, size, arrow = TaskContext.get().partitionId() << 32, 0, None, None, [], 0, None

        def close(whole: bool) -> bool:
            """Put the run's rows into ``out``; true if that is full."""
            nonlocal n, size
            size += now.size + PIECE_CHARS // PIECE_ROWS * (1 + len(now.symbols))
            out.append(now.row(base + n, whole))
            n += 1
            now.cut = True
            now.clear()
            return size >= PIECE_CHARS

        def table():
            nonlocal size
            got = pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
            size = 0
            return got

        for batch in batches:
            if arrow is None:
                long, text = pa.int64(), pa.string()
                kinds = dict(seq=long, whole=pa.bool_(), n_rows=long, blank=long, duplicate=long, truncated=long, illegal=long, turns=long, low=long, high=long, first=text, last=text, symbols=pa.binary(), roles=pa.list_(text), texts=pa.list_(text))
                arrow = pa.schema([("conv_id", batch.schema.field("conv_id").type), *kinds.items()])
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "key", "copy", "text", "blank", "broken")]
            for conv, part, turn, role, key, copy, text, blank, broken in zip(*cols, strict=True):
                if now is None or conv != now.conv:
                    if now is not None and close(now.opened and not now.cut):
                        yield table()
                    now, mark = _Run(conv, part == 0), None
                if part == 0:
                    continue
                if copy < 0:
                    mark = (turn, key)
                    continue
                now.add(turn, role, text, blank, broken, copy == 0 and mark == (turn, key))
                if (len(now.symbols) >= PIECE_ROWS or now.size >= PIECE_CHARS) and close(False):
                    yield table()
        if now is not None:
            close(False)
            yield table()

    return ordered.mapInArrow(run, schema)


def _per_row(df: DataFrame, columns: list[str], make, added: str) -> DataFrame:
    """``columns`` of ``df`` and those of ``added``, which ``make`` gives for each row as a list; pieces are rows of bounded size."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    names = [x.split()[0] for x in added.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

    def run(batches):
        C.hold("turns", _machines.clear)
        for batch in batches:
            made = [make(r) for r in batch.to_pylist()]
            new = [pa.array([m[i] for m in made], kinds[x.split()[1]]) for i, x in enumerate(added.split(", "))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *new], names=[*columns, *names])

    return df.mapInArrow(run, f"{schema}, {added}")


def _fold(df: DataFrame, start, step, added: str, last_first: bool) -> DataFrame:
    """seq and ``added``: ``step`` carries a value over a conversation's pieces in order and gives the value each piece meets."""
    tasks = C.shuffle_partitions(df.sparkSession)
    rows = df.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", F.desc("seq") if last_first else F.asc("seq"))
    name, kind = added.split()
    arrow = pa.list_(pa.int64()) if kind.startswith("array") else pa.int64()

    def run(batches):
        at, value, fresh = None, None, True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if fresh or r["conv_id"] != at:
                    at, value, fresh = r["conv_id"], start(), False
                out.append(value)
                value = step(value, r)
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(out, arrow)], names=["seq", name])

    return rows.mapInArrow(run, f"seq bigint, {added}")


def _through(h: list[int], m: list[int]) -> list[int]:
    """The vector before a piece of matrix ``m`` whose end has vector ``h``, less its minimum."""
    v = [min(m[4 * a + b] + h[b] for b in range(4)) for a in range(4)]
    return [x - min(v) for x in v]


def _edits(row: dict, end: list[int] | None, q: int, last: bool) -> list:
    """audit, cost, roles and texts of a piece entered in state ``q`` whose end has the vector ``end`` (None: the conversation ends)."""
    a = machine()
    state = a.end if end is None else a.state(end)[0]
    symbols = row["symbols"]
    states, off = a.scan(symbols, state)
    cost, start = off + a.vectors[states[0]][q], q
    word, roles, texts = [], [], []
    for (w, q, new), role, text in zip(a.trace(symbols, states, start), row["roles"], row["texts"], strict=True):
        word.append(w)
        for s in new:
            roles.append(_ROLE[s])
            texts.append("")
        if w[-1] != "D":
            roles.append(role if w[-1] == "K" else _ROLE[q])
            texts.append(text)
    if last:
        for s in a.tail(q):
            word.append("I")
            roles.append(_ROLE[s])
            texts.append("")
    else:
        cost -= a.vectors[state][q]
    return ["".join(word), cost, roles, texts]


_EDITED = "audit string, cost bigint, out_roles array<string>, out_texts array<string>"


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text, n: copies) in pieces: conv_id, seq (their order), whole, what is counted in each, audit, cost and the kept and new rows' out_roles and out_texts.

    Every conversation of ``ids`` (conv_id, distinct) has a piece, be it empty. Rows are taken by turn (nulls first), then role and text (beyond 64 characters by a hash). A null id is a conversation of its own.
    """
    spark = rows.sparkSession
    scratch = C.Scratch(spark, "turns")
    rows = scratch.put("rows", rows)
    tasks = max(C.shuffle_partitions(spark), math.ceil((rows.agg(F.sum("n")).first()[0] or 0) / ROWS_PER_TASK))
    pieces = scratch.put("pieces", _pieces(_ordered(rows, ids, tasks)))
    stats = ["conv_id", "seq", "whole", *[x.split()[0] for x in _STATS.split(", ")]]
    whole = _per_row(pieces.where("whole"), stats, lambda r: _edits(r, None, 0, True), _EDITED)
    parted = pieces.where("not whole")
    light = parted.select("conv_id", "seq", "symbols")
    sums = _per_row(light, ["conv_id", "seq"], lambda r: [machine().matrix(r["symbols"])], "m array<bigint>")
    ends = scratch.put("ends", _fold(sums, lambda: list(machine().vectors[machine().end]), lambda h, r: _through(h, r["m"]), "h array<bigint>", True))

    def leaves(r):
        a = machine()
        states, _ = a.scan(r["symbols"], a.state(r["h"])[0])
        out = []
        for entry in range(4):
            q = entry
            for _, q, _ in a.trace(r["symbols"], states, entry):
                pass
            out.append(q)
        return [out]

    maps = _per_row(light.join(ends, "seq"), ["conv_id", "seq"], leaves, "to array<bigint>")
    entries = scratch.put("entries", _fold(maps, lambda: 0, lambda q, r: r["to"][q], "q bigint", False))
    final = parted.groupBy("conv_id").agg(F.max("seq").alias("seq")).select("seq", F.lit(True).alias("ending"))
    known = parted.join(ends, "seq").join(entries, "seq").join(final, "seq", "left")
    return whole.unionByName(_per_row(known, stats, lambda r: _edits(r, r["h"], r["q"], bool(r["ending"])), _EDITED))


_DIGEST = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Digest:
    """What a conversation's pieces, in order, come to."""

    def __init__(self, conv):
        self.conv, self.hash, self.any, self.audit = conv, hashlib.sha256(), False, []
        self.sums, self.turns, self.low, self.high, self.last = [0] * 5, 0, None, None, None

    def add(self, r: dict):
        self.sums = [x + r[c] for x, c in zip(self.sums, ("blank", "duplicate", "truncated", "illegal", "cost"), strict=True)]
        if r["n_rows"]:
            self.sums[3] += self.last is not None and self.last + r["first"] not in _LEGAL
            self.last = r["last"]
        if r["low"] is not None:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        self.audit.append(r["audit"])
        for role, text in zip(r["out_roles"], r["out_texts"], strict=True):
            self.hash.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode())
            self.any = True

    def row(self) -> list:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *self.sums, "".join(self.audit), self.hash.hexdigest()]


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation of ``repair``: gaps of turns, faults by kind, illegal neighbours, cost, audit and the hash of the repaired rows. Pieces of a conversation are hashed one after another, as a stream."""
    schema = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, {_DIGEST}"
    names = [x.split() for x in _DIGEST.split(", ")]

    def run(batches):
        now, kind, done = None, None, []

        def table():
            cols = [pa.array([d.conv for d, _ in done], kind)] + [pa.array([r[i] for _, r in done], pa.string() if k == "string" else pa.int64()) for i, (_, k) in enumerate(names)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", *[n for n, _ in names]])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now.conv:
                    if now is not None:
                        done.append((now, now.row()))
                    now = _Digest(r["conv_id"])
                now.add(r)
            if done:
                yield table()
        if now is not None:
            done.append((now, now.row()))
            yield table()

    tasks = C.shuffle_partitions(pieces.sparkSession)
    parted = pieces.where("not whole").repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "seq")
    return pieces.where("whole").mapInArrow(run, schema).unionByName(parted.mapInArrow(run, schema))


def turns(pieces: DataFrame) -> DataFrame:
    """The repaired rows of ``repair``: conv_id, seq and at (their order), role, text."""
    return pieces.select("conv_id", "seq", F.posexplode(F.arrays_zip("out_roles", "out_texts")).alias("at", "row")).select("conv_id", "seq", "at", F.col("row.out_roles").alias("role"), F.col("row.out_texts").alias("text"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``digests`` of every conv_id of ``conversations`` after ``damaged``. Nulls in any column read as one space (a null turn comes first and counts for no gap), blank and
    empty texts are deleted, repeated rows are duplicates, further columns are ignored, a conversation without rows has zeros and empty strings, an empty table no rows."""
    return digests(repair(damaged(conversations), conversations.select("conv_id").distinct()))


def oracle() -> str:
    """DuckDB SQL for ``repair_damaged``: least costs from the last row on, edits from the first row on, one recursion each."""
    closed = "[least(g[1], 3 + g[3], 6 + g[4]), least(g[2], 3 + g[3], 6 + g[4]), least(g[3], 3 + g[4]), least(g[4], 3 + g[3])]"
    arc = lambda q, keep: f"least(4 + h[{q}], CASE WHEN NOT gone THEN 3 * broken + 3 + h[{4 if q == 3 else 3}] ELSE 1000000000 END, CASE WHEN NOT gone AND ini = '{keep[0]}' THEN 3 * broken + h[{keep[1]}] ELSE 1000000000 END{', CASE WHEN NOT gone AND ini = ' + repr('u') + ' THEN 3 * broken + h[3] ELSE 1000000000 END' if q == 1 else ''})"  # noqa: E731
    arcs = ", ".join(arc(q, keep) for q, keep in ((1, ("s", 2)), (2, ("u", 3)), (3, ("a", 4)), (4, ("u", 3))))
    return rf"""
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM src, poly),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE f <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini FROM hurt),
flag AS (SELECT *, regexp_full_match(text, '[ 	-]*') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  regexp_matches(text, '[^.!? 	-][ 	-]*$') AS cut, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM num),
r AS (SELECT *, blank OR again AS gone, cut::INTEGER AS broken FROM flag),
ids AS (SELECT DISTINCT conv_id FROM conversations),
n AS (SELECT ids.conv_id, count(r.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (again AND NOT blank)::BIGINT AS duplicate,
  count(*) FILTER (cut AND NOT blank AND NOT again)::BIGINT AS truncated, count(*) FILTER (was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM ids LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
back AS (SELECT conv_id, n + 1 AS i, [0, 6, 3, 0] AS h FROM n
  UNION ALL SELECT conv_id, i, {closed} AS h FROM (SELECT b.conv_id, r.i, [{arcs}] AS g FROM back b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
walk AS (SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines FROM n
  UNION ALL SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN q WHEN e = 'K' AND ini = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END) WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || text) END
  FROM (SELECT w.*, r.role, r.text, r.ini, CASE
      WHEN r.i IS NOT NULL AND a.h[q] = 4 + z.h[q] THEN 'D' WHEN a.h[q] = 3 + a.h[CASE WHEN q = 3 THEN 4 ELSE 3 END] THEN 'I'
      WHEN r.i IS NOT NULL AND NOT r.gone AND ((r.ini = 's' AND q = 1 AND a.h[q] = 3 * r.broken + z.h[2]) OR (r.ini = 'u' AND q <> 3 AND a.h[q] = 3 * r.broken + z.h[3]) OR (r.ini = 'a' AND q = 3 AND a.h[q] = 3 * r.broken + z.h[4])) THEN 'K'
      WHEN r.i IS NOT NULL THEN 'R' END AS e
    FROM walk w JOIN back a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i LEFT JOIN back z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.i = w.i + 1
    LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i) WHERE e IS NOT NULL)
SELECT n.conv_id, gaps, n.blank, n.duplicate, n.truncated, n.illegal, b.h[1]::BIGINT AS cost, w.audit, sha256(array_to_string(w.lines, chr(10))) AS repaired_sha256
FROM n JOIN back b ON b.conv_id IS NOT DISTINCT FROM n.conv_id AND b.i = 1 JOIN walk w ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.n + 1 AND w.q IN (1, 4)
"""
