"""Conversation structure repair: a dynamic programme that streams over secondary-sorted rows.

Rows are repartitioned by conversation and sorted by turn; mapInPandas reads them batch by batch and carries the programme's state
across batches. A conversation's role initials must become (s?(ua)+)?, at the least cost of these edits, each with its initial:

* K, keep a row: 0 (5 if it is truncated);
* R, give it the role user or assistant: 1 (6 if it is truncated);
* D, delete it: 2; blank and duplicate rows must be deleted;
* I, insert a row without text, user or assistant, anywhere: 5.

Of equally cheap edits those whose initials come first as ASCII are taken. A row's fault is the first that holds of: blank (no
character but white space), duplicate (same role and text seen earlier in the conversation), truncated (its last character besides
white space is none of . ! ?).

The programme has four states: nothing written yet, and s, u or a written last. What it needs to know between rows is which states
are alive, how much dearer each is than the cheapest (more than DOMINATED never pays), and in which order their edits so far stand;
since each row's edits, inserts first, end with the row's own letter, no such sequence is the beginning of another, and the order
of two is settled for good by their first different row. That makes finitely many situations, whose moves are worked out once a
worker. For each row only the number of its move is noted, four bytes, in memory up to SPILL_BYTES a conversation and beyond that
in an unlinked file of the task, which no other task reads and a repeated task writes anew. The digest of the repaired text needs
no second pass: every living state has a running SHA-256 that forks where states do.

Whatever its length, a conversation takes bounded memory besides its own list of edits (one letter a row). It is one task's
work, as a digest of its whole text in order has to be; Spark sorts within partitions and spills.

Duplicates are found by a window over (conversation, role, text), which reads the same partitions sorted another way.

Defined cases: a null role or text counts as one space, and so does a null in the key of damage(); rows with a null conv_id form
one conversation; null turns come first; rows of equal turn stand in the order of role and text; a conversation without rows after
damage has zeros, no edits and the digest of the empty string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import short_batches, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A state that is dearer than another by more than this can't be on a cheapest way: any state can do what any other does for 10 more.
DOMINATED = 2 * INSERT
NOTHING, S, U, A = range(4)
#: What must be written next, and the state after it.
NEXT = {NOTHING: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
#: Of a conversation's moves, bytes that are kept in memory.
SPILL_BYTES = 8 << 20
SPACE = r"\x20\x09-\x0D"
FAULTS = ("none", "blank", "duplicate", "truncated")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with faults put in by crc32('conv_id:turn') % 20: 0 drops a row (gone is true), 1
    empties its text, 2 removes . ! ?, 3 repeats it, 4 sets the role user."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).when(kind == 0, "").otherwise(F.col("text"))
    once = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return once.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "again")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with fault (index of FAULTS) and initial, each conversation in one partition and in its order. Takes one shuffle."""
    dealt = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))}).repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), 1).when(earlier, 2).when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), 3).otherwise(0)
    marked = dealt.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))
    return marked.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


# --- the dynamic programme ------------------------------------------------------------------------------------------------------


def _inserted(state: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(inserts, state after them, their lines): from a state to each that it reaches in the fewest inserts."""
    seen, lines, n = set(), [], 0
    while state not in seen:
        yield n, state, list(lines)
        seen.add(state)
        role, state = NEXT[state]
        lines.append(f"{role}:".encode())
        n += 1


class Moves:
    """Situations and the moves between them. A situation is a tuple of (state, cost above the cheapest), best edits first; a move
    has its next situation, what the cheapest grew by, and for each state that it reaches (state, state before, edits, whether the
    row is kept, bytes that come before the row's own line or text)."""

    def __init__(self) -> None:
        self.situations: list[tuple] = [((NOTHING, 0),)]
        self._number = {self.situations[0]: 0}
        self.moves: list[tuple[int, int, tuple]] = []
        self._known: dict[tuple[int, int, str], int] = {}

    def of(self, situation: int, fault: int, initial: str) -> int:
        key = situation, fault, initial if initial in "sua" else ""
        if (number := self._known.get(key)) is None:
            number = self._known[key] = len(self.moves)
            self.moves.append(self._work_out(*key))
        return number

    def _work_out(self, situation: int, fault: int, initial: str) -> tuple[int, int, tuple]:
        best: dict[int, tuple] = {}
        more = TRUNCATED if fault == 3 else 0
        for rank, (before, cost) in enumerate(self.situations[situation]):
            for n, state, lines in _inserted(before):
                ways = [("D", DELETE, state, None)]
                if fault not in (1, 2):
                    role, after = NEXT[state]
                    ways.append(("R", REROLE + more, after, f"{role}:".encode()))
                    if initial and (initial == role[0] or (state == NOTHING and initial == "s")):
                        ways.append(("K", KEEP + more, S if initial == "s" else after, b""))
                for letter, price, after, line in ways:
                    written = lines if line is None else [*lines, line]
                    head = b"\n".join(written)
                    if written and before != NOTHING:
                        head = b"\n" + head
                    found = cost + INSERT * n + price, rank, "I" * n + letter, before, letter, head
                    if after not in best or found[:3] < best[after][:3]:
                        best[after] = found
        least = min(x[0] for x in best.values())
        alive = sorted(((x[1:3], s, x) for s, x in best.items() if x[0] - least <= DOMINATED))
        after = tuple((s, x[0] - least) for _, s, x in alive)
        if after not in self._number:
            self._number[after] = len(self.situations)
            self.situations.append(after)
        return self._number[after], least, tuple((s, x[3], x[2], x[4], x[5]) for _, s, x in alive)


class Repair:
    """One conversation on its way through the programme."""

    def __init__(self, moves: Moves) -> None:
        self.moves, self.situation, self.cost, self.rows = moves, 0, 0, 0
        self.notes, self.spilled = array("I"), None
        self.digests = {NOTHING: hashlib.sha256()}
        self.counts, self.illegal, self.initial = [0, 0, 0, 0], 0, None
        self.lowest = self.highest = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: int, initial: str) -> None:
        self.rows += 1
        self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.lowest = turn if self.lowest is None else self.lowest
            self.highest = self.last = turn
            self.turns += 1
        number = self.moves.of(self.situation, fault, initial)
        self.situation, more, ways = self.moves.moves[number]
        self.cost += more
        self.notes.append(number)
        if len(self.notes) * 4 >= SPILL_BYTES:
            self.spilled = self.spilled or tempfile.TemporaryFile()
            self.notes.tofile(self.spilled)
            self.notes = array("I")
        own, digests = text.encode(), {}
        for state, before, _, letter, head in ways:
            digest = self.digests[before]
            if letter != "D" or head:
                digest = digest.copy()
                digest.update(head + (role.encode() + b":" + own if letter == "K" else own if letter == "R" else b""))
            digests[state] = digest
        self.digests = digests

    def _backwards(self) -> Iterator[int]:
        yield from reversed(self.notes)
        if self.spilled:
            size = self.spilled.tell()
            while size:
                part, start = array("I"), max(0, size - SPILL_BYTES)
                self.spilled.seek(start)
                part.frombytes(self.spilled.read(size - start))
                yield from reversed(part)
                size = start
            self.spilled.close()

    def result(self) -> tuple:
        ends = []
        for rank, (state, cost) in enumerate(self.moves.situations[self.situation]):
            for n, after, lines in _inserted(state):
                if after in (NOTHING, A):
                    ends.append((cost + INSERT * n, rank, n, state, lines))
                    break
        cost, _, n, state, lines = min(ends)
        digest = self.digests[state]
        if lines:
            digest.update((b"" if state == NOTHING else b"\n") + b"\n".join(lines))
        edits = bytearray(b"I" * n)
        for number in self._backwards():
            _, before, letters, _, _ = next(w for w in self.moves.moves[number][2] if w[0] == state)
            edits += letters.encode()[::-1]
            state = before
        edits.reverse()
        gaps = self.highest - self.lowest + 1 - self.turns if self.turns else 0
        return gaps, *self.counts[1:], self.illegal, self.cost + cost, edits.decode(), digest.hexdigest()


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FIELDS = [x.split()[0] for x in _RESULT.split(", ")]


def _repair_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    moves, key, now, done = Moves(), None, None, []

    def closed() -> list:
        return [(None if key[0] else key[1], *now.result())] if now else []

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame({f: pd.array([r[i] for r in rows], "Int64") if i < 7 else pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(_FIELDS)})

    for batch in batches:
        for no_id, conv, no_turn, turn, role, text, fault, initial, gone in zip(*(batch[c].tolist() for c in _SENT), strict=True):
            if (no_id, conv) != key:
                done += closed()
                key, now = (no_id, conv), Repair(moves)
            if not gone:
                now.add(None if no_turn else turn, role, text, fault, initial)
        if done:
            yield frame(done)
            done = []
    if now:
        yield frame(closed())


_SENT = ["no_id", "conv", "no_turn", "turn0", "role", "text", "fault", "initial", "gone"]


def _sent(rows: DataFrame) -> DataFrame:
    """Without nulls, which pandas would turn into doubles."""
    return rows.select(F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("turn").isNull().alias("no_turn"), F.coalesce("turn", F.lit(0)).alias("turn0"), "role", "text", "fault", "initial", "gone")


def repairs(rows: DataFrame) -> DataFrame:
    """For rows (conv_id, turn, role, text, gone) of each conversation: gaps among its turns, rows by fault, adjacent roles that may
    not follow each other, cost, edits (audit) and the digest of the repaired role:text lines. A conversation whose rows are all gone
    is returned too."""
    short_batches(rows.sparkSession)
    return _sent(ordered(rows)).mapInPandas(_repair_stream, _RESULT)


def _apply_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, edits, at, state, position = None, "", 0, NOTHING, 0

    def inserts(out: list) -> None:
        nonlocal at, state, position
        while at < len(edits) and edits[at] == "I":
            role, state = NEXT[state]
            out.append((*key, position, role, "", "I"))
            at, position = at + 1, position + 1

    for batch in batches:
        out: list[tuple] = []
        for no_id, conv, role, text, initial, audit in zip(*(batch[c].tolist() for c in ("no_id", "conv", "role", "text", "initial", "audit")), strict=True):
            if (no_id, conv) != key:
                key, edits, at, state, position = (no_id, conv), audit, 0, NOTHING, 0
                inserts(out)
                continue  # the first row of a conversation brings its edits
            letter, at = edits[at], at + 1
            if letter != "D":
                wanted, after = NEXT[state]
                state = S if letter == "K" and initial == "s" else after
                out.append((*key, position, wanted if letter == "R" else role, text, letter))
                position += 1
            inserts(out)
        yield pd.DataFrame({"conv_id": pd.array([None if r[0] else r[1] for r in out], "Int64"), **{f: pd.Series([r[i] for r in out], dtype=kind) for i, f, kind in ((2, "position", "int64"), (3, "role", object), (4, "text", object), (5, "edit", object))}})


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations themselves: (conv_id, position, role, text, edit), by the edits that repairs() has found for the
    same rows. Each conversation's edits come first in its stream of rows."""
    short_batches(rows.sparkSession)
    own = ordered(rows.where("NOT gone")).select("conv_id", "turn", "role", "text", "initial", F.lit("").alias("audit"), F.lit(1).alias("place"))
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("initial"), "audit", F.lit(0).alias("place"))
    stream = heads.unionByName(own).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place", F.asc_nulls_first("turn"), "role", "text")
    sent = stream.select(F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "role", "text", "initial", "audit")
    return sent.mapInPandas(_apply_stream, "conv_id long, position long, role string, text string, edit string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damage(table(spark, sf_dir, "conversations")))
