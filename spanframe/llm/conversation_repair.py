"""Operator 11: the cheapest edit script that repairs a conversation's structure.

A repaired conversation is a system turn or none, then user and assistant in turn,
ending with the assistant: role initials ``(s?(ua)+)?``. Kept turns cost 0 (1 if
truncated), a turn given another role 2 (3), a deleted turn 3, an inserted empty
turn 2; blank and repeated turns have to go. Among the cheapest scripts the one with
the least audit string stays (initials of the edits in order: D, I, K, R).

A dynamic programme over four states (nothing yet, after s, u or a) reads the turns
in order. Scripts that end in different states share their beginnings, so a script
is a linked node: last edit, number of edits, rolling hash of all of them, and
ancestors at powers of two. Two scripts of equal cost are compared by a search for
their longest common prefix: both are cut to one length, then lifted while their
hashes differ. The hashes only guide: the prefix they name is walked letter by letter
down to the node that both share, and a collision falls back to letters alone. Once
all states share a prefix it is final: its letters and digest input leave the
programme, so memory follows the number of turns that are still open, not the length.

Rows are dealt by conversation and sorted inside the partition (Spark spills), then
streamed. The digest of a conversation is defined over its turns in order, so one
conversation is read by one task, however long; that task holds open turns only, and
one letter an edit for the audit.

Defined cases: null roles and texts count as one space, null turns come first; turns
with equal numbers follow role and text. Null conversation ids form one conversation.
Blank: nothing but spaces and the characters 9 to 13. Repeated: role and text seen
earlier in the conversation (a blank turn counts as blank). Truncated: the last other
character is none of ``.!?``. Only a row's first fault counts. Conversations without turns
(``present`` false in all rows) have zeros, an empty audit and the digest of an empty
text. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanframe.session import ship_package

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: State after nothing, s, u, a; where each initial leads.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {"u": "user", "a": "assistant"}
#: Open turns before the first look for a prefix that all states share; later looks wait until twice as many are open.
SETTLE = 64
_BASE, _MOD = 0x1F123BB5, (1 << 61) - 1

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
FIELDS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Node:
    """A script: its last edit after the script ``up[0]``; ``up[k]`` is 2**k edits shorter."""

    __slots__ = ("edit", "role", "row", "length", "hash", "up")

    def __init__(self, parent: "Node | None", edit: str = "", role: str = "", row: int = -1):
        self.edit, self.role, self.row = edit, role, row
        if parent is None:
            self.length, self.hash, self.up = 0, 0, ()
            return
        self.length = parent.length + 1
        self.hash = (parent.hash * _BASE + ord(edit)) % _MOD
        up, k = [parent], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = up


def cut(node: Node, length: int) -> Node:
    """The script's first ``length`` edits."""
    while node.length > length:
        k = (node.length - length).bit_length() - 1
        node = node.up[k]
    return node


def same_letters(a: Node, b: Node) -> bool:
    """Letter by letter from the end to the node that both share; equal lengths."""
    while a is not b and a.up:
        if a.edit != b.edit:
            return False
        a, b = a.up[0], b.up[0]
    return True


def _letters(node: Node) -> str:
    out = []
    while node.up:
        out.append(node.edit)
        node = node.up[0]
    return "".join(reversed(out))


def before(a: Node, b: Node) -> bool:
    """True if a's edits come before b's in ASCII order."""
    if a is b:
        return False
    size = min(a.length, b.length)
    x, y = cut(a, size), cut(b, size)
    if x is y or (x.hash == y.hash and same_letters(x, y)):
        return a.length < b.length
    if x.hash == y.hash:  # two scripts met under one hash
        return _letters(a) < _letters(b)
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k] is not y.up[k] and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if not same_letters(x.up[0], y.up[0]):
        return _letters(a) < _letters(b)
    return x.edit < y.edit


class Repair:
    """The programme over one conversation's turns; finished turns go to ``emit(edit, role, row)``."""

    def __init__(self, emit):
        self.emit = emit
        self.best: list[tuple[int, Node] | None] = [(0, Node(None)), None, None, None]
        self.rows: dict[int, tuple[str, str]] = {}
        self.seen, self.patience = 0, SETTLE
        self._fill(self.best)

    @staticmethod
    def _offer(best: list, state: int, cost: int, parent: Node, edit: str, role: str, row: int) -> None:
        held = best[state]
        if held is not None and held[0] < cost:
            return
        node = Node(parent, edit, role, row)
        if held is None or cost < held[0] or before(node, held[1]):
            best[state] = (cost, node)

    def _fill(self, best: list) -> None:
        """Inserted turns: a chain of two reaches every state they can reach cheapest."""
        for _ in range(2):
            for state, held in enumerate(list(best)):
                if held is not None:
                    for initial in "ua":
                        if initial in STEP[state]:
                            self._offer(best, STEP[state][initial], held[0] + INSERT, held[1], "I", initial, -1)

    @staticmethod
    def _drop_beaten(best: list) -> None:
        """States that no cheapest script can pass any more, so that they do not hold the common prefix back.

        Whatever follows the start can follow an assistant turn too, but for a kept system turn, which is deleted there; whatever
        follows a system turn can follow an assistant turn.
        """
        if (held := best[3]) is not None:
            if best[0] is not None and held[0] + DELETE < best[0][0]:
                best[0] = None
            if best[1] is not None and held[0] < best[1][0]:
                best[1] = None

    def read(self, role: str, text: str, gone: bool, short: bool) -> None:
        row, self.seen = self.seen, self.seen + 1
        best: list = [None, None, None, None]
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            self._offer(best, state, cost + DELETE, node, "D", "", row)
            if gone:
                continue
            more = CUT_SHORT * short
            if (to := STEP[state].get(role[:1])) is not None:
                self._offer(best, to, cost + KEEP + more, node, "K", "", row)
            for initial in "ua":
                if (to := STEP[state].get(initial)) is not None:
                    self._offer(best, to, cost + REROLE + more, node, "R", initial, row)
        self._fill(best)
        self._drop_beaten(best)
        self.best, self.rows[row] = best, (role, text)
        if len(self.rows) >= self.patience:
            self.settle()
            self.patience = max(SETTLE, 2 * len(self.rows))

    def settle(self) -> None:
        """Give out the edits that all states share, and forget what came before them."""
        nodes = {id(x[1]): x[1] for x in self.best if x}
        while len(nodes) > 1:
            size = min(x.length for x in nodes.values())
            lower = [cut(x, size) for x in nodes.values()]
            nodes = {id(x): x for x in lower}
            if len(nodes) > 1:
                nodes = {id(x.up[0]): x.up[0] for x in lower}
        (shared,) = nodes.values()
        self._give(shared)
        # the shared node becomes a start of length 0: all that is compared later begins with it
        if shared.length:
            made = {id(shared): Node(None)}

            def again(node: Node) -> Node:
                chain = []
                while id(node) not in made:
                    chain.append(node)
                    node = node.up[0]
                new = made[id(node)]
                for old in reversed(chain):
                    new = made[id(old)] = Node(new, old.edit, old.role, old.row)
                return new

            self.best = [x and (x[0], again(x[1])) for x in self.best]

    def _give(self, node: Node) -> None:
        out = []
        while node.up:
            out.append(node)
            node = node.up[0]
        for x in reversed(out):
            role, text = self.rows.pop(x.row) if x.row >= 0 else ("", "")
            self.emit(x.edit, ROLES[x.role] if x.role else role, text)

    def finish(self) -> int:
        """Cost of the best whole script; what is open goes to ``emit``."""
        ends = [x for x in (self.best[0], self.best[3]) if x is not None]
        cost, node = ends[0]
        for c, x in ends[1:]:
            if c < cost or (c == cost and before(x, node)):
                cost, node = c, x
        self._give(node)
        return cost


class Conversation:
    """Counts, audit and digest of one conversation, fed turn by turn."""

    def __init__(self, want_turns: bool):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.distinct, self.low, self.high = None, 0, None, None
        self.last_initial = None
        self.audit: list[str] = []
        self.digest, self.written = hashlib.sha256(), 0
        self.out: list[tuple[str, str | None, str | None]] = []
        self.want_turns = want_turns
        self.repair = Repair(self._emit)

    def _emit(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.written += 1
        if self.want_turns:
            self.out.append((edit, None, None) if edit == "D" else (edit, role, text))

    def read(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.distinct, self.high = self.distinct + 1, turn
        if self.last_initial is not None and self.last_initial + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last_initial = role[:1]
        duplicate = duplicate and not blank
        truncated = truncated and not blank and not duplicate
        for name, value in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            self.counts[name] += value
        self.repair.read(role, text, blank or duplicate, truncated)

    def finish(self) -> tuple:
        cost = self.repair.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (min(gaps, (1 << 63) - 1), *self.counts.values(), cost, "".join(self.audit), self.digest.hexdigest())


#: What is not text: the characters 32 and 9 to 13.
SPACE = " \t\n\x0b\x0c\r"


def _faults(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Turns of each conversation together in order, with the faults of each."""
    spark = rows.sparkSession
    ship_package(spark)
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                      F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    out = out.repartition(F.col("conv"))
    copies = Window.partitionBy("conv", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    out = out.withColumn("blank", last == "").withColumn("duplicate", F.row_number().over(copies) > 1).withColumn("truncated", ~last.isin(".", "!", "?"))
    # the first of equal turns before its copies
    return out.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "duplicate")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _stream(batches: Iterator[pa.RecordBatch], want_turns: bool):
    """(conversation id, state) after each of its turns, and once more with ``True`` at its end."""
    held, name = None, None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for conv, turn, role, text, present, blank, duplicate, truncated in zip(*columns, strict=True):
            if held is None or conv != name:
                if held is not None:
                    yield name, held, True
                held, name = Conversation(want_turns), conv
            if present:
                held.read(turn, role, text, blank, duplicate, truncated)
                if held.out:
                    yield name, held, False
    if held is not None:
        yield name, held, True


def summarise(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row a conversation: faults, cost, audit and the digest of the repaired turns (``role:text`` lines).

    Rows where ``present`` is not true only name their conversation.
    """
    ready = _faults(rows, conv, turn, role, text, present)
    kind = dict(ready.dtypes)["conv"]

    kinds = [to_arrow_type(ready.schema["conv"].dataType), *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for name, held, ended in _stream(batches, False):
            if ended:
                done.append((name, *held.finish()))
                if len(done) >= 1000:
                    yield _batch(done, kinds, ["conv", *COLUMNS])
                    done = []
        if done:
            yield _batch(done, kinds, ["conv", *COLUMNS])

    found = ready.mapInArrow(run, f"conv {kind}, {FIELDS}")
    return found.withColumnRenamed("conv", conv)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, step, edit, role, text) for each edit; deleted turns have a null role and text."""
    ready = _faults(rows, conv, turn, role, text, present)
    kind = dict(ready.dtypes)["conv"]

    kinds = [to_arrow_type(ready.schema["conv"].dataType), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, step, of = 0, 0, None
        for name, held, ended in _stream(batches, True):
            if held is not of:
                step, of = 0, held
            if ended:
                held.finish()
            for edit, who, what in held.out:
                out.append((name, step, edit, who, what))
                step, size = step + 1, size + len(what or "") + 40
                if size > 1 << 21:
                    yield _batch(out, kinds, ["conv", "step", "edit", "role", "text"])
                    out, size = [], 0
            held.out = []
        if out:
            yield _batch(out, kinds, ["conv", "step", "edit", "role", "text"])

    return ready.mapInArrow(run, f"conv {kind}, step bigint, edit string, role string, text string").withColumnRenamed("conv", conv)
