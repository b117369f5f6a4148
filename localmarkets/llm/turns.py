"""Conversation structure repair by survivor-coalescence Viterbi.

A conversation's rows are read in the order of their turns. The first fault of a row counts: blank (no
character but white space), duplicate (its role and text stood before), truncated (its last character
but white space is none of ``.!?``). The cheapest edits make the role initials ``(s?(ua)+)?``: keep (0),
give the role user or assistant (3), delete (4; blank and duplicate rows must go), insert an empty row
of a user or an assistant (3); a truncated row that stays adds 3. Of equally dear edits those whose
initials (K, R, D, I) come first in ASCII are taken.

The edits are the states' paths of a Viterbi search. A state (nothing written, system, user, assistant)
keeps its cheapest path as a node of a tree of backpointers, in which each node counts what refers to
it: children and survivors. A node that nothing refers to is freed; where the root has one child left
and no survivor, all survivors share that edit, so it is told and the root moves on. Equal costs are
compared by the whole tied paths down from their common node. A run of one edit is one node. What a
task holds is therefore what is not yet decided, whatever the length of the conversation; the repaired
text goes straight into its digest. A state whose cost can't be made good by any continuation (one that
nothing was written in, or a system row only, against an assistant's) is dropped, so that the paths
meet. A conversation's text is one digest and its edits one string, so its rows pass through one task,
in Spark's sorted order and one batch at a time; whether a row is a duplicate is decided before, by an
aggregate over (conversation, role, text).

Defined results: null roles and texts are one space; an empty role has no initial, so such a row can't
be kept and breaks adjacent rows; null turns come first; rows of one turn are ordered by role and text; a null
conversation id is a conversation; no rows give no results. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from localmarkets.shared import cut

#: States: nothing written, last a system row, a user's, an assistant's. Whole conversations end in the first or last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: state -> {initial: next state}
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\v\f\r"
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "conv long, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string"


class Node:
    """``count`` times the same edits of a row; ``refs``: children and survivors that stand on it."""

    __slots__ = ("parent", "letters", "count", "depth", "refs", "kids", "row")

    def __init__(self, parent: Node | None, letters: str, row: tuple[str, str] | None):
        self.parent, self.letters, self.count, self.refs, self.kids, self.row = parent, letters, 1, 0, set(), row
        self.depth = 0
        if parent:
            self.depth = parent.depth + 1
            parent.refs += 1
            parent.kids.add(self)


def release(node: Node) -> None:
    """One reference less; what nothing refers to any more is freed, up the tree."""
    node.refs -= 1
    while not node.refs and node.parent:
        node.parent.kids.discard(node)
        node = node.parent
        node.refs -= 1


def path(node: Node, above: Node) -> str:
    out = []
    while node is not above:
        out.append(node.letters * node.count)
        node = node.parent
    return "".join(reversed(out))


def earlier(a: Node, a_more: str, b: Node, b_more: str) -> bool:
    """Whether path ``a`` and ``a_more`` come before ``b`` and ``b_more`` in ASCII: all that follows their common node is compared."""
    x, y = a, b
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
    return path(a, x) + a_more < path(b, x) + b_more


def _insertions(state: int) -> list[tuple[str, int, int]]:
    """(letters, state after, cost): two insertions reach all that insertions can reach."""
    out = [("", state, 0)]
    for _ in range(2):
        letters, at, cost = out[-1]
        out.append((letters + "I", NEXT[at]["a" if at == USER else "u"], cost + INSERT))
    return out


def _moves(initial: str, fault: str) -> list[tuple[int, str, int, int]]:
    """(state before, letters, state after, cost) of a row's edit and the insertions after it."""
    out = []
    for state, on in NEXT.items():
        edits = [("D", state, DELETE)]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            edits += [("K", on[initial], KEEP + more)] if initial in on else []
            edits += [("R", on[x], REROLE + more) for x in ROLE if x in on]
        out += [(state, letter + letters, to, cost + added) for letter, after, cost in edits for letters, to, added in _insertions(after)]
    return out


class Repair:
    """One conversation: rows go in one by one, facts, edits and digest come out."""

    moves: dict[tuple[str, str], list[tuple[int, str, int, int]]] = {}

    def __init__(self):
        self.root = Node(None, "", None)
        self.alive: dict[int, tuple[int, Node]] = {NOTHING: (0, self.root)}
        self.root.refs = 1
        self.facts = dict.fromkeys(FACTS, 0)
        self.least = self.turn = None
        self.distinct = 0
        self.before: tuple | None = None  # turn, role, text of the last row
        self.told: list[str] = []
        self.digest, self.wrote, self.last = hashlib.sha256(), False, ""
        self._step([(NOTHING, letters, to, added) for letters, to, added in _insertions(NOTHING)], None)

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """``seen``: the role and the text stand at an earlier turn."""
        if turn is not None and turn != self.turn:
            self.least, self.turn, self.distinct = turn if self.turn is None else self.least, turn, self.distinct + 1
        shown = text.rstrip(SPACE)
        same = self.before == (turn, role, text)
        fault = "blank" if not shown else "duplicate" if seen or same else "truncated" if shown[-1] not in ".!?" else ""
        if fault:
            self.facts[fault] += 1
        if self.before and self.before[1][:1] + role[:1] not in LEGAL:
            self.facts["illegal"] += 1
        self.before = turn, role, text
        kind = role[:1] if role[:1] in ("s", "u", "a") else "", fault
        if kind not in self.moves:
            self.moves[kind] = _moves(*kind)
        self._step(self.moves[kind], (role, text))

    def _step(self, moves: list[tuple[int, str, int, int]], row: tuple[str, str] | None) -> None:
        best: dict[int, tuple[int, Node, str]] = {}
        for state, letters, to, more in moves:
            if state in self.alive:
                cost, node = self.alive[state]
                cost += more
                held = best.get(to)
                if held is None or cost < held[0] or (cost == held[0] and earlier(node, letters, held[1], held[2])):
                    best[to] = cost, node, letters
        self._drop_hopeless(best)
        heirs = [node for _, node, _ in best.values()]
        after = {}
        for to, (cost, node, letters) in best.items():
            if letters == "D" == node.letters and node.refs == 1 and heirs.count(node) == 1 and node is not self.root:
                node.count += 1  # a run of deletions is one node
            else:
                node = Node(node, letters, row if letters[:1] in ("K", "R") else None)
            node.refs += 1
            after[to] = cost, node
        for _, node in self.alive.values():
            release(node)
        self.alive = after
        while self.root.refs == 1 and self.root.kids:  # all survivors share the next edit
            self._tell(next(iter(self.root.kids)))

    def _drop_hopeless(self, best: dict[int, tuple[int, Node, str]]) -> None:
        """From an assistant's row on, everything goes that goes after nothing or a system row, but for one system row, which can be deleted."""
        if ASSISTANT in best:
            most = best[ASSISTANT][0]
            for state, more in ((NOTHING, DELETE), (SYSTEM, 0)):
                if state in best and best[state][0] > most + more:
                    del best[state]

    def _tell(self, node: Node) -> None:
        """The edits of ``node`` are decided: it becomes the root."""
        for letter in node.letters:
            if letter == "D":
                continue
            role, text = node.row if letter in ("K", "R") else ("", "")
            if letter != "K":
                role = ROLE["a" if self.last == "u" else "u"]
            self.digest.update((("\n" if self.wrote else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.wrote, self.last = True, role[:1]
        self.told.append(node.letters * node.count)
        self.root, node.parent = node, None

    def result(self) -> tuple:
        ends = [(*self.alive[s], s) for s in (NOTHING, ASSISTANT) if s in self.alive]
        cost, node, _ = ends[0]
        for other, there, _ in ends[1:]:
            if other < cost or (other == cost and earlier(there, "", node, "")):
                cost, node = other, there
        way = []
        while node is not self.root:
            way.append(node)
            node = node.parent
        for step in reversed(way):
            self._tell(step)
        if self.turn is not None:
            self.facts["gaps"] = self.turn - self.least + 1 - self.distinct
        self.facts["cost"] = cost
        return *self.facts.values(), "".join(self.told), self.digest.hexdigest()


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation that has rows: conv, ``FACTS``, audit (edits' initials), repaired_sha256."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    read = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    key = ["known", "of", "role", "mark"]
    read = read.select("conv", "turn", "role", "text", F.col("conv").isNotNull().alias("known"), F.coalesce("conv", F.lit(0)).alias("of"), F.sha2("text", 256).alias("mark"))
    at = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = read.groupBy(key).agg(F.min(at).alias("first"))
    seen = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    marked = read.join(first, key).select("known", "of", "conv", "turn", "role", "text", seen.alias("seen"))
    inorder = marked.repartition("known", "of").sortWithinPartitions("known", "of", F.asc_nulls_first("turn"), "role", "text")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch's rows go in together; a conversation that is not over is carried on.
        held, job = None, None
        done: list[tuple] = []
        for batch in batches:
            for known, of, conv, turn, role, text, seen in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held != (known, of):
                    if job:
                        done.append((held_conv, *job.result()))
                    held, held_conv, job = (known, of), conv, Repair()
                job.add(turn, role, text, seen)
            if done:
                yield _batch(done)
                done = []
        if job:
            yield _batch([(held_conv, *job.result())])

    return cut(inorder.mapInArrow(repair, RESULT), "repaired")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * (1 + len(FACTS)) + [pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", *FACTS, "audit", "repaired_sha256"])


def repair_conversations(original: DataFrame, rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``repaired`` rows with one row for each conversation of ``original``: zeros, no edits and the digest of nothing where it has no rows left."""
    done = repaired(rows, conv_col)
    every = original.select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    facts = [F.coalesce(c, F.lit(0)).alias(c) for c in FACTS]
    return every.join(done, every["conv_id"].eqNullSafe(done["conv"]), "left").select("conv_id", *facts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def damaged(rows: DataFrame, law: Column) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) with planted faults; ``law`` (over these columns, nulls one space): 0 drops a row,
    1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes it a user's; anything else leaves it."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    read = rows.select("conv_id", "turn", *said).withColumn("law", law).where("law <> 0")
    text = F.when(F.col("law") == 1, "").when(F.col("law") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("law") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.array_repeat(F.lit(1), F.when(F.col("law") == 3, 2).otherwise(1)))
    return read.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("copy")).drop("copy")
