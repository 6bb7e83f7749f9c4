"""Repair of conversations: the cheapest edits after which the roles read as the grammar wants, by Dijkstra over an implicit lattice.

A node is (turns taken, state of the grammar). An edit is an edge; the queue's key is the cost and then the initials of the edits so far. Of two
paths to one node at one cost, neither one's initials begin with the other's, as what follows would cost something; so the lesser of them
stays the lesser whatever comes after, and the first accepting end node that is popped ends the best path of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The grammar (s?(ua)+)? over the initials of roles as states and what each takes, the states where it may end, the roles that edits
# can give, and the costs of edits; an undeleted truncated turn costs more.
NEXT: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
GIVEN = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
BLANK = " \t\n\v\f\r"
#: Turns that one search covers. Longer conversations are searched piece by piece, from every state that a piece may begin in.
PIECE = 256

Turn = tuple[str, str, bool, bool]
Paths = dict[int, tuple[int, str]]


def search(turns: list[Turn], begin: int, whole: bool) -> Paths:
    """State at the end -> (cost, audit) of the best path there from state ``begin`` over ``turns`` (role, text, whether it must go, whether it is
    truncated). whole: only that of the first accepting state popped."""
    done: set[tuple[int, int]] = set()
    found: Paths = {}
    queue = [(0, "", 0, begin)]
    while queue:
        cost, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns):
            if whole and state in ACCEPTING:
                return {state: (cost, audit)}
            found[state] = (cost, audit)
        for letter, after in NEXT[state].items():
            if letter in GIVEN:
                heappush(queue, (cost + INSERT, audit + "I", i, after))
        if i == len(turns):
            continue
        role, _, must_go, truncated = turns[i]
        heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
        if not must_go:
            more = TRUNCATED if truncated else 0
            if role[:1] in NEXT[state]:
                heappush(queue, (cost + KEEP + more, audit + "K", i + 1, NEXT[state][role[:1]]))
            for letter, after in NEXT[state].items():
                if letter in GIVEN:
                    heappush(queue, (cost + REROLE + more, audit + "R", i + 1, after))
    return found


def replay(turns: list[Turn], state: int, audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what the edits ``audit`` leave of ``turns``, from ``state``."""
    i = 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = ("", "") if edit == "I" else turns[i][:2]
        i += edit != "I"
        letter = role[:1] if edit == "K" else next(x for x in NEXT[state] if x in GIVEN)
        state = NEXT[state][letter]
        yield edit, role if edit == "K" else GIVEN[letter], text


class Conversation:
    """One conversation, whose turns are added in their order. At most a piece of them is held; for each state that the pieces so far may end in, there
    is the best path, the hash of its repaired text and, if wanted, its turns."""

    def __init__(self, with_turns: bool) -> None:
        self.turns: list[Turn] = []
        self.paths: dict[int, tuple[int, str, object, list | None]] = {0: (0, "", sha256(), [] if with_turns else None)}
        self.blank = self.duplicate = self.truncated = self.illegal = self.numbers = 0
        self.least = self.most = self.before = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if len(self.turns) == PIECE:
            self._close(False)
        said = text.strip(BLANK)
        blank, duplicate = not said, bool(said) and again
        truncated = bool(said) and not again and said[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.numbers += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.turns.append((role, text, blank or duplicate, truncated))

    def _close(self, last: bool) -> None:
        """Take the piece: of the ways to each state the one of the least cost, then of the least audit."""
        best: dict[int, tuple[int, str, int, str]] = {}
        for begin, (cost, audit, _, _) in self.paths.items():
            for end, (more, edits) in search(self.turns, begin, last).items():
                way = (cost + more, audit + edits, begin, edits)
                best[end] = min(best.get(end, way), way)
        if last:
            end = min((e for e in best if e in ACCEPTING), key=lambda e: best[e][:2])
            best = {end: best[end]}
        paths = {}
        for end, (cost, audit, begin, edits) in best.items():
            _, _, hashed, turns = self.paths[begin]
            hashed = hashed.copy()
            first = not self.paths[begin][1].strip("D")
            left = list(replay(self.turns, begin, edits))
            for _, role, text in left:
                hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
            paths[end] = cost, audit, hashed, None if turns is None else turns + left
        self.paths, self.turns = paths, []

    def result(self) -> tuple:
        self._close(True)
        cost, audit, hashed, turns = next(iter(self.paths.values()))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.numbers
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, hashed.hexdigest(), turns


def repair(rows: DataFrame, present: Column | None = None, with_turns: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and turns (edit, role, text; only with_turns) of every
    conversation in ``rows`` (conv_id, turn, role, text).

    present: rows where it isn't true are no turns, but their conversation is in the result. Null roles and texts count as one space, a null conv_id
    is a conversation, an empty role has no initial and can't be kept, turns ascend with null ones first; those of one number go by role, then by the MD5 of their text, equal
    ones are alike in any order. A turn without any character but white space is blank, one whose role and text were there
    before is a duplicate, one that doesn't end in ``.!?`` is truncated; the first of these counts. Other columns are not read. An empty table gives
    no rows; a conversation without turns zeros, an empty audit and the hash of nothing.

    Rows are dealt by conversation once, and both the search for duplicates and the order of turns are sorts that can spill. A conversation is
    one task's work, since one hash runs over its text, but the task holds only a piece of it at a time, and its audit.
    """
    there = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    kind = dict(rows.dtypes)["conv_id"]
    said = rows.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), there.alias("present"))
    dealt = said.withColumn("text", F.when(F.col("present"), F.col("text")).otherwise("")).withColumn("hash", F.md5("text")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "present", "role", "hash").orderBy("turn")
    dealt = dealt.withColumn("again", F.row_number().over(same) > 1).sortWithinPartitions("conv_id", "turn", "role", "hash", "again")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    turns = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
    kinds = [pa.int64()] * 6 + [pa.string(), pa.string()] + ([turns] if with_turns else [])
    columns = ["conv_id", *names, "audit", "repaired_sha256"] + (["turns"] if with_turns else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            ids, *rest = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_kind), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=False))], columns)

        now, open_, id_kind = None, None, None
        for b in batches:
            id_kind = b.schema.field(0).type
            for conv_id, turn, role, text, is_there, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if open_ is None or conv_id != now:
                    if open_:
                        out.append((now, *open_.result()))
                        held += len(out[-1][7]) + sum(len(t[2]) for t in out[-1][9] or [])
                        if len(out) == 4096 or held > 16 << 20:
                            yield batch()
                            out, held = [], 0
                    now, open_ = conv_id, Conversation(with_turns)
                if is_there:
                    open_.add(turn, role, text, again)
        if open_:
            out.append((now, *open_.result()))
            yield batch()

    schema = f"conv_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string" + (", turns array<struct<edit: string, role: string, text: string>>" if with_turns else "")
    return dealt.select("conv_id", "turn", "role", "text", "present", "again").mapInArrow(run, schema)
