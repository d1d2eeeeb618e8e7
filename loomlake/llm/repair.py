"""Conversation structure repair by Knuth's lightest-derivation agenda.

Roles must spell ``(s?(ua)+)?``. A repair item (i, state) says that the first i rows of a block were turned into turns that
lead from the block's first state to ``state``. Deductions are weighted edits: keep, rerole or delete the next row,
insert a turn. An item's value is (cost, audit), the audit being the edits' initials so far; adding an edit never
makes a value smaller and keeps the order of values of one item (equal costs over the same rows mean that neither
audit begins with the other), so the functions are superior and monotone, and the least value on the agenda is final. The
agenda ends when the goal item is final.

Conversations of any length: rows lie in range partitions sorted by conversation and turn. One that lies whole inside
a partition, in one block, is repaired there. Of others every block gives its lightest items from each state to each;
these few rows are joined in order, an item of several blocks being deduced from one before and one of the next block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import partial

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomlake.llm.common import small_side
from loomlake.llm.runs import blocks, map_stream, ranged
from loomlake.session import materialize

#: Rows that are repaired at once; longer conversations are put together from blocks.
BLOCK = 256
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (START, ASSISTANT)
#: Fixed values of the contract: what an edit costs, and what an undeleted truncated row costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_SPACE = " \t\n\x0b\x0c\r"


def after(state: int, initial: str) -> int | None:
    """The state after a turn whose role begins with ``initial``; None where the grammar has no such turn."""
    if initial == "a":
        return ASSISTANT if state == USER else None
    if initial == "u":
        return USER if state != USER else None
    return SYSTEM if initial == "s" and state == START else None


def lightest(rows: list[tuple[str, bool, bool]], start: int = START, whole: bool = True) -> dict[int, tuple[int, str]]:
    """Values (cost, audit) of the goal items: state -> lightest repair of ``rows`` (initial, must go, truncated) from ``start``.

    ``whole``: the first final item that is an end of the grammar is the goal, and the only result.
    """
    agenda, final, n = [(0, "", 0, start)], {}, len(rows)
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = cost, audit
        if i == n and whole and q in ENDS:
            return {q: (cost, audit)}
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, ASSISTANT if q == USER else USER))
        if i == n:
            continue
        initial, must_go, truncated = rows[i]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
        if must_go:
            continue
        more = TRUNCATED * truncated
        if (to := after(q, initial)) is not None:
            heapq.heappush(agenda, (cost + more, audit + "K", i + 1, to))
        heapq.heappush(agenda, (cost + REROLE + more, audit + "R", i + 1, ASSISTANT if q == USER else USER))
    return {q: final[n, q] for q in STATES if (n, q) in final}


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[str]:
    """The turns, as ``role:text``, that the edits of ``audit`` make of ``rows`` (role, text) from ``state`` on."""
    given = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(given)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = after(state, role[:1])
        yield f"{role}:{text}"


class Faults:
    """Counts over the rows of a conversation, which come in order, in one or several blocks."""

    def __init__(self) -> None:
        self.low = self.high = self.last = None  # of turns; the initial of the last role
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.some = False

    def add(self, rows: list[tuple]) -> list[tuple[str, bool, bool]]:
        """Counts ``rows`` (turn, role, text, copy); returns what the agenda takes."""
        out = []
        for turn, role, text, copy in rows:
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            words, initial = text.strip(_SPACE), role[:1]
            cut = bool(words) and not copy and words[-1] not in ".!?"
            self.blank += not words
            self.duplicate += bool(words) and copy
            self.truncated += cut
            self.illegal += self.some and self.last + initial not in ("su", "ua", "au")
            self.last, self.some = initial, True
            out.append((initial, copy or not words, cut))
        return out

    def values(self) -> tuple:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns, self.blank, self.duplicate, self.truncated, self.illegal


_FAULTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
_RESULT = f"conv long, {_FAULTS}, cost long, audit string, hash string"
_BLOCK = f"{_RESULT}, at long, rows array<struct<turn:long,role:string,text:string,copy:boolean>>, items array<struct<a:int,b:int,cost:long,audit:string>>"


def _hash(turns: Iterator[str]) -> str:
    return hashlib.sha256("\n".join(turns).encode()).hexdigest()


def _blocks(rows: Iterator[tuple], size: int) -> Iterator[tuple]:
    """Of rows (conv, turn, role, text, gone, copies, old) sorted by conversation: results, and blocks of ``size`` rows that wait for others."""

    def each() -> Iterator[tuple]:
        for conv, turn, role, text, gone, copies, old in rows:
            if gone:  # tells that there is the conversation
                yield conv, None
            else:
                for k in range(copies):
                    yield conv, (turn, role, text, bool(old or k))

    task = TaskContext.get().partitionId() << 32
    for at, ((conv,), held, begins, ends) in enumerate(blocks(each(), size)):
        held = [r for _, r in held if r is not None]
        if begins and ends:
            faults = Faults()
            ((cost, audit),) = lightest(faults.add(held)).values()
            yield conv, *faults.values(), cost, audit, _hash(repaired([r[1:3] for r in held], audit, START)), None, None, None
        else:
            edits = Faults().add(held)
            items = [(p, q, *value) for p in STATES for q, value in lightest(edits, p, False).items()]
            yield conv, *[None] * 8, task + at, held, items


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Results of conversations that lie in several blocks: (conv, at, rows, items) sorted by conversation and place.

    Of each state only the lightest item is held, with the running hash of its turns.
    """
    conv, front, faults = None, {}, None

    def result() -> tuple:
        cost, audit, h, _ = min((front[q] for q in ENDS if q in front), key=lambda x: x[:2])
        return conv, *faults.values(), cost, audit, h.hexdigest()

    for c, _, held, items in rows:
        if faults is None or c != conv:
            if faults is not None:
                yield result()
            conv, front, faults = c, {START: (0, "", hashlib.sha256(), False)}, Faults()
        held = [(r["turn"], r["role"], r["text"], r["copy"]) for r in held]
        faults.add(held)
        least: dict = {}
        for x in items:
            if x["a"] in front:
                cost, audit = front[x["a"]][:2]
                value = cost + x["cost"], audit + x["audit"]
                if x["b"] not in least or value < least[x["b"]][0]:
                    least[x["b"]] = value, x["a"], x["audit"]
        new = {}
        for q, (value, p, edits) in least.items():
            h, some = front[p][2].copy(), front[p][3]
            for turn in repaired([r[1:3] for r in held], edits, p):
                h.update((f"\n{turn}" if some else turn).encode())
                some = True
            new[q] = *value, h, some
        front = new
    if faults is not None:
        yield result()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone, copies): rows after damage, equal ones counted together.

    crc32 of ``conv_id:turn`` modulo 20 tells: 0 drops a row (it stays here as ``gone``), 1 empties its text, 2 takes
    ``[.!?]`` out of it, 3 repeats it, 4 makes its role user. A null counts as one space.
    """
    what = F.crc32(F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:-1]).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), what.alias("what"))
    text = F.when(F.col("what").isin(0, 1), "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 0, "").when(F.col("what") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("what") == 0).alias("gone"), F.when(F.col("what") == 3, 2).otherwise(1).alias("k"))
    return rows.groupBy("conv", "turn", "role", "text", "gone").agg(F.sum("k").alias("copies"))


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: its faults after damage, and the cheapest repair of its structure.

    Rows are taken by turn, nulls first; rows of the same turn by role, then text, after damage. Repeated rows are
    duplicates of each other. A null conv_id is a conversation of its own. Columns other than conv_id, turn, role
    and text are not read. An empty table gives no rows.
    """
    rows = materialize(damaged(conversations).withColumn("said", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))), "damaged")
    # role and text of several turns: all but those of the first turn are duplicates (equal rows of one turn meet anyway)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.where("not gone").groupBy("conv", "said").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = materialize(first.where("first < last").select(F.col("conv").alias("c"), F.col("said").alias("s"), "first"), "said-again")
    told = rows.join(small_side(first), F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")) & ~F.col("gone"), "left")
    told = told.withColumn("old", F.coalesce(place > F.col("first"), F.lit(False)))
    order = ("conv", "turn", "role", "text", "gone")
    made = materialize(map_stream(ranged(told.select(*order, "copies", "old"), *order), partial(_blocks, size=BLOCK), _BLOCK, 256), "repair-blocks")
    names = [x.split()[0] for x in _RESULT.split(", ")]
    split = made.where("at is not null").select("conv", "at", "rows", "items").repartition("conv").sortWithinPartitions("conv", "at")
    out = made.where("at is null").select(names).union(map_stream(split, _joined, _RESULT, 16))
    return out.withColumnsRenamed({"conv": "conv_id", "hash": "repaired_sha256"})
