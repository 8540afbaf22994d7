"""Repair of conversations by least edits.

A repaired conversation's role initials match ``(s?(ua)+)?``, an automaton of four
states.  Before each of a conversation's n rows, and behind the last, there is a
*layer* of four nodes, one for each state; edits are arcs.  Insert stays in its
layer, Keep, Rerole and Delete lead to the next.  Least costs forward from the
start and backward from the accepting end tell which arcs are *tight*, that is lie
on some cheapest path.  From the start a set of nodes, the frontier, walks along the
tight arcs: at each step the least edit letter that any of its nodes offers is
taken, and the frontier becomes all that this letter leads to.

Costs: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or
assistant row 5; a truncated row that is not deleted adds 5; blank and duplicate rows
can only be deleted.

How it runs.  Rows are range partitioned and sorted by (conversation, turn, role,
text), and a task walks through its part in *blocks* of bounded size.  A conversation
that lies inside one block is repaired at once.  One that a block's or a task's end
cuts is *open*: each of its blocks gives the 4 x 4 least costs from its first layer
to its last, these are chained per conversation (one small row for each block), and
with the costs at both ends of each block known, all blocks are repaired in parallel;
for each state they might be entered in, they say where they end, and a second chain
picks.  From one state a letter leads to one state only, so that is all that can
happen.  So a conversation that holds a third of all rows is many blocks; only
its digest, one hash of one text, is a stream through one task.

Later copies of a row's role and text are told by an aggregate over their hashes; of
rows that are equal in conversation, turn, role and text, all but the first in order
are such copies.

Defined cases: nulls in role and text count as one space, which makes a null text
blank and a null role one that can only be deleted or reroled, like any other role
with another initial; rows with a null turn come first; rows with one turn are
ordered by role, then by the md5 of their text; a null conv_id is a conversation of its own; repeated rows are duplicates; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stored

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Rows and bytes of text of a block at most (one row may be longer).
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after s, after u, after a; the first and the last accept.
START, S, U, A = range(4)
_NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: What Rerole and Insert write in each state, and where it leads.
_OFFER = {START: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
_LEGAL = {"su", "ua", "au"}
_FAR = 1 << 50
_INSIDE = np.full((4, 4), _FAR, np.int64)
for _q, (_, _to) in _OFFER.items():
    _INSIDE[_q, _q], _INSIDE[_q, _to] = 0, INSERT
_END = np.array([0, _FAR, _FAR, 0], np.int64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs of a path of ``a`` and then one of ``b``; a vector is taken as costs at one end."""
    if a.ndim == 1:
        return np.minimum((a[:, None] + b).min(0), _FAR)
    return np.minimum((a[:, :, None] + b[None]).min(1) if b.ndim == 2 else (a + b).min(1), _FAR)


#: Costs between the nodes of one layer: at most three inserts pay.
_LAYER = times(times(_INSIDE, _INSIDE), _INSIDE)


def row_costs(initial: str, fault: int) -> np.ndarray:
    """Costs of the arcs of one row from state to state."""
    out = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(out, DELETE)
    if fault in (BLANK, DUPLICATE):
        return out
    extra = CUT if fault == TRUNCATED else 0
    for q, (_, to) in _OFFER.items():
        out[q, to] = REROLE + extra
    for (q, c), to in _NEXT.items():
        if c == initial:
            out[q, to] = KEEP + extra
    return out


_ROWS = {(c, fault): row_costs(c, fault) for c in ("s", "u", "a", "") for fault in range(4)}


def _of_row(initial: str, fault: int) -> np.ndarray:
    return _ROWS[initial if initial in ("s", "u", "a") else "", fault]


def through(initials: list[str], faults: list[int]) -> np.ndarray:
    """4 x 4 least costs over rows, with inserts before each."""
    total = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(total, 0)
    for c, f in zip(initials, faults, strict=True):
        total = times(times(total, _LAYER), _of_row(c, f))
    return total


def walk(initials: list[str], faults: list[int], at: np.ndarray, behind: np.ndarray, frontier: set[int], last: bool) -> tuple[str, set[int]]:
    """The letters of the least cheapest edits of these rows, and the frontier behind them.

    ``at`` has the least costs from the conversation's start to the first layer's
    states, ``behind`` those from the states behind the last row to its end;
    ``last`` says that no rows follow, and inserts may.
    """
    n = len(initials)
    forward = [times(at, _LAYER)]
    for c, f in zip(initials, faults, strict=True):
        forward.append(times(times(forward[-1], _of_row(c, f)), _LAYER))
    backward = [behind if not last else times(_LAYER, behind)]
    for c, f in zip(reversed(initials), reversed(faults), strict=True):
        backward.append(times(_LAYER, times(_of_row(c, f), backward[-1])))
    backward.reverse()
    best = int((forward[0] + backward[0]).min())
    letters: list[str] = []
    for i in range(n + 1):
        f, b = forward[i], backward[i]
        costs = _of_row(initials[i], faults[i]) if i < n else None
        while True:
            moves: dict[str, set[int]] = {}
            for q in frontier:
                to = _OFFER[q][1]
                if (i < n or last) and f[q] + INSERT + b[to] == best:
                    moves.setdefault("I", set()).add(to)
                if costs is None:
                    continue
                ahead = backward[i + 1]
                if f[q] + DELETE + ahead[q] == best:
                    moves.setdefault("D", set()).add(q)
                if faults[i] in (BLANK, DUPLICATE):
                    continue
                extra = CUT if faults[i] == TRUNCATED else 0
                if (kept := _NEXT.get((q, initials[i]))) is not None and f[q] + KEEP + extra + ahead[kept] == best:
                    moves.setdefault("K", set()).add(kept)
                if f[q] + REROLE + extra + ahead[to] == best:
                    moves.setdefault("R", set()).add(to)
            if not moves:
                break
            letter = min(moves)
            letters.append(letter)
            frontier = moves[letter]
            if letter != "I":
                break
    return "".join(letters), frontier


def cost_of(letters: str, faults: list[int]) -> int:
    """What these edits of rows with these faults cost."""
    rows = [x for x in letters if x != "I"]
    cut = sum(x != "D" and f == TRUNCATED for x, f in zip(rows, faults, strict=True))
    return REROLE * rows.count("R") + DELETE * rows.count("D") + INSERT * (len(letters) - len(rows)) + CUT * cut


def spoken(letters: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    out_roles, out_texts, i = [], [], 0
    for letter in letters:
        if letter == "I":
            role, state = _OFFER[state]
            out_roles.append(role)
            out_texts.append("")
            continue
        if letter == "K":
            out_roles.append(roles[i])
            out_texts.append(texts[i])
            state = _NEXT[state, roles[i][:1]]
        elif letter == "R":
            role, state = _OFFER[state]
            out_roles.append(role)
            out_texts.append(texts[i])
        i += 1
    return out_roles, out_texts


# --- rows -------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: each row damaged by what crc32 of ``conv_id:turn`` leaves by 20.

    0 drops it (no copies), 1 empties its text, 2 takes ``[.!?]`` from it, 3 repeats
    it, 4 makes it the user's.  Nulls in the key count as one space, as they do in role and text.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with ``fault``; copies of an earlier turn's role and text are found by their hashes."""
    spark = rows.sparkSession
    space = r"[\x20\x09-\x0D]"
    whole = F.regexp_replace("text", f"{space}+$", "")
    rows = rows.withColumns({"h": F.md5(F.col("text").cast("binary")), "fault": F.when(F.length(whole) == 0, BLANK).when(~F.substring(whole, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)})
    turns = F.struct(F.col("turn").isNotNull(), "turn")  # null first
    light = rows.where((F.col("copies") > 0) & (F.col("fault") != BLANK)).select("conv_id", "role", "h", turns.alias("t"))
    repeated = light.groupBy("conv_id", "role", "h").agg(F.min("t").alias("first"), F.max("t").alias("latest")).where("first <> latest").select("conv_id", "role", "h", "first")
    # written, so that its size is known: small ones are broadcast, a large one is joined by exchange, where frequent keys are split
    repeated = stored(repeated, "repeated").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("x"), "first")
    met = rows.join(repeated, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("x")), "left")
    late = F.col("first").isNotNull() & (F.col("fault") != BLANK) & (turns != F.col("first"))
    return met.withColumn("fault", F.when(late, DUPLICATE).otherwise(F.col("fault"))).select("conv_id", "turn", "role", "h", "text", "copies", "fault")


@dataclass
class Block:
    """Neighbouring rows of one conversation."""

    conv_id: int | None
    head: tuple | None = None
    last: tuple | None = None
    rows: int = 0
    size: int = 0
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)
    turns: int = 0
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, role: str, h: str, text: str, copies: int, fault: int) -> None:
        key = (turn, role, h)
        for _ in range(copies):
            own = DUPLICATE if fault != BLANK and self.last == key else fault
            if self.head is None:
                self.head = key
            if turn is not None and turn != self.high:
                self.turns += 1
                self.low, self.high = turn if self.low is None else self.low, turn
            self.last = key
            self.rows += 1
            self.roles.append(role)
            # a row that must go needs no text
            self.texts.append("" if own in (BLANK, DUPLICATE) else text)
            self.faults.append(own)
            self.size += len(self.texts[-1]) + len(role)

    def initials(self) -> list[str]:
        return [r[:1] for r in self.roles]

    def bad(self) -> int:
        c = self.initials()
        return sum(a + b not in _LEGAL for a, b in zip(c, c[1:], strict=False))


_BLOCK = (
    "conv_id long, task int, number int, whole boolean, head string, last string, first_initial string, last_initial string, turns long, low long, high long, "
    "blank long, duplicate long, truncated long, illegal long, cost long, costs array<long>, costs_if_copy array<long>, "
    "audit string, roles array<string>, texts array<string>, faults array<int>"
)
_BLOCK_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("task", pa.int32()), ("number", pa.int32()), ("whole", pa.bool_())]
    + [(c, pa.string()) for c in ("head", "last", "first_initial", "last_initial")]
    + [(c, pa.int64()) for c in ("turns", "low", "high", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [(c, pa.list_(pa.int64())) for c in ("costs", "costs_if_copy")]
    + [("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.int32()))]
)


def _as_text(key: tuple | None) -> str | None:
    return None if key is None else f"{'' if key[0] is None else key[0]}|{key[2]}|{key[1]}"


def _described(block: Block, task: int, number: int, whole: bool) -> dict:
    """A block's row: repaired if it is a whole conversation, else with what the chain needs."""
    c, faults = block.initials(), block.faults
    out = {"conv_id": block.conv_id, "task": task, "number": number, "whole": whole, "head": _as_text(block.head), "last": _as_text(block.last)}
    out |= {"first_initial": c[0] if c else None, "last_initial": c[-1] if c else None, "turns": block.turns, "low": block.low, "high": block.high}
    out |= {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": block.bad(), "cost": None, "costs": None, "costs_if_copy": None, "audit": None}
    if whole:
        start = np.array([0, _FAR, _FAR, _FAR], np.int64)
        audit, _ = walk(c, faults, start, _END, {START}, True)
        roles, texts = spoken(audit, block.roles, block.texts, START)
        return out | {"cost": cost_of(audit, faults), "audit": audit, "roles": roles, "texts": texts, "faults": None}
    rest = through(c[1:], faults[1:])
    head = lambda f: times(times(_LAYER, _of_row(c[0], f)), rest).ravel().tolist()
    if c:
        out |= {"costs": head(faults[0]), "costs_if_copy": head(DUPLICATE if faults[0] != BLANK else BLANK)}
    return out | {"roles": block.roles, "texts": block.texts, "faults": faults}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks: one for each conversation unless it is long or may go on in another task."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    block: Block | None = None
    number, first, cut = 0, True, False
    out: list[dict] = []

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, _BLOCK_ARROW)

    held = 0
    for batch in batches:
        for conv_id, turn, role, h, text, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "h", "text", "copies", "fault")), strict=True):
            if block is not None and block.conv_id != conv_id:
                out.append(_described(block, task, number, not first and not cut))
                held += block.size
                block, first, cut, number = None, False, False, number + 1
            elif block is not None and (block.rows >= BLOCK_ROWS or block.size >= BLOCK_BYTES):
                out.append(_described(block, task, number, False))
                held += block.size
                seen, high = block.last, block.high
                block, cut, number = Block(conv_id, last=seen, high=high), True, number + 1
            if block is None:
                block = Block(conv_id)
            block.add(turn, role, h, text, copies, fault)
            if held > BLOCK_BYTES or len(out) >= 2048:
                yield packed(out)
                out, held = [], 0
    if block is not None:
        out.append(_described(block, task, number, False))
    if out:
        yield packed(out)


_COUNTS = ("turns", "low", "high", "blank", "duplicate", "truncated", "illegal")
_DONE = "conv_id long, task int, number int, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>"


def repaired_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole conversations, and blocks of the open ones: audit letters, repaired roles and texts, and what they count."""
    spark = rows.sparkSession
    bounded_batches(spark)
    # ties by hash of the text; rows that are equal in all may lie in several tasks, and are known as copies by what lies before them
    dealt = _marked(rows).repartitionByRange("conv_id", "turn", "role", "h", F.rand(5)).sortWithinPartitions("conv_id", "turn", "role", "h")
    blocks = stored(dealt.mapInArrow(_blocks, _BLOCK), "blocks", 16 << 20)
    open_, keys = blocks.where("not whole"), ["task", "number"]
    ends = open_.select("conv_id", *keys, "head", "last", "first_initial", "last_initial", F.col("low").cast("string"), F.col("high").cast("string"), "costs", "costs_if_copy")
    chain = ends.groupBy("conv_id").applyInPandas(_chained, "task int, number int, at array<long>, behind array<long>, copy boolean, ends boolean, more_turns long, more_illegal long")
    chain = stored(chain, "chain")
    walked = stored(open_.select(*keys, "roles", "faults").join(chain, keys).mapInArrow(_walked, _WALKED), "walked")
    picked = open_.select("conv_id", *keys).join(walked, keys).groupBy("conv_id").applyInPandas(_picked, "task int, number int, state int, audit string")
    done = open_.drop("audit").join(chain, keys).join(picked, keys)
    head, sound = F.get("faults", F.lit(0)), F.col("copy")
    done = done.withColumns(
        {
            "turns": F.col("turns") - F.col("more_turns"),
            "illegal": F.col("illegal") + F.col("more_illegal"),
            "duplicate": F.col("duplicate") + F.when(sound & head.isin(SOUND, TRUNCATED), 1).otherwise(0),
            "truncated": F.col("truncated") - F.when(sound & (head == TRUNCATED), 1).otherwise(0),
        }
    )
    return blocks.where("whole").select("conv_id", *keys, *_COUNTS, "cost", "audit", "roles", "texts"), done.select("conv_id", *keys, *_COUNTS, "audit", "state", "roles", "texts", "faults").mapInArrow(_edited, _DONE)


def _chained(group: pd.DataFrame) -> pd.DataFrame:
    """Costs at both ends of each block of a conversation, and what its first row has to do with the block before."""
    at = np.array([0, _FAR, _FAR, _FAR], np.int64)
    out, last, initial, high = [], None, None, None
    for r in group.sort_values(["task", "number"]).to_dict("records"):
        filled = r["first_initial"] is not None
        copy = bool(filled and last is not None and r["head"] == last)
        costs = r["costs_if_copy" if copy else "costs"] if filled else np.where(np.eye(4, dtype=bool), 0, _FAR)
        m = np.array(costs, np.int64).reshape(4, 4)
        out.append({"task": r["task"], "number": r["number"], "at": at.tolist(), "copy": copy, "more_turns": int(r["low"] is not None and r["low"] == high), "more_illegal": int(filled and initial is not None and initial + r["first_initial"] not in _LEGAL), "m": m})
        at = times(at, m)
        if filled:
            last, initial = r["last"], r["last_initial"]
        high = r["high"] if r["high"] is not None else high
    behind = _END
    for k, r in enumerate(reversed(out)):
        r["ends"], r["behind"] = k == 0, behind.tolist()
        behind = times(r["m"], behind if k else times(_LAYER, behind))
    return pd.DataFrame(out)[["task", "number", "at", "behind", "copy", "ends", "more_turns", "more_illegal"]]


_WALKED = "task int, number int, entries array<int>, exits array<int>, audits array<string>"


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state that an open block might be entered in: its letters, and the state behind."""
    for batch in batches:
        columns: dict[str, list] = {"task": [], "number": [], "entries": [], "exits": [], "audits": []}
        for r in batch.to_pylist():
            faults = r["faults"]
            if r["copy"] and faults[0] != BLANK:
                faults[0] = DUPLICATE
            initials = [x[:1] for x in r["roles"]]
            at, behind = np.array(r["at"], np.int64), np.array(r["behind"], np.int64)
            states = [q for q in range(4) if at[q] < _FAR]
            ways = [walk(initials, faults, at, behind, {q}, r["ends"]) for q in states]
            for name, value in (("task", r["task"]), ("number", r["number"]), ("entries", states), ("exits", [min(to) for _, to in ways]), ("audits", [letters for letters, _ in ways])):
                columns[name].append(value)
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_pydict({name: pa.array(values, kind) for (name, values), kind in zip(columns.items(), kinds, strict=True)})


def _picked(group: pd.DataFrame) -> pd.DataFrame:
    """The letters that each block of a conversation really gets, and the state it is entered in."""
    state, out = START, []
    for r in group.sort_values(["task", "number"]).to_dict("records"):
        k = list(r["entries"]).index(state)
        out.append({"task": r["task"], "number": r["number"], "state": state, "audit": r["audits"][k]})
        state = int(r["exits"][k])
    return pd.DataFrame(out)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts, costs = [], [], []
        for letters, own, said, state, faults in zip(*(batch.column(c).to_pylist() for c in ("audit", "roles", "texts", "state", "faults")), strict=True):
            r, t = spoken(letters, own, said, state)
            roles.append(r)
            texts.append(t)
            costs.append(cost_of(letters, faults))
        kept = {c: batch.column(c) for c in ("conv_id", "task", "number", *_COUNTS)}
        yield pa.RecordBatch.from_pydict(kept | {"cost": pa.array(costs, pa.int64()), "audit": batch.column("audit"), "roles": pa.array(roles, pa.list_(pa.string())), "texts": pa.array(texts, pa.list_(pa.string()))})


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations, ordered within each by ``place``.

    ``rows`` are conv_id, turn, role, text and ``copies``, the number of times a row stands there (0: it was lost).
    """
    whole, parts = repaired_blocks(rows)
    turns = whole.unionByName(parts).select("conv_id", "task", "number", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "z"))
    return turns.select("conv_id", F.struct("task", "number", "i").alias("place"), F.col("z.roles").alias("role"), F.col("z.texts").alias("text"))


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its blocks in order; of its texts only the state of the hash is held."""
    own: dict | None = None
    names = ("turns", "blank", "duplicate", "truncated", "illegal", "cost")

    def closed(x: dict) -> pa.RecordBatch:
        gaps = 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"]
        row = {"conv_id": pa.array([x["conv_id"]], pa.int64()), "gaps": pa.array([gaps], pa.int64())}
        row |= {c: pa.array([x[c]], pa.int64()) for c in names[1:]}
        return pa.RecordBatch.from_pydict(row | {"audit": ["".join(x["letters"])], "repaired_sha256": [x["hash"].hexdigest()]})

    for batch in batches:
        for r in batch.to_pylist():
            if own is None or own["conv_id"] != r["conv_id"]:
                if own is not None:
                    yield closed(own)
                own = {"conv_id": r["conv_id"], "low": None, "high": None, "letters": [], "hash": hashlib.sha256(), "any": False} | dict.fromkeys(names, 0)
            for c in names:
                own[c] += r[c]
            own["low"] = r["low"] if own["low"] is None else own["low"]
            own["high"] = own["high"] if r["high"] is None else r["high"]
            own["letters"].append(r["audit"])
            if r["lines"] is not None:
                own["hash"].update((("\n" if own["any"] else "") + r["lines"]).encode())
                own["any"] = True
    if own is not None:
        yield closed(own)


def audits(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows``: its counts, cost, edit letters, and the hash of the repaired lines."""
    whole, parts = repaired_blocks(rows)
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    one = whole.select("conv_id", gaps.alias("gaps"), *_COUNTS[3:], "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))
    lines = parts.withColumn("lines", F.when(F.size("roles") > 0, said)).drop("roles", "texts")
    # blocks of one conversation in order; a row here is a block
    many = lines.repartition("conv_id").sortWithinPartitions("conv_id", "task", "number").mapInArrow(_digests, _DIGEST)
    return one.unionByName(many)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, faults and least repair of all ``conversations``."""
    return audits(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The same rows by a recursive query that keeps the least (cost, letters) for each state.
OP12_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crcs AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT),
                            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM crcs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) - 1 AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen FROM damaged),
marked AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c,
         CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
convs AS (SELECT DISTINCT conv_id FROM conversations),
sizes AS (SELECT conv_id, count(*) AS n FROM marked GROUP BY conv_id),
inserts(q, p, n, said) AS (VALUES (0, 0, 0, []::VARCHAR[]), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 1, 0, []), (1, 2, 1, ['user:']),
  (1, 3, 2, ['user:', 'assistant:']), (2, 2, 0, []), (2, 3, 1, ['assistant:']), (3, 3, 0, []), (3, 2, 1, ['user:'])),
edits(p, letter, t, price, initial, role) AS (VALUES (0, 'D', 0, 2, NULL, NULL), (1, 'D', 1, 2, NULL, NULL), (2, 'D', 2, 2, NULL, NULL), (3, 'D', 3, 2, NULL, NULL),
  (0, 'R', 2, 1, NULL, 'user'), (1, 'R', 2, 1, NULL, 'user'), (2, 'R', 3, 1, NULL, 'assistant'), (3, 'R', 2, 1, NULL, 'user'),
  (0, 'K', 1, 0, 's', NULL), (0, 'K', 2, 0, 'u', NULL), (1, 'K', 2, 0, 'u', NULL), (2, 'K', 3, 0, 'a', NULL), (3, 'K', 2, 0, 'u', NULL)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} AS best FROM convs
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.t,
         min({'cost': (w.best.cost + 5 * s.n + e.price + CASE WHEN m.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END)::BIGINT,
              'audit': w.best.audit || repeat('I', s.n) || e.letter,
              'said': w.best.said || s.said || CASE e.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'R' THEN [e.role || ':' || m.text] ELSE [m.role || ':' || m.text] END})
  FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i JOIN inserts s ON s.q = w.q JOIN edits e ON e.p = s.p
  WHERE (e.initial IS NULL OR e.initial = m.c) AND (e.letter = 'D' OR m.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, w.i, e.t),
ends AS (
  SELECT w.conv_id, min({'cost': (w.best.cost + 5 * s.n)::BIGINT, 'audit': w.best.audit || repeat('I', s.n), 'said': w.best.said || s.said}) AS best
  FROM walk w JOIN inserts s ON s.q = w.q LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.i = coalesce(z.n, 0) AND s.p IN (0, 3) GROUP BY w.conv_id),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
