"""Repair of conversations: a forward Viterbi pass over four grammar states.

A conversation should read as `(s?(ua)+)?`: perhaps a system message, then user
and assistant in turn. The states are: nothing yet, after the system message,
after a user, after an assistant. A message is kept, given the other role or
deleted, and empty messages may be inserted; every state carries the least
(cost, audit), where the audit is the string of the edits' initials.

Audits are compared by rank. Before inserts all of them end in the letter of the
same message, so none begins another one, and their order stays what it is
whatever follows. So what a state carries is a small number, a step is a function
of four small pairs and the kind of a message, and these functions can be joined
in any grouping: a conversation may be cut anywhere, its parts run with all four
states to begin from, and put together from 16 (cost, rank) pairs a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, spool

#: What edits cost. A message that breaks off and is not deleted costs TRUNCATED more.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of messages: the initial (s, u, a, other) times three, and 0, 1 if it breaks off; and one for those to be deleted.
INITIALS = "sua"
GONE = 12
FAULTS = (None, "truncated", "blank", "duplicate")

#: (state, inserts) that a state reaches by inserts: two lead anywhere, and more would go in a circle.
CLOSED = {
    NOTHING: ((NOTHING, 0), (USER, 1), (ASSISTANT, 2)),
    SYSTEM: ((SYSTEM, 0), (USER, 1), (ASSISTANT, 2)),
    USER: ((USER, 0), (ASSISTANT, 1)),
    ASSISTANT: ((ASSISTANT, 0), (USER, 1)),
}
#: A state that costs this much more than another can't win: two inserts and a deletion lead from anywhere to anywhere.
HOPELESS = 2 * INSERT + DELETE


def moves(kind: int, state: int) -> list[tuple[int, str, int]]:
    """(state after, letter, cost) of what may become of a message."""
    found = [(state, "D", DELETE)]
    if kind != GONE:
        initial, more = kind // 3, TRUNCATED * (kind % 3)
        after = ASSISTANT if state == USER else USER
        found.append((after, "R", RELABEL + more))
        if initial == 0 and state == NOTHING:
            found.append((SYSTEM, "K", more))
        elif (initial, after) in ((1, USER), (2, ASSISTANT)):
            found.append((after, "K", more))
    return found


class Step:
    """What a message does to the cells before it: cells after it, what they all cost more, and where each came from."""

    __slots__ = ("after", "back", "cost")

    def __init__(self, after: int, cost: int, back: dict[int, tuple[int, int, str, int]]):
        self.after, self.cost, self.back = after, cost, back


class Grammar:
    """Cells are (first state, state) pairs with (cost, rank); each set of cells has a number, and steps between them are remembered.

    Costs are less the least one, and cells that can't win are left out, so there are few sets.
    """

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.cells: list[dict[int, tuple[int, int]]] = []
        self.steps: list[dict[int, Step]] = []

    def number(self, cells: dict[int, tuple[int, int]]) -> int:
        name = tuple(sorted(cells.items()))
        if name not in self.numbers:
            self.numbers[name] = len(self.cells)
            self.cells.append(cells)
            self.steps.append({})
        return self.numbers[name]

    def begin(self, firsts: tuple[int, ...]) -> int:
        return self.number({f * STATES + f: (0, 0) for f in firsts})

    def step(self, at: int, kind: int) -> Step:
        found = self.steps[at].get(kind)
        if found is None:
            found = self.steps[at][kind] = self.made(self.cells[at], kind)
        return found

    def made(self, cells: dict[int, tuple[int, int]], kind: int) -> Step:
        best: dict[int, tuple] = {}
        for i, (cost, rank) in cells.items():
            first, state = divmod(i, STATES)
            for reached, inserts in CLOSED[state]:
                for after, letter, more in moves(kind, reached):
                    to = first * STATES + after
                    one = (cost + INSERT * inserts + more, rank, "I" * inserts + letter, i, reached)
                    if to not in best or one < best[to]:
                        best[to] = one
        least = {f: min(one[0] for to, one in best.items() if to // STATES == f) for f in {to // STATES for to in best}}
        best = {to: one for to, one in best.items() if one[0] <= least[to // STATES] + HOPELESS}
        ranks = {r: i for i, r in enumerate(sorted({one[1:3] for one in best.values()}))}
        low = min(one[0] for one in best.values())
        after = self.number({to: (one[0] - low, ranks[one[1:3]]) for to, one in best.items()})
        return Step(after, low, {to: (one[3], len(one[2]) - 1, one[2][-1], one[4]) for to, one in best.items()})

    def run(self, kinds: list[int], firsts: tuple[int, ...]) -> tuple[int, int, list[Step]]:
        """The cells after all messages, the cost to add to theirs, and the steps."""
        at, cost, steps = self.begin(firsts), 0, []
        for kind in kinds:
            step = self.step(at, kind)
            cost += step.cost
            at = step.after
            steps.append(step)
        return at, cost, steps


def ended(cells: dict[int, tuple[int, int]]) -> tuple[int, int, int]:
    """(cost, state, inserts) of the best end: nothing at all, or after an assistant."""
    found = []
    for state, (cost, rank) in cells.items():
        for reached, inserts in CLOSED[state]:
            if reached in (NOTHING, ASSISTANT):
                found.append((cost + INSERT * inserts, rank, inserts, state))
    cost, _, inserts, state = min(found)
    return cost, state, inserts


def inserted(inserts: int, reached: int) -> list[str]:
    """The roles of inserted messages that lead to a state."""
    return ["user", "assistant"] if inserts == 2 else [ROLE[reached]] if inserts else []


def traced(steps: list[Step], cell: int) -> list[tuple[int, int, str, int]]:
    """(state before, inserts, letter, state after inserts) for every message."""
    found = []
    for step in reversed(steps):
        found.append(step.back[cell])
        cell = step.back[cell][0]
    return found[::-1]


MESSAGE = "turn long, role string, text string, fault string, edit string, new_role string, same binary, kind int"


class Edited:
    """Messages of several conversations after their edits, in columns."""

    def __init__(self) -> None:
        self.source: list[int | None] = []
        self.edit: list[str] = []
        self.role: list[str | None] = []
        self.offsets = [0]

    def add(self, at: int, path: list[tuple[int, int, str, int]], tail: list[str]) -> None:
        """A conversation, or a part of one, whose messages are rows from `at`."""
        for i, (_, inserts, letter, reached) in enumerate(path):
            if inserts:
                self.insert(inserted(inserts, reached))
            self.source.append(at + i)
            self.edit.append(letter)
            self.role.append(None if letter in "KD" else ROLE[ASSISTANT if reached == USER else USER])
        self.insert(tail)
        self.offsets.append(len(self.source))

    def insert(self, roles: list[str]) -> None:
        self.source += [None] * len(roles)
        self.edit += ["I"] * len(roles)
        self.role += roles

    def messages(self, rows: pa.Table, faults: list[str | None]) -> pa.ListArray:
        source = pa.array(self.source, pa.int64())
        column = lambda name: rows.column(name).combine_chunks().take(source)
        role, edit = column("role"), pa.array(self.edit, pa.string())
        new = pc.if_else(pc.equal(edit, "K"), role, pa.array(self.role, pa.string()))
        empty = lambda kind: pa.nulls(len(source), kind)
        fields = [column("turn"), role, pc.fill_null(column("text"), ""), pa.array(faults, pa.string()).take(source), edit, new, empty(pa.binary()), empty(pa.int32())]
        return _list(self.offsets, fields)


def _list(offsets: list[int], fields: list[pa.Array]) -> pa.ListArray:
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=names))


def _batch(conv: pa.Array, part: int, pieces: list[int], whole: bool, messages: pa.ListArray) -> pa.RecordBatch:
    n = len(messages)
    return pa.RecordBatch.from_arrays([conv, pa.array([part] * n, pa.int64()), pa.array(pieces, pa.int64()), pa.array([whole] * n), messages], names=["conv_id", "part", "piece", "whole", "messages"])


def _raw(rows: pa.Table, part: int, piece: int) -> pa.RecordBatch:
    """Messages of one conversation as they are, for later."""
    n = rows.num_rows
    column = lambda name: rows.column(name).combine_chunks()
    none = pa.nulls(n, pa.string())
    return _batch(column("conv").slice(0, 1), part, [piece], False, _list([0, n], [column("turn"), column("role"), column("text"), none, none, none, column("same"), column("kind")]))


def _starts(conv: pa.Array) -> list[int]:
    """Where conversations begin in a sorted column, null being one of them."""
    if len(conv) < 2:
        return [0] if len(conv) else []
    a, b = conv.slice(0, len(conv) - 1), conv.slice(1)
    differs = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.not_equal(a, b), pc.not_equal(pc.is_valid(a), pc.is_valid(b)))
    return [0, *(np.nonzero(differs.to_numpy(zero_copy_only=False))[0] + 1).tolist()]


def _fault_kinds(same: list[bytes], kinds: list[int]) -> tuple[list[str | None], list[int]]:
    """The first fault of each message of one whole conversation, and its kind for the grammar."""
    seen: set[bytes] = set()
    faults, found = [], []
    for s, kind in zip(same, kinds, strict=True):
        fault = kind % 3
        if fault != 2 and s in seen:
            fault = 3
        seen.add(s)
        faults.append(FAULTS[fault])
        found.append(GONE if fault > 1 else kind)
    return faults, found


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations between the first and the last one of a sorted partition are repaired; these two may go on in others, and wait."""
    grammar, part, piece = Grammar(), TaskContext.get().partitionId(), 0
    last, first, held = None, True, []  # the name of the conversation that rows end in, whether it is the first, and its rows
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        conv = rows.column("conv").combine_chunks()
        starts = _starts(conv)
        goes_on = last is None or len(_starts(pa.concat_arrays([last, conv.slice(0, 1)]))) == 1
        last = conv.slice(len(conv) - 1)
        end = (starts[1] if len(starts) > 1 else rows.num_rows) if goes_on else 0  # of what belongs to the conversation before
        begins = [s for s in starts if s >= end]
        if end and first:
            yield _raw(rows.slice(0, end), part, piece)
            piece += 1
        elif end:
            held.append(rows.slice(0, end))
        if not begins:
            continue
        first = False
        done = pa.concat_tables([*held, rows.slice(begins[0], begins[-1] - begins[0])])
        before = sum(t.num_rows for t in held)
        whole = [0] * bool(held) + [before + s - begins[0] for s in begins[:-1]]
        if whole:
            yield _repaired(done, whole, grammar, part)
        held = [rows.slice(begins[-1])]
    if held:
        yield _raw(pa.concat_tables(held), part, piece)


def _repaired(rows: pa.Table, begins: list[int], grammar: Grammar, part: int) -> pa.RecordBatch:
    """Whole conversations, a row each."""
    same, kinds = rows.column("same").to_pylist(), rows.column("kind").to_pylist()
    edited, faults = Edited(), []
    for a, b in zip(begins, [*begins[1:], rows.num_rows], strict=True):
        fault, found = _fault_kinds(same[a:b], kinds[a:b])
        faults += fault
        at, _, steps = grammar.run(found, (NOTHING,))
        _, state, inserts = ended(grammar.cells[at])
        edited.add(a, traced(steps, state), inserted(inserts, ASSISTANT))
    conv = rows.column("conv").combine_chunks().take(pa.array(begins, pa.int64()))
    return _batch(conv, part, [0] * len(begins), True, edited.messages(rows, faults))


def _sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A part of a conversation as 16 (cost, rank) pairs, from any state to any."""
    kinds = pdf.sort_values(["piece", "pos"])["kind"].tolist()
    grammar = Grammar()
    at, more, _ = grammar.run(kinds, tuple(range(STATES)))
    cells = [grammar.cells[at].get(i) for i in range(STATES * STATES)]
    return pd.DataFrame({"conv_id": [key[0]], "part": [key[1]], "costs": [[None if c is None else c[0] + more for c in cells]], "ranks": [[None if c is None else c[1] for c in cells]]})


def _route(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The states that each part of a conversation begins and ends with, from the pairs of all of them."""
    pdf = pdf.sort_values("part")
    cells, backs = {NOTHING: (0, 0)}, []
    for costs, ranks in zip(pdf["costs"], pdf["ranks"], strict=True):
        best: dict[int, tuple] = {}
        for state, (cost, rank) in cells.items():
            for after in range(STATES):
                i = state * STATES + after
                if costs[i] is not None and costs[i] == costs[i]:
                    one = (cost + int(costs[i]), rank, int(ranks[i]), state)
                    if after not in best or one < best[after]:
                        best[after] = one
        order = {r: i for i, r in enumerate(sorted({one[1:3] for one in best.values()}))}
        cells = {after: (one[0], order[one[1:3]]) for after, one in best.items()}
        backs.append({after: one[3] for after, one in best.items()})
    _, state, inserts = ended(cells)
    ends = [state]
    for back in reversed(backs):
        ends.append(back[ends[-1]])
    ends.reverse()
    n = len(pdf)
    return pd.DataFrame({"conv_id": [key[0]] * n, "part": pdf["part"].tolist(), "begin": ends[:-1], "end": ends[1:], "tail": [0] * (n - 1) + [inserts]})


def _part(rows: pa.Table) -> pa.Table:
    """A part of a conversation whose first and last state are known, in one row."""
    rows = rows.sort_by([("piece", "ascending"), ("pos", "ascending")])
    begin, end, tail, part = (rows.column(c)[0].as_py() for c in ("begin", "end", "tail", "part"))
    grammar, edited = Grammar(), Edited()
    _, _, steps = grammar.run(rows.column("kind").to_pylist(), (begin,))
    edited.add(0, traced(steps, begin * STATES + end), inserted(tail, ASSISTANT))
    batch = _batch(rows.column("conv_id").combine_chunks().slice(0, 1), part, [0], True, edited.messages(rows, rows.column("fault").to_pylist()))
    return pa.Table.from_batches([batch]).drop_columns(["piece", "whole"])


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, messages): the messages of every conversation in order with their faults and edits.

    messages are structs (turn, role, text, fault, edit, new_role): edit is K, R,
    D or I; new_role is null for what is deleted, and role and turn are for what
    is inserted. A message's first fault is `blank` (no word), `duplicate` (role
    and text came before), or `truncated` (its last word does not end in `.`,
    `!` or `?`); blank ones and duplicates are deleted. The edits are the
    cheapest ones, of equal cost those whose audit is least by ASCII.

    Messages go by turn, nulls first, and where turns are equal by role, the
    first 32 characters and the hash of the text; repeated rows are rows each,
    duplicates but for the first. A null role or text is one space, so it fits no
    place or is blank; an empty role fits no place. Rows without a conversation
    are one. An empty table gives no rows; other columns are not read, and may
    have any name.

    Rows are sorted by ranges, so no task holds a conversation that is larger
    than a partition. Conversations inside a partition are repaired there. Those
    at its borders (two a partition) wait: parts that may be of one conversation
    are run from all four states, put together by their 16 pairs each, and run
    again from the state that they then begin with. So most conversations are one
    row, and very long ones some, in order of `part`.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    found = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(trimmed == "", 2).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "", 3).otherwise(F.coalesce(F.nullif(F.instr(F.lit(INITIALS), initial), F.lit(0)) - 1, F.lit(3)))
    sha = F.sha2("text", 256)
    found = found.select("*", F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)).alias("same"), (place * 3 + fault).cast("int").alias("kind"), F.left("text", F.lit(32)).alias("_begins"), sha.alias("_sha"))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("_begins"), F.asc("_sha")]
    # equal rows are apart by their number only, so that they need not be in one partition
    ranged = found.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(*order, F.asc("_n")).sortWithinPartitions(*order)
    conv_type = rows.schema[conv].dataType.simpleString()
    done = spool(ranged.select("conv", "turn", "role", "text", "same", "kind").mapInArrow(_inner, f"conv_id {conv_type}, part long, piece long, whole boolean, messages array<struct<{_typed()}>>"))

    waiting = done.where(~F.col("whole")).select("conv_id", "part", "piece", F.posexplode("messages").alias("pos", "m")).select("conv_id", "part", "piece", "pos", *[F.col(f"m.{c}").alias(c) for c in ("turn", "role", "text", "same", "kind")])
    where = F.struct("part", "piece", "pos")
    seen = waiting.groupBy(F.col("conv_id").alias("_conv"), F.col("same").alias("_same")).agg(F.min(where).alias("_first"))
    waiting = waiting.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same"))).withColumn("_again", where > F.col("_first"))
    blank = F.col("kind") % 3 == 2
    waiting = waiting.withColumn("fault", F.when(blank, FAULTS[2]).when(F.col("_again"), FAULTS[3]).when(F.col("kind") % 3 == 1, FAULTS[1]))
    waiting = waiting.withColumn("kind", F.when(blank | F.col("_again"), GONE).otherwise(F.col("kind"))).drop("_conv", "_same", "_first", "_again", "same")
    waiting = spool(waiting)
    sums = waiting.select("conv_id", "part", "piece", "pos", "kind").groupBy("conv_id", "part").applyInPandas(_sums, f"conv_id {conv_type}, part long, costs array<long>, ranks array<long>")
    routes = spool(sums.groupBy("conv_id").applyInPandas(_route, f"conv_id {conv_type}, part long, begin int, end int, tail int"))
    routes = routes.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "begin", "end", "tail")
    parts = waiting.join(routes, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).drop("_conv", "_part")
    parts = parts.groupBy("conv_id", "part").applyInArrow(_part, f"conv_id {conv_type}, part long, messages array<struct<{_typed()}>>")
    shown = F.transform("messages", lambda m: F.struct(*[m[c].alias(c) for c in ("turn", "role", "text", "fault", "edit", "new_role")]))
    return done.where("whole").select("conv_id", "part", "messages").unionByName(parts).select("conv_id", "part", shown.alias("messages"))


def _typed() -> str:
    return ", ".join(": ".join(f.split()) for f in MESSAGE.split(", "))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of conversations that come in several parts, in order; only the hash's state is held."""
    import hashlib

    name, state, any_lines = None, None, False
    conv_type = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], conv_type), pa.array([state.hexdigest()])], names=["conv_id", "sha"])

    for batch in batches:
        conv_type = batch.column("conv_id").type
        for i in range(batch.num_rows):
            conv = batch.column("conv_id")[i].as_py()
            if state is None or conv != name:
                if state is not None:
                    yield row()
                name, state, any_lines = conv, hashlib.sha256(), False
            if batch.column("n_lines")[i].as_py():
                state.update((("\n" if any_lines else "") + batch.column("lines")[i].as_py()).encode())
                any_lines = True
    if state is not None:
        yield row()


def report(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of repair()'s rows.

    Counts are made a part at a time. Parts of a conversation are put together
    in order: at most one a partition. The text of a conversation in several
    parts goes through one task, as a hash has no other way, but isn't held there.
    """
    messages = F.filter("messages", lambda m: m["edit"] != "I")
    turns = F.array_distinct(F.filter(F.transform(messages, lambda m: m["turn"]), lambda t: t.isNotNull()))
    initials = F.transform(messages, lambda m: F.substring(m["role"], 1, 1))
    n = F.size(initials)
    pairs = F.zip_with(F.slice(initials, 1, F.greatest(n - 1, F.lit(0))), F.slice(initials, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    illegal = lambda p: ~p.isin("su", "ua", "au")
    having = lambda fault: F.size(F.filter("messages", lambda m: F.coalesce(m["fault"] == fault, F.lit(False)))).cast("long").alias(fault)
    price = lambda m: F.when(m["edit"] == "R", RELABEL).when(m["edit"] == "D", DELETE).when(m["edit"] == "I", INSERT).otherwise(0) + F.when(m["edit"].isin("K", "R") & (F.coalesce(m["fault"], F.lit("")) == "truncated"), TRUNCATED).otherwise(0)
    lines = F.transform(F.filter("messages", lambda m: m["edit"] != "D"), lambda m: F.concat(m["new_role"], F.lit(":"), m["text"]))
    per = repaired.select(
        "conv_id",
        "part",
        turns.alias("_turns"),
        *[having(f) for f in ("blank", "duplicate", "truncated")],
        F.size(F.filter(pairs, illegal)).cast("long").alias("illegal"),
        F.get(initials, F.lit(0)).alias("from"),
        F.get(initials, n - 1).alias("to"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + price(m)).alias("cost"),
        F.array_join(F.transform("messages", lambda m: m["edit"]), "").alias("audit"),
        F.sha2(F.array_join(lines, "\n"), 256).alias("sha"),
    )
    per = per.withColumns({"low": F.array_min("_turns"), "high": F.array_max("_turns"), "n": F.size("_turns").cast("long")}).drop("_turns")
    names = ["part", "low", "high", "n", "blank", "duplicate", "truncated", "illegal", "from", "to", "cost", "audit", "sha"]
    whole = per.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("p"))
    total = lambda c: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x[c])
    size = F.size("p")
    both = F.zip_with(F.slice("p", 1, size - 1), F.slice("p", 2, size - 1), lambda a, b: F.struct(a["to"].alias("to"), b["from"].alias("from"), a["high"].alias("high"), b["low"].alias("low")))
    between = lambda test: F.size(F.filter(both, test)).cast("long")
    span = F.array_max(F.transform("p", lambda x: x["high"])) - F.array_min(F.transform("p", lambda x: x["low"])) + 1
    distinct = total("n") - between(lambda x: F.coalesce(x["high"] == x["low"], F.lit(False)))
    whole = whole.select(
        "conv_id",
        F.coalesce(span - distinct, F.lit(0)).alias("gaps"),
        *[total(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (total("illegal") + between(lambda x: illegal(F.concat(x["to"], x["from"])))).alias("illegal"),
        total("cost").alias("cost"),
        F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"),
        F.when(size == 1, F.get("p", F.lit(0))["sha"]).alias("sha"),
    )
    whole = spool(whole)
    several = whole.where(F.col("sha").isNull()).select(F.col("conv_id").alias("_conv"))
    text = repaired.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").select("conv_id", "part", F.size(lines).alias("n_lines"), F.array_join(lines, "\n").alias("lines"))
    hashed = text.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_hashed, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, sha string")
    hashed = hashed.select(F.col("conv_id").alias("_conv"), F.col("sha").alias("_sha"))
    joined = whole.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", "_sha").alias("repaired_sha256"))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults made by the CRC-32 of `conv:turn` modulo 20, to test a repair with.

    0 drops a row, 1 empties its text, 2 strips its `.`, `!` and `?`, 3 doubles
    it, 4 makes it a user's. Nulls are one space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    broken = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), fault.alias("_f")).where(F.col("_f") != 0)
    rows = rows.select("conv_id", "turn", F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"), broken.alias("text"), F.explode(F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")
