"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant
messages in turn, the assistant last. For every conversation dynamic
programming over that automaton finds the cheapest way to make it legal:

* a turn becomes a message of its own, under its role or another one;
* it is merged into the message before it, under that message's role;
* empty user or assistant messages are inserted before it, or at the end.

The states are what the last message was; a turn's cost depends on the state
before and after it, its role and whether it is blank. Of equally cheap
repairs the one counts that takes, turn by turn, the first option in the
order of ``_options``.

The result has one row for each turn, with the rendered piece it adds; the
pieces of a conversation, joined in order, are the rendered conversation
(``transcripts``). Conversations of any length are repaired: beyond
``SEGMENT`` turns a conversation is cut into segments, each segment is
reduced to a matrix of least costs from state to state, and only those
matrices meet in one task.

Defined results: turns are ordered by turn (null first), role, text; a null
or unknown role may become user or assistant at the least cost; a null text
is the empty one; repeated turns are merged as any others; a null conversation
id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .ordering import global_rank

SEGMENT = 4096
ROLES = ("system", "user", "assistant")
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"
JOINT = "\n\n"

START, SYSTEM, USER, ASSISTANT = range(4)
_LAST = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
_NEXT = {(START, "system"): SYSTEM, (START, "user"): USER, (SYSTEM, "user"): USER, (USER, "assistant"): ASSISTANT,
         (ASSISTANT, "user"): USER}
INSERT, MERGE = 4, 1
FAR = 1 << 40

# Costs of giving a turn another role.
_RELABEL = {("system", "user"): 2, ("system", "assistant"): 4, ("user", "system"): 5, ("user", "assistant"): 3,
            ("assistant", "system"): 5, ("assistant", "user"): 3, ("other", "system"): 3, ("other", "user"): 1,
            ("other", "assistant"): 1}


def _relabel(role: str, to: str) -> int:
    return 0 if role == to else _RELABEL[role, to]


def _insertions(state: int):
    """Legal runs of inserted messages from ``state``: (roles, state after)."""
    yield (), state
    for role in ("user", "assistant"):
        after = _NEXT.get((state, role))
        if after:
            yield (role,), after
            for second in ("user", "assistant"):
                if (after, second) in _NEXT:
                    yield (role, second), _NEXT[after, second]


def _options(state: int, role: str, blank: bool):
    """(cost, state after, inserted roles, role given, whether merged) of a turn, in order of preference."""
    for to in ROLES:
        for inserted, before in _insertions(state):
            if (before, to) in _NEXT:
                yield INSERT * len(inserted) + _relabel(role, to), _NEXT[before, to], inserted, to, False
    if state in _LAST:
        to = _LAST[state]
        yield (0 if blank else MERGE + _relabel(role, to)), state, (), to, True


_KINDS = [(r, b) for r in (*ROLES, "other") for b in (False, True)]
_TABLE = {(s, k): list(_options(s, *k)) for s, k in itertools.product(range(4), _KINDS)}
_STEP = {k: [[min((o[0] for o in _TABLE[s, k] if o[1] == e), default=FAR) for e in range(4)] for s in range(4)]
         for k in _KINDS}
_END = {s: min((len(i) * INSERT, i) for i, e in _insertions(s) if e == ASSISTANT) for s in range(4)}
END_COSTS = [_END[s][0] for s in range(4)]


def kind_of(role, text) -> tuple[str, bool]:
    role = (role or "").strip().lower()
    return role if role in ROLES else "other", not (text or "").strip()


def _back(kind, ahead: list[int]) -> list[int]:
    """Least cost from each state before a turn, given those after it."""
    return [min(c + a for c, a in zip(row, ahead)) for row in _STEP[kind]]


def cost_matrix(kinds) -> list[int]:
    """Least costs over some turns from each state to each state, row by row."""
    columns = []
    for end in range(4):
        ahead = [0 if s == end else FAR for s in range(4)]
        for k in reversed(kinds):
            ahead = [min(x, FAR) for x in _back(k, ahead)]
        columns.append(ahead)
    return [columns[e][s] for s in range(4) for e in range(4)]


def repair(kinds, state: int = START, ahead: list[int] | None = None):
    """The chosen option of each turn. ``ahead``: least costs from each state after the last turn."""
    costs = [END_COSTS if ahead is None else ahead]
    for k in reversed(kinds):
        costs.append(_back(k, costs[-1]))
    costs.reverse()
    chosen = []
    for i, k in enumerate(kinds):
        least = costs[i][state]
        option = next(o for o in _TABLE[state, k] if o[0] + costs[i + 1][o[1]] == least)
        chosen.append(option)
        state = option[1]
    return chosen


def _rows(turns, state: int, ahead, last: bool):
    """Result fields of some turns of a conversation: (new role, merged, before, after, cost, piece)."""
    kinds = [kind_of(r, t) for r, t in turns]
    out = []
    for (_, text), (cost, after, inserted, to, merged) in zip(turns, repair(kinds, state, ahead)):
        if merged:
            piece = (JOINT if text else "") + (text or "")
        else:
            piece = CLOSE if state != START else ""
            piece += "".join(OPEN.format(r) + CLOSE for r in inserted) + OPEN.format(to) + (text or "")
        out.append([to, merged, list(inserted), [], cost, piece])
        state = after
    if last and out:
        added = _END[state][1]
        out[-1][3] = list(added)
        out[-1][4] += INSERT * len(added)
        out[-1][5] += CLOSE + "".join(OPEN.format(r) + CLOSE for r in added)
    return out


REPAIRED = "new_role string, merged boolean, inserted array<string>, appended array<string>, cost int, piece string"
_FIELDS = [pa.field("new_role", pa.string()), pa.field("merged", pa.bool_()), pa.field("inserted", pa.list_(pa.string())),
           pa.field("appended", pa.list_(pa.string())), pa.field("cost", pa.int32()), pa.field("piece", pa.string())]


def _stream(batches, key_columns: int):
    """(key, rows) of each run of rows with equal leading columns; a run may span batches."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[:key_columns] != key:
                yield key, held
                held = []
            key = row[:key_columns]
            held.append(row)
    if held:
        yield key, held


def _repair_batches(names, types, segment, with_facts, batches):
    """Rows are (conv, segment, turn, role, text[, state, ahead, last])."""
    done: list[tuple] = []

    def flush():
        cols = list(zip(*done))
        arrays = [pa.array(c, t) for c, t in zip(cols, types)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for _, rows in _stream(batches, 2):
        turns = [(r[3], r[4]) for r in rows]
        state, ahead, last = rows[0][5:8] if with_facts else (START, None, True)
        first = rows[0][1] * segment
        for i, (row, new) in enumerate(zip(rows, _rows(turns, state, ahead, last))):
            done.append((row[0], row[2], first + i, row[3], *new))
        if len(done) >= 2000:
            yield flush()
            done = []
    if done:
        yield flush()


def _matrix_batches(batches):
    for (conv, seg), rows in _stream(batches, 2):
        yield pa.RecordBatch.from_pylist([{"conv": conv, "seg": seg, "costs": cost_matrix([kind_of(r[3], r[4]) for r in rows])}],
                                         pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("costs", pa.list_(pa.int64()))]))


def _exit_batches(batches):
    for (conv, seg), rows in _stream(batches, 2):
        kinds, ahead = [kind_of(r[3], r[4]) for r in rows], rows[0][5]
        ends = [repair(kinds, s, ahead)[-1][1] for s in range(4)]
        yield pa.RecordBatch.from_pylist([{"conv": conv, "seg": seg, "exits": ends}],
                                         pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("exits", pa.list_(pa.int64()))]))


def _ahead(table: pa.Table) -> pa.Table:
    """Least costs after each segment of a conversation, from its last segment back."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seg"], reverse=True)
    ahead, out = END_COSTS, []
    for i, r in enumerate(rows):
        out.append({"conv": r["conv"], "seg": r["seg"], "ahead": ahead, "last": i == 0})
        m = r["costs"]
        ahead = [min(m[4 * s + e] + ahead[e] for e in range(4)) for s in range(4)]
    return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("seg", pa.int64()),
                                                ("ahead", pa.list_(pa.int64())), ("last", pa.bool_())]))


def _entries(table: pa.Table) -> pa.Table:
    """The state before each segment of a conversation."""
    state, out = START, []
    for r in sorted(table.to_pylist(), key=lambda r: r["seg"]):
        out.append({"conv": r["conv"], "seg": r["seg"], "state": state})
        state = r["exits"][state]
    return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("state", pa.int64())]))


def repair_roles(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per turn: conversation, turn, pos, role, new_role, merged, inserted, appended, cost, piece.

    ``inserted`` and ``appended`` are the roles of empty messages put before
    the turn and, on a conversation's last turn, after it.
    """
    T.bound_batches(df.sparkSession)
    kinds = {c: df.schema[c].dataType for c in (conv_col, turn_col)}
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                     F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    out = f"conv {kinds[conv_col].simpleString()}, turn {kinds[turn_col].simpleString()}, pos long, role string, {REPAIRED}"
    probe = df.sparkSession.createDataFrame([], out.split(", pos")[0])
    types = [*(f.type for f in probe.toArrow().schema), pa.int64(), pa.string(), *(f.type for f in _FIELDS)]
    names = ["conv", "turn", "pos", "role", *(f.name for f in _FIELDS)]

    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    long = sizes.where(F.col("n") > segment).select(F.col("conv").alias("long"))
    is_long = F.col("conv").eqNullSafe(F.col("long"))
    order = ["turn", "role", "text"]

    # a conversation of at most ``segment`` turns is repaired as it streams by
    short = rows.join(long, is_long, "left_anti").withColumn("seg", F.lit(0).cast("long"))
    short = (short.select("conv", "seg", "turn", "role", "text").repartition("conv").sortWithinPartitions("conv", *order)
             .mapInArrow(lambda it: _repair_batches(names, types, segment, False, it), out))
    made = short
    if not long.isEmpty():
        made = made.union(_repair_long(rows.join(long, is_long, "left_semi"), segment, order, names, types, out))
    return made.withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def _repair_long(rows: DataFrame, segment: int, order, names, types, out) -> DataFrame:
    """Conversations cut into segments of ``segment`` turns."""
    kind = rows.schema["conv"].dataType
    # a null id becomes a string of its own, so that segments of one conversation find each other
    key = F.when(F.col("conv").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("conv").cast("string")))
    numbered = global_rank(rows.withColumn("key", key), ["key", *order], "rank")
    first = numbered.groupBy("key").agg(F.min("rank").alias("first")).withColumnRenamed("key", "k")
    cut = (numbered.join(first, F.col("key") == F.col("k"))
           .withColumn("seg", F.floor((F.col("rank") - F.col("first")) / segment)).drop("first", "k", "rank"))
    dealt = lambda t: t.repartition("key", "seg").sortWithinPartitions("key", "seg", *order)
    base = cut.select("key", "seg", "turn", "role", "text")
    matrices = dealt(base).mapInArrow(_matrix_batches, "conv string, seg long, costs array<long>")
    ahead = matrices.groupBy("conv").applyInArrow(_ahead, "conv string, seg long, ahead array<long>, last boolean")
    on = lambda t: base.join(t.withColumnRenamed("conv", "key"), ["key", "seg"])
    exits = dealt(on(ahead)).select("key", "seg", "turn", "role", "text", "ahead").mapInArrow(
        _exit_batches, "conv string, seg long, exits array<long>")
    entries = exits.groupBy("conv").applyInArrow(_entries, "conv string, seg long, state long")
    facts = ahead.join(entries, ["conv", "seg"])
    named = out.replace(f"conv {kind.simpleString()}", "conv string", 1)
    made = dealt(on(facts)).select("key", "seg", "turn", "role", "text", "state", "ahead", "last").mapInArrow(
        lambda it: _repair_batches(names, [pa.string(), *types[1:]], segment, True, it), named)
    return made.withColumn("conv", F.when(F.col("conv") != "null", F.expr("substring(conv, 2)")).cast(kind))


def transcripts(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, rendered): each conversation's pieces in order, as one string."""
    pieces = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return repaired.groupBy(conv_col).agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("rendered"))
