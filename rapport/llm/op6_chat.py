"""Chat formatting: minimum-cost repair of roles, then rendering.

Legal conversations are those of an automaton: an optional system message, then user and assistant in turn, the assistant
last. For each turn a repair keeps it, merges it into the message before it, gives it another role, or does several of
these, and it may put empty messages in between. Costs add up, and dynamic programming finds the cheapest legal reading.

A conversation of any length is cut in blocks of ``BLOCK`` rows, whatever their turn numbers (see ``numbered``). A block's effect is a small matrix: the least cost
from each state before it to each state after it. Matrices are combined in the min-plus algebra, level by level, so that no
task holds a conversation; the states at the blocks' edges then come down again, and every block is decoded by itself.
Rows stay rows: the rendered conversation is its pieces in order of (turn, seq), and no text is gathered.

Defined results: turns are ordered by turn (nulls last), role and text; roles are read without case or outer space, a
missing or foreign role counts as one to be replaced; null texts are empty; repeated rows are turns of their own; a null
conversation id is one conversation; equal costs go to the operation that is first in ``MOVES``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rapport.llm.shared import staged, table

BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
#: Which role may come after which state.
AFTER = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 2, 3, 4
FAR = 1 << 40
#: Shortest runs of empty messages that lead from a state to one after which a role may come.
_BRIDGE = {
    (state, role): next(path for path in ((), (USER,), (ASSISTANT,), (USER, ASSISTANT), (ASSISTANT, USER))
                        if all(b in AFTER[a] for a, b in zip((state, *path), (*path, role))))
    for state in AFTER for role in (SYSTEM, USER, ASSISTANT) if role != SYSTEM or state == START
}


def _moves(role: int) -> list[tuple[int, int, int, bool, tuple]]:
    """(cost, state before, state after, merged, empty messages put before) for a turn of this role (0: unknown)."""
    out = []
    for state in AFTER:
        for new in (USER, ASSISTANT, SYSTEM):
            change = RELABEL * (new != role)
            if state == new:
                out.append((MERGE + change, state, new, True, ()))
            if (state, new) in _BRIDGE:
                path = _BRIDGE[state, new]
                out.append((INSERT * len(path) + change, state, new, False, path))
    return sorted(out, key=lambda m: (m[0], m[3], len(m[4])))


MOVES = {role: _moves(role) for role in range(4)}
#: Cost of ending in each state: an assistant message is put where none is last.
END = [0, INSERT * 2, INSERT, 0]
_CODE = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}


def codes(roles) -> list[int]:
    return [_CODE.get((r or "").strip().lower(), 0) for r in roles]


def step(role: int) -> np.ndarray:
    """Least cost from state to state over one turn."""
    out = np.full((4, 4), FAR, np.int64)
    for cost, before, after, _, _ in MOVES[role]:
        out[before, after] = min(out[before, after], cost)
    return out


STEPS = {role: step(role) for role in range(4)}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the min-plus algebra."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


def product(matrices) -> np.ndarray:
    total = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for m in matrices:
        total = times(total, m)
    return total


def path(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """The state before each matrix (and after the last) on a cheapest way from ``entry`` to ``leave``."""
    costs = [np.where(np.arange(4) == entry, 0, FAR).astype(np.int64)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), FAR))
    states = [leave]
    for m, before in zip(reversed(matrices), reversed(costs[:-1])):
        states.append(int((before + m[:, states[-1]]).argmin()))
    return states[::-1]


def decoded(roles: list[int], entry: int, leave: int) -> list[tuple]:
    """The move of each turn on a cheapest way."""
    states = path([STEPS[r] for r in roles], entry, leave)
    return [next(m for m in MOVES[r] if (m[1], m[2]) == (a, b)) for r, a, b in zip(roles, states, states[1:])]


def best_end(matrix: np.ndarray) -> int:
    return int((matrix[START] + END).argmin())


def _rows(group: pa.Table) -> pa.Table:
    return group.sort_by("position")


def _matrices(group: pa.Table) -> pa.Table:
    roles = codes(_rows(group)["role"].to_pylist())
    return pa.table({"conv": group["conv"].slice(0, 1), "block": group["block"].slice(0, 1),
                     "m": pa.array([product([STEPS[r] for r in roles]).ravel().tolist()], pa.list_(pa.int64()))})


def _combine(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    group = group.sort_by("block")
    total = product([np.array(m).reshape(4, 4) for m in group["m"].to_pylist()])
    return pa.table({"conv": group["conv"].slice(0, 1), "block": pa.array([key[1].as_py()], pa.int64()),
                     "m": pa.array([total.ravel().tolist()], pa.list_(pa.int64()))})


def _spread(group: pa.Table) -> pa.Table:
    """States at the edges of a group's blocks, from those at the group's edges."""
    group = group.sort_by("block")
    states = path([np.array(m).reshape(4, 4) for m in group["m"].to_pylist()], group["entry"][0].as_py(), group["leave"][0].as_py())
    return pa.table({"conv": group["conv"], "block": group["block"], "entry": pa.array(states[:-1], pa.int64()),
                     "leave": pa.array(states[1:], pa.int64())})


def _render(group: pa.Table) -> pa.Table:
    last = group["last_block"][0].as_py()
    rows = _rows(group.drop_columns(["entry", "leave", "last_block"]))
    roles, texts, turns = codes(rows["role"].to_pylist()), rows["text"].to_pylist(), rows["turn"].to_pylist()
    moves = decoded(roles, group["entry"][0].as_py(), group["leave"][0].as_py())
    # A message that begins here ends the one before it, so each piece opens by closing its predecessor.
    out, seq = [], 0
    for role, text, turn, (_, before, after, merged, between) in zip(roles, texts, turns, moves):
        state = before
        for empty in between:
            out.append((turn, seq, ROLES[empty], "insert", ("<|end|>\n" if state else "") + f"<|{ROLES[empty]}|>\n"))
            state, seq = empty, seq + 1
        action = "+".join(name for name, on in (("merge", merged), ("relabel", after != role)) if on) or "keep"
        head = "\n" if merged else ("<|end|>\n" if state else "") + f"<|{ROLES[after]}|>\n"
        out.append((turn, seq, ROLES[after], action, head + (text or "")))
        seq += 1
    if rows["block"][0].as_py() == last:
        state, turn = moves[-1][2], turns[-1]
        for empty in {USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}.get(state, ()):
            out.append((turn, seq, ROLES[empty], "insert", f"<|end|>\n<|{ROLES[empty]}|>\n"))
            seq += 1
        out.append((turn, seq, None, "end", "<|end|>\n"))
    turn, seqs, names, actions, pieces = zip(*out)
    conv = pa.repeat(rows["conv"][0], len(out))
    return pa.table({"conv": conv, "block": pa.repeat(rows["block"][0], len(out)), "turn": pa.array(turn, pa.int64()),
                     "seq": pa.array(seqs, pa.int64()), "role": pa.array(names, pa.string()), "action": pa.array(actions),
                     "piece": pa.array(pieces, pa.string())})


#: Turn numbers that are counted together first; characters of a text by which rows of equal turn and role are parted.
TURNS_BITS, PREFIX = 12, 4


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their ``position`` in the conversation, from 0 on, by (turn_, role, text), nulls last.

    Rows are ranked within (turn, role, first characters of the text); what comes before each of these is added up from
    counts, level by level. No task holds a conversation or a turn; what a window ranks is sorted by Spark, which spills.
    """
    rows = rows.withColumns({
        "own": F.struct(F.col("conv").isNull().alias("none"), F.coalesce("conv", F.lit(0)).alias("id")),
        "tie": F.struct(F.col("role").isNull().alias("no_role"), F.coalesce("role", F.lit("")).alias("role"), F.col("text").isNull().alias("no_text"),
                        F.substring(F.coalesce("text", F.lit("")), 1, PREFIX).alias("head"))})

    def before(counts: DataFrame, within: list[str], at: str, name: str) -> DataFrame:
        window = Window.partitionBy(*within).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(name, F.coalesce(F.sum("n").over(window), F.lit(0))).drop("n")

    ties = staged(rows.groupBy("own", F.shiftright("turn_", TURNS_BITS).alias("turns"), "turn_", "tie").agg(F.count("*").alias("n")), "chat-counts")
    each = ties.groupBy("own", "turns", "turn_").agg(F.sum("n").alias("n"))
    many = each.groupBy("own", "turns").agg(F.sum("n").alias("n"))
    offsets = (before(ties, ["own", "turn_"], "tie", "x").join(before(each, ["own", "turns"], "turn_", "y"), ["own", "turns", "turn_"])
               .join(before(many, ["own"], "turns", "z"), ["own", "turns"])
               .select("own", "turn_", "tie", (F.col("x") + F.col("y") + F.col("z")).alias("ahead")))
    inside = F.row_number().over(Window.partitionBy("own", "turn_", "tie").orderBy("text"))
    placed = rows.withColumn("inside", inside).join(staged(offsets, "chat-offsets"), ["own", "turn_", "tie"])
    return placed.withColumn("position", F.col("ahead") + F.col("inside") - 1).drop("own", "tie", "inside", "ahead")


EDGES = "conv bigint, block bigint, entry bigint, leave bigint"


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, block, turn, seq, role, action, piece: a conversation is its pieces, by (block, seq)."""
    rows = turns.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                        F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    # Missing turn numbers come after all others.
    inside = F.greatest(F.least("turn", F.lit(1 << 61)), F.lit(-(1 << 61))) + F.lit(1 << 61)
    rows = rows.withColumn("turn_", F.coalesce(inside, F.lit((1 << 62) + 1)))
    rows = staged(numbered(rows).drop("turn_"), "chat-turns").withColumn("block", F.shiftright("position", BLOCK_BITS))
    level = staged(rows.drop("text").groupBy("conv", "block")
                   .applyInArrow(_matrices, "conv bigint, block bigint, m array<bigint>"), "chat-blocks")
    levels = [level]
    while not level.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        level = staged(level.groupBy("conv", F.shiftright("block", BLOCK_BITS).alias("above"))
                       .applyInArrow(_combine, "conv bigint, block bigint, m array<bigint>"), "chat-blocks")
        levels.append(level)
    finish = F.array(*[F.col("m")[i] + F.lit(END[i]) for i in range(4)])
    edges = level.select("conv", "block", F.lit(START).cast("bigint").alias("entry"),
                         (F.array_position(finish, F.array_min(finish)) - 1).cast("bigint").alias("leave"))
    for below in reversed(levels[:-1]):
        joined = below.withColumn("above", F.shiftright("block", BLOCK_BITS)).alias("b").join(
            edges.alias("e"), F.col("b.conv").eqNullSafe(F.col("e.conv")) & (F.col("b.above") == F.col("e.block"))).select(
            "b.conv", "b.block", "b.above", "b.m", "e.entry", "e.leave")
        edges = staged(joined.groupBy("conv", "above").applyInArrow(lambda g: _spread(g.drop_columns(["above"])), EDGES), "chat-edges")
    ends = edges.groupBy("conv").agg(F.max("block").alias("last_block"))
    ends = edges.alias("e").join(ends.alias("l"), F.col("e.conv").eqNullSafe(F.col("l.conv"))).select("e.*", "l.last_block")
    ready = rows.alias("r").join(ends.alias("e"), F.col("r.conv").eqNullSafe(F.col("e.conv")) & (F.col("r.block") == F.col("e.block")))
    done = ready.select("r.*", "e.entry", "e.leave", "e.last_block").groupBy("conv", "block").applyInArrow(
        _render, "conv bigint, block bigint, turn bigint, seq bigint, role string, action string, piece string")
    return done.withColumnRenamed("conv", "conv_id")


def op6_chat(spark, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
