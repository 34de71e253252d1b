"""Chat formatting: minimum-cost repair of role sequences, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending
with the assistant. Any sequence of input turns is brought into that form at least cost by a dynamic
programme over the automaton of legal turns (states: start, system, user, assistant). Each input turn
is kept, relabelled, or merged into the turn before it; empty turns are inserted where a role lacks.
Costs are fixed below; among equal costs the first transition in the table's order wins.

The programme is a product of min-plus matrices, so a conversation of more than 4096 turns is cut: every
4096 of its turns, counted from its first, are a segment. Shorter ones (nearly all) are solved whole. A cut one
gives one 4 x 4 matrix a segment; their product, over rows that are 4096 times fewer, fixes the states
at the cuts, and each segment is then traced on its own. So no task holds a conversation of unbounded
length. Turns are counted from range-partitioned, sorted rows and the numbers of rows of each partition, so
where a cut lies depends on the conversation alone. A repaired turn whose merged texts span segments comes
out in pieces, so that no text is unbounded either.

Nulls: a null or unknown role is relabelled at low cost, a null text is empty, a null turn sorts last,
rows with a null conv_id form one conversation. Ties in turn sort by role, then a hash of the text,
then the text; repeated rows are turns like others. Very long texts stay whole. An empty table gives no
rows. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.session import materialize

#: States, and costs of one merge, one relabel, one relabel of an unknown role, one inserted turn.
ROLES = ("start", "system", "user", "assistant")
MERGE, RELABEL, NAME, INSERT = 1, 4, 1, 3
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "sys": "system"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turns that may follow a state, with the empty turns inserted before them.
FOLLOW = {
    START: ((SYSTEM, ()), (USER, ()), (ASSISTANT, (USER,))),
    SYSTEM: ((USER, ()), (ASSISTANT, (USER,))),
    USER: ((ASSISTANT, ()), (USER, (ASSISTANT,))),
    ASSISTANT: ((USER, ()), (ASSISTANT, (USER,))),
}
#: Empty turns that end a conversation from a state.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
SEGMENT = 4096
#: monotonically_increasing_id holds the partition above, and the row in it below, so many bits.
PARTITION_BITS = 33
FAR = 10**12


def transitions() -> dict[int, list[tuple[int, int, int, bool, tuple[int, ...]]]]:
    """By input role (0: unknown): (state before, state after, cost, merged, inserted)."""
    out = {}
    for role in range(4):
        named = lambda q: 0 if q == role else (RELABEL if role else NAME)  # noqa: E731,B023
        steps = [(s, q, named(q) + INSERT * len(ins), False, ins) for s, nxt in FOLLOW.items() for q, ins in nxt]
        steps += [(s, s, named(s) + MERGE, True, ()) for s in (SYSTEM, USER, ASSISTANT)]
        out[role] = steps
    return out


STEPS = transitions()


def forward(roles: list[int], entry: list[int]) -> list[list[int]]:
    """Least cost of each state after 0, 1, ... turns."""
    rows = [entry]
    for r in roles:
        now, nxt = rows[-1], [FAR] * 4
        for s, q, c, _, _ in STEPS[r]:
            if now[s] + c < nxt[q]:
                nxt[q] = now[s] + c
        rows.append(nxt)
    return rows


def matrix(roles: list[int]) -> list[list[int]]:
    """Least cost from each state before the turns to each after."""
    return [forward(roles, [0 if s == t else FAR for t in range(4)])[-1] for s in range(4)]


def trace(roles: list[int], entry: int, leave: int | None) -> list[tuple[int, bool, tuple[int, ...]]]:
    """For each turn (state after, merged, inserted) on a cheapest way; leave None: any end, with its closing."""
    rows = forward(roles, [0 if s == entry else FAR for s in range(4)])
    at = min(range(4), key=lambda s: (rows[-1][s] + INSERT * len(CLOSING[s]), s)) if leave is None else leave
    out = []
    for k in range(len(roles) - 1, -1, -1):
        s, q, _, merged, ins = next(x for x in STEPS[roles[k]] if x[1] == at and rows[k][x[0]] < FAR and rows[k][x[0]] + x[2] == rows[k + 1][at])
        out.append((q, merged, ins))
        at = s
    return out[::-1]


def boundaries(segments: list[list[list[int]]]) -> list[tuple[int, int]]:
    """(state before, state after) of each segment on a cheapest way through all."""
    rows = [[0, FAR, FAR, FAR]]
    for m in segments:
        rows.append([min(rows[-1][s] + m[s][q] for s in range(4)) for q in range(4)])
    at = min(range(4), key=lambda s: (rows[-1][s] + INSERT * len(CLOSING[s]), s))
    out = []
    for k in range(len(segments) - 1, -1, -1):
        s = next(s for s in range(4) if rows[k][s] + segments[k][s][at] == rows[k + 1][at])
        out.append((s, at))
        at = s
    return out[::-1]


def runs(parts: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Rows of one conversation and segment, from rows sorted by place; a run may span batches."""
    kept: list[tuple] = []
    for pdf in parts:
        for row in pdf.itertuples(index=False, name=None):
            if kept and kept[-1][:2] != row[:2]:
                yield kept
                kept = []
            kept.append(row)
    if kept:
        yield kept


def segment_matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for run in runs(parts):
        rows.append((run[0][0], run[0][1], [x for r in matrix([t[3] for t in run]) for x in r]))
        if len(rows) >= 1000:
            yield pd.DataFrame(rows, columns=["conv", "seg", "m"])
            rows = []
    yield pd.DataFrame(rows, columns=["conv", "seg", "m"])


def solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """States at the cuts of one conversation, from one matrix a segment."""
    pdf = pdf.sort_values("seg")
    ends = boundaries([[list(m[4 * s : 4 * s + 4]) for s in range(4)] for m in pdf.m])
    last = [False] * (len(ends) - 1) + [True]
    return pd.DataFrame({"conv": pdf.conv.values, "seg": pdf.seg.values, "before": [a for a, _ in ends], "after": [b for _, b in ends], "last": last})


def repaired(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired turns of each run; the first may go on a turn of the segment before."""
    cols = ["conv", "seg", "k", "role", "text", "n_merged", "inserted", "relabelled", "goes_on", "last"]
    rows, size = [], 0
    for run in runs(parts):
        conv, seg = run[0][:2]
        whole = pd.isna(run[0][5])
        before, after, last = (START, None, True) if whole else (int(run[0][5]), int(run[0][6]), bool(run[0][7]))
        out: list[list] = []
        for (q, merged, ins), turn in zip(trace([t[3] for t in run], before, after), run):
            for i in ins:
                out.append([i, [""], 0, True, False, False])
            if merged and out:
                out[-1][1].append(turn[4])
                out[-1][2] += 1
                out[-1][4] |= q != turn[3]
            else:
                out.append([q, [turn[4]], 1, False, q != turn[3], merged])
        end = out[-1][0]
        if last:
            for i in CLOSING[end]:
                out.append([i, [""], 0, True, False, False])
        for k, (q, texts, n, inserted, relabelled, goes_on) in enumerate(out):
            text = "\n".join(texts)
            rows.append((conv, seg, k, ROLES[q], text, n, inserted, relabelled, goes_on, k == len(out) - 1))
            size += len(text)
        if size > 4_000_000 or len(rows) > 20_000:
            yield pd.DataFrame(rows, columns=cols)
            rows, size = [], 0
    yield pd.DataFrame(rows, columns=cols)


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Return conv_id, out_turn, piece, role, text, n_merged, inserted, relabelled, rendered.

    piece is 0 but for merged turns that span segments of conversations of more than 4096 turns, whose pieces follow each other.
    """
    spoken = F.lower(F.trim(F.col(role)))
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    spoken = F.coalesce(F.element_at(alias, spoken), spoken)
    code = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES[1:]]), spoken), F.lit(0)).cast("int")
    base = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), code.alias("code"), F.col(role).alias("said"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")))
    placed = base.withColumn("h", F.xxhash64("text")).repartitionByRange(F.col("conv"), F.col("turn").asc_nulls_last(), F.col("said").asc_nulls_last(), F.col("h"))
    placed = placed.sortWithinPartitions(F.col("conv"), F.col("turn").asc_nulls_last(), F.col("said").asc_nulls_last(), F.col("h"), F.col("text"))
    placed = placed.withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed.drop("h", "turn", "said"), "chat-turns")
    rows = placed.select("conv", "place", F.shiftright("place", PARTITION_BITS).alias("part"), "code", "text")

    # of each conversation above a segment, the number of its turns before each partition
    counts = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("begin"))
    long = counts.groupBy("conv").agg(F.sum("n").alias("total")).where(F.col("total") > SEGMENT).select("conv")
    ahead = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    shift = materialize(counts.join(long, "conv", "left_semi").select("conv", "part", (F.col("begin") - ahead).alias("zero")), "chat-shifts")
    seg = F.coalesce(F.floor((F.col("place") - F.col("zero")) / SEGMENT), F.lit(-1)).cast("long")
    rows = rows.join(shift, ["conv", "part"], "left").select("conv", seg.alias("seg"), "place", "code", "text")
    cut_rows = rows.where("seg >= 0").select("conv", "seg", "place", "code").repartition("conv", "seg").sortWithinPartitions("conv", "seg", "place")
    matrices = cut_rows.mapInPandas(segment_matrices, "conv string, seg long, m array<long>")
    ends = materialize(matrices.groupBy("conv").applyInPandas(solve, "conv string, seg long, before int, after int, last boolean"), "chat-cuts")

    each = rows.join(ends, ["conv", "seg"], "left").select("conv", "seg", "place", "code", "text", "before", "after", "last")
    each = each.repartition("conv", "seg").sortWithinPartitions("conv", "seg", "place")
    out = each.mapInPandas(repaired, "conv string, seg long, k int, role string, text string, n_merged long, inserted boolean, relabelled boolean, goes_on boolean, last boolean")
    out = materialize(out, "chat-repaired")

    # numbers of turns before each segment of a conversation that spans some
    spread = out.join(ends.select("conv", "seg"), ["conv", "seg"], "left_semi").groupBy("conv", "seg")
    spread = spread.agg(F.sum((~F.col("goes_on")).cast("long")).alias("n"), F.max((F.col("goes_on") & (F.col("k") == 0)).cast("int")).alias("on"), F.max("k").alias("max_k"))
    w = Window.partitionBy("conv").orderBy("seg")
    spread = spread.withColumn("first", F.sum("n").over(w) - F.col("n")).withColumn("next_on", F.coalesce(F.lead("on").over(w), F.lit(0)))
    # pieces so far: segments since the last one that began a turn of its own
    spread = spread.withColumn("began", F.max(F.when((F.col("n") > 0), F.col("seg"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spread = spread.withColumn("rank", F.row_number().over(w)).withColumn("began_rank", F.max(F.when(F.col("n") > 0, F.col("rank"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spread = spread.select("conv", "seg", "first", "on", "next_on", (F.col("rank") - F.coalesce("began_rank", F.lit(1))).alias("piece_here"))
    full = out.join(spread, ["conv", "seg"], "left")
    number = F.coalesce("first", F.lit(0)) + F.col("k") - F.coalesce("on", F.lit(0))
    piece = F.when(F.col("goes_on") & (F.col("k") == 0), F.coalesce("piece_here", F.lit(0))).otherwise(0)
    open_end = F.col("last") & (F.coalesce("next_on", F.lit(0)) == 1)
    rendered = F.concat(F.when(piece == 0, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise(F.lit("\n")), F.col("text"), F.when(open_end, F.lit("")).otherwise(F.lit("<|end|>\n")))
    conv = F.when(F.col("conv") == "n", F.lit(None)).otherwise(F.expr("substring(conv, 2)")).cast(turns.schema[conv_id].dataType)
    return full.select(conv.alias("conv_id"), number.cast("long").alias("out_turn"), piece.cast("int").alias("piece"), "role", "text", "n_merged", "inserted", "relabelled", rendered.alias("rendered"))
