"""Chat formatting with the cheapest repair of roles.

A legal conversation is an optional system turn, then user and assistant in turns, ending with the assistant. Dynamic
programming over that automaton picks, for each turn, to keep it, to merge it into the one before, to relabel it, or to
put empty turns in, at the least total cost; then the repaired turns are rendered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Roles that may follow; None is the start.
NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Costs of a repair.
MERGE, RELABEL, INSERT = 1, 2, 3
#: What stands around a turn when rendered.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def _ways() -> dict[str | None, dict[str, tuple[str, ...]]]:
    """Last role, then role to append: the fewest empty turns to put in between."""
    out: dict = {}
    for last in NEXT:
        found, edge = {r: () for r in NEXT[last]}, {r: () for r in NEXT[last]}
        while edge:
            edge = {r: (*path, x) for x, path in edge.items() for r in NEXT[x] if r not in found}
            found |= edge
        out[last] = found
    return out


WAYS = _ways()


def repair(roles: list[str | None]) -> tuple[int, list[tuple[str, str | None, tuple[str, ...]]]]:
    """(cost, per turn (what, role, empty turns before it)); the last entry is the end, with the empty turns put there.

    Equal costs go to fewer empty turns at the end, then to merging, then to the earlier role of ROLES. Unknown roles are relabelled.
    """
    best: dict[str | None, tuple[int, tuple | None]] = {None: (0, None)}
    for role in roles:
        now: dict[str | None, tuple[int, tuple | None]] = {}
        for last, (cost, path) in best.items():
            if last is not None:
                c = cost + MERGE + RELABEL * (role != last)
                if last not in now or c < now[last][0]:
                    now[last] = (c, (path, ("merge", last, ())))
            for to in ROLES:
                if to not in WAYS[last]:
                    continue
                before = WAYS[last][to]
                c = cost + INSERT * len(before) + RELABEL * (role != to)
                if to not in now or c < now[to][0]:
                    now[to] = (c, (path, ("turn", to, before)))
        best = now
    ends = []
    for last, (cost, path) in best.items():
        if last is None:
            ends.append((0, 0, 0, path, ()))
        else:
            after = () if last == "assistant" else (*WAYS[last]["assistant"], "assistant")
            ends.append((cost + INSERT * len(after), len(after), ROLES.index(last), path, after))
    cost, _, _, path, after = min(ends, key=lambda e: e[:3])
    out: list = [("end", None, after)]
    while path is not None:
        path, step = path
        out.append(step)
    return cost, out[::-1]


def render(turns: list[tuple[str | None, str | None]]) -> tuple[int, list[tuple[str, str]], str]:
    """(cost, repaired turns, text) of (role, text) turns in order; null texts are empty; merged ones meet in a line feed."""
    cost, steps = repair([r for r, _ in turns])
    held: list[tuple[str, list[str]]] = []
    for (what, role, before), (_, text) in zip(steps, [*turns, (None, None)]):
        held += [(r, [""]) for r in before]
        if what == "merge":
            held[-1][1].append(text or "")
        elif what == "turn":
            held.append((role, [text or ""]))
    out = [(role, "\n".join(texts)) for role, texts in held]
    return cost, out, "".join(OPEN.format(role=r) + t + CLOSE for r, t in out)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, n_turns, n_out, cost, rendered.

    Turns are ordered by number (null last), then role and text; repeated rows are turns like others and get merged.
    Roles are compared in lower case without white space around them. Rows without a conversation id make up one
    conversation; an empty table gives no rows; other columns are ignored. A conversation is one row of the result, so
    it is gathered in one task whatever the method.
    """
    row = F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).cast("bigint").alias("turn"), F.lower(F.trim(F.col(role_col))).alias("role"), F.col(text_col).alias("text"))
    by = turns.select(F.col(conv_col).alias("conv_id"), row.alias("r")).groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("r"))

    @F.arrow_udf("struct<n_turns: bigint, n_out: bigint, cost: bigint, rendered: string>")
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for conv in rows.to_pylist():
            cost, done, text = render([(x["role"], x["text"]) for x in conv])
            out.append({"n_turns": len(conv), "n_out": len(done), "cost": cost, "rendered": text})
        return pa.array(out, pa.struct([("n_turns", pa.int64()), ("n_out", pa.int64()), ("cost", pa.int64()), ("rendered", pa.string())]))

    return by.select("conv_id", run("r").alias("c")).select("conv_id", "c.*")
