"""Conversation structure repair: the cheapest edits that give every conversation the
shape ``(s?(ua)+)?`` of role initials, found in linear space.

Hirschberg's divide and conquer over a four-state automaton (0 start, 1 after system,
2 after user, 3 after assistant; 0 and 3 accept).  Forward costs from the start and
backward costs from the end meet at the middle row; the crossing state is the optimal
one whose forward edit string is ASCII-least, which the forward pass knows as a rank
among the four states without storing any string.  Both halves are solved alike, so
only O(rows) moves are held at any time and the work is O(rows log rows).

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only edit for a blank or
duplicate row), Insert an empty user or assistant row 5 (before any row or at the end);
a truncated row that is not deleted adds 5.  Among cheapest scripts the one whose
initials (D, I, K, R) read ASCII-least is returned.

Spark damages the rows, deals them by conversation and sorts them; each task reads its
rows as one stream and repairs one conversation at a time, so memory holds the rows of
one conversation, not of a group of them.

Defined cases: null role or text reads as one space, a null conv_id is one
conversation of its own, a null turn sorts first.  Rows of one turn are ordered by
role, text and copy.  A conversation whose rows are all dropped gives zeros, an empty
audit and the digest of the empty string.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipmeter.llm.shipping import ship

# Fixed values of the contract: edit costs, the grammar's states and damage kinds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL_PAIRS = ("su", "ua", "au")
ACCEPT = frozenset({0, 3})
DAMAGE_KINDS = 20  # crc32(conv_id:turn) % 20: 0 drop, 1 empty, 2 no [.!?], 3 repeat, 4 role user
INF = float("inf")

SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
_NEXT_ROLE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_KEEP_TO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with ``dropped`` rows kept as markers so every conv_id stays."""
    key = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    kind = F.crc32(key) % DAMAGE_KINDS
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    rows = conversations.select(F.col("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each ``(role, text)`` row: blank, duplicate, truncated or ''."""
    seen: set[tuple[str, str]] = set()
    out = []
    for role, text in rows:
        visible = _VISIBLE.findall(text)
        if not visible:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif visible[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def _inserts(state: int) -> list[tuple[int, int]]:
    """(inserted rows, state) reachable from ``state`` by inserts alone, cheapest first."""
    out, seen = [(0, state)], {state}
    while True:
        k, s = out[-1]
        nxt = _NEXT_ROLE[s][1]
        if nxt in seen:
            return out
        seen.add(nxt)
        out.append((k + 1, nxt))


def _moves(state: int, initial: str, fault: str) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row from ``state``."""
    extra = TRUNCATED if fault == "truncated" else 0
    out = [("D", DELETE, state)]
    if fault not in ("blank", "duplicate"):
        if (state, initial) in _KEEP_TO:
            out.append(("K", KEEP + extra, _KEEP_TO[state, initial]))
        out.append(("R", REROLE + extra, _NEXT_ROLE[state][1]))
    return out


def _forward(rows: list[tuple[str, str]], start: int) -> tuple[list[float], list[int]]:
    """Cost of the cheapest script over ``rows`` from ``start`` to each state (no trailing
    inserts), and the ASCII rank of those scripts among the states that are reachable."""
    cost, rank = [INF] * 4, [0] * 4
    cost[start] = 0
    for initial, fault in rows:
        best: dict[int, tuple[float, int, str]] = {}
        for q in range(4):
            if cost[q] == INF:
                continue
            for k, q1 in _inserts(q):
                for letter, c, q2 in _moves(q1, initial, fault):
                    cand = (cost[q] + INSERT * k + c, rank[q], "I" * k + letter)
                    if q2 not in best or cand < best[q2]:
                        best[q2] = cand
        cost = [best[q][0] if q in best else INF for q in range(4)]
        order = sorted(best, key=lambda q: best[q][1:])
        rank = [order.index(q) if q in best else 0 for q in range(4)]
    return cost, rank


def _backward(rows: list[tuple[str, str]], finals: frozenset[int], trailing: bool) -> list[float]:
    """Cheapest cost from each state before ``rows`` to a state of ``finals`` after them."""
    if trailing:
        ahead = [min((INSERT * k for k, s in _inserts(q) if s in finals), default=INF) for q in range(4)]
    else:
        ahead = [0 if q in finals else INF for q in range(4)]
    for initial, fault in reversed(rows):
        ahead = [
            min((INSERT * k + c + ahead[q2] for k, q1 in _inserts(q) for _, c, q2 in _moves(q1, initial, fault)), default=INF)
            for q in range(4)
        ]
    return ahead


def _single(row: tuple[str, str], start: int, finals: frozenset[int], trailing: bool) -> tuple[float, str]:
    """The cheapest, then ASCII-least, script of one row."""
    initial, fault = row
    best = (INF, "")
    for k, q1 in _inserts(start):
        for letter, c, q2 in _moves(q1, initial, fault):
            for j, q3 in _inserts(q2) if trailing else [(0, q2)]:
                if q3 in finals:
                    best = min(best, (INSERT * (k + j) + c, "I" * k + letter + "I" * j))
    return best


def solve(rows: list[tuple[str, str]], start: int = 0, finals: frozenset[int] = ACCEPT, trailing: bool = True) -> tuple[float, str]:
    """Cost and ASCII-least audit of the cheapest scripts over ``rows`` ((initial, fault)
    pairs) from ``start`` to ``finals``; inserts after the last row only if ``trailing``."""
    if not rows:
        costs = [(INSERT * k, "I" * k) for k, s in _inserts(start) if s in finals and (trailing or k == 0)]
        return min(costs, default=(INF, ""))
    if len(rows) == 1:
        return _single(rows[0], start, finals, trailing)
    mid = len(rows) // 2
    cost, rank = _forward(rows[:mid], start)
    ahead = _backward(rows[mid:], finals, trailing)
    total = min(cost[q] + ahead[q] for q in range(4))
    if total == INF:
        return INF, ""
    cross = min((q for q in range(4) if cost[q] + ahead[q] == total), key=lambda q: rank[q])
    _, left = solve(rows[:mid], start, frozenset({cross}), False)
    _, right = solve(rows[mid:], cross, finals, trailing)
    return total, left + right


def repaired(rows: list[tuple[str, str]], audit: str) -> list[str]:
    """``role:text`` lines after the edits of ``audit``."""
    out, state, i = [], 0, 0
    for letter in audit:
        if letter == "I":
            role, state = _NEXT_ROLE[state]
            out.append(f"{role}:")
            continue
        role, text = rows[i]
        i += 1
        if letter == "K":
            state = _KEEP_TO[state, role[:1]]
            out.append(f"{role}:{text}")
        elif letter == "R":
            role, state = _NEXT_ROLE[state]
            out.append(f"{role}:{text}")
    return out


def report(conv_id, turns: list, rows: list[tuple[str, str]]) -> tuple:
    """One output row of a conversation from its ordered rows after damage."""
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    found = faults(rows)
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))
    cost, audit = solve(list(zip(initials, found)))
    digest = hashlib.sha256("\n".join(repaired(rows, audit)).encode()).hexdigest()
    return (
        conv_id, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal,
        int(cost), audit, digest,
    )


_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reports of the conversations of one task, whose rows arrive sorted by conversation
    and order; only the rows of the current conversation are held."""
    current, turns, rows, out = _NONE, [], [], []
    for batch in batches:
        for conv, turn, role, text, dropped in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"], batch["dropped"]):
            conv = None if pd.isna(conv) else int(conv)
            if conv != current:
                if current is not _NONE:
                    out.append(report(current, turns, rows))
                current, turns, rows = conv, [], []
            if not dropped:
                turns.append(None if pd.isna(turn) else int(turn))
                rows.append((role, text))
        if len(out) >= _BATCH:
            yield pd.DataFrame(out, columns=_COLUMNS)
            out = []
    if current is not _NONE:
        out.append(report(current, turns, rows))
    if out:
        yield pd.DataFrame(out, columns=_COLUMNS)


_NONE = object()
_BATCH = 4096


def repair(conversations: DataFrame) -> DataFrame:
    """One row per original conv_id: gaps, first faults, illegal role pairs, the cost and
    audit of the cheapest repair, and the digest of the repaired conversation.

    Rows are dealt by conversation and sorted in Spark; each task then reads its rows
    as one stream, holding one conversation at a time.
    """
    ship(conversations.sparkSession)
    rows = damaged(conversations)
    ordered = rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy"
    )
    return ordered.select("conv_id", "turn", "role", "text", "dropped").mapInPandas(_stream, SCHEMA)
