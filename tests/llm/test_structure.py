"""Conversation repair, embedding range join and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from helpers import odd

from shipmeter.llm import convrepair as cr
from shipmeter.llm import filteraudit as fa
from shipmeter.llm import metricjoin as mj

# ---- conversation repair ------------------------------------------------------------


def brute_scripts(rows, max_inserts=3):
    """Every script with at most ``max_inserts`` inserts, cheapest then ASCII-least."""
    best = (cr.INF, "")

    def walk(i, state, cost, audit, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and state in cr.ACCEPT:
            best = min(best, (cost, audit))
        if inserts < max_inserts:
            walk(i, cr._NEXT_ROLE[state][1], cost + cr.INSERT, audit + "I", inserts + 1)
        if i < len(rows):
            for letter, c, nxt in cr._moves(state, *rows[i]):
                walk(i + 1, nxt, cost + c, audit + letter, inserts)

    walk(0, 0, 0, "", 0)
    return best


def test_hirschberg_equals_all_scripts():
    rng = random.Random(7)
    for _ in range(400):
        n = rng.randint(0, 7)
        rows = [(rng.choice("suax "), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(n)]
        assert cr.solve(rows) == brute_scripts(rows), rows


def test_forward_and_backward_meet():
    rng = random.Random(3)
    for _ in range(100):
        rows = [(rng.choice("sua"), rng.choice(["", "truncated"])) for _ in range(rng.randint(2, 12))]
        mid = len(rows) // 2
        cost, _ = cr._forward(rows[:mid], 0)
        ahead = cr._backward(rows[mid:], cr.ACCEPT, True)
        assert min(c + a for c, a in zip(cost, ahead)) == cr.solve(rows)[0]


def test_long_conversation_is_linear_in_work():
    rows = [("u", ""), ("a", "")] * 2000 + [("s", "truncated")]
    cost, audit = cr.solve(rows)
    assert cost == 2 and audit == "K" * 4000 + "D"


def test_faults_first_counts():
    rows = [("user", "Hi."), ("user", "Hi."), ("user", " \t"), ("assistant", "no end"), ("user", "Hi.")]
    assert cr.faults(rows) == ["", "duplicate", "blank", "truncated", "duplicate"]


def plain_report(rows):
    """The contract by hand for rows (conv_id, turn, role, text) of one conversation."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        import zlib

        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(turn, role, text, c) for c in range(2 if kind == 3 else 1)]
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3]))
    return cr.report(rows[0][0], [r[0] for r in out], [(r[1], r[2]) for r in out])


def test_query_rows_and_odd_cases(spark):
    data = [
        (1, 0, "user", "Hello there."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Bye"),
        (2, None, None, None), (2, 5, "system", "Be kind."), (2, 7, "user", "ok?"),
        (None, 1, "user", "who am I."), (3, 4, "tool", "x!"), (3, 4, "user", "same turn."),
    ]
    data += [(4, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(40)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("audit", F_lit())
    got = {r["conv_id"]: tuple(r) for r in cr.repair(df).collect()}
    by_conv = {}
    for r in data:
        by_conv.setdefault(r[0], []).append(r)
    for conv, rows in by_conv.items():
        assert got[conv] == plain_report(rows), conv
    assert cr.repair(df.limit(0)).count() == 0


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("clashing extra column")


def test_all_rows_dropped_gives_zeros(spark):
    import zlib

    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "gone.")], "conv_id long, turn long, role string, text string")
    (row,) = cr.repair(df).collect()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# ---- embedding range join -----------------------------------------------------------


def brute_links(rows):
    """n_links and component of every vec_id by all pairs."""
    ids = [r[0] for r in rows]
    ok = []
    for _, e, label in rows:
        good = label is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e)
        ok.append(good and any(x != 0 for x in e))
    n = {i: 0 for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, ea, la), oka in zip(rows, ok):
        for (b, eb, lb), okb in zip(rows, ok):
            if a < b and oka and okb and la == lb and len(ea) == len(eb):
                x, y = np.array(ea, dtype=np.float64), np.array(eb, dtype=np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= mj.SIMILARITY:
                    n[a] += 1
                    n[b] += 1
                    ra, rb = sorted((find(a), find(b)))
                    parent[rb] = ra
    return {i: (n[i], find(i)) for i in ids}


def vectors(seed, count=300, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(count):
        if i % 3 == 0:
            v = centres[i % 12] + rng.normal(scale=0.08, size=dim)
        else:
            v = rng.normal(size=dim)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2)))
    return rows


def test_range_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(mj, "CELL_ROWS", 40)  # many cells and blocks on few rows
    monkeypatch.setattr(mj, "BLOCK", 16)
    rows = vectors(1)
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [1.0] * 7 + [None], 0), (1003, [float("nan")] + [1.0] * 7, 0)]
    rows += [(1004, rows[3][1], None), (1005, rows[3][1], 1), (1006, [1.0, 2.0], 1), (1007, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in mj.near_duplicates(df).collect()}
    want = brute_links(rows)
    assert sum(v[0] for v in want.values()) > 50
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_range_join_repeats_nulls_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F_lit())
    got = sorted(tuple(r) for r in mj.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False)]
    assert mj.near_duplicates(df.limit(0)).count() == 0


def test_guests_cover_every_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = x[:9]
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
    home = d.argmin(1)
    for i, j in itertools.combinations(range(len(x)), 2):
        if np.linalg.norm(x[i] - x[j]) <= mj.RADIUS:
            lo, hi = sorted((i, j), key=lambda k: home[k])
            assert d[lo, home[hi]] <= d[lo, home[lo]] + 2 * mj.RADIUS + mj.SLACK


# ---- filter audit -------------------------------------------------------------------


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > first[t],
        }
        docs.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in fa.ORDERS:
            for s, letter in enumerate(order):
                c = dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], 0)
                for _, f, g, tx in mine:
                    before = any(f[x] for x in order[:s])
                    here = f[letter] and not before
                    c["kept"] += not before and not f[letter]
                    c["removed"] += here
                    c["redundant"] += f[letter] and before
                    c["unique_fails"] += f[letter] and sum(f.values()) == 1
                    c["good_lost"] += here and g
                    c["toxic_lost"] += here and tx
                    c["shapley"] += 120 // sum(f.values()) if f[letter] else 0
                out[part, order, s + 1] = tuple(int(v) for v in c.values())
    return out


def test_audit_equals_plain_count(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(160):
        n = rng.choice([0, 10, 49, 50, 60, 120])
        text = " ".join(rng.choice(vocab[: rng.choice([20, 80])]) for _ in range(n))
        if i % 7 == 0:
            text += " SHOUT" * 20
        if i % 11 == 0:
            text += " # here"
        rows.append((i, text, f"s{i % 3}"))
    rows += [(200, rows[5][1], "s1"), (3, rows[5][1], "s2"), (201, None, None), (202, "", None), (None, rows[7][1], "s0")]
    rows += [(5, rows[5][1], "s1")]  # a repeated row of the smallest id
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 210, 3)] + [(6, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F_lit())
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in fa.audit(docs, lab).collect()}
    assert got == brute_audit(rows, labels)


def test_audit_odd_rows_and_empty(spark):
    docs = odd(spark)
    lab = spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")
    got = fa.audit(docs, lab).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {"s"}
    first = [r for r in got if r["filter_order"] == "ABCDE" and r["step"] == 1][0]
    assert first["removed"] == len(docs.collect()) - 1  # all but the long text have under 50 words
    assert fa.audit(docs.limit(0), lab).count() == 0


def test_fields_never_carry():
    width = fa.field_width(3)
    values = fa.outcomes(31, 1, 1)
    per = 63 // width
    summed = [3 * limb for limb in fa.limbs(values, width)]
    assert all(s < 1 << 63 for s in summed)
    fields = [(limb >> (j * width)) & ((1 << width) - 1) for limb in summed for j in range(per)]
    assert fields[: len(values)] == [3 * v for v in values]


@pytest.mark.parametrize("mask", range(32))
def test_shapley_shares_sum_to_orders(mask):
    fields = fa.outcomes(mask, 0, 0)
    assert sum(fields[-5:]) == (120 if mask else 0)
