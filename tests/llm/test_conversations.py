import hashlib
import itertools
import zlib
from functools import cache

import numpy as np

from wayfowl.llm import conversations as cv

SPACE = " \t\n\x0b\x0c\r"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def slow_repair(rows):
    """The contract read plainly for one conversation's rows (turn, role, text): cheapest edits by recursion over what is left."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        shown = text.strip(SPACE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))

    def step(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @cache
    def best(i, state, inserted=0):
        """(cost, edits, lines) from row i on; state is the initial written last."""
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if after := step(state, role[0]):
                    cost, edits, lines = best(i, after, inserted + 1)
                    ways.append((cost + 5, "I" + edits, (role + ":", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, edits, lines = best(i + 1, state)
            ways.append((cost + 2, "D" + edits, lines))
            if faults[i] not in ("blank", "duplicate"):
                for letter, name, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if after := step(state, name[:1]):
                        cost, edits, lines = best(i + 1, after)
                        ways.append((cost + price + 5 * (faults[i] == "truncated"), letter + edits, (f"{name}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    for i in range(len(rows), 0, -20):  # so that no recursion gets deep
        for state in ("", "s", "u", "a"):
            best(i, state)
    cost, edits, lines = best(0, "")
    turns = {r[0] for r in rows if r[0] is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def slow_all(rows):
    groups = {r[0]: [] for r in rows}
    for conv, *rest in slow_damage(rows):
        groups[conv].append(tuple(rest))
    return {conv: slow_repair(own) for conv, own in groups.items()}


def repaired_by(rows):
    """Repair over rows in order, with the faults of their place."""
    run, seen = cv.Repair(MOVES), set()
    for turn, role, text in rows:
        shown = text.strip(SPACE)
        run.add(turn, role, text, 1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0, role[:1])
        seen.add((role, text))
    return run.result()


MOVES = cv.Moves()


def test_random_conversations_equal_the_slow_recursion():
    rng = np.random.default_rng(1)
    for n in [0, 1, 2, 3, 4, 5, 8, 13, 30, 60] * 40:
        rows = [(i, str(rng.choice(["system", "user", "assistant", "tool", ""], p=[0.1, 0.35, 0.35, 0.1, 0.1])), str(rng.choice(["a.", "b!", "c", " ", f"x{i}.", f"y{i}"], p=[0.05, 0.05, 0.1, 0.1, 0.5, 0.2]))) for i in range(n)]
        rows.sort()
        assert repaired_by(rows) == slow_repair(rows)[0]


def test_every_short_conversation():
    kinds = [(r, t) for r in ("system", "user", "assistant", "x") for t in ("{}.", "{}", "")]
    for n in range(4):
        for chosen in itertools.product(kinds, repeat=n):
            rows = [(i, r, t.format(i)) for i, (r, t) in enumerate(chosen)]
            assert repaired_by(rows) == slow_repair(rows)[0]
    assert len(MOVES.situations) < 2000


def test_spilled_moves_give_the_same(monkeypatch):
    rows = [(i, ("user", "assistant")[i % 2 if i % 7 else 0], f"t{i}." if i % 5 else f"t{i}") for i in range(400)]
    want = repaired_by(rows)
    monkeypatch.setattr(cv, "SPILL_BYTES", 64)
    assert repaired_by(rows) == want == slow_repair(rows)[0]


def results(df):
    return {r.conv_id: tuple(r[1:]) for r in df.collect()}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(cv.op13_conversation_repair(spark, sf)) == {c: x[0] for c, x in slow_all(rows).items()}


def test_odd_rows_and_repaired_turns(spark):
    rows = [(1, None, "user", None, 0), (1, None, None, "Hi.", 0), (1, 5, "assistant", "Yes.", 0), (1, 5, "assistant", "Yes.", 0), (1, 3, "", "Yes? \t", 0), (None, 1, "system", "S.", 0), (None, 2, "user", "q", 0), (2, 1, "user", "long " * 60_000 + ".", 0)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Turn {t}.", 0) for c in range(3, 60) for t in range(c % 4)]
    rows += [(99, t, ("user", "assistant")[t % 2], f"Turn {t % 900}.", 0) for t in range(1500)]  # many batches
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault int")
    damaged = cv.damage(df)
    found = cv.repairs(damaged)
    want = slow_all([r[:4] for r in rows])
    assert results(found) == {c: x[0] for c, x in want.items()}
    lines = {}
    for r in sorted(cv.repaired(damaged, found).collect(), key=lambda r: r.position):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: list(x[1]) for c, x in want.items() if x[1]}
    assert cv.repairs(cv.damage(df.limit(0))).count() == 0


def test_a_conversation_whose_rows_are_all_gone(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = cv.repairs(cv.damage(spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
