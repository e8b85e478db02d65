"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from sievework.llm import repair

BLANK = r"\x20\x09-\x0D"


def plain(rows):
    """The contract in its words; rows: (conv_id, turn, role, text)."""
    space = lambda x: " " if x is None else str(x)
    own = {}
    for conv, turn, role, text in rows:
        kept = own.setdefault(conv, [])
        kind, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: judged(sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for conv, kept in own.items()}


def judged(rows):
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        m = re.findall(f"[^{BLANK}]", text)
        faults.append("blank" if not m else "duplicate" if (role, text) in seen else "truncated" if m[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def fits(sofar, letter):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[sofar].find(letter) >= 0 if letter else False

    @cache
    def best(i, state, inserts):
        out = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 2:
            out += [(c + 5, "I" + s, ((r, ""), *t)) for r in ("user", "assistant") if fits(state, r[0]) for c, s, t in [best(i, r[0], inserts + 1)]]
        if i < len(rows):
            c, s, t = best(i + 1, state, 0)
            out.append((c + 2, "D" + s, t))
            if faults[i] not in ("blank", "duplicate"):
                _, role, text = rows[i]
                for letter, r, cost in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if fits(state, r[:1]):
                        c, s, t = best(i + 1, r[0], 0)
                        out.append((c + cost + 5 * (faults[i] == "truncated"), letter + s, ((r, text), *t)))
        return min(out) if out else (10**9, "", ())

    cost, audit, fixed = best(0, "", 0)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    says = ["Yes.", "No!", "why?", "and then", "", None, "  \n", "Fine.  \n", "wait. ", "é", "x" * 300 + ".", "x" * 300 + "y."]
    out = []
    for c in range(convs):
        n = rng.randrange(1, most)
        for t in range(n):
            turn = None if rng.random() < 0.05 else rng.choice([t, t, t, t + 3, max(t - 1, 0)])
            role = rng.choice(["system"] if t == 0 and rng.random() < 0.3 else [["user", "assistant"][t % 2]] * 6 + ["system", "tool", None, "", "User", "agent"])
            text = rng.choice(says) if rng.random() < 0.4 else f"Turn {rng.randrange(40)}."
            out.append((None if c == 3 else c - 5, turn, role, text))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("bits", [1, 16])
def test_repair(spark, bits):
    rows = random_rows(bits, 60, 24)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as conv", "3 as seg").repartition(4)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(df, bits).collect()}
    assert got == plain(rows)
    assert len({len(v[6]) for v in got.values()}) > 5


def test_op12(spark, tmp_path):
    rows = random_rows(7, 30, 12) + [(900, t, ["user", "assistant"][t % 2], f"Turn {t % 50}.") for t in range(150)] + [(901, 1, "user", "Same.")] * 5
    rows += [(1000 + k, 0, "user", "Only one.") for k in range(60)]  # some of them lose it
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.op12(spark, f"file://{tmp_path}").collect()}
    assert got == plain(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got.values()
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/none/conversations.parquet")
    assert repair.op12(spark, f"file://{tmp_path}/none").count() == 0
