"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sievework.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        others = sorted(((-m, x) for x, m in counts.items() if near(w, x)))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[w] = (form, n, len(others), -others[0][0] if form else None)
    rows = {}
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, k, m)
    return rows


def plain_words(docs):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def vocabulary(seed, letters, n, sizes):
    rng = random.Random(seed)
    own = {"".join(rng.choices(letters, k=rng.choice(sizes))) for _ in range(n)}
    for w in list(own)[: n // 2]:
        i = rng.randrange(len(w))
        own |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
    return {w: rng.choice([2, 3, 5, 20, 31, 200, 2500]) for w in own if w}


@pytest.mark.parametrize("letters,n,sizes,subtree", [("ab", 60, (3, 4, 5), 40), ("aé÷z", 60, (2, 6, 7), 30), ("abcdefgh", 200, (7, 8, 9), 100_000), ("a", 12, (1, 2, 3, 4, 5, 30), 100_000)])
def test_grouped(spark, letters, n, sizes, subtree):
    counts = vocabulary(n, letters, n, sizes)
    if subtree > 100:  # a level of joins for each character otherwise
        counts |= {letters[0] * 3000: 4, letters[0] * 2999: 50}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in spelling.grouped(df, subtree=subtree).collect()}
    assert got == plain(counts)


def test_each_pair_turns_up_once():
    own = sorted(vocabulary(5, "abc", 300, (3, 4, 5, 6)))
    t, seen = spelling.Subtrees(own), Counter()
    for i, j in t.pairs(np.zeros(len(own), int)):
        seen.update(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist()))
    assert seen == Counter((i, j) for j in range(len(own)) for i in range(j) if near(own[i], own[j]))


def test_op13(spark, tmp_path):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdéÀ", k=rng.randrange(6, 11))) for _ in range(30)]
    docs = [(i, " ".join(rng.choices(base, k=60)) + "," + "".join(rng.choices(base, k=1)).upper()) for i in range(60)]
    docs += [(None, " ".join(base * 2)), (7, None), (8, ""), docs[0], (9, "straßeße×÷ Straßeße×÷ ÄÄÄÄÄÄÄ äääääää" * 2), (10, "x" * 100_000 + " " + "x" * 100_000)]
    spark.createDataFrame([(i, t, "t") for i, t in docs], "doc_id long, text string, word string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in spelling.op13(spark, f"file://{tmp_path}").collect()}
    assert got == plain(plain_words(docs)) and any(r[0] for r in got.values())
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert spelling.op13(spark, f"file://{tmp_path}/none").count() == 0
