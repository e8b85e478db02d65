"""The hierarchical Pitman-Yor model: counts and base scores exactly, draws against their distribution, probabilities that sum to one."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from sievework.llm import pitman


def seatings(c):
    """P(t) of c customers of one dish by adding up all ways to sit down: p 0.3, 4 other tables, strength 1, discount 1/2."""
    weight = Counter()
    for choice in product(range(c), repeat=c):
        sizes, w = [], 1.0
        for k in choice:
            if k > len(sizes):
                break
            if k == len(sizes):
                w *= (1 + 0.5 * (4 + len(sizes))) * 0.3
                sizes.append(1)
            else:
                w *= sizes[k] - 0.5
                sizes[k] += 1
        else:
            weight[len(sizes)] += w
    return {t: w / sum(weight.values()) for t, w in weight.items()}


@pytest.mark.parametrize("c", [2, 3, 5])
def test_seat_draws_from_the_conditional(c):
    n = 40_000
    u = (np.arange(n) + 0.5) / n
    got = Counter(pitman.seat(np.full(n, c), np.full(n, 0.3), np.full(n, 4), u).tolist())
    for t, p in seatings(c).items():
        assert got[t] / n == pytest.approx(p, abs=1e-4)


def test_seat_of_very_many_customers():
    c = np.array([1, 10**6, 10**9, 10**12])
    t = pitman.seat(c, np.array([0.5, 1e-3, 1e-6, 0.9]), np.array([0, 100_000, 0, 0]), np.array([0.5, 0.1, 0.999, 0.5]))
    assert t[0] == 1 and (t >= 1).all() and (t <= c).all() and t[1] > 50


def test_spelling_sums_to_one():
    key = np.unique(np.random.default_rng(1).integers(0, 1 << 24, 3000))
    count = np.random.default_rng(2).integers(1, 50, len(key))
    model = None
    for sweep in range(3):
        model = pitman.Spelling(key, count, model, sweep)
    for room in (0, int(key[5] >> 8), int(key[-1] >> 8)):
        assert model.probability(room << 8 | np.arange(256)).sum() == pytest.approx(1)
    none = pitman.Spelling(key[:0], count[:0], None, 0)
    assert none.probability(np.arange(256)).sum() == pytest.approx(1)


def plain(docs):
    """doc_id -> (held_out, n_tokens, n_known, N, base) by the contract."""
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode()), None]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    count = Counter(w for d, t in docs if not held(d) for w in words(t))
    n, v = sum(count.values()), len(count)
    return [(d, held(d), len(words(t)), sum(count[w] > 0 for w in words(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t))) for d, t in docs]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeéßж", k=rng.randrange(1, 9))) for _ in range(300)]
    out = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(300)], k=rng.randrange(3, 120)))) for i in range(150)]
    out += [(400 + i, f"unseen{i} {out[i][1]}\tEND\x0b\x00x") for i in range(20)]
    return [*out, (500, None), (501, ""), (502, " \n"), (None, "no id"), out[3], out[3], (503, "w" * 50_000), (2**40, "Ä ä A a"), (-5, "x")]


@pytest.mark.parametrize("frequent", [0, 7, 10**6])
def test_score(spark, docs, frequent, request):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, h long, word string").repartition(3)
    got = sorted(pitman.score(df, frequent).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["base_score"]))
    want = sorted(plain(docs), key=lambda r: (r[0] is None, r[0], r[5]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert [r["base_score"] for r in got] == pytest.approx([w[5] for w in want])
    assert all(r["score"] < 0 for r in got)
    seen = request.config.__dict__.setdefault("op11_scores", [r["score"] for r in got])
    assert [r["score"] for r in got] == pytest.approx(seen, rel=1e-9)


@pytest.mark.parametrize("frequent, heavy", [(0, 1024), (10**6, 1024), (10**6, 4)])
def test_probabilities_sum_to_one(spark, monkeypatch, frequent, heavy):
    """After every word: a walk over words and ends whose steps are the model's probabilities keeps its mass. `?` stands for all unknown words."""
    monkeypatch.setattr(pitman, "HEAVY", heavy)
    held = (d for d in range(10_000) if zlib.crc32(str(d).encode()) % 7 == 2)
    words = "abc?"
    texts = ["", *words, *map(" ".join, product(words, words))]
    trained = [d for d in range(2000) if zlib.crc32(str(d).encode()) % 7 != 2][:60]
    rows = [(d, "a b a a c b"[: 1 + 2 * (i % 6)]) for i, d in enumerate(trained)]
    rows += zip(held, texts)
    got = {r["doc_id"]: r["score"] for r in pitman.score(spark.createDataFrame(rows, "doc_id long, text string"), frequent).collect()}
    p = {t: 10 ** got[d] for d, t in rows[len(trained) :]}
    # steps up to a factor f(to) / f(from), which changes no eigenvalue: all words lead to an end with one
    step = np.ones((5, 5))
    step[0] = [p[""], *(p[w] for w in words)]
    step[1:, 1:] = [[p[f"{u} {w}"] / p[u] for w in words] for u in words]
    assert max(abs(np.linalg.eigvals(step))) == pytest.approx(1, abs=1e-9)


def test_context_is_the_whole_word_before(spark):
    """words of the same ending are different contexts."""
    ids = [d for d in range(3000) if zlib.crc32(str(d).encode()) % 7 != 2]
    rows = [(d, "left ping" if i % 2 else "raft pong") for i, d in enumerate(ids[:400])]
    held = [d for d in range(3000) if zlib.crc32(str(d).encode()) % 7 == 2][:4]
    rows += zip(held, ["left ping", "left pong", "raft ping", "raft pong"])
    for frequent in (0, 10**6):
        got = {r["doc_id"]: r["score"] for r in pitman.score(spark.createDataFrame(rows, "doc_id long, text string"), frequent).collect()}
        a, b, c, d = (got[k] for k in held)
        assert a > b + 1 and d > c + 1


def test_rows_are_small(spark, tmp_path):
    """Of texts of very many pairs, too: rows and pages of any size were held outside the heap."""
    rng = random.Random(5)
    text = " ".join(str(rng.randrange(10**5)) for _ in range(200_000))
    docs = spark.createDataFrame([(1, False, text), (2, False, text[::-1])], "doc_id long, held_out boolean, text string")
    pitman.counted(docs).select("h", "c").write.parquet(path := f"file://{tmp_path}/frequent")
    blocks = pitman.chunks(docs.coalesce(1), path, 1, 1e9, 400_000).cache()
    for rows in (blocks, pitman.built(blocks.where("kind = 8"), path, 1, 1e9)):
        sizes = [r["n"] for r in rows.where("data is not null").selectExpr("length(data) as n").collect()]
        assert max(sizes) <= 1 << 18 and sum(sizes) > 1 << 19
    blocks.unpersist()


def test_pieces_make_the_whole(monkeypatch):
    monkeypatch.setattr(pitman, "PIECE", 100)
    parts = {7: np.arange(300), 2**33: np.arange(0), 8: np.array([2**60, 1])}
    batches = [b for key, x in parts.items() for b in pitman.pieces(8, 3, key, pitman.pack(x))]
    random.Random(6).shuffle(batches)
    import pyarrow as pa

    got = {key: x.tolist() for key, (x,) in pitman.whole(pa.Table.from_batches(batches))}
    assert len(batches) > 3 and list(got) == sorted(parts) and got == {k: x.tolist() for k, x in parts.items()}


def test_op11(spark, tmp_path, docs):
    schema = "doc_id long, text string"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = pitman.op11(spark, f"file://{tmp_path}")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and got.count() == len(docs)
    held = pitman.op11(spark, "/root/testdata/sf0.001").where("held_out").toPandas()
    assert held.score.sum() > 0.9 * held.base_score.sum() and (held.score > held.base_score).mean() > 0.9
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert pitman.op11(spark, f"file://{tmp_path}/none").count() == 0
    spark.createDataFrame([(1, "never trained on")] if zlib.crc32(b"1") % 7 == 2 else [(2, None)], schema).write.parquet(f"file://{tmp_path}/one/documents.parquet")
    assert pitman.op11(spark, f"file://{tmp_path}/one").count() == 1
