"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is its own vector (words seen in training) beside the mean vector of its character trigrams. Windows of
WIDTH words overlap by WIDTH - STRIDE; every window of a text is scored, the text's score is that of its highest window.
Training picks, in each step, the highest windows of its texts under the network so far (multiple-instance learning).
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, written

#: The bounds of the training sample: labelled texts, half of them toxic at most, and their bytes (those first in the order of a hash).
SAMPLE, SAMPLE_BYTES = 2_400, 64 << 20
WIDTH, STRIDE = 32, 24
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 12, 16, 12, 12
VOCABULARY, TRIGRAMS = 20_000, 1 << 14
STEPS, TEXTS, RATE = 320, 32, 0.01
#: The first fifth of the steps trains on this many windows drawn from its texts, as the network cannot choose yet.
DRAWN = 256
#: Windows that go through the network at a time.
AT_ONCE = 1024
#: Share of words that a training step shows by their characters only.
HIDDEN_WORDS = 0.5
THRESHOLD = 0.7
#: Words whose inputs a worker remembers.
REMEMBERED = 1 << 16
_EDGES = ".,;:!?\"'()[]{}<>|*_-–—«»¿¡…"
_sigmoid = lambda x: 1 / (1 + np.exp(-x))


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def normal(word: str) -> str:
    return word.lower().strip(_EDGES) or word.lower()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words' character trigrams, where each word's begin); a word is set between ^ and $."""
    text = "".join(f"^{w}$" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)  # a word of n characters has n trigrams
    begin = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(len(words)), sizes)
    h = (c[place] * np.uint64(0x9E3779B97F4A7C15) ^ c[place + 1] * np.uint64(0xBF58476D1CE4E5B9) ^ c[place + 2] * np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(40)).astype(np.int64) % TRIGRAMS, begin


def added(size: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows that share a place, in an array of `size` rows."""
    out = np.zeros((size, rows.shape[1]), "f4")
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Network:
    """Parameters, and the table of input projections of words met so far. Row 0 is padding: its update gate keeps the state."""

    def __init__(self, words: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype("f4")
        d = WORD_SIZE + CHAR_SIZE
        self.word = {w: i + 1 for i, w in enumerate(words)}
        self.p = {"W": (rng.standard_normal((len(words) + 1, WORD_SIZE)) * 0.1).astype("f4"), "C": (rng.standard_normal((TRIGRAMS, CHAR_SIZE)) * 0.1).astype("f4")}
        for k in "fb":
            self.p |= {f"X{k}": g(d, 3 * HIDDEN), f"U{k}": g(HIDDEN, 3 * HIDDEN), f"B{k}": np.zeros(3 * HIDDEN, "f4")}
        self.p |= {"A": g(2 * HIDDEN, ATTENTION), "v": g(ATTENTION), "o": g(2 * HIDDEN), "c": np.zeros(1, "f4")}
        self.p["W"][0] = 0
        self.scale, self.shift = 1.0, 0.0
        self.clear()

    def clear(self) -> None:
        """Forgets the words met so far."""
        self.row: dict[str, int] = {}
        self.words: list[str] = ["-"]
        self.gates: dict[str, np.ndarray] = {}

    def _open(self) -> None:
        self.gates = {k: np.empty((REMEMBERED + 1, 3 * HIDDEN), "f4") for k in "fb"}
        for g in self.gates.values():
            g[0] = self._padding()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "words", "gates")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.clear()

    @staticmethod
    def _padding() -> np.ndarray:
        return np.concatenate([np.full(HIDDEN, 30), np.zeros(2 * HIDDEN)]).astype("f4")

    def ids(self, words: list[str]) -> np.ndarray:
        return np.array([self.word.get(w, 0) for w in words], np.int64)

    def vectors(self, ids: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Inputs of words given by their rows in W and their trigrams."""
        chars = np.add.reduceat(self.p["C"][flat], begin, axis=0) / np.diff(begin, append=len(flat))[:, None]
        return np.concatenate([self.p["W"][ids], chars], 1).astype("f4")

    def rows(self, texts: list[str], gates: bool = True) -> list[np.ndarray]:
        """Row numbers of each text's words; new words get a row (and, for scoring, their projections)."""
        words = [t.split() for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self.row))
        if not gates:  # training draws by row: a set's order would change it from run to run
            new.sort()
        if gates and len(self.row) + len(new) > REMEMBERED:
            self.clear()
            new = list(set(chain.from_iterable(words)))
            if len(new) > REMEMBERED:  # one very long text
                self._open()
                self.gates = {k: np.concatenate([g[:1], np.empty((len(new), 3 * HIDDEN), "f4")]) for k, g in self.gates.items()}
        if gates and not self.gates:
            self._open()
        if new:
            at = len(self.row) + 1
            self.row.update(zip(new, range(at, at + len(new))))
            plain = list(map(normal, new))
            if gates:
                x = self.vectors(self.ids(plain), *trigrams(plain))
                for k in "fb":
                    self.gates[k][at : at + len(new)] = x @ self.p[f"X{k}"] + self.p[f"B{k}"]
            else:
                self.words += plain
        get = self.row.__getitem__
        return [np.fromiter(map(get, own), np.int64, len(own)) for own in words]

    def logits(self, w: np.ndarray, gates, keep: dict | None = None) -> np.ndarray:
        """Of windows of row numbers (n, WIDTH) in `gates`. keep: gets what the backward pass needs."""
        p, n = self.p, len(w)
        states = {}
        for k in "fb":
            h, hs, own = np.zeros((n, HIDDEN), "f4"), np.empty((WIDTH, n, HIDDEN), "f4"), []
            u, table_ = p[f"U{k}"], gates[k]
            for t in range(WIDTH) if k == "f" else range(WIDTH - 1, -1, -1):
                g, a = table_[w[:, t]], h @ u
                zr = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r, q = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN :]
                m = np.tanh(g[:, 2 * HIDDEN :] + r * q)
                if keep is not None:
                    own.append((t, h, z, r, q, m))
                h = m + z * (h - m)
                hs[t] = h
            states[k] = hs
            if keep is not None:
                keep[k] = own
        s = np.concatenate([states["f"], states["b"]], 2)
        hidden = np.tanh(s @ p["A"])
        e = np.where(w.T > 0, hidden @ p["v"], np.float32(-1e9))
        a = np.exp(e - e.max(0)) * (w.T > 0)
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * s).sum(0)
        if keep is not None:
            keep |= {"s": s, "hidden": hidden, "a": a, "pooled": pooled}
        return pooled @ p["o"] + p["c"][0]

    def all_logits(self, w: np.ndarray, gates) -> np.ndarray:
        """Of any number of windows, AT_ONCE at a time."""
        return np.concatenate([self.logits(w[at : at + AT_ONCE], gates) for at in range(0, len(w), AT_ONCE)] or [np.zeros(0, "f4")])

    def gradients(self, w: np.ndarray, keep: dict, d: np.ndarray):
        """Of the parameters but W, C, X and B, and of the gates' rows, for the loss's gradient d on the logits."""
        p, g = self.p, {}
        g["c"], g["o"] = d.sum(keepdims=True), keep["pooled"].T @ d
        dp = d[:, None] * p["o"]
        s, a, hidden = keep["s"], keep["a"], keep["hidden"]
        ds = a[:, :, None] * dp
        da = (s * dp).sum(2)
        de = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tn,tnk->k", de, hidden)
        dh = de[:, :, None] * p["v"] * (1 - hidden**2)
        g["A"] = np.einsum("tni,tnk->ik", s, dh)
        ds = ds + dh @ p["A"].T
        gates = {}
        for k, cut in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u, carry = p[f"U{k}"], 0
            g[f"U{k}"] = np.zeros_like(u)
            out = np.zeros((len(w), WIDTH, 3 * HIDDEN), "f4")
            for t, h, z, r, q, m in reversed(keep[k]):
                x = ds[t][:, cut] + carry
                dm = x * (1 - z) * (1 - m**2)
                dz, dr = x * (h - m) * z * (1 - z), dm * q * r * (1 - r)
                back = np.concatenate([dz, dr, dm * r], 1)
                g[f"U{k}"] += h.T @ back
                carry = x * z + back @ u.T
                out[:, t] = np.concatenate([dz, dr, dm], 1)
            gates[k] = out.reshape(-1, 3 * HIDDEN)
        return g, gates

    def score(self, texts: list[str]) -> np.ndarray:
        """Each text's score: the highest of its windows' logits, calibrated."""
        w, of = windows(self.rows(texts))
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, of, self.all_logits(w, self.gates))
        return _sigmoid(np.clip(self.scale * out + self.shift, -60, 60))


def windows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, their text): each text in windows of WIDTH words, a step of STRIDE apart, the last filled up with padding."""
    counts = np.array([1 + max(0, -(-(len(r) - WIDTH) // STRIDE)) for r in rows])
    out = np.zeros((counts.sum(), WIDTH), np.int64)
    at = 0
    for r, k in zip(rows, counts.tolist()):
        padded = np.zeros((k - 1) * STRIDE + WIDTH, np.int64)
        padded[: len(r)] = r
        out[at : at + k] = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STRIDE]
        at += k
    return out, np.repeat(np.arange(len(rows)), counts)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """A network from labelled texts; a fifth of them only sets the scale and the threshold."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, "f4")
    counts = Counter(n for t in texts for n in {normal(w) for w in t.split()})
    net = Network([w for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if c > 2], seed)
    rows = net.rows(texts, gates=False)
    order = rng.permutation(len(texts))
    check, fit = order[: len(order) // 5], order[len(order) // 5 :]
    good, bad = fit[y[fit] == 0], fit[y[fit] == 1]
    if not len(good) or not len(bad):
        net.scale, net.shift = 0.0, float(np.log((y.mean() * len(y) + 0.5) / ((1 - y.mean()) * len(y) + 0.5))) if len(y) else 0.0
        net.clear()
        return net
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}

    ids = net.ids(net.words)

    def made(used, hide):
        own = trigrams([net.words[i] for i in used])
        # some words go without their own vector, so that characters are learned too
        word = np.where(hide, 0, ids[used])
        x = net.vectors(word, *own)
        out = {k: x @ net.p[f"X{k}"] + net.p[f"B{k}"] for k in "fb"}
        for k in "fb":
            out[k][0] = net._padding()
        return word, own, x, out

    for step in range(STEPS):
        docs = np.concatenate([rng.choice(good, TEXTS // 2), rng.choice(bad, TEXTS // 2)])
        w, of = windows([rows[i] for i in docs])
        warm = step < STEPS // 5
        if warm:
            own = np.sort(rng.permutation(len(w))[:DRAWN])
            w, of = w[own], of[own]
        used, inverse = np.unique(w, return_inverse=True)
        w = inverse.reshape(w.shape) + (0 if used[0] == 0 else 1)
        if used[0] != 0:
            used = np.concatenate([[0], used])
        word, (flat, begin), x, gates = made(used, rng.random(len(used)) < HIDDEN_WORDS)
        if not warm:
            at = np.lexsort((-net.all_logits(w, gates), of))
            rank = np.arange(len(at)) - np.searchsorted(of[at], of[at])
            own = at[rank < 2]
            w, of = w[own], of[own]
        keep: dict = {}
        z = net.logits(w, gates, keep)
        target = y[docs][of]
        d = ((_sigmoid(z) - target) / len(z)).astype("f4")
        g, dg = net.gradients(w, keep, d)
        dx = np.zeros_like(x)
        for k in "fb":
            row = added(len(used), w.reshape(-1), dg[k])
            row[0] = 0
            g[f"X{k}"], g[f"B{k}"] = x.T @ row, row.sum(0)
            dx += row @ net.p[f"X{k}"].T
        g["W"] = added(len(net.p["W"]), word, dx[:, :WORD_SIZE])
        g["W"][0] = 0
        sizes = np.diff(begin, append=len(flat))
        g["C"] = added(TRIGRAMS, flat, np.repeat(dx[:, WORD_SIZE:] / sizes[:, None], sizes, axis=0))
        rate = RATE * (1 - step / STEPS) + 1e-4
        for k, grad in g.items():
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            net.p[k] -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)).astype("f4")
    net.clear()
    _calibrate(net, [texts[i] for i in check], y[check])
    return net


def _calibrate(net: Network, texts: list[str], y: np.ndarray) -> None:
    """Puts THRESHOLD at the logit that splits the checked texts best, midway in the gap there."""
    if not len(texts):
        return
    w, of = windows(net.rows(texts))
    z = np.full(len(texts), -np.inf)
    np.maximum.at(z, of, net.all_logits(w, net.gates))
    net.clear()
    cuts = np.unique(z)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    wrong = np.array([(y[z < c] == 1).sum() + (y[z >= c] == 0).sum() for c in cuts])
    best = np.flatnonzero(wrong == wrong.min())
    gap = np.diff(np.concatenate([cuts[:1], np.unique(z), cuts[-1:]]))
    cut = float(cuts[best[np.argmax(gap[np.minimum(best, len(gap) - 1)])]])
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - net.scale * cut


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, size_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """At most `size` labelled texts of `size_bytes` outside the held-out third, at most half of them toxic, the least by a hash of doc_id.

    Where rows share a doc_id the least text counts, where labels do any toxic one; so the sample is the same in each run.
    """
    doc = F.col("doc_id").cast("string")
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(doc) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = [known.where(f"toxic {c} 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size // 2) for c in ("<>", "=")]
    chosen = pick[0].union(pick[1])
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    drawn = written(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    sizes = drawn.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()  # at most `size` rows
    sizes.sort(key=lambda r: (r["h"], r["doc_id"]))
    kept, room = [], size_bytes
    for r in sizes:  # a text that does not fit is passed over
        if r["n"] <= room:
            kept.append(r["doc_id"])
            room -= r["n"]
    rows = (drawn if len(kept) == len(sizes) else drawn.where(F.col("doc_id").isin(kept))).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [int(r["toxic"] != 0) for r in rows]


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    return train(*sample(docs, labels))


def scored(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """All columns, and one called `name`: the score of every whole text. A null or empty text has the score of a window without words."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        net = model.value
        for batch in batches:
            out, own, size = [], [], 0
            for text in batch.column("text").to_pylist():
                own.append(text or "")
                size += len(own[-1])
                if size > 400_000:
                    out.append(net.score(own))
                    own, size = [], 0
            if own:
                out.append(net.score(own))
            score = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), score], [*names, name])
        net.clear()  # a worker keeps nothing for its next task

    schema = docs.schema.fromJson(docs.schema.jsonValue()).add(name, "double")
    return arrow_map(docs, run, schema)


def rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (columns doc_id, text; others are ignored).

    A null doc_id is not held out; repeated rows are scored each. Without labelled texts of both kinds every score is
    the smoothed share of toxic labels (a half if there are none).
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return scored(docs, fit(docs, labels), name).where(F.col(name) < THRESHOLD).drop(name)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
