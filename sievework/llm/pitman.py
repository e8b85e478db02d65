"""Language model scoring: a hierarchical Pitman-Yor model of words, seated by Gibbs sampling.

A token is drawn in the restaurant of its context, the word before it (a text's first token has the end before it). All these restaurants
share one parent, that of the words alone, whose parent spells: restaurants of two bytes of context over those of one, over that of none,
over equal chances. A table of a restaurant is a customer of its parent. Discounts are 1/2, for which the number of seatings of c customers
at t tables has a closed form; so a dish's number of tables is drawn from its exact conditional distribution, however many customers it has.
Dishes are drawn side by side, each given the other dishes' tables of the sweep before; draws come from hashes of word, context and sweep,
so that a task that runs again seats as before.

Texts are read twice, for the words and for the pairs of words. Pairs are dealt to buckets by their context (those of the at most HEAVY
most frequent contexts by their word), and stay there as packed arrays. Pairs seen once have one table always, so a sweep passes over the
repeated ones: tasks read the parents' values of frequent words, those of all others come to the buckets that want them by a join, and
a pass over the words sums up what pairs send to them. A bucket answers each block of pairs with probabilities, which meet the
texts' tokens by chunk.
"""

from __future__ import annotations

import contextlib
import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, remove, remove_table, shared_path, store, table, written
from .jaccard import _texts
from .quality import Lookup
from .words import U, hashed, mix

STRENGTH, DISCOUNT = 1.0, 0.5
#: Sweeps that are thrown away, and those whose predictive probabilities are averaged.
BURN_IN, SAMPLES = 2, 3
#: Words of largest count whose values tasks hold; the tokens of all others meet theirs in a join.
FREQUENT = 250_000
#: Contexts of more than one in so many tokens are dealt over all buckets; what their restaurants hold is a number each that all tasks know.
HEAVY = 1024
#: Tokens of training in a bucket, tokens of a chunk of texts, bytes of text that are cut into words at once.
BUCKET, CHUNK, CUT = 1 << 20, 1 << 20, 1 << 19
#: Bytes of a row's data at most, and of a batch of rows: the JVM holds rows, pages of files and batches whole, outside its heap too.
PIECE, BATCH = 1 << 18, 1 << 20
#: One in so many documents, by checksum, is held out.
FOLDS, HELD_OUT = 7, 2
#: The end of a text is a token: the word without letters, which a blank ends as it ends all.
END, _STOP = "", 0x20
#: Set in all hashes of words, so that the numbers of frequent words are none.
_HASH = 1 << 63
END_HASH = 0x5851F42D4C957F2D | _HASH


def tokens(texts: list[bytes]):
    """(hash, hash of the word before, text, start, end) of each token, the end of each text included; places are bytes in the joined lower-case texts, last."""
    h, text, start, end = hashed(texts)
    data = b" ".join(t.lower() for t in texts) + b" "
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1].astype(np.int64)
    start, end = start + begin[text], end + begin[text]
    # an end token after the words of each text
    cut = np.searchsorted(text, np.arange(len(texts)), "right")
    h = np.insert(h | U(_HASH), cut, U(END_HASH))
    start, end, text = np.insert(start, cut, 0), np.insert(end, cut, 0), np.insert(text, cut, np.arange(len(texts)))
    return h, np.concatenate([[U(END_HASH)], h[:-1]]), text, start, end, data


def _cuts(batches, *columns: str):
    """_texts, about CUT bytes at a time."""
    rows, texts, size = [], [], 0
    for r, t in _texts(batches, *columns):
        rows += r
        texts += t
        size += sum(map(len, t))
        if size > CUT:
            yield rows, texts
            rows, texts, size = [], [], 0
    if texts:
        yield rows, texts


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different values in the order of their first places, number of the value of each)."""
    import pyarrow as pa

    e = pa.array(x).dictionary_encode()
    return np.asarray(e.dictionary), np.asarray(e.indices)


def firsts(at: np.ndarray, n: int) -> np.ndarray:
    """The first place of each number."""
    out = np.empty(n, np.int64)
    out[at[::-1]] = np.arange(len(at) - 1, -1, -1)
    return out


def counted(docs: DataFrame) -> DataFrame:
    """h, word, c: each word of the texts and its count."""

    def run(batches):
        import pyarrow as pa

        def merged():
            h, n = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            u, at = coded(h)
            word = pa.concat_arrays([x[2] for x in parts]).take(pa.array(firsts(at, len(u)))).cast(pa.string())
            n = np.bincount(at, n, len(u)).astype(np.int64)
            for a in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[a : a + 100_000].view("i8")), word[a : a + 100_000], pa.array(n[a : a + 100_000])], ["h", "word", "n"])

        parts, size = [], 0
        for _, texts in _cuts(batches):
            h, _, _, start, end, data = tokens(texts)
            u, at = coded(h)
            first = firsts(at, len(u))
            parts.append((u, np.bincount(at, minlength=len(u)), pa.array([data[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())], pa.binary())))
            size += len(u)
            if size > 500_000:
                yield from merged()
                parts, size = [], 0
        if parts:
            yield from merged()

    return arrow_map(docs.select("text"), run, "h long, word string, n long").groupBy("h", "word").agg(F.sum("n").alias("c"))


def uniform(h: np.ndarray, salt: np.ndarray | int, sweep: int) -> np.ndarray:
    x = mix(h + mix(np.atleast_1d(salt).astype(np.uint64) + U(sweep * 1_000_003 + 7)))
    return ((x >> U(11)).astype("f8") + 0.5) / (1 << 53)


def seat(c: np.ndarray, p: np.ndarray, other: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Tables of dishes of c customers, drawn from P(t) ~ S(c, t) p^t (STRENGTH + other/2)(STRENGTH + (other + 1)/2)...

    p: the parent's probability of the dish; other: the restaurant's tables of other dishes; u: a uniform number each. The ratio of
    neighbours falls with t, so the mode is found by bisection, and the weights are summed from there outward, twice.
    """
    out = np.ones(len(c), np.int64)
    # few customers: all weights are added up
    k = np.flatnonzero((c > 1) & (c <= 16))
    if len(k):
        n, q, o, weights = c[k].astype("f8"), p[k].astype("f8"), other[k].astype("f8"), [np.ones(len(k))]
        order = np.argsort(-c[k], kind="stable")
        k, n, q, o = k[order], n[order], q[order], o[order]
        total = np.ones(len(k))
        for t in range(1, int(n[0])):
            m = np.searchsorted(-n, -t, "left")  # the dishes of more customers than t
            w = weights[-1][:m] * (4 * (n[:m] - t) / (t * (2 * n[:m] - t - 1)) * q[:m] * (STRENGTH + DISCOUNT * (o[:m] + t)))
            weights.append(w)
            total[:m] += w
        left, t = u[k] * total, np.ones(len(k), np.int64)
        for w, w2 in zip(weights[:-1], weights[1:]):
            left = left[: len(w2)] - w[: len(w2)]
            t[: len(w2)] += left > 0
        out[k] = t
    own = np.flatnonzero(c > 16)
    if not len(own):
        return out
    c, p, other, u = c[own].astype("f8"), p[own], other[own].astype("f8"), u[own]
    ratio = lambda t, k: 4 * (c[k] - t) / (t * (2 * c[k] - t - 1)) * p[k] * (STRENGTH + DISCOUNT * (other[k] + t))
    everything = np.arange(len(own))
    lo, hi = np.ones(len(own)), c.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = np.floor((lo[open_] + hi[open_]) / 2)
        falls = ratio(mid, open_) < 1
        hi[open_[falls]] = mid[falls]
        lo[open_[~falls]] = mid[~falls] + 1
    mode = lo

    def outward(limit):
        """Sums of the weights until `limit` is reached, and where."""
        total, at = np.ones(len(own)), mode.copy()
        live = everything[total < limit]
        for step in (1, -1):
            k, t, w = live, mode[live], np.ones(len(live))
            while True:
                go = (t < c[k]) if step > 0 else (t > 1)
                k, t, w = k[go], t[go], w[go]
                if not len(k):
                    break
                w = w * ratio(t, k) if step > 0 else w / ratio(t - 1, k)
                t = t + step
                total[k] += w
                at[k] = t
                go = (w > 1e-12) & (total[k] < limit[k])
                k, t, w = k[go], t[go], w[go]
            live = live[total[live] < limit[live]]
        return total, at

    total, _ = outward(np.full(len(own), np.inf))
    out[own] = outward(u * total)[1].astype(np.int64)
    return out


class Spelling:
    """Restaurants of bytes: the probability of a word's bytes and the blank that ends it."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, before: "Spelling | None", sweep: int):
        """One Gibbs sweep given the customers: keys are byte triples in order, counts how often tables of words sent them."""
        c, k = counts, keys
        levels = []
        for depth in (2, 1, 0):
            levels.append((k, c))
            room, dish = k >> 8, k
            p = before.probability(k, depth - 1) if before else np.full(len(k), 1 / 256)
            t = before.tables(depth, k, c) if before else np.ones(len(k), np.int64)
            whole = np.bincount(room, t, 1 << 8 * depth)[room]
            t = seat(c, p, whole - t, uniform(dish.astype(np.uint64), depth, sweep))
            levels[-1] += (t,)
            k, at = np.unique(k & ((1 << 8 * depth) - 1), return_inverse=True)
            c = np.bincount(at, t, len(k)).astype(np.int64)
        self.levels = levels[::-1]
        # own part of each cell, and what its restaurant leaves to the parent
        self.own, self.left = [], []
        for depth, (k, c, t) in enumerate(self.levels):
            n = np.bincount(k >> 8, c, 1 << 8 * depth)
            self.own.append((c - DISCOUNT * t) / (STRENGTH + n[k >> 8]))
            self.left.append((STRENGTH + DISCOUNT * np.bincount(k >> 8, t, 1 << 8 * depth)) / (STRENGTH + n))

    def tables(self, depth: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        have, _, t = self.levels[depth]
        at = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
        return np.minimum(np.where(have[at] == keys, t[at], 1), counts) if len(have) else np.ones(len(keys), np.int64)

    def probability(self, key: np.ndarray, depth: int = 2) -> np.ndarray:
        """Of the last byte of each key after the `depth` bytes before it; depth -1: equal chances."""
        p = np.full(len(key), 1 / 256)
        for d in range(depth + 1):
            k = key & ((1 << 8 * (d + 1)) - 1)
            have = self.levels[d][0]
            at = np.minimum(np.searchsorted(have, k), max(len(have) - 1, 0))
            own = np.where(have[at] == k, self.own[d][at], 0.0) if len(have) else 0.0
            p = own + self.left[d][k >> 8] * p
        return p


def triples(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the different byte triples of the words and the blanks that end them, number of each triple in turn, its word)."""
    import pyarrow as pa

    column = column.cast(pa.binary())
    size = np.diff(place := np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1]).astype(np.int64) + 1
    of = np.repeat(np.arange(len(size)), size)
    b, letters = np.full(len(of), _STOP, np.int64), np.ones(len(of), bool)
    letters[np.cumsum(size) - 1] = False
    if letters.any():
        b[letters] = np.frombuffer(column.buffers()[2], "u1")[place[0] : place[-1]]
    at = np.arange(len(b)) - np.repeat(np.cumsum(size) - size, size)
    back = lambda k: np.where(at >= k, np.roll(b, k), _STOP)
    return *coded(back(2) << 16 | back(1) << 8 | b), of


def spelled(models: list[Spelling], n: int, key: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The probability of each of n words under each model, from their triples."""
    return np.stack([np.exp(np.bincount(of, np.log(m.probability(key))[at], n)) for m in models], 1) if n else np.zeros((n, len(models)))


def cut_off(values: DataFrame, most: int) -> int:
    """A count that no more than `most` words reach: the least such one, above 1,024 the least power of two. At most 1,086 bands are collected."""
    bands = values.groupBy(F.when(F.col("c") < 1024, F.col("c")).otherwise(F.expr("shiftleft(1L, length(bin(c)) - 1)")).alias("least")).agg(F.count("*").alias("k")).orderBy(F.desc("least")).collect()
    least = 1 << 62
    for r in bands:
        most -= r["k"]
        if most < 0:
            break
        least = r["least"]
    return least


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in few bytes: their first bytes, then their second and so on, compressed."""
    import pyarrow as pa

    kinds, out = [], []
    for a in arrays:
        kind = a.dtype.str
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(a.max()))
        kinds.append((kind, a.dtype.str, len(a)))
        out.append(np.ascontiguousarray(a).view("u1").reshape(len(a), a.dtype.itemsize).T.tobytes())
    raw = b"".join(out)
    return pickle.dumps((kinds, len(raw), pa.Codec("zstd", 1).compress(raw, asbytes=True)))


def unpack(data: bytes) -> list[np.ndarray]:
    import pyarrow as pa

    kinds, size, packed = pickle.loads(data)
    raw, out = np.frombuffer(pa.Codec("zstd").decompress(packed, size, asbytes=True) if size else b"", "u1"), []
    for kind, narrow, n in kinds:
        width = np.dtype(narrow).itemsize
        out.append(np.ascontiguousarray(raw[: n * width].reshape(width, n).T).view(narrow).ravel().astype(kind))
        raw = raw[n * width :]
    return out


def split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys as numbers of 4 bytes, and the hashes of those that have none."""
    few = key < U(1 << 24)
    return np.where(few, key, U(1 << 24)).astype("u4"), key[~few]


def joined(number: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = number.astype("u8")
    out[number == 1 << 24] = h
    return out


def read_columns(path: str, *columns: str) -> list[np.ndarray]:
    """Columns of numbers of a written table, for use on executors."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    fs, where = store(path)
    found = [[] for _ in columns]
    for name in sorted(i.path for i in fs.get_file_info(FileSelector(where)) if i.path.endswith(".parquet")):
        with fs.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(50_000, columns=list(columns), use_threads=False):
                for all_, c in zip(found, columns):
                    all_.append(np.array(batch.column(c)))
    return [np.concatenate(x) if x else np.zeros(0) for x in found]


class Frequent:
    """The words of largest count, numbered from 0. A word's key is its number, or else its hash."""

    def __init__(self, path: str):
        h, c = read_columns(path, "h", "c")
        h, c = h.astype("i8").view("u8"), c.astype("i8")
        order = np.lexsort((h, -c))
        self.h, self.c = h[order], c[order]
        self.find = Lookup(self.h, np.arange(len(h)))

    def keys(self, h: np.ndarray) -> np.ndarray:
        at, hit = self.find(h)
        return np.where(hit, at.astype("u8"), h)

    def hashes(self, key: np.ndarray) -> np.ndarray:
        few = key < U(1 << 24)
        out = key.copy()
        out[few] = self.h[key[few].astype(np.int64)]
        return out

    def heavy(self, key: np.ndarray, limit: float) -> np.ndarray:
        """Whether the contexts are dealt over all buckets: those of more than `limit` tokens."""
        few = key < U(1 << 24)
        out = np.zeros(len(key), bool)
        out[few] = self.c[key[few].astype(np.int64)] > limit
        return out

    def values(self, path: str, columns: tuple) -> np.ndarray:
        """Columns of a written table by word; 0 where it has none."""
        names, *cells = read_columns(path, "h", *columns)
        at, hit = self.find(names.astype("i8").view("u8"))
        out = np.zeros((len(columns), len(self.h) + 1))
        for k, cell in enumerate(cells):
            out[k, at[hit]] = cell[hit]
        return out


def looked_up(key: np.ndarray, dense: np.ndarray, rows, columns: tuple) -> np.ndarray:
    """The columns for each key: from `dense` by number, or from the rows by hash; 0 where there is none."""
    few = key < U(1 << 24)
    out = dense[:, np.where(few, key, U(0)).astype(np.int64)]
    rare = np.flatnonzero(~few)
    out[:, rare] = 0
    if len(rows) and len(rare):
        h = np.asarray(rows.column("h")).view("u8")
        order = np.argsort(h)
        h = h[order]
        place = np.minimum(np.searchsorted(h, key[rare]), len(h) - 1)
        found = h[place] == key[rare]
        for k, c in enumerate(columns):
            out[k, rare[found]] = np.asarray(rows.column(c))[order][place[found]]
    return out


#: kind 0: the pairs of a bucket; 1: which of them a block (key: its chunk) has; 2: its repeated pairs; 3, 4: words (key) whose values it wants, for
#: repeated and for other pairs; 5: customers that sit at a table of others, by word (key); 6: the same by heavy context; 7: a chunk's texts; 8: a block.
#: Data stands in pieces, numbered by value.
PARTS = "kind int, bucket int, key long, value long, data binary"


def _rows(kind, bucket=None, key=None, value=None, data=None):
    """Batches of PARTS; the arguments are arrays, lists, one number or None."""
    import pyarrow as pa

    n = len(next(x for x in (key, data) if x is not None))
    cols = []
    for x, t in ((kind, pa.int32()), (bucket, pa.int32()), (key, pa.int64()), (value, pa.int64()), (data, pa.binary())):
        if isinstance(x, np.ndarray) and x.dtype == np.uint64:
            x = x.view("i8")
        cols.append(pa.nulls(n, t) if x is None else pa.array(np.full(n, x), t) if np.isscalar(x) else pa.array(x, t))
    batch = pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PARTS.split(", ")])
    step = 1 if data is not None else 50_000
    for a in range(0, n, step):
        yield batch.slice(a, step)


def pieces(kind: int, bucket: int, key: int | None, data: bytes):
    """_rows of the data, at most PIECE of it each."""
    for k, a in enumerate(range(0, len(data), PIECE)):
        yield from _rows(kind, bucket, [key], [k], [data[a : a + PIECE]])


def whole(rows, by: str = "key"):
    """(value of `by`, unpacked data) in its order, of a table of pieces."""
    of, number = (np.asarray(rows.column(c).fill_null(-1)) for c in (by, "value"))
    column, held = rows.column("data"), []
    order = np.lexsort((number, of))
    for i, last in zip(order.tolist(), np.append(np.diff(of[order]) != 0, True).tolist()):
        held.append(column[i].as_buffer())
        if last:
            yield int(of[i]), unpack(b"".join(held))
            held = []


def grouped(df: DataFrame, by: str, parts: int | None) -> DataFrame:
    """Rows of one value of `by` after one another, in one task."""
    return (df.repartition(parts, by) if parts else df.repartition(by)).sortWithinPartitions(by)


def groups(batches, by: str):
    """(value, its rows as a table) of rows in order of `by`."""
    import pyarrow as pa

    now, held = None, []
    for batch in batches:
        v = np.asarray(batch.column(by))
        edge = [0, *(np.flatnonzero(np.diff(v)) + 1).tolist(), len(v)]
        for a, b in zip(edge[:-1], edge[1:]):
            if a == b:
                continue
            if held and v[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(v[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def chunks(docs: DataFrame, path: str, buckets: int, limit: float, under: int) -> DataFrame:
    """PARTS 7 and 8: texts as places in their chunk's pairs, and the chunk's pairs with their counts in training, by bucket."""

    def run(batches):
        from pyspark import TaskContext

        frequent, held, size = Frequent(path), [], 0
        chunk = TaskContext.get().partitionId() << 32

        def flush():
            word, at = coded(np.concatenate([x[1] for x in held]))
            sizes = np.concatenate([x[2] for x in held])
            ids = [r for x in held for r in x[0]]
            held.clear()
            out = np.array([r[1] for r in ids], bool)
            key = frequent.keys(word)
            rank = np.empty(len(key), "i4")
            order = np.argsort(key)
            rank[order] = np.arange(len(key))
            key, word, at = key[order], word[order], rank[at]
            end = np.searchsorted(key, frequent.keys(np.array([END_HASH], "u8")))[0]
            bits = int(len(key)).bit_length()
            # the word before, and the word
            pair, shift = np.concatenate([[end], at[:-1]]).astype(np.int64), int(len(at)).bit_length()
            pair <<= bits
            pair |= at
            if 2 * bits + shift < 64:  # pair and place in one number sort much faster than places do
                pair <<= shift
                pair |= np.arange(len(at))
                pair.sort()
                order = (pair & ((1 << shift) - 1)).astype("u4")
                pair >>= shift
            else:
                order = np.argsort(pair)
                pair = pair[order]
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            place = np.empty(len(at), "u4")
            place[order] = np.cumsum(new, dtype="u4") - np.uint32(1)
            pair = pair[new]
            u, w = (pair >> bits).astype("i4"), (pair & ((1 << bits) - 1)).astype("i4")
            del pair, order, new
            own = (mix(word) % U(buckets)).astype("i4")
            bucket = np.where(frequent.heavy(key, limit)[u], own[w], own[u])
            order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
            rank = np.empty(len(u), "u4")
            rank[order] = np.arange(len(u), dtype="u4")
            place, u, w, bucket = rank[place], u[order], w[order], bucket[order]
            del rank, order
            n = np.bincount(place[np.repeat(~out, sizes)], minlength=len(u)).astype("u4")
            # the base score of frequent words is known here
            few = key < U(1 << 24)
            count = np.zeros(len(key))
            count[few] = frequent.c[key[few].astype(np.int64)]
            text = np.repeat(np.arange(len(sizes)), sizes)
            base = np.bincount(text, np.where(few, np.log10((count + 1) / under), 0)[at], len(sizes))
            known = np.bincount(text, few[at], len(sizes)).astype("i8")
            del text, at
            doc = np.array([r[0] or 0 for r in ids], "i8")
            none = np.array([r[0] is None for r in ids], "u1")
            yield from pieces(7, -1, chunk, pack(doc, none, out.astype("u1"), sizes.astype("i8"), base, known, place))
            del place
            edge = np.flatnonzero(np.diff(np.concatenate([[-1], bucket, [-1]])))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                yield from pieces(8, int(bucket[a]), chunk, pack(n[a:b], *split(key[u[a:b]]), *split(key[w[a:b]])))

        for rows, texts in _cuts(batches, "doc_id", "held_out"):
            h, _, text, *_ = tokens(texts)
            held.append((rows, h, np.bincount(text, minlength=len(texts))))
            size += len(h)
            if size > CHUNK:
                yield from flush()
                size, chunk = 0, chunk + 1
        if held:
            yield from flush()

    return arrow_map(docs.select("doc_id", "held_out", "text"), run, PARTS)


def _runs(u: np.ndarray):
    """(where each run of equal values starts, run of each row)."""
    new = np.concatenate([[True], u[1:] != u[:-1]])[: len(u)]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Sent:
    """What a task's pairs keep from the words: customers less tables, by word and by heavy context."""

    def __init__(self, frequent: Frequent, limit: float):
        self.frequent, self.limit = frequent, limit
        self.few, self.rare, self.heavy = np.zeros(len(frequent.h), np.int64), [], {}

    def add(self, u, w, less):
        few = w < U(1 << 24)
        self.few += np.bincount(w[few].astype(np.int64), less[few], len(self.few)).astype(np.int64)
        k, at = np.unique(w[~few], return_inverse=True)
        self.rare.append((k, np.bincount(at.ravel(), less[~few], len(k)).astype(np.int64)))
        heavy = self.frequent.heavy(u, self.limit)
        k, at = np.unique(u[heavy], return_inverse=True)
        for key, v in zip(k.tolist(), np.bincount(at.ravel(), less[heavy], len(k)).astype(np.int64).tolist()):
            self.heavy[key] = self.heavy.get(key, 0) + v

    def rows(self):
        own = np.flatnonzero(self.few)
        for k, v in [(self.frequent.h[own], self.few[own]), *self.rare]:
            k, v = k[v > 0], v[v > 0]
            if len(k):
                yield from _rows(5, None, k, v)
        if self.heavy:
            yield from _rows(6, None, np.array(list(self.heavy), "i8"), np.array(list(self.heavy.values()), "i8"))


def ordered(numbers: list[np.ndarray], hashes: list[np.ndarray]):
    """Split keys, put together, as numbers of less than 32 bits in the order of the keys; and the hashes that those from 2**24 on stand for."""
    out, h = np.concatenate(numbers).astype(np.int64), np.concatenate(hashes)
    u, at = coded(h)
    order = np.argsort(u)
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    out[out == 1 << 24] += rank[at]
    return out, u[order]


def keyed(number: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = number.astype("u8")
    rare = number >= 1 << 24
    out[rare] = hashes[number[rare] - (1 << 24)]
    return out


def built(blocks: DataFrame, path: str, parts: int, limit: float) -> DataFrame:
    """PARTS 0 to 6 of the blocks: each repeated pair has one table yet."""

    def run(batches):
        frequent = Frequent(path)
        sent = Sent(frequent, limit)
        for bucket, rows in groups(batches, "bucket"):
            keys, data = zip(*whole(rows))
            del rows
            n, sizes = np.concatenate([x[0] for x in data]), [len(x[0]) for x in data]
            # numbers in the order of the keys: a frequent word's own, and after them those of the others
            (u, us), (w, ws) = (ordered([x[k] for x in data], [x[k + 1] for x in data]) for k in (1, 3))
            del data
            pair = u << 32
            pair |= w
            del u, w
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            at = np.empty(len(pair), "u4")
            at[order] = np.cumsum(new, dtype="u4") - np.uint32(1)
            pair = pair[new]
            del order, new
            u, w, n = keyed(pair >> 32, us), keyed(pair & 0xFFFFFFFF, ws), np.bincount(at, n, len(pair)).astype("i8")
            del pair
            yield from pieces(0, bucket, None, pack(n, *split(u), *split(w)))
            a = 0
            for key, size in zip(keys, sizes):
                yield from pieces(1, bucket, key, pack(np.diff(at[a : a + size].astype(np.int64), prepend=0).astype("u4")))
                a += size
            del at
            start, of = _runs(u)
            total = np.bincount(of, n, len(start)).astype("i8")
            own = n > 1
            ru, rw, rn = u[own], w[own], n[own]
            yield from pieces(2, bucket, None, pack(rn, *split(ru), *split(rw), np.ones(len(rn), "i8"), total[of[own]][_runs(ru)[0]], np.zeros(len(rn))))
            often = np.unique(rw[rw >= U(1 << 24)])
            if len(often):
                yield from _rows(3, bucket, often)
            other = np.setdiff1d(w[w >= U(1 << 24)], often)
            if len(other):
                yield from _rows(4, bucket, other)
            sent.add(ru, rw, rn - 1)
        yield from sent.rows()

    return arrow_map(grouped(blocks, "bucket", parts), run, PARTS)


def _write(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """PARTS as files by kind. Their data is packed already; sizes of pages are looked at early, as by default one holds a hundred rows of any size."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.partitionBy("kind").options(**{"compression": "none", "parquet.page.size.row.check.min": 4, "parquet.block.size": 8 << 20}).parquet(path)
    return path, spark.read.schema("bucket int, key long, value long, data binary, kind int").parquet(path)


def messages(words: DataFrame, wanted: DataFrame, columns: tuple) -> DataFrame:
    """The words' values as rows (kind 9) for the buckets that want them."""
    return words.join(wanted.select("bucket", F.col("key").alias("h")), "h").select("bucket", F.lit(9).alias("kind"), "h", *columns)


def met(parts: DataFrame, values: DataFrame) -> DataFrame:
    return parts.select("bucket", "kind", "key", "value", "data").unionByName(values, allowMissingColumns=True)


def sat(rows: DataFrame, path: str, values: str, parts: int, limit: float, shared: dict, sweep: int) -> DataFrame:
    """One sweep over the repeated pairs: PARTS 2, 5 and 6. rows: PARTS 2 and the wanted words' customers, tables and spelling."""
    cast = rows.sparkSession.sparkContext.broadcast(shared)  # a number a heavy context

    def run(batches):
        frequent, now = Frequent(path), cast.value
        columns = ("customers", "root", "base")
        dense, sent = frequent.values(values, columns), Sent(frequent, limit)
        for bucket, t in groups(batches, "bucket"):
            kind = np.asarray(t.column("kind"))
            if not (kind == 2).any():
                continue
            ((_, (n, u, us, w, ws, tables, total, free, *less)),) = whole(t.filter(kind == 2))
            u, w = joined(u, us), joined(w, ws)
            customers, root, base = looked_up(w, dense, t.filter(kind == 9), columns)
            start, run_ = _runs(u)
            there = total - np.bincount(run_, n - tables, len(start))
            heavy = frequent.heavy(u[start], limit)
            there[heavy] = [frequent.c[k] - now["heavy"].get(k, 0) for k in u[start][heavy].astype(np.int64).tolist()]
            # the parent's probability without the dish's own tables
            without = customers - tables
            theirs = np.where(without > 0, without - DISCOUNT * np.minimum(root, without), 0.0)
            p = (theirs + (STRENGTH + DISCOUNT * now["tables"]) * base) / (STRENGTH + now["root"] - tables)
            tables = seat(n, p, there[run_] - tables, uniform(frequent.hashes(w), frequent.hashes(u), sweep))
            if sweep > BURN_IN:
                free = free + n - DISCOUNT * tables
                less.append(np.bincount(run_, n - tables, len(start)).astype("i8"))
            yield from pieces(2, bucket, None, pack(n, *split(u), *split(w), tables, total, free, *less))
            sent.add(u, w, n - tables)
        yield from sent.rows()

    return arrow_map(grouped(rows, "bucket", parts), run, PARTS)


WORDS = "h long, word string, c long, customers long, root long, base double, kept array<double>, kind int, key long, value long"


class Totals:
    """What restaurants share: tables and customers of the word restaurant (kind 1), byte triples (2)."""

    def __init__(self):
        self.root, self.tables, self.bytes = 0, 0, {}

    def add(self, customers, root, key, at, of):
        self.root, self.tables = self.root + int(customers.sum()), self.tables + int(root.sum())
        for k, v in zip(key.tolist(), np.bincount(at, root[of], len(key)).astype(np.int64).tolist()):
            self.bytes[k] = self.bytes.get(k, 0) + v

    def rows(self):
        yield from ((1, 0, self.tables), (1, 1, self.root))
        yield from ((2, k, v) for k, v in self.bytes.items() if v)


def _joined(batches, rows: int = 20_000):
    """Small batches put together."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lists(column, dtype):
    """(values, row of each) of a list column."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]].astype(dtype), np.repeat(np.arange(len(column)), np.diff(offsets))


def _listed(values, sizes):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4")), pa.array(values, pa.float64()))


def parents(words: DataFrame, shared: dict | None, sweep: int) -> DataFrame:
    """One sweep over the words (h, word, c, customers, root, kept): WORDS with new tables, and rows of the totals. Without `shared`
    each word has one table and no value yet; sweep 0 leaves it there."""
    cast = words.sparkSession.sparkContext.broadcast(shared)  # at most 2**24 byte triples

    def run(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in WORDS.split(", "))])
        totals, now = Totals(), cast.value
        for batch in _joined(batches):
            n = len(batch)
            h, customers, root = np.asarray(batch.column("h")).view("u8"), np.asarray(batch.column("customers")), np.asarray(batch.column("root"))
            key, at, of = triples(batch.column("word"))
            base = np.zeros(n) if now is None else spelled([now["spelling"]], n, key, at, of)[:, 0]
            kept, _ = _lists(batch.column("kept"), "f8")
            sizes = np.diff(np.asarray(batch.column("kept").offsets))
            if sweep:
                root = seat(customers, base, now["tables"] - root, uniform(h, 0, sweep))
            if sweep > BURN_IN:
                # a sample: what the word restaurant keeps for the dish
                kept, sizes = np.insert(kept, np.cumsum(sizes), customers - DISCOUNT * root), sizes + 1
            totals.add(customers, root, key, at, of)
            if now is not None:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h"), batch.column("word"), batch.column("c"), pa.array(customers), pa.array(root), pa.array(base), _listed(kept, sizes), *(pa.nulls(n, kinds[t]) for t in ("int", "long", "long"))],
                    schema=schema,
                )
        if totals.root:
            kind, key, value = (np.array(x, np.int64) for x in zip(*totals.rows()))
            for a in range(0, len(kind), 50_000):
                own = {"kind": pa.array(kind[a : a + 50_000].astype("i4")), "key": pa.array(key[a : a + 50_000]), "value": pa.array(value[a : a + 50_000])}
                yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(own["key"]), f.type)) for f in schema], schema=schema)

    return arrow_map(words.select("h", "word", "c", "customers", "root", "kept"), run, WORDS)


def gathered(state: DataFrame):
    """Sums of the totals, as arrays: their number is bounded by the byte triples."""
    rows = state.where("kind is not null").groupBy("kind", "key").agg(F.sum("value").alias("value")).toArrow()
    kind, key, value = (np.asarray(rows.column(c)) for c in ("kind", "key", "value"))
    one = dict(zip(key[kind == 1].tolist(), value[kind == 1].tolist()))
    order = np.argsort(key[kind == 2])
    return {"tables": one.get(0, 0), "root": one.get(1, 0), "keys": key[kind == 2][order], "counts": value[kind == 2][order]}


def together(a: dict, b: dict) -> dict:
    keys, at = np.unique(np.concatenate([a["keys"], b["keys"]]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([a["counts"], b["counts"]]), len(keys)).astype(np.int64)
    return {k: a[k] + b[k] for k in ("tables", "root")} | {"keys": keys, "counts": counts}


def heavies(parts: DataFrame) -> dict:
    """By heavy context, of which there are at most HEAVY, the customers that sit at a table of others."""
    return {r["key"]: r["v"] for r in parts.where("kind = 6").groupBy("key").agg(F.sum("value").alias("v")).collect()}


def trained(words: DataFrame, pairs: str, parts: DataFrame, path: str, least: int, tasks: int, limit: float):
    """(path and rows of the state, values: h, c and a root of every sample by word; unknown; heavies of every sample).

    Words that are not in training are one outcome, as for the base score; its roots are `unknown`, what all known words leave.
    """
    spark = words.sparkSession
    nothing = F.array().cast("array<double>")
    start = words.select("h", "word", "c", F.col("c").alias("customers"), F.lit(1).cast("long").alias("root"), nothing.alias("kept"))
    once, often = start.where("c = 1"), start.where("c > 1")
    fixed = gathered(parents(once, None, 0))
    spelling = None
    now = together(gathered(parents(often, None, 0)), fixed)
    wanted = parts.where("kind = 3")
    state, words_now, samples = parts, often, []
    columns = ("customers", "root", "base")
    for sweep in range(BURN_IN + SAMPLES + 1):
        spelling = Spelling(now["keys"], now["counts"], spelling, sweep)
        if sweep:
            values = shared_path(spark, "frequent")
            seen = words_now.where("kind is null")
            seen.where(F.col("c") >= least).select("h", *columns).write.parquet(values)
            shared = {k: now[k] for k in ("tables", "root")} | {"heavy": heavies(state)}
            rows = met(state.where("kind = 2"), messages(seen.where(F.col("c") < least), wanted, columns))
            where, after = _write(sat(rows, path, values, tasks, limit, shared, sweep), "seating")
            remove(spark, values)
            if sweep > 1:
                remove(spark, last)
            else:  # of the pairs of all, what the first sweep has replaced
                for kind in (2, 5, 6):
                    remove(spark, f"{pairs}/kind={kind}")
            last, state = where, after
        # customers of a word: a pair's that sit at a table of others send none
        less = state.where("kind = 5").groupBy("key").agg(F.sum("value").alias("less"))
        if sweep:
            words_now = words_now.where("kind is null")
        fed = words_now.select("h", "word", "c", "root", "kept").join(less, F.col("h") == F.col("key"), "left").withColumn("customers", F.col("c") - F.coalesce("less", F.lit(0)))
        after = written(parents(fed, {k: now[k] for k in ("tables", "root")} | {"spelling": spelling}, sweep), "words")
        if sweep:
            remove_table(words_now)
        words_now = after
        now = together(gathered(words_now), fixed)
        if sweep > BURN_IN:
            samples.append((spelling, now["tables"], now["root"], heavies(state)))
    cast = spark.sparkContext.broadcast(([s[0] for s in samples], np.array([s[1] for s in samples], "f8"), np.array([s[2] for s in samples], "f8")))

    def run(batches):
        import pyarrow as pa

        models, tables, root = cast.value
        for batch in _joined(batches):
            c = np.asarray(batch.column("c"))
            kept, _ = _lists(batch.column("kept"), "f8")
            keep = np.zeros((len(c), SAMPLES))
            keep[c == 1] = 1 - DISCOUNT
            keep[c > 1] = kept.reshape(-1, SAMPLES)
            roots = (keep + (STRENGTH + DISCOUNT * tables) * spelled(models, len(c), *triples(batch.column("word")))) / (STRENGTH + root)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), *map(pa.array, np.ascontiguousarray(roots.T))], ["h", "c", *ROOTS])

    remove(spark, f"{last}/kind=5")
    both = words_now.where("kind is null").select("h", "word", "c", "kept").unionByName(once.select("h", "word", "c", "kept"))
    values = written(arrow_map(both, run, f"h long, c long, {', '.join(f'{r} double' for r in ROOTS)}"), "values")
    remove_table(words_now)
    known = values.agg(*(F.coalesce(F.sum(r), F.lit(0.0)) for r in ROOTS)).first()
    return last, state.where("kind = 2"), values, np.maximum(1 - np.array(known), 1e-15), [s[3] for s in samples]


#: A word's probability in the restaurant of the words, by sample.
ROOTS = tuple(f"root{k}" for k in range(SAMPLES))


def rounded(x: np.ndarray) -> np.ndarray:
    """Doubles to 36 of their 52 bits (an error of 1e-11 of each), which takes 6 bytes when packed."""
    return ((x.view("u8") + U(1 << 15)) & ~U((1 << 16) - 1)).view("f8")


def answered(rows: DataFrame, path: str, values: str, tasks: int, limit: float, unknown: np.ndarray, heavy: list[dict]) -> DataFrame:
    """kind 9, bucket, key, data: of each block's pairs (key: its chunk) the log10 probability, and the count of words that are not frequent (frequent ones: -1)."""
    cast = rows.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        frequent = Frequent(path)
        columns = ("c", *ROOTS)
        dense = frequent.values(values, columns)
        for bucket, t in groups(batches, "bucket"):
            kind = np.asarray(t.column("kind"))
            ((_, (n, u, us, w, ws)),) = whole(t.filter(kind == 0))
            u, w = joined(u, us), joined(w, ws)
            ((_, (_, ru, us, _, _, _, _, free, *less)),) = whole(t.filter(kind == 2))
            ru = joined(ru, us)
            found = looked_up(w, dense, t.filter(kind == 9), columns)
            blocks = t.filter(kind == 1)
            del t
            start, run_ = _runs(u)
            total = np.bincount(run_, n, len(start))
            there = np.repeat(total[None], SAMPLES, 0)
            place = np.searchsorted(u[start], ru[_runs(ru)[0]])
            for k, x in enumerate(less):
                there[k, place] -= x
            big = np.flatnonzero(frequent.heavy(u[start], limit))
            for j, k in zip(big.tolist(), u[start][big].astype(np.int64).tolist()):
                total[j] = frequent.c[k]
                there[:, j] = [frequent.c[k] - x.get(k, 0) for x in cast.value]
            left = (STRENGTH + DISCOUNT * there) / (STRENGTH + total)
            own = np.where(n == 1, 1 - DISCOUNT, 0.0)
            own[n > 1] = free / SAMPLES
            p = own / (STRENGTH + total[run_])
            for k in range(SAMPLES):
                p += left[k, run_] * np.where(found[0] > 0, found[k + 1], unknown[k]) / SAMPLES
            p = rounded(np.log10(p))
            c = np.where(w < U(1 << 24), -1, found[0]).astype("i8")
            del found, u, w, run_, own
            for key, (at,) in whole(blocks):
                at = np.cumsum(at, dtype=np.int64)
                yield from pieces(9, bucket, key, pack(p[at], c[at]))

    return arrow_map(grouped(rows, "bucket", tasks), run, PARTS)


def scored(rows: DataFrame, under: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of the documents of chunks (PARTS 7) and the answers to their blocks (9)."""

    def run(batches):
        import pyarrow as pa

        for _, t in groups(batches, "key"):
            # the texts stand in bucket -1
            (_, (doc, none, out, sizes, base, known, place)), *answers = whole(t, "bucket")
            del t
            p, c = (np.concatenate([x[k] for _, x in answers]) for k in (0, 1))
            del answers
            text = np.repeat(np.arange(len(sizes)), sizes)
            rare = np.where(c >= 0, np.log10((np.maximum(c, 0) + 1) / under), 0.0)
            n = len(sizes)
            cols = [pa.array(doc, mask=none > 0), pa.array(out > 0), pa.array(sizes), pa.array(known + np.bincount(text, (c > 0)[place], n).astype("i8")), pa.array(base + np.bincount(text, rare[place], n)), pa.array(np.bincount(text, p[place], n))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return arrow_map(grouped(rows.select("bucket", "key", "value", "data"), "key", None), run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of a query go when it ends: each pass here writes its result to a table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def score(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (columns doc_id, text; others are ignored).

    score is the log10 probability of the text, a word that training lacks being one outcome for all such; perplexity is 10 ** (-score / n_tokens). Null and empty texts are an end token. A
    null doc_id counts as the empty text in the checksum, so it is trained on. Repeated rows are trained on and scored
    each. Words are told apart by 63-bit hashes, beside their own text where they are counted, pairs of a bucket by 64-bit hashes.
    """
    if frequent > 1 << 24:
        raise ValueError("tasks hold at most 2**24 frequent words")
    spark = docs.sparkSession
    bound_batches(spark, BATCH)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    with shuffles_dropped(spark):
        words = written(counted(docs.where(~F.col("held_out"))), "words")
        sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
        total, under = sums["total"], sums["total"] + sums["distinct"] + 1
        least = cut_off(words, frequent)
        path = shared_path(spark, "frequent")
        words.where(F.col("c") >= least).select("h", "c").write.parquet(path)
        buckets, limit = max(8, total // BUCKET), total / HEAVY
        tasks = max(8, buckets // 4)
        where, dealt = _write(chunks(docs, path, buckets, limit, under), "chunks")
        pairs, parts = _write(built(dealt.where("kind = 8"), path, tasks, limit), "pairs")
        remove(spark, f"{where}/kind=8")
        seats, state, values, unknown, heavy = trained(words, pairs, parts, path, least, tasks, limit)
        remove_table(words)
        few = shared_path(spark, "frequent")
        columns = ("c", *ROOTS)
        values.where(F.col("c") >= least).select("h", *columns).write.parquet(few)
        own = parts.where("kind in (0, 1)").unionByName(state)
        told = written(messages(values.where(F.col("c") < least), parts.where("kind in (3, 4)"), columns), "told")
        remove_table(values)
        for kind in (3, 4):
            remove(spark, f"{pairs}/kind={kind}")
        rows = met(own, told)
        _, answers = _write(answered(rows, path, few, tasks, limit, unknown, heavy), "answers")
        for done in (pairs, seats, few, path):
            remove(spark, done)
        remove_table(told)
    out = scored(dealt.where("kind = 7").unionByName(answers), under)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
