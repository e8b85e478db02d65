"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept only at minimisers: a word position whose GRAM-word hash is the least of SPAN successive ones. Equal
passages keep equal positions, and each stretch of LEAST words has one in its first SPAN words, so that at least
KEY = LEAST - SPAN words of it follow. Two passes over the texts:

1. the first KEY words of each kept suffix, as one hash: those that start suffixes of different texts go into a filter;
2. suffixes that pass it are sorted by the LEAST words from them on, with the common length of neighbours. Where the common
   length of a run of neighbours and the words that they are extended by to the left, SPAN at most, add up to LEAST, a
   stretch of LEAST words is found. Longer passages keep a suffix in each SPAN words, so their stretches overlap and are
   joined, however long they are.

Only stretches that stand in different texts count: a text that repeats itself is no copy of another.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, written
from .jaccard import _texts
from .words import U, _BASE, hashed, mix, shingles

LEAST, SPAN, GRAM = 50, 24, 8
KEY = LEAST - SPAN
#: log2 of the filter's bits: 16 MB at most, however many suffixes repeat; a full filter only lets more pass.
FILTER = 27
SUFFIX = np.dtype([("key", "<u8"), ("text", "<i8"), ("pos", "<u4"), ("words", "<u4", (SPAN + LEAST,))])
#: Bytes of suffixes in a bucket, about; suffixes that are sorted at a time, but for those of one key.
BUCKET_BYTES, AT_ONCE = 8 << 20, 20_000
_END = np.uint32(0)


def kept(h: np.ndarray) -> np.ndarray:
    """Positions of the kept suffixes of a text's word hashes: the leftmost least GRAM-word hash of each SPAN of them."""
    g = shingles(h, GRAM)
    if len(h) < LEAST:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, SPAN)
    at = np.unique(view.argmin(1) + np.arange(len(view)))
    return at[at + KEY <= len(h)]


def name_of(h: np.ndarray) -> int:
    """A 64-bit name of a sequence of words."""
    with np.errstate(over="ignore"):
        x = np.arange(1, len(h) + 1, dtype=np.uint64) * U(_BASE)
        return int(mix(np.array([mix(h ^ mix(x)).sum(dtype=np.uint64) ^ U(len(h))], np.uint64)).view("i8")[0])


def _each(texts: list[bytes]):
    h, text, _, _ = hashed(texts)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [h[a:b] for a, b in zip(cut[:-1], cut[1:])]


def keys(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, text (its name), n (words); kind 1: text and key of each kept suffix."""

    def run(batches):
        import pyarrow as pa

        names = ["kind", "doc_id", "text", "n", "key"]
        seen: set[int] = set()
        for rows, held in _texts(batches, "doc_id"):
            ids, texts, sizes, found = [], [], [], []
            for (doc,), h in zip(rows, _each(held)):
                t = name_of(h)
                ids.append(doc)
                texts.append(t)
                sizes.append(len(h))
                if len(h) >= LEAST and t not in seen:  # copies in one task add nothing
                    if len(seen) < 1_000_000:
                        seen.add(t)
                    key = np.unique(shingles(h, KEY)[kept(h)])
                    found.append((np.full(len(key), t, np.int64), key.view("i8")))
            k = len(ids)
            none = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, "i4")), pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(sizes, pa.int64()), none(k)], names)
            if found:
                t, key = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), "i4")), none(len(t)), pa.array(t), none(len(t)), pa.array(key)], names)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "kind int, doc_id long, text long, n long, key long")


def _filter(made: DataFrame):
    """(bits of the keys that start suffixes of different texts, as a broadcast of at most 2**FILTER bits; how many suffixes have such keys)."""
    shared = made.where("kind = 1").groupBy("key").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.count("*").alias("k")).where("a <> b")
    shared = written(shared.select(F.shiftrightunsigned("key", 64 - FILTER).alias("bit"), "k"), "shared")
    words = shared.groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER - 6), np.uint64)
    out[words["word"].to_numpy("i8")] = words["bits"].to_numpy("i8").view("u8")
    return made.sparkSession.sparkContext.broadcast(out), shared.agg(F.sum("k")).first()[0] or 0


def suffixes(docs: DataFrame, bits, buckets: int) -> DataFrame:
    """Suffixes that pass the filter, with their context, dealt by key; a row is what one task has for one bucket."""

    def run(batches):
        import pyarrow as pa

        table_, seen, held, size = bits.value, set(), [], 0

        def dealt():
            e = np.concatenate(held)
            bucket = mix(e["key"]) % U(buckets)
            at = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[at], np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(full.astype("i4")), pa.array([e[at[cut[b] : cut[b + 1]]].tobytes() for b in full], pa.binary())], ["bucket", "entries"])

        for _, texts in _texts(batches):
            for h in _each(texts):
                at = kept(h)
                if not len(at):
                    continue
                key = shingles(h, KEY)[at]
                bit = key >> U(64 - FILTER)
                own = (table_[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) > 0
                if not own.any() or (t := name_of(h)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(t)
                e = np.zeros(int(own.sum()), SUFFIX)
                e["key"], e["text"], e["pos"] = key[own], t, at[own]
                # words beyond an end are a mark of their own, which agrees with nothing
                w = np.concatenate([np.full(SPAN, _END), (h >> U(32)).astype("<u4") | np.uint32(1), np.full(LEAST, _END)])
                e["words"] = np.lib.stride_tricks.sliding_window_view(w, SPAN + LEAST)[at[own]]
                held.append(e)
                size += len(e)
            if size > 40_000:
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()

    return arrow_map(docs.select("text"), run, "bucket int, entries binary")


def repeated(batches):
    """(text, s, e) of stretches of LEAST words or more that a suffix of another text shares, in words of the text."""
    import pyarrow as pa

    held = [np.frombuffer(x, SUFFIX) for batch in batches for x in batch.column("entries").to_pylist()]
    if not held:
        return
    e = np.concatenate(held)
    del held
    e = e[np.lexsort((e["pos"], e["text"], e["key"]))]
    e = e[np.concatenate([[True], (e["key"][1:] != e["key"][:-1]) | (e["text"][1:] != e["text"][:-1]) | (e["pos"][1:] != e["pos"][:-1])])]
    edge = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1], [True]]))
    e = e[np.repeat(np.diff(edge) > 1, np.diff(edge))]
    if not len(e):
        return
    # keys are independent: some at a time, so that the work on a bucket needs little beyond the bucket
    edge = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1], [True]]))
    cut = [0]
    for z in edge[1:].tolist():
        if z - cut[-1] >= AT_ONCE or z == len(e):
            cut.append(z)
    for x, y in zip(cut, cut[1:]):
        text, s, t = _stretches(e[x:y])
        if len(text):
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (s[1:] > t[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(text[first]), pa.array(s[first]), pa.array(np.maximum.reduceat(t, first))], ["text", "s", "e"])


def _stretches(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of what each suffix shares with another text, LEAST words or more around it; by text and place."""
    # the sorted array of suffixes, and how many words each shares with its neighbour before
    right = np.ascontiguousarray(e["words"][:, SPAN:])
    order = np.argsort(right.view(f"S{4 * LEAST}").ravel(), kind="stable")
    common = np.zeros(len(e), "u1")
    for at in range(1, len(e), AT_ONCE):
        x, y = right[order[at - 1 : at - 1 + AT_ONCE]], right[order[at : at + AT_ONCE]]
        alike = (x[: len(y)] == y) & (y != _END)
        common[at : at + len(y)] = np.where(alike.all(1), LEAST, alike.argmin(1))
    del right
    text, pos, before = e["text"][order], e["pos"][order], e["words"][:, :SPAN][order]
    least, most = np.full(len(e), SPAN + 1, "u1"), np.zeros(len(e), "u1")
    left = np.zeros(len(e), np.uint64)  # hash of the j words before
    for j in range(SPAN + 1):
        if j:
            left = mix(left * U(_BASE) + before[:, SPAN - j])
        # stretches of the array that share the words to the right; in each, suffixes that are extended alike by j words to the left
        stretch = np.cumsum(common < LEAST - j)
        own = np.flatnonzero(before[:, SPAN - j] != _END) if j else np.arange(len(e))
        if not len(own):
            continue
        at = own[np.lexsort((text[own], left[own], stretch[own]))]
        start = np.flatnonzero(np.concatenate([[True], (stretch[at][1:] != stretch[at][:-1]) | (left[at][1:] != left[at][:-1])]))
        end = np.concatenate([start[1:], [len(at)]])
        other = text[at[start]] != text[at[end - 1]]  # the least and the largest text of those that agree
        hit = at[np.repeat(other, end - start)]
        least[hit], most[hit] = np.minimum(least[hit], j), j
    # two stretches around one suffix start less than LEAST words apart: they are one
    hit = np.flatnonzero(least <= SPAN)
    s, t = pos[hit].astype("i8") - most[hit], pos[hit].astype("i8") - least[hit] + LEAST
    order = np.lexsort((s, text[hit]))
    return text[hit][order], s[order], t[order]


def _merged():
    """Sorted spans of one text, overlapping and touching ones joined."""
    return F.expr("""aggregate(array_sort(collect_list(struct(s, e))), cast(array() as array<struct<s:bigint,e:bigint>>),
        (acc, x) -> if(size(acc) > 0 and x.s <= acc[size(acc) - 1].e,
            concat(slice(acc, 1, size(acc) - 1), array(struct(acc[size(acc) - 1].s as s, greatest(acc[size(acc) - 1].e, x.e) as e))),
            concat(acc, array(struct(x.s as s, x.e as e)))))""")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, repeated_words, spans (array of s, e in words, by start) of each document with repeated stretches.

    A stretch is at least LEAST words long and stands in another text too, or the whole text of LEAST words or more has
    copies. Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. Null, empty and shorter texts repeat nothing; a null
    doc_id is kept; rows that repeat a doc_id are rows of their own, copies of each other if their words are equal.
    """
    made = written(keys(docs), "keys")
    own = made.where("kind = 0").select("doc_id", "text", "n")
    bits, shared = _filter(made)
    # a bucket does not grow with the data
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(shared) * SUFFIX.itemsize // BUCKET_BYTES))
    posted = suffixes(docs, bits, buckets).repartitionById(buckets, F.col("bucket"))
    parts = arrow_map(posted, repeated, "text long, s long, e long")
    copies = own.where(f"n >= {LEAST}").groupBy("text").agg(F.count("*").alias("k"), F.max("n").alias("e")).where("k > 1").select("text", F.lit(0).cast("long").alias("s"), "e")
    spans = parts.union(copies).groupBy("text").agg(_merged().alias("spans"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.e - x.s)
    return own.join(spans, "text").select("doc_id", F.col("n").alias("n_words"), total.alias("repeated_words"), "spans")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x.s.cast("string"), x.e.cast("string"))), ",")
    return out.select("doc_id", "n_words", "repeated_words", F.size("spans").cast("long").alias("n_spans"), text.alias("spans"))
