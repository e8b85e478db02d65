"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

An n-gram is a long of ORDER symbols of BITS bits; its suffixes and contexts are shifts and masks of it. Counts and
probabilities are tables, joined by n-gram (shards of a shuffle); a document's perplexity comes from the probabilities
of the n-grams that the corpus holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_path, small, store, table, written
from .jaccard import _texts
from .words import U

ORDER, BITS = 5, 12
#: Quantile, by language, of how far trusted texts that the model has not seen lie over their median; a text up to it is kept.
HIGH = 0.995
#: The log perplexity of a text of n characters spreads as the root of 1 + WIDEN / n: short texts vary more.
WIDEN = 600
#: One in so many trusted texts, by a hash of doc_id, sets the thresholds and is not trained on.
HELD_OUT = 5
#: Held-out texts of a language that weigh as much as those of all languages together.
ENOUGH = 50
#: N-grams of a shard that a task holds while it passes over its texts (48 MB, and its table).
SHARD = 4_000_000
_PLAIN = 2048


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of each character with the ORDER - 1 before it, first character of each text); texts are padded with zeros in front."""
    points = [np.frombuffer(t.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(p) for p in points])
    pad = ORDER - 1
    s = np.zeros(int(sizes.sum()) + pad * len(points), np.uint64)
    begin = np.concatenate([[0], np.cumsum(sizes + pad)]).astype(np.int64)
    place = np.arange(int(sizes.sum())) + np.repeat((np.arange(len(points)) + 1) * pad, sizes)
    x = np.concatenate(points).astype(np.uint64) if points else s[:0]
    # common characters have symbols of their own, rare ones share the others
    s[place] = np.where(x < U(_PLAIN), x, U(_PLAIN) + (x * U(0x9E3779B97F4A7C15) >> U(53)))
    key = s[place - pad] if len(place) else s[:0]
    for i in range(pad - 1, -1, -1):
        key = key << U(BITS) | s[place - i]
    return key, np.concatenate([[0], np.cumsum(sizes)])


def counted(docs: DataFrame) -> DataFrame:
    """key, c: each n-gram of the texts, and how often trusted ones (column trusted) have it."""

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def merged():
            key, count = (np.concatenate(x) for x in zip(*held))
            u, at = np.unique(key, return_inverse=True)
            return u, np.bincount(at, count, len(u)).astype("i8")

        for rows, texts in _texts(batches, "trusted"):
            key, begin = symbols(texts)
            yes = np.repeat(np.array([r[0] for r in rows], bool), np.diff(begin))
            key = np.sort(key << U(1) | yes.astype(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate([first, [len(key)]]))
            key = key[first]
            held.append((key >> U(1), np.where(key & U(1) > 0, count, 0)))
            size += len(key)
            if size > 3_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view("i8")), pa.array(held[0][1])], ["key", "c"])
                    held, size = [], 0
        if held:
            key, count = merged()
            yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), pa.array(count)], ["key", "c"])

    return arrow_map(docs.select("text", "trusted"), run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _cut(order: int):
    """The last `order` symbols of an n-gram."""
    return F.col("key").bitwiseAND(F.lit((1 << BITS * order) - 1))


def discounts(t: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams with count 1 to 4 (Chen and Goodman, 1999); 0.5 each where they are not defined."""
    if min(t[:3]) <= 0:
        return [0.5, 0.5, 0.5]
    y = t[0] / (t[0] + 2 * t[1])
    out = [k + 1 - (k + 2) * y * t[k + 1] / t[k] for k in range(2)] + [3 - 4 * y * t[3] / t[2] if t[3] else 0.5]
    return [min(max(d, 0.0), k + 1.0) for k, d in enumerate(out)]


def probabilities(counts: DataFrame) -> DataFrame:
    """key, logp (natural) of every n-gram in counts, seen in trusted text or not."""
    wanted = {ORDER: counts.select("key")}
    seen = {ORDER: counts.where("c > 0")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(_cut(k).alias("key")).distinct()
        seen[k] = written(seen[k + 1].groupBy(_cut(k).alias("key")).agg(F.count("*").alias("c")), "counts")
    p = None
    for k in range(1, ORDER + 1):
        n = lambda c: F.count(F.when(c, 1))
        t = seen[k].agg(*(n(F.col("c") == i) for i in (1, 2, 3, 4))).first()
        d = discounts(list(t))
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftrightunsigned("key", BITS).alias("context")
        sums = [F.sum("c").alias("total"), (F.sum(discount)).alias("mass")]
        own = wanted[k].join(seen[k], "key", "left")
        if k == 1:
            total = seen[k].agg(*sums).first()
            whole, mass = float(total["total"] or 0), float(total["mass"] or 0)
            base = 1.0 / (1 << BITS)
            own = own.select("key", (F.greatest(F.coalesce(F.col("c") - discount, F.lit(0.0)), F.lit(0.0)) / whole + mass / whole * base if whole else F.lit(base)).alias("p"))
        else:
            contexts = seen[k].groupBy(context).agg(*sums)
            lower = p.withColumnRenamed("key", "suffix").withColumnRenamed("p", "q")
            own = own.withColumn("context", F.shiftrightunsigned("key", BITS)).withColumn("suffix", _cut(k - 1)).join(contexts, "context", "left").join(lower, "suffix")
            seen_part = F.greatest(F.coalesce(F.col("c") - discount, F.lit(0.0)), F.lit(0.0))
            own = own.select("key", F.when(F.col("total").isNull(), F.col("q")).otherwise((seen_part + F.col("mass") * F.col("q")) / F.col("total")).alias("p"))
        p = written(own, "p") if k < ORDER else own
    return p.select("key", F.log("p").cast("float").alias("logp"))


class Lookup:
    """N-grams to numbers by open tables: each round takes the keys that the rounds before could not seat."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.rounds = keys, np.concatenate([values, np.zeros(1, values.dtype)]), []
        left = np.arange(len(keys), dtype=np.int64)
        multiplier = 0x9E3779B97F4A7C15
        while len(left):
            bits = max(8, int(len(left) * 3).bit_length())
            slot = (keys[left] * U(multiplier) >> U(64 - bits)).astype(np.int64)
            seat = np.full(1 << bits, -1, "i4")
            seat[slot] = left
            self.rounds.append((multiplier, bits, seat))
            left = left[seat[slot] != left]
            multiplier = (multiplier * 0xBF58476D1CE4E5B9 + 2) % (1 << 64) | 1

    def __call__(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether found); 0 where not found."""
        at = np.full(len(query), -1, np.int64)
        todo = np.arange(len(query))
        for multiplier, bits, seat in self.rounds:
            q = query[todo]
            k = seat[(q * U(multiplier) >> U(64 - bits)).astype(np.int64)]
            hit = (k >= 0) & (self.keys[k] == q)
            at[todo[hit]] = k[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return self.values[at], at >= 0


def perplexities(docs: DataFrame, logp: DataFrame) -> DataFrame:
    """doc_id, lang, trusted, perplexity, chars of every document; perplexity is null for a text without characters.

    The table of n-grams is cut into shards of about SHARD, written to the shared folder; the texts pass over each in
    turn, and a document's sums are added up. Tasks read their shard there: nothing of it goes through the driver.
    One shard holds the n-grams of most alphabets' corpora; more of them cost a scan each.
    """
    spark = docs.sparkSession
    grams = logp.count()
    if not grams:
        return docs.select("doc_id", "lang", "trusted", F.lit(None).cast("double").alias("perplexity"), F.lit(0).cast("long").alias("chars"))
    shards = -(-grams // SHARD)
    path = shared_path(spark, "model")
    logp.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).write.partitionBy("shard").parquet(path)
    out = None
    for k in range(shards):

        def run(batches, part=f"{path}/shard={k}"):
            import pyarrow as pa
            import pyarrow.parquet as pq

            fs, where = store(part)
            model = pq.read_table(where, filesystem=fs, columns=["key", "logp"])
            keys, values = model["key"].to_numpy(), model["logp"].to_numpy()
            find = Lookup(keys.view("u8"), values)
            for rows, texts in _texts(batches, "doc_id", "lang", "trusted"):
                key, begin = symbols(texts)
                value, hit = find(key)
                total = np.concatenate([[0.0], np.cumsum(value, dtype="f8")])
                n = np.concatenate([[0], np.cumsum(hit)])
                doc, lang, trusted = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lang, pa.string()), pa.array(trusted, pa.bool_()), pa.array(total[begin[1:]] - total[begin[:-1]]), pa.array((n[begin[1:]] - n[begin[:-1]]).astype("i8")), pa.array(np.diff(begin).astype("i8")), pa.array([hash_of(t) for t in texts], pa.int64())], ["doc_id", "lang", "trusted", "total", "n", "chars", "text"])

        part = arrow_map(docs.select("doc_id", "lang", "trusted", "text"), run, "doc_id long, lang string, trusted boolean, total double, n long, chars long, text long")
        part = part.withColumn("rows", F.lit(int(k == 0)))
        out = part if out is None else out.union(part)
    if shards > 1:
        # equal rows have equal sums: one row for all of them holds their ratio, and comes back as often as it was there
        out = out.groupBy("doc_id", "lang", "trusted", "text").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("chars").alias("chars"), F.sum("rows").alias("rows"))
        out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select("doc_id", "lang", "trusted", F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n"))).alias("perplexity"), "chars")


def hash_of(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def classify(docs: DataFrame, labels: DataFrame, high: float = HIGH) -> DataFrame:
    """doc_id, lang, perplexity, kept of every document (columns doc_id, text, lang; others are ignored).

    Trusted are the documents that labels (doc_id, quality) marks with quality 1. One in HELD_OUT of them is kept from
    training: a model knows its own texts too well to tell how it meets others. kept: the excess, the log
    perplexity less its median and over the spread that WIDEN gives a text of its length, is at most the quantile of the
    language's held-out texts. Median and quantile are drawn toward those of all held-out texts, which count as ENOUGH of
    the language's own; a null language or one without such texts has the common ones. Without any, all are kept that have
    characters. So a few odd short texts do not loosen the bound of long ones. Null and empty texts have no perplexity and are not kept.
    A null doc_id is never trusted. Rows that repeat a doc_id are judged each; where labels differ, one of 1 suffices.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")).distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).join(small(good), "doc_id", "left").withColumn("known", F.coalesce("trusted", F.lit(False)))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    counts = written(counted(docs.withColumn("trusted", F.col("known") & ~held)), "counts")
    scores = written(perplexities(docs.withColumn("trusted", F.col("known") & held), written(probabilities(counts), "logp")), "scores")
    unseen = "trusted and perplexity is not null"
    quantile = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(100_000))
    log = F.log("perplexity")
    centres = scores.where(unseen).groupBy("lang").agg(F.count("*").alias("k"), quantile(log, 0.5).alias("centre")).where("lang is not null")
    everywhere = scores.where(unseen).agg(quantile(log, 0.5).alias("centre_all"))
    placed = scores.join(small(centres), "lang", "left").crossJoin(F.broadcast(everywhere))  # one row of one number
    drawn = lambda own, common: F.coalesce((F.col("k") * F.col(own) + ENOUGH * F.col(common)) / (F.col("k") + ENOUGH), F.col(common))
    placed = placed.withColumn("excess", (log - drawn("centre", "centre_all")) / F.sqrt(1 + WIDEN / F.greatest("chars", F.lit(1))))
    by_lang = placed.where(unseen).where("k is not null").groupBy("lang").agg(quantile("excess", high).alias("high"))
    everywhere = placed.where(unseen).agg(quantile("excess", high).alias("high_all"))
    out = placed.join(small(by_lang), "lang", "left").crossJoin(F.broadcast(everywhere))  # one row of one number
    within = F.col("excess") <= drawn("high", "high_all")
    return out.select("doc_id", "lang", "perplexity", F.when(F.col("high_all").isNull(), F.col("perplexity").isNotNull()).otherwise(F.coalesce(within, F.lit(False))).alias("kept"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
