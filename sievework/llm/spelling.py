"""Spelling variants: pairs of words one edit apart, found by merging the subtrees of a trie.

Two words that differ by one edit part at one node of the trie. There the larger child (heavy) stays as it is, and the words
of the smaller ones (light), as of every node small ones are moved into large ones, are entered again with their next
character replaced by the heavy one, skipped, or preceded by the heavy one; light words also meet each other with
that character blanked out. Where such an entry ends at a word there is a pair, and each pair turns up once. A word
is light at no more than log2 of the words' number of nodes. Nodes of too many words are taken level by level as
joins; the subtrees below them go to tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, small, table, written
from .words import U, _powers

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is this many times as frequent as its variant.
RATIO = 10
#: One in so many of a document's runs loses a character, by its checksum.
DAMAGE = 31
#: Words of a subtree that one task takes whole; larger nodes are split by joins.
SUBTREE = 100_000
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
_RUN = re.compile(r"[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def lower(text: str) -> str:
    """A-Z alone in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def runs(doc_id, text: str) -> Counter:
    """The words of LEAST_LENGTH or more code points of a text, after damage, and how often each occurs."""
    out: Counter = Counter()
    seed = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    for run, n in Counter(_RUN.findall(lower(text))).items():
        h = zlib.crc32(run.encode(), seed)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def words(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct words of all texts that occur `least` times or more."""

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if text.is_valid:
                    held.update(runs(doc, text.as_py()))
                if len(held) >= HELD:
                    yield made()
                    held.clear()
        if held:
            yield made()

    bound_batches(docs.sparkSession)
    counted = arrow_map(docs.select("doc_id", "text"), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Subtrees:
    """Tries over sorted Latin-1 words, as ranges of the sorted list: a node at depth d is a range that shares d characters."""

    def __init__(self, own: list[str]):
        data = [w.encode("latin-1") for w in own]
        self.size = np.array([len(w) for w in data], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.codes = np.frombuffer(b"".join(data) + b"\0", "u1")
        self.up, self.down = _powers(len(self.codes) + 2)
        self.sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum((self.codes + U(1)) * self.up[: len(self.codes)], out=self.sums[1:])
        self.full = self.head(np.arange(len(own)), self.size)
        self.by_hash = np.argsort(self.full, kind="stable")
        self.sorted = self.full[self.by_hash]

    def head(self, i: np.ndarray, n) -> np.ndarray:
        """Hashes of the first n characters of words i."""
        s = self.start[i]
        return (self.sums[s + n] - self.sums[s]) * self.down[s]

    def same(self, i: np.ndarray, a, j: np.ndarray, b) -> np.ndarray:
        """Whether word i from its character a on equals word j from b on."""
        left, right = self.size[i] - a, self.size[j] - b
        out = left == right
        x, y = self.start[i] + a, self.start[j] + b
        todo, k = np.flatnonzero(out & (left > 0)), 0
        while len(todo):
            equal = self.codes[x[todo] + k] == self.codes[y[todo] + k]
            out[todo[~equal]] = False
            k += 1
            todo = todo[equal & (left[todo] > k)]
        return out

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys that are words, those words)."""
        at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
        hit = np.flatnonzero(self.sorted[at] == key)
        return hit, self.by_hash[at[hit]]

    def pairs(self, tree: np.ndarray):
        """Yields (words i, words j): each pair of words of one tree that one edit parts. tree: a number a word, in order."""
        a, g, d = np.arange(len(self.size)), tree, 0
        while len(a):
            ends = self.size[a] <= d
            ch = np.where(ends, -1, self.codes[np.minimum(self.start[a] + d, len(self.codes) - 1)].astype(np.int64))
            new_node = np.concatenate([[True], g[1:] != g[:-1]])
            new_child = new_node | np.concatenate([[True], ch[1:] != ch[:-1]])
            child = np.cumsum(new_child) - 1
            count = np.bincount(child)
            first = np.flatnonzero(new_child)
            node = np.cumsum(new_node) - 1
            # the heavy child of each node: the last of its children when they stand by size
            order = np.lexsort((np.where(ch[first] < 0, 0, count), node[first]))
            heavy = np.zeros(node[-1] + 1, np.int64)
            heavy[node[first][order]] = order
            light = np.flatnonzero(child != heavy[node])
            if len(light):
                yield from self._light(a[light], ch[light], ch[first[heavy[node[light]]]], node[light], d)
            keep = (count[child] > 1) & ~ends
            a, g, d = a[keep], child[keep], d + 1

    def _light(self, i, ch, hc, node, d):
        head, full, p = self.head(i, np.minimum(d, self.size[i])), self.full[i], self.up[d]
        B, inverse = self.up[1], self.down[1]
        deep = np.flatnonzero(ch >= 0)
        own, c = i[deep], ch[deep].astype(np.uint64)
        tail = full[deep] - head[deep] - (c + U(1)) * p
        # replaced by the heavy character
        at, j = self.find(full[deep] + (hc[deep].astype(np.uint64) - c) * p)
        ok = self.same(own[at], d + 1, j, d + 1)
        yield own[at][ok], j[ok]
        # skipped; where the next one is equal, the words part further down
        after = np.where(self.size[own] > d + 1, self.codes[np.minimum(self.start[own] + d + 1, len(self.codes) - 1)].astype(np.int64), -1)
        at, j = self.find(head[deep] + tail * inverse)
        ok = (after[at] != ch[deep][at]) & self.same(own[at], d + 1, j, d)
        yield own[at][ok], j[ok]
        # the heavy character put before
        at, j = self.find(head + (hc.astype(np.uint64) + U(1)) * p + (full - head) * B)
        ok = (hc[at] >= 0) & self.same(i[at], d, j, d + 1)
        yield i[at][ok], j[ok]
        # light words that differ in this character alone
        blank = head[deep] + tail
        order = np.lexsort((blank, node[deep]))
        k, n, left = blank[order], node[deep][order], own[order]
        for step in range(1, len(order)):
            equal = np.flatnonzero((k[step:] == k[:-step]) & (n[step:] == n[:-step]))
            if not len(equal):
                break
            x, y = left[equal], left[equal + step]
            ok = self.same(x, d + 1, y, d + 1)
            yield x[ok], y[ok]


PARTIAL = "word string, k long, best struct<lack: long, near: string>"


def below(buckets: DataFrame) -> DataFrame:
    """PARTIAL of the subtrees (tree, word, n): how many near words of its own tree each word has, and the best of them."""

    def run(batches):
        import pyarrow as pa

        tree, word, count = [], [], []

        def done():
            t, n = Subtrees(word), np.array(count, np.int64)
            number = np.cumsum([k > 0 and tree[k] != tree[k - 1] for k in range(len(tree))])
            near, best = np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64)
            rank = np.empty(len(word), np.int64)  # the better of two words has the smaller rank
            rank[np.lexsort((np.arange(len(word)), -n))] = np.arange(len(word))
            by_rank = np.argsort(rank)
            least = np.full(len(word), len(word), np.int64)
            for i, j in t.pairs(number):
                for x, y in ((i, j), (j, i)):
                    near += np.bincount(x, minlength=len(near))
                    np.minimum.at(least, x, rank[y])
            some = np.flatnonzero(near)
            best = by_rank[least[some]]
            kind = pa.struct([("lack", pa.int64()), ("near", pa.string())])
            for a in range(0, len(some), 20_000):
                s, b = some[a : a + 20_000], best[a : a + 20_000]
                pair = pa.StructArray.from_arrays([pa.array(-n[b]), pa.array([word[x] for x in b], pa.string())], fields=list(kind))
                yield pa.RecordBatch.from_arrays([pa.array([word[x] for x in s], pa.string()), pa.array(near[s]), pair], ["word", "k", "best"])

        for batch in batches:
            for t, w, n in zip(*(batch.column(c).to_pylist() for c in ("tree", "word", "n"))):
                if len(word) >= SUBTREE and t != tree[-1]:
                    yield from done()
                    tree, word, count = [], [], []
                tree.append(t)
                word.append(w)
                count.append(n)
        if word:
            yield from done()

    dealt = buckets.select("tree", "word", "n").repartition("tree").sortWithinPartitions("tree", "word")
    return arrow_map(dealt, run, PARTIAL)


def near_words(vocabulary: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """word, n_near, best (lack: minus its n, near: the word) of every word (word, n; each once) that has a near one.

    best is the near word of largest n, of equal ones the smallest. The trie is split from the root: at a node of more than
    `subtree` words the light words' entries are joined with the words, and each child is a subtree or is split in turn.
    """
    out, cur, d = [], vocabulary, 0
    if vocabulary.count() <= subtree:
        out, cur = [below(vocabulary.withColumn("tree", F.lit("")))], None
    while cur is not None:
        ch, rest = F.substring("word", d + 1, 1), F.expr(f"substring(word, {d + 2})")
        node = F.substring("word", 1, d) if d else F.lit("")
        at = cur.select("word", "n", node.alias("node"), ch.alias("ch"))
        sizes = written(at.groupBy("node", "ch").agg(F.count("*").alias("size")), "nodes")
        heavy = sizes.where("ch <> ''").groupBy("node").agg(F.min(F.struct((-F.col("size")).alias("s"), F.col("ch").alias("ch"))).alias("h")).select("node", F.col("h.ch").alias("hc"))
        light = at.join(small(heavy), "node").where("ch <> hc").withColumn("rest", rest)
        deep = F.col("ch") != ""
        entries = F.array(
            F.when(deep, F.concat("node", "hc", "rest")),
            F.when(deep & (F.substring("rest", 1, 1) != F.col("ch")), F.concat("node", "rest")),
            F.concat("node", "hc", "ch", "rest"),
        )
        entered = light.select(F.col("word").alias("other"), F.col("n").alias("m"), F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("word"))
        met = entered.join(vocabulary, "word")
        one = lambda w, n, x: F.struct(F.col(w).alias("word"), F.lit(1).cast("long").alias("k"), F.struct((-F.col(n)).alias("lack"), F.col(x).alias("near")).alias("best"))
        out.append(met.select(F.explode(F.array(one("other", "n", "word"), one("word", "m", "other"))).alias("p")).select("p.*"))
        # one word a character at most: the alphabet bounds the list
        mates = light.where(deep).groupBy("node", "rest").agg(F.collect_list(F.struct((-F.col("n")).alias("lack"), F.col("word").alias("near"))).alias("all")).where(F.size("all") > 1)
        mates = mates.select("all", F.explode("all").alias("own"))
        out.append(mates.select(F.col("own.near").alias("word"), (F.size("all") - 1).cast("long").alias("k"), F.array_min(F.filter("all", lambda x: x["near"] != F.col("own.near"))).alias("best")))
        kids = small(sizes.where("ch <> '' and size > 1").select("node", "ch", "size"))
        placed = at.join(kids, ["node", "ch"]).select(F.concat("node", "ch").alias("tree"), "word", "n", "size")
        out.append(below(placed.where(F.col("size") <= subtree)))
        more = sizes.where((F.col("size") > subtree) & (F.col("ch") != "")).head(1)
        cur, d = (written(placed.where(F.col("size") > subtree).select("word", "n"), "level") if more else None), d + 1
    parts = out[0]
    for part in out[1:]:
        parts = parts.unionByName(part)
    return parts.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def grouped(vocabulary: DataFrame, ratio: int = RATIO, subtree: int = SUBTREE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n; each once).

    form: the near word of largest n (of equal ones the smallest), if its n is at least `ratio` times the word's; a word without
    such one has null. root: the last of the forms; the word itself without any. Forms grow by the ratio, so their
    chains are short; each round doubles the steps.
    """
    near = near_words(vocabulary, subtree)
    joined = vocabulary.join(near, "word", "left").withColumn("form_n", -F.col("best.lack"))
    fits = F.col("form_n") >= ratio * F.col("n")
    own = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    step = own.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        step = after.select("word", "root")
        if not after.where("moved").head(1):
            break
    return own.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """The words of all texts (columns doc_id, text; others are ignored), each with its more frequent form.

    A null text has no words, nor has one without runs of LEAST_LENGTH letters; a null doc_id counts as the empty one in the
    checksum that damages runs. Repeated rows count each; no rows give no words.
    """
    return grouped(written(words(docs), "words"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
