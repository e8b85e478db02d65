"""Benchmark decontamination by pigeonhole edit matching: exact hits of an item's pieces, verified by Myers's bit vectors.

Texts and items are lower-cased and every run of other than letters and digits becomes one space. An item of m characters
may differ by k = m * BUDGET edits; cut into k + 1 pieces, one of them is unharmed in every such match. An item too short for
an edit has to stand between words: "cat" is not in "education".
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

BUDGET = 0.08
#: Bytes of benchmark text whose pieces one pass carries to the executors; a larger benchmark takes several passes.
PASS_BYTES = 4 << 20
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(m: int) -> int:
    return int(m * BUDGET)


def cut(item: str) -> list[tuple[int, str]]:
    """(start, piece): budget + 1 pieces of nearly equal length."""
    m, k = len(item), budget(len(item)) + 1
    edges = [m * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(pattern: str, text: str, peq: dict[str, int] | None = None) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of text, the end of the first such), by Myers's bit vectors."""
    m = len(pattern)
    peq = peq or masks(pattern)
    pv, mv, score, best, end = (1 << m) - 1, 0, m, m, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """All items' pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        items = [(i, t, budget(len(t))) for i, t in items if t]
        self.items = [(i, t, k, masks(t)) for i, t, k in ((i, t if k else f" {t} ", k) for i, t, k in items)]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, _, _) in enumerate(self.items):
            for a, piece in cut(t) if budget(len(t.strip())) else [(0, t)]:
                where.setdefault(piece, []).append((n, a))
        for piece, own in where.items():
            self.automaton.add_word(piece, (len(piece), own))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normal text) of each item in a normal text."""
        if not self.items:
            return []
        text = f" {text} "
        around: dict[int, list[list[int]]] = {}
        for last, (size, own) in self.automaton.iter(text):
            for n, a in own:
                _, t, k, _ = self.items[n]
                begin = last + 1 - size - a
                lo, hi = max(0, begin - k), min(len(text), begin + len(t) + k)
                spans = around.setdefault(n, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1] = [min(lo, spans[-1][0]), max(hi, spans[-1][1])]
                else:
                    spans.append([lo, hi])
        out = []
        for n, spans in around.items():
            item, t, k, peq = self.items[n]
            best = min(((d, lo + e) for lo, hi in spans for d, e in [distance(t, text[lo:hi], peq)]), default=(k + 1, 0))
            if best[0] <= k:  # the blank before the text counts for nothing, nor does one that an item brought
                out.append((item, best[0], best[1] - (1 if k else 2)))
        return sorted(out)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, match_end: each document and each item that it holds within the item's budget.

    docs: columns doc_id, text; benchmark: item_id, text; other columns are ignored. distance is the least over the
    document, match_end where it ends in the normal text. Null and empty texts and items match nothing; null ids stay
    null; documents' repeated rows are matched each, an item's repeated rows once. Items go to the executors PASS_BYTES at a time; texts stay where they are.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes, out = max(1, -(-size // PASS_BYTES)), None
    for k in range(passes):
        rows = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).select("item_id", "text").distinct().collect()
        items = spark.sparkContext.broadcast([(r["item_id"], normal(r["text"])) for r in rows])

        def run(batches, items=items):
            import pyarrow as pa

            matcher = Matcher(items.value)
            for batch in batches:
                found = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    found += [(doc, *m) for m in matcher.find(normal(text))] if text else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "distance", "match_end"])

        own = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, item_id long, distance int, match_end long")
        out = own if out is None else out.union(own)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, all columns. Texts stay where they are; each pass drops what it finds."""
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    for k in range(passes):
        rows = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).select("item_id", "text").distinct().collect()
        items = spark.sparkContext.broadcast([(r["item_id"], normal(r["text"])) for r in rows])

        def run(batches, items=items):
            import pyarrow as pa

            matcher = Matcher(items.value)
            for batch in batches:
                yield batch.filter(pa.array([not (t and matcher.find(normal(t))) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = arrow_map(docs, run, docs.schema)
    return docs


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
