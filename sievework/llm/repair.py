"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and user/assistant pairs.

The repair is a weighted automaton over a conversation's rows. It is determinised lazily: the costs of finishing from each
of its four states, less the least of them, are one state of the deterministic machine, and a step (such a vector, a row's symbol)
is worked out once and looked up from then on. The scan runs from the last row to the first, so that
the trace, which follows tight arcs the other way, gives the audit from its first letter and takes the
ASCII-least one. A conversation is cut into segments; where it has several, each is first summed up as a matrix of
costs between states, and the vectors and states at the borders follow from those.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches, small, table, written

#: Rows of a segment, as a power of two.
SEGMENT_BITS = 16
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLANKS = " \t\n\x0b\x0c\r"
#: States: start, after the system turn, after user, after assistant; and the state that the next turn leads to.
NEXT = (2, 2, 3, 2)
#: Symbols are 3 * role + fault: roles system, user, assistant, other; faults none, delete (blank or duplicate), truncated.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, GONE, CUT = range(3)
FINAL = (0, 2 * INSERT, INSERT, 0)
ROLES = {2: "user", 3: "assistant"}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
INF = float("inf")


class Machine:
    """The determinised machine; its tables grow as rows need them."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table: dict[tuple[int, int], tuple[int, float]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, int, int]] = {}

    def state(self, costs) -> tuple[int, float]:
        """(number of the normalised vector, what was taken off)."""
        least = min(costs)
        key = tuple(c - least for c in costs)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], least

    @staticmethod
    def options(symbol: int, q: int):
        """(letter, cost, state after) of a row's own arcs."""
        role, fault = divmod(symbol, 3)
        yield "D", DELETE, q
        if fault != GONE:
            extra, to = TRUNCATED * (fault == CUT), NEXT[q]
            if role == to - 1:
                yield "K", extra, to
            elif q == 0 and role == SYSTEM:
                yield "K", extra, 1
            yield "R", extra + REROLE, to

    def before(self, v: int, symbol: int) -> tuple[int, float]:
        """The vector before a row, from that after it."""
        if (v, symbol) not in self.table:
            after = self.vectors[v]
            costs = [min(c + after[to] for _, c, to in self.options(symbol, q)) for q in range(4)]
            for _ in range(3):
                costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(4)]
            self.table[v, symbol] = self.state(costs)
        return self.table[v, symbol]

    def scan(self, symbols, end) -> tuple[list[int], float]:
        """(vectors at each border, first to last; what was taken off in all)."""
        v, off = self.state(end)
        out = [v]
        for s in reversed(symbols):
            v, more = self.before(v, s)
            off += more
            out.append(v)
        return out[::-1], off

    def arc(self, v: int, symbol: int, q: int) -> tuple[str, int, int]:
        """(letters, cost, state after the row) of the least tight arcs from q before the row; v is the vector after it."""
        if (v, symbol, q) not in self.arcs:
            after, (mine, off) = self.vectors[v], self.before(v, symbol)
            left = [c + off for c in self.vectors[mine]]
            letters, cost, at = "", 0, q
            while True:
                tight = [x for x in self.options(symbol, at) if x[1] + after[x[2]] == left[at]]
                if INSERT + left[NEXT[at]] == left[at]:
                    tight.append(("I", INSERT, NEXT[at]))
                letter, own, at = min(tight)
                letters, cost = letters + letter, cost + own
                if letter != "I":
                    break
            self.arcs[v, symbol, q] = letters, cost, at
        return self.arcs[v, symbol, q]

    def trace(self, symbols, vectors: list[int], q: int, last: bool) -> tuple[str, int, int]:
        """(audit, cost, state at the end) of the cheapest edits from state q; the last segment also completes the pattern."""
        letters, cost = [], 0
        for s, v in zip(symbols, vectors[1:]):
            own, more, q = self.arc(v, s, q)
            letters.append(own)
            cost += more
        while last and FINAL[q]:
            letters.append("I")
            cost, q = cost + INSERT, NEXT[q]
        return "".join(letters), cost, q

    def matrix(self, symbols) -> list[list[float]]:
        """Costs from each state before the symbols to each state after them."""
        columns = []
        for to in range(4):
            vectors, off = self.scan(symbols, [0 if q == to else INF for q in range(4)])
            columns.append([c + off for c in self.vectors[vectors[0]]])
        return [[columns[to][q] for to in range(4)] for q in range(4)]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text after damage by the checksum of `conv_id:turn`; a null of any column is one space there."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select(_conv(), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _conv():
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")


def placed(rows: DataFrame) -> DataFrame:
    """The rows in order of conversation and turn with `pos`, their place, and what a repair has to know of them; written once.

    Ranges are cut on the whole order, so that a long conversation fills many of them. Rows of one turn stand by role, then by the first 256
    characters of the text, then by its hash; equal rows stand together.
    """
    rows = rows.withColumn("start", F.substring("text", 1, 256)).withColumn("hash", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "start", "hash", "copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    role = F.substring("role", 1, 1)
    number = F.when(role == "s", SYSTEM).when(role == "u", USER).when(role == "a", ASSISTANT).otherwise(OTHER)
    return written(rows.select("conv", "turn", "role", "text", F.unhex(F.md5("text")).alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), number.alias("number"), F.monotonically_increasing_id().alias("pos")), "turns")


def segments(rows: DataFrame, bits: int) -> DataFrame:
    """conv, seg, symbols, and the segment's counts, of placed rows; a segment holds at most 2**bits rows."""
    firsts = written(rows.where("not blank").groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "repeated")
    light = rows.select("conv", "pos", "turn", "role", "digest", "blank", "cut", "number").join(small(firsts), ["conv", "role", "digest"], "left")
    again = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank") | again, GONE).when(F.col("cut"), CUT).otherwise(FINE)
    light = light.select("conv", "pos", "turn", F.shiftright("pos", bits).alias("seg"), (F.col("number") * 3 + fault).cast("tinyint").alias("symbol"), "blank", again.alias("again"))
    n = lambda c: F.count_if(c)
    out = light.groupBy("conv", "seg").agg(
        F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("own"), F.size(F.collect_set("turn")).cast("long").alias("turns"), F.min("turn").alias("lo"), F.max("turn").alias("hi"),
        n(F.col("blank")).alias("blank"), n(F.col("again")).alias("duplicate"), n(F.col("symbol") % 3 == CUT).alias("truncated"),
    )
    return written(out.withColumn("symbols", F.col("own.symbol")).drop("own"), "segments")


def _rows(batches, *columns):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _batch(rows, schema):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def _mapped(df: DataFrame, each, schema: str) -> DataFrame:
    """each(iterator of a partition's rows) gives rows of the schema; they leave in batches of bounded size."""

    def run(batches):
        held, size = [], 0
        for row in each(batches):
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, (str, list)))
            if size > 1 << 20:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)

    return arrow_map(df, run, schema)


def borders(segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, seg, end, last), (conv, seg, q): of conversations of several segments, the vector after each, and the state before each."""

    def sums(batches):
        machine = Machine()
        for conv, seg, symbols in _rows(batches, "conv", "seg", "symbols"):
            yield conv, seg, [float(x) for row in machine.matrix(symbols) for x in row]

    matrices = written(_mapped(segs.select("conv", "seg", "symbols"), sums, "conv string, seg long, matrix array<double>"), "matrices")

    def backward(batches):
        now, end = None, None
        for conv, seg, m in _rows(batches, "conv", "seg", "matrix"):
            last = conv != now
            end = [float(x) for x in FINAL] if last else end
            yield conv, seg, end, int(last)
            now, end = conv, [min(m[4 * q + to] + end[to] for to in range(4)) for q in range(4)]

    ends = written(_mapped(matrices.repartition("conv").sortWithinPartitions("conv", F.desc("seg")), backward, "conv string, seg long, end array<double>, last long"), "ends")

    def ways(batches):
        machine = Machine()
        for conv, seg, symbols, end, last in _rows(batches, "conv", "seg", "symbols", "end", "last"):
            vectors, _ = machine.scan(symbols, end)
            yield conv, seg, [machine.trace(symbols, vectors, q, bool(last))[2] for q in range(4)]

    through = _mapped(segs.join(ends, ["conv", "seg"]).select("conv", "seg", "symbols", "end", "last"), ways, "conv string, seg long, after array<long>")

    def forward(batches):
        now, q = None, 0
        for conv, seg, after in _rows(batches, "conv", "seg", "after"):
            q = q if conv == now else 0
            yield conv, seg, q
            now, q = conv, after[q]

    return ends, written(_mapped(through.repartition("conv").sortWithinPartitions("conv", "seg"), forward, "conv string, seg long, q long"), "states")


def audits(segs: DataFrame) -> DataFrame:
    """conv, seg, audit, cost, illegal: the edits of each segment, as letters: inserts before a row, then the row's own."""
    several = written(segs.groupBy("conv").agg(F.count("*").alias("k")).where("k > 1").select("conv"), "several")
    known = segs.select("conv", "seg", "symbols")
    if several.head(1):
        ends, states = borders(known.join(small(several), "conv"))
        known = known.join(small(ends), ["conv", "seg"], "left").join(small(states), ["conv", "seg"], "left")
    else:
        known = known.select("*", F.lit(None).cast("array<double>").alias("end"), F.lit(1).cast("long").alias("last"), F.lit(0).cast("long").alias("q"))

    def run(batches):
        machine = Machine()
        for conv, seg, symbols, end, last, q in _rows(batches, "conv", "seg", "symbols", "end", "last", "q"):
            vectors, _ = machine.scan(symbols, end or FINAL)
            audit, cost, _ = machine.trace(symbols, vectors, q or 0, last != 0)
            roles = [s // 3 for s in symbols]
            yield conv, seg, audit, cost, sum((a, b) not in _LEGAL for a, b in zip(roles, roles[1:]))

    return written(_mapped(known, run, "conv string, seg long, audit string, cost long, illegal long"), "audits")


def hashes(rows: DataFrame, edits: DataFrame, bits: int) -> DataFrame:
    """conv, repaired_sha256: a digest is sequential, so a conversation streams through one task, a row at a time."""
    none = lambda t: F.lit(None).cast(t)
    turns = rows.select("conv", F.shiftright("pos", bits).alias("seg"), "pos", "role", "text", none("string").alias("audit"))
    both = edits.select("conv", "seg", none("long").alias("pos"), none("string").alias("role"), none("string").alias("text"), "audit").unionByName(turns)

    def run(batches):
        for conv, own in groupby(_rows(batches, "conv", "role", "text", "audit"), key=lambda r: r[0]):
            digest, empty, q, audit, at = hashlib.sha256(), True, 0, "", 0

            def add(role, text):
                nonlocal empty
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False

            def inserted():
                nonlocal q, at
                while at < len(audit) and audit[at] == "I":
                    q, at = NEXT[q], at + 1
                    add(ROLES[q], "")

            for _, role, text, more in own:
                inserted()
                if more is not None:
                    audit, at = more, 0
                    continue
                letter, at = audit[at], at + 1
                if letter != "D":
                    q = 1 if letter == "K" and q == 0 and role[:1] == "s" else NEXT[q]
                    add(role if letter == "K" else ROLES[q], text)
            inserted()
            yield conv, digest.hexdigest()

    return _mapped(both.repartition("conv").sortWithinPartitions("conv", "seg", F.asc_nulls_first("pos")), run, "conv string, repaired_sha256 string")


def repair(conversations: DataFrame, bits: int = SEGMENT_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id (columns conv_id, turn, role, text; others are ignored).

    Rows with a null conv_id are one conversation. A null role or text is one space: such a text is blank, such a role has to change. Rows of a turn
    are ordered by role and text. A conversation of which damage leaves no row has zeros and the hash of nothing.
    """
    bound_batches(conversations.sparkSession)
    rows = placed(damaged(conversations))
    segs = segments(rows, bits)
    edits = audits(segs)
    w = Window.partitionBy("conv").orderBy("seg")
    parts = segs.select("conv", "seg", "turns", "lo", "hi", "blank", "duplicate", "truncated", F.element_at("symbols", 1).alias("head"), F.element_at("symbols", -1).alias("tail")).join(edits, ["conv", "seg"])
    role = lambda c: F.floor(F.col(c) / 3)
    legal = F.lit(False)
    for a, b in sorted(_LEGAL):
        legal = legal | ((role("before") == a) & (role("head") == b))
    parts = parts.withColumn("before", F.lag("tail").over(w)).withColumn("met", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("turns", F.col("turns") - F.coalesce((F.col("met") == F.col("lo")).cast("long"), F.lit(0)))
    parts = parts.withColumn("illegal", F.col("illegal") + F.when(F.col("before").isNotNull() & ~legal, 1).otherwise(0))
    total = lambda c: F.sum(c).alias(c)
    whole = parts.groupBy("conv").agg((F.max("hi") - F.min("lo") + 1 - F.sum("turns")).alias("gaps"), *(total(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.array_join(F.array_sort(F.collect_list(F.struct("seg", "audit")))["audit"], "").alias("audit"))
    out = conversations.select(_conv(), "conv_id").distinct().join(whole, "conv", "left").join(hashes(rows, edits, bits), "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
