"""N-gram Jaccard join with set relations: positions skip blocks of the lists, and like sets share their answers.

Equal sets are one node. A node's prefix, its tokens in one global order (frequent ones last), goes to the lists of
these tokens. Answers are found in two steps (set relations, after Wang et al., 2017):

1. In each list nodes are tried with a leader, the node in the middle of the list. What is linked forms a relation, and a
   set's difference from its leader is kept.
2. In each list only nodes of different relations are tried. Long lists are cut into blocks by size, and a pair of blocks is
   skipped whole where their sizes, positions or relations leave no chance. What remains is answered from the leaders: the
   overlap of two leaders is computed once, and those of the sets like them follow from it by the small differences.
   Inside a relation nothing is left to find, so a group of many near copies costs a pass and not its square.

Pairs are tried on parity bitmaps (a lower bound of the difference) where their list is, before any set is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, remove_table, small, table, written
from .graph import components
from .words import U, mix, shingle_sets

WORDS, SIMILAR = 5, (80, 100)
#: Bits of a parity bitmap: those that go to the lists, and those that pairs are tried on before the sets meet.
BITS, WIDE_BITS = 512, 4096
#: Frequent shingles whose counts order the tokens; any table gives the same answers.
ORDERED = 400_000
SEEN_OFTEN = 3
#: Texts of one numpy step, in bytes.
STEP = 1 << 20
#: Lists up to this size are tried at once, pair by pair.
SHORT_LIST = 12
#: Entries of a list's block, whose bounds may skip it whole; bytes of entries in a bucket; pairs whose answers one row derives.
BLOCK, BUCKET_BYTES, DERIVED = 64, 256 << 20, 256
ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def required(a, b):
    """The least overlap of linked sets of these sizes: 100 * i >= 80 * (a + b - i)."""
    num, den = SIMILAR
    return -((-num * (a + b)) // (den + num))


def _texts(batches, *columns: str):
    """(rows, texts) of Arrow batches, STEP bytes at a time; a null text is empty."""
    for batch in batches:
        fields = [batch.column(c) for c in columns]
        own, held, size = [], [], 0
        for k, text in enumerate(batch.column("text")):
            own.append(tuple(f[k].as_py() for f in fields))
            held.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
            size += len(held[-1])
            if size > STEP:
                yield own, held
                own, held, size = [], [], 0
        if own:
            yield own, held


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set: two sums over its tokens, mixed."""
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(s).sum(dtype=np.uint64) ^ (mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) << U(1)) ^ U(len(s))], np.uint64))
    return int(h.view("i8")[0])


def _short(s: np.ndarray) -> bytes:
    """The upper six bytes of each token, in order: two sets of 20,000 words have a wrong match once in a million pairs."""
    return s.view("u1").reshape(-1, 8)[:, 2:].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), "u1")
    out[:, 2:] = np.frombuffer(data, "u1").reshape(-1, 6)
    return out.view("<u8").ravel()


def _bitmap(s: np.ndarray, bits: int = BITS) -> bytes:
    odd = np.bincount((s % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype("u1")).tobytes()


def sets(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, node, bitmap of each document; kind 1: a frequent shingle (node) and its count (n)."""

    def run(batches):
        import pyarrow as pa

        names, types = ["kind", "doc_id", "n", "node", "bitmap"], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        held, size = [], 0

        def often():
            token, count = np.unique(np.concatenate(held), return_counts=True)
            own = count >= SEEN_OFTEN
            k = int(own.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, "i4")), pa.array([None] * k, pa.int64()), pa.array(count[own].astype("i8")), pa.array(token[own].view("i8")), pa.array([None] * k, pa.binary())], names)

        for rows, texts in _texts(batches, "doc_id"):
            out = []
            for (doc,), s in zip(rows, shingle_sets(texts, WORDS)):
                out.append((0, doc, len(s), node_of(s) if len(s) else None, _bitmap(s) if len(s) else None))
                held.append(s)
                size += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            if size > 2_000_000:
                yield often()
                held, size = [], 0
        if held:
            yield often()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "kind int, doc_id long, n long, node long, bitmap binary")


def _order(made: DataFrame):
    """(tokens, counts) of the most frequent shingles, at most ORDERED of them, as a broadcast of at most 16 * ORDERED bytes."""
    rows = made.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(ORDERED).toPandas()
    token = rows["node"].to_numpy("i8").view("u8")
    at = np.argsort(token)
    return made.sparkSession.sparkContext.broadcast((token[at], rows["n"].to_numpy("i8")[at]))


def _prefix(s: np.ndarray, token: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The tokens of a set that a linked set of any size must share one of, in global order: count, then token."""
    num, den = SIMILAR
    k = len(s) - -(-num * len(s) // den) + 1
    rank = np.zeros(len(s), np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        hit = token[at] == s
        rank[hit] = count[at[hit]]
    return s[np.lexsort((s, rank))[:k]]


def lists(docs: DataFrame, order, buckets: int) -> DataFrame:
    """Prefix entries (ENTRY), dealt by token to buckets; a row is what one task has for one bucket."""

    def run(batches):
        import pyarrow as pa

        token, count = order.value
        held, size, known = [], 0, set()

        def dealt():
            e = np.concatenate(held)
            bucket = (e["token"] >> U(20)) % U(buckets)
            at = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[at], np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(full.astype("i4")), pa.array([e[at[cut[b] : cut[b + 1]]].tobytes() for b in full], pa.binary())], ["bucket", "entries"])

        for _, texts in _texts(batches):
            for s in shingle_sets(texts, WORDS):
                if not len(s) or (node := node_of(s)) in known:
                    continue
                if len(known) < 1_000_000:  # copies in one task need no second entry; lists drop the others
                    known.add(node)
                p = _prefix(s, token, count)
                e = np.empty(len(p), ENTRY)
                e["token"], e["node"], e["n"], e["pos"] = p, node, len(s), np.arange(len(p))
                held.append(e)
                size += len(e)
            if size > 500_000:
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()

    return arrow_map(docs.select("text"), run, "bucket int, entries binary")


def shared_lists(batches):
    """One row for each bucket: its entries without repeats, by token, size and node, of the tokens that two nodes or more have."""
    import pyarrow as pa

    own: dict[int, list] = {}
    for batch in batches:
        for bucket, entries in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist()):
            own.setdefault(bucket, []).append(np.frombuffer(entries, ENTRY))
    for bucket, parts in own.items():
        e = np.concatenate(parts)
        e = e[np.lexsort((e["node"], e["n"], e["token"]))]
        e = e[np.concatenate([[True], (e["token"][1:] != e["token"][:-1]) | (e["node"][1:] != e["node"][:-1])])]
        edge = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1], [True]]))
        e = e[np.repeat(np.diff(edge) > 1, np.diff(edge))]
        if len(e):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([e.tobytes()], pa.binary())], ["bucket", "entries"])


def _fits(a, b):
    """Whether the pair's sizes and positions leave a chance; a is the smaller."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    rest = np.minimum(na - a["pos"], nb - b["pos"])
    return (SIMILAR[1] * na >= SIMILAR[0] * nb) & (rest >= required(na, nb))


def _batches(pairs: list[tuple[np.ndarray, np.ndarray]]):
    import pyarrow as pa

    if pairs:
        p = np.unique(np.stack([np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])


def _pairs(x: np.ndarray, y: np.ndarray):
    return np.minimum(x["node"], y["node"]), np.maximum(x["node"], y["node"])


def blocks(e: np.ndarray, root: np.ndarray):
    """(from, to, from, to) of the pairs of a list's blocks that sizes, positions and relations leave a chance; the others are skipped whole.

    The list is sorted by size, and a block's bounds are its least and largest size, the most that any position leaves,
    and its least and largest relation.
    """
    first = np.arange(0, len(e), BLOCK)
    last = np.minimum(first + BLOCK, len(e))
    n = e["n"].astype(np.int64)
    low, high, rest = n[first], n[last - 1], np.maximum.reduceat(n - e["pos"], first)
    least, most = np.minimum.reduceat(root, first), np.maximum.reduceat(root, first)
    for x in range(len(first)):
        y = np.arange(x, np.searchsorted(low, high[x] * SIMILAR[1] // SIMILAR[0], "right"))
        one = (least[x] == most[x]) & (least[y] == most[y]) & (least[x] == least[y])
        y = y[(np.minimum(rest[x], rest[y]) >= required(low[x], low[y])) & ~one]
        for k in y.tolist():
            yield int(first[x]), int(last[x]), int(first[k]), int(last[k])


class _Bucket:
    """A bucket's lists with what is known of their nodes: bitmaps and, in step 2, relations."""

    def __init__(self, entries: bytes, node: np.ndarray, bitmap: np.ndarray):
        e = np.frombuffer(entries, ENTRY)
        at = np.minimum(np.searchsorted(node, e["node"]), max(len(node) - 1, 0))
        own = node[at] == e["node"] if len(node) else np.zeros(len(e), bool)
        self.e, self.at, self.bitmap = e[own], at[own], bitmap
        edge = np.flatnonzero(np.concatenate([[True], self.e["token"][1:] != self.e["token"][:-1], [True]])) if len(self.e) else np.zeros(1, np.int64)
        self.begin, self.size = edge[:-1], np.diff(edge)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sizes, positions and bitmaps leave the pairs of entries a chance."""
        x, y = self.e[i], self.e[j]
        swap = x["n"] > y["n"]
        n = x["n"].astype(np.int64) + y["n"]
        out = (x["node"] != y["node"]) & _fits(np.where(swap, y, x), np.where(swap, x, y))
        k = np.flatnonzero(out)
        differ = np.bitwise_count(self.bitmap[self.at[i[k]]] ^ self.bitmap[self.at[j[k]]]).sum(1).astype(np.int64)
        out[k] = differ <= n[k] - 2 * required(n[k], 0)
        return out

    def pairs(self, i: np.ndarray, j: np.ndarray):
        return _pairs(self.e[i], self.e[j])

    def leaders(self, rounds: int = 8):
        """Step 1: (leader, node). Short lists: their node of least name with each other one. Long lists: the node nearest to the list's
        majority, which alike sets have in their middle, with all that are near it; then the same among the rest."""
        out = []
        short = self.size <= SHORT_LIST
        begin, size = self.begin[short], self.size[short]
        if len(begin):
            which = np.repeat(np.arange(len(begin)), size)
            member = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            low = np.minimum.reduceat(self.e["node"][member], np.cumsum(size) - size)
            lead = member[self.e["node"][member] == low[which]][which]
            own = self.near(lead, member)
            out.append((self.e["node"][lead[own]], self.e["node"][member[own]]))
        for a, k in zip(self.begin[~short].tolist(), self.size[~short].tolist()):
            left = np.arange(a, a + k)
            for _ in range(rounds):
                if len(left) < 2:
                    break
                bits = np.unpackbits(self.bitmap[self.at[left]], axis=1)
                major = bits.mean(0) > 0.5
                lead = left[np.argmin((bits != major).sum(1))]
                own = self.near(np.full(len(left), lead), left)
                out.append((np.full(int(own.sum()), self.e["node"][lead]), self.e["node"][left[own]]))
                left = left[~own & (left != lead)]
        yield from _batches(out)

    def cross(self, root: np.ndarray):
        """Step 2: pairs of different relations (root: of each entry). Lists of one relation are skipped, and in long lists the
        blocks that cannot hold a pair."""
        if not len(self.begin):
            return
        mixed = np.minimum.reduceat(root, self.begin) != np.maximum.reduceat(root, self.begin)
        out, made = [], 0
        for k in range(2, SHORT_LIST + 1):
            own = self.begin[mixed & (self.size == k)]
            x, y = np.triu_indices(k, 1)
            for at in range(0, len(own), 1 << 16):
                i, j = ((own[at : at + (1 << 16), None] + z).ravel() for z in (x, y))
                other = root[i] != root[j]
                i, j = i[other], j[other]
                near = self.near(i, j)
                out.append(self.pairs(i[near], j[near]))
        long = mixed & (self.size > SHORT_LIST)
        for a, k in zip(self.begin[long].tolist(), self.size[long].tolist()):
            for x0, x1, y0, y1 in blocks(self.e[a : a + k], root[a : a + k]):
                i, j = (z.ravel() for z in np.meshgrid(np.arange(a + x0, a + x1), np.arange(a + y0, a + y1), indexing="ij"))
                own = (i < j) & (root[i] != root[j])
                i, j = i[own], j[own]
                near = self.near(i, j)
                if near.any():
                    out.append(self.pairs(i[near], j[near]))
                    made += int(near.sum())
            if made > 200_000:
                yield from _batches(out)
                out, made = [], 0
        yield from _batches(out)


def _buckets(batches):
    for batch in batches:
        for k, entries in enumerate(batch.column("entries").to_pylist()):
            x = batch.column("names")[k]
            node = np.asarray(x.values.field("node"))
            bitmap = np.frombuffer(b"".join(x.values.field("bitmap").to_pylist()), "u1").reshape(-1, BITS // 8)
            node, at = np.unique(node, return_index=True)
            yield _Bucket(entries, node, bitmap[at]), batch, k


def first_pairs(batches):
    for bucket, _, _ in _buckets(batches):
        yield from bucket.leaders()


def cross_pairs(batches):
    for bucket, batch, k in _buckets(batches):
        x, root = batch.column("roots")[k], bucket.e["node"].copy()
        if x.is_valid and len(root):
            node, own = (np.asarray(x.values.field(c)) for c in ("node", "root"))
            node, at = np.unique(node, return_index=True)
            k = np.minimum(np.searchsorted(node, root), len(node) - 1)
            root = np.where(node[k] == root, own[at][k], root)
        yield from bucket.cross(root)


def _near(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the pairs that wide bitmaps leave, the sets of their nodes and of `also`). nodes: node, doc_id (one that has the set); both are written."""
    left = written(pairs, "near")
    wanted = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node")))
    wanted = (wanted.union(also.select("node")) if also is not None else wanted).distinct().join(nodes.select("node", "doc_id"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(wanted), "doc_id")

    def full(batches):
        import pyarrow as pa

        for rows, held in _texts(batches, "node"):
            found = [(r[0], len(s), _bitmap(s, WIDE_BITS), _short(s)) for r, s in zip(rows, shingle_sets(held, WORDS)) if len(s) and node_of(s) == r[0]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["node", "n", "bits", "tokens"])

    # rows that repeat a doc_id and its set give it more than once
    made = written(arrow_map(texts, full, "node long, n long, bits binary, tokens binary").dropDuplicates(["node"]), "tokens")

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(-1, WIDE_BITS // 8) for c in ("x", "y"))
                n = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
                own = pa.array(np.bitwise_count(x ^ y).sum(1).astype(np.int64) <= n - 2 * required(n, 0))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(own) for c in ("a", "b")], ["a", "b"])

    # long sets fill the small bitmaps: the wide ones decide which sets have to meet
    x, y = made.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), made.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    return written(arrow_map(left.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y"), near, "a long, b long"), "near"), made


def computed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of pairs (a, b), from their whole sets, with what b's lacks and has beyond a's (minus, plus). Each b is tried
    with its least a only. Written; the sets go."""
    num, den = SIMILAR
    left, made = _near(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), nodes, docs)

    def exact(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                s, t = _wide(x), _wide(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if den * both >= num * (len(s) + len(t) - both):
                    out.append((a, b, _short(np.setdiff1d(s, t, assume_unique=True)), _short(np.setdiff1d(t, s, assume_unique=True))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["a", "b", "minus", "plus"])

    x, y = made.select(F.col("node").alias("a"), F.col("tokens").alias("x")), made.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    out = written(arrow_map(left.join(x, "a").join(y, "b").select("a", "b", "x", "y"), exact, "a long, b long, minus binary, plus binary"), "links")
    remove_table(made)
    return out


def _has(t: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of t are in the sorted s."""
    if not len(s):
        return np.zeros(len(t), bool)
    return s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t


def overlap(r: np.ndarray, s: np.ndarray, both: int, minus_a, plus_a, minus_b, plus_b) -> int:
    """The overlap of a = r - minus_a + plus_a with b = s - minus_b + plus_b, from that of r with s and the differences alone."""
    both += int(_has(plus_a, s).sum()) - int(_has(minus_a, s).sum())
    in_a = lambda t: (_has(t, r) & ~_has(t, minus_a)) | _has(t, plus_a)
    return both + int(in_a(plus_b).sum()) - int(in_a(minus_b).sum())


def derived(pairs: DataFrame, like: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of pairs (a, b), by answers of like sets. like: what computed() gave; a set b there has the like set a.

    All pairs whose like sets are the same two meet with these sets, DERIVED pairs at a time: the overlap of the two is
    computed once, and each pair's follows from it by its differences. A set without a like one stands for itself.
    """
    num, den = SIMILAR
    left, made = _near(pairs.distinct(), nodes, docs, also=like.select(F.col("a").alias("node")))
    for side in "ab":
        own = like.select(F.col("b").alias(side), F.col("a").alias(f"r{side}"), F.col("minus").alias(f"m{side}"), F.col("plus").alias(f"p{side}"))
        left = left.join(own, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    left = written(left, "near")
    groups = left.groupBy("ra", "rb").agg(F.ceil(F.count("*") / DERIVED).alias("parts"))
    dealt = left.join(groups, ["ra", "rb"]).withColumn("part", F.pmod(F.xxhash64("a", "b"), "parts"))
    dealt = dealt.groupBy("ra", "rb", "part").agg(F.collect_list(F.struct("a", "b", "ma", "pa", "mb", "pb")).alias("own"))  # about DERIVED each

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                r, s = _wide(batch.column("x")[k].as_py()), _wide(batch.column("y")[k].as_py())
                first, out = len(np.intersect1d(r, s, assume_unique=True)), []
                for z in batch.column("own")[k].as_py():
                    ma, pa_, mb, pb = (_wide(z[c] or b"") for c in ("ma", "pa", "mb", "pb"))
                    both = overlap(r, s, first, ma, pa_, mb, pb)
                    if den * both >= num * (len(r) - len(ma) + len(pa_) + len(s) - len(mb) + len(pb) - both):
                        out.append((z["a"], z["b"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    x, y = made.select(F.col("node").alias("ra"), F.col("tokens").alias("x")), made.select(F.col("node").alias("rb"), F.col("tokens").alias("y"))
    out = written(arrow_map(dealt.join(x, "ra").join(y, "rb").select("x", "y", "own"), run, "a long, b long"), "links")
    remove_table(made)
    return out


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (columns doc_id, text; others are ignored).

    Documents without words (null, empty, blank) have an empty set, which links with nothing: component_id is their own
    doc_id. Rows that repeat a doc_id are copies if their texts have one set, and otherwise lie in different components
    unless linked. A null doc_id may be a copy of others but names no component unless it is alone.
    """
    made = written(sets(docs), "sets")
    own = made.where("kind = 0")
    nodes = written(own.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "nodes")
    # a node goes to each bucket that has one of its tokens: a quarter as many buckets as partitions keep these few; more of
    # them where entries are so many that a bucket would grow beyond its bytes
    num, den = SIMILAR
    entries = nodes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4, -(-int(entries) * ENTRY.itemsize // BUCKET_BYTES))
    order = _order(made)
    # texts give their entries once; what is left of a bucket is one row, so that no step below deals entries anew
    dealt = lists(docs, order, buckets).repartitionById(buckets, F.col("bucket"))
    posted = written(arrow_map(dealt, shared_lists, "bucket int, entries binary"), "lists")
    member = arrow_map(posted, _members, "bucket int, node long")
    # at most as long as the bucket's own entries
    known = member.join(nodes.select("node", "bitmap"), "node").groupBy("bucket").agg(F.collect_list(F.struct("node", "bitmap")).alias("names"))
    posted = written(posted.join(known, "bucket"), "lists")
    first = computed(arrow_map(posted, first_pairs, "a long, b long"), nodes, docs)
    relation = written(components(first.select(F.col("a").alias("u"), F.col("b").alias("v"))), "relations")
    roots = arrow_map(posted, _members, "bucket int, node long").join(relation, "node").groupBy("bucket").agg(F.collect_list(F.struct("node", "root")).alias("roots"))
    second = derived(arrow_map(posted.join(roots, "bucket", "left"), cross_pairs, "a long, b long"), first, nodes, docs)
    links = first.select("a", "b").union(second).select(F.col("a").alias("u"), F.col("b").alias("v"))
    root = components(links)
    least = nodes.join(root, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    name = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = least.join(name, "root").select("node", "component_id")
    return own.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _members(batches):
    """bucket, node of every node in a bucket."""
    import pyarrow as pa

    for batch in batches:
        for bucket, entries in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist()):
            node = np.unique(np.frombuffer(entries, ENTRY)["node"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), bucket, "i4")), pa.array(node)], ["bucket", "node"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the least doc_id of each component, all columns. Rows without words or without doc_id all stay; of
    rows that repeat a kept doc_id one with each text stays."""
    names = docs.columns
    found = join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    # a doc_id may be repeated: of equal rows one is enough
    ids = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    left = docs.join(small(found), "doc_id", "left_anti").select(names)
    if not ids.head(1):
        return left
    repeats = small(ids)
    return left.join(repeats, "doc_id", "left_anti").select(names).union(left.join(repeats, "doc_id", "left_semi").select(names).dropDuplicates(["doc_id", "text"]))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
