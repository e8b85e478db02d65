"""Near copies among embeddings by an epsilon grid order join (after Boehm et al., 2001).

Unit vectors are turned to their principal axes; a grid of the join's radius on the leading axes orders them. Runs of
that order are blocks of bounded bytes with a box. Blocks, then halves of blocks, are joined recursively; two intervals
whose boxes lie further apart than the radius are skipped. In a leaf the leading axes and the length of what the others
hold bound each cosine from above, and whole vectors meet only where that bound leaves a chance. Rotation, boxes and bounds
decide only what is skipped: a link is a cosine of the vectors themselves, in double precision.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, put, shared_path, small, store, table, written
from .graph import components

COSINE = 0.95
#: Leading axes of the grid and the boxes, and vectors from which the axes are taken.
AXES, FITTED = 16, 20_000
#: Vectors of a block at least, its bytes at most, blocks that give small tables tasks enough, vectors of a leaf, partners in a row.
BLOCK, BLOCK_BYTES, SPREAD, LEAF, PARTNERS = 1024, 4 << 20, 48, 256, 16
#: What rounding may move a coordinate of a unit vector, and a bound in single precision.
SLACK, BOUND_SLACK = 1e-7, 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def radius(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK


def bounding(p: np.ndarray) -> np.ndarray:
    """Leading coordinates of unit vectors and the length of the rest: products of these rows are at least the cosines."""
    rest = np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))
    return np.concatenate([p, rest[:, None]], 1).astype("f4")


def apart(lo_a, hi_a, lo_b, hi_b, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    return bool((gap * gap).sum() > eps * eps)


class _Join:
    """The recursion over two blocks (or one with itself)."""

    def __init__(self, axes: np.ndarray, cosine: float):
        self.axes, self.cosine, self.eps = axes, cosine, radius(cosine)

    def run(self, a, b, same: bool):
        """a, b: (node, copies, unit vectors), in grid order. Returns links of each row of a and of b, and star edges."""
        self.a, self.b, self.same = a, b, same
        self.pa, self.pb = a[2] @ self.axes, b[2] @ self.axes
        self.fa, self.fb = bounding(self.pa), bounding(self.pb)
        self.na, self.nb = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
        self.parent: dict[int, int] = {}
        self._go(0, len(a[0]), 0, len(b[0]))
        edges = [(x, self._find(x)) for x in self.parent]
        return self.na, self.nb, [(x, r) for x, r in edges if x != r]

    def _find(self, x: int) -> int:
        p = self.parent
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def _go(self, i0, i1, j0, j1):
        if i0 >= i1 or j0 >= j1 or (self.same and j1 <= i0):
            return
        if apart(self.pa[i0:i1].min(0), self.pa[i0:i1].max(0), self.pb[j0:j1].min(0), self.pb[j0:j1].max(0), self.eps):
            return
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            return self._leaf(i0, i1, j0, j1)
        cut_i = [(i0, i1)] if i1 - i0 <= LEAF else [(i0, (i0 + i1) // 2), ((i0 + i1) // 2, i1)]
        cut_j = [(j0, j1)] if j1 - j0 <= LEAF else [(j0, (j0 + j1) // 2), ((j0 + j1) // 2, j1)]
        for i in cut_i:
            for j in cut_j:
                self._go(*i, *j)

    def _leaf(self, i0, i1, j0, j1):
        near = self.fa[i0:i1] @ self.fb[j0:j1].T >= self.cosine - BOUND_SLACK
        if self.same and i0 == j0:
            np.fill_diagonal(near, False)
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            return
        near[np.ix_(rows, cols)] &= self.a[2][i0:i1][rows] @ self.b[2][j0:j1][cols].T >= self.cosine
        if self.same:
            near &= np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None]
        if not near.any():
            return
        self.na[i0:i1] += near @ self.b[1][j0:j1]
        self.nb[j0:j1] += near.T @ self.a[1][i0:i1]
        # labels of the leaf's components: the least row or column number that reaches one
        x, y = np.arange(i1 - i0), np.full(j1 - j0, LEAF + 1)
        while True:
            y2 = np.where(near, x[:, None], LEAF + 1).min(0)
            x2 = np.minimum(x, np.where(near, y2[None], LEAF + 1).min(1))
            if (x2 == x).all() and (y2 == y).all():
                break
            x, y = x2, y2
        for node, label in [*zip(self.a[0][i0:i1][near.any(1)].tolist(), x[near.any(1)].tolist()), *zip(self.b[0][j0:j1][near.any(0)].tolist(), y[near.any(0)].tolist())]:
            p, q = self._find(node), self._find(int(self.a[0][i0 + label]))
            if p != q:
                self.parent[max(p, q)] = min(p, q)


def partners(lo: np.ndarray, hi: np.ndarray, i: int, eps: float) -> list[int]:
    """The blocks from i on whose boxes are not apart from its own, by recursion over intervals of the sequence."""
    out = []

    def go(j0, j1):
        if j0 >= j1 or apart(lo[i], hi[i], lo[j0:j1].min(0), hi[j0:j1].max(0), eps):
            return
        if j1 - j0 == 1:
            out.append(j0)
            return
        m = (j0 + j1 + 1) // 2
        go(j0, m)
        go(m, j1)

    go(i, len(lo))
    return out


def links(classes: DataFrame, size: int, cosine: float) -> DataFrame:
    """kind 0: links (v) of node u that one pair of blocks gives; kind 1: an edge u, v. classes: node, vector, copies; all of one size.

    Blocks are files in the shared folder; a task takes a block and some of its partners and reads them there. The driver
    has the blocks' boxes only: 2 * AXES numbers for BLOCK_BYTES of vectors.
    """
    spark = classes.sparkSession
    n = classes.count()
    fitted = _unit(np.array([r[0] for r in classes.orderBy(F.xxhash64("node")).limit(FITTED).select("vector").collect()], "f8").reshape(-1, size))
    axes = np.linalg.eigh(np.cov(fitted.T) if len(fitted) > 1 else np.eye(size))[1][:, ::-1][:, :AXES] if size > 1 else np.eye(1)
    eps = radius(cosine)
    block = max(1, min(max(BLOCK, -(-n // SPREAD)), BLOCK_BYTES // (8 * size) or 1))
    path = shared_path(spark, "blocks")

    def located(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                cell = np.clip(np.floor(_unit(v) @ axes / eps) + 32768, 0, 65535).astype(">u2")
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), batch.column("vector"), pa.array([c.tobytes() for c in cell], pa.binary())], ["node", "copies", "vector", "cell"])

    kind = classes.schema["vector"].dataType.simpleString()
    ordered = arrow_map(classes, located, f"node long, copies long, vector {kind}, cell binary")
    parts = max(1, -(-n // (8 * block)))
    ordered = ordered.repartitionByRange(parts, "cell", "node").sortWithinPartitions("cell", "node")

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, top = store(path)
        fs.create_dir(top, recursive=True)
        part, made, own, held = TaskContext.get().partitionId(), 0, [], 0

        def done(rows):
            nonlocal made
            node, copies, v = (np.concatenate(x) for x in zip(*rows))
            p = _unit(v) @ axes
            name = f"{part:08d}-{made:08d}"
            made += 1
            put(fs, f"{top}/{name}", node.astype("<i8").tobytes() + copies.astype("<i8").tobytes() + v.astype("<f8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([p.min(0).tolist()], pa.list_(pa.float64())), pa.array([p.max(0).tolist()], pa.list_(pa.float64()))], ["block", "lo", "hi"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, block - held)
                own.append((some.column("node").to_numpy(), some.column("copies").to_numpy(), some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)))
                held, at = held + some.num_rows, at + some.num_rows
                if held == block:
                    yield done(own)
                    own, held = [], 0
        if own:
            yield done(own)

    boxes = sorted(tuple(r) for r in written(arrow_map(ordered, blocks, "block string, lo array<double>, hi array<double>"), "boxes").collect())
    if not boxes:
        return spark.createDataFrame([], "kind int, u long, v long")
    shared = spark.sparkContext.broadcast(([b[0] for b in boxes], *(np.array([b[k] for b in boxes]) for k in (1, 2))))

    def met(batches):
        import pyarrow as pa

        _, lo, hi = shared.value
        for batch in batches:
            for i in batch.column("id").to_pylist():
                own = partners(lo, hi, i, eps)
                rows = [own[at : at + PARTNERS] for at in range(0, len(own), PARTNERS)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["a", "bs"])

    todo = arrow_map(spark.range(len(boxes)), met, "a long, bs array<long>")
    tasks = max(1, min(len(boxes) * (len(boxes) // PARTNERS + 1), 4 * spark.sparkContext.defaultParallelism))
    todo = written(todo.repartition(tasks), "partners")

    def run(batches):
        import pyarrow as pa

        names = shared.value[0]
        fs, top = store(path)
        join = _Join(axes, cosine)

        def take(i):
            with fs.open_input_stream(f"{top}/{names[i]}") as f:
                data = f.read()
            k = len(data) // (16 + 8 * size)
            return np.frombuffer(data, "<i8", k), np.frombuffer(data, "<i8", k, 8 * k), _unit(np.frombuffer(data, "<f8", k * size, 16 * k).reshape(-1, size))

        for batch in batches:
            for i, js in zip(batch.column("a").to_pylist(), batch.column("bs").to_pylist()):
                a = take(i)
                for j in js:
                    b = a if i == j else take(j)
                    na, nb, edges = join.run(a, b, i == j)
                    u = np.concatenate([a[0][na > 0], b[0][nb > 0], np.array([e[0] for e in edges], np.int64)])
                    v = np.concatenate([na[na > 0], nb[nb > 0], np.array([e[1] for e in edges], np.int64)])
                    what = np.concatenate([np.zeros(len(u) - len(edges), "i4"), np.ones(len(edges), "i4")])
                    yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(u), pa.array(v)], ["kind", "u", "v"])

    return arrow_map(todo.repartition(tasks), run, "kind int, u long, v long")


def near_copies(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (columns vec_id, embedding; others are ignored).

    Links: cosine >= `cosine` in double precision, between vectors of one length. A vector that is null, empty, zero or
    holds a null or non-finite component links with nothing, nor does one without vec_id (its component_id is null and
    it is kept). Equal vectors are one class; copies count as links. Rows that repeat a vec_id are vectors of their own.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    good = F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    # 128 bits tell vectors apart in the shuffle and in the last join; a class has a number of its own between them
    rows = vectors.withColumns({"h1": F.when(good, F.xxhash64("vector")), "h2": F.when(good, F.xxhash64(F.lit(1), "vector"))})
    classes = rows.where("h1 is not null").groupBy("h1", "h2", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = None
    for (size,) in sorted(classes.select(F.size("vector")).distinct().collect()):
        own = links(classes.where(F.size("vector") == size).select("node", "vector", "copies"), size, cosine)
        found = own if found is None else found.union(own)
    alone = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    found = written(found, "found")
    counts = found.where("kind = 0").groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("n"))
    root = components(found.where("kind = 1").select("u", "v"))
    named = classes.select("node", "h1", "h2", "copies", "first").join(counts, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(small(named), ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))
