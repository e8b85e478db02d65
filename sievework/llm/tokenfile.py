"""Token files of patched frame-of-reference blocks: minimum, packed differences, exceptions, an index of block starts."""

from __future__ import annotations

import io
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, put, shared_path, store, table, written
from .tokens import WORD_BPE, crc32, encoded

BLOCK, LANE = 1024, 64
#: Blocks that are packed or unpacked at a time.
STEP = 256
#: Share of a block's values that its packed width must hold; the others are exceptions.
FITTING = 0.95
#: Ids in a file, but for a single longer document.
FILE_TOKENS = 4 << 20
MAGIC = b"SVPFOR01"
_HEAD = struct.Struct("<8sQQQ")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """values: (n, LANE) of less than 2**width; returns (n, width) words."""
    out = np.zeros((len(values), width), "<u8")
    for i in range(LANE if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), LANE), "<u8")
    mask = np.uint64((1 << width) - 1)
    for i in range(LANE if width else 0):
        word, shift = divmod(i * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = x & mask
    return out


def _packed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(minima, widths, exception counts, sizes in bytes, payload) of some whole blocks."""
    v = ids.reshape(-1, BLOCK)
    low = v.min(axis=1)
    d = (v - low[:, None]).astype("<u8")
    bits = np.frexp(d.astype("f8"))[1].astype("u1")  # the bit length
    at = min(BLOCK - 1, int(np.ceil(FITTING * BLOCK)) - 1)
    width = np.partition(bits, at, axis=1)[:, at]
    out_of = bits > width[:, None]
    count = out_of.sum(axis=1).astype("<u2")
    size = width.astype("<u8") * (BLOCK // 8) + count.astype("<u8") * 6
    start = np.concatenate([[0], np.cumsum(size)]).astype("<u8")
    payload = np.zeros(int(start[-1]), "u1")
    kept = np.where(out_of, np.uint64(0), d)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        words = _pack(kept[own].reshape(-1, LANE), int(w)).reshape(len(own), -1).view("u1")
        for k, b in enumerate(own):
            payload[int(start[b]) : int(start[b]) + words.shape[1]] = words[k]
    for b in np.flatnonzero(count):
        where = np.flatnonzero(out_of[b])
        tail = where.astype("<u2").tobytes() + v[b, where].astype("<u4").tobytes()
        payload[int(start[b + 1]) - len(tail) : int(start[b + 1])] = np.frombuffer(tail, "u1")
    return low.astype("<u4"), width, count, size, payload.tobytes()


def write_file(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file's bytes. Header: magic, documents, ids, blocks. Then doc ids (with a null mask), lengths, the blocks'
    minima, widths, exception counts and byte starts, the payload (for each block its words, then its exceptions'
    positions and values). The last block is filled up with its last value. STEP blocks are packed at a time.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    made = []
    for at in range(0, blocks, STEP):
        own = ids[at * BLOCK : (at + STEP) * BLOCK]
        made.append(_packed(np.concatenate([own, np.full(-len(own) % BLOCK, own[-1], "<u4")])))
    empty = (np.zeros(0, "<u4"), np.zeros(0, "u1"), np.zeros(0, "<u2"), np.zeros(0, "<u8"))
    low, width, count, size = (np.concatenate(x) for x in zip(*(m[:4] for m in made))) if made else empty
    start = np.concatenate([[0], np.cumsum(size)]).astype("<u8")
    null = np.array([x is None for x in docs], "u1")
    parts = [_HEAD.pack(MAGIC, len(docs), n, blocks), np.array([x or 0 for x in docs], "<i8"), null, np.array(lengths, "<u8"), low, width, count, start]
    return b"".join([p if isinstance(p, bytes) else p.tobytes() for p in parts] + [m[4] for m in made])


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a file's bytes."""
    magic, n_docs, n, blocks = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    buf = io.BytesIO(data)
    buf.seek(_HEAD.size)
    take = lambda kind, count: np.frombuffer(buf.read(np.dtype(kind).itemsize * count), kind)
    docs, null, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    low, width, count, start = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u8", blocks + 1)
    payload = np.frombuffer(data, "u1", offset=buf.tell())
    v = np.zeros((blocks, BLOCK), "<u4")
    for w in np.unique(width):
        every, size = np.flatnonzero(width == w), int(w) * BLOCK // 8
        for at in range(0, len(every), STEP):
            own = every[at : at + STEP]
            words = np.empty((len(own), size), "u1")
            for k, b in enumerate(own):
                words[k] = payload[int(start[b]) : int(start[b]) + size]
            v[own] = (_unpack(words.view("<u8").reshape(-1, int(w)), int(w)).reshape(len(own), BLOCK) if w else np.zeros((len(own), BLOCK), "<u8")) + low[own, None]
    for b in np.flatnonzero(count):
        tail, k = payload[int(start[b + 1]) - 6 * int(count[b]) : int(start[b + 1])].tobytes(), int(count[b])
        v[b, np.frombuffer(tail, "<u2", k)] = np.frombuffer(tail, "<u4", k, 2 * k)
    return [None if z else int(x) for x, z in zip(docs, null)], lengths, v.reshape(-1)[:n]


def write_tokens(docs: DataFrame, path: str, vocabulary: str = WORD_BPE) -> DataFrame:
    """Writes the ids of every document (columns doc_id, text) in ascending doc_id to files under `path`.

    Returns the manifest: part, seq, file, n_docs, n_tokens; files in the order of (part, seq) hold the documents in
    order. One range shuffle of the texts; a task holds one file's ids at a time. Null doc_ids come first; rows with
    one doc_id are ordered by their text's hash, then text, so that a doc_id with many rows fills many tasks; a null text is empty.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, top = store(path)
        part, made, own, lengths, held, total = TaskContext.get().partitionId(), [], [], [], [], 0
        fs.create_dir(top, recursive=True)

        def flush():
            name = f"{part:06d}-{len(made):05d}.pfor"
            put(fs, f"{top}/{name}", write_file(own, lengths, np.frombuffer(b"".join(held), "<u4")))
            made.append((part, len(made), name, len(own), total))

        for doc, ids in encoded(batches, vocabulary):
            if own and total + len(ids) // 4 > FILE_TOKENS:
                flush()
                own, lengths, held, total = [], [], [], 0
            own.append(doc)
            lengths.append(len(ids) // 4)
            held.append(ids)
            total += len(ids) // 4
        if own:
            flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "file", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    return written(arrow_map(ordered, run, "part long, seq long, file string, n_docs long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files that write_tokens wrote: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    spark = manifest.sparkSession

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, base, content in zip(*(batch.column(c).to_pylist() for c in ("file", "base", "content"))):
                docs, lengths, ids = read_file(content)
                end = np.cumsum(lengths).astype("i8")
                view = memoryview(ids.astype("<u4").tobytes())
                cuts = [view[4 * (e - int(k)) : 4 * e] for e, k in zip(end.tolist(), lengths.tolist())]
                columns = [pa.array(docs, pa.int64()), pa.array(base + end - lengths.astype("i8"), pa.int64()), pa.array(lengths.astype("i8"), pa.int64()), pa.array([crc32(c) for c in cuts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([bytes(c) for c in cuts] if with_ids else [None] * len(cuts), pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    # totals by task of the write, a few numbers, are summed up on the driver
    totals, base = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()), 0
    bases = []
    for part, n in totals:
        bases.append((part, base))
        base += n
    before = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.withColumn("before", before).join(F.broadcast(spark.createDataFrame(bases, "part long, first long")), "part").select("file", (F.col("first") + F.col("before")).alias("base"))
    if not bases:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    # the files' contents stay where they are read: only names and starts, one row a file, go to all
    return arrow_map(files.join(F.broadcast(starts), "file"), run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(manifest, path).select("doc_id", "start", "n_tokens", "ids_crc32")
