"""Packing by powers of two: a document's ids are cut into pieces of binary lengths; pieces of one length share a bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_path, table
from .tokens import BYTE_BPE, crc32, encoded

LONGEST = 2048
SCHEMA = "doc_id long, start long, length long, bucket int, doc_tokens long, ids_crc32 long, ids binary"


def pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length): as many of the longest as fit, then the binary digits of the rest, longest first.

    >>> pieces(4097 + 6)
    [(0, 2048), (2048, 2048), (4096, 4), (4100, 2), (4102, 1)]
    """
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    while at < n:
        out.append((at, 1 << ((n - at).bit_length() - 1)))
        at += out[-1][1]
    return out


def cut(docs: DataFrame, vocabulary: str = BYTE_BPE, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """SCHEMA: the pieces of every document (columns doc_id, text; others are ignored). No row moves between tasks.

    A null or empty text is one piece with the end id; a null doc_id stays null; repeated rows are cut each.
    longest must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        rows, held = [], 0
        for doc, ids in encoded(batches, vocabulary):
            n = len(ids) // 4
            for start, length in pieces(n, longest):
                own = ids[4 * start : 4 * (start + length)]
                rows.append((doc, start, length, length.bit_length() - 1, n, crc32(own), bytes(own) if with_ids else None))
            held += len(ids)
            if len(rows) > 20_000 or held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def bucketed(cuts: DataFrame, path: str) -> DataFrame:
    """The pieces as Parquet under `path`, one folder for each length (bucket, its log2), read back with the sequences' numbers.

    A piece is a sequence: it holds one document's ids, begins at offset 0 and needs no padding. A folder's sequences have
    one shape, and their numbers stand together. A task writes its pieces of a length to one file; no row is shuffled.
    """
    spark = cuts.sparkSession
    cuts.write.partitionBy("bucket").parquet(path)
    back = spark.read.schema(SCHEMA).parquet(path).select(cuts.columns)
    number = F.col("bucket").cast("long") * F.lit(1 << 53) + F.monotonically_increasing_id()
    return back.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long"))


def pack(docs: DataFrame, vocabulary: str = BYTE_BPE, longest: int = LONGEST, with_ids: bool = True, path: str | None = None) -> DataFrame:
    """The documents' pieces (see cut) in buckets of equal length, written under `path` or a new folder in the shared one."""
    return bucketed(cut(docs, vocabulary, longest, with_ids), path or shared_path(docs.sparkSession, "sequences"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
