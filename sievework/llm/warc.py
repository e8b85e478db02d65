"""Web archives: WARC files with revisit records, read back, and a global index of captures by loser-tree merging."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, put, shared_path, store, table, written

#: Uncompressed bytes of a file, but for a single longer record.
FILE_BYTES = 32 << 20
#: Bytes of a compressed record that are read at once.
PIECE = 16 << 10
#: Rows of the index that one task merges, about.
MERGE_ROWS = 200_000
#: Captures without a time of their own are dated by this second plus their id.
EPOCH = 1_704_067_200
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
RUN = "url_key string, captured string, page_id long, run long, file string, offset long, length long"


def url_key(url):
    """Sort-friendly key: reversed host, then the path, in lower case; a null or odd URL is its own key."""
    url = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    rest = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest)))


def verdicts(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with the payload's `digest` and `refers_to`: the response's page_id where a row is a revisit.

    Payloads move once, dealt by their page_id; the digests' groups, which may be large, are only counted and joined.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")))
    pages = pages.withColumn("digest", digest)
    ids = pages.select("page_id", "digest", F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    first = ids.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1").drop("k")
    other = ids.join(first, "digest").where("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()
    p, o = pages.alias("p"), other.alias("o")
    return p.join(o, F.col("p.page_id").eqNullSafe(F.col("o.page_id")) & (F.col("p.digest") == F.col("o.digest")), "left").select("p.*", "o.refers_to")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, captured: str, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit without the payload."""
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:none"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {captured}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one uncompressed record; a response's digest and size are taken from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    out = {"page_id": number(fields["warc-record-id"]), "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to", ""))}
    if out["record_type"] == "revisit":
        size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
        return out | {"payload_bytes": size, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload": None}
    return out | {"payload_bytes": len(payload), "payload_digest": payload_digest(payload), "payload": payload}


def members(data: bytes):
    """(offset, length, record) of each gzip member, read PIECE bytes at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out, end = zlib.decompressobj(31), [], at
        while not z.eof:
            if end >= len(view):
                raise ValueError("an archive ends within a record")
            out.append(z.decompress(view[end : end + PIECE]))
            end = min(end + PIECE, len(view))
        end -= len(z.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row (columns page_id, url, html and, if there, captured) to .warc.gz files under `path`.

    Returns the index runs: each task sorts its captures by URL key and time, writes its files in that order and gives
    one run of index rows. Among equal payloads of at least least_bytes bytes the row with the largest page_id is the
    response (rows that repeat it too), the others are revisits. A null html is empty; a null url and page_id are kept.
    Rows that tie in all of that have equal records, so a task that runs again writes the same bytes.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, top = store(path)
        fs.create_dir(top, recursive=True)
        part, seq, held, size, rows = TaskContext.get().partitionId(), 0, [], [0, 0], []
        name = lambda: f"{part:06d}-{seq:05d}.warc.gz"

        def done():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], [f.split()[0] for f in RUN.split(", ")])
            put(fs, f"{top}/{name()}", b"".join(held))
            return out

        for batch in batches:
            for key, when, page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "url", "html", "refers_to"))):
                data = record(page, url, when, (html or "").encode(), refers)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = z.compress(data) + z.flush()
                if rows and size[0] + len(data) > FILE_BYTES:
                    yield done()
                    seq, held, size, rows = seq + 1, [], [0, 0], []
                rows.append((key, when, page, part, name(), size[1], len(packed)))
                held.append(packed)
                size = [size[0] + len(data), size[1] + len(packed)]
        if rows:
            yield done()

    when = F.col("captured").cast("string") if "captured" in pages.columns else F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pages = pages.select("page_id", "url", "html", F.coalesce(when, F.lit("1970-01-01T00:00:00Z")).alias("captured"))
    ordered = verdicts(pages, least_bytes).withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions("url_key", "captured", "page_id", "digest", "url", "refers_to")
    return written(arrow_map(ordered, run, RUN), "runs")


def loser_tree(runs: list[list]):
    """Merges sorted runs by a tournament of losers: each step replays one path of the tree."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    head = lambda i: runs[i][at[i]] if at[i] < len(runs[i]) else None

    def beats(i, j):
        if i < 0 or j < 0:
            return i < 0  # an empty seat wins while the tree is filled
        x, y = head(i), head(j)
        return y is None or (x is not None and (x < y or (x == y and i < j)))

    tree = [-1] * k

    def replay(i):
        node = (i + k) // 2
        while node:
            if not beats(i, tree[node]):
                i, tree[node] = tree[node], i
            node //= 2
        tree[0] = i

    for i in range(k - 1, -1, -1):
        replay(i)
    while (x := head(tree[0])) is not None:
        yield x
        at[tree[0]] += 1
        replay(tree[0])


def merge_index(runs: DataFrame) -> DataFrame:
    """The index in one global order of URL key, time, page_id, file and offset: range `part`, then `pos` in it.

    Ranges are cut on the whole key, so that one host or URL may fill many of them; a task merges the pieces of the
    runs that fall in its range.
    """
    rows = runs.count()
    parts = max(1, -(-rows // MERGE_ROWS))
    order = ["url_key", "captured", "page_id", "file", "offset"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own: dict[int, list] = {}
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("run", "url_key", "captured", "page_id", "file", "offset", "length"))):
                own.setdefault(r[0], []).append((r[1], r[2], -(1 << 63) if r[3] is None else r[3], r[4], r[5], r[6]))
        merged = list(loser_tree([own[k] for k in sorted(own)]))
        part = TaskContext.get().partitionId()
        for at in range(0, len(merged), 10_000):
            some = merged[at : at + 10_000]
            key, when, page, file, offset, length = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(key, pa.string()), pa.array(when, pa.string()), pa.array([None if p == -(1 << 63) else p for p in page], pa.int64()), pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["part", "pos", "url_key", "captured", "page_id", "file", "offset", "length"])

    # a run's piece arrives in order
    dealt = runs.repartitionByRange(parts, *order).sortWithinPartitions("run", *order)
    return arrow_map(dealt, run, "part long, pos long, url_key string, captured string, page_id long, file string, offset long, length long")


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives under `path`: file, offset, page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                rows, held = [], 0
                for offset, _, data in members(content):
                    r = parse(data)
                    rows.append((file, offset, r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] if with_payload else None))
                    held += len(data)
                    if held > 8 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    names = ["file", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def made(rows):
        import pyarrow as pa

        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "file string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return arrow_map(files, run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    runs = write_archives(table(spark, sf_dir, "pages"), path)
    if not runs.head(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, index_part long, index_pos long")
    index = merge_index(runs).select("file", "offset", F.col("part").alias("index_part"), F.col("pos").alias("index_pos"))
    return indexed(read_archives(spark, path).drop("payload"), index)


def indexed(records: DataFrame, index: DataFrame) -> DataFrame:
    """The records with their places in the index; a record or an entry without the other stops the job."""
    both = records.withColumn("read", F.lit(True)).join(index, ["file", "offset"], "full")
    whole = F.col("read") & F.col("index_pos").isNotNull()
    lost = F.raise_error(F.concat(F.lit("record and index differ at "), F.col("file"), F.lit(":"), F.col("offset").cast("string")))
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "index_part", F.when(whole, F.col("index_pos")).otherwise(lost.cast("long")).alias("index_pos"))
