"""Files of any size as windows of text: byte ranges that overlap, so that no text has to fit into one cell.

`spark.read.format("text_windows").load(path)` gives a row a window: file, start (the byte at which its own part begins), lead (characters
of `text` before that part), chars (characters of that part) and text: what overlaps before, the own part, what overlaps behind. Own parts
lie side by side and make up the file; an empty file is one empty window. Options, in bytes: window (1 MiB), overlap (16 KiB, which holds
4,096 characters whatever they are) and partition (128 MiB: what a task reads, out of large files or of many small ones).

Ranges are cut between characters; bytes that are no UTF-8 are replaced. A lost task reads its ranges again. Windows leave a task in batches of
about 4 MiB of text, whatever a batch's number of rows may be elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "text_windows"
SCHEMA = "file string, start long, lead int, chars int, text string"
#: Bytes of text in a batch that goes to the JVM; a larger window is a batch.
BATCH = 4 << 20
DEFAULTS = {"window": 1 << 20, "overlap": 4 * 4096, "partition": 128 << 20}


class Ranges(InputPartition):
    """Own parts of one task: (path, file's size, first byte, byte after the last)."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def boundary(data: bytes, at: int) -> int:
    """The first position from `at` on where a character begins or the file ends; four further bytes in a row are of no character, and cut there."""
    for k in range(at, min(at + 4, len(data))):
        if data[k] & 0xC0 != 0x80:
            return k
    return at if at + 4 <= len(data) else len(data)


class WindowReader(DataSourceReader):
    def __init__(self, path: str, window: int, overlap: int, partition: int):
        if window < 4 or overlap < 0 or partition < 1:
            raise ValueError("a window has 4 bytes or more, an overlap none or more, a partition one or more")
        self.path, self.window, self.overlap, self.partition = path, window, overlap, max(partition, window)

    def partitions(self):
        from pyarrow import fs

        store, top = _store(self.path)
        info = store.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(top, recursive=True))
        hidden = lambda p: any(x[:1] in ("_", ".") for x in p[len(top) :].split("/"))
        out, now, held = [], [], 0
        step = self.partition // self.window * self.window
        for i in sorted((i for i in found if i.is_file and not hidden(i.path)), key=lambda i: i.path):
            for begin in range(0, max(i.size, 1), step):
                end = min(begin + step, i.size)
                if now and held + end - begin > self.partition:
                    out, now, held = [*out, Ranges(now)], [], 0
                now.append((i.path, i.size, begin, end))
                held += end - begin
        return [*out, Ranges(now)] if now else []

    def read(self, partition):
        """Arrow batches: rows would be gathered by their number, ten thousand windows at once."""
        import pyarrow as pa

        names, kinds = ["file", "start", "lead", "chars", "text"], [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for row in self._windows(partition):
            rows.append(row)
            held += len(row[-1].encode())
            if held >= BATCH or len(rows) >= 10_000:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    def _windows(self, partition):
        store, _ = _store(self.path)
        for path, size, first, last in partition.parts:
            with store.open_input_file(path) as f:
                for begin in range(first, max(last, first + 1), self.window):
                    end = min(begin + self.window, last)
                    low, high = max(begin - self.overlap, 0), min(end + self.overlap, size)
                    f.seek(low)
                    data = f.read(min(high + 4, size) - low)
                    cuts = [boundary(data, at - low) if 0 < at < size else at - low for at in (low, begin, end, high)]
                    before, own, behind = (data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:]))
                    yield path, low + cuts[1], len(before), len(own), before + own + behind


class TextWindows(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WindowReader(self.options["path"], **{k: int(self.options.get(k, v)) for k, v in DEFAULTS.items()})


def text_windows(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The windows of a file, or of all files below a folder."""
    spark.dataSource.register(TextWindows)
    return spark.read.format(NAME).options(**options).load(path)
