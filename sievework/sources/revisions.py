"""Files as they were at a revision, read from the objects of a version store as a data source: no tool is run.

`spark.read.format("revision_files").option("revision", ...).load(folder)` gives file, bytes and content of the files of a commit (its id, a branch or a
tag). The driver walks the commit's folders, which name the files; tasks inflate the contents, loose or packed, and resolve deltas.
"""

from __future__ import annotations

import os
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

NAME = "revision_files"
#: Files that a partition reads.
FILES = 200
_KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


class Objects:
    """The objects below a store's folder, by their hexadecimal ids."""

    def __init__(self, folder: str):
        self.folder = folder
        packs = os.path.join(folder, "objects", "pack")
        self.packs = sorted(os.path.join(packs, f[:-4]) for f in os.listdir(packs) if f.endswith(".idx")) if os.path.isdir(packs) else []

    def get(self, oid: str) -> tuple[str, bytes]:
        """(kind, content) of an object; KeyError without it."""
        loose = os.path.join(self.folder, "objects", oid[:2], oid[2:])
        if os.path.exists(loose):
            with open(loose, "rb") as f:
                head, _, data = zlib.decompress(f.read()).partition(b"\0")
            return head.split()[0].decode(), data
        for pack in self.packs:
            at = self._offset(pack + ".idx", bytes.fromhex(oid))
            if at is not None:
                return self._packed(pack + ".pack", at)
        raise KeyError(oid)

    @staticmethod
    def _offset(index: str, oid: bytes) -> int | None:
        """Where a pack holds an object: a fan of 256 counts, the ids in order, checksums, places; those of 2**31 and more in a table behind."""
        with open(index, "rb") as f:
            if f.read(8) != b"\xfftOc\x00\x00\x00\x02":
                raise ValueError(f"{index} is of another version")
            fan = struct.unpack(">256I", f.read(1024))
            lo, hi, total = fan[oid[0] - 1] if oid[0] else 0, fan[oid[0]], fan[255]
            while lo < hi:
                mid = (lo + hi) // 2
                f.seek(1032 + 20 * mid)
                own = f.read(20)
                if own == oid:
                    f.seek(1032 + 24 * total + 4 * mid)
                    at = struct.unpack(">I", f.read(4))[0]
                    if at >> 31:
                        f.seek(1032 + 28 * total + 8 * (at & 0x7FFFFFFF))
                        at = struct.unpack(">Q", f.read(8))[0]
                    return at
                lo, hi = (mid + 1, hi) if own < oid else (lo, mid)
        return None

    def _packed(self, pack: str, at: int) -> tuple[str, bytes]:
        deltas = []  # a chain is followed to its base, then applied backwards
        while True:
            with open(pack, "rb") as f:
                f.seek(at)
                byte = f.read(1)[0]
                kind, size, shift = byte >> 4 & 7, byte & 15, 4
                while byte & 128:
                    byte = f.read(1)[0]
                    size, shift = size | (byte & 127) << shift, shift + 7
                base = None
                if kind == 6:
                    byte = f.read(1)[0]
                    back = byte & 127
                    while byte & 128:
                        byte = f.read(1)[0]
                        back = (back + 1) << 7 | byte & 127
                    base = at - back
                elif kind == 7:
                    base = f.read(20).hex()
                z, data = zlib.decompressobj(), b""
                while not z.eof and (chunk := f.read(1 << 16)):
                    data += z.decompress(chunk)
            if len(data) != size:
                raise ValueError(f"{pack} is broken at {at}")
            if base is None:
                name = _KINDS[kind]
                break
            deltas.append(data)
            if isinstance(base, str):
                name, data = self.get(base)
                break
            at = base
        for delta in reversed(deltas):
            data = patched(data, delta)
        return name, data

    def commit(self, revision: str) -> str:
        """The id of a commit, branch or tag."""
        for ref in ("", "refs/heads/", "refs/tags/", "refs/remotes/"):
            path = os.path.join(self.folder, ref + revision)
            if os.path.isfile(path):
                with open(path) as f:
                    text = f.read().strip()
                return self.commit(text[5:]) if text.startswith("ref: ") else text
        packed = os.path.join(self.folder, "packed-refs")
        if os.path.exists(packed):
            with open(packed) as f:
                for line in f:
                    oid, _, name = line.strip().partition(" ")
                    if name in {ref + revision for ref in ("", "refs/heads/", "refs/tags/", "refs/remotes/")}:
                        return oid
        if len(revision) == 40:
            return revision
        raise ValueError(f"unknown revision {revision}")

    def files(self, revision: str):
        """(file, id) of a revision's plain files, in order; links and other stores are no files."""
        kind, data = self.get(self.commit(revision))
        while kind == "tag":
            kind, data = self.get(data.split(b"\n", 1)[0].split()[1].decode())
        left = [("", data.split(b"\n", 1)[0].split()[1].decode())]
        while left:
            folder, oid = left.pop()
            tree, inner = self.get(oid)[1], []
            while tree:
                head, _, rest = tree.partition(b"\0")
                mode, name = head.split(b" ", 1)
                path, own, tree = folder + name.decode("utf-8", "surrogateescape"), rest[:20].hex(), rest[20:]
                if mode == b"40000":
                    inner.append((path + "/", own))
                elif mode.startswith(b"100"):
                    yield path, own
            left += reversed(inner)


def patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: copies of ranges and new bytes."""
    at, sizes = 0, []
    for _ in range(2):
        size = shift = 0
        while True:
            byte, at = delta[at], at + 1
            size, shift = size | (byte & 127) << shift, shift + 7
            if not byte & 128:
                break
        sizes.append(size)
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            values = [0, 0]
            for k in range(7):
                if op >> k & 1:
                    values[k // 4] |= delta[at] << 8 * (k if k < 4 else k - 4)
                    at += 1
            start, size = values[0], values[1] or 0x10000
            out += base[start : start + size]
        else:
            out += delta[at : at + op]
            at += op
    if sizes != [len(base), len(out)]:
        raise ValueError("a delta does not fit its base")
    return bytes(out)


class Blobs(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class RevisionReader(DataSourceReader):
    def __init__(self, folder: str, revision: str):
        self.folder, self.revision, self.wanted = folder, revision, None

    def pushFilters(self, filters):
        for f in filters:
            if f.__class__ in (EqualTo, In) and tuple(f.attribute) == ("file",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self):
        own = [x for x in Objects(self.folder).files(self.revision) if self.wanted is None or x[0] in self.wanted]
        return [Blobs(own[k : k + FILES]) for k in range(0, len(own), FILES)]

    def read(self, partition):
        store = Objects(self.folder)
        for file, oid in partition.files if partition is not None else []:
            data = store.get(oid)[1]
            yield file, len(data), data


class RevisionFiles(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return "file string, bytes long, content binary"

    def reader(self, schema):
        folder = self.options["path"].removeprefix("file://")
        inner = os.path.join(folder, ".git")
        return RevisionReader(inner if os.path.isdir(inner) else folder, self.options.get("revision", "HEAD"))


def files_at(spark: SparkSession, path: str, revision: str = "HEAD") -> DataFrame:
    """file, bytes, content of a store's files at a revision, as of a source tree; the store has to be seen by all executors."""
    spark.dataSource.register(RevisionFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("revision", revision).load(path)
