"""Token ids of whole texts, equal to those of the tokenizers library.

Many texts are cut at once: the vocabulary's own cutting rule runs as array operations over their UTF-8 bytes, each piece is
looked up in a table of bounded size, and only pieces that the table lacks go through the library's model.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from functools import cache

import numpy as np

END_ID = 1
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Pieces and ids that an encoder remembers before it starts anew: at most about 45 MB.
REMEMBERED, REMEMBERED_IDS = 1 << 19, 1 << 22
#: Bytes of text of one step.
STEP = 1 << 20
#: How byte-level vocabularies write a byte: printable Latin-1 as itself, the others from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_TEXT = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_BLANK = _AS_TEXT[0x20]
#: The patterns by which the two kinds of vocabulary cut (fixed values).
BYTE_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of characters; the mark after a text is the byte 0xFF, which UTF-8 never uses.
SPACE, LETTER, NUMBER, OTHER, END, UNSURE = range(6)
_END = b"\xff"
_KEEP = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)
_LOADED: dict[str, "Encoder"] = {}
U = np.uint64


@cache
def classes() -> np.ndarray:
    """The class of each code point up to U+1FAFF. Unassigned ones are unsure, as libraries know different versions; so is what lies
    between the pictographs and the first plane, and the digits among the former."""
    out = np.full(0x1FB00, UNSURE, "u1")
    out[0x1F000:0x1FB00] = OTHER
    out[0x1F100:0x1F200] = UNSURE
    kind = {"L": LETTER, "N": NUMBER, "M": OTHER, "P": OTHER, "S": OTHER, "Z": SPACE}
    for i in range(0x10000):
        c = unicodedata.category(chr(i))
        out[i] = kind.get(c[0], UNSURE if c == "Cn" else OTHER)
    out[[*range(0x09, 0x0E), 0x85]] = SPACE
    return out


class _Table:
    """Pieces to ids, in arrays. A key of up to 16 bytes is the piece itself; longer ones have a 128-bit hash."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.size, self.used = 0, 0
        self._open(self.limit)
        self.low, self.high, self.length = np.zeros(0, U), np.zeros(0, U), np.zeros(0, "i4")
        self.first, self.count, self.ids = np.zeros(0, "i4"), np.zeros(0, "i4"), np.zeros(0, "<u4")

    def _open(self, entries: int) -> None:
        """Slots for so many entries, at most half of them full."""
        self.shift = 64 - max(8, (2 * entries - 1).bit_length())
        self.slots = np.full(1 << (64 - self.shift), -1, "i4")

    def _slot(self, low, high, length):
        h = (low ^ (low >> U(29))) * U(0x9E3779B97F4A7C15) ^ (high + length.astype(U)) * U(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> U(32))) * U(0x94D049BB133111EB) >> U(self.shift)).astype(np.int64)

    def find(self, low, high, length) -> np.ndarray:
        """Entries of the keys; -1 where there is none."""
        out, todo, slot = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slot(low, high, length)
        while len(todo):
            at = self.slots[slot]
            full = at >= 0
            if not full.all():
                todo, slot, at = todo[full], slot[full], at[full]
            same = (self.low[at] == low[todo]) & (self.high[at] == high[todo]) & (self.length[at] == length[todo])
            out[todo[same]] = at[same]
            todo, slot = todo[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def add(self, low, high, length, ids: list[list[int]]) -> None:
        """New keys, each once."""
        n, k = self.size, len(low)
        count = np.fromiter(map(len, ids), "i4", k)
        flat = np.fromiter((i for own in ids for i in own), "<u4", int(count.sum()))
        first = self.used + np.cumsum(count, dtype="i4") - count
        if n + k > len(self.low) or self.used + len(flat) > len(self.ids):
            more = max(k, n // 2, 4096)
            grown = lambda a, by: np.concatenate([a, np.zeros(by, a.dtype)])
            self.low, self.high, self.length, self.first, self.count = (grown(a[:n], more) for a in (self.low, self.high, self.length, self.first, self.count))
            self.ids = grown(self.ids[: self.used], max(len(flat), self.used // 2, 16_384))
        for a, new in ((self.low, low), (self.high, high), (self.length, length), (self.first, first), (self.count, count)):
            a[n : n + k] = new
        self.ids[self.used : self.used + len(flat)] = flat
        self.size, self.used = n + k, self.used + len(flat)
        if 2 * self.size > len(self.slots):  # one step with more pieces than are remembered
            self._open(2 * self.size)
            n = 0
        left = np.arange(n, self.size, dtype="i4")
        slot = self._slot(self.low[left], self.high[left], self.length[left])
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.slots) - 1)


class Encoder:
    """Ids of texts, equal to those of tokenizers on each whole text.

    The vocabulary's own rules, not its name, decide the way: those with BYTE_RULE or with WORD_RULE (after NFC and lower
    case) are cut here. Texts that hold a special token's string or a character of unsure class, and vocabularies with any other rules,
    are encoded by the library.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.model = t.model
        self.special = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        self.kind = self._kind(json.loads(t.to_str()))
        self.table = _Table(remembered)
        self._begin()

    @staticmethod
    def _kind(rules: dict) -> str:
        pre, normal = rules.get("pre_tokenizer") or {}, rules.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and normal is None:
            return "byte"
        steps = pre.get("pretokenizers", [])
        if len(steps) == 2 and steps[0].get("type") == "Split" and steps[0]["pattern"] == {"Regex": WORD_RULE} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
            level = steps[1]
            folded = [x["type"] for x in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            if folded and level["type"] == "ByteLevel" and not level.get("use_regex", True) and not level.get("add_prefix_space"):
                return "word"
        return "other"

    def _begin(self) -> None:
        self.table.clear()
        self.table.add(np.array([0xFF], U), np.zeros(1, U), np.ones(1, "i4"), [[END_ID]])

    def _ids(self, piece: bytes) -> list[int]:
        if piece.isalnum():
            shown = piece.decode()
        elif piece[:1] == b" " and piece[1:].isalnum():
            shown = _BLANK + piece[1:].decode()
        else:
            shown = piece.decode("latin-1").translate(_AS_TEXT)
        return [t.id for t in self.model.tokenize(shown)]

    def _folded(self, text: bytes) -> bytes:
        if text.isascii():
            return text.lower()
        whole = text.decode()
        # the first 256 code points are composed already; for others the library's own version of Unicode decides
        return (whole.lower() if max(whole) < "\u0100" else self.tokenizer.normalizer.normalize_str(whole)).encode()

    def _classes(self, data: np.ndarray) -> np.ndarray:
        out = np.full(256, OTHER, "u1")
        out[:128], out[0xFF] = classes()[:128], END
        out = out[data]
        lead = np.flatnonzero((data >= 0xC0) & (data < 0xFF))
        if len(lead):
            b = [data[np.minimum(lead + k, len(data) - 1)].astype("i4") for k in range(4)]
            size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
            point = b[0] & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
            for k in range(1, 4):
                point = np.where(k < size, point << 6 | b[k] & 0x3F, point)
            table = classes()
            c = np.where(point < len(table), table[np.minimum(point, len(table) - 1)], UNSURE)
            for k in range(4):
                own = k < size
                out[lead[own] + k] = c[own]
        return out

    def _pieces(self, data: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of all pieces, the marks after texts among them."""
        n = len(data)
        start = np.concatenate([[True], c[1:] != c[:-1]])
        start |= c == END
        space = c == SPACE
        if self.kind == "byte":
            after = np.flatnonzero(start[1:] & space[:-1] & ~space[1:] & (c[1:] != END)) + 1  # what follows white space
            joined = data[after - 1] == 0x20
            start[after[joined]] = False
            start[after[joined] - 1] = True
            last = after[~joined] - 1  # the last character of white space stands alone
            while len(inner := last[(data[last] & 0xC0) == 0x80]):
                last = np.concatenate([last[(data[last] & 0xC0) != 0x80], inner - 1])
            start[last] = True
        else:
            start |= (c == NUMBER) & ((data & 0xC0) != 0x80)
        mark = np.flatnonzero(start & (data == 0x27))
        if len(mark):
            x, y = (data[np.minimum(mark + k, n - 1)] for k in (1, 2))
            size = np.where(np.isin(x, list(b"stmd")), 2, np.where(((y == ord("e")) & ((x == ord("r")) | (x == ord("v")))) | ((x == ord("l")) & (y == ord("l"))), 3, 0))
            mark, size = mark[size > 0], size[size > 0]
            start[mark + 1] = False
            start[mark + size] = True
        first = np.flatnonzero(start)
        length = np.diff(first, append=n)
        if self.kind == "word":
            own = ~space[first]
            first, length = first[own], length[own]
        return first, length

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(ids of all texts, each with END_ID after it, where each ends, the texts of unsure classes)."""
        whole = _END.join([*texts, b""])
        data = np.frombuffer(whole, "u1")
        c = self._classes(data)
        unsure = np.flatnonzero(c == UNSURE)
        if len(unsure):
            ends = np.cumsum([len(t) + 1 for t in texts])
            unsure = np.unique(np.searchsorted(ends, unsure, "right"))
        first, length = self._pieces(data, c)
        words = np.ndarray((len(data),), "<u8", whole + bytes(16), strides=(1,))
        low = words[first] & _KEEP[np.minimum(length, 8)]
        high = np.ndarray((len(data),), "<u8", whole + bytes(16), 8, strides=(1,))[first] & _KEEP[np.clip(length - 8, 0, 8)]
        long = np.flatnonzero(length > 16)
        if len(long):
            import xxhash

            names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(whole[a : a + k]) for a, k in zip(first[long].tolist(), length[long].tolist())]), "<u8").reshape(-1, 2)
            low[long], high[long] = names[:, 0], names[:, 1]
        length = length.astype("i4")
        if self.table.size + len(first) // 4 > self.table.limit or self.table.used > REMEMBERED_IDS:
            self._begin()
        at = self.table.find(low, high, length)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            order = missing[np.lexsort((low[missing], high[missing], length[missing]))]
            new = order[np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]) | (length[order][1:] != length[order][:-1])])]
            self.table.add(low[new], high[new], length[new], [self._ids(whole[a : a + k]) for a, k in zip(first[new].tolist(), length[new].tolist())])
            at[missing] = self.table.find(low[missing], high[missing], length[missing])
        count = self.table.count[at].astype(np.int64)
        end = np.cumsum(count)
        ids = self.table.ids[np.repeat(self.table.first[at] - (end - count), count) + np.arange(end[-1] if len(end) else 0)]
        return ids, end[c[first] == END], unsure.tolist()

    def encode_many(self, texts: list[bytes]) -> list[memoryview]:
        """Each text's ids as little-endian uint32 bytes, END_ID last. texts: UTF-8."""
        own = list(texts)
        apart = set(range(len(own))) if self.kind == "other" else {k for s in self.special if any(s in t for t in own) for k, t in enumerate(own) if s in t}
        for k in apart:
            own[k] = b""
        if self.kind == "word":
            own = list(map(self._folded, own))
        ids, end, unsure = self._encode(own)
        ids = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        end = (4 * end).tolist()
        out = [ids[a:b] for a, b in zip([0, *end], end)]
        for k in apart.union(unsure):
            out[k] = memoryview(pack_ids([*self.tokenizer.encode(texts[k].decode(), add_special_tokens=False).ids, END_ID]))
        return out

    def encode(self, text: str) -> bytes:
        """One text's ids without END_ID."""
        return bytes(self.encode_many([text.encode()])[0][:-4])


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def vocabulary(name_or_path: str) -> str:
    """The file of a public vocabulary by its name, or a path as it is."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def encoder(name_or_path: str) -> Encoder:
    """The process's encoder of a vocabulary; it keeps one at a time."""
    if name_or_path not in _LOADED:
        _LOADED.clear()
        _LOADED[name_or_path] = Encoder(vocabulary(name_or_path))
    return _LOADED[name_or_path]


def encoded(batches, name_or_path: str):
    """(doc_id, ids) of Arrow batches with the columns doc_id and text; each document ends with END_ID. Ids are a view of a step's
    memory: what is kept longer than a few steps is best copied."""
    enc = encoder(name_or_path)
    for batch in batches:
        ids, docs, held, size = batch.column("doc_id"), [], [], 0
        for k, text in enumerate(batch.column("text")):
            docs.append(ids[k].as_py())
            held.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
            size += len(held[-1])
            if size > STEP:
                yield from zip(docs, enc.encode_many(held))
                docs, held, size = [], [], 0
        if docs:
            yield from zip(docs, enc.encode_many(held))
    _LOADED.clear()  # a worker keeps nothing for its next task


def crc32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
