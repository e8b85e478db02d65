"""Secret scans: three fixed patterns, and a battery of randomness tests with false-discovery control by length.

A candidate is a maximal run of [A-Za-z0-9+/_=-] with a digit and a letter, or the part of one that a key may be: names are
joined to keys by the same characters. Of spans that overlap the one of least p stands, wide ones before their parts where p is alike. A candidate's encoding is inferred from the
characters it uses. Each test asks how unlikely a patterned string of that length is to look as random:

* alphabet uniformity: the chi-squared statistic, as its count of coinciding pairs, against a source that repeats
  symbols SKEW times as often as a uniform one;
* runs: the number of runs of character classes against a source that changes class half as often as chance;
* serial correlation: lag-1 correlation of the symbols' values against a source with correlation 0.5.

A string whose runs or correlation lie TOO_FAR standard deviations from chance is patterned, whatever its alphabet says.
Fisher's method combines the three. They are nearly blind to short keys, so a fourth test asks how much likelier a string
is as random symbols of its encoding than as a name of words, numbers and separators, in either case: the ratio bounds p.
The smaller of the two p counts, doubled. The step-up procedure of
Benjamini and Hochberg runs within each length stratum over all candidates of the corpus, so many short candidates
never loosen the threshold of long ones or the other way round.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, written

KINDS = ("assign", "access", "hex", "random")
#: Fixed by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
_HINTS = ("passw", "secret", "token", "api")

SHORTEST = 16
#: Where a run may be cut besides not at all: '=' that pads nothing, and what is foreign to base64url, to base64 or to both.
CUTS = tuple(re.compile(p) for p in (r"=+(?=[^=])", r"=+(?=[^=])|[/+]", r"=+(?=[^=])|[_-]", r"=+(?=[^=])|[/+_-]"))
STRATA = (16, 20, 24, 32, 40, 48, 64, 96, 128)
RATE = 0.001
SKEW = 2.0
TOO_FAR = 3.3
#: -log10 p is kept in steps of 1/GRID up to LOWEST.
GRID, LOWEST = 100, 40
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
#: Alphabets in the order in which they are tried.
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z"), "0123456789abcdef", str.lower),
    ("base32", re.compile(r"[A-Z2-7]+=*\Z"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", str),
    ("base36", re.compile(r"[0-9a-z]+\Z|[0-9A-Z]+\Z"), "0123456789abcdefghijklmnopqrstuvwxyz", str.lower),
    ("base64", re.compile(r"[A-Za-z0-9+/]+=*\Z"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", str),
    ("base64url", re.compile(r"[A-Za-z0-9_=-]+\Z"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", str),
)


#: A name's next character is of a class (digit, lower, upper, other) by the class before; then letters are as frequent as in text.
_NEXT = ((0.75, 0.10, 0.05, 0.10), (0.05, 0.85, 0.04, 0.06), (0.06, 0.60, 0.29, 0.05), (0.25, 0.50, 0.20, 0.05))
_LETTERS = dict(zip("etaoinsrhldcumfpgwybvkxjqz", (12, 9, 8, 7.5, 7, 6.7, 6.3, 6, 5.5, 4, 4, 3, 2.8, 2.5, 2.2, 2, 2, 2, 2, 1.5, 1, 0.8, 0.3, 0.3, 0.3, 0.3)))

#: A key's own '/' or '-' may part off an end that looks like a name: a part must be that much better than what holds it.
WHOLE = 0.9


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _binomial_upper(n: int, p: float, k: int) -> float:
    """P(X >= k) for X ~ Binomial(n, p); a normal tail for long strings."""
    if k <= 0:
        return 1.0
    if n > 200:
        return _upper((k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    return min(1.0, math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def encoding(text: str):
    """(name, alphabet, symbols) of a candidate, or None."""
    for name, form, alphabet, fold in ENCODINGS:
        if form.match(text):
            return name, alphabet, fold(text).rstrip("=").replace("=", "")
    return None


def battery(text: str) -> float:
    """Combined p of the three tests; 1 where no encoding fits or too little is left."""
    found = encoding(text)
    if not found or len(found[2]) < SHORTEST:
        return 1.0
    _, alphabet, s = found
    n, size = len(s), len(alphabet)
    codes = [alphabet.index(c) for c in s]
    counts = np.bincount(codes, minlength=size)
    pairs, expected = float((counts * (counts - 1)).sum()) / 2, SKEW / size * n * (n - 1) / 2
    # the chi-squared statistic is 2 * size / n * pairs + size - n: pairs alone decide
    uniform = _poisson_lower(expected, int(pairs))
    shares = np.bincount([_class(c) for c in alphabet]) / size
    kinds = [_class(c) for c in s]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    runs = _binomial_upper(n - 1, (1 - float((shares**2).sum())) / 2, changes)
    x = np.array(codes, float)
    a, b = x[:-1] - x[:-1].mean(), x[1:] - x[1:].mean()
    scale = math.sqrt(float((a * a).sum() * (b * b).sum()))
    r = float((a * b).sum()) / scale if scale else 1.0
    turns = 1 - float((shares**2).sum())
    if abs(r) * math.sqrt(n) > TOO_FAR or abs(changes - (n - 1) * turns) > TOO_FAR * math.sqrt((n - 1) * turns * (1 - turns)) + 0.5:
        return 1.0
    serial = _upper((math.atanh(0.5) - abs(math.atanh(max(-0.999999, min(0.999999, r))))) * math.sqrt(n - 3))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return min(1.0, 2 * min(math.exp(-half) * (1 + half + half * half / 2), word_like(s, size)))


def _emission(c: str) -> float:
    return math.log(0.1 if c.isdigit() else _LETTERS[c.lower()] / sum(_LETTERS.values()) if c.isalpha() else 0.25)


_STEP = np.full((4, 256), -1e3)
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-":
    for _k in range(4):
        _STEP[_k, ord(_c)] = math.log(_NEXT[_k][_class(_c)]) + _emission(_c)
_CLASS = np.array([_class(chr(i)) for i in range(128)])


def word_like(s: str, size: int) -> float:
    """A bound of P(a name is as much likelier as random symbols as s is): the likelihood ratio, by Markov's inequality."""
    best = -math.inf
    for text in (s, s.swapcase()):
        code = np.frombuffer(text.encode("ascii"), "u1")
        before = np.concatenate([[3], _CLASS[code[:-1]]])  # a name starts as after a separator
        best = max(best, float(_STEP[before, code].sum()))
    return math.exp(min(0.0, best + len(s) * math.log(size)))


def _poisson_lower(mean: float, k: int) -> float:
    """P(X <= k) for X ~ Poisson(mean)."""
    if mean > 400:
        return _upper((mean - k - 0.5) / math.sqrt(mean))
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return min(1.0, total)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(int(a), int(b), 2) for a, b in _runs(_codes(text), _HEX, HEX_LENGTH)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def _codes(text: str) -> np.ndarray:
    """A byte for each code point; those beyond Latin-1 become a question mark."""
    return np.frombuffer(text.encode("latin-1", "replace"), "u1")


def _runs(codes: np.ndarray, member: np.ndarray, shortest: int) -> np.ndarray:
    """(start, end) of maximal runs of members."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], member[codes].view("i1"), [0]])))
    runs = edge.reshape(-1, 2)
    return runs[runs[:, 1] - runs[:, 0] >= shortest]


def candidates(text: str) -> list[tuple[int, int, float]]:
    """(start, end, p) of candidates that do not overlap: in each run those of least p; a part's log p counts WHOLE times for each cut."""
    codes = _codes(text)
    runs = _runs(codes, _TOKEN, SHORTEST)
    if not len(runs):
        return []
    digits = np.concatenate([[0], np.cumsum(_DIGIT[codes])])
    some = digits[runs[:, 1]] - digits[runs[:, 0]]
    runs = runs[(some > 0) & (some < runs[:, 1] - runs[:, 0])]
    out = []
    for a, b in runs.tolist():
        found, tries = parts(text[a:b])
        taken = []
        tested = ((min(1.0, battery(text[a + s : a + e]) * tries), s, e, depth) for (s, e), depth in found.items())
        for _, _, s, e, p in sorted((WHOLE**depth * math.log10(max(p, 1e-300)), s - e, s, e, p) for p, s, e, depth in tested):
            at = bisect.bisect(taken, (s, e))
            if (not at or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e):
                taken.insert(at, (s, e))
                out.append((a + s, a + e, p))
    return sorted(out)


def parts(run: str) -> tuple[dict[tuple[int, int], int], int]:
    """(the run and its parts by each of CUTS that are long enough and have a digit, with the number of cuts; how many may hold one place)."""
    ways = {((0, len(run)),): 0}
    for cut, depth in zip(CUTS, (1, 2, 2, 3)):
        edge = [0, *(x for m in cut.finditer(run) for x in m.span()), len(run)]
        ways.setdefault(tuple((s, e) for s, e in zip(edge[::2], edge[1::2]) if e - s >= SHORTEST and not run[s:e].isdigit() and any(map(str.isdigit, run[s:e]))), depth)
    ways.pop((), None)
    spans: dict[tuple[int, int], int] = {}
    for way, depth in ways.items():
        for span in way:
            spans.setdefault(span, depth)
    return spans, len(ways)


def stratum(length: int) -> int:
    return int(np.searchsorted(STRATA, length, "right")) - 1


SCAN = "doc_id long, base array<struct<s:int,e:int,k:int>>, found array<struct<s:int,e:int,stratum:int,score:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of every whole text; score is floor(GRID * -log10 p), so that a later threshold is exact."""

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32())]))
        cand = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("stratum", pa.int32()), ("score", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base, found = [], []
                for text in part.column("text").to_pylist():
                    own = base_spans(text or "")
                    base.append([{"s": a, "e": b, "k": k} for a, b, k in own])
                    found.append([{"s": a, "e": b, "stratum": stratum(b - a), "score": int(min(LOWEST, -math.log10(max(p, 1e-300))) * GRID)} for a, b, p in candidates(text or "")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base, span), pa.array(found, cand)], ["doc_id", "base", "found"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCAN)


def thresholds(scanned: DataFrame, rate: float = RATE) -> list[int]:
    """The least score that the step-up procedure accepts in each stratum, from a histogram over all candidates.

    The histogram has at most len(STRATA) * (GRID * LOWEST + 1) rows, however large the corpus.
    """
    rows = scanned.select(F.explode("found").alias("f")).groupBy("f.stratum", "f.score").count().collect()
    counts = np.zeros((len(STRATA), GRID * LOWEST + 1))
    for r in rows:
        counts[r["stratum"], r["score"]] += r["count"]
    out = []
    for row in counts:
        rank = np.cumsum(row[::-1])[::-1]  # candidates with at least this score
        accepted = np.flatnonzero((rank > 0) & (10.0 ** (-np.arange(len(row)) / GRID) <= rate * rank / max(rank[0], 1)))
        out.append(int(accepted[0]) if len(accepted) else GRID * LOWEST + 1)
    return out


def spans(scanned: DataFrame, least: list[int]) -> DataFrame:
    """doc_id and `spans`: base spans, and accepted candidates that lie in none of them; by start, then kind."""
    bound = F.array(*map(F.lit, least))
    extra = F.filter("found", lambda f: (f.score >= F.get(bound, f.stratum)) & ~F.exists("base", lambda b: (b.s <= f.s) & (f.e <= b.e)))
    both = F.concat("base", F.transform(extra, lambda f: F.struct(f.s.alias("s"), f.e.alias("e"), F.lit(3).alias("k"))))
    ordered = F.transform(F.array_sort(F.transform(both, lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e")))), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.k.alias("k")))
    return scanned.select("doc_id", "base", ordered.alias("spans"))


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Secrets of every document (columns doc_id, text; others are ignored): doc_id, base, spans.

    A null text is empty and has no spans; null doc_ids and repeated rows stay, a row each; an empty table gives no rows.
    One scan writes what it found, a histogram of it gives the thresholds; texts are not shuffled.
    """
    scanned = written(scan(docs), "secrets")
    return spans(scanned, thresholds(scanned, rate))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.k), x.s.cast("string"), x.e.cast("string"))), ",")


def redact(docs: DataFrame, rate: float = RATE, mask: str = "[secret]") -> DataFrame:
    """The documents with every secret replaced by a mask; overlapping spans become one; n_chars follows, in its own type.

    Null and empty texts stay as they are; repeated rows are masked each; other columns are untouched, whatever their names.
    """
    least = thresholds(written(scan(docs), "secrets"), rate)  # a number for each stratum
    names = docs.columns

    # the thresholds are known, so the texts are scanned in place rather than joined with their spans
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                texts.append(text and masked(text, least, mask))
            out = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                out["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    return arrow_map(docs, run, docs.schema)


def masked(text: str, least: list[int], mask: str) -> str:
    own = [(a, b) for a, b, _ in base_spans(text)]
    own += [(a, b) for a, b, p in candidates(text) if int(min(LOWEST, -math.log10(max(p, 1e-300))) * GRID) >= least[stratum(b - a)]]
    out, at, end = [], 0, 0
    for a, b in sorted(own):
        if a >= end:
            out += [text[at:a], mask]
        at = end = max(end, b)
    return "".join([*out, text[at:]]) if own else text


def base_digest(text: str | None) -> str:
    """The contract's digest of base spans, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in base_spans(text or "")).encode()).hexdigest()


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda b: b.k == k)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
