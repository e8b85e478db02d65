"""Rules over the structure of code: patterns with holes, conditions on the blocks around a match, and values that must be released."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import catalogue as C
from sievework.functions.scalar import strip

from .nesting import around, code_blocks, place

#: An argument, and any number of them: no separators outside of parentheses of two levels.
_NESTED = r"\((?:[^()]|\([^()]*\))*\)"
_ONE, _ANY = rf"(?:[^(),;{{}}]|{_NESTED})+", rf"(?:[^();{{}}]|{_NESTED})*"
_TEXT = r"\"(?:\\.|[^\"\\\n])*\""
#: What an expression before a dot ends with; what a call is not preceded by where it is a declaration.
_AFTER, _NOT_FUN = r"(?<=[\w)\]\"?!])", r"(?<!\bfun\s)(?<![\w$])"
#: A remark to the line's end, and the lines of a block of remarks; line breaks stay.
REMARKS = r"(?m)^[ \t]*(?:\*|/\*)[^\n]*$|//[^\n\"]*$"
BEGIN, END = "\x01", "\x02"


def pattern_regex(pattern: str) -> str:
    """The regular expression of a pattern: $X before a dot is any expression's end, else one argument or name; ... any arguments; "..." any text."""
    out, parts = [], re.findall(r'"\.\.\."|"[^"]*"|\.\.\.|\$[A-Z_]+|\w+|\s+|.', pattern)
    for k, x in enumerate(parts):
        following = parts[k + 1] if k + 1 < len(parts) else ""
        if x.isspace():
            words = k and re.match(r"[\w$]", following) and re.search(r"\w$", parts[k - 1])
            out.append(r"\s+" if words else r"\s*")
        elif x == '"..."':
            out.append(_TEXT)
        elif x == "...":
            out.append(_ANY)
        elif x[0] == "$":
            # a receiver's own text is of no matter; after a word or before a colon stands a name or type; else an argument
            word = r"[\w.$<>\[\]?]+"
            alone = k > 1 and parts[k - 1].isspace() and re.match(r"\w", parts[k - 2])
            out.append(_AFTER if k == 0 and following == "." else _NOT_FUN + word if k == 0 and following == "(" else word if alone or following in (":", "(") or following.isspace() and k > 0 and parts[k + 2 : k + 3] != ["+"] else _ONE)
        elif re.match(r"\w", x):
            out.append(rf"(?<![\w$.]){x}\b" if k == 0 else x)
        elif x[0] == '"':
            out.append(re.escape(x))
        else:
            out.append(rf"\s*{re.escape(x)}\s*")
    return "".join(out).replace(r"\s*\s*", r"\s*")


def pattern_hits(files: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """file, rule (its number), line, snippet of each match in the texts (file, text) for which a rule's condition holds.

    Each text is read once. Matches are marked in place and cut there, so a line's number is the sum of the pieces' breaks before it.
    """
    marked = lambda p: F.split(F.regexp_replace("text", p, f"{BEGIN}$0{END}"), BEGIN)
    found = F.array_compact(F.array(*(F.when(where & F.col("text").rlike(p), F.struct(F.lit(k).alias("rule"), marked(p).alias("pieces"))) for k, (where, p) in enumerate(rules))))
    rows = files.select("file", F.explode(found).alias("x")).select("file", "x.rule", F.posexplode("x.pieces").alias("n", "piece"))
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    before = Window.partitionBy("file", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", (F.coalesce(F.sum(breaks).over(before), F.lit(0)) + 1).cast("int")).where("n > 0")
    return rows.select("file", "rule", "line", F.left(F.substring_index("piece", END, 1), F.lit(300)).alias("snippet"))


def named(hits: DataFrame, names: list[tuple[str, str, str]]) -> DataFrame:
    """Hits with rule_id, category and severity in place of the rule's number."""
    own = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(n, ("rule_id", "category", "severity")))) for n in names))
    return hits.withColumn("_r", F.get(own, F.col("rule"))).select("file", "line", "_r.*", "snippet")


def _within(hits: DataFrame, blocks: DataFrame, headers: dict[int, str]) -> DataFrame:
    """The hits of rules with a header whose blocks, at any depth, hold one with that header."""
    marks = F.array_compact(F.array(*(F.when(F.col("header").rlike(p), F.lit(k)) for k, p in headers.items())))
    opened = blocks.select("file", "line", "at", "close", F.explode(marks).alias("rule")).withColumn("in", F.lit(True))
    last = opened.groupBy("file", "rule", "line").agg(F.max("at").alias("_last"))
    points = hits.join(last, ["file", "rule", "line"], "left").withColumn("_at", F.coalesce("_last", place())).drop("_last")
    return around(points, opened.select("file", "rule", "at", "close", "in"), ["file", "rule"], "_at", "at", "in").where("in").select(*hits.columns)


def _unreleased(hits: DataFrame, blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Hits (snippet begins with a variable) without variable.close() later in the block that is innermost at the hit: the name's text has to agree."""
    hits = hits.withColumn("name", F.regexp_extract("snippet", r"^(\w+)", 1))
    ends = lines.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\w+)\s*\.\s*close\s*\(\s*\)"), F.lit(1)))).alias("name"))
    both = hits.select("file", "name", "line", F.lit(1).alias("kind"), F.struct("rule", "snippet").alias("own")).unionByName(ends.select("file", "name", "line", F.lit(0).alias("kind")), allowMissingColumns=True)
    later = Window.partitionBy("file", "name").orderBy("line", F.desc("kind")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = both.withColumn("closed", F.first(F.when(F.col("kind") == 0, F.col("line")), ignorenulls=True).over(later)).where("kind = 1")
    rows = around(rows.select("file", "line", "closed", "own.*").withColumn("_at", place(k=F.lit(1))), blocks.select("file", "at", "close", F.coalesce("close_line", F.lit(1 << 40)).alias("end")), ["file"], "_at", "at", "end")
    return rows.where("closed is null or closed > coalesce(end, closed)").select("file", "rule", "line", "snippet")


def structural_hits(files: DataFrame, rules: list[tuple] = C.STRUCTURAL) -> DataFrame:
    """One row a match of the structural rules: file, line, rule_id, category, severity, snippet. files: file, text.

    Remarks are no code. A match is told by its text, so what a name resolves to is not known; a chain's line is that of its last dot.
    """
    code = files.select("file", F.regexp_replace("text", REMARKS, "").alias("text"))
    patterns, headers, held = [], {}, set()
    for k, (_, _, _, suffixes, own, when) in enumerate(rules):
        if kept := when.get("held") or when.get("made"):
            held.add(k)
            value = rf"[^;={{}}]*\.\s*(?:{kept})" if "held" in when else rf"new\s+(?:{kept})"
            own_regex = rf"(?<![\w.])\w+\s*=\s*{value}\s*\("
            own_regex = rf"(?<!\btry\s{{0,3}}\([\w<>. ]{{0,60}}){own_regex}"
        else:
            own_regex = "|".join(map(pattern_regex, own))
        if "unless" in when:
            # what must not be is tried first, and keeps its place
            own_regex = rf"(?:{'|'.join(map(pattern_regex, when['unless']))})|(?:{own_regex})"
        if "inside" in when:
            headers[k] = rf"{pattern_regex(when['inside'])}\s*$".replace(_ANY, r"[^{}]*")
        where = F.lit(False)
        for s in suffixes:
            where = where | F.endswith("file", F.lit(s))
        patterns.append((where, own_regex))
    hits = pattern_hits(code, patterns)
    for k, (_, _, _, _, _, when) in enumerate(rules):
        if "literal" in when:
            hits = hits.where((F.col("rule") != k) | F.regexp_extract("snippet", r"\"([^\"]*)\"", 1).rlike(when["literal"]))
        if "unless" in when:
            whole = "|".join(pattern_regex(x).removeprefix(_AFTER) for x in when["unless"])
            hits = hits.where((F.col("rule") != k) | ~F.col("snippet").rlike(f"^(?:{whole})$"))
    lines = code.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    blocks = code_blocks(lines)
    inner, kept = F.col("rule").isin(*headers), F.col("rule").isin(*held)
    out = hits.where(~inner & ~kept)
    if headers:
        out = out.unionByName(_within(hits.where(inner), blocks, headers))
    if held:
        out = out.unionByName(_unreleased(hits.where(kept), blocks, lines))
    return named(out.withColumn("snippet", strip("snippet")), [r[:3] for r in rules])
