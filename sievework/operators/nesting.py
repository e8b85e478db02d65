"""Nested intervals from rows that open and close: matched by running depth, without a list for each file.

At one depth openings and closings take turns, so the closing of an opening is the next row of its level, and what encloses it is the last
opening one level up. Both are windows over (key, level). A closing without an opening is passed over, as by a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.readers import DECLARATION

#: Pieces of a line of code: texts in quotes, remarks, separators, and runs of all else.
PIECES = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*|/\*.*?\*/|[{};]|[^{};\"'/]+|."
COMMENT_LINE = r"^\s*(//|\*|/\*)"
#: Words after which a name and parentheses are no declaration, and names that open a block without being a method.
NOT_BEFORE = ["return", "new", "else", "throw", "case", "assert", "in", "is", "as", "do", "yield", "await"]
CONTROL = ["if", "for", "while", "switch", "catch", "synchronized", "when", "try", "else", "do", "super", "this", "init"]
#: What stands before a method's name, and the name.
BEFORE_NAME = r"^\s*([\w@<>\[\],.?& \t]*[\w>\]?])\s+([A-Za-z_]\w*)\s*\("


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key over as many tasks as the session sets. Several sorts stand in the memory of one task here, so tasks are not joined by the bytes that they read."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def nest(events: DataFrame, keys: list[str], order: str, step: str = "step") -> DataFrame:
    """The openings of events (step 1 opens, -1 closes) with level, close (the order of its closing, null if none) and parent (the order of
    the opening around it, null if none)."""
    own = Window.partitionBy(*keys)
    depth = F.sum(step).over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    levelled = dealt(events, keys).withColumn("level", depth + F.when(F.col(step) < 0, 1).otherwise(0))
    closed = levelled.withColumn("close", F.lead(order).over(Window.partitionBy(*keys, "level").orderBy(order))).where(f"{step} > 0")
    # an opening stands on its own level, and as a child on that above
    both = closed.withColumn("_lv", F.explode(F.array("level", F.col("level") - 1)))
    w = Window.partitionBy(*keys, "_lv").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("_lv") == F.col("level"), F.col(order)), ignorenulls=True).over(w)
    return both.withColumn("parent", above).where("_lv < level").drop("_lv", step)


def around(points: DataFrame, opened: DataFrame, keys: list[str], at: str, order: str, name: str) -> DataFrame:
    """Adds the value `name` of the innermost of some nested openings (keys, order, close, name) that is open at a point's place; null if none."""
    used = opened.select(*keys, F.col(order).alias("_o"), "close", F.col(name).alias("_n"))
    ends = used.select(*keys, F.col("_o").alias("_at"), F.lit(1).alias("step"), "_n").union(used.where("close is not null").select(*keys, F.col("close").alias("_at"), F.lit(-1).alias("step"), F.lit(None).cast(used.schema["_n"].dataType)))
    tree = nest(ends, keys, "_at")
    up = tree.alias("c").join(tree.select(*keys, F.col("_at").alias("parent"), F.col("_n").alias("_up")), [*keys, "parent"], "left")
    events = up.select(*keys, F.col("_at").alias("_p"), F.lit(0).alias("_kind"), F.struct(F.col("_n").alias("n")).alias("_v")).union(up.where("close is not null").select(*keys, F.col("close").alias("_p"), F.lit(0).alias("_kind"), F.struct(F.col("_up").alias("n"))))
    # columns side by side, so that those which nobody asks for are left out
    rest = [c for c in points.columns if c not in keys]
    asked = points.select(*keys, F.col(at).alias("_p"), F.lit(1).alias("_kind"), F.lit(None).cast(events.schema["_v"].dataType).alias("_v"), *(F.col(c).alias(f"_c{k}") for k, c in enumerate(rest)))
    both = events.select("*", *(F.lit(None).cast(points.schema[c].dataType).alias(f"_c{k}") for k, c in enumerate(rest))).unionByName(asked)
    w = Window.partitionBy(*keys).orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return dealt(both, keys).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1").select(*keys, *(F.col(f"_c{k}").alias(c) for k, c in enumerate(rest)), F.col("_v.n").alias(name))


def place(line: str = "line", k: Column | None = None) -> Column:
    """One number for a line and a piece in it; indexed files have fewer bytes than pieces fit in a line."""
    return F.shiftleft(F.col(line).cast("long"), 20) + (F.lit(0) if k is None else k)


def code_blocks(lines: DataFrame) -> DataFrame:
    """file, line, at, close, close_line, level, parent, header, type_name, method_name of each brace block of source lines (file, line, text).

    Quotes, comment lines and what follows // count for nothing. The header is what stands between the last separator and the brace.
    type_name, method_name: what the header declares, else null.
    """
    pieces = lines.where(~F.col("text").rlike(COMMENT_LINE)).select("file", "line", F.posexplode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("k", "piece")).where("not piece rlike '^/[/*]'")
    pieces = pieces.withColumn("at", place("line", F.col("k") + 1)).withColumn("cut", F.col("piece").isin("{", "}", ";"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # a semicolon in the parentheses of a loop separates nothing; parentheses are counted from brace to brace
    count = lambda c: F.length("piece") - F.length(F.replace("piece", F.lit(c), F.lit("")))
    quoted = F.substring("piece", 1, 1).isin('"', "'")
    pieces = pieces.withColumn("run", F.coalesce(F.count_if(F.col("piece").isin("{", "}")).over(before), F.lit(0)))
    in_run = Window.partitionBy("file", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("open", F.sum(F.when(quoted, 0).otherwise(count("(") - count(")"))).over(in_run)).withColumn("cut", F.col("cut") & ~((F.col("piece") == ";") & (F.col("open") > 0)))
    pieces = pieces.withColumn("n", F.coalesce(F.count_if("cut").over(before), F.lit(0)))
    said = F.when(quoted, '""').otherwise(F.col("piece"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("cut"), F.struct("line", "at", said.alias("s"))))), lambda x: x["s"]), " ")
    cuts = pieces.groupBy("file", "n").agg(F.max(F.when(F.col("cut"), F.struct("at", "line", "piece"))).alias("c"), words.alias("header")).where("c is not null")
    events = cuts.where("c.piece <> ';'").select("file", "c.at", "c.line", F.when(F.col("c.piece") == "{", 1).otherwise(-1).alias("step"), F.trim("header").alias("header"))
    # the last declaration of a header counts: an annotation's or a supertype's words come before or hold none
    name, prefix = F.regexp_extract("header", r"([A-Za-z_]\w*)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s[\w.,\s]+|:[\w<>?.,\s\[\]]+)?=?\s*$", 1), F.regexp_extract("header", BEFORE_NAME, 1)
    typed = F.element_at(F.regexp_extract_all("header", F.lit(DECLARATION), F.lit(1)), 1)
    typed = F.when(F.size(F.regexp_extract_all("header", F.lit(DECLARATION), F.lit(1))) > 0, typed)
    last_word = F.regexp_extract(prefix, r"(\S+)$", 1)
    bare = F.col("header").rlike(r"^\s*[A-Z]\w*\s*\(")
    declared = (name != "") & ~name.isin(*CONTROL) & typed.isNull() & (bare | ((F.regexp_extract("header", BEFORE_NAME, 2) == name) & ~last_word.isin(*NOT_BEFORE)))
    out = nest(events, ["file"], "at")
    return out.select("file", "line", "at", "close", F.shiftright("close", 20).alias("close_line"), "level", "parent", "header", typed.alias("type_name"), F.when(declared, name).alias("method_name"))


def enclosing(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds enclosing_type and enclosing_symbol, the innermost type and method around each row (file, line); null without one.

    A row belongs to what its own line opens last, else to what is open where its line begins.
    """
    out = rows
    for name, as_ in (("type_name", "enclosing_type"), ("method_name", "enclosing_symbol")):
        own = blocks.where(F.col(name).isNotNull())
        opened = own.groupBy("file", "line").agg(F.max("at").alias("_last"))
        out = out.join(opened, ["file", "line"], "left").withColumn("_place", F.coalesce("_last", place())).drop("_last")
        out = around(out, own.select("file", "at", "close", name), ["file"], "_place", "at", name).withColumnRenamed(name, as_).drop("_place")
    return out
