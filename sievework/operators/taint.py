"""Taint inside a method: which assignments carry a value from a source to a sink, by definitions, uses and a fixpoint over them.

A use refers to the last definition of its name above it in the same method, told by one window; so definitions form a graph without cycles.
A definition is tainted if it holds a source, or uses a tainted one, unless a sanitizer is in it. Each round follows all new
definitions by one step, and the rounds end when nothing new is found. What a loop carries back to lines above is not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import catalogue as C
from sievework.functions.scalar import strip

from .filters import matches_any
from .graph import _cut
from .nesting import around, code_blocks, place
from .structural import REMARKS, pattern_regex

ASSIGNED = r"(\w+)\s*(?::\s*[\w.<>?]+\s*)?(\+?)=(?!=)([\s\S]*)$"
_NAME = r"(?<![\w.$])([A-Za-z_]\w*)(?!\s*\()"
_HOP = "struct<file:string,line:int,message:string>"


def statements(files: DataFrame) -> DataFrame:
    """file, scope, ord, line, text, var, expr of the statements of texts (file, text); scope is the place of the method around, -1 without one.

    var is what the statement assigns (null if nothing), expr what it assigns, or all of it. Texts in quotes hold no names.
    """
    code = files.select("file", F.regexp_replace("text", REMARKS, "").alias("text"))
    lines = code.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    methods = code_blocks(lines).where("method_name is not null").select("file", "line", "at", "close", F.col("at").alias("scope"))
    last = methods.groupBy("file", "line").agg(F.max("at").alias("_last"))
    rows = lines.join(last, ["file", "line"], "left").withColumn("_at", F.coalesce("_last", place())).drop("_last")
    rows = around(rows, methods.drop("line"), ["file"], "_at", "at", "scope")
    parts = rows.select("file", F.coalesce("scope", F.lit(-1)).alias("scope"), "line", F.posexplode(F.split("text", "[;{}]")).alias("k", "text")).where(F.trim("text") != "")
    bare = F.regexp_replace("text", r"\"(?:\\.|[^\"\\])*\"", "\"\"")
    got = lambda k: F.regexp_extract(bare, ASSIGNED, k)
    # a += b uses a as well
    expr = F.when(got(1) == "", bare).otherwise(F.concat(F.when(got(2) == "+", got(1)).otherwise(""), F.lit(" "), got(3)))
    return parts.select("file", "scope", place("line", F.col("k")).alias("ord"), "line", strip("text").alias("text"), F.nullif(got(1), F.lit("")).alias("var"), expr.alias("expr"))


def taint_flows(files: DataFrame, rules: list[tuple] = C.TAINT, sanitizers: list[str] = [], skip: list[str] = C.TAINT_SKIP) -> DataFrame:
    """file, line, rule_id, category, severity, snippet, dataflow_path (source to sink) of each sink statement that a source reaches.

    rules: id, category, severity, sources, sinks; sanitizers are patterns too. Of several ways the shortest is told, of equal ones that of the first places.
    """
    own = statements(files.where(~matches_any("file", skip)) if skip else files)
    either = lambda patterns: "|".join(map(pattern_regex, patterns)) if patterns else r"(?!)"
    clean = either(sanitizers)
    marks = lambda column, k: F.array_compact(F.array(*(F.when(F.col(column).rlike(either(r[k])), F.lit(i)) for i, r in enumerate(rules))))
    args = F.array(*(F.array_join(F.regexp_extract_all("text", F.lit(f"({either(r[4])})"), F.lit(1)), " ") for r in rules))
    own = _cut(own.select("*", marks("expr", 3).alias("sources"), marks("text", 4).alias("sinks"), F.col("expr").rlike(clean).alias("clean"), args.alias("args")))
    hop = F.struct("file", F.col("line").cast("int").alias("line"), F.left("text", F.lit(300)).alias("message")).cast(_HOP)

    # names that definitions and sinks use, met with the last definition above
    asks = own.where("var is not null and not clean").select("file", "scope", "ord", F.lit(-1).alias("sink"), F.col("expr").alias("e"))
    asks = asks.union(own.select("file", "scope", "ord", F.explode("sinks").alias("sink"), "args").select("file", "scope", "ord", "sink", F.get("args", F.col("sink")).alias("e")))
    bare = F.regexp_replace("e", r"\"(?:\\.|[^\"\\])*\"", "\"\"")
    asks = asks.select("file", "scope", "ord", "sink", F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(_NAME), F.lit(1)))).alias("name"))
    both = asks.withColumn("defines", F.lit(0)).unionByName(own.where("var is not null").select("file", "scope", "ord", F.lit(None).cast("int").alias("sink"), F.col("var").alias("name"), F.lit(1).alias("defines")))
    w = Window.partitionBy("file", "scope", "name").orderBy("ord", "defines").rowsBetween(Window.unboundedPreceding, -1)
    met = _cut(both.withColumn("from", F.last(F.when(F.col("defines") == 1, F.col("ord")), ignorenulls=True).over(w)).where("defines = 0 and from is not null").select("file", "scope", "from", "ord", "sink").distinct())

    edges = met.where("sink = -1").join(own.select("file", "scope", "ord", hop.alias("hop")), ["file", "scope", "ord"])
    found = new = _cut(own.where("var is not null and not clean").select("file", "scope", "ord", F.explode("sources").alias("rule"), F.array(hop).alias("path")))
    while new.head(1):
        ahead = new.withColumnRenamed("ord", "from").join(edges, ["file", "scope", "from"]).select("file", "scope", "ord", "rule", F.concat("path", F.array("hop")).alias("path"))
        ahead = ahead.groupBy("file", "scope", "ord", "rule").agg(F.min("path").alias("path"))
        new = _cut(ahead.join(found.select("file", "scope", "ord", "rule"), ["file", "scope", "ord", "rule"], "left_anti"))
        found = found.union(new)

    through = met.where("sink >= 0").select("file", "scope", F.col("from"), F.col("ord").alias("at"), F.col("sink").alias("rule")).join(found.withColumnRenamed("ord", "from"), ["file", "scope", "from", "rule"])
    ends = own.select("file", "scope", F.col("ord").alias("at"), "line", "text", hop.alias("end"))
    hits = through.join(ends, ["file", "scope", "at"]).select("file", "line", "text", "rule", F.concat("path", F.array("end")).alias("path"))
    at_once = own.where(F.size("sinks") > 0).select("*", F.explode("sinks").alias("rule"), hop.alias("end"))
    same = F.lit(False)
    for i, r in enumerate(rules):
        same = same | ((F.col("rule") == i) & F.get("args", F.col("rule")).rlike(either(r[3])))
    hits = hits.union(at_once.where(same & ~F.col("clean")).select("file", "line", "text", "rule", F.array("end")))
    best = hits.groupBy("file", "line", "text", "rule").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("b"))
    names = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(r, ("rule_id", "category", "severity")))) for r in rules))
    return best.withColumn("r", F.get(names, F.col("rule"))).select("file", "line", "r.*", F.left("text", F.lit(300)).alias("snippet"), F.col("b.path").alias("dataflow_path"))
