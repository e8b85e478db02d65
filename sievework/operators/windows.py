"""Order-sensitive operators: coverage of intervals, caps, nearest preceding rows, budgets, windows of long texts, ranked output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.scalar import severity_rank


def ranges_cover(ranges: DataFrame, keys: list[str], start: str, end: str, total: str) -> DataFrame:
    """keys, covered: whether the intervals' union is exactly 1..total. A range is odd if it starts below 1, ends before it
    starts or beyond the total. An empty file (total 0) must have no range: give it as a row with null start and end."""
    w = W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    gap = F.col(start) > F.coalesce(F.max(end).over(w), F.lit(0)) + 1
    odd = (F.col(start) < 1) | (F.col(end) < F.col(start)) | (F.col(end) > F.col(total))
    rows = ranges.withColumn("_bad", F.coalesce(gap | odd, F.lit(False)))
    return rows.groupBy(*keys).agg((~F.bool_or("_bad") & (F.coalesce(F.max(end), F.lit(0)) == F.coalesce(F.max(total), F.lit(0)))).alias("covered"))


def cap_per_key(rows: DataFrame, keys: list[str], order: list, cap: int) -> tuple[DataFrame, DataFrame]:
    """(the first `cap` rows of each key, truncated counts by key); a cap of 0 keeps all."""
    if cap <= 0:
        return rows, rows.groupBy(*keys).agg(F.lit(0).cast("long").alias("truncated"))
    kept = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
    return kept, rows.groupBy(*keys).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("truncated"))


def nearest_preceding(rows: DataFrame, keys: list[str], order: list[str], wanted: Column, value: Column, name: str) -> DataFrame:
    """Adds the value of the last row up to and with this one where `wanted` holds."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(wanted, value), ignorenulls=True).over(w))


def enclosing_type(lines: DataFrame, declaration: str) -> DataFrame:
    """Adds `type`: the nearest preceding type declaration whose braces are still open, or that of the line itself. lines: file, line, text."""
    from .nesting import around, dealt, nest, place

    declared = F.regexp_extract("text", declaration, 1)
    braces = lines.select("file", "line", F.posexplode(F.regexp_extract_all("text", F.lit("[{}]"), F.lit(0))).alias("k", "b")).select("file", "line", place("line", F.col("k") + 1).alias("at"), F.when(F.col("b") == "{", 1).otherwise(-1).alias("step"))
    # a declaration opens with the first brace from its line on
    named = lines.where(declared != "").select("file", place().alias("_from"), declared.alias("type"))
    opened = nest(braces, ["file"], "at")
    own = W.partitionBy("file").orderBy("_p", "_k").rowsBetween(W.currentRow, W.unboundedFollowing)
    first = named.select("file", F.col("_from").alias("_p"), F.lit(0).alias("_k"), "type", F.lit(None).cast("struct<at:bigint,close:bigint>").alias("_b")).union(opened.select("file", "at", F.lit(1), F.lit(None).cast("string"), F.struct("at", "close")))
    bound = dealt(first, ["file"]).withColumn("_b", F.first("_b", ignorenulls=True).over(own)).where("_k = 0 and _b is not null")
    bound = bound.groupBy("file", F.col("_b.at").alias("at"), F.col("_b.close").alias("close")).agg(F.max_by("type", "_p").alias("type"))
    # what a line declares goes along, so that its text need not
    asked = lines.withColumns({"_place": place(), "_own": F.nullif(declared, F.lit(""))})
    inside = around(asked, bound, ["file"], "_place", "at", "type").drop("_place")
    return inside.withColumn("type", F.coalesce("_own", "type")).drop("_own")


def running_total(rows: DataFrame, order: list, cost: str, name: str = "running") -> DataFrame:
    """Adds the sum of `cost` over all rows up to and with this one, without one task for all: ranges of the order are summed up each, and a row adds
    what the ranges before its own hold. Costs are whole numbers; a null counts nothing.

    The ranges are a written table, as a second plan would cut others. Their sums are as many as there are partitions.
    """
    from .graph import _cut

    dealt = _cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.coalesce(F.sum(cost), F.lit(0)).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = F.coalesce(F.sum(cost).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")  # a row a partition


def positions(rows: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Adds the number, from 1, of a row in the order of all rows, without one task for all. The order must tell rows apart."""
    return running_total(rows.withColumn("_one", F.lit(1)), order, "_one", name).drop("_one")


def budget_prefix(rows: DataFrame, keys: list[str], order: list, cost: str, budget: int) -> DataFrame:
    """Ranked rows before the first one that would exceed the budget; what follows it does not come back. Costs are not negative.

    Without keys the budget is one for all rows, in two passes over ranges of the order.
    """
    if not keys:
        return running_total(rows, order, cost).where(F.col("running") <= budget)
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("running", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.coalesce(F.col("running"), F.lit(0)) <= budget)


def matches_in(pattern: str, text: str = "text", lead: str = "lead", chars: str = "chars") -> Column:
    """How many matches begin in a window's own part; what overlaps is context only, so a match at an edge counts once.

    The sum over a file's windows is that of one scan of the whole text where a match, with what it looks at around it, and an
    unbroken run of touching matches are no longer than the overlap.
    """
    mark = "\x01"
    pieces = F.split(F.regexp_replace(F.translate(text, mark, "\x02"), pattern, f"{mark}$0"), mark)
    # a piece but the first begins with a match: its place is the length of those before
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    own = lambda at: (at >= F.col(lead)) & (at < F.col(lead) + F.col(chars))
    step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), (s["n"] + F.when(own(s["at"]), 1).otherwise(0)).alias("n"))
    walk = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start.withField("at", F.length(F.get(pieces, F.lit(0)))), step, lambda s: s["n"])
    return F.when(F.col(text).rlike(pattern), walk).otherwise(0).cast("long")


def own_part(text: str = "text", lead: str = "lead", chars: str = "chars") -> Column:
    """The part of a window's text that no other window has as its own."""
    return F.substring(text, F.col(lead) + 1, F.col(chars))


def match_counts(windows: DataFrame, patterns: dict[str, str], keys: list[str] = ["file"]) -> DataFrame:
    """keys, chars, breaks (line feeds), matches (map of name and number, names without a match left out) of texts in windows."""
    own = own_part()
    breaks = F.length(own) - F.length(F.replace(own, F.lit("\n"), F.lit("")))
    each = windows.select(*keys, F.col("chars").cast("long").alias("chars"), breaks.cast("long").alias("breaks"), *(matches_in(p).alias(f"m{k}") for k, p in enumerate(patterns.values())))
    sums = each.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in each.columns if c not in keys))
    found = F.array_compact(F.array(*(F.when(F.col(f"m{k}") > 0, F.struct(F.lit(n).alias("key"), F.col(f"m{k}").alias("value"))) for k, n in enumerate(patterns))))
    return sums.select(*keys, "chars", "breaks", F.map_from_entries(found.cast("array<struct<key:string,value:bigint>>")).alias("matches"))


def report_order(severity: str = "severity") -> list[Column]:
    return [severity_rank(severity), F.col("category"), F.col("file"), F.col("line")]


def fan_out(rows: DataFrame, keys: list[str], order: list, limit: int = 25) -> DataFrame:
    """The first `limit` rows of each key with `position`, and a marker row (position limit + 1, truncated = how many more)."""
    # the first rows are cut while they are ranked; how many there are is a count of its own
    kept = rows.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= limit + 1)
    kept = kept.join(rows.groupBy(*keys).agg(F.count("*").alias("_k")), keys)
    marker = F.col("position") > limit
    rest = [c for c in rows.columns if c not in keys]
    return kept.select(*keys, *(F.when(~marker, F.col(c)).alias(c) for c in rest), "position", F.when(marker, F.col("_k") - limit).otherwise(0).alias("truncated"))
