"""Aggregations: merging by identity, roll-ups, coverage and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.scalar import severity_name, severity_rank

from .filters import STATUSES


def richness(*fields) -> Column:
    """Characters of evidence; lists count by their JSON."""
    return sum((F.coalesce(F.length(F.col(f) if isinstance(f, str) else f), F.lit(0)) for f in fields), F.lit(0))


def dedupe_richest(rows: DataFrame, keys: list[str], score: Column, ordinal: str) -> DataFrame:
    """The richest row of each key, the first on ties; `first_seen` is the key's least ordinal."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(score, -F.col(ordinal)))
    return rows.groupBy(*keys).agg(best.alias("_r"), F.min(ordinal).alias("first_seen")).select(*keys, "_r.*", "first_seen")


def merge(rows: DataFrame, key: str, score: Column, ordinal: str, location: list[str], sources: str | None = None, detail: list[str] = [], lists: list[str] = []) -> DataFrame:
    """One row for each key: the richest row's fields, the worst severity, distinct locations and sources in order of the ordinal.

    `merged_manifestations` counts distinct locations and is null where nothing was merged; so is related_locations, unless the
    one row had some. A row's related_locations count after its own place. `detail` comes along with a location and does not tell it apart.
    Each array column of `lists` becomes its distinct items over all rows of the key (union_lists).
    """
    earlier = "related_locations" in rows.columns
    others = [c for c in rows.columns if c not in (key, "severity", "related_locations", "merged_manifestations", *lists)]
    place = F.struct(*(F.col(c) for c in location + detail))
    own = rows.select(key, ordinal, F.lit(0).alias("_p"), place.alias("_l"))
    if earlier:
        before = rows.select(key, ordinal, F.posexplode("related_locations").alias("_p", "_l")).where("_l is not null")
        types = dict(zip(location + detail, (f.dataType for f in own.schema["_l"].dataType.fields)))
        fields = before.schema["_l"].dataType.names
        own = own.unionByName(before.select(key, ordinal, (F.col("_p") + 1).alias("_p"), F.struct(*((F.col(f"_l.{c}") if c in fields else F.lit(None)).cast(types[c]).alias(c) for c in location + detail)).alias("_l")))
    first = F.struct(ordinal, "_p")
    spots = own.groupBy(key, *(F.col(f"_l.{c}").alias(c) for c in location)).agg(F.min(first).alias("_o"), F.min_by("_l", first).alias("_l"))
    spots = spots.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda x: x["_l"]).alias("_places"))
    out = rows.groupBy(key).agg(
        F.max_by(F.struct(*others), F.struct(score, -F.col(ordinal))).alias("_r"),
        F.min(severity_rank("severity")).alias("_rank"),
        F.min_by("severity", F.struct(severity_rank("severity"), F.col(ordinal))).alias("severity"),
        F.count("*").alias("inputs"),
        *([F.array_sort(F.collect_set(sources)).alias("merged_sources")] if sources else []),
    )
    merged = F.col("inputs") > 1
    # a row alone keeps what it had
    kept = F.when(F.size("_places") > 1, F.slice("_places", 2, F.size("_places") - 1))
    out = out.join(spots, key).select(key, "_r.*", "severity", "inputs", *(["merged_sources"] if sources else []), F.when(merged, F.col("_places")).otherwise(kept).alias("related_locations"), F.when(merged, F.size("_places")).alias("merged_manifestations"))
    return out.join(union_lists(rows, key, ordinal, lists), key, "left") if lists else out


def union_lists(rows: DataFrame, key: str, ordinal: str, lists: list[str]) -> DataFrame:
    """key and, for each array column, its distinct items over the key's rows, by the first row and place; null where there are none."""
    out = None
    for c in lists:
        items = rows.select(key, ordinal, F.posexplode(c).alias("_p", "_x")).where("_x is not null")
        first = items.groupBy(key, "_x").agg(F.min(F.struct(ordinal, "_p")).alias("_f"))
        own = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_x"))), lambda x: x["_x"]).alias(c))
        out = own if out is None else out.join(own, key, "full")
    return out


def merge_counters(rows: DataFrame, key: str, semantic: str, queue: str) -> DataFrame:
    """One row with the eight counters of a merge. rows: one an input; queue is confirmed, review, or moved (confirmed, held back for want of an origin).

    semantic tells whether the key names a root cause, and is the same for a key's rows.
    """
    held = F.col(queue) != "confirmed"
    per = rows.groupBy(key).agg(F.first(semantic).alias("_s"), F.count(F.when(~held, 1)).alias("_c"), F.count(F.when(held, 1)).alias("_h"), F.count(F.when(F.col(queue) == "moved", 1)).alias("_m"))
    more = F.greatest(F.col("_c") - 1, F.lit(0)) + F.greatest(F.col("_h") - 1, F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(
        *count_where(findings_total=F.col("_c") > 0, needs_review_total=(F.col("_c") == 0) & (F.col("_h") > 0)),
        total(more).alias("findings_duplicate"),
        total(F.when(F.col("_s"), more)).alias("semantic_duplicates_merged"),
        total(F.when(~F.col("_s"), more)).alias("exact_duplicates_merged"),
        *count_where(confirmed_review_conflicts_resolved=(F.col("_c") > 0) & (F.col("_h") > 0)),
        total(F.when(~F.col("_s"), F.col("_c") + F.col("_h"))).alias("records_without_root_cause"),
        total("_m").alias("moved_to_review_no_origin"),
    )


def lossless(coverage_ok, given, batched, batches, files) -> Column:
    """Whether a verifier's receipt is whole: all candidates batched, and as many batch files as batches."""
    return F.coalesce(F.col(coverage_ok) & (F.col(given) == F.col(batched)) & (F.col(batches) == F.col(files)), F.lit(False))


def phases(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phase, status, reason: four rows a run. runs: ai_excluded, hunt_files (null: no list was written), hunt_ok, gap_ok, verify_ok, merge_ok (null: no receipt)."""
    empty = F.coalesce(F.col("hunt_files"), F.lit(0)) == 0
    done = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "complete").otherwise("failed")
    why = lambda c, told: F.when(F.col(c).isNull(), "missing receipt").when(~F.col(c), told).otherwise("")
    row = lambda name, status, reason: F.struct(F.lit(name).alias("phase"), status.alias("status"), reason.alias("reason"))
    hunter = row(
        "ai_hunter",
        F.when(F.col("ai_excluded"), "skipped").when(F.col("hunt_files").isNull(), "failed").when(empty, "not_applicable").otherwise(done("hunt_ok")),
        F.when(F.col("ai_excluded"), "excluded").when(F.col("hunt_files").isNull(), "missing hunt scope").when(empty, "").otherwise(why("hunt_ok", "hunt coverage not ok")),
    )
    audit = row(
        "ai_gap_audit",
        F.when(F.col("ai_excluded"), "skipped").when(empty, "not_applicable").otherwise(done("gap_ok")),
        F.when(F.col("ai_excluded"), "excluded").when(empty, "").otherwise(why("gap_ok", "audit coverage not ok")),
    )
    rest = [row("verifier", done("verify_ok"), why("verify_ok", "not lossless")), row("merge", done("merge_ok"), why("merge_ok", "receipt does not match"))]
    return runs.select(*keys, F.inline(F.array(hunter, audit, *rest)))


def distinct_structs(items: DataFrame, key: str, fields: list[str], ordinal: str) -> DataFrame:
    """The first row of each (key, fields)."""
    w = W.partitionBy(key, *fields).orderBy(ordinal)
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def count_where(**conditions: Column) -> list[Column]:
    return [F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()]


def edges(raw: DataFrame, ordinal: str, most: int = 4, width: int = 240) -> DataFrame:
    """One row for each (source, target, kind): weight, and the first distinct evidence texts, cut before they are compared."""
    e = raw.withColumn("evidence", F.left("evidence", F.lit(width))).groupBy("source", "target", "kind", "evidence").agg(F.min(ordinal).alias("_o"), F.max("weight").alias("weight"))
    w = W.partitionBy("source", "target", "kind").orderBy("_o", "evidence")
    e = e.withColumn("_n", F.row_number().over(w))
    # evidence beyond the first few only adds to the group's weight, so lists stay short however often an edge occurs
    listed = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "evidence"))))
    return e.groupBy("source", "target", "kind").agg(F.max("weight").alias("weight"), F.transform(listed, lambda x: x.evidence).alias("evidence"))


def edge_order() -> list[Column]:
    """Edges as they are listed: the heaviest first, then by source, target and kind."""
    return [F.desc("weight"), F.asc("source"), F.asc("target"), F.asc("kind")]


def adjacency(edge: DataFrame) -> DataFrame:
    """node, neighbour, weight: both directions, weights summed; edges without an end are dropped."""
    e = edge.where("source <> '' and target <> ''") if dict(edge.dtypes)["source"] == "string" else edge.where("source is not null and target is not null")
    both = e.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "weight").union(e.select("target", "source", "weight"))
    return both.groupBy("node", "neighbour").agg(F.sum("weight").alias("weight"))


def kind_stats(edge: DataFrame) -> DataFrame:
    return edge.groupBy("kind").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def overall_status(stats: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """incomplete if any engine failed, stayed partial or is unknown; complete_with_skips if any was skipped; else complete."""
    s = F.coalesce(F.col(status), F.lit("complete"))
    bad = F.bool_or(~s.isin(*STATUSES) | s.isin("partial", "failed"))
    return stats.groupBy(*keys).agg(F.when(bad, "incomplete").when(F.bool_or(s == "skipped"), "complete_with_skips").otherwise("complete").alias("overall"))


def engine_rollup(stats: DataFrame, keys: list[str] = []) -> DataFrame:
    """Sums of the rules, the used and the incomplete engines, sorted."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("engine")))), ",")
    return stats.groupBy(*keys).agg(F.sum("rules_run").alias("rules_run"), F.sum("rules_triggered").alias("rules_triggered"), F.sum("candidates").alias("candidates"), names(F.col("status").isin("complete", "partial")).alias("engines_used"), names(~F.col("status").isin("complete", "not_applicable")).alias("incomplete_engines"))


def integrity_problems(stats: DataFrame, registry: DataFrame, declared: DataFrame) -> DataFrame:
    """problem, engine: engines that are duplicate, missing, unexpected, or whose declared summary differs from its rows."""
    from .joins import compare_sets, compare_values

    sets = compare_sets(registry, stats, ["engine"]).select("problem", "engine")
    summary = stats.groupBy("engine").agg(F.sum("candidates").alias("candidates"))
    return sets.union(compare_values(summary, declared, ["engine"], ["candidates"]).select(F.concat(F.lit("summary:"), "field").alias("problem"), "engine"))


def severity_counts(rows: DataFrame, keys: list[str] = []) -> DataFrame:
    """Counts of the four known severities, and a total that counts unknown ones too."""
    n = {s: F.col("severity") == s for s in ("critical", "major", "minor", "info")}
    return rows.groupBy(*keys).agg(*count_where(**n), F.count("*").alias("total"))


def sample_coverage(results: DataFrame, planned: DataFrame, least: int) -> DataFrame:
    """batch, samples, problems, covered: distinct samples against the least, and the number of problem rows. results: batch, sample, problem (null: none)."""
    r = results.groupBy("batch").agg(F.countDistinct("sample").alias("samples"), F.count("problem").alias("problems"))
    out = planned.select("batch").distinct().join(r, "batch", "left").na.fill(0, ["samples", "problems"])
    return out.withColumn("covered", (F.col("samples") >= least) & (F.col("problems") == 0))


def attested_coverage(expected: DataFrame, attested: DataFrame, results: DataFrame, least: int) -> DataFrame:
    """batch, samples, results, missing, stray, ok: plans of the first version, whose receipts and results are counted apart.

    expected: batch, perspective (null: none); attested: batch, sample, perspective (null: none); results: batch, sample. A batch is
    ok when each expected perspective is in some receipt and there are as many results as receipts, `least` and one at least.
    """
    lacks = expected.where("perspective is not null").distinct().join(attested.select("batch", "perspective").distinct(), ["batch", "perspective"], "left_anti")
    lacks = lacks.groupBy("batch").agg(F.array_join(F.array_sort(F.collect_set("perspective")), ",").alias("missing"))
    n = lambda df, name: df.groupBy("batch").agg(F.countDistinct("sample").alias(name))
    out = expected.select("batch").distinct().withColumn("_e", F.lit(True)).join(n(attested, "samples"), "batch", "full").join(n(results, "results"), "batch", "full")
    out = out.join(lacks, "batch", "left").na.fill(0, ["samples", "results"]).na.fill("", ["missing"])
    fits = F.col("_e").isNotNull() & (F.col("missing") == "") & (F.col("samples") == F.col("results")) & (F.col("samples") >= max(least, 1))
    return out.select("batch", "samples", "results", "missing", F.col("_e").isNull().alias("stray"), fits.alias("ok"))


def case_status(assessed: DataFrame, planned: DataFrame, keys: list[str], negative: list[str]) -> DataFrame:
    """keys, statuses, negative (all statuses are, or there is none), disagreement (several distinct ones)."""
    s = assessed.groupBy(*keys).agg(F.countDistinct("status").alias("_n"), F.bool_and(F.col("status").isin(*negative)).alias("_neg"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))
    both = planned.select(*keys).distinct().join(s, keys, "full")
    return both.select(*keys, F.coalesce("statuses", F.lit("")).alias("statuses"), F.coalesce("_neg", F.lit(True)).alias("negative"), (F.coalesce("_n", F.lit(0)) > 1).alias("disagreement"))


def suppression_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("suppressed"))


def precision_recall(counts: DataFrame, by: list[str]) -> DataFrame:
    """Micro averages over the counts tp, fp, fn; null where a denominator is zero; F1 is null where one of both is null or zero."""
    s = counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    s = s.withColumns({"precision": p, "recall": r})
    return s.withColumn("f1", F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def fingerprint(rows: DataFrame, path: str, content: str) -> DataFrame:
    """One SHA-256 over path, NUL, content, NUL of a rule set's files by path. A rule set is a short list of small files."""
    line = F.struct(F.col(path).alias("p"), F.concat(F.hex(F.encode(path, "UTF-8")), F.lit("00"), F.hex(F.col(content).cast("binary")), F.lit("00")).alias("x"))
    return rows.agg(F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda v: v.x), "")), 256).alias("fingerprint"))


def rule_kinds(hits: DataFrame, configured: DataFrame) -> DataFrame:
    """engine, rules_run (different checks that reported), rules_configured (never less). hits: engine, check; configured: engine, rules."""
    run = hits.where("check is not null and check <> ''").groupBy("engine").agg(F.countDistinct("check").alias("rules_run"))
    both = run.join(configured.groupBy("engine").agg(F.sum("rules").alias("_n")), "engine", "full")
    ran = F.coalesce("rules_run", F.lit(0))
    return both.select("engine", ran.alias("rules_run"), F.greatest(F.coalesce("_n", F.lit(0)), ran).alias("rules_configured"))


def scope_stats(files: DataFrame, missing: DataFrame, hunts: bool = True) -> DataFrame:
    """One row of counts. files: file, direct, in_scope, in_hunt, in_context, deleted (booleans); missing: file. should_hunt: the
    evidence of a language model is required, as its engine is not excluded (`hunts`) and there are files to hunt in."""
    n = lambda c: F.count(F.when(F.expr(c), 1))
    gone = missing.select(F.count("*").alias("missing_changed"))
    own = files.agg(
        n("direct and not deleted").alias("direct_files"), n("in_scope and not direct and not deleted").alias("impact_added"), n("in_scope").alias("scope_files"),
        n("in_hunt").alias("hunt_files"), n("in_context").alias("context_files"), n("deleted").alias("deleted_files"), n("direct").alias("direct_paths_total"),
    )
    return own.crossJoin(F.broadcast(gone)).withColumn("should_hunt", F.lit(hunts) & (F.col("hunt_files") > 0))  # one row each


def coverage(rows: DataFrame, keys: list[str] = []) -> DataFrame:
    """Conservation of inputs by `state` (analysed, generated, missing): counts, and whether they add up with nothing missing."""
    n = {s: F.col("state") == s for s in ("analysed", "generated", "missing")}
    out = rows.groupBy(*keys).agg(F.count("*").alias("total_input"), *count_where(**n))
    return out.withColumn("coverage_ok", (F.col("total_input") == F.col("analysed") + F.col("generated") + F.col("missing")) & (F.col("missing") == 0))


def worst(rank: str) -> Column:
    return severity_name(rank)
