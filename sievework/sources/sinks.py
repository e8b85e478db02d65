"""Sinks: run folders, batches, reports and manifests. A run writes into a folder of its own; nothing is removed by pattern."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalar import fence, percent, severity_rank

# Fields of a run manifest that later phases may not change.
MANIFEST_VERSION = 1


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replaces a table as a whole: the new one is written beside it and takes its name when it is complete.

    A write that fails leaves the old table. Between the removal of the old name and the renaming readers find none.
    """
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.{uuid.uuid4().hex}"))
    df.write.format(form).save(new.toString())
    fs = old.getFileSystem(conf)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{new.toString()} could not take the name {path}")


def write_batches(files: DataFrame, path: str) -> None:
    """One folder of JSON a batch."""
    files.write.mode("overwrite").partitionBy("batch").json(path)


def write_list(files: DataFrame, path: str, column: str = "file") -> None:
    """A sorted list as lines of text, in one file: a file list of a project."""
    files.select(F.col(column).cast("string").alias("value")).distinct().coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def run_path(base: str, run_id: str, name: str) -> str:
    """Where a run's artefact lies. A new run never meets an older one's files."""
    return f"{base.rstrip('/')}/run_id={run_id}/{name}"


def report(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, report: one line a finding, by severity, category, file and line."""
    line = F.concat(F.lit("["), "severity", F.lit("] "), "category", F.lit(":"), F.col("line").cast("string"))
    item = F.struct(severity_rank("severity").alias("r"), F.col("category").alias("c"), F.col("file").alias("f"), F.col("line").alias("l"), line.alias("x"))
    return findings.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.x), "\n").alias("report"))


def markdown(findings: DataFrame, title: str) -> DataFrame:
    """The lines of a Markdown report as rows (position, text): a head with the counts, then the items in report order.

    Items of unknown severity count in the total and are not listed. What is written down is a bounded report; the
    ordering is Spark's global sort, so rows may be streamed to a file.
    """
    known = findings.withColumn("_r", severity_rank("severity"))
    counts = known.agg(F.count("*").alias("n"), *(F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("critical", "major", "minor", "info")))
    head = counts.select(F.lit(-1).alias("_r"), F.lit("").alias("category"), F.lit("").alias("file"), F.lit(0).cast("long").alias("line"), F.format_string(f"# {title}\n\n%d findings: %d critical, %d major, %d minor, %d info\n", "n", "critical", "major", "minor", "info").alias("text"))
    mark = F.lit("```")
    item = F.concat(F.lit("## ["), "severity", F.lit("] "), F.coalesce("title", "category"), F.lit("\n"), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("\n\n"), mark, fence("file"), F.lit("\n"), F.coalesce("evidence", F.lit("")), F.lit("\n"), mark, F.lit("\n"))
    items = known.where("_r < 99").select("_r", "category", "file", F.col("line").cast("long").alias("line"), item.alias("text"))
    return head.unionByName(items).orderBy("_r", "category", "file", "line").select("text")


# Heads, labels and default reasons of the report of undecided items, by language.
REVIEW_TEXTS = {
    "zh": ("# 待复核项", "> 这些条目有有效线索，但当前证据不足以确认或排除。它们不计入正式 finding。", "待复核：", "位置", "复核原因", "证据不足", "缺少证据", "现有线索：", "、"),
    "en": ("# Needs review", "> These items have useful signals, but current evidence is insufficient to confirm or reject them. They are not confirmed findings.", "Needs review:", "Location", "Review reason", "Insufficient evidence", "Missing evidence", "Current evidence:", ", "),
}


def review_report(items: DataFrame, language: str = "zh") -> DataFrame:
    """The lines (text) of the report of undecided items in report order, below a head with their number. items: rule_id, title,
    category, severity, file, line, review_reason, missing_evidence array<string>, evidence."""
    head, note, count, place, why, default, lacks, shown, comma = REVIEW_TEXTS["en" if language == "en" else "zh"]
    said = lambda c, other="": F.coalesce(F.col(c).cast("string"), F.lit(other))
    missing = F.array_join("missing_evidence", comma)
    mark = F.lit("```")
    text = F.concat(
        F.lit("## "), said("rule_id", "?"), F.lit(" · "), said("title"), F.lit(f"\n\n{place}: `"), said("file"), F.lit(":"), said("line", "0"), F.lit(f"`\n\n{why}: "), said("review_reason", default),
        F.when(F.coalesce(missing, F.lit("")) != "", F.concat(F.lit(f"\n\n{lacks}: "), missing)).otherwise(""),
        F.when(said("evidence") != "", F.concat(F.lit(f"\n\n{shown}\n\n"), mark, fence("file"), F.lit("\n"), F.col("evidence"), F.lit("\n"), mark)).otherwise(""),
        F.lit("\n\n---\n"),
    )
    rows = items.select(severity_rank("severity").alias("_r"), said("category").alias("_c"), said("file").alias("_f"), F.col("line").cast("long").alias("_l"), text.alias("text"))
    top = items.agg(F.count("*").alias("n")).select(F.lit(-1).alias("_r"), F.lit("").alias("_c"), F.lit("").alias("_f"), F.lit(0).cast("long").alias("_l"), F.format_string(f"{head}\n\n{note}\n\n**{count}** %d\n", "n").alias("text"))
    return top.unionByName(rows).orderBy("_r", "_c", "_f", "_l").select("text")


# Heads and labels of the report of findings, by language; counts are given in the order of the severities, then the total.
FINDING_TEXTS = {
    "zh": ("# 扫描结果", "**本次发现：** %d critical · %d major · %d minor · %d info（合计 %d）", "原因", "复现", "修复建议", "**数据流路径:**", "**相关定位:**", "来源候选"),
    "en": ("# Scan results", "**Findings:** %d critical · %d major · %d minor · %d info (%d total)", "Why", "Repro", "Suggestion", "**Dataflow path:**", "**Related locations:**", "Source candidates"),
}
SEVERITIES = ("critical", "major", "minor", "info")


def findings_report(findings: DataFrame, language: str = "zh") -> DataFrame:
    """The texts of the report of open findings in report order: a head with the counts, a heading a severity, an item a finding.

    findings: status, rule_id, category, severity, title, file, line, why, evidence, repro, suggestion, dataflow_path array<struct<file, line,
    message>>, related_locations array<struct<file, line, title, category>>, source_candidate_ids array<string>. Unknown severities count in the
    total and are not listed. The order is Spark's global sort; texts may be streamed to a file.
    """
    head, count, why, repro, fix, path, near, sources = FINDING_TEXTS["en" if language == "en" else "zh"]
    known = findings.where("status = 'open'").withColumn("_r", severity_rank("severity"))
    said = lambda c, other="": F.coalesce(F.col(c).cast("string"), F.lit(other))
    place = lambda x: F.concat(F.lit("`"), F.coalesce(x.file, F.lit("")), F.lit(":"), F.coalesce(x.line, F.lit(0)).cast("string"), F.lit("` — "))
    labelled = lambda label, c, end: F.when(said(c) != "", F.concat(F.lit(f"{label}: "), F.col(c), F.lit(end))).otherwise("")
    steps, marks = F.size("dataflow_path"), F.lit("```")
    hops = F.transform("dataflow_path", lambda x, k: F.concat(F.lit("  "), F.when(k < steps - 1, "→").otherwise("⬇"), F.lit(" "), place(x), F.coalesce(x.message, F.lit(""))))
    other = F.transform("related_locations", lambda x: F.concat(F.lit("- "), place(x), F.coalesce(F.nullif(x.title, F.lit("")), x.category, F.lit(""))))
    text = F.concat(
        F.lit("### "), said("rule_id", "?"), F.lit(" · "), said("category"), F.lit("\n**"), said("title"), F.lit("** — "), said("file"), F.lit(":"), said("line", "0"), F.lit("\n\n"),
        labelled(why, "why", "\n\n"),
        F.when(said("evidence") != "", F.concat(marks, fence("file"), F.lit("\n"), F.col("evidence"), F.lit("\n"), marks, F.lit("\n\n"))).otherwise(""),
        labelled(repro, "repro", "\n"), labelled(fix, "suggestion", "\n"),
        F.when(steps > 0, F.concat(F.lit(f"\n{path}\n"), F.array_join(hops, "\n"), F.lit("\n"))).otherwise(""),
        F.when(F.size("related_locations") > 1, F.concat(F.lit(f"\n{near}\n"), F.array_join(other, "\n"), F.lit("\n"))).otherwise(""),
        F.when(F.size("source_candidate_ids") > 0, F.concat(F.lit(f"\n**{sources}:** "), F.size("source_candidate_ids").cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("\n---\n"),
    )
    row = lambda r, k, t: [r.alias("_r"), F.lit(k).alias("_k"), *t]
    blank = [F.lit("").alias("_c"), F.lit("").alias("_f"), F.lit(0).cast("long").alias("_l")]
    items = known.where(F.col("_r") < 99).select(*row(F.col("_r"), 1, [said("category").alias("_c"), said("file").alias("_f"), F.col("line").cast("long").alias("_l"), text.alias("text")]))
    levels = known.where(F.col("_r") < 99).select("_r", "severity").distinct().select(*row(F.col("_r"), 0, [*blank, F.concat(F.lit("## "), F.initcap(F.lower("severity")), F.lit("\n")).alias("text")])).distinct()
    counts = known.agg(F.count("*").alias("n"), *(F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES))
    top = counts.select(*row(F.lit(-1), 0, [*blank, F.format_string(f"{head}\n\n{count}\n", *SEVERITIES, "n").alias("text")]))
    return top.unionByName(levels).unionByName(items).orderBy("_r", "_k", "_c", "_f", "_l").select("text")


def map_receipt(map_text: DataFrame, batch_text: DataFrame, backend: str) -> DataFrame:
    """The receipt of a map (file, text and, where its maker tells, truncated) that was made for a batch (file, text): names, SHA-256, backend,
    whether it is degraded or cut. Without the flag the map's own words tell."""
    said = F.col("text").contains("截断") | F.col("text").contains("已用尽") | F.col("text").contains("[truncated")
    cut = F.coalesce("truncated", F.lit(False)) if "truncated" in map_text.columns else said
    m = map_text.select(F.col("file").alias("map_file"), F.sha2("text", 256).alias("map_sha256"), cut.alias("map_truncated"))
    b = batch_text.select(F.col("file").alias("batch_file"), F.sha2("text", 256).alias("batch_sha256"))
    return m.join(F.broadcast(b), how="left").select(F.lit(2).alias("schema_version"), F.lit(backend).alias("backend"), (F.lit(backend) != "treesitter").alias("degraded"), "*")  # one row each


def degraded_map(files: DataFrame) -> DataFrame:
    """file, text, degraded: the map of files without an index, which says so for each of them."""
    return files.select("file", F.concat(F.lit("### "), "file", F.lit("\n  (no signatures without an index: read this file)")).alias("text"), F.lit(True).alias("degraded"))


def benchmark_report(scores: DataFrame) -> DataFrame:
    """The lines (text) of a table of navigation scores (backend, tp, fp, fn, precision, recall, f1, seconds) by backend; a dash for what is undefined."""
    line = F.concat(F.lit("| `"), "backend", F.lit("` | "), percent("precision"), F.lit(" | "), percent("recall"), F.lit(" | "), percent("f1"), F.lit(" | "), F.concat_ws("/", F.col("tp").cast("string"), (F.col("tp") + F.col("fp")).cast("string"), (F.col("tp") + F.col("fn")).cast("string")), F.lit(" | "), F.round("seconds", 2).cast("string"), F.lit(" |"))
    head = scores.sparkSession.createDataFrame([("", 0, "| backend | precision | recall | F1 | hits/returned/truth | seconds |"), ("", 1, "|---|---|---|---|---|---|")], "b string, k int, text string")
    return head.unionByName(scores.select(F.col("backend").alias("b"), F.lit(2).alias("k"), line.alias("text"))).orderBy("k", "b").select("text")


def write_audit(plan: DataFrame, artefacts: dict[str, DataFrame], base: str, run_id: str) -> None:
    """An audit's plan and artefacts as JSON below the run's own folder, so that those of an older plan are never read with them."""
    for name, df in {**artefacts, "gap_audit_plan": plan}.items():
        df.write.mode("errorifexists").json(run_path(base, run_id, name))


def skeletons(defs: DataFrame) -> DataFrame:
    """file, text: a head and the signatures of a file's definitions (file, line, kind, sig) by line; a method without a body's brace ends in dots."""
    cut = (F.col("kind") == "method") & ~F.rtrim("sig").rlike(r"[{;]$")
    line = F.concat(F.lit("  "), "sig", F.when(cut, "  ...").otherwise(""))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("text")))), lambda x: x.text)
    return defs.groupBy("file").agg(rows.alias("_l")).select("file", F.concat(F.lit("### "), "file", F.lit("\n"), F.array_join("_l", "\n")).alias("text"))


def status_lines(stats: DataFrame, scanned: str = "%s: %s, %d candidates") -> DataFrame:
    """One banner line an engine."""
    return stats.select("engine", F.format_string(scanned, "engine", "status", F.coalesce("candidates", F.lit(0))).alias("text"))


def manifest(spark, facts: dict) -> DataFrame:
    """One row of a new run: its id, version and the given facts."""
    row = spark.createDataFrame([tuple(facts.values())], list(facts))
    return row.select(F.expr("uuid()").alias("run_id"), F.lit(MANIFEST_VERSION).alias("schema_version"), "*")


def finish_manifest(runs: DataFrame, run_id: str, facts: dict) -> DataFrame:
    """The run's row with what became known at the end; other runs stay."""
    own = F.col("run_id") == run_id
    return runs.withColumns({k: F.when(own, F.lit(v)).otherwise(F.col(k) if k in runs.columns else F.lit(None)) for k, v in facts.items()})


def publish(spark, tables: dict, base: str, run_id: str) -> dict:
    """Writes tables (name: DataFrame and the condition of a bad row) below the run's folder, all or none, and returns the receipt.

    The pass that stages a table also counts its rows and bad ones and folds its rows into a fingerprint that their order does not
    change. Only if no table has a bad row the staged folder takes the place of the run's; otherwise it goes, and what was
    published before stays as it is. The receipt has status published or refused, and rows, problems and fingerprint by table.
    """
    from pyspark.sql import Observation

    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    final, staged, old = (f"{base.rstrip('/')}/{run_id}{end}" for end in ("", ".staged", ".old"))
    fs = path(final).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(staged), True)
    receipt = {"run_id": run_id, "tables": {}}
    for name, (df, bad) in tables.items():
        seen = Observation(name)
        fold = F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in df.columns)}))")
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(bad, F.lit(False))).alias("problems"), fold.alias("fold")).write.parquet(f"{staged}/{name}")
        own = seen.get
        receipt["tables"][name] = {"rows": own["rows"], "problems": own["problems"], "fingerprint": f"{(own['fold'] or 0) & (1 << 64) - 1:016x}"}
    receipt["status"] = "refused" if any(x["problems"] for x in receipt["tables"].values()) else "published"
    if receipt["status"] == "refused":
        fs.delete(path(staged), True)
        return receipt
    spark.createDataFrame([(json.dumps(receipt, sort_keys=True),)], "receipt string").coalesce(1).write.text(f"{staged}/receipt")
    fs.delete(path(old), True)
    if fs.exists(path(final)) and not fs.rename(path(final), path(old)):
        raise OSError(f"{final} could not be moved")
    if not fs.rename(path(staged), path(final)):
        fs.rename(path(old), path(final))
        raise OSError(f"{staged} could not be moved")
    fs.delete(path(old), True)
    return receipt
