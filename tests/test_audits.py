"""Inputs of audits, plans made again, tasks of variants, order of edges, the report of findings."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import aggregates as A
from sievework.operators import filters as P
from sievework.operators import review as V
from sievework.operators import windows as W
from sievework.sources import sinks as K

SAID = "batch int, sample int, case_id string, status string, signals_checked array<string>, evidence array<struct<file:string,line:int>>, conclusion string"


def frames(spark):
    files = spark.createDataFrame([(1, 1, "b.kt", "hb"), (1, 0, "a.kt", "ha"), (2, 0, "c.kt", "hc")], "batch int, position int, file string, sha256 string")
    expected = spark.createDataFrame([(1, "R-AI-001"), (1, "R-AI-068"), (1, "R-AI-070"), (2, "R-AI-001")], "batch int, case_id string")
    results = spark.createDataFrame([(1, 2, "r_1_2.json"), (1, 1, "r_1_1.json")], "batch int, sample int, result_file string")
    said = [(1, 1, "R-AI-001", "no_signal", ["x"], [], "none"), (1, 2, "R-AI-001", "mitigated", None, [("a.kt", 3)], "safe"), (1, 1, "R-AI-068", "candidate", ["y"], [("b.kt", 1)], "bad")]
    found = spark.createDataFrame([(1, 1, "R-AI-068", "b.kt", 1)], "batch int, sample int, rule_id string, file string, line int")
    return files, expected, results, spark.createDataFrame(said, SAID), found


def test_audit_inputs(spark):
    files, expected, results, said, found = frames(spark)
    plan = V.audit_inputs(files, expected, results, said, found)
    one, two = sorted(plan.collect(), key=lambda r: r["batch"])
    assert one["files"] == ["a.kt", "b.kt"] and one["expected_cases"] == ["R-AI-001", "R-AI-068", "R-AI-070"] and one["logic_cases"] == ["R-AI-068", "R-AI-070"]
    assert one["negative_cases"] == ["R-AI-001", "R-AI-070"] and one["disagreements"] == ["R-AI-001"] and one["problem"] is None
    first, second = one["prior_results"]
    assert (first["sample"], first["result_file"]) == (1, "r_1_1.json") and [a["case_id"] for a in first["case_assessments"]] == ["R-AI-001", "R-AI-068"]
    assert first["candidate_locations"][0]["rule_id"] == "R-AI-068" and second["candidate_locations"] == [] and second["case_assessments"][0]["evidence"][0]["line"] == 3
    assert (two["problem"], two["files"], two["prior_results"]) == ("no-results", ["c.kt"], None)
    assert V.audit_inputs(files.limit(0), expected, results, said, found).count() == 0


def test_hashes_bind_an_audit_to_its_inputs(spark):
    files, expected, results, said, found = frames(spark)
    plan = V.audit_inputs(files, expected, results, said, found)
    turned = V.audit_inputs(files.orderBy("file"), expected.orderBy(F.desc("case_id")), results.orderBy("sample"), said.orderBy(F.desc("status")).repartition(3), found)
    assert V.stale_audits(plan, turned).count() == 0
    changed = lambda **x: {(r["batch"], r["field"]) for r in V.stale_audits(plan, V.audit_inputs(*(x.get(n, df) for n, df in zip(("files", "expected", "results", "said", "found"), (files, expected, results, said, found))))).collect()}
    assert changed(files=files.withColumn("sha256", F.when(F.col("file") == "b.kt", "new").otherwise(F.col("sha256")))) == {(1, "source_sha256"), (1, "audit_sha256")}
    assert changed(found=found.withColumn("line", F.lit(2))) == {(1, "prior_sha256"), (1, "audit_sha256")}
    assert changed(files=files.where("batch = 1")) == {(2, "missing")}


def test_plan_made_again(spark):
    files = spark.createDataFrame([(f"m/F{k}.kt", f"class F{k} {{ fun f() {{ loadUrl(x{k}) }} }}\n" * (k + 1)) for k in range(9)], "file string, text string")
    edges = spark.createDataFrame([("m/F0.kt", "m/F5.kt", 3), ("m/F1.kt", "m/F2.kt", 1)], "source string, target string, weight int")
    policy = {"batch_size": 3, "token_budget": 5000}
    stored = spark.createDataFrame(V.plan_batches(V.analyse(files), edges, policy).collect())
    problems = lambda s, f=files: {(r["file"], r["problem"]) for r in V.plan_problems(s, f, edges, policy).collect()}
    assert stored.count() == 9 and problems(stored) == set()
    assert problems(stored.where("file <> 'm/F3.kt'")) == {("m/F3.kt", "missing")}
    moved = problems(stored.withColumn("batch", F.when(F.col("file") == "m/F0.kt", 77).otherwise(F.col("batch"))))
    assert moved == {("m/F0.kt", "missing"), ("m/F0.kt", "extra")}
    assert problems(stored.withColumn("tech", F.array().cast("array<string>")).where("size(tech) = 0")) >= {("m/F0.kt", "tech")}
    assert problems(stored.union(stored.where("file = 'm/F4.kt'"))) == {("m/F4.kt", "duplicate")}
    # a source that has changed since
    assert {p for f, p in problems(stored, files.withColumn("text", F.when(F.col("file") == "m/F8.kt", F.replace("text", F.lit("F8"), F.lit("G8"))).otherwise(F.col("text"))))} == {"sha256"}
    for bad in ({"batch_size": 0, "token_budget": 5000}, {"batch_size": True, "token_budget": 5000}, {"batch_size": 3, "token_budget": 999}, {}):
        with pytest.raises(ValueError):
            V.plan_problems(stored, files, edges, bad)


@pytest.mark.parametrize("flavors,types,want", [
    ([], ["debug", "release"], ["lintRelease", "lint"]),
    (None, None, ["lintRelease", "lint"]),
    (["free", "paid"], ["debug", "release", "beta"], ["lintFreeRelease", "lintFreeBeta", "lintPaidRelease", "lintPaidBeta", "lintRelease", "lintBeta", "lint"]),
    (["x"], ["stagingDebug", "Test", "androidTest"], ["lintXRelease", "lintRelease", "lint"]),
    ([], ["a", "A", "a"], ["lintA", "lint"]),
])
def test_lint_tasks(spark, flavors, types, want):
    row = spark.createDataFrame([(flavors, types)], "f array<string>, t array<string>")
    assert row.select(P.lint_tasks("f", "t")).first()[0] == want


def test_variants_fall_back_to_release(spark):
    flavors, types = spark.createDataFrame([("free",)], "flavor string"), spark.createDataFrame([("qaDebug",), ("debug",)], "build_type string")
    assert [tuple(r) for r in P.shipping_variants(flavors, types).collect()] == [("free", "release", "freeRelease")]
    assert [r["variant"] for r in P.shipping_variants(flavors, types.limit(0)).collect()] == ["freeRelease"]


def test_edges_in_order(spark):
    rng = random.Random(3)
    rows = list({(rng.choice("abc"), rng.choice("xyz"), rng.choice("kl")): rng.randrange(4) for _ in range(60)}.items())
    edges = spark.createDataFrame([(*k, w) for k, w in rows], "source string, target string, kind string, weight int").repartition(5)
    got = {r["position"]: (r["source"], r["target"], r["kind"]) for r in W.positions(edges, A.edge_order()).collect()}
    assert [got[k] for k in sorted(got)] == [k for k, w in sorted(rows, key=lambda x: (-x[1], x[0]))] and min(got) == 1


FOUND = "status string, rule_id string, category string, severity string, title string, file string, line int, why string, evidence string, repro string, suggestion string, dataflow_path array<struct<file:string,line:int,message:string>>, related_locations array<struct<file:string,line:int,title:string,category:string>>, source_candidate_ids array<string>"


def test_findings_report(spark):
    rows = [
        ("open", "R-1", "security/x", "critical", "Leak", "a.kt", 3, "because", "val x", "run it", "close it", [("a.kt", 1, "in"), ("b.kt", 2, None)], [("a.kt", 3, "Leak", "c"), ("d.kt", 4, "", "c2")], ["c1", "c2"]),
        ("open", "R-2", "perf/y", "minor", "Slow", "B.java", 9, None, "", None, None, None, [("B.java", 9, "Slow", "c")], []),
        ("open", "R-3", "perf/a", "minor", "First", "B.java", 1, None, None, None, None, None, None, None),
        ("open", "R-4", "z", "odd", "?", "z", 1, None, None, None, None, None, None, None),
        ("fixed", "R-5", "z", "critical", "gone", "z", 1, None, None, None, None, None, None, None),
    ]
    text = [r["text"] for r in K.findings_report(spark.createDataFrame(rows, FOUND), "en").collect()]
    assert text[0] == "# Scan results\n\n**Findings:** 1 critical · 0 major · 2 minor · 0 info (4 total)\n"
    assert [t.split("\n")[0] for t in text[1:]] == ["## Critical", "### R-1 · security/x", "## Minor", "### R-3 · perf/a", "### R-2 · perf/y"]
    assert text[2] == (
        "### R-1 · security/x\n**Leak** — a.kt:3\n\nWhy: because\n\n```kotlin\nval x\n```\n\nRepro: run it\nSuggestion: close it\n"
        "\n**Dataflow path:**\n  → `a.kt:1` — in\n  ⬇ `b.kt:2` — \n\n**Related locations:**\n- `a.kt:3` — Leak\n- `d.kt:4` — c2\n\n**Source candidates:** 2\n\n---\n"
    )
    assert text[5] == "### R-2 · perf/y\n**Slow** — B.java:9\n\n\n---\n"
    zh = [r["text"] for r in K.findings_report(spark.createDataFrame(rows, FOUND)).collect()]
    assert zh[0].startswith("# 扫描结果\n") and "原因: because" in zh[2] and "（合计 4）" in zh[0]
    assert [r["text"] for r in K.findings_report(spark.createDataFrame([], FOUND), "en").collect()] == ["# Scan results\n\n**Findings:** 0 critical · 0 major · 0 minor · 0 info (0 total)\n"]
