import pytest
from pyspark.sql import functions as F

from sievework.functions import catalogue as C
from sievework.operators import joins as J
from sievework.operators import review as R


def test_catalogue(spark):
    assert len(C.RULE_MAPS["lint"]) == 38 and len(C.RULE_MAPS["detekt"]) == 22 and len(C.MARKERS) == 29 and set(C.GATES) == set(C.CASES)
    assert C.policy({"hunt_samples": True, "hunt_batch_size": 5, "hunt_token_budget": 10}) == {"samples": 2, "batch_size": 5, "token_budget": 24_000}
    assert C.excluded_engines({"excluded_engines": [" PMD", "pmd", "x", 3]}) == ["pmd"] and C.excluded_engines([]) == []
    rows = spark.createDataFrame([("Recycle", "warning"), ("Other", "error")], "native string, level string")
    got = J.map_rules(rows, C.rule_map(spark, "lint"), "native", {"rule_id": F.lit("R-LT-000"), "category": F.lit("lint/other"), "severity": F.col("level")}).orderBy("native").collect()
    assert [(r["rule_id"], r["severity"]) for r in got] == [("R-LT-000", "error"), ("R-LT-013", "major")]


def test_analysis_and_text_rules(spark):
    files = spark.createDataFrame([("app/src/main/AndroidManifest.xml", '<a>\n<x android:exported="true"/>\n\n<y android:exported = "true"/>'), ("a/B.kt", "val x = y!!\nif (a !!= b) z!!.c()"), ("x/build/C.kt", "WebView")], "file string, text string")
    got = {r["file"]: r for r in R.analyse(files).collect()}
    assert set(got) == {"app/src/main/AndroidManifest.xml", "a/B.kt"} and got["app/src/main/AndroidManifest.xml"]["tech"] == ["exported"] and got["app/src/main/AndroidManifest.xml"]["risk_score"] == 3
    hits = {(r["file"], r["line"], r["rule_id"]) for r in R.text_rule_hits(files).collect()}
    assert hits == {("app/src/main/AndroidManifest.xml", 2, "R-SG-007"), ("app/src/main/AndroidManifest.xml", 4, "R-SG-007"), ("a/B.kt", 1, "R-SG-032"), ("a/B.kt", 2, "R-SG-032")}


def test_suppression(spark):
    c = spark.createDataFrame([("R-SG-060", "m", "x"), ("R-SG-023", "k", "registerReceiver( null, f)"), ("R-SG-023", "k", "addListener(cb)"), ("R-SG-023", "k", "addListener(other)"), ("R-SG-060", "k", "x")], "rule_id string, file string, snippet string")
    files = spark.createDataFrame([("m", "android.permission.ACCESS_COARSE_LOCATION"), ("k", "try { } finally { removeListener(cb) }")], "file string, text string")
    assert sorted((r["snippet"], r["suppression"] or "") for r in R.suppressed(c, files).collect()) == sorted([("x", "fine-coarse-permission-pair-present"), ("registerReceiver( null, f)", "sticky-broadcast-null-receiver"), ("addListener(cb)", "paired-release-in-finally"), ("addListener(other)", ""), ("x", "")])
    v = spark.createDataFrame([("CloseResource", "style"), ("X", "Error Prone"), ("Y", "Code Style")], "native_rule_id string, ruleset string")
    assert R.emitted(v).count() == 2 and R.emitted(v, True).count() == 3


def test_batches_and_cases(spark):
    analysed = spark.createDataFrame([("a", 5, 100, ["webview"]), ("b", 1, 100, ["crypto"]), ("c", 3, 100, [])], "file string, risk_score int, estimated_tokens long, tech array<string>")
    edges = spark.createDataFrame([("a", "b", 5)], "source string, target string, weight int")
    b = R.plan_batches(analysed, edges, {"batch_size": 2, "token_budget": 1000})
    got = {(r["batch"], r["file"]) for r in b.collect()}
    assert got == {(0, "a"), (0, "b"), (1, "c")}
    cases = {(r["batch"], r["perspective"]): r["cases"] for r in R.expected_cases(b).collect()}
    assert (0, "webview") in cases and (1, "webview") not in cases and cases[(1, "performance")] == ["R-AI-009", "R-AI-010", "R-AI-011"] and cases[(1, "free")] == []


def test_receipts_and_audits(spark):
    rng = "array<struct<start:int,end:int>>"
    expected = spark.createDataFrame([(1, 1, "a", "h", 3), (1, 1, "b", "h", 2), (1, 1, "e", "h", 0)], "batch int, sample int, file string, sha256 string, line_count int")
    reads = spark.createDataFrame([(1, 1, "a", "x", 3, [(1, 2)]), (1, 1, "c", "h", 1, [(1, 1)]), (1, 1, "e", "h", 0, [])], f"batch int, sample int, file string, sha256 string, line_count int, ranges {rng}")
    got = {(r["file"], r["problem"]) for r in R.read_problems(reads, expected).collect()}
    assert got == {("b", "missing"), ("c", "extra"), ("a", "sha256"), ("a", "ranges")}
    assessed = spark.createDataFrame([(1, "A", "candidate"), (1, "B", "odd"), (1, "A2", "no_signal")], "batch int, case_id string, status string")
    planned = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C")], "batch int, case_id string")
    none = spark.createDataFrame([], "batch int, rule_id string")
    got = {(r["case_id"], r["problem"]) for r in R.case_problems(assessed, planned, none, ("no_signal", "mitigated", "candidate", "needs_context")).collect()}
    assert got == {("C", "missing"), ("A2", "extra"), ("B", "status"), ("A", "no-candidate")}
    plan = R.audit_plan(assessed, planned).first()
    assert plan["negative_cases"] == ["A2", "C"] and plan["disagreements"] == []
    state = R.audit_result(spark.createDataFrame([(1,), (2,), (3,)], "batch int"), spark.createDataFrame([(1,), (3,), (4,)], "batch int"), spark.createDataFrame([(3,)], "batch int"))
    assert {r["batch"]: r["state"] for r in state.collect()} == {1: "audited", 2: "missing", 3: "failed", 4: "stray"}


def test_impact(spark):
    files = spark.createDataFrame([("app/A.kt", "b()"), ("app/B.kt", "fun b() {}"), ("app/D.kt", "val g: Gone"), ("lib/C.kt", "a()"), ("lib/x.xml", ""), ("app/res.xml", "")], "file string, text string")
    changed = spark.createDataFrame([("app/A.kt", False)], "file string, deleted boolean")
    none = spark.createDataFrame([("app/A.kt", "app/res.xml", 1)], "source string, target string, weight int")
    defs = spark.createDataFrame([("a", "app/A.kt"), ("b", "app/B.kt")], "name string, file string")
    calls = spark.createDataFrame([("app/A.kt", "a", "b"), ("lib/C.kt", "c", "a")], "caller_file string, caller string, name string")
    run = lambda ch, depth: {r["file"] for r in R.impact_slice(files, ch, none, defs, calls, ["app", "lib"], depth, ["AndroidManifest.xml"]).collect()}
    assert run(changed, 1) == {"app/A.kt", "app/B.kt", "lib/C.kt", "app/res.xml"}
    assert run(changed, 0) == {"app/A.kt"}
    gone = spark.createDataFrame([("lib/Gone.kt", True)], "file string, deleted boolean")
    assert run(gone, 1) == {"lib/C.kt", "lib/x.xml", "app/D.kt"}
    assert len(run(spark.createDataFrame([("top.kt", True)], "file string, deleted boolean"), 0)) == 6


HOP = "array<struct<file:string,line:int,message:string>>"
SCHEMA = f"file string, line int, end_line int, rule_id string, category string, severity string, title string, evidence string, why string, repro string, suggestion string, dataflow_path {HOP}, origin_trace {HOP}, root_cause struct<primary_file:string,symbol:string,failure_mode:string>, ordinal int"


def test_final_merge(spark):
    row = lambda o, **k: tuple({"file": "a.kt", "line": o, "end_line": None, "rule_id": "R", "category": "stability/x", "severity": "minor", "title": "t", "evidence": "e", "why": "w", "repro": "r", "suggestion": "s", "dataflow_path": None, "origin_trace": None, "root_cause": None, "ordinal": o} | k for _ in (0,))[0]
    names = [f.split()[0] for f in "file,line,end_line,rule_id,category,severity,title,evidence,why,repro,suggestion,dataflow_path,origin_trace,root_cause,ordinal".split(",")]
    made = lambda rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    root = ("a.kt", "f", "leak")
    confirmed = made([row(1, root_cause=root), row(2, root_cause=("A.KT", " f ", "Leak"), severity="critical", evidence="longer evidence"), row(3, category="security/webview"), row(4, category="security/webview", dataflow_path=[("b", 1, "m")])])
    review = made([row(5, line=4, category="security/webview"), row(6)])
    findings, held = R.merge_findings(confirmed, review)
    got = {r["line"]: r for r in findings.collect()}
    assert set(got) == {2, 4} and got[2]["severity"] == "critical" and got[2]["merged_manifestations"] == 2 and got[2]["end_line"] == 2 and got[2]["status"] == "open"
    assert sorted((r["line"], r["status"]) for r in held.collect()) == [(3, "needs_review"), (6, "needs_review")]
    with pytest.raises(ValueError):
        R.merge_findings(made([row(1, title=" ")]), review)


def test_merge_keeps_provenance(spark):
    place = "array<struct<file:string,line:int,rule_id:string,category:string>>"
    form = f"{SCHEMA}, candidate_id string, source_candidate_ids array<string>, provenance array<struct<engine:string>>, related_locations {place}"
    root = ("a.kt", "f", "leak")
    row = lambda o, ids, cid, prov, near, cause=root: ("a.kt", o, None, "R", "stability/x", "minor", f"t{o}", "e" * o, "w", "r", "s", None, None, cause, o, cid, ids, prov, near)
    rows = spark.createDataFrame([row(1, ["x", ""], "c1", [("pmd",)], [("z.kt", 9, "R", "stability/x"), ("a.kt", 2, "R", "stability/x")]), row(2, ["x", "y"], None, [("lint",), ("pmd",)], None), row(7, None, None, None, [("q", 1, "R", "c")], None)], form)
    findings, held = R.merge_findings(rows, rows.limit(0))
    got = {r["line"]: r for r in findings.collect()}
    assert got[2]["source_candidate_ids"] == ["x", "c1", "y"] and [p["engine"] for p in got[2]["provenance"]] == ["pmd", "lint"]
    assert [(p["file"], p["line"], p["title"]) for p in got[2]["related_locations"]] == [("a.kt", 1, "t1"), ("z.kt", 9, None), ("a.kt", 2, None)] and got[2]["merged_manifestations"] == 3
    assert [p["file"] for p in got[7]["related_locations"]] == ["q"] and got[7]["merged_manifestations"] is None and got[7]["provenance"] is None
    counters = R.merge_receipt(rows, rows.where("line = 2")).first().asDict()
    assert counters == {"findings_total": 2, "needs_review_total": 0, "findings_duplicate": 1, "semantic_duplicates_merged": 1, "exact_duplicates_merged": 0, "confirmed_review_conflicts_resolved": 1, "records_without_root_cause": 1, "moved_to_review_no_origin": 0}


def test_case_evidence(spark):
    spot = "array<struct<file:string,line:int>>"
    audits = spark.createDataFrame(
        [
            (1, "A", "new_candidate", ["s"], "long enough", [("x\\a.kt", 3)]),
            (1, "B", "agree_mitigated", [], "no", None),
            (1, "C", "agree_no_signal", ["s", " "], "fine then", [("b.kt", 1), ("x/a.kt", 0), ("x/a.kt", 9)]),
            (1, "D", "unresolved", ["s"], "fine then", None),
            (1, "E", None, None, None, None),
            (2, "A", "agree_no_signal", ["s"], "fine then", [("x/a.kt", 1)]),
        ],
        f"batch int, case_id string, disposition string, signals_checked array<string>, conclusion string, evidence {spot}",
    )
    expected = spark.createDataFrame([(1, c) for c in "ABCDE"] + [(2, "A")], "batch int, case_id string")
    files = spark.createDataFrame([(1, "x/a.kt", 5)], "batch int, file string, line_count int")
    none = spark.createDataFrame([], "batch int, rule_id string")
    got = sorted((r["batch"], r["case_id"], r["problem"]) for r in R.audit_case_problems(audits, expected, none, files).collect())
    assert got == sorted([(1, "A", "no-candidate"), (1, "B", "signals"), (1, "B", "conclusion"), (1, "B", "evidence"), (1, "C", "signals"), (1, "C", "evidence-file"), (1, "C", "evidence-line"), (1, "C", "evidence-range"), (1, "D", "undecided"), (1, "E", "status"), (2, "A", "evidence-file")])


def test_project_facts(spark):
    from sievework.sources import readers

    a = "android { compileSdkVersion(33)\n buildTypes { } \n productFlavors {\n paid { }\n dimension { } }\n manifestPlaceholders['k'] = 1 }"
    b = "plugins { id 'com.android.library' }\nminSdk = 21\nproductFlavors { create('free') { } }"
    scripts = spark.createDataFrame([("app", "app/build.gradle", a), ("app", "app/build.gradle.kts", b), ("x", "x/build.gradle", a)], "module string, file string, text string")
    files = spark.createDataFrame([("app/src/main/A.kt",), ("app/src/paid/A.kt",), ("y/src/main/B.kt",)], "file string")
    got = {r["module"]: r for r in readers.project_facts(scripts, files, ["app", "lib"]).collect()}
    assert set(got) == {"app"} and got["app"]["flavors"] == ["free", "paid"] and got["app"]["source_sets"] == ["main", "paid"]
    assert got["app"]["min_sdk"] == 21 and got["app"]["compile_sdk"] is None and got["app"]["build_types"] == ["debug", "release"] and got["app"]["manifest_placeholder_keys"] == []


def test_callees_and_canonical_text(spark):
    from sievework.functions import scalar as S

    defs = spark.createDataFrame([("f", "A", "a.kt", 1), ("g", "A", "a.kt", 2)], "name string, owner string, file string, line int")
    assert [(r["line"], bool(r["hint"])) for r in J.callees(defs, "f").collect()] == [(1, True)]
    rows = spark.createDataFrame([('{"b": [1, {"d": null, "c": "ü"}], "a": 1.5}',), ("oops",), (None,), ("[2]",)], "j string")
    got = [(r["a"], r["b"]) for r in rows.select(S.canonical_text("j").alias("a"), S.canonical_text("j", ["a"]).alias("b")).collect()]
    assert got == [('{"a": 1.5, "b": [1, {"c": "ü", "d": null}]}', '{"a": 1.5}'), (None, '{"a": null}'), (None, '{"a": null}'), ("[2]", '{"a": null}')]
