import hashlib

from pyspark.sql import functions as F

from sievework.functions import catalogue as C
from sievework.operators import aggregates as A
from sievework.operators import joins as J
from sievework.operators import navigation as V
from sievework.sources import readers as R
from sievework.sources import sinks as K

REF = "file string, line int, name string, receiver string, receiver_type string, snippet string, enclosing_type string, enclosing_symbol string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_backend():
    assert V.backend(None, {"treesitter"}) == ("treesitter", False)
    assert V.backend(" Source ", {"treesitter"}) == ("source", True)
    assert V.backend("odd", set()) == ("source", True)


def test_outgoing_calls(spark):
    refs = [
        ("a.kt", 1, "run", "Db", None, "Db.run()", "A", "m"),  # a receiver that names a type
        ("a.kt", 2, "run", "db", "Net", "db.run()", "A", "m"),  # an inferred type
        ("a.kt", 3, "save", "x", None, "x.save(Store)", "A", "n"),  # the one owner that the snippet names
        ("a.kt", 4, "save", "x", None, "x.save(Store, Cache)", "A", "two"),  # two owners named: none
        ("a.kt", 5, "go", "", None, "go()", "Base", "o"),  # in the owner itself
        ("a.kt", 6, "go", "x", None, "x.go()", "Base", "p"),  # a variable's type is unknown
        ("a.kt", 7, "twin", "Db", None, "Db.twin()", "A", "q"),  # two targets
        ("a.kt", 9, "run", "Db", None, "Db.run()", "A", "m"),  # a repeated call: the first line stays
        ("z.kt", 1, "run", "Db", None, "Db.run()", "A", "m"),  # not in the batch
        (None, None, None, None, None, None, None, None),
    ]
    methods = [("run", "Db", "Db.run", "d.kt", 4), ("run", "Net", "Net.run", "e.kt", 5), ("save", "Store", "Store.save", "s.kt", 6), ("save", "Cache", "Cache.save", "c.kt", 7), ("go", "Base", "Base.go", "b.kt", 8), ("twin", "Db", "Db.twin", "d.kt", 9), ("twin", "Db", "Db.twin", "d2.kt", 9), ("run", "Db", "Db.run", "a.kt", 1)]
    args = spark.createDataFrame(refs, REF), spark.createDataFrame(methods, "name string, owner string, fqn string, file string, line int"), spark.createDataFrame([("a.kt", 3)], "file string, risk int")
    got = rows(V.outgoing_calls(*args), "line", "enclosing_symbol", "fqn", "target_file")
    assert got == [(1, "m", "Db.run", "d.kt"), (2, "m", "Net.run", "e.kt"), (3, "n", "Store.save", "s.kt"), (5, "o", "Base.go", "b.kt")]
    assert V.outgoing_calls(args[0].limit(0), *args[1:]).count() == 0


def test_measure(spark):
    truth = spark.createDataFrame([("f", "a.kt", 1), ("f", "b.kt", 2)], "symbol string, file string, line int")
    got = spark.createDataFrame([("a.kt", 1), ("a.kt", 1), ("c.kt", 3)], "file string, line int")
    counts = V.measure({"source": lambda s: got, "none": lambda s: got.limit(0)}, truth, ["f"])
    assert rows(counts, "backend", "tp", "fp", "fn") == [("none", 0, 0, 2), ("source", 1, 1, 1)]
    scores = A.precision_recall(counts, ["backend"]).withColumn("seconds", F.lit(1.234))
    text = [r["text"] for r in K.benchmark_report(scores).collect()]
    assert text[2:] == ["| `none` | — | 0.0% | — | 0/0/2 | 1.23 |", "| `source` | 50.0% | 50.0% | 50.0% | 1/2/2 | 1.23 |"]


def test_modules_by_settings_or_scan(spark):
    make = lambda *f: spark.createDataFrame(f, "file string, text string")
    build = [("app/build.gradle", ""), ("lib/core/build.gradle.kts", ""), ("a/b/c/build.gradle", ""), ("buildSrc/build.gradle", ""), ("build/x/build.gradle", ""), ("build.gradle", "")]
    assert rows(R.project_modules(make(*build)), "module", "source") == [("app", "scan"), ("lib/core", "scan")]
    named = make(*build, ("settings.gradle", 'include ":app", ":gone"\n// include ":lib:core"\ninclude(\n  ":lib:core",\n)'))
    assert rows(R.project_modules(named), "module", "source") == [("app", "settings.gradle"), ("lib/core", "settings.gradle")]
    assert rows(R.project_modules(make(*build, ("settings.gradle", "// nothing"))), "source") == [("scan",), ("scan",)]


def test_report_rows_become_candidates(spark):
    found = [("detekt", "UnsafeCast", "A.kt", 3, "warning", "m"), ("detekt", "Other", "A.kt", 4, "error", "m"), ("lint", "Recycle", "A.kt", 5, "Ignore", "m"), ("lint", "New", "B.kt", 6, "Fatal", "m"), ("pmd", "X", "A.kt", 7, "critical", "m")]
    df = spark.createDataFrame(found, "engine string, native_rule_id string, file string, line int, severity string, message string")
    rules = spark.createDataFrame([(e, *r) for e, m in C.RULE_MAPS.items() for r in m], "engine string, native_rule_id string, rule_id string, category string, severity string")
    got = rows(R.report_candidates(df, rules), "line", "rule_id", "category", "severity")
    assert got == [(3, "R-DK-003", "stability/kotlin-not-null-assert", "major"), (4, "R-DK-000", "stability/general", "major"), (5, "R-LT-013", "stability/resource-leak-cursor", "major"), (6, "R-LT-New", "lint/new", "critical"), (7, "R-PMD-X", "stability/pmd-x", "critical")]
    kept = R.report_candidates(df, rules, spark.createDataFrame([("B.kt",)], "file string"))
    assert rows(kept, "line") == [(6,)] and kept.schema.simpleString() == spark.createDataFrame([], R.CANDIDATE).schema.simpleString()


def test_style_rules(spark):
    text = "build:\n  maxIssues: 0\n\nstyle:\n  active: true\n  # a remark\n  A:\n    active: true\n    other: 1\n  B:\n    active: false\n\nbugs:\n  C:\n    active: true\n"
    got = R.style_rules(spark.createDataFrame([(text,), (None,)], "text string"))
    assert rows(got, "rule_set", "rule", "active") == [("bugs", "C", True), ("style", "A", True), ("style", "B", False)]


def test_fingerprint_hashes_paths_and_bytes(spark):
    files = [("b/ü.md", "two\n"), ("a.md", ""), ("c", "é")]
    want = hashlib.sha256(b"".join(p.encode() + b"\0" + t.encode() + b"\0" for p, t in sorted(files))).hexdigest()
    assert A.fingerprint(spark.createDataFrame(files, "path string, content string"), "path", "content").first()[0] == want


def test_attested_coverage(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, None), (5, "a")], "batch int, perspective string")
    attested = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "a"), (3, 1, "b"), (3, 2, "b"), (4, 1, None), (4, 2, None), (9, 1, "a")], "batch int, sample int, perspective string")
    results = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (8, 1)], "batch int, sample int")
    got = rows(A.attested_coverage(expected, attested, results, 2), "batch", "samples", "results", "missing", "stray", "ok")
    assert got == [(1, 2, 2, "", False, True), (2, 2, 1, "", False, False), (3, 2, 2, "a", False, False), (4, 2, 2, "", False, True), (5, 0, 0, "a", False, False), (8, 0, 1, "", True, False), (9, 1, 0, "", True, False)]


def test_provenance_is_kept_as_a_set(spark):
    inputs = spark.createDataFrame([("x", ["p", "q"]), ("y", ["q"]), ("z", None)], "candidate_id string, provenance array<string>")
    records = spark.createDataFrame([(1, ["x", "y"], ["q", "p"]), (2, ["y"], ["q", "q"]), (3, ["y"], ["p"]), (4, [], ["q"]), (5, ["u"], ["q"]), (6, ["z"], None), (7, ["y", "y"], ["q"])], "record int, source_candidate_ids array<string>, provenance array<string>")
    got = rows(J.provenance_problems(records, inputs), "record", "problem")
    assert got == [(2, "provenance"), (3, "provenance"), (4, "no-source"), (4, "provenance"), (5, "provenance"), (5, "unknown-source"), (6, "no-provenance"), (7, "repeated-source")]


def test_review_report_in_both_languages(spark):
    items = spark.createDataFrame([("R-1", "t", "c", "minor", "B.kt", 2, None, ["x", "y"], "code"), (None, None, "c", "major", "A.kt", 1, "why", None, None)], "rule_id string, title string, category string, severity string, file string, line int, review_reason string, missing_evidence array<string>, evidence string")
    en = [r["text"] for r in K.review_report(items, "en").collect()]
    assert en[0].endswith("**Needs review:** 2\n") and en[1].startswith("## ? · \n\nLocation: `A.kt:1`\n\nReview reason: why\n\n---")
    assert "Missing evidence: x, y\n\nCurrent evidence:\n\n```kotlin\ncode\n```" in en[2] and "Review reason: Insufficient evidence" in en[2]
    assert "**待复核：** 0" in K.review_report(items.limit(0)).first()["text"]


def test_maps_and_audits(spark, tmp_path):
    one = lambda f, t: spark.createDataFrame([(f, t)], "file string, text string")
    r = K.map_receipt(one("m.md", "map"), one("b.json", "{}"), "source").first()
    assert (r["degraded"], r["map_sha256"], r["map_truncated"]) == (True, hashlib.sha256(b"map").hexdigest(), False)
    assert K.map_receipt(one("m.md", "截断"), one("b.json", "{}").limit(0), "treesitter").first()["batch_sha256"] is None
    assert K.degraded_map(one("A.kt", "")).first()["degraded"]
    K.write_audit(one("a", "b"), {"prior": one("c", "d")}, str(tmp_path), "r1")
    assert spark.read.json(K.run_path(str(tmp_path), "r1", "gap_audit_plan")).first()["file"] == "a"
