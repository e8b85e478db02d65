import hashlib
import json

from pyspark.sql import functions as F

from sievework.functions import scalar as S
from sievework.operators import aggregates as A
from sievework.operators import batching as B
from sievework.operators import filters as P
from sievework.operators import graph as G
from sievework.operators import joins as J
from sievework.operators import sets as X
from sievework.operators import windows as W
from sievework.sources import readers as R
from sievework.sources import sinks as K


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_identities(spark):
    sha = lambda *x, by: hashlib.sha1(by.join(x).encode()).hexdigest()
    row = spark.createDataFrame([("A\\b.kt ", " Foo  Bar\t", "Leaked_handle on  exit", 3, None)], "f string, s string, m string, l int, r string")
    got = row.select(S.finding_id("f", "l", F.lit("c"), "r"), S.root_cause_id("f", "s", "m"), S.identity("f", "l", F.lit("c"), "r", "f", "s", F.lit(" ")).alias("i"), S.identity("f", "l", F.lit("c"), "r", "f", "s", "m").alias("j")).first()
    assert got[0] == sha("A\\b.kt ", "3", "c", "", by=":")
    assert got[1] == sha("a/b.kt", "foo bar", "leaked-handle-on-exit", by="\0")
    assert (got["i"]["semantic"], got["i"]["key"]) == (False, "exact:" + got[0]) and got["j"]["key"] == "root:" + got[1]


def test_scalars(spark):
    text = lambda x: F.lit(x)
    assert one(spark, S.severity_rank(text("major")), S.severity_rank(text("odd")), S.severity_rank(F.lit(None))) == (1, 99, 99)
    assert one(spark, S.method_hint(text("a.B#run(x.y)")), S.class_hint(text("a.B#run(x)")), S.class_hint(text("run")), S.method_hint(text("a.B.run"))) == ("run", "B", "", None)
    assert one(spark, S.class_hint(text("Any#foo")), S.class_hint(text("a.unknown#x")), S.class_hint(text("a.b.C")), S.method_hint(text("Any#`go`(x#y)"))) == ("", "", "", "go")
    assert one(spark, S.receiver(text("  x?.load(1)"), text("load")), S.receiver(text("load(1)"), text("load"))) == ("x", "")
    assert one(spark, S.component_class(text(".Main"), text("a.b")), S.component_class(text("Main"), text("a.b")), S.component_class(text("c.Main"), text("a.b"))) == ("a.b.Main", "a.b.Main", "c.Main")
    assert one(spark, S.normal_path(text("./a\\b/../c")), S.normal_path(text("../x")), S.normal_path(text("/x")), S.normal_path(text("a/../../x"))) == ("a/c", None, None, None)
    assert one(spark, S.line_count(text("a\nb")), S.line_count(text("a\nb\n")), S.line_count(text("")), S.token_estimate(text("x" * 193))) == (2, 2, 0, 65)
    assert one(spark, S.percent(F.lit(0.125)), S.percent(F.lit(None).cast("double"))) == ("12.5%", "—")
    assert one(spark, S.strict_equal(text("true"), text("1")), S.strict_equal(text("[1, 2]"), text("[1,2]"))) == (False, True)
    assert one(spark, P.strict_integer(text('{"n": true}'), "$.n"), P.strict_integer(text('{"n": 3}'), "$.n"), P.strict_integer(text('{"n": 1.0}'), "$.n")) == (False, True, False)
    assert one(spark, S.bounded(text("abcdef"), 3), S.fence(text("A.KT")), S.short_commit(text("0123456789"))) == ("abc…", "kotlin", "01234567")
    assert one(spark, S.iso_time(F.lit("2024-01-01 20:00:00").cast("timestamp"))) == ("2024-01-02T04:00:00+08:00",)


def test_paths(spark):
    files = spark.createDataFrame([(f,) for f in ("app/src/A.kt", "lib/build/B.java", "app/R.java", "docs/x/C.kt", "a/b/test.c")], "file string")
    names = lambda df: sorted(r["file"] for r in df.collect())
    assert names(files.where(P.generated("file"))) == ["app/R.java", "lib/build/B.java"]
    assert names(files.where(P.matches_any("file", ["app/*.kt", "*.{c,h}"]))) == ["a/b/test.c", "app/src/A.kt"]
    assert names(files.where(P.excluded("file", ["docs"], ["R.java"], ["*.c"]))) == ["a/b/test.c", "app/R.java", "docs/x/C.kt"]
    assert names(P.user_filter(files, ["app", "lib"], "app")) == ["app/R.java", "app/src/A.kt"]
    assert {r["file"]: r["module"] for r in J.longest_prefix(files, ["app", "app/src", "lib"]).collect()}["app/src/A.kt"] == "app/src"


def test_gate_and_fields(spark):
    rows = spark.createDataFrame([("security/webview-x", None), ("security/webview-x", ["h"]), ("perf/other", None), ("a-data-flow", [])], "category string, dataflow_path array<string>")
    got = P.gate(rows, P.needs_origin("category"), P.has_items("dataflow_path"), "no origin")
    assert [r["queue"] for r in got.collect()] == ["needs_review", "confirmed", "confirmed", "needs_review"]
    problems = P.missing_fields(spark.createDataFrame([("a", " "), (None, "x")], "file string, rule_id string"), ("file", "rule_id"))
    assert sorted(r["field"] for r in problems.collect()) == ["file", "rule_id"]
    files = spark.createDataFrame([("a", 3)], "file string, line_count int")
    bad = spark.createDataFrame([("a", 1, None), ("a", 4, None), ("a", 2, 1), ("b", 1, None), ("a", 0, None)], "file string, line int, end_line int")
    assert sorted(r["problem"] for r in P.location_problems(bad, files).collect()) == ["end_line", "file", "line", "line"]


def test_merge_keeps_richest_and_worst(spark):
    rows = spark.createDataFrame([("k", 1, "minor", "aa", "f1", 1), ("k", 2, "critical", "a", "f2", 2), ("k", 3, "info", "aa", "f1", 1), ("z", 4, "odd", "", "f3", 9)], "key string, ordinal long, severity string, evidence string, file string, line int")
    got = {r["key"]: r for r in A.merge(rows, "key", A.richness("evidence"), "ordinal", ["file", "line"]).collect()}
    assert (got["k"]["ordinal"], got["k"]["severity"], got["k"]["merged_manifestations"]) == (1, "critical", 2)
    assert [x["file"] for x in got["k"]["related_locations"]] == ["f1", "f2"] and got["z"]["related_locations"] is None and got["z"]["severity"] == "odd"
    best = A.dedupe_richest(rows, ["key"], A.richness("evidence"), "ordinal").orderBy("first_seen").collect()
    assert [(r["key"], r["ordinal"]) for r in best] == [("k", 1), ("z", 4)]


def test_interval_cover(spark):
    rows = [("exact", 1, 5, 5), ("overlap", 1, 3, 5), ("overlap", 2, 5, 5), ("gap", 1, 2, 5), ("gap", 4, 5, 5), ("beyond", 1, 6, 5), ("short", 1, 4, 5), ("empty", None, None, 0), ("ghost", 1, 1, 0), ("zero", 0, 5, 5)]
    got = {r["f"]: r["covered"] for r in W.ranges_cover(spark.createDataFrame(rows, "f string, s int, e int, n int"), ["f"], "s", "e", "n").collect()}
    assert got == {"exact": True, "overlap": True, "gap": False, "beyond": False, "short": False, "empty": True, "ghost": False, "zero": False}


def test_windows(spark):
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(["class A {", " fun x() {", " }", " class B {", "  y()", " }", " z()", "}", "w()"])], "file string, line int, text string")
    got = {r["line"]: r["type"] for r in W.enclosing_type(lines, r"\bclass\s+(\w+)").collect()}
    assert (got[3], got[5], got[7], got[9]) == ("A", "B", "A", None)
    rows = spark.createDataFrame([(1, 40), (2, 50), (3, 30), (4, 1)], "id int, cost int")
    kept = W.budget_prefix(rows.withColumn("g", F.lit(1)), ["g"], ["id"], "cost", 100)
    assert [r["id"] for r in kept.orderBy("id").collect()] == [1, 2]
    many = spark.range(30).select(F.lit("m").alias("k"), F.col("id"))
    got = W.fan_out(many, ["k"], ["id"]).orderBy("position").collect()
    assert len(got) == 26 and got[-1]["truncated"] == 5 and got[-1]["id"] is None


def test_set_checks(spark):
    df = lambda rows, schema="k int, v string": spark.createDataFrame(rows, schema)
    got = {(r["k"], r["problem"]) for r in J.compare_sets(df([(1, ""), (2, "")]), df([(2, ""), (2, ""), (3, "")]), ["k"]).collect()}
    assert got == {(1, "missing"), (2, "duplicate"), (3, "extra")}
    got = {(r["k"], r["field"]) for r in J.compare_values(df([(1, "a"), (2, None), (4, "x")]), df([(1, "b"), (2, None), (3, "c")]), ["k"], ["v"]).collect()}
    assert got == {(1, "v"), (3, "extra"), (4, "missing")}
    got = {(r["k"], r["problem"]) for r in J.partition_problems(df([(1, ""), (2, ""), (3, "")]), df([(2, ""), (3, ""), (3, ""), (9, "")]), "k").collect()}
    assert got == {(1, "missing"), (3, "repeated"), (9, "unknown")}
    assert X.union_all([df([(1, "a")]), spark.createDataFrame([(2,)], "k int")]).count() == 2
    status = df([(1, "complete"), (1, "skipped"), (2, "complete"), (3, "failed"), (4, "weird"), (5, None)])
    assert {r["k"]: r["overall"] for r in A.overall_status(status.withColumnRenamed("v", "status"), ["k"]).collect()} == {1: "complete_with_skips", 2: "complete", 3: "incomplete", 4: "incomplete", 5: "complete"}
    cases = A.case_status(df([(1, "no_signal"), (1, "candidate"), (2, "mitigated")]).withColumnRenamed("v", "status"), df([(1, ""), (2, ""), (3, "")]), ["k"], ["no_signal", "mitigated"])
    assert {(r["k"], r["negative"], r["disagreement"]) for r in cases.collect()} == {(1, False, True), (2, True, False), (3, True, False)}


def test_edges(spark):
    raw = spark.createDataFrame([("a", "b", "import", 5, "e" * 250 + str(i % 2), i) for i in range(6)] + [("a", "b", "import", 5, f"x{i}", 10 + i) for i in range(6)], "source string, target string, kind string, weight int, evidence string, ordinal int")
    got = A.edges(raw, "ordinal").collect()
    assert len(got) == 1 and got[0]["evidence"] == ["e" * 240, "x0", "x1", "x2"]
    members = spark.createDataFrame([(1, "a"), (2, "b")], "batch int, node string")
    assert {(r["batch"], r["part"]) for r in J.edge_split(raw.select("source", "target").distinct(), members).collect()} == {(1, "boundary"), (2, "boundary")}


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 2), ("x", "y", 1)], "source string, target string, weight int")
    got = {r["node"]: r["hops"] for r in G.expand(e, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    calls = spark.createDataFrame([("t", "m", "high"), ("m", "t", "high"), ("m", "n", "nominal"), ("n", "o", "ambiguous"), ("o", "p", "high")], "callee string, caller string, confidence string")
    got = {(",".join(r["path"]), r["terminal"]) for r in G.trace(spark, calls, spark.createDataFrame([("t",)], "symbol string")).collect()}
    assert got == {("t,m,n,o", "ambiguous")}
    got = {(",".join(r["path"]), r["terminal"]) for r in G.trace(spark, calls.where("caller in ('m', 't')"), spark.createDataFrame([("t",)], "symbol string")).collect()}
    assert got == {("t,m", "cycle")}
    ranks = {r["node"]: r["rank"] for r in G.pagerank(spark.createDataFrame([(n,) for n in "abcd"], "node string"), e.where("source <> 'x'"), iterations=6, every=3).collect()}
    want = dict.fromkeys("abcd", 0.25)
    for _ in range(6):
        want = {n: 0.0375 + 0.85 * (want["d"] / 4 + {"a": 0, "b": want["a"], "c": want["b"], "d": want["c"]}[n]) for n in want}
    assert all(abs(ranks[n] - want[n]) < 1e-12 for n in want)


def test_clusters(spark):
    def run(items, edges, size, tokens):
        i = spark.createDataFrame(items, "node string, risk int, tokens long")
        e = spark.createDataFrame(edges, "source string, target string, weight int")
        out = {}
        for r in G.cluster(i, e, size, tokens).orderBy("batch", "position").collect():
            out.setdefault(r["batch"], []).append(r["node"])
        return list(out.values())

    # related items come first, and if none of them fits the batch closes though others would fit
    assert run([("a", 5, 10), ("b", 1, 10), ("c", 3, 10)], [("a", "b", 2)], 2, 100) == [["a", "b"], ["c"]]
    assert run([("a", 5, 60), ("b", 1, 60), ("c", 3, 10)], [("a", "b", 2)], 3, 100) == [["a"], ["c", "b"]]
    assert run([("a", 5, 60), ("b", 1, 60), ("c", 3, 10)], [("x", "y", 1)], 3, 100) == [["a", "c"], ["b"]]
    assert run([("a", 5, 900), ("b", 1, 1)], [("x", "y", 1)], 3, 100) == [["a"], ["b"]]


def test_next_fit(spark):
    units = spark.createDataFrame([("g", i, n, t) for i, (n, t) in enumerate([(2, 10), (2, 10), (1, 90), (1, 200), (1, 1), (3, 1), (2, 1)])], "g string, ordinal int, n int, t int")
    got = [r["batch"] for r in B.next_fit(units, ["g"], ["ordinal"], "n", "t", 4, 100).orderBy("ordinal").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 4]


def test_readers(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\n\n a\\b.kt \nc.kt\na/b.kt\n../x\n/abs\n")
    known = spark.createDataFrame([("a/b.kt",)], "file string")
    good, bad = R.scope_list(spark, str(tmp_path / "list.txt"), known)
    assert [r["file"] for r in good.orderBy("ordinal").collect()] == ["a/b.kt", "c.kt"]
    assert {(r["file"], r["problem"]) for r in bad.collect()} == {("../x", "outside"), ("/abs", "outside"), ("c.kt", "missing")}
    (tmp_path / "diff.txt").write_text("M\ta\nR90\tb\tc\nC50\ta\td\nD\te\nA\tb\n")
    assert {r["file"]: r["deleted"] for r in R.name_status(spark, str(tmp_path / "diff.txt")).collect()} == {"a": False, "b": True, "c": False, "d": False, "e": True}
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"check_id": "x.r-sg-7", "path": "./a/b.kt", "start": {"line": 3}, "end": {"line": 4}, "extra": {"message": "m", "severity": "ERROR", "lines": "y" * 400, "metadata": {"rule_id": " "}}}], "errors": []}))
    r = R.read_engine(spark, "semgrep", str(tmp_path / "p.json")).first()
    assert (r["rule_id"], r["file"], r["line"], r["severity"], len(r["snippet"])) == ("R-SG-007", "a/b.kt", 3, "critical", 300)
    (tmp_path / "c.xml").write_text('<checkstyle><file name="a/b.kt"><error line="2" source="detekt.LongMethod" message="m" severity="warning"/><error line="5" source="detekt.X" message="n" severity="info"/></file></checkstyle>')
    assert [(r["native_rule_id"], r["line"]) for r in R.style_report(spark, str(tmp_path / "c.xml")).orderBy("line").collect()] == [("LongMethod", 2), ("X", 5)]
    (tmp_path / "l.xml").write_text('<issues><issue id="A" severity="Error" message="m"><location file="x.kt" line="1"/><location file="y.kt" line="2"/></issue><issue id="B" severity="Ignore" message="m"><location file="z.kt" line="3"/></issue></issues>')
    assert {r["file"] for r in R.issue_report(spark, str(tmp_path / "l.xml")).collect()} == {"x.kt", "y.kt"}
    assert R.issue_report(spark, str(tmp_path / "l.xml"), ["B"]).count() == 3
    (tmp_path / "v.json").write_text(json.dumps({"files": [{"filename": "a.java", "violations": [{"rule": "R", "ruleset": "s", "beginline": 1, "endline": 2, "priority": 2, "description": "d"}]}]}))
    assert R.violation_report(spark, str(tmp_path / "v.json")).first()["severity"] == "major"
    for name, content in (("c1.json", [{"file": "a", "line": 1}, 5]), ("c2.json", {"candidates": [{"file": "b"}]}), ("c3.json", 7)):
        (tmp_path / name).write_text(json.dumps(content))
    good, bad = R.candidates(spark, str(tmp_path / "c[123].json"))
    assert sorted(r["file"] for r in good.collect()) == ["a", "b"] and sorted(r["problem"] for r in bad.collect()) == ["element", "envelope"]
    assert R.config(spark, "[]")[1] and R.config(spark, None) == ({}, None) and R.select_engines("pmd, pmd,lint") == ["pmd", "lint"]


def test_text_sources(spark):
    assert one(spark, R.modules(F.lit('include(":app", ":lib:core")\n// x\ninclude \':app\''))) == (["app", "lib/core"],)
    assert one(spark, R.block(F.lit("x { a { b } c } tail"), "x"), R.block(F.lit("y { open"), "y"), R.block(F.lit("none"), "z")) == (" a { b } c ", None, None)
    files = spark.createDataFrame([("app/src/main/A.kt",), ("app/src/debug/B.kt",), ("src/main/C.kt",)], "file string")
    assert {r["module"]: r["source_sets"] for r in R.source_sets(files).collect()} == {"app": ["debug", "main"], "": ["main"]}
    got = R.inspect(spark.createDataFrame([("A.kt", "package a.b\nimport c.D\nclass A { val d: D }\n")], "file string, text string")).first()
    assert (got["package"], got["imports"], got["symbols"]) == ("a.b", ["c.D"], ["A"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("minor", "c", "f", 2, "t", "e"), ("critical", "c", "f", 9, "t", "e"), ("odd", "c", "f", 1, "t", "e")], "severity string, category string, file string, line int, title string, evidence string")
    text = [r["text"] for r in K.markdown(rows, "Findings").collect()]
    assert text[0].startswith("# Findings\n\n3 findings: 1 critical, 0 major, 1 minor") and len(text) == 3 and text[1].startswith("## [critical]")
    K.write_list(spark.createDataFrame([("b",), ("a",), ("b",)], "file string"), f"{tmp_path}/list")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/list").collect()] == ["a", "b"]
    run = K.manifest(spark, {"engine": "x"}).first()
    assert len(run["run_id"]) == 36 and run["schema_version"] == 1


def test_shipping_variants_keeps_every_build_type(spark):
    flavors = spark.createDataFrame([("free",)], "flavor string")
    types = spark.range(10_001).selectExpr("concat('t', id) as build_type")
    assert P.shipping_variants(flavors, types).select("variant").distinct().count() == 10_001
