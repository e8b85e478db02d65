"""Reports in their odder shapes, declarations of every kind, and what a change reaches."""

import json

from sievework.functions import scalar as S
from sievework.operators import relations as N
from sievework.operators import review as V
from sievework.sources import readers as R


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_pattern_report(spark, tmp_path):
    one = lambda path, start, end=None, **extra: {"check_id": "c", "path": path, "start": start} | ({"end": end} if end else {}) | {"extra": extra}
    results = [one("/work/app/a.kt", {"line": 2}, {"line": 3}, severity="INVENTORY", lines="requires login"), one("/other/b.kt", {"line": 1}, {"line": 1}, severity="NEW", lines=" x "), one("app\\c.kt", {}, lines=""), one("./app/c.kt", {"line": 9}, severity="error")]
    (tmp_path / "r.json").write_text(json.dumps({"results": results}))
    lines = spark.createDataFrame([("app/a.kt", k, f"  line {k}  ") for k in range(1, 5)], "file string, line int, text string")
    got = rows(R.pattern_report(spark, str(tmp_path / "r.json"), "/work", lines), "file", "line", "end_line", "severity", "snippet")
    assert got == [("/other/b.kt", 1, None, "info", "x"), ("app/a.kt", 2, 3, "info", "line 2  \n  line 3"), ("app/c.kt", 0, None, "minor", ""), ("app/c.kt", 9, None, "info", "")]


def test_issue_report(spark, tmp_path):
    (tmp_path / "lint-results-debug.xml").write_text('<issues><issue id="A" message="m"><location file="/work/x.kt"/></issue><issue id="B" severity="Ignore" message="m"><location file="y.kt" line="2"/></issue></issues>')
    (tmp_path / "other.xml").write_text('<issues><issue id="C" severity="Error" message="m"><location file="z.kt" line="1"/></issue></issues>')
    assert rows(R.issue_report(spark, str(tmp_path), root="/work"), "native_rule_id", "file", "line", "severity") == [("A", "x.kt", 0, "Warning")]
    assert rows(R.issue_report(spark, str(tmp_path), ["B"]), "native_rule_id") == [("A",), ("B",)]


def test_violation_and_style_reports(spark, tmp_path):
    own = [{"rule": "R", "ruleset": "s", "beginline": 5, "endline": 5 + (k == 2), "description": f" {'d' * 400}"} | ({"priority": k} if k else {}) for k in (1, 2, 3, 5, 9, 0)]
    (tmp_path / "v.json").write_text(json.dumps({"files": [{"filename": "/work/a/b.java", "violations": own}]}))
    df = R.violation_report(spark, str(tmp_path / "v.json"), "/work")
    assert rows(df, "severity", "end_line", "file") == sorted([("major", None, "a/b.java"), ("major", 6, "a/b.java"), ("minor", None, "a/b.java"), ("info", None, "a/b.java"), ("info", None, "a/b.java"), ("minor", None, "a/b.java")], key=repr)
    assert {len(r["message"]) for r in df.collect()} == {300}
    (tmp_path / "c.xml").write_text('<checkstyle><file name="/work/a.kt"><error line="2" source="detekt.X" message="m" severity="info"/></file></checkstyle>')
    assert rows(R.style_report(spark, str(tmp_path / "c.xml"), root="/work/"), "file", "native_rule_id") == [("a.kt", "X")]


def test_declarations(spark):
    text = "package a.b\nenum class Color { RED }\ndata class P(val c: Color)\nrecord Foo(int x)\nenum Old { A }\nsealed interface S\nannotation class Ann"
    node = R.inspect(spark.createDataFrame([("a.kt", text)], "file string, text string")).first()
    assert node["symbols"] == ["Ann", "Color", "Foo", "Old", "P", "S"] and node["package"] == "a.b"
    code = ["public interface Api {", "  void load(int id);", "  <T> List<T> all(Class<T> c) throws IOException;", "}", "enum class Kind {", "  fun go() {", "    api.load(3);", "    return make(1);", "  }", "}", "// class Not {"]
    defs, refs = N.index(spark.createDataFrame([("a.kt", k + 1, x) for k, x in enumerate(code)], "file string, line int, text string"))
    assert rows(defs, "kind", "name", "line") == [("method", "all", 3), ("method", "go", 6), ("method", "load", 2), ("type", "Api", 1), ("type", "Kind", 5)]
    assert rows(refs, "name", "line", "receiver", "enclosing_type", "enclosing_symbol") == [("load", 7, "api", "Kind", "go"), ("make", 8, "", "Kind", "go")]


def test_receiver_types(spark):
    code = ["fun f(db: Map, x: Any) {", "val db: com.a.Db = open()", "Store db = null;", "val net = Net(3)", "val net: Other", "call(Foo a, Bar b)", "this.z = Zed("]
    got = N.receiver_types(spark.createDataFrame([("a", k, x) for k, x in enumerate(code)], "file string, line int, text string"))
    assert rows(got, "variable", "type") == [("a", "Foo"), ("b", "Bar"), ("db", "Store"), ("net", "Other")]


def test_what_a_change_reaches(spark):
    files = spark.createDataFrame([("app/A.kt", ""), ("app/B.kt", ""), ("lib/C.kt", ""), ("AndroidManifest.xml", ""), ("build.gradle", "")], "file string, text string")
    none = lambda s: spark.createDataFrame([], s)
    run = lambda *ch: {r["file"] for r in V.impact_slice(files, spark.createDataFrame(list(ch), "file string, deleted boolean"), none("source string, target string, weight int"), none("name string, file string"), none("caller_file string, caller string, name string"), ["app", "lib"], 0).collect()}
    assert run(("AndroidManifest.xml", False)) == {"AndroidManifest.xml"}
    assert run(("build.gradle", False)) == {r["file"] for r in files.collect()}
    assert run(("lib/AndroidManifest.xml", False)) == {"lib/C.kt"}
    assert len(run(("gone.kt", True))) == 5
    assert len(run(("gradle.properties", True))) == 5


def test_paths(spark):
    got = spark.range(1).select(*(R.in_project(S.F.lit(p), "/a.b/c") for p in ("/a.b/c/d.kt", "/axb/c/d.kt", "\\a.b\\c\\d.kt", "../x"))).first()
    assert tuple(got) == ("d.kt", "/axb/c/d.kt", "d.kt", "../x")
