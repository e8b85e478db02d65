"""Reports as a data source, and captures as a table function."""

import json

from sievework.sources import readers as R
from sievework.sources import report_source as X


def test_one_broken_report_is_partial(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    one = {"results": [{"check_id": "a.r-sg-1", "path": "x.kt", "start": {"line": 1}, "extra": {"severity": "ERROR"}}]}
    for name, text in {"semgrep.json": json.dumps(one), "deep/semgrep-2.json": "{broken", "detekt.xml": "<checkstyle/>", "lint-results-debug.xml": "<issues>", "pmd.json": "[]", "other.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    rows = X.reports(spark, str(tmp_path))
    assert {(r["engine"], r["file"], r["status"]) for r in rows.collect()} == {("semgrep", "semgrep.json", "complete"), ("semgrep", "semgrep-2.json", "failed"), ("detekt", "detekt.xml", "complete"), ("lint", "lint-results-debug.xml", "failed"), ("pmd", "pmd.json", "failed")}
    assert {r["engine"]: (r["reports"], r["failed"], r["status"]) for r in X.engine_status(rows).collect()} == {"semgrep": (2, 1, "partial"), "detekt": (1, 0, "complete"), "lint": (1, 1, "failed"), "pmd": (1, 1, "failed")}
    kept = R.pattern_texts(rows.where("engine = 'semgrep' and status = 'complete'")).collect()
    assert [(r["rule_id"], r["severity"]) for r in kept] == [("R-SG-001", "critical")]


def test_filters_reach_the_listing(tmp_path):
    for name in ("semgrep.json", "pmd.json", "detekt.xml"):
        (tmp_path / name).write_text("{}")
    reader = X.ReportReader(str(tmp_path))
    rest = list(reader.pushFilters([X.EqualTo(("engine",), "pmd"), X.EqualTo(("status",), "failed"), X.In(("file",), ("pmd.json", "detekt.xml"))]))
    assert [f.attribute for f in rest] == [("status",)] and [p.path.rsplit("/", 1)[-1] for p in reader.partitions()] == ["pmd.json"]


def test_extract_in_sql(spark):
    X.register_extract(spark)
    spark.createDataFrame([("a", "class A {\n  fun go(x: B) = load(x)\n}"), ("b", "return new Foo(1)"), ("c", None)], "file string, text string").createOrReplaceTempView("texts")
    got = sorted(map(tuple, spark.sql("select file, kind, name, line from texts, lateral extract_tags(text)").collect()))
    assert got == [("a", "definition.method", "go", 2), ("a", "definition.type", "A", 1), ("a", "reference.call", "load", 2), ("b", "reference.call", "Foo", 1), ("b", "reference.new", "Foo", 1)]
