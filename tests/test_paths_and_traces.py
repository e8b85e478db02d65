import fnmatch
import itertools
import json
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from sievework.operators import aggregates as A
from sievework.operators import filters as P
from sievework.operators import graph as G
from sievework.operators import joins as J
from sievework.operators import relations as N
from sievework.sources import readers as R
from sievework.sources import sinks as K


def test_globs_match_the_whole_path_or_its_last_parts(spark):
    paths = ["A.kt", "src/A.kt", "app/src/A.kt", "app/src/x/A.kt", "a/b/c", "x/a/c/b", "a.b/c[1].txt", "src/é.kt", "b", "src/a-b"]
    globs = ["src/*.kt", "*.kt", "A.kt", "a*b", "app/*", "app/**/A.kt", "*/A.??", "/src/A.kt", "c[[]1].txt", "[!a]", "src/[a-c]*", "./src/A.kt", "src//A.kt", "[^b]", "é.kt", "*"]
    files = spark.createDataFrame([(p,) for p in paths], "file string")
    for g in globs:
        got = {r["file"] for r in files.where(P.matches_any("file", [g])).collect()}
        assert got == {p for p in paths if fnmatch.fnmatchcase(p, g) or PurePosixPath(p).match(g)}, g


def test_test_sources(spark):
    files = spark.createDataFrame([(p,) for p in ("src/test/A.kt", "app/src/androidTest/B.kt", "app/src/main/test/C.kt", "mysrc/test/D.kt")], "file string")
    assert [r["file"] for r in files.where(~P.test_source("file")).collect()] == ["app/src/main/test/C.kt", "mysrc/test/D.kt"]


def test_report_paths_take_the_shortest_suffix_in_scope(spark):
    scope = spark.createDataFrame([("app/src/A.kt",), ("src/A.kt",), ("B.kt",)], "file string")
    got = J.report_paths(spark.createDataFrame([("/ci/app/src/A.kt",), ("C:\\ci\\app\\src\\A.kt",), ("xB.kt",), ("B.kt",), (None,)], "file string"), scope)
    assert [r["path"] for r in got.orderBy(F.col("file").asc_nulls_last()).collect()] == ["src/A.kt", "B.kt", "src/A.kt", "xB.kt", None]


TRACES = {
    "lists": ({"taint_source": ["CliLoc", [{"path": "a.kt", "start": {"line": 3}}, "src"]], "intermediate_vars": [{"location": {"path": "b.kt", "start": {"line": 4}}, "content": "v"}, {"location": {"path": "b.kt", "start": {"line": 4}}, "content": "v"}], "taint_sink": ["CliLoc", [{"path": "c.kt", "start": {"line": 9}}, "snk"]]}, [("a.kt", 3, "taint source"), ("b.kt", 4, "v"), ("c.kt", 9, "taint sink")]),
    "objects": ({"taint_sink": {"location": {"path": "z.kt", "start": {"line": 1}}, "content": {"text": " t "}}, "taint_source": {"deep": {"er": [{"path": "y.kt", "start": {"line": "7"}}]}}}, [("y.kt", 7, "taint source"), ("z.kt", 1, "t")]),
    "odd": ({"taint_source": [{"path": "", "start": {"line": 1}}, {"path": "p", "start": 5}, {"path": "q", "start": {"line": "x"}}, None, 3], "taint_sink": []}, []),
    "none": (None, []),
}


@pytest.mark.parametrize("shape", TRACES)
def test_traces_of_a_pattern_report_and_the_gate(spark, tmp_path, shape):
    trace, want = TRACES[shape]
    extra = {"message": "m", "severity": "ERROR", "lines": "x", "metadata": {"category": "security/x"}}
    if trace is not None:
        extra["dataflow_trace"] = trace
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"check_id": "r-sg-1", "path": "a.kt", "start": {"line": 3}, "end": {"line": 3}, "extra": extra}], "errors": []}))
    rows = R.pattern_report(spark, str(tmp_path))
    assert [tuple(h) for h in rows.first()["dataflow_path"]] == want
    out = P.gate(rows, F.lit(True), P.has_items("dataflow_path"), "origin missing").first()
    assert out["queue"] == ("confirmed" if want else "needs_review")


def test_language(spark):
    rows = spark.createDataFrame([("zh-CN", "en"), ("", "en_US"), ("fr", "zh"), (None, ""), (None, "ZH_tw")], "a string, b string")
    assert [r[0] for r in rows.select(R.language("a", "b")).collect()] == ["zh", "en", "en", "zh", "zh"]


def test_scope_stats_of_nothing(spark):
    files = spark.createDataFrame([], "file string, direct boolean, in_scope boolean, in_hunt boolean, in_context boolean, deleted boolean")
    got = A.scope_stats(files, files.select("file")).first()
    assert got["scope_files"] == 0 and got["should_hunt"] is False


def test_callers_of_names_with_signs(spark):
    refs = spark.createDataFrame([("f", "run$1", 1, "A$B.x.run$1(", "", "A$B.x", "", "")], "file string, name string, line int, snippet string, enclosing string, receiver string, enclosing_type string, enclosing_symbol string")
    types = spark.createDataFrame([], "file string, variable string, type string")
    assert N.callers(refs, "A$B.run$1", types).count() <= 1


def test_expand_and_frontier_equal_plain_search(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("e", "b"), ("f", "g"), ("d", "a"), ("h", "h")]
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    for depth, seeds in itertools.product(range(4), (["a"], ["e", "f"], ["none"])):
        want = dict.fromkeys(seeds, 0)
        for k in range(1, depth + 1):
            for y in {y for x in [x for x, n in want.items() if n == k - 1] for y in near.get(x, ())} - set(want):
                want[y] = k
        got = G.expand(spark.createDataFrame(edges * 2, "source string, target string"), spark.createDataFrame([(s,) for s in seeds * 2], "node string"), depth)
        assert {(r["node"], r["hops"]) for r in got.collect()} == set(want.items()) and got.count() == len(want)
    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("b", "c")], "callee string, caller string")
    got = G.frontier(calls, spark.createDataFrame([("c",)], "name string"), 3)
    assert {(r["name"], r["level"]) for r in got.collect()} == {("c", 0), ("b", 1), ("a", 2)}


def test_write_table_leaves_the_old_one_when_it_fails(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    K.write_table(spark.range(3), path)
    K.write_table(spark.range(5), path)
    with pytest.raises(Exception):
        K.write_table(spark.range(7).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 5
