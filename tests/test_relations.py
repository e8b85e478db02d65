from sievework.operators import relations as R
from sievework.sources import readers

NODE = "file string, module string, source_set string, package string, symbols array<string>, imports array<string>, identifiers array<string>, tail string"


def test_graph_edges(spark):
    nodes = spark.createDataFrame([
        ("app/src/main/A.kt", "app", "main", "p", ["A"], ["q.B", "q.*"], ["A", "B", "Twin", "Lone"], "A.kt"),
        ("app/src/debug/A.kt", "app", "debug", "p", ["A"], [], [], "A.kt"),
        ("lib/src/main/B.kt", "lib", "main", "q", ["B", "Twin"], [], [], "B.kt"),
        ("app/src/main/T.kt", "app", "main", "p", ["Twin"], [], [], "T.kt"),
        ("lib/src/main/L.kt", "lib", "main", "z", ["Lone"], [], [], "L.kt"),
    ], NODE)
    pairs = lambda df: {(r["source"], r["target"]) for r in df.collect()}
    assert pairs(R.import_edges(nodes)) == {("app/src/main/A.kt", "lib/src/main/B.kt")}
    assert pairs(R.type_edges(nodes)) >= {("app/src/main/A.kt", "app/src/main/T.kt"), ("app/src/main/A.kt", "lib/src/main/L.kt"), ("app/src/main/A.kt", "lib/src/main/B.kt")}
    assert pairs(R.overlay_edges(nodes)) == {("app/src/debug/A.kt", "app/src/main/A.kt")}
    comp = spark.createDataFrame([("m.xml", "q", ".B"), ("m.xml", "p", ".A"), ("m.xml", "other", ".Lone")], "file string, package string, value string")
    assert pairs(R.component_edges(comp, nodes)) == {("m.xml", "lib/src/main/B.kt"), ("m.xml", "lib/src/main/L.kt")}
    refs = spark.createDataFrame([("app/A", "app", "main", "layout/x")], "file string, module string, source_set string, key string")
    defs = spark.createDataFrame([("app/main/x", "app", "main", "layout/x"), ("app/debug/x", "app", "debug", "layout/x"), ("root/x", "", "main", "layout/x")], "file string, module string, source_set string, key string")
    assert pairs(R.resource_edges(refs, defs)) == {("app/A", "app/main/x")}
    dep = spark.createDataFrame([("app/build.gradle", "lib")], "file string, module string")
    scripts = spark.createDataFrame([("lib/build.gradle", "lib")], "file string, module string")
    g = R.graph([R.import_edges(nodes), R.overlay_edges(nodes), R.build_edges(dep, scripts)]).collect()
    assert {(r["kind"], r["weight"]) for r in g} == {("import", 5), ("overlay", 6), ("gradle", 5)}


def test_navigation(spark):
    text = "class Own {\n  fun run(a: Int) {\n    val h: Helper = make()\n    h.load(1)\n    load(2)\n  }\n}\n// h.load(3)\n"
    files = spark.createDataFrame([("a.kt", len(text), bytearray(text.encode()))], "file string, bytes long, content binary")
    lines = readers.source_lines(files)
    defs, refs = R.index(lines)
    assert {(r["name"], r["kind"]) for r in defs.collect()} >= {("Own", "type"), ("run", "method")}
    from pyspark.sql import functions as F

    refs = refs.withColumn("enclosing_type", F.lit("Own"))
    types = R.receiver_types(lines)
    assert {r["variable"]: r["type"] for r in types.collect()}["h"] == "Helper"
    got = [(r["line"], r["confidence"], r["matched_by"]) for r in R.callers(refs, "x.Helper#load(int)", types).collect()]
    assert got == [(4, "high", "inferred-receiver-type"), (5, "ambiguous", "method-name-only")]
    assert {r["confidence"] for r in R.callers(refs, "load", types).collect()} == {"nominal"}
    cands = spark.createDataFrame([("a.kt", 3, 4), ("a.kt", 1, None), ("a.kt", 99, None)], "file string, line int, end_line int")
    assert {r["line"]: r["snippet"] for r in R.snippets(cands, lines).collect()} == {3: "    val h: Helper = make()\n    h.load(1)", 1: "class Own {", 99: None}


def test_changes(spark):
    f = lambda *x: spark.createDataFrame([(v,) for v in x], "file string")
    assert {r["file"]: r["deleted"] for r in R.changes(f("a", "b"), f("c"), f("a", "c")).collect()} == {"a": False, "b": True, "c": False}
