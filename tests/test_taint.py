"""Taint by definitions and uses against a walk over the statements."""

import random
import re

from sievework.operators import filters as P
from sievework.operators import taint as T

CODE = """class A {
  void one(Intent i) {
    String u = i.getStringExtra("u"); // i.getDataString()
    String v = "x" + u;
    String w = clean(v);
    v = v.trim();
    web.loadUrl(v);
    web.loadUrl(w);
    u = "fixed";
    db.rawQuery(u, null);
    rt.exec(i.getDataString());
    web.loadUrl("u v");
  }
  void two() {
    web.loadUrl(u);
    String a = uri.getQueryParameter("q"); a += b; File f = new File(dir, a);
  }
}"""


def flows(spark, files, **k):
    df = spark.createDataFrame(files, "file string, text string")
    return sorted((r["file"], r["line"], r["rule_id"], [h["line"] for h in r["dataflow_path"]]) for r in T.taint_flows(df, **k).collect())


def test_flows(spark):
    files = [("A.java", CODE), ("x/test/A.java", CODE), ("E.kt", ""), ("N.kt", None)]
    got = flows(spark, files, sanitizers=["clean(...)"])
    assert got == [("A.java", 7, "R-SG-056", [3, 4, 6, 7]), ("A.java", 11, "R-SG-057", [11]), ("A.java", 16, "R-SG-059", [16, 16, 16])]
    assert ("A.java", 8, "R-SG-056", [3, 4, 5, 8]) in flows(spark, files[:1])
    gated = P.gate(T.taint_flows(spark.createDataFrame(files[:1], "file string, text string")), P.needs_origin("category"), P.has_items("dataflow_path"), "origin not traced")
    assert {r["queue"] for r in gated.collect()} == {"confirmed"}


def plain(lines):
    """Lines that a source reaches, by going through a method's statements in order."""
    held, out = {}, set()
    for n, x in enumerate(lines, 2):
        names = set(re.findall(r"\b[a-f]\b", x.split("=", 1)[-1]))
        hot = ".getDataString()" in x or any(held.get(v) for v in names)
        if x.startswith("web.loadUrl"):
            out |= {n} if hot else set()
        else:
            held[x[0]] = hot and "clean(" not in x
    return out


def test_flows_equal_a_walk(spark):
    rng = random.Random(12)
    kinds = ["{0} = i.getDataString()", "{0} = {1}", "{0} = {1} + {2}", "{0} = clean({1})", "{0} = \"{1}\"", "web.loadUrl({1})", "web.loadUrl({1} + {2})"]
    files = {}
    for k in range(25):
        body = [rng.choice(kinds).format(*rng.choices("abcdef", k=3)) for _ in range(rng.randrange(3, 25))]
        files[f"{k}.kt"] = body
    got = flows(spark, [(f, "fun go() {\n" + "\n".join(b) + "\n}") for f, b in files.items()], sanitizers=["clean(...)"])
    strip = lambda b: [re.sub('"[^"]*"', '""', x) for x in b]
    assert {(f, n) for f, n, rule, _ in got} == {(f, n) for f, b in files.items() for n in plain(strip(b))} and len(got) > 15
