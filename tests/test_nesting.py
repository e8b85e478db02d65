"""Blocks and nested intervals against a stack."""

import random

from sievework.operators import nesting as X
from sievework.operators import windows as W


def stack(steps):
    """order -> (close, parent, level is left out) of each opening."""
    out, held = {}, []
    for at, step in steps:
        if step > 0:
            out[at] = [None, held[-1] if held else None]
            held.append(at)
        elif held:
            out[held.pop()][0] = at
    return {k: tuple(v) for k, v in out.items()}


def test_nest_equals_a_stack(spark):
    rng = random.Random(3)
    rows = [(f, k, rng.choice([1, 1, -1] if f % 3 else [1, -1, -1])) for f in range(40) for k in range(rng.randrange(30))]
    got = {}
    for r in X.nest(spark.createDataFrame(rows, "file int, at int, step int"), ["file"], "at").collect():
        got.setdefault(r["file"], {})[r["at"]] = (r["close"], r["parent"])
    want = {f: stack([(k, s) for g, k, s in rows if g == f]) for f in range(40)}
    assert got == {f: v for f, v in want.items() if v}


CODE = """package a;
// class Ghost {
public class Outer extends Base {
  private final String odd = "{ class Quoted {";
  char c = '{'; /* not here */
  void first(int x)
      throws IOException {
    if (x > 0) {
      call(x); Runnable r = new Runnable() {
        public void run() { inner(); }
      };
    } else { other(); }
    for (int i = 0; i < 3; i++) { loop(i); }
  }
  enum class Kind { A, B }
  static { setup(); }
  Outer(String s) { build(s); }
  fun <T> generic(a: List<T>): Map<T, T> = work(a) {
    lambda(it)
  }
}
after();""".split("\n")


def test_enclosing(spark):
    lines = spark.createDataFrame([("A", k + 1, x) for k, x in enumerate(CODE)] + [("B", 1, "}}} { x() }"), ("B", 2, "y()"), ("C", 1, "")], "file string, line int, text string")
    got = {(r["file"], r["line"]): (r["enclosing_type"], r["enclosing_symbol"]) for r in X.enclosing(lines.select("file", "line"), X.code_blocks(lines)).collect()}
    none = (None, None)
    assert [got["A", k] for k in (1, 2, 3, 4, 5)] == [none, none, ("Outer", None), ("Outer", None), ("Outer", None)]
    assert [got["A", k] for k in (7, 8, 9)] == [("Outer", "first")] * 3
    assert [got["A", k] for k in (10, 11, 12, 13)] == [("Outer", "run"), ("Outer", "first"), ("Outer", "first"), ("Outer", "first")]
    assert [got["A", k] for k in (15, 16, 17)] == [("Kind", None), ("Outer", None), ("Outer", "Outer")]
    assert got["A", 22] == none and got["B", 1] == got["B", 2] == got["C", 1] == none


def test_enclosing_type_by_lines(spark):
    rng = random.Random(5)
    parts = ["class T{} {{", "}}", "x();", "if (a) {{ b(); }}", "class One{} {{ }}", "{{", "class Late{}"]
    files = {f: [rng.choice(parts).format(k) if "{}" in (p := rng.choice(parts)) else p.format() for k in range(25)] for f in "abcdef"}
    declaration = r"\bclass\s+(\w+)"
    import re

    def plain(own, i):
        """The last declaration before a line whose braces are still open there, as they stand when the line begins."""
        if m := re.search(declaration, own[i]):
            return m[1]
        held, waiting, result = [], None, None
        for line in own[:i]:
            if m := re.search(declaration, line):
                waiting = m[1]
            for c in re.findall("[{}]", line):
                if c == "{":
                    held.append(waiting)
                    waiting = None
                elif held:
                    held.pop()
        return next((h for h in reversed(held) if h), result)

    rows = spark.createDataFrame([(f, k, x) for f, own in files.items() for k, x in enumerate(own)], "file string, line int, text string")
    got = {(r["file"], r["line"]): r["type"] for r in W.enclosing_type(rows, declaration).collect()}
    simple = {f: own for f, own in files.items()}
    wrong = {k: (got[k], plain(simple[k[0]], k[1])) for k in got if got[k] != plain(simple[k[0]], k[1])}
    assert not wrong
