"""Structural rules: patterns with holes, blocks around, released values; and text rules in one scan."""

import re

from sievework.functions import catalogue as C
from sievework.operators import review as V
from sievework.operators import structural as X

JAVA = """class A {
  static final Pattern P = Pattern.compile("a+");
  void x() { Pattern.compile("b"); } // Math.random()
  protected void onDraw(Canvas canvas) {
    Paint p = new Paint();
    for (int i = 0; i < 3; i++) {
      db.insert("t", null, v);
      view = inflater.inflate(R.layout.a, root);
    }
    db.update("t", v);
  }
  void q() {
    Cursor c = db.rawQuery(sql + name, null);
    Cursor d = db.query("t");
    try (Cursor e = db.query("u")) { e.moveToFirst(); }
    if (ok) { d.close(); }
    FileReader r = new FileReader(f);
    r.close();
  }
  void after() { c.close(); new Rect(); }
  public void onReceive(Context c, Intent i) { Thread.sleep(5); ctx.registerReceiver(null, f); ctx.registerReceiver(r, f); }
  void w() { Cipher.getInstance("DES/x"); Cipher.getInstance("AES/GCM"); Runtime.getRuntime().exec(cmd(a, b)); new Random(); new Random(7); }
  void y() { live.observe(this, o); live.observe(owner, o); synchronized ("lock") { } s.startForeground(1, n); s.startForeground(1); }
}"""
KOTLIN = """class B {
  override fun onDraw(c: Canvas) {
    val p = Paint(3)
    c.draw(p)
  }
  fun z() { GlobalScope.launch { run() } ; Paint(4) }
  override fun onBindViewHolder(holder: VH, position: Int) { holder.view.findViewById<T>(R.id.a); v.findViewById(R.id.b) }
}"""


def test_structural_rules(spark):
    files = spark.createDataFrame([("A.java", JAVA), ("B.kt", KOTLIN), ("C.txt", JAVA), ("D.java", None), ("E.java", "")], "file string, text string")
    got = sorted((r["file"], r["line"], r["rule_id"]) for r in X.structural_hits(files).collect())
    assert got == sorted([
        ("A.java", 3, "R-SG-050"), ("A.java", 5, "R-SG-048"), ("A.java", 7, "R-SG-054"), ("A.java", 8, "R-SG-052"),
        ("A.java", 13, "R-SG-011"), ("A.java", 13, "R-SG-021"), ("A.java", 17, "R-SG-045"),
        ("A.java", 21, "R-SG-055"), ("A.java", 21, "R-SG-017"), ("A.java", 22, "R-SG-002"), ("A.java", 22, "R-SG-012"), ("A.java", 22, "R-SG-009"),
        ("A.java", 23, "R-SG-044"), ("A.java", 23, "R-SG-034"), ("A.java", 23, "R-SG-042"),
        ("B.kt", 3, "R-SG-048"), ("B.kt", 4, "R-SG-048"), ("B.kt", 6, "R-SG-033"), ("B.kt", 7, "R-SG-049"),
    ])
    assert {r["severity"] for r in X.structural_hits(files).where("rule_id = 'R-SG-012'").collect()} == {"critical"}


def test_patterns():
    hit = lambda p, text: bool(re.search(X.pattern_regex(p), text))
    assert hit("$A.b($X, $Y)", "x().b(f(1, 2), c)") and not hit("$A.b($X, $Y)", "x.b(f(1, 2))") and not hit("$A.b($X)", "x.b(1, 2)")
    assert hit("new T(...)", "return new  T ( a, f(b(c)));") and not hit("new T()", "new T(1)") and not hit("new T()", "renew T()")
    assert hit("$A.b(...)", "a\n  .b (") is False and hit("$A.b(...)", "a\n.b(1)") and not hit("$A.b(...)", "b(1)")


def test_text_rules_in_one_scan(spark):
    rules = [{"rule_id": "R1", "pattern": r"a+b", "category": "x", "severity": "minor", "paths": ["**/*.kt"]}, {"rule_id": "R2", "pattern": r"b\nc", "category": "y", "severity": "major", "paths": ["**/*"]}]
    texts = {"d/x.kt": "aab ab\n\nzab\nc ab", "d/y.txt": "ab\nc\nb\nc", "d/z.kt": ""}
    got = sorted((r["file"], r["line"], r["rule_id"], r["snippet"]) for r in V.text_rule_hits(spark.createDataFrame(list(texts.items()), "file string, text string"), rules).collect())
    want = [(f, t[: m.start()].count("\n") + 1, r["rule_id"], m[0]) for f, t in texts.items() for r in rules if f.endswith(r["paths"][0][4:]) for m in re.finditer(r["pattern"], t)]
    assert got == sorted(want)
    assert len({r[0] for r in C.STRUCTURAL} | {r["rule_id"] for r in C.text_rules()}) > 50
