"""XML elements against a parser, and a project's graph from raw files."""

import random
import xml.etree.ElementTree as ET

from sievework.operators import elements as X


def text_of(rng, depth=0):
    tag = rng.choice(["a", "b", "c.d", "x-y"])
    attributes = "".join(f' {k}={q}{rng.choice(["1", "<", ">", "/>", "é"])}{q}'.replace("<", "&lt;") for k in rng.sample(["name", "android:id", "t"], rng.randrange(3)) for q in [rng.choice("\"'")])
    kids = [text_of(rng, depth + 1) if rng.random() < 0.7 else rng.choice(["text", "<!-- <b> -->", "\n"]) for _ in range(rng.randrange(4 if depth < 4 else 1))]
    return f"<{tag}{attributes}/>" if not kids else f"<{tag}{attributes}>{''.join(kids)}</{tag}>"


def test_shred_equals_a_parser(spark):
    rng = random.Random(2)
    texts = [(k, "<?xml version='1.0'?>" + text_of(rng)) for k in range(40)]
    got = {}
    for r in X.shred(spark.createDataFrame([*texts, (99, None), (98, "no < tags > </b> here")], "file int, text string")).orderBy("file", "element").collect():
        got.setdefault(r["file"], []).append(r)
    assert set(got) == {k for k, _ in texts}
    for k, text in texts:
        parsed = [(e.tag, [*e.attrib.values()]) for e in ET.fromstring(text.replace("android:", "android_")).iter()]
        own = got[k]
        assert [(r["tag"], [a["value"].replace("&lt;", "<") for a in r["attributes"]]) for r in own] == parsed
        parent = {c: p for p in ET.fromstring(text.replace("android:", "android_")).iter() for c in p}
        assert [r["parent"] is None for r in own] == [i == 0 for i in range(len(own))] and all(r["close"] > r["element"] for r in own)
        at = {r["element"]: r for r in own}
        assert all(r["parent"] is None or at[r["parent"]]["element"] < r["element"] < r["close"] <= at[r["parent"]]["close"] for r in own)
        assert len(parent) == len(own) - 1
    df = X.shred(spark.createDataFrame(texts, "file int, text string"))
    marked = {(r["file"], r["element"]) for r in X.inside(df, df.where("tag = 'b'")).collect()}
    assert marked == {(r["file"], r["element"]) for own in got.values() for r in own if any(o["tag"] == "b" and o["element"] < r["element"] < o["close"] for o in own)}


FILES = {
    "app/build.gradle": "dependencies { implementation project(':lib:core') ; api project(path: \":gone\") }",
    "lib/core/build.gradle.kts": "",
    "app/src/main/AndroidManifest.xml": "<manifest package='p.app'><application android:name='.App'><activity android:name=\"p.app.ui.Main\"/></application></manifest>",
    "app/src/main/java/App.kt": "package p.app\nimport p.core.Store\nenum class Mode { A }\nclass App { val s: Store; val x = R.layout.main; val t = R.string.title }",
    "app/src/debug/java/App.kt": "package p.app\nclass App",
    "app/src/main/java/Main.java": "package p.app.ui;\nimport p.app.Mode;\npublic class Main { Mode m; Twin t; }",
    "lib/core/src/main/java/Store.kt": "package p.core\nclass Store\nclass Twin",
    "lib/core/src/main/java/Twin.kt": "package p.other\nclass Twin",
    "app/src/main/res/layout/main.xml": "<LinearLayout><p.core.Store android:id=\"@+id/box\"/><TextView android:text='@string/title'/></LinearLayout>",
    "app/src/debug/res/layout/main.xml": "<View/>",
    "app/src/main/res/values/strings.xml": "<resources><string name='title'>T</string><item type='id' name='other'/></resources>",
}


def test_graph_from_raw_files(spark):
    rows = [(f, len(t), t) for f, t in FILES.items()] + [("big.kt", 900_000, "class Big"), ("none.kt", 0, None)]
    nodes, edges = X.project_graph(spark.createDataFrame(rows, "file string, bytes long, text string"))
    state = {r["file"]: (r["analysis_state"], r["module"]) for r in nodes.collect()}
    assert state["big.kt"][0] == "oversized" and state["none.kt"][0] == "unreadable" and state["lib/core/build.gradle.kts"] == ("complete", "lib/core")
    got = {(r["kind"], r["source"].split("/", 1)[1].removeprefix("src/"), r["target"].split("/", 1)[1].removeprefix("src/")) for r in edges.collect()}
    manifest, app, main, layout = "main/AndroidManifest.xml", "main/java/App.kt", "main/java/Main.java", "main/res/layout/main.xml"
    store = "core/src/main/java/Store.kt"
    assert got == {
        ("gradle", "build.gradle", "core/build.gradle.kts"),
        ("component", manifest, app), ("component", manifest, main), ("component", layout, store),
        ("import", app, store), ("import", main, app), ("type", app, store), ("type", main, app),
        ("resource", app, layout), ("resource", app, "main/res/values/strings.xml"), ("resource", layout, "main/res/values/strings.xml"),
        ("overlay", "debug/java/App.kt", app), ("overlay", "debug/res/layout/main.xml", layout),
    }
