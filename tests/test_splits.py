"""Windows over byte ranges against a scan of whole texts."""

import random
import re

import pytest

from sievework.operators import review as V
from sievework.operators import windows as W
from sievework.sources.splits import boundary, text_windows

PATTERNS = {"bang": "!!", "word": r"\bkey\b", "pair": r"é[ab]+ü", "none": "qqq"}


def write(folder, name, text):
    (folder / name).write_bytes(text.encode() if isinstance(text, str) else text)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Texts whose matches lie on every edge, of one to four bytes a character."""
    folder, rng = tmp_path_factory.mktemp("texts"), random.Random(7)
    parts = ["!!", " key ", "xkey", "key\n", "éabü", "éaaaabbü", "漢字", "😀", "\n", "ab", "é", "! !", "$1 \\ "]
    texts = {f"t{k}.kt": "".join(rng.choice(parts) for _ in range(rng.randrange(1, 400))) for k in range(12)} | {"empty.kt": "", "one.kt": "é", "break.kt": "\n", "mark.kt": "a\x01!!\x01 key"}
    for n, x in texts.items():
        write(folder, n, x)
    write(folder, "_skipped", "!!")
    return folder, texts


@pytest.mark.parametrize("window,overlap,partition", [(4, 64, 64), (7, 40, 7), (64, 48, 200), (1 << 20, 16384, 1 << 27)])
def test_windows_make_up_the_file(spark, files, window, overlap, partition):
    folder, texts = files
    rows = text_windows(spark, str(folder), window=window, overlap=overlap, partition=partition)
    assert rows.rdd.getNumPartitions() > (20 if partition < 100 else 0)
    own = {}
    for r in rows.collect():
        assert len(r["text"].encode()) <= window + 2 * overlap + 8
        own.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["start"], r["text"][r["lead"] : r["lead"] + r["chars"]]))
    assert set(own) == set(texts)
    for n, x in texts.items():
        got = sorted(own[n])
        assert "".join(t for _, t in got) == x
        assert all(a + len(t.encode()) == b for (a, t), (b, _) in zip(got, got[1:])), n


@pytest.mark.parametrize("window,overlap", [(5, 64), (33, 64), (1 << 20, 16384)])
def test_matches_at_edges_count_once(spark, files, window, overlap):
    folder, texts = files
    got = W.match_counts(text_windows(spark, "file://" + str(folder), window=window, overlap=overlap), PATTERNS).collect()
    want = {n: (len(x), x.count("\n"), {k: c for k, p in PATTERNS.items() if (c := len(re.findall(p, x)))}) for n, x in texts.items()}
    assert {r["file"].rsplit("/", 1)[-1]: (r["chars"], r["breaks"], r["matches"]) for r in got} == want


def test_analysis_of_windows_equals_that_of_texts(spark, tmp_path):
    """With the catalogue's own signals and markers, and a file with more lines than the bound."""
    code = {"A.kt": "class A : WebView() {\n  fun f() { loadUrl(x); Class.forName(n)\n}\n" + "x\n" * 700, "B.kt": "val q = db.rawQuery(\"a\" + b)", "C.kt": "", "build/D.kt": "loadUrl"}
    (tmp_path / "build").mkdir()
    for n, x in code.items():
        write(tmp_path, n, x)
    short = lambda df: {r["file"].rsplit("/", 1)[-1]: tuple(r[c] for c in ("risk_score", "tech", "estimated_tokens", "line_count")) for r in df.collect()}
    whole = V.analyse(spark.createDataFrame([(str(tmp_path / n), x) for n, x in code.items()], "file string, text string"))
    got = short(V.analyse_windows(text_windows(spark, str(tmp_path), window=50, overlap=256)))
    assert got == short(whole) and set(got) == {"A.kt", "B.kt", "C.kt"} and got["A.kt"][0] > 1


def test_bytes_that_are_no_text(spark, tmp_path):
    """Runs of further bytes are cut where the range says; nothing is lost and nothing fails."""
    assert boundary(b"\x80\x80\x80\x80a", 0) == 0 and boundary("aé".encode(), 2) == 3
    write(tmp_path, "x.kt", b"\x80" * 50 + b"a" * 10 + b"\xe6\xbc")
    rows = text_windows(spark, str(tmp_path), window=9, overlap=0).collect()
    assert sum(r["text"].count("a") for r in rows) == 10 and all(r["lead"] == 0 for r in rows)
    with pytest.raises(Exception, match="4 bytes"):
        text_windows(spark, str(tmp_path), window=1).collect()
    with pytest.raises(Exception):
        text_windows(spark, str(tmp_path / "absent")).collect()
