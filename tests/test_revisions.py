"""Files at a revision against the version control's own answers."""

import os
import random
import subprocess

import pytest

from sievework.operators import review as V
from sievework.sources import readers as R
from sievework.sources import revisions as X


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    top = tmp_path_factory.mktemp("store")
    env = os.environ | {k: "t@example.org" for k in ("GIT_AUTHOR_NAME", "GIT_AUTHOR_EMAIL", "GIT_COMMITTER_NAME", "GIT_COMMITTER_EMAIL")}
    git = lambda *a: subprocess.run(["git", "-C", str(top), *a], check=True, capture_output=True, env=env).stdout
    git("init", "-q", "-b", "main")
    rng = random.Random(3)
    lines = [f"line {rng.random()}" for _ in range(3000)]
    for k in range(6):
        lines[rng.randrange(3000)] = f"edit {k}"
        (top / "src/deep").mkdir(parents=True, exist_ok=True)
        (top / "src/deep/big.txt").write_text("\n".join(lines))
        (top / f"src/F{k}.kt").write_text(f"package p\nclass Gone{k}\nclass Other{k}")
        (top / "empty").write_bytes(b"")
        (top / "é.bin").write_bytes(bytes(range(256)) * (k + 1))
        git("add", "-A")
        git("commit", "-q", "-m", str(k))
    git("tag", "-a", "v1", "-m", "one", "HEAD~2")
    git("rm", "-q", "src/F5.kt")
    git("commit", "-q", "-m", "last")
    return top, git


@pytest.mark.parametrize("packed", [False, True])
def test_files_at_a_revision(spark, store, packed):
    top, git = store
    if packed:
        git("gc", "-q", "--aggressive", "--prune=now")
        assert not [d for d in os.listdir(top / ".git/objects") if len(d) == 2]
    for revision in ("HEAD", "main", "v1", git("rev-parse", "HEAD~1").decode().strip()):
        names = git("-c", "core.quotepath=off", "ls-tree", "-r", "--name-only", revision).decode().splitlines()
        got = {r["file"]: bytes(r["content"]) for r in X.files_at(spark, str(top), revision).collect()}
        assert sorted(got) == sorted(names)
        assert all(got[n] == git("show", f"{revision}:{n}") for n in names)
    with pytest.raises(ValueError):
        X.Objects(str(top / ".git")).commit("nowhere")


def test_types_of_deleted_files(spark, store):
    top, git = store
    old = X.files_at(spark, str(top), git("rev-parse", "HEAD~1").decode().strip()).where("file = 'src/F5.kt'")
    assert old.count() == 1
    files = spark.createDataFrame([("a/A.kt", "val x: Other5"), ("a/B.kt", "F5()"), ("a/C.kt", "nothing")], "file string, text string")
    changed = spark.createDataFrame([("src/F5.kt", True)], "file string, deleted boolean")
    none = lambda s: spark.createDataFrame([], s)
    run = lambda **k: {r["file"] for r in V.impact_slice(files, changed, none("source string, target string, weight int"), none("name string, file string"), none("caller_file string, caller string, name string"), ["src"], 1, **k).collect()}
    assert run() == {"a/B.kt"} and run(before=R.texts(old)) == {"a/A.kt", "a/B.kt"}
