"""End to end over a two-commit repository."""

import subprocess

from driftlake.plans import mining
from driftlake.sources import git


def commit(repo, message, files):
    for name, text in files.items():
        (repo / name).write_text(text)
    subprocess.run(["git", "-C", repo, "add", "-A"], check=True)
    subprocess.run(["git", "-C", repo, "-c", "user.name=a", "-c", "user.email=a@b.c", "commit", "-qm", message], check=True)


OLD = "import Foo\nnamespace A\ntheorem one : x = y := by\n  exact old_name h\n\ntheorem two : y = z := by\n  simp [aa]\nend A\n"


def test_two_commits(spark, tmp_path):
    subprocess.run(["git", "init", "-q", tmp_path], check=True)
    commit(tmp_path, "start", {"toolchain": "v4.8.0\n", "A.src": OLD, "B.src": "theorem b := old_name x\n"})
    new = OLD.replace("old_name", "new_name").replace("simp [aa]", "simp [aa, bb]")
    commit(tmp_path, "chore: bump toolchain to v4.9.0 (#7)", {"toolchain": "v4.9.0\n", "A.src": new, "B.src": "theorem b := new_name x\n"})
    repo = str(tmp_path)
    w = mining.discover(spark, repo, modes=("squash", "version-file")).collect()
    assert [(x["key"], x["pr"], x["version_before"], x["version_after"], x["source"]) for x in w] == [("v4.9.0", "7", "v4.8.0", "v4.9.0", "squash")]
    pairs = mining.mine(mining.discover(spark, repo), repo, suffix=".src").cache()
    rows = {(r["path"], r["label"]): r for r in pairs.collect()}
    assert set(rows) == {("A.src", "rename.decl"), ("A.src", "auto.simp_lemma_added"), ("B.src", "rename.decl")}
    one = rows["A.src", "rename.decl"]
    assert one["decl"] == "A.one" and one["decl_kind"] == "theorem" and one["broken_window"] in OLD and one["fixed_window"] in new and one["toolchain"] == "v4.9.0"
    built = mining.build(pairs, by="file")
    assert built.count() == 3 and {"split", "duplicate_count"} <= set(built.columns)
    found = mining.induce(pairs)
    assert [(r["old"], r["new"], r["support"], r["files"]) for r in found.collect()] == [("old_name", "new_name", 2, 2)]
    s = mining.synthesize(spark, found, repo, suffix=".src").collect()
    assert {(r["path"], r["broken"].count("old_name")) for r in s} == {("A.src", 1), ("B.src", 1)}
    assert git.tags(spark, repo).count() == 0 and git.heads(spark, repo).count() == 1 and not git.is_shallow(repo)
