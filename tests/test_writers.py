"""What is written reads back; settled diagnostics; a repository's odd corners."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from driftlake.operators import rules
from driftlake.sources import git, readers, writers


def test_log_and_fold(spark, tmp_path):
    rows = spark.createDataFrame([("v1", 0, ["a"]), ("v2", 0, ["b"]), ("v1", 1, ["c", "d"])], "tag string, seq int, hits array<string>")
    path = str(tmp_path / "log")
    writers.append_log(rows.where("seq = 0"), path)
    writers.append_log(rows.where("seq = 1"), path)
    back = readers.jsonl(spark, path, "tag string, seq int, hits array<string>")
    assert back.count() == 3 and readers.latest(back, "tag", "seq").where("tag = 'v1'").first()["hits"] == ["c", "d"]
    assert readers.pending(spark.createDataFrame([("v1",), ("v3",)], "tag string"), back).first()["tag"] == "v3"
    writers.write_folded(back, str(tmp_path / "fold"))
    folded = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "fold")).collect()]
    assert sorted(folded, key=str) == [{"v1": ["c", "d"]}, {"v2": ["b"]}]


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n')
    assert readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_tables_and_manifest(spark, tmp_path):
    c = spark.createDataFrame([("1", "2", "const.absent", "a,b", "é", "removed", "break")], "base string, target string, cause string, name string, detail string, class string, sev string")
    m = writers.with_meta(c, "1", "2", schema="1").collect()
    assert [r["cause"] for r in m] == ["meta", "const.absent"] and json.loads(m[0]["detail"]) == {"schema": "1"}
    writers.write_chain(c.select("base", "target", "name"), str(tmp_path / "chain"))
    assert spark.read.option("header", True).csv(str(tmp_path / "chain")).first()["name"] == "a,b" and len(list((tmp_path / "chain").glob("part-*"))) == 1
    assert writers.write_jsonl(c, str(tmp_path / "j")) == 1 and list(json.loads(spark.read.text(str(tmp_path / "j")).first()[0])) == sorted(c.columns)
    writers.write_manifest(str(tmp_path / "m.json"), b={"x": 1}, a=[2])
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": [2], "b": {"x": 1}}


def test_repository_corners(spark, tmp_path):
    repo = str(tmp_path / "r")
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", repo], check=True)
    for i in range(2):
        (tmp_path / "r" / "f").write_text(f"line {i}\n")
        run("add", "-A")
        run("commit", "-qm", f"c{i}")
    assert git.exists(repo, "HEAD") and not git.exists(repo, "nope") and not git.is_shallow(repo)
    copy = git.clone(repo, str(tmp_path / "copy"), blobless=False)
    assert git.rev_parse(copy, "HEAD") == git.rev_parse(repo, "HEAD") and git.remote_heads(spark, copy).count() == 1
    with pytest.raises(git.GitError):
        git.clone(str(tmp_path / "absent"), str(tmp_path / "c2"))
    w = spark.createDataFrame([(None, git.rev_parse(repo, "HEAD")), (git.rev_parse(repo, "HEAD~1"), git.rev_parse(repo, "HEAD")), ("bad", "bad")], "base string, tip string")
    got = {r["base"]: r["diff"] for r in git.diffs(w, repo).collect()}
    assert "+line 1" in got[None] and "-line 0" in got[git.rev_parse(repo, "HEAD~1")] and got["bad"] is None
    assert git.log(spark, repo, limit=1).count() == 1


def test_verdict_defaults(spark):
    """A sample without expectations has its label's; a label that predicts no error is borne out by silence."""
    s = spark.createDataFrame([("a", "meta.formatting", [], "f", "x", "y"), ("b", "meta.unknown", [], "f", "x", "y"), ("c", "rename.decl", ["e"], "g", "x", "y"), ("d", "rename.decl", ["e"], "f", "", "y")], "sample_id string, label string, expected_errors array<string>, path string, fixed_window string, broken_window string")
    files = spark.createDataFrame([("f", "text x here")], "path string, text string")
    runs = spark.createDataFrame([(k, False, []) for k in "abcd"], "sample_id string, timeout boolean, diagnostics array<struct<error_class:string,severity:string>>")
    got = {r["sample_id"]: (r["agreement"], r["stderr"]) for r in rules.verdicts(s, files, runs).collect()}
    assert got == {"a": ("match", None), "b": ("no_error", None), "c": ("error", "missing file: g"), "d": ("error", "fixed window not found at this commit")}
    assert rules.verdicts(s, files, runs, ["rename.decl"]).count() == 2
