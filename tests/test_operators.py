import pytest
from pyspark.sql import functions as F

from driftlake import vocab
from driftlake.functions import text as X
from driftlake.operators import classify, dataset, hunks, messages, rules, snapshot, weights, windows
from driftlake.sources import readers, writers


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr).first()[0]


def test_bounded_terms(spark):
    hit = lambda s: one(spark, X.matching_terms(F.col("t"), ["throwError", "panic!"]), t=s)
    assert hit("throwErrorAt x") == [] and hit("a.throwError x") == ["throwError"] and hit("throwError panic!") == ["throwError", "panic!"] and hit("panic!!") == []


def test_names(spark):
    new = lambda s: one(spark, X.replace_name(F.col("t"), F.lit("Nat.old"), F.lit("Nat.new$1")), t=s)
    assert new("Nat.old.mp x") == "Nat.new$1.mp x" and new("Nat.older Nat.old.Foo My.Nat.old") == "Nat.older Nat.old.Foo My.Nat.old"
    move = lambda a, b: one(spark, X.namespace_move(F.col("a"), F.col("b")), a=a, b=b)
    assert move("DirectLimit", "Module.DirectLimit") and not move("eq_iff.mp", "eq_heq.mp") and move("A.x", "B.x") and not move("a.x", "b.x")


def test_versions(spark, tmp_path):
    got = [r[0] for r in readers.versions(spark, given=["4.10.0", "4.9.0", "4.9.0-rc2"]).collect()]
    assert got == ["4.9.0-rc2", "4.9.0", "4.10.0"]
    with pytest.raises(ValueError):
        readers.versions(spark, given=["4.9", "4.9.1"])
    with pytest.raises(ValueError):
        readers.versions(spark, given=["4.9.0"])
    (tmp_path / "v.txt").write_text("﻿# list\n4.2.0\n\n 4.1.0 \n")
    assert [r[0] for r in readers.versions(spark, str(tmp_path / "v.txt")).collect()] == ["4.1.0", "4.2.0"]


def test_normalize(spark):
    n = lambda s: one(spark, X.normalize(F.col("s")), s=s)
    assert n("a :=\n  b -- c") == n("a := b") and n("/-- d -/ x /- y -/ z") == "x z"
    assert one(spark, X.notes(F.col("s")), s="#adaptation_note /-- moved\n up -/ x") == ["moved up"]


def edits(spark, rows):
    return {r["k"]: r for r in classify.classify(spark.createDataFrame(rows, "k string, pre string, post string, ctx_before array<string>")).collect()}


def test_classifier(spark):
    got = edits(spark, [
        ("reflow", "a :=\n b", "a := b -- note", []), ("decl", "exact foo_bar h", "exact foo_baz h", []), ("move", "open_x DirectLimit y", "open_x Module.DirectLimit y", []),
        ("added", "simp [a]", "simp [a, b]", []), ("removed", "simp [a, b]", "simp [a]", []), ("turned", "rw [foo]", "rw [← foo]", []), ("tight", "simp [a]", "simp only [a]", []),
        ("beats", "", "set_option maxHeartbeats 400 in", []), ("defeq", "", "set_option backward.isDefEq.x false in", []), ("lint", "", "set_option linter.foo false in", []),
        ("attr", "@[reducible] def x", "@[implicit_reducible] def x", []), ("dep", "theorem x", "@[deprecated y] theorem x", []), ("import", "import A.b", "import A.c", []),
        ("open", "open Foo Bar", "open Foo", []), ("note", "x", "#adaptation_note /-- why -/\nx", []), ("wrap", "exact Foo.sound h", "exact mapArg _ (Foo.sound h)", []),
        ("frag", "aa_b, cc_d]", "aa_b, ee_f]", ["simp only [x,"]), ("none", "", "", []), ("cut", "@[to_additive (attr := foo,", "@[to_additive (attr := bar,", []),
    ])
    first = {k: r["label"] for k, r in got.items()}
    assert first["reflow"] == "meta.formatting" and got["reflow"]["noise"] and first["decl"] == "rename.decl" and first["move"] == "rename.namespace"
    assert first["added"] == "auto.simp_lemma_added" and first["removed"] == "auto.simp_lemma_removed" and first["turned"] == "auto.simp_lemma_reoriented" and first["tight"] == "auto.simp_tightened"
    assert first["beats"] == "perf.heartbeats" and first["defeq"] == "elab.defeq_transparency" and first["lint"] == "lint.disabled"
    assert first["attr"] == "elab.instance_reducibility" and "rename.attribute" in got["attr"]["labels"] and first["dep"] == "rename.deprecation_added"
    assert first["import"] == "rename.import" and first["open"] == "rename.open_scope" and first["note"] == "meta.adaptation_note" and got["note"]["notes"] == ["why"]
    assert first["wrap"] == "auto.term_wrapped" and got["frag"]["labels"][:2] == ["auto.simp_lemma_added", "auto.simp_lemma_removed"] and first["none"] == "meta.formatting"
    assert "rename.attribute" in got["cut"]["labels"] and got["decl"]["expected_errors"] == ["unknown_constant", "unknown_identifier"]
    assert set(vocab.EXPECTED_ERRORS) >= {x for r in got.values() for x in r["labels"]}


def test_substitutions(spark):
    d = spark.createDataFrame([("foo x", "bar x"), ("foo x", "foo y x"), ("a b a", "c b d")], "pre string, post string").select(X.substitutions("pre", "post"))
    assert [[tuple(s) for s in r[0]] for r in d.collect()] == [[("foo", "bar")], [], []]


DIFF = "\n".join(["diff --git a/x.src b/x.src", "--- a/x.src", "+++ b/x.src", "@@ -1,5 +1,5 @@ sec", " a", "-b", "+B", " c", "--- d", "+D", " e", "diff --git a/n.src b/n.src", "new file mode 100644", "--- /dev/null", "+++ b/n.src", "@@ -0,0 +1,1 @@", "+new", ""])


def test_hunks(spark):
    lines = hunks.parse_unified(spark.createDataFrame([(DIFF,)], "diff string"))
    assert {r["path"] for r in lines.where("is_new").collect()} == {"n.src"}
    own = hunks.numbered(lines.where("path = 'x.src'"))
    two = hunks.hunks(own, gap=0).orderBy("run").collect()
    assert [(r["old_lines"], r["new_lines"]) for r in two] == [(["b"], ["B"]), (["-- d"], ["D"])] and two[1]["line_old"] == 4 and two[0]["ctx_before"] == ["a"]
    joined = hunks.hunks(own, gap=1).select("*", hunks.window("-").alias("w"), hunks.window("+", 1).alias("v")).collect()
    assert len(joined) == 1 and joined[0]["w"] == "b\nc\n-- d" and joined[0]["v"] == "a\nB\nc\nD\ne"


def test_declarations(spark):
    src = ["import Foo", "namespace A.B", "section", "@[simp] theorem foo (x) :", "  x", "end", "end A.B", "def bar := 1"]
    lines = readers.lines(spark.createDataFrame([("f", "\n".join(src))], "path string, text string"))
    d = {r["line"]: r for r in hunks.declarations(lines).collect()}
    n = {r["line"]: r["namespace"] for r in hunks.namespaces(lines).collect()}
    assert d[5]["name"] == "foo" and d[5]["kind"] == "theorem" and d[5]["start_line"] == 4 and d[8]["name"] == "bar" and d[1]["name"] is None
    assert n[5] == "A.B" and n[8] == ""


def test_expected_text(spark):
    content = "noise\na.src:3:1-4:2: error(my.name): bad\n  x\na.src:5:0: info: fine\n\n"
    rows = readers.harvest(spark.createDataFrame([("p", "v", content), ("j", "v", ' {"m":[{"message":"deep","range":{"start":{"line":1,"character":2}}}]}\n{broken'), ("e", "v", "")], "path string, toolchain string, content string")).orderBy("path", "idx").collect()
    assert [(r["path"], r["severity"], r["text"]) for r in rows] == [("j", "unknown", "deep"), ("p", "error", "bad\n  x"), ("p", "information", "fine")]
    assert rows[1]["error_name"] == "my.name" and rows[1]["start"]["line"] == 2 and rows[1]["end"]["column"] == 2 and rows[2]["end"] is None


def test_snapshot_load_and_diff(spark):
    raw = spark.createDataFrame([(v, i, s) for v, recs in {"1.0.0": ['{"t":"const","n":"a","k":"def","ar":1,"bi":"d","th":"1","u":0}', '{"t":"const","n":"b","k":"def","ar":2,"bi":"d","th":"2","u":0}', '{"t":"const","n":"c","k":"def","ar":0,"bi":"","th":"9","fields":["x"]}', '{"t":"zzz"}', ""], "2.0.0": ['{"t":"const","n":"a","k":"thm","ar":1,"bi":"d","th":"7","u":0}', '{"t":"const","n":"bb","k":"def","ar":2,"bi":"d","th":"2","u":0}', '{"t":"const","n":"c","k":"def","ar":0,"bi":"","th":"9"}']}.items() for i, s in enumerate(recs)], "release string, seq int, value string")
    consts = readers.snapshot(raw, "const")
    pairs = snapshot.version_pairs(consts)
    c = snapshot.constants(snapshot.side(consts, pairs, "base"), snapshot.side(consts, pairs, "target"), info=True)
    got = {(r["name"], r["cause"], r["sev"]) for r in c.collect()}
    assert got == {("a", "const.kind-changed", "break"), ("a", "const.type-changed", "break"), ("b", "const.renamed", "break"), ("c", "const.fields-changed", "break"), ("bb", "const.new", "info")}
    assert snapshot.chain(c, pairs).first()["breaks"] == 4 and vocab.unknown_causes(c).isEmpty()
    empty = spark.createDataFrame([("const", 3), ("attr", 0), ("deprecated", 0)], "section string, n int")
    with pytest.raises(ValueError):
        snapshot.self_check(empty)
    assert snapshot.self_check(empty, allow_empty=True) == ["attr"]


def test_templates(spark):
    msgs = [("an unknown constant named `a`", 1), ("an unknown constant named `b.c`", 2), ("type mismatch at x", 3)]
    m = messages.prepared(spark.createDataFrame([(i, "error", None, t) for t, i in msgs], "seq long, severity string, error_name string, text string"))
    t = messages.fit(m)
    assert {r["template"] for r in t.collect()} == {"an unknown constant named {0}", "type mismatch at x"}
    a = {r["seq"]: r["template"] for r in messages.assign(m, t).collect()}
    assert a[1] == a[2] == "an unknown constant named {0}"


def test_weights(spark):
    with pytest.raises(ValueError):
        weights.prior(spark, {"a": 0.5})
    obs = spark.createDataFrame([("a", "f1"), ("a", "f1"), ("a", "f2"), ("b", "f2")], "stratum string, fingerprint string")
    w = {r[0]: r[1] for r in weights.point(weights.shares(obs), weights.prior(spark, {"a": 0.3, "b": 0.3, "c": 0.4})).collect()}
    assert abs(w["f1"] - 1 / 3) < 1e-9 and abs(w["f2"] - 2 / 3) < 1e-9
    rows = [(1, 1, "x", "error", 0, 10, False), (1, 2, "y", "error", 5, 20, False), (1, 3, "z", "error", 15, None, False), (1, 4, "z", "error", 15, None, False), (1, 5, "w", "warning", 30, None, True)]
    r = {x["seq"]: x["is_root"] for x in weights.collapse(spark.createDataFrame(rows, "cluster int, seq int, fingerprint string, severity string, start long, end long, prone boolean")).collect()}
    assert r == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_dataset(spark):
    rows = spark.createDataFrame([(1, "s", "c1", "l", 0.5, "d"), (2, "s", "c1", "l", 0.5, "d"), (3, "t", "c1", "l", 0.9, "e")], "seq int, signature string, context string, label string, confidence double, decl string")
    got = {r["seq"]: r["duplicate_count"] for r in dataset.dedup(rows).collect()}
    assert got == {1: 2, 3: 1}
    many = spark.range(90).select(F.col("id").alias("seq"), (F.col("id") % 18).cast("string").alias("file"), F.lit("v").alias("toolchain"))
    assert dataset.choose_key(many, "toolchain") == "file"
    s = dataset.split(many, "file")
    assert s.groupBy("file").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty() and s.select("split").distinct().count() == 3


def test_rules(spark):
    pairs = [(f"p{i}", i, [("new_name", "old_name")], "new_name", "old_name", "rename.decl", f"f{i}", "w", "v", 1) for i in range(3)]
    r = rules.induce(spark.createDataFrame(pairs, "sample_id string, seq int, subs array<struct<old:string,new:string>>, broken string, fixed string, label string, file string, window string, toolchain string, duplicate_count int"))
    row = r.first()
    assert (row["support"], row["files"], row["kind"]) == (3, 3, "subst")
    files = spark.createDataFrame([("a", "use old_name and old_name.mp"), ("b", "old_names only"), ("c", "My.old_name")], "path string, text string")
    s = rules.synthesize(r, files).collect()
    assert [(x["path"], x["broken"]) for x in s] == [("a", "use new_name and old_name.mp")]
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    v = lambda ok, t, o, e: one(spark, rules.agreement(F.lit(ok), F.lit(t), o, e))
    assert v(False, False, arr(), arr("x")) == "error" and v(True, True, arr(), arr("deterministic_timeout")) == "match" and v(True, False, arr(), arr("no_error")) == "match"
    assert v(True, False, arr(), arr("x")) == "no_error" and v(True, False, arr("x"), arr("x", "y")) == "match" and v(True, False, arr("z"), arr("x")) == "mismatch"


def test_windows(spark):
    c = spark.createDataFrame([("c2", ["c1"], "2024-02-01T00", "chore: bump toolchain to v4.9.0 (#12)", ""), ("c1", [], "2024-01-01T00", "init", ""), ("m", ["c2", "b1"], "2024-03-01T00", "Merge branch 'bump/v4.10.0'", ""), ("b1", ["c2"], "2024-02-05T00", "x", "")], "sha string, parents array<string>, author_date string, subject string, body string")
    blobs = spark.createDataFrame([("c1", "v4.8.0"), ("c2", "v4.9.0"), ("m", "v4.10.0"), ("b1", "v4.9.0")], "sha string, version string")
    w = windows.merged([windows.from_messages(c, blobs), windows.from_version_changes(c, blobs), windows.from_merges(c, blobs), windows.from_branches(spark.createDataFrame([("origin/bump/v4.11.0", "z")], "ref string, sha string"), "m")]).collect()
    assert [(x["kind"], x["key"], x["base"], x["tip"], x["pr"]) for x in w if x["base"] == "c1"] == [("bump", "v4.9.0", "c1", "c2", "12")]
    assert any(x["key"] == "4.10.0" and x["tip"] == "b1" for x in w) and w[-1]["key"] == "4.11.0"
    assert {r[0] for r in windows.reachable(c, ["m"], ["c2"]).collect()} == {"m", "b1"}


def test_log_and_stream(spark, tmp_path):
    from driftlake.streaming.log import committed, scan_stream

    files = spark.createDataFrame([("t1", "a", "x throwError y\nz"), ("t2", "b", "none")], "tag string, file string, text string")
    files.write.parquet(str(tmp_path / "in"))
    q = scan_stream(spark, str(tmp_path / "in"), "tag string, file string, text string", str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    log = committed(spark, str(tmp_path / "log"), "tag string, file string, line int, targets array<string>, content string")
    assert [(r["tag"], r["line"], r["targets"]) for r in log.collect()] == [("t1", 1, ["throwError"])]
    writers.append_log(spark.createDataFrame([("t1", 1, ["old"]), ("t1", 2, ["new"])], "tag string, seq int, hits array<string>"), str(tmp_path / "l2"))
    again = readers.jsonl(spark, str(tmp_path / "l2"), "tag string, seq int, hits array<string>", strict=False)
    assert writers.folded(again).collect()[0]["json"] == '["new"]' and readers.pending(files, again).count() == 1
    writers.write_folded(again, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"t1":["new"]}'


def test_edits_are_dealt_out_by_number(spark):
    """One small file of edits is not one task, no rule's outcome is worked out twice, and useful edits need one pass."""
    from driftlake.plans import whole

    e = spark.createDataFrame([(i, "open A B", f"open A{i}") for i in range(40)], "k int, pre string, post string").coalesce(1)
    c = classify.classify(e).select("k", "labels")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = c.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) == n and max(r["count"] for r in tasks) <= 2 * 40 / n
    plan = whole.useful_edits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Relation [") == 1
