"""Operators that SQL can't express, against plain Python."""

import difflib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from driftlake.operators import dataset, drift, hunks, messages, rules, windows
from driftlake.plans import queries as Q
from driftlake.sources import readers

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_drift_pairs(spark):
    """Greedy pairing without any bound gives the same pairs."""
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("the goal type of term is not unknown here".split()) for _ in range(n))
    a, b = [], []
    for p in range(6):
        olds = [say(rng.randint(1, 9)) for _ in range(8)]
        a += [(f"p{p}", i, t, "error", None) for i, t in enumerate(olds)]
        news = [t if rng.random() < 0.3 else t + " " + say(2) for t in olds[2:]] + [say(5), "", "zzz"]
        b += [(f"p{p}", i + 20, t, "error", None) for i, t in enumerate(news)]
    schema = "path string, idx int, prose string, severity string, name string"
    got = sorted((r["path"], r["kind"], r["before"], r["after"], r["similarity"] and round(r["similarity"], 9)) for r in drift.drift(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect())
    want = []
    for p in range(6):
        free = [r[2] for r in b if r[0] == f"p{p}"]
        for t in [r[2] for r in a if r[0] == f"p{p}"]:
            best = max(range(len(free)), key=lambda i: (ratio(t, free[i]), -i)) if free else None
            if best is not None and ratio(t, free[best]) >= drift.THRESHOLD:
                want.append((f"p{p}", "retext", t, free[best], round(ratio(t, free[best]), 9)))
                free.pop(best)
            else:
                want.append((f"p{p}", "removed", t, None, None))
        want += [(f"p{p}", "added", None, t, None) for t in free]
    assert got == sorted(want, key=lambda r: tuple(str(x) for x in r)) or sorted(map(str, got)) == sorted(map(str, want))


def test_drift_of_turns(spark):
    """Every removed and added turn of the registered query is in one event, and no pair was missed."""
    events = Q.drift_fuzzy(spark, SF).collect()
    a, b = (x.collect() for x in Q._turn_pairs(spark, SF))
    keyed = {(r["path"], r["idx"]) for r in a} & {(r["path"], r["idx"]) for r in b}
    left = defaultdict(list)
    for side, rows in (("a", a), ("b", b)):
        for r in rows:
            if (r["path"], r["idx"]) not in keyed:
                left[r["path"], side].append(r["prose"])
    fuzzy = [e for e in events if e["similarity"] is not None]
    alone = Counter((e["path"], e["kind"]) for e in events if e["kind"] in ("removed", "added"))
    assert sum(alone.values()) + 2 * len(fuzzy) == sum(map(len, left.values()))
    for (p, kind), n in alone.items():
        if kind == "removed" and alone[p, "added"]:
            assert all(ratio(x, y) < drift.THRESHOLD for x in left[p, "a"] for y in left[p, "b"]) or n < len(left[p, "a"])


def brute_templates(messages_):
    """Templates by the rule as it stands: literals matched in order, gaps on either side to one hole."""
    out = []
    for tokens in messages_:
        for t in out:
            heads = [x if isinstance(x, str) else None for x in t]
            blocks = difflib.SequenceMatcher(None, ["\0" if h is None else h for h in heads], tokens, autojunk=False).get_matching_blocks()
            literals = [h for h in heads if h is not None]
            same = sum(1 for m in blocks for k in range(m.size))
            if literals and same / len(literals) < messages.THETA:
                continue
            new, i, j, bad = [], 0, 0, False
            for m in blocks:
                mine, theirs = t[i : m.a], tokens[j : m.b]
                bad = bad or max(len(mine), len(theirs)) > messages.WIDEST
                if mine or theirs:
                    new.append([v for x in mine if not isinstance(x, str) for v in x] + ([" ".join(theirs)] if theirs else []))
                new += [x if isinstance(x, str) else [*x, tokens[m.b + k]] for k, x in enumerate(t[m.a : m.a + m.size])]
                i, j = m.a + m.size, m.b + m.size
            if not bad and any(isinstance(x, str) for x in new):
                t[:] = new
                break
        else:
            out.append(list(tokens))
    return out


def test_templates(spark):
    m = Q._turns(spark, SF)
    rows = m.select("seq", "bucket", "tokens", F.length("head").alias("len")).collect()
    per = defaultdict(dict)
    for r in rows:
        t = tuple(r["tokens"])
        seq, size = per[r["bucket"]].get(t, (r["seq"], 0))
        per[r["bucket"]][t] = (min(seq, r["seq"]), max(size, r["len"]))
    want = Counter()
    of = {}
    for bucket, found in per.items():
        order = sorted(found, key=lambda t: (-found[t][1], found[t][0]))
        of[bucket] = brute_templates([list(t) for t in order])
        for t in of[bucket]:
            n = iter(range(len(t)))
            want[bucket, " ".join(x if isinstance(x, str) else f"{{{next(n)}}}" for x in t)] += 1
    fit = messages.fit(m)
    got = Counter((r["bucket"], r["template"]) for r in fit.collect())
    assert got == want and len(got) > 20
    texts = {r["seq"]: (r["bucket"], list(r["tokens"])) for r in rows}
    for r in messages.assign(m, fit).collect():
        bucket, tokens = texts[r["seq"]]
        best = max([ratio([x for x in t if isinstance(x, str)], tokens) for t in of[bucket]], default=0.0)
        assert (abs(r["ratio"] - best) < 1e-9) if best >= messages.THETA else (r["template_id"] == -1 and r["template"] == " ".join(tokens))


def test_reachable_over_merges(spark):
    """Histories with merges, several roots and shared parts, against a plain walk."""
    rng = random.Random(5)
    parents = {f"c{i}": [f"c{j}" for j in sorted({max(0, i - 1), *(rng.sample(range(max(0, i - 9), i), 1) if i > 3 and rng.random() < 0.3 else [])}, reverse=True)] if i % 23 else [] for i in range(120)}
    c = spark.createDataFrame(list(parents.items()), "sha string, parents array<string>")

    def walk(tips):
        seen, todo = set(), list(tips)
        while todo:
            x = todo.pop()
            if x in parents and x not in seen:
                seen.add(x)
                todo += parents[x]
        return seen

    for inc, exc in ((["c119"], ["c60"]), (["c50", "c110"], []), (["c7"], ["c119"])):
        assert {r["sha"] for r in windows.reachable(c, inc, exc).collect()} == walk(inc) - walk(exc)


def test_split_by_ranges(spark):
    """Running sums in two steps place groups as one running sum does."""
    rng = random.Random(1)
    rows = [(f"g{rng.randint(0, 400)}" if rng.random() < 0.97 else None, i) for i in range(3000)]
    got = {}
    for r in dataset.split(spark.createDataFrame(rows, "g string, i int"), "g").collect():
        assert got.setdefault(r["g"], r["split"]) == r["split"]
    import hashlib

    n = Counter(r[0] for r in rows)
    order = sorted(n, key=lambda g: (g is not None, hashlib.md5(g.encode()).hexdigest() if g is not None else ""))
    before, want, start = 0, {}, None
    for g in order:
        if before < 0.8 * len(rows):
            want[g] = "train"
        else:
            start = before if start is None else start
            want[g] = "val" if before - start < 0.1 * len(rows) else "test"
        before += n[g]
    assert got == want and set(want.values()) == {"train", "val", "test"}


def test_diffs_of_equal_text_stay_apart(spark):
    """Two windows with one diff keep their own lines, once each."""
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,1 +1,1 @@\n-a\n+b\n"
    d = spark.createDataFrame([("t1", text), ("t2", text)], "tip string, diff string")
    got = Counter(r["tip"] for r in hunks.parse_unified(d, keep=("tip",)).collect())
    assert got == {"t1": 2, "t2": 2}


def test_declaration_signatures(spark):
    code = ["@[simp, ext] theorem foo (a : Nat) :", "    a = a := by", "  rfl", "def bar : Nat where", "  x", "lemma baz"]
    lines = spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(code)], "path string, line int, text string")
    got = {r["start_line"]: (r["signature"], r["attributes"]) for r in hunks.signatures(lines).collect()}
    assert got == {1: ("@[simp, ext] theorem foo (a : Nat) : a = a", ["simp", "ext"]), 4: ("def bar : Nat", []), 6: ("lemma baz", [])}


def test_rule_faults(spark):
    """A rule that can't be built is named and stops no other; blank windows are not reversible; names must be identifiers."""
    from driftlake.operators import classify

    bad = classify.Rule(99, "broken", lambda: F.struct(F.col("no_such_column").alias("labels"), F.lit(1.0).alias("confidence")))
    e = spark.createDataFrame([(1, "open A B", "open A")], "k int, pre string, post string")
    r = classify.classify(e, [*classify.RULES, bad]).first()
    assert r["labels"] == ["rename.open_scope"] and r["fired"] == ["open"] and len(r["rule_errors"]) == 1 and r["rule_errors"][0].startswith("broken: ") and r["evidence"]["open_removed"] == ["B"]
    p = spark.createDataFrame([("s", 0, [("->", "a")], "  ", "x y", "l", "f", "w", "v", 1, "c9", ["n1"]), ("t", 1, [("a", "b")], "q", "r", "l", "f", "w", "v", 1, "c8", ["n2"])], "sample_id string, seq int, subs array<struct<old:string,new:string>>, broken string, fixed string, label string, file string, window string, toolchain string, duplicate_count int, commit string, notes array<string>")
    got = {(r["kind"], r["old"]): r for r in rules.induce(p, 1, renames=True).collect()}
    assert set(got) == {("subst", "a"), ("window", "q")} and got["subst", "a"]["notes"] == ["n2"] and got["subst", "a"]["provenance"] == ["c8"] and got["subst", "a"]["windows"] == ["r"]


def test_synthesis_of_parts_of_words(spark):
    """Window rules whose text is no whole token."""
    files = spark.createDataFrame([("a", "x -> y rfl' z"), ("b", "the cat sat"), ("c", "rfl"), ("d", "none")], "path string, text string")
    r = spark.createDataFrame([(f"w{i}", "window", "l", o, n, 9 - i, True) for i, (o, n) in enumerate([("=>", "->"), ("bad", "rfl"), ("she dog", "he cat"), ("q", "")])], "rule_id string, kind string, label string, old string, new string, support int, reversible boolean")
    want = {("w0", "a", "x => y rfl' z"), ("w1", "a", "x -> y bad' z"), ("w1", "c", "bad"), ("w2", "b", "tshe dog sat")}
    assert {(x["rule_id"], x["path"], x["broken"]) for x in rules.synthesize(r, files).collect()} == want


def test_version_list_forms(spark, tmp_path):
    (tmp_path / "v").write_text("\\xef\\xbb\\xbf4.9.0\n# no\n4.16.0-rc1\n\n4.16.0\n")
    assert [r["release"] for r in readers.versions(spark, str(tmp_path / "v")).collect()] == ["4.9.0", "4.16.0-rc1", "4.16.0"]
    (tmp_path / "u").write_text("﻿4.9.0\n4.10.0\n")
    assert [r["release"] for r in readers.versions(spark, str(tmp_path / "u")).collect()] == ["4.9.0", "4.10.0"]


def test_wide_types_on_request(spark, tmp_path):
    f = tmp_path / "s" / "release=1"
    f.mkdir(parents=True)
    (f / "x.jsonl").write_text('{"t":"const","n":"a","k":"def","ty":"Nat"}\n{"t":"option","n":"o"}\n')
    assert "ty" not in readers.snapshot_file(spark, str(tmp_path / "s")).columns
    assert readers.snapshot_file(spark, str(tmp_path / "s"), types=True).first()["ty"] == "Nat"


def test_option_text():
    from driftlake.functions import text as X

    assert X.preamble({"b": "1", "a": "true"}) == "set_option a true\nset_option b 1\n" and X.option_flags({"b": "1", "a": "x"}) == ["-Da=x", "-Db=1"]
