"""Automata against plain search."""

import random
import re

import pytest

from driftlake import vocab
from driftlake.operators import rules, search
from driftlake.sources import readers

RULE = "rule_id string, kind string, label string, old string, new string, support int, reversible boolean"


def texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["ab", "a", "é", "·", "⟨", "⟩", " ", "\n", "[", "]", "cd", "'", "x1", "日本", "😀"]
    return [(f"f{i}", "".join(rng.choice(bits) for _ in range(rng.randint(0, 80)))) for i in range(n)] + [("null", None), ("empty", "")]


@pytest.mark.parametrize("piece", [4 << 20, 600])
def test_matched(spark, monkeypatch, piece):
    monkeypatch.setattr(search, "PIECE", piece)
    monkeypatch.setattr(search, "OUT", 500)
    rng = random.Random(2)
    files = texts(60)
    pats = [(i, "".join(rng.choice(["ab", "a", "·", "⟨", " ", "[", "cd", "😀", "é"]) for _ in range(rng.randint(1, 3)))) for i in range(60)]
    pats += [(100, "ab"), (101, "ab"), (102, ""), (103, None), (104, "none such")]
    got = search.matched(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame(pats, "id int, p string"), "p")
    want = {(f, i) for f, t in files for i, p in pats if t and p and p in t}
    rows = [(r["path"], r["id"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_ten_thousand_rules_without_tokens(spark):
    rng = random.Random(3)
    marks = "⟨⟩[](){}+-*/=<>|·∘×→←∀∃¬∧∨≤≥≠"
    words = {"".join(rng.choice(marks) for _ in range(rng.randint(2, 6))) for _ in range(12_000)}
    r = [(f"wind-{i:05}", "window", "l", f"old {i}", w, 1, True) for i, w in enumerate(sorted(words)[:10_000])]
    files = [(f"p{i}", " a ".join(rng.choice(r)[4] for _ in range(12))) for i in range(40)]
    df = rules.synthesize(spark.createDataFrame(r, RULE), spark.createDataFrame(files, "path string, text string"), n=100_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("MapInArrow") == 1
    want = {(k[0], p, t.replace(k[4], k[3], 1)) for p, t in files for k in r if k[4] in t}
    want = {w for w in want if w[2].replace(f"old {int(w[0][5:])}", r[int(w[0][5:])][4]) == dict(files)[w[1]]}
    got = {(x["rule_id"], x["path"], x["broken"]) for x in df.collect()}
    assert got <= want and len(r) == 10_000
    kept = {}
    for rid, p, b in sorted(want, key=lambda w: (w[0], w[1])):
        kept.setdefault(rid, []).append((rid, p, b))
    assert got == {x for v in kept.values() for x in v[:20]}


def test_many_terms(spark):
    rng = random.Random(4)
    terms = [f"t{i}" for i in range(60)] + ["a.b", "lean'"]
    assert len(terms) > readers.FEW
    files = [("v1", f"f{i}", "\n".join(" ".join(rng.choice([*terms, "t1x", "xt2", "t3'", "(t4)", "a.bc", "é"]) for _ in range(rng.randint(0, 5))) for _ in range(6))) for i in range(20)]
    df = spark.createDataFrame(files, "tag string, file string, text string")
    got = {(r["file"], r["line"]): (r["targets"], r["content"]) for r in readers.term_hits(df, terms).collect()}
    want = {}
    for _, f, text in files:
        for i, line in enumerate(text.split("\n"), 1):
            has = [t for t in terms if re.search(f"(?<![{vocab.IDENT}]){re.escape(t)}(?![{vocab.IDENT}])", line)]
            if has:
                want[f, i] = (has, line.strip(" "))
    assert got == want
    few = readers.term_hits(df, terms[:20])
    assert {(r["file"], r["line"]): r["targets"] for r in few.collect()} == {k: [t for t in v[0] if t in terms[:20]] for k, v in want.items() if set(v[0]) & set(terms[:20])}
