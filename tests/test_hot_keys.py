"""Operators that no longer need one task a key, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from driftlake.functions.text import similarity
from driftlake.operators import dataset, drift, hunks, messages, ranks, weights
from driftlake.session import kept


@pytest.mark.parametrize("parts", ["1", "3", "9"])
def test_placed(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 5)) for i in range(300)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = ranks.placed(spark.createDataFrame(rows, "k string, i int, w int"), [F.col("k").desc_nulls_first(), F.col("i")], weight="w")
        got = {r["i"]: (r["place"], r["before"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, total = {}, 0
    for n, (_, i, w) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, [-ord(c) for c in r[0] or ""], r[1]))):
        want[i] = (n, total)
        total += w
    assert got == want and ranks.placed(spark.createDataFrame([], "k string"), [F.col("k")]).count() == 0


def test_no_window_over_all_rows(spark):
    obs = spark.createDataFrame([("s", f"c{i}", f"f{i % 3}") for i in range(20)] + [(None, "c", "f0")], "stratum string, cluster string, fingerprint string")
    pri = spark.createDataFrame([("s", 1.0)], "stratum string, weight double")
    for df in (weights.bootstrap(obs, pri, 20), dataset.split(obs, "cluster", [F.desc("cluster")]), dataset.split(obs, "cluster")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for w in re.findall(r"Window \[.*", plan):
            assert not re.search(r"windowspecdefinition\((?:cluster|_n|n)#", w) and ("windowspecdefinition(_part" in w or "windowspecdefinition(r#" in w), w


def test_namespaces(spark):
    rng = random.Random(2)
    bits = ["namespace A", " namespace B.c'", "section", "noncomputable section X", "end", "  end B", "theorem x", "", "ending", "sectional", "namespace", None, "namespace é"]
    rows = [(f"p{k}", i, rng.choice(bits)) for k in range(12) for i in range(60)]
    want = {}
    for k in range(12):
        stack = []
        for p, i, t in [r for r in rows if r[0] == f"p{k}"]:
            if m := re.match(r"\s*namespace\s+([\w.']+)", t or ""):
                stack.append(m[1])
            elif re.match(r"\s*(?:noncomputable\s+)?section\b", t or ""):
                stack.append(None)
            elif re.match(r"\s*end\b", t or "") and stack:
                stack.pop()
            want[p, i] = ".".join(s for s in stack if s)
    got = hunks.namespaces(spark.createDataFrame(rows, "path string, line int, text string").repartition(3))
    assert {(r["path"], r["line"]): r["namespace"] for r in got.collect()} == want and len(set(want.values())) > 20
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()


def bucket(n, kinds=6, seed=3):
    rng = random.Random(seed)
    forms = [f"{w} {{}} {w}1 {w}2 kind {{}} {w}3 {w}4 {w}5" for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta")[:kinds]]
    return [rng.choice(forms).format(f"name{i}", rng.randint(0, 10**6)) for i in range(n)]


def rows_of(spark, texts):
    df = spark.createDataFrame([(i, "error", None, t) for i, t in enumerate(texts)], "seq int, severity string, error_name string, text string")
    return messages.prepared(df).withColumn("bucket", F.lit("one"))


def shown(df):
    return sorted((r["template"], list(r["hole_kinds"]), r["n"]) for r in df.collect())


def test_small_buckets_are_induced_as_before(spark):
    texts = bucket(60)
    m = rows_of(spark, texts)
    order = sorted(m.select("head", "seq", "tokens").collect(), key=lambda r: (-len(r["head"]), r["seq"]))
    want = sorted((*t.render(), t.n) for t in messages.induce([list(r["tokens"]) for r in order]))
    assert shown(messages.fit(m)) == want


def test_a_hot_bucket_spreads(spark, monkeypatch):
    monkeypatch.setattr(messages, "LEAF", 50)
    monkeypatch.setattr(messages, "FAN", 3)
    m = rows_of(spark, bucket(1500))
    one, two = messages.fit(m.repartition(2)), messages.fit(m.repartition(7, "text"))
    assert shown(one) == shown(two) and sum(r[2] for r in shown(one)) == m.select("tokens").distinct().count()
    assert sorted(r[0] for r in shown(one)) == sorted(f"{w} {{0}} {w}1 {w}2 kind {{1}} {w}3 {w}4 {w}5" for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta"))
    assert {tuple(r[1]) for r in shown(one)} == {("ident", "numeral")}


def test_templates_that_do_not_shrink_take_rounds(spark, monkeypatch):
    """No task holds more than ROOM tokens of templates, and the templates are those of one list; so it is with what is assigned."""
    monkeypatch.setattr(messages, "LEAF", 60)
    monkeypatch.setattr(messages, "FAN", 2)
    rng = random.Random(6)
    m = rows_of(spark, bucket(150) + [" ".join(f"w{rng.randint(0, 40)}" for _ in range(9)) for _ in range(80)] + ["a \0 b", "a \0 c", ""])
    whole = messages.fit(m)
    both = lambda t: (sorted(map(tuple, t.select("template_id", "template", F.concat_ws(",", "hole_kinds"), "n").collect())), sorted(map(tuple, messages.assign(m, t).select("seq", "template_id", "template", "ratio").collect())))
    want = both(whole)
    monkeypatch.setattr(messages, "ROOM", 120)
    rounds = []
    monkeypatch.setattr(messages, "kept", lambda d, name: rounds.append(name) or kept(d, name))
    assert both(messages.fit(m)) == want and len(want[0]) > 60 and len(want[1]) == m.count()
    assert rounds.count("templates") > 6 and rounds.count("messages") == 2
    plan = messages.assign(m, whole)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan


def test_holes_keep_their_kind():
    rng = random.Random(4)
    pool = ["a", "B", "12", "-3", "x/y", "z.lean", "`q`", "", "  ", "R" * 70, "two words", "`Type`", "m\nn", "Foo.bar", "é"]
    for _ in range(3000):
        v = [rng.choice(pool) for _ in range(rng.randint(0, 6))]
        assert messages.hole_kind(messages._kept(v)) == messages.hole_kind(v), v


def plain_pairs(events, threshold=drift.THRESHOLD):
    out = []
    for path in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == path), key=lambda e: e[1])
        free = [e for e in own if e[2] == "added"]
        for x in (e for e in own if e[2] == "removed"):
            best, at = threshold, None
            for y in free:
                r = similarity(x[3] or "", y[4] or "")
                if r >= best and (at is None or r > best):
                    best, at = r, y
            if at:
                free.remove(at)
                out.append((path, "retext", x[3], at[4], round(best, 9)))
            else:
                out.append((path, "removed", x[3], None, None))
        out += [(path, "added", None, y[4], None) for y in free]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,choices", [(256, 1_000_000), (3, 40)])
def test_fuzzy_pairs(spark, monkeypatch, block, choices):
    """A hot path, copies on both sides, ties, empty and null texts, long and short ones."""
    monkeypatch.setattr(drift, "BLOCK", block)
    monkeypatch.setattr(drift, "CHOICES", choices)
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abc de") for _ in range(n))
    pool = [say(rng.choice([3, 8, 20, 60])) for _ in range(12)] + ["", "copy of one", "copy of one"]
    events = []
    for path, n in (("hot", 60), ("p", 7), ("q", 1), (None, 5)):
        for i in range(n):
            t = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                t.insert(rng.randint(0, len(t)), rng.choice("xyz"))
            t = "".join(t) if rng.random() < 0.95 else None
            events.append((path, i, "removed", t, None, "a", None) if rng.random() < 0.5 else (path, i, "added", None, t, None, "b"))
    df = spark.createDataFrame(events, "path string, idx int, kind string, before string, after string, before_name string, after_name string")
    got = sorted(((r["path"], r["kind"], r["before"], r["after"], None if r["similarity"] is None else round(r["similarity"], 9)) for r in drift.paired(df).collect()), key=repr)
    assert got == plain_pairs(events) and {r[1] for r in got} == {"retext", "removed", "added"}


def test_few_pairs_are_compared(spark):
    """Texts that can't be alike, by their length or letters, are not compared."""
    rng = random.Random(10)
    side = lambda n, at: [("hot", i + at, "".join(rng.choice(letters) for _ in range(size))) for i in range(n) for letters, size in [rng.choice([("abcdefg", 30), ("hijklmn", 30), ("opqrstu", 30), ("abcdefg", 200)])]]
    a, b = (spark.createDataFrame(side(120, k), "path string, idx int, text string") for k in (0, 500))
    compared = drift.similar(a, b).agg(F.sum("compared")).first()[0]
    assert 0 < compared < 0.4 * 120 * 120


def _fold(rows):
    """is_root by (cluster, seq): every cluster in order, with the spans that are open."""
    out = {}
    for c in {r[0] for r in rows}:
        seen, spans, first = set(), [], None
        for _, seq, fp, sev, s, e, prone in sorted((r for r in rows if r[0] == c), key=lambda r: (r[4] is None, r[4] or 0, r[1])):
            ok = (fp, s) not in seen
            seen.add((fp, s))
            if s is not None:
                ok = ok and not any(a < s < b for a, b in spans) and not (first is not None and s > first and sev == "warning" and prone)
                if ok and sev == "error":
                    first = s if first is None else first
                    spans += [(s, e)] if e is not None else []
            out[c, seq] = ok
    return out


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_cascades(spark, parts):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        c, s = (rng.choice([1, 2, None]), rng.randint(0, 60)) if i % 3 else (7, rng.randint(0, 400))  # cluster 7 is hot
        s = None if rng.random() < 0.02 else s
        e = None if s is None or rng.random() < 0.1 else s + rng.choice([-1, 0, 1, 2, 5, 9] + [90] * (c is None))
        rows.append((c, i, rng.choice("abcd"), rng.choice(["error", "warning", "info", None]), s, e, rng.choice([True, False, None])))
    # Spans that only link up one by one: what a range hands on changes what the next ones do.
    rows += [(9, 5000 + i, "x", "error", 10 * i, 10 * i + (15 if i else 18), False) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        kind = "cluster int, seq int, fingerprint string, severity string, start long, end long, prone boolean"
        got = weights.collapse(spark.createDataFrame(rows, kind))
        assert {(r["cluster"], r["seq"]): r["is_root"] for r in got.collect()} == _fold(rows)
        assert weights.collapse(spark.createDataFrame([], kind)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_draws_multiply_cells_as_vectors(spark, monkeypatch):
    """Against plain Python, with sums told in small pieces; no row stands for a replicate of a cell."""
    import hashlib
    from collections import Counter

    monkeypatch.setattr(weights, "HELD", 2)
    rng = random.Random(8)
    rows = [(s, f"c{rng.randint(0, 6)}", rng.choice(["f0", "f1", "f2", None])) for s in ("a", "b") for _ in range(60)]
    pri, draws, est = {"a": 0.7, "b": 0.3}, 40, Counter()
    for s, w in pri.items():
        own = sorted({c for x, c, _ in rows if x == s})
        for r in range(draws):
            got = Counter()
            for i in range(len(own)):
                c = own[int(hashlib.md5(f"0|{r}|{s}|{i}".encode()).hexdigest()[:8], 16) % len(own)]
                got.update(f for x, y, f in rows if (x, y) == (s, c))
            for f, n in got.items():
                est[f, r] += w * n / sum(got.values())
    want = {f: [sorted(est[f, r] for r in range(draws))[k] for k in (int(0.025 * draws), int(0.975 * (draws - 1)))] for f in ("f0", "f1", "f2", None)}
    got = weights.bootstrap(spark.createDataFrame(rows, "stratum string, cluster string, fingerprint string"), spark.createDataFrame(list(pri.items()), "stratum string, weight double"), draws)
    assert {r["fingerprint"]: [r["ci_low"], r["ci_high"]] for r in got.collect()} == {f: pytest.approx(v) for f, v in want.items()}
