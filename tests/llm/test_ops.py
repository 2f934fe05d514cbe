"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlake.llm import op1_sharding, op2_mixing, op3_substring, op4_quality, op5_rules, op6_minhash, op7_pii, op8_sentencepiece, op9_warc, op10_exact_dedup
from driftlake.llm._spark import scratch_dir

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, digest string, size long, label int, n_words int"


def words(t):
    return WORD.findall(t or "")


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["é", "naïve", "x.y", "#tag", "日本"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = say(60), say(200)
    texts = [None, "", " \n\t ", "one", "One", "a b", "A  b\n", say(3000), base, base, base.replace(" ", "\n"), base + " tail", "head " + base, say(30) + " " + passage + " " + say(20), passage, say(10) + " " + passage]
    for _ in range(12):
        w = base.split()
        for i in rng.sample(range(len(w)), rng.randint(1, 12)):
            w[i] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [say(rng.randint(1, 120)) for _ in range(40)] + ["line one\nline one\nline two\n\nline one", "the cat sat on it " * 6, "a b c\x85d", "x" * 5000]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 101, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1, 2, "d", 3, 4, 5) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd(spark):
    """Null and repeated ids, repeated rows."""
    return spark.createDataFrame([(None, "a b c", "s"), (None, None, None), (1, "a b c", "s"), (1, "a b c", "s"), (1, "d", None)], "doc_id long, text string, source string")


def test_sharding(spark, docs, texts, empty):
    limit = 4000
    got = op1_sharding.shard(docs, limit).collect()
    size = {i: len((t or "").encode()) for i, t in texts.items()}
    h = {i: int(hashlib.md5(f"{i}\x1f{t or ''}".encode()).hexdigest()[:15], 16) for i, t in texts.items()}
    bits = {i: format(x, "060b") for i, x in h.items()}

    def depth(i):
        for d in range(61):
            mates = [size[j] for j in bits if bits[j][:d] == bits[i][:d]]
            if sum(mates) <= limit or len(mates) == 1 or d == 60:
                return d

    assert {r["doc_id"]: r["shard"] for r in got} == {i: bits[i][: depth(i)] for i in texts}
    assert all(r["fits"] == (r["shard_bytes"] <= limit) for r in got) and op1_sharding.shard(empty).count() == 0
    assert op1_sharding.shard(odd(spark), 1).count() == 5


def test_shard_files(spark, docs, tmp_path):
    op1_sharding.write_shards(docs, str(tmp_path / "s"), 4000)
    back = spark.read.parquet(str(tmp_path / "s"))
    want = {r["doc_id"]: f"{r['depth']}-{r['prefix']}" for r in op1_sharding.shard(docs, 4000).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == want and back.count() == docs.count() and set(docs.columns) < set(back.columns)
    many = spark.createDataFrame([(1, "x" * 50, "s")] * 40 + [(2, "y", "s")], "doc_id long, text string, source string")
    op1_sharding.write_shards(many, str(tmp_path / "m"), 500)
    assert Counter(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "m")).collect()) == {1: 40, 2: 1}


def test_sharding_query_splits(spark):
    from driftlake.llm import catalog

    depths = {r[0] for r in catalog.op1_extendible_sharding(spark, "/root/testdata/sf0.001").select("depth").distinct().collect()}
    assert len(depths) >= 2 and max(depths) >= 3


def test_mixing(spark, docs, texts, empty):
    got = op2_mixing.mix(docs).collect()
    again = op2_mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and op2_mixing.mix(empty).count() == 0
    src = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = Counter()
    for i, t in texts.items():
        size[src[i]] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want, full, total = {}, set(), 1.5 * sum(size.values())
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    while True:
        rest = [s for s in order if s not in full]
        rate = (total - sum(2 * size[s] for s in full)) / max(1e-9, sum(weight[s] for s in rest))
        over = {s for s in rest if 2 * size[s] <= rate * weight[s]}
        if not over:
            break
        full |= over
    want = {s: min(2 * size[s], rate * weight[s]) for s in order}
    taken, most = Counter(), Counter()
    for r in got:
        s = src[r["doc_id"]]
        assert r["size"] == len(words(texts[r["doc_id"]])) and abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == size[s] and r["taken"] <= 2 * r["size"]
        assert r["copies"] in (int(want[s] / size[s] + 1e-9), int(want[s] / size[s] + 1e-9) + 1) or r["size"] == 0
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in order)
    assert op2_mixing.mix(odd(spark)).count() == 5
    m = op2_mixing.mixed(docs)
    assert m.columns == docs.columns and Counter(r["doc_id"] for r in m.collect()) == brute_mixed(docs, want, size, src, texts)


def brute_mixed(docs, want, size, src, texts):
    """Copies of each document in the mix, by the plan of ``mixed`` itself: whole parts at least, one more at most, near the targets."""
    got = Counter(r["doc_id"] for r in op2_mixing.mixed(docs).collect())
    taken = Counter()
    for i, t in texts.items():
        rate, n = want[src[i]] / max(1, size[src[i]]), len(words(t))
        assert got[i] in (int(rate + 1e-9), int(rate + 1e-9) + 1) if n else got[i] == 0
        taken[src[i]] += got[i] * n
    assert all(abs(taken[s] - want[s]) <= max([0, *(len(words(t)) for i, t in texts.items() if src[i] == s)]) / 2 + 1 for s in want)
    return got


def test_mixing_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    miss = op2_mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.abs(F.sum("taken") / F.first("target") - 1).alias("miss"))
    assert miss.where("miss > 0.005").isEmpty()


def test_mixing_equal_rows(spark, monkeypatch):
    """Equal rows get just the copies planned for them, however many they are."""
    rows = [(7, "a b c d", "s")] * 300 + [(None, "x y", "s")] * 200 + [(8, "one two three", "t")] * 10 + [(9, "p q r s t u v", "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for piece in (1 << 16, 7):
        monkeypatch.setattr(op2_mixing, "PIECE", piece)
        plan = Counter()
        for r in op2_mixing.mix(d).collect():
            plan[r["doc_id"]] += r["copies"]
        assert op2_mixing.mix(d).count() == len(rows)
        out = Counter((r["doc_id"], r["text"]) for r in op2_mixing.mixed(d).collect())
        words_of = lambda s: sum(c * len(t.split()) for (i, t), c in out.items() if (i in (8, 9)) == (s == "t"))
        goal = {r["source"]: r["target"] for r in op2_mixing.targets(op2_mixing.sizes(d)).collect()}
        assert abs(words_of("s") - goal["s"]) <= 2 and abs(words_of("t") - goal["t"]) <= 3
        assert abs(4 * plan[7] + 2 * plan[None] - goal["s"]) <= 2 and all(abs(out[k] - plan[k[0]]) <= 300 / piece + 2 for k in out)


def test_pivot_keeps_mass():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 100, 500).astype(float), rng.random(500)
    q, i = op2_mixing.pivot(size, p, rng.random(500))
    assert abs((size * p).sum() - (size * q).sum()) < 1e-6 and all(x in (0, 1) for k, x in enumerate(q) if k != i)


def test_pivot_tree(docs, monkeypatch):
    monkeypatch.setattr(op2_mixing, "LEAF", 4)
    monkeypatch.setattr(op2_mixing, "FAN", 2)
    assert op2_mixing.mix(docs).where("taken > 2 * size").isEmpty() and op2_mixing.mix(docs).count() == docs.count()


def brute_repeats(texts, n=50):
    first = {}
    for i, t in texts.items():
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in texts.items():
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("group", [1 << 16, 200, 1])
def test_substring(spark, docs, texts, empty, group):
    """Short prefixes only; prefixes that grow; the whole window."""
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op3_substring.remove_repeats(docs, group=group).collect()}
    assert got == brute_repeats(texts) and sum(x[1] for x in got.values()) > 500
    assert op3_substring.remove_repeats(empty).count() == 0


def test_substring_comes_from_trees(spark, docs, monkeypatch):
    """Without the trees nothing is removed, whole copies included."""
    none = lambda leaves, window: leaves.sparkSession.createDataFrame([], op3_substring._SPANS)
    monkeypatch.setattr(op3_substring, "_trees", none)
    assert op3_substring.remove_repeats(docs).where("n_removed > 0").isEmpty()


def test_substring_odd_ids(spark):
    long = " ".join(f"t{i}" for i in range(55))
    d = spark.createDataFrame([(1, long), (1, long), (1, long + " x"), (None, long), (2, "y " + long)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in op3_substring.remove_repeats(d).collect())
    assert got == [(1, 0), (1, 0), (1, 0), (2, 55), (99, 55)]


def test_suffix_tree():
    """Order, common prefixes and internal nodes against all suffixes compared one by one."""
    rng = np.random.default_rng(0)
    for size, letters in ((1, 1), (2, 1), (200, 2), (150, 1), (120, 5)):
        x = np.append(rng.integers(0, letters, size), letters)
        order, common = op3_substring.suffix_order(x)
        suffix = [tuple(x[i:]) for i in range(len(x))]
        assert [suffix[i] for i in order] == sorted(suffix)
        same = lambda a, b: next(k for k in range(len(a) + 1) if k == min(len(a), len(b)) or a[k] != b[k])
        assert common.tolist() == [same(suffix[i], suffix[j]) for i, j in zip(order[:-1], order[1:], strict=True)]
        for least in (1, 3, 9):
            got = {(int(d), frozenset(order[a:b].tolist())) for a, b, d in op3_substring.deep_nodes(common, least)}
            full = defaultdict(set)
            for i in range(len(x)):
                for k in range(least, len(x) - i + 1):
                    full[suffix[i][:k]].add(i)
            # An internal node is a string that goes on in two ways.
            assert got == {(len(p), frozenset(v)) for p, v in full.items() if len({suffix[i][len(p)] for i in v if i + len(p) < len(x)}) > 1}


def test_maximal_repeats():
    """All repeats that can be made longer on neither side, listed by brute force."""
    rng = random.Random(5)
    for trial in range(30):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 5))]
        tree = op3_substring.Tree(pa.array([" ".join(t) for t in texts]), 2)
        got = set()
        for lo, hi, depth in tree.repeats.tolist():
            at = list(zip(tree.leaf[lo:hi].tolist(), tree.off[lo:hi].tolist(), strict=True))
            got.add((tuple(texts[at[0][0]][at[0][1] : at[0][1] + depth]), frozenset(at)))
        where = defaultdict(set)
        for i, t in enumerate(texts):
            for k in range(len(t)):
                for n in range(2, len(t) - k + 1):
                    where[tuple(t[k : k + n])].add((i, k))
        left = lambda i, k: texts[i][k - 1] if k else (i, "start")
        right = lambda i, k, n: texts[i][k + n] if k + n < len(texts[i]) else (i, "end")
        want = {(s, frozenset(v)) for s, v in where.items() if len(v) > 1 and len({left(*p) for p in v}) > 1 and len({right(*p, len(s)) for p in v}) > 1}
        assert got == want, trial


def test_covered_parts():
    """What smaller documents have too, from node depths, against windows looked up one by one."""
    rng = random.Random(6)
    for _ in range(40):
        window = rng.randint(2, 5)
        texts = [[rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 6))]
        d = np.array([rng.randint(0, 4) for _ in texts])
        nxt = np.array([x + rng.choice([0, 0, 1, 3]) for x in d.tolist()])
        leaf, start, end, rest = op3_substring.repeats(pa.array([" ".join(t) for t in texts]), d, nxt, window)
        got = defaultdict(set)
        for i, a, b, r in zip(leaf.tolist(), start.tolist(), end.tolist(), rest.tolist(), strict=True):
            got[i, r].update(range(a, b))
        first = {}
        for t, x in zip(texts, d.tolist(), strict=True):
            for k in range(len(t) - window + 1):
                first[tuple(t[k : k + window])] = min(x, first.get(tuple(t[k : k + window]), 99))
        for i, t in enumerate(texts):
            for r, own in ((0, d[i]), (1, nxt[i])):
                assert got[i, r] == {p for k in range(len(t) - window + 1) if first[tuple(t[k : k + window])] < own for p in range(k, k + window)}


def test_quality(spark, empty):
    rng = random.Random(2)
    say = lambda n, junk: " ".join(rng.choice("the of and into near some words here".split()) + ("***" if junk and rng.random() < 0.7 else "") for _ in range(n))
    rows = [(i, say(rng.randint(5, 300), i % 3 == 0)) for i in range(600)] + [(601, None), (602, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0), (7, 0, 0), (7, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in op4_quality.score(d, op4_quality.fit(d, lab)).collect()}
    held = [r for r in out.values() if r["held_out"] and r["doc_id"] < 600]
    assert len(out) == 602 and all(0 <= r["score"] <= 1 for r in out.values()) and len(held) > 60
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) / len(held) > 0.95
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    none = op4_quality.fit(empty, lab)
    assert none.prior == 0.5 and op4_quality.score(empty, none).count() == 0


def brute_score(m, t):
    """One document's score: passages, encoder, gated attention and bag, word by word in plain Python."""
    from math import exp, log1p, tanh

    w = words(t)
    bags = [w[i : i + 64] for i in range(0, len(w), 64)] or [[]]
    five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    gaps = [g.count("\n") for g in re.split("[^\x20\x09-\x0d]+", t)[1:]] if w else []
    encoded, gate = [], []
    for b, bag in enumerate(bags):
        n, at = max(1, len(bag)), range(b * 64, b * 64 + len(bag))
        raw = "".join(bag).encode()
        x = [sum(c in v.encode() for c in raw) / max(1, len(raw)) for v in op4_quality._CLASSES.values()]
        x += [sum(c >= 128 for c in raw) / max(1, len(raw)), len(raw) / n / 10, sum(len(y.encode()) > 20 for y in bag) / n, sum(len(y.encode()) <= 2 for y in bag) / n]
        x += [sum(y in bag[:k] for k, y in enumerate(bag)) / n, sum(k in covered for k in at) / n, sum(gaps[k] for k in at) / n, sum("A" <= y[0] <= "Z" for y in bag) / n, len(bag) / 64, log1p(len(w)) / 8]
        if not bag:
            x = [0.0] * len(x)
        z = [max(-6, min(6, (v - a) / c)) for v, a, c in zip(x, m.mean, m.scale, strict=True)]
        e = [tanh(sum(z[i] * m.p["W"][i][j] for i in range(len(z))) + m.p["b"][j]) for j in range(len(m.p["b"]))]
        encoded.append(e)
        gate.append(sum(m.p["w"][g] * tanh(sum(e[j] * m.p["V"][j][g] for j in range(len(e)))) / (1 + exp(-sum(e[j] * m.p["U"][j][g] for j in range(len(e))))) for g in range(len(m.p["w"]))))
    a = [exp(g - max(gate)) for g in gate]
    bag = [sum(a[k] * encoded[k][j] for k in range(len(a))) / sum(a) for j in range(len(encoded[0]))]
    return 1 / (1 + exp(-(sum(bag[j] * m.p["c"][j] for j in range(len(bag))) + float(m.p["d"]))))


def test_quality_scores(spark, docs, texts):
    """Scores against a plain loop over each document's words."""
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(101)], "doc_id long, quality int, toxic int")
    m = op4_quality.fit(docs, lab)
    assert m.prior is None
    for r in op4_quality.score(docs, m).collect():
        assert abs(r["score"] - brute_score(m, texts[r["doc_id"]] or "")) < 1e-5, r


def test_quality_fit_is_bounded(spark, monkeypatch):
    """A labelled document gives at most FIT_PASSAGES passages to the training, and one bag however often its id comes."""
    long = " ".join(f"w{i}" for i in range(64 * 200))
    d = spark.createDataFrame([(1, long), (1, long), (1, "other"), (1, long), (1, "more"), (2, "short text")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    seen, train = [], op4_quality.train
    monkeypatch.setattr(op4_quality, "train", lambda x, ptr, y: seen.append((x, ptr, y)) or train(x, ptr, y))
    op4_quality.fit(d, lab, most=10)
    x, ptr, y = seen[0]
    assert len(y) == 2 and np.diff(ptr).max() <= op4_quality.FIT_PASSAGES and len(x) == ptr[-1] and x.shape[1] == op4_quality.N_FEATURES


def test_no_name_is_defined_twice():
    import ast
    from pathlib import Path

    for f in Path(op4_quality.__file__).parent.glob("*.py"):
        for scope in ast.walk(ast.parse(f.read_text())):
            if isinstance(scope, (ast.Module, ast.ClassDef)):
                names = [x.name for x in scope.body if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
                assert len(names) == len(set(names)), f


def test_pii_long_runs_of_numbers():
    import time

    t = time.perf_counter()
    text = "1 " * 1_000_000
    n = op7_pii.nodes(text, op7_pii.base(text))
    assert len(n) == 1 and (n[0].start, n[0].end, n[0].text) == (0, len(text) - 1, text[:-1])
    assert op7_pii.base("7" * 500_000 + ".")["ip"] == [] and op7_pii.base("1.2.3." * 100_000)["ip"][0] == (0, 7)
    assert time.perf_counter() - t < 30
    mixed = op7_pii.nodes("tel 12 34 5a 66 77 a@b 8 9", {k: [] for k in op7_pii.KINDS})
    assert [x.text for x in mixed] == ["12 34", "5a", "66 77", "a@b", "8 9"]


def test_mixing_tells_nulls_apart(spark):
    """Rows that differ only in which column is null are two items, each within its bounds."""
    rows = [(1, "a b c d", "en", None), (1, "a b c d", None, "en"), (2, "x y z", "en", "en"), (2, "x y z", "en", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = Counter(map(tuple, op2_mixing.mixed(d).collect()))
    assert set(out) <= set(rows) and out[rows[0]] <= 2 and out[rows[1]] <= 2 and out[rows[2]] <= 4
    goal = {r["source"]: r["target"] for r in op2_mixing.targets(op2_mixing.sizes(d)).collect()}
    for source in (None, "en"):
        took = sum(n * len(r[1].split()) for r, n in out.items() if r[3] == source)
        assert abs(took - goal[source]) <= 4


def brute_rules(rules, n):
    """The list's verdict on one document's counts: the first rule whose tests all hold rejects."""
    value = {k: n[a] if b is None else n[a] / max(1, n[b]) for k, (a, b) in op5_rules.FEATURES.items()}
    return not any(all(value[f] >= t if up else value[f] <= t for f, up, t in rule) for rule in rules)


def test_rule_verdicts(spark, docs, texts):
    """kept, against the rules applied in plain Python to counts taken in plain Python."""
    rules = [[("symbols_per_word", True, 0.01), ("n_words", False, 70.0)], [("distinct_per_word", False, 0.9), ("chars_per_word", True, 3.2)], [("dup_lines_per_line", True, 0.2)], [("words_per_line", True, 150.0)], [("digits_per_char", True, 0.74)]]
    got = {r["doc_id"]: r["kept"] for r in op5_rules.statistics(docs).select("doc_id", op5_rules.verdict(rules).alias("kept")).collect()}
    want = {}
    for i, t in texts.items():
        w, flat = words(t), "".join(words(t))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n = dict(zip(op5_rules.BASE, brute_counts(t), strict=True)) | {"n_lines": len(lines), "n_distinct": len(set(w)), "n_digits": sum(c in "0123456789" for c in flat), "n_long": sum(len(x.encode()) > 20 for x in w), "n_marks": sum((t or "").count(c) for c in "!?;:=_~^@\\/{}[]()\"'"), "n_upper": 0}
        want[i] = brute_rules(rules, n)
    assert got == want and 5 < sum(want.values()) < len(want) - 5


def test_rules_planted(spark):
    """A planted threshold is found, and judge() keeps just what the learnt list keeps of what passes the base rule."""
    rng = random.Random(6)
    rows = [(i, " ".join(("#" if rng.random() < (i % 3 == 0) * 0.6 else "") + f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(12, 60)))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    rules = op5_rules.fit(d, lab)
    assert rules and rules[0][0][0] in ("symbols_per_word",) and {r["doc_id"] for r in op5_rules.judge(d, lab).where("kept").collect()} == {i for i in range(300) if i % 3}


def brute_counts(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover)


def test_rules(spark, docs, texts, empty):
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    out = op5_rules.judge(docs, lab).collect()
    for r in out:
        n = brute_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in op5_rules.BASE) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in out if r["kept"]}
    f = op5_rules.filtered(docs, lab)
    assert f.columns == docs.columns and {r["doc_id"] for r in f.collect()} == kept
    assert op5_rules.judge(empty, lab).count() == 0 and op5_rules.judge(odd(spark), lab.limit(0)).count() == 5


def test_rule_learning(spark):
    rng = np.random.default_rng(0)
    x = {"symbols_per_word": rng.random(900), "n_words": rng.integers(10, 500, 900).astype(float)}
    bad = (x["symbols_per_word"] > 0.8) & (x["n_words"] > 100)
    rules = op5_rules.learn(x, bad)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= op5_rules._holds(x, r)
    assert rules and (hit & bad).sum() > 0.8 * bad.sum() and (hit & ~bad).sum() <= 0.06 * hit.sum()


def brute_near(texts, k=2, percent=80):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    sets = {}
    for i, t in texts.items():
        w = words(low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, texts, empty, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op6_minhash.near_duplicates(docs, k).collect()}
    assert got == brute_near(texts, k)
    assert op6_minhash.near_duplicates(empty).count() == 0 and op6_minhash.near_duplicates(odd(spark), 2).count() == 5
    d = op6_minhash.dedup(docs, k)
    assert d.columns == docs.columns and {r["doc_id"] for r in d.collect()} == {i for i, x in got.items() if x[1] == i}


def test_mixed_buckets(spark):
    """Chains and families whose star leaves pieces: the later rounds must join them."""
    rng = random.Random(3)
    out, n = {}, 0
    for _ in range(4):
        w = [f"a{rng.randint(0, 10**6)}" for _ in range(120)]
        for _ in range(25):
            out[n] = " ".join(w)
            n += 1
            w = list(w)
            for i in rng.sample(range(120), 3):
                w[i] = f"b{rng.randint(0, 10**6)}"
    ids = list(out)
    rng.shuffle(ids)
    t = {j: out[i] for j, i in enumerate(ids)}
    d = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op6_minhash.near_duplicates(d, 2).collect()} == brute_near(t)


def test_long_texts_share_no_band():
    """Unrelated sets of any size are no candidates: the places kept of a minimum don't depend on how small it is."""
    rng = np.random.default_rng(4)
    for n in (200, 20_000, 200_000):
        g = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(2)]
        sig = op6_minhash.signatures(np.concatenate(g), np.array([0, len(g[0]), len(g[0]) + len(g[1])]))
        band = op6_minhash.band_keys(sig)
        assert (sig[0] == sig[1]).mean() < 0.02 and not (band[0] == band[1]).any()
        assert op6_minhash.survive(sig[:1], sig[1:], op6_minhash.least_matches(80)).tolist() == []


def test_near_duplicates_repeated_ids(spark):
    """Rows of one doc_id are one document with the links of all its texts; rows without one keep apart."""
    say = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(5, say("a")), (5, say("b")), (9, say("a")), (7, say("b") + " z"), (9, say("c")), (11, say("c")), (None, say("d")), (None, say("e")), (20, say("e")), (3, say("f")), (3, say("f"))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["component_id"] or 99) for r in op6_minhash.near_duplicates(d, 2).collect())
    assert got == [(3, 3), (3, 3), (5, 5), (5, 5), (7, 5), (9, 5), (9, 5), (11, 5), (20, 20), (99, 20), (99, 99)]


@pytest.mark.parametrize("block", [512, 8])
def test_crossed_families(spark, block, monkeypatch):
    """Families that share buckets, some of which link only through members that no star meets."""
    monkeypatch.setattr(op6_minhash, "BLOCK", block)
    rng = random.Random(9)
    head = [f"h{i}" for i in range(90)]
    t, n = {}, 0
    for fam in range(5):
        own = head + [f"f{fam}x{i}" for i in range(18)]
        for _ in range(14):
            w = list(own)
            for i in rng.sample(range(len(w)), rng.randint(0, 5)):
                w[i] = f"r{rng.randint(0, 10**6)}"
            t[n] = " ".join(w)
            n += 1
    d = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op6_minhash.near_duplicates(d, 2).collect()} == brute_near(t)


def test_bayes_bounds():
    least = op6_minhash.least_matches(80)
    assert list(least) == [40, 80, 120, 160, 200] and all(0.3 * n < m < 0.8 * n for n, m in least.items())
    a = np.zeros((3, op6_minhash.PLACES), np.uint16)
    b = a.copy()
    b[1] = 1
    b[2, ::6] = 1
    assert op6_minhash.survive(a, b, least).tolist() == [0, 2]


PII = "Mail x.y+z@mail.example.com, or a@b (no), ip 10.0.0.255 not 10.0.0.256; card 4111 1111 1111 1111 not 4111 1111 1111 1112; call +1 (523) 555-1055 or 555-1055 é@ @@x."


def brute_pii(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15]
    return hashlib.sha256(",".join(out).encode()).hexdigest(), out


def test_pii(spark, empty):
    rng = random.Random(1)
    soup = ["".join(rng.choice("ab@.+-0123456789 ()%_") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    rows = list(enumerate([PII, None, "", "no data here", "1.2.3.4.5 +12-34 56 78 9", *soup]))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for r in op7_pii.find(d, op7_pii.fit(d)).collect():
        sha, spans = brute_pii(rows[r["doc_id"]][1])
        assert r["base_sha256"] == sha and set(spans) <= set(filter(None, r["spans"].split(","))) and r["n_email"] == sum(s.startswith("email") for s in spans)
    model = op7_pii.fit(empty)
    assert op7_pii.find(empty, model).count() == 0 and op7_pii.find(odd(spark), model).count() == 5


def test_skip_chain():
    """A bare number that repeats a sure phone number elsewhere in the text takes its label; alone it does not."""
    skip = np.zeros((5, 5)) + 3 * np.eye(5) - 1.5 * (1 - np.eye(5))
    f = op7_pii.Field(np.zeros((len(op7_pii.form("0")), 5)), np.zeros((5, 5)), skip)
    f.weight[0] = [1.0, 0, 0, 0, 0]
    t = "call +1 523 555 1055 now. " + "word " * 50 + "again 15235551055 please"
    b = op7_pii.base(t)
    assert [t[x:y] for x, y in f.added(t, b)["phone"]] == ["15235551055"] and f.added("see 15235551055", op7_pii.base("see 15235551055"))["phone"] == []


def test_pii_odd_digits(spark):
    """Digits that are not ASCII, and numbers too long for int(), are ordinary text; null and repeated ids don't starve the fit."""
    assert list(op7_pii.allowed("1.2.3.\u00b2")) == [True, False, False, False, False] and op7_pii.allowed("0" * 5000 + "1.1.1.1")[2]
    assert op7_pii.base("0" * 5000 + ".1.1.1")["ip"] == [(0, 5006)] and op7_pii.base("9" * 5000 + ".1.1.1")["ip"] == []
    rows = [(None, f"call +1 (523) 555-10{i}") for i in range(10, 40)] + [(5, f"call +1 (523) 555-20{i}") for i in range(10, 40)] + [(i, f"ip 10.0.0.{i} mail a{i}@b.example") for i in range(100, 140)]
    model = op7_pii.fit(spark.createDataFrame(rows, "doc_id long, text string"), most=20)
    assert np.abs(model.weight).max() > 0.1 and np.abs(model.skip).max() > 0.1


def test_pii_degraded_mentions(spark):
    """A mention without its cue is found where the same text holds a clean one, and only there."""
    rng = random.Random(8)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    clean, bad, alone = {}, {}, {}
    for i in range(240):
        kind = i % 4
        local, a, b = f"u{num(5)}", num(3), num(4)
        ip = ".".join(str(rng.randint(20, 255)) for _ in range(4))
        card = next(c for c in iter(lambda: "4" + num(15), None) if op7_pii.luhn(c))
        clean[i] = [f"{local}@m.example.com", ip, card, f"+1 (523) {a}-{b}"][kind]
        bad[i] = [f"{local}@m", ip.replace(".", "-"), ".".join(card[k : k + 4] for k in range(0, 16, 4)), f"523{a}{b}"][kind]
        alone[i] = rng.random() < 0.5
    text = lambda i: ("" if alone[i] else f"write to {clean[i]} now. ") + "some words here " * rng.randint(1, 40) + f"and again {bad[i]} please"
    rows = [(i, text(i)) for i in clean]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for r in op7_pii.find(d, op7_pii.fit(d)).collect():
        t, i = rows[r["doc_id"]][1], r["doc_id"]
        want = [] if alone[i] else [f"{op7_pii.KINDS[i % 4]}:{t.index(bad[i], len(clean[i]) + 9)}:{t.index(bad[i], len(clean[i]) + 9) + len(bad[i])}"]
        assert set(r["spans"].split(",")) - set(brute_pii(t)[1]) - {""} == set(want) and r["n_added"] == len(want), t


def test_skip_chain_beliefs():
    """Message passing against all assignments, on a graph without loops."""
    import itertools

    rng = np.random.default_rng(0)
    n, graph = 5, [(0, 1, 0), (1, 2, 1), (1, 3, 1), (3, 4, 0)]
    unary, chain, skip = rng.normal(size=(n, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5))
    node, pair = op7_pii.Messages(n, graph).run(unary, chain, skip, 200)
    want, both, z = np.zeros((n, 5)), np.zeros((len(graph), 5, 5)), 0.0
    for y in itertools.product(range(5), repeat=n):
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum((skip if k else chain)[y[a], y[b]] for a, b, k in graph))
        z += w
        for i in range(n):
            want[i, y[i]] += w
        for e, (a, b, _) in enumerate(graph):
            both[e, y[a], y[b]] += w
    assert np.allclose(node, want / z, atol=1e-3) and np.allclose(pair, both / z, atol=1e-3)


def test_sentencepiece(spark, docs, texts, empty):
    spm = pytest.importorskip("sentencepiece")
    sp = spm.SentencePieceProcessor(model_file=op8_sentencepiece.MODEL)
    m = op8_sentencepiece.compile_model(open(op8_sentencepiece.MODEL, "rb").read())
    hard = ["", " ", "   a", "a   ", "\n\n", "日本語 😀 text\t\x00", "é ﬁ  x", "a▁b", "the " * 300, "x" * 3000]
    for t in [*hard, *filter(None, texts.values())]:
        ids = np.frombuffer(m.encode(t), "<i4").tolist()
        assert ids == sp.encode(t)
        assert m.decode(ids) == t.replace("▁", " ")
    out = op8_sentencepiece.encode(docs)
    back = {r["doc_id"]: r["text"] for r in op8_sentencepiece.decode(out).collect()}
    assert back == {i: t or "" for i, t in texts.items()} and out.where("NOT round_trip").isEmpty() and op8_sentencepiece.encode(empty).count() == 0


def test_unigram_machine():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a"]
    m = op8_sentencepiece.Machine(pieces, [0, -3, -3, -3, -2.5, -4], [2, 1, 1, 1, 1, 1], False, True)
    assert [pieces[i] for i in np.frombuffer(m.encode("ab"), "<i4")] == ["▁", "ab"]


def test_normaliser():
    spm = pytest.importorskip("sentencepiece")
    hard = ["  \uff28ello  \u2460 \ufb01\t x ", "", "   ", "a\u0301b \u00bd\u3000z", "plain text", "\u200bx\n\ny", "\U0001f600 ok"]
    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        for squeeze in (True, False):
            lib = spm.SentencePieceNormalizer(rule_name=rule, escape_whitespaces=True, remove_extra_whitespaces=squeeze, add_dummy_prefix=True)
            own = op8_sentencepiece.compile_model(lib.serialized_model_proto()).normaliser
            assert own.identity == (rule == "identity" and not squeeze)
            for t in hard:
                assert own(t) == lib.normalize(t), (rule, squeeze, t)


def test_pieces_of_all_kinds():
    """User-defined pieces never merge, pieces over a space mark turn units off, ids out of range decode as unknown."""
    pieces = ["<unk>", "a", "b", "ab", "▁", "[x]", "a▁", "a▁b"]
    m = op8_sentencepiece.Machine(pieces, [0, -3, -4, -1, -5, 0, -2, -0.5], [2, 1, 1, 1, 1, 4, 1, 1], True, False)
    name = lambda t: [pieces[i] for i in np.frombuffer(m.encode(t), "<i4")]
    assert m.crosses and name("a b") == ["a▁b"] and name("a[x]b") == ["a", "[x]", "b"] and name("azzb") == ["a", "<unk>", "b"]
    assert m.decode([1, -1, 99, 2]) == "a \u2047  \u2047 b" and m.decode([]) == ""


PAGE = '<html lang="en"><head><title>T &amp; t</title><style>p{}</style></head><body><script>var t="</p>";</script><!-- c --><p>One<b>two</b>&nbsp;x</p><div>A<br>B</div><a href="/l?x=1&amp;y">k</a><img src=p.png></body></html>'


def test_warc(spark, tmp_path):
    d = spark.createDataFrame([(1, "http://h.example/d/", PAGE, 7), (2, None, None, 7), (3, "http://x.example/", "<p>open <b", 7)], "page_id long, url string, html string, content string").drop("content")
    rows = op9_warc.derivatives(d).collect()
    by = {(r["page_id"], r["record_type"]): r for r in rows}
    assert len(rows) == 6 and by[1, "conversion"]["content"] == "Onetwo x\nA\nB\nk"
    assert "title: T & t\r\n" in by[1, "metadata"]["content"] and "outlink: http://h.example/l?x=1&y L a/@href" in by[1, "metadata"]["content"] and "http-header: Content-Type" in by[1, "metadata"]["content"]
    for i in (1, 2, 3):
        a, b = by[i, "metadata"], by[i, "conversion"]
        assert a["refers_to"] == b["refers_to"] and a["record_id"] != b["record_id"] and a["payload_digest"] == b["payload_digest"]
        assert b["block_digest"] == op9_warc.sha1(b["content"].encode()) and b["content_length"] == len(b["content"].encode())
    assert by[2, "conversion"]["content"] == "" and "WARC-Target-URI" not in by[2, "conversion"]["headers"]
    op9_warc.write_warc(op9_warc.derivatives(d), str(tmp_path / "w"))
    back = {r["record_id"]: r for r in op9_warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert {k: bytes(v["block"]).decode() for k, v in back.items()} == {r["record_id"]: r["content"] for r in rows}
    assert all(back[r["record_id"]]["refers_to"] == r["refers_to"] for r in rows) and op9_warc.derivatives(d.limit(0)).count() == 0
    assert list(op9_warc.parse(b"WARC/1.1\r\nContent-Length: 99\r\n\r\ntorn")) == []
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    for bad in (b"x", b"-1", b"\xc2\xb2", b"9" * 5000):
        assert [b for _, b in op9_warc.parse(b"WARC/1.1\r\nContent-Length: " + bad + b"\r\n\r\n" + good)] == [b"ok"]


def brute_warc(data):
    """Records of a WARC file, cut by hand."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        out.append((fields, rest[:n]))
        data = rest[n:].removeprefix(b"\r\n\r\n")
    return out


def test_warc_round_trip(spark, tmp_path):
    """Pages to an archive, its responses to derivatives again: equal to those of the pages, and every Refers-To is there."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40).union(spark.createDataFrame([(9001, None, None), (9002, "http://x.example/ \u00e9", "<p>\u65e5 a\r\n\r\nb")], "page_id long, url string, html string"))
    op9_warc.archive(pages, str(tmp_path / "w"))
    records = [r for f in sorted((tmp_path / "w").glob("part-*")) for r in brute_warc(f.read_bytes())]
    ids = {f["WARC-Record-ID"] for f, _ in records}
    assert len(records) == 3 * 42 and all(f["WARC-Refers-To"] in ids for f, _ in records if f["WARC-Type"] != "response")
    for f, block in records:
        assert f["WARC-Block-Digest"] == op9_warc.sha1(block)
        if f["WARC-Type"] == "response":
            assert f["WARC-Payload-Digest"] == op9_warc.sha1(block.partition(b"\r\n\r\n")[2])
    back = op9_warc.read_warc(spark, str(tmp_path / "w"))
    assert {(r["record_id"], bytes(r["block"])) for r in back.collect()} == {(f["WARC-Record-ID"], b) for f, b in records}
    again = op9_warc.derivatives(op9_warc.from_warc(back)).drop("page_id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, op9_warc.derivatives(pages).drop("page_id").collect()))
    made = op9_warc.responses(pages)
    assert made.columns == [f.split()[0] for f in ("page_id", "source_id", "url", "date", "http", "payload_digest", "html", "head", "payload")]
    assert sorted(map(str, op9_warc.derivatives(made).collect())) == sorted(map(str, op9_warc.derivatives(pages).collect()))


def test_exact_dedup(spark, docs, texts, empty):
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in texts.items()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in op10_exact_dedup.DigestIndex(spark).decide(docs).collect()}
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    assert op10_exact_dedup.DigestIndex(spark).decide(empty).count() == 0 and op10_exact_dedup.DigestIndex(spark).decide(odd(spark)).count() == 5
    d = op10_exact_dedup.dedup(docs)
    assert d.columns == docs.columns and {r["doc_id"] for r in d.collect()} == {i for i, x in got.items() if x[2]}
    assert op10_exact_dedup.dedup(odd(spark)).count() == 3


def test_index_persists(spark, docs):
    index = op10_exact_dedup.DigestIndex(spark, buckets=4)
    first = docs.where(F.col("doc_id") < 50)
    early = sorted(index.decide(first).collect(), key=str)
    n = index.rows().count()
    rest = docs.where(F.col("doc_id") >= 50)
    later = index.decide(rest).collect()
    old = {r["doc_id"] for r in first.collect()}
    assert index.rows().count() == n + len({r["text_sha256"] for r in later if r["kept"]}) and all(not r["kept"] for r in later if r["keep_id"] in old)
    assert all(k == 1 for k in Counter(r["digest"] for r in index.rows().collect()).values())
    # The same batches again, by their numbers: nothing changes.
    assert sorted(index.decide(first, first=1).collect(), key=str) == early and sorted(index.decide(rest, first=2).collect(), key=str) == sorted(later, key=str)
    assert {r["doc_id"] for r in op10_exact_dedup.dedup(rest, index, 2).collect()} == {r["doc_id"] for r in later if r["kept"]}
    name = index.name
    index.drop()
    assert not spark.catalog.tableExists(name)


def test_dedup_in_batches(spark, docs):
    """Batches of ascending doc_id decide as one batch does, through the anti-join."""
    one = sorted(map(tuple, op10_exact_dedup.DigestIndex(spark).decide(docs).collect()))
    index = op10_exact_dedup.DigestIndex(spark, buckets=4)
    assert sorted(map(tuple, index.decide(docs, batches=4).collect())) == one
    assert index.rows().select("batch").distinct().count() == 4
    assert op10_exact_dedup.DigestIndex(spark).decide(odd(spark), batches=3).count() == 5


def test_index_without_a_shared_warehouse(spark, docs, monkeypatch):
    """A cluster whose warehouse is one machine's folder: an index without a name is in the checkpoint folder and leaves nothing there."""
    base = scratch_dir(spark).removeprefix("file://")
    one = sorted(map(tuple, op10_exact_dedup.DigestIndex(spark).decide(docs).collect()))
    kept = sorted(map(str, op10_exact_dedup.dedup(docs).collect()))
    get = type(spark.conf).get
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: f"file:{os.getcwd()}/spark-warehouse" if key == "spark.sql.warehouse.dir" else get(self, key, *a))
    index = op10_exact_dedup.DigestIndex(spark, buckets=4)
    assert sorted(map(tuple, index.decide(docs, batches=4).collect())) == one == sorted(map(tuple, index.decide(docs, batches=4, first=1).collect()))
    assert {os.path.commonpath([base, f.removeprefix("file://")]) for f in index.rows().inputFiles()} == {base}
    assert all(k == 1 for k in Counter(r["digest"] for r in index.rows().collect()).values())
    index.drop()
    assert not os.path.exists(f"{base}/{index.name}") and not spark.catalog.tableExists(index.name)
    assert sorted(map(str, op10_exact_dedup.dedup(docs).collect())) == kept
    with pytest.raises(ValueError, match="warehouse"):
        op10_exact_dedup.DigestIndex(spark, "lasting")


def test_named_index(spark, docs):
    """A named index is the warehouse's: a second object finds it, and a batch that is added again replaces itself."""
    name = f"lasting_{uuid.uuid4().hex}"
    one = sorted(map(tuple, op10_exact_dedup.DigestIndex(spark, name, 4).decide(docs, batches=2).collect()))
    again = op10_exact_dedup.DigestIndex(spark, name, 4)
    assert again.next_batch() == 3 and sorted(map(tuple, again.decide(docs, batches=2, first=1).collect())) == one
    assert not any(r["kept"] for r in again.decide(docs).collect())
    again.drop()
    assert not spark.catalog.tableExists(name)


def test_words_vectorised():
    from driftlake.llm._text import Words, slices

    t = [x for x in corpus()]
    w = Words(pa.array(t))
    assert [w.joined(i).decode() for i in range(len(t))] == [" ".join(words(x)) for x in t]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t)], ["doc_id", "text"])
    assert sum(p.num_rows for p in slices(b, limit=100)) == len(t)


def test_warc_unclosed_head():
    text = op9_warc.to_text
    assert text("<html><head><title>T</title><body><p>text</p>") == "text"
    assert text("<html><head><title>T</title><meta content='a > b'><script>x='<p>no</p>'</script><p>one<p>two</html>") == "one\ntwo"
    assert text("<head><title>T</title><body><p>a</p><p>&lt;/head> </head> b</p>") == "a\n</head> b"
    assert text("<head><title>T</title>bare text") == "bare text" and text("<head><link href=x></head ><p>y") == "y"
    assert text("a<noscript>b<p>c") == "a b\nc" and text("a<template>b") == "a b" and text("a<head><noscript><link href=x><p>d") == "a\nd"
    assert text("a<script>b<p>c") == "a" and text("a<style>b") == "a" and text("a<!-- b<p>c") == "a" and text("<head><style>b<body>c") == ""


def test_warc_keeps_headers_dates_and_ids(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nX-Long: a\r\n b\r\nServer: s:1\r\n\r\n<p>one\r\n\r\ntwo"
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:7>\r\nWARC-Target-URI: http://h.example/\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nContent-Type: application/http; msgtype=response\r\n"
    (tmp_path / "a.warc").write_bytes(head.encode() + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n")
    w = op9_warc.read_warc(spark, str(tmp_path / "a.warc"))
    pages = w.select(F.lit(1).cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.decode("payload", "UTF-8").alias("html"), "date", "http", F.col("record_id").alias("source_id"))
    meta, conv = op9_warc.derivatives(pages).collect()
    assert meta["content"] == "http-header: X-Long: a b\r\nhttp-header: Server: s:1\r\n" and conv["content"] == "one two"
    assert {(r["refers_to"], r["date"]) for r in (meta, conv)} == {("<urn:uuid:7>", "2024-05-06T07:08:09Z")}
    torn = w.withColumn("payload", F.lit(bytearray(b"a\xffb")))
    torn = torn.withColumn("head", F.lit(None).cast("binary"))
    assert op9_warc.from_warc(torn).first()["html"] == "a\ufffdb"
    absent = pages.withColumns({c: F.lit(None).cast(pages.schema[c].dataType) for c in ("date", "http", "source_id")})
    assert op9_warc.derivatives(absent).collect() == op9_warc.derivatives(pages.select("page_id", "url", "html")).collect()


def test_warc_bytes_round_trip(spark, tmp_path):
    """A 404, a Latin-1 page, a gzip one and a chunked one come back byte by byte, and are read for what they say."""
    import gzip

    packed = gzip.compress("<title>Zip</title><p>caf\u00e9".encode())
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in (b"<p>one ", b"two\r\nthree")) + b"0\r\n\r\n"
    blocks = [
        b"HTTP/1.1 404 Not Found\r\nServer:  odd \r\n\r\n<p>gone",
        b"HTTP/1.0 200 Fine\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>caf\xe9\r\n\r\n\xff",
        b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nX-A: 1\r\n b\r\n\r\n" + packed,
        b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked,
        b"HTTP/1.1 200 OK\r\n\r\n<meta charset='windows-1251'><p>\xcf\xf0",
        b"HTTP/1.1 204 None\r\n\r\n",
    ]
    with open(tmp_path / "a.warc", "wb") as f:
        for i, b in enumerate(blocks):
            f.write(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\nWARC-Payload-Digest: sha1:P%d\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % (i, i, len(b)) + b + b"\r\n\r\n")
    pages = op9_warc.from_warc(op9_warc.read_warc(spark, str(tmp_path / "a.warc")))
    assert {r["source_id"]: op9_warc.to_text(r["html"]) for r in pages.collect()} == dict(zip((f"<urn:uuid:{i}>" for i in range(6)), ("gone", "caf\u00e9 \u00ff", "Zip\ncaf\u00e9", "one two three", "\u041f\u0440", ""), strict=True))
    op9_warc.archive(pages, str(tmp_path / "out"))
    back = op9_warc.read_warc(spark, str(tmp_path / "out")).collect()
    got = {r["record_id"]: (bytes(r["block"]), r["payload_digest"], r["block_digest"]) for r in back if r["record_type"] == "response"}
    assert got == {f"<urn:uuid:{i}>": (b, f"sha1:P{i}", op9_warc.sha1(b)) for i, b in enumerate(blocks)}
    assert sorted((r["record_type"], r["refers_to"]) for r in back if r["record_type"] != "response") == sorted((k, f"<urn:uuid:{i}>") for i in range(6) for k in ("conversion", "metadata"))


def test_shards_of_a_large_row_group(spark, tmp_path):
    """Rows of a shard beyond its limit are dealt out by what they are, so a run that reads them in another order writes them alike."""
    d = spark.createDataFrame([(1, "x" * 50, f"s{i}") for i in range(60)], "doc_id long, text string, source string")
    for k in (1, 5):
        op1_sharding.write_shards(d.repartition(k), str(tmp_path / f"m{k}"), 500)
        assert Counter(r["source"] for r in spark.read.parquet(str(tmp_path / f"m{k}")).collect()) == {f"s{i}": 1 for i in range(60)}


def test_warc_files_are_streamed(spark, tmp_path):
    """Files are read piece by piece, packed record by record or not; a wrong length takes no memory, and large records go on in small batches."""
    import gzip
    import io

    record = lambda i, b: b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(b)) + b + b"\r\n\r\n"
    blocks = [bytes([i]) * (i * 300_000) + b"\r\n\r\nWARC/1.1\r\n" for i in range(8)]
    (tmp_path / "w w%").mkdir()
    (tmp_path / "w w%" / "a.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(blocks)))
    (tmp_path / "w w%" / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(i + 8, b)) for i, b in enumerate(blocks)))
    w = op9_warc.read_warc(spark, str(tmp_path / "w w%"))
    want = {f"<urn:uuid:{i}>": blocks[i % 8] for i in range(16)}
    assert {r["record_id"]: bytes(r["block"]) for r in w.collect()} == want
    assert "content#" not in w._jdf.queryExecution().executedPlan().toString()
    local = op9_warc.read_warc(spark, str(tmp_path / "w w%"), opener=lambda p: open(p.removeprefix("file:"), "rb"))
    assert {r["record_id"]: bytes(r["block"]) for r in local.collect()} == want

    class Watched(io.BytesIO):
        largest = 0

        def readinto(self, b):
            Watched.largest = max(Watched.largest, len(b))
            return super().readinto(b)

    for data in (record(1, b"ok"), gzip.compress(record(1, b"ok"))):
        torn = b"WARC/1.1\r\nContent-Length: 999999999999999999\r\n\r\nx"
        got = list(op9_warc.parse(Watched(data + (gzip.compress(torn) if data[:1] == b"\x1f" else torn))))
        assert [b for _, b in got] == [b"ok"]
    assert 0 < Watched.largest <= 1 << 20
    assert [len(p) for p in op9_warc._parts(iter([({}, b"x" * 10)] * 7), most=3, size=100)] == [3, 3, 1]
    assert [len(p) for p in op9_warc._parts(iter([({}, b"x" * 60)] * 5), most=9, size=100)] == [2, 2, 1]
