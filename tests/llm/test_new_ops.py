"""Operators 11 to 13 against plain Python, on small tables with nulls, ties, repeats and clashing columns."""

import datetime
import hashlib
import math
import pickle
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlake.llm import catalog, op11_funnels, op12_whitening, op13_chat

SF = "/root/testdata/sf0.001"


def against(spark, name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cur = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cur.fetchall())


# ---------------------------------------------------------------- 11

START = datetime.datetime(2024, 3, 10, 1, 59, 0)


def plain_funnels(rows, which, limit=op11_funnels.LIMIT):
    """funnel, client -> n1.., t2.. by walking each attempt."""
    own = {}
    for who, kind, t in {r for r in rows if None not in r}:
        own.setdefault(who, []).append((round((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6), kind))
    out = {}
    for f, (steps, bad) in which.items():
        for who, have in own.items():
            times = [[] for _ in steps]
            n = [0] * len(steps)
            for t1 in (t for t, k in have if k == steps[0]):
                n[0] += 1
                at = t1
                for i, k in enumerate(steps[1:], 1):
                    nxt = min((t for t, x in have if x == k and t > at), default=None)
                    if nxt is None or nxt - t1 > limit or any(x == bad and at < t <= nxt for t, x in have):
                        break
                    n[i] += 1
                    times[i].append(nxt - at)
                    at = nxt
            if n[0]:
                out[f, who] = (*n, sum(x > 0 for x in n), *[sorted(v)[-(-90 * len(v) // 100) - 1] if v else None for v in times[1:]])
    return out


def clicks(spark, rows):
    df = spark.createDataFrame(rows, "client_id long, kind string, arrived_at timestamp_ntz")
    return df.withColumns({c: F.lit(1) for c in ("t", "mask", "range", "funnel", "pair", "n", "w", "step", "next0", "starts")})


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_funnels(spark, parts):
    rng = random.Random(parts)
    kinds = ["view", "click", "purchase", "error", "signup", "other", None]
    rows = []
    for who in [1, 1, 1, 1, 2, 3, None]:
        at = 0
        for _ in range(120):
            at += rng.choice([0, 0, 1, 17_000_000, 60_000_000, 900_000_000])
            rows.append((who, rng.choices(kinds, [6, 5, 4, 1, 2, 1, 1])[0], START + datetime.timedelta(microseconds=at)))
    rows += rows[:50] + [(4, "view", None), (5, "view", START), (5, "click", START), (6, "error", START)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # its clocks change inside these rows
        got = op11_funnels.funnels(clicks(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = plain_funnels(rows, op11_funnels.FUNNELS)
    assert {(r["funnel"], r["client_id"]): tuple(r)[2:10] for r in got} == want and len(got) == len(want)
    for r in got:
        assert r["same_depth"] == sum(f == r["funnel"] and v[4] == r["deepest"] for (f, _), v in want.items())


def test_funnel_shared_target(spark):
    """Many starts that meet at one target: the limit cuts between them, in one bin and in several."""
    rows = [(1, "view", START + datetime.timedelta(microseconds=i * 999_983)) for i in range(2500)] + [(1, "click", START + datetime.timedelta(seconds=2501)), (1, "view", START + datetime.timedelta(seconds=2502))]
    rows += [(1, "purchase", START + datetime.timedelta(seconds=2502, microseconds=7))]
    r = op11_funnels.funnels(clicks(spark, rows)).where("funnel = 'A'").first()
    want = plain_funnels(rows, {"A": op11_funnels.FUNNELS["A"]})["A", 1]
    assert tuple(r)[2:10] == want and want[1] > want[2] >= want[3] > 1700


def test_other_funnels(spark):
    rows = [(1, k, START + datetime.timedelta(seconds=i)) for i, k in enumerate("abcabxc")]
    which = {"two": (("a", "b"), "x"), "three": (("a", "b", "c"), "x")}
    got = {(r["funnel"], r["client_id"]): r for r in op11_funnels.funnels(clicks(spark, rows), which).collect()}
    assert tuple(got["two", 1])[2:] == (2, 2, 0, 2, 1_000_000, None, 1) and tuple(got["three", 1])[2:] == (2, 2, 1, 3, 1_000_000, 1_000_000, 1)
    assert op11_funnels.funnels(clicks(spark, [])).count() == 0


def test_funnel_query(spark):
    against(spark, "op11_ordered_funnels", "clicks")


# ---------------------------------------------------------------- 12


def plain_whitening(vectors):
    """n, sums, covariance (exact fractions) of the distinct integer vectors."""
    xs = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    cov = [[Fraction(n * sum(x[i] * x[j] for x in xs) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return n, s, cov


def test_scatter_is_exact():
    rng = np.random.default_rng(2)
    for size in (10**6, 10**12, (1 << 62) + 5):
        x = rng.integers(-size, size, (50, 3))
        p = op12_whitening.primes(2 * 50 * size**2)
        assert math.prod(p) > 2 * 50 * size**2 and max(p) < 1 << 20 and len(set(p)) == len(p)
        rest = [op12_whitening.residues(x, q).tolist() for q in p]
        rows = [(1, *map(int, r)) for r in x]
        want = [sum(r[i] * r[j] for r in rows) for i in range(4) for j in range(i, 4)]
        assert [op12_whitening.chinese([r[k] for r in rest], p) for k in range(10)] == want


def test_whitening(spark):
    rng = random.Random(4)
    v = [[rng.gauss(0, 1 + i) for i in range(5)] for _ in range(60)]
    v += v[:30] + [v[0]] * 20
    bad = [None, [], [1.0] * 4, [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [1.0, float("inf"), 0.0, 0.0, 0.0]]
    rows = [(i if i % 9 else None, x, i) for i, x in enumerate(v + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").withColumns({c: F.lit(0) for c in ("x", "key", "v", "component", "d")}).repartition(3)
    got = op12_whitening.whiten(df).collect()
    assert len(got) == 5 * len(v)
    n, s, cov = plain_whitening(v)
    e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    e, u = e[::-1], u[:, ::-1]
    want = {}
    for i, x in enumerate(v):
        ints = [math.floor(64 * c) + 1_000_000 for c in x]
        y = [n * a - b for a, b in zip(ints, s, strict=True)]
        key = i if i % 9 else None
        for c in range(5):
            want.setdefault((key, c + 1, sum(a * a for a in y)), []).append(abs(float(np.dot([a / n for a in y], u[:, c])) / math.sqrt(e[c])))
    for r in got:
        assert r["n"] == n and min(abs(abs(r["whitened"]) - w) for w in want[r["vec_id"], r["component"], r["deviation"]]) < 1e-8
        assert abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-8
    signs = {(r["vec_id"], r["component"]): r["whitened"] for r in got if r["vec_id"] is not None}
    assert all(signs[i, 1] * signs[i + 60, 1] >= 0 for i in range(1, 30) if i % 9 and (i + 60) % 9)


def test_whitening_odd(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert op12_whitening.whiten(make([])).count() == 0 and op12_whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = op12_whitening.whiten(make([(i, [float(i), 2.0 * i, 7.0]) for i in range(10)])).collect()
    assert len(line) == 10 and {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    huge = op12_whitening.whiten(make([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])])).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and any(r["deviation"] is None for r in huge)


def test_whitening_query(spark):
    got = catalog.queries()["op12_residue_whitening"](spark, SF)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got.count() == 16 * rows.count() and got.dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    n, s, cov = plain_whitening([r[0] for r in rows.select("embedding").collect()])
    one = {r["vec_id"]: r for r in got.where("component = 1").collect()}
    for r in rows.limit(20).collect():
        y = [n * (math.floor(64 * c) + 1_000_000) - b for c, b in zip(r["embedding"], s, strict=True)]
        assert one[r["vec_id"]]["deviation"] == sum(a * a for a in y) and one[r["vec_id"]]["n"] == n
    assert one[0]["identity_error"] < 1e-9


# ---------------------------------------------------------------- 13


def test_escapes():
    rng = random.Random(6)
    bits = ["\\", "<", "</s>", "s>", "[INST]", "[/INST]", "[", "/INST]", " ", "\n", "a", "<s>", "[/", "é"]
    for _ in range(2000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        e = op13_chat.escape(s)
        assert op13_chat.unescape(e) == s and not any(c in e for c in op13_chat.CONTROL)


def test_chat_round_trip():
    rng = random.Random(7)
    bits = ["\\", "<", "</s>", "s>", "[INST]", "[/INST]", "[", " [/INST", " ", "\n", "a", "<s>", "é"]
    t = pickle.loads(pickle.dumps(op13_chat.chat()))
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "", "a\nb\\", "\n", " [/INST]"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 6))]
        text, spans = t.render(messages=[{"role": r, "text": x} for r, x in turns])
        assert op13_chat.read_back(text) == turns
        assert [op13_chat.unescape(text[a:b]) for a, b in spans] == [x for r, x in turns if r == "assistant"]


def test_templates():
    T = op13_chat.Template
    r = lambda s, **k: T(s).render(**k)[0]
    assert r("a{{ 1 + 2 }}b{{ x }}", x="!") == "a3b!" and r("{{ x.y }}{{ x['y'] }}{{ x.z }}", x={"y": 1}) == "11"
    assert r("{% if a == 1 %}one{% elif a in [2, 3] %}few{% else %}many{% endif %}", a=3) == "few"
    assert r("{% for x in xs %}{{ loop.index }}{{ x | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=["a", "b"]) == "1A, 2B"
    assert r("  {%- set y = 'q' -%}  {{ y + y | upper }} {{ none_such | default('d') }}") == "QQ d"
    assert r("{{ 'a' if x else 'b' }}{{ x and 1 }}{{ x or 2 }}{{ -1 < 0 < 1 }}", x=0) == "b02True"
    text, spans = T("é{% for m in ms %}{% generation %}{{ m }}{% endgeneration %}|{% endfor %}").render(ms=["ab", ""])
    assert text == "éab||" and spans == [(1, 3), (4, 4)]


def test_folding():
    tree = op13_chat.Template("a{% if k == 1 %}b{{ k + 1 }}{% else %}c{% endif %}d{{ x }}{% if false %}e{% endif %}f", k=1).tree
    assert [type(n).__name__ for n in tree] == ["Text", "Put", "Text"] and tree[0].text == "ab2d" and tree[2].text == "f"
    assert op13_chat.Template("{% set k = 2 %}{{ k }}", k=1).render()[0] == "2"
    assert op13_chat.Template("{{ upper }}{{ 'a' | upper }}").render(upper="x")[0] == "xA"
    assert op13_chat.Template("{{ x + ('a' | upper) }}").tree[0].value.right.value == "A" and op13_chat.Template("{{ 1 + 'a' }}").tree
    assert sum(isinstance(n, op13_chat.For) for n in op13_chat.chat().tree) == 1


@pytest.mark.parametrize("bad", ["{{ x() }}", "{{ x.__class__ }}", "{{ [y for y in x] }}", "{{ lambda: 1 }}", "{{ x | system }}", "{{ f'{x}' }}", "{{ 9 ** 9 }}", "{{ 'a' * 9 }}", "{% if a %}", "{% endfor %}", "{% for x y %}{% endfor %}", "{% import os %}", "{% else %}", "{{ (y := 1) }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}"])
def test_sandbox(bad):
    with pytest.raises(op13_chat.TemplateError):
        op13_chat.Template(bad)


def test_sandbox_at_run_time():
    with pytest.raises(op13_chat.TemplateError):
        op13_chat.Template("{% for a in x %}{% for b in x %}{{ b }}{% endfor %}{% endfor %}", limit=1000).render(x=[1] * 100)
    with pytest.raises(op13_chat.TemplateError):
        op13_chat.Template("{% for a in x %}.{% endfor %}").render(x="text")
    assert op13_chat.Template("{{ x.append }}{{ x.real }}").render(x=[1])[0] == ""


def test_long_conversations(spark):
    """The limit on parts grows with the turns, and large texts go on in small batches."""
    turns = [{"role": "user" if i % 2 else "assistant", "text": "</s>"} for i in range(2000)]
    text, spans = op13_chat.Template(op13_chat.CHAT, limit=0, begin=op13_chat.BEGIN, end=op13_chat.END, stop=op13_chat.STOP).render(messages=turns)
    assert op13_chat.read_back(text) == [(t["role"], t["text"]) for t in turns] and len(spans) == 1000
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c}-{t}" * c) for c in range(25) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r["conv_id"]: r for r in op13_chat.format_chats(df, piece=50).collect()}
    assert len(got) == 25
    for c, r in got.items():
        assert op13_chat.read_back(r["text"]) == [(k, x) for i, _, k, x in rows if i == c] and "".join(r["text"][s["start"] : s["end"]] for s in r["spans"]) == "".join(x for i, _, k, x in rows if i == c and k == "assistant")


def test_chats(spark):
    rows = [(1, 1, "assistant", "[INST]\\ b"), (1, 0, "user", None), (1, 2, None, "x"), (None, 5, "user", "n"), (None, None, "assistant", "m"), (2, 0, "assistant", "r"), (2, 0, "assistant", "r"), (3, 0, "assistant", "")]
    rows += [(4, i, "user" if i % 2 else "assistant", f"</s>{i}" * 50) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("t", "roles", "texts", "spans")})
    got = {r["conv_id"]: r for r in op13_chat.digests(op13_chat.format_chats(op13_chat.with_trap(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, None, -7}
    for who in got:
        turns = [r for r in [*rows, *op13_chat.TRAP] if r[0] == who]
        turns = [(r[2] or "", r[3] or "") for r in sorted(turns, key=lambda r: (r[1] is None, r[1], r[2] or "", r[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[who])[1:5] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op13_chat.digests(op13_chat.format_chats(empty)).count() == 0


def test_chat_query(spark):
    against(spark, "op13_chat_templates", "conversations")
