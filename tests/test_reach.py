"""Reachability against a plain walk."""

import random

from driftlake.operators import windows


def walk(parents, tips):
    seen, left = set(), list(tips)
    while left:
        x = left.pop()
        if x not in seen:
            seen.add(x)
            left += parents.get(x, [])
    return seen & set(parents)


def frame(spark, parents):
    return spark.createDataFrame(list(parents.items()), "sha string, parents array<string>")


def rounds(monkeypatch):
    n, plain = [], windows._round
    monkeypatch.setattr(windows, "_round", lambda *a: n.append(1) or plain(*a))
    return n


def test_random_histories(spark):
    rng = random.Random(1)
    parents = {"c0": [], "r": []}
    names = list(parents)
    for i in range(1, 120):
        k = rng.choice([1, 1, 2, 3])
        parents[f"c{i}"] = rng.sample(names[-12:], min(k, len(names[-12:]))) + (["absent"] if i == 40 else [])
        names.append(f"c{i}")
    df = frame(spark, parents)
    for include, exclude in ((["c119", "c80"], ["c100"]), (["r"], [])):
        assert {r[0] for r in windows.reachable(df, include, exclude).collect()} == walk(parents, include) - walk(parents, exclude)


def test_ten_thousand_merges_in_a_row(spark, monkeypatch):
    """Each merge's second parent is the merge before it; its first is a short branch."""
    n = 10_000
    parents = {"root": []} | {f"x{i}": ["root"] for i in range(n)} | {"m0": ["root"]}
    parents |= {f"m{i}": [f"x{i}", f"m{i - 1}"] for i in range(1, n)}
    count = rounds(monkeypatch)
    got = {r[0] for r in windows.reachable(frame(spark, parents), [f"m{n - 1}"], ["m5"]).collect()}
    assert got == walk(parents, [f"m{n - 1}"]) - walk(parents, ["m5"]) and len(count) < 20
