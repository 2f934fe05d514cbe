"""The snapshot store and the chain kept over it, against full builds."""

import json
import random
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftlake.operators import snapshot
from driftlake.sources import git, store
from driftlake.sources.store import ChainStore, SnapshotStore, digests

RAW = "release string, value string, seq int"


def lines(release, constants):
    rows = [json.dumps({"t": "header", "v": 1})] + [json.dumps({"t": "const", "n": n, **c}) for n, c in constants.items()]
    return [(release, v, i) for i, v in enumerate(rows)]


def history(n=5, seed=1):
    rng = random.Random(seed)
    now = {f"c{i}": {"k": "thm", "ar": i % 3, "bi": "d" * (i % 3), "th": f"h{i}"} for i in range(40)}
    out = {}
    for r in range(n):
        now = dict(now)
        for _ in range(6):
            name = rng.choice(sorted(now))
            what = rng.random()
            if what < 0.3:
                now[f"moved{r}{name}"] = now.pop(name)
            elif what < 0.6:
                now.pop(name)
            else:
                now[name] = now[name] | {"th": f"t{rng.random()}"}
        out[f"4.{8 + r}.0"] = now
    return out


def full(spark, every):
    """The chain from all snapshots at once, through joined sides."""
    rows = spark.createDataFrame([(v, n, c["k"], c["ar"], c["bi"], c["th"]) for v, cs in every.items() for n, c in cs.items()], "release string, n string, k string, ar int, bi string, th string")
    pairs = snapshot.version_pairs(rows.select("release").distinct())
    return sorted(map(tuple, snapshot.constants(snapshot.side(rows, pairs, "base"), snapshot.side(rows, pairs, "target")).collect()), key=repr)


def stored(spark, path, every, buckets=4):
    s = SnapshotStore(spark, str(path), buckets)
    s.add(spark.createDataFrame([x for v, c in every.items() for x in lines(v, c)], RAW))
    return s


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_second_run_writes_nothing(spark, tmp_path):
    every = history(3)
    store = stored(spark, tmp_path / "s", every)
    raw = spark.createDataFrame([x for v, c in every.items() for x in lines(v, c)], RAW)
    before = files(tmp_path / "s")
    assert store.add(raw.repartition(3)) == [] and files(tmp_path / "s") == before
    spark.sql(f"DROP TABLE {store.name}")  # a catalog that forgets: the files tell what is there
    again = SnapshotStore(spark, str(tmp_path / "s"), 4)
    assert again.add(raw) == [] and again.rows().count() == sum(map(len, every.values())) and again.partitions() == {tuple(r) for r in digests(raw).collect()}


def test_compare_moves_no_rows(spark, tmp_path):
    store = stored(spark, tmp_path / "s", history(4))
    both = snapshot.paired(store.rows(), spark.createDataFrame([("4.8.0", "4.9.0"), ("4.9.0", "4.10.0")], "base string, target string"))
    plan = both._jdf.queryExecution().executedPlan().toString()
    big, few = plan.split("BroadcastExchange")  # what is broadcast is the one row of hops
    assert "Exchange" not in big and "Bucketed: true" in big and few.count("Exchange") == 1 and "Exchange SinglePartition" in few
    assert both.count() == sum(len(set(history(4)[a]) | set(history(4)[b])) for a, b in (("4.8.0", "4.9.0"), ("4.9.0", "4.10.0")))


def test_changed_lines_replace_a_release(spark, tmp_path):
    every = history(3)
    store = stored(spark, tmp_path / "s", every)
    chain = ChainStore(store, str(tmp_path / "c"))
    assert len(chain.update()[0]) == 2 and chain.update() == ([], [])
    every["4.10.0"] = every["4.10.0"] | {"extra": {"k": "def", "ar": 0, "bi": "", "th": "x"}}
    del every["4.10.0"][next(iter(every["4.10.0"]))]
    new = store.add(spark.createDataFrame(lines("4.10.0", every["4.10.0"]), RAW))
    assert [r["release"] for r in new] == ["4.10.0"] and len(store.partitions()) == 3
    computed, dropped = chain.update()
    assert [h[:2] for h in computed] == [("4.9.0", "4.10.0")] == [h[:2] for h in dropped]
    assert sorted(map(tuple, chain.causes().collect()), key=repr) == full(spark, every)


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [0, 4, 2, 1, 3]])
def test_chain_in_any_order(spark, tmp_path, order):
    every = history(5)
    names = list(every)
    store = SnapshotStore(spark, str(tmp_path / "s"), 4)
    chain = ChainStore(store, str(tmp_path / "c"))
    there = []
    for i in order:
        store.add(spark.createDataFrame(lines(names[i], every[names[i]]), RAW))
        new, old = chain.update()
        beside = [any(j < i for j in there), any(j > i for j in there)]
        assert len(new) == sum(beside) and len(old) == all(beside)
        there.append(i)
    assert sorted(map(tuple, chain.causes().collect()), key=repr) == full(spark, every)
    span = ChainStore(store, str(tmp_path / "e"))
    assert len(span.update(endpoint=True)[0]) == 5


def test_written_twice_is_there_once(spark, tmp_path):
    """A write that is run again, and a hop without causes."""
    same = {"a": {"k": "thm", "ar": 0, "bi": "", "th": "x"}}
    store = stored(spark, tmp_path / "s", {"4.8.0": same, "4.9.0": same})
    rows = store.rows().where("release = '4.8.0'")
    store.replace(spark.createDataFrame(rows.collect(), rows.schema))
    assert store.rows().count() == 2
    chain = ChainStore(store, str(tmp_path / "c"))
    assert len(chain.update()[0]) == 1 and chain.update() == ([], []) and chain.causes().count() == 0


def test_one_scan_gives_what_joined_sides_give(spark):
    every = history(6, seed=4)
    rows = spark.createDataFrame([(v, n, c["k"], c["ar"], c["bi"], c["th"]) for v, cs in every.items() for n, c in cs.items()], "release string, n string, k string, ar int, bi string, th string")
    pairs = snapshot.pairs_of(rows.select("release"), F.col("release"), reverse=True, endpoint=True)
    one = snapshot.chained(rows, pairs, info=True)
    two = snapshot.constants(snapshot.side(rows, pairs, "base"), snapshot.side(rows, pairs, "target"), info=True)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr) and one.count() > 100


def test_blob_store(spark, tmp_path):
    """A file at a commit is read from git once; what was absent is looked for again."""
    repo = str(tmp_path / "r")
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", repo], check=True)
    shas = []
    for i in range(3):
        for k in "ab":
            (tmp_path / "r" / f"{k} x").write_text(f"{k}{i}\n")
        run("add", "-A")
        run("commit", "-qm", f"c{i}")
        shas.append(git.rev_parse(repo, "HEAD"))
    blobs = store.BlobStore(spark, str(tmp_path / "blobs"))
    ask = lambda rows: spark.createDataFrame(rows, "sha string, path string, extra int")
    some = [(shas[0], "a x", 1), (shas[0], "a x", 2), (shas[2], "b x", 1), (None, "a x", 1)]
    want = {(shas[0], "a x"): "a0\n", (shas[2], "b x"): "b2\n"}
    got = lambda df: {(r["sha"], r["path"]): r["text"] for r in df.collect()}
    first = blobs.read(ask(some), repo)
    assert got(first) == want and first.count() == 2
    again = store.BlobStore(spark, str(tmp_path / "blobs"))
    assert got(again.read(ask(some), str(tmp_path / "gone"))) == want  # git isn't asked
    more = [*some, (shas[1], "a x", 1), (shas[1], "none", 1)]
    assert got(again.read(ask(more), repo)) == want | {(shas[1], "a x"): "a1\n", (shas[1], "none"): None}
    with pytest.raises(Exception, match="gone"):
        again.read(ask(more), str(tmp_path / "gone")).collect()
    assert again.table.rows().count() == 3 and again.read(ask([]), repo).count() == 0
