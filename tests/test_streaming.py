"""The exactly-once log and settled diagnostics, against plain replays."""

import datetime
import random

import pytest

from driftlake.sources.readers import term_hits
from driftlake.streaming import log, settle

FILES = "tag string, file string, text string"
HITS = "tag string, file string, line int, targets array<string>, content string"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def hits(df):
    return sorted((r["tag"], r["file"], r["line"], r["content"]) for r in df.collect())


def corpus(n):
    rng = random.Random(n)
    return [(f"t{i}", f"f{j}", "\n".join(rng.choice(["throwError x", "plain", "a throwErrorAt b", ""]) for _ in range(4))) for i in range(n) for j in range(2)]


def test_a_killed_batch_leaves_one_copy(spark, tmp_path, monkeypatch):
    rows = corpus(6)
    for i in range(0, len(rows), 4):
        put(spark, tmp_path / "in", rows[i : i + 4], FILES)
    went = log.commit

    def dies(session, path, epoch):
        if epoch == 1:
            raise RuntimeError("lost after the write")
        went(session, path, epoch)

    args = (spark, str(tmp_path / "in"), FILES, str(tmp_path / "log"), str(tmp_path / "cp"))
    monkeypatch.setattr(log, "commit", dies)
    with pytest.raises(Exception, match="lost after the write"):
        log.scan_stream(*args, files_per_batch=1).awaitTermination(120)
    done = log.committed(spark, str(tmp_path / "log"), HITS)
    assert {r["epoch"] for r in done.select("epoch").distinct().collect()} == {0} and spark.read.parquet(str(tmp_path / "log" / "rows")).select("epoch").distinct().count() == 2
    monkeypatch.setattr(log, "commit", went)
    log.scan_stream(*args, files_per_batch=1).awaitTermination(120)
    log.scan_stream(*args, files_per_batch=1).awaitTermination(120)  # nothing is left to do
    done = log.committed(spark, str(tmp_path / "log"), HITS)
    assert hits(done) == hits(term_hits(spark.createDataFrame(rows, FILES))) and len(hits(done)) > 10
    more = spark.createDataFrame([*rows, ("new", "f", "x")], FILES)
    assert {r["tag"] for r in log.unscanned(more, done).collect()} == {r[0] for r in [*rows, ("new",)]} - {h[0] for h in hits(done)}


def test_an_epoch_is_replaced(spark, tmp_path):
    one = lambda t: spark.createDataFrame([(t, "f", 1, ["x"], "c")], HITS)
    path = str(tmp_path / "log")
    assert log.committed(spark, path, HITS).count() == 0
    for t in ("a", "b"):
        log.put_epoch(one(t), path, 7)
    one("half").write.parquet(f"{path}/rows/epoch=8")  # written, not committed
    assert [(r["tag"], r["epoch"]) for r in log.committed(spark, path, HITS).collect()] == [("b", 7)]


START = datetime.datetime(2024, 1, 1)
EVENT = "uri string, ts timestamp, diagnostics array<string>"


def replay(batches, quiet, late):
    """Rows that settle, by taking what is not late in order of time. A batch's rows are late by the watermark that the batch before it worked with."""
    taken, before, mark, most = [], -1, -1, 0
    for batch in batches:
        taken += [e for e in batch if e[1] > before]
        most = max([most, *(e[1] for e in batch)])
        before, mark = mark, max(mark, (most - late) // 1000 * 1000)
    out = []
    for uri in {e[0] for e in taken}:
        state = None
        for _, ts, found in sorted((e for e in taken if e[0] == uri and e[1] < mark), key=lambda e: (e[1], sorted(e[2] or []))):
            found = sorted(found or [])
            if state and not state[2] and state[0] + quiet < ts:
                out.append((uri, state[0], state[1], state[3]))
                state[2] = True
            if state is None or state[3] != found:
                state = [ts, 1, False, found]
            else:
                state[1] += not state[2]
        if state and not state[2] and state[0] + quiet < mark:
            out.append((uri, state[0], state[1], state[3]))
    return sorted(out)


def run(spark, tmp_path, batches, **args):
    for batch in batches:
        put(spark, tmp_path / "in", [(u, START + datetime.timedelta(microseconds=ts), d) for u, ts, d in batch], EVENT)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = settle.settled(stream, **args).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(300)
    zero = lambda t: round((t - START).total_seconds() * 1e6)
    return sorted((r["uri"], zero(r["since"]), r["n"], r["diagnostics"]) for r in spark.read.schema(settle.SETTLED).parquet(str(tmp_path / "out")).collect())


def test_settled(spark, tmp_path):
    s = 1_000_000
    batches = [
        [("a", 0, ["x"]), ("a", 1 * s, ["x"]), ("b", 0, ["p"]), ("c", 0, None)],  # a: published again, equal: the clock runs on
        [("a", 2 * s, ["x", "y"]), ("b", 1 * s, ["q"]), ("b", 1_400_000, ["q", "p"]), ("a", 1_200_000, ["x"])],
        [("b", 2 * s, ["p", "q"]), ("b", 9 * s, ["r"]), ("z", 40 * s, [])],
        [("z", 80 * s, ["end"])],
        [("b", 3 * s, ["late"]), ("z", 81 * s, ["end"])],
    ]
    got = run(spark, tmp_path, batches, late="10 seconds")
    assert got == replay(batches, settle.QUIET, 10 * s)
    assert [(r[0], r[1], r[2]) for r in got] == [("a", 0, 3), ("a", 2 * s, 1), ("b", 1_400_000, 2), ("b", 9 * s, 1), ("c", 0, 1), ("z", 40 * s, 1)]


def test_settled_random(spark, tmp_path):
    rng = random.Random(3)
    now, batches = 0, []
    for _ in range(4):
        batch = []
        for _ in range(40):
            now += rng.choice([0, 100_000, 700_000, 2_000_000])
            batch.append((rng.choice("uvw"), max(0, now - rng.choice([0, 0, 0, 900_000, 9_000_000])), rng.choice([["a"], ["b", "a"], ["a", "b"], []])))
        batches.append(batch)
    batches.append([("end", now + 60_000_000, ["x"])])
    got = run(spark, tmp_path, batches, late="3 seconds")
    assert got == replay(batches, settle.QUIET, 3_000_000) and len(got) > 10
