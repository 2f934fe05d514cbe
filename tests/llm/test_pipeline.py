"""The pipeline's stages against brute force, each on its own input."""

import os
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from driftlake.llm import op5_rules
from driftlake.llm._spark import written

from .test_ops import brute_counts, brute_near, brute_rules, words

SF = "/root/testdata/sf0.001"


def brute_targets(size):
    """Words wanted of each source: 150 % of all by weights 3, 1, 2, repeating; nothing above twice a source's size."""
    order, want, open_ = sorted(size), {}, sorted(size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left = 1.5 * sum(size.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if rate * weight[s] >= 2 * size[s]]
        for s in over or open_:
            want[s] = 2 * size[s] if over else rate * weight[s]
            left -= want[s]
        open_ = [s for s in open_ if s not in want]
    return want


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = written(stage(spark, docs, SF), name)
        after = docs.collect()
        if i < 4:
            assert docs.columns == columns
        texts, ids = {r["doc_id"]: r["text"] for r in before}, {r["doc_id"] for r in after}
        if name == "quality_rules":
            lab = spark.read.parquet(f"{SF}/labels.parquet")
            full = spark.read.parquet(f"{SF}/documents.parquet")
            rules = op5_rules.fit(full, lab)
            counts = {r["doc_id"]: r.asDict() for r in op5_rules.statistics(full).collect()}
            base = {k for k, t in texts.items() if (n := brute_counts(t))[0] >= 10 and 100 * n[4] <= 20 * n[0]}
            assert ids == {k for k in base if brute_rules(rules, counts[k])} and (rules or ids == base)
        elif name == "exact_dedup":
            first = {}
            for k in sorted(texts):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[k]), k)
            assert ids == set(first.values()) and len(after) == len(ids)
        elif name == "near_dedup":
            assert ids == {k for k, (_, c) in brute_near(texts, 5).items() if c == k}
        elif name == "mixing":
            got, size, sources = Counter(r["doc_id"] for r in after), {}, {r["doc_id"]: r["source"] for r in before}
            assert all(r["text"] == texts[r["doc_id"]] for r in after)
            for k, t in texts.items():
                size[sources[k]] = size.get(sources[k], 0) + len(words(t))
            want = brute_targets(size)
            for k, t in texts.items():
                rate = want[sources[k]] / size[sources[k]]
                assert got[k] in (int(rate + 1e-9), int(rate + 1e-9) + 1) and got[k] <= 2
            for s in size:
                mine = [k for k in texts if sources[k] == s]
                assert abs(sum(got[k] * len(words(texts[k])) for k in mine) - want[s]) <= max(len(words(texts[k])) for k in mine) / 2 + 1
        else:
            assert len(after) == len(before) and all(r["round_trip"] for r in after)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_exact_dedup_without_a_shared_warehouse(spark, monkeypatch):
    """The stage runs on a cluster that shares the checkpoint folder alone, and keeps what it keeps elsewhere."""
    docs, stage = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)["exact_dedup"]
    kept, get = sorted(map(str, stage(spark, docs, SF).collect())), type(spark.conf).get
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: f"file:{os.getcwd()}/spark-warehouse" if key == "spark.sql.warehouse.dir" else get(self, key, *a))
    assert sorted(map(str, stage(spark, docs, SF).collect())) == kept


def test_clashing_columns(spark):
    """Columns named like the stages' own ones come through unchanged; null ids and texts, and ids beyond 2**53, too."""
    say = lambda i: " ".join(f"{w}{i}" for w in "alpha beta gamma delta one two three four five six seven eight".split())
    rows = [(2**60 + i, say(i), "en", f"s{i % 2}", 1) for i in range(8)] + [(7, say(0), "en", "s0", 1), (None, say(9), None, None, None), (None, None, None, None, None), (8, "", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = "c0 c5 _size size _copies _id _n _copy _same copies digest _digest _keep keep_id n_words _n_words n_symbols _row kept component_id rep band no_id".split()
    docs = written(docs.select("*", *[F.lit(5).alias(c) for c in extra]), "clash")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns, name
        assert all(r[c] == 5 for r in got for c in extra), name
        texts = {(r["doc_id"], r["text"]) for r in got}
        assert texts <= {r[:2] for r in rows}, name
        if name in ("exact_dedup", "near_dedup"):
            assert {(2**60 + i, say(i)) for i in range(1, 8)} | {(7, say(0))} <= texts and (2**60, say(0)) not in texts, name
