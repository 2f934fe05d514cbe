"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of the whole
text is encoded; gated attention, learnt from document labels alone, weighs
the passages; the score is a logistic function of the weighted sum (Ilse,
Tomczak and Welling 2018). Labels, lang, source and doc_id are no inputs.

The model is fitted with numpy on the driver from at most MAX_LABELLED
labelled documents (the least by md5 of doc_id) outside the held-out fold, and
FIT_PASSAGES passages of each (evenly spaced over the whole text): about 100 MB
at most. Scoring is one pass over all documents, and all their passages,
without a shuffle.

Defined cases: null text is empty text; an empty text is one passage of
zeros; labels that are null, disagree or name no document are left out;
without labels of both kinds the score is the share of label 1 among them
(0.5 if there are none). Extra columns are ignored; equal doc_ids give one
row each, and the fit takes the least of their texts by md5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, gram_starts, grams, slices
from .op5_rules import labelled, repeated

PASSAGE = 64
MAX_LABELLED = 6000
FIT_PASSAGES = 64
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8
_CLASSES = {
    "symbol": "#*$%&|<>", "mark": "!?", "stop": ".,;:", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "quote": "\"'`()[]{}=_/\\^~@", "hyphen": "-",
}
_TABLES = {k: np.isin(np.arange(256), [ord(c) for c in v]) for k, v in _CLASSES.items()}
N_FEATURES = len(_CLASSES) + 10


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and n+1 offsets from documents to passages."""
    w = Words(column)
    n_docs, n_words = len(w.n), len(w.ws)
    doc, h = w.doc(), w.hashes()
    per = np.maximum(1, -(-w.n // PASSAGE))
    ptr = np.concatenate([[0], np.cumsum(per)])
    at = ptr[doc] + (np.arange(n_words) - w.ptr[doc]) // PASSAGE  # each word's passage
    m = int(ptr[-1])
    n = np.bincount(at, minlength=m).astype(float)
    some = np.maximum(n, 1)
    size = (w.we - w.ws).astype(float)

    def total(v: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=v, minlength=m)

    length = total(size)
    cols = []
    for table in _TABLES.values():
        c = np.concatenate([[0], np.cumsum(table[w.data])])
        cols.append(total((c[w.we] - c[w.ws]).astype(float)) / np.maximum(length, 1))
    wide = np.concatenate([[0], np.cumsum(w.data >= 0x80)])
    cols.append(total((wide[w.we] - wide[w.ws]).astype(float)) / np.maximum(length, 1))
    cols.append(length / some / 10)
    cols.append(total((size > 20).astype(float)) / some)
    cols.append(total((size <= 2).astype(float)) / some)
    _, again = repeated(h, at)
    cols.append(total(again.astype(float)) / some)
    cover = np.zeros(n_words + 1)
    ok = np.flatnonzero(gram_starts(w.ptr, 5, n_words))
    twice, _ = repeated(grams(h, 5)[ok], doc[ok])
    np.add.at(cover, ok[twice], 1)
    np.add.at(cover, ok[twice] + 5, -1)
    cols.append(total((np.cumsum(cover[:-1]) > 0).astype(float)) / some)
    brk = np.concatenate([[0], np.cumsum(w.data == 10)])
    gap = np.zeros(n_words)
    if n_words:
        nxt = np.append(w.ws[1:], len(w.data))
        gap = (brk[np.maximum(nxt, w.we)] - brk[w.we]).astype(float)
    cols.append(total(gap) / some)
    caps = _TABLES["upper"][w.data[w.ws]] if n_words else np.zeros(0, bool)
    cols.append(total(caps.astype(float)) / some)
    cols.append(n / PASSAGE)
    cols.append(np.repeat(np.log1p(w.n) / 8, per))
    x = np.stack(cols, 1) if m else np.zeros((0, N_FEATURES))
    x[n == 0] = 0.0
    assert x.shape[1] == N_FEATURES and len(ptr) == n_docs + 1
    return x, ptr


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    prior: float | None = None

    def forward(self, x: np.ndarray, ptr: np.ndarray) -> dict[str, np.ndarray]:
        p, starts, n = self.p, ptr[:-1], np.diff(ptr)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        e = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), n))
        a /= np.repeat(np.add.reduceat(a, starts), n)
        bag = np.add.reduceat(e * a[:, None], starts, axis=0)
        return {"z": z, "e": e, "t": t, "s": s, "a": a, "bag": bag, "out": 1 / (1 + np.exp(-(bag @ p["c"] + p["d"])))}

    def score(self, x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(ptr) - 1, self.prior)
        return self.forward(x, ptr)["out"] if len(ptr) > 1 else np.zeros(0)


def train(x: np.ndarray, ptr: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Model:
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    shapes = {"W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}
    p = {k: rng.normal(0, 0.3, s) if len(s) == 2 else rng.normal(0, 0.1, s) for k, s in shapes.items()}
    p["d"] = np.array(np.log(y.mean() / (1 - y.mean())))
    m = Model(x.mean(0), x.std(0) + 1e-3, p)
    g1, g2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    n = np.diff(ptr)
    for step in range(1, steps + 1):
        f = m.forward(x, ptr)
        err = (f["out"] - y) / len(y)
        dbag = err[:, None] * p["c"]
        de = np.repeat(dbag, n, axis=0) * f["a"][:, None]
        da = (np.repeat(dbag, n, axis=0) * f["e"]).sum(1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, ptr[:-1]), n))  # through the softmax
        dt = da[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = da[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        de += dt @ p["V"].T + ds @ p["U"].T
        dz = de * (1 - f["e"] ** 2)
        grad = {"W": f["z"].T @ dz, "b": dz.sum(0), "V": f["e"].T @ dt, "U": f["e"].T @ ds, "w": ((f["t"] * f["s"]) * da[:, None]).sum(0), "c": f["bag"].T @ err, "d": err.sum()}
        for k in p:
            g = grad[k] + decay * p[k] * (np.ndim(p[k]) > 0)
            g1[k] = 0.9 * g1[k] + 0.1 * g
            g2[k] = 0.99 * g2[k] + 0.01 * g * g
            p[k] = p[k] - rate * (g1[k] / (1 - 0.9**step)) / (np.sqrt(g2[k] / (1 - 0.99**step)) + 1e-8)
    return m


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bags(docs: DataFrame, labels: DataFrame, column: str, most: int) -> pd.DataFrame:
    """doc_id, x (features of its passages) and label of at most ``most`` labelled documents that are not held out."""
    chosen = F.broadcast(labelled(labels.where(~held_out()), column, most))  # ``most`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, ptr = passages(part.column(1))
                at = [np.unique(np.linspace(a, b - 1, min(FIT_PASSAGES, b - a)).astype(int)) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in at])]) * N_FEATURES
                flat = pa.array(x[np.concatenate(at)].astype(np.float32).ravel() if at else np.zeros(0, np.float32))
                name = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.binary()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], ["doc_id", "h", "x"])

    rows = docs.where(~held_out()).join(chosen.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    rows = rows.mapInArrow(run, "doc_id long, h binary, x array<float>").groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("r"))
    return rows.select("doc_id", F.col("r.x").alias("x")).join(chosen, "doc_id").toPandas().sort_values("doc_id")


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MAX_LABELLED) -> Model:
    """Train on at most ``most`` labelled documents that are not held out."""
    found = bags(docs, labels, column, most)
    y = found["label"].to_numpy(float)
    if not len(y):
        return train(np.zeros((0, N_FEATURES)), np.zeros(1, int), y)
    x = [np.asarray(v, float).reshape(-1, N_FEATURES) for v in found["x"]]
    return train(np.concatenate(x), np.concatenate([[0], np.cumsum([len(v) for v in x])]), y)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(*passages(part.column(1))))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
