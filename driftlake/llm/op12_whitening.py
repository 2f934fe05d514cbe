"""Embedding whitening from an exact scatter matrix, by residue numbers.

Entries become integers x = floor(64 * c) + 1000000. ``scatter`` sums the outer
products of the distinct vectors, each with a 1 put in front, so that counts
and sums come with the products. Each task works modulo several primes: the
residues of a block of rows are multiplied as doubles, which is exact while
rows * prime ** 2 stays under 2 ** 53; residues are added in Spark, one row a
(prime, i, j), and the Chinese remainder theorem gives back the exact integers.
There are as many primes as n and the largest entry ask for. The covariance is
(n * products - sums sums') / n ** 2, in integers, rounded once to doubles, and
then taken apart by ``eigh``.

What reaches the driver is primes * dimensions ** 2 / 2 sums, whatever the
number of rows. The identity error is measured, not derived: the whitened
vectors of the fit list are multiplied and added in a second pass.

Defined cases: null vectors, and vectors with null or non-finite entries, are
dropped, and so are vectors of another length than the most frequent one (the
longest of equals); equal vectors are in the fit list once, but each row is
returned; null and repeated ids are rows like others; entries are clamped to
+-2**62 / 64 before they become integers; components whose eigenvalue is 0 to
double precision are left out, so a table without two different vectors gives
no rows; a deviation beyond a long is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import scratch, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Residues are under 2**20, so products of BLOCK rows add up to less than 2**53.
BLOCK = 1 << 13
_BOUND = 1 << 20
_LONG = (1 << 63) - 1


def primes(most: int) -> list[int]:
    """The largest primes under 2**20 whose product is over ``most``."""
    out, product, p = [], 1, _BOUND - 1
    while product <= most:
        if all(p % q for q in range(3, 1025, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def integers(rows: DataFrame, column: str) -> DataFrame:
    """rows with ``x``, the integers of the vector; rows whose vector can't be used are left out."""
    c = F.col(column)
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    most = float(1 << 62)
    x = F.transform(c, lambda e: F.floor(F.greatest(F.least(e.cast("double") * SCALE, F.lit(most)), F.lit(-most))).cast("long") + SHIFT)
    return rows.where(whole).withColumn("x", x)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """The scatter of (1, x) modulo p, upper triangle row by row."""
    r = np.concatenate([np.ones((len(x), 1), np.int64), x % p], 1).astype(float)
    total = np.zeros((r.shape[1],) * 2, np.int64)
    for a in range(0, len(r), BLOCK):
        part = r[a : a + BLOCK]
        total = (total + (part.T @ part).astype(np.int64) % p) % p
    return total[np.triu_indices(len(total))]


def scatter(fit: DataFrame, d: int, n: int, largest: int) -> list[list[int]]:
    """The exact (d+1) x (d+1) scatter of the rows (1, x) of fit, whose entries are at most ``largest`` in size."""
    moduli = primes(2 * max(1, n) * max(1, largest) ** 2)
    pairs = np.stack(np.triu_indices(d + 1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(moduli), len(pairs)), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for k, p in enumerate(moduli):
                sums[k] = (sums[k] + residues(x, p)) % p
        k = np.repeat(np.arange(len(moduli)), len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.tile(np.arange(len(pairs)), len(moduli))), pa.array(sums.ravel())], ["k", "at", "r"])

    got = fit.select("x").mapInArrow(run, "k long, at long, r long").groupBy("k", "at").agg(F.sum("r").alias("r")).toArrow()
    r = np.zeros((len(moduli), len(pairs)), dtype=object)
    for k, at, v in zip(*(got.column(c).to_pylist() for c in ("k", "at", "r")), strict=True):
        r[k, at] = v
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for at, (i, j) in enumerate(pairs.tolist()):
        out[i][j] = out[j][i] = chinese(r[:, at].tolist(), moduli)
    return out


def chinese(rest: list[int], moduli: list[int]) -> int:
    """The integer nearest 0 with these residues (of any multiple of each modulus)."""
    x, product = 0, 1
    for r, p in zip(rest, moduli, strict=True):
        x += product * ((r - x) * pow(product, -1, p) % p)
        product *= p
    return x - product if 2 * x > product else x


@dataclass
class Whitener:
    """x is whitened as (n * x - sums) / n @ directions."""

    n: int
    sums: list[int]
    directions: np.ndarray  # dimensions x components: eigenvectors over the square roots of their eigenvalues
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: in longs where they hold it, else in Python's integers."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most <= _LONG:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def deviation(self, y: np.ndarray) -> pa.Array:
        if y.dtype != object and (int(np.abs(y).max(initial=0)) ** 2) * max(1, y.shape[1]) <= _LONG:
            return pa.array((y * y).sum(1))
        exact = [sum(int(v) ** 2 for v in row) for row in y]
        return pa.array([v if v <= _LONG else None for v in exact], pa.int64())

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y / self.n).astype(float) @ self.directions


def whitener(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitener:
    """Fitted on every row of ``fit`` (x: arrays of d longs, each once)."""
    n, low, high = fit.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    s = scatter(fit, d, n, max(abs(low), abs(high))) if n else [[0] * (d + 1) for _ in range(d + 1)]
    assert s[0][0] == n
    sums = s[0][1:]
    v = np.array([[(n * s[i][j] - s[0][i] * s[0][j]) / max(1, n * n) for j in range(1, d + 1)] for i in range(1, d + 1)], float).reshape(d, d)
    e, u = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
    e, u = e[::-1], u[:, ::-1]
    some = int((e > max(e.max(initial=0), 0) * d * np.finfo(float).eps).sum())
    k = min(components, some)
    return Whitener(n, sums, u[:, :k] / np.sqrt(e[:k]), e[:k] / max(np.trace(v), np.finfo(float).tiny))


def identity_error(fit: DataFrame, model: Whitener, d: int) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, less the identity."""
    k = model.directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = model.project(model.centred(_matrix(batch.column(0), d)))  # centred by the exact mean
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "v"])

    got = fit.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg((F.sum("v") / model.n).alias("v")).collect()
    return max(abs(r["v"] - (r["at"] // k == r["at"] % k)) for r in got)


def lengths(rows: DataFrame) -> int:
    """The most frequent length of x, the longest of equals; 0 without rows."""
    first = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return first["d"] if first else 0


def whiten(rows: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for each usable row and component."""
    kind = rows.schema[key].dataType.simpleString()
    usable = integers(rows.select(F.col(key).alias("key"), F.col(column).alias("v")), "v").select("key", "x")
    d = lengths(usable)
    usable = usable.where(F.size("x") == d)
    with scratch(rows.sparkSession):
        fit = written(usable.select("x").distinct(), "fit")
        model = whitener(fit, d, components)
        k = model.directions.shape[1]
        error = identity_error(fit, model, d) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model.centred(_matrix(batch.column(1), d))
            m = len(y)
            row = pa.array(np.repeat(np.arange(m), k))
            whitened = model.project(y).ravel()
            columns = [batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), model.deviation(y).take(row)]
            columns += [pa.array(whitened), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return (usable if k else usable.where("false")).mapInArrow(run, schema)
