"""Many patterns searched in many texts, by automata built from the pattern table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from .. import vocab

#: Bytes of patterns (with what goes with them) in one automaton; a larger table is searched in several passes over the texts.
PIECE = 4 << 20
#: Bytes of text in one batch of what is found.
OUT = 4 << 20
_IN_NAME = re.compile(f"[{vocab.IDENT}]")
_built: dict[str, tuple[ahocorasick.Automaton, pa.Table]] = {}


def _automaton(name: str, shared: Broadcast, column: str) -> tuple[ahocorasick.Automaton, pa.Table]:
    """The automaton of a piece, built once a worker process: each pattern leads to its rows."""
    if name not in _built:
        _built.clear()
        with pa.ipc.open_stream(shared.value) as r:
            table = r.read_all()
        rows: dict[str, list[int]] = {}
        for i, p in enumerate(table.column(column).to_pylist()):
            rows.setdefault(p, []).append(i)
        a = ahocorasick.Automaton()
        for p, own in rows.items():
            a.add_word(p, (len(p), own))
        a.make_automaton()
        _built[name] = a, table
    return _built[name]


def found(text: str, automaton: ahocorasick.Automaton, whole: bool) -> list[int]:
    """Rows of the patterns that occur in text; ``whole``: not inside a longer identifier."""
    out: set[int] = set()
    seen: set[int] = set()  # patterns by their rows' first
    for end, (n, rows) in automaton.iter(text):
        if rows[0] in seen:
            continue
        if whole and (end + 1 < len(text) and _IN_NAME.match(text[end + 1]) or end >= n and _IN_NAME.match(text[end - n])):
            continue
        seen.add(rows[0])
        out.update(rows)
    return sorted(out)


def matched(files: DataFrame, patterns: DataFrame, pattern: str, text: str = "text", whole: bool = False) -> DataFrame:
    """Rows of files joined to those of patterns whose column ``pattern`` occurs in ``text``.

    Patterns are cut by a hash into pieces of about half of PIECE bytes, which
    is what is broadcast at once; each piece is one pass over the texts, whose
    time doesn't grow with the number of patterns in it. Null and empty
    patterns and null texts match nothing. Columns of both sides must differ in
    name.
    """
    spark = files.sparkSession
    p = patterns.where(F.length(pattern) > 0)
    weight = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, t in patterns.dtypes if t == "string"), F.lit(8 * len(patterns.columns)))
    total = p.agg(F.sum(weight)).first()[0] or 0
    pieces = max(1, -(-2 * int(total) // PIECE))
    schema = to_arrow_schema(files.schema), to_arrow_schema(patterns.schema)
    spark_schema = from_arrow_schema(pa.schema([*schema[0], *schema[1]]))
    at = files.columns.index(text)
    slot = F.pmod(F.xxhash64(pattern), F.lit(pieces))  # equal patterns share a piece

    def piece(k: int) -> DataFrame:
        table = p.where(slot == k).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        name = uuid.uuid4().hex
        shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, rules = _automaton(name, shared, pattern)
            for batch in batches:
                if not len(automaton):
                    continue
                left: list[int] = []
                right: list[int] = []
                size = 0
                for i in range(batch.num_rows):
                    t = batch.column(at)[i].as_py()  # one text at a time
                    for k in found(t, automaton, whole) if t else []:
                        left.append(i)
                        right.append(k)
                        size += len(t)
                        if size > OUT:
                            yield _taken(batch, rules, left, right)
                            left, right, size = [], [], 0
                if left:
                    yield _taken(batch, rules, left, right)

        return files.mapInArrow(run, spark_schema)

    return reduce(DataFrame.unionAll, [piece(k) for k in range(pieces)])


def _taken(batch: pa.RecordBatch, rules: pa.Table, left: list[int], right: list[int]) -> pa.RecordBatch:
    a = batch.take(pa.array(np.array(left, np.int64)))
    b = rules.take(pa.array(np.array(right, np.int64))).combine_chunks()
    columns = [*a.columns, *[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in b.columns]]
    return pa.RecordBatch.from_arrays(columns, [*a.schema.names, *b.schema.names])
