"""Message templates: greedy induction within buckets, assignment, purity."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..session import kept

# Share of literals that must match, and the widest hole in tokens.
THETA = 0.72
WIDEST = 8
HOLE = "\u0000"
_TOKEN = re.compile(X.PROSE_TOKEN)
TEMPLATE = "bucket string, template_id long, template string, hole_kinds array<string>, tokens array<string>, n long"


def hole_kind(values: Iterable[str]) -> str:
    v = [x.strip("`") for x in (y.strip() for y in values) if x]
    if not v:
        return "opaque"
    if all(re.fullmatch(r"-?\d+", x) for x in v):
        return "numeral"
    if all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.'!?‹›]*", x) for x in v):
        return "type" if all(x[:1].isupper() for x in v) else "ident"
    if all(x.endswith(".lean") or "/" in x for x in v):
        return "path"
    return "term" if any(len(x) > 60 or "\n" in x for x in v) else "opaque"


def _form(value: str) -> str:
    """What hole_kind asks of a value: values of one form are worth one."""
    v = value.strip()
    if not v:
        return ""
    first = v.strip("`")[:1]
    return f"{hole_kind([v])}{first.isupper()}{first.isalpha()}{len(v.strip('`')) > 60 or chr(10) in v}{'/' in v or v.strip('`').endswith('.lean')}"


def _kept(values: Iterable[str]) -> list[str]:
    """The first value of each form: a hole stays small however many messages it has seen, and keeps its kind."""
    return list({_form(v): v for v in reversed(list(values))}.values())


class Template:
    """Items are [literal] or [HOLE, value, ...]."""

    def __init__(self, tokens: list[str], items: list[list[str]] | None = None, n: int = 1):
        self.items: list[list[str]] = [[t] for t in tokens] if items is None else items
        self.n = n
        self.literals = Counter(i[0] for i in self.items if i[0] != HOLE)

    def heads(self) -> list[str]:
        return [i[0] for i in self.items]

    def absorb(self, tokens: list[str], theta: float = THETA, widest: int = WIDEST, counts: Counter | None = None) -> bool:
        """Take in a message if enough literals match and no gap is too wide: gaps on either side become one hole.

        No more literals can match in order than the two have in common, so most templates are passed over by counts alone.
        """
        return self.merge(Template(tokens), theta, widest, counts)

    def merge(self, other: Template, theta: float = THETA, widest: int = WIDEST, counts: Counter | None = None) -> bool:
        """Take in another template: a hole matches a hole, and what stands in a gap goes into the hole there."""
        common = (self.literals & (other.literals if counts is None else counts)).total()
        if self.literals and common / self.literals.total() < theta:
            return False
        heads = self.heads()
        blocks = difflib.SequenceMatcher(None, heads, other.heads(), autojunk=False).get_matching_blocks()
        literals = sum(h != HOLE for h in heads)
        if literals and sum(h != HOLE for b in blocks for h in heads[b.a : b.a + b.size]) / literals < theta:
            return False
        out: list[list[str]] = []
        i = j = 0
        for b in blocks:
            mine, theirs = self.items[i : b.a], other.items[j : b.b]
            if max(len(mine), len(theirs)) > widest:
                return False
            if mine or theirs:
                said = " ".join(item[0] for item in theirs if item[0] != HOLE)
                out.append([HOLE, *_kept([*(v for item in [*mine, *theirs] if item[0] == HOLE for v in item[1:]), *([said] if said else [])])])
            out += [[HOLE, *_kept([*x[1:], *y[1:]])] if x[0] == HOLE else x for x, y in zip(self.items[b.a : b.a + b.size], other.items[b.b : b.b + b.size], strict=True)]
            i, j = b.a + b.size, b.b + b.size
        if all(item[0] == HOLE for item in out):
            return False
        self.items, self.n = out, self.n + other.n
        self.literals = Counter(item[0] for item in out if item[0] != HOLE)
        return True

    def render(self) -> tuple[str, list[str]]:
        words, kinds = [], []
        for item in self.items:
            words.append(f"{{{len(kinds)}}}" if item[0] == HOLE else item[0])
            if item[0] == HOLE:
                kinds.append(hole_kind(item[1:]))
        return " ".join(words), kinds


def induce(messages: Iterable[list[str]]) -> list[Template]:
    """Templates of one bucket, from messages in their order."""
    out: list[Template] = []
    for tokens in messages:
        counts = Counter(tokens)
        if not any(t.absorb(tokens, counts=counts) for t in out):
            out.append(Template(tokens))
    return out


def prepared(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with head, payload, trailers, shape, tokens and bucket; rows: severity, error_name and text."""
    m = X.split_message(X.scrub(F.coalesce(F.col(text), F.lit(""))))
    r = rows.withColumn("_m", m).select("*", "_m.head", F.array_sort(F.array_distinct("_m.trailers")).alias("trailers"), X.payload_shape(F.col("_m.payload")).alias("shape")).drop("_m")
    r = r.withColumn("tokens", X.prose_tokens(F.col("head")))
    return r.withColumn("bucket", X.bucket_key(F.col("severity"), F.col("error_name"), F.col("tokens")))


#: Different messages that one leaf induces templates from, partial sets that are merged at once, and tokens of the templates that a task holds.
LEAF, FAN, ROOM = 4096, 16, 1 << 19
_TEXTS = pa.list_(pa.string())
_PART = "bucket string, node long, from long, seq long, base long, n long, heads array<string>, holes array<array<string>>, done boolean"
_PART_ARROW = pa.schema([("bucket", pa.string()), *[(c, pa.int64()) for c in ("node", "from", "seq", "base", "n")], ("heads", _TEXTS), ("holes", pa.list_(_TEXTS)), ("done", pa.bool_())])
_TEMPLATE_ARROW = pa.schema([("bucket", pa.string()), ("template_id", pa.int64()), ("template", pa.string()), ("hole_kinds", _TEXTS), ("tokens", _TEXTS), ("n", pa.int64())])
#: Rows that become Python values at once, and tokens of rows that are written at once.
_SLICE, _OUT = 64, 1 << 16


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, _SLICE):
            yield from batch.slice(i, _SLICE).to_pylist()


def _written(rows: Iterable[dict], schema: pa.Schema, sized: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows, as few at once as the tokens in ``sized`` ask for."""
    held: list[dict] = []
    size = 0
    for r in rows:
        held.append(r)
        size += 8 + len(r[sized])
        if size > _OUT:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _read(heads: list[str], holes: list[list[str]], n: int) -> Template:
    """A template of its heads and the values of each hole in turn; a message's own NUL has none."""
    values = iter(holes)
    return Template([], [[h, *next(values, [])] if h == HOLE else [h] for h in heads], n)


def _settled(batches: Iterable[pa.RecordBatch], room: int) -> Iterator[dict]:
    """Templates of each (bucket, node), from templates sorted by it and by their order: each is taken in by the first that can, or stands for itself.

    Once those that stand have ``room`` tokens, what none of them takes in is given
    back open, in its order, for a next round; the templates are those that one
    list of any length would hold, since a later one never changes an earlier.
    """
    key, out, size, full = None, [], 0, False

    def closed() -> Iterator[dict]:
        for i, t in enumerate(out):
            yield {"bucket": key[0], "node": key[1], "from": 0, "seq": key[2] + i, "base": 0, "n": t.n, "heads": t.heads(), "holes": [x[1:] for x in t.items if x[0] == HOLE], "done": True}

    for r in _rows(batches):
        if (r["bucket"], r["node"], r["base"]) != key:
            yield from closed()
            key, out, size, full = (r["bucket"], r["node"], r["base"]), [], 0, False
        t = _read(r["heads"], r["holes"], r["n"])
        if any(o.merge(t) for o in out):
            continue
        full = full or bool(out) and size + len(t.items) > room
        if not full:
            out.append(t)
            size += len(t.items)
        else:
            yield {**r, "base": key[2] + len(out), "done": False}
    yield from closed()


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "node").sortWithinPartitions("bucket", "node", "from", "seq")


def fit(messages: DataFrame, order: str = "seq") -> DataFrame:
    """Templates of all buckets. Equal messages are counted first, so a bucket holds its different messages only; the longest head is taken first, then by ``order``.

    A bucket of more than LEAF messages is dealt out to leaves by a hash of the
    message, each induces its own templates, and sets of templates are merged
    FAN at a time, in order of their leaves, until one is left. So the result
    depends on the messages alone. Tasks read sorted rows in a stream and hold
    the templates of one leaf or node, ROOM tokens at most: sets that don't
    shrink take more rounds, not more memory.
    """
    distinct = messages.groupBy("bucket", "tokens").agg(F.min(order).alias("seq"), F.max(F.length("head")).alias("len"))
    distinct = kept(distinct, "messages")
    sizes = distinct.groupBy("bucket").agg(F.ceil(F.count("*") / LEAF).alias("_leaves"), F.sum(F.size("tokens")).alias("_tokens")).withColumnRenamed("bucket", "_b")
    most, heavy = sizes.agg(F.max("_leaves"), F.max("_tokens")).first()
    most, heavy, room = most or 1, (heavy or 0) > ROOM, ROOM
    node = F.lit(0)
    if most > 1:
        distinct = distinct.join(sizes, F.col("bucket").eqNullSafe(F.col("_b")))
        node = F.pmod(F.xxhash64("tokens"), F.col("_leaves"))
    none = F.array().cast("array<array<string>>")
    sets = distinct.select("bucket", node.cast("long").alias("node"), (-F.col("len")).cast("long").alias("from"), F.col("seq").cast("long").alias("seq"), F.lit(0).cast("long").alias("base"), F.lit(1).cast("long").alias("n"), F.col("tokens").alias("heads"), none.alias("holes"))

    def part(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from _written(_settled(batches, room), _PART_ARROW, "heads")

    def _shown(rows: Iterable[dict]) -> Iterator[dict]:
        for r in rows:
            template, kinds = _read(r["heads"], r["holes"], r["n"]).render()
            yield {"bucket": r["bucket"], "template_id": r["seq"], "template": template, "hole_kinds": kinds, "tokens": r["heads"], "n": r["n"]}

    def shown(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from _written(_shown(_rows(batches)), _TEMPLATE_ARROW, "tokens")

    def both(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from _written(_shown(_settled(batches, room)), _TEMPLATE_ARROW, "tokens")

    if most == 1 and not heavy:
        return _ordered(sets).mapInArrow(both, TEMPLATE)
    while True:
        sets = _rounds(sets, part, heavy)
        if most == 1:
            return sets.mapInArrow(shown, TEMPLATE)
        sets = sets.withColumn("from", F.col("node")).withColumn("node", F.floor(F.col("node") / FAN).cast("long")).drop("done")
        most = -(-most // FAN)


def _rounds(sets: DataFrame, part: Callable, heavy: bool) -> DataFrame:
    """Every node's templates: rounds over what is still open, until nothing is."""
    done = []
    while True:
        found = kept(_ordered(sets).mapInArrow(part, _PART), "templates")
        done.append(found.where("done"))
        sets = found.where("not done").drop("done")
        if not heavy or sets.isEmpty():
            return reduce(DataFrame.unionAll, done)


def assign(messages: DataFrame, templates: DataFrame, key: str = "seq") -> DataFrame:
    """For each message the template of its bucket with the best ratio of at least THETA (the first among equals), else itself.

    A task reads a bucket's templates and then streams its messages past them.
    A bucket whose templates have more than ROOM tokens is cut into pieces of
    about that: its messages go to each, and the best of their answers counts.
    """
    templates = kept(templates, "templates")
    sizes = templates.groupBy(F.col("bucket").alias("_b")).agg(F.ceil(F.sum(F.size("tokens")) / ROOM).alias("_pieces"))
    most = sizes.agg(F.max("_pieces")).first()[0] or 1
    m, t = messages.select(F.col(key).alias("key"), "bucket", "tokens"), templates
    if most > 1:
        m = kept(m.withColumn("row", F.monotonically_increasing_id()), "messages")
        cut = lambda d: d.join(sizes, F.col("bucket").eqNullSafe(F.col("_b")), "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
        m = cut(m).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_pieces").cast("int") - 1)))
        t = cut(t).withColumn("piece", F.pmod("template_id", "_pieces").cast("int"))
    else:
        m, t = m.withColumns({"row": F.lit(0).cast("long"), "piece": F.lit(0)}), t.withColumn("piece", F.lit(0))
    kind = messages.schema[key].dataType
    none = F.array().cast("array<string>")
    m = m.select("bucket", "piece", "row", "key", F.lit(-1).cast("long").alias("template_id"), F.lit("").alias("template"), none.alias("hole_kinds"), "tokens", F.xxhash64("tokens").alias("place"))
    t = t.select("bucket", "piece", F.lit(0).cast("long").alias("row"), F.lit(None).cast(kind).alias("key"), "template_id", "template", "hole_kinds", "tokens", F.col("template_id").alias("place"))
    both = m.unionByName(t).withColumn("said", F.col("template_id") < 0)
    both = both.repartition("bucket", "piece").sortWithinPartitions("bucket", "piece", "said", "place")
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, kind)] + [T.StructField(c, T.StringType()) for c in ("bucket", "template")] + [T.StructField("template_id", T.LongType()), T.StructField("hole_kinds", T.ArrayType(T.StringType())), T.StructField("ratio", T.DoubleType())])
    schema = to_arrow_schema(out)

    def answers(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        at, each, last, got = None, [], None, ()
        for r in _rows(batches):
            if (r["bucket"], r["piece"]) != at:
                at, each, last = (r["bucket"], r["piece"]), [], None
            if not r["said"]:
                heads = [h for h in r["tokens"] if h != HOLE]
                each.append((r["template_id"], r["template"], r["hole_kinds"], heads, Counter(heads)))
                continue
            if r["tokens"] != last:
                last = r["tokens"]
                best, got = THETA, (-1, " ".join(last), [], 0.0)
                counts = Counter(last)
                for i, tpl, kinds, heads, own in each:
                    size = len(heads) + len(last)
                    if size and 2 * (own & counts).total() / size < best:  # the ratio's upper bound
                        continue
                    ratio = difflib.SequenceMatcher(None, heads, last, autojunk=False).ratio()
                    if ratio > best or (ratio == best and got[0] < 0):
                        best, got = ratio, (i, tpl, kinds, ratio)
            yield {"row": r["row"], key: r["key"], "bucket": r["bucket"], **dict(zip(("template_id", "template", "hole_kinds", "ratio"), got, strict=True))}

    def one(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from _written(answers(batches), schema, "template")

    found = both.mapInArrow(one, out)
    names = [key, "bucket", "template_id", "template", "hole_kinds", "ratio"]
    if most > 1:
        first = F.struct(F.col("ratio"), -F.col("template_id"))  # the best ratio, then the first template
        found = found.groupBy("row").agg(F.max_by(F.struct(*names), first).alias("r")).select("r.*")
    return found.select(*names)


def listing(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("template").count().orderBy(F.desc("count"), "template")


def purity(rows: DataFrame, template: str = "template", name: str = "error_name") -> DataFrame:
    """labelled rows, distinct names, names split over templates, templates with several names."""
    labelled = rows.where(F.nullif(F.col(name), F.lit("")).isNotNull())
    by_name = labelled.groupBy(name).agg(F.countDistinct(template).alias("k"), F.count("*").alias("n")).agg(F.sum("n").alias("labelled"), F.count("*").alias("names"), F.count_if(F.col("k") > 1).alias("names_split"))
    by_template = labelled.groupBy(template).agg(F.countDistinct(name).alias("k")).agg(F.count_if(F.col("k") > 1).alias("templates_mixed"))
    return by_name.crossJoin(by_template)  # one row each
