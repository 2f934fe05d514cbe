"""Snapshot diffs: keyed null-safe compare of many release pairs at once, set differences, renames, and roll-ups of causes.

All frames of one side carry the pair columns ``base`` and ``target`` (see
``pairs_of``), so a whole chain is one plan whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import version

PAIR = ["base", "target"]
CAUSE_COLUMNS = ["base", "target", "cause", "name", "detail", "class", "sev"]


def pairs_of(releases: DataFrame, order: Column, column: str = "release", reverse: bool = False, endpoint: bool = False) -> DataFrame:
    """base and target of adjacent releases; ``reverse`` adds them swapped, ``endpoint`` first to last if there are more than two. Releases are few."""
    w = Window.orderBy(order)
    r = releases.select(column).distinct().withColumn("target", F.lead(column).over(w)).withColumnRenamed(column, "base")
    out = r.where("target is not null").withColumn("kind", F.lit("hop"))
    if reverse:
        out = out.unionByName(out.select(F.col("target").alias("base"), F.col("base").alias("target"), F.lit("back").alias("kind")))
    if endpoint:
        ends = releases.select(column).distinct().agg(F.min_by(column, order).alias("base"), F.max_by(column, order).alias("target"), F.count("*").alias("n")).where("n > 2")
        out = out.unionByName(ends.select("base", "target", F.lit("span").alias("kind")))
    return out


def version_pairs(versions: DataFrame) -> DataFrame:
    return pairs_of(versions, version(F.col("release")))


def side(rows: DataFrame, pairs: DataFrame, which: str, column: str = "release") -> DataFrame:
    """Rows of the base or target release of every pair. pairs has one row a hop, bounded by the number of releases."""
    p = pairs.select(*PAIR)
    return rows.join(F.broadcast(p), rows[column] == p[which]).drop(rows[column])


def _cause(cond: Column, cause: str, detail: Column) -> Column:
    return F.when(cond, F.struct(F.lit(cause).alias("cause"), detail.cast("string").alias("detail"), F.lit("break").alias("sev")))


def _arrow(a: Column, b: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.concat(text(a), F.lit(" -> "), text(b))


def _only(new: DataFrame) -> DataFrame:
    """base, target, th, ar and the new name that alone has them."""
    return new.groupBy(*PAIR, "th", "ar").agg(F.count("*").alias("n_new"), F.min("n").alias("to")).where("n_new = 1").drop("n_new")


def renames(gone: DataFrame, new: DataFrame) -> DataFrame:
    """For names that are gone: the one new name with their type hash and arity, if it is the only one. Base names may share it (claimants)."""
    found = gone.join(_only(new), [*PAIR, "th", "ar"])
    return found.withColumn("claimants", F.count("*").over(Window.partitionBy(*PAIR, "to")))


FIELDS = ("k", "ar", "bi", "th", "u", "cls", "prot", "red", "fields", "ctors")


def paired(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """base, target, n, and b and t (structs of the constant's fields, or null) for each pair of releases and each name that either has.

    rows: snapshots of all releases, a name once each. They are gathered by
    name, so every hop comes from one scan and at most one shuffle, and from
    none where rows are bucketed by name. A name has a record a release, a
    release is in few pairs: both are bounded by the number of releases.
    """
    have = [c for c in FIELDS if c in rows.columns]
    p = pairs.select(*PAIR).agg(F.collect_list(F.struct(*PAIR)).alias("p"))  # one row
    g = rows.where("n is not null").groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct(F.col("release"), F.struct(*have).alias("r")))).alias("m"))
    either = F.filter("p", lambda x: F.map_contains_key("m", x["base"]) | F.map_contains_key("m", x["target"]))
    g = g.crossJoin(F.broadcast(p)).select("n", "m", F.explode(either).alias("p"))
    return g.select("p.base", "p.target", "n", F.try_element_at("m", F.col("p.base")).alias("b"), F.try_element_at("m", F.col("p.target")).alias("t"))


def judged(both: DataFrame, info: bool = False) -> DataFrame:
    """Causes of compared constants (see ``paired``); with ``info`` new names too."""
    have = both.schema["b"].dataType.names
    ne = lambda c: ~F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")) if c in have else F.lit(False)
    show = lambda c: _arrow(F.col(f"b.{c}"), F.col(f"t.{c}"))
    shape_same = ~ne("ar") & ~ne("bi") & ~ne("u")
    tests = [("k", "const.kind-changed", ne("k")), ("ar", "const.arity-changed", ne("ar")), ("bi", "const.binders-changed", ~ne("ar") & ne("bi")), ("u", "const.universes-changed", ne("u")), ("th", "const.type-changed", ne("th") & shape_same)]
    tests += [(c, f"const.{name}-changed", ne(c)) for c, name in (("cls", "class"), ("prot", "protected"), ("red", "reducibility"), ("fields", "fields"), ("ctors", "ctors"))]
    found = F.array(*[_cause(cond, cause, show(c) if c not in ("fields", "ctors") else F.array_join(f"t.{c}", ",")) for c, cause, cond in tests if c in have])
    changed = both.where("b is not null and t is not null").select(*PAIR, "n", F.explode(F.array_compact(found)).alias("c")).select(*PAIR, F.col("n").alias("name"), "c.*")
    gone = both.where("t is null").select(*PAIR, "n", "b.th", "b.ar")
    new = both.where("b is null").select(*PAIR, "n", "t.th", "t.ar")
    lost = gone.join(_only(new), [*PAIR, "th", "ar"], "left").select(*PAIR, F.col("n").alias("name"), F.when(F.col("to").isNull(), "const.absent").otherwise("const.renamed").alias("cause"), F.col("to").cast("string").alias("detail"), F.lit("break").alias("sev"))
    out = changed.unionByName(lost)
    if info:
        out = out.unionByName(new.select(*PAIR, F.col("n").alias("name"), F.lit("const.new").alias("cause"), F.lit(None).cast("string").alias("detail"), F.lit("info").alias("sev")))
    return classed(out)


def chained(rows: DataFrame, pairs: DataFrame, info: bool = False) -> DataFrame:
    """Causes of all pairs from snapshots of all releases (release, n and fields)."""
    return judged(paired(rows, pairs), info)


def constants(base: DataFrame, target: DataFrame, info: bool = False) -> DataFrame:
    """Causes between constants (n, k, ar, bi, th and, where present, u, cls, prot, red, fields, ctors) of all pairs, where the sides come from different places."""
    have = [c for c in FIELDS if c in base.columns]
    b, t = (d.select(*PAIR, "n", F.struct(*have).alias(name)) for d, name in ((base, "b"), (target, "t")))
    return judged(b.join(t, [*PAIR, "n"], "full_outer"), info)


def classed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("class", vocab.lookup(vocab.CAUSES, F.col("cause"), vocab.UNCLASSIFIED)).select(*PAIR, "cause", "name", "detail", "class", "sev")


def elements(base: DataFrame, target: DataFrame, cause: str, info: bool = False) -> DataFrame:
    """Names in base that target lacks; with ``info`` the reverse too, as information."""
    row = lambda d, c, s: d.select(*PAIR, F.col("n").alias("name"), F.lit(c).alias("cause"), F.lit(None).cast("string").alias("detail"), F.lit(s).alias("sev"))
    b, t = base.select(*PAIR, "n").distinct(), target.select(*PAIR, "n").distinct()
    out = row(b.join(t, [*PAIR, "n"], "left_anti"), cause, "break")
    return classed(out.unionByName(row(t.join(b, [*PAIR, "n"], "left_anti"), f"{cause}.reverse", "info")) if info else out)


def valued(base: DataFrame, target: DataFrame, value: str, absent: str, changed: str) -> DataFrame:
    """Names that are gone, and names whose value differs (null-safe)."""
    b = base.select(*PAIR, "n", F.struct(value).alias("b"))
    j = b.join(target.select(*PAIR, "n", F.struct(value).alias("t")), [*PAIR, "n"], "left")
    cause = F.when(F.col("t").isNull(), absent).when(~F.col(f"b.{value}").eqNullSafe(F.col(f"t.{value}")), changed)
    detail = F.when(F.col("t").isNotNull(), _arrow(F.col(f"b.{value}"), F.col(f"t.{value}")))
    return classed(j.select(*PAIR, F.col("n").alias("name"), cause.alias("cause"), detail.alias("detail"), F.lit("break").alias("sev")).where("cause is not null"))


def option_causes(base: DataFrame, target: DataFrame) -> DataFrame:
    return valued(base, target, "default", "option.absent", "option.default-changed")


def instance_causes(base: DataFrame, target: DataFrame) -> DataFrame:
    return valued(base, target, "prio", "instance.absent", "instance.priority-changed")


def syntax(base: DataFrame, target: DataFrame) -> DataFrame:
    """Categories that are gone; in those that stay, leading tokens and kinds that are gone."""
    j = base.select(*PAIR, "n", F.struct("lead", "kinds").alias("b")).join(target.select(*PAIR, "n", F.struct("lead", "kinds").alias("t")), [*PAIR, "n"], "left")
    none = F.array().cast("array<string>")
    rows = lambda cause, c: F.transform(F.array_except(F.coalesce(f"b.{c}", none), F.coalesce(f"t.{c}", none)), lambda x: F.struct(F.lit(cause).alias("cause"), x.alias("detail")))
    gone = F.array(F.struct(F.lit("syntax.category-absent").alias("cause"), F.lit(None).cast("string").alias("detail")))
    each = F.explode(F.when(F.col("t").isNull(), gone).otherwise(F.concat(rows("syntax.token-absent", "lead"), rows("syntax.kind-absent", "kinds"))))
    return classed(j.select(*PAIR, F.col("n").alias("name"), each.alias("c"), F.lit("break").alias("sev")).select(*PAIR, "name", "c.*", "sev"))


def deprecations(base: DataFrame, target: DataFrame, target_constants: DataFrame) -> DataFrame:
    """Aliases that are neither deprecated nor constants in target."""
    known = target.select(*PAIR, "n").unionByName(target_constants.select(*PAIR, "n"))
    return elements(base, known, "deprecation.alias-absent")


def with_instances(consts: DataFrame, instances: DataFrame) -> DataFrame:
    """Flag constants that are in the instance table."""
    i = instances.select("release", "n").distinct().withColumn("inst", F.lit(True))
    return consts.join(i, ["release", "n"], "left").withColumn("inst", F.coalesce("inst", F.lit(False)))


def histogram(causes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Breaks by cause, most first."""
    return causes.where("sev = 'break'").groupBy(*(by or []), "cause").count().orderBy(F.desc("count"), "cause")


def sections(causes: DataFrame, names: list[str]) -> DataFrame:
    """Breaks by section (the cause up to its dot), sections without any included."""
    s = causes.where("sev = 'break'").groupBy(F.substring_index("cause", ".", 1).alias("section")).count()
    every = causes.sparkSession.createDataFrame([(n,) for n in names], "section string")
    return F.broadcast(every).join(s, "section", "left").select("section", F.coalesce("count", F.lit(0)).alias("breaks"))


def column_name(cause: str) -> str:
    return cause.replace(".", "_").replace("-", "_")


def chain(causes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a hop: breaks, silent and a column for each of the causes."""
    counts = causes.where("sev = 'break'").groupBy(*PAIR).agg(
        F.count("*").alias("breaks"), F.count_if(F.col("cause").isin(vocab.SILENT)).alias("silent"),
        *[F.count_if(F.col("cause") == c).alias(column_name(c)) for c in vocab.CAUSES],
    )
    return pairs.select(*PAIR).join(counts, PAIR, "left").fillna(0)


def churn(rows: DataFrame, key: str, release: str) -> DataFrame:
    """Names by presence: those only in the middle of all releases, and those removed and restored. rows: one a (name, release)."""
    ends = rows.agg(F.min(release).alias("lo"), F.max(release).alias("hi"), F.countDistinct(release).alias("m"))
    ranks = rows.select(release).distinct().withColumn("i", F.dense_rank().over(Window.orderBy(release)))
    per = rows.join(F.broadcast(ranks), release).groupBy(key).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.countDistinct("i").alias("n"))
    per = per.crossJoin(F.broadcast(ends.select("m")))  # one row
    return per.select(key, "first", "last", "n", ((F.col("first") > 1) & (F.col("last") < F.col("m"))).alias("mid_only"), (F.col("last") - F.col("first") + 1 > F.col("n")).alias("restored"))


def self_check(counts: DataFrame, exempt: tuple[str, ...] = ("deprecated",), allow_empty: bool = False) -> list[str]:
    """Sections of (section, n) that are empty and may not be; raises unless allowed. Sections are a closed list."""
    empty = sorted(r["section"] for r in counts.where("n = 0").collect() if r["section"] not in exempt)
    if empty and not allow_empty:
        raise ValueError(f"empty sections: {', '.join(empty)}")
    return empty
