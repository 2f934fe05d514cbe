"""Adaptation windows in a commit history, found in four ways and merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..session import kept

COLUMNS = ["kind", "key", "source", "ref", "base", "tip", "date", "pr", "version_before", "version_after"]


def match(patterns: list[tuple[str, str]], text: Column) -> Column:
    """(kind, key) of the first pattern that matches, or null."""
    out = None
    for kind, p in patterns:
        hit = F.struct(F.lit(kind).alias("kind"), F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias("key"))
        out = F.when(text.rlike(p), hit) if out is None else out.when(text.rlike(p), hit)
    return out


def pull_request(subject: Column) -> Column:
    return F.nullif(F.regexp_extract(subject, r"\(#(\d+)\)\s*$", 1), F.lit(""))


def _blobs(commits: DataFrame, blobs: DataFrame | None) -> DataFrame:
    """Add the version file's text at the first parent and at the commit; blobs: (sha, version)."""
    c = commits.withColumn("base", F.try_element_at("parents", F.lit(1)))
    if blobs is None:
        return c.withColumn("version_before", F.lit(None).cast("string")).withColumn("version_after", F.lit(None).cast("string"))
    after = blobs.select("sha", F.trim("version").alias("version_after"))
    before = blobs.select(F.col("sha").alias("base"), F.trim("version").alias("version_before"))
    return c.join(after, "sha", "left").join(before, "base", "left")


def _shaped(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source)).select(*COLUMNS)


def from_messages(commits: DataFrame, blobs: DataFrame | None = None, adaptations: bool = True) -> DataFrame:
    c = commits.withColumn("m", match(vocab.MESSAGE_PATTERNS, F.col("subject"))).where("m is not null").where(F.size("parents") > 0)
    if not adaptations:
        c = c.where("m.kind <> 'dep-adaptation'")
    c = _blobs(c, blobs)
    return _shaped(c.select("*", "m.kind", "m.key", F.col("sha").alias("ref"), F.col("sha").alias("tip"), F.substring("author_date", 1, 10).alias("date"), pull_request(F.col("subject")).alias("pr")), "squash")


def from_version_changes(commits: DataFrame, blobs: DataFrame) -> DataFrame:
    c = _blobs(commits.where(F.size("parents") > 0), blobs).where(~F.col("version_before").eqNullSafe(F.col("version_after")))
    key = F.coalesce(F.nullif("version_after", F.lit("")), F.substring("sha", 1, 8))
    return _shaped(c.select("*", F.lit("bump").alias("kind"), key.alias("key"), F.col("sha").alias("ref"), F.col("sha").alias("tip"), F.substring("author_date", 1, 10).alias("date"), pull_request(F.col("subject")).alias("pr")), "version-file")


def from_branches(heads: DataFrame, mainline_tip: str) -> DataFrame:
    """heads: (ref, sha). One remote prefix is stripped; without a date they come last."""
    short = F.regexp_replace("ref", r"^(refs/)?(heads|remotes/[^/]+|origin)/", "")
    h = heads.withColumn("m", match(vocab.BRANCH_PATTERNS, short)).where("m is not null")
    none = F.lit(None).cast("string")
    return _shaped(h.select("m.kind", F.coalesce("m.key", short).alias("key"), "ref", F.lit(mainline_tip).alias("base"), F.col("sha").alias("tip"), F.lit("").alias("date"), none.alias("pr"), none.alias("version_before"), none.alias("version_after")), "branch")


# Subjects of merges that name a branch.
MERGES = [r"Merge branch '([^']+)'", r"Merge remote-tracking branch '(?:[^'/]+/)?([^']+)'", r"Merge pull request #\d+ from [^/\s]+/(\S+)"]


def from_merges(commits: DataFrame, blobs: DataFrame) -> DataFrame:
    c = _blobs(commits.where(F.size("parents") >= 2), blobs)
    branch = F.coalesce(*[F.nullif(F.regexp_extract("subject", p, 1), F.lit("")) for p in MERGES])
    c = c.withColumn("branch", branch).withColumn("m", match(vocab.BRANCH_PATTERNS, F.col("branch")))
    bumped = ~F.col("version_before").eqNullSafe(F.col("version_after"))
    c = c.where(F.col("m").isNotNull() | bumped)
    key = F.coalesce("m.key", "branch", F.nullif("version_after", F.lit("")), F.substring("sha", 1, 8))
    return _shaped(c.select("*", F.coalesce("m.kind", F.lit("bump")).alias("kind"), key.alias("key"), F.col("sha").alias("ref"), F.element_at("parents", 2).alias("tip"), F.substring("author_date", 1, 10).alias("date"), pull_request(F.col("subject")).alias("pr")), "merge")


def merged(found: list[DataFrame]) -> DataFrame:
    """Windows of all ways, in their order: the first of each (base, tip), latest date first."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("_way", F.lit(i)) for i, d in enumerate(found)])
    w = Window.partitionBy("base", "tip").orderBy("_way", "ref", "key")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_way").orderBy(F.desc("date"), "kind", "key")


def picked(found: DataFrame, kind: str | None = None, most: int = 0) -> DataFrame:
    """Windows of one kind (all without), the first ``most`` by date, latest first (0: all)."""
    f = found.where(F.col("kind") == kind) if kind else found
    return f.orderBy(F.desc("date"), "kind", "key", "base", "tip").limit(most) if most else f


def _jumps(step: DataFrame) -> list[DataFrame]:
    """Tables (sha, to) of the commit 1, 2, 4, ... steps away."""
    out, step = [], kept(step, "jump")
    while not step.isEmpty():
        out.append(step)
        step = kept(step.join(step.select(F.col("sha").alias("to"), F.col("to").alias("far")), "to").select("sha", F.col("far").alias("to")), "jump")
    return out


def _depths(commits: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """sha, depth: steps until there are no more, by the longest jumps first."""
    cur = commits.select("sha", F.col("sha").alias("at"), F.lit(0).cast("long").alias("depth"))
    for k, jump in reversed(list(enumerate(jumps))):
        cur = cur.join(jump.select(F.col("sha").alias("at"), "to"), "at", "left").select("sha", F.coalesce("to", "at").alias("at"), (F.col("depth") + F.when(F.col("to").isNotNull(), 1 << k).otherwise(0)).alias("depth"))
    return kept(cur.select("sha", "depth"), "depths")


#: Times that each commit's main parent is chosen anew.
IMPROVED = 3


def main_parents(commits: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (sha, parent, main), one main parent a commit, and the jumps along main parents.

    Main is first the first parent. While another parent has a longer way of
    main parents below it (its generation, as far as it is known), that one
    takes its place, IMPROVED times at most: so long histories become long
    ways, whichever parent of a merge they go through.
    """
    edges = kept(commits.select("sha", F.posexplode("parents").alias("place", "parent")), "edges")
    main = edges.where("place = 0").select("sha", F.col("parent").alias("to"))
    jumps = _jumps(main)
    for _ in range(IMPROVED if not edges.where("place > 0").isEmpty() else 0):
        depth = _depths(commits, jumps).select(F.col("sha").alias("parent"), "depth")
        best = edges.join(depth, "parent", "left").groupBy("sha").agg(F.max_by("parent", F.struct(F.coalesce("depth", F.lit(-1).cast("long")).alias("d"), (-F.col("place")).alias("p"))).alias("to"))
        best = kept(best, "main")
        if best.join(jumps[0].withColumnRenamed("to", "was"), "sha").where("to <> was").isEmpty():
            break
        jumps = _jumps(best)
    m = jumps[0] if jumps else main
    return edges.join(m, "sha", "left").select("sha", "parent", F.col("parent").eqNullSafe(F.col("to")).alias("main")), jumps


def _round(front: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """front and all that main parents lead to from it. Each step reads the one before it once, so the plan grows with the jumps, not with their power set."""
    for jump in jumps:
        front = front.join(jump, "sha", "left").select(F.explode(F.array_compact(F.array("sha", "to"))).alias("sha")).distinct()
    return kept(front, "front")


def reachable(commits: DataFrame, include: list[str] | DataFrame, exclude: list[str] | DataFrame) -> DataFrame:
    """Commits reachable from ``include`` and not from ``exclude`` (lists, or DataFrames with column sha).

    Main parents are followed in doubled steps: a set is closed under them by
    one join a jump table. Other parents of what was reached begin the next
    round. Since main parents lead down the longest ways (``main_parents``),
    there are as many rounds as side branches that a way enters, not as many as
    it has merges.
    """
    spark = commits.sparkSession
    edges, jumps = main_parents(commits)
    side = kept(edges.where("NOT main").select("sha", "parent"), "side")

    def walk(tips: list[str] | DataFrame) -> DataFrame:
        start = tips.select("sha") if isinstance(tips, DataFrame) else spark.createDataFrame([(t,) for t in tips], "sha string")
        seen, front = None, start.distinct()
        while True:
            front = _round(front, jumps)
            seen = front if seen is None else kept(seen.union(front).distinct(), "seen")
            front = kept(front.join(side, "sha").select(F.col("parent").alias("sha")).distinct().join(seen, "sha", "left_anti"), "next")
            if front.isEmpty():
                return seen

    out = commits.select("sha").join(walk(include), "sha", "left_semi")
    return out.join(walk(exclude), "sha", "left_anti") if isinstance(exclude, DataFrame) or exclude else out
