"""The mining pipeline over a repository: windows, pairs, dataset, rules, breakages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import classify, dataset, hunks, rules, windows
from ..sources import git

MODES = ("squash", "version-file", "branch", "merge")


def discover(spark: SparkSession, repo: str, mainline: str = "HEAD", modes: tuple[str, ...] = ("squash",), version_file: str = "toolchain", limit: int = 0, adaptations: bool = True) -> DataFrame:
    """Windows of the chosen ways, merged."""
    c = git.log(spark, repo, mainline, limit=limit)
    every = git.log(spark, repo, mainline).select("sha", F.lit(version_file).alias("path"))
    b = git.blobs(every, repo).select("sha", F.trim(F.regexp_replace("text", r"\s+$", "")).alias("version")).where("version is not null")
    ways = {
        "squash": lambda: windows.from_messages(c, b, adaptations), "version-file": lambda: windows.from_version_changes(c, b),
        "branch": lambda: windows.from_branches(git.heads(spark, repo), git.rev_parse(repo, mainline)), "merge": lambda: windows.from_merges(c, b),
    }
    return windows.merged([ways[m]() for m in MODES if m in modes])


def mine(found: DataFrame, repo: str, prefixes: tuple[str, ...] = (), suffix: str = "", without: tuple[str, ...] = (), gap: int = 0, context: int = 6, keep_noise: bool = False, least: float = 0.0, most: int = 60, kind: str | None = None, max_windows: int = 0) -> DataFrame:
    """Pairs of the windows: one a run of changed lines of files that both sides have. ``kind`` picks windows of one kind, ``max_windows`` the first so many."""
    w = windows.picked(found, kind, max_windows).select("kind", "key", "base", "tip", "date", "pr", "version_before", "version_after")
    d = git.diffs(w, repo, max(context, 6)).where("diff is not null")
    lines = hunks.parse_unified(d, keep=("tip",))
    lines = hunks.paths(lines.where("NOT is_new AND NOT is_deleted AND NOT is_binary"), prefixes, suffix, without)
    # The window is part of a hunk's path, so equal paths of two windows stay apart.
    own = hunks.numbered(lines.withColumn("path", F.concat_ws("\u0001", "tip", "path")))
    h = hunks.usable(hunks.hunks(own, gap, context), most)
    texts = h.select(
        F.substring_index("path", "\u0001", 1).alias("tip"), F.substring_index("path", "\u0001", -1).alias("path"), "hunk_seq", "run", F.array_join("old_lines", "\n").alias("pre"), F.array_join("new_lines", "\n").alias("post"),
        hunks.window("-", context).alias("broken_window"), hunks.window("+", context).alias("fixed_window"), "ctx_before", "ctx_after", "line_new", "line_old",
    )
    labelled = classify.useful(classify.classify(texts), keep_noise, least)
    files = git.blobs(labelled.select(F.col("tip").alias("sha"), "path").distinct(), repo).withColumn("file", F.concat_ws(":", "sha", "path"))
    code = files.select(F.col("file").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)
    named = hunks.declarations(code).join(hunks.namespaces(code), ["path", "line"]).select(F.col("path").alias("file"), F.col("line").alias("at"), F.col("name").alias("decl"), F.col("kind").alias("decl_kind"), "namespace")
    at = F.coalesce("line_new", "line_old")
    p = labelled.withColumn("file", F.concat_ws(":", "tip", "path")).withColumn("at", at).join(named, ["file", "at"], "left").drop("file", "at")
    p = p.join(w.withColumnRenamed("kind", "window_kind").withColumnRenamed("key", "window"), "tip")
    qualified = F.concat_ws(".", F.nullif("namespace", F.lit("")), "decl")
    sid = X.short_hash(F.col("tip"), F.col("path"), F.col("pre"), F.col("post"), F.coalesce(F.col("line_new"), F.col("line_old")))
    return p.withColumn("decl", F.when(F.col("decl").isNotNull(), qualified)).select(
        sid.alias("sample_id"), F.col("pre").alias("broken"), F.col("post").alias("fixed"), "label", "labels", "confidence", "expected_errors", "path", "decl", "decl_kind", "namespace", "broken_window", "fixed_window", "ctx_before", "ctx_after",
        "line_new", "line_old", F.col("version_before").alias("toolchain_before"), F.col("version_after").alias("toolchain"), "window_kind", "window", F.col("tip").alias("commit"), "pr", "date", "notes", "subs", "fired", "evidence", dataset.signature(F.col("pre"), F.col("post")).alias("signature"),
        F.concat_ws("|", "path", "decl").alias("context"), F.concat_ws("|", F.col("date"), F.col("tip"), F.col("path"), F.lpad("hunk_seq", 6, "0"), F.lpad("run", 6, "0")).alias("seq"), F.col("path").alias("file"),
    )


def build(pairs: DataFrame, keep: int = 1, per_label: int = 2000, per_signature: int = 8, by: str = "toolchain", seed: int = 0, parted: bool = True) -> DataFrame:
    """Deduplicated, capped pairs, with their split if ``parted``."""
    d = dataset.rebalance(dataset.dedup(pairs, keep), per_label, per_signature, seed)
    return dataset.split(d, dataset.choose_key(d, by)) if parted else d.withColumn("split", F.lit("all"))


def induce(pairs: DataFrame, min_support: int = 2) -> DataFrame:
    have = pairs if "duplicate_count" in pairs.columns else pairs.withColumn("duplicate_count", F.lit(1))
    return rules.induce(have, min_support, renames=True)


def synthesize(spark: SparkSession, found: DataFrame, repo: str, ref: str = "HEAD", suffix: str = "", scan: int = 1500, n: int = 1000, seed: int = 0, per_rule: int = 20, sites: int = 1, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Breakages in a seeded sample of the files at a commit (``scan`` 0: all)."""
    f = git.files(spark, repo, ref, prefixes, suffix)
    f = f.orderBy(dataset.shuffle_key(seed, "path"), "path").limit(scan) if scan else f
    return rules.synthesize(found, f, n, per_rule, sites)
