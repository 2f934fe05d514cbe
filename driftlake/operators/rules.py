"""Rewrite rules: induction from pairs, application, synthetic breakages, replay verdicts, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X
from . import search


def _first(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their place ``_n``: cut by rank before they are gathered, so a popular rule is no large row."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)


def _summed(rows: DataFrame, kind: str) -> DataFrame:
    """Rules of rows (old, new, ...).

    Everything that a rule counts or shows is a value of one of its columns:
    rows are summed once to (old, new, column, value), partly before the
    shuffle, and the sums are rolled up.
    """
    rule, none = ["old", "new"], F.array().cast("array<string>")
    one = lambda what, c: F.struct(F.lit(what).alias("what"), c.cast("string").alias("v"))
    values = F.array(*[one(what, F.col(c)) for what, c in (("label", "label"), ("file", "file"), ("toolchain", "toolchain"), ("origin", "window"), ("provenance", "commit" if "commit" in rows.columns else "sample_id"))])
    if kind == "subst" and "notes" in rows.columns:
        values = F.concat(values, F.transform(F.coalesce("notes", none), lambda x: one("note", x)))
    of = lambda *what: F.col("what").isin(*what)
    d = rows.select(*rule, "seq", "duplicate_count", F.explode(values).alias("x")).select(*rule, "seq", "duplicate_count", "x.*").where(of("label", "file") | (F.col("v") != ""))
    d = d.groupBy(*rule, "what", "v").agg(F.count("*").alias("n"), F.sum("duplicate_count").alias("w"), F.min("seq").alias("seq"))
    every = lambda what: F.array_sort(F.collect_set(F.when(of(what), F.col("v"))))
    r = d.groupBy(*rule).agg(
        F.sum(F.when(of("label"), F.col("n"))).alias("support"), F.sum(F.when(of("label"), F.col("w"))).alias("support_weighted"), F.count(F.when(of("file"), F.col("v"))).alias("files"),
        F.min_by("v", F.when(of("label"), F.col("seq"))).alias("label"), every("toolchain").alias("toolchains"), every("note").alias("notes"),
    )
    ranked = lambda cond, v: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("_n", F.col(v).alias("v"))))), lambda x: x["v"])
    shown = _first(d.where(of("origin", "provenance")), [*rule, "what"], ["seq", "v"], 5)
    parts = [shown.groupBy(*rule).agg(ranked(of("origin") & (F.col("_n") <= 3), "v").alias("origins"), ranked(of("provenance"), "v").alias("provenance"))]
    if kind == "subst":
        texts = rows.select(*rule, "seq", F.substring("fixed", 1, EXCERPT).alias("text")).where("text <> ''")
        parts.append(_first(texts, rule, ["seq", "text"], 3).groupBy(*rule).agg(ranked(F.lit(True), "text").alias("windows")))
    for part in parts:
        names = [c for c in part.columns if c not in rule]
        r = r.join(part.select(F.col("old").alias("_o"), F.col("new").alias("_w"), *names), F.col("old").eqNullSafe(F.col("_o")) & F.col("new").eqNullSafe(F.col("_w")), "left").drop("_o", "_w")
    for c in ("origins", "provenance", "windows"):
        r = r.withColumn(c, F.coalesce(c, none) if c in r.columns else none)
    return r.withColumn("kind", F.lit(kind)).withColumn("reversible", F.lit(True) if kind == "subst" else F.trim(F.regexp_replace("old", r"\s+", " ")) != "")


# Fixed value: characters of a fixed text that a rule shows.
EXCERPT = 400


def induce(pairs: DataFrame, min_support: int = 2, guard_tactics: bool = False, longest: int = 600, renames: bool = False) -> DataFrame:
    """Rules from pairs (sample_id, seq, subs, broken, fixed, label, file, window, toolchain, duplicate_count; notes and commit if there are).

    kind ``subst``: one for each replaced token, if both names are identifiers
    that may go back; kind ``window``: one for each (broken, fixed) that differ
    in more than white space and whose fixed text, white space collapsed, is
    shorter than ``longest``. Window rules of pairs with replaced tokens are
    left to ``renames``; one with a blank broken side is not reversible.
    Support counts rows, support_weighted sites. ``windows`` are the first three
    fixed texts (EXCERPT characters), ``origins`` the first three adaptation
    windows, provenance the first five commits. Order: support, then id.
    """
    bad = vocab.UNSAFE_REVERSE + (vocab.TACTICS if guard_tactics else [])
    s = pairs.where(F.size("subs") > 0).withColumn("s", F.explode("subs")).select("*", F.col("s.old").alias("old"), F.col("s.new").alias("new")).where(~F.col("old").isin(bad) & ~F.col("new").isin(bad))
    s = s.where(X.is_identifier(F.col("old")) & X.is_identifier(F.col("new")))
    pre, post = (X.normalize(F.col(c), comments=True) for c in ("broken", "fixed"))
    p = pairs if renames else pairs.where(F.size("subs") <= 0)
    p = p.where((pre != "") & (post != "") & (pre != post) & (F.length(post) < longest)).withColumns({"old": F.col("broken"), "new": F.col("fixed")})
    r = _summed(s, "subst").unionByName(_summed(p, "window")).where(F.col("support") >= min_support)
    rid = F.concat(F.substring("kind", 1, 4), F.lit("-"), X.short_hash(F.col("kind"), F.col("old"), F.col("new"), n=12))
    return r.withColumn("rule_id", rid).orderBy(F.desc("support"), "rule_id")


def _limited(text: Column, pattern: Column, to: Column, limit: int) -> Column:
    """The first ``limit`` matches replaced: the text is cut at matches, and only the first cuts are joined with ``to``."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit("\u0001$0\u0002")), "\u0001", -1)
    parts = F.transform(marked, lambda x, i: F.when((i > 0) & (i <= limit), F.concat(to, F.regexp_replace(x, "^[^\u0002]*\u0002", ""))).otherwise(F.replace(x, F.lit("\u0002"), F.lit(""))))
    return F.array_join(parts, "")


def applied(text: Column, kind: Column, source: Column, to: Column, limit: int | None = None) -> Column:
    """Rewrite source to ``to`` in text: names as whole identifiers, windows as they stand."""
    names = X.replace_name(text, source, to) if limit is None else _limited(text, X.name_pattern(source), to, limit)
    at = F.instr(text, source)
    once = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), to, F.substring(text, at + F.length(source), F.length(text)))).otherwise(text)
    return F.when(kind == "subst", names).otherwise(once if limit else F.replace(text, source, to))


def sites(text: Column, kind: Column, source: Column) -> Column:
    """How often a rule's source occurs in text."""
    names = F.size(F.split(F.regexp_replace(text, X.name_pattern(source), F.lit("\u0001")), "\u0001", -1)) - 1
    whole = F.size(F.split(F.replace(text, source, F.lit("\u0001")), "\u0001", -1)) - 1
    return F.when(kind == "subst", names).otherwise(F.when(source == "", 0).otherwise(whole))


def reversed_text(text: Column, rule: Column, limit: int | None = None) -> Column:
    """Working text made broken by a rule (struct of kind, old, new, reversible); one that is not reversible leaves it as it is."""
    return F.when(rule["reversible"], applied(text, rule["kind"], rule["new"], rule["old"], limit)).otherwise(text)


def reverse_window(text: Column, fixed: Column, broken: Column) -> Column:
    """text with the first occurrence of the fixed window replaced, or null if it has none."""
    at = F.instr(text, fixed)
    return F.when((fixed != "") & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), broken, F.substring(text, at + F.length(fixed), F.length(text))))


def synthesize(rules: DataFrame, files: DataFrame, n: int = 1000, per_rule: int = 20, sites: int = 1, toolchain: str = "") -> DataFrame:
    """Breakages: rules applied backwards to files (path, text) where going forward again restores the text.

    All rules are searched at once, by an automaton, wherever their text stands
    (``search.matched``); that a name stands whole is for the rewriting to see.
    Caps hold in order of path, then of rule.
    """
    r = rules.where("reversible").select("rule_id", "kind", "label", "old", "new", "support")
    hit = search.matched(files.select("path", "text"), r, "new")
    broken = applied(F.col("text"), F.col("kind"), F.col("new"), F.col("old"), limit=sites)
    s = hit.withColumn("broken", broken).where("broken <> text")
    s = s.where(applied(F.col("broken"), F.col("kind"), F.col("old"), F.col("new")) == F.col("text"))
    s = s.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy("path"))).where(F.col("_n") <= per_rule).drop("_n")
    return s.orderBy("path", F.desc("support"), "rule_id").limit(n).select(X.short_hash(F.col("rule_id"), F.col("path")).alias("sample_id"), "rule_id", "label", "path", "broken", F.col("text").alias("fixed"), F.lit(sites).alias("sites"), F.lit(toolchain).alias("toolchain"))


def agreement(applied_ok: Column, timeout: Column, observed: Column, expected: Column) -> Column:
    """Verdict on a replayed sample: error, match, no_error or mismatch."""
    none = F.size(observed) <= 0
    return (
        F.when(~applied_ok, "error").when(timeout, F.when(F.array_contains(expected, "deterministic_timeout"), "match").otherwise("mismatch"))
        .when(none, F.when(F.array_contains(expected, "no_error"), "match").otherwise("no_error")).when(F.arrays_overlap(observed, expected), "match").otherwise("mismatch")
    )


def verdicts(samples: DataFrame, files: DataFrame, outcomes: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One row a sample: applied, timeout, observed, expected, agreement, stderr, the first eight diagnostics.

    samples: sample_id, label, expected_errors, path, fixed_window,
    broken_window; files: path, text; outcomes of the runs: sample_id, timeout,
    diagnostics (array of struct with error_class and severity). A sample
    without expectations has its label's; ``labels`` picks samples first.
    """
    table = F.create_map(*[y for k, v in vocab.EXPECTED_ERRORS.items() for y in (F.lit(k), F.array(*[F.lit(e) for e in sorted(v)]))])
    s = samples.where(F.col("label").isin(labels)) if labels else samples
    own = F.when(F.size("expected_errors") > 0, F.col("expected_errors"))
    none = F.array().cast("array<string>")
    s = s.withColumn("expected", F.coalesce(own, F.try_element_at(table, F.col("label")), none))
    j = s.join(files.select("path", F.col("text").alias("_text")), "path", "left").join(outcomes.select("sample_id", "timeout", "diagnostics"), "sample_id", "left")
    found = F.col("_text").isNotNull() & reverse_window(F.col("_text"), F.col("fixed_window"), F.col("broken_window")).isNotNull()
    late = F.coalesce("timeout", F.lit(False)) & found
    seen = F.array_sort(F.array_distinct(F.transform(F.filter("diagnostics", lambda d: d["severity"] != "info"), lambda d: d["error_class"])))
    observed = F.when(~found, none).when(late, F.array(F.lit("deterministic_timeout"))).otherwise(F.coalesce(seen, none))
    stderr = F.when(F.col("_text").isNull(), F.concat(F.lit("missing file: "), "path")).when(~found, "fixed window not found at this commit")
    return j.select("sample_id", "label", found.alias("applied"), late.alias("timeout"), observed.alias("observed"), "expected", agreement(found, late, observed, F.col("expected")).alias("agreement"), stderr.alias("stderr"), F.slice(F.coalesce("diagnostics", F.array().cast(j.schema["diagnostics"].dataType)), 1, 8).alias("diagnostics"))


def calibration(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """label, counts by agreement, precision and genuine_break_rate; results without a pair have label ``?``."""
    labels = pairs.groupBy("sample_id").agg(F.max_by("label", "seq").alias("label"))
    j = results.join(labels, "sample_id", "left").withColumn("label", F.coalesce("label", F.lit("?")))
    kinds = ["match", "mismatch", "no_error", "error"]
    p = j.groupBy("label").agg(F.count("*").alias("n"), *[F.count_if(F.col("agreement") == k).alias(k) for k in kinds])
    precision = F.round(F.col("match") / F.greatest(F.lit(1), F.col("match") + F.col("mismatch")), 3)
    return p.withColumn("precision", precision).withColumn("genuine_break_rate", F.round(1 - F.col("no_error") / F.greatest(F.lit(1), F.col("n")), 3))


def budget(samples: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` samples when groups are taken whole, in the order they first appear."""
    first = samples.groupBy(group).agg(F.min(order).alias("_first"))
    return samples.join(first, group).orderBy("_first", order).limit(limit).drop("_first")
