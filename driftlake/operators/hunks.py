"""Runs of changed lines, their context and windows, and the declaration they stand in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = "path string, hunk_seq int, seq int, kind string, text string, old_no int, new_no int, section string"
MAX_CHANGED = 60
CONTEXT = 6


def runs(lines: DataFrame, gap: int = 0, by: tuple[str, ...] = ("path", "hunk_seq")) -> DataFrame:
    """lines with ``run``: changed lines with at most ``gap`` unchanged between share one (gaps and islands); unchanged lines inside a run have it too, others null."""
    w = Window.partitionBy(*by).orderBy("seq")
    changed = F.col("kind") != " "
    last = F.last(F.when(changed, F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = changed & (last.isNull() | (F.col("seq") - last > gap + 1))
    d = lines.withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(w))
    nxt = F.first(F.when(changed, F.col("_run")), ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    prev = F.last(F.when(changed, F.col("_run")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn("run", F.when(changed | (nxt == prev), F.col("_run"))).drop("_run")


def numbered(lines: DataFrame, by: tuple[str, ...] = ("path", "hunk_seq")) -> DataFrame:
    """old_no and new_no of each line from old_start and new_start."""
    before = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(before), F.lit(0))
    return lines.withColumn("old_no", (F.col("old_start") + count((" ", "-"))).cast("int")).withColumn("new_no", (F.col("new_start") + count((" ", "+"))).cast("int"))


def hunks(lines: DataFrame, gap: int = 0, context: int = CONTEXT) -> DataFrame:
    """One row a run: old and new text, body, line numbers, and up to ``context`` lines on either side."""
    w = Window.partitionBy("path", "hunk_seq").orderBy("seq")
    kind_text = F.struct("kind", "text")
    d = runs(lines, gap).withColumn("_b", F.collect_list(kind_text).over(w.rowsBetween(-context, -1))).withColumn("_a", F.collect_list(kind_text).over(w.rowsBetween(1, context)))
    d = d.where("run is not null")
    entry = F.struct("seq", "kind", "text")
    g = d.groupBy("path", "hunk_seq", "run").agg(
        F.array_sort(F.collect_list(entry)).alias("body"), F.min_by("_b", "seq").alias("_b"), F.max_by("_a", "seq").alias("_a"), F.min("seq").alias("first_seq"),
        F.min(F.when(F.col("kind") == "-", F.col("old_no"))).alias("line_old"), F.min(F.when(F.col("kind") == "+", F.col("new_no"))).alias("line_new"),
    )
    texts = lambda kinds: F.transform(F.filter("body", lambda x: x["kind"].isin(*kinds)), lambda x: x["text"])
    plain = lambda c: F.transform(F.filter(c, lambda x: x["kind"] == " "), lambda x: x["text"])
    return g.select("path", "hunk_seq", "run", "first_seq", texts("-").alias("old_lines"), texts("+").alias("new_lines"), "body", plain("_b").alias("ctx_before"), plain("_a").alias("ctx_after"), F.col("_b").alias("before"), F.col("_a").alias("after"), "line_old", "line_new")


def window(side: str, context: int = 0) -> Column:
    """One side's slice, as it stands in the file: its lines and unchanged ones of the body and of up to ``context`` diff lines on either side."""
    mine = lambda c: F.transform(F.filter(c, lambda x: x["kind"].isin(" ", side)), lambda x: x["text"])
    none = F.array().cast("array<string>")
    head, tail = (mine(F.slice("before", F.greatest(F.lit(1), F.size("before") - context + 1), context)), mine(F.slice("after", 1, context))) if context else (none, none)
    return F.array_join(F.concat(head, mine("body"), tail), "\n")


def pure(side: str) -> Column:
    """Whether a run only adds (``+``) or only removes (``-``) lines."""
    own, other = ("new_lines", "old_lines") if side == "+" else ("old_lines", "new_lines")
    return (F.size(own) > 0) & (F.size(other) == 0)


def usable(h: DataFrame, most: int = MAX_CHANGED) -> DataFrame:
    return h.where(F.size("old_lines") + F.size("new_lines") <= most)


def paths(df: DataFrame, prefixes: tuple[str, ...] = (), suffix: str = "", without: tuple[str, ...] = (), column: str = "path") -> DataFrame:
    """Rows whose path has one of the prefixes, the suffix and none of the parts: plain string tests that scans can take."""
    c = F.col(column)
    for p in without:
        df = df.where(~c.contains(p))
    if prefixes:
        cond = c.startswith(prefixes[0])
        for p in prefixes[1:]:
            cond = cond | c.startswith(p)
        df = df.where(cond)
    return df.where(c.endswith(suffix)) if suffix else df


# Words that begin a declaration.
DECL = (
    r"^((?:@\[[^\]]*\]\s*|private\s+|protected\s+|noncomputable\s+|partial\s+|unsafe\s+|nonrec\s+|scoped\s+|local\s+)*)"
    r"(theorem|lemma|def|abbrev|instance|example|structure|inductive|class|opaque|axiom|irreducible_def)\b\s*([^\s:({\[⦃⟨]*)"
)


def enclosing(lines: DataFrame, header: Column, value: Column, by: str = "path", order: str = "line") -> DataFrame:
    """lines with ``decl``: the value at the nearest header at or above (a backward as-of join without a join)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("decl", F.last(F.when(header, value), ignorenulls=True).over(w))


def declarations(lines: DataFrame) -> DataFrame:
    """Code lines with the enclosing declaration's name, kind and start line."""
    head = F.col("text").rlike(DECL)
    value = F.struct(F.nullif(F.regexp_extract("text", DECL, 3), F.lit("")).alias("name"), F.regexp_extract("text", DECL, 2).alias("kind"), F.col("line").alias("start_line"))
    return enclosing(lines, head, value).select("*", "decl.name", "decl.kind", "decl.start_line").drop("decl")


#: Lines after a declaration's first that its signature may span.
SIGNATURE_LINES = 6


def signatures(lines: DataFrame) -> DataFrame:
    """path, start_line, signature and attributes of each declaration: its text up to ``:=`` or ``where``, SIGNATURE_LINES lines at most, and the attributes before its keyword."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(0, SIGNATURE_LINES - 1)
    head = F.col("text").rlike(DECL)
    d = lines.withColumn("_s", F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), "\n")).where(head)
    cut = F.regexp_replace("_s", r"(?s)(\s*:=|\s+\bwhere\b|\n\s*\|).*$", "")
    found = F.regexp_extract_all(F.regexp_extract("text", DECL, 1), F.lit(r"@\[([^\]]*)\]"), F.lit(1))
    attrs = F.filter(F.flatten(F.transform(found, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y)))), lambda x: x != "")
    return d.select("path", F.col("line").alias("start_line"), F.trim(F.regexp_replace(cut, r"\s+", " ")).alias("signature"), attrs.alias("attributes"))


def namespaces(lines: DataFrame) -> DataFrame:
    """path, line, namespace of code lines: the names of the namespaces that are open there, joined by dots.

    ``namespace`` and ``section`` open, ``end`` closes the last that is open,
    or nothing. The depth is a running sum, raised by how far it fell under 0;
    what is open at a level is the last that opened at this depth, an as-of
    window a level. Lines that open or close are cut to levels, others take
    over the namespace of the last such line.
    """
    name = F.nullif(F.regexp_extract("text", r"(?U)^\s*namespace\s+([\w.']+)", 1), F.lit(""))
    opens = name.isNotNull() | F.coalesce(F.col("text").rlike(r"(?U)^\s*(noncomputable\s+)?section\b"), F.lit(False))
    step = F.when(opens, 1).when(F.col("text").rlike(r"(?U)^\s*end\b"), -1)
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    e = lines.select("path", "line", name.alias("name"), step.alias("step")).where("step is not null")
    e = e.withColumn("sum", F.sum("step").over(w))
    e = e.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(w), F.lit(0)))
    opened = F.when((F.col("level") == F.col("depth")) & (F.col("step") > 0), F.struct("name"))
    level = Window.partitionBy("path", "level").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    at = e.where("depth > 0").withColumn("level", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth")))).withColumn("o", F.last(opened, ignorenulls=True).over(level))
    names = F.transform(F.array_sort(F.collect_list(F.struct("level", F.col("o.name").alias("name")))), lambda x: x["name"])
    at = at.groupBy("path", "line").agg(F.array_join(names, ".").alias("namespace"))  # array_join passes over sections, which have no name
    e = e.select("path", "line").join(at, ["path", "line"], "left").select("path", "line", F.coalesce("namespace", F.lit("")).alias("_ns"))
    every = lines.select("path", "line").join(e, ["path", "line"], "left")
    return every.select("path", "line", F.coalesce(F.last("_ns", ignorenulls=True).over(w), F.lit("")).alias("namespace"))


def parse_unified(diffs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """diffs (diff string) to LINES plus old_start, new_start, the file's flags, diff_id (SHA-1 of the diff) and the columns ``keep`` (strings); hunks end by their line counts, not by what lines look like."""
    import hashlib
    import re

    schema = LINES.replace("old_no int, new_no int", "old_start int, new_start int") + ", is_new boolean, is_deleted boolean, is_rename boolean, is_binary boolean, diff_id string" + "".join(f", `{c}` string" for c in keep)
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    mark = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for text, *own in zip(pdf["diff"], *(pdf[c] for c in keep), strict=True):
                diff_id = hashlib.sha1((text or "").encode("utf-8", "surrogatepass")).hexdigest()
                path, flags, hunk, left, right, seq, at = None, [False] * 4, -1, 0, 0, 0, (0, 0, "")
                for line in (text or "").split("\n"):
                    if left > 0 or right > 0:
                        kind = line[:1] or " "
                        if kind == "\\":
                            continue
                        left -= kind in " -"
                        right -= kind in " +"
                        rows.append((path, hunk, seq, kind, line[1:], at[0], at[1], at[2], *flags, diff_id, *own))
                        seq += 1
                    elif line.startswith("diff --git "):
                        flags, hunk = [False] * 4, -1
                        path = line.rsplit(" b/", 1)[-1]
                    elif m := mark.match(line):
                        hunk, seq = hunk + 1, 0
                        at = (int(m[1]), int(m[3]), m[5])
                        left, right = int(m[2] or 1), int(m[4] or 1)
                    elif line.startswith("+++ b/"):
                        path = line[6:]
                    else:
                        for i, p in enumerate(("new file", "deleted file", "rename ", "Binary files ")):
                            flags[i] = flags[i] or line.startswith(p)
            yield pd.DataFrame(rows, columns=names)

    return diffs.select("diff", *keep).mapInPandas(run, schema)
