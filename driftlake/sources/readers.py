"""Readers of the record formats. Order is carried in explicit columns; nothing relies on the order of rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X
from ..operators import search

POSITION = "struct<line:int,column:int>"
DIAGNOSTIC = f"severity string, text string, file string, start {POSITION}, end {POSITION}, error_name string, source string, toolchain string, path string, idx int"
SNAPSHOT = {
    "const": "n string, k string, u int, ar int, bi string, th string, red string, cls boolean, prot boolean, inst boolean, fields array<string>, ctors array<string>",
    "category": "n string, lead array<string>, kinds array<string>", "tokens": "all array<string>", "deprecated": "n string, new string, since string",
    "option": "n string, default string, descr string", "instance": "n string, prio int", "attr": "n string, descr string", "tacticelab": "n string", "simp": "n string", "simpunfold": "n string",
}
COMMIT = "sha string, parents array<string>, author_date string, subject string, body string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, bad ones raise or (not strict) are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row a line: ``line`` counts from 1."""
    return docs.select(*keep, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def term_hits(files: DataFrame, terms: list[str] | None = None, keep: tuple[str, ...] = ("tag", "file")) -> DataFrame:
    """Lines that mention a term as a whole identifier: (keep..., line, targets, content). Whole files without any term's text are dropped before they are cut to lines.

    More than FEW terms are searched by one automaton, whose time doesn't grow with their number.
    """
    terms = terms or vocab.TARGETS
    if len(terms) > FEW:
        return _many_hits(files, terms, keep)
    some = F.col("text").contains(terms[0])
    for t in terms[1:]:
        some = some | F.col("text").contains(t)
    hits = lines(files.where(some), keep=keep).withColumn("targets", X.matching_terms(F.col("text"), terms))
    return hits.where(F.size("targets") > 0).select(*keep, "line", "targets", F.trim("text").alias("content"))


#: Terms that a chain of expressions finds sooner than an automaton.
FEW = 24


def _many_hits(files: DataFrame, terms: list[str], keep: tuple[str, ...]) -> DataFrame:
    place = files.sparkSession.createDataFrame([(t, i) for i, t in enumerate(dict.fromkeys(terms))], "_term string, _place int")
    hits = search.matched(lines(files, keep=keep), place, "_term", whole=True)
    # A term stands on a line once; terms of several pieces meet again here.
    g = hits.groupBy(*keep, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_term"))), lambda x: x["_term"]).alias("targets"), F.first("text").alias("text"))
    return g.select(*keep, "line", "targets", F.trim("text").alias("content"))


def pending(files: DataFrame, log: DataFrame, key: str = "tag") -> DataFrame:
    """Rows whose key the log has not recorded."""
    return files.join(log.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key, by a partial aggregate."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def snapshot(raw: DataFrame, tag: str) -> DataFrame:
    """One section of tagged records (release, value, seq): the last record of each name; other tags are ignored, bad JSON raises."""
    kind = F.get_json_object("value", "$.t")
    rows = raw.where((F.trim("value") != "") & (kind == tag)).select("release", "seq", F.from_json("value", SNAPSHOT[tag], {"mode": "FAILFAST"}).alias("r"))
    if tag == "tokens":
        return rows.select("release", F.explode("r.all").alias("n")).distinct()
    return rows.groupBy("release", F.col("r.n").alias("n")).agg(F.max_by("r", "seq").alias("r")).select("release", "r.*")


# Fixed value: the header of a diagnostic.
HEADER = r"^([^\s:][^:\n]*?):([0-9]+):([0-9]+)(?:-([0-9]+):([0-9]+))?: (error|warning|information|info|trace)(?:\(([^)\n]*)\))?: (.*)$"


def severity(s: Column) -> Column:
    return F.coalesce(vocab.lookup(vocab.SEVERITY_ALIAS, s), s)


def expected_text(files: DataFrame) -> DataFrame:
    """Diagnostics of plain expected-output files (path, toolchain, content): header lines open a message, lines up to the next header are its body, text before the first header goes."""
    rows = lines(files, "content", ("path", "toolchain"))
    head = F.col("text").rlike(HEADER)
    w = Window.partitionBy("path", "toolchain").orderBy("line")
    rows = rows.withColumn("head", head).withColumn("idx", F.sum(head.cast("int")).over(w) - 1).where("idx >= 0")
    part = lambda i: F.regexp_extract("h", HEADER, i)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.when(F.col("head"), F.regexp_extract("text", HEADER, 8)).otherwise(F.col("text")).alias("t")))), lambda x: x["t"]), "\n")
    g = rows.groupBy("path", "toolchain", "idx").agg(F.min_by("text", "line").alias("h"), F.regexp_replace(body, r"\n+$", "").alias("text"))
    pos = lambda a, b: F.struct((part(a).try_cast("int") - 1).alias("line"), part(b).try_cast("int").alias("column"))
    return g.select(
        severity(part(6)).alias("severity"), "text", part(1).alias("file"), pos(2, 3).alias("start"), F.when(part(4) != "", pos(4, 5)).alias("end"),
        F.nullif(part(7), F.lit("")).alias("error_name"), F.lit("out.expected").alias("source"), "toolchain", "path", F.col("idx").cast("int").alias("idx"),
    )


def _values(content: str) -> list:
    """JSON values written one after another, up to the first that is broken."""
    out, at, dec = [], 0, json.JSONDecoder()
    while at < len(content):
        while at < len(content) and content[at].isspace():
            at += 1
        if at == len(content):
            break
        try:
            v, at = dec.raw_decode(content, at)
        except ValueError:
            break
        out.append(v)
    return out


def _messages(v: object) -> Iterator[dict]:
    """Objects with a message and a range, at any depth, outermost first."""
    stack = [v]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if "message" in x and isinstance(x.get("range"), dict):
                yield x
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))


def expected_json(files: DataFrame) -> DataFrame:
    """Diagnostics found anywhere in files of concatenated JSON values (path, toolchain, content)."""

    def place(p: object) -> dict | None:
        return {"line": p.get("line"), "column": p.get("character", p.get("column"))} if isinstance(p, dict) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ("severity", "text", "file", "start", "end", "error_name", "source", "toolchain", "path", "idx")]
        for pdf in batches:
            rows = []
            for path, chain, content in zip(pdf["path"], pdf["toolchain"], pdf["content"], strict=True):
                for i, m in enumerate(d for v in _values(content or "") for d in _messages(v)):
                    sev = m.get("severity")
                    sev = vocab.SEVERITY_CODES.get(sev, "unknown") if not isinstance(sev, str) else vocab.SEVERITY_ALIAS.get(sev, sev)
                    msg, code = m["message"], m.get("code")
                    rows.append((sev, msg if isinstance(msg, str) else json.dumps(msg, sort_keys=True), path, place(m["range"].get("start")), place(m["range"].get("end")), code if isinstance(code, str) else None, "json.expected", chain, path, i))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "toolchain", "content").mapInPandas(run, DIAGNOSTIC)


def harvest(files: DataFrame) -> DataFrame:
    """Diagnostics of expected-output files, JSON or text by their first character; an empty file has none."""
    is_json = F.ltrim(F.coalesce("content", F.lit(""))).rlike(r"^\s*[{\[]")
    return expected_text(files.where(~is_json)).unionByName(expected_json(files.where(is_json)))


def json_diagnostics(raw: DataFrame) -> DataFrame:
    """Compiler output lines (value, file, toolchain) as diagnostics: fields fall back (data, message; pos, range.start; errorName, code), other lines are skipped, unknown keys are kept in extra."""
    j = lambda p: F.get_json_object("value", f"$.{p}")
    rows = raw.where(F.ltrim("value").startswith("{")).withColumn("m", F.from_json("value", "map<string,string>")).where(F.col("m").isNotNull() & (F.size("m") > 0))

    def pos(own: str, lsp: str) -> Column:
        one = F.struct(F.greatest(j(f"{own}.line").cast("int") - 1, F.lit(0)).alias("line"), j(f"{own}.column").cast("int").alias("column"))
        two = F.struct(j(f"range.{lsp}.line").cast("int").alias("line"), j(f"range.{lsp}.character").cast("int").alias("column"))
        return F.when(j(f"{own}.column").isNotNull(), one).when(j(f"range.{lsp}.line").isNotNull(), two)

    sev = j("severity")
    code = vocab.lookup({str(k): v for k, v in vocab.SEVERITY_CODES.items()}, sev)
    named = F.when(F.lower(sev).isin(*vocab.SEVERITY_CODES.values(), *vocab.SEVERITY_ALIAS), severity(F.lower(sev)))
    known = ["severity", "data", "message", "pos", "endPos", "range", "errorName", "code", "fileName"]
    name = F.coalesce(j("errorName"), F.when(~j("code").rlike(r"^-?[0-9.]+$"), j("code")))
    return rows.select(F.coalesce(code, named, F.lit("unknown")).alias("severity"), F.coalesce(j("data"), j("message"), F.lit("")).alias("text"), F.coalesce(j("fileName"), "file").alias("file"), pos("pos", "start").alias("start"), pos("endPos", "end").alias("end"), name.alias("error_name"), F.lit("json").alias("source"), "toolchain", F.map_filter("m", lambda k, v: ~k.isin(known)).alias("extra"))


def run_diagnostics(runs: DataFrame) -> DataFrame:
    """Diagnostics of whole runs (file, toolchain, stdout, stderr, code, timeout): those of their output lines, and one made-up error for a run that timed out, or that failed without any."""
    r = runs.withColumn("stdout", F.when(F.coalesce("timeout", F.lit(False)), "").otherwise(F.coalesce("stdout", F.lit(""))))
    told = json_diagnostics(r.select("file", "toolchain", F.explode(F.split("stdout", "\n", -1)).alias("value")).withColumn("_run", F.col("file")))
    line = r.withColumn("_n", F.size(F.filter(F.split("stdout", "\n", -1), lambda x: F.ltrim(x).startswith("{") & (F.coalesce(F.size(F.from_json(x, "map<string,string>")), F.lit(0)) > 0))))
    late = F.coalesce("timeout", F.lit(False))
    text = F.when(late, "<elaboration timeout>").otherwise(F.concat(F.lit("<exit "), F.col("code").cast("string"), F.lit(">\n"), F.substring(F.coalesce("stderr", F.lit("")), 1, 2000)))
    made = line.where(late | ((F.col("code") != 0) & (F.col("_n") == 0)))
    none = F.lit(None)
    made = made.select(F.lit("error").alias("severity"), text.alias("text"), "file", none.cast(POSITION).alias("start"), none.cast(POSITION).alias("end"), none.cast("string").alias("error_name"), F.lit("json").alias("source"), "toolchain", F.create_map(F.lit("synthetic"), F.lit("true")).alias("extra"))
    return told.unionByName(made)


def snapshot_file(spark: SparkSession, path: str, types: bool = False) -> DataFrame:
    """Constants of snapshot lines under folders release=...; the wide column ``ty`` is read only where ``types`` asks for it."""
    raw = spark.read.text(path).select(F.col("release").cast("string").alias("release"), "value", F.monotonically_increasing_id().alias("seq"))
    schema = SNAPSHOT["const"] + (", ty string" if types else "")
    rows = raw.where(F.get_json_object("value", "$.t") == "const").select("release", "seq", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.groupBy("release", F.col("r.n").alias("n")).agg(F.max_by("r", "seq").alias("r")).select("release", "r.*")


def commits(raw: DataFrame) -> DataFrame:
    """A log text (value) with records ended by 0x1e and fields by 0x1f; records with under four fields are skipped. Where raw has ``seq``, each row is one record."""
    each = raw.select("seq", F.col("value").alias("r")) if "seq" in raw.columns else raw.select(F.posexplode(F.split("value", "\x1e")).alias("seq", "r"))
    rec = each.withColumn("f", F.split(F.regexp_replace("r", r"^\s+", ""), "\x1f")).where(F.size("f") >= 4)
    g = lambda i: F.try_element_at("f", F.lit(i))
    return rec.select("seq", g(1).alias("sha"), F.filter(F.split(g(2), " "), lambda p: p != "").alias("parents"), g(3).alias("author_date"), g(4).alias("subject"), F.coalesce(g(5), F.lit("")).alias("body"))


def versions(spark: SparkSession, path: str | None = None, given: list[str] | None = None) -> DataFrame:
    """Releases of a list file or of ``given`` (which wins), each once; invalid ones raise before use, and two are needed."""
    raw = spark.createDataFrame([(v,) for v in given], "value string") if given else spark.read.text(path)
    r = raw.select(F.trim(X.strip_bom(F.col("value"))).alias("release")).where((F.col("release") != "") & ~F.col("release").startswith("#")).distinct()
    bad = [x[0] for x in r.where(~X.valid_version(F.col("release"))).limit(20).collect()]
    if bad:
        raise ValueError(f"not versions: {', '.join(bad)}")
    if r.limit(2).count() < 2:
        raise ValueError("two versions are needed")
    return r.orderBy(X.version(F.col("release")))


def expected_files(files: DataFrame, suffix: str = ".expected", ignored: str = ".ignored", include_ignored: bool = False) -> DataFrame:
    return files.where(F.col("path").endswith(suffix) | (F.lit(include_ignored) & F.col("path").endswith(f"{suffix}{ignored}")))


def blobs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and whole text of the files under a folder."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
