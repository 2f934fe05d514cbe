"""Queries over the driver's tables, each with the SQL that must give the same rows.

The tables stand in for the record kinds: a release is a year of orders and a
constant is a customer in it; a file is a document and a tag its source; a
diagnostic is an event (error, view as warning, others as information), its
cluster the user, its stratum the third of the month, and its span ends after
as many hours as its value; a window is a source and a signature the
normalised text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..catalog import query
from ..functions import text as X
from ..operators import binding, classify, dataset, drift, hunks, messages, rules, snapshot, weights, windows
from ..sources import readers, writers
from ..sources.readers import table

S = SparkSession

# ---------------------------------------------------------------- stage 1: term scan

TERMS = ["the", "ered", "ver", "quea"]


def _files(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("tag"), F.col("doc_id").alias("file"), "text")


def _sql_terms() -> str:
    one = " || ".join(f"CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_''!?]){t}($|[^A-Za-z0-9_''!?])') THEN '{t},' ELSE '' END" for t in TERMS)
    return f"""l AS (SELECT source AS tag, doc_id AS file, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
h AS (SELECT tag, file, line, rtrim({one}, ',') AS targets, trim(text, ' ') AS content FROM l)"""


@query(f"WITH {_sql_terms()} SELECT tag, file, line, targets, content FROM h WHERE targets <> ''")
def term_hits(spark: S, d: str) -> DataFrame:
    return readers.term_hits(_files(spark, d), TERMS).select("tag", "file", F.col("line").cast("long").alias("line"), F.array_join("targets", ",").alias("targets"), "content")


@query(f"WITH {_sql_terms()} SELECT tag, count(*) AS hits, count(DISTINCT file) AS files FROM h WHERE targets <> '' GROUP BY tag")
def term_hits_per_tag(spark: S, d: str) -> DataFrame:
    return readers.term_hits(_files(spark, d), TERMS).groupBy("tag").agg(F.count("*").alias("hits"), F.countDistinct("file").alias("files"))


@query(f"WITH {_sql_terms()} SELECT tag, md5(string_agg(file || ':' || line || ':' || targets, ';' ORDER BY file, line)) AS folded, count(*) AS n FROM h WHERE targets <> '' GROUP BY tag")
def fold_hits_by_tag(spark: S, d: str) -> DataFrame:
    h = readers.term_hits(_files(spark, d), TERMS).select("tag", F.struct("file", "line", F.concat_ws(":", F.col("file").cast("string"), F.col("line").cast("string"), F.array_join("targets", ",")).alias("s")).alias("r"))
    # A tag's record is one value by its nature: the log holds one JSON object a tag.
    return h.groupBy("tag").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["s"]), ";").cast("binary")).alias("folded"), F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_pending(spark: S, d: str) -> DataFrame:
    return readers.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_record_per_key(spark: S, d: str) -> DataFrame:
    return readers.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


# ---------------------------------------------------------------- stage 2: snapshots

SNAP = """snap AS (
  SELECT year(o_orderdate) AS release, o_custkey AS n, max(o_orderpriority) AS k, count(*) AS ar, string_agg(o_orderstatus, '' ORDER BY o_orderstatus) AS bi,
         md5(string_agg(o_orderpriority || '|' || o_orderstatus, ',' ORDER BY o_orderpriority || '|' || o_orderstatus)) AS th, bool_or(o_orderstatus = 'F') AS prot
  FROM orders GROUP BY ALL),
rel AS (SELECT release AS base, lead(release) OVER (ORDER BY release) AS target FROM (SELECT DISTINCT release FROM snap)),
pairs AS (SELECT * FROM rel WHERE target IS NOT NULL)"""
CAUSED = f"""{SNAP},
b AS (SELECT base, target, s.* EXCLUDE release FROM pairs JOIN snap s ON s.release = base),
t AS (SELECT base, target, s.* EXCLUDE release FROM pairs JOIN snap s ON s.release = target),
j AS (SELECT b.*, t.n IS NULL AS gone, t.k AS k2, t.ar AS ar2, t.bi AS bi2, t.th AS th2, t.prot AS prot2 FROM b LEFT JOIN t USING (base, target, n)),
fresh AS (SELECT t.* FROM t ANTI JOIN b ON t.base = b.base AND t.target = b.target AND t.n = b.n),
uniq AS (SELECT base, target, th, ar, min(n) AS dest FROM fresh GROUP BY ALL HAVING count(*) = 1),
lost AS (SELECT j.base, j.target, j.n, dest FROM j LEFT JOIN uniq USING (base, target, th, ar) WHERE gone),
causes AS (
  SELECT base, target, n AS name, CASE WHEN dest IS NULL THEN 'const.absent' ELSE 'const.renamed' END AS cause, dest::VARCHAR AS detail FROM lost
  UNION ALL SELECT base, target, n, 'const.kind-changed', k || ' -> ' || k2 FROM j WHERE NOT gone AND k IS DISTINCT FROM k2
  UNION ALL SELECT base, target, n, 'const.arity-changed', ar || ' -> ' || ar2 FROM j WHERE NOT gone AND ar IS DISTINCT FROM ar2
  UNION ALL SELECT base, target, n, 'const.binders-changed', bi || ' -> ' || bi2 FROM j WHERE NOT gone AND ar IS NOT DISTINCT FROM ar2 AND bi IS DISTINCT FROM bi2
  UNION ALL SELECT base, target, n, 'const.type-changed', th || ' -> ' || th2 FROM j WHERE NOT gone AND th IS DISTINCT FROM th2 AND ar = ar2 AND bi = bi2
  UNION ALL SELECT base, target, n, 'const.protected-changed', prot || ' -> ' || prot2 FROM j WHERE NOT gone AND prot IS DISTINCT FROM prot2)"""


def _snapshots(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("release"), F.col("o_custkey").alias("n"), "o_orderpriority", "o_orderstatus")
    both = F.concat_ws("|", "o_orderpriority", "o_orderstatus")
    return o.groupBy("release", "n").agg(
        F.max("o_orderpriority").alias("k"), F.count("*").alias("ar"), F.array_join(F.array_sort(F.collect_list("o_orderstatus")), "").alias("bi"),
        F.md5(F.array_join(F.array_sort(F.collect_list(both)), ",").cast("binary")).alias("th"), F.max(F.col("o_orderstatus") == "F").alias("prot"),
    )


def _hops(spark: S, d: str) -> DataFrame:
    return snapshot.pairs_of(table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("release")), F.col("release"))


def _sides(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    s, p = _snapshots(spark, d), _hops(spark, d)
    return snapshot.side(s, p, "base"), snapshot.side(s, p, "target")


def _causes(spark: S, d: str) -> DataFrame:
    return snapshot.chained(_snapshots(spark, d), _hops(spark, d))


@query(f"WITH {SNAP} SELECT * FROM snap")
def snapshot_records(spark: S, d: str) -> DataFrame:
    return _snapshots(spark, d)


@query(f"WITH {SNAP} SELECT release, count(*) AS consts, count(*) FILTER (prot) AS protected, count(DISTINCT k) AS kinds FROM snap GROUP BY release")
def snapshot_selfcheck(spark: S, d: str) -> DataFrame:
    return _snapshots(spark, d).groupBy("release").agg(F.count("*").alias("consts"), F.count_if("prot").alias("protected"), F.countDistinct("k").alias("kinds"))


@query(f"WITH {CAUSED} SELECT base, target, cause, name, detail FROM causes")
def diff_field_causes(spark: S, d: str) -> DataFrame:
    return _causes(spark, d).select("base", "target", "cause", "name", "detail")


@query(f"WITH {CAUSED} SELECT base, target, n AS name, 'attr.absent' AS cause, 'break' AS sev FROM j WHERE gone UNION ALL SELECT base, target, n, 'attr.absent.reverse', 'info' FROM fresh")
def diff_absent_and_reverse(spark: S, d: str) -> DataFrame:
    return snapshot.elements(*_sides(spark, d), "attr.absent", info=True).select("base", "target", "name", "cause", "sev")


@query(f"WITH {CAUSED} SELECT base, target, n, dest AS \"to\", count(*) OVER (PARTITION BY base, target, dest) AS claimants FROM lost WHERE dest IS NOT NULL")
def diff_renamed(spark: S, d: str) -> DataFrame:
    b, t = _sides(spark, d)
    key = ["base", "target", "n"]
    return snapshot.renames(b.join(t, key, "left_anti"), t.join(b, key, "left_anti")).select("base", "target", "n", "to", "claimants")


CAT = """c AS (SELECT p_size > 25 AS half, p_brand || '/' || p_type AS n, list(DISTINCT p_name) AS lead, list(DISTINCT split_part(p_name, ' ', 1)) AS kinds FROM part GROUP BY ALL)"""


@query(f"""WITH {CAT}, j AS (SELECT b.n, b.lead, b.kinds, t.n IS NULL AS gone, t.lead AS lead2, t.kinds AS kinds2 FROM (FROM c WHERE NOT half) b LEFT JOIN (FROM c WHERE half) t ON b.n = t.n)
SELECT n AS name, 'syntax.category-absent' AS cause, NULL::VARCHAR AS detail FROM j WHERE gone
UNION ALL SELECT n, 'syntax.token-absent', x FROM (SELECT n, unnest(list_filter(lead, lambda y: NOT list_contains(lead2, y))) AS x FROM j WHERE NOT gone)
UNION ALL SELECT n, 'syntax.kind-absent', x FROM (SELECT n, unnest(list_filter(kinds, lambda y: NOT list_contains(kinds2, y))) AS x FROM j WHERE NOT gone)""")
def diff_nested_sets(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "part").groupBy((F.col("p_size") > 25).alias("half"), F.concat_ws("/", "p_brand", "p_type").alias("n")).agg(F.collect_set("p_name").alias("lead"), F.collect_set(F.substring_index("p_name", " ", 1)).alias("kinds"))
    c = c.withColumns({"base": F.lit(0), "target": F.lit(1)})
    return snapshot.syntax(c.where("NOT half"), c.where("half")).select("name", "cause", "detail")


@query("""WITH s AS (SELECT year(o_orderdate) AS release, o_custkey AS n, max(o_orderpriority) AS v, count(*) AS p FROM orders GROUP BY ALL), b AS (FROM s WHERE release = 1995), t AS (FROM s WHERE release = 1996),
j AS (SELECT b.n, b.v, b.p, t.n IS NULL AS gone, t.v AS v2, t.p AS p2 FROM b LEFT JOIN t ON b.n = t.n)
SELECT n AS name, CASE WHEN gone THEN 'option.absent' ELSE 'option.default-changed' END AS cause, CASE WHEN NOT gone THEN v || ' -> ' || v2 END AS detail FROM j WHERE gone OR v IS DISTINCT FROM v2
UNION ALL SELECT n, CASE WHEN gone THEN 'instance.absent' ELSE 'instance.priority-changed' END, CASE WHEN NOT gone THEN p || ' -> ' || p2 END FROM j WHERE gone OR p IS DISTINCT FROM p2""")
def diff_option_and_instance(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("release"), F.col("o_custkey").alias("n")).agg(F.max("o_orderpriority").alias("default"), F.count("*").alias("prio"))
    s = s.withColumns({"base": F.lit(1995), "target": F.lit(1996)})
    b, t = s.where("release = 1995"), s.where("release = 1996")
    return snapshot.option_causes(b, t).unionByName(snapshot.instance_causes(b, t)).select("name", "cause", "detail")


@query("""WITH s AS (SELECT year(o_orderdate) AS release, o_custkey AS n, max(o_orderpriority) AS v, count(*) AS p FROM orders GROUP BY ALL),
r AS (SELECT release AS base, lead(release) OVER (ORDER BY release) AS target FROM (SELECT DISTINCT release FROM s)),
j AS (SELECT base, target, b.n, b.v, b.p, t.n IS NULL AS gone, t.v AS v2, t.p AS p2 FROM r JOIN s b ON b.release = base LEFT JOIN s t ON t.release = target AND t.n = b.n WHERE target IS NOT NULL)
SELECT base, target, n AS name, CASE WHEN gone THEN 'option.absent' ELSE 'option.default-changed' END AS cause, CASE WHEN NOT gone THEN v || ' -> ' || v2 END AS detail FROM j WHERE gone OR v IS DISTINCT FROM v2
UNION ALL SELECT base, target, n, CASE WHEN gone THEN 'instance.absent' ELSE 'instance.priority-changed' END, CASE WHEN NOT gone THEN p || ' -> ' || p2 END FROM j WHERE gone OR p IS DISTINCT FROM p2""")
def diff_option_and_instance_hops(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("release"), F.col("o_custkey").alias("n")).agg(F.max("o_orderpriority").alias("default"), F.count("*").alias("prio"))
    p = _hops(spark, d)
    b, t = snapshot.side(s, p, "base"), snapshot.side(s, p, "target")
    return snapshot.option_causes(b, t).unionByName(snapshot.instance_causes(b, t)).select("base", "target", "name", "cause", "detail")


@query("""SELECT c_custkey AS name, 'deprecation.alias-absent' AS cause FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def diff_double_anti(spark: S, d: str) -> DataFrame:
    pair = lambda df: df.withColumns({"base": F.lit(0), "target": F.lit(1)})
    o = table(spark, d, "orders")
    one, two = (pair(x.select(F.col("o_custkey").alias("n"))) for x in (o.where(F.year("o_orderdate") == 1996), o.where("o_orderstatus = 'F'")))
    return snapshot.deprecations(pair(table(spark, d, "customer").select(F.col("c_custkey").alias("n"))), one, two).select("name", "cause")


@query(f"WITH {CAUSED} SELECT cause, count(*) AS count FROM causes WHERE base = 1995 GROUP BY cause")
def cause_histogram(spark: S, d: str) -> DataFrame:
    return snapshot.histogram(snapshot.chained(_snapshots(spark, d), _hops(spark, d).where("base = 1995")))


@query(f"WITH {CAUSED} SELECT s.section, count(cause) AS breaks FROM (VALUES ('const'), ('instance'), ('option'), ('simp')) s(section) LEFT JOIN causes ON split_part(cause, '.', 1) = s.section GROUP BY ALL")
def section_subtotals(spark: S, d: str) -> DataFrame:
    return snapshot.sections(_causes(spark, d), ["const", "instance", "option", "simp"])


@query(f"WITH {CAUSED} SELECT p.base, p.target, count(cause) AS breaks, count(cause) FILTER (cause IN ({', '.join(repr(c) for c in vocab.SILENT)})) AS silent, " + ", ".join(f"count(*) FILTER (cause = '{c}') AS {snapshot.column_name(c)}" for c in vocab.CAUSES) + " FROM pairs p LEFT JOIN causes c ON p.base = c.base AND p.target = c.target GROUP BY ALL")
def chain_pivot(spark: S, d: str) -> DataFrame:
    return snapshot.chain(_causes(spark, d), _hops(spark, d))


_ENDS = CAUSED.replace("pairs AS (SELECT * FROM rel WHERE target IS NOT NULL)", "pairs AS (SELECT * FROM rel WHERE target IS NOT NULL UNION ALL SELECT min(release), max(release) FROM snap)")


@query(f"WITH {_ENDS}, e AS (SELECT min(release) AS lo, max(release) AS hi FROM snap) SELECT cause, count(*) FILTER (NOT (base = lo AND target = hi)) AS chained, count(*) FILTER (base = lo AND target = hi) AS direct FROM causes, e GROUP BY cause")
def endpoint_vs_chain(spark: S, d: str) -> DataFrame:
    s = _snapshots(spark, d)
    p = snapshot.pairs_of(table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("release")), F.col("release"), endpoint=True)
    c = snapshot.chained(s, p).join(F.broadcast(p), ["base", "target"])
    return c.groupBy("cause").agg(F.count_if(F.col("kind") == "hop").alias("chained"), F.count_if(F.col("kind") == "span").alias("direct"))


@query(f"""WITH {SNAP}, r AS (SELECT release, row_number() OVER (ORDER BY release) AS i FROM (SELECT DISTINCT release FROM snap)), p AS (SELECT n, min(i) AS a, max(i) AS z, count(*) AS k FROM snap JOIN r USING (release) GROUP BY n), m AS (SELECT count(*) AS m FROM r)
SELECT n, a AS first, z AS last, k AS n_releases, a > 1 AND z < m AS mid_only, z - a + 1 > k AS restored FROM p, m""")
def churn(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.year("o_orderdate").cast("long").alias("release")).distinct()
    return snapshot.churn(o, "name", "release").select(F.col("name").alias("n"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("n").alias("n_releases"), "mid_only", "restored")


@query(f"WITH {CAUSED} SELECT base, count(*) FILTER (cause NOT IN ({', '.join(repr(c) for c in vocab.SILENT)})) AS loud, count(*) FILTER (cause IN ({', '.join(repr(c) for c in vocab.SILENT)})) AS silent FROM causes GROUP BY base")
def loud_silent_totals(spark: S, d: str) -> DataFrame:
    quiet = F.col("cause").isin(vocab.SILENT)
    return _causes(spark, d).groupBy("base").agg(F.count_if(~quiet).alias("loud"), F.count_if(quiet).alias("silent"))


@query("SELECT * FROM (VALUES ('4.9.0', 1), ('4.16.0-rc1', 2), ('4.16.0', 3), ('4.16.1', 4), ('10.0.0', 5)) v(release, rank)")
def version_sort(spark: S, d: str) -> DataFrame:
    r = readers.versions(spark, given=["10.0.0", "4.16.1", "4.9.0", "4.16.0", "4.16.0-rc1"])
    return r.withColumn("rank", F.row_number().over(Window.orderBy(X.version(F.col("release")))))


@query(f"WITH {CAUSED}, c AS (SELECT cause, count(*) AS n FROM causes GROUP BY cause) SELECT cause, n AS count, round(100.0 * n / sum(n) OVER (), 2) AS share, row_number() OVER (ORDER BY n DESC, cause) AS rank, 'loud' AS tag FROM c")
def ranked_share_report(spark: S, d: str) -> DataFrame:
    return writers.ranked(snapshot.histogram(_causes(spark, d)), vocab.SILENT)


# ---------------------------------------------------------------- stage 3: messages and weights

SEV = "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'information' END"
EV = f"ev AS (SELECT event_id, user_id, {SEV} AS sev, event_type, value, ts FROM events)"


def _events(spark: S, d: str) -> DataFrame:
    sev = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "warning").otherwise("information")
    return table(spark, d, "events").withColumn("sev", sev)


@query(f"""WITH {EV} SELECT event_id, 'f' || user_id || '.x' AS file, (event_id % 97)::INT AS line, (user_id % 13)::INT AS col, sev AS severity, event_type AS error_name, 'k is ' || event_id AS text FROM ev""")
def header_parse(spark: S, d: str) -> DataFrame:
    e = _events(spark, d)
    line = F.concat(F.lit("f"), "user_id", F.lit(".x:"), F.col("event_id") % 97 + 1, F.lit(":"), F.col("user_id") % 13, F.lit(": "), F.replace("sev", F.lit("information"), F.lit("info")), F.lit("("), "event_type", F.lit("): k is "), "event_id")
    files = e.select(F.col("event_id").cast("string").alias("path"), F.lit("v").alias("toolchain"), F.concat(F.lit("noise\n"), line, F.lit("\n\n")).alias("content"))
    m = readers.harvest(files)
    return m.select(F.col("path").cast("long").alias("event_id"), "file", F.col("start.line").alias("line"), F.col("start.column").alias("col"), "severity", "error_name", "text")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
g AS (SELECT *, (sum((length(t) % 3 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY line))::BIGINT AS id FROM l) SELECT doc_id, id, min(line) AS first_line, count(*) AS n_lines, sum(length(t))::BIGINT AS chars FROM g WHERE id > 0 GROUP BY doc_id, id""")
def message_bodies(spark: S, d: str) -> DataFrame:
    l = readers.lines(table(spark, d, "documents"), keep=("doc_id",))
    g = l.withColumn("id", F.sum((F.length("text") % 3 == 0).cast("int")).over(Window.partitionBy("doc_id").orderBy("line")))
    return g.where("id > 0").groupBy("doc_id", "id").agg(F.min(F.col("line").cast("long")).alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' WHEN 'click' THEN 'information' ELSE 'unknown' END AS severity, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'm' || user_id END AS text, greatest((event_id % 50)::INT - 1, 0) AS line, (json_extract_string(props, '$.k'))::INT AS col FROM events")
def json_diagnostic_fallbacks(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events")
    code = F.when(F.col("event_type") == "error", "1").when(F.col("event_type") == "view", '"warning"').when(F.col("event_type") == "click", '"info"').otherwise("77")
    msg = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"data":"'), "event_type", F.lit('"'))).otherwise(F.concat(F.lit('"message":"m'), "user_id", F.lit('"')))
    value = F.concat(F.lit('{"severity":'), code, F.lit(","), msg, F.lit(',"pos":{"line":'), F.col("event_id") % 50, F.lit(',"column":'), F.get_json_object("props", "$.k"), F.lit('},"id":'), "event_id", F.lit("}"))
    m = readers.json_diagnostics(e.select(value.alias("value"), F.lit("f").alias("file"), F.lit("v").alias("toolchain")))
    return m.select(F.col("extra")["id"].cast("long").alias("event_id"), "severity", "text", F.col("start.line").alias("line"), F.col("start.column").alias("col"))


_SCRUB_IN = "'/a/b-c/' || source || '.lean:' || doc_id || ' u_' || n_chars || ' ?m.' || doc_id || ' took ' || n_chars || ' ms, ' || doc_id || ' heartbeats in match_' || doc_id || chr(10) || chr(10) || chr(10) || chr(10) || 'end  ' || chr(10)"


@query("SELECT doc_id, source || '.lean:' || doc_id || ' u_‹n› ?m.‹n› took ‹n›ms, ‹n› heartbeats in match_‹n›' || chr(10) || chr(10) || 'end' AS text FROM documents")
def scrub_text(spark: S, d: str) -> DataFrame:
    t = F.expr(_SCRUB_IN.replace("chr(10)", "'\\n'"))
    return table(spark, d, "documents").select("doc_id", X.scrub(t).alias("text"))


_MSG = "CASE WHEN doc_id % 3 = 0 THEN 'unknown thing ' || source WHEN doc_id % 3 = 1 THEN 'type mismatch' || chr(10) || '  ' || lang || chr(10) || 'Hint: ' || source ELSE 'unsolved goals' || chr(10) || '  case a' || chr(10) || '  ⊢ ' || lang || chr(10) || 'Note: x' || chr(10) || 'Hint: y' END"


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'unknown thing ' || source WHEN 1 THEN 'type mismatch' ELSE 'unsolved goals' END AS head, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN lang ELSE 'case a' || chr(10) || '  ⊢ ' || lang END AS payload,
CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Hint' ELSE 'Note,Hint' END AS trailers, CASE doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'term:1' ELSE 'goal:1' END AS shape FROM documents""")
def split_message_parts(spark: S, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("doc_id", X.split_message(F.expr(_MSG.replace("chr(10)", "'\\n'"))).alias("m"))
    return m.select("doc_id", "m.head", "m.payload", F.array_join("m.trailers", ",").alias("trailers"), X.payload_shape(F.col("m.payload")).alias("shape"))


@query("""SELECT substr(sha1('name:' || lang || '|' || CASE WHEN n_chars > 1500 THEN 'error' ELSE 'warning' END), 1, 20) AS fingerprint, count(*) AS n FROM documents GROUP BY ALL""")
def fingerprint_counts(spark: S, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    fp = X.fingerprint(F.lit("t"), none, F.when(F.col("n_chars") > 1500, "error").otherwise("warning"), F.col("lang"), none, F.lit("none"))
    return table(spark, d, "documents").groupBy(fp.alias("fingerprint")).agg(F.count("*").alias("n"))


def _observations(spark: S, d: str) -> DataFrame:
    """cluster, seq, fingerprint, severity, start and end (hours), prone, stratum."""
    e = _events(spark, d)
    hour = F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600
    start = F.floor(hour).cast("long")
    fp = F.concat_ws(":", "event_type", (F.col("value") % 5).cast("int").cast("string"))
    third = F.concat(F.lit("s"), F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)))
    return e.select(F.col("user_id").alias("cluster"), F.col("event_id").alias("seq"), fp.alias("fingerprint"), F.col("sev").alias("severity"), start.alias("start"), (start + F.floor("value").cast("long")).alias("end"), (F.col("value") > 50).alias("prone"), third.alias("stratum"), "event_type")


OBS = f"""ob AS (SELECT user_id AS cluster, event_id AS seq, event_type || ':' || trunc(value % 5)::INT AS fingerprint, {SEV} AS severity, floor(epoch(ts) / 3600)::BIGINT AS start, floor(epoch(ts) / 3600)::BIGINT + floor(value)::BIGINT AS stop, value > 50 AS prone,
's' || least((day(ts) - 1) // 10, 2) AS stratum, event_type FROM events)"""
W3 = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
PRI = "pri AS (SELECT * FROM (VALUES ('s0', 0.5), ('s1', 0.3), ('s2', 0.2)) p(stratum, w))"


@query(f"WITH {OBS} SELECT cluster, seq, row_number() OVER (PARTITION BY cluster, fingerprint, start ORDER BY seq) > 1 AS repeat, severity = 'warning' AND prone AND coalesce(min(CASE WHEN severity = 'error' THEN start END) OVER (PARTITION BY cluster ORDER BY start, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < start, false) AS after_error FROM ob")
def cascade_windows(spark: S, d: str) -> DataFrame:
    o = _observations(spark, d)
    rep = weights.repeats([F.col("cluster"), F.col("fingerprint"), F.col("start")], F.col("seq"))
    late = weights.after_first_error(F.col("cluster"), [F.col("start"), F.col("seq")], F.col("severity"), F.col("prone"), F.col("start"))
    return o.select("cluster", "seq", rep.alias("repeat"), F.coalesce(late, F.lit(False)).alias("after_error"))


@query()
def cascade_collapse(spark: S, d: str) -> DataFrame:
    return weights.collapse(_observations(spark, d))


@query(f"WITH {OBS} SELECT stratum, fingerprint, count(*) AS c, (sum(count(*)) OVER (PARTITION BY stratum))::BIGINT AS n FROM ob GROUP BY stratum, fingerprint")
def stratum_shares(spark: S, d: str) -> DataFrame:
    return weights.shares(_observations(spark, d))


_POINT = f"WITH {OBS}, {PRI}, c AS (SELECT stratum, fingerprint, count(*) AS c, sum(count(*)) OVER (PARTITION BY stratum) AS n FROM ob GROUP BY stratum, fingerprint), e AS (SELECT fingerprint, sum(w * c / n) AS weight FROM c JOIN pri USING (stratum) GROUP BY fingerprint)"


@query(f"{_POINT} SELECT fingerprint, round(weight, 9) AS weight FROM e")
def post_stratified_weight(spark: S, d: str) -> DataFrame:
    return weights.point(weights.shares(_observations(spark, d)), weights.prior(spark, W3)).select("fingerprint", F.round("weight", 9).alias("weight"))


@query(f"{_POINT} SELECT fingerprint, round(weight, 9) AS weight, count(*) AS raw_count, count(*) FILTER (severity = 'error') AS root_count, count(DISTINCT stratum || '/' || cluster) AS clusters, arg_min(severity, seq) AS severity FROM e JOIN ob USING (fingerprint) GROUP BY ALL")
def weight_metadata(spark: S, d: str) -> DataFrame:
    o = _observations(spark, d).withColumn("is_root", F.col("severity") == "error")
    return weights.table(o, weights.prior(spark, W3), roots_only=False).select("fingerprint", F.round("weight", 9).alias("weight"), "raw_count", "root_count", "clusters", "severity")


@query(f"""{_POINT}, f AS (SELECT fingerprint, sum(w * c / n) AS weight FROM c JOIN (VALUES ('s0', 0.1), ('s1', 0.1), ('s2', 0.8)) p(stratum, w) USING (stratum) GROUP BY fingerprint),
r AS (SELECT fingerprint, rank FROM (SELECT fingerprint, row_number() OVER (ORDER BY round(weight, 12) DESC, fingerprint) - 1 AS rank FROM e) WHERE rank < 10 UNION ALL SELECT fingerprint, rank FROM (SELECT fingerprint, row_number() OVER (ORDER BY round(weight, 12) DESC, fingerprint) - 1 AS rank FROM f) WHERE rank < 10)
SELECT fingerprint, count(*) AS n_priors, min(rank)::BIGINT AS best, max(rank)::BIGINT AS worst, (max(rank) - min(rank))::BIGINT AS spread FROM r GROUP BY fingerprint""")
def prior_sensitivity(spark: S, d: str) -> DataFrame:
    p = {"a": weights.prior(spark, W3), "b": weights.prior(spark, {"s0": 0.1, "s1": 0.1, "s2": 0.8})}
    r = weights.sensitivity(_observations(spark, d), p, top=10)
    return r.select("fingerprint", "n_priors", *[F.col(c).cast("long").alias(c) for c in ("best", "worst", "spread")])


_CI = f"""WITH {OBS}, {PRI}, cell AS (SELECT stratum, cluster, fingerprint, count(*) AS c FROM ob GROUP BY ALL),
num AS (SELECT stratum, cluster, row_number() OVER (PARTITION BY stratum ORDER BY cluster) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS k FROM (SELECT DISTINCT stratum, cluster FROM ob)),
drawn AS (SELECT r, stratum, ('0x' || substr(md5('0|' || r || '|' || stratum || '|' || i), 1, 8))::BIGINT % k AS i FROM num, range(40) t(r)),
cnt AS (SELECT r, d.stratum, fingerprint, sum(c) AS c FROM drawn d JOIN num USING (stratum, i) JOIN cell ON cell.stratum = d.stratum AND cell.cluster = num.cluster GROUP BY ALL),
est AS (SELECT r, fingerprint, sum(w * c / n) AS weight FROM (SELECT *, sum(c) OVER (PARTITION BY r, stratum) AS n FROM cnt) JOIN pri USING (stratum) GROUP BY ALL),
al AS (SELECT f.fingerprint, list_sort(list(coalesce(weight, 0))) AS ws FROM (SELECT DISTINCT fingerprint FROM est) f CROSS JOIN range(40) t(r) LEFT JOIN est ON est.r = t.r AND est.fingerprint = f.fingerprint GROUP BY ALL)
SELECT fingerprint, round(ws[2], 9) AS ci_low, round(ws[39], 9) AS ci_high FROM al"""


@query(_CI)
def bootstrap_ci(spark: S, d: str) -> DataFrame:
    r = weights.bootstrap(_observations(spark, d), weights.prior(spark, W3), draws=40)
    return r.select("fingerprint", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


@query(_CI.replace("range(40)", "range(400)").replace("ws[2]", "ws[11]").replace("ws[39]", "ws[390]"))
def bootstrap_ci_400(spark: S, d: str) -> DataFrame:
    r = weights.bootstrap(_observations(spark, d), weights.prior(spark, W3))
    return r.select("fingerprint", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


def _turns(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return messages.prepared(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("role").alias("severity"), F.lit(None).cast("string").alias("error_name"), "text"))


@query()
def template_fit(spark: S, d: str) -> DataFrame:
    return messages.fit(_turns(spark, d)).select("bucket", "template_id", "template", F.array_join("hole_kinds", ",").alias("hole_kinds"), "n")


@query()
def template_assign(spark: S, d: str) -> DataFrame:
    m = _turns(spark, d)
    return messages.assign(m, messages.fit(m)).select("seq", "template", F.round("ratio", 6).alias("ratio"))


@query("""WITH r AS (SELECT split_part(text, ' ', 1) AS template, role AS error_name FROM conversations),
n AS (SELECT error_name, count(DISTINCT template) AS k, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT template, count(DISTINCT error_name) AS k FROM r GROUP BY ALL)
SELECT (SELECT sum(n)::BIGINT FROM n) AS labelled, (SELECT count(*) FROM n) AS names, (SELECT count(*) FROM n WHERE k > 1) AS names_split, (SELECT count(*) FROM t WHERE k > 1) AS templates_mixed""")
def template_purity(spark: S, d: str) -> DataFrame:
    return messages.purity(table(spark, d, "conversations").select(F.substring_index("text", " ", 1).alias("template"), F.col("role").alias("error_name")))


def _tags(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("idx"), F.substring_index("text", " ", 3).alias("prose"), "role")
    a = c.select("path", "idx", "prose", F.when(F.col("idx") % 2 == 0, "error").otherwise("warning").alias("severity"), F.when(F.col("idx") % 3 == 0, F.col("role")).alias("name")).where("(idx + length(prose)) % 5 <> 0")
    b = c.select("path", "idx", F.when(F.col("idx") % 4 == 3, F.concat("prose", F.lit("!"))).otherwise(F.col("prose")).alias("prose"), F.when(F.col("idx") % 5 == 0, "error").otherwise("warning").alias("severity"), F.when(F.col("idx") % 2 == 0, F.col("role")).alias("name")).where("(idx + length(prose)) % 7 <> 0")
    return a, b


@query("""WITH c AS (SELECT conv_id::VARCHAR AS path, turn AS idx, array_to_string(string_split(text, ' ')[1:3], ' ') AS prose, role FROM conversations),
a AS (SELECT path, idx, prose, CASE WHEN idx % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN idx % 3 = 0 THEN role END AS name FROM c WHERE (idx + length(prose)) % 5 <> 0),
b0 AS (SELECT path, idx, CASE WHEN idx % 4 = 3 THEN prose || '!' ELSE prose END AS prose, CASE WHEN idx % 5 = 0 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN idx % 2 = 0 THEN role END AS name FROM c),
b AS (SELECT * FROM b0 WHERE (idx + length(prose)) % 7 <> 0),
j AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.idx, b.idx) AS idx, a.path IS NULL AS no_a, b.path IS NULL AS no_b, a.prose AS p, b.prose AS q, a.severity AS s, b.severity AS u, a.name AS m, b.name AS n FROM a FULL JOIN b ON a.path = b.path AND a.idx = b.idx)
SELECT path, idx, CASE WHEN no_b THEN 'removed' WHEN no_a THEN 'added' WHEN p = q AND m IS DISTINCT FROM n THEN 'retag' WHEN p = q THEN 'reseverity' ELSE 'retext' END AS kind, p AS before, q AS after, m AS before_name, n AS after_name FROM j
WHERE no_a OR no_b OR p <> q OR s <> u OR m IS DISTINCT FROM n""")
def drift_exact(spark: S, d: str) -> DataFrame:
    return drift.exact(*_tags(spark, d))


def _turn_pairs(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    """Whole turns, and under each one's key the turn after it: every turn is in both sides."""
    c = table(spark, d, "conversations")
    side = lambda at: c.select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") - at).alias("idx"), F.col("text").alias("prose"), F.when(F.col("turn") % 2 == 0, "error").otherwise("warning").alias("severity"), F.col("role").alias("name"))
    return side(0), side(1)


@query("""WITH c AS (SELECT conv_id::VARCHAR AS path, turn, text, CASE WHEN turn % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, role FROM conversations),
j AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.turn, b.turn - 1) AS idx, a.path IS NULL AS no_a, b.path IS NULL AS no_b, a.text AS p, b.text AS q, a.severity AS s, b.severity AS u, a.role AS m, b.role AS n FROM c a FULL JOIN c b ON a.path = b.path AND a.turn = b.turn - 1)
SELECT path, idx, CASE WHEN no_b THEN 'removed' WHEN no_a THEN 'added' WHEN p IS DISTINCT FROM q THEN 'retext' WHEN m IS DISTINCT FROM n THEN 'retag' ELSE 'reseverity' END AS kind, p AS before, q AS after, m AS before_name, n AS after_name FROM j
WHERE no_a OR no_b OR p IS DISTINCT FROM q OR s <> u OR m IS DISTINCT FROM n""")
def drift_exact_turns(spark: S, d: str) -> DataFrame:
    return drift.exact(*_turn_pairs(spark, d))


@query()
def drift_fuzzy(spark: S, d: str) -> DataFrame:
    return drift.drift(*_turn_pairs(spark, d)).withColumn("similarity", F.round("similarity", 6))


_REAL = "r AS (SELECT DISTINCT substr(md5(source || lang), 1, 8) AS fingerprint, CASE WHEN source < 'src2' THEN lang END AS error_name FROM documents), l AS (SELECT * FROM (VALUES ('en', 'c1'), ('en', 'c2'), ('fr', 'c1'), ('xx', 'c9')) v(error_name, cause_id)), dm AS (SELECT DISTINCT substr(md5('src' || (doc_id % 23) || 'de'), 1, 8) AS fingerprint, 'd' || (doc_id % 23) AS cause_id FROM labels)"


def _bind(spark: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = table(spark, d, "documents").select(F.substring(F.md5(F.concat("source", "lang").cast("binary")), 1, 8).alias("fingerprint"), F.when(F.col("source") < "src2", F.col("lang")).alias("error_name")).distinct()
    names = spark.createDataFrame([("en", "c1"), ("en", "c2"), ("fr", "c1"), ("xx", "c9")], "error_name string, cause_id string")
    k = F.col("doc_id") % 23
    dm = table(spark, d, "labels").select(F.substring(F.md5(F.concat(F.lit("src"), k, F.lit("de")).cast("binary")), 1, 8).alias("fingerprint"), F.concat(F.lit("d"), k).alias("cause_id"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("note")).distinct()
    return r, names, dm


@query(f"WITH {_REAL} SELECT fingerprint, cause_id, 1.0::DOUBLE AS confidence, 'error_name' AS basis, error_name AS note FROM r JOIN l USING (error_name) UNION ALL SELECT fingerprint, cause_id, 0.5::DOUBLE, 'declared', NULL FROM r JOIN dm USING (fingerprint)")
def binding_edges(spark: S, d: str) -> DataFrame:
    r, names, dm = _bind(spark, d)
    return binding.edges(r, names, dm)


@query(f"WITH {_REAL} SELECT fingerprint, error_name FROM r WHERE fingerprint NOT IN (SELECT fingerprint FROM dm) AND (error_name IS NULL OR error_name NOT IN (SELECT error_name FROM l))")
def binding_unbound(spark: S, d: str) -> DataFrame:
    r, names, dm = _bind(spark, d)
    return binding.unbound(r, binding.edges(r, names, dm))


@query(f"WITH {_REAL} SELECT DISTINCT fingerprint FROM dm WHERE fingerprint NOT IN (SELECT fingerprint FROM r)")
def binding_stale(spark: S, d: str) -> DataFrame:
    r, _, dm = _bind(spark, d)
    return binding.stale(dm, r)


# ---------------------------------------------------------------- stage 4: mining

_SUBJ = "CASE p_partkey % 5 WHEN 0 THEN 'chore: bump toolchain to v4.' || p_size || '.0 (#' || p_partkey || ')' WHEN 1 THEN 'chore: adaptations for ' || split_part(p_name, ' ', 1) || '#' || p_size || ' (#' || p_partkey || ')' WHEN 2 THEN 'chore: backport fixes from nightly-testing' WHEN 3 THEN 'feat: ' || p_name ELSE 'chore: adapt to ' || p_type END"


def _commits(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part")
    subject = F.expr(_SUBJ.replace("split_part(p_name, ' ', 1)", "substring_index(p_name, ' ', 1)"))
    parents = F.when(F.col("p_partkey") == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), F.col("p_partkey") - 1)))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00"))
    return p.select(F.concat(F.lit("c"), "p_partkey").alias("sha"), parents.alias("parents"), day.alias("author_date"), subject.alias("subject"), F.lit("").alias("body"), "p_brand")


def _blobs(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("sha"), F.concat(F.lit("v"), F.floor(F.col("p_partkey") / 7)).alias("version"))


_WIN = f"""c AS (SELECT p_partkey AS i, {_SUBJ} AS subject, '2024-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS date, p_size, p_name, p_type FROM part WHERE p_partkey > 0),
sq AS (SELECT CASE i % 5 WHEN 0 THEN 'bump' WHEN 2 THEN 'backport' ELSE 'dep-adaptation' END AS kind, CASE i % 5 WHEN 0 THEN 'v4.' || p_size || '.0' WHEN 1 THEN split_part(p_name, ' ', 1) || '#' || p_size WHEN 2 THEN 'nightly-testing' ELSE p_type END AS key, 'squash' AS source, i, date, nullif(regexp_extract(subject, '\\(#(\\d+)\\)$', 1), '') AS pr FROM c WHERE i % 5 <> 3),
vf AS (SELECT 'bump' AS kind, 'v' || (i // 7) AS key, 'version-file' AS source, i, date, nullif(regexp_extract(subject, '\\(#(\\d+)\\)$', 1), '') AS pr FROM c WHERE i % 7 = 0),
u AS (SELECT * FROM sq UNION ALL SELECT * FROM vf WHERE i NOT IN (SELECT i FROM sq))"""


@query(f"WITH {_WIN} SELECT kind, key, source, 'c' || i AS tip, 'c' || (i - 1) AS base, date, pr, 'v' || ((i - 1) // 7) AS version_before, 'v' || (i // 7) AS version_after FROM u")
def window_discovery(spark: S, d: str) -> DataFrame:
    c, b = _commits(spark, d), _blobs(spark, d)
    return windows.merged([windows.from_messages(c, b), windows.from_version_changes(c, b)]).drop("ref")


@query("""WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id, before, event_type AS after FROM e WHERE before IS NOT NULL AND before <> event_type""")
def state_change_windows(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.lag("event_type").over(w).alias("before"), F.col("event_type").alias("after"))
    return e.where("before is not null and before <> after")


def _lines(spark: S, d: str) -> DataFrame:
    l = readers.lines(table(spark, d, "documents"), keep=("doc_id",))
    kind = F.when(F.length("text") % 4 == 0, "-").when(F.length("text") % 4 == 1, "+").otherwise(" ")
    return l.select(F.col("doc_id").alias("path"), F.lit(0).alias("hunk_seq"), F.col("line").alias("seq"), kind.alias("kind"), "text", F.lit(1).alias("old_start"), F.lit(1).alias("new_start"))


_LN = "l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS seq FROM documents), k AS (SELECT *, CASE length(text) % 4 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END AS kind FROM l)"


@query(f"""WITH {_LN}, c AS (SELECT *, lag(seq) OVER (PARTITION BY path ORDER BY seq) AS before FROM k WHERE kind <> ' '), g AS (SELECT *, (sum((before IS NULL OR seq - before > 2)::INT) OVER (PARTITION BY path ORDER BY seq))::BIGINT AS run FROM c)
SELECT path, run, min(seq)::BIGINT AS first_seq, count(*) FILTER (kind = '-') AS n_old, count(*) FILTER (kind = '+') AS n_new, max(seq) - min(seq) + 1 AS n_body FROM g GROUP BY path, run""")
def hunk_runs(spark: S, d: str) -> DataFrame:
    h = hunks.hunks(hunks.numbered(_lines(spark, d)), gap=1)
    return h.select("path", "run", F.col("first_seq").cast("long").alias("first_seq"), F.size("old_lines").cast("long").alias("n_old"), F.size("new_lines").cast("long").alias("n_new"), F.size("body").cast("long").alias("n_body"))


@query(f"WITH {_LN} SELECT path, seq, last_value(CASE WHEN length(text) % 7 = 0 THEN seq END IGNORE NULLS) OVER (PARTITION BY path ORDER BY seq) AS decl FROM k")
def enclosing_decl(spark: S, d: str) -> DataFrame:
    l = _lines(spark, d).withColumn("seq", F.col("seq").cast("long"))
    return hunks.enclosing(l, F.length("text") % 7 == 0, F.col("seq"), order="seq").select("path", "seq", "decl")


_PRE = "CASE p_partkey % 8 WHEN 0 THEN 'open ' || x || ' Foo' WHEN 1 THEN 'set_option linter.' || x || ' true' WHEN 2 THEN 'simp only [' || x || ', b]' WHEN 3 THEN x || '_' || y || ' h' WHEN 4 THEN x || ' := ' || y WHEN 5 THEN 'exact ' || x || '_lemma h' WHEN 6 THEN '  apply ' || x ELSE 'import A.' || x END"
_POST = "CASE p_partkey % 8 WHEN 0 THEN 'open ' || x WHEN 1 THEN 'set_option maxHeartbeats 400' WHEN 2 THEN 'simp only [' || x || ', c]' WHEN 3 THEN x || '_' || y || '_new h' WHEN 4 THEN x || ' :=   ' || y || ' -- note' WHEN 5 THEN 'exact foo (' || x || '_lemma h)' WHEN 6 THEN '  exact ' || x ELSE 'import A.B.' || x END"


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'rename.open_scope' WHEN 1 THEN 'lint.disabled,perf.heartbeats' WHEN 2 THEN 'auto.simp_lemma_added,auto.simp_lemma_removed,rename.decl' WHEN 3 THEN 'rename.decl' WHEN 4 THEN 'meta.formatting' WHEN 5 THEN 'auto.term_wrapped' WHEN 6 THEN 'auto.tactic_swap,rename.decl' ELSE 'rename.decl,rename.import' END AS labels FROM part""")
def classify_rules(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumns({"x": F.substring_index("p_name", " ", 1), "y": F.substring_index("p_name", " ", -1)})
    c = classify.classify(p.select("p_partkey", F.expr(_PRE).alias("pre"), F.expr(_POST).alias("post")))
    return c.select("p_partkey", F.array_join(F.array_sort("labels"), ",").alias("labels"))


@query("""WITH s AS (SELECT o_custkey AS n, list_sort(list_distinct(list(o_orderstatus) FILTER (o_orderpriority < '3'))) AS a, list_sort(list_distinct(list(o_orderstatus) FILTER (o_orderpriority >= '3'))) AS b FROM orders GROUP BY 1), t AS (SELECT n, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT n, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS removed, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS added, a = b AS same, list_has_any(a, b) AS overlap FROM t""")
def array_delta(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    part = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("o_orderstatus"))))
    g = o.groupBy(F.col("o_custkey").alias("n")).agg(part(F.col("o_orderpriority") < "3").alias("a"), part(F.col("o_orderpriority") >= "3").alias("b"))
    return g.select("n", F.array_join(F.array_except("a", "b"), ",").alias("removed"), F.array_join(F.array_except("b", "a"), ",").alias("added"), (F.col("a") == F.col("b")).alias("same"), F.arrays_overlap("a", "b").alias("overlap"))


_PAIR = "pr AS (SELECT doc_id AS seq, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS signature, source AS context, lang AS label, source AS file, quality, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'd' || (doc_id % 11) END AS decl, round(coalesce(quality, 0) + (doc_id % 10) / 10.0, 1) AS confidence FROM documents LEFT JOIN labels USING (doc_id))"


def _pairs(spark: S, d: str) -> DataFrame:
    lab = table(spark, d, "labels").select("doc_id", "quality")
    sig = F.md5(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("binary"))
    return table(spark, d, "documents").join(lab, "doc_id", "left").select(F.col("doc_id").alias("seq"), sig.alias("signature"), F.col("source").alias("context"), F.col("lang").alias("label"), F.col("source").alias("file"), "quality", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("d"), F.col("doc_id") % 11)).alias("decl"), F.round(F.coalesce("quality", F.lit(0)) + (F.col("doc_id") % 10) / 10, 1).cast("double").alias("confidence"))


@query(f"WITH {_PAIR}, f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY signature) AS duplicate_count, row_number() OVER (PARTITION BY signature, context ORDER BY seq) AS n FROM pr) WHERE n = 1) SELECT signature, context, seq, duplicate_count FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY seq) AS m FROM f) WHERE m <= 2")
def dedup_topk_context(spark: S, d: str) -> DataFrame:
    return dataset.dedup(_pairs(spark, d), keep=2).select("signature", "context", "seq", "duplicate_count")


@query(f"WITH {_PAIR}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY md5('0|' || seq), seq) AS n FROM pr) WHERE n <= 1) SELECT seq, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, decl NULLS FIRST, md5('1|' || seq), seq) AS m FROM a) WHERE m <= 50")
def rebalance_caps(spark: S, d: str) -> DataFrame:
    return dataset.rebalance(_pairs(spark, d), per_label=50, per_signature=1).select("seq", "label")


@query("""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT source, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY md5(source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
s AS (SELECT *, min(CASE WHEN before >= 0.8 * total THEN before END) OVER () AS start FROM p) SELECT doc_id, source, CASE WHEN before < 0.8 * total THEN 'train' WHEN before - start < 0.1 * total THEN 'val' ELSE 'test' END AS split FROM documents JOIN s USING (source)""")
def split_groups(spark: S, d: str) -> DataFrame:
    return dataset.split(table(spark, d, "documents").select("doc_id", "source"), "source")


@query(f"WITH {_PAIR} SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM pr GROUP BY label")
def label_report(spark: S, d: str) -> DataFrame:
    return dataset.report(_pairs(spark, d))


@query(f"WITH {_PAIR}, n AS (SELECT label, count(*) AS n FROM pr GROUP BY label) SELECT (SELECT count(*) FROM pr) AS total, (SELECT count(*) FROM n) AS labels, round(100.0 * (SELECT max(n) FROM n) / (SELECT count(*) FROM pr), 2) AS top_share, (SELECT count(DISTINCT file) FROM pr) AS files, (SELECT count(DISTINCT decl) FROM pr) AS decls")
def dataset_totals(spark: S, d: str) -> DataFrame:
    return dataset.totals(_pairs(spark, d))


def _edits(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("next", F.lead("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("next is not null and next <> o_orderpriority")
    name = lambda c: F.concat(F.lit("p"), F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    e = o.select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderkey").alias("seq"), name("o_orderpriority").alias("old"), name("next").alias("new"), F.col("o_orderstatus").alias("label"), F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("file"), F.concat(F.lit("w"), F.year("o_orderdate")).alias("window"), F.lit("v").alias("toolchain"), F.lit(1).alias("duplicate_count"))
    return e.select("*", F.array(F.struct("old", "new")).alias("subs"), F.col("old").alias("broken"), F.col("new").alias("fixed")).drop("old", "new")


_IND = "e AS (SELECT *, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders), r AS (SELECT 'p' || regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g') AS old, 'p' || regexp_replace(nxt, '[^A-Za-z0-9]', '', 'g') AS new, count(*) AS support, count(DISTINCT o_custkey % 50) AS files, arg_min(o_orderstatus, o_orderkey) AS label FROM e WHERE nxt <> o_orderpriority GROUP BY ALL HAVING count(*) >= 2)"


@query(f"WITH {_IND} SELECT 'subs-' || substr(sha1('subst' || chr(0) || old || chr(0) || new), 1, 12) AS rule_id, old, new, support, files, label FROM r")
def induce_rules(spark: S, d: str) -> DataFrame:
    return rules.induce(_edits(spark, d)).select("rule_id", "old", "new", "support", "files", "label")


_RULE = "count(*) AS support, count(DISTINCT o_custkey % 50) AS files, arg_min(o_orderstatus, o_orderkey) AS label"
_FIRSTS = "SELECT kind, old, new, list(win ORDER BY s)[1:3] AS windows FROM (SELECT kind, old, new, 'w' || year(o_orderdate) AS win, min(o_orderkey) AS s FROM k GROUP BY ALL) GROUP BY ALL"


@query(f"""WITH e AS (SELECT *, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders),
p AS (SELECT *, 'p' || regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g') AS old, 'p' || regexp_replace(nxt, '[^A-Za-z0-9]', '', 'g') AS new FROM e WHERE nxt <> o_orderpriority),
k AS (SELECT *, unnest(['subst', 'window']) AS kind FROM p), r AS (SELECT kind, old, new, {_RULE} FROM k GROUP BY ALL HAVING count(*) >= 2), f AS ({_FIRSTS})
SELECT substr(kind, 1, 4) || '-' || substr(sha1(kind || chr(0) || old || chr(0) || new), 1, 12) AS rule_id, kind, old, new, support, files, label, array_to_string(windows, ',') AS windows FROM r JOIN f USING (kind, old, new)""")
def induce_rules_all(spark: S, d: str) -> DataFrame:
    return rules.induce(_edits(spark, d), renames=True).select("rule_id", "kind", "old", "new", "support", "files", "label", F.array_join("origins", ",").alias("windows"))


_NAME = r"'(^|[^\p{L}\p{N}_.''!?])the(\.[^A-Z]|\.$|[^\p{L}\p{N}_''!?.]|$)', '\1zz_the\2', 'g'"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, {_NAME}), {_NAME}), {_NAME}) AS forward FROM documents")
def apply_rules(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.applied(F.col("text"), F.lit("subst"), F.lit("the"), F.lit("zz_the")).alias("forward"))


@query()
def synthesize_capped(spark: S, d: str) -> DataFrame:
    r = spark.createDataFrame([("subs-1", "subst", "l1", "thee", "the", 9, True), ("subs-2", "subst", "l2", "unx", "und", 5, True), ("wind-1", "window", "l3", "of teh", "of the", 3, True)], "rule_id string, kind string, label string, old string, new string, support int, reversible boolean")
    return rules.synthesize(r, table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text"), n=200, per_rule=20).select("sample_id", "rule_id", "path", F.md5(F.col("broken").cast("binary")).alias("broken_md5"))


_CAL = """res AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_type = 'signup' AND value > 50 THEN 'no_error' WHEN event_type = 'error' OR event_type = 'view' THEN 'match' ELSE 'mismatch' END AS agreement FROM events)"""


@query(f"""WITH {_CAL}, l AS (SELECT doc_id, quality FROM labels), j AS (SELECT coalesce('q' || quality, '?') AS label, agreement FROM res LEFT JOIN l ON doc_id = event_id)
SELECT label, count(*) AS n, count(*) FILTER (agreement = 'match') AS match, count(*) FILTER (agreement = 'mismatch') AS mismatch, count(*) FILTER (agreement = 'no_error') AS no_error, count(*) FILTER (agreement = 'error') AS error,
round(count(*) FILTER (agreement = 'match') / greatest(1, count(*) FILTER (agreement IN ('match', 'mismatch'))), 3) AS precision, round(1 - count(*) FILTER (agreement = 'no_error') / greatest(1, count(*)), 3) AS genuine_break_rate FROM j GROUP BY label""")
def calibration(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events")
    none = F.array().cast("array<string>")
    observed = F.when((F.col("event_type") == "signup") & (F.col("value") > 50), none).otherwise(F.array("event_type"))
    verdict = rules.agreement(F.col("event_id") % 11 != 0, F.lit(False), observed, F.array(F.lit("error"), F.lit("view")))
    res = e.select(F.col("event_id").alias("sample_id"), verdict.alias("agreement"))
    return rules.calibration(res, table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.lit(0).alias("seq"), F.concat(F.lit("q"), "quality").alias("label")))


@query("WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id) SELECT event_id, user_id FROM events JOIN f USING (user_id) ORDER BY first, event_id LIMIT 500")
def replay_budget(spark: S, d: str) -> DataFrame:
    return rules.budget(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 500)


@query("SELECT doc_id, substr(text, 1, 400) AS excerpt FROM documents WHERE source LIKE 'src1%' ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def seeded_file_sample(spark: S, d: str) -> DataFrame:
    docs = hunks.paths(table(spark, d, "documents"), prefixes=("src1",), column="source")
    return docs.orderBy(dataset.shuffle_key(7, "doc_id"), "doc_id").limit(100).select("doc_id", F.substring("text", 1, 400).alias("excerpt"))


@query("SELECT 'n' || conv_id || '_' || turn AS sha FROM conversations WHERE conv_id = 3 AND turn > 1")
def history_reachability(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.concat(F.lit("n"), "conv_id", F.lit("_"), "turn").alias("sha"), F.when(F.col("turn") > 0, F.array(F.concat(F.lit("n"), "conv_id", F.lit("_"), F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"), "conv_id", "turn")
    top = c.where("conv_id = 3").agg(F.max("turn")).first()[0] or 0
    return windows.reachable(c.select("sha", "parents"), [f"n3_{top}"], ["n3_1"])


@query("SELECT 'n' || conv_id || '_' || turn AS sha FROM conversations WHERE turn > 1")
def history_reachability_all(spark: S, d: str) -> DataFrame:
    sha = lambda turn: F.concat(F.lit("n"), "conv_id", F.lit("_"), turn)
    c = table(spark, d, "conversations").select("conv_id", "turn", sha(F.col("turn")).alias("sha"), F.when(F.col("turn") > 0, F.array(sha(F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"))
    last = c.groupBy("conv_id").agg(F.max_by("sha", "turn").alias("sha"))
    return windows.reachable(c.select("sha", "parents"), last, c.where("turn = 1"))


@query("SELECT event_id, 0 AS idx, event_type AS text, (json_extract_string(props, '$.k'))::INT AS line FROM events UNION ALL SELECT event_id, 1, 'in ' || user_id, 7 FROM events")
def json_walk(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events")
    inner = F.concat(F.lit('{"message":"in '), "user_id", F.lit('","range":{"start":{"line":7,"character":1}}}'))
    value = F.concat(F.lit('{"a":[{"message":"'), "event_type", F.lit('","range":{"start":{"line":'), F.get_json_object("props", "$.k"), F.lit(',"character":0}}}]}\n{"b":{"c":['), inner, F.lit("]}}\n{broken"))
    m = readers.expected_json(e.select(F.col("event_id").cast("string").alias("path"), F.lit("v").alias("toolchain"), value.alias("content")))
    return m.select(F.col("path").cast("long").alias("event_id"), "idx", "text", F.col("start.line").alias("line"))
