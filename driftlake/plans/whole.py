"""More registered queries: whole tables and whole texts, with SQL that works the answer out.

Where a query needs edits, they are put together from table columns part by
part, and the SQL derives each label from the parts' conditions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..catalog import query
from ..functions import text as X
from ..operators import classify, hunks, messages, ranks, rules, search, snapshot, windows
from ..sources import readers, writers
from ..sources.readers import table
from .queries import CAUSED, OBS, SNAP, _causes, _edits, _files, _hops, _LN, _lines, _observations, _snapshots, _sql_terms, TERMS

S = SparkSession


# ---------------------------------------------------------------- stage 1 and 2


@query(f"WITH {_sql_terms()} SELECT tag, count(*) AS hits, min(file) AS first_file FROM h WHERE targets <> '' GROUP BY tag")
def term_first_file_per_tag(spark: S, d: str) -> DataFrame:
    return readers.term_hits(_files(spark, d), TERMS).groupBy("tag").agg(F.count("*").alias("hits"), F.min("file").alias("first_file"))


@query("WITH f AS (SELECT user_id, arg_max(event_type || ':' || event_id, event_id) AS last FROM events GROUP BY user_id) SELECT user_id, '\"' || last || '\"' AS json FROM f")
def fold_log(spark: S, d: str) -> DataFrame:
    """The last record of each key, by the writer's own fold."""
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.concat_ws(":", "event_type", "event_id").alias("hits"))
    return writers.folded(log.withColumn("hits", F.array("hits")), "user_id").select("user_id", F.regexp_replace("json", r"^\[|\]$", "").alias("json"))


@query(f"WITH {CAUSED} SELECT base, cause, count(*) AS count FROM causes GROUP BY ALL")
def cause_histogram_hops(spark: S, d: str) -> DataFrame:
    """Every hop, not one."""
    return _causes(spark, d).groupBy("base", "cause").agg(F.count("*").alias("count"))


_SECTIONS = ["const", "syntax", "tactic", "attr", "option", "instance", "simp", "simpunfold", "deprecation", "token"]


@query(f"WITH {CAUSED} SELECT s.section, count(cause) AS breaks FROM (VALUES {', '.join(f'({x!r})' for x in _SECTIONS)}) s(section) LEFT JOIN causes ON split_part(cause, '.', 1) = s.section GROUP BY ALL")
def section_subtotals_all(spark: S, d: str) -> DataFrame:
    return snapshot.sections(_causes(spark, d), _SECTIONS)


@query("""WITH k AS (SELECT DISTINCT o_custkey FROM orders), y AS (SELECT DISTINCT year(o_orderdate) AS r, o_custkey FROM orders), p AS (SELECT r AS base, lead(r) OVER (ORDER BY r) AS target FROM (SELECT DISTINCT r FROM y)),
f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT base, target, c_custkey AS name, 'deprecation.alias-absent' AS cause FROM p, customer c WHERE target IS NOT NULL AND (target, c_custkey) NOT IN (SELECT r, o_custkey FROM y) AND c_custkey NOT IN (SELECT o_custkey FROM f)""")
def diff_double_anti_hops(spark: S, d: str) -> DataFrame:
    """Every pair of adjacent years."""
    o, p = table(spark, d, "orders"), _hops(spark, d).select("base", "target")
    spread = lambda df: df.crossJoin(F.broadcast(p))  # noqa: E731  one row a hop
    years = o.select(F.year("o_orderdate").cast("long").alias("release"), F.col("o_custkey").alias("n")).distinct()
    names = spread(table(spark, d, "customer").select(F.col("c_custkey").alias("n")))
    return snapshot.deprecations(names, snapshot.side(years, _hops(spark, d), "target"), spread(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("n")).distinct())).select("base", "target", "name", "cause")


# ---------------------------------------------------------------- texts of the tables

_SCRUBS = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\?m\.[0-9]+', '?m.‹n›', 'g'), '\bu_[0-9]+\b', 'u_‹n›', 'g'), '\b[0-9]+ heartbeats?\b', '‹n› heartbeats', 'g'), '\b[0-9]+(\.[0-9]+)?\s?(ms|s|MB|KB|GB)\b', '‹n›\2', 'g')"""


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_SCRUBS}, '[ \t\r\f\x0B]+\n', chr(10), 'g'), '[ \t\r\f\x0B]+$', '', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS text_md5 FROM documents")
def scrub_documents(spark: S, d: str) -> DataFrame:
    """Every whole text through all scrubs."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.scrub(F.col("text")).cast("binary")).alias("text_md5"))


@query(r"""SELECT conv_id, turn, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT conv_id, turn, regexp_extract_all(text, '`[^`]*`|‹[a-z]+›|[A-Za-z_][A-Za-z0-9_.''!?]*|[0-9]+|\S') AS t FROM conversations)""")
def prose_tokens(spark: S, d: str) -> DataFrame:
    t = X.prose_tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/--.*?-/', ' ', 'g'), '(?s)/-.*?-/', ' ', 'g'), '--[^\n]*', '', 'g'), '\s+', ' ', 'g'), ' ')) AS norm_md5 FROM documents""")
def normalize_documents(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalize(F.col("text")).cast("binary")).alias("norm_md5"))


_PARTS = "CASE WHEN length(o_orderpriority) % 3 = 0 THEN '' WHEN length(o_orderpriority) % 3 = 1 THEN chr(10) || '  ' || o_orderpriority ELSE chr(10) || '  case ' || o_orderkey || chr(10) || '  ⊢ ' || o_orderpriority || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || '  ⊢ ' || o_orderpriority ELSE '' END END"


@query(f"""WITH m AS (SELECT o_orderkey, {_PARTS} AS p, o_orderpriority FROM orders)
SELECT o_orderkey, o_orderpriority AS head, CASE WHEN p = '' THEN 'none' WHEN length(p) - length(replace(p, '⊢', '')) = 1 THEN 'goal:1' WHEN contains(p, '⊢') THEN 'goal:n' WHEN regexp_matches(p, '(?m)^\\s*case\\s') THEN 'cases' WHEN NOT contains(trim(p, chr(10) || ' '), chr(10)) THEN 'term:1' ELSE 'term:n' END AS shape FROM m""")
def payload_shapes(spark: S, d: str) -> DataFrame:
    """Messages put together of order columns: the shape of what follows the head."""
    o = table(spark, d, "orders")
    text = F.concat("o_orderpriority", F.expr(_PARTS.replace("chr(10)", "'\\n'")))
    m = o.select("o_orderkey", X.split_message(text).alias("m"))
    return m.select("o_orderkey", F.col("m.head").alias("head"), X.payload_shape(F.col("m.payload")).alias("shape"))


# ---------------------------------------------------------------- cascades


@query(f"""WITH RECURSIVE {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY start, seq) AS i, row_number() OVER (PARTITION BY cluster, fingerprint, start ORDER BY seq) > 1 AS again FROM ob),
r AS (
  SELECT cluster, seq, i, true AS is_root, CASE WHEN severity = 'error' THEN [{{'a': start, 'e': stop}}] ELSE [] END AS spans, CASE WHEN severity = 'error' THEN start END AS first FROM n WHERE i = 1
  UNION ALL
  SELECT x.cluster, x.seq, x.i, ok, CASE WHEN ok AND severity = 'error' THEN list_append(spans, {{'a': x.start, 'e': x.stop}}) ELSE spans END, CASE WHEN ok AND severity = 'error' THEN coalesce(first, x.start) ELSE first END
  FROM (SELECT n.*, r.spans, r.first, NOT again AND len(list_filter(r.spans, lambda s: s.a < n.start AND s.e > n.start)) = 0 AND NOT coalesce(n.start > r.first AND severity = 'warning' AND prone, false) AS ok FROM r JOIN n ON n.cluster = r.cluster AND n.i = r.i + 1) x)
SELECT cluster, seq, is_root FROM r""")
def cascade_roots(spark: S, d: str) -> DataFrame:
    """The fold of every cluster, against a recursive statement."""
    from ..operators import weights

    return weights.collapse(_observations(spark, d))


# ---------------------------------------------------------------- windows and hunks

_MERGE_SUBJ = "CASE p_partkey % 4 WHEN 0 THEN 'Merge branch ''bump/v4.' || p_size || '.0''' WHEN 1 THEN 'Merge pull request #' || p_partkey || ' from fork/' || split_part(p_name, ' ', 1) WHEN 2 THEN 'Merge remote-tracking branch ''origin/nightly-testing''' ELSE 'merge ' || p_name END"


@query(f"""WITH c AS (SELECT p_partkey AS i, {_MERGE_SUBJ} AS subject, p_size, p_name FROM part WHERE p_partkey > 1)
SELECT 'c' || i AS ref, 'c' || (i - 1) AS base, 's' || i AS tip, 'merge' AS source, CASE i % 4 WHEN 0 THEN '4.' || p_size || '.0' WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN 'nightly-testing' ELSE 'v' || (i // 7) END AS key
FROM c WHERE i % 4 IN (0, 2) OR i % 7 = 0""")
def merge_windows(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_partkey > 1")
    parents = F.array(F.concat(F.lit("c"), F.col("p_partkey") - 1), F.concat(F.lit("s"), "p_partkey"))
    subject = F.expr(_MERGE_SUBJ.replace("split_part(p_name, ' ', 1)", "substring_index(p_name, ' ', 1)").replace("''bump/v4.'", "\\'bump/v4.'").replace("'.0'''", "'.0\\''").replace("''origin/nightly-testing'''", "\\'origin/nightly-testing\\''"))
    c = p.select(F.concat(F.lit("c"), "p_partkey").alias("sha"), parents.alias("parents"), F.lit("2024-01-01T00:00").alias("author_date"), subject.alias("subject"), F.lit("").alias("body"))
    v = table(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("sha"), F.concat(F.lit("v"), F.floor(F.col("p_partkey") / 7)).alias("version"))
    return windows.from_merges(c, v).select("ref", "base", "tip", "source", "key")


@query("SELECT 'bump' AS kind, '4.' || p_size || '.0' AS key, 'refs/heads/bump/v4.' || p_size || '.0' AS ref, 'main' AS base, 'c' || p_partkey AS tip FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'nightly-testing', 'nightly-testing', 'refs/remotes/origin/nightly-testing', 'main', 'c' || p_partkey FROM part WHERE p_partkey % 3 = 1")
def branch_windows(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part")
    ref = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("refs/heads/bump/v4."), "p_size", F.lit(".0"))).when(F.col("p_partkey") % 3 == 1, F.lit("refs/remotes/origin/nightly-testing")).otherwise(F.concat(F.lit("refs/heads/feature/"), "p_partkey"))
    return windows.from_branches(p.select(ref.alias("ref"), F.concat(F.lit("c"), "p_partkey").alias("sha")), "main").select("kind", "key", "ref", "base", "tip")


@query(f"""WITH {_LN} SELECT path, seq, 1 + count(*) FILTER (kind IN (' ', '-')) OVER w AS old_no, 1 + count(*) FILTER (kind IN (' ', '+')) OVER w AS new_no FROM k WINDOW w AS (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def line_counters(spark: S, d: str) -> DataFrame:
    return hunks.numbered(_lines(spark, d)).select("path", F.col("seq").cast("long").alias("seq"), F.col("old_no").cast("long").alias("old_no"), F.col("new_no").cast("long").alias("new_no"))


@query(f"""WITH {_LN}, c AS (SELECT *, kind <> ' ' AND coalesce(lag(kind) OVER (PARTITION BY path ORDER BY seq), ' ') = ' ' AS new FROM k), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY path ORDER BY seq)::BIGINT AS run FROM c),
h AS (SELECT path, run, min(seq) AS lo, max(seq) AS hi, count(*) FILTER (kind = '-') AS n_old, count(*) FILTER (kind = '+') AS n_new FROM g WHERE kind <> ' ' GROUP BY ALL)
SELECT h.path, h.run, n_old = 0 AS adds_only, n_new = 0 AS removes_only,
  md5(coalesce((SELECT string_agg(text, chr(10) ORDER BY seq) FROM k WHERE k.path = h.path AND seq BETWEEN lo - 3 AND hi + 3 AND kind IN (' ', '+')), '')) AS window_md5,
  (SELECT count(*) FROM k WHERE k.path = h.path AND seq BETWEEN lo - 3 AND lo - 1 AND kind = ' ') AS n_before FROM h""")
def hunk_windows(spark: S, d: str) -> DataFrame:
    """Each run with the new side's slice of up to three lines around it."""
    h = hunks.hunks(hunks.numbered(_lines(spark, d)), context=3)
    return h.select("path", F.col("run").cast("long").alias("run"), hunks.pure("+").alias("adds_only"), hunks.pure("-").alias("removes_only"), F.md5(hunks.window("+", 3).cast("binary")).alias("window_md5"), F.size("ctx_before").cast("long").alias("n_before"))


_LOG = "'s' || o_orderkey || chr(31) || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'p' || o_custkey ELSE 'p' || o_custkey || ' q' || o_orderkey END || chr(31) || o_orderdate || chr(31) || o_orderpriority || chr(31) || o_orderstatus || chr(30)"


@query("SELECT 's' || o_orderkey AS sha, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_parents, o_orderpriority AS subject, o_orderstatus AS body FROM orders")
def commit_log(spark: S, d: str) -> DataFrame:
    """A log text of every order, parsed back."""
    line = F.expr(_LOG.replace("chr(31)", "'\\u001f'").replace("chr(30)", "'\\u001e'").replace("|| o_orderdate ||", "|| cast(o_orderdate as string) ||"))
    return readers.commits(table(spark, d, "orders").select(line.alias("value"))).select("sha", F.size("parents").alias("n_parents"), "subject", "body")


# ---------------------------------------------------------------- classification

# Each line of an edit depends on columns of its row; ` stands for a line break.
_A1 = "CASE p_size % 3 WHEN 0 THEN 'simp' WHEN 1 THEN 'simp, ext' ELSE 'to_additive' END"
_A2 = "CASE p_size % 4 WHEN 0 THEN 'simp' WHEN 1 THEN 'ext' WHEN 2 THEN 'simp, deprecated foo' ELSE 'to_additive, reducible' END"
_U1, _U2 = ("CASE WHEN p_partkey % 2 = 0 THEN '.{u}' ELSE '' END", "CASE WHEN p_partkey % 3 = 0 THEN '.{u}' ELSE '' END")
_N1, _N2 = ("CASE WHEN p_partkey % 5 = 0 THEN ' (n := 1)' ELSE '' END", "CASE WHEN p_partkey % 7 < 4 THEN ' (n := 1)' ELSE '' END")
_T2 = "CASE WHEN p_size % 5 < 2 THEN ' (x : Nat)' ELSE '' END"
_F1, _F2 = ("CASE WHEN p_size % 7 < 5 THEN 'fun ⟨a, b⟩' ELSE 'fun | c' END", "CASE WHEN p_size % 7 < 3 THEN 'fun | a' ELSE 'fun ⟨a, b⟩' END")
_W2 = "CASE WHEN p_partkey % 11 < 3 THEN 'where' ELSE 'end' END"
_ROWS = f"""e AS (SELECT p_partkey, p_size, p_partkey % 4 AS c1, p_size % 4 AS c2,
 '@[' || {_A1} || '] lemma k' || chr(10) || 'def u' || {_U1} || chr(10) || 'have y := ' || repeat('↑', (p_partkey % 4)::INT) || 'z' || chr(10) || 'app f' || {_N1} || chr(10) || {_F1} || chr(10) || 'tail ' || p_partkey || ' old' AS pre,
 '@[' || {_A2} || '] lemma k' || chr(10) || 'def u' || {_U2} || chr(10) || 'have y := ' || repeat('↑', (p_size % 4)::INT) || 'z' || chr(10) || 'app f' || {_N2} || {_T2} || chr(10) || {_F2} || chr(10) || {_W2} || chr(10) || 'tail ' || p_partkey || ' new extra' AS post FROM part)"""
_DELTA = """SELECT *, list_filter(a2, lambda x: NOT list_contains(a1, x)) AS add_, list_filter(a1, lambda x: NOT list_contains(a2, x)) AS rem_, lines2, list_filter(lines2, lambda x: NOT list_contains(lines1, trim(x))) AS added, list_filter(lines1, lambda x: NOT list_contains(lines2, trim(x))) AS removed
 FROM (SELECT *, string_split(regexp_extract(pre, '@\\[([^\\]]*)\\]', 1), ', ') AS a1, string_split(regexp_extract(post, '@\\[([^\\]]*)\\]', 1), ', ') AS a2, string_split(pre, chr(10)) AS lines1, string_split(post, chr(10)) AS lines2 FROM e)"""
_WATCHED = ["rename.attribute", "elab.instance_reducibility", "rename.deprecation_added", "auto.attribute_delta", "elab.universe", "elab.named_argument", "elab.type_ascription", "elab.coercion", "elab.binder_syntax", "elab.structure_instance"]


@query(f"""WITH {_ROWS}, x AS ({_DELTA}), y AS (SELECT *, array_to_string(added, chr(10)) AS p, len(add_) = 1 AND len(rem_) = 1 AS one, len(add_) + len(rem_) > 0 AS anyd, len(list_filter(list_concat(add_, rem_), lambda v: contains(v, 'reducible'))) > 0 AS red,
  array_to_string(removed, chr(10)) AS q, length(post) - length(replace(post, '(', '')) > length(pre) - length(replace(pre, '(', '')) AS wider, regexp_matches(pre, 'fun\\s*[⟨(]') AND regexp_matches(post, 'fun\\s*\\|') AND NOT regexp_matches(pre, 'fun\\s*\\|') AS binder FROM x),
z AS (SELECT *, regexp_matches(p, '\\(\\s*[a-zA-Z]+\\s*:=') AND NOT regexp_matches(pre, '\\(\\s*[a-zA-Z]+\\s*:=') AS named FROM y),
l AS (SELECT p_partkey, [
  CASE WHEN anyd AND one THEN 'rename.attribute' END, CASE WHEN anyd AND red THEN 'elab.instance_reducibility' END, CASE WHEN NOT (anyd AND red) AND NOT one AND len(list_filter(add_, lambda v: starts_with(v, 'deprecated'))) > 0 THEN 'rename.deprecation_added' END,
  CASE WHEN anyd AND NOT red AND NOT one AND len(list_filter(add_, lambda v: starts_with(v, 'deprecated'))) = 0 THEN 'auto.attribute_delta' END,
  CASE WHEN regexp_matches(p, '\\.\\{{[^}}]*\\}}') AND NOT regexp_matches(pre, '\\.\\{{[^}}]*\\}}') THEN 'elab.universe' END,
  CASE WHEN named THEN 'elab.named_argument' END, CASE WHEN NOT named AND regexp_matches(p, '\\([^()]+\\s:\\s[^()]+\\)') AND wider THEN 'elab.type_ascription' END,
  CASE WHEN length(p) - length(replace(p, '↑', '')) <> length(q) - length(replace(q, '↑', '')) THEN 'elab.coercion' END,
  CASE WHEN binder THEN 'elab.binder_syntax' END, CASE WHEN NOT binder AND contains(pre, '⟨') AND regexp_matches(post, '\\bwhere\\b') THEN 'elab.structure_instance' END] AS v FROM z)
SELECT p_partkey, array_to_string(list_sort(list_filter(v, lambda t: t IS NOT NULL)), ',') AS labels FROM l""")
def classify_conditions(spark: S, d: str) -> DataFrame:
    """Edits of several parts, each changed or not by its row's columns: which of the watched labels each gets."""
    e = table(spark, d, "part").selectExpr("p_partkey", *[x.replace("chr(10)", "'\\n'").replace("::INT", "") + f" AS {n}" for x, n in ((_ROWS.split(" AS c2,\n ")[1].split(" AS pre,\n ")[0], "pre"), (_ROWS.split(" AS pre,\n ")[1].split(" AS post FROM")[0], "post"))])
    c = classify.classify(e)
    return c.select("p_partkey", F.array_join(F.array_sort(F.array_intersect("labels", F.array(*[F.lit(x) for x in _WATCHED]))), ",").alias("labels"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'meta.adaptation_note' WHEN a = b THEN 'meta.formatting' ELSE 'auto.simp_lemma_added,auto.simp_lemma_removed' END AS labels, p_partkey % 2 = 0 AS noted
FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', -1) AS b FROM part)""")
def classify_notes_and_fragments(spark: S, d: str) -> DataFrame:
    """A note put into a line as it was; or one lemma of a list, whose call stands above, for another."""
    p = table(spark, d, "part").withColumns({"a": F.substring_index("p_name", " ", 1), "b": F.substring_index("p_name", " ", -1)})
    note = F.col("p_partkey") % 2 == 0
    pre = F.when(note, F.concat(F.lit("have "), "a", F.lit(" := 1"))).otherwise(F.concat(F.lit("  one_"), "a", F.lit(", two]")))
    post = F.when(note, F.concat(F.lit("have "), "a", F.lit("  #adaptation_note /-- of "), "p_brand", F.lit(" -/ := 1"))).otherwise(F.concat(F.lit("  one_"), "b", F.lit(", two]")))
    c = classify.classify(p.select("p_partkey", pre.alias("pre"), post.alias("post"), F.array(F.lit("  simp only [zero,")).alias("ctx_before")))
    watched = F.array_intersect("labels", F.array(*[F.lit(x) for x in ("meta.adaptation_note", "meta.formatting", "auto.simp_lemma_added", "auto.simp_lemma_removed")]))
    return c.select("p_partkey", F.array_join(F.array_sort(watched), ",").alias("labels"), (F.size("notes") > 0).alias("noted"))


_OPEN1, _OPEN2 = "'open ' || p_name || ' A' || p_size % 3", "'open ' || p_name || ' A' || p_size % 5"


@query("""WITH e AS (SELECT p_partkey, list_sort(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'A' || p_size % 3])) AS a, list_sort(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'A' || p_size % 5])) AS b, p_size, p_partkey % 6 AS m, p_partkey % 4 AS n FROM part)
SELECT p_partkey, CASE WHEN a <> b THEN array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') END AS open_added, CASE WHEN a <> b THEN array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') END AS open_removed,
CASE WHEN m <> n THEN 'M.' || n END AS imports_added, CASE WHEN m <> n THEN 'M.' || m END AS imports_removed, CASE WHEN m <> n THEN 'maxHeartbeats=' || n END AS set_option_added FROM e""")
def classify_evidence(spark: S, d: str) -> DataFrame:
    """What the open, import and option rules saw."""
    p = table(spark, d, "part").withColumns({"m": F.col("p_partkey") % 6, "n": F.col("p_partkey") % 4})
    text = lambda o, k: F.concat(F.expr(o), F.lit("\nimport M."), k, F.lit("\nset_option maxHeartbeats "), k)
    c = classify.classify(p.select("p_partkey", text(_OPEN1, "m").alias("pre"), text(_OPEN2, "n").alias("post")))
    flat = lambda k: F.array_join(F.col(f"evidence.{k}"), ",").alias(k)
    return c.select("p_partkey", flat("open_added"), flat("open_removed"), flat("imports_added"), flat("imports_removed"), flat("set_option_added"))


@query("""WITH p AS (SELECT p_partkey, p_size % 6 AS k, split_part(p_name, ' ', 1) AS x FROM part),
n AS (SELECT p_partkey, CASE WHEN k IN (3, 4) THEN x ELSE 'Aa.' || x END AS a, CASE k WHEN 0 THEN 'Bb.' || x WHEN 1 THEN 'Aa.' || x || '_y' WHEN 2 THEN 'Bb.Aa.' || x WHEN 3 THEN x || '_y' WHEN 4 THEN 'Aa.Bb.' || x ELSE 'cc.' || x END AS b FROM p)
SELECT p_partkey, regexp_replace(a, '^([A-Z][A-Za-z0-9]*[.])*', '') = regexp_replace(b, '^([A-Z][A-Za-z0-9]*[.])*', '') AS moved FROM n""")
def namespace_moves(spark: S, d: str) -> DataFrame:
    """A.x to B.x, A.x to B.A.x and x to A.B.x are moves; A.x to A.y, x to y and A.x to c.x are not."""
    p = table(spark, d, "part").withColumn("x", F.substring_index("p_name", " ", 1)).withColumn("y", F.concat("x", F.lit("_y")))
    k = F.col("p_size") % 6
    a = F.when(k.isin(3, 4), F.col("x")).otherwise(F.concat(F.lit("Aa."), "x"))
    b = F.when(k == 0, F.concat(F.lit("Bb."), "x")).when(k == 1, F.concat(F.lit("Aa."), "y")).when(k == 2, F.concat(F.lit("Bb.Aa."), "x")).when(k == 3, F.col("y")).when(k == 4, F.concat(F.lit("Aa.Bb."), "x")).otherwise(F.concat(F.lit("cc."), "x"))
    return p.select("p_partkey", X.namespace_move(a, b).alias("moved"))


# ---------------------------------------------------------------- rules


@query("""WITH e AS (SELECT *, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders),
p AS (SELECT *, 'p' || regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g') AS old, 'p' || regexp_replace(nxt, '[^A-Za-z0-9]', '', 'g') AS new FROM e WHERE nxt <> o_orderpriority AND o_orderpriority <> '3-MEDIUM' AND nxt <> '3-MEDIUM'),
t AS (SELECT old, new, list(substr(old || ' to ' || new || ' of ' || o_orderstatus, 1, 400) ORDER BY o_orderkey)[1:3] AS w FROM p GROUP BY ALL),
c AS (SELECT old, new, list(c ORDER BY s, c)[1:5] AS prov FROM (SELECT old, new, 'c' || o_custkey % 17 AS c, min(o_orderkey) AS s FROM p GROUP BY ALL) GROUP BY ALL)
SELECT old, new, array_to_string(w, ';') AS windows, array_to_string(prov, ',') AS provenance FROM t JOIN c USING (old, new)""")
def induce_examples(spark: S, d: str) -> DataFrame:
    """Rules of replaced names: the first fixed texts and commits of each; names that are no identifiers give none."""
    e = _edits(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey", "o_orderstatus"), "seq")
    strip = lambda c: F.when(c == "p3MEDIUM", "3-MEDIUM").otherwise(c)  # noqa: E731  not an identifier
    subs = F.transform("subs", lambda x: F.struct(strip(x["old"]).alias("old"), strip(x["new"]).alias("new")))
    e = e.withColumns({"fixed": F.concat(F.col("subs")[0]["old"], F.lit(" to "), F.col("subs")[0]["new"], F.lit(" of "), "o_orderstatus"), "commit": F.concat(F.lit("c"), F.col("o_custkey") % 17), "subs": subs})
    return rules.induce(e, 1).where("kind = 'subst'").select("old", "new", F.array_join("windows", ";").alias("windows"), F.array_join("provenance", ",").alias("provenance"))


@query("""SELECT doc_id, (length(text) - length(replace(text, 'er', ''))) // 2 AS n, md5(replace(text, 'er', 'xyz')) AS broken_md5, CASE WHEN contains(text, 'er') THEN md5(substr(text, 1, strpos(text, 'er') - 1) || 'xyz' || substr(text, strpos(text, 'er') + 2)) END AS first_md5 FROM documents""")
def apply_reverse(spark: S, d: str) -> DataFrame:
    """A window rule backwards over every whole text: all sites, their number, and the first alone (null without one)."""
    rule = F.struct(F.lit("window").alias("kind"), F.lit("xyz").alias("old"), F.lit("er").alias("new"), F.lit(True).alias("reversible"))
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", rules.sites(t, rule["kind"], rule["new"]).cast("long").alias("n"), F.md5(rules.reversed_text(t, rule).cast("binary")).alias("broken_md5"), F.md5(rules.reverse_window(t, F.lit("er"), F.lit("xyz")).cast("binary")).alias("first_md5"))


_WHOLE = r"(^|[^\p{L}\p{N}_.''!?])%s(\.[^A-Z]|\.$|[^\p{L}\p{N}_''!?.]|$)"


def _sql_rule(rid: str, old: str, new: str, support: int) -> str:
    return f"SELECT '{rid}' AS rule_id, {support} AS support, doc_id, regexp_replace(text, '{_WHOLE % new}', '\\1{old}\\2') AS broken FROM documents WHERE regexp_matches(text, '{_WHOLE % new}') AND NOT regexp_matches(text, '{_WHOLE % old}')"


@query(f"""WITH h AS ({_sql_rule('subs-1', 'thee', 'the', 9)} UNION ALL {_sql_rule('subs-2', 'unx', 'und', 5)}
UNION ALL SELECT 'wind-1', 3, doc_id, substr(text, 1, strpos(text, 'of the') - 1) || 'of teh' || substr(text, strpos(text, 'of the') + 6) FROM documents WHERE contains(text, 'of the') AND NOT contains(text, 'of teh')
UNION ALL SELECT 'wind-2', 2, doc_id, substr(text, 1, strpos(text, ', ') - 1) || ' ;; ' || substr(text, strpos(text, ', ') + 2) FROM documents WHERE contains(text, ', ') AND NOT contains(text, ' ;; ')),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY doc_id) AS n FROM h) WHERE n <= 20)
SELECT substr(sha1(rule_id || chr(0) || doc_id), 1, 16) AS sample_id, rule_id, doc_id AS path, md5(broken) AS broken_md5 FROM c""")
def synthesize_sites(spark: S, d: str) -> DataFrame:
    """Two names and two windows, one of them without a word, searched in every file."""
    r = spark.createDataFrame([("subs-1", "subst", "l1", "thee", "the", 9, True), ("subs-2", "subst", "l2", "unx", "und", 5, True), ("wind-1", "window", "l3", "of teh", "of the", 3, True), ("wind-2", "window", "l4", " ;; ", ", ", 2, True)], "rule_id string, kind string, label string, old string, new string, support int, reversible boolean")
    return rules.synthesize(r, table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")).select("sample_id", "rule_id", "path", F.md5(F.col("broken").cast("binary")).alias("broken_md5"))


@query("SELECT doc_id, count(*) AS n, md5(string_agg(p, ',' ORDER BY p)) AS found FROM documents JOIN (SELECT DISTINCT substr(md5(p_partkey::VARCHAR), 1, 3) AS p FROM part) ON contains(text, p) GROUP BY doc_id")
def patterns_in_documents(spark: S, d: str) -> DataFrame:
    """As many patterns as there are parts, searched in every whole text."""
    p = table(spark, d, "part").select(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 3).alias("p")).distinct()
    m = search.matched(table(spark, d, "documents").select("doc_id", "text"), p, "p")
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("p")), ",").cast("binary")).alias("found"))


_EXP = {k: sorted(v) for k, v in vocab.EXPECTED_ERRORS.items()}
_LABELS = sorted(_EXP)[:4]


@query(f"""WITH x AS (SELECT event_id, user_id, event_type, value, CASE event_id % 4 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_LABELS))} END AS label, event_id % 7 = 0 AS missing, event_id % 5 = 0 AS lost, event_id % 11 = 0 AS late, CASE WHEN event_type = 'view' THEN [] ELSE [CASE WHEN user_id % 2 = 0 THEN 'deterministic_timeout' ELSE 'unknown_identifier' END] END AS seen FROM events),
y AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN ['unknown_identifier'] ELSE CASE label {' '.join(f"WHEN '{k}' THEN {_EXP[k]!r}" for k in _LABELS)} END END AS want, NOT missing AND NOT lost AS ok FROM x)
SELECT event_id, ok AS applied, ok AND late AS timeout, CASE WHEN NOT ok THEN 'error' WHEN late THEN CASE WHEN list_contains(want, 'deterministic_timeout') THEN 'match' ELSE 'mismatch' END WHEN len(seen) = 0 THEN CASE WHEN list_contains(want, 'no_error') THEN 'match' ELSE 'no_error' END WHEN list_has_any(seen, want) THEN 'match' ELSE 'mismatch' END AS agreement,
CASE WHEN missing THEN 'missing file: f' || event_id WHEN lost THEN 'fixed window not found at this commit' END AS stderr FROM y""")
def replay_verdicts(spark: S, d: str) -> DataFrame:
    """A sample an event: files that are missing, windows that are lost, runs out of time, own expectations or the label's."""
    e = table(spark, d, "events")
    label = F.element_at(F.array(*[F.lit(k) for k in _LABELS]), (F.col("event_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("f"), "event_id")
    own = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("unknown_identifier"))).otherwise(F.array().cast("array<string>"))
    samples = e.select(F.col("event_id").alias("sample_id"), label.alias("label"), own.alias("expected_errors"), path.alias("path"), F.lit("good").alias("fixed_window"), F.lit("bad").alias("broken_window"))
    files = e.where("event_id % 7 <> 0").select(path.alias("path"), F.when(F.col("event_id") % 5 == 0, "other text").otherwise("a good text").alias("text"))
    error = F.struct(F.when(F.col("user_id") % 2 == 0, "deterministic_timeout").otherwise("unknown_identifier").alias("error_class"), F.lit("error").alias("severity"))
    info = F.struct(F.lit("x").alias("error_class"), F.lit("info").alias("severity"))
    runs = e.select(F.col("event_id").alias("sample_id"), (F.col("event_id") % 11 == 0).alias("timeout"), F.when(F.col("event_type") == "view", F.array(info)).otherwise(F.array(info, error)).alias("diagnostics"))
    return rules.verdicts(samples, files, runs).select(F.col("sample_id").alias("event_id"), "applied", "timeout", "agreement", "stderr")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '<elaboration timeout>' WHEN event_id % 3 = 0 THEN '<exit 2>' || chr(10) || event_type ELSE 'm' || user_id END AS text, event_id % 5 = 0 OR event_id % 3 = 0 AS synthetic FROM events WHERE event_id % 5 = 0 OR event_id % 3 = 0 OR event_id % 2 = 0""")
def run_outcomes(spark: S, d: str) -> DataFrame:
    """Runs that time out, fail without a word, or report: one made-up error for each of the first two."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    silent = (k % 3 == 0) | (k % 2 != 0)
    out = F.when(silent, "noise").otherwise(F.concat(F.lit('noise\n{"severity":"error","data":"m'), "user_id", F.lit('"}\n{broken')))
    runs = e.select(k.cast("string").alias("file"), F.lit("v").alias("toolchain"), out.alias("stdout"), F.col("event_type").alias("stderr"), F.when(k % 3 == 0, 2).otherwise(0).alias("code"), (k % 5 == 0).alias("timeout"))
    r = readers.run_diagnostics(runs)
    return r.select(F.col("file").cast("long").alias("event_id"), "text", F.coalesce(F.try_element_at("extra", F.lit("synthetic")) == "true", F.lit(False)).alias("synthetic"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey WHEN 2 THEN 0 ELSE 0 END AS major, CASE WHEN c_custkey % 4 < 2 THEN c_nationkey ELSE 0 END AS minor, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 0 END AS patch FROM customer")
def version_parts(spark: S, d: str) -> DataFrame:
    """Three parts, two parts, and what is no version."""
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, F.concat_ws(".", "c_custkey", "c_nationkey", F.lit("3-rc1"))).when(k == 1, F.concat_ws(".", "c_custkey", "c_nationkey")).when(k == 2, F.concat_ws(".", "c_custkey", "c_nationkey", F.lit("1"), F.lit("2"))).otherwise(F.concat_ws(".", "c_custkey", F.lit("x"), F.lit("1")))
    x = table(spark, d, "customer").select("c_custkey", X.version(v).alias("v"))
    return x.select("c_custkey", *[F.col(f"v.{p}").cast("long").alias(p) for p in ("major", "minor", "patch")])


# ---------------------------------------------------------------- snapshots from lines, readers and writers, code facts

_SNAP_LINES = "'{\"t\":\"const\",\"n\":\"c' || o_custkey || '\",\"k\":\"' || o_orderpriority || '\",\"u\":' || o_orderkey % 5 || ',\"prot\":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || ',\"fields\":[\"' || o_orderstatus || '\"]}'"


@query("SELECT year(o_orderdate)::BIGINT AS release, 'c' || o_custkey AS n, arg_max(o_orderpriority, o_orderkey) AS k, arg_max(o_orderkey % 5, o_orderkey)::INT AS u, arg_max(o_orderstatus = 'F', o_orderkey) AS prot, arg_max(o_orderstatus, o_orderkey) AS field FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY ALL")
def snapshot_lines(spark: S, d: str) -> DataFrame:
    """Tagged lines of every order: other tags are ignored, and the last record of a name counts."""
    o = table(spark, d, "orders")
    line = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit('{"t":"later-tag","n":"c'), "o_custkey", F.lit('"}'))).otherwise(F.expr(_SNAP_LINES))
    raw = o.select(F.year("o_orderdate").cast("long").alias("release"), line.alias("value"), F.col("o_orderkey").alias("seq"))
    return readers.snapshot(raw, "const").select("release", "n", "k", "u", "prot", F.col("fields")[0].alias("field"))


@query("SELECT DISTINCT year(o_orderdate)::BIGINT AS release, 't' || x AS n FROM orders, (SELECT unnest([0, 1]) AS s) v, LATERAL (SELECT (o_orderkey + s) % 40 AS x)")
def snapshot_tokens(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    tok = lambda s: F.concat(F.lit('"t'), (F.col("o_orderkey") + s) % 40, F.lit('"'))
    line = F.concat(F.lit('{"t":"tokens","all":['), tok(0), F.lit(","), tok(1), F.lit("]}"))
    return readers.snapshot(o.select(F.year("o_orderdate").cast("long").alias("release"), line.alias("value"), F.col("o_orderkey").alias("seq")), "tokens")


@query(f"WITH {SNAP}, i AS (SELECT DISTINCT year(o_orderdate) AS release, o_custkey AS n FROM orders WHERE o_totalprice > 200000) SELECT release, n, (release, n) IN (SELECT release, n FROM i) AS inst FROM snap")
def instance_flags(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 200000").select(F.year("o_orderdate").cast("long").alias("release"), F.col("o_custkey").alias("n"))
    return snapshot.with_instances(_snapshots(spark, d).select("release", "n"), o).select("release", "n", "inst")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS section, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice > 470000) = 0 AS empty FROM orders GROUP BY ALL")
def empty_sections(spark: S, d: str) -> DataFrame:
    """Sections that the self-check names: months without a large urgent order that is pending."""
    n = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("section")).agg(F.count_if(F.expr("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice > 470000")).alias("n"))
    found = snapshot.self_check(n, exempt=(), allow_empty=True)
    return n.select("section", F.col("section").isin(found).alias("empty"))


@query("""WITH e AS (SELECT *, lag(event_type) OVER w AS before, lag(event_id) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT 'bump' AS kind, event_type AS key, 'e' || prev AS base, 'e' || event_id AS tip, before AS version_before, event_type AS version_after FROM e WHERE prev IS NOT NULL AND before <> event_type""")
def version_changes(spark: S, d: str) -> DataFrame:
    """A history for each user, whose version file is the type of the event: windows where it changes."""
    e = table(spark, d, "events")
    prev = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    sha = lambda c: F.concat(F.lit("e"), c)
    c = e.select(sha(F.col("event_id")).alias("sha"), F.when(prev.isNotNull(), F.array(sha(prev))).otherwise(F.array().cast("array<string>")).alias("parents"), F.lit("2024-01-01").alias("author_date"), F.lit("s").alias("subject"), F.lit("").alias("body"))
    return windows.from_version_changes(c, e.select(sha(F.col("event_id")).alias("sha"), F.col("event_type").alias("version"))).select("kind", "key", "base", "tip", "version_before", "version_after")


@query(f"SELECT p_partkey, replace({_A2}, ', ', ',') || CASE WHEN p_partkey % 3 = 0 THEN ',to_dual (attr := norm_cast),norm_cast' ELSE '' END AS attrs, CASE WHEN p_partkey % 3 = 0 THEN 'argument' END AS role FROM part")
def attributes_found(spark: S, d: str) -> DataFrame:
    """Attributes of a block and of an ``attr :=`` argument in a second one; where a name stands."""
    block = F.concat(F.lit("@["), F.expr(_A2), F.lit("]"), F.when(F.col("p_partkey") % 3 == 0, " @[to_dual (attr := norm_cast)]").otherwise(""), F.lit(" theorem t : "), F.col("p_name"))
    p = table(spark, d, "part").select("p_partkey", block.alias("text"))
    role = X.attribute_role(F.col("text"), F.lit("attr"))
    return p.select("p_partkey", F.array_join(X.attributes(F.col("text")), ",").alias("attrs"), role.alias("role")).withColumn("role", F.when(F.col("role").isNotNull(), "argument"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' twice;' || p_brand WHEN p_partkey % 4 = 1 THEN p_brand ELSE '' END AS notes FROM part")
def notes_found(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("#adaptation_note /-- "), "p_name", F.lit("\n  twice -/\nx\n#adaptation_note /--"), "p_brand", F.lit("-/"))).when(k == 1, F.concat(F.lit("#adaptation_note /-- "), "p_brand", F.lit(" -/ #adaptation_note /--  -/"))).otherwise(F.concat(F.lit("/-- "), "p_name", F.lit(" -/")))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.notes(text), ";").alias("notes"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 4 THEN true ELSE false END AS noise, p_partkey % 8 NOT IN (4, 5) AS useful FROM part""")
def useful_edits(spark: S, d: str) -> DataFrame:
    """Noise goes, and what only the fallback named has too little confidence."""
    from .queries import _POST, _PRE

    p = table(spark, d, "part").withColumns({"x": F.substring_index("p_name", " ", 1), "y": F.substring_index("p_name", " ", -1)})
    c = classify.classify(p.select("p_partkey", F.expr(_PRE).alias("pre"), F.expr(_POST).alias("post")))
    return c.select("p_partkey", "noise", F.coalesce(classify.is_useful(least=0.5), F.lit(False)).alias("useful"))


@query("SELECT p_partkey, p_name || '.expected' AS path, p_partkey % 3 <> 2 AS listed FROM part")
def expected_files(spark: S, d: str) -> DataFrame:
    """Which files are expected-output files; ignored ones and others are left out."""
    end = F.when(F.col("p_partkey") % 3 == 2, ".ignored").otherwise("")
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(".expected"), end).alias("path"))
    kept = readers.expected_files(p).select("p_partkey", F.lit(True).alias("listed"))
    return p.join(kept, "p_partkey", "left").select("p_partkey", F.regexp_replace("path", r"\.ignored$", "").alias("path"), F.coalesce("listed", F.lit(False)).alias("listed"))


@query("""SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":' || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS value FROM orders""")
def sorted_json(spark: S, d: str) -> DataFrame:
    """Rows as JSON with sorted keys, nulls included."""
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_custkey").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")))
    v = writers.dumps(o)
    return v.select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), "value")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'unknown_identifier' WHEN 'view' THEN 'deterministic_timeout' ELSE 'other' END AS class FROM events")
def error_classes(spark: S, d: str) -> DataFrame:
    t = F.when(F.col("event_type") == "error", F.concat(F.lit("unknown identifier "), "user_id")).when(F.col("event_type") == "view", F.lit("(deterministic) timeout at x")).otherwise(F.concat(F.lit("message "), "user_id"))
    c = X.classify_error(t)
    return table(spark, d, "events").select("event_id", F.when(c == vocab.OTHER_ERROR, "other").otherwise(c).alias("class"))


@query("""WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN -1 END AS step, CASE WHEN event_type = 'view' THEN 'N' || event_id END AS name FROM events),
s AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY user_id ORDER BY event_id) AS sum FROM l), h AS (SELECT *, sum - least(0, min(sum) OVER (PARTITION BY user_id ORDER BY event_id)) AS depth FROM s),
o AS (SELECT * FROM h WHERE step = 1), c AS (SELECT a.*, (SELECT min(b.event_id) FROM h b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND b.depth < a.depth) AS closed FROM o a)
SELECT h.user_id, h.event_id, coalesce(string_agg(c.name, '.' ORDER BY c.depth), '') AS namespace FROM h LEFT JOIN c ON c.user_id = h.user_id AND c.event_id <= h.event_id AND (c.closed IS NULL OR c.closed > h.event_id) AND c.name IS NOT NULL GROUP BY h.user_id, h.event_id""")
def namespaces_of_events(spark: S, d: str) -> DataFrame:
    """Views open a namespace, clicks a section, errors end what is open; a user is a file."""
    e = table(spark, d, "events")
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("namespace N"), "event_id")).when(F.col("event_type") == "click", "noncomputable section").when(F.col("event_type") == "error", "  end x").otherwise("ended")
    n = hunks.namespaces(e.select(F.col("user_id").alias("path"), F.col("event_id").alias("line"), text.alias("text")))
    return n.select(F.col("path").alias("user_id"), F.col("line").alias("event_id"), "namespace")


_RELEASES = "SELECT p_partkey, (p_size % 5) || '.' || (p_partkey % 40) || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.' || (p_partkey % 3) END || CASE WHEN p_partkey % 4 = 0 THEN '-rc' || (p_partkey % 9) ELSE '' END AS release FROM part"


@query(rf"""WITH r AS ({_RELEASES}), v AS (SELECT *, split_part(release, '-', 1) AS plain FROM r WHERE regexp_matches(release, '^\d+\.\d+\.\d+(-.*)?$'))
SELECT p_partkey, release, row_number() OVER (ORDER BY split_part(plain, '.', 1)::INT, split_part(plain, '.', 2)::INT, split_part(plain, '.', 3)::INT, plain = release, release, p_partkey) - 1 AS place FROM v""")
def versions_in_order(spark: S, d: str) -> DataFrame:
    """Versions made of the parts' keys: those that are valid, and their places in order, counted over ranges."""
    k = F.col("p_partkey")
    release = F.concat(F.col("p_size") % 5, F.lit("."), k % 40, F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("."), k % 3)), F.when(k % 4 == 0, F.concat(F.lit("-rc"), k % 9)).otherwise(""))
    r = table(spark, d, "part").select("p_partkey", release.alias("release")).where(X.valid_version(F.col("release")))
    return ranks.placed(r, [X.version(F.col("release")), F.col("p_partkey")])


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ \n]+')) AS template FROM conversations) SELECT template, count(*) AS count FROM w GROUP BY template""")
def template_listing(spark: S, d: str) -> DataFrame:
    """How often each template was assigned: words stand for templates here."""
    w = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("template"))
    return messages.listing(w)
