"""Multi-label classification of edits by a prioritised rule table.

A rule is a function of a context of columns that gives an array of labels
(empty: it does not fire) with a confidence. Rules are columns, so all of them
run in one projection; lexers that need bracket depth are pandas UDFs whose
results are columns of the context.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X

Outcome = Column  # struct<labels array<string>, confidence double>
STOP = ["meta.formatting", "meta.comment_only", "meta.adaptation_note"]


@dataclass(frozen=True)
class Rule:
    priority: int
    name: str
    build: Callable[[], Outcome]


RULES: list[Rule] = []


def rule(priority: int, name: str) -> Callable:
    """Add a rule; users may register theirs the same way."""

    def add(f: Callable[[], Outcome]) -> Callable[[], Outcome]:
        RULES.append(Rule(priority, name, f))
        RULES.sort(key=lambda r: -r.priority)
        return f

    return add


C = F.col


def out(labels: Column | list[str | None], confidence: float | Column) -> Outcome:
    arr = labels if isinstance(labels, Column) else F.array(*[F.lit(x) for x in labels])
    return F.struct(F.filter(arr, lambda x: x.isNotNull()).alias("labels"), (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).alias("confidence"))


def fires(cond: Column, labels, confidence) -> Outcome:
    return F.when(cond, out(labels, confidence))


def minus(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


@rule(100, "formatting")
def _formatting() -> Outcome:
    return fires(C("norm_pre") == C("norm_post"), ["meta.formatting"], 0.99)


@rule(95, "adaptation_note")
def _note() -> Outcome:
    bare = X.normalize(F.replace(C("post"), F.lit("#adaptation_note"), F.lit(" ")))
    return fires(C("post").contains("#adaptation_note") & (bare == C("norm_pre")), ["meta.adaptation_note"], 0.95)


@rule(90, "set_option")
def _set_option() -> Outcome:
    names = F.array_distinct(F.concat(F.transform("opts_added", lambda o: o["name"]), F.transform("opts_removed", lambda o: o["name"])))

    def label(o: Column) -> Column:
        return (
            F.when(o.contains("synthInstance"), "perf.synth_instance").when(o.contains("maxHeartbeats"), "perf.heartbeats").when(o.contains("maxRecDepth"), "perf.max_rec_depth")
            .when(o.startswith("linter."), "lint.disabled").when(o.contains("isDefEq") | F.lower(o).contains("defeq") | o.contains("Transparency") | o.startswith("backward.") | o.startswith("experimental."), "elab.defeq_transparency")
            .otherwise("lint.other")
        )

    return fires(F.size(names) > 0, F.array_distinct(F.transform(names, label)), 0.93)


@rule(85, "attribute")
def _attribute() -> Outcome:
    add, rem = minus(C("attr_post"), C("attr_pre")), minus(C("attr_pre"), C("attr_post"))
    one = (F.size(add) == 1) & (F.size(rem) == 1)
    any_delta = (F.size(add) > 0) | (F.size(rem) > 0)
    reducible = F.exists(F.concat(add, rem), lambda a: a.contains("reducible"))
    return (
        F.when(any_delta & reducible, out(F.array(F.lit("elab.instance_reducibility"), F.when(one, "rename.attribute")), 0.95)).when(one, out(["rename.attribute"], 0.8))
        .when(F.exists(add, lambda a: a.startswith("deprecated")), out(["rename.deprecation_added"], 0.95)).when(any_delta, out(["auto.attribute_delta"], 0.7))
    )


@rule(84, "import")
def _import() -> Outcome:
    return fires(C("imports_pre") != C("imports_post"), ["rename.import"], 0.9)


@rule(83, "open")
def _open() -> Outcome:
    return fires(C("open_pre") != C("open_post"), ["rename.open_scope"], 0.9)


def _lemmas(add: Column, rem: Column) -> Column:
    bare = lambda v: F.transform(v, lambda x: F.trim(F.regexp_replace(x, r"^[←\-\s]+", "")))
    turned = F.array_intersect(bare(add), bare(rem))
    more = lambda v: F.exists(v, lambda x: ~F.array_contains(turned, F.trim(F.regexp_replace(x, r"^[←\-\s]+", ""))))
    return F.array(F.when(F.size(turned) > 0, "auto.simp_lemma_reoriented"), F.when(more(add), "auto.simp_lemma_added"), F.when(F.exists(rem, lambda x: ~F.array_contains(turned, F.trim(F.regexp_replace(x, r"^[←\-\s]+", "")))), "auto.simp_lemma_removed"))


@rule(80, "lemma_calls")
def _calls() -> Outcome:
    args = lambda c: F.array_distinct(F.flatten(F.transform(C(c), lambda x: x["args"])))
    a, b = args("calls_pre"), args("calls_post")
    both = (F.size("calls_pre") > 0) & (F.size("calls_post") > 0)
    differ = (F.size(minus(a, b)) > 0) | (F.size(minus(b, a)) > 0)
    tight = F.exists("calls_pre", lambda x: ~x["only"]) & F.forall("calls_post", lambda x: x["only"])
    return F.when(both & differ, out(_lemmas(minus(b, a), minus(a, b)), 0.88)).when(both & tight, out(["auto.simp_tightened"], 0.85))


@rule(79, "lemma_fragment")
def _fragment() -> Outcome:
    a, b = C("frag_pre"), C("frag_post")
    cond = a.isNotNull() & b.isNotNull() & (F.array_sort(a) != F.array_sort(b)) & (F.size(X.tactics(F.array_join("ctx_before", "\n"))) > 0)
    return fires(cond, _lemmas(minus(b, a), minus(a, b)), 0.82)


@rule(75, "rename")
def _rename() -> Outcome:
    s = C("subs")
    ok = (F.size(s) > 0) & F.forall(s, lambda x: X.is_identifier(x["old"]) & X.is_identifier(x["new"]))
    reducible = F.exists(s, lambda x: x["old"].contains("reducible") | x["new"].contains("reducible"))
    a, b = s[0]["old"], s[0]["new"]
    return (
        F.when(ok & (C("role") == "name"), out(F.array(F.when(reducible, "elab.instance_reducibility"), F.lit("rename.attribute")), 0.9))
        .when(ok & X.namespace_move(a, b), out(["rename.namespace"], 0.9)).when(ok, out(["rename.decl"], F.when(F.size(s) == 1, 0.9).otherwise(0.75)))
    )


@rule(70, "universe")
def _universe() -> Outcome:
    braces = r"\.\{[^}]*\}"
    return fires((C("added").rlike(braces) | C("added").rlike(r"\bType\s+u\b")) & ~C("pre").rlike(braces), ["elab.universe"], 0.7)


@rule(68, "argument")
def _argument() -> Outcome:
    named = r"\(\s*[\p{L}\p{N}_']+\s*:=\s*"
    parens = lambda c: F.length(c) - F.length(F.replace(c, F.lit("("), F.lit("")))
    return F.when(C("added").rlike(named) & ~C("pre").rlike(named), out(["elab.named_argument"], 0.75)).when(C("added").rlike(r"\([^()]+\s:\s[^()]+\)") & (F.trim(C("pre")) != "") & (parens(C("post")) > parens(C("pre"))), out(["elab.type_ascription"], 0.6))


def _arrows(c: Column) -> Column:
    marks = ["↑", "⇑", r"\(↑", "toFun", r"\.hom", r"Subtype\.val"]  # fixed values; an arrow in a bracket counts twice
    return sum((F.regexp_count(c, F.lit(m)) for m in marks[1:]), F.regexp_count(c, F.lit(marks[0])))


@rule(66, "coercion")
def _coercion() -> Outcome:
    return fires(_arrows(C("added")) != _arrows(C("removed")), ["elab.coercion"], 0.6)


@rule(64, "binder")
def _binder() -> Outcome:
    shapes = [(r"fun\s*[⟨(]", r"fun\s*\|"), (r"∀\s*[\p{L}\p{N}_]+\s*[><≤≥∈]", r"∀\s*[\p{L}\p{N}_]+,\s*[\p{L}\p{N}_]+\s*[><≤≥∈]"), (r"⟨[^⟩]*⟩", r"\{\s*[\p{L}\p{N}_]+\s*:=")]
    hit = F.lit(False)
    for old, new in shapes:
        hit = hit | (C("pre").rlike(old) & C("post").rlike(new) & ~C("pre").rlike(new))
    return F.when(hit, out(["elab.binder_syntax"], 0.6)).when(C("pre").contains("⟨") & C("post").rlike(r"\bwhere\b|\{\s*[\p{L}\p{N}_]+\s*:="), out(["elab.structure_instance"], 0.55))


def _shift(a: Column, b: Column, both: float, one: float) -> Outcome:
    add, rem = F.size(minus(b, a)) > 0, F.size(minus(a, b)) > 0
    return F.when(add & rem, out(["auto.tactic_swap"], both)).when(add, out(["auto.tactic_added"], one)).when(rem, out(["auto.tactic_removed"], one))


@rule(62, "inline_tactic")
def _inline() -> Outcome:
    return _shift(C("tactics_pre"), C("tactics_post"), 0.65, 0.6)


@rule(60, "tactic_shape")
def _shape() -> Outcome:
    return _shift(C("heads_pre"), C("heads_post"), 0.6, 0.55)


@rule(10, "fallback")
def _fallback() -> Outcome:
    a, b = C("norm_pre"), C("norm_post")
    rest = F.when(a.contains(" "), F.substring(a, F.instr(a, " ") + 1, F.length(a))).otherwise(a)
    inside = lambda p: (F.length(p) >= 6) & b.contains(p)
    some = (F.trim(C("pre")) != "") & (F.trim(C("post")) != "")
    return F.when(some & (a != "") & (inside(a) | inside(rest)), out(["auto.term_wrapped"], 0.45)).when(some, out(["auto.proof_rewrite"], 0.3))


def context(edits: DataFrame) -> DataFrame:
    """edits (pre, post, ctx_before) with what the rules read."""
    d = edits.withColumn("pre", F.coalesce("pre", F.lit(""))).withColumn("post", F.coalesce("post", F.lit("")))
    if "ctx_before" not in d.columns:
        d = d.withColumn("ctx_before", F.array().cast("array<string>"))
    d = d.withColumns({"norm_pre": X.normalize(C("pre")), "norm_post": X.normalize(C("post")), "added": X.added_lines(C("pre"), C("post")), "removed": X.added_lines(C("post"), C("pre"))})
    d = d.withColumns({"attr_pre": X.attributes(C("pre")), "attr_post": X.attributes(C("post")), "calls_pre": X.lemma_calls(C("pre")), "calls_post": X.lemma_calls(C("post")), "frag_pre": X.lemma_fragment(X.strip_comments(C("pre"))), "frag_post": X.lemma_fragment(X.strip_comments(C("post"))), "subs": X.substitutions(C("pre"), C("post"))})
    # What rules and their evidence both read is found once.
    sides = {"imports": X.imports, "open": X.opened, "tactics": X.tactics, "heads": X.tactic_heads}
    d = d.withColumns({f"{k}_{side}": f(C(side)) for k, f in sides.items() for side in ("pre", "post")} | {"opts_added": X.options(C("added")), "opts_removed": X.options(C("removed"))})
    return d.withColumn("role", X.attribute_role(C("pre"), F.try_element_at(F.transform("subs", lambda x: x["old"]), F.lit(1))))


def evidence(fired: Column) -> Column:
    """What the rules that fired saw, by the keys of each; keys of other rules are null, and a later rule's value stands where two give one."""
    on = lambda *names: F.arrays_overlap(fired, F.array(*[F.lit(n) for n in names]))
    sorted_minus = lambda a, b: F.array_sort(F.array_distinct(minus(a, b)))
    last = lambda o: F.transform(o, lambda x: F.concat_ws("=", x["name"], x["value"]))
    args = lambda c: F.array_distinct(F.flatten(F.transform(C(c), lambda x: x["args"])))
    lemmas = lambda full, fragment: F.when(on("lemma_calls"), full).when(on("lemma_fragment"), fragment)
    simp_add = lemmas(sorted_minus(args("calls_post"), args("calls_pre")), sorted_minus(C("frag_post"), C("frag_pre")))
    simp_rem = lemmas(sorted_minus(args("calls_pre"), args("calls_post")), sorted_minus(C("frag_pre"), C("frag_post")))
    bare = lambda x: F.trim(F.regexp_replace(x, r"^[←\-\s]+", ""))
    some = lambda c: F.when(F.size(c) > 0, c)
    tact = lambda f, a, b: F.array_sort(F.array_distinct(minus(C(f"{f}_{a}"), C(f"{f}_{b}"))))
    shape, inline = on("tactic_shape"), on("inline_tactic")
    named = F.regexp_extract_all("added", F.lit(r"\(\s*([\p{L}\p{N}_']+)\s*:=\s*"), F.lit(1))
    return F.struct(
        F.when(on("set_option"), last(C("opts_added"))).alias("set_option_added"), F.when(on("set_option"), last(C("opts_removed"))).alias("set_option_removed"),
        F.when(on("attribute"), sorted_minus(C("attr_post"), C("attr_pre"))).alias("attr_added"), F.when(on("attribute"), sorted_minus(C("attr_pre"), C("attr_post"))).alias("attr_removed"),
        F.when(on("import"), sorted_minus(C("imports_post"), C("imports_pre"))).alias("imports_added"), F.when(on("import"), sorted_minus(C("imports_pre"), C("imports_post"))).alias("imports_removed"),
        F.when(on("open"), sorted_minus(C("open_post"), C("open_pre"))).alias("open_added"), F.when(on("open"), sorted_minus(C("open_pre"), C("open_post"))).alias("open_removed"),
        some(simp_add).alias("simp_added"), some(simp_rem).alias("simp_removed"), some(F.filter(simp_add, lambda x: F.exists(simp_rem, lambda y: bare(x) == bare(y)))).alias("reoriented"), F.when(on("lemma_fragment"), True).alias("fragment"),
        F.when(on("lemma_calls"), F.array_sort(F.array_distinct(F.transform(F.concat("calls_pre", "calls_post"), lambda x: x["tactic"])))).alias("tactics"),
        F.when(shape, tact("heads", "post", "pre")).when(inline, tact("tactics", "post", "pre")).alias("tactics_added"), F.when(shape, tact("heads", "pre", "post")).when(inline, tact("tactics", "pre", "post")).alias("tactics_removed"), F.when(inline, True).alias("inline"),
        F.when(on("rename"), F.col("subs")).alias("substitutions"), F.when(on("argument"), some(named)).alias("named_args"), F.when(on("coercion"), _arrows(C("added")) - _arrows(C("removed"))).alias("coercion_delta"),
    )


def classify(edits: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """edits with labels, label (the first), confidence, noise, notes, expected_errors, fired (rules), evidence and rule_errors.

    All rules that fire add their labels in order of priority; the first to
    give a label of STOP ends it; the fallback counts only if no other fired. A
    rule that can't be built is left out and named in rule_errors. Edits are
    small and costly, so they are dealt out by their number: files are split by
    their bytes, and a small file would be one task.
    """
    parts = int(edits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = _barrier(context(edits.repartition(parts)), "_ctx")
    table = sorted(rules or RULES, key=lambda r: -r.priority)
    built, errors = [], []
    for r in table:
        try:
            got = r.build()
            d.select(got)  # a column that doesn't fit the context fails here
            built.append((r, got))
        except Exception as e:  # noqa: BLE001  a rule never stops the others
            errors.append(f"{r.name}: {str(e).splitlines()[0][:200]}")
    some = lambda found: F.filter(F.array(*found), lambda x: x.isNotNull() & (F.size(x["labels"]) > 0)) if found else F.array().cast("array<struct<labels:array<string>,confidence:double,name:string>>")
    # Each outcome is a column first: what is said of it three times is worked out once.
    d = _barrier(d.withColumns({f"_r{i}": got for i, (_, got) in enumerate(built)}), "_built")
    said = [(r.priority, F.when(C(f"_r{i}").isNotNull(), F.struct(C(f"_r{i}.labels").alias("labels"), C(f"_r{i}.confidence").alias("confidence"), F.lit(r.name).alias("name")))) for i, (r, _) in enumerate(built)]
    d = _barrier(d.withColumns({"_high": some([c for p, c in said if p > 10]), "_low": some([c for p, c in said if p <= 10])}).drop(*[f"_r{i}" for i in range(len(built))]), "_rules")
    stop = F.array_position(F.transform("_high", lambda x: x["labels"][0].isin(*STOP)), True)
    d = d.withColumn("_hits", F.when(stop > 0, F.slice("_high", F.lit(1), stop.cast("int"))).when(F.size("_high") > 0, F.col("_high")).otherwise(F.col("_low")))
    labels = F.array_distinct(F.flatten(F.transform("_hits", lambda x: x["labels"])))
    d = _barrier(d.withColumns({"_labels": labels, "fired": F.transform("_hits", lambda x: x["name"]), "rule_errors": F.array(*[F.lit(e) for e in errors]).cast("array<string>"), "confidence": F.coalesce(F.array_max(F.transform("_hits", lambda x: x["confidence"])), F.lit(0.0))}), "_found")
    d = d.withColumn("labels", F.when(F.size("_labels") > 0, F.col("_labels")).otherwise(F.array(F.lit(vocab.UNKNOWN_LABEL))))
    table_of = F.create_map(*[y for k, v in vocab.EXPECTED_ERRORS.items() for y in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    expected = F.array_sort(F.array_distinct(F.flatten(F.transform("labels", lambda x: F.coalesce(F.try_element_at(table_of, x), F.array().cast("array<string>"))))))
    keep = [c for c in edits.columns if c not in ("pre", "post")]
    noise = F.arrays_overlap("labels", F.array(*[F.lit(x) for x in vocab.NOISE_LABELS]))
    d = d.withColumns({"label": F.col("labels")[0], "noise": noise, "notes": X.notes(F.concat_ws("\n", "post", F.array_join("ctx_before", "\n"))), "expected_errors": expected, "evidence": evidence(C("fired"))})
    return d.select(*dict.fromkeys([*keep, "pre", "post", "labels", "label", "confidence", "noise", "notes", "expected_errors", "subs", "fired", "evidence", "rule_errors"]))


def _barrier(d: DataFrame, name: str) -> DataFrame:
    """The same rows behind a generator of one element: the optimiser doesn't copy expressions through it, which for nested rule arrays would multiply the plan."""
    return d.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in d.columns]))).alias(name)).select(f"{name}.*")


def is_useful(keep_noise: bool = False, least: float = 0.0) -> Column:
    return (F.lit(keep_noise) | ~F.col("noise")) & (F.col("confidence") >= least)


def useful(rows: DataFrame, keep_noise: bool = False, least: float = 0.0) -> DataFrame:
    return rows.where(is_useful(keep_noise, least))
