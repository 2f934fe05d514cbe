
from driftlake import catalog
from driftlake.operators import rules
from driftlake.sources.readers import table

SF = "/root/testdata/sf0.001"


def test_drift_takes_whole_turns(spark):
    texts = {r[0] for r in table(spark, SF, "conversations").select("text").collect()}
    for name in ("drift_exact_turns", "drift_fuzzy"):
        rows = catalog.queries()[name](spark, SF).collect()
        assert {r[k] for r in rows for k in ("before", "after")} - {None} == texts


def test_window_rules_of_every_pair(spark):
    wide = "x" + " " * 700 + "y"
    rows = [("r", 0, [("a", "b")], "a z", "b z", "w0"), ("l", 1, [], "m" * 700, "n", "w0"), ("s", 2, [], "n", wide, "w0"), ("o", 3, [], "n", "q" * 600, "w0"), ("b", 4, [], "i  j", "i j", "w0")]
    rows += [("many", i, [("c", "d")], "c", "d", "w1" if i < 150 else f"w{i // 50 - 1}") for i in range(10, 260)]
    p = spark.createDataFrame([(*r[:5], "l", "f", r[5], "v", 1) for r in rows], "sample_id string, seq int, subs array<struct<old:string,new:string>>, broken string, fixed string, label string, file string, window string, toolchain string, duplicate_count int")
    got = {(r["kind"], r["old"], r["new"]): r for r in rules.induce(p, 1, renames=True).collect()}
    assert {k[1:] for k in got if k[0] == "window"} == {("a z", "b z"), ("m" * 700, "n"), ("n", wide), ("c", "d")}
    assert got["subst", "c", "d"]["origins"] == ["w1", "w2", "w3"] and got["subst", "c", "d"]["windows"] == ["d"] * 3 and got["subst", "c", "d"]["support"] == 250 and got["subst", "c", "d"]["provenance"] == ["many"]
    assert {r["old"] for r in rules.induce(p, 1).where("kind = 'window'").collect()} == {"m" * 700, "n"}


def test_window_rules_are_searched(spark):
    r = spark.createDataFrame([("w1", "window", "⟨a⟩", "[·]"), ("w2", "window", "tt", "rfl"), ("s1", "subst", "tt", "rfl")], "rule_id string, kind string, old string, new string").selectExpr("*", "'l' AS label", "1 AS support", "true AS reversible")
    f = spark.createDataFrame([("a", "x [·] y"), ("b", "by rfl'"), ("c", "by rfl")], "path string, text string")
    got = {(s["rule_id"], s["path"], s["broken"]) for s in rules.synthesize(r, f).collect()}
    assert got == {("w1", "a", "x ⟨a⟩ y"), ("w2", "b", "by tt'"), ("w2", "c", "by tt"), ("s1", "c", "by tt")}


def test_every_conversation_and_hop(spark):
    q = catalog.queries()
    got = {r[0].split("_")[0] for r in q["history_reachability_all"](spark, SF).collect()}
    assert got == {f"n{r[0]}" for r in table(spark, SF, "conversations").where("turn > 1").select("conv_id").collect()} and len(got) > 1
    years = sorted(r[0] for r in table(spark, SF, "orders").selectExpr("year(o_orderdate)").distinct().collect())
    assert {(r["base"], r["target"]) for r in q["diff_option_and_instance_hops"](spark, SF).select("base", "target").distinct().collect()} == set(zip(years, years[1:]))


def test_bootstrap_of_400_draws(spark):
    a, b = (sorted(catalog.queries()[n](spark, SF).collect()) for n in ("bootstrap_ci", "bootstrap_ci_400"))
    assert a != b and "range(400)" in catalog.oracle_sql()["bootstrap_ci_400"]
