"""Command line: discover, mine, rules, synth, replay, stats, chain. Stages read and write JSON lines or Parquet, so a later one can be run again."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .operators import dataset, rules, snapshot
from .plans import mining
from .session import build
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftlake")
    s = p.add_subparsers(dest="verb", required=True)
    d = s.add_parser("discover")
    d.add_argument("repo"), d.add_argument("out"), d.add_argument("--mainline", default="HEAD"), d.add_argument("--modes", default="squash"), d.add_argument("--limit", type=int, default=0), d.add_argument("--version-file", default="toolchain"), d.add_argument("--no-adaptations", action="store_true")
    m = s.add_parser("mine")
    m.add_argument("repo"), m.add_argument("windows"), m.add_argument("out"), m.add_argument("--suffix", default=""), m.add_argument("--gap", type=int, default=0), m.add_argument("--context", type=int, default=6), m.add_argument("--keep-noise", action="store_true"), m.add_argument("--min-confidence", type=float, default=0.0)
    m.add_argument("--keep-per-signature", type=int, default=1), m.add_argument("--cap-per-label", type=int, default=2000), m.add_argument("--cap-per-signature", type=int, default=8), m.add_argument("--split-by", default="toolchain"), m.add_argument("--seed", type=int, default=0)
    m.add_argument("--kind", default=None), m.add_argument("--max-windows", type=int, default=0), m.add_argument("--max-hunk-lines", type=int, default=60), m.add_argument("--prefix", action="append", default=[]), m.add_argument("--no-split", action="store_true")
    r = s.add_parser("rules")
    r.add_argument("pairs"), r.add_argument("out"), r.add_argument("--min-support", type=int, default=2)
    y = s.add_parser("synth")
    y.add_argument("repo"), y.add_argument("rules"), y.add_argument("out"), y.add_argument("--ref", default="HEAD"), y.add_argument("--suffix", default=""), y.add_argument("--scan-files", type=int, default=1500), y.add_argument("-n", type=int, default=1000)
    y.add_argument("--max-per-rule", type=int, default=20), y.add_argument("--sites-per-file", type=int, default=1), y.add_argument("--prefix", action="append", default=[]), y.add_argument("--seed", type=int, default=0)
    v = s.add_parser("replay")
    v.add_argument("samples"), v.add_argument("files"), v.add_argument("outcomes"), v.add_argument("out"), v.add_argument("--labels", default=""), v.add_argument("--limit", type=int, default=0)
    t = s.add_parser("stats")
    t.add_argument("pairs")
    c = s.add_parser("chain")
    c.add_argument("snapshots", help="folder of release=... partitions of snapshot lines"), c.add_argument("out"), c.add_argument("--info", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build()
    if a.verb == "discover":
        mining.discover(spark, a.repo, a.mainline, tuple(a.modes.split(",")), a.version_file, a.limit, not a.no_adaptations).write.mode("overwrite").parquet(a.out)
    elif a.verb == "mine":
        pairs = mining.mine(spark.read.parquet(a.windows), a.repo, suffix=a.suffix, gap=a.gap, context=a.context, keep_noise=a.keep_noise, least=a.min_confidence, prefixes=tuple(a.prefix), most=a.max_hunk_lines, kind=a.kind, max_windows=a.max_windows)
        pairs.write.mode("overwrite").parquet(f"{a.out}/raw")
        mining.build(spark.read.parquet(f"{a.out}/raw"), a.keep_per_signature, a.cap_per_label, a.cap_per_signature, a.split_by, a.seed, not a.no_split).write.mode("overwrite").partitionBy("split").parquet(f"{a.out}/pairs")
        writers.dumps(dataset.report(spark.read.parquet(f"{a.out}/pairs"))).write.mode("overwrite").text(f"{a.out}/report")
    elif a.verb == "rules":
        mining.induce(spark.read.parquet(a.pairs), a.min_support).write.mode("overwrite").parquet(a.out)
    elif a.verb == "synth":
        mining.synthesize(spark, spark.read.parquet(a.rules), a.repo, a.ref, a.suffix, a.scan_files, a.n, a.seed, a.max_per_rule, a.sites_per_file, tuple(a.prefix)).write.mode("overwrite").parquet(a.out)
    elif a.verb == "replay":
        samples = spark.read.parquet(a.samples)
        if a.limit:
            samples = rules.budget(samples, "commit", "sample_id", a.limit)
        found = rules.verdicts(samples, spark.read.parquet(a.files), spark.read.parquet(a.outcomes), a.labels.split(",") if a.labels else None)
        found.write.mode("overwrite").parquet(f"{a.out}/results")
        pairs = samples.select("sample_id", "label", F.lit(0).alias("seq"))
        rules.calibration(spark.read.parquet(f"{a.out}/results"), pairs).write.mode("overwrite").json(f"{a.out}/calibration")
    elif a.verb == "stats":
        dataset.report(spark.read.parquet(a.pairs)).show(50, truncate=False)
    else:
        raw = spark.read.text(a.snapshots).select(F.col("release").cast("string").alias("release"), "value", F.monotonically_increasing_id().alias("seq"))
        consts = readers.snapshot(raw, "const")
        pairs = snapshot.version_pairs(consts)
        b, t = snapshot.side(consts, pairs, "base"), snapshot.side(consts, pairs, "target")
        snapshot.constants(b, t, a.info).write.mode("overwrite").partitionBy("base", "target").json(f"{a.out}/causes")
        writers.write_chain(snapshot.chain(snapshot.constants(b, t), pairs), f"{a.out}/chain")
    return 0


if __name__ == "__main__":
    sys.exit(main())
