"""Writers. Folders are committed by Spark; single-file forms are for results that are small by nature."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(records: DataFrame, path: str) -> None:
    """Append records of finished keys; a failed batch leaves no trace and its keys stay pending."""
    records.write.mode("append").json(path)


def folded(log: DataFrame, key: str = "tag", hits: str = "hits", order: str = "seq") -> DataFrame:
    """key and hits as JSON: the last record of each key."""
    return log.groupBy(key).agg(F.to_json(F.max_by(hits, order)).alias("json"))


def write_folded(log: DataFrame, path: str) -> None:
    """One JSON object a line, {key: hits}; the folder is replaced as a whole."""
    f = folded(log)
    f.select(F.concat(F.lit("{"), F.to_json(F.array(f.columns[0])).substr(F.lit(2), F.length(F.to_json(F.array(f.columns[0]))) - 2), F.lit(":"), "json", F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def dumps(rows: DataFrame) -> DataFrame:
    """Rows as JSON with sorted keys."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Write and count in one pass over the written files' rows."""
    dumps(rows).write.mode("overwrite").text(path)
    return rows.sparkSession.read.text(path).count()


def write_chain(chain: DataFrame, path: str) -> None:
    """The hop table as one CSV file: a row a hop."""
    chain.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def with_meta(causes: DataFrame, base: str, target: str, **about: str) -> DataFrame:
    """Causes preceded by a row about the run."""
    meta = causes.sparkSession.createDataFrame([(base, target, "meta", f"{base} -> {target}", json.dumps(about, sort_keys=True), "", "info")], "base string, target string, cause string, name string, detail string, class string, sev string")
    return meta.unionByName(causes)


def write_manifest(path: str, **sections: object) -> None:
    with open(path, "w") as f:
        json.dump(sections, f, indent=2, sort_keys=True, default=str)


def ranked(counts: DataFrame, silent: list[str]) -> DataFrame:
    """cause, count, share, cumulative rank and whether it is silent: what a bar chart shows. One row a cause."""
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(1))
    return counts.select("cause", "count", F.round(100 * F.col("count") / F.sum("count").over(every), 2).alias("share"), F.row_number().over(Window.orderBy(F.desc("count"), "cause")).cast("long").alias("rank"), F.when(F.col("cause").isin(silent), "silent").otherwise("loud").alias("tag"))
