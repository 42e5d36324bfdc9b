"""Counts of segments and issues, by document, language and project."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireline.functions.values import HELD
from quireline.operators.selection import translated


def document_counts(segments: DataFrame, keys: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """segments, translated, pending and held of each document; white space is no translation."""
    done = translated(F.col("target"))
    return segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(done).alias("translated"), F.count_if(~done).alias("pending"), F.count_if(F.col("review") == HELD).alias("held")
    )


def check_reports(checked: DataFrame, keys: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """One report for each document: segments, translated (any wording), errors, warnings and by_rule."""
    rule = checked.select(*keys, F.explode("issues").alias("x")).groupBy(*keys, F.col("x.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    by_rule = rule.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "n")))).alias("by_rule"))
    having = lambda severity: F.sum(F.size(F.filter("issues", lambda x: x.severity == severity))).cast("long")
    counts = checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.coalesce("target", F.lit("")) != "").alias("translated"), having("error").alias("errors"), having("warn").alias("warnings")
    )
    named = by_rule.select(*[F.col(k).alias(f"_{k}") for k in keys], "by_rule")  # a document or language that is null has rules too
    same = reduce(and_, [counts[k].eqNullSafe(named[f"_{k}"]) for k in keys])
    joined = counts.join(named, same, "left").drop(*[f"_{k}" for k in keys])
    return joined.withColumn("by_rule", F.coalesce("by_rule", F.create_map().cast("map<string, bigint>")))


def rollup(documents: DataFrame, project: str = "project", lang: str = "lang") -> DataFrame:
    """Totals by project and language, and by project (lang null); errors count checked documents only."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("segments", "translated", "pending", "held")]
    issues = [F.coalesce(F.sum(F.when(F.col("checked"), F.col(c))), F.lit(0)).alias(c) for c in ("errors", "warnings")]
    sets = [[F.col(project), F.col(lang)], [F.col(project)]]
    return documents.groupingSets(sets, F.col(project), F.col(lang)).agg(F.count(F.lit(1)).alias("documents"), F.count_if("checked").alias("checked_documents"), *sums, *issues)


def with_reports(documents: DataFrame, reports: DataFrame, keys: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """Documents beside their reports: ``checked``, and ``stale`` where a report's counts are no longer the document's."""
    r = reports.select(*keys, F.struct("segments", "translated", "errors", "warnings").alias("report"))
    df = documents.join(r, list(keys), "left")
    differs = (F.col("report.segments") != F.col("segments")) | (F.col("report.translated") != F.col("translated"))
    return df.withColumns({"checked": F.col("report").isNotNull(), "stale": F.coalesce(differs, F.lit(False))})


def untracked(candidates: DataFrame, targets: DataFrame, tracked: DataFrame) -> DataFrame:
    """Pairs of a candidate (doc_id, label) and a target language (lang) that no tracked document has; ids are compared without case.

    Target languages are a project's settings: as one array they are joined to each candidate, all of them.
    """
    langs = targets.where("lang IS NOT NULL").agg(F.sort_array(F.collect_set("lang")).alias("_langs"))  # one row
    every = candidates.join(F.broadcast(langs)).withColumn("lang", F.explode("_langs")).withColumn("_fold", F.lower("doc_id")).drop("_langs")
    known = tracked.select(F.lower("doc_id").alias("_fold"), "lang")
    return every.join(known, ["_fold", "lang"], "left_anti").drop("_fold")


def collisions(labels: DataFrame) -> DataFrame:
    """Ids that more than one label has: id (without case), number of labels and the labels in order."""
    ids = labels.groupBy(F.lower("doc_id").alias("identity")).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return ids.where(F.size("labels") > 1).withColumn("n", F.size("labels").cast("long"))


def issues_by_segment(issues: DataFrame, keys: Sequence[str] = ("doc_id", "lang", "seg")) -> DataFrame:
    """All issues of each segment as one ordered array."""
    return issues.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rule", "severity", "message"))).alias("issues"))


def shown(issues: DataFrame, most: int = 25, keys: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """The first ``most`` issues of each document, by segment and then as found; ``more`` counts the rest of the document's."""
    w = Window.partitionBy(*keys)
    placed = issues.withColumns({"_n": F.row_number().over(w.orderBy("seg", "rule", "message")), "more": F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0))})
    return placed.where(F.col("_n") <= most).orderBy(*keys, "_n").drop("_n")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Stored check reports (``write_report``): lang, doc_id and counts; files that are no report are left out."""
    schema = "doc_id string, lang string, segments long, translated long, errors long, warnings long, by_rule map<string, long>"
    files = spark.read.text(f"{folder}/*.json", wholetext=True)  # by name, as listing leaves out what lies below a folder with a dot
    return files.select(F.from_json("value", schema).alias("r")).where("r.doc_id IS NOT NULL").select("r.*")


def write_report(report: dict, folder: str) -> str:
    """One document's report as a JSON file that appears at once; its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{report['doc_id']}.{report['lang']}.json")
    with open(f"{path}.tmp", "w", encoding="utf-8", newline="\n") as file:
        json.dump(report, file, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(f"{path}.tmp", path)
    return path
