"""Rebuilding documents from skeletons and wording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.functions import masking
from quireline.functions.normalizing import polished
from quireline.functions.text import with_terminator
from quireline.functions.values import MARKERS


def render_blocks(nodes: DataFrame, segments: DataFrame, fallback: bool = False, marker: str = MARKERS["markdown"], lang: str = "", operations: Sequence[str] = (), keys: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """Blocks in order: keys, pos, id, kind, from (target, source or marker) and text.

    Any non-empty wording is used, white space too; the rest shows its source or a marker.
    """
    s = segments.select(*keys, F.col("id").alias("seg_id"), F.struct("kind", "target", "masked", "originals").alias("_s"))
    df = nodes.join(s, [*keys, "seg_id"], "left")
    has = F.coalesce(F.col("_s.target"), F.lit("")) != ""
    back = lambda c: masking.unmasked(c, F.col("_s.originals"))
    instead = back(F.col("_s.masked")) if fallback else F.replace(F.lit(marker), F.lit("{id}"), F.col("seg_id"))
    text = F.when(F.col("t") == "raw", F.col("v")).when(has, polished(back(F.col("_s.target")), lang, operations)).otherwise(instead)
    source = F.when(F.col("t") == "seg", F.when(has, "target").otherwise("source" if fallback else "marker"))
    return df.select(*keys, "pos", F.col("seg_id").alias("id"), F.col("_s.kind").alias("kind"), source.alias("from"), text.alias("text"))


def render(blocks: DataFrame, eol: Column | str = "\n", keys: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """One text for each document, with its line end put back, and how many segments had no wording."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text)
    end = F.lit(eol) if isinstance(eol, str) else F.first(eol)
    df = blocks.groupBy(*keys).agg(F.array_join(parts, "").alias("text"), end.alias("_eol"), F.count_if(F.col("from").isin("source", "marker")).alias("missing"))
    return df.withColumn("text", with_terminator(F.col("text"), F.col("_eol"))).drop("_eol")


def output_path(pattern: str, lang: Column, path: Column) -> Column:
    """A pattern with {lang}, {path} and {name} filled in."""
    name = F.regexp_extract(path, r"[^/]*\z", 0)
    out = F.lit(pattern)
    for key, value in (("{lang}", lang), ("{path}", path), ("{name}", name)):
        out = F.replace(out, F.lit(key), value)
    return out
