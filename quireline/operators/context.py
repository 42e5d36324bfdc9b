"""Neighbours, batches, terminology and prompts for translation requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.functions.text import mentions
from quireline.functions.values import BATCH_SIZE, CONTEXT


def neighbours(segments: DataFrame, window: int = CONTEXT, document: Sequence[str] = ("doc_id",), order: str = "pos") -> DataFrame:
    """``before`` and ``after``: arrays of struct<id, text> of up to ``window`` segments on either side, in document order."""
    near = Window.partitionBy(*document).orderBy(order)
    one = F.struct(F.col("id").alias("id"), F.col("masked").alias("text"))
    return segments.withColumns({"before": F.collect_list(one).over(near.rowsBetween(-window, -1)), "after": F.collect_list(one).over(near.rowsBetween(1, window))})


def batches(segments: DataFrame, size: int = BATCH_SIZE, document: Sequence[str] = ("doc_id",), order: str = "pos") -> DataFrame:
    """``batch``: a number from 0 for every ``size`` segments of a document."""
    place = F.row_number().over(Window.partitionBy(*document).orderBy(order))
    return segments.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def referenced(segments: DataFrame, document: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Neighbours in the same batch by id (``before_id``, ``after_id``), others by text (``before_text``, ``after_text``)."""
    batch = Window.partitionBy(*document, "batch")
    df = segments.withColumn("_present", F.collect_set("id").over(batch))
    out = {}
    for side in ("before", "after"):
        inside = F.filter(side, lambda x: F.array_contains("_present", x.id))
        outside = F.filter(side, lambda x: ~F.array_contains("_present", x.id) & (F.coalesce(x.text, F.lit("")) != ""))
        out[f"{side}_id"] = F.when(F.size(inside) > 0, F.array_join(F.transform(inside, lambda x: x.id), " "))
        out[f"{side}_text"] = F.when(F.size(outside) > 0, F.array_join(F.transform(outside, lambda x: x.text), "\n\n"))
    return df.withColumns(out).drop("_present")


def glossary_hints(text: Column, rows: Sequence[dict]) -> Column:
    """array<string> ``source -> target`` of the glossary rows that a text mentions; proposals without a target give none."""
    found = [F.when(mentions(text, F.lit(r["source"])), F.lit(f"{r['source']} -> {r['target']}")) for r in rows if r.get("target")]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def style_notes(text: Column, blocks: Sequence[dict]) -> Column:
    """array<struct<names, notes>> of the style blocks that a text mentions."""
    found = []
    for b in blocks:
        hit = F.lit(False)
        for name in b["names"]:
            hit = hit | mentions(text, F.lit(name))
        found.append(F.when(hit, F.struct(F.array(*map(F.lit, b["names"])).alias("names"), F.lit(b["notes"]).alias("notes"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<names: array<string>, notes: string>>")


def requests(segments: DataFrame, glossary: Sequence[dict] = (), style: Sequence[dict] = (), document: Sequence[str] = ("doc_id",), mode: str = "draft") -> DataFrame:
    """One request for each batch: terminology and style notes of the whole batch, and its items as JSON in document order."""
    item = {"id": F.col("id"), "kind": F.col("kind"), "before_id": F.col("before_id"), "before_text": F.col("before_text"), "text": F.col("masked"), "after_id": F.col("after_id"), "after_text": F.col("after_text")}
    if mode == "polish":
        item["draft"] = F.coalesce("target", F.lit(""))
    if "problems" in segments.columns:
        item["problems"] = F.col("problems")
    one = F.struct(*[v.alias(k) for k, v in item.items()])
    df = segments.groupBy(*document, "batch").agg(
        F.sort_array(F.collect_list(F.struct("pos", one.alias("item")))).alias("_items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(glossary_hints(F.col("masked"), glossary))))).alias("terms"),
    )
    text = F.array_join(F.transform("_items", lambda x: x.item.text), "\n")
    return df.withColumns({"style": style_notes(text, style), "payload": F.to_json(F.transform("_items", lambda x: x.item), {"ignoreNullFields": "true"})}).drop("_items")


def system_prompt(source_lang: str, target_lang: str, tone: str, mode: str = "draft", with_context: bool = False, brief: str | None = None, preamble: str = "") -> str:
    """The one system prompt of a run; its parts that hold nothing are left out."""
    if mode == "polish":
        base = f"Revise translations into {target_lang} for fluency. Keep the meaning and every placeholder ⟦n⟧. Reply with one JSON object of segment ids and revised texts."
    else:
        base = f"Translate segments of a document from {source_lang} into {target_lang}, in a {tone} tone. Copy every placeholder ⟦n⟧ exactly. Reply with one JSON object of segment ids and translations."
    context = "Items may carry neighbours as before_id, before_text, after_id or after_text: they are context and are not to be translated." if with_context else ""
    return "\n\n".join(p for p in (base, context, brief, preamble) if p)
