"""Which segments a stage works on, and what writing does to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.functions import masking
from quireline.functions.normalizing import normalized, outer_blanks
from quireline.functions.text import is_blank, target_token
from quireline.functions.values import HELD, HUMAN, MODEL_PREFIX

POLISHED_KINDS = ("para", "quote", "list")


def workable(review: Column) -> Column:
    """True unless a segment is held for review."""
    return ~review.eqNullSafe(F.lit(HELD))


def translated(target: Column) -> Column:
    return ~is_blank(F.coalesce(target, F.lit("")))


def select(segments: DataFrame, mode: str = "draft", ids: DataFrame | None = None, include_all: bool = False, limit: int = 0, over_human: bool = False, document: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The segments of a stage: ``draft``, ``polish`` or ``repair`` (with an ``issues`` column), or just the given ids.

    ``ids`` is a table of the document's keys and id; what it names is taken as it is. All other ways leave held segments out, and those that a person wrote
    unless ``over_human``. ``limit`` is for drafts: so many pending segments of each document, 0 for all.
    """
    if ids is not None:
        return segments.join(ids.select(*document, "id").distinct(), [*document, "id"], "left_semi")
    out = segments.where(workable(F.col("review")))
    if mode == "polish":
        out = out.where((F.coalesce("target", F.lit("")) != "") & F.col("kind").isin(*POLISHED_KINDS))
    elif mode == "repair":
        out = out.where(F.exists("issues", lambda x: x.severity == "error"))
    else:
        if not include_all:
            out = out.where(~translated(F.col("target")))
        if limit:
            out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*document).orderBy("pos"))).where(F.col("_n") <= limit).drop("_n")
    return out if over_human else out.where(~F.col("origin").eqNullSafe(F.lit(HUMAN)))


def proposals(rows: DataFrame, json: str = "json") -> DataFrame:
    """(id, text) of proposals in any of three forms: a map, a list of {id, text | target}, or either under ``segments``."""
    inner = F.coalesce(F.get_json_object(json, "$.segments"), F.col(json))
    listed = F.from_json(inner, "array<struct<id: string, text: string, target: string>>")
    pairs = F.when(
        F.trim(inner).startswith("["), F.transform(listed, lambda x: F.struct(x.id.alias("id"), F.coalesce(x.text, x.target, F.lit("")).alias("text")))
    ).otherwise(F.transform(F.map_entries(F.from_json(inner, "map<string, string>")), lambda e: F.struct(e.key.alias("id"), e.value.alias("text"))))
    others = [c for c in rows.columns if c != json]
    return rows.select(*others, F.inline(pairs))


def parse_reply(reply: Column) -> Column:
    """map<string, string> of a model's reply: fences cut, else the outermost braces; a list of {id, text | target} works too."""
    clean = F.trim(F.regexp_replace(reply, r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    outer = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    listed = F.from_json(clean, "array<struct<id: string, text: string, target: string>>")
    from_list = F.map_from_entries(F.transform(F.filter(listed, lambda x: x.id.isNotNull()), lambda x: F.struct(x.id, F.coalesce(x.text, x.target, F.lit("")))))
    from_map = F.from_json(F.when(clean.startswith("{"), clean).otherwise(outer), "map<string, variant>")
    strings = F.map_filter(from_map, lambda _, v: F.schema_of_variant(v) == "STRING")
    return F.when(clean.startswith("["), from_list).otherwise(F.transform_values(strings, lambda _, v: F.variant_get(v, "$", "string")))


def apply(segments: DataFrame, incoming: DataFrame, lang: str, operations: Sequence[str] = (), origin: str = "agent", over_human: bool = False, keys: Sequence[str] = ("doc_id", "id")) -> DataFrame:
    """What becomes of each proposal (keys, text, base): ``outcome``, ``new_target`` and ``token``.

    Outcomes: ``unknown`` (no such segment), ``blank`` (no wording), ``conflict`` (a base token that
    is not the stored wording's), ``refused`` (a model over a person's wording) and ``applied``.
    """
    stored = segments.select(*keys, F.struct("masked", "target", "origin").alias("_s"))
    df = incoming.join(stored, list(keys), "left")
    s = F.col("_s")
    current = target_token(s["target"])
    base = F.col("base") if "base" in incoming.columns else F.lit(None).cast("string")
    by_model = F.lit(origin.startswith(MODEL_PREFIX)) & (s["origin"] == HUMAN) & F.lit(not over_human)
    outcome = (
        F.when(s.isNull(), "unknown").when(is_blank(F.coalesce(F.col("text"), F.lit(""))), "blank").when(base.isNotNull() & (base != current), "conflict")
        .when(F.coalesce(by_model, F.lit(False)), "refused").otherwise("applied")
    )
    wording = outer_blanks(s["masked"], normalized(masking.repaired(F.col("text")), lang, operations), keep_added_indent=True)
    df = df.withColumn("outcome", outcome)
    new = F.when(F.col("outcome") == "applied", wording)
    token = F.when(F.col("outcome") == "applied", target_token(wording)).when(F.col("outcome") == "conflict", current)
    return df.withColumns({"new_target": new, "token": token}).drop("_s")


def hold(segments: DataFrame, ids: DataFrame, held: bool = True, keys: Sequence[str] = ("doc_id", "id")) -> DataFrame:
    """What becomes of each id to hold or release: ``unknown``, ``blank`` (nothing to hold), ``unchanged`` or ``applied``."""
    df = ids.join(segments.select(*keys, F.struct("target", "review").alias("_s")), list(keys), "left")
    s = F.col("_s")
    wanted = F.lit(HELD) if held else F.lit(None).cast("string")
    blank = F.lit(held) & ~translated(s["target"])
    outcome = F.when(s.isNull(), "unknown").when(blank, "blank").when(s["review"].eqNullSafe(wanted), "unchanged").otherwise("applied")
    return df.withColumn("outcome", outcome).drop("_s")


def size_of(chosen: DataFrame) -> DataFrame:
    """What a stage would send: segments, and characters of their masked text."""
    return chosen.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum(F.length("masked")), F.lit(0)).alias("characters"))
