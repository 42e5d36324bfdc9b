"""Documents to stored segments: segmentation, carried-over wording, then the memory's."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.functions import masking
from quireline.functions.normalizing import accepted
from quireline.functions.text import key_tone
from quireline.functions.values import SEGMENTATION_VERSION
from quireline.operators.alignment import carry_over
from quireline.operators.assembly import nodes_of, segments_of
from quireline.operators.memory import lookup
from quireline.operators.segment_markdown import segment_markdown
from quireline.operators.segment_text import segment_text


#: How each format is segmented: from documents, the text column and protected terms to ``host``, ``segments`` and ``nodes``.
#: A further format is one more entry.
FORMATS: dict[str, Callable[[DataFrame, str, Sequence[str]], DataFrame]] = {"markdown": segment_markdown, "text": segment_text}


def segmented(docs: DataFrame, dnt: Sequence[str] = (), text: str = "text", formats: Mapping[str, Callable[[DataFrame, str, Sequence[str]], DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, nodes) of documents with doc_id, lang, tone, format and text."""
    keys = ("doc_id", "lang", "tone")
    parts = [segment(docs.where(F.col("format") == name), text, dnt).select(*keys, "host", "segments", "nodes") for name, segment in (formats or FORMATS).items()]
    every = reduce(DataFrame.unionByName, parts)
    segments = segments_of(every, *keys, "host").withColumns({"context": F.col("kind"), "variant": F.lit(None).cast("string"), "slots": masking.tag_slots(F.col("originals"))})
    return segments, nodes_of(every, "doc_id", "lang")


def segment_key(tone: str = "tone"):
    """A segment's key as one string."""
    return F.to_json(F.struct("hash", "context", F.lit(SEGMENTATION_VERSION).alias("version"), "variant", key_tone(F.col(tone)).alias("tone")))


def reused(segments: DataFrame, lang: str, prior: DataFrame | None = None, memory: DataFrame | None = None, operations: Sequence[str] = (), dnt: Sequence[str] = (), keep_key: bool = False) -> DataFrame:
    """Segments with target, origin, review and ``outcome``, and with ``keep_key`` the key that a later state is aligned by.

    Wording carried over from ``prior`` comes first, then the memory's. What the acceptance gate lets
    through first is taken (``carried`` or ``memory``); if nothing is, carried wording is ``kept``
    with the slots it was written against; else the segment is ``pending``.
    """
    empty = F.lit(None).cast("string")
    df = segments.withColumn("key", segment_key())
    if prior is not None:
        placed = carry_over(prior, df).select("doc_id", "lang", "id", "from_pos", "ambiguous")
        old = prior.select("doc_id", "lang", F.col("pos").alias("from_pos"), F.struct("target", "origin", "review", "slots").alias("_was"))
        df = df.join(placed, ["doc_id", "lang", "id"], "left").join(old, ["doc_id", "lang", "from_pos"], "left")
    else:
        df = df.withColumns({"ambiguous": F.lit(False), "_was": F.lit(None).cast(f"struct<target: string, origin: string, review: string, slots: {masking.SLOTS.simpleString()}>")})
    if memory is not None:
        df = lookup(df, memory)
        ids = masking.placeholder_ids(F.coalesce("hit", F.lit("")))
        guards = F.exists(ids, lambda i: F.coalesce(F.try_element_at("slots", i).original.isin(*dnt), F.lit(False))) if dnt else F.lit(False)
        df = df.withColumn("hit", F.when(F.col("hit_slots").isNotNull() | ~guards, F.col("hit")))
    else:
        df = df.withColumns({"hit": empty, "hit_slots": F.lit(None).cast("array<string>"), "hit_origin": empty})
    own = F.col("slots")
    df = df.withColumn("_a", accepted(F.col("masked"), own, F.col("_was.target"), lang, operations, F.coalesce("_was.slots", own)))
    df = df.withColumn("_b", accepted(F.col("masked"), own, F.col("hit"), lang, operations, F.coalesce(masking.plain_slots(F.col("hit_slots")), own)))
    a, b, old = F.col("_a.text"), F.col("_b.text"), F.col("_was.target")
    outcome = F.when(a.isNotNull(), "carried").when(b.isNotNull(), "memory").when(old.isNotNull(), "kept").otherwise("pending")
    review = F.when(outcome.isin("carried", "kept") & ~F.coalesce("ambiguous", F.lit(False)), F.col("_was.review"))
    return df.withColumns(
        {
            "target": F.coalesce(a, b, old),
            "origin": F.when(outcome.isin("carried", "kept"), F.coalesce("_was.origin", F.lit("carryover"))).when(outcome == "memory", F.col("hit_origin")),
            "review": review,
            "target_slots": F.when((outcome == "kept") & (F.to_json("_was.slots") != F.to_json("slots")), F.col("_was.slots")),
            "outcome": outcome,
        }
    ).drop("_a", "_b", "_was", "from_pos", "hit", "hit_slots", "hit_origin", *(() if keep_key else ("key",)))
