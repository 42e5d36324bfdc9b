"""Work lists for people and agents: pending segments with terminology and style notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.functions.sentences import sentences
from quireline.functions.values import ABBREVIATIONS, MARKERS
from quireline.operators import rendering, reports
from quireline.operators.checks import Rules, check_segments
from quireline.operators.context import glossary_hints, style_notes
from quireline.operators.selection import select


def todo(segments: DataFrame, glossary: Sequence[dict] = (), style: Sequence[dict] = (), include_all: bool = False, limit: int = 0, document: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One JSON item for each pending segment: id, kind, text and the glossary rows and style notes that it mentions."""
    chosen = select(segments, "draft", include_all=include_all, limit=limit, over_human=True, document=document)
    text = F.col("masked")
    hints, notes = glossary_hints(text, glossary), style_notes(text, style)
    item = F.struct("id", "kind", text.alias("text"), F.when(F.size(hints) > 0, hints).alias("glossary"), F.when(F.size(notes) > 0, notes).alias("voice_notes"))
    return chosen.select(*document, "pos", F.to_json(item, {"ignoreNullFields": "true"}).alias("item"))


def sentence_list(segments: DataFrame, of: str = "target", abbreviations: Sequence[str] = ABBREVIATIONS) -> DataFrame:
    """doc_id, lang, id, n (from 1) and sentence of each segment's wording or, ``of="source"``, masked source; segments without that text have none."""
    if of not in ("target", "source"):
        raise ValueError(f"sentences are of target or source, not {of!r}")
    text = F.col("target" if of == "target" else "masked")
    cut = segments.select("doc_id", "lang", "id", F.posexplode(sentences(text, abbreviations)).alias("n", "sentence"))
    return cut.withColumn("n", F.col("n") + 1)


def checked(segments: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(reports, issues): one row for each document, and one for each issue."""
    found = check_segments(segments, rules)
    issues = found.select("doc_id", "lang", F.col("id").alias("seg"), F.inline("issues"))
    return reports.check_reports(found), issues


def rendered(documents: DataFrame, nodes: DataFrame, segments: DataFrame, pattern: str = "i18n/{lang}/{path}", fallback: bool = False) -> DataFrame:
    """doc_id, lang, path, text and missing of each stored document, with its own marker and line end."""
    facts = documents.select("doc_id", "lang", "source", "eol", "format")
    out = None
    for name, marker in MARKERS.items():
        own = facts.where(F.col("format") == name).select("doc_id", "lang", "eol")
        blocks = rendering.render_blocks(nodes.join(own.drop("eol"), ["doc_id", "lang"], "left_semi"), segments, fallback, marker)
        texts = rendering.render(blocks.join(own, ["doc_id", "lang"]), F.col("eol"))
        out = texts if out is None else out.unionByName(texts)
    path = rendering.output_path(pattern, F.col("lang"), F.col("source"))
    return out.join(facts, ["doc_id", "lang"]).select("doc_id", "lang", path.alias("path"), "text", "missing")
