"""Candidate terms of an English source: runs of capitalized words that stand inside sentences too."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireline.functions.values import ABBREVIATIONS, NAME_LETTER, STOPWORDS

PARTS = 64
_WORD = re.compile(rf"[{NAME_LETTER}]+(?:['’-][{NAME_LETTER}]+)*")
_POSSESSIVE = re.compile(r"['’][Ss]\Z")
_ENDS = frozenset(".!?…")
_QUOTES = frozenset("\"“‘«'’")
_SPEECH_END = re.compile(r"[!?…]+[\"”’'»]")


def _begins_sentence(gap: str, before: str, abbreviations: frozenset[str]) -> bool:
    """True if the word after a gap begins a sentence; ``before``: the word ahead of the gap."""
    if gap[-1:] in _QUOTES and gap:
        return True
    speech = _SPEECH_END.match(gap)
    if speech:
        gap = gap[speech.end() :]
    elif before in abbreviations:
        gap = gap.removeprefix(".")
    return not _ENDS.isdisjoint(gap)


def runs(text: str, abbreviations: frozenset[str]) -> Iterator[tuple[list[str], bool]]:
    """Runs of capitalized words joined by one space, each with whether it begins a sentence."""
    run: list[str] = []
    first = False
    end, before = 0, None
    for m in _WORD.finditer(text):
        gap = text[end : m.start()]
        capital = m[0][0].isupper()
        if run and capital and gap == " ":
            run.append(m[0])
        else:
            if run:
                yield run, first
            run, first = [], False
            if capital:
                run, first = [m[0]], before is None or _begins_sentence(gap, before, abbreviations)
        end, before = m.end(), m[0]
    if run:
        yield run, first


def sightings(text: str, abbreviations: frozenset[str], stopwords: frozenset[str]) -> Iterator[tuple[str, bool]]:
    """(term, inside a sentence); a run that begins a sentence is seen without its first word as well."""
    for run, first in runs(text, abbreviations):
        for words, inside in ((run, not first), *([(run[1:], True)] if first and len(run) > 1 else [])):
            term = " ".join([*words[:-1], _POSSESSIVE.sub("", words[-1])])
            if len(term) > 1 and term not in stopwords and term not in abbreviations:
                yield term, inside


def candidate_terms(segments: DataFrame, min_count: int = 2, abbreviations: Sequence[str] = ABBREVIATIONS, stopwords: Sequence[str] = STOPWORDS, keys: Sequence[str] = ("doc_id",), text: str = "masked") -> DataFrame:
    """keys, source, count, mid_sentence and examples (the first three segments with it inside a sentence).

    Sightings are counted per segment before the shuffle. A term that is everywhere is ranked in
    ``PARTS`` parts, whose first three examples each then meet.
    """
    known, stops = frozenset(abbreviations), frozenset(stopwords)

    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"source": s, "inside": i} for s, i in sightings(t or "", known, stops)] for t in texts], dtype=object)

    seen = segments.select(*keys, "pos", "id", F.inline(F.pandas_udf(rows, "array<struct<source: string, inside: boolean>>")(F.col(text))))
    each = seen.groupBy(*keys, "source", "pos", "id").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("mid"))
    parts = [*keys, "source", "_part"]
    each = each.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    place = F.row_number().over(Window.partitionBy(*parts).orderBy((F.col("mid") == 0).cast("int"), "pos"))
    example = F.collect_list(F.when((F.col("_place") <= 3) & (F.col("mid") > 0), F.struct("pos", "id")))
    inside = each.withColumn("_place", place).groupBy(*parts).agg(F.sum("n").alias("n"), F.sum("mid").alias("mid"), example.alias("ex"))
    first = F.slice(F.array_sort(F.flatten(F.collect_list("ex"))), 1, 3)
    out = inside.groupBy(*keys, "source").agg(F.sum("n").alias("count"), F.sum("mid").alias("mid_sentence"), F.transform(first, lambda x: x.id).alias("examples"))
    return out.where((F.col("count") >= min_count) & (F.col("mid_sentence") > 0))


def unknown_terms(terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """Terms that no glossary row has, compared in lower case."""
    held = glossary.select(F.lower("source").alias("_low")).distinct()
    return terms.withColumn("_low", F.lower("source")).join(held, "_low", "left_anti").drop("_low")


def ranked(terms: DataFrame) -> DataFrame:
    """Terms by count, the most frequent first, then by their text."""
    return terms.orderBy(F.desc("count"), "source")
