"""Sentence splitting that partitions a text exactly, with placeholders as atoms."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column

from quireline.functions.arrow import by_row
from quireline.functions.values import ABBREVIATIONS, CANNOT_START, CLOSERS, IN_WORD, OPENING, STRONG, SYMMETRIC, WEAK

_ATOMS = r"(?:⟦\d+⟧)*"
_LETTER = r"[^\W\d_]"
_MARKS = re.compile(f"[{re.escape(STRONG + WEAK)}]+")
_CLOSING = re.compile(f"[{re.escape(CLOSERS)}]*")
_PAIRED = re.compile(f"[{re.escape(SYMMETRIC)}]+(?=\\s|\\Z)")
_AFTER_STOP = re.compile(f"[{re.escape(CLOSERS + SYMMETRIC)}]*{_ATOMS}(?=\\s|\\Z)")
_ATOM = re.compile(_ATOMS)
_WHITE = re.compile(r"\s*")
_WORD_CHAR = re.compile(f"{_LETTER}|[{re.escape(IN_WORD)}]")
_EDGE = IN_WORD


def _word_ending(text: str, at: int) -> str | None:
    """The word that ends right before a place, found by one walk back."""
    if at == 0 or not re.match(_LETTER, text[at - 1]):
        return None
    start = at
    while start and _WORD_CHAR.match(text[start - 1]):
        start -= 1
    return text[start:at].lstrip(_EDGE)


def _full_stop(text: str, at: int, abbreviations: frozenset[str]) -> bool:
    """True if a lone stop ends a sentence: before white space, after neither an abbreviation nor one capital."""
    if not _AFTER_STOP.match(text, at + 1):
        return False
    word = _word_ending(text, at)
    return word is None or word not in abbreviations and not (len(word) == 1 and word.isupper())


def _boundaries(text: str, abbreviations: frozenset[str]) -> Iterator[int]:
    for run in _MARKS.finditer(text):
        marks = run[0]
        strong = any(c in STRONG for c in marks)
        if marks == "." and not _full_stop(text, run.start(), abbreviations):
            continue
        end = _CLOSING.match(text, run.end()).end()
        quotes = _PAIRED.match(text, end)
        end = _ATOM.match(text, quotes.end() if quotes else end).end()
        ahead = _WHITE.match(text, end).end()
        if ahead < len(text):
            first = text[ahead]
            if first in CANNOT_START:
                continue
            if first.islower() if strong else not (first in OPENING or first.isupper()):
                continue
        yield ahead


def split(text: str, abbreviations: Sequence[str] = ABBREVIATIONS) -> list[str]:
    """The sentences of a text; joined they are the text."""
    cuts = [0]
    for at in _boundaries(text, frozenset(abbreviations)):
        if at > cuts[-1]:
            cuts.append(at)
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def sentences(text: Column, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    """array<string> of the sentences of each text."""
    known = tuple(abbreviations)

    return by_row(lambda t: split(t, known), "array<string>")(text)
