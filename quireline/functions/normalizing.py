"""Normalization of wording: punctuation and spacing of Chinese, and outer blanks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireline.functions import masking
from quireline.functions.text import is_blank, leading_white, let, strip, trailing_white
from quireline.functions.values import CJK, FULLWIDTH, HALF_TO_FULL, WHITE

_INSIDE = rf"(?<=[^{WHITE}]|\r)"


def _widening(half: str, full: str) -> Callable[[Column], Column]:
    pattern = rf"\Q{half}\E(?<=[{CJK}]\Q{half}\E)(?=[{WHITE}]|\z|[{CJK}])"
    return lambda c: F.when(c.contains(half), F.regexp_replace(c, pattern, full)).otherwise(c)


def full_width(c: Column) -> Column:
    """Half-width marks after CJK in full width, full-width parentheses around CJK, no blanks at full-width marks.

    Each pattern begins with the mark or blank itself and looks behind it only then, not at every character.
    """
    for half, full in HALF_TO_FULL:
        c = let(c, _widening(half, full))
    c = F.regexp_replace(c, rf"\.(?<=[{CJK}]\.)(?=[{WHITE}]*\z|[{CJK}])", "。")
    c = F.regexp_replace(c, rf"\(([^(){CJK}]*+[{CJK}][^()]*+)\)", "（$1）")
    c = F.regexp_replace(c, rf"[ \t](?<=(?:[^{WHITE}]|\r)[ \t])[ \t]*(?=[{FULLWIDTH}])", "")
    return F.regexp_replace(c, rf"[ \t](?<=[{FULLWIDTH}][ \t])[ \t]*(?![ \t]*\r?\n)", "")


def spaced(c: Column) -> Column:
    """A space where CJK and Latin letters or digits meet."""
    c = F.regexp_replace(c, rf"(?<=[{CJK}])(?=[A-Za-z0-9$])", " ")
    return F.regexp_replace(c, rf"(?<=[A-Za-z0-9%$)])(?=[{CJK}])", " ")


def collapsed(c: Column) -> Column:
    """Blanks at a line's end gone (two stay as a hard break), inner runs as one space; indents stay."""
    c = F.regexp_replace(c, r"(?:(?<=[\r\n])|(?<![\s\S]))[ \t]+(?=\r?\n)", "")
    c = F.regexp_replace(c, r"(?<=[^\r\n \t])[ \t]*  (?=\r?\n)", "  ")
    c = F.regexp_replace(c, r"(?<=[^\r\n \t])(?:[ \t]*\t| )(?=\r?\n)", "")
    c = F.regexp_replace(c, rf"{_INSIDE}[ \t]{{2,}}(?![ \t]*\r?\n)", " ")
    return F.regexp_replace(c, r"[ \t]+\z", "")


OPERATIONS = {"punct": full_width, "pangu": spaced, "collapse_space": collapsed}


def normalized(c: Column, lang: str, operations: Sequence[str]) -> Column:
    """The operations in their fixed order, for Chinese only."""
    if lang.lower().startswith("zh"):
        for name, operation in OPERATIONS.items():
            if name in operations:
                c = operation(c)
    return c


def outer_blanks(source: Column, text: Column, keep_added_indent: bool = False) -> Column:
    """The text in the white space that surrounds its source; blank ones stay as they are."""
    lead = leading_white(source)
    if keep_added_indent:
        lead = F.when(lead == "", leading_white(text)).otherwise(lead)
    return F.when(is_blank(text) | is_blank(source), text).otherwise(F.concat(lead, strip(text), trailing_white(source)))


def polished(c: Column, lang: str, operations: Sequence[str]) -> Column:
    """Spacing of rendered text, with its code, links and tags out of reach."""
    if "pangu" not in operations or not lang.lower().startswith("zh"):
        return c
    return let(masking.masked(c), lambda m: masking.unmasked(spaced(m.text), m.originals))


def accepted(segment_masked: Column, segment_slots: Column, text: Column, lang: str, operations: Sequence[str], written_slots: Column | None = None) -> Column:
    """struct<text, why>: wording fit to be stored for a segment, or the reason it is not.

    Placeholders are repaired; wording written against other slots is re-seated; then the ids must be
    the segment's own, and the rest is normalized and gets the source's outer blanks.
    """
    cleaned = strip(masking.repaired(text))
    if written_slots is None:
        seated = F.struct(cleaned.alias("text"), F.lit(None).cast("string").alias("why"))
    else:
        now = F.coalesce(F.to_json(segment_slots), F.lit(""))
        moved = F.coalesce(F.to_json(written_slots), now) != now
        again = masking.reseated(F.when(moved, cleaned), written_slots, segment_slots)
        seated = F.when(moved, F.struct(again.text.alias("text"), again.why.alias("why"))).otherwise(F.struct(cleaned.alias("text"), F.lit(None).cast("string").alias("why")))

    def judged(s: Column) -> Column:
        want, got = F.array_sort(masking.placeholder_ids(segment_masked)), F.array_sort(masking.placeholder_ids(s.text))
        mismatch = F.concat(F.lit("placeholders differ: expected ["), F.array_join(want, ", "), F.lit("], got ["), F.array_join(got, ", "), F.lit("]"))
        good = outer_blanks(segment_masked, normalized(s.text, lang, operations))
        why = F.when(s.why.isNotNull(), s.why).when(want != got, mismatch).when(s.text == "", "empty translation")
        return F.struct(F.when(why.isNull(), good).alias("text"), why.alias("why"))

    return let(seated, judged)
