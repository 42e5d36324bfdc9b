"""Text columns with the white space, blank and letter rules that the engine shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireline.functions.values import NAME_LETTER, SEGMENTATION_VERSION, TRANSLATABLE, WHITE

OPEN, CLOSE = "⟦", "⟧"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space, separators U+001C to U+001F included.

    Only a text that begins or ends with white space is searched as a whole.
    """

    def body(x: Column) -> Column:
        edges = F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
        return F.when(~edges.rlike(f"[{WHITE}]"), x).otherwise(F.regexp_replace(x, rf"^[{WHITE}]+|(?<![{WHITE}])[{WHITE}]+\z", ""))

    return let(c, body)


def leading_white(c: Column) -> Column:
    return let(c, lambda x: F.when(~F.substring(x, 1, 1).rlike(f"[{WHITE}]"), "").otherwise(F.regexp_extract(x, rf"^[{WHITE}]*", 0)))


def trailing_white(c: Column) -> Column:
    return let(c, lambda x: F.when(~F.substring(x, -1, 1).rlike(f"[{WHITE}]"), "").otherwise(F.regexp_extract(x, rf"(?<![{WHITE}])[{WHITE}]*\z", 0)))


def is_blank(c: Column) -> Column:
    """True for white space only, and for the empty string."""
    return let(c, lambda x: F.when(F.substring(x, 1, 1).rlike(f"[^{WHITE}]"), False).otherwise(~x.rlike(f"[^{WHITE}]")))


def has_translatable_text(c: Column) -> Column:
    """True if a Latin letter or a CJK ideograph occurs."""
    return c.rlike(TRANSLATABLE)


def lines(c: Column) -> Column:
    """The lines of a text, split at LF only; a final LF ends the last line and begins none."""
    return F.split(let(c, lambda x: F.when(~x.endswith("\n"), x).otherwise(F.regexp_replace(x, r"\n\z", ""))), "\n", -1)


def segment_hash(c: Column) -> Column:
    """Twelve hexadecimal digits of SHA-1."""
    return F.substring(F.sha1(c.cast("binary")), 1, 12)


def target_token(c: Column) -> Column:
    """The token of a stored wording; none and the empty one have the same."""
    return segment_hash(F.coalesce(c, F.lit("")))


def key_tone(c: Column) -> Column:
    """The register as it stands in keys: null for none and for the default one."""
    return F.nullif(F.nullif(F.lower(strip(c)), F.lit("")), F.lit("technical"))


def memory_key(digest: Column, context: Column, variant: Column, tone: Column, version: Column | int = SEGMENTATION_VERSION) -> Column:
    """The key under which wording is remembered; nulls are values here, so compare with ``eqNullSafe``."""
    number = F.lit(version) if isinstance(version, int) else F.coalesce(version, F.lit(0))
    return F.struct(digest.alias("hash"), context.alias("context"), number.cast("int").alias("version"), variant.alias("variant"), key_tone(tone).alias("tone"))


def document_id(label: Column) -> Column:
    """A path as an id: every character but ASCII letters, digits, dot, low line and hyphen becomes a low line."""
    return F.regexp_replace(F.replace(label, F.lit("\\"), F.lit("/")), "[^A-Za-z0-9._-]", "_")


def one_line(c: Column) -> Column:
    """Backslash, CR, LF and tab as escapes."""
    for plain, shown in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(shown))
    return c


def progress_bar(done: Column, total: Column, cells: int = 20) -> Column:
    """An integer percentage and a bar of that many cells."""
    share = F.when(total > 0, F.floor(done * 100 / total)).otherwise(0).cast("int")
    filled = F.when(total > 0, F.floor(done * cells / total)).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(cells) - filled), F.format_string(" %3d%%", share))


def mentions(text: Column, term: Column) -> Column:
    """True if a lower-cased text has a lower-cased term that no Latin letter touches."""
    quoted = F.concat(F.lit(rf"(?<![{NAME_LETTER}])\Q"), F.replace(F.lower(term), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(rf"\E(?![{NAME_LETTER}])"))
    return F.regexp_like(F.lower(text), quoted)


def terminator(text: Column) -> Column:
    """A document's line end: CR LF if it has no other, else LF."""
    pure = text.contains("\r\n") & ~text.rlike(r"(?<!\r)\n") & ~text.rlike(r"\r(?!\n)")
    return F.when(pure, "\r\n").otherwise("\n")


def without_terminator(text: Column) -> Column:
    """The text with LF for its line end, where that was CR LF throughout."""
    return F.when(terminator(text) == "\r\n", F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)


def with_terminator(text: Column, eol: Column) -> Column:
    """The text with its document's line end put back."""
    return F.when(eol == "\n", text).otherwise(F.regexp_replace(text, F.lit(r"\r?\n"), eol))


def with_terminator_parts(parts: Column, eol: Column) -> Column:
    """``with_terminator`` of an array of parts, so that the joined result is that of the joined parts.

    Where a CR LF is split between two parts, the CR moves to the part that has the LF.
    """

    def body(p: Column) -> Column:
        def rest(k: Column) -> Column:  # what follows part k, without empty parts
            return F.coalesce(F.try_element_at(F.filter(F.slice(p, k + 2, F.size(p)), lambda x: x != ""), F.lit(1)), F.lit(""))

        def before(k: Column) -> Column:
            return F.coalesce(F.try_element_at(F.filter(F.slice(p, F.lit(1), k), lambda x: x != ""), F.lit(-1)), F.lit(""))

        def moved(x: Column, k: Column) -> Column:
            lead = F.when(before(k).endswith("\r") & x.startswith("\n"), F.lit("\r")).otherwise("")
            gone = x.endswith("\r") & rest(k).startswith("\n")
            return F.concat(lead, F.when(gone, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))

        return F.transform(p, lambda x, k: with_terminator(moved(x, k), eol))

    return F.when(eol == "\n", parts).otherwise(let(parts, body))

