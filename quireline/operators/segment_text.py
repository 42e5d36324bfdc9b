"""Segmentation of plain text, in native expressions inside each document's row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.functions.text import is_blank, leading_white, let, lines, strip
from quireline.functions.values import CHAPTERS, WHITE
from quireline.operators.assembly import assembled

MODES = ("line", "blank-line", "indent")


def filled_lines(text: Column) -> Column:
    """array<struct<pos, line>> of the lines that are not blank, positions from 1."""
    numbered = F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("pos"), x.alias("line")))
    return F.filter(numbered, lambda x: ~is_blank(x.line))


def paragraph_mode(text: Column) -> Column:
    """``blank-line`` if a blank line lies between two filled ones, else ``line``."""
    inner = strip(F.when(~text.startswith("\ufeff"), text).otherwise(F.regexp_replace(text, r"^\x{FEFF}+", "")))  # begins and ends inside filled lines
    return F.when(inner.rlike(rf"\n[{WHITE}&&[^\n]]*\n"), "blank-line").otherwise("line")


def is_chapter(source: Column, patterns: Sequence[str] = CHAPTERS) -> Column:
    """True for a line that begins like a chapter heading."""
    anchored = [p[:-1] + r"\z" if p.endswith("$") else p for p in patterns]
    return strip(source).rlike("(?iud)^(?:" + "|".join(f"(?:{p})" for p in anchored) + ")") if anchored else F.lit(False)


def text_pieces(text: Column, mode: Column, chapters: Sequence[str] = CHAPTERS) -> Column:
    """The pieces of a plain text: blocks of lines, and what stands between them."""
    mark = F.regexp_extract(text, r"^\x{FEFF}*", 0)
    whole = let(mark, lambda m: F.struct(m.alias("bom"), F.substring(text, F.length(m) + 1, F.length(text)).alias("body")))
    return F.when(text == "", F.array(_piece(None, text))).otherwise(let(whole, lambda w: _cut(w.bom, let(w.body, lambda b: F.struct(lines(b).alias("rows"), b.endswith("\n").alias("ended"), mode.alias("mode"))), chapters)))


def _cut(bom: Column, parts: Column, chapters: Sequence[str]) -> Column:
    """The pieces of a text's rows; ``parts``: struct<rows, ended, mode>, bound so that no loop computes them again."""

    def cut(given: Column) -> Column:
        rows, ended_by_lf, mode = given.rows, given.ended, given.mode
        n = F.size(rows)
        line = lambda i: F.element_at(rows, i)
        before = lambda i: F.element_at(rows, F.greatest(i - 1, F.lit(1)))
        opens = lambda i: ~is_blank(line(i)) & ((mode == "line") | (i == 1) | is_blank(before(i)) | ((mode == "indent") & line(i).rlike(f"^[{WHITE}]")))
        starts = F.filter(F.sequence(F.lit(1), n), opens)

        def blocks(at: Column) -> Column:
            count = F.size(at)

            def block(i: Column, j: Column) -> Column:
                following = F.when(j + 1 < count, F.element_at(at, F.least(j + 2, count))).otherwise(n + 1)
                own = F.slice(rows, i, following - i)
                # What the lines are, then what the block is made of: each is computed once.
                parts = let(own, lambda o: F.struct(o.alias("own"), F.size(F.filter(o, lambda x: ~is_blank(x))).alias("filled"), leading_white(F.element_at(o, 1)).alias("indent"), (following > n).alias("last")))
                return let(parts, pieces_of)

            def pieces_of(p: Column) -> Column:
                gap = F.slice(p.own, p.filled + 1, F.greatest(F.size(p.own) - p.filled, F.lit(0)))
                whole = F.when(F.size(p.own) == 1, F.element_at(p.own, 1)).otherwise(F.array_join(F.slice(p.own, F.lit(1), p.filled), "\n"))
                ended = F.concat(F.lit("\n"), F.array_join(F.transform(gap, lambda x: F.concat(x, F.lit("\n"))), ""))
                ended = F.when(p.last & ~ended_by_lf, F.substring(ended, F.lit(1), F.length(ended) - 1)).otherwise(ended)
                source = F.when(p.indent == "", whole).otherwise(F.substring(whole, F.length(p.indent) + 1, F.length(whole)))
                return let(source, lambda x: F.array(_piece(None, p.indent), _piece(F.when((p.filled == 1) & is_chapter(x, chapters), "heading").otherwise("para"), x), _piece(None, ended)))

            head = F.slice(rows, F.lit(1), F.when(count > 0, F.element_at(at, F.lit(1)) - 1).otherwise(n))
            opening = F.array_join(F.transform(head, lambda x: F.concat(x, F.lit("\n"))), "")
            opening = F.when((count == 0) & ~ended_by_lf, F.substring(opening, F.lit(1), F.length(opening) - 1)).otherwise(opening)
            return F.concat(F.array(_piece(None, F.concat(bom, opening))), F.flatten(F.transform(at, block)))

        return let(starts, blocks)

    return let(parts, cut)


def _piece(kind: Column | None, text: Column) -> Column:
    return F.struct((F.lit(None) if kind is None else kind).cast("string").alias("kind"), text.alias("text"))


def segment_text(docs: DataFrame, text: str = "text", dnt: Sequence[str] = (), mode: str = "auto", chapters: Sequence[str] = CHAPTERS) -> DataFrame:
    """``docs`` with ``paragraph_mode``, ``host``, ``segments`` and ``nodes`` of each plain text."""
    chosen = F.lit(mode) if mode in MODES else paragraph_mode(F.col(text))
    df = docs.withColumn("paragraph_mode", chosen)
    df = df.withColumn("host", F.when(F.col("paragraph_mode") == "line", "text-line").otherwise("text"))
    return assembled(df.withColumn("pieces", text_pieces(F.coalesce(F.col(text), F.lit("")), F.col("paragraph_mode"), chapters)), dnt)
