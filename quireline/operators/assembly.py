"""From pieces of a document to numbered segments and an untouched skeleton.

A document's pieces are array<struct<kind, text>>: kind is null for text that stays as it is. Pieces
that hold nothing to translate stay as well; the rest become segments ``s0001``, ``s0002`` and so on.
Everything is computed inside the document's row, so segmentation needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.functions import masking
from quireline.functions.text import let, segment_hash

PIECES = "array<struct<kind: string, text: string>>"


def _opened(piece: Column, dnt: Sequence[str]) -> Column:
    """A piece with its trailing CRs apart, masked where it has a kind, and ``keep``."""
    none = F.struct(F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("originals"))

    def stripped(source: Column) -> Column:
        mask = F.when(piece.kind.isNotNull(), masking.masked(source, dnt)).otherwise(none)
        return let(mask, lambda m: built(source, m))

    def built(source: Column, m: Column) -> Column:
        keep = piece.kind.isNotNull() & masking.worth_sending(source, m.text)
        return F.struct(
            piece.kind.alias("kind"),
            piece.text.alias("text"),
            source.alias("source"),
            F.when(~piece.text.endswith("\r"), "").otherwise(F.substring(piece.text, F.length(source) + 1, F.length(piece.text))).alias("cr"),
            m.text.alias("masked"),
            m.originals.alias("originals"),
            F.coalesce(keep, F.lit(False)).alias("keep"),
        )

    return let(F.when(piece.text.endswith("\r"), F.regexp_replace(piece.text, r"\r+\z", "")).otherwise(piece.text), stripped)


def _number(j: Column) -> Column:
    return F.concat(F.lit("s"), F.when(j < 10_000, F.lpad(j.cast("string"), 4, "0")).otherwise(j.cast("string")))


def assembled(docs: DataFrame, dnt: Sequence[str] = (), pieces: str = "pieces") -> DataFrame:
    """``docs`` with ``segments`` and ``nodes`` arrays in place of ``pieces``; all other columns stay."""

    def built(opened: Column) -> Column:
        n = F.size(opened)
        places = F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(opened, i).keep)).otherwise(F.array().cast("array<int>"))
        return F.struct(opened.alias("opened"), places.alias("kept"))

    # Steps are bound variables: Catalyst cannot copy the masking into a loop. Who reads only segments never has nodes built.
    opened = docs.withColumn("_opened", let(F.transform(pieces, lambda p: _opened(p, dnt)), built))
    both = {"segments": lambda x: _segments(x.opened, x.kept), "nodes": lambda x: _nodes(x.opened, x.kept)}
    return opened.withColumns({name: let(F.col("_opened"), body) for name, body in both.items()}).drop("_opened", pieces)


def _segments(opened: Column, kept: Column) -> Column:
    """The segments of opened pieces, given the places of those that are kept."""

    def segment(i: Column, j: Column) -> Column:
        return let(
            F.element_at(opened, i),
            lambda p: F.struct(_number(j + 1).alias("id"), (j + 1).alias("pos"), p.kind.alias("kind"), segment_hash(p.source).alias("hash"), p.source.alias("source"), p.masked.alias("masked"), p.originals.alias("originals")),
        )

    return F.transform(kept, segment)


def _nodes(opened: Column, kept: Column) -> Column:
    """The nodes of opened pieces, given the places of those that are kept."""
    n = F.size(opened)

    def between(first: Column, last: Column) -> Column:
        """The text of the pieces from first to last."""
        return F.array_join(F.transform(F.slice(opened, first, F.greatest(last - first + 1, F.lit(0))), lambda p: p.text), "")

    def gap(j: Column, last: Column) -> Column:
        """What stands before the kept piece at place j: the CRs of the one before it, and the pieces in between."""
        before = F.when(j > 0, F.element_at(kept, F.greatest(j, F.lit(1)))).otherwise(0)
        cr = F.when(before > 0, F.element_at(opened, F.greatest(before, F.lit(1))).cr).otherwise("")
        return F.concat(cr, between(before + 1, last))

    raw = lambda v: F.struct(F.lit("raw").alias("t"), v.alias("v"), F.lit(None).cast("string").alias("seg_id"))
    seg = lambda j: F.struct(F.lit("seg").alias("t"), F.lit(None).cast("string").alias("v"), _number(j + 1).alias("seg_id"))
    body = F.flatten(F.transform(kept, lambda i, j: F.array(raw(gap(j, i - 1)), seg(j))))
    return F.filter(F.concat(body, F.array(raw(gap(F.size(kept), n)))), lambda x: (x.t == "seg") | (x.v != ""))


def segments_of(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each segment, with the key columns of its document.

    The outer form keeps Catalyst from testing the array's size first, which would build it twice more.
    """
    return docs.select(*keys, F.inline_outer("segments")).where(F.col("id").isNotNull())


def nodes_of(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each node: keys, pos, t, v, seg_id."""
    rows = docs.select(*keys, F.posexplode_outer("nodes").alias("pos", "node")).where(F.col("node").isNotNull())
    return rows.select(*keys, (F.col("pos") + 1).alias("pos"), "node.*")
