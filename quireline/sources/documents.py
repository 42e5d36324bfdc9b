"""Documents from files: bytes, encodings, line ends and formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.functions.text import document_id, terminator, without_terminator
from quireline.functions.values import BOMS, EXTENSIONS, TEXT_ENCODINGS


def implausible(text: Column) -> Column:
    """True if most characters beyond ASCII are half-width katakana or C1 controls: a wrong guess of the encoding."""
    return 2 * F.length(F.regexp_replace(text, r"[^\x{FF61}-\x{FF9F}\x{80}-\x{9F}]+", "")) > F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))


def _plausible(text: str) -> bool:
    beyond = [c for c in text if c > "\x7f"]
    return 2 * sum("｡" <= c <= "ﾟ" or "\x80" <= c <= "\x9f" for c in beyond) <= len(beyond)


def decode(data: bytes, encodings: Sequence[str] = ("utf-8",)) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, None), or (None, None, why).

    A byte-order mark decides. Else the first encoding counts that decodes strictly, without NUL, to
    plausible text; if all that decode are implausible, the first of them.
    """
    marked = next((encoding for mark, encoding in BOMS if data.startswith(mark)), None)
    good, tried = [], []
    for encoding in (marked,) if marked else tuple(encodings) or ("utf-8",):
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError as error:
            tried.append(f"{encoding}: invalid byte at {error.start}")
        except LookupError:
            tried.append(f"{encoding}: unknown")
        else:
            if "\0" in text:
                tried.append(f"{encoding}: NUL")
            else:
                good.append((text, encoding))
    best = next((x for x in good if _plausible(x[0])), good[0] if good else None)
    return (*best, None) if best else (None, None, "; ".join(tried))


def decoded(content: Column, encodings: Sequence[str] = ("utf-8",)) -> Column:
    """struct<text, encoding, error> of bytes; plain UTF-8 is decoded in the JVM where it comes first."""
    names = tuple(encodings)

    def rows(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if v is None else decode(bytes(v), names) for v in values], columns=["text", "encoding", "error"], dtype=object)

    slow = F.pandas_udf(rows, "text string, encoding string, error string")
    if names[:1] != ("utf-8",):
        return slow(content)
    valid = F.try_validate_utf8(content.cast("string"))
    head = F.hex(F.substring(content, F.lit(1), F.lit(4)))
    other = F.lit(False)
    for mark, encoding in BOMS:
        if encoding != "utf-8":
            other = other | head.startswith(mark.hex().upper())
    fast = valid.isNotNull() & ~other & ~F.contains(valid, F.lit("\0")) & ~implausible(valid)
    rest = slow(F.when(~F.coalesce(fast, F.lit(False)), content))
    return F.when(fast, F.struct(valid.alias("text"), F.lit("utf-8").alias("encoding"), F.lit(None).cast("string").alias("error"))).otherwise(rest)


def format_of(path: Column, extensions: Mapping[str, str] | None = None) -> Column:
    """The format of a path by its extension, null for unknown ones; ``extensions`` adds to the known or wins over them."""
    table = EXTENSIONS | {("." + k.strip().lower().lstrip(".")): v for k, v in (extensions or {}).items()}
    found = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)\z", 1))
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[found]


def read_documents(spark: SparkSession, path: str, pattern: str | None = None, extensions: Mapping[str, str] | None = None, encodings: Mapping[str, Sequence[str]] | None = None, root: str = "") -> DataFrame:
    """doc_id, source, format, encoding, eol, text and error of each file; line ends are LF inside ``text``.

    Files of no known format, and bytes that no encoding fits, have an ``error`` and no text.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lists = {"markdown": ("utf-8",), "text": TEXT_ENCODINGS} | dict(encodings or {})
    label = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), "^" + (r"\Q" + root.rstrip("/") + r"\E/" if root else r"\z"), "")
    df = reader.load(path).select(label.alias("source"), "content").withColumn("format", format_of(F.col("source"), extensions))
    results = F.lit(None).cast("struct<text: string, encoding: string, error: string>")
    for name, names in lists.items():
        results = F.when(F.col("format") == name, decoded(F.when(F.col("format") == name, F.col("content")), names)).otherwise(results)
    df = df.withColumn("_d", results).select(
        document_id(F.col("source")).alias("doc_id"), "source", "format", F.col("_d.encoding").alias("encoding"), F.col("_d.text").alias("_text"),
        F.when(F.col("format").isNull(), "unknown format").otherwise(F.col("_d.error")).alias("error"),
    )
    return df.select("doc_id", "source", "format", "encoding", terminator(F.col("_text")).alias("eol"), without_terminator(F.col("_text")).alias("text"), "error")
