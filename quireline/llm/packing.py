"""Packing by concatenate and cut.

All documents' tokens, each followed by an end id, stand in one long row that is cut into windows of
fixed length. The first pass encodes texts and counts inside each partition; prefix sums over the
partitions' totals give every document its global offset; the second pass cuts documents where
windows end. A document that runs over a window's end, or a window over a partition's, leaves one
piece record on either side. Only the very last window has padding.

Defined results: a null or empty text is its end id alone; the string of a special token in a text is
that token's id, as ``tokenizers`` has it (``add_special_tokens=False`` only adds none); a text of any
length is cut into as many pieces as it needs; a null doc_id is kept; repeated rows are packed once
each; other columns are dropped first, so their names clash with nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireline.llm.scratch import cut, small

WINDOW, END = 1024, 0
#: Rows that are handled together, and rows of the partitions' table up to which it is broadcast (16 bytes a row).
TOGETHER, MAX_BROADCAST = 256, 1_000_000
#: Texts with other characters than these (Latin letters and common punctuation, which all Unicode versions treat alike) go through ``tokenizers``.
RARE = r"[^\x00-ɏ‐-‧€]"


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class VocabularyTokenizer:
    """Ids of whole texts as ``tokenizers`` gives them for a byte-level BPE vocabulary file.

    Where every token of the vocabulary, merged from its bytes, gives itself (tests hold the file to
    that), merging by listed pairs and merging by ranks are the same: two adjacent tokens whose bytes
    make a token are then always its listed pair, or merging that token's own bytes would have
    stopped at them. So texts go through the faster rank merger, under the file's own ids; only texts
    with rare characters, where Unicode versions may split differently, and texts that hold the string
    of an added token, which ``tokenizers`` gives that token's id, go through ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str, pattern: str):
        import json

        import tiktoken

        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as file:
            described = json.load(file)
        special = {t["content"] for t in described["added_tokens"]}
        self.added = sorted(special)
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        self.merger = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.dtype = "<u2" if max(described["model"]["vocab"].values()) < 1 << 16 else "<u4"
        self.rare = re.compile(RARE).search

    @cached_property
    def tokenizer(self):
        """The file as ``tokenizers`` reads it, loaded when a text needs it."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian, in ``dtype``."""
        if (not text.isascii() and self.rare(text)) or any(a in text for a in self.added):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        else:
            ids = self.merger.encode_to_numpy(text, disallowed_special=())
        return ids.astype(self.dtype).tobytes()


def pack(docs: DataFrame, vocabulary: str, pattern: str, window: int = WINDOW, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.spark_partition_id().alias("_part"))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, at = VocabularyTokenizer(vocabulary, pattern), 0
        last = np.array([end], dtype=tokenizer.dtype).tobytes()
        for whole in batches:
            for few in range(0, whole.num_rows, TOGETHER):
                rows = whole.slice(few, TOGETHER)
                ids = [tokenizer.encode(t or "") + last for t in rows.column("_text").to_pylist()]
                n = np.array([len(x) // len(last) for x in ids], dtype=np.int64)
                first = at + np.cumsum(n) - n
                at += int(n.sum())
                width = np.full(len(n), len(last), dtype=np.int32)
                made = [rows.column("doc_id"), rows.column("_part"), pa.array(first), pa.array(n), pa.array(width), pa.array(ids, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "_part", "_first", "_n", "_width", "_ids"])

    tokens = cut(picked.mapInArrow(counted, f"doc_id {kind}, _part int, _first long, _n long, _width int, _ids binary"), "tokens")
    totals = tokens.groupBy("_part").agg(F.sum("_n").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = cut(totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")), "bases")
    placed = tokens.join(small(bases, MAX_BROADCAST), "_part").select("doc_id", (F.col("_base") + F.col("_first")).alias("_at"), "_n", "_width", "_ids")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for few in range(0, whole.num_rows, TOGETHER):
                part = whole.slice(few, TOGETHER)
                rows = []
                for k, row in enumerate(part.select(["_at", "_n", "_width", "_ids"]).to_pylist()):
                    at, n, a = row["_at"], row["_n"], 0
                    values = np.frombuffer(row["_ids"], dtype=f"<u{row['_width']}").astype("<u4")
                    while a < n:
                        sequence, offset = divmod(at + a, window)
                        b = min(n, a + window - offset)
                        rows.append((k, a, b - a, zlib.crc32(values[a:b].tobytes()), n, sequence, offset))
                        a = b
                columns = np.array(rows, dtype=np.int64).reshape(-1, 7).T
                made = [part.column("doc_id").take(pa.array(columns[0])), *map(pa.array, columns[1:])]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(sliced, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
