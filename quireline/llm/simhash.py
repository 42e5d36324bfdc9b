"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A text's fingerprint has a bit set where over half of its 3-word shingles' XXH64 values have it.
Fingerprints that differ in at most two bits are linked, and links join documents into components.

Copies of one fingerprint count once. A fingerprint is cut into three segments of 22, 21 and 21
bits. Two errors over three segments leave, for one of the ordered pairs (1, 2), (2, 3), (3, 1), no
error in its first segment and at most one in its second: so a key is the first segment itself with
one of the Golay indices near the second, which two fingerprints within two bits always share.

Buckets of up to ``MAX_BUCKET`` fingerprints are verified pair by pair in one place. Fingerprints of
larger buckets are linked exactly without pairs: two differ in at most two bits if and only if some
word lies within one bit of both, so each is sent to itself and its 64 neighbours, and those that
meet at a word (65 at most) are linked. No link between different fingerprints is lost.

Defined results: a null, empty or blank text has fingerprint zero, which is linked like any other;
a text of any length counts whole; a null doc_id is never the name of a component unless all of its
documents have none; repeated rows come back once each; other columns are dropped first or come back
inside one struct, so their names clash with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm import golay
from quireline.llm.components import components
from quireline.llm.scratch import arrow_function, cut, drop, recorded, small

SHINGLE, SEED, MAX_DISTANCE = 3, 42, 2
#: Bits and first bit of each segment.
SEGMENTS = ((22, 42), (21, 21), (21, 0))
#: The largest bucket that is verified pair by pair.
MAX_BUCKET = 64
#: Documents to drop (eight bytes each) up to which their list is broadcast; a longer one is joined by a shuffle.
MAX_BROADCAST = 1_000_000
_BLOCK = 1 << 14


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hash of each shingle of so many words, repeats included; fewer words are one shingle, none have none."""
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))], dtype="<u8")


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text."""
    return fingerprint_of(shingle_hashes(words_of(text), SHINGLE))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that over half of some hashes have; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[k : k + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(texts: list[str | None]) -> list[int]:
    return np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, carry: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table of _row (unique), _id, _fp (signed 64-bit) and, if columns are carried, the struct _doc of them."""
    picked = docs.select(F.col(doc_id).alias("_id"), arrow_function(_fingerprints, "long")(F.col(text)).alias("_fp"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_doc")] if carry else []))
    return cut(picked.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")


def keys(fps: np.ndarray) -> list[np.ndarray]:
    """The Golay keys of each unsigned 64-bit fingerprint."""
    parts = [(fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64) for width, first in SEGMENTS]
    found = []
    for k in range(3):
        exact, fuzzy = parts[k], golay.nearby(parts[(k + 1) % 3], SEGMENTS[(k + 1) % 3][0])
        new = np.concatenate([np.ones((len(fps), 1), dtype=bool), fuzzy[:, 1:] != fuzzy[:, :-1]], axis=1)
        found.append((k << 34 | exact[:, None] << 12 | fuzzy, new))
    values = np.concatenate([v for v, _ in found], axis=1)
    new = np.concatenate([n for _, n in found], axis=1)
    return [v[n] for v, n in zip(values, new, strict=True)]


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for at in range(0, len(whole), 4096):
            fps = whole["_fp"].to_numpy()[at : at + 4096]
            if len(fps):
                each = keys(fps.view(np.uint64))
                yield pd.DataFrame({"_key": np.concatenate(each), "_fp": np.repeat(fps, [len(k) for k in each])})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside each small bucket, as a star around the least of every group that hangs together."""
    for pdf in batches:
        a, b = [], []
        for members in pdf["_fps"]:
            fps = np.sort(np.asarray(members, dtype=np.int64))
            near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= MAX_DISTANCE
            group = np.arange(len(fps))
            while True:
                least = np.where(near, group[None, :], len(fps)).min(axis=1)
                if (least == group).all():
                    break
                group = least
            linked = group != np.arange(len(fps))
            a.append(fps[group[linked]])
            b.append(fps[linked])
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``_fp`` that give the components of all pairs within two bits."""
    keyed = cut(distinct.select("_fp").mapInPandas(_keyed, "_key long, _fp long"), "keys")
    shared = cut(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "buckets")
    members = keyed.join(shared, "_key")
    small = (
        members.where(F.col("_n") <= MAX_BUCKET).groupBy("_key").agg(F.collect_list("_fp").alias("_fps")).select("_fps")
        .mapInPandas(_verified, "a long, b long")
    )
    large = members.where(F.col("_n") > MAX_BUCKET).select("_fp").distinct()
    words = F.concat(F.array(F.col("_fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("_fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    hubs = large.select(F.explode(words).alias("_hub"), "_fp").groupBy("_hub").agg(F.collect_list("_fp").alias("_fps")).where("size(_fps) > 1")
    met = hubs.select(F.array_min("_fps").alias("a"), F.explode("_fps").alias("b"))
    return small.union(met).where("a <> b")


def near_duplicates(docs: DataFrame, carry: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The table of ``fingerprints`` and, for each distinct _fp, its component_id and the _row of the document to keep."""
    rows = fingerprints(docs, carry, doc_id, text)
    with recorded() as passing:
        first = F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_row").alias("row")))
        distinct = cut(rows.groupBy("_fp").agg(first.alias("_first")), "distinct")
        joined = components(links(distinct))
        named = distinct.join(joined, F.col("_fp") == F.col("node"), "left").select("_fp", "_first", F.coalesce("component", "_fp").alias("_component"))
        named = cut(named, "named")
        firsts = cut(named.groupBy("_component").agg(F.min("_first").alias("_least")), "firsts")
    classes = cut(named.select("_fp", "_component").join(firsts, "_component").select("_fp", F.col("_least.id").alias("component_id"), F.col("_least.row").alias("_keep")), "classes")
    drop(docs.sparkSession, passing)
    return rows, classes


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    rows, classes = near_duplicates(docs, (), doc_id, text)
    hexed = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return rows.join(classes, "_fp").select(F.col("_id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id, with the columns of ``docs``."""
    rows, classes = near_duplicates(docs, docs.columns, doc_id, text)
    kept = classes.select(F.col("_keep").alias("_row")).distinct()
    gone = cut(rows.select("_row").join(kept, "_row", "left_anti"), "gone")
    return rows.join(small(gone, MAX_BROADCAST), "_row", "left_anti").select("_doc.*")
