"""Near-dedup for pipelines: SimHash keys propose pairs, the shingle sets themselves decide.

Two texts are near copies if at least 4/5 of their different five-word shingles (XXH64 values) are
common to both; near copies of near copies hang together. Texts of the same words count once.

Candidates share a key. The keys of a text are the Golay keys of its SimHash fingerprint over the same
shingles (``simhash.keys``: none is missed whose fingerprints differ in at most two bits) and, as texts at
0.8 differ in about ten bits, ``BANDS`` keys of ``ROWS`` minwise hashes each: a pair at exactly 0.8 shares
none of these with a chance of (1 - 0.8^6)^32, about 6 in 100,000, one at 0.9 with 3 in 10^11.

All texts that keys hang together are a group. A group whose sets are ``GROUP_BYTES`` or less goes to one
task, each set once, and every pair of it is decided there by walking from one text to all that are not yet
reached, so copies of one text cost about their number, not their pairs. A larger group is taken apart by
its keys, and a key whose texts are too many for one task is dealt in blocks of texts, each two of which
meet in a task: memory stays bounded, and no pair of one key is left out.

Defined results: null, empty and blank texts are copies of each other; a text of under five words
has one shingle; a text of any length counts whole; of a group the smallest id stays, null ids last, of
equal rows one; an empty table gives an empty result; the columns of the input come back whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm.components import components
from quireline.llm.scratch import arrow_function, cut, drop, recorded, small
from quireline.llm.simhash import MAX_BROADCAST, SEED, fingerprint_of, keys, shingle_hashes, words_of

SHINGLE, BANDS, ROWS = 5, 32, 6
#: Bytes of sets (8 a shingle) that one task holds together.
GROUP_BYTES = 16 << 20
#: Keys are told apart by their kind in the highest bits: below for the bands, this for Golay keys.
_GOLAY = 1 << 62
_BLOCK, _TOGETHER = 1 << 12, 10_000
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_TIMES, _PLUS = _DRAWN[0] << np.uint64(1) | np.uint64(1), _DRAWN[1]


def bands(found: np.ndarray) -> list[int]:
    """The minwise keys of a set of shingles, none for the empty one."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), _BLOCK):
        least = np.minimum(least, (found[k : k + _BLOCK, None] * _TIMES + _PLUS).min(axis=0))
    return [(xxhash.xxh64_intdigest(row.tobytes(), k) >> 2) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _signed(texts: list[str | None]) -> list[dict]:
    out = []
    for t in texts:
        words = words_of(t)
        hashes = shingle_hashes(words, SHINGLE)
        found = np.unique(hashes)
        golay = keys(np.array([fingerprint_of(hashes)], dtype=np.uint64))[0] | _GOLAY
        out.append({"copy": xxhash.xxh3_128_digest(b" ".join(words)), "keys": bands(found) + golay.tolist() if words else [], "bytes": found.nbytes})
    return out


def _sets(texts: list[str | None]) -> list[bytes]:
    return [np.unique(shingle_hashes(words_of(t), SHINGLE)).tobytes() for t in texts]


def stars(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (reached from, reached) that join all sets which hang together."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, codes, shared_by = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = shared_by[codes] > 1  # shingles of one set alone are never common
    owners, held = np.repeat(np.arange(n), sizes)[several], np.zeros(len(shared_by), dtype=bool)
    codes = codes[several]
    at = np.searchsorted(owners, np.arange(n + 1))
    rest, theirs, looked_at = codes, owners, n
    unseen, out, queue, begin = np.ones(n, dtype=bool), [], [], 0
    while (left := int(unseen.sum())) > 0:
        if 2 * left <= looked_at:  # only what is unseen is looked at again
            keep = unseen[theirs]
            rest, theirs, looked_at = rest[keep], theirs[keep], left
        if not queue:
            begin += int(np.argmax(unseen[begin:]))
            queue.append(begin)
            unseen[begin] = False
        x = queue.pop()
        mine = codes[at[x] : at[x + 1]]
        held[mine] = True
        common = np.bincount(theirs[held[rest]], minlength=n)
        held[mine] = False
        near = np.flatnonzero((9 * common >= 4 * (sizes[x] + sizes)) & unseen)  # the same as common / all >= 4/5
        unseen[near] = False
        queue += near.tolist()
        out += [(x, y) for y in near.tolist()]
    return out


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the texts of each unit of work; rows come in order of units."""
    members = (m for pdf in batches for m in zip(pdf["_unit"], pdf["_node"], pdf["_set"], strict=True))
    a, b = [], []
    for _, group in groupby(members, key=itemgetter(0)):
        _, nodes, sets = zip(*group, strict=True)
        for x, y in stars([np.frombuffer(s, dtype=np.uint64) for s in sets]):
            a.append(min(nodes[x], nodes[y]))
            b.append(max(nodes[x], nodes[y]))
        if len(a) >= _TOGETHER:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = [], []
    yield pd.DataFrame({"a": a, "b": b}, dtype="int64")


def units(distinct: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(_unit, _node): which texts of ``distinct(_node, _keys, _bytes)`` are held against each other in one task."""
    keyed = cut(distinct.select("_node", "_bytes", F.explode("_keys").alias("_key")), "keys")
    shared = keyed.groupBy("_key").agg(F.min("_node").alias("_least"), F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_sum")).where("_n > 1")
    shared = cut(shared.drop("_n"), "shared")
    met = cut(keyed.join(shared, "_key").select("_node", "_key", "_least", "_bytes", "_sum"), "met")
    grouped = components(met.select(F.col("_least").alias("a"), F.col("_node").alias("b")))
    sized = cut(grouped.join(distinct.select(F.col("_node").alias("node"), "_bytes"), "node"), "sized")
    heavy = cut(sized.groupBy("component").agg(F.sum("_bytes").alias("_all")).where(F.col("_all") > group_bytes), "heavy")
    fits = sized.join(heavy, "component", "left_anti").select(F.xxhash64("component", F.lit(-1)).alias("_unit"), F.col("node").alias("_node"))
    apart = sized.join(heavy, "component", "left_semi").select(F.col("node").alias("_node"))
    blocks = F.ceil(2 * F.col("_sum") / group_bytes).cast("int")  # so that two blocks fit
    dealt = met.join(apart, "_node", "left_semi").select("_node", "_key", F.when(F.col("_sum") <= group_bytes, 1).otherwise(blocks).alias("_blocks"))
    own = F.pmod(F.xxhash64("_node", "_key"), F.col("_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda other: F.xxhash64("_key", F.least(other, "_own"), F.greatest(other, "_own")))
    return fits.union(dealt.withColumn("_own", own).select(F.explode(pairs).alias("_unit"), "_node"))


def links(rows: DataFrame, distinct: DataFrame, text: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Links (a, b) between nodes of ``distinct`` that are near copies; ``rows`` has their texts."""
    dealt = cut(units(distinct, group_bytes), "units")
    wanted = cut(dealt.groupBy(F.col("_node").alias("_row")).agg(F.collect_list("_unit").alias("_units")), "wanted")
    texts = rows.select("_row", F.col(f"_doc.`{text}`").alias("_text")).join(small(wanted, MAX_BROADCAST), "_row")
    sets = texts.select("_units", F.col("_row").alias("_node"), arrow_function(_sets, "binary")(F.col("_text")).alias("_set"))
    each = sets.select(F.explode("_units").alias("_unit"), "_node", "_set")
    return each.repartition("_unit").sortWithinPartitions("_unit").mapInPandas(_linked, "a long, b long")


def near_copies_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One document of each group of near copies, that of the smallest id, with the columns of ``docs``."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    signed = docs.select(F.col(doc_id).alias("_id"), doc, arrow_function(_signed, "copy binary, keys array<long>, bytes long")(F.col(text)).alias("_s"))
    rows = cut(signed.select("_id", "_doc", "_s.*").withColumn("_row", F.monotonically_increasing_id()), "signed")
    with recorded() as passing:
        first = F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_first")
        copies = rows.groupBy("copy").agg(first)
        firsts = cut(copies.select("_first", F.col("_first.row").alias("_node")), "copies")
        distinct = cut(rows.select(F.col("_row").alias("_node"), F.col("keys").alias("_keys"), F.col("bytes").alias("_bytes")).join(small(firsts.select("_node"), MAX_BROADCAST), "_node", "left_semi"), "distinct")
        joined = components(links(rows, distinct, text, group_bytes))
        named = firsts.join(joined, F.col("_node") == F.col("node"), "left").select("_first", F.coalesce("component", "_node").alias("_component"))
        kept = cut(named.groupBy("_component").agg(F.min("_first").alias("_least")).select(F.col("_least.row").alias("_row")), "kept")
        missing = rows.select("_row").join(kept, "_row", "left_anti")
    gone = cut(missing, "gone")
    drop(docs.sparkSession, passing)
    return rows.join(small(gone, MAX_BROADCAST), "_row", "left_anti").select("_doc.*")
