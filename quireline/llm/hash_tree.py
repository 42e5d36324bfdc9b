"""Sharding by a hierarchical weighted hash tree, in DataFrame functions.

Shards are leaves under racks under regions, ``SHARDS`` to a rack and ``RACKS`` to a region. A document
descends: among the children of each node it goes to the one of least draw, ``-ln(u) / weight``, where
u is a hash of the document's key and the child's path and the weight is that of the child's whole
subtree. A document meets the draws of the nodes on its way alone, so its cost follows the regions and
the depth and not the leaves.

A draw depends on its own subtree's weight alone, and falls when that rises. So a change of weights
moves documents only into or out of subtrees whose weight changed; below, documents move only where
a child's own weight changed. A shard that opens a new region takes documents only into itself (eight
shards are two whole regions, so a ninth does).

Defined results: a null id has the key of the string ``null``; a null text has size 1 and the CRC of no
bytes; a text of any length counts by its bytes; repeated rows go to the same shard and get slots of
their own; other columns are dropped first, so their names clash with nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.llm.scratch import cut, small

#: Fan-out of racks and of regions.
SHARDS, RACKS = 2, 2
#: Parts of a shard in which slots are counted, each on its own, and copies of a row in which equal rows are counted.
PARTS, COPIES = 1024, 64
#: Rows of the parts' table (shards * PARTS at most) up to which it is broadcast; a longer one is joined by a shuffle.
MAX_BROADCAST = 1_000_000


def _unit(key: Column, path: Column) -> Column:
    """A number above 0 and at most 1 from 52 bits of MD5."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), path)), 1, 13), 16, 10).cast("double") + 1) / float(2**52)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tree_of(weights: Sequence[float]) -> list[list[list[float]]]:
    """The weights of shards, by region and rack."""
    racks = [list(map(float, weights[k : k + SHARDS])) for k in range(0, len(weights), SHARDS)]
    return [racks[k : k + RACKS] for k in range(0, len(racks), RACKS)]


def _nested(value) -> Column:
    """A literal array of numbers or of arrays."""
    return F.array(*map(_nested, value)) if isinstance(value, list) else F.lit(value)


def _least(key: Column, prefix: Column, weights: Column) -> Column:
    """The number (from 0) of the child of least draw; ``weights``: one for each child."""
    draws = F.transform(weights, lambda w, i: -F.log(_unit(key, F.concat(prefix, i.cast("string")))) / w)
    return _let(draws, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def descend(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key (a string): region, rack, shard."""
    tree = tree_of(weights)
    regions = _nested([sum(map(sum, racks)) for racks in tree])
    racks = _nested([[sum(rack) for rack in racks] for racks in tree])
    shards = _nested(tree)
    path = lambda *parts: F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("."))])

    def rack_of(region: Column) -> Column:
        return _let(_least(key, path(region), F.element_at(racks, region + 1)), lambda rack: shard_of(region, rack))

    def shard_of(region: Column, rack: Column) -> Column:
        own = F.element_at(F.element_at(shards, region + 1), rack + 1)
        return (region * RACKS + rack) * SHARDS + _least(key, path(region, rack), own)

    return _let(_least(key, F.lit(""), regions), rack_of)


def shard(docs: DataFrame, weights: Sequence[float], shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    The first ``shards`` of the weights (all positive) are the shards there are; all weights are those after growth.

    Slots are dealt by (shard, part), a part being a hash of the id, the size and the CRC, then
    shifted by the totals of the parts before, so no task sorts a whole shard. Equal rows are counted
    before they are shuffled, and dealt their slots together.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("_key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    named = F.concat_ws("/", "_key", "size", "text_crc32")
    part = F.conv(F.substring(F.md5(F.concat(named, F.lit("/part"))), 1, 8), 16, 10).cast("long") % PARTS
    rows = rows.select(
        "doc_id", "size", "text_crc32",
        descend(F.col("_key"), weights[:shards]).cast("int").alias("shard"),
        descend(F.col("_key"), weights).cast("int").alias("grown_shard"),
        part.cast("int").alias("_part"),
        F.pmod(F.monotonically_increasing_id(), F.lit(COPIES)).cast("int").alias("_copy"),
    )
    equal = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")), "shards")
    totals = equal.groupBy("shard", "_part").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(totals.select("shard", "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")), "offsets")
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "size", "text_crc32", "_copy").rowsBetween(Window.unboundedPreceding, -1)
    dealt = equal.withColumn("_first", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(small(offsets, MAX_BROADCAST), ["shard", "_part"])
    first = F.col("_before") + F.col("_first")
    slots = F.explode(F.sequence(first, first + F.col("_n") - 1).cast("array<long>"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots.alias("slot"), "grown_shard")
