"""Translation memory: an append-only log of wording, looked up by key.

A key is (hash, context, version, variant, tone); null is a value in each part, so keys are compared
null-safely. Lookups are equi-joins on the whole key: adaptive execution broadcasts the memory where
it is small and splits skewed keys where it is not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.functions.text import key_tone
from quireline.functions.values import SEGMENTATION_VERSION

_APPEND = re.compile(r"(?:append|_claim)-(\d+)")
KEY = ("hash", "context", "version", "variant", "tone")
RECORD = "hash string, context string, segmentation_version int, variant string, tone string, source string, target string, slots array<string>"


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines log in the order they were appended (``seq``); lines that are none are skipped.

    An appended record brings its number (``append``). Lines without one, in files from elsewhere, are the oldest and
    come in the order of their files and lines.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    parsed = lines.select(F.from_json("value", f"{RECORD}, seq bigint, place bigint", {"mode": "PERMISSIVE"}).alias("r"), "_file", "_at")
    rows = parsed.where("r.hash <> '' AND r.target <> ''")
    return rows.select("r.*", "_file", "_at").withColumn("seq", F.struct(F.coalesce("seq", F.lit(0)).alias("commit"), F.coalesce("place", F.lit(0)).alias("place"), "_file", "_at")).drop("place", "_file", "_at")


def keyed(records: DataFrame) -> DataFrame:
    """Records with the parts of their key; a missing version is 0."""
    return records.withColumn("version", F.coalesce(F.col("segmentation_version"), F.lit(0))).withColumn("tone", key_tone(F.col("tone"))).drop("segmentation_version")


def latest(records: DataFrame, key: tuple[str, ...] = KEY, seq: str = "seq") -> DataFrame:
    """The last record of each key; an aggregate with partial results, not a window, so a hot key is never gathered."""
    rest = [c for c in records.columns if c not in key]
    # An aggregate for each column: what a reader does not select is not shuffled. All follow the same order, so they take the same record.
    return records.groupBy(*key).agg(*[F.max_by(c, F.col(seq)).alias(c) for c in rest])


def _same(left: DataFrame, right: DataFrame, prefix: str = "_k_") -> Column:
    condition = F.lit(True)
    for k in KEY:
        condition = condition & left[k].eqNullSafe(right[prefix + k])
    return condition


def lookup(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """``segments`` (hash, context, variant, tone) with ``hit``, ``hit_slots`` and ``hit_origin`` from the memory of ``latest``.

    The exact key wins. Where variant and tone are null, a record of version 0 without context is
    the legacy answer. Wording must be there in either case.
    """
    known = memory.select(*[F.col(k).alias("_k_" + k) for k in KEY], F.struct("target", "slots").alias("_hit")).where(~F.isnull("_hit.target") & (F.col("_hit.target") != ""))
    legacy = known.where("_k_version = 0 AND _k_context IS NULL AND _k_variant IS NULL AND _k_tone IS NULL").select(F.col("_k_hash").alias("_old_hash"), F.col("_hit").alias("_old"))
    asked = segments.withColumn("version", F.lit(SEGMENTATION_VERSION)).withColumn("_tone", F.col("tone")).withColumn("tone", key_tone(F.col("tone")))
    found = asked.join(known, _same(asked, known), "left").drop(*["_k_" + k for k in KEY])
    plain = found["variant"].isNull() & found["tone"].isNull()
    found = found.join(legacy, plain & (found["hash"] == legacy["_old_hash"]), "left")
    best = F.coalesce(F.col("_hit"), F.col("_old"))
    origin = F.when(F.col("_hit").isNotNull(), "tm").when(F.col("_old").isNotNull(), "tm:legacy")
    return found.withColumns({"hit": best["target"], "hit_slots": best["slots"], "hit_origin": origin, "tone": F.col("_tone")}).drop("_hit", "_old", "_old_hash", "_tone", "version")


def digest() -> Column:
    """A record's source, target and slots as 32 bytes (SHA-256); nulls are values of their own."""
    return F.unhex(F.sha2(F.to_json(F.struct("source", "target", "slots")), 256))


def to_commit(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """Records of translated segments that the memory does not hold just so already.

    Records are compared by ``digest``, so that no wording is shuffled to find out; a memory may bring it as a column.
    """
    done = segments.where(F.coalesce("target", F.lit("")) != "")
    records = done.select(
        "hash", "context", F.lit(SEGMENTATION_VERSION).alias("version"), "variant", key_tone(F.col("tone")).alias("tone"), "source", "target", "slots"
    ).withColumn("_digest", digest())
    fresh = records.groupBy(*KEY, "_digest").agg(*[F.first(c).alias(c) for c in ("source", "target", "slots")])
    held = F.col("digest") if "digest" in memory.columns else digest()
    old = memory.select(*[F.col(k).alias("_k_" + k) for k in KEY], held.alias("_held"))
    same = _same(fresh, old) & (fresh["_digest"] == old["_held"])
    return fresh.join(old, same, "left_anti").drop("_digest")


def append(records: DataFrame, path: str) -> int:
    """Append records to a JSON-lines log, nulls left out; the number of this append.

    Each append is a folder of its own, named by its number, which is claimed by making the folder: of two
    writers at a time one gets the next number. All its records carry the number and their place, so they
    are read in order whatever their files are called.
    """
    spark = records.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(folder)
    taken = [int(m[1]) for s in system.listStatus(folder) if (m := _APPEND.fullmatch(s.getPath().getName()))]
    number = max(taken, default=0) + 1
    while not system.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, f"_claim-{number:012d}")):
        number += 1
    renamed = records.withColumnRenamed("version", "segmentation_version") if "version" in records.columns else records
    numbered = renamed.withColumns({"seq": F.lit(number).cast("long"), "place": F.monotonically_increasing_id()})
    numbered.write.json(f"{path}/append-{number:012d}")
    return number
