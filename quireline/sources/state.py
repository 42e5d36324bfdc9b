"""Stored documents as a log of commits over Parquet, which readers take whole.

A commit adds rows and never rewrites others: documents replaced (with their nodes and segments), or
patches to fields of segments. It counts once its record is in ``commits``, which a rename puts there at
once, so a reader never sees half a save and a lost executor leaves nothing behind. What stands is, of
each document, the rows of its last replacing commit, and of each field of a segment the last patch since.

Writers take turns: a commit's number is claimed by creating a file that must not exist yet, and the claim
comes before the first read, so what a writer compares with is what it writes over. A writer that fails
gives its turn back; a claim that a dead driver has left must be deleted by hand, and others say so after ``WAIT``.
"""

from __future__ import annotations

import contextlib
import json
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireline.functions import masking
from quireline.functions.text import target_token
from quireline.functions.values import HELD, HUMAN, MODEL_PREFIX, STATE_VERSION

TABLES = ("documents", "nodes", "segments")
KEYS = ("doc_id", "lang")
SEGMENT = (*KEYS, "id")
#: Fields of a segment that are written by themselves, with their types.
FIELDS: dict[str, T.DataType] = {"target": T.StringType(), "origin": T.StringType(), "review": T.StringType(), "issues": T.ArrayType(T.StringType()), "target_slots": masking.SLOTS}
#: Review values that may be stored, beside none.
REVIEWS = (HELD,)
#: Seconds to wait for another writer's turn to end.
WAIT = 600.0


class State:
    """A folder of commits and their rows."""

    def __init__(self, spark: SparkSession, root: str, wait: float = WAIT):
        self.spark, self.root, self.wait = spark, root.rstrip("/"), wait

    # ---- commits ------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _system(self):
        return self._path("commits").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def commits(self) -> dict[int, dict]:
        """The records of whole commits by number, ascending."""
        system, folder = self._system(), self._path("commits")
        if not system.exists(folder):
            return {}
        names = sorted(s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName().endswith(".json"))
        out = {}
        for name in names:
            stream = system.open(self._path("commits", name))
            try:
                out[int(name.split(".")[0])] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return out

    def versions(self) -> list[int]:
        """Commits that were saved whole, ascending."""
        return list(self.commits())

    @contextlib.contextmanager
    def turn(self) -> Iterator[Turn]:
        """A writer's turn: no other commit is made between its claim and the end of the block."""
        system, until = self._system(), time.monotonic() + self.wait
        while True:
            number = max(self.versions(), default=0) + 1
            claim = self._path("commits", f"{number:012d}.claim")
            if system.createNewFile(claim):
                break
            if time.monotonic() > until:
                raise TimeoutError(f"another writer holds commit {number} of {self.root}; delete {claim.toString()} if it is dead")
            time.sleep(0.1)
        if number in self.versions():  # it was published between the listing and the claim, which its writer had deleted
            system.delete(claim, False)
            with self.turn() as later:
                yield later
            return
        mine = Turn(self, number)
        try:
            yield mine
            mine.publish()
        finally:
            system.delete(claim, False)

    def _rows(self, table: str, version: int | None = None) -> DataFrame | None:
        """Every row of a table up to a commit, with its commit's number as _v."""
        found = [f"{self.root}/data/{record['folder']}/{table}" for n, record in self.commits().items() if table in record["tables"] and (version is None or n <= version)]
        return self.spark.read.option("mergeSchema", "true").parquet(*found) if found else None

    # ---- readers ------------------------------------------------------------------------------------

    def _latest(self, version: int | None) -> DataFrame:
        """The last replacing commit of each document."""
        rows = self._rows("documents", version)
        if rows is None:
            raise FileNotFoundError(f"no state in {self.root}")
        return rows.groupBy(*KEYS).agg(F.max("_v").alias("_v"))

    def read(self, table: str, version: int | None = None, doc_id: str | None = None, lang: str | None = None) -> DataFrame:
        """A table as it stands, or stood at a commit; of one document or language, if given, which the scan filters by."""
        rows, latest = self._rows(table, version), self._latest(version)
        for column, value in (("doc_id", doc_id), ("lang", lang)):
            if value is not None:
                rows, latest = rows.where(F.col(column) == value), latest.where(F.col(column) == value)
        rows = rows.join(latest, [*KEYS, "_v"], "left_semi")
        return self._patched(rows, version, latest).drop("_v") if table == "segments" else rows.drop("_v")

    def _patched(self, segments: DataFrame, version: int | None, latest: DataFrame) -> DataFrame:
        """Segments with the last patch of each field since their document was replaced."""
        for name, kind in FIELDS.items():
            if name not in segments.columns:
                segments = segments.withColumn(name, F.lit(None).cast(kind))
        patches = self._rows("patches", version)
        if patches is None:
            return segments
        last = [F.max_by(F.struct(F.col(name).alias("x")), F.when(F.array_contains("fields", name), F.col("_v"))).alias(f"_p_{name}") for name in FIELDS]
        valid = patches.join(latest.withColumnRenamed("_v", "_since"), list(KEYS)).where("_v > _since")
        joined = segments.join(valid.groupBy(*SEGMENT).agg(*last), list(SEGMENT), "left")
        new = {name: F.when(F.col(f"_p_{name}").isNotNull(), F.col(f"_p_{name}.x")).otherwise(F.col(name)) for name in FIELDS}
        return joined.withColumns(new).drop(*[f"_p_{name}" for name in FIELDS])

    def current(self, doc_id: str | None = None, lang: str | None = None) -> DataFrame:
        """Segments with the wording, issues and reviews that stand now."""
        return self.read("segments", doc_id=doc_id, lang=lang)

    def documents(self, doc_id: str | None = None, lang: str | None = None) -> DataFrame:
        """Stored documents, by id and language; a newer layout than this code knows is refused, among those asked for."""
        found = self.read("documents", doc_id=doc_id, lang=lang)
        if not found.where(F.col("state_version") > STATE_VERSION).isEmpty():
            raise ValueError(f"{self.root} has documents of a newer state version than {STATE_VERSION}")
        return found.orderBy(*KEYS)

    def tracked(self, lang: str | None = None) -> DataFrame:
        """Every document, of any layout, beside its segments as an ordered array; by id and language."""
        whole = self.current(lang=lang).select(*KEYS, F.struct("pos", "id", *[F.col(c) for c in FIELDS]).alias("s"))
        segments = whole.groupBy(*KEYS).agg(F.collect_list("s").alias("segments")).withColumn("segments", F.array_sort("segments", lambda a, b: a.pos - b.pos))
        return self.read("documents", lang=lang).join(segments, list(KEYS), "left").orderBy(*KEYS)

    # ---- writers ------------------------------------------------------------------------------------

    def replace(self, documents: DataFrame, nodes: DataFrame, segments: DataFrame) -> int:
        """Save documents with their nodes and segments; rows of other documents are not touched."""
        with self.turn() as mine:
            mine.add("documents", documents.withColumn("state_version", F.lit(STATE_VERSION)))
            mine.add("nodes", nodes)
            mine.add("segments", segments)
        return mine.number

    def write_segments(self, incoming: DataFrame, over_human: bool = False) -> DataFrame:
        """Write wording (SEGMENT, target, origin; ``expect``: the token of the wording that the writer saw); rows with their ``outcome``.

        Outcomes are those of ``guarded``. New wording takes the issues and old slots of the segment away.
        """
        with self.turn() as mine:
            out = mine.add("outcomes", guarded(self.current(), incoming, over_human))
            new = out.where("outcome = 'written'").select(*SEGMENT, "target", "origin")
            mine.patch(new, ("target", "origin", "issues", "target_slots"))
        return out

    write_targets = write_segments

    def write_issues(self, checked: DataFrame) -> DataFrame:
        """Write ``issues`` (null or empty: none) of segments whose wording is still that of ``token``; the rows written."""
        with self.turn() as mine:
            known = self.current().select(*SEGMENT, target_token(F.col("target")).alias("_now"))
            same = checked.join(known, list(SEGMENT)).where(F.col("token").isNull() | (F.col("token") == F.col("_now")))
            out = mine.add("outcomes", same.select(*SEGMENT, F.when(F.size("issues") > 0, F.col("issues")).alias("issues")))
            mine.patch(out, ("issues",))
        return out

    def write_review(self, ids: DataFrame, value: str | None = HELD) -> DataFrame:
        """Set or clear the review of segments (SEGMENT): ``outcome`` is unknown, blank (no wording to hold), unchanged or applied."""
        if value is not None and value not in REVIEWS:
            raise ValueError(f"{value!r} is no review value; there are {', '.join(REVIEWS)} and none")
        with self.turn() as mine:
            stored = self.current().select(*SEGMENT, F.struct("target", "review").alias("_s"))
            s = F.col("_s")
            blank = F.lit(value is not None) & (F.trim(F.coalesce(s["target"], F.lit(""))) == "")
            outcome = F.when(s.isNull(), "unknown").when(blank, "blank").when(s["review"].eqNullSafe(F.lit(value)), "unchanged").otherwise("applied")
            out = mine.add("outcomes", ids.select(*SEGMENT).join(stored, list(SEGMENT), "left").select(*SEGMENT, outcome.alias("outcome")))
            mine.patch(out.where("outcome = 'applied'").select(*SEGMENT, F.lit(value).cast("string").alias("review")), ("review",))
        return out


class Turn:
    """One commit in the making."""

    def __init__(self, state: State, number: int):
        self.state, self.number = state, number
        self.folder, self.tables = f"{number:012d}-{uuid.uuid4().hex}", []

    def add(self, table: str, rows: DataFrame) -> DataFrame:
        """Write rows of a table, and give them back as written."""
        path = f"{self.state.root}/data/{self.folder}/{table}"
        rows.withColumn("_v", F.lit(self.number).cast("long")).write.parquet(path)
        self.tables.append(table)
        return self.state.spark.read.parquet(path).drop("_v")

    def patch(self, rows: DataFrame, fields: Sequence[str]) -> None:
        """Set ``fields`` of segments; one that the rows lack is emptied."""
        columns = [(F.col(name) if name in rows.columns and name in fields else F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()]
        self.add("patches", rows.select(*SEGMENT, *columns, F.array(*map(F.lit, fields)).alias("fields")))

    def publish(self) -> None:
        system = self.state._system()
        draft, final = (self.state._path("commits", f"{self.number:012d}.{end}") for end in ("draft", "json"))
        stream = system.create(draft, True)
        stream.write(bytearray(json.dumps({"folder": self.folder, "tables": self.tables}).encode()))
        stream.close()
        if not system.rename(draft, final):
            raise OSError(f"commit {self.number} of {self.state.root} could not be published")


def guarded(segments: DataFrame, incoming: DataFrame, over_human: bool = False, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """``incoming`` (keys, target, origin and, at will, expect) with its ``outcome``.

    ``unknown`` where there is no such segment, ``refused`` where a model would replace a person's wording,
    ``stale`` where the stored wording is not what the writer expected, else ``written``.
    """
    stored = segments.select(*keys, F.struct("target", "origin").alias("_s"))
    df = incoming.join(stored, list(keys), "left")
    old = F.col("_s")
    changed = F.col("expect").isNotNull() & (target_token(old["target"]) != F.col("expect")) if "expect" in incoming.columns else F.lit(False)
    by_hand = F.col("origin").startswith(MODEL_PREFIX) & (old["origin"] == HUMAN) & F.lit(not over_human)
    outcome = F.when(old.isNull(), "unknown").when(F.coalesce(by_hand, F.lit(False)), "refused").when(changed, "stale").otherwise("written")
    return df.withColumn("outcome", outcome).drop("_s")


def still_true(segments: DataFrame, checked: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Of ``checked`` (keys, issues, token of the wording that was checked), the rows whose wording has not changed since."""
    now = segments.select(*keys, target_token(F.col("target")).alias("_now"))
    return checked.join(now, list(keys)).where(F.col("token") == F.col("_now")).drop("_now")


def issue_lines(issues: Column) -> Column:
    """array<string> ``rule: message`` of a check's issues, as segments store them."""
    return F.transform(issues, lambda x: F.concat(x.rule, F.lit(": "), x.message))


_FOLDERS: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared ``spark.checkpoint.dir``; in one process without that setting, a temporary one.

    The driver's file system deletes it when the driver ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        if context.applicationId not in _FOLDERS:
            _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="quireline-")
        shared = _FOLDERS[context.applicationId]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return path.toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in a scratch folder and read back: what it took to make is not done again, even for a lost executor."""
    path = scratch_folder(df.sparkSession, name) + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
