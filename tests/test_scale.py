"""What is held, shuffled and built for large tables."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quireline import queries as catalogue
from quireline.functions.normalizing import full_width
from quireline.functions.values import CJK, FULLWIDTH, HALF_TO_FULL, WHITE
from quireline.operators import memory, reports


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reports_of_null_languages(spark):
    rows = [("a", None, "x", [("dnt", "warn", "m")]), (None, "de", "x", [("dnt", "warn", "m")])]
    checked = spark.createDataFrame(rows, "doc_id string, lang string, target string, issues array<struct<rule: string, severity: string, message: string>>")
    assert [r.by_rule for r in reports.check_reports(checked).collect()] == [{"dnt": 1}, {"dnt": 1}]


def test_few_rows_are_python_objects_at_a_time():
    from quireline.functions.arrow import pieces

    array = pa.array(["x" * 1000] * 50 + ["y" * 50_000] + [None] + ["z"] * 50)
    cut = list(pieces(array, rows=20, most=5_000))
    assert pa.concat_arrays(cut).equals(array)
    assert all(len(p) == 1 or len(p) <= 20 and p.nbytes <= 5_000 for p in cut)


def test_segments_alone_build_no_nodes(spark, sf_dir):
    assert "seg_id" not in plan(catalogue.document_segments(spark, sf_dir))


def test_commit_shuffles_digests(spark, sf_dir):
    s = catalogue.document_segments(spark, sf_dir).withColumn("target", F.upper("masked")).drop("slots").withColumnRenamed("originals", "slots")
    known = catalogue.document_memory(catalogue.document_segments(spark, sf_dir))
    told = plan(memory.to_commit(s, known).select("hash"))
    assert "first(source" not in told and not re.search(r"max_by\(\S*(struct|source|target)", told)


def test_commit_tells_nulls_apart(spark):
    made = spark.createDataFrame([("h", None, 1, None, None, "s", "t", None, 1), ("i", None, 1, None, None, "s", "t", [], 1)], memory.RECORD + ", seq int")
    known = memory.latest(memory.keyed(made))
    segments = spark.createDataFrame([(h, None, None, None, "s", "t", slots) for h in "hi" for slots in (None, [])], "hash string, context string, variant string, tone string, source string, target string, slots array<string>")
    assert sorted((r.hash, r.slots) for r in memory.to_commit(segments, known).collect()) == [("h", []), ("i", None)]


def test_full_width_as_its_plain_patterns(spark):
    """The patterns that look behind at every character give the same."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("中文ab,;:!?.() \t\n\r，。（") for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    inside = rf"(?<=[^{WHITE}]|\r)"
    c = F.col("t")
    for half, full in HALF_TO_FULL:
        c = F.regexp_replace(c, rf"(?<=[{CJK}])\Q{half}\E(?=[{WHITE}]|\z|[{CJK}])", full)
    c = F.regexp_replace(c, rf"(?<=[{CJK}])\.(?=[{WHITE}]*\z|[{CJK}])", "。")
    c = F.regexp_replace(c, rf"\(([^()]*[{CJK}][^()]*)\)", "（$1）")
    c = F.regexp_replace(F.regexp_replace(c, rf"{inside}[ \t]+(?=[{FULLWIDTH}])", ""), rf"(?<=[{FULLWIDTH}])[ \t]+(?![ \t]*\r?\n)", "")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~full_width(F.col("t")).eqNullSafe(c)).count() == 0
    assert not re.search(r"regexp_replace\([^,]*, \(\?<=", plan(df.select(full_width(F.col("t")))))  # each begins with a character
