"""The query catalogue: one function for each operator or group of operators, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.functions import masking
from quireline.functions.normalizing import collapsed, full_width, spaced
from quireline.functions.sentences import sentences
from quireline.functions.text import document_id, lines, segment_hash, with_terminator_parts
from quireline.functions.values import INLINE, LEXICON
from quireline.operators import checks, context, memory, rendering, reports, selection, terms
from quireline.operators.alignment import carry_over
from quireline.operators.assembly import nodes_of, segments_of
from quireline.operators.segment_markdown import segment_markdown
from quireline.operators.segment_text import is_chapter, paragraph_mode, segment_text
from quireline.plans.extract import reused, segmented
from quireline.plans.translate import stub_provider, translate
from quireline.sources.documents import decoded
from quireline.sources.state import scratch_folder, written
from quireline.streaming.ingest import read_stream, stream_reuse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


#: Tables of up to so many bytes a core are dealt anew before costly text work: they may lie in one row group, which one task reads.
SPREAD_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; a large one as it is read, as it has row groups enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES * cores else df


# ---- inputs that several queries share -------------------------------------------------------------

#: Terms of the invented English of ``documents``; they stand in for a project's lists.
DNT = ("tion", "the", "and")
GLOSSARY = (
    {"source": "that", "target": "the", "forbidden": ("ing", "ou"), "severity": "error"},
    {"source": "with", "target": "zu", "forbidden": (), "severity": "warn"},
    {"source": "of", "target": "", "forbidden": ("###",), "severity": "error"},
)


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(lines(F.coalesce("text", F.lit("")))).alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("long"))


LINES = r"""
lines AS (
  SELECT doc_id, lang, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, lang, string_split(regexp_replace(coalesce(text, ''), '\n\z', ''), chr(10)) AS l FROM documents)
)"""

LETTER = r"[A-Za-zÀ-ɏ㐀-䶿一-鿿豈-﫿]"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each conversation: its turns, a blank line between them."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x.text), "\n\n").alias("text"))


CONVERSATIONS = r"""
convs AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id),
conv_lines AS (
  SELECT conv_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT conv_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM convs)
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, target): each user turn and the turn after it; a join on the conversation and the turn's number."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    told = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    joined = asked.join(told, ["conv_id", "turn"], "left")
    return joined.select(F.concat_ws("/", "conv_id", "turn").alias("id"), "source", "target")


PAIRS = """
pairs AS (
  SELECT u.conv_id || '/' || u.turn AS id, u.text AS source, a.text AS target
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, target): each document and, as its wording, the next document's text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("target"))
    return docs.select("doc_id", F.col("text").alias("source")).join(other, "doc_id").withColumnRenamed("doc_id", "id")


DOCUMENT_PAIRS = "pairs AS (SELECT d.doc_id AS id, d.text AS source, n.text AS target FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1)"


def counted(df: DataFrame, issues: Column) -> DataFrame:
    """(id, rule, severity, n) of the issues of each row."""
    found = df.select("id", F.explode(issues).alias("x"))
    return found.groupBy("id", F.col("x.rule").alias("rule"), F.col("x.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``documents`` as segments, with the columns that stored ones have."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    out = segments_of(segment_text(docs, mode="line").select("doc_id", "lang", "host", "segments"), "doc_id", "lang", "host")
    null = F.lit(None).cast("string")
    return out.withColumns({"context": F.col("kind"), "variant": null, "tone": null, "slots": masking.plain_slots(F.col("originals"))})


#: Segments of documents in SQL; a line of nothing but a URL has none.
SEGMENTS = (
    LINES
    + rf""", segs AS (
  SELECT doc_id, lang, line AS source, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos
  FROM lines WHERE regexp_matches(regexp_replace(line, 'https?://[^\s)\]<>]+', '', 'g'), '{LETTER}')
)"""
)

# ---- segmentation -----------------------------------------------------------------------------------


@query("q01_split_lines", f"WITH {LINES} SELECT doc_id, pos, length(line)::BIGINT AS n_chars FROM lines")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select("doc_id", "pos", F.length("line").cast("long").alias("n_chars"))


@query(
    "q02_paragraph_mode",
    f"""WITH {LINES}, {CONVERSATIONS},
every AS (SELECT 'document' AS kind, doc_id AS id, pos, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM lines
          UNION ALL SELECT 'conversation', conv_id, pos, trim(line, ' ' || chr(9) || chr(13)) = '' FROM conv_lines),
ends AS (SELECT kind, id, min(pos) FILTER (WHERE NOT blank) AS a, max(pos) FILTER (WHERE NOT blank) AS b FROM every GROUP BY kind, id)
SELECT kind, id, CASE WHEN count(*) FILTER (WHERE blank AND pos BETWEEN a AND b) > 0 THEN 'blank-line' ELSE 'line' END AS paragraph_mode
FROM every JOIN ends USING (kind, id) GROUP BY kind, id""",
)
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    every = docs.union(conversations(spark, sf_dir).select(F.lit("conversation"), "conv_id", "text"))
    return every.select("kind", "id", paragraph_mode(F.col("text")).alias("paragraph_mode"))


@query(
    "q03_blank_line_paragraphs",
    f"""WITH {CONVERSATIONS},
flagged AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM conv_lines),
islands AS (SELECT *, sum(blank::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS island FROM flagged),
blocks AS (SELECT conv_id, min(pos) AS first, string_agg(line, chr(10) ORDER BY pos) AS source FROM islands WHERE NOT blank GROUP BY conv_id, island)
SELECT conv_id, 's' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY first))::VARCHAR, 4, '0') AS id, substr(sha1(source), 1, 12) AS hash
FROM blocks WHERE regexp_matches(source, '{LETTER}')""",
)
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_of(segment_text(conversations(spark, sf_dir), mode="blank-line"), "conv_id").select("conv_id", "id", "hash")


@query("q04_segment_hash", f"WITH {LINES} SELECT doc_id, pos, substr(sha1(line), 1, 12) AS hash FROM lines")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select("doc_id", "pos", segment_hash(F.col("line")).alias("hash"))


@query("q05_segment_ids", f"WITH {SEGMENTS} SELECT doc_id, 's' || lpad(pos::VARCHAR, 4, '0') AS id, substr(sha1(source), 1, 12) AS hash FROM segs")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_segments(spark, sf_dir).select("doc_id", "id", "hash")


@query(
    "q06_chapter_heading",
    """SELECT n_nationkey, n_nationkey % 4 <> 3 AS chapter FROM nation""",
)
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("Chapter "), k + 1)).when(k % 4 == 1, F.concat(F.lit("PART two: "), "n_name")).when(k % 4 == 2, "  Epilogue").otherwise(F.concat(F.lit("The chapter "), k))
    return n.select("n_nationkey", is_chapter(text).alias("chapter"))


# ---- masking ----------------------------------------------------------------------------------------


def mask_sql(source: str, terms_: tuple[str, ...] = ()) -> str:
    """SQL that masks ``source`` (a query of id and s), pattern by pattern; the two patterns after ``]`` need a look-behind that it has not."""
    patterns = [p for name, p in INLINE if name not in ("linkdest", "refdest")]
    plain = [p.replace(r"\x{", r"\x{").replace(r"\p{Nd}", r"\d") for p in patterns] + [rf"\b{t}\b" for t in terms_]
    steps = [f"s0 AS (SELECT id, s, 0 AS n FROM ({source}))"]
    for k, p in enumerate(plain):
        quoted = p.replace("'", "''")
        steps.append(
            f"s{k + 1} AS (SELECT id, n + len(h) AS n, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i <= len(h) THEN '⟦' || (n + i) || '⟧' ELSE '' END), '') AS s "
            f"FROM (SELECT id, n, string_split_regex(s, '{quoted}') AS p, regexp_extract_all(s, '{quoted}') AS h FROM s{k}))"
        )
    return ", ".join(steps) + f", masked AS (SELECT id, s, n FROM s{len(plain)})"


@query("q07_mask_documents", f"WITH {mask_sql('SELECT doc_id AS id, text AS s FROM documents')} SELECT id AS doc_id, n::BIGINT AS n_slots, sha1(s) AS masked_sha1 FROM masked")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", masking.masked(F.col("text")).alias("m"))
    return m.select("doc_id", F.size("m.originals").cast("long").alias("n_slots"), F.sha1(F.col("m.text").cast("binary")).alias("masked_sha1"))


@query("q08_mask_html", f"WITH {mask_sql('SELECT page_id AS id, html AS s FROM pages')} SELECT id AS page_id, n::BIGINT AS n_slots, sha1(s) AS masked_sha1 FROM masked")
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "pages").select("page_id", masking.masked(F.col("html")).alias("m"))
    return m.select("page_id", F.size("m.originals").cast("long").alias("n_slots"), F.sha1(F.col("m.text").cast("binary")).alias("masked_sha1"))


@query("q09_mask_terms", f"WITH {mask_sql('SELECT doc_id AS id, text AS s FROM documents', ('tion', 'and', 'the'))} SELECT id AS doc_id, n::BIGINT AS n_slots, sha1(s) AS masked_sha1 FROM masked")
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", masking.masked(F.col("text"), masking.term_order(DNT)).alias("m"))
    return m.select("doc_id", F.size("m.originals").cast("long").alias("n_slots"), F.sha1(F.col("m.text").cast("binary")).alias("masked_sha1"))


@query(
    "q10_placeholder_ids",
    f"""WITH {mask_sql('SELECT page_id AS id, html AS s FROM pages')}
SELECT id AS page_id, array_to_string(regexp_extract_all(s, '⟦(\\d+)⟧', 1), ',') AS ids, length(regexp_replace(s, '⟦\\d+⟧', ' ', 'g'))::BIGINT AS plain_chars FROM masked""",
)
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "pages").select("page_id", masking.masked(F.col("html")).text.alias("m"))
    return m.select("page_id", F.array_join(masking.placeholder_ids(F.col("m")), ",").alias("ids"), F.length(masking.without_placeholders(F.col("m"))).cast("long").alias("plain_chars"))


@query("q10b_unmask_round_trip", "SELECT page_id, sha1(html) AS html_sha1 FROM pages")
def q10b(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "pages").select("page_id", masking.masked(F.col("html"), DNT).alias("m"))
    return m.select("page_id", F.sha1(masking.unmasked(F.col("m.text"), F.col("m.originals")).cast("binary")).alias("html_sha1"))


#: Each page's tags when its other spans have been taken. In pages whose tags nest, a closing tag closes one of its name that
#: is open, so of each name as many stay alone as closing ones come too early.
TAGS = rf"""{mask_sql('SELECT page_id AS id, html AS s FROM pages')},
each AS (SELECT id, unnest(t) AS tag, generate_subscripts(t, 1) AS i FROM (SELECT id, regexp_extract_all(s, '</?[A-Za-z][A-Za-z0-9-]*(?:[ \t\n\r][^<>]*)?/?>') AS t FROM s5)),
steps AS (SELECT id, i, lower(regexp_extract(tag, '</?([A-Za-z][A-Za-z0-9-]*)', 1)) AS name, CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END AS d FROM each WHERE tag NOT LIKE '%/>'),
depth AS (SELECT *, sum(d) OVER (PARTITION BY id, name ORDER BY i) AS level FROM steps),
names AS (SELECT id, name, count(*) FILTER (WHERE d < 0) + least(0, min(level)) AS pairs FROM depth GROUP BY id, name),
tags AS (SELECT s5.id AS page_id, (s6.n - s5.n)::BIGINT AS n_tags, coalesce((SELECT sum(pairs) FROM names WHERE names.id = s5.id), 0)::BIGINT AS n_pairs FROM s5 JOIN s6 USING (id))"""


@query("q10c_tag_slots", f"WITH {TAGS} SELECT page_id, n_tags, n_pairs, 2 * n_pairs AS n_halves FROM tags")
def q10c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each page, pairs of them, and slots that stand in a pair with one of either role."""
    tag = rf"^(?:{dict(INLINE)['htmltag']})\z"
    m = table(spark, sf_dir, "pages").select("page_id", masking.masked(F.col("html")).originals.alias("o"))
    slots = m.select("page_id", F.map_values(masking.tag_slots(F.col("o"))).alias("s"))
    pairs = F.array_distinct(F.filter(F.transform("s", lambda s: s.pair_id), lambda p: p.isNotNull()))
    whole = F.filter(pairs, lambda p: F.size(F.array_distinct(F.transform(F.filter("s", lambda s: s.pair_id == p), lambda s: s.role))) == 2)
    halves = F.size(F.filter("s", lambda s: s.pair_id.isNotNull() & ~s.can_reorder))
    return slots.select("page_id", F.size(F.filter("s", lambda s: s.original.rlike(tag))).cast("long").alias("n_tags"), F.size(whole).cast("long").alias("n_pairs"), halves.cast("long").alias("n_halves"))


@query("q10d_repair_placeholders", "SELECT p_partkey, '⟦' || p_partkey || '⟧ x ⟦' || (p_partkey % 10) || '⟧' AS repaired FROM part")
def q10d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey").cast("string")
    digit = (F.col("p_partkey") % 10).cast("string")
    wide = F.translate(digit, "0123456789", "０１２３４５６７８９")
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("【"), p, F.lit("】"))).otherwise(F.concat(F.lit("[[ "), p, F.lit(" ]]"))), F.lit(" x ⟦ "), wide, F.lit(" ⟧"))
    return table(spark, sf_dir, "part").select("p_partkey", masking.repaired(text).alias("repaired"))


# ---- checks -----------------------------------------------------------------------------------------


@query("q11_check_missing", f"WITH {PAIRS} SELECT id, 'missing' AS rule, 'error' AS severity, 1::BIGINT AS n FROM pairs WHERE target IS NULL OR trim(target) = ''")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(pairs(spark, sf_dir), checks.missing_translation(F.col("target")))


NUMBERS = r"""
a AS (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(source, '\d+(?:\.\d+)?')) AS x FROM pairs) GROUP BY id, x),
b AS (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(target, '\d+(?:\.\d+)?')) AS x FROM pairs) GROUP BY id, x),
lost AS (SELECT a.id, a.x, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b USING (id, x) WHERE a.n > coalesce(b.n, 0))"""


@query(
    "q12_check_numbers",
    f"""WITH {DOCUMENT_PAIRS}, {NUMBERS},
each AS (SELECT id, x FROM lost, range(lost.n) r(k))
SELECT id, 'numbers absent from target: [' || string_agg(x, ', ' ORDER BY x) || ']' AS message FROM each GROUP BY id""",
)
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.lost_numbers(F.col("source"), F.col("target"))
    return document_pairs(spark, sf_dir).select("id", F.explode(found).alias("x")).select("id", "x.message")


@query(
    "q13_check_length",
    f"""WITH {PAIRS}, sized AS (SELECT id, length(trim(source, ' ' || chr(10) || chr(9) || chr(13))) AS s, length(trim(target, ' ' || chr(10) || chr(9) || chr(13))) AS t FROM pairs WHERE target IS NOT NULL)
SELECT id, 'length' AS rule, 'warn' AS severity, 1::BIGINT AS n FROM sized WHERE s >= 40 AND (t / s < 0.2 OR t / s > 2.5)""",
)
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(spark, sf_dir).where("target IS NOT NULL")
    return counted(df, checks.length_ratio(F.col("source"), F.col("target"), "fr", {}))


@query(
    "q14_check_untranslated",
    """WITH shown AS (SELECT text, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY text)
SELECT id, 'untranslated' AS rule, 'warn' AS severity, 1::BIGINT AS n FROM shown WHERE n > 1 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 3""",
)
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    copies = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")  # digests are shuffled, not texts
    df = docs.join(copies, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), F.col("text").alias("source"), F.col("text").alias("target"))
    return counted(df, checks.untranslated(F.col("source"), F.col("target")))


@query(
    "q15_check_glossary",
    f"""WITH {DOCUMENT_PAIRS},
rows AS (SELECT * FROM (VALUES ('that', 'the', ['ing', 'ou'], 'error'), ('with', 'zu', []::VARCHAR[], 'warn'), ('of', '', ['###'], 'error')) g(term, want, bad, severity)),
hits AS (SELECT * FROM pairs JOIN rows ON regexp_matches(lower(source), '(^|[^A-Za-z])' || term || '($|[^A-Za-z])')),
found AS (SELECT id, severity FROM hits WHERE want <> '' AND NOT contains(target, want)
          UNION ALL SELECT id, 'error' FROM (SELECT id, target, unnest(bad) AS b FROM hits) WHERE contains(target, b))
SELECT id, 'glossary' AS rule, severity, count(*) AS n FROM found GROUP BY id, severity""",
)
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(document_pairs(spark, sf_dir), checks.glossary(F.col("source"), F.col("target"), GLOSSARY))


@query("q15b_glossary_join", ORACLE["q15_check_glossary"])
def q15b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(g["source"], g["target"], list(g["forbidden"]), g["severity"]) for g in GLOSSARY], "source string, target string, forbidden array<string>, severity string")
    found = checks.glossary_issues(document_pairs(spark, sf_dir), rows)
    return found.groupBy("id", F.lit("glossary").alias("rule"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q16_check_terms",
    f"""WITH {DOCUMENT_PAIRS}, t AS (SELECT unnest(['tion', 'the', 'and']) AS term)
SELECT id, 'dnt' AS rule, 'warn' AS severity, count(*) AS n FROM pairs JOIN t ON contains(source, term) AND NOT contains(target, term) GROUP BY id""",
)
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(document_pairs(spark, sf_dir), checks.lost_terms(F.col("source"), F.col("target"), DNT))


def masked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source): each page's text, masked."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), masking.masked(F.col("html")).text.alias("source"))


@query(
    "q17_check_placeholders",
    f"""WITH {mask_sql('SELECT page_id AS id, html AS s FROM pages')},
told AS (SELECT id, CASE WHEN n > 0 AND id % 3 = 1 THEN '1' ELSE '' END AS lost, CASE WHEN id % 3 = 2 THEN '1, 99999' ELSE '' END AS extra FROM masked)
SELECT id, 'placeholders differ: lost [' || lost || '], extra [' || extra || ']' AS message FROM told WHERE lost <> '' OR extra <> ''""",
)
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose first placeholder is lost, or that gain two, beside pages whose wording is as masked."""
    k, s = F.col("id") % 3, F.col("source")
    target = F.when(k == 1, F.replace(s, F.lit("⟦1⟧"), F.lit(""))).when(k == 2, F.concat(s, F.lit("⟦1⟧ ⟦99999⟧"))).otherwise(s)
    return masked_pages(spark, sf_dir).select("id", F.explode(checks.placeholder_sets(s, target)).alias("x")).select("id", "x.message")


@query("q18_check_pairs", f"WITH {TAGS} SELECT page_id, 'tags' AS rule, n_pairs AS n FROM tags WHERE n_pairs > 0")
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose wording has all placeholders in reverse order, so that each pair of tags is inverted."""
    m = table(spark, sf_dir, "pages").select("page_id", masking.masked(F.col("html")).alias("m")).select("page_id", "m.text", masking.tag_slots(F.col("m.originals")).alias("slots"))
    backwards = F.array_join(F.reverse(F.transform(masking.placeholder_ids(F.col("text")), lambda k: F.concat(F.lit("⟦"), k, F.lit("⟧")))), " ")
    found = m.select("page_id", F.explode(checks.tag_pairs(backwards, F.col("slots"))).alias("x"))
    return found.groupBy("page_id", F.col("x.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


#: Document lines that begin with a letter, so that none opens a block by itself.
PLAIN_LINES = LINES + r""", plain AS (SELECT doc_id, pos, line FROM lines WHERE regexp_matches(line, '^[A-Za-zÀ-ɏ]') AND NOT contains(line, '|'))"""


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).where(F.col("line").rlike("^[A-Za-zÀ-ɏ]") & ~F.col("line").contains("|"))


@query(
    "q19_check_containment",
    f"""WITH {PLAIN_LINES}
SELECT doc_id, pos, 'containment' AS rule, 'error' AS severity, CASE pos % 8 WHEN 1 THEN 'the target has more lines than a heading may have' WHEN 2 THEN 'the target contains a blank line, which ends the block it sits in'
  WHEN 3 THEN 'the target opens a list; the source does not' WHEN 4 THEN 'line 2 of the target opens a blockquote; a translation may not add a block' WHEN 5 THEN 'the target adds a ''|'', which starts a new table column'
  WHEN 6 THEN 'the target opens a heading; the source does not' ELSE 'line 2 of the target opens a setext heading; a translation may not add a block' END AS message FROM plain WHERE pos % 8 > 0""",
)
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plain line of the documents, its wording leaving its block in one of seven ways or not at all."""
    k, line = F.col("pos") % 8, F.col("line")
    kind = F.when(k == 1, "heading").when(k == 5, "cell").otherwise("para")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    target = F.when(k == 0, line).when(k == 1, put(line, "\nmore")).when(k == 2, put(line, "\n\n", line)).when(k == 3, put("- ", line)).when(k == 4, put(line, "\n> ", line)).when(k == 5, put(line, " | ")).when(k == 6, put("## ", line)).otherwise(put(line, "\n==="))
    found = checks.containment(kind, F.lit("markdown"), line, target)
    return plain_lines(spark, sf_dir).select("doc_id", "pos", F.explode(found).alias("x")).select("doc_id", "pos", "x.*")


@query("q20_check_eol", f"WITH {LINES} SELECT doc_id, pos, 'eol' AS rule FROM lines WHERE pos % 2 = 0 AND NOT contains(line, chr(13))")
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("pos") % 2 == 0, F.concat("line", F.lit("\r"))).otherwise(F.col("line"))
    return doc_lines(spark, sf_dir).select("doc_id", "pos", F.explode(checks.added_cr(F.col("line"), target)).alias("x")).select("doc_id", "pos", "x.rule")


@query(
    "q20b_check_escaping",
    r"""WITH t AS (SELECT page_id, contains(html, '<') AS lt, contains(regexp_replace(html, '&(?:[A-Za-z][A-Za-z0-9]*|#\d+|#[xX][0-9A-Fa-f]+);', '', 'g'), '&') AS amp, contains(html, ']]>') AS cdata FROM pages)
SELECT page_id::VARCHAR AS id, 'escaping' AS rule, 'error' AS severity, (lt::INT + amp::INT + cdata::INT)::BIGINT AS n FROM t WHERE lt OR amp OR cdata""",
)
def q20b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as targets of an XML host: raw signs and character references as they stand in them."""
    df = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), "html")
    return counted(df, checks.escaping(F.col("html"), F.lit("xml")))


#: Document texts with Chinese between their words: what the checks of Chinese wording look at.
CHINESE = r"""
zh AS (SELECT doc_id, replace(replace(replace(replace(text, ' the ', '中文'), ' and ', '中,文'), ' of ', '的 "文" '), ' in ', '軟件視頻 ') AS t FROM documents)"""


def chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    for word, put in ((" the ", "中文"), (" and ", "中,文"), (" of ", '的 "文" '), (" in ", "軟件視頻 ")):
        t = F.replace(t, F.lit(word), F.lit(put))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), t.alias("target"))


@query(
    "q21_check_punctuation",
    rf"""WITH {CHINESE},
found AS (SELECT doc_id, 'half-width ' || chr(39) || regexp_extract(t, '[一-鿿][ \t-\r]*([,;:!?])', 1) || chr(39) || ' after CJK' AS message FROM zh WHERE regexp_matches(t, '[一-鿿][ \t-\r]*[,;:!?]')
  UNION ALL SELECT doc_id, 'straight quotes around CJK' FROM zh WHERE regexp_matches(t, '"[^"]*[一-鿿][^"]*"')
  UNION ALL SELECT doc_id, 'no space between CJK and Latin' FROM zh WHERE regexp_matches(t, '[一-鿿][A-Za-z0-9]|[A-Za-z0-9][一-鿿]'))
SELECT doc_id AS id, message FROM found""",
)
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chinese(spark, sf_dir).select("id", F.explode(checks.punctuation(F.col("target"))).alias("x")).select("id", "x.message")


_FORMS = ", ".join(f"('{bad}', '{severity}')" for bad, _, severity in LEXICON)


@query(
    "q22_check_lexicon",
    f"""WITH {CHINESE}, lex(bad, severity) AS (VALUES {_FORMS})
SELECT doc_id AS id, 'lexicon' AS rule, severity, count(*) AS n FROM zh JOIN lex ON contains(t, bad) GROUP BY doc_id, severity""",
)
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(chinese(spark, sf_dir), checks.lexicon(F.col("target"), "zh-TW"))


# ---- translation memory -----------------------------------------------------------------------------


@query("q23_memory_latest", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return memory.latest(events.withColumn("seq", F.col("event_id")), ("user_id", "event_type"), "seq").select("user_id", "event_type", "value", "event_id")


def cut_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_segments``, cut once and written, for queries that read them twice: each reader then reads its own columns."""
    return written(document_segments(spark, sf_dir), "segments")


def document_memory(segments: DataFrame, legacy: bool = False) -> DataFrame:
    """The memory of the wording (upper case) of every document whose id is even, with digests."""
    s = segments.where("doc_id % 2 = 0")
    none = F.lit(None).cast("string")
    records = s.select(
        "hash", (none if legacy else F.col("context")).alias("context"), F.lit(0 if legacy else 1).alias("segmentation_version"), "variant", "tone", "source",
        F.upper("masked").alias("target"), "originals", F.struct("doc_id", "pos").alias("seq"),
    ).withColumnRenamed("originals", "slots").withColumn("digest", memory.digest())
    return memory.latest(memory.keyed(records))


@query(
    "q24_memory_exact",
    f"""WITH {SEGMENTS}, known AS (SELECT DISTINCT source FROM segs WHERE doc_id % 2 = 0)
SELECT doc_id, pos::INTEGER AS pos, CASE WHEN k.source IS NOT NULL THEN 'tm' END AS origin FROM segs LEFT JOIN known k USING (source)""",
)
def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = cut_segments(spark, sf_dir)
    return memory.lookup(segments, document_memory(segments)).select("doc_id", "pos", F.col("hit_origin").alias("origin"))


@query(
    "q25_memory_legacy",
    f"""WITH {SEGMENTS}, known AS (SELECT DISTINCT source FROM segs WHERE doc_id % 2 = 0)
SELECT doc_id, pos::INTEGER AS pos, CASE WHEN k.source IS NOT NULL THEN 'tm:legacy' END AS origin FROM segs LEFT JOIN known k USING (source)""",
)
def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = cut_segments(spark, sf_dir)
    return memory.lookup(segments, document_memory(segments, legacy=True)).select("doc_id", "pos", F.col("hit_origin").alias("origin"))


@query(
    "q26_memory_commit",
    f"""WITH {SEGMENTS}, known AS (SELECT DISTINCT source FROM segs WHERE doc_id % 2 = 0)
SELECT DISTINCT substr(sha1(source), 1, 12) AS hash FROM segs WHERE source NOT IN (SELECT source FROM known)""",
)
def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = cut_segments(spark, sf_dir)
    done = segments.withColumn("target", F.upper("masked")).drop("slots").withColumnRenamed("originals", "slots")
    return memory.to_commit(done, document_memory(segments)).select("hash").distinct()


@query(
    "q23b_memory_log",
    """SELECT l_partkey::VARCHAR AS hash, arg_max('wording ' || l_orderkey || '/' || l_linenumber, l_orderkey % 3 * 1000000000000 + l_orderkey * 10 + l_linenumber) AS target, count(*) AS n FROM lineitem GROUP BY l_partkey""",
)
def q23b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory log of three appends, read back: the last wording of each key is that of the last append."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("hash"), F.concat(F.lit("wording "), "l_orderkey", F.lit("/"), "l_linenumber").alias("target"), (F.col("l_orderkey") % 3).alias("turn"), "l_orderkey", "l_linenumber"
    )
    log = scratch_folder(spark, "memory")
    for turn in range(3):
        own = lines.where(F.col("turn") == turn).orderBy("l_orderkey", "l_linenumber")
        memory.append(own.select("hash", "target"), log)
    rows = memory.read_memory(spark, log)
    last = memory.latest(rows.select("hash", "target", "seq"), ("hash",))
    return last.join(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hash").select("hash", "target", "n")


def reuse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: segments, distinct keys, segments that the memory of lower ids answers, and those pending."""
    s = written(document_segments(spark, sf_dir).select("doc_id", "hash", "context"), "keys")
    first = s.groupBy("hash", "context").agg(F.min("doc_id").alias("first"))
    known = s.join(first, ["hash", "context"]).withColumn("reused", F.col("first") < F.col("doc_id"))
    out = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("hash", "context").alias("keys"), F.count_if("reused").alias("reused"))
    return out.withColumn("pending", F.col("segments") - F.col("reused"))


@query(
    "q27_reuse_report",
    f"""WITH {SEGMENTS}, first AS (SELECT source, min(doc_id) AS f FROM segs GROUP BY source)
SELECT doc_id, count(*) AS segments, count(DISTINCT source) AS keys, count(*) FILTER (WHERE f < doc_id) AS reused, count(*) FILTER (WHERE f >= doc_id) AS pending
FROM segs JOIN first USING (source) GROUP BY doc_id""",
)
def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse_report(spark, sf_dir)


@query(
    "q28_id_collisions",
    """WITH l AS (SELECT DISTINCT url AS label, lower(regexp_replace(regexp_replace(url, '[0-9]+', '', 'g'), '[^A-Za-z0-9._-]', '_', 'g')) AS identity FROM pages)
SELECT identity, count(*) AS n, array_to_string(list(label ORDER BY label), ' ') AS labels FROM l GROUP BY identity HAVING count(*) > 1""",
)
def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "pages").select(F.col("url").alias("label"), document_id(F.regexp_replace("url", "[0-9]+", "")).alias("doc_id"))
    return reports.collisions(labels).select("identity", "n", F.array_join("labels", " ").alias("labels"))


# ---- reports and selection --------------------------------------------------------------------------


def checked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and the next one's text as segments of their source, checked by all rules."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host_name"), "lang"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("target"))
    df = docs.withColumnRenamed("text", "source").join(other, "doc_id")
    slots = masking.plain_slots(F.array().cast("array<string>"))
    rules = checks.Rules(lang="de", glossary=GLOSSARY, dnt=DNT)
    found = checks.issues(rules, F.col("source"), F.col("target"), slots, F.lit("para"), F.lit("text"), F.lit(None).cast("string"))
    return df.select(F.col("host_name").alias("doc_id"), "lang", F.col("doc_id").alias("id"), "target", found.alias("issues"))


@query(
    "q29_check_report",
    f"""WITH {DOCUMENT_PAIRS}, {NUMBERS},
rows AS (SELECT * FROM (VALUES ('that', 'the', ['ing', 'ou'], 'error'), ('with', 'zu', []::VARCHAR[], 'warn'), ('of', '', ['###'], 'error')) g(term, want, bad, severity)),
hits AS (SELECT * FROM pairs JOIN rows ON regexp_matches(lower(source), '(^|[^A-Za-z])' || term || '($|[^A-Za-z])')),
sized AS (SELECT id, length(trim(source, ' ' || chr(10) || chr(9) || chr(13))) AS s, length(trim(target, ' ' || chr(10) || chr(9) || chr(13))) AS t FROM pairs),
found AS (
  SELECT id, 'glossary' AS rule, severity FROM hits WHERE want <> '' AND NOT contains(target, want)
  UNION ALL SELECT id, 'glossary', 'error' FROM (SELECT id, target, unnest(bad) AS b FROM hits) WHERE contains(target, b)
  UNION ALL SELECT DISTINCT id, 'numbers', 'error' FROM lost
  UNION ALL SELECT id, 'length', 'warn' FROM sized WHERE s >= 40 AND (t / s < 0.2 OR t / s > 2.5)
  UNION ALL SELECT id, 'dnt', 'warn' FROM pairs JOIN (SELECT unnest(['tion', 'the', 'and']) AS term) ON contains(source, term) AND NOT contains(target, term)
  UNION ALL SELECT id, 'untranslated', 'warn' FROM pairs WHERE trim(source, ' ' || chr(10) || chr(9) || chr(13)) = trim(target, ' ' || chr(10) || chr(9) || chr(13)) AND len(list_filter(regexp_split_to_array(source, '\\s+'), lambda w: w <> '')) >= 3
  UNION ALL SELECT id, 'containment', 'error' FROM pairs WHERE len(list_filter(string_split(target, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13)) = '')) > 0 AND len(list_filter(string_split(source, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13)) = '')) = 0
), held AS (SELECT d.source AS doc_id, d.lang, pairs.id, target FROM pairs JOIN documents d ON d.doc_id = pairs.id),
counts AS (SELECT doc_id, lang, rule, severity, count(*) AS n FROM found JOIN held USING (id) GROUP BY doc_id, lang, rule, severity),
sums AS (SELECT doc_id, lang, sum(n) FILTER (WHERE severity = 'error') AS e, sum(n) FILTER (WHERE severity = 'warn') AS w FROM counts GROUP BY doc_id, lang),
ruled AS (SELECT doc_id, lang, string_agg(rule || ':' || n, ',' ORDER BY rule) AS by_rule FROM (SELECT doc_id, lang, rule, sum(n)::BIGINT AS n FROM counts GROUP BY doc_id, lang, rule) GROUP BY doc_id, lang),
whole AS (SELECT doc_id, lang, count(*) AS segments, count(*) FILTER (WHERE target <> '') AS translated FROM held GROUP BY doc_id, lang)
SELECT w.doc_id, w.lang, segments, translated, coalesce(e, 0)::BIGINT AS errors, coalesce(s.w, 0)::BIGINT AS warnings, coalesce(by_rule, '') AS by_rule
FROM whole w LEFT JOIN sums s ON s.doc_id IS NOT DISTINCT FROM w.doc_id AND s.lang IS NOT DISTINCT FROM w.lang LEFT JOIN ruled r ON r.doc_id IS NOT DISTINCT FROM w.doc_id AND r.lang IS NOT DISTINCT FROM w.lang""",
)
def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_join(F.transform(F.array_sort(F.map_entries("by_rule")), lambda e: F.concat(e.key, F.lit(":"), e.value.cast("string"))), ",")
    return reports.check_reports(checked_pairs(spark, sf_dir)).withColumn("by_rule", told)


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with made-up counts: the reports' inputs."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("project"), "lang", "doc_id", F.col("n_chars").alias("segments"), (F.col("n_chars") % 7).alias("translated"), (F.col("n_chars") - F.col("n_chars") % 7).alias("pending"),
        (F.col("doc_id") % 2).alias("held"), (F.col("doc_id") % 3 == 0).alias("checked"), (F.col("doc_id") % 5).alias("errors"), (F.col("doc_id") % 4).alias("warnings"),
    )


@query(
    "q30_rollup",
    """SELECT source AS project, lang, count(*) AS documents, count(*) FILTER (WHERE doc_id % 3 = 0) AS checked_documents, sum(n_chars)::BIGINT AS segments, sum(n_chars % 7)::BIGINT AS translated,
  sum(n_chars - n_chars % 7)::BIGINT AS pending, sum(doc_id % 2)::BIGINT AS held,
  coalesce(sum(doc_id % 5) FILTER (WHERE doc_id % 3 = 0), 0)::BIGINT AS errors, coalesce(sum(doc_id % 4) FILTER (WHERE doc_id % 3 = 0), 0)::BIGINT AS warnings
FROM documents GROUP BY GROUPING SETS ((source, lang), (source))""",
)
def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rollup(document_rows(spark, sf_dir))


@query(
    "q31_untracked",
    """WITH c AS (SELECT doc_id, l.lang FROM documents, (VALUES ('de'), ('en'), ('es'), ('fr')) l(lang))
SELECT doc_id::VARCHAR AS doc_id, lang FROM c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.doc_id AND d.lang = c.lang)""",
)
def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang")
    targets = spark.createDataFrame([("de",), ("en",), ("es",), ("fr",)], "lang string")
    return reports.untracked(d.select("doc_id"), targets, d)


def queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document segments with made-up wording, origins and reviews."""
    s = document_segments(spark, sf_dir)
    k = (F.col("doc_id") + F.col("pos")) % 6
    return s.withColumns(
        {
            "target": F.when(k == 0, F.lit(None).cast("string")).when(k == 1, " ").otherwise(F.upper("masked")),
            "origin": F.when(k == 2, "human").when(k == 1, "human").otherwise("agent"),
            "review": F.when(k == 3, "held"),
        }
    )


@query(
    "q32_select_draft",
    f"""WITH {SEGMENTS}, q AS (SELECT doc_id, pos, (doc_id + pos) % 6 AS k FROM segs), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM q WHERE k < 2)
SELECT doc_id, 's' || lpad(pos::VARCHAR, 4, '0') AS id FROM n WHERE r <= 3 AND k <> 1""",
)
def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select(queued(spark, sf_dir), "draft", limit=3).select("doc_id", "id")


@query("q33_select_polish", f"WITH {SEGMENTS} SELECT doc_id, 's' || lpad(pos::VARCHAR, 4, '0') AS id FROM segs WHERE (doc_id + pos) % 6 IN (4, 5)")
def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select(queued(spark, sf_dir), "polish").select("doc_id", "id")


def proposed(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    """Outcomes of a proposal for each segment, on another base for every second one, and of one for a missing segment."""
    token = segment_hash(F.coalesce("target", F.lit("")))
    incoming = s.select("doc_id", "id", F.lit("new wording").alias("text"), F.when(F.col("pos") % 2 == 0, "other").otherwise(token).alias("base"))
    nobody = table(spark, sf_dir, "documents").select("doc_id", F.lit("none").alias("id"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("base"))
    return selection.apply(s, incoming.union(nobody), "de").select("doc_id", "id", "outcome")


@query(
    "q34_apply_conflicts",
    f"""WITH {SEGMENTS}
SELECT doc_id, 's' || lpad(pos::VARCHAR, 4, '0') AS id, CASE WHEN pos % 2 = 0 THEN 'conflict' ELSE 'applied' END AS outcome FROM segs
UNION ALL SELECT doc_id, 'none', 'unknown' FROM documents""",
)
def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposed(spark, sf_dir, queued(spark, sf_dir))


@query("q35_stale_reports", "SELECT doc_id, lang, doc_id % 2 = 0 AS checked, doc_id % 4 = 0 AS stale FROM documents")
def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_rows(spark, sf_dir).select("doc_id", "lang", "segments", "translated", "errors", "warnings")
    r = d.where("doc_id % 2 = 0").withColumn("segments", F.when(F.col("doc_id") % 4 == 0, F.col("segments") + 1).otherwise(F.col("segments")))
    return reports.with_reports(d, r).select("doc_id", "lang", "checked", "stale")


# ---- context and rendering --------------------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("id"), F.lit("para").alias("kind"), F.col("text").alias("masked"))


@query(
    "q36_neighbours",
    """WITH t AS (SELECT conv_id AS doc_id, turn AS pos, 's' || turn AS id FROM conversations)
SELECT doc_id, pos, coalesce(string_agg(id, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(id, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM t""",
)
def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = context.neighbours(turns(spark, sf_dir), 2)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.id), " ").alias(c)
    return df.select("doc_id", "pos", ids("before"), ids("after"))


@query("q37_batches", f"WITH {SEGMENTS} SELECT doc_id, (pos - 1) // 25 AS batch, count(*) AS n FROM segs GROUP BY doc_id, (pos - 1) // 25")
def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.batches(document_segments(spark, sf_dir)).groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q38_in_batch_reference",
    """WITH t AS (SELECT conv_id AS doc_id, turn AS pos, 's' || turn AS id, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch FROM conversations),
n AS (SELECT *, lag(id) OVER w AS bi, lag(batch) OVER w AS bb, lag(text) OVER w AS bt, lead(id) OVER w AS ai, lead(batch) OVER w AS ab, lead(text) OVER w AS a FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, CASE WHEN bb = batch THEN bi END AS before_id, CASE WHEN bb <> batch AND bt <> '' THEN bt END AS before_text,
  CASE WHEN ab = batch THEN ai END AS after_id, CASE WHEN ab <> batch AND a <> '' THEN a END AS after_text FROM n""",
)
def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = context.referenced(context.batches(context.neighbours(turns(spark, sf_dir), 1), 2))
    return df.select("doc_id", "pos", "before_id", "before_text", "after_id", "after_text")


@query(
    "q39_terminology",
    rf"""WITH g(term, want) AS (VALUES ('that', 'the'), ('with', 'zu')),
t AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch, lower(text) AS low FROM conversations),
hits AS (SELECT DISTINCT doc_id, batch, term || ' -> ' || want AS h FROM t JOIN g ON regexp_matches(low, '(^|[^A-Za-zÀ-ÖØ-öø-ɏ])' || term || '($|[^A-Za-zÀ-ÖØ-öø-ɏ])'))
SELECT t.doc_id, t.batch, coalesce(string_agg(DISTINCT h, '; ' ORDER BY h), '') AS terms FROM t LEFT JOIN hits ON hits.doc_id = t.doc_id AND hits.batch = t.batch GROUP BY t.doc_id, t.batch""",
)
def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = context.referenced(context.batches(context.neighbours(turns(spark, sf_dir), 1), 2))
    return context.requests(df, GLOSSARY).select("doc_id", "batch", F.array_join("terms", "; ").alias("terms"))


@query("q40_render", f"WITH {CONVERSATIONS} SELECT conv_id, sha1(replace(text, chr(10), chr(13) || chr(10))) AS text_sha1 FROM convs")
def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segment_text(conversations(spark, sf_dir), mode="blank-line").select("conv_id", "segments", "nodes")
    segments = segments_of(cut, "conv_id").withColumn("target", F.lit(None).cast("string"))
    blocks = rendering.render_blocks(nodes_of(cut, "conv_id"), segments, fallback=True, keys=("conv_id",))
    return rendering.render(blocks, "\r\n", keys=("conv_id",)).select("conv_id", F.sha1(F.col("text").cast("binary")).alias("text_sha1"))


@query(
    "q40b_terminator_parts",
    "SELECT n_nationkey, n_name || chr(13) || chr(10) || n_name || chr(13) || chr(10) || chr(13) || chr(10) AS joined, n_name AS first FROM nation",
)
def q40b(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.concat("n_name", F.lit("\r")), F.lit(""), F.concat(F.lit("\n"), "n_name", F.lit("\n")), F.lit("\r\n"))
    df = table(spark, sf_dir, "nation").select("n_nationkey", with_terminator_parts(parts, F.lit("\r\n")).alias("p"))
    return df.select("n_nationkey", F.array_join("p", "").alias("joined"), F.element_at("p", 1).alias("first"))


@query(
    "q41_spacing",
    r"""SELECT doc_id, regexp_replace(regexp_replace('中文' || replace(text, chr(10), '文' || chr(10) || '中') || '文字', '([一-鿿])([A-Za-z0-9$])', '\1 \2', 'g'), '([A-Za-z0-9%$)])([一-鿿])', '\1 \2', 'g') AS spaced FROM documents""",
)
def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, with Chinese around each of their lines."""
    lines = F.replace(F.col("text"), F.lit("\n"), F.lit("文\n中"))
    return table(spark, sf_dir, "documents").select("doc_id", spaced(F.concat(F.lit("中文"), lines, F.lit("文字"))).alias("spaced"))


@query(
    "q42_collapse_space",
    r"""SELECT doc_id, sha1(regexp_replace(regexp_replace(replace(text, ' ', chr(9) || ' '), '([^ \t\n])[ \t]+\n', '\1' || chr(10), 'g'), '([^ \t\n])[ \t]{2,}', '\1 ', 'g')) AS collapsed_sha1 FROM documents WHERE NOT regexp_matches(text, '(^|\n)[ \t]|[ \t](\n|$)|[ \t][ \t]')""",
)
def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose single blanks have become a tab and a blank, collapsed again."""
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(^|\n)[ \t]|[ \t](\n|\z)|[ \t][ \t]"))
    return docs.select("doc_id", F.sha1(collapsed(F.replace("text", F.lit(" "), F.lit("\t "))).cast("binary")).alias("collapsed_sha1"))


@query(
    "q42b_full_width",
    r"""SELECT doc_id, sha1('中文，文字；好：（文' || regexp_replace(text, '[,;:!?()" ]', '', 'g') || '）。') AS wide_sha1 FROM documents""",
)
def q42b(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.regexp_replace("text", '[,;:!?()" ]', "")
    text = F.concat(F.lit("中文,文字;好: (文"), inner, F.lit(")  。"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.sha1(full_width(text).cast("binary")).alias("wide_sha1"))


# ---- what SQL does not say --------------------------------------------------------------------------


@query(
    "q43_encoding_detect",
    r"""WITH t AS (SELECT doc_id, text, doc_id % 4 AS k, doc_id % 4 = 3 AND regexp_full_match(text, '[\x{00}-\x{FF}]*') AND NOT regexp_full_match(text, '[\x{00}-\x{7F}]*') AS narrow FROM documents)
SELECT doc_id, CASE WHEN k = 1 THEN 'utf-16-le' WHEN narrow THEN 'cp1252' ELSE 'utf-8' END AS encoding, sha1(CASE WHEN k IN (1, 2) THEN chr(65279) ELSE '' END || text) AS text_sha1, NULL::VARCHAR AS error FROM t""",
)
def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes of four encodings, found out again: UTF-8, UTF-16 and UTF-8 with a mark, and one byte a character."""
    t, k = F.col("text"), F.col("doc_id") % 4
    marked = lambda charset: F.encode(F.concat(F.lit("﻿"), t), charset)
    narrow = F.encode(F.when(t.rlike(r"^[\x00-\xFF]*\z"), t), "ISO-8859-1")
    content = F.when(k == 1, marked("UTF-16LE")).when(k == 2, marked("UTF-8")).when((k == 3) & narrow.isNotNull(), narrow).otherwise(F.encode(t, "UTF-8"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", decoded(content, ("utf-8", "cp1252")).alias("d"))
    return docs.select("doc_id", "d.encoding", F.sha1(F.col("d.text").cast("binary")).alias("text_sha1"), "d.error")


#: Sentences in SQL, for texts without placeholders: pieces that end in marks, and whether each end is a sentence's.
SENTENCES = r"""
pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？.!?…⋯]*[。！？.!?…⋯]+[’”»›」』〉》】〕｝）)\]}]*(?:["''*_~]+(?:\s+|$)|\s*)|[^。！？.!?…⋯]+$') AS p FROM documents)
), told AS (
  SELECT *, regexp_extract(piece, '[。！？.!?…⋯]+') AS marks, substr(lead(piece) OVER w, 1, 1) AS first,
    regexp_extract(piece, '([A-Za-zÀ-ɏ]?[A-Za-zÀ-ɏ''’-]*)[。！？.!?…⋯]', 1) AS word, regexp_matches(piece, '\.[’”»›」』〉》】〕｝）)\]}"''*_~]*\s') AS spaced
  FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ends AS (
  SELECT *, marks <> '' AND (first IS NULL OR (
      (marks <> '.' OR (spaced AND word NOT IN ('Mr','Mrs','Ms','Dr','Prof','St','Sr','Jr','Mt','Capt','Lt','Sgt','Col','Gen','Rev','Hon') AND NOT (length(word) = 1 AND upper(word) = word AND lower(word) <> word)))
      AND NOT contains('，、；：,;:」』〉》】〕｝）)]}', first)
      AND CASE WHEN regexp_matches(marks, '[。！？.!?]') THEN NOT (lower(first) = first AND upper(first) <> first) ELSE contains('「『（《〈【〔｛“‘"''([{', first) OR (upper(first) = first AND lower(first) <> first) END)) AS ends
  FROM told
), numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ends),
split AS (SELECT doc_id, s, string_agg(piece, '' ORDER BY i) AS sentence FROM numbered GROUP BY doc_id, s)"""


@query("q44_sentences", f"WITH {SENTENCES} SELECT doc_id, count(*) AS n, sha1(string_agg(sentence, chr(31) ORDER BY s)) AS split_sha1 FROM split GROUP BY doc_id")
def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document, by a digest of them with a mark in between, and their number."""
    df = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return df.select("doc_id", F.size("s").cast("long").alias("n"), F.sha1(F.array_join("s", "\x1f").cast("binary")).alias("split_sha1"))


@query("q45_terms")
def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = document_segments(spark, sf_dir).where("lang = 'en'").select(F.lit(0).alias("book"), F.struct("doc_id", "pos").alias("pos"), F.concat_ws("/", "doc_id", "id").alias("id"), "masked")
    found = terms.candidate_terms(s, keys=("book",))
    return terms.unknown_terms(found, spark.createDataFrame([("The",), ("And",)], "source string")).select("source", "count", "mid_sentence", F.array_join("examples", " ").alias("examples"))


def markdown_text() -> Column:
    """A heading of r_name, a quotation, a table of the nations n, a list of the parts p and a code block."""
    return F.concat(
        F.lit("# "), "r_name", F.lit("\n\n> A region with `code`.\n\n| nation | n |\n| --- | --- |\n"),
        F.array_join(F.transform("n", lambda x: F.concat(F.lit("| "), x, F.lit(" | 1 |\n"))), ""), F.lit("\n"),
        F.array_join(F.transform("p", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), F.lit("\n```\ncode\n```\n"),
    )


def markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document for each run of 100 part keys: a heading, a quotation, a table of a region's nations and a list of the parts."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    regions = table(spark, sf_dir, "region").join(nations, "r_regionkey")
    runs = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 100").alias("doc_id")).agg(F.array_sort(F.collect_list("p_name")).alias("p"))
    rows = runs.join(F.broadcast(regions), F.col("doc_id") % 5 == F.col("r_regionkey"))
    return rows.select("doc_id", markdown_text().alias("text"))


@query(
    "q46_markdown_segments",
    """WITH d AS (SELECT DISTINCT (p_partkey // 100)::BIGINT AS doc_id FROM part), r AS (SELECT doc_id, r_regionkey, r_name FROM d JOIN region ON r_regionkey = doc_id % 5),
every AS (
  SELECT doc_id, 1 AS a, 0 AS b, 'heading' AS kind, r_name AS source FROM r
  UNION ALL SELECT doc_id, 2, 0, 'quote', 'A region with `code`.' FROM r
  UNION ALL SELECT doc_id, 3, 0, 'cell', 'nation' FROM r UNION ALL SELECT doc_id, 3, 1, 'cell', 'n' FROM r
  UNION ALL SELECT doc_id, 4, row_number() OVER (PARTITION BY doc_id ORDER BY n_name), 'cell', n_name FROM r JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT (p_partkey // 100)::BIGINT, 5, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_name), 'list', p_name FROM part)
SELECT doc_id, 's' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY a, b))::VARCHAR, 4, '0') AS id, kind, source, substr(sha1(source), 1, 12) AS hash FROM every""",
)
def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of Markdown documents that hold every part: order, kind, text and hash."""
    return segments_of(segment_markdown(markdown_parts(spark, sf_dir)), "doc_id").select("doc_id", "id", "kind", "source", "hash")


@query("q46b_markdown_round_trip", "SELECT DISTINCT (p_partkey // 100)::BIGINT AS doc_id, true AS same FROM part")
def q46b(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segment_markdown(markdown_parts(spark, sf_dir))
    blocks = rendering.render_blocks(nodes_of(cut, "doc_id"), segments_of(cut, "doc_id").withColumn("target", F.lit(None).cast("string")), fallback=True, keys=("doc_id",))
    back = rendering.render(blocks, keys=("doc_id",)).withColumnRenamed("text", "back")
    return cut.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"))


@query(
    "q47_reseat",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' ⟦2⟧ und ⟦1⟧' END AS text, CASE WHEN n_nationkey % 2 = 1 THEN '1 of ''`b`'' wanted, 0 free in the wording' END AS why FROM nation""",
)
def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = lambda *xs: masking.plain_slots(F.array(*map(F.lit, xs)))
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" ⟦1⟧ und ⟦2⟧")).alias("text"))
    df = df.withColumns({"was": slots("`a`", "Go"), "now": F.when(F.col("n_nationkey") % 2 == 0, slots("Go", "`a`")).otherwise(slots("Go", "`b`"))})
    return df.select("n_nationkey", masking.reseated(F.col("text"), F.col("was"), F.col("now")).alias("r")).select("n_nationkey", "r.*")


@query("q48_align")
def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cut_segments(spark, sf_dir).withColumn("key", F.col("hash"))
    prior = s.withColumn("target", F.when(F.col("pos") % 3 > 0, F.upper("masked")))
    fresh = s.where("pos % 5 <> 2")
    return carry_over(prior, fresh).select("doc_id", "id", "from_pos", "ambiguous")


@query(
    "q49_accept",
    f"""WITH {SEGMENTS}, known AS (SELECT DISTINCT source FROM segs WHERE doc_id % 2 = 0),
flagged AS (SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM lines),
filled AS (SELECT doc_id, min(pos) FILTER (WHERE NOT blank) AS a, max(pos) FILTER (WHERE NOT blank) AS b FROM flagged GROUP BY doc_id),
spaced AS (SELECT doc_id, count(*) FILTER (WHERE blank AND pos BETWEEN a AND b) > 0 AS by_blank FROM flagged JOIN filled USING (doc_id) GROUP BY doc_id),
islands AS (SELECT *, CASE WHEN by_blank THEN sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY pos) ELSE pos END AS island FROM flagged JOIN spaced USING (doc_id)),
blocks AS (SELECT doc_id, min(pos) AS pos, string_agg(line, chr(10) ORDER BY pos) AS source FROM islands WHERE NOT blank GROUP BY doc_id, island),
cuts AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM blocks WHERE regexp_matches(regexp_replace(source, 'https?://[^\\s)\\]<>]+', '', 'g'), '{LETTER}')),
{mask_sql("SELECT doc_id || '/' || n AS id, source AS s FROM cuts")}
SELECT doc_id, 's' || lpad(n::VARCHAR, 4, '0') AS id, CASE WHEN fit THEN 'memory' ELSE 'pending' END AS outcome, CASE WHEN fit THEN 'tm' END AS origin
FROM (SELECT doc_id, cuts.n, k.source IS NOT NULL AND NOT regexp_matches(masked.s, '(^|[^A-Za-z0-9])(tion|the|and)($|[^A-Za-z0-9])') AS fit
  FROM cuts JOIN masked ON masked.id = doc_id || '/' || cuts.n LEFT JOIN known k ON k.source = cuts.source)""",
)
def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that the memory answers; wording in capitals has none of the protected terms that a source may hold, so it is refused there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("technical").alias("tone"), F.lit("text").alias("format"), "text")
    segments, _ = segmented(docs, DNT)
    known = document_memory(document_segments(spark, sf_dir))
    return reused(segments, "zh-TW", memory=known, operations=("punct", "pangu"), dnt=DNT).select("doc_id", "id", "outcome", "origin")


@query(
    "q50_stub_translate",
    f"""WITH {SEGMENTS}, {mask_sql("SELECT doc_id || '/' || pos AS id, source AS s FROM segs WHERE (doc_id + pos) % 6 = 0")}
SELECT split_part(id, '/', 1)::BIGINT AS doc_id, 's' || lpad(split_part(id, '/', 2), 4, '0') AS id, regexp_extract(s, '^[ \t]*') || '[' || trim(s, ' ' || chr(9) || chr(13)) || ']' || regexp_extract(s, '[ \t\r]*$') AS target, 'llm:draft' AS origin, NULL::VARCHAR AS why FROM masked""",
)
def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = written(queued(spark, sf_dir), "queued")  # read for the neighbours and for what is chosen
    return translate(s, selection.select(s, "draft"), "de", stub_provider, glossary=GLOSSARY).select("doc_id", "id", "target", "origin", "why")


@query(
    "q51_stream_reuse",
    f"""WITH {SEGMENTS}, known AS (SELECT DISTINCT source FROM segs WHERE doc_id % 2 = 0)
SELECT doc_id, 's' || lpad(pos::VARCHAR, 4, '0') AS id, CASE WHEN k.source IS NOT NULL THEN 'tm' END AS origin FROM segs LEFT JOIN known k USING (source)""",
)
def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive as a stream, answered from the memory and logged batch by batch."""
    schema = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").schema
    docs = read_stream(spark, f"{sf_dir}/documents.parque[t]", schema)
    out = scratch_folder(spark, "stream")
    known = written(document_memory(document_segments(spark, sf_dir)).select(*memory.KEY, "target", "slots"), "memory")  # not made anew for each batch
    stream_reuse(docs, known, f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/log").select("doc_id", "id", "origin")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


