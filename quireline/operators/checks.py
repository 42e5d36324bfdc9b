"""Mechanical checks of translated segments, as one array of issues for each row.

Every rule is a native expression that gives an array<struct<rule, severity, message>>, empty where
the rule is content; only lines that may be link definitions are tested by an Arrow function.
Lists of terms come as literals (they are short by nature); a long glossary goes through
``glossary_issues``, a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.functions import masking
from quireline.functions.text import is_blank, let, strip
from quireline.functions.values import CJK, DEFAULT_RATIO, HELD, LENGTH_FLOOR, LENGTH_RATIOS, LEXICON, LEXICON_UNLESS_BEFORE, WHITE

ISSUES = "array<struct<rule: string, severity: string, message: string>>"
NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"

# What each host allows: kinds that are inline, and kinds that may not gain lines.
INLINE_KINDS = {"markdown": ("heading", "cell"), "text": (), "text-line": ()}
ONE_LINE_KINDS = {"markdown": ("heading", "quote", "cell"), "text": ("heading",), "text-line": ("heading", "para")}
#: Glossary terms up to which they are broadcast.
MAX_BROADCAST = 100_000
XML_HOSTS = ("xml", "xhtml")
# What a line opens in Markdown, tested in this order on the line without its leading white space.
BLOCKS = (
    ("code fence", r"^(?:`{3,}[^`]*|(?d)~{3,}.*)(?=\n?\z)"),
    ("thematic break", r"^(?:\*{3,}|-{3,}|_{3,})[ \t]*\r*(?=\n?\z)"),
    ("setext heading", r"^(?:=+|-{2,})[ \t]*\r*(?=\n?\z)"),
    ("heading", r"^#{1,6}[ \t]+"),
    ("link reference definition", None),
    ("blockquote", r"^>"),
    ("list", rf"^(?:[-*+]|\p{{Nd}}+[.)])[{WHITE}]+"),
)


@dataclass(frozen=True)
class Rules:
    """Settings of the checks: language, glossary rows (source, target, forbidden, severity), protected terms and the rest."""

    lang: str = "zh-TW"
    glossary: Sequence[Mapping] = ()
    dnt: Sequence[str] = ()
    disabled: frozenset[str] = frozenset()
    lexicon_extra: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    length_ratios: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(LENGTH_RATIOS))


def _none() -> Column:
    return F.array().cast(ISSUES)


def _issue(rule: str, severity: Column | str, message: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.array(F.struct(F.lit(rule).alias("rule"), text(severity).alias("severity"), text(message).alias("message")))


def _when(condition: Column, rule: str, severity: Column | str, message: Column | str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), _issue(rule, severity, message)).otherwise(_none())


def multiset_minus(a: Column, b: Column) -> Column:
    """What array a has over array b, counting repeats, sorted."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    extra = lambda x: F.greatest(count(a, x) - count(b, x), F.lit(0))
    return F.array_sort(F.flatten(F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, extra(x)))))


def missing_translation(target: Column) -> Column:
    return _when(F.coalesce(is_blank(target), F.lit(True)), "missing", "error", "no translation")


def held(review: Column) -> Column:
    return _when(review == HELD, "held", "warn", "held for review; no queue selects this segment")


def placeholder_sets(source: Column, target: Column) -> Column:
    def body(ids: Column) -> Column:
        lost, extra = multiset_minus(ids.a, ids.b), multiset_minus(ids.b, ids.a)
        message = F.concat(F.lit("placeholders differ: lost ["), F.array_join(lost, ", "), F.lit("], extra ["), F.array_join(extra, ", "), F.lit("]"))
        return _when(F.array_sort(ids.a) != F.array_sort(ids.b), "tags", "error", message)

    return let(F.struct(masking.placeholder_ids(source).alias("a"), masking.placeholder_ids(target).alias("b")), body)


def tag_pairs(target: Column, slots: Column) -> Column:
    """Opening and closing placeholders out of order, and pairs that cross, in the order of pair ids."""

    entries = F.map_entries(slots)
    halves = lambda role: F.filter(entries, lambda e: (e.value.role == role) & e.value.pair_id.isNotNull())
    spot = lambda key: F.call_function("locate", F.concat(F.lit("⟦"), key, F.lit("⟧")), target)

    def spans(opens: Column) -> Column:
        closes = halves("close")
        joined = F.transform(
            opens,
            lambda o: F.struct(
                o.value.pair_id.alias("pair"),
                spot(o.key).alias("at"),
                let(F.filter(closes, lambda c: c.value.pair_id == o.value.pair_id), lambda c: F.when(F.size(c) > 0, spot(F.element_at(c, 1).key)).otherwise(0)).alias("to"),
                o.key.alias("first"),
                let(F.filter(closes, lambda c: c.value.pair_id == o.value.pair_id), lambda c: F.when(F.size(c) > 0, F.element_at(c, 1).key)).alias("last"),
            ),
        )
        return F.array_sort(F.filter(joined, lambda x: (x.at > 0) & (x.to > 0)))

    def told(found: Column) -> Column:
        wrong = F.filter(found, lambda x: x.at > x.to)
        right = F.filter(found, lambda x: x.at <= x.to)
        inverted = F.transform(wrong, lambda x: _issue("tags", "error", F.concat(F.lit("pair inverted: ⟦"), x.first, F.lit("⟧ must come before ⟦"), x.last, F.lit("⟧")))[0])

        def crossing(rows: Column) -> Column:
            def against(a: Column, i: Column) -> Column:
                later = F.filter(F.slice(rows, i + 2, F.size(rows)), lambda b: ((a.at < b.at) & (b.at < a.to) & (a.to < b.to)) | ((b.at < a.at) & (a.at < b.to) & (b.to < a.to)))
                return F.transform(later, lambda b: _issue("tags", "error", F.concat(F.lit("pairs cross: ⟦"), a.first, F.lit("⟧…⟦"), a.last, F.lit("⟧ and ⟦"), b.first, F.lit("⟧…⟦"), b.last, F.lit("⟧")))[0])

            return F.flatten(F.transform(rows, against))

        return F.concat(inverted, let(right, crossing))

    return let(spans(halves("open")), told)


def bare_terms(target: Column, slots: Column, dnt: Sequence[str]) -> Column:
    """Terms that are protected in the source and stand unprotected in the target too."""
    if not dnt:
        return _none()
    originals = F.transform(F.map_values(slots), lambda s: s.original)
    plain = masking.without_placeholders(target)
    return F.concat(*[_when(F.array_contains(originals, t) & plain.rlike(masking.term_regex(t)), "bare_term", "warn", f"{t!r} is protected here and also stands as plain text") for t in sorted(set(dnt))])


def block_of(line: Column, definition: Column) -> Column:
    """The kind of Markdown block that a line opens, or null; ``definition``: whether it is a link definition."""
    bare = F.regexp_replace(line, f"^[{WHITE}]+", "")
    found = F.lit(None).cast("string")
    for name, pattern in reversed(BLOCKS):
        found = F.when(definition if pattern is None else bare.rlike(pattern), name).otherwise(found)
    return found


def definition_lines(text: Column) -> Column:
    """array<string>: the lines of a text that are link definitions; rows without ``]:`` never leave the JVM."""
    from quireline.operators.segment_markdown import is_definition

    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [x for x in t.split("\n") if is_definition(x.lstrip())] for t in texts], dtype=object)

    return F.coalesce(F.pandas_udf(rows, "array<string>")(F.when(text.contains("]:"), text)), F.array().cast("array<string>"))


def containment(kind: Column, host: Column, source: Column, target: Column) -> Column:
    """A target that would leave the block it sits in; both texts with their originals put back."""
    known = F.when(host.isin(*INLINE_KINDS), host).otherwise("markdown")
    kind = F.coalesce(kind, F.lit("para"))
    among = lambda table: F.coalesce(*[F.when((known == h) & (kind.isin(*kinds) if kinds else F.lit(False)), True) for h, kinds in table.items()], F.lit(False))

    def body(t: Column) -> Column:
        more = among(ONE_LINE_KINDS) & (F.size(t.tl) > F.size(t.sl))
        empty = F.exists(t.tl, is_blank) & ~F.exists(t.sl, is_blank)
        added = _when(more, "containment", "error", F.concat(F.lit("the target has more lines than a "), kind, F.lit(" may have")))
        broken = _when(~more & empty, "containment", "error", "the target contains a blank line, which ends the block it sits in")
        opens = lambda x: F.when(known == "markdown", block_of(x, F.array_contains(t.defs, x)))
        first = _when(
            opens(F.element_at(t.tl, 1)).isNotNull() & ~opens(F.element_at(t.tl, 1)).eqNullSafe(opens(F.element_at(t.sl, 1))),
            "containment", "error", F.concat(F.lit("the target opens a "), opens(F.element_at(t.tl, 1)), F.lit("; the source does not")),
        )
        allowed = F.transform(F.slice(t.sl, F.lit(2), F.size(t.sl)), opens)
        later = F.transform(F.slice(t.tl, F.lit(2), F.size(t.tl)), lambda x, i: F.struct((i + 2).alias("n"), opens(x).alias("b")))
        wrong = F.filter(later, lambda x: x.b.isNotNull() & ~F.exists(allowed, lambda a: a.eqNullSafe(x.b)))
        rest = F.transform(wrong, lambda x: _issue("containment", "error", F.concat(F.lit("line "), x.n.cast("string"), F.lit(" of the target opens a "), x.b, F.lit("; a translation may not add a block")))[0])
        pipes = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
        column = _when((kind == "cell") & (pipes(t.t) > pipes(t.s)), "containment", "error", "the target adds a '|', which starts a new table column")
        blocks = F.when(among(INLINE_KINDS), _none()).otherwise(F.concat(first, rest))
        return F.concat(added, broken, blocks, column)

    parts = F.struct(
        source.alias("s"), target.alias("t"), F.split(source, "\n", -1).alias("sl"), F.split(target, "\n", -1).alias("tl"),
        F.concat(definition_lines(source), definition_lines(target)).alias("defs"),
    )
    return let(parts, body)


def escaping(target: Column, host: Column) -> Column:
    xml = host.isin(*XML_HOSTS)
    loose = F.regexp_replace(target, "&(?:[A-Za-z][A-Za-z0-9]*|#\\p{Nd}+|#[xX][0-9A-Fa-f]+);", "")
    return F.concat(
        _when(xml & target.contains("<"), "escaping", "error", "the target contains a raw '<'"),
        _when(xml & loose.contains("&"), "escaping", "error", "the target contains a raw '&'"),
        _when(xml & target.contains("]]>"), "escaping", "error", "the target contains ']]>'"),
    )


def added_cr(source: Column, target: Column) -> Column:
    return _when(target.contains("\r") & ~source.contains("\r"), "eol", "error", "the target adds a carriage return")


def untranslated(source: Column, target: Column) -> Column:
    words = F.filter(F.split(masking.without_placeholders(source), f"[{WHITE}]+"), lambda w: w != "")
    return _when((strip(target) == strip(source)) & (F.size(words) >= 3), "untranslated", "warn", "target identical to source")


def _glossary_row(source: Column, target: Column, row: Mapping) -> Column:
    found = F.lower(source).rlike(rf"(?<![A-Za-z])\Q{row['source'].lower()}\E(?![A-Za-z])")
    rules = []
    if row.get("target"):
        rules.append(_when(found & ~target.contains(row["target"]), "glossary", row.get("severity") or "error", f"{row['source']!r} should be {row['target']!r}"))
    rules += [_when(found & target.contains(bad), "glossary", "error", f"forbidden {bad!r} for {row['source']!r}") for bad in row.get("forbidden") or ()]
    return F.concat(*rules) if rules else _none()


def glossary(source: Column, target: Column, rows: Sequence[Mapping]) -> Column:
    return F.concat(*[_glossary_row(source, target, r) for r in rows]) if rows else _none()


def glossary_issues(pairs: DataFrame, rows: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """One row for each glossary issue of pairs, by a join for glossaries too long to be literals.

    Pairs are joined on the keys they hold, each once, then verified. A term that begins with an ASCII letter
    has its first run of them as key, as no such letter may stand beside a match; any other has its first two
    characters, or the one it has. Each pair holds the key of the empty term.
    """
    low = F.lower(source)
    every = lambda pattern, group: F.regexp_extract_all(low, F.lit(pattern), F.lit(group))
    keys = F.array_distinct(F.concat(every("[A-Za-z]+", 0), every("(?s)(?=([^A-Za-z].))", 1), every("[^A-Za-z]", 0), F.array(F.lit(""))))
    keyed = pairs.withColumn("_word", F.explode(F.transform(keys, lambda w: w)))
    terms = rows.select(
        F.lower("source").alias("_term"), F.col("target").alias("_want"), F.col("forbidden").alias("_bad"), F.col("severity").alias("_severity"),
        F.regexp_extract(F.lower("source"), r"(?s)^(?:[A-Za-z]+|[^A-Za-z].?)", 0).alias("_word"),
    )
    quoted = F.concat(F.lit(r"(?<![A-Za-z])\Q"), F.col("_term"), F.lit(r"\E(?![A-Za-z])"))
    few = terms.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST  # else keys and terms are shuffled, each key with its pair
    hit = keyed.join(F.broadcast(terms) if few else terms, "_word").where(F.regexp_like(F.lower(F.col(source)), quoted))
    wanted = hit.where((F.col("_want") != "") & ~F.contains(F.col(target), F.col("_want"))).select(*pairs.columns, F.col("_term").alias("term"), F.col("_severity").alias("severity"), F.col("_want").alias("wording"), F.lit("required").alias("issue"))
    banned = hit.select("*", F.explode("_bad").alias("_word_bad")).where(F.contains(F.col(target), F.col("_word_bad"))).select(*pairs.columns, F.col("_term").alias("term"), F.lit("error").alias("severity"), F.col("_word_bad").alias("wording"), F.lit("forbidden").alias("issue"))
    return wanted.union(banned)


def lexicon(target: Column, lang: str, extra: Mapping[str, tuple[str, str]] | None = None) -> Column:
    """Words of another variety of Chinese; ``extra`` rows win over the fixed ones."""
    if lang != "zh-TW":
        return _none()
    rows = {bad: (good, severity) for bad, good, severity in LEXICON} | dict(extra or {})
    found = []
    for bad, (good, severity) in rows.items():
        tail = LEXICON_UNLESS_BEFORE.get(bad)
        hit = target.rlike(rf"\Q{bad}\E(?![{tail}])") if tail else target.contains(bad)
        found.append(_when(hit, "lexicon", severity, f"write {good!r}, not {bad!r}"))
    return F.concat(*found)


def punctuation(target: Column) -> Column:
    """Half-width marks and straight quotes with CJK, and CJK that touches Latin letters or digits."""
    mark = F.regexp_extract(target, rf"[{CJK}][{WHITE}]*([,;:!?])", 1)
    return F.concat(
        _when(mark != "", "punct", "warn", F.concat(F.lit("half-width '"), mark, F.lit("' after CJK"))),
        _when(target.rlike(rf'"[^"]*[{CJK}][^"]*"'), "punct", "warn", "straight quotes around CJK"),
        _when(target.rlike(rf"[{CJK}][A-Za-z0-9]|[A-Za-z0-9][{CJK}]"), "spacing", "warn", "no space between CJK and Latin"),
    )


def lost_numbers(source: Column, target: Column) -> Column:
    numbers = lambda c: F.regexp_extract_all(masking.without_placeholders(c), F.lit(NUMBER), 0)
    lost = let(F.struct(numbers(source).alias("a"), numbers(target).alias("b")), lambda n: multiset_minus(n.a, n.b))
    return let(lost, lambda x: _when(F.size(x) > 0, "numbers", "error", F.concat(F.lit("numbers absent from target: ["), F.array_join(x, ", "), F.lit("]"))))


def lost_terms(source: Column, target: Column, dnt: Sequence[str]) -> Column:
    plain = masking.without_placeholders
    return F.concat(*[_when(plain(source).contains(t) & ~plain(target).contains(t), "dnt", "warn", f"protected term {t!r} missing in target") for t in dnt]) if dnt else _none()


def length_ratio(source: Column, target: Column, lang: str, ratios: Mapping[str, tuple[float, float]]) -> Column:
    low, high = ratios.get(lang, DEFAULT_RATIO)
    size = lambda c: F.length(strip(masking.without_placeholders(c)))

    def body(n: Column) -> Column:
        ratio = n.t / n.s
        shown = F.format_string("%.2f", ratio)
        long_enough = n.s >= LENGTH_FLOOR
        return F.concat(
            _when(long_enough & (ratio < low), "length", "warn", F.concat(F.lit("target unusually short (ratio "), shown, F.lit(")"))),
            _when(long_enough & (ratio > high), "length", "warn", F.concat(F.lit("target unusually long (ratio "), shown, F.lit(")"))),
        )

    return let(F.struct(size(source).alias("s"), size(target).alias("t")), body)


def issues(rules: Rules, masked: Column, target: Column, slots: Column, kind: Column, host: Column, review: Column) -> Column:
    """All issues of a segment; one without a translation has that issue alone."""
    t = F.coalesce(target, F.lit(""))
    originals = F.coalesce(masking.slot_originals(slots), F.array().cast("array<string>"))
    back = lambda c: masking.unmasked(c, originals)
    found = F.concat(
        held(review),
        placeholder_sets(masked, t),
        tag_pairs(t, slots),
        bare_terms(t, slots, rules.dnt),
        containment(kind, host, back(masked), back(t)),
        escaping(t, host),
        added_cr(masked, t),
        untranslated(masked, t),
        glossary(masked, t, rules.glossary),
        lexicon(t, rules.lang, rules.lexicon_extra),
        F.when(t.rlike(f"[{CJK}]"), punctuation(t)).otherwise(_none()),
        lost_numbers(masked, t),
        lost_terms(masked, t, rules.dnt),
        length_ratio(masked, t, rules.lang, rules.length_ratios),
    )
    every = F.when(is_blank(t), missing_translation(t)).otherwise(found)
    return F.filter(every, lambda x: ~x.rule.isin(*sorted(rules.disabled))) if rules.disabled else every


def check_segments(segments: DataFrame, rules: Rules) -> DataFrame:
    """``segments`` (masked, target, slots, kind, host, review) with an ``issues`` column."""
    c = F.col
    return segments.withColumn("issues", issues(rules, c("masked"), c("target"), c("slots"), c("kind"), c("host"), c("review")))
