"""Personal data by base patterns and bootstrapped contextual extraction.

Base matches (email, ip, card, phone) are the seeds. Every other identifier-like run of a text (six
characters or more, three digits or more) is a candidate. Seeds and candidates alike show lexical
patterns of what stands around them: up to three words and marks on the left, one of them with the word on the
right, and the letters a value begins with. Patterns and instances form a graph whose edges count hits
over all documents, and Spark scores both sides in turn:

- an instance's score is 1 for a seed, else the noisy-or of its trusted patterns' confidences;
- a pattern's confidence is the share, smoothed, of its hits whose instance scores; its support is the
  number of different instances that score ``MIN_CONFIDENCE`` or more, discovered ones included;
- a pattern of ``MIN_CONFIDENCE`` and ``MIN_SUPPORT`` or more is trusted.

Each round may so reach patterns that no seed stands in. After ``ROUNDS`` rounds, candidates in trusted
patterns are added with kind ``context``. Patterns and instances are compared by their XXH64 values.

Defined results: a null or empty text has no spans; a text, a word of a context and a value of any
length count whole (an added span ends where its run ends); added spans overlap neither each other nor
base spans, and come after these, by start; one that a document shows again is added again; a null
doc_id is kept; rows come back once each, repeated or not (repeats count as hits, not as support);
other columns are dropped first or come back inside one struct, so their names clash with nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm.scratch import arrow_function, cut, drop, recorded, small

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
#: Rows with added spans, and trusted patterns, up to which they are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 100_000
ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT, SMOOTHING = 3, 0.5, 3, 1.0
#: What makes a run a candidate: so many characters and digits.
MIN_LENGTH, MIN_DIGITS = 6, 3

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"(?<![\w.@+/-])[A-Za-z0-9]++(?:[._@+/-]++[A-Za-z0-9]++)*+(?!\w)")
_RUN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._@+/-")
_STRETCH = re.compile(r"[A-Za-z0-9._@+/-]+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_BEGINNING = re.compile(r"[A-Za-z][^0-9]*")


def luhn(digits: str) -> bool:
    """True if the digits pass the Luhn test."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ with a domain takes the run of local characters before it, as far as no match holds them."""
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``_RUN`` that hold a digit: few words do, so each digit is sought and its run found around it."""
    digit = _DIGIT.search(text)
    while digit:
        start = digit.start()
        while start and text[start - 1] in _RUN_CHARS:
            start -= 1
        run = _RUN.match(text, start)
        if run:
            yield run.span()
        digit = _DIGIT.search(text, _STRETCH.match(text, digit.start()).end())


def candidates(text: str, base: Sequence[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like runs that touch no base span; both lists are walked together by start."""
    spans = sorted((s, e) for _, s, e in base)
    out, at, reached = [], 0, 0
    for start, end in runs(text):
        while at < len(spans) and spans[at][0] < end:
            reached = max(reached, spans[at][1])
            at += 1
        if start >= reached and end - start >= MIN_LENGTH and len(_DIGIT.findall(text, start, end)) >= MIN_DIGITS:
            out.append((start, end))
    return out


def _told(token: str) -> str:
    """A token of a context: in lower case, one with several digits only as such."""
    return "<number>" if len(_DIGIT.findall(token)) >= 2 else token.lower()


def patterns(text: str, starts: array, start: int, end: int) -> list[str]:
    """The patterns of the value at start to end; ``starts``: where the text's words and marks begin."""
    first, after = bisect_left(starts, start), bisect_left(starts, end)
    token = lambda k: _told(_TOKEN.match(text, starts[k])[0])
    left = [token(k) for k in range(max(0, first - 3), first)]
    out = []
    if len(left) >= 2:
        out.append(f"{left[-2]} {left[-1]} _")
    if len(left) == 3:
        out.append(f"{left[0]} {left[1]} {left[2]} _")
    if left and after < len(starts):
        out.append(f"{left[-1]} _ {token(after)}")
    if len(left) == 1 and not left[0].isalnum() or not left:
        out.append(f"^ {' '.join(left)} _")  # where the text begins
    beginning = _BEGINNING.match(text, start, end)
    if beginning and len(beginning[0]) >= 2:
        out.append(f"_ {beginning[0].lower()}")
    return out


def occurrences(text: str, base: Sequence[tuple[str, int, int]]) -> list[tuple[list[str], str, int, int, bool]]:
    """(patterns, instance, start, end, seed) for each seed and candidate of the text, by start."""
    places = sorted([(s, e, True) for _, s, e in base] + [(s, e, False) for s, e in candidates(text, base)])
    if not places:
        return []
    starts = array("q", (m.start() for m in _TOKEN.finditer(text)))
    return [(patterns(text, starts, s, e), text[s:e], s, e, seed) for s, e, seed in places]


def hashed(value: str) -> int:
    """The signed XXH64 value of a string."""
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def _joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = "array<struct<p: array<long>, i: long, s: int, e: int, seed: boolean>>"


def _scanned(texts: list[str | None]) -> list[dict]:
    rows = []
    for t in texts:
        base = base_spans(t or "")
        counts = {f"n_{name}": sum(k == name for k, _, _ in base) for name in KINDS}
        found = [{"p": [hashed(p) for p in ps], "i": hashed(i), "s": s, "e": e, "seed": seed} for ps, i, s, e, seed in occurrences(t or "", base)]
        rows.append(counts | {"base": _joined(base), "found": found})
    return rows


def trusted_patterns(hits: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(p, confidence) of the patterns that are trusted after some rounds; ``hits(p, i, seed)`` has a row for each pattern of each occurrence."""
    edges = cut(hits.groupBy("p", "i").agg(F.count(F.lit(1)).alias("hits"), F.bool_or("seed").alias("seed")), "edges")
    places = edges.groupBy("p").agg(F.sum("hits").alias("n"), F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= min_support)  # others can never have the support
    places = cut(places.select("p", "n"), "places")
    edges = cut(edges.join(places, "p"), "edges")
    scores = cut(edges.groupBy("i").agg(F.bool_or("seed").cast("double").alias("score")), "scores")
    trusted = None
    for k in range(rounds):
        sums = edges.join(scores, "i").groupBy("p", "n").agg(F.sum(F.col("score") * F.col("hits")).alias("good"), F.count_if(F.col("score") >= min_confidence).alias("support"))
        confidence = F.col("good") / (F.col("n") + SMOOTHING)
        trusted = cut(sums.where((confidence >= min_confidence) & (F.col("support") >= min_support)).select("p", confidence.alias("confidence")), "trusted")
        if k + 1 < rounds:
            credit = edges.join(small(trusted, MAX_BROADCAST), "p", "left")
            noisy_or = 1 - F.exp(F.sum(F.log(1 - F.coalesce("confidence", F.lit(0.0)))))
            scores = cut(credit.groupBy("i").agg(F.when(F.bool_or("seed"), 1.0).otherwise(noisy_or).alias("score")), "scores")
    return trusted


def find_personal(docs: DataFrame, carry: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans and n_context of each row, with the struct doc of carried columns.

    Texts are read once: what the patterns need is written beside the base results.
    """
    struct = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")] if carry else []
    schema = f"n_email long, n_ip long, n_card long, n_phone long, base string, found {_FOUND}"

    scanned = docs.select(F.col(doc_id).alias("doc_id"), *struct, arrow_function(_scanned, schema)(F.col(text)).alias("r"))
    kept = ["doc_id", *(["doc"] if carry else [])]
    rows = cut(scanned.select(F.monotonically_increasing_id().alias("_row"), *kept, "r.*"), "personal")
    with recorded() as passing:
        found = rows.where(F.size("found") > 0).select("_row", F.inline("found"))
        trusted = trusted_patterns(found.select(F.explode("p").alias("p"), "i", "seed"))
        open_ = found.where("NOT seed").select("_row", "s", "e", F.explode("p").alias("p"))
        new = open_.join(small(trusted, MAX_BROADCAST), "p").groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("new"))
        label = lambda x: F.concat(F.lit(f"{CONTEXT}:"), x.s.cast("string"), F.lit(":"), x.e.cast("string"))
        written = new.select("_row", F.array_join(F.transform("new", label), ",").alias("_added"), F.size("new").cast("long").alias("_n"))
    added = cut(written, "added")
    drop(docs.sparkSession, passing)
    out = rows.drop("found").join(small(added, MAX_BROADCAST), "_row", "left")
    spans = F.array_join(F.filter(F.array(F.col("base"), F.coalesce("_added", F.lit(""))), lambda x: x != ""), ",")
    return out.select(*kept, "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"), F.coalesce("_n", F.lit(0)).alias("n_context"))


def _masked(text: str, spans: str) -> str:
    """A text with its spans replaced; where spans overlap, the first one's kind stands for both."""
    parts, at = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(","))):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets."""
    found = find_personal(docs, docs.columns, doc_id, text)

    def masked(texts: list[str | None], spans: list[str]) -> list[str | None]:
        return [t if t is None or not s else _masked(t, s) for t, s in zip(texts, spans, strict=True)]

    new = F.when(F.col("spans") == "", F.col(f"doc.{text}")).otherwise(arrow_function(masked, "string")(F.col(f"doc.{text}"), F.col("spans")))
    return found.select(*[new.alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])

