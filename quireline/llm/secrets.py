"""Secret scans: three base patterns and a token-efficiency test for random strings.

Strings that people write have pieces that a byte-pair vocabulary knows, random ones have not: a run
of 20 or more characters that needs a token for every two characters or fewer is exposed as
``random``, unless it is a digest of a known length, a UUID or a number (a run without letters). Runs
that touch a base span add nothing.

Defined results: a null or empty text has no spans; a text or run of any length is read whole, in one
pass for each kind; spans of one start are in the order of kinds, and base spans of different kinds may
overlap; rows come back once each, repeated or not; other columns are dropped first, so their names
clash with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm.scratch import arrow_function

KINDS = ("assign", "access", "hex")
RANDOM = "random"
#: Characters for each token, at most, of a random string.
MAX_RATIO = 2.0
MIN_LENGTH = 20

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What every assignment has in lower case.
_WORDS = ("passw", "secret", "token", "api")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_LENGTH)
#: Known digests (hexadecimal digits of MD5, SHA-1 and the SHA-2 family) and identifiers.
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_LETTER = re.compile("[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base matches, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def candidate(run: str) -> bool:
    """True for a run that is neither a known digest or identifier nor a number."""
    return not (_DIGEST.fullmatch(run) or _UUID.fullmatch(run)) and _LETTER.search(run) is not None


class Scanner:
    """Base and token-efficiency spans; ``encode`` gives the tokens of a string."""

    def __init__(self, vocabulary: str, pattern: str, max_ratio: float = MAX_RATIO):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.max_ratio = max_ratio

    def added(self, text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """Random runs apart from the base spans, which come by start: both lists are walked together."""
        out, at, reached = [], 0, 0
        for m in _RUN.finditer(text):
            start, end = m.span()
            while at < len(base) and base[at][0] < end:
                reached = max(reached, base[at][2])
                at += 1
            if start < reached or not candidate(run := m[0]):
                continue
            if len(run) <= self.max_ratio * len(self.encode(run)):
                out.append((start, RANDOM, end))
        return out


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


@lru_cache(maxsize=1)
def scanner(vocabulary: str, pattern: str) -> Scanner:
    """The scanner of a worker."""
    return Scanner(vocabulary, pattern)


def scan(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of each row; offsets in code points."""
    order = {k: i for i, k in enumerate((*KINDS, RANDOM))}

    def scanned(texts: list[str | None]) -> list[dict]:
        out = []
        for t in texts:
            base = base_spans(t or "")
            more = scanner(vocabulary, pattern).added(t or "", base)
            counts = {f"n_{name}": sum(k == name for _, k, _ in base) for name in KINDS}
            every = sorted(base + more, key=lambda x: (x[0], order[x[1]]))
            out.append(counts | {"base_sha256": sha256(_joined(base).encode()).hexdigest(), "spans": _joined(every), "n_random": len(more)})
        return out

    made = arrow_function(scanned, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
    return docs.select(F.col(doc_id).alias("doc_id"), made(F.col(text)).alias("r")).select("doc_id", "r.*")
