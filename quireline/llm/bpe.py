"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the pattern that splits text) is encoded by halves: each half recursively,
then the two token lists are joined. To join, the bytes of a window of tokens around the seam are
encoded afresh. A side has settled when the token outside it and the window's outermost token, encoded
together, stay these two tokens. While the left side has not, the window grows there; while the right
side has not, the window's tokens are taken over and the next window lies at the new seam, so text
whose tokens shift all the way (long runs of one character) costs its length and not its square.

Why nothing outside can change then: let every two adjacent tokens of a list encode, together, to
just these two. Were the list not the encoding of all its bytes, some first merge would cross from
one token into the next; before it both tokens' merges stayed inside and came in the order of rank
that they have when the two are encoded alone, where that merge never comes. So settled pairs make
the whole list right, and an inner pair of an encoded list is always settled.

Decoding concatenates the tokens' bytes up the same kind of tree.

Defined results: a null or empty text has no tokens, and its ids and decoded bytes are the empty
string (their SHA-256 is that of no bytes); a text or piece of any length is encoded whole, in time
about in proportion; rows come back once each, repeated or not; other columns
of the input are dropped first, so their names clash with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm.scratch import arrow_function

#: Pieces of at most so many bytes are merged directly.
LEAF = 16
#: Windows of at most so many bytes are merged by looking through all their pairs; longer ones by a heap.
DIRECT = 128
#: Tokens taken from either side of a seam at first.
WINDOW = 2
#: A task's memory of pieces and pairs is emptied beyond so many entries.
MEMORY = 300_000


class TreeBPE:
    """Encoder and decoder over the ranks of a vocabulary (token bytes to rank; every single byte has one)."""

    def __init__(self, ranks: dict[bytes, int], memory: int = MEMORY):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.memory = memory
        self._settled: dict[tuple[int, int], bool] = {}
        self._windows: dict[tuple[int, ...], list[int]] = {}

    @classmethod
    def load(cls, path: str) -> TreeBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def _merged(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of least rank, the leftmost first, while any pair has a rank."""
        if len(data) > DIRECT:
            return self._merged_by_heap(data)
        parts = [data[k : k + 1] for k in range(len(data))]
        ranks, none = self.ranks, len(self.ranks) + (1 << 40)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) != none:
            k = pairs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
        return [ranks[p] for p in parts]

    def _merged_by_heap(self, data: bytes) -> list[int]:
        """The same for long windows: parts are (first, end) in a linked list, pairs wait in a heap by rank and place."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at each place; end 0: none does
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapify(heap)

        def offer(first: int) -> None:
            middle = end[first]
            if middle < n and (r := ranks.get(data[first : end[middle]])) is not None:
                heappush(heap, (r, first, end[middle]))

        while heap:
            _, first, last = heappop(heap)
            middle = end[first]
            if not middle or middle == n or end[middle] != last:
                continue  # one of its parts has been merged since
            end[first], end[middle] = last, 0
            if last < n:
                before[last] = first
            offer(first)
            if before[first] >= 0:
                offer(before[first])
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out

    def _window(self, tokens: tuple[int, ...]) -> list[int]:
        """The encoding of the bytes of a few tokens; what was encoded before is known."""
        found = self._windows.get(tokens)
        if found is None:
            if len(self._windows) >= self.memory:
                self._windows.clear()
            found = self._windows[tokens] = self._merged(b"".join(map(self.tokens.__getitem__, tokens)))
        return found

    def _stays(self, left: int, right: int) -> bool:
        """True if two tokens, encoded together, stay these two."""
        found = self._settled.get((left, right))
        if found is None:
            if len(self._settled) >= self.memory:
                self._settled.clear()
            found = self._settled[left, right] = self._merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        done, at = left, 0
        while done and at < len(right) and not self._stays(done[-1], right[at]):
            if done is left:
                done = left.copy()
            a, stop = WINDOW, min(at + WINDOW, len(right))
            while True:
                a = min(a, len(done))
                window = self._window((*done[len(done) - a :], *right[at:stop]))
                if a == len(done) or self._stays(done[-a - 1], window[0]):
                    break
                a *= 2
            done[len(done) - a :], at = window, stop
        return done + right[at:]

    def tree(self, data: bytes) -> list[int]:
        """The encoding of bytes by halves; of halves that are equal one is encoded."""
        if len(data) <= LEAF:
            return self._merged(data)
        half = len(data) // 2
        first, second = data[:half], data[half:]
        left = self.tree(first)
        return self.join(left, left if second == first else self.tree(second))

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one piece; a piece that is a token is that token."""
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self.tree(piece)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of tokens, joined up a tree."""
        if len(ids) <= LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TextCodec:
    """Whole texts to ids and back, with a bounded memory of pieces that were met before."""

    def __init__(self, bpe: TreeBPE, pattern: str, memory: int = MEMORY):
        self.bpe, self.memory = bpe, memory
        self.pieces = regex.compile(pattern).findall
        self._ids: dict[str, str] = {}
        self._bytes: dict[str, bytes] = {}

    def encode(self, text: str) -> list[str]:
        """For each piece of the text, its ids in decimal, joined by spaces."""
        found, known = self.pieces(text), self._ids
        try:
            return [known[p] for p in found]
        except KeyError:
            if len(known) > self.memory:
                known.clear()
                self._bytes.clear()
            for p in [p for p in {*found} if p not in known]:
                ids = self.bpe.encode_piece(p.encode("utf-8", "surrogatepass"))
                known[p] = " ".join(map(str, ids))
                self._bytes[known[p]] = self.bpe.decode(ids)
            return [known[p] for p in found]

    def decode(self, encoded: list[str]) -> bytes:
        """The bytes of what ``encode`` gave; pieces join as they stand, being a level of the tree."""
        return b"".join(map(self._bytes.__getitem__, encoded))


@lru_cache(maxsize=1)
def text_codec(vocabulary: str, pattern: str) -> TextCodec:
    """The codec of a worker, which keeps what it knows from task to task."""
    return TextCodec(TreeBPE.load(vocabulary), pattern)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; ``vocabulary``: a file of ranks that every machine has."""

    def coded(texts: list[str | None]) -> list[dict]:
        codec, out = text_codec(vocabulary, pattern), []
        for t in texts:
            encoded = codec.encode(t or "")
            ids = " ".join(encoded)
            out.append({"n_tokens": ids.count(" ") + 1 if ids else 0, "ids_sha256": sha256(ids.encode()).hexdigest(), "decoded_sha256": sha256(codec.decode(encoded)).hexdigest()})
        return out

    made = arrow_function(coded, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col(doc_id).alias("doc_id"), made(F.col(text)).alias("r")).select("doc_id", "r.*")
