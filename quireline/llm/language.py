"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes, forwards and backwards, and gives language probabilities at every
position of the whole text; a document's probabilities are the mean over its positions. Long texts go
through in windows of ``CORE`` positions that overlap by ``MARGIN`` on either side: there the states
take up what is before and after, and no label is read, so each position is labelled once and sees
``MARGIN`` bytes or more in both directions, or the text's end.

The network is trained here, in numpy, by backpropagation through time, on a bounded sample: of the
labelled rows that are not held out, about ``QUOTA`` windows of ``WINDOW`` bytes a language (fewer, but
one at least, where ``SAMPLE`` is shared by very many), from documents drawn by a hash of the id, at
places drawn by another (several of a document only where there are few). Training goes over the sample
once at least. The sample and the network grow with the number of languages, not with the rows.

Rows whose ``crc32(doc_id as text) mod 4`` is 2 are held out from training. Only a row's text takes
part in its prediction.

Defined results: a null text or one without a letter is ``und`` with score 0; a text of any length is
labelled whole; languages of equal probability go by name, the first one wins; a null id is not held
out; without any labelled row all texts are ``und``; rows come back once each, repeated or not; other
columns are dropped first or come back inside one struct, so their names clash with nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.llm.scratch import arrow_function

WINDOW, HIDDEN = 96, 8
#: Positions that a window of a text labels, and those it reads besides on either side.
CORE, MARGIN = 256, 32
#: Training windows for each language, about, for all together and of one document at most.
QUOTA, SAMPLE, PLACES = 1_200, 100_000, 8
#: More different labels than this are an error, not languages; none is left out.
MAX_LANGUAGES = 10_000
STEPS, BATCH, RATE, SEED = 350, 128, 0.02, 7
UNKNOWN = "und"
#: Windows that go through the network together.
TOGETHER = 768
_PAD = 32


class ByteNetwork:
    """Gated recurrent units over bytes in two directions, and a softmax over both at each position.

    ``table`` (2, 256, 3H) has the inputs of update gate, reset gate and candidate for each byte;
    ``recur`` (2, H, 3H) the same for the state; ``out`` (2, H, L) and ``bias`` (L) the labels'.
    """

    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        self.table = draw.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32)
        self.table[:, :, :hidden] += 1.0  # remember at first
        self.recur = draw.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(np.float32)
        self.out = draw.normal(0, 0.3, (2, hidden, labels)).astype(np.float32)
        self.bias = np.zeros(labels, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.out, self.bias]

    def states(self, windows: np.ndarray, keep: bool = False, inside: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States (W, 2, N, H) at each step of windows (N, W) of bytes, the backward ones in reading order.

        ``keep``: what training needs; ``inside`` (N, W): which positions belong to the text, as states begin at its ends.
        """
        n, w = windows.shape
        h2, h3 = 2 * self.hidden, 3 * self.hidden
        state = np.zeros((2, n, self.hidden), dtype=np.float32)
        states = np.empty((w, 2, n, self.hidden), dtype=np.float32)
        given = np.empty((2, n, h3), dtype=np.float32)
        kept = []
        steps = np.ascontiguousarray(windows.T)
        for t in range(w):
            np.take(self.table[0], steps[t], axis=0, out=given[0], mode="clip")
            np.take(self.table[1], steps[w - 1 - t], axis=0, out=given[1], mode="clip")
            own = np.matmul(state, self.recur)
            gates = given[:, :, :h2] + own[:, :, :h2]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :, : self.hidden], gates[:, :, self.hidden :]
            candidate = own[:, :, h2:] * r
            candidate += given[:, :, h2:]
            np.tanh(candidate, out=candidate)
            before = state
            state = before - candidate
            state *= z
            state += candidate
            if inside is not None:
                state[0] *= inside[:, t, None]
                state[1] *= inside[:, w - 1 - t, None]
            states[t, 0] = state[0]
            states[w - 1 - t, 1] = state[1]
            if keep:
                kept.append((before, own[:, :, h2:].copy(), z, r, candidate))
        return states, kept

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(W, N, L) from states."""
        logits = states[:, 0] @ self.out[0]
        logits += states[:, 1] @ self.out[1]
        logits += self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, real: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean weighted cross-entropy over real positions and its gradients, through time."""
        n, w = windows.shape
        hidden = self.hidden
        states, kept = self.states(windows, keep=True)
        p = self.probabilities(states)
        share = (real * weights[:, None]).T.astype(np.float32)
        share /= share.sum()
        loss = -float((np.log(np.maximum(p[:, np.arange(n), labels], 1e-9)) * share).sum())
        p[:, np.arange(n), labels] -= 1
        p *= share[:, :, None]
        d_out = np.stack([np.tensordot(states[:, k], p, axes=([0, 1], [0, 1])) for k in range(2)])
        d_bias = p.sum(axis=(0, 1))
        d_states = [p @ self.out[k].T for k in range(2)]
        d_recur = np.zeros_like(self.recur)
        d_bytes = np.empty((2, w, n, 3 * hidden), dtype=d_states[0].dtype)
        d_state = np.zeros((2, n, hidden), dtype=np.float32)
        for t in range(w - 1, -1, -1):
            before, own, z, r, c = kept[t]
            d_state[0] += d_states[0][t]
            d_state[1] += d_states[1][w - 1 - t]
            d_c = d_state * (1 - z) * (1 - c * c)
            d_own = np.concatenate([d_state * (before - c) * z * (1 - z), d_c * own * r * (1 - r), d_c * r], axis=2)
            d_given = np.concatenate([d_own[:, :, : 2 * hidden], d_c], axis=2)
            d_recur += np.matmul(before.transpose(0, 2, 1), d_own)
            d_bytes[0, t], d_bytes[1, w - 1 - t] = d_given
            d_state = d_state * z + np.matmul(d_own, self.recur.transpose(0, 2, 1))
        seen = windows.T.ravel()
        d_table = np.stack([[np.bincount(seen, weights=column, minlength=256) for column in d.reshape(w * n, -1).T] for d in d_bytes]).transpose(0, 2, 1).astype(self.table.dtype)
        return loss, [d_table, d_recur, d_out.astype(np.float32), d_bias.astype(np.float32)]


def cut_windows(raw: bytes, core: int = WINDOW, margin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, margin + core + margin) of some bytes, padded outside them, and how many of each core's positions are real."""
    n = -(-len(raw) // core)
    flat = np.full(n * core + 2 * margin, _PAD, dtype=np.uint8)
    flat[margin : margin + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.full(n, core)
    if n:
        sizes[-1] = len(raw) - (n - 1) * core
    return np.lib.stride_tricks.sliding_window_view(flat, core + 2 * margin)[::core] if n else np.zeros((0, core + 2 * margin), dtype=np.uint8), sizes


class LanguageModel:
    """A trained network and its label names."""

    def __init__(self, network: ByteNetwork, names: Sequence[str]):
        self.network, self.names = network, list(names)

    @classmethod
    def fit(cls, samples: Iterable[tuple[str, str]], steps: int = STEPS) -> LanguageModel:
        """Adam over (text, language) pairs, each used once at least; languages weigh the same however many texts they have."""
        samples = [(t.encode("utf-8", "surrogatepass")[:WINDOW], name) for t, name in samples]
        names = sorted({name for _, name in samples})
        network = ByteNetwork(len(names))
        if len(names) < 2:
            return cls(network, names)
        cut = [cut_windows(raw) for raw, _ in samples]
        windows = np.concatenate([w for w, _ in cut])
        real = np.arange(WINDOW)[None, :] < np.concatenate([s for _, s in cut])[:, None]
        labels = np.array([names.index(name) for _, name in samples])
        weights = (len(labels) / len(names) / np.bincount(labels))[labels].astype(np.float32)
        draw = np.random.default_rng(SEED)
        means = [np.zeros_like(p) for p in network.parameters()]
        squares = [np.zeros_like(p) for p in network.parameters()]
        order = np.zeros(0, dtype=np.int64)
        steps = max(steps, -(-len(labels) // BATCH))
        for step in range(1, steps + 1):
            while len(order) < BATCH:
                order = np.concatenate([order, draw.permutation(len(labels))])
            rows, order = order[:BATCH], order[BATCH:]
            _, grads = network.gradients(windows[rows], real[rows], labels[rows], weights[rows])
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
            rate = RATE * (1 - (step - 1) / steps)
            for p, g, m, s in zip(network.parameters(), grads, means, squares, strict=True):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return cls(network, names)

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """The best language and its pooled probability for each text; ``und`` and 0 for null and empty ones."""
        sums = np.zeros((len(texts), max(1, len(self.names))))
        counts = np.zeros(len(texts))
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if waiting:
                windows, sizes, owners, before, after = (np.concatenate(x) for x in zip(*waiting, strict=True))
                for at in range(0, len(windows), TOGETHER):
                    spot = np.arange(windows.shape[1])[None, :]
                    inside = (spot >= before[at : at + TOGETHER, None]) & (spot < after[at : at + TOGETHER, None])
                    states, _ = self.network.states(windows[at : at + TOGETHER], inside=inside)
                    p = self.network.probabilities(states[MARGIN : MARGIN + CORE])
                    some = sizes[at : at + TOGETHER]
                    p *= (np.arange(CORE)[:, None] < some[None, :])[:, :, None]
                    np.add.at(sums, owners[at : at + TOGETHER], p.sum(axis=0))
                    np.add.at(counts, owners[at : at + TOGETHER], some)
            waiting.clear()
            held = 0

        if len(self.names) == 1:
            return [self.names[0] if t else UNKNOWN for t in texts], np.array([1.0 if t else 0.0 for t in texts])
        for k, t in enumerate(texts if self.names else []):
            if t:
                windows, sizes = cut_windows(t.encode("utf-8", "surrogatepass"), CORE, MARGIN)
                first = np.arange(len(sizes)) * CORE - MARGIN  # where in the text each window begins
                waiting.append((windows, sizes, np.full(len(sizes), k), np.maximum(-first, 0), sizes.sum() - first))
                held += len(sizes)
                if held >= TOGETHER:
                    flush()
        flush()
        best = sums.argmax(axis=1)
        scores = np.where(counts > 0, sums[np.arange(len(texts)), best] / np.maximum(counts, 1), 0.0)
        return [self.names[b] if c else UNKNOWN for b, c in zip(best, counts, strict=True)], np.clip(scores, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """True for rows that training must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quota: int = QUOTA) -> LanguageModel:
    """A model of the labelled rows that are not held out, from at most about ``quota`` short passages a language."""
    seen = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    counts = seen.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{lang} has over {MAX_LANGUAGES} values: these are no languages")
    if not counts:
        return LanguageModel.fit([])
    quota = max(1, min(quota, SAMPLE // len(counts)))
    share = {r["lang"]: 1.5 * quota / r["n"] for r in counts}
    rates = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col(lang)]
    draw = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    places = F.sequence(F.lit(1), F.least(F.ceil(rates), F.lit(PLACES)).cast("int"))
    drawn = seen.where(draw < rates).select(F.col(lang).alias("lang"), draw.alias("draw"), F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"), F.explode(places).alias("k"))
    place = F.pmod(F.xxhash64("key", "k"), F.greatest(F.length("text") - WINDOW, F.lit(1)).cast("long"))
    picked = drawn.select("lang", "draw", F.substring(F.col("text"), (place + 1).cast("int"), F.lit(WINDOW)).alias("passage"))
    fit = picked.where(F.col("passage").rlike(r"\p{L}")).orderBy("draw", "lang", "passage").limit(3 * quota * len(counts))  # in order, so the same rows each time
    rows = sorted(fit.collect(), key=lambda r: (r["draw"], r["passage"]))
    taken: dict[str, list[tuple[str, str]]] = {}
    for r in rows:
        if len(own := taken.setdefault(r["lang"], [])) < quota:
            own.append((r["passage"], r["lang"]))
    return LanguageModel.fit([s for name in sorted(taken) for s in taken[name]])


def identify(docs: DataFrame, model: LanguageModel, carry: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, with the struct doc of carried columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a network of fixed size

    def predicted(texts: list[str | None]) -> list[dict]:
        names, scores = shared.value.predict(texts)
        return [{"lang_pred": n, "score": s} for n, s in zip(names, scores.tolist(), strict=True)]

    spoken = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    struct = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")] if carry else []
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), *struct, arrow_function(predicted, "lang_pred string, score double")(spoken).alias("r"))
    return out.select("doc_id", "held_out", *(["doc"] if carry else []), "r.lang_pred", "r.score")
