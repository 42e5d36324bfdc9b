"""Toxicity by a classifier chain over the labelled categories.

Categories are predicted one after the other (``CHAIN``: quality first, then toxicity). Each has a
linear model over the hashed words, and beginnings of words, of the whole text and over the log-odds of the categories before
it. In training, those log-odds come out of fold: for each fold, a model that has not seen it gives
them, so a later model learns from predictions as good as those that it will get.

The models are trained on a bounded sample: of the labelled documents, about ``QUOTA`` of each value
of the last category, drawn by a hash of the id. All documents are scored, over all their words.

Defined results: a null, empty or wordless text has no evidence and is not toxic, with both scores 0;
a text of any length counts whole; a score of exactly the threshold is not toxic; labels that are null
take no part, several of one id are averaged; an id that several documents have is trained on with each
of them, as far as the sample goes; without labels nothing is toxic;
rows come back once each, repeated or not; other columns are dropped first, so their names clash with
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm.scratch import arrow_function

CHAIN = ("quality", "toxic")
#: Sampled documents for each value of the last category, about; folds; buckets of hashed words.
QUOTA, FOLDS, BUCKETS = 1_500, 4, 1 << 17
#: Beginnings of words that count beside the words, by length.
PREFIXES = (4, 5, 6, 7)
#: A model takes the buckets whose share differs between both values of its label by so many standard errors.
MIN_Z = 3.5
STEPS, RATE, PENALTY = 100, 0.1, 1e-4
#: Scores come from models to which both values weigh the same; this threshold leaves about one clean document of 150 flagged.
THRESHOLD = 0.7
#: A task's memory of words is emptied beyond so many.
MEMORY = 300_000

_WORD = re.compile(r"\w+|[^\w\s]")


def words(text: str | None) -> set[str]:
    """The different words and marks of a text, in lower case."""
    return set(_WORD.findall(text.lower())) if text else set()


def buckets_of(word: str) -> np.ndarray:
    """The buckets of a word: its own, and those of its beginnings."""
    parts = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
    return np.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts], dtype=np.int32)


def features(found: set[str], known: dict[str, np.ndarray]) -> np.ndarray:
    """The different buckets of some words; ``known`` keeps those of words."""
    if len(known) > MEMORY:
        known.clear()
    for w in found:
        if w not in known:
            known[w] = buckets_of(w)
    return np.unique(np.concatenate([known[w] for w in found])) if found else np.zeros(0, dtype=np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Logistic regression over sets of buckets and a few dense columns, by full-batch Adam with an L2 penalty."""

    def __init__(self, dense: int):
        self.sparse, self.dense, self.bias = np.zeros(BUCKETS, dtype=np.float32), np.zeros(dense), 0.0

    def log_odds(self, owners: np.ndarray, buckets: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(owners, weights=self.sparse[buckets], minlength=len(dense)) + dense @ self.dense + self.bias

    def fit(self, owners: np.ndarray, buckets: np.ndarray, dense: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Linear:
        ones = labels > 0.5
        n1, n0 = max(1, int(ones.sum())), max(1, int((~ones).sum()))
        with_one = np.bincount(buckets[ones[owners]], minlength=BUCKETS)
        with_any = np.bincount(buckets, minlength=BUCKETS)
        share_all = with_any / (n1 + n0)
        error_of = np.sqrt(share_all * (1 - share_all) * (1 / n1 + 1 / n0)) + 1e-12
        telling = (np.abs(with_one / n1 - (with_any - with_one) / n0) >= MIN_Z * error_of) & (with_any >= 3)
        kept = telling[buckets]
        owners, buckets = owners[kept], buckets[kept]
        seen, place = np.unique(buckets, return_inverse=True)
        w = np.zeros(len(seen) + dense.shape[1] + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        share = weights / weights.sum()
        for step in range(1, STEPS + 1):
            z = np.bincount(owners, weights=w[place], minlength=len(labels)) + dense @ w[len(seen) : -1] + w[-1]
            error = (sigmoid(z) - labels) * share
            g = np.concatenate([np.bincount(place, weights=error[owners], minlength=len(seen)), dense.T @ error, [error.sum()]])
            g[:-1] += PENALTY * w[:-1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.sparse[seen], self.dense, self.bias = w[: len(seen)], w[len(seen) : -1], float(w[-1])
        return self


class Chain:
    """The models of the categories, in order."""

    def __init__(self, names: Sequence[str], models: Sequence[Linear]):
        self.names, self.models = list(names), list(models)
        self._known: dict[str, np.ndarray] = {}

    @classmethod
    def fit(cls, names: Sequence[str], found: Sequence[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
        """``labels``: one column for each name, NaN where there is none; ``folds``: the fold of each row."""
        n = len(found)
        owners = np.repeat(np.arange(n), [len(f) for f in found])
        buckets = np.concatenate(found)
        earlier = np.zeros((n, 0))
        models = []

        def fitted(rows: np.ndarray, column: np.ndarray) -> Linear:
            """A model of some rows, both values of the label weighing the same."""
            rows = rows & ~np.isnan(column)
            at = np.cumsum(rows) - 1
            held = rows[owners]
            y = column[rows]
            ones = y.mean() if len(y) else 0.0
            if not 0 < ones < 1:
                model = Linear(earlier.shape[1])
                model.bias = 0.0 if not len(y) else (30.0 if ones else -30.0)
                return model
            weights = np.where(y > 0.5, 0.5 / ones, 0.5 / (1 - ones))
            return Linear(earlier.shape[1]).fit(at[owners[held]], buckets[held], earlier[rows], y, weights)

        for k in range(len(names)):
            column = labels[:, k]
            out_of_fold = np.zeros(n)
            for fold in range(FOLDS if k + 1 < len(names) else 0):
                own = folds == fold
                if own.any():
                    out_of_fold[own] = fitted(~own, column).log_odds(owners, buckets, earlier)[own]
            models.append(fitted(np.ones(n, dtype=bool), column))
            earlier = np.concatenate([earlier, out_of_fold[:, None]], axis=1)
        return cls(names, models)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probabilities (texts, categories); 0 for texts without words."""
        table = np.stack([m.sparse for m in self.models], axis=1)
        out = np.zeros((len(texts), len(self.models)))
        for k, text in enumerate(texts):
            if not (found := words(text)):
                continue
            odds = table[features(found, self._known)].sum(axis=0, dtype=np.float64)
            chain: list[float] = []
            for j, model in enumerate(self.models):
                chain.append(float(odds[j] + np.dot(model.dense, chain) + model.bias))
            out[k] = sigmoid(np.array(chain))
        return out


def train(docs: DataFrame, labels: DataFrame, chain: Sequence[str] = CHAIN, quota: int = QUOTA, doc_id: str = "doc_id", text: str = "text") -> Chain | None:
    """A chain trained on a bounded sample of the labelled documents, None without any."""
    last = chain[-1]
    known = labels.where(F.col(doc_id).isNotNull() & F.col(last).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(*[F.avg(c).alias(f"_{k}") for k, c in enumerate(chain)])
    known = known.withColumn("_y", F.col(f"_{len(chain) - 1}") > 0.5)
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("_y"), min(1.0, quota / counts.get(True, 1))).otherwise(min(1.0, quota / counts.get(False, 1)))
    sample = known.where(draw < rate).orderBy(draw, "_id").limit(4 * quota)  # a fixed number of rows, so it may be broadcast; in order, so the same ones each time
    made = arrow_function(lambda texts: [features(words(t), {}).tobytes() for t in texts], "binary")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id").select("_id", *[f"_{k}" for k in range(len(chain))], made(F.col("_text")).alias("f"))
    rows = rows.orderBy(F.xxhash64("_id"), "f").limit(4 * quota).collect()
    rows = sorted(rows, key=lambda r: (str(r["_id"]), r["f"]))
    if not rows:
        return None
    values = np.array([[np.nan if r[f"_{k}"] is None else float(r[f"_{k}"] > 0.5) for k in range(len(chain))] for r in rows])
    folds = np.array([zlib.crc32(f"fold/{r['_id']}".encode()) % FOLDS for r in rows])
    return Chain.fit(chain, [np.frombuffer(r["f"], dtype=np.int32) for r in rows], values, folds)


def score(docs: DataFrame, chain: Chain | None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, toxic, toxic_score and the scores of the categories before, of each row."""
    names = chain.names if chain is not None else list(CHAIN)
    if chain is None:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(False).alias("toxic"), *[F.lit(0.0).alias(f"{n}_score") for n in reversed(names)])
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # models of fixed size

    def scored(texts: list[str | None]) -> list[dict]:
        return [dict(zip((f"{n}_score" for n in names), row, strict=True)) for row in shared.value.scores(texts).tolist()]

    made = arrow_function(scored, ", ".join(f"{n}_score double" for n in names))
    out = docs.select(F.col(doc_id).alias("doc_id"), made(F.col(text)).alias("r"))
    last = f"{names[-1]}_score"
    return out.select("doc_id", (F.col(f"r.{last}") > threshold).alias("toxic"), *[F.col(f"r.{n}_score").alias(f"{n}_score") for n in reversed(names)])
