"""The classifier chain: held-out accuracy, out-of-fold inputs, and tricky tables."""

import numpy as np
from pyspark.sql import functions as F

from quireline.llm import queries, toxicity


def test_held_out(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = toxicity.score(docs, toxicity.train(docs, labels.where(~held))).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").where(held).toPandas()
    assert len(out) > 500
    assert out[out.y == 1].toxic.mean() > 0.8 and out[out.y == 0].toxic.mean() < 0.02


def test_chain_feeds_later_models():
    """The second label follows the first, which the words tell: the chain passes it on."""
    draw = np.random.default_rng(0)
    first = draw.integers(0, 2, 600)
    rows = [np.array(sorted({int(b) for b in draw.integers(10, 4000, 20)} | ({1, 2} if y else {3})), dtype=np.int32) for y in first]
    chain = toxicity.Chain.fit(["a", "b"], rows, np.stack([first, 1 - first], axis=1).astype(float), np.arange(600) % toxicity.FOLDS)
    assert chain.models[1].dense.shape == (1,) and chain.models[1].dense[0] < 0
    one = toxicity.Chain.fit(["a", "b"], rows, np.stack([first, np.full(600, np.nan)], axis=1).astype(float), np.arange(600) % toxicity.FOLDS)
    assert not one.models[1].sparse.any()


def plain_scores(chain, text):
    """Each category's probability by one sum after another over the different words and their beginnings."""
    import math
    import re
    import zlib

    parts = set()
    for w in set(re.findall(r"\w+|[^\w\s]", (text or "").lower())):
        parts |= {w} | {f"{w[:n]}*" for n in (4, 5, 6, 7) if len(w) > n}
    if not parts:
        return [0.0] * len(chain.models)
    buckets = {zlib.crc32(p.encode()) % toxicity.BUCKETS for p in parts}
    odds = []
    for m in chain.models:
        odds.append(sum(float(m.sparse[b]) for b in buckets) + sum(w * o for w, o in zip(m.dense, odds)) + m.bias)
    return [1 / (1 + math.exp(-x)) for x in odds]


def test_query_against_plain(spark, sf_dir):
    """The registered query over whole texts against the plain chain of the same training."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = queries.op7_toxicity(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        quality, toxic = plain_scores(chain, texts[r.doc_id])
        assert abs(r.quality_score - quality) < 1e-5 and abs(r.toxic_score - toxic) < 1e-5 and r.toxic == (r.toxic_score > toxicity.THRESHOLD)


def test_plain_logistic_regression():
    """A model's weights are those of the same steps taken one number after another."""
    import math

    draw = np.random.default_rng(6)
    y = draw.integers(0, 2, 200)
    rows = [np.array(sorted({int(b) for b in draw.integers(100, 400, 8)} | ({7} if v and draw.random() < 0.8 else set())), dtype=np.int32) for v in y]
    owners, buckets = np.repeat(np.arange(200), [len(r) for r in rows]), np.concatenate(rows)
    model = toxicity.Linear(0).fit(owners, buckets, np.zeros((200, 0)), y.astype(float), np.ones(200))
    kept = np.flatnonzero(model.sparse).tolist()
    assert 7 in kept
    w = dict.fromkeys([*kept, "bias"], 0.0)
    m, v = dict(w), dict(w)
    for step in range(1, toxicity.STEPS + 1):
        error = [(1 / (1 + math.exp(-w["bias"] - sum(w[b] for b in r.tolist() if b in w))) - t) / 200 for r, t in zip(rows, y)]
        slope = {b: sum(e for e, r in zip(error, rows) if b in r) + toxicity.PENALTY * w[b] for b in kept} | {"bias": sum(error)}
        for k, g in slope.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            w[k] -= toxicity.RATE * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    assert all(abs(float(model.sparse[b]) - w[b]) < 1e-4 for b in kept) and abs(model.bias - w["bias"]) < 1e-4


def test_tricky(spark, tricky, nothing, sf_dir):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 1), (7, None, 1), (8, 0, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(tricky, labels)
    rows = toxicity.score(tricky, chain).collect()
    assert len(rows) == tricky.count()
    by = {r.doc_id: r for r in rows}
    assert all((by[k].toxic, by[k].toxic_score) == (False, 0.0) for k in (3, 4, 5))
    assert toxicity.train(tricky, labels.limit(0)) is None
    assert not any(r.toxic for r in toxicity.score(tricky, None).collect())
    assert toxicity.score(nothing, chain).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.op7_toxicity(spark, sf_dir)
    assert out.count() == docs.count() and out.columns == ["doc_id", "toxic", "toxic_score", "quality_score"]
