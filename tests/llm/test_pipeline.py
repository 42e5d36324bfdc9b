"""The corpus pipeline, stage by stage, against plain versions."""

import re

import public_tokenizers as P
import pytest

import corpus_pipeline
from quireline.llm import language, near_copies, pii, queries
from quireline.llm.scratch import cut
from tests.llm.test_operators import plain_pieces, plain_spans, plain_trusted


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "personal_data", "packing"]


def test_pipeline(spark, sf_dir, duck):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"test-{name}")
        outs.append(docs.toPandas())
    assert all(list(o.columns) == columns for o in outs[:-1])
    quality, spoken, single, masked, packed = outs
    kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({queries.quality_sql()}) WHERE kept").fetchall()}
    assert set(quality.doc_id) == kept and 0 < len(kept)
    assert set(spoken.doc_id) <= kept and len(spoken) > 0.98 * len(kept)  # all are prose in known languages
    assert set(single.doc_id) == plain_kept(dict(zip(spoken.doc_id, spoken.text, strict=True)))
    before = dict(zip(single.doc_id, single.text, strict=True))
    seen = {d: pii.occurrences(t, plain_spans(t)) for d, t in before.items()}
    trusted = plain_trusted([(p, i, s) for found in seen.values() for ps, i, _, _, s in found for p in ps])
    for d, t, n in zip(masked.doc_id, masked.text, masked.n_chars, strict=True):
        spans = [(s, e, k) for k, s, e in plain_spans(before[d])] + [(s, e, "context") for ps, _, s, e, seed in seen[d] if not seed and any(p in trusted for p in ps)]
        assert t == plain_masked(before[d], spans) and n == len(t) and not plain_spans(t)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: e.ids + [0] for d, e in zip(masked.doc_id, t.encode_batch(masked.text.tolist(), add_special_tokens=False), strict=True)}
    order = packed.sort_values(["sequence_id", "offset"]).doc_id.drop_duplicates().tolist()  # documents as they stand in the row of tokens
    expected = plain_pieces([(d, ids[d]) for d in order])
    assert sorted(map(tuple, packed.values.tolist())) == sorted(expected)


def plain_kept(texts):
    """The ids that stay of {id: text}: the least of each group by five-word shingles at 0.8."""
    sets = {}
    for d, t in texts.items():
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        sets[d] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    holders = {}
    for d in ids:
        for x in sets[d] or {()}:
            holders.setdefault(x, []).append(d)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(held[a], held[b]) for held in holders.values() for b in range(len(held)) for a in range(b)}
    for a, b in pairs:
        if not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(d) for d in ids}


def plain_masked(text, spans):
    out, at = "", 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += text[at:s] + f"[{k.upper()}]"
        at = max(at, e)
    return out + text[at:]


def test_run_and_edges(spark, sf_dir, tricky, nothing):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for docs in (tricky, nothing):
        columns, sizes = docs.columns, []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir), f"edge-{name}")
            assert docs.columns == columns, name
            sizes.append(docs.count())
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert sorted({r.doc_id or 0 for r in packed.collect()}) == sorted({r.doc_id or 0 for r in docs.collect()}) and sizes == sorted(sizes, reverse=True)
    assert sizes == [0, 0, 0, 0]


def test_stages_on_tricky_rows(spark, tricky):
    """What each docstring states of nulls, empties and repeats."""
    whole = corpus_pipeline.personal_data(spark, tricky, "")
    assert whole.count() == tricky.count() and {r.doc_id for r in whole.where("text IS NULL").collect()} == {3}
    single = sorted(r.doc_id or 0 for r in corpus_pipeline.near_duplicates(spark, tricky, "").collect())
    assert single == sorted(d or 0 for d in plain_kept_rows(tricky))
    assert not {3, 4, 5, 6} & {r.doc_id for r in corpus_pipeline.quality(spark, tricky, "").collect()}
    assert not {3, 4, 5} & {r.doc_id for r in corpus_pipeline.known_language(spark, tricky, "").collect()}


def plain_kept_rows(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect()]
    rows.sort(key=lambda x: (x[0] is None, x[0] or 0))  # null ids are the last to stay
    return [rows[k][0] for k in plain_kept({k: t for k, (_, t) in enumerate(rows)})]


def test_two_runs_keep_their_tables_apart(spark, tricky):
    first, second = corpus_pipeline.Pipeline(), corpus_pipeline.Pipeline()
    a = first.stages()[2][1](spark, tricky, "")
    b = cut(second.stages()[2][1](spark, tricky, ""), "written")
    second.stages()[3][1](spark, b, "")  # deletes what the second's stage before has cut
    assert a.count() > 0
    first.close(spark)


def test_nothing_labelled_keeps_all(spark, tricky):
    from pyspark.sql import functions as F

    blank = tricky.withColumn("lang", F.lit(None).cast("string"))
    assert language.train(blank).names == []
    assert corpus_pipeline.known_language(spark, blank, "").count() == blank.count()


@pytest.mark.parametrize("name", ["op1_language", "op9_secrets"])
def test_results_repeat(name, spark, sf_dir):
    """A second run gives the same rows."""
    once, again = (sorted(map(str, queries.queries()[name](spark, sf_dir).collect())) for _ in range(2))
    assert once == again


def test_near_copies_by_five_words(spark):
    """Copies with a few words replaced go, whatever their fingerprints; lesser likeness stays."""
    import random

    def plain(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    draw = random.Random(3)
    rows = []
    for k in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(250)]
        rows.append((10 * k, " ".join(words)))
        for j, changed in enumerate((3, 5, 5, 20)):
            new = words[:]
            for at in draw.sample(range(250), changed):
                new[at] = "other"
            rows.append((10 * k + j + 1, " ".join(new)))
    sets = [plain(t) for _, t in rows]
    roots = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and roots[a] != roots[b]:
                roots = [min(roots[a], roots[b]) if r in (roots[a], roots[b]) else r for r in roots]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {rows[r][0] for r in roots} == plain_kept(dict(rows)) and len(kept) < len(rows)
    small = near_copies.near_copies_dedup(docs, group_bytes=6_000)  # groups taken apart by key, keys in blocks
    assert {r.doc_id for r in small.collect()} == kept
