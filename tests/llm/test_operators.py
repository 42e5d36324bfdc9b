"""Each operator against brute force, and on tricky and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireline.llm import bpe, golay, hash_tree, host_quality, language, packing, pii, queries, secrets, simhash, topk
from quireline.llm.components import components, contractions

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tree():
    return bpe.TreeBPE.load(RANKS)


@pytest.fixture(scope="module")
def reference(tree):
    return tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=tree.ranks, special_tokens={})


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_against_sql(name, spark, sf_dir, duck, same):
    same(queries.queries()[name](spark, sf_dir).toPandas(), duck.sql(queries.oracle_sql()[name]).df())


# ---- 1: language ------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    own = out[out.held_out & out.lang.notna()]
    assert len(own) > 100 and (own.lang == own.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_language_gradients():
    draw = np.random.default_rng(1)
    network = language.ByteNetwork(3, hidden=3)
    for k, p in enumerate((network.table, network.recur, network.out, network.bias)):
        setattr(network, ("table", "recur", "out", "bias")[k], p.astype(np.float64))
    windows = draw.integers(97, 103, (4, 7)).astype(np.uint8)
    real = np.arange(7)[None, :] < np.array([7, 5, 7, 2])[:, None]
    labels, weights = np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 1.0, 0.5])
    _, grads = network.gradients(windows, real, labels, weights)
    for p, g in zip(network.parameters(), grads, strict=True):
        for at in [tuple(draw.integers(0, s) for s in p.shape) for _ in range(4)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            kept = p[at]
            p[at] = kept + 1e-3
            above = network.gradients(windows, real, labels, weights)[0]
            p[at] = kept - 1e-3
            below = network.gradients(windows, real, labels, weights)[0]
            p[at] = kept
            assert abs((above - below) / 2e-3 - g[at]) < 2e-3


def test_language_tricky(tricky, nothing):
    model = language.train(tricky)
    rows = language.identify(tricky, model).collect()
    assert len(rows) == tricky.count()
    by = {r.doc_id: r for r in rows}
    for k in (3, 4, 5):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert by[1].lang_pred in model.names and by[None].held_out is False
    empty = language.train(nothing)
    assert empty.names == [] and {r.lang_pred for r in language.identify(tricky, empty).collect()} == {"und"}
    assert language.identify(nothing, model).count() == 0


def plain_probabilities(network, raw):
    """Label probabilities at each position of some bytes by one scalar step after another, states carried through the whole text."""
    import math

    h = network.hidden
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    sides = []
    for side, order in ((0, range(len(raw))), (1, range(len(raw) - 1, -1, -1))):
        state, kept = [0.0] * h, {}
        for t in order:
            given = network.table[side, raw[t]]
            own = [sum(state[i] * network.recur[side, i, j] for i in range(h)) for j in range(3 * h)]
            z = [sigmoid(given[j] + own[j]) for j in range(h)]
            r = [sigmoid(given[h + j] + own[h + j]) for j in range(h)]
            c = [math.tanh(given[2 * h + j] + r[j] * own[2 * h + j]) for j in range(h)]
            state = [z[j] * state[j] + (1 - z[j]) * c[j] for j in range(h)]
            kept[t] = state
        sides.append(kept)
    out = []
    for t in range(len(raw)):
        logits = [sum(sides[s][t][j] * network.out[s, j, k] for s in (0, 1) for j in range(h)) + network.bias[k] for k in range(len(network.bias))]
        top = [math.exp(x - max(logits)) for x in logits]
        out.append([x / sum(top) for x in top])
    return np.array(out)


def test_language_against_plain_network(spark, sf_dir):
    """A trained model's pooled probabilities for short and long texts are those of the plain network over the whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs, quota=120)
    texts = [r.text for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(3).select("text").collect()]
    texts = ["a", "one two", *(t[:1500] for t in texts), None, ""]
    names, scores = model.predict(texts)
    for t, name, score in zip(texts[:-2], names, scores, strict=False):
        mean = plain_probabilities(model.network, t.encode()).mean(axis=0)
        assert model.names[int(mean.argmax())] == name and abs(mean.max() - score) < 0.02
    assert names[-2:] == ["und", "und"]


def test_language_windows_meet():
    """Cores cover each byte once, margins hold their neighbours, and states at the seams are near those of the whole text."""
    raw = bytes(range(1, 200)) * 9
    windows, sizes = language.cut_windows(raw, 256, 32)
    assert b"".join(bytes(w[32 : 32 + n]) for w, n in zip(windows, sizes, strict=True)) == raw
    assert bytes(windows[1][:32]) == raw[224:256] and bytes(windows[0][288:]) == raw[256:288]


def test_language_ties_and_many_languages(spark, monkeypatch):
    model = language.LanguageModel(language.ByteNetwork(2), ["a", "b"])
    for p in (model.network.out, model.network.bias):
        p[...] = 0
    assert model.predict(["some words " * 200])[0] == ["a"]  # even probabilities: the first name
    rows = [(k, f"text number {chr(97 + k % 26)} of language {k % 300}", f"l{k % 300:03d}") for k in range(900)]
    monkeypatch.setattr(language.LanguageModel, "fit", classmethod(lambda cls, samples: list(samples)))
    sample = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), quota=2)
    assert len({name for _, name in sample}) > 256 and len(sample) < 900


# ---- 2: quality -------------------------------------------------------------------------------------


def test_quality_tricky(tricky, nothing, same, spark):
    import duckdb

    got = host_quality.host_quality(tricky, ["doc_id"]).select("doc.doc_id", *host_quality.BASE, "base_failed", "kept").toPandas()
    db = duckdb.connect()
    frame = tricky.select("doc_id", "text", "source").toPandas()
    db.register("tricky", frame)
    same(got.astype({"doc_id": object}), db.sql(queries.quality_sql("tricky")).df())
    assert host_quality.host_quality(nothing, ["doc_id"]).count() == 0
    assert host_quality.host_quality(tricky, tricky.columns).select("doc.*").columns == tricky.columns


def lines_of(k, n=60):
    return " ".join(f"word{k}x{j}" for j in range(n))


def test_quality_query_turns_hosts_down(spark, tmp_path, same):
    """The registered query over documents of which hosts fail: one for its short texts, one for its symbols, which no base rule sees."""
    import duckdb

    rows = [(k, lines_of(k), f"good{k % 4}") for k in range(200)]
    rows += [(1000 + k, "too short", "short") for k in range(90)] + [(2000 + k, lines_of(k), "short") for k in range(10)]
    rows += [(3000 + k, lines_of(k) + " # | # | # | # |", "signs") for k in range(70)] + [(4000 + k, lines_of(k), "signs") for k in range(20)]
    rows += [(5000, "one short text", "tiny"), (5001, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_quality(spark, str(tmp_path)).toPandas()
    same(got.astype({"doc_id": object}), duckdb.sql(queries.quality_sql(f"'{tmp_path}/documents.parquet/*.parquet'")).df())
    out = got.set_index("doc_id")
    changed = out[out.kept == out.base_failed].index.tolist()
    assert sorted(changed) == [*range(2000, 2010), *range(3000, 3070), *range(4000, 4020)]
    rates = {r._host: r for r in host_quality.host_verdicts(host_quality.measured(spark.createDataFrame(rows, "doc_id long, text string, _host string"))).collect()}
    assert rates["signs"].rate_symbols > 0.5 > rates["signs"].rate_short and rates["short"].rate_short > 0.5 and not rates["good0"].host_failed


def test_quality_prior():
    """Hosts that differ no more than sampling does have the fallback; rates drawn from a beta give its strength back."""
    draw = np.random.default_rng(3)

    def fitted(n, f):
        return host_quality.prior(len(n), int(n.sum()), float((n * n).sum()), int(f.sum()), float((f * f / n).sum()))

    n = draw.integers(5, 60, 4000)
    mean, strength = fitted(n, draw.binomial(n, draw.beta(2, 6, len(n))))
    assert abs(mean - 0.25) < 0.02 and 6 < strength < 10.5
    assert fitted(np.full(10, 20), np.full(10, 5))[1] == host_quality.FALLBACK_STRENGTH
    assert host_quality.prior(0, 0, 0.0, 0, 0.0) == (0.0, host_quality.FALLBACK_STRENGTH)


# ---- 3: BPE -----------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab ", max_size=200) | st.text(alphabet="aeinrst", max_size=300))
def test_bpe_as_tiktoken(text):
    tree = bpe.TreeBPE.load(RANKS) if not hasattr(test_bpe_as_tiktoken, "tree") else test_bpe_as_tiktoken.tree
    test_bpe_as_tiktoken.tree = tree
    own = [t for p in bpe.TextCodec(tree, P.PATTERN).pieces(text) for t in tree.encode_piece(p.encode())]
    encoding = tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=tree.ranks, special_tokens={}) if not hasattr(tree, "peer") else tree.peer
    tree.peer = encoding
    assert own == encoding.encode_ordinary(text)
    assert tree.decode(own) == text.encode()


def test_bpe_long_pieces_and_joins(tree, reference):
    for text in ("a" * 3000, "ab" * 1500, "the" * 1000, "ß" * 700, "".join(chr(97 + k * k % 26) for k in range(4000))):
        ids = reference.encode_ordinary(text)
        assert tree.tree(text.encode()) == ids
        assert tree.join(tree.tree(text[:1111].encode()), tree.tree(text[1111:].encode())) == ids
    assert tree.join([], [5]) == [5]


@pytest.mark.parametrize("unit", ["a", "ab", "abc", "there", "é"])
def test_bpe_one_piece_of_a_million(tree, unit):
    """Long pieces cost about their length, periodic ones too; the heap gives the same."""
    import time

    piece = (unit * 1_000_000)[:1_000_000].encode()[:1_000_000]
    began = time.process_time()
    found = tree.tree(piece)
    assert time.process_time() - began < 20 and tree.decode(found) == piece
    assert found == tree._merged(piece)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400) | st.text(alphabet="aeinrst ", max_size=400).map(str.encode))
def test_bpe_heap(data):
    own = test_bpe_as_tiktoken.tree if hasattr(test_bpe_as_tiktoken, "tree") else bpe.TreeBPE.load(RANKS)
    test_bpe_as_tiktoken.tree = own
    parts = [data[k : k + 1] for k in range(len(data))]
    while True:
        pairs = [(own.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own.ranks]
        if not pairs:
            break
        k = min(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert own._merged_by_heap(data) == [own.ranks[x] for x in parts] == own.tree(data)


def test_bpe_tricky(tricky, nothing, reference):
    out = sorted(map(str, (tuple(r) for r in bpe.encode_decode(tricky, RANKS, P.PATTERN).collect())))
    expected = []
    for r in tricky.select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        expected.append(str((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode()))))
    assert out == sorted(expected)
    assert bpe.encode_decode(nothing, RANKS, P.PATTERN).count() == 0


def test_bpe_query(spark, sf_dir, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---- 4: SimHash -------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """The smallest member reachable from each of a list of fingerprints."""
    values = np.array(fps, dtype=np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(values ^ values[k]) <= 2)[0]:
            a, b = find(k), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_simhash_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    expected = {r.doc_id: (f"{f:016x}", docs[c].doc_id) for r, f, c in zip(docs, fps, plain_components(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, sf_dir).collect()}
    assert got == expected and len({c for _, c in expected.values()}) < len(docs)


def test_simhash_tricky(tricky, nothing):
    rows = simhash.simhash_components(tricky).collect()
    assert len(rows) == tricky.count()
    by = {r.doc_id: r for r in rows}
    assert {by[k].fingerprint for k in (3, 4, 5)} == {"0" * 16} and by[5].component_id == 3
    assert by[2].component_id == 1 and by[None].component_id is None
    kept = simhash.simhash_dedup(tricky)
    assert kept.columns == tricky.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert 1 in ids and 2 not in ids and 4 not in ids and 0 in ids
    assert simhash.simhash_components(nothing).count() == 0 and simhash.simhash_dedup(nothing).count() == 0


def test_golay_code():
    draw = np.random.default_rng(0)
    words = draw.integers(0, 1 << 23, 500)
    near = golay.nearby(words, 23)
    assert {len(set(r)) for r in near.tolist()} == {1, 6}
    for w, own in zip(words, near, strict=True):
        for bit in range(23):
            assert set(own) & set(golay.nearby(np.array([w ^ (1 << bit)]), 23)[0])


@pytest.mark.parametrize("crowd", [0, 200])
def test_links_lose_nothing(spark, crowd):
    """Random fingerprints, chains of near ones, and a crowd in one bucket that is too large for pairs."""
    draw = np.random.default_rng(crowd)
    flip = lambda f, n: f ^ int(sum(1 << int(b) for b in draw.choice(64, n, replace=False)))
    fps = {int(draw.integers(0, 1 << 63)) for _ in range(300)}
    for f in list(fps)[:60]:
        for n in (1, 2, 3):
            fps.add(f := flip(f, n))
    centre = int(draw.integers(0, 1 << 63))
    for k in range(crowd):
        fps.add(centre ^ (int(draw.integers(0, 1 << 8)) << 40))  # all in one segment: the others stay equal
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "_fp long")
    found = {r.node: r.component for r in components(simhash.links(df)).collect()}
    names = [found.get(s, s) for s in signed]
    expected = plain_components(fps)
    groups = lambda xs: sorted(sorted(k for k, y in enumerate(xs) if y == x) for x in set(xs))
    assert groups(names) == groups(expected)


def test_components(spark):
    edges = [(1, 2), (3, 2), (5, 4), (9, 9)] + [(100 + k, 101 + k) for k in range(50)] + [(200, k) for k in range(201, 260)]
    df = spark.createDataFrame(edges, "a long, b long")
    out = {r.node: r.component for r in components(df).collect()}
    assert out[3] == 1 and out[5] == 4 and 9 not in out and {out[k] for k in range(100, 151)} == {100} and {out[k] for k in range(200, 260)} == {200}
    assert components(df.limit(0)).count() == 0


def test_components_rounds(spark):
    """A chain of ascending numbers and one of shuffled numbers take rounds by the logarithm of their nodes."""
    chain = lambda names: spark.createDataFrame([(int(a), int(b)) for a, b in zip(names, names[1:])], "a long, b long").coalesce(1)
    assert len(contractions(chain(np.arange(1000)))) <= 20
    assert {r.component for r in components(chain(np.random.default_rng(5).permutation(300))).collect()} == {0}


# ---- 5: personal data -------------------------------------------------------------------------------

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain_spans(text):
    return [(kind, *m.span()) for kind, (p, good) in BASE.items() for m in re.finditer(p, text) if good(m[0])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@-_ +()4é", max_size=60) | st.from_regex(BASE["email"][0], fullmatch=False) | st.from_regex(r"\+?[0-9 .-]{10,30}"))
def test_pii_base(text):
    assert pii.base_spans(text) == plain_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ09._@+/-é ,٣", max_size=60))
def test_pii_runs(text):
    """The runs found around digits are those of one pass over all words that hold a digit."""
    assert list(pii.runs(text)) == [m.span() for m in pii._RUN.finditer(text) if re.search("[0-9]", m[0])]


def test_pii_cards():
    assert pii.base_spans("pay 4111 1111 1111 1111 or 4111-1111-1111-1112") == [("card", 4, 23)]
    assert pii.base_spans("1" * 20000 + " 0001.2.3.4 256.1.1.1") == [("ip", 20001, 20011)]


def test_pii_context(spark):
    rows = [(k, f"Some words here. Contact: user{k}@mail.example.com and more.") for k in range(6)]
    rows += [(10, "Contact: AB-12345 is new"), (11, "Other: AB-99999 stays"), (12, "Contact: nobody"), (13, None), (14, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find_personal(df).collect()}
    assert out[10].spans == "context:9:17" and out[11].spans == "" and out[12].n_context == 0 and out[13].spans == ""
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert masked[10] == "Contact: [CONTEXT] is new" and "[EMAIL]" in masked[0] and masked[13] is None and masked[14] == ""
    assert masked[11] == "Other: AB-99999 stays"


def test_pii_long_values_and_second_hop(spark, tmp_path):
    """The registered query adds spans: long values whole, and values in a pattern that only discovered ones share."""
    rows = [(k, f"Some words here. Contact: user{k}@mail.example.com and more.") for k in range(9)]
    long_ = "AB1-" + "9" * 60
    rows += [(20, f"Contact: {long_} end"), (21, "a" * 50 + ": 9988776655 end")]
    rows += [(30 + k, f"Contact: ZQX-{k}{k}{k}7{k} then") for k in range(4)] + [(40, "the file ZQX-5150123 was sent"), (41, "the file RST-5150123 was sent")]
    wide = "verylongcue" * 9  # of 99 characters
    rows += [(50 + k, f"{wide}: +49 30 1234567{k} calls") for k in range(4)] + [(60, f"{wide}: K-4433221 calls")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    assert out[20].spans == f"context:9:{9 + len(long_)}" and out[60].spans == f"context:{len(wide) + 2}:{len(wide) + 11}"
    assert out[40].spans == "context:9:20" and out[41].spans == "" and out[21].n_context == 0
    assert all(out[30 + k].n_context == 1 for k in range(4))
    masked = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert masked[20] == "Contact: [CONTEXT] end" and masked[40] == "the file [CONTEXT] was sent"
    assert len(out) == len(rows)


def plain_trusted(hits):
    """The graph's rounds over a list of (pattern, instance, seed), in dictionaries."""
    import math
    from collections import Counter, defaultdict

    seeds = {i for _, i, s in hits if s}
    edges = Counter((p, i) for p, i, _ in hits)
    own = defaultdict(set)
    for p, i in edges:
        own[p].add(i)
    own = {p: v for p, v in own.items() if len(v) >= 3}
    score, trusted = {i: float(i in seeds) for _, i in edges}, {}
    for _ in range(3):
        confidence = {p: sum(score[i] * edges[p, i] for i in v) / (sum(edges[p, i] for i in v) + 1) for p, v in own.items()}
        trusted = {p: c for p, c in confidence.items() if c >= 0.5 and sum(score[i] >= 0.5 for i in own[p]) >= 3}
        score = {i: 1.0 if i in seeds else 1 - math.prod(1 - trusted[p] for p in own if i in own[p] and p in trusted) for i in score}
    return trusted


def test_pii_graph(spark):
    draw = np.random.default_rng(4)
    hits = [(int(p), int(i), bool(i < 12)) for p, i in zip(draw.zipf(1.6, 900) % 40, draw.zipf(1.3, 900) % 60)]
    got = {r.p: r.confidence for r in pii.trusted_patterns(spark.createDataFrame(hits, "p long, i long, seed boolean")).collect()}
    expected = plain_trusted(hits)
    assert got.keys() == expected.keys() and len(expected) > 3
    assert all(abs(got[p] - c) < 1e-9 for p, c in expected.items())


def test_pii_query_against_plain(spark, sf_dir, tricky, nothing):
    """Base spans, counts and added spans of the registered query over whole texts, against the rules and the plain graph."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    seen = {d: pii.occurrences(t or "", plain_spans(t or "")) for d, t in texts.items()}
    trusted = plain_trusted([(p, i, s) for found in seen.values() for ps, i, _, _, s in found for p in ps])
    for r in queries.op5_pii(spark, sf_dir).collect():
        base = plain_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        new = [f"context:{s}:{e}" for ps, _, s, e, seed in seen[r.doc_id] if not seed and any(p in trusted for p in ps)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans == ",".join([*([joined] if joined else []), *new])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in BASE)
    assert pii.find_personal(tricky).count() == tricky.count() and pii.find_personal(nothing).count() == 0
    assert pii.redact(tricky).columns == tricky.columns and pii.redact(nothing).count() == 0


def test_pii_long_text():
    import time

    text = "".join(f"id{k} = X{k:07d}, mail{k}@a.example.com; " for k in range(60_000))
    began = time.process_time()
    found = pii.occurrences(text, pii.base_spans(text))
    assert len(found) == 120_000 + 59_000 and time.process_time() - began < 60


# ---- 6: top k ---------------------------------------------------------------------------------------


def plain_topk(ids, v, k=20):
    expected = []
    for q in [n for n, i in enumerate(ids) if i % 20 == 0]:
        scored = sorted((-int(v[q] @ v[n]), ids[n]) for n in range(len(ids)) if n != q)[:k]
        expected += [(ids[q], r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(expected)


@pytest.mark.parametrize("shape", ["clusters", "ties", "spread"])
def test_topk_brute(spark, monkeypatch, shape):
    """Many leaves, leaves of several shards, several blocks, and ties across the twentieth rank."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 10)
    draw = np.random.default_rng(2)
    if shape == "ties":  # few different vectors: every twentieth rank is a tie
        vectors = draw.integers(-1, 2, (900, 3)).astype(float)
    elif shape == "spread":
        vectors = draw.normal(0, 1, (900, 6)) * draw.gamma(1, 3, (900, 1))
    else:
        centres = draw.normal(0, 1, (6, 12))
        vectors = np.round(centres[draw.integers(0, 6, 900)] + draw.normal(0, 0.2, (900, 12)), 1)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)] + [(20, vectors[20].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    v = np.floor(64 * np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64))
    got = sorted(map(tuple, topk.top_inner_products(df).collect()))
    assert got == plain_topk([r[0] for r in rows], v) and len(got) == 20 * 46


def test_topk_of_many_lengths(spark, monkeypatch):
    """Vectors of lengths that the sample misses, null ids and wild values beside ordinary ones."""
    monkeypatch.setattr(topk, "PILOT_ROWS", 4)
    monkeypatch.setattr(topk, "SAMPLED", 1)
    draw = np.random.default_rng(8)
    rows = [(k, draw.integers(-9, 9, 1 + k % 7).astype(float).tolist()) for k in range(300)]
    rows += [(1000 + 20 * k, [1e300 * (k % 2), 2.0, 3.0]) for k in range(3)]
    got = sorted(map(tuple, topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)).collect()))
    expected = []
    whole = [(i, [int(np.floor(64 * x)) if abs(64 * x) < 2**53 else int(64 * x) for x in v]) for i, v in rows]
    for i, q in whole:
        if i % 20 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in whole if j != i and len(v) == len(q))
            expected += [(i, r + 1, j, -x) for r, (x, j) in enumerate(scored[:20])]
    assert got == sorted(expected)


def test_topk_prunes(spark, monkeypatch):
    """Of well-parted clusters, queries go to few leaves."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    draw = np.random.default_rng(7)
    centres = 40 * np.eye(16)
    vectors = np.concatenate([c + draw.normal(0, 0.3, (100, 16)) for c in centres])
    asked = []
    kept = topk._dealt
    monkeypatch.setattr(topk, "_dealt", lambda rows, asks, *more: (asked.append(asks.count()), kept(rows, asks, *more))[1])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_inner_products(df).collect()))
    assert got == plain_topk(list(range(1600)), np.floor(64 * vectors)) and asked[0] == 80 and asked[1] < 80 * 6


def test_topk_tricky(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (1, [1.0, 2.0]), (2, [3.0]), (3, []), (100, []), (None, [0.5, 0.5]), (5, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [tuple(r) for r in topk.top_inner_products(df).orderBy("query_id", "rank").collect()]
    assert [r for r in out if r[0] == 100] == [(100, 1, 3, 0)]
    assert [(r[2], r[3]) for r in out if r[0] == 0] == [(5, 2**63 - 1), (1, 64 * 64 + 128 * 128), (None, 64 * 32 + 128 * 32)]
    assert topk.top_inner_products(df.limit(0)).count() == 0


# ---- 8: shards --------------------------------------------------------------------------------------


def plain_shard(key, weights):
    """The descent, node by node."""
    import math

    def least(prefix, weights):
        draws = [-math.log((int(hashlib.md5(f"{key}/{prefix}{i}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / w for i, w in enumerate(weights)]
        return draws.index(min(draws))

    tree = [[weights[k : k + 2] for k in range(g, min(g + 4, len(weights)), 2)] for g in range(0, len(weights), 4)]
    region = least("", [sum(map(sum, g)) for g in tree])
    rack = least(f"{region}.", [sum(x) for x in tree[region]])
    return region * 4 + rack * 2 + least(f"{region}.{rack}.", tree[region][rack])


def test_shards(spark, tricky, nothing):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    out = hash_tree.shard(docs, [1.0] * 9, 8).toPandas()
    assert set(out["size"]) == {3} and set(out.text_crc32) == {zlib.crc32("é".encode())}
    assert out.groupby("shard").size().between(400, 600).all() and ((out.grown_shard == out.shard) | (out.grown_shard == 8)).all()
    assert 300 < (out.grown_shard == 8).sum() < 600
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    rows = hash_tree.shard(tricky, [1.0] * 9, 8).collect()
    assert len(rows) == tricky.count() and {r.size for r in rows if r.doc_id in (3, 4)} == {1}
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and hash_tree.shard(nothing, [1.0] * 9, 8).count() == 0


def test_shards_of_unlike_weights(spark):
    """Shares follow weights at every level, and a change of one shard's weight moves documents at no node outside its path."""
    weights, heavier = [1.0, 3.0, 2.0, 2.0, 0.5, 0.5, 4.0, 1.0, 2.0], [1.0, 3.0, 2.0, 5.0, 0.5, 0.5, 4.0, 1.0, 2.0]
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = (hash_tree.shard(docs, w, 9).toPandas().set_index("doc_id").shard.sort_index() for w in (weights, heavier))
    assert a.tolist() == [plain_shard(k, weights) for k in range(6000)]
    share = a.value_counts(normalize=True).sort_index().to_numpy()
    assert np.abs(share - np.array(weights) / sum(weights)).max() < 0.02
    moved = a != b
    assert set(b[moved] // 4) == {0}  # all that moves goes into the region whose weight rose
    inside = moved & (a // 4 == 0)
    assert set(b[inside] // 2) == {1} and set(b[inside & (a // 2 == 1)]) == {3}


def test_shards_against_sql(spark, tmp_path, same):
    """Unlike weights and a hot id, by the SQL that descends."""
    import duckdb

    rows = [(None, f"text {k % 7}") for k in range(600)] + [(k, f"é{k}") for k in range(300)] + [(5, "twice"), (5, "twice"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/d.parquet")
    weights = [1.0, 2.0, 0.5, 1.0, 3.0, 1.0]
    got = hash_tree.shard(df, weights, 5).toPandas()
    same(got.astype({"doc_id": "Int64"}), duckdb.sql(queries.shard_sql(weights, 5, f"'{tmp_path}/d.parquet/*.parquet'")).df().astype({"doc_id": "Int64"}))


# ---- 9: secrets -------------------------------------------------------------------------------------

SECRETS = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "APIKEY", " ", "=", ":", '"', "'", "abc123", "AKIA", "Z" * 17, "deadbeef" * 3, "x", "\n", "é", "K"]), max_size=14).map("".join))
def test_secret_base(text):
    order = list(SECRETS)
    found = sorted((m.start(), order.index(k), m.end()) for k, (p, good) in SECRETS.items() for m in re.finditer(p, text) if good(m))
    assert secrets.base_spans(text) == [(s, order[k], e) for s, k, e in found]


def test_secret_random():
    scanner = secrets.Scanner(RANKS, P.PATTERN)
    exposed = lambda t: [t[s:e] for s, _, e in scanner.added(t, secrets.base_spans(t))]
    assert exposed("key xK9fQ2vLm8TzR4wPn7YbJ3 end") == ["xK9fQ2vLm8TzR4wPn7YbJ3"]
    for clean in ("Donaudampfschifffahrtsgesellschaft", "123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "get_user_profile_by_identifier_v2", "2024010112345678901234", "internationalization localization"):
        assert exposed(clean) == [], clean


def test_secret_random_of_few_digits():
    """Tokens a character decide, not how many digits or cases a run has."""
    import random

    scanner = secrets.Scanner(RANKS, P.PATTERN)
    draw = random.Random(1)
    for alphabet in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789"):
        runs = ["".join(draw.choices(alphabet, k=20)) for _ in range(300)]
        assert sum(bool(scanner.added(r, [])) for r in runs) >= 298, alphabet
    for clean in ("antidisestablishmentarianism", "MAX_CONNECTION_POOL_SIZE_DEFAULT", "2024-01-02/2024-05-06+11", "usr/share/doc/python3/examples"):
        assert scanner.added(clean, []) == [], clean


def plain_random(text, base, reference):
    """Runs of 20 or more that touch no base span, are no digest, UUID or number, and need a token for every two characters."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", text):
        run = m[0]
        known = re.fullmatch("[0-9a-fA-F]+", run) and len(run) in (32, 40, 56, 64, 96, 128)
        uuid = re.fullmatch("-".join(f"[0-9a-fA-F]{{{n}}}" for n in (8, 4, 4, 4, 12)), run)
        if known or uuid or not re.search("[A-Za-z]", run) or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if len(run) / len(reference.encode_ordinary(run)) <= 2:
            out.append((m.start(), "random", m.end()))
    return out


def plain_secrets(text):
    order = list(SECRETS)
    found = sorted((m.start(), order.index(k), m.end()) for k, (p, good) in SECRETS.items() for m in re.finditer(p, text) if good(m))
    return [(s, order[k], e) for s, k, e in found]


def test_secret_query_against_plain(spark, tmp_path, sf_dir, tricky, nothing, reference):
    """The registered query over the tables and over a folder where it adds spans."""
    import random

    draw = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(draw.choices(alphabet, k=n))
    rows = [(k, f"use {key(24 + k)} here, password = {key(9)} and {'deadbeef' * 4} or {key(40)}== twice {key(22)}") for k in range(40)]
    rows += [(100, None), (101, ""), (102, "plain words only"), (103, key(3000)), (104, " ".join(f"token={key(30)}" for _ in range(3000)))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert secrets.scan(tricky, RANKS, P.PATTERN).count() == tricky.count() and secrets.scan(nothing, RANKS, P.PATTERN).count() == 0
    added = 0
    for folder in (sf_dir, str(tmp_path)):
        texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
        for r in queries.op9_secrets(spark, folder).collect():
            base = plain_secrets(texts[r.doc_id])
            new = plain_random(texts[r.doc_id], base, reference)
            joined = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
            assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in SECRETS)
            assert r.spans == joined(sorted(base + new, key=lambda x: (x[0], [*SECRETS, "random"].index(x[1])))) and r.n_random == len(new)
            added += len(new)
    assert added > 100


# ---- 10: packing ------------------------------------------------------------------------------------


def plain_pieces(docs):
    """Pieces of (doc_id, ids) in order."""
    out, at = [], 0
    for key, ids in docs:
        n, a = len(ids), 0
        while a < n:
            s, o = divmod(at + a, 1024)
            b = min(n, a + 1024 - o)
            out.append((key, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()), n, s, o))
            a = b
        at += n
    return out


def test_packing(spark, sf_dir, tricky, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    special = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 3), (3, "<|endoftext|"), (4, "é<|endoftext|>日本")], "doc_id long, text string").coalesce(1)
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), tricky.coalesce(1), special):
        rows = df.select("doc_id", "text").collect()
        ids = [e.ids + [0] for e in t.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
        got = packing.pack(df, JSON, P.PATTERN).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_pieces(zip([r.doc_id for r in rows], ids, strict=True))))
    spread = packing.pack(tricky.repartition(4), JSON, P.PATTERN).toPandas()
    whole = spread.sort_values(["sequence_id", "offset"])
    ends = whole.groupby("sequence_id")["length"].sum().tolist()
    assert set(ends[:-1]) <= {1024} and (whole.groupby("sequence_id")["offset"].apply(lambda s: s.iloc[0]) == 0).all()
    assert packing.pack(nothing, JSON, P.PATTERN).count() == 0


def test_packing_vocabulary_is_closed():
    """Every token, merged from its bytes, is itself: the ground for merging by ranks."""
    import json

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(JSON).model
    vocabulary = json.load(open(JSON, encoding="utf-8"))["model"]["vocab"]
    assert all([x.id for x in model.tokenize(t)] == [i] for t, i in vocabulary.items() if not t.startswith("<|"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", "<|", "endoftext", "|>", " ", "a", "é", "日", "\n"]), max_size=9).map("".join))
def test_packing_ids(text):
    own = getattr(test_packing_ids, "own", None) or packing.VocabularyTokenizer(JSON, P.PATTERN)
    test_packing_ids.own = own
    assert np.frombuffer(own.encode(text), dtype=own.dtype).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
