"""Exact top-k inner-product search with ball trees.

Rows are dealt to shards by place: a tree of halving planes, fitted to a bounded sample, gives each
row its leaf, and a leaf is a ball around the sample's centre there with the radius of all its rows.
A leaf of more than ``SHARD_ROWS`` rows is several shards of one ball, dealt by a hash.

A query's first kth score is that over a bounded pilot of rows. It then goes to the leaf of highest
bound ``q.c + |q| r``; the kth score found there is shared with all other leaves: the query goes only
to those whose bound can still reach it. Within a shard, a ball tree is searched by branch and bound
for many queries at once: nodes come from a heap by their upper bound, and a node is entered only by
queries whose current kth score it can reach. A shard's tree is built once for each block of up to
``BLOCK_ROWS`` queries that come to it; the queries of a block stream past it.

Components become floor(64 x) first, so all scores are integers; float64 holds them exactly while
they stay under 2^53. Rows with a component that could pass that are a leaf of their own, which every
query visits, and are queries that visit every leaf; scores with them are made in Python integers,
those beyond 64 bits counting as the nearest 64-bit value.

Defined results: vectors that are null, or hold a null or a component that is not finite (64-fold), take no part; neither
do rows with a null id as queries (they are candidates); vectors are compared with those of the same
length only; an empty vector scores 0; a query's own row is that row alone, so a repeated row is a
candidate for its twin; ties go to the smaller id, nulls last; an id of 2^63 - 1 counts as null; other columns are
dropped first, so their names clash with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireline.llm.scratch import cut, drop, recorded, small

K, EVERY, SCALE = 20, 20, 64
#: Rows of a shard, queries that share one tree and rows of the pilot, about; memory of a task follows the first, and ``TOGETHER``.
SHARD_ROWS, BLOCK_ROWS, PILOT_ROWS = 32_768, 65_536, 1_024
#: Leaves at most, and sampled rows for each: the driver holds their product in vectors, however large the table is.
MAX_LEAVES, SAMPLED = 2_048, 8
#: Queries that go down a tree together.
TOGETHER = 2_048
LEAF = 128
#: Of points that are split at a gap, the least share on either side, and the least share of their spread that is a gap.
MIN_SIDE, WIDE = 1 / 32, 1 / 8
_EXACT = float(2**53)
_NULL_ID = np.iinfo(np.int64).max
#: Leaves that queries come to up to which their table is broadcast; a longer one (of very many lengths) is joined by a shuffle.
MAX_BROADCAST = 100_000
#: The leaf of rows whose scores float64 may not hold.
_WILD = -1


class BallTree:
    """Balls over the rows of ``vectors``; a node is (first, last, centre, radius, children or None) over the order of ``rows``."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors, self.rows, self.nodes = vectors, np.arange(len(vectors)), []
        self._build(0, len(vectors), leaf)

    def _build(self, first: int, last: int, leaf: int) -> int:
        own = self.rows[first:last]
        points = self.vectors[own]
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max(initial=0.0)))
        at = len(self.nodes)
        self.nodes.append(None)
        children = None
        if last - first > leaf and radius > 0:
            order = np.argsort(points @ long_direction(points, centre), kind="stable")
            self.rows[first:last] = own[order]
            middle = (first + last) // 2
            children = (self._build(first, middle, leaf), self._build(middle, last, leaf))
        self.nodes[at] = (first, last, centre, radius, children)
        return at


def long_direction(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """From the point farthest from the centre to the one farthest from that."""
    far = points[((points - centre) ** 2).sum(axis=1).argmax()]
    return points[((points - far) ** 2).sum(axis=1).argmax()] - far


class Places:
    """Leaves over vectors of one length, from a sample: where a vector belongs, and each leaf's centre."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.planes: list[tuple[np.ndarray, float, int, int] | int] = []  # a plane and its two sides, or a leaf's number
        self.centres: list[np.ndarray] = []
        self._split(sample, leaves)
        self.centres = np.array(self.centres).reshape(len(self.centres), sample.shape[1])

    def _split(self, points: np.ndarray, leaves: int) -> int:
        """Along the line between two far points: at a wide gap, which parts clusters, else at the median."""
        at = len(self.planes)
        self.planes.append(len(self.centres))
        centre = points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
        direction = long_direction(points, centre) if leaves > 1 and len(points) > 1 else np.zeros(points.shape[1])
        along = points @ direction
        cut_at = float(np.median(along)) if len(points) else 0.0
        ordered = np.sort(along)[int(MIN_SIDE * len(along)) : len(along) - int(MIN_SIDE * len(along))]
        gaps = np.diff(ordered)
        if len(gaps) and gaps.max() > WIDE * (ordered[-1] - ordered[0]):
            cut_at = float(ordered[gaps.argmax() : gaps.argmax() + 2].mean())
        right = along > cut_at
        if not right.any():
            self.centres.append(centre)
            return at
        self.planes[at] = None
        share = min(leaves - 1, max(1, round(leaves * float(right.mean()))))
        sides = self._split(points[~right], leaves - share), self._split(points[right], share)
        self.planes[at] = (direction, cut_at, *sides)
        return at

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(vectors), dtype=np.int32)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            at, own = waiting.pop()
            plane = self.planes[at]
            if isinstance(plane, int):
                out[own] = plane
            elif len(own):
                direction, cut_at, left, right = plane
                over = vectors[own] @ direction > cut_at
                waiting += [(left, own[~over]), (right, own[over])]
        return out


def _better(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row of scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def reach(queries: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """An upper bound (queries, balls) of the inner products with points of each ball, rounding allowed for."""
    top = queries @ centres.T + norms[:, None] * radii
    return top + 1e-9 * (np.abs(top) + norms[:, None] * (radii + np.abs(centres).sum(axis=1)) + 1)


def search(tree: BallTree, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores (-inf where there is none) and ids of each query's k best; ``own``: its row, ``floor``: a score that its kth best has at least."""
    n = len(queries)
    best = np.full((n, k), -np.inf)
    best_ids = np.full((n, k), _NULL_ID, dtype=np.int64)
    kth = floor.astype(np.float64).copy()
    if not len(tree.vectors):
        return best, best_ids
    norms = np.sqrt((queries**2).sum(axis=1))
    heap, turn = [], 0

    def push(node: int, among: np.ndarray) -> None:
        nonlocal turn
        _, _, centre, radius, _ = tree.nodes[node]
        top = reach(queries[among], norms[among], centre[None, :], np.array([radius]))[:, 0]
        keep = top >= kth[among]
        if keep.any():
            turn += 1
            heapq.heappush(heap, (-float(top[keep].max()), turn, node, among[keep], top[keep]))

    push(0, np.arange(n))
    while heap:
        _, _, node, among, top = heapq.heappop(heap)
        among = among[top >= kth[among]]  # kth scores have risen meanwhile
        if not len(among):
            continue
        first, last, _, _, children = tree.nodes[node]
        if children is not None:
            for child in children:
                push(child, among)
            continue
        members = tree.rows[first:last]
        scores = queries[among] @ tree.vectors[members].T
        scores[own[among][:, None] == rows[members][None, :]] = -np.inf
        keep = scores.max(axis=1) >= kth[among]
        among, scores = among[keep], scores[keep]
        if not len(among):
            continue
        most = int((scores >= kth[among][:, None]).sum(axis=1).max())  # so many columns hold all that can enter a query's best
        columns = np.argpartition(-scores, min(most, len(members)) - 1, axis=1)[:, :most]
        best[among], best_ids[among] = _better(
            np.concatenate([best[among], np.take_along_axis(scores, columns, axis=1)], axis=1),
            np.concatenate([best_ids[among], ids[members][columns]], axis=1),
            k,
        )
        kth[among] = np.maximum(kth[among], best[among, k - 1])
    return best, best_ids


def _brute(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """The same in Python integers."""
    whole = [[int(x) for x in v] for v in vectors]
    out = []
    for q, o in zip(queries, own, strict=True):
        q = [int(x) for x in q]
        scored = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), i) for v, i, r in zip(whole, ids, rows, strict=True) if r != o]
        out.append([(-s, int(i)) for s, i in heapq.nsmallest(k, scored)])
    return out


def _matrix(values: pd.Series, size: int) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64).reshape(len(values), size) if len(values) else np.zeros((0, size))


def _wild(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose inner product with another that is not wild either might pass 2^53."""
    largest = np.abs(vectors).max(axis=1, initial=0.0)
    return largest >= np.sqrt(_EXACT / max(vectors.shape[1], 1))


def integers(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """_id, _v (array of double, floor(64 x)) of the rows that take part."""
    x = F.col(vector)
    times = lambda c: c.cast("double") * SCALE
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(times(c)) == float("inf")))
    whole = F.transform(x, lambda c: F.when(F.abs(times(c)) < 2.0**53, F.floor(times(c)).cast("double")).otherwise(times(c)))  # larger doubles are whole
    return embeddings.select(F.col(vec_id).cast("long").alias("_id"), whole.alias("_v")).where(fine)


def _by_size(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the frame, vectors) for each length of vectors in a frame."""
    sizes = pdf["_size"].to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, _matrix(pdf["_v"].iloc[at], int(size))


_CANDIDATES = "_own long, query_id long, vec_id long, score long"


def _searched(k: int):
    """A function of frames in order of unit and kind, a shard's rows (kind 0) before the queries (kind 1) that search it."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, held, ready = None, [], None
        for batch in batches:
            start = 0
            units, kinds = batch["_unit"].to_numpy(), batch["_kind"].to_numpy()
            while start < len(batch):
                stop = start + 1
                same = (units[start:] == units[start]) & (kinds[start:] == kinds[start])
                stop = start + (int(np.argmin(same)) if not same.all() else len(same))
                part, start = batch.iloc[start:stop], stop
                if part["_unit"].iloc[0] != unit:
                    unit, held, ready = part["_unit"].iloc[0], [], None
                if part["_kind"].iloc[0] == 0:
                    held.append(part[["_id", "_row", "_size", "_v"]])
                    continue
                size = int(part["_size"].iloc[0])
                if ready is None:
                    rows = pd.concat(held) if held else part.iloc[:0]
                    held, vectors = [], _matrix(rows["_v"], size)
                    strange = bool(_wild(vectors).any())
                    ready = None if strange else BallTree(vectors), vectors, rows["_id"].to_numpy(dtype=np.int64), rows["_row"].to_numpy(dtype=np.int64)
                for at in range(0, len(part), TOGETHER):
                    yield _answers(part.iloc[at : at + TOGETHER], size, *ready, k)

    return found


def _answers(asks: pd.DataFrame, size: int, tree: BallTree | None, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    queries = _matrix(asks["_v"], size)
    own, asked = asks["_row"].to_numpy(dtype=np.int64), asks["_id"].to_numpy(dtype=np.int64)
    out: list[np.ndarray] = []
    exact = ~_wild(queries) if tree is not None else np.zeros(len(queries), dtype=bool)
    if exact.any():
        best, found = search(tree, ids, rows, queries[exact], own[exact], asks["_floor"].to_numpy(dtype=np.float64)[exact], k)
        q, c = np.nonzero(best > -np.inf)
        out.append(np.stack([own[exact][q], asked[exact][q], found[q, c], best[q, c].astype(np.int64)], axis=1))
    if not exact.all():
        odd = ~exact
        scored = _brute(vectors, ids, rows, queries[odd], own[odd], k)
        out.append(np.array([(o, i, j, s) for o, i, pairs in zip(own[odd], asked[odd], scored, strict=True) for s, j in pairs], dtype=np.int64).reshape(-1, 4))
    return pd.DataFrame(np.concatenate(out), columns=["_own", "query_id", "vec_id", "score"])


def _dealt(rows: DataFrame, asks: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """Candidates (_own, query_id, vec_id, score) from ``asks`` (with _leaf and _floor) in the leaves they name.

    ``shards`` has _size, _leaf, _subs: in how many shards a leaf lies. Queries of a shard are dealt to
    as many blocks as they need; each brings the shard's rows once.
    """
    key = ["_size", "_leaf"]
    wanted = asks.groupBy(*key).agg(F.count(F.lit(1)).alias("_asks"))
    units = small(cut(wanted.join(shards, key).withColumn("_blocks", F.ceil(F.col("_asks") / BLOCK_ROWS).cast("int")), "units"), MAX_BROADCAST)
    unit = F.xxhash64(*key, "_sub", "_block").alias("_unit")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    offers = rows.join(units, key).withColumns({"_sub": F.pmod(F.xxhash64("_row"), F.col("_subs")).cast("int"), "_block": F.explode(upto("_blocks"))})
    asking = asks.join(units, key).withColumns({"_block": F.pmod(F.xxhash64("_row", F.lit(1)), F.col("_blocks")).cast("int"), "_sub": F.explode(upto("_subs"))})
    columns = ["_id", "_row", "_size", "_v"]
    both = offers.select(unit, F.lit(0).alias("_kind"), *columns, F.lit(0.0).alias("_floor")).union(asking.select(unit, F.lit(1).alias("_kind"), *columns, "_floor"))
    return both.repartition("_unit").sortWithinPartitions("_unit", "_kind").mapInPandas(_searched(k), _CANDIDATES)


def top_inner_products(embeddings: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose id is divisible by ``every``, among all other rows."""
    spark = embeddings.sparkSession
    with recorded() as passing:
        # A null id goes through pandas as the largest long: it would turn the column into floats.
        vectors = integers(embeddings, vec_id, vector).select(F.coalesce("_id", F.lit(int(_NULL_ID))).alias("_id"), "_v")
        vectors = cut(vectors.withColumns({"_row": F.monotonically_increasing_id(), "_size": F.size("_v")}), "vectors")
        n = vectors.count()
        leaves = min(MAX_LEAVES, max(1, -(-n // SHARD_ROWS)))
        some = max(PILOT_ROWS, SAMPLED * leaves)
        sample = vectors.where(F.pmod(F.xxhash64("_row", F.lit(2)), F.lit(max(1, n // some))) == 0).limit(2 * some).select("_size", "_row", "_v").toPandas()
        known: dict[int, tuple[Places, np.ndarray, np.ndarray]] = {}
        for size, at, points in _by_size(sample):
            tame = ~_wild(points)
            points, at = points[tame], at[tame]
            known[size] = Places(points, max(1, leaves * len(points) // max(len(sample), 1))), points[:PILOT_ROWS], sample["_row"].to_numpy(dtype=np.int64)[at][:PILOT_ROWS]
        shared = spark.sparkContext.broadcast(known)  # at most 2 * some vectors

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                leaf, far = np.zeros(len(pdf), dtype=np.int32), np.zeros(len(pdf))
                for size, at, points in _by_size(pdf):
                    if size in shared.value:
                        places = shared.value[size][0]
                        own = places.leaf_of(points)
                        leaf[at], far[at] = own, np.sqrt(((points - places.centres[own]) ** 2).sum(axis=1))
                    leaf[at] = np.where(_wild(points), _WILD, leaf[at])
                yield pdf.assign(_leaf=leaf, _far=far)

        rows = cut(vectors.mapInPandas(placed, "_id long, _v array<double>, _row long, _size int, _leaf int, _far double"), "placed")
        balls = rows.groupBy("_size", "_leaf").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("radius"))
        balls = cut(balls, "balls")
        shards = balls.select("_size", "_leaf", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("_subs"))
        sampled = balls.where(F.col("_size").isin(*known)) if known else balls.limit(0)
        radii = {(r["_size"], r["_leaf"]): r["radius"] for r in sampled.collect()}  # a row for each leaf, of which there are MAX_LEAVES and one for each sampled length at most
        bounds = spark.sparkContext.broadcast(radii)
        asks = rows.where((F.col("_id") % every == 0) & (F.col("_id") != int(_NULL_ID))).select("_id", "_row", "_size", "_v")

        def aimed(first: bool):
            """Each query beside the leaf of highest bound (``first``), or all others that its kth score does not rule out."""

            def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    for start in range(0, len(pdf), TOGETHER):
                        yield from chunk(pdf.iloc[start : start + TOGETHER])

            def chunk(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
                for size, at, queries in _by_size(pdf):
                    own = pdf.iloc[at]
                    # A length that the sample has missed has one leaf, and the one of wild rows.
                    names = np.array(sorted(leaf for s, leaf in bounds.value if s == size) or (_WILD, 0), dtype=np.int32)
                    floor = own["_floor"].to_numpy(dtype=np.float64).copy() if not first else np.full(len(own), -np.inf)
                    norms = np.sqrt((queries**2).sum(axis=1))
                    top = np.full((len(own), len(names)), np.inf)
                    strange = _wild(queries)
                    if size in shared.value:
                        places, pilot, pilot_rows = shared.value[size]
                        tame = names != _WILD
                        top[:, tame] = reach(queries, norms, places.centres[names[tame]], np.array([bounds.value[size, leaf] for leaf in names[tame]]))
                        if first and len(pilot) > k:
                            scores = queries @ pilot.T
                            scores[own["_row"].to_numpy(dtype=np.int64)[:, None] == pilot_rows[None, :]] = -np.inf
                            floor = np.partition(scores, -k, axis=1)[:, -k]
                    top[strange], floor[strange] = np.inf, -np.inf
                    highest = top.argmax(axis=1)
                    chosen = np.zeros(top.shape, dtype=bool)
                    chosen[np.arange(len(own)), highest] = True
                    if not first:
                        chosen = ~chosen & (top >= floor[:, None])
                    q, c = np.nonzero(chosen)
                    made = own.iloc[q][["_id", "_row", "_size", "_v"]]
                    yield made.assign(_leaf=names[c], _floor=floor[q])

            return out

        kind = "_id long, _row long, _size int, _v array<double>, _leaf int, _floor double"
        nearest = cut(asks.mapInPandas(aimed(True), kind), "nearest")
        near = cut(_dealt(rows, nearest, shards, k), "near")
        order = Window.partitionBy("_own").orderBy(F.desc("score"), F.asc("vec_id"))
        full = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select(F.col("_own").alias("_row"), F.col("score").cast("double").alias("_kth"))
        risen = nearest.drop("_leaf").join(full, "_row", "left").withColumn("_floor", F.greatest("_floor", F.coalesce("_kth", F.lit(float("-inf"))))).drop("_kth")
        further = cut(risen.select("_id", "_row", "_size", "_v", "_floor").mapInPandas(aimed(False), kind), "further")
        away = cut(_dealt(rows, further, shards, k), "away")
    ranked = near.union(away).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    out = cut(ranked.select("query_id", "rank", F.when(F.col("vec_id") != int(_NULL_ID), F.col("vec_id")).alias("vec_id"), "score"), "ranked")
    drop(spark, passing)
    return out
