"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample by k-means, where lists of too many sample
vectors are split until none holds more than twice its share. Every vector goes to
its nearest list and, if it lies near a boundary, to further ones whose centroid is
hardly farther away, unless that centroid lies nearer to a chosen one than to
the vector. A query walks a graph over the centroids, held in memory by each task,
and keeps the lists whose distance is within a ratio of the nearest one. Lists are
cut into pieces of bounded size, so a vector that many rows share makes no large
group; queries meet every piece of their lists.

Defined results: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part; rows of one id count once, with
their smallest vector; with fewer candidates than asked for all are returned.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.runtime import pin, ship

#: Vectors the centroids are fitted to, at most.
SAMPLE = 20_000
#: Vectors of a list on average, lists at most, rows of a piece of a list.
LIST_SIZE, MAX_LISTS, PIECE = 160, 1_024, 4_096
#: Copies of a boundary vector, and how much farther its other centroids may be.
COPIES, BOUNDARY = 3, 1.08
#: Lists a query may visit, and how much farther than the nearest they may be.
PROBES, PRUNE = 96, 1.6
#: Neighbours of a centroid in the graph.
DEGREE = 24


class Index(NamedTuple):
    """``postings``: list, piece, vec_id, embedding; ``pieces``: list, pieces; the rest for routing."""

    postings: DataFrame
    pieces: DataFrame
    centroids: Broadcast
    vectors: DataFrame


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    usual = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    rows = rows.filter(F.size(v) == (usual["n"] if usual else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2.0 * x @ centers.T
    return np.sqrt(np.maximum(squares, 0.0))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids of about ``lists`` clusters, none with more than twice its share of distinct sample vectors."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centers = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest = _distances(sample, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centers))
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        # Empty lists move into the largest ones.
        order = np.argsort(-counts)
        for empty, full in zip(np.flatnonzero(counts == 0), order, strict=False):
            centers[empty] = sample[rng.choice(np.flatnonzero(nearest == full))]
    share, out, open_ = 2.0 * len(sample) / lists, [], []
    nearest = _distances(sample, centers).argmin(1)
    open_ = [(sample[nearest == i], centers[i]) for i in range(len(centers)) if (nearest == i).any()]
    while open_:
        members, center = open_.pop()
        if len(members) <= share:
            out.append(center)
            continue
        axis = np.linalg.svd(members - members.mean(0), full_matrices=False)[2][0]
        side = (members @ axis) > np.median(members @ axis)
        open_ += [(m, m.mean(0)) for m in (members[side], members[~side]) if len(m)] if 0 < side.sum() < len(side) else [(members[:1], center)]
    return np.array(out)


class Router:
    """Centroids with a neighbour graph over them."""

    def __init__(self, centers: np.ndarray) -> None:
        self.centers = centers
        between = _distances(centers, centers)
        self.between = between
        near = np.argsort(between, axis=1, kind="stable")[:, 1 : DEGREE + 1]
        links: list[set[int]] = [set(map(int, row)) for row in near]
        for i, row in enumerate(near):
            for j in row:
                links[int(j)].add(i)
        # A few far links keep the graph in one piece.
        for i in range(len(centers)):
            links[i].add((i + len(centers) // 2) % len(centers))
            links[i].add((i * 7 + 1) % len(centers))
        self.links = [np.array(sorted(s - {i}), np.int64) for i, s in enumerate(links)]

    def search(self, query: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk from centroid 0: about the ``width`` nearest centroids and their distances."""
        start = float(np.linalg.norm(self.centers[0] - query))
        seen = np.zeros(len(self.centers), bool)
        seen[0] = True
        todo, best = [(start, 0)], [(-start, 0)]
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for e, j in zip(np.linalg.norm(self.centers[new] - query, axis=1).tolist(), new.tolist(), strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(todo, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > width:
                        heapq.heappop(best)
        found = sorted((-d, i) for d, i in best)
        return np.array([i for _, i in found]), np.array([d for d, _ in found])

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists of a block of vectors, boundary vectors several times."""
        distance = _distances(x, self.centers)
        k = min(COPIES * 2, len(self.centers))
        near = np.argpartition(distance, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(distance, near, 1), axis=1), 1)
        rows, lists = [], []
        for row, options in enumerate(near):
            own, chosen = distance[row], [int(options[0])]
            for c in options[1:]:
                if len(chosen) == COPIES or own[c] > BOUNDARY * own[chosen[0]]:
                    break
                if all(self.between[c, o] > own[c] * 0.5 for o in chosen):
                    chosen.append(int(c))
            rows += [row] * len(chosen)
            lists += chosen
        return np.array(rows, np.int64), np.array(lists, np.int64)


_routers: dict[int, Router] = {}


def _router(sent: Broadcast) -> Router:
    key = id(sent.value)
    if key not in _routers:
        _routers.clear()
        _routers[key] = Router(sent.value)
    return _routers[key]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build_index(table: DataFrame, key: str = "vec_id", vector: str = "embedding", list_size: int = LIST_SIZE) -> Index | None:
    """Fit the centroids and put every vector in its lists; None without any vector."""
    spark = table.sparkSession
    ship(spark)
    vectors = pin(usable(table, key, vector))
    n = vectors.count()
    if not n:
        return None
    sample = vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    lists = min(MAX_LISTS, max(1, -(-n // list_size)))
    sent = spark.sparkContext.broadcast(fit_centroids(np.stack(sample), lists))
    dims = sent.value.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = _router(sent)
        for batch in batches:
            if batch.num_rows:
                rows, lists = router.lists_of(_matrix(batch.column("embedding"), dims))
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(lists), *taken.columns], names=["list", *batch.schema.names])

    placed = pin(vectors.mapInArrow(assign, "list long, vec_id long, embedding array<double>"))
    pieces = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("long").alias("pieces"))
    # One row per list, at most 2 * MAX_LISTS of them.
    pieces = F.broadcast(pin(pieces))
    postings = placed.join(pieces, "list").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces"))).drop("pieces")
    return Index(postings, pieces, sent, vectors)


def _rough_squares(q: np.ndarray, x: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, Callable[[float], float]]:
    """Squared distances by one product of matrices, and how far two of about a size may be off together.

    Seen from the middle of the piece, norms are those of the piece and not of its place, so the products lose
    little; what is lost there grows with the squares of these norms, and by moving the
    vectors with the norms they had.
    """
    here, there = x - middle, q - middle
    squares = (there * there).sum(1)[:, None] + (here * here).sum(1)[None, :] - 2 * (there @ here.T)
    eps, dims = np.finfo(np.float64).eps, x.shape[1]
    product = 64 * eps * dims * ((here * here).sum(1).max() + (there * there).sum(1).max())
    moved = 8 * eps * np.sqrt(dims) * (np.abs(x).max() + np.abs(q).max())
    return np.maximum(squares, 0), lambda square: product + 8 * np.sqrt(square) * moved + 4 * moved * moved


def _nearest(queries: pd.DataFrame, postings: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of a piece for each of its queries, by exact distances."""
    out: list[tuple[int, int, float]] = []
    if len(queries) and len(postings):
        x, ids = np.stack(postings["embedding"]), postings["vec_id"].to_numpy()
        middle = x.mean(axis=0)
        for at in range(0, len(queries), 256):
            some = queries.iloc[at : at + 256]
            q = np.stack(some["embedding"])
            rough, slack = _rough_squares(q, x, middle)
            for row, (query_id, vector) in enumerate(zip(some["vec_id"].to_numpy(), q, strict=True)):
                other = ids != query_id
                distance = np.where(other, rough[row], np.inf)
                if len(ids) > k:
                    bound = np.partition(distance, k - 1)[k - 1]
                    bound += slack(bound)
                    picked = np.flatnonzero((distance <= bound) & other)
                else:
                    picked = np.flatnonzero(other)
                exact = np.sqrt(((x[picked] - vector) ** 2).sum(1))
                order = np.lexsort((ids[picked], exact))[:k]
                out += [(int(query_id), int(ids[picked[o]]), float(exact[o])) for o in order]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = PROBES, prune: float = PRUNE) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries``: vec_id, embedding; a query does not find its own id."""
    sent = index.centroids
    dims = sent.value.shape[1]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = _router(sent)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lists = [], []
            for row, query in enumerate(_matrix(batch.column("embedding"), dims)):
                found, distance = router.search(query, probes)
                kept = found[distance <= max(prune * distance[0], 1e-12)]
                rows += [row] * len(kept)
                lists += kept.tolist()
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *taken.columns], names=["list", *batch.schema.names])

    routed = queries.select("vec_id", "embedding").mapInArrow(route, "list long, vec_id long, embedding array<double>")
    last = F.col("pieces") - 1
    probes_ = routed.join(index.pieces, "list").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("pieces")
    met = probes_.groupBy("list", "piece").cogroup(index.postings.groupBy("list", "piece"))
    found = met.applyInPandas(lambda q, p: _nearest(q, p, k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if index is None:
        return spark.range(0).selectExpr("id AS query_id", "1 AS rank", "id AS vec_id", "0.0D AS score")
    return search(index, index.vectors.filter(F.col("vec_id") % 100 == 0))
