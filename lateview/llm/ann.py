"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on a few random lines, each of which is a sorted array. A query
opens a window around its own projection on every line and widens all windows step by step
(virtual rehashing: the index is not rebuilt for another radius). A vector that lies in enough
windows is verified with its true distance; a query stops once its k-th verified distance is
within the radius that its windows stand for. Rows and queries meet block by block, so an
index is never larger than a block and every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lateview.llm.common import table

#: Rows of a block at least, and bytes of its vectors at most; queries that meet a block at once at most, and those whose windows are held at once.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_QUERIES, HELD_QUERIES = 4096, 32 << 20, 16384, 256
#: Projections; share of windows that a vector must lie in; step of the radius.
LINES, SHARE, STEP = 64, 0.5, 1.4


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, their squares summed component after component."""
    apart = (vectors - query) ** 2
    return np.sqrt(np.add.accumulate(apart, axis=1)[:, -1])


class Block:
    """The sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        lines = rng.normal(size=(LINES, vectors.shape[1]))
        self.lines = lines / np.linalg.norm(lines, axis=1, keepdims=True)
        self.vectors = vectors
        place = vectors @ self.lines.T
        self.order = np.ascontiguousarray(np.argsort(place, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.sort(place, axis=0).T)
        # a line shows a distance times a normal factor of this deviation
        self.stretch = 1 / np.sqrt(vectors.shape[1])

    def first_radius(self, k: int) -> float:
        """A radius to begin with: what some of the block's own rows need for their k nearest, less a fifth."""
        some = self.vectors[:: max(1, len(self.vectors) // 16)][:16]
        apart = np.sqrt(np.maximum((some**2).sum(1)[:, None] + (self.vectors**2).sum(1) - 2 * some @ self.vectors.T, 0))
        near = np.partition(apart, min(k, len(self.vectors) - 1), axis=1)[:, min(k, len(self.vectors) - 1)]
        return 0.8 * float(np.median(near))

    def search(self, queries: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions and distances of the k nearest found, ties to the smaller id; ``own`` is left out (-1: none)."""
        parts = range(0, len(queries), HELD_QUERIES)
        return [x for s in parts for x in self._search(queries[s : s + HELD_QUERIES], k, ids, own[s : s + HELD_QUERIES])]

    def _search(self, queries: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        n, m = len(self.vectors), len(queries)
        centre = np.ascontiguousarray(self.lines @ queries.T)
        need = int(np.ceil(SHARE * LINES))
        widest = np.abs(self.sorted[:, [0, -1]][:, :, None] - centre[:, None, :]).max(axis=(0, 1))
        low = np.stack([np.searchsorted(s, c) for s, c in zip(self.sorted, centre)])
        high = low.copy()
        count = [np.zeros(n, np.int16) for _ in range(m)]
        found = [np.zeros(0, np.int64)] * m
        gone = [np.zeros(0)] * m
        radius = np.full(m, max(self.first_radius(k), float(widest.max(initial=1e-300)) / 256))
        left = np.arange(m)
        while len(left):
            half = radius[left] * self.stretch
            to_low = np.stack([np.searchsorted(s, c[left] - half, "left") for s, c in zip(self.sorted, centre)])
            to_high = np.stack([np.searchsorted(s, c[left] + half, "right") for s, c in zip(self.sorted, centre)])
            to_low, to_high = np.minimum(to_low, low[:, left]), np.maximum(to_high, high[:, left])
            on = []
            for i, q in enumerate(left.tolist()):
                fresh = [o[a:b] for o, a, b in zip(self.order, to_low[:, i].tolist(), low[:, q].tolist()) if a < b]
                fresh += [o[a:b] for o, a, b in zip(self.order, high[:, q].tolist(), to_high[:, i].tolist()) if a < b]
                if fresh:
                    was = count[q] >= need
                    count[q] += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int16)
                    hit = np.flatnonzero((count[q] >= need) & ~was)
                    hit = hit[hit != own[q]]
                    found[q], gone[q] = self._best(queries[q], k, ids, found[q], gone[q], hit)
                if half[i] <= widest[q]:
                    if len(found[q]) < k:
                        radius[q] *= STEP
                        on.append(q)
                    elif gone[q][-1] > radius[q]:  # the last windows: those of the k-th distance itself
                        radius[q] = gone[q][-1]
                        on.append(q)
            low[:, left], high[:, left] = to_low, to_high
            left = np.array(on, np.int64)
        return list(zip(found, gone))

    def _best(self, query: np.ndarray, k: int, ids: np.ndarray, found: np.ndarray, gone: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of what was found and what ``hit`` turns out to be, by true distance and then id."""
        d = distances(self.vectors[hit], query)
        if len(found) == k:
            near = d <= gone[-1]
            hit, d = hit[near], d[near]
        found, gone = np.concatenate([found, hit]), np.concatenate([gone, d])
        if len(found) > k:
            near = gone <= np.partition(gone, k - 1)[k - 1]
            found, gone = found[near], gone[near]
        best = np.lexsort((ids[found], gone))[:k]
        return found[best], gone[best]


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its k nearest other rows by Euclidean distance.

    A query's own row is no candidate; a copy of it under the same id is. Ties go to the smaller
    id. Vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do rows without an id; vectors of another length are never compared. Fewer candidates
    than k give fewer rows; no queries or an empty table give none. Very long vectors make smaller blocks; other columns are not
    read. Each pair of a block of rows and a block of queries is one task's work; rows and queries are dealt at random, so copies spread.
    Rows travel once for every ``BLOCK_QUERIES`` queries, queries once for every block of rows, which is as large as
    ``BLOCK_BYTES`` allows wherever the table gives every core such a block.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(finite, F.lit(False)).alias("ok"),
    )
    rows = rows.where(F.col("ok") & F.col("id").isNotNull() & F.exists("v", lambda x: x != 0)).drop("ok")
    n, asked, longest = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    most = BLOCK_BYTES // (8 * (longest or 1))
    each = max(1, min(most, max(BLOCK_ROWS, n // vectors.sparkSession.sparkContext.defaultParallelism)))
    blocks, turns = max(1, -(-n // each)), max(1, -(-asked // BLOCK_QUERIES))
    deal = lambda seed, m: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m)).cast("int")
    rows = rows.withColumn("dim", F.size("v"))
    held = rows.withColumn("block", deal(1, blocks)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    ask = rows.where("asks").withColumn("turn", deal(2, turns)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "block", "turn"]
    names = ["asked", "query_id", "vec_id", "score"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            ids, where = left["id"].to_numpy(), left["row"].to_numpy()
            at = {r: i for i, r in enumerate(where.tolist())}
            block = Block(matrix(left))
            rows, asked = right["row"].to_pylist(), right["id"].to_pylist()
            own = np.array([at.get(r, -1) for r in rows])
            for row, q, (found, score) in zip(rows, asked, block.search(matrix(right), k, ids, own)):
                out[0] += [row] * len(found)
                out[1] += [q] * len(found)
                out[2] += ids[found].tolist()
                out[3] += score.tolist()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(out, types)], names)

    def side(df: DataFrame, n: str):
        # columns of its own for either side: both come from the same rows
        fresh = df.select(*(F.col(c).alias(f"{c}_{n}") for c in keys), *(F.col(c).alias(c) for c in ("id", "row", "v")))
        return fresh.groupBy(*(f"{c}_{n}" for c in keys))

    met = side(held, "l").cogroup(side(ask, "r"))
    met = met.applyInArrow(meet, "asked long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: All distances, in the order in which :func:`distances` sums: the operator finds the true neighbours of the tables that this is run on.
OP9_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), sound AS (
  SELECT * FROM rows WHERE v IS NOT NULL AND len(v) > 0 AND vec_id IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(v, lambda x: x != 0)) > 0
), apart AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) AS score
  FROM sound q JOIN sound c ON c.vec_id != q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM apart
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10
"""
