"""The late-interaction index: one row an item, scored by MaxSim inside the row, cut by top-k.

Because an item's unit rows lie in one array, a search is a scan, one projection and a
TakeOrderedAndProject: no shuffle but that of the k best rows of each task. Small products are column expressions;
larger ones, and batches of queries, go through numpy in Arrow batches, where every batch keeps its own k best.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lateview.functions import matrix, vec
from lateview.sources.shared import write_shared

#: Bytes of query vectors that a pass of a batch search hands to the tasks, and queries that are told apart in it.
BATCH_BYTES, BATCH_QUERIES = 32 << 20, 4096
#: Multiplications an item from which products go through numpy.
BULK_FROM = 4096


@dataclass(frozen=True)
class SearchResult:
    item_id: str
    score: float


def normalize_rows(value: Sequence) -> np.ndarray:
    """Unit rows of a matrix on the driver; a row shorter than 1e-12 is divided by that."""
    m = matrix.checked(value, "expected a non-empty rank-2 matrix", "vectors must be finite")
    return matrix.unit_rows(m)


def maxsim_score(query: Sequence, document: Sequence) -> float:
    """MaxSim of two matrices on the driver."""
    q, d = normalize_rows(query), normalize_rows(document)
    if q.shape[1] != d.shape[1]:
        raise ValueError("query and document dimensions differ")
    return matrix.maxsim(q, d)


def items_from_long(rows: DataFrame) -> DataFrame:
    """``item_ord, item_id, vectors`` from ``item_ord, item_id, vec_pos, v``: an item's rows in order of position."""
    held = rows.groupBy("item_ord", "item_id").agg(F.array_sort(F.collect_list(F.struct("vec_pos", "v"))).alias("r"))
    return held.select("item_ord", "item_id", F.transform("r", lambda x: x["v"]).alias("vectors"))


class CompactIndex:
    """Items with unit rows, in a fixed order: a DataFrame ``item_ord, item_id, vectors, scoring``.

    ``vectors`` went through one pass of normalisation, as records show them; ``scoring`` through
    another, as a score normalises what it is given (the passes differ below 1e-12 only).
    """

    def __init__(self, items: DataFrame) -> None:
        """items: ``item_ord, item_id, vectors``; checked in one aggregate, ValueError for the first rule broken."""
        m = vec.doubles("vectors")
        rows = items.select("item_ord", F.col("item_id").cast("string").alias("item_id"), m.alias("vectors"))
        bad = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
        found = rows.agg(
            F.count("*").alias("n"),
            bad(vec.is_matrix(F.col("vectors"))).alias("shape"),
            bad(F.forall("vectors", vec.is_finite)).alias("finite"),
            F.count_distinct("item_id").alias("ids"),
            F.min(F.size(F.get("vectors", F.lit(0)))).alias("low"),
            F.max(F.size(F.get("vectors", F.lit(0)))).alias("high"),
            F.sum(F.size("vectors")).alias("vectors"),
            F.max(F.size("vectors")).alias("most"),
        ).first()
        if found["shape"]:
            raise ValueError("expected a non-empty rank-2 matrix")
        if found["finite"]:
            raise ValueError("vectors must be finite")
        if not found["n"]:
            raise ValueError("an index requires at least one item")
        if found["ids"] < found["n"]:
            raise ValueError("item identifiers must be unique")
        if found["low"] != found["high"]:
            raise ValueError("all indexed vectors must share one dimension")
        self.dimension: int = found["low"]
        self.vector_count: int = found["vectors"]
        #: Vectors of the largest item.
        self.most_vectors: int = found["most"]
        self._n: int = found["n"]
        once = rows.withColumn("vectors", vec.unit_rows(F.col("vectors")))
        self.items = once.withColumn("scoring", vec.unit_rows(F.col("vectors")))

    @classmethod
    def of(cls, spark: SparkSession, items: Sequence[tuple[object, Sequence]]) -> CompactIndex:
        """An index of matrices held by the driver."""
        rows = [(i, str(k), [[float(x) for x in r] for r in m]) for i, (k, m) in enumerate(items)]
        return cls(spark.createDataFrame(rows, "item_ord long, item_id string, vectors array<array<double>>"))

    def __len__(self) -> int:
        return self._n

    def stored(self) -> CompactIndex:
        """Write the unit rows to the shared folder, for many searches: they are worked out once, and lost executors cost nothing."""
        self.items = write_shared(self.items)
        return self

    def persist(self) -> CompactIndex:
        """Keep the unit rows for many searches; memory and disk."""
        self.items = self.items.persist()
        return self

    @property
    def item_ids(self) -> DataFrame:
        """``item_ord, item_id`` in order."""
        return self.items.select("item_ord", "item_id").orderBy("item_ord")

    def records(self) -> DataFrame:
        """``item_ord, item_id, vec_pos, v``: unit rows in order."""
        rows = self.items.select("item_ord", "item_id", F.posexplode("vectors").alias("vec_pos", "v"))
        return rows.orderBy("item_ord", "vec_pos")

    def contains(self, item_id: str) -> bool:
        return not self.items.where(F.col("item_id") == F.lit(item_id)).isEmpty()

    def _query(self, query: Sequence) -> np.ndarray:
        q = normalize_rows(query)
        if q.shape[1] != self.dimension:
            raise ValueError("query and document dimensions differ")
        return q

    def scores(self, query: Sequence, *, bulk: bool | None = None) -> DataFrame:
        """``item_id, score`` of every item; ``bulk`` picks the tier, by default the size of the product does."""
        return self._scored(query, None, bulk)

    def _scored(self, query: Sequence, best: int | None, bulk: bool | None) -> DataFrame:
        """``item_id, score``; with ``best``, in the numpy tier, of that many of each batch."""
        q = self._query(query)
        if not (len(q) * self.most_vectors * self.dimension >= BULK_FROM if bulk is None else bulk):
            return self.items.select("item_id", vec.maxsim(vec.literal(q.tolist()), F.col("scoring")).alias("score"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    scores = matrix.maxsim_of_rows(q, [len(q)], b.column(1))[0]
                    keep = np.arange(len(scores)) if best is None else matrix.best(scores, b.column(0), best)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(scores[keep])], ["item_id", "score"])

        return self.items.select("item_id", "scoring").mapInArrow(run, "item_id string, score double")

    def search(self, query: Sequence, *, top_k: int = 10, bulk: bool | None = None) -> DataFrame:
        """The ``top_k`` best items, by score and then item id."""
        if top_k <= 0:
            raise ValueError("top_k must be positive")
        return self._scored(query, top_k, bulk).orderBy(F.desc("score"), "item_id").limit(top_k)

    def results(self, query: Sequence, *, top_k: int = 10) -> list[SearchResult]:
        return [SearchResult(*r) for r in self.search(query, top_k=top_k).collect()]

    def search_batch(self, queries: DataFrame, *, top_k: int = 10) -> DataFrame:
        """``query_id, rank, item_id, score`` for a table ``query_id, rows`` of query matrices.

        Queries are few and items many. A pass hands at most ``BATCH_BYTES`` of query vectors to the tasks, which score
        all of them against each batch of items and let only every query's best of the batch go on to the ranking; more
        queries take further passes. Query ids must be unique; a query that is no finite matrix of the index's dimension is a ValueError.
        """
        if top_k <= 0:
            raise ValueError("top_k must be positive")
        asked = queries.select("query_id", vec.doubles("rows").alias("rows"))
        fits = vec.is_matrix(F.col("rows")) & F.forall("rows", lambda v: (F.size(v) == self.dimension) & vec.is_finite(v))
        n, wrong, rows = asked.agg(F.count("*"), F.count_if(~F.coalesce(fits, F.lit(False))), F.sum(F.size("rows"))).first()
        if wrong:
            raise ValueError("query and document dimensions differ")
        passes = max(1, -(-(rows or 0) * self.dimension * 8 // BATCH_BYTES), -(-n // BATCH_QUERIES))
        turn = F.pmod(F.xxhash64("query_id"), F.lit(passes))
        found = [self._best_of(asked.where(turn == p) if passes > 1 else asked, top_k) for p in range(passes)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
        return out.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query_id", "rank", "item_id", "score")

    def _best_of(self, asked: DataFrame, top_k: int) -> DataFrame:
        """``query_id, item_id, score`` of each batch's best items for a bounded number of queries."""
        held = asked.toArrow()
        found = [np.array(r.as_py(), float) for r in held["rows"]]
        sizes = [len(m) for m in found]
        q = np.concatenate([matrix.unit_rows(m) for m in found]) if found else np.zeros((0, self.dimension))
        ids = held["query_id"].combine_chunks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not sizes:
                    continue
                scores = matrix.maxsim_of_rows(q, sizes, b.column(1))
                keep = [matrix.best(s, b.column(0), top_k) for s in scores]
                of = np.repeat(np.arange(len(keep)), [len(k) for k in keep])
                at = np.concatenate(keep)
                columns = [ids.take(pa.array(of)), b.column(0).take(pa.array(at)), pa.array(scores[of, at])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "item_id", "score"])

        kind = asked.schema["query_id"].dataType.simpleString()
        return self.items.select("item_id", "scoring").mapInArrow(run, f"query_id {kind}, item_id string, score double")


def known_candidates(index: CompactIndex, candidates: DataFrame) -> DataFrame:
    """The rows of ``candidates`` (``item_id``) that the index holds."""
    return candidates.join(index.items.select("item_id"), "item_id", "left_semi")


def unknown_candidates(index: CompactIndex, candidates: DataFrame) -> DataFrame:
    """The rows of ``candidates`` (``item_id``) that the index does not hold."""
    return candidates.join(index.items.select("item_id"), "item_id", "left_anti")


def refine(index: CompactIndex, query: Sequence, candidates: Sequence, full: DataFrame, *, top_k: int | None = None) -> DataFrame:
    """Score ``candidates`` (ids, or search results) again with their full vectors: ``item_id, score``, best first.

    full: ``item_id, vectors`` of at least the candidates; it is filtered to them before any product. A candidate that
    it lacks is a KeyError, as is one outside the index.
    """
    ids, q = _checked(index, query, candidates, top_k)
    rows = full.where(F.col("item_id").cast("string").isin(ids)).select(
        F.col("item_id").cast("string").alias("item_id"), vec.doubles("vectors").alias("m")
    )
    there = {r["item_id"] for r in rows.select("item_id").distinct().collect()}  # as many as candidates at most
    for c in ids:
        if c not in there:
            raise KeyError(f"candidate has no full vectors: {c}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for m in matrix.each(b.column(1)):
                m = matrix.checked(m, "expected a non-empty rank-2 matrix", "vectors must be finite")
                if m.shape[1] != q.shape[1]:
                    raise ValueError("query and document dimensions differ")
                scores.append(matrix.maxsim(q, matrix.unit_rows(m)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["item_id", "score"])

    scored = rows.mapInArrow(run, "item_id string, score double")
    return scored.orderBy(F.desc("score"), "item_id").limit(top_k or len(ids))


def _checked(index: CompactIndex, query: Sequence, candidates: Sequence, top_k: int | None) -> tuple[list[str], np.ndarray]:
    """The candidates' ids and the query's unit rows, after all checks of a refinement."""
    ids = [c.item_id if isinstance(c, SearchResult) else str(c) for c in candidates]
    if not ids:
        raise ValueError("refinement requires at least one candidate")
    if len(set(ids)) < len(ids):
        raise ValueError("refinement candidates must be unique")
    known = {r["item_id"] for r in index.items.where(F.col("item_id").isin(ids)).select("item_id").collect()}
    for c in ids:
        if c not in known:
            raise KeyError(f"candidate is outside the compact index: {c}")
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be positive")
    return ids, normalize_rows(query)


def refine_candidates(index: CompactIndex, query: Sequence, candidates: Sequence, materialize_full, *, top_k: int | None = None) -> list[SearchResult]:
    """:func:`refine` where full vectors come from a callback, called once a candidate and in order."""
    ids, _ = _checked(index, query, candidates, top_k)
    rows = [(c, np.asarray(materialize_full(c), dtype=float)) for c in ids]
    scored = sorted((-maxsim_score(query, m), c) for c, m in rows)
    return [SearchResult(c, -s) for s, c in scored[: top_k or len(ids)]]
