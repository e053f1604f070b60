"""Anchors, assignment and pooling of pages of token vectors.

A page is one row: ``item_id`` and ``hidden``, an array of vectors of which the first
rows*columns are visual, in row order, and the rest auxiliary. Every operator works inside the
row, so no page is ever shuffled. Each comes in two tiers with the same results: column
expressions, and Arrow batches through numpy for pages of real size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.functions import vec

#: Pairs of token and anchor a page from which the bulk tier is taken.
BULK_FROM = 1024


def check_grid(grid: tuple[int, int]) -> None:
    if min(grid) <= 0 or grid[0] % 2 or grid[1] % 2:
        raise ValueError("grid dimensions must be positive and even")


def topology_anchors(grid: tuple[int, int]) -> list[int]:
    """Positions of the anchors by slot: the right pair of every 2x2 cell, cells in row order, top first."""
    check_grid(grid)
    rows, columns = grid
    return [row * columns + column for cell in range(0, rows, 2) for column in range(1, columns, 2) for row in (cell, cell + 1)]


def anchors(spark: SparkSession, grid: tuple[int, int]) -> DataFrame:
    """``slot, pos`` of the anchors, computed from the slot alone."""
    check_grid(grid)
    rows, columns = grid
    cells = columns // 2
    cell, low = F.expr("cast(id div 2 as int)"), F.expr("cast(id % 2 as int)")
    pos = (2 * F.floor(cell / cells) + low) * columns + 2 * (cell % cells) + 1
    return spark.range(rows * columns // 2).select(F.col("id").cast("int").alias("slot"), pos.cast("int").alias("pos"))


def compact_positions(grid: tuple[int, int], *, auxiliary_tokens: int = 0) -> list[int]:
    """The original positions of a compact page's rows."""
    if auxiliary_tokens < 0:
        raise ValueError("auxiliary token count cannot be negative")
    full = grid[0] * grid[1]
    return topology_anchors(grid) + list(range(full, full + auxiliary_tokens))


def page_faults(pages: DataFrame, rows: int | None, what: str = "hidden", mismatch: str = "grid and auxiliary counts do not match hidden states") -> DataFrame:
    """``item_id, reason``: the first rule that a page's matrix breaks, or null. Null matrices and null rows are no matrices."""
    m = vec.doubles(what)
    rules = [(vec.is_matrix(m), "expected a non-empty rank-2 hidden-state matrix"), (F.forall(m, vec.is_finite), "hidden states must be finite")]
    if rows is not None:
        rules.append((F.size(m) == rows, mismatch))
    reason = F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(why)) for holds, why in rules))
    return pages.select(F.col("item_id").cast("string").alias("item_id"), reason.alias("reason"))


def check_pages(pages: DataFrame, rows: int | None, what: str = "hidden", mismatch: str = "grid and auxiliary counts do not match hidden states") -> None:
    """ValueError with a reason of :func:`page_faults` for the first of those that any page has; one pass over the pages."""
    order = ("expected a non-empty", "hidden states must be", "")
    reasons = [r["reason"] for r in page_faults(pages, rows, what, mismatch).where("reason is not null").select("reason").distinct().collect()]
    for start in order:
        for reason in reasons:
            if reason.startswith(start):
                raise ValueError(reason)


def _assigned(hidden: Column, at: list[int], full: int) -> Column:
    """For each visual token the struct ``cosine, slot`` of its nearest anchor, the lowest slot of equals."""
    units = vec.unit_rows(F.slice(hidden, 1, full))

    def nearest(u: Column, held: Column) -> Column:
        each = F.transform(held, lambda a, i: F.struct(vec.dot(u, a).alias("cosine"), (-i).alias("last")))
        best = F.array_max(each)
        return F.struct((-best["last"]).cast("int").alias("slot"), best["cosine"].alias("cosine"))

    # units is bound once, so that anchors are not normalised for every token again
    bound = F.transform(F.array(units), lambda all_: F.transform(all_, lambda u: nearest(u, F.array(*(F.get(all_, F.lit(p)) for p in at)))))
    return F.get(bound, F.lit(0))


def _assign_bulk(pages: DataFrame, grid: tuple[int, int]) -> DataFrame:
    at, full = np.array(topology_anchors(grid)), grid[0] * grid[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, cosines = [], []
            for m in matrices(b.column(1)):
                slot, cosine = nearest_anchors(m, at, full)
                slots.append(slot)
                cosines.append(cosine)
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(slots).astype(np.int32)), pa.array(np.concatenate(cosines))], ["slot", "cosine"]
            ) if slots else pa.array([], pa.struct([("slot", pa.int32()), ("cosine", pa.float64())]))
            ends = pa.array(np.arange(len(slots) + 1, dtype=np.int32) * full)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, flat)], ["item_id", "hidden", "assigned"])

    schema = "item_id string, hidden array<array<double>>, assigned array<struct<slot:int,cosine:double>>"
    return pages.select(F.col("item_id").cast("string").alias("item_id"), vec.doubles("hidden").alias("hidden")).mapInArrow(run, schema)


def matrices(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Every row of an array<array<double>> column as a matrix, without Python numbers."""
    outer = column.offsets.to_numpy()
    inner = column.values.offsets.to_numpy()
    values = column.values.values.to_numpy(zero_copy_only=False)
    for a, z in zip(outer[:-1], outer[1:]):
        yield values[inner[a] : inner[z]].reshape(z - a, -1)


def nearest_anchors(matrix: np.ndarray, at: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and cosine of each visual token of one page; of equal anchors the lowest slot, whatever order products are summed in."""
    u = matrix[:full] / np.maximum(np.linalg.norm(matrix[:full], axis=1, keepdims=True), vec.FLOOR)
    first = np.sort(np.unique(u[at], axis=0, return_index=True)[1])  # of equal anchors one takes part
    cos = u @ u[at[first]].T
    best = cos.argmax(axis=1)
    return first[best], cos[np.arange(full), best]


def _bulk(grid: tuple[int, int], bulk: bool | None) -> bool:
    return grid[0] * grid[1] * (grid[0] * grid[1] // 2) >= BULK_FROM if bulk is None else bulk


def assign(pages: DataFrame, grid: tuple[int, int], *, auxiliary_tokens: int = 0, bulk: bool | None = None, check: bool = True) -> DataFrame:
    """``item_id, hidden, assigned``: each visual token's slot and cosine, as an array in token order.

    Cosines are between unit rows; a token goes to its most similar anchor, ties to the lowest
    slot; zero rows have cosine 0 everywhere and go to slot 0. ``bulk`` picks the tier; by
    default the size of a page does. A page that is no finite matrix, or has not as many rows as the grid and
    the auxiliary tokens, is a ValueError; a caller that has checked may leave it out.
    """
    at, full = topology_anchors(grid), grid[0] * grid[1]
    if check:
        check_pages(pages, full + auxiliary_tokens, mismatch="grid shape does not match the visual hidden states")
    if _bulk(grid, bulk):
        return _assign_bulk(pages, grid)
    m = vec.doubles("hidden")
    return pages.select(F.col("item_id").cast("string").alias("item_id"), m.alias("hidden"), _assigned(m, at, full).alias("assigned"))


def capacity(assigned: DataFrame, grid: tuple[int, int]) -> DataFrame:
    """``item_id, full_visual_tokens, compact_visual_tokens, persistent_fraction`` of every assignment."""
    full, compact = F.size("assigned").cast("long"), F.lit(len(topology_anchors(grid))).cast("long")
    return assigned.select("item_id", full.alias("full_visual_tokens"), compact.alias("compact_visual_tokens"), F.try_divide(compact, full).alias("persistent_fraction"))


def assignment(assigned: DataFrame) -> DataFrame:
    """Long form ``item_id, pos, slot, cosine``."""
    return assigned.select("item_id", F.posexplode("assigned").alias("pos", "a")).select("item_id", "pos", "a.slot", "a.cosine")


def clusters(assigned: DataFrame, grid: tuple[int, int]) -> DataFrame:
    """Long form ``item_id, slot, anchor_pos, size``; empty clusters have size 0."""
    at = topology_anchors(grid)
    places = F.array(*map(F.lit, at))
    rows = assigned.select("item_id", "assigned", F.posexplode(places).alias("slot", "anchor_pos"))
    size = F.expr("size(filter(assigned, a -> a.slot = slot))").cast("long")
    return rows.select("item_id", "slot", "anchor_pos", size.alias("size"))


def apply_assignment(
    assigned: DataFrame,
    grid: tuple[int, int],
    *,
    auxiliary_tokens: int = 0,
    bulk: bool | None = None,
    check: bool = True,
) -> DataFrame:
    """``item_id, workers, assigned``: the mean of the raw rows of each cluster by slot, then the auxiliary rows; and the assignment.

    A cluster without rows keeps its raw anchor. ``assigned`` may pair an assignment with another
    matrix of as many rows, of any width. Pages whose rows do not match are a ValueError, found by
    one aggregate; a caller that has checked them may leave it out.
    """
    if auxiliary_tokens < 0:
        raise ValueError("auxiliary token count cannot be negative")
    at, full = topology_anchors(grid), grid[0] * grid[1]
    rows = full + auxiliary_tokens
    if check and not assigned.where((F.size("hidden") != rows) | (F.size("assigned") != full)).isEmpty():
        raise ValueError("assignment and auxiliary counts do not match hidden states")
    if _bulk(grid, bulk):
        return _apply_bulk(assigned, at, full, rows)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def pooled(hidden: Column, taken: Column, slot: Column, anchor: Column) -> Column:
        held = F.filter(hidden, lambda v, i: F.get(taken, i)["slot"] == slot)
        zero = F.transform(anchor, lambda x: F.lit(0.0))
        n = F.size(held)
        return F.when(n > 0, F.transform(F.aggregate(held, zero, add), lambda x: x / n)).otherwise(anchor)

    def compact(page: Column) -> Column:
        means = F.transform(F.array(*map(F.lit, at)), lambda p, s: pooled(page["hidden"], page["assigned"], s, F.get(page["hidden"], p)))
        return F.concat(means, F.slice(page["hidden"], full + 1, auxiliary_tokens)) if auxiliary_tokens else means

    # bound in an array of one, or the assignment would be worked out again for every slot
    means = F.get(F.transform(F.array(F.struct("hidden", "assigned")), compact), F.lit(0))
    return assigned.select("item_id", means.alias("workers"), "assigned")


def pool(matrix: np.ndarray, slot: np.ndarray, at: np.ndarray, full: int) -> np.ndarray:
    """One page's compact rows in numpy."""
    size = np.bincount(slot, minlength=len(at))
    order = np.argsort(slot, kind="stable")
    out = matrix[at].astype(float)
    held = np.flatnonzero(size)
    start = np.cumsum(size) - size
    out[held] = np.add.reduceat(matrix[:full][order], start[held], axis=0) / size[held, None]
    return np.vstack([out, matrix[full:]])


def nested(found: list[np.ndarray]) -> pa.ListArray:
    """Matrices as an array<array<double>> column."""
    outer = np.cumsum([0, *(len(m) for m in found)]).astype(np.int32)
    inner = np.cumsum(np.r_[0, np.concatenate([np.full(len(m), m.shape[1]) for m in found])] if found else [0]).astype(np.int32)
    flat = pa.array(np.concatenate([m.reshape(-1) for m in found]) if found else np.zeros(0))
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), flat))


def _apply_bulk(assigned: DataFrame, at: list[int], full: int, rows: int) -> DataFrame:
    places = np.array(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = b.column(2)
            ends, flat = slots.offsets.to_numpy(), slots.values.field("slot").to_numpy(zero_copy_only=False)
            found = []
            for m, a, z in zip(matrices(b.column(1)), ends[:-1], ends[1:]):
                if len(m) != rows or z - a != full:
                    raise ValueError("assignment and auxiliary counts do not match hidden states")
                found.append(pool(m, flat[a:z], places, full))
            yield pa.RecordBatch.from_arrays([b.column(0), nested(found), slots], ["item_id", "workers", "assigned"])

    kind = "item_id string, workers array<array<double>>, assigned array<struct<slot:int,cosine:double>>"
    return assigned.select("item_id", "hidden", "assigned").mapInArrow(run, kind)


def coalesce_hidden_states(pages: DataFrame, grid: tuple[int, int], *, auxiliary_tokens: int = 0, bulk: bool | None = None, check: bool = True) -> DataFrame:
    """Assignment and pooling of whole pages: ``item_id, workers, assigned``."""
    check_grid(grid)
    if check:
        check_pages(pages, grid[0] * grid[1] + auxiliary_tokens)
    assigned = assign(pages, grid, bulk=bulk, check=False)
    return apply_assignment(assigned, grid, auxiliary_tokens=auxiliary_tokens, bulk=bulk, check=False)


def long_rows(df: DataFrame, column: str, pos: str, value: str) -> DataFrame:
    """Long form of a matrix column: ``item_id``, the row's position, the row."""
    return df.select("item_id", F.posexplode(column).alias(pos, value))
