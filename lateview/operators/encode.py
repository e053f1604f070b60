"""The model stage: prefix, coalescing and suffix of a document in one Python task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.functions import matrix
from lateview.operators import grid
from lateview.operators.index import CompactIndex
from lateview.plans.contracts import BackboneProfile, CompilerConfig
from lateview.sources.shared import write_shared


@dataclass(frozen=True)
class BoundaryState:
    """What a model hands over between its halves; ``context`` never leaves the task."""

    hidden_states: Any
    grid_shape: tuple[int, int]
    auxiliary_tokens: int = 0
    context: Any = None


@dataclass(frozen=True)
class PageAssignment:
    """Which anchor slot each visual token of one page went to."""

    grid_shape: tuple[int, int]
    anchor_indices: np.ndarray
    slot_for_token: np.ndarray
    cluster_sizes: np.ndarray
    assignment_cosines: np.ndarray

    @property
    def full_visual_tokens(self) -> int:
        return len(self.slot_for_token)

    @property
    def compact_visual_tokens(self) -> int:
        return len(self.anchor_indices)

    @property
    def persistent_fraction(self) -> float:
        return self.compact_visual_tokens / self.full_visual_tokens

    def compact_positions(self, *, auxiliary_tokens: int = 0) -> np.ndarray:
        """The original positions of the compact rows."""
        return np.array(grid.compact_positions(self.grid_shape, auxiliary_tokens=auxiliary_tokens))


@dataclass(frozen=True)
class CoalescedState:
    """The compact rows of one page, and how they came about."""

    hidden_states: np.ndarray
    assignment: PageAssignment


@runtime_checkable
class DocumentEncoderAdapter(Protocol):
    """A model that can stop after a layer and go on from a compact state."""

    @property
    def profile(self) -> BackboneProfile: ...

    def run_prefix(self, document: Any, *, split_after_layer: int) -> BoundaryState: ...

    def run_suffix(self, boundary: BoundaryState, compact: CoalescedState) -> Any: ...


def coalesce_matrix(hidden: Any, shape: tuple[int, int], auxiliary: int) -> CoalescedState:
    """One page's compact state, with the checks of the table form."""
    m = matrix.checked(hidden, "expected a non-empty rank-2 hidden-state matrix", "hidden states must be finite")
    full = shape[0] * shape[1]
    if len(m) != full + auxiliary:
        raise ValueError("grid and auxiliary counts do not match hidden states")
    at = np.array(grid.topology_anchors(shape))
    slot, cosine = grid.nearest_anchors(m, at, full)
    assignment = PageAssignment(tuple(shape), at, slot, np.bincount(slot, minlength=len(at)), cosine)
    return CoalescedState(grid.pool(m, slot, at, full), assignment)


class Compiler:
    """Compiles collections under one validated plan."""

    def __init__(self, config: CompilerConfig) -> None:
        self.plan = config.build_plan()

    def compile_hidden_states(self, pages: DataFrame, *, auxiliary_tokens: int = 0) -> DataFrame:
        """``item_id, workers, assigned`` of a table of pages."""
        return grid.coalesce_hidden_states(pages, self.plan.grid_shape, auxiliary_tokens=auxiliary_tokens)

    def _admit(self, adapter: DocumentEncoderAdapter) -> None:
        if adapter.profile != self.plan.profile:
            raise ValueError("adapter profile does not match the compile plan")

    def compile_document(self, adapter: DocumentEncoderAdapter, document: Any) -> np.ndarray:
        """One document's endpoints."""
        self._admit(adapter)
        state = adapter.run_prefix(document, split_after_layer=self.plan.profile.split_after_layer)
        if state.grid_shape != self.plan.grid_shape:
            raise ValueError("adapter boundary grid does not match the compile plan")
        compact = coalesce_matrix(state.hidden_states, state.grid_shape, state.auxiliary_tokens)
        return np.asarray(adapter.run_suffix(state, compact), dtype=float)

    def compile_documents(self, adapter: DocumentEncoderAdapter, documents: DataFrame) -> DataFrame:
        """``item_ord, item_id, vectors`` from ``item_ord, item_id, document`` (a matrix column, or anything the adapter takes).

        Profiles are compared before the job starts; any document that fails, fails the job.
        """
        self._admit(adapter)
        nested = documents.schema["document"].dataType.simpleString().startswith("array<array<")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                given = grid.matrices(b.column(2)) if nested else b.column(2).to_pylist()
                found = [self.compile_document(adapter, d) for d in given]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), grid.nested(found)], ["item_ord", "item_id", "vectors"])

        document = F.col("document").cast("array<array<double>>") if nested else F.col("document")
        rows = documents.select(F.col("item_ord").cast("long").alias("item_ord"), F.col("item_id").cast("string").alias("item_id"), document.alias("document"))
        return rows.mapInArrow(run, "item_ord long, item_id string, vectors array<array<double>>")

    def build(self, spark: SparkSession, items: DataFrame | list) -> CompactIndex:
        """An index of endpoints that are there already."""
        return CompactIndex(items) if isinstance(items, DataFrame) else CompactIndex.of(spark, items)

    def build_documents(self, adapter: DocumentEncoderAdapter, documents: DataFrame) -> CompactIndex:
        """An index of compiled documents. The model runs once a document: its endpoints are written before they are checked,
        and searches, refinements and the durable artifact read what was written."""
        return CompactIndex(write_shared(self.compile_documents(adapter, documents)))
