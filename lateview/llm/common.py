"""What the training-data operators share: tables, shared storage, batches and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.sources.shared import discard, write_shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any path that Spark itself can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        start, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(values).to_pylist()):
            n = n or 0
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def binary_array(offsets: np.ndarray, data) -> pa.Array:
    """The values between ``offsets`` of ``data``, without a copy of the data."""
    at = pa.py_buffer(np.ascontiguousarray(offsets, np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, at, data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


def value_offsets(values: pa.Array) -> np.ndarray:
    """Where the values of a large binary array without nulls begin and end in its data."""
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]


def whole_buckets(batches: Iterator[pa.RecordBatch], columns: int = 2) -> Iterator[list[np.ndarray]]:
    """Sorted batches as numpy columns, cut only where the first ``columns`` columns change."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        change = np.zeros(len(cols[0]), bool)
        for i, c in enumerate(cols[:columns]):
            change[1:] |= c[1:] != c[:-1]
            change[0] |= bool(held) and held[-1][i][-1] != c[0]
        at = np.flatnonzero(change)
        if len(at):
            held.append([c[: at[-1]] for c in cols])
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        held.append([c[at[-1] if len(at) else 0 :] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: edges ``a, b`` (long) to ``node, root``.

    Alternating large-star and small-star rounds, each written to the shared folder; every
    linked node comes out once, with the smallest node of its component as ``root`` (a root
    itself has no row). Nothing but one number a round reaches the driver. Loops and
    repeated edges do no harm; no edges give no rows.
    """

    def stars(e: DataFrame) -> bool:
        """Whether every linked node has one edge down, to a node that has none."""
        ends = e.select("u", F.lit(1).alias("down"), F.lit(0).alias("held"))
        ends = ends.unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("held")))
        nodes = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("held").alias("held"))
        return nodes.agg(F.count_if((F.col("down") > 1) | (F.col("down") == 1) & (F.col("held") == 1))).first()[0] == 0

    e = write_shared(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = e
        e = write_shared(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
