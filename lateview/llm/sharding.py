"""Sharding by sampled splitters, in DataFrame operations only.

Records have a long key; a size-weighted sample of keys gives quantile splitters for many small
ranges; ranges that turn out overfull are subdivided; exact sums over ranges and a running sum
inside each then place every record. The order alone decides, so the sample's luck shows in
the running time and not in how equal the shards are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lateview.llm.common import table, write_shared

#: Ranges that a shard is made of, and sampled keys that a range is drawn from, on average.
RANGES_PER_SHARD, KEYS_PER_RANGE = 25, 16


def splitters(rows: DataFrame, ranges: int) -> list[int]:
    """Up to ``ranges - 1`` ascending keys that cut ``rows`` (``key, size, row``) into ranges of like size.

    A row is drawn with a chance in proportion to its size, and weighs more where that passes
    1; the draw is a hash of ``row``. The sample has about ``16 * ranges`` rows at any input size.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total or ranges < 2:
        return []
    expected = F.col("size") * F.lit(ranges * KEYS_PER_RANGE / total)
    draw = F.xxhash64("row", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    sample = rows.where(draw < expected).select("key", F.greatest(F.lit(1), F.round(expected)).cast("long").alias("n"))
    cuts = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    found = sample.select(F.expr(f"percentile(key, array({cuts}), n)")).first()[0] or []
    return sorted({min(int(x), (1 << 63) - 1) for x in found})


def range_of(key: str, cuts: list[int]) -> F.Column:
    """How many of ``cuts`` are at most ``key``, by binary search in one expression."""
    if not cuts:
        return F.lit(0)
    steps = ", ".join(str(1 << i) for i in reversed(range(len(cuts).bit_length())))
    held = ", ".join("(-9223372036854775807L - 1L)" if c == -(1 << 63) else f"{c}L" for c in cuts)
    return F.expr(
        f"aggregate(array({steps}), 0, (p, s) -> "
        f"if(p + s <= {len(cuts)} and element_at(array({held}), least(p + s, {len(cuts)})) <= {key}, p + s, p))"
    )


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row in one of ``shards`` shards of nearly equal size.

    Returns the id, ``size`` (bytes of the text, none if null, plus 16), ``text_crc32``
    (unsigned; 0 if null), ``shard`` from 0, and ``slot``, gapless from 0 within a shard. Shards
    differ from the mean by at most one record's size at either end. Equal texts lie side
    by side and so in one shard or in neighbours, unless they fill whole ranges, which are
    subdivided. Null ids are placed like others; repeated rows each get a slot; an empty table
    gives no rows; other columns are not read.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        # the text's hash first, so that equal texts meet; the id's hash parts a large group
        F.shiftleft(F.shiftright(F.xxhash64(text), 32), 32)
        .bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 32))
        .alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = write_shared(rows)
    ranges = shards * RANGES_PER_SHARD
    placed = rows.withColumn("range", range_of("key", splitters(rows, ranges)))

    # what a range holds beyond twice the mean is dealt into parts by the row's hash
    held = placed.groupBy("range").agg(F.sum("size").alias("bytes"))
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(ranges)
    parts = held.select("range", F.greatest(F.lit(1), F.when(F.col("bytes") > 2 * mean, F.ceil(F.col("bytes") / mean))).alias("parts"))
    placed = placed.join(F.broadcast(parts), "range")  # at most as many rows as ranges
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row", F.lit(2)), F.col("parts")))

    order = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = sums.select(
        "range",
        "part",
        F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("range", "part").orderBy("key", "id", "row")
    placed = placed.join(F.broadcast(before), ["range", "part"])  # a few rows for each range
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    middle = start + F.col("size") / 2
    placed = placed.select(
        "id",
        "size",
        "text_crc32",
        F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total"))).cast("int").alias("shard"),
        (F.col("rows_before") + F.row_number().over(inside)).alias("at"),
    )
    placed = write_shared(placed)
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row for each shard
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``bytes``."""
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
