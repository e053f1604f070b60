"""Mixing sources to target weights by hash-threshold histograms.

A document's hash decides: below its source's threshold it is taken once more than above. The
threshold comes from sums by source and hash bucket; only the bucket that holds the budget's
edge is refined, level by level, so nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lateview.llm.common import table, write_shared

#: Bits of a document's hash that each level refines.
LEVELS = (12, 12, 12)
BITS = sum(LEVELS)
#: Sources up to which a table of one short row each is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def _beside(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``table`` (written, one row a source, under ``key``) for their source: broadcast where its rows are counted as few."""
    few = table.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col(key)), how)


def target_sizes(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all
    sizes. A target stops at ``most`` times its source's size, and what it leaves is shared
    again by weight: with level L, target = least(cap, weight * L), where sources are filled in
    order of cap / weight. One row for each source: the windows run over those alone.
    """
    if min(weights, default=0) <= 0 or not 0 <= share <= most:
        raise ValueError("weights must be positive, and share between 0 and most")
    everything = Window.partitionBy()
    listed = ", ".join(map(str, weights))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("turn", turn).withColumn(
        "weight", F.expr(f"element_at(array({listed}), cast(turn % {len(weights)} as int) + 1)").cast("double")
    )
    rows = rows.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    earlier = Window.orderBy("ratio", "turn").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    rows = rows.withColumn("level", left / weight)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "turn", "level"))
    rows = rows.withColumn("level", F.min(fits).over(everything)["level"])
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """``s, source_size, target, whole, threshold`` for each source of ``rows`` (``source, size, h``).

    A source is taken whole ``whole`` times, and once more where ``h`` is below ``threshold`` (null: nowhere).
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = target_sizes(sizes, weights, share, most)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = write_shared(plan.withColumnRenamed("source", "s"))  # one row for each source

    edge = plan.select("s", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))  # one row a source at every level
    left = BITS
    for bits in LEVELS:
        inside = _beside(rows, edge, "s").where(F.shiftright("h", left) == F.col("prefix"))
        left -= bits
        cells = inside.groupBy("s", "budget", "base", F.shiftright("h", left).alias("cell")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("sum", F.col("base") + F.sum("words").over(upto))
        over = F.col("sum") > F.col("budget")
        edge = cells.where(over).groupBy("s", "budget").agg(F.min(F.struct("cell", "sum", "words")).alias("c"))
        edge = edge.select("s", "budget", F.col("c.cell").alias("prefix"), (F.col("c.sum") - F.col("c.words")).alias("base"), F.col("c.sum").alias("sum"))
        edge = write_shared(edge)
    nearer = F.col("sum") - F.col("budget") < F.col("budget") - F.col("base")
    edge = edge.select(F.col("s").alias("e"), (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))
    plan = plan.join(edge, F.col("s").eqNullSafe(F.col("e")), "left").select("s", "source_size", "target", "whole", "threshold")
    return write_shared(plan)


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[F.Column]:
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return [
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long").alias("h"),
    ]


def _times() -> F.Column:
    return (F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: list[int], share: float, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document goes into the mix: ``id, source, size, source_size, target, times``.

    ``size`` is the text's number of words (runs without 0x20, 0x09-0x0D; null: 0). A source is
    taken whole as often as its target allows, and once more where the hash of the id lies
    below a threshold: the last cell of the histogram goes in if that comes nearer. Rows with
    equal ids, or null ids, share a hash and stand or fall together. Null is a source of its
    own. Sources without words have target 0. An empty table gives no rows.
    """
    rows = write_shared(docs.select(F.col(id_col).alias("id"), *_measured(docs, id_col, text_col, source_col)))
    plan = thresholds(rows, weights, share, most)
    rows = _beside(rows, plan, "s")
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", _times().alias("times"))


def take(docs: DataFrame, weights: list[int], share: float, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with their own columns.

    Texts are not shuffled, as long as the sources are few enough to be broadcast: each row is held against its source's
    threshold, and what is taken twice is repeated. Null texts and texts without words have size 0 and are taken as often as their
    hash says; repeated rows and rows with null ids stand or fall together; columns named like those used here stay as they are;
    an empty table gives no rows.
    """
    rows = write_shared(docs.select(*_measured(docs, id_col, text_col, source_col)))
    plan = thresholds(rows, weights, share, most)
    held = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    marked = docs.select(*(F.col(c).alias(k) for k, c in held.items()), *_measured(docs, id_col, text_col, source_col))
    marked = _beside(marked, plan, "s").withColumn("_times", _times().cast("int"))
    again = F.explode(F.array_repeat(F.lit(0), F.col("_times")))
    return marked.select(*held, again.alias("_again")).select(*(F.col(k).alias(c) for k, c in held.items()))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under weights 3, 1, 2 for 150 % of all words."""
    out = mix(table(spark, sf_dir, "documents"), [3, 1, 2], 1.5)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), turns AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sizes
), caps AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM turns
), levels AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS own
  FROM caps WINDOW w AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(own, (ratio, turn)) FROM levels WHERE own <= ratio)) AS target FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM plan
), cells AS (
  SELECT d.source, h, sum(size) AS words FROM docs d GROUP BY ALL
), sums AS (
  SELECT c.*, b.target - b.whole * b.source_size AS budget, sum(words) OVER (PARTITION BY c.source ORDER BY h) AS upto
  FROM cells c JOIN budgets b ON c.source IS NOT DISTINCT FROM b.source
), picked AS (
  SELECT source, h FROM sums s
  WHERE upto <= budget OR (upto - words <= budget AND upto - budget < budget - (upto - words))
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.whole + CASE WHEN p.h IS NULL OR (b.target - b.whole * b.source_size) <= 0 THEN 0 ELSE 1 END))::BIGINT AS taken
FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN picked p ON d.source IS NOT DISTINCT FROM p.source AND d.h = p.h
"""
