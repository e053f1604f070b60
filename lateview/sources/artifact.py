"""The durable index: Parquet of its items, and a manifest written last and verified first.

``path/items`` holds the rows, ``path/manifest.json`` the plan, the counts and a digest over the
digests of all part files. Both are reached through Spark and Hadoop's file systems alone, so any
store that Spark can write will do.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lateview.operators.index import CompactIndex
from lateview.plans.contracts import CompilePlan

FORMAT_VERSION = 1
#: Bytes of vectors in a part file at most (an item that is larger stands alone), which bounds what a task hashes at once.
FILE_BYTES = 128 << 20
#: Ranges of items whose sums make the offsets.
OFFSET_RANGES = 256


@dataclass(frozen=True)
class IndexManifest:
    """What an artifact holds, and under which plan it was made."""

    plan: CompilePlan
    item_count: int
    vector_count: int
    dimension: int
    payload_sha256: str
    format_version: int = FORMAT_VERSION

    def to_dict(self) -> dict[str, Any]:
        out = {k: getattr(self, k) for k in ("format_version", "item_count", "vector_count", "dimension", "payload_sha256")}
        return out | {"plan": self.plan.to_dict(), "plan_fingerprint": self.plan.fingerprint}

    @classmethod
    def from_dict(cls, value: dict[str, Any]) -> IndexManifest:
        plan = CompilePlan.from_dict(value["plan"])
        if plan.fingerprint != value["plan_fingerprint"]:
            raise ValueError("compile-plan fingerprint mismatch")
        counts = {k: int(value[k]) for k in ("item_count", "vector_count", "dimension", "format_version")}
        return cls(plan=plan, payload_sha256=str(value["payload_sha256"]), **counts)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``name, sha256`` of every part file of a folder, hashed where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def payload_digest(spark: SparkSession, folder: str) -> str:
    """One digest of all part files, in order of their names."""
    lines = [f"{r['name']} {r['sha256']}\n" for r in file_digests(spark, folder).orderBy("name").collect()]
    return hashlib.sha256("".join(lines).encode()).hexdigest()


def rows_a_file(index: CompactIndex) -> int:
    """Items of a part file, so that no file of more than one passes ``FILE_BYTES``."""
    return max(1, FILE_BYTES // (8 * index.dimension * index.most_vectors))


def offsets(items: DataFrame) -> DataFrame:
    """``item_ord, item_id, start, stop``: where each item's vectors lie among all, in order of items.

    Items fall into ranges of their order; sums of the ranges, one row each, say where a range begins, and a running sum
    inside each does the rest, so no task sees all items.
    """
    rows = items.select("item_ord", "item_id", F.size("vectors").cast("long").alias("n"))
    shares = [i / OFFSET_RANGES for i in range(1, OFFSET_RANGES)]
    cuts = sorted(set(rows.agg(F.percentile_approx("item_ord", shares)).first()[0] or []))
    held = F.array(*(F.lit(int(c)).cast("long") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("range", F.size(F.filter(held, lambda c: c < F.col("item_ord"))))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("range").agg(F.sum("n").alias("sum")).select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("begin"))
    upto = F.col("begin") + F.sum("n").over(Window.partitionBy("range").orderBy("item_ord").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.join(F.broadcast(sums), "range")  # at most as many rows as ranges
    return placed.select("item_ord", "item_id", (upto - F.col("n")).alias("start"), upto.alias("stop"))


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def save_index(spark: SparkSession, path: str, index: CompactIndex, plan: CompilePlan) -> IndexManifest:
    """Write an index to a path that must not exist; without its manifest an artifact is none."""
    store, root = _file_system(spark, path)
    if store.exists(root):
        raise FileExistsError(path)
    rows = index.items.select("item_ord", "item_id", "vectors")
    rows.write.mode("errorifexists").option("maxRecordsPerFile", rows_a_file(index)).parquet(f"{path}/items")
    manifest = IndexManifest(plan, len(index), index.vector_count, index.dimension, payload_digest(spark, f"{path}/items"))
    _, target = _file_system(spark, f"{path}/manifest.json")
    out = store.create(target, False)
    try:
        out.write(bytearray((json.dumps(manifest.to_dict(), indent=2, sort_keys=True) + "\n").encode()))
    finally:
        out.close()
    return manifest


def load_index(spark: SparkSession, path: str) -> tuple[CompactIndex, IndexManifest]:
    """The index and manifest of a path; plan, format, digest and counts are verified, in this order."""
    text = spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0]
    manifest = IndexManifest.from_dict(json.loads(text))
    if manifest.format_version != FORMAT_VERSION:
        raise ValueError("unsupported index-artifact format")
    try:
        digest = payload_digest(spark, f"{path}/items")
    except (Py4JJavaError, PySparkException) as e:  # a store that checks its blocks may refuse changed files itself
        raise ValueError("index payload checksum mismatch") from e
    if digest != manifest.payload_sha256:
        raise ValueError("index payload checksum mismatch")
    index = CompactIndex(spark.read.parquet(f"{path}/items"))
    if (len(index), index.vector_count, index.dimension) != (manifest.item_count, manifest.vector_count, manifest.dimension):
        raise ValueError("index payload shape does not match its manifest")
    return index, manifest
