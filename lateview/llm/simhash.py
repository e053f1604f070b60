"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits all variants within half the radius; equal variants meet in one
bucket. Two balls of radius 1 meet for up to two differing bits. For a radius of 3 the odd
bit is met by masking: the bits are cut into three blocks and the balls are emitted once with
each block masked. Any three bits touch some block, and without it at most two are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.llm.common import connected_components, slices, table, whole_buckets, write_shared

#: Shingles hashed at once, so that a very long text needs no more memory than a short one.
BLOCK = 1 << 16
#: Bytes of text that a task holds as Python objects at once.
SLICE = 1 << 20
#: Members of a bucket that are compared pair by pair; larger buckets are linked through their structure.
SMALL = 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed long.

    A-Z are lower-cased; words are runs without white space (0x20, 0x09-0x0D); shingles count
    as often as they occur. Fewer words than ``words`` make one shingle; no words give 0.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    total = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, total, BLOCK):
        part = found[start : start + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(found) > words else [b" ".join(found)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row; null and empty texts have fingerprint 0. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE):
            fp = pa.array([fingerprint(t.as_py(), words) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, radius: int) -> list[int]:
    """The bits kept under each mask."""
    if radius not in (2, 3):
        raise ValueError("the radius must be 2 or 3")
    if not 3 <= bits <= 64:
        raise ValueError("a fingerprint has 3 to 64 bits")
    full = (1 << bits) - 1
    if radius == 2:
        return [full]
    cut = [bits * i // 3 for i in range(4)]
    return [full & ~(((1 << cut[i + 1]) - 1) & ~((1 << cut[i]) - 1)) for i in range(3)]


def ball(bits: int = 64, radius: int = 3) -> list[tuple[int, int, int]]:
    """``(mask number, kept bits, flip)`` of every variant that a fingerprint emits, as signed longs."""
    return [
        (m, _signed(keep), _signed(flip))
        for m, keep in enumerate(_masks(bits, radius))
        for flip in [0, *(1 << i for i in range(bits) if keep >> i & 1)]
    ]


def variants(fps: DataFrame, bits: int = 64, radius: int = 3) -> DataFrame:
    """Explode each row of ``fps`` (with a long ``fp``) into its ball: adds ``mask`` and ``variant``."""
    body = ",".join(f"named_struct('m', {m}Y, 'k', {_sql(k)}, 'f', {_sql(f)})" for m, k, f in ball(bits, radius))
    kinds = F.expr(f"array({body})")
    out = fps.withColumn("_v", F.explode(kinds))
    return out.select(
        *fps.columns,
        F.col("_v.m").alias("mask"),
        F.col("fp").bitwiseAND(F.col("_v.k")).bitwiseXOR(F.col("_v.f")).alias("variant"),
    )


def _sql(x: int) -> str:
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"{x}L"


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _linked(b: np.ndarray, f: np.ndarray, none: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether groups i and j of one bucket hold two fingerprints within 3 bits.

    b: the masked block's bits; f: the flips seen; none: the mark of no flip. Outside the block
    two members differ in 0 bits (same flip), 1 (one has none) or 2.
    """
    d = _popcount(b[i] ^ b[j])
    same = (f[i] & f[j]) != 0
    either = ((f[i] | f[j]) & none[i]) != 0
    return (d <= 1) | ((d == 2) & (same | either)) | ((d == 3) & same)


def _forest(b: np.ndarray, f: np.ndarray, none: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one large bucket of distinct block values."""
    n = len(b)
    label = np.arange(n)
    pairs = []
    if n <= 4096:
        step = max(1, (1 << 20) // n)
        for s in range(0, n, step):
            i, j = np.divmod(np.arange(s * n, min(n, s + step) * n), n)
            i, j = i[i < j], j[i < j]
            ok = _linked(b, f, none, i, j)
            pairs.append((i[ok], j[ok]))
    else:  # every block value within three bits is looked up: linear in the bucket
        order = np.argsort(b)
        ranked = b[order]
        bit = [np.uint64(1 << k) for k in range(64) if block >> k & 1]
        steps = [x for x in bit]
        steps += [x ^ y for a, x in enumerate(bit) for y in bit[:a]]
        steps += [x ^ y ^ z for a, x in enumerate(bit) for c, y in enumerate(bit[:a]) for z in bit[:c]]
        for x in steps:
            want = b ^ x
            at = np.minimum(np.searchsorted(ranked, want), n - 1)
            i = np.flatnonzero((ranked[at] == want) & (want > b))
            j = order[at[i]]
            ok = _linked(b, f, none, i, j)
            pairs.append((i[ok], j[ok]))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return label[at], at


def _bucket_edges(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, masks: list[int]) -> list[tuple]:
    """Verified edges of whole buckets (radius 3): enough to connect all that is within 3 bits."""
    keep = np.array(masks, np.uint64)[mask]
    b = fp & ~keep
    o = np.lexsort((b, key, mask))
    mask, key, fp, b, keep = mask[o], key[o], fp[o], b[o], keep[o]
    flip = (fp & keep) ^ key
    spare = np.array([~m & (m + 1) if m & 1 else 1 for m in masks], np.uint64)[mask]  # a bit that no flip uses
    flip = np.where(flip == 0, spare, flip)
    new_bucket = np.r_[True, (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])]
    new_group = new_bucket | np.r_[True, b[1:] != b[:-1]]
    first = np.flatnonzero(new_group)
    lead = first[np.cumsum(new_group) - 1]
    rest = np.flatnonzero(~new_group)
    out = [(fp[lead[rest]], fp[rest])]  # same block: at most two bits apart
    seen = np.bitwise_or.reduceat(flip, first)
    gb, gfp, gnone, gmask = b[first], fp[first], spare[first], mask[first]
    head = np.flatnonzero(new_bucket[first])
    run = np.diff(np.r_[head, len(first)])
    small = np.repeat(run <= SMALL, run)
    where = np.repeat(head, run)
    for d in range(1, SMALL):
        if len(first) <= d:
            break
        i = np.flatnonzero((where[d:] == where[:-d]) & small[d:])
        if not len(i):
            break
        i = i[_linked(gb, seen, gnone, i, i + d)]
        out.append((gfp[i], gfp[i + d]))
    for k in np.flatnonzero(run > SMALL):
        s = slice(head[k], head[k] + run[k])
        i, j = _forest(gb[s], seen[s], gnone[s], ~masks[gmask[head[k]]] & (1 << 64) - 1)
        out.append((gfp[s][i], gfp[s][j]))
    return out


def links(fps: DataFrame, bits: int = 64, radius: int = 3) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints of ``fps.fp`` that connect whatever lies within ``radius`` bits.

    Linear in the input however many fingerprints meet in a bucket: members that agree on the
    masked block are tied to one of them, and the groups that are left are joined by a forest.
    """
    masks = _masks(bits, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, key, fp in whole_buckets(batches):
            mask, key, fp = mask.astype(np.int64), key.view(np.uint64), fp.view(np.uint64)
            if radius == 2:  # one bucket, at most two bits apart
                new = np.r_[True, key[1:] != key[:-1]]
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                pairs = [(fp[lead[~new]], fp[~new])]
            else:
                pairs = _bucket_edges(mask, key, fp, masks)
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = variants(fps.select("fp").distinct(), bits, radius).select("mask", "variant", "fp")
    return (
        rows.repartition("variant", "mask")
        .sortWithinPartitions("mask", "variant")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``: every row with the smallest id reachable over links.

    Two rows link if their fingerprints differ in at most ``radius`` bits; rows with equal
    fingerprints are one node, so copies cost nothing. Null and empty texts have fingerprint 0
    and link like any other. Rows with a null id take part but name no component: one whose
    rows all lack an id has a null component_id. Repeated rows come out as often as they
    came in. An empty table gives no rows.
    """
    fps = write_shared(fingerprints(docs, id_col, text_col, words))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(nodes, 64, radius))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(nodes.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its 3-word SimHash and its component under links of at most 3 bits."""
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
