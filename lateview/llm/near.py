"""Near-duplicate texts: SimHash proposes, a prefix filter on five-word shingles completes, whole texts decide.

Texts travel once: all rows are written with a place each, bucketed by place, and whatever needs texts
again is joined to that table where it lies. Everything else is narrow. Equal texts are one node. SimHashes
of distinct words meet by ball hashing and link most copies. Prefixes of shingles then meet: two texts
at the threshold have a shingle in common among the first fifth of either, rare ones first; pairs that are in
one group by then are passed over. A pair is read only if bitmaps of either's shingles leave it possible.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateview.llm.common import binary_array, connected_components, slices, whole_buckets, write_shared
from lateview.llm.simhash import variants
from lateview.sources.shared import discard, fresh_folder

#: Bytes of text that a task takes apart at once.
SLICE = 1 << 20
#: Bits of a SimHash over distinct words, of which two may differ in a proposed pair.
BITS = 64
#: Bytes of the smallest bitmap of a text's shingles; longer texts have twice, four times as many and so on, a bit a shingle at least.
BITMAP = 128
#: Texts whose shingles are counted to tell common from rare ones; common shingles held, at most.
COUNTED, COMMON = 8192, 1 << 17
#: Members of a bucket whose pairs are all candidates at once; members of a crowd, or of a star, that one task holds against others.
SMALL, CROWD = 16, 1024

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word of all texts, one after another, and where each text begins and ends in them.

    A-Z are lower-cased; words are runs without white space (0x20, 0x09-0x0D).
    """
    data = np.frombuffer(b" ".join([t or b"" for t in texts]).lower() + b" ", np.uint8)
    gap = _SPACE[data]
    starts = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    at = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    stop = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
    coded = binary_array(np.cumsum(np.r_[0, stop - at]), data[~gap].tobytes()).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.to_pylist()), np.uint64)
    return known[coded.indices.to_numpy()], np.searchsorted(at, starts)


def _distinct(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of a text once, sorted."""
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return of[new], h[new]


def shingles(words: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``of, h``: the distinct shingles of ``size`` words of every text, by text and hash; a shorter text is one shingle."""
    many = np.diff(ends)
    of = np.repeat(np.arange(len(many)), many)
    short = np.flatnonzero((many > 0) & (many < size))
    h = words.copy()
    valid = np.arange(len(words)) + size <= ends[1:][of]
    prime = np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, size):
        h[: len(h) - k] = _mix(h[: len(h) - k] * prime + words[k:])
    whole = []
    for i in short.tolist():
        x = np.array([many[i]], np.uint64)
        for w in words[ends[i] : ends[i + 1]]:
            x = _mix(x * prime + w)
        whole.append(x[0])
    return _distinct(np.r_[of[valid], short], np.r_[h[valid], np.array(whole, np.uint64)])


def word_codes(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The SimHash of every text's distinct words, as signed longs; 0 for texts without words."""
    of, h = _distinct(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), words)
    out = np.zeros(len(ends) - 1, np.int64)
    head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    step = 1 << 17  # hashes whose bits are counted at once
    ones = np.zeros((len(head), 64), np.int64)
    rank = np.cumsum(np.isin(np.arange(len(of)), head, assume_unique=True)) - 1
    for s in range(0, len(h), step):
        bits = np.unpackbits(_mix(h[s : s + step]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        part = rank[s : s + step]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ones[part[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    on = 2 * ones > np.diff(np.r_[head, len(of)])[:, None]
    out[of[head]] = np.packbits(on, axis=1).view(">i8").reshape(-1)
    return out


def bitmaps(of: np.ndarray, h: np.ndarray, texts: int) -> list[bytes]:
    """Of each place of a text's bitmap, whether an odd number of the text's shingles falls there."""
    n = np.bincount(of, minlength=texts)
    bits = BITMAP * 8 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / (BITMAP * 8)))).astype(np.int64)
    start = np.cumsum(np.r_[0, bits])
    odd = np.bincount(start[of] + (h & (bits[of] - 1).astype(np.uint64)).astype(np.int64), minlength=start[-1]) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [data[a:z] for a, z in zip((start[:-1] // 8).tolist(), (start[1:] // 8).tolist())]


def folded(bitmap: bytes, size: int) -> bytes:
    """A bitmap as it would be with ``size`` bytes, which must be a power of two less or the same."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = (int.from_bytes(bitmap[:half], "little") ^ int.from_bytes(bitmap[half:], "little")).to_bytes(half, "little")
    return bitmap


def possible(threshold: float, apart: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of together ``sizes`` shingles may reach ``threshold``: they differ in as many at least as their bitmaps do."""
    return apart * (1 + threshold) <= (1 - threshold) * sizes + 1e-6


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many places two bitmaps differ, at the size of the smaller."""
    size = min(len(a), len(b))
    return (int.from_bytes(folded(a, size), "little") ^ int.from_bytes(folded(b, size), "little")).bit_count()


def placed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a ``place`` for each row, written bucketed by place, and its columns' names by those in the table.

    Joins on the place find these rows where they lie. The columns are renamed, so that none clashes.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*held).withColumn("place", F.monotonically_increasing_id())
    name = f"lateview_{uuid.uuid4().hex}"
    out = rows.repartition(n, "place").write.bucketBy(n, "place").option("path", fresh_folder(spark, "placed"))
    out.option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved: the name is not needed any more, and the files stay
    spark.sql(f"DROP TABLE {name}")
    return table, held


def distinct_texts(rows: DataFrame, words: int) -> DataFrame:
    """``node, id, fp, n, bits, small`` for every distinct text of ``place, id, text``: the row of the smallest id (null last) and then place.

    Texts are equal if their SHA-256 is. fp: SimHash of the distinct words; n: distinct shingles; bits: their bitmap; small: the same at the smallest size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, SLICE):
            texts = b.column(2).to_pylist()
            found, ends = word_hashes(texts)
            of, h = shingles(found, ends, words)
            digest = [bytes(32) if t is None else hashlib.sha256(t).digest() for t in texts]
            columns = [b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(word_codes(found, ends)), pa.array(np.bincount(of, minlength=len(texts)).astype(np.int32))]
            bits = bitmaps(of, h, len(texts))
            columns += [pa.array(bits, pa.binary()), pa.array([folded(x, BITMAP) for x in bits], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["place", "id", "digest", "fp", "n", "bits", "small"])

    kind = rows.schema["id"].dataType.simpleString()
    keys = write_shared(rows.mapInArrow(run, f"place long, id {kind}, digest binary, fp long, n int, bits binary, small binary"))
    best = keys.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("w"))
    best = best.select(F.col("w.place").alias("node"))
    out = write_shared(keys.join(best, keys.place == best.node).select("node", "id", "fp", "n", "bits", "small"))
    discard(keys)
    return out


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Candidate pairs ``a, b`` whose SimHashes differ in two bits at most; those of equal SimHash are held against the first of them.

    A bucket holds the fingerprints one flip away from its variant, 65 at most, and all their pairs are candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node in whole_buckets(batches, 1):
            found = []
            for d in range(1, BITS + 1):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                found.append((node[i], node[i + d]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    nodes = nodes.where("n > 0").select("node", "fp")
    lead = nodes.groupBy("fp").agg(F.min("node").alias("lead"))
    same = nodes.join(lead, "fp").where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    rows = variants(lead, BITS, 2).select("variant", "lead")
    met = rows.repartition("variant").sortWithinPartitions("variant", "lead").mapInArrow(run, "a long, b long")
    return same.unionByName(met).distinct()


def possible_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (``a, b``) that the bitmaps leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart = [bits_apart(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                ok = possible(threshold, np.array(apart), b.column(4).to_numpy())
                yield b.select([0, 1]).filter(pa.array(ok))

    of = lambda k: nodes.select(F.col("node").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("n").cast("long").alias(f"n_{k}"))
    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6
    rows = pairs.join(of("a"), "a").join(of("b"), "b").where(near)
    rows = rows.select("a", "b", "bits_a", "bits_b", (F.col("n_a") + F.col("n_b")).alias("n"))
    return rows.mapInArrow(run, "a long, b long")


def verified(table: DataFrame, text: str, pairs: DataFrame, words: int, threshold: float) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose whole texts share ``threshold`` of their distinct shingles (Jaccard), written.

    The partners of a text come together with it, in parts of about ``CROWD`` each with the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for b in slices(batches, 3, SLICE):
            found, ends = word_hashes(b.column(3).to_pylist())
            of, h = shingles(found, ends, words)
            at = np.searchsorted(of, np.arange(b.num_rows + 1))
            group, node = b.column(0).to_numpy(), b.column(2).to_numpy()
            near = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                s = h[at[i] : at[i + 1]]
                if group[i] == node[i]:
                    centre = s
                elif len(s) and len(centre):
                    shared = len(np.intersect1d(centre, s, assume_unique=True))
                    near[i] = shared >= threshold * (len(centre) + len(s) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(group[near]), pa.array(node[near])], ["a", "b"])

    pairs = write_shared(pairs)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CROWD).alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b", F.lit(5)), "parts").alias("part"), "b")
    centres = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"))
    wanted = members.unionByName(centres).hint("shuffle_hash")
    texts = table.select("place", F.col(text).cast("binary").alias("text"))
    rows = texts.join(wanted, texts.place == F.col("b")).select("a", "part", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"), "b")
    out = write_shared(rows.mapInArrow(run, "a long, b long"))
    discard(pairs)
    return out


def common_shingles(texts: DataFrame, words: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of the shingles that a bounded sample of the ``n`` texts ``node, text`` holds thrice or more, and how often.

    They only say in which order shingles stand in a prefix, and which buckets are dealt out from the start. Any order
    gives the same pairs; this one keeps buckets small.
    """
    rate = min(1.0, COUNTED / max(1, n))
    drawn = texts.where(F.xxhash64("node", F.lit(9)).bitwiseAND(F.lit((1 << 40) - 1)) < F.lit(int(rate * (1 << 40))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(*word_hashes(b.column(1).to_pylist()), words)[1].view(np.int64))], ["s"])

    counts = drawn.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    rows = sorted((r["s"] & ((1 << 64) - 1), r["n"]) for r in counts.orderBy(F.desc("n"), "s").limit(COMMON).collect())
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)


def prefix_rows(texts: DataFrame, words: int, threshold: float, n: int) -> DataFrame:
    """``key, part, node, shift, meta`` of every text's prefix, from the ``n`` texts ``node, text, root``.

    A prefix holds a fifth of a text's shingles, rare ones first. shift: root less node, as most are their own root; meta: place in the order
    and number of shingles, in one long. part: 0; or, for a shingle that is common in the sample, one of as many parts from 1 as it may need.
    """
    held = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, words, n))  # bounded by COMMON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = held.value
        for b in slices(batches, 1, SLICE):
            node, root = b.column(0).to_numpy(), b.column(2).to_numpy()
            of, h = shingles(*word_hashes(b.column(1).to_pylist()), words)
            count = np.bincount(of, minlength=b.num_rows)
            keep = count - np.ceil(threshold * count - 1e-9).astype(np.int64) + 1
            seen = np.zeros(len(h), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                seen = np.where(common[at] == h, often[at], 0)
            order = np.lexsort((h, seen, of))
            of, h, seen = of[order], h[order], seen[order]
            rank = np.arange(len(h)) - (np.cumsum(count) - count)[of]
            first = rank < keep[of]
            of, h, seen, rank = of[first], h[first], seen[first], rank[first]
            parts = -(-np.abs(seen) * n // (COUNTED * CROWD))
            part = np.where(seen != 0, 1 + (_mix(node[of].view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), 0)
            columns = [h.view(np.int64), part, node[of], (root - node)[of], rank << 32 | count[of]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "part", "node", "shift", "meta"])

    return texts.mapInArrow(run, "key long, part long, node long, shift long, meta long")


def _within(threshold: float, n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether texts i and j of n shingles may reach ``threshold`` if their first common one has place ``at`` in each."""
    most = np.minimum(n[i] - at[i], n[j] - at[j])
    return most * (1 + threshold) >= threshold * (n[i] + n[j]) - 1e-6


def prefix_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs ``a, b`` of different roots, and the members ``a, key, at, n`` of crowds, from rows of :func:`prefix_rows`.

    In a bucket of up to ``SMALL`` texts all pairs are candidates. In a crowd, or a part of one, each text is held
    against its neighbour and against the one with the fewest rare shingles, as is the template
    of many copies; the members come out for :func:`crowd_pairs` to deal with the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key", "at", "n"]
        for key, part, node, shift, meta in whole_buckets(batches, 2):
            at, n, root = meta >> 32, meta & ((1 << 32) - 1), node + shift
            head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            size = np.diff(np.r_[head, len(key)])
            where, run = np.repeat(head, size), np.repeat(size, size)
            crowd = np.flatnonzero((run > SMALL) | (part > 0))
            pairs = [(where[crowd], crowd)]
            for d in range(1, SMALL):
                if len(key) <= d:
                    break
                i = np.flatnonzero((where[d:] == where[:-d]) & ((run[d:] <= SMALL) & (part[d:] == 0) | (d == 1)))
                if not len(i):
                    break
                pairs.append((i, i + d))
            i, j = (np.concatenate(x) for x in zip(*pairs))
            ok = (i != j) & (root[i] != root[j]) & _within(threshold, n, at, i, j)
            found = np.unique(np.stack([np.minimum(node[i], node[j])[ok], np.maximum(node[i], node[j])[ok]]), axis=1)
            none = pa.nulls(found.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), none, none, none], names)
            columns = [pa.array(c[crowd]) for c in (node, key, at, n)]
            yield pa.RecordBatch.from_arrays([columns[0], pa.nulls(len(crowd), pa.int64()), *columns[1:]], names)

    met = rows.repartition("key", "part").sortWithinPartitions("key", "part", "meta", "node")
    return met.mapInArrow(run, "a long, b long, key long, at long, n long")


def crowd_pairs(crowds: DataFrame, threshold: float) -> DataFrame:
    """All further candidates ``a, b`` of the crowds (``node, key, at, n, root, bits``, the small bitmap), but for pairs of one root.

    A crowd is dealt in blocks of about ``CROWD`` members, every two of which meet in a bucket of their own. Bitmaps at their
    smallest size pass over most pairs at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_buckets(batches, 3):
            ends = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0), True])
            for x, z in zip(ends[:-1], ends[1:]):
                _, low, high, n, at, node, root, block, bits = (c[x:z] for c in columns)
                bits = np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITMAP // 8)
                last = np.searchsorted(n, n / threshold + 1e-6, "right")  # by size: what is larger cannot be near
                start = 0
                while start < len(n):
                    ahead = np.maximum(last[start:] - np.arange(start, len(n)) - 1, 0)
                    take = max(1, int(np.searchsorted(np.cumsum(ahead), 1 << 18)))
                    ahead = ahead[:take]
                    i = np.repeat(np.arange(start, start + len(ahead)), ahead)
                    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
                    start += take
                    ok = (root[i] != root[j]) & ((low[i] == high[i]) | (block[i] != block[j])) & _within(threshold, n, at, i, j)
                    i, j = i[ok], j[ok]
                    ok = possible(threshold, np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64), n[i] + n[j])
                    i, j = i[ok], j[ok]
                    if len(i):
                        pair = [np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in pair], ["a", "b"])

    mixed = crowds.groupBy("key").agg(F.min("root").alias("_r"), F.max("root").alias("_s"), F.ceil(F.count("*") / CROWD).alias("blocks"))
    dealt = crowds.join(mixed.where("_r != _s"), "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "n", "at", "node", "root", "block", "bits")
    met = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "n", "node")
    return met.mapInArrow(run, "a long, b long").distinct()


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_groups(table: DataFrame, text: str, nodes: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``node, root`` for the distinct texts with near-duplicates, but for roots themselves.

    table: rows with ``place`` and the column ``text``; nodes: their distinct texts. Near-duplicates share at least ``threshold``
    of their distinct ``words``-word shingles; texts without words are near no other. All pairs at the threshold end in one group: SimHash
    links what it can, prefixes miss none of the rest, and whole texts decide on every candidate.
    """
    near = verified(table, text, possible_pairs(simhash_pairs(nodes), nodes, threshold), words, threshold)
    roots = connected_components(near)
    known = nodes.where("n > 0").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")).hint("shuffle_hash")
    texts = table.join(known, F.col("place") == F.col("node")).select("node", F.col(text).cast("binary").alias("text"), "root")
    more = write_shared(prefix_pairs(prefix_rows(texts, words, threshold, nodes.where("n > 0").count()), threshold))
    pairs = more.where("b is not null").select("a", "b").distinct()
    near = verified(table, text, possible_pairs(pairs, nodes, threshold), words, threshold)
    roots = connected_components(_edges(roots).unionByName(near))
    crowds = more.where("b is null").select(F.col("a").alias("node"), "key", "at", "n")
    held = nodes.select("node", F.col("small").alias("bits")).join(roots, "node", "left").select("node", "bits", F.coalesce("root", "node").alias("root"))
    pairs = crowd_pairs(crowds.join(held, "node"), threshold)
    rest = verified(table, text, possible_pairs(pairs, nodes, threshold), words, threshold)
    roots = connected_components(_edges(roots).unionByName(rest))
    discard(more)
    return roots


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of equal or near-equal texts: that of the smallest id.

    Columns stay as they are, also such as are named like those used here. Null equals null and empty equals empty. A null id
    counts as larger than any; of repeated rows one stays. An empty table gives no rows. ``docs`` are read once; their rows are shuffled
    once, when they are written by place, and neither sorted nor aggregated.
    """
    table, held = placed(docs)
    at = {c: k for k, c in held.items()}
    rows = table.select("place", F.col(at[id_col]).alias("id"), F.col(at[text_col]).cast("binary").alias("text"))
    nodes = distinct_texts(rows, words)
    roots = near_groups(table, at[text_col], nodes, words, threshold)
    grouped = nodes.select("node", "id").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    best = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("w"))
    best = best.select(F.col("w.node").alias("_kept")).hint("shuffle_hash")
    kept = table.join(best, F.col("place") == F.col("_kept"), "left_semi")
    return kept.select(*held).toDF(*held.values())
