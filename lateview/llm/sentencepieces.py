"""SentencePiece encoding and decoding over a relational lattice.

The corpus is cut into blocks of documents. A block's distinct words (pre-tokens, cut again where
no piece crosses) are dealt by hash into buckets and travel as one string for each block and bucket.
In its bucket every distinct word explodes once into its substrings up to the longest piece, an
equi-join with the piece table leaves the lattice's edges, and a fold over each word's edges
(Spark's higher-order ``aggregate``) finds its best path. Codes go back as one value for each bucket and
block. Documents travel once, compressed by block; where they are put together with their
codes, everything is done on whole blocks in Arrow and numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.llm.common import binary_array, slices, table, value_offsets
from lateview.llm.pieces import MODEL, Pieces

#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Partitions of words for each shuffle partition of the session, as a word's edges take far more room than the word,
#: and buckets for each of them: they, and so what a bucket holds, follow the cluster's setting.
WORD_PARTITIONS, BUCKETS_PER_PARTITION = 4, 4
#: Code points up to which neighbours are looked up in a square table.
DENSE = 0x250


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """``piece, score, code``: the vocabulary as a relation; code is the id in four hexadecimal digits."""
    rows = [(p, s, f"{pieces.ids[p]:04X}") for p, s in pieces.scores.items()]
    return spark.createDataFrame(pa.table(list(map(list, zip(*rows))), ["piece", "score", "code"]))


def best_paths(words: DataFrame, pieces: Pieces, keys: tuple[str, ...] = ()) -> DataFrame:
    """``*keys, word, code`` from distinct ``*keys, word``: the best path's ids, two bytes each, as binary.

    The fold holds the scores and paths of as many places as the longest piece has characters, whatever the word's length.
    """
    held = [*keys, "word"]
    starts = words.select(*held, F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    ends = F.sequence("start", F.least(F.length("word"), F.col("start") + F.lit(pieces.longest - 1)))
    cuts = starts.select(*held, "start", F.explode(ends).alias("end"))
    cuts = cuts.select(*held, "end", "start", F.substr("word", "start", F.col("end") - F.col("start") + 1).alias("piece"))
    vocabulary = F.broadcast(piece_table(words.sparkSession, pieces))  # bounded by the vocabulary
    edges = cuts.join(vocabulary, "piece", "left").where("code is not null or end = start")
    base = pieces.byte_ids[0]
    if pieces.byte_ids != list(range(base, base + 256)) or len(pieces.spelt) > 1 << 16:
        raise ValueError("byte pieces must have ids in a row, and ids two bytes")
    spelt = F.expr(
        "array_join(transform(sequence(1, octet_length(piece)), i -> "
        f"lpad(hex(cast(conv(substr(hex(piece), 2 * i - 1, 2), 16, 10) as int) + {base}), 4, '0')), '')"
    )
    edge = F.struct(
        "end",
        "start",
        F.coalesce("score", F.lit(pieces.unknown)).alias("score"),
        F.when(F.col("code").isNull(), spelt).otherwise(F.col("code")).alias("code"),
    )
    lattice = edges.groupBy(*held).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    # done: score and path of the places before `at`, nearest last, as many as a piece can reach back;
    # now, code: the best so far that ends at `at`. An edge that starts right after `at` opens the next place.
    place = "struct<now:double,code:string>"
    start = f"named_struct('at', 0, 'now', 0D, 'code', '', 'done', cast(array() as array<{place}>))"
    last = pieces.longest - 1
    step = (
        "(a, e) -> if(e.end > a.at,"
        " if(e.start > a.at,"
        "  named_struct('at', e.end, 'now', a.now + e.score, 'code', concat(a.code, e.code), 'done', {done}),"
        "  named_struct('at', e.end, 'now', {back_new}.now + e.score, 'code', concat({back_new}.code, e.code), 'done', {done})),"
        " if({back}.now + e.score > a.now,"
        "  named_struct('at', a.at, 'now', {back}.now + e.score, 'code', concat({back}.code, e.code), 'done', a.done),"
        "  a))"
    )
    here = "named_struct('now', a.now, 'code', a.code)"
    step = step.format(
        done=f"if(size(a.done) < {last}, array_append(a.done, {here}), array_append(slice(a.done, 2, {last - 1}), {here}))",
        back_new="element_at(a.done, e.start - 1 - a.at)",
        back="element_at(a.done, e.start - 1 - a.at)",
    )
    return lattice.select(*held, F.expr(f"unhex(aggregate(edges, {start}, {step}).code)").alias("code"))


class Letters:
    """Which neighbouring characters some piece holds: between others every path has a cut."""

    def __init__(self, joined: set[str]) -> None:
        pairs = np.array(sorted((ord(p[0]) << 21) | ord(p[1]) for p in joined), np.uint64)
        self.pairs = pairs
        self.dense = np.zeros((DENSE, DENSE), bool)
        a, b = (pairs >> np.uint64(21)).astype(np.int64), (pairs & np.uint64((1 << 21) - 1)).astype(np.int64)
        near = (a < DENSE) & (b < DENSE)
        self.dense[a[near], b[near]] = True

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        near = (a < DENSE) & (b < DENSE)
        out = self.dense[np.where(near, a, 0), np.where(near, b, 0)] & near
        far = np.flatnonzero(~near)
        if len(far) and len(self.pairs):
            key = a[far].astype(np.uint64) << np.uint64(21) | b[far].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out[far] = self.pairs[at] == key
        return out


def _hashes(values: pa.Array) -> np.ndarray:
    """A hash of each value, none of which is empty, as the sum of its bytes times powers of an odd number."""
    at = value_offsets(values)
    data = np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    power = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[place], at[:-1])
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Words:
    """The distinct words of a block of texts, dealt into buckets, and the texts as sequences of pre-tokens.

    Pre-tokens are a line feed, or a run of spaces with what follows up to the next space or line feed;
    every text that is not empty has a space in front. tokens: the pre-tokens of all texts, by number; ends: where each text
    begins and ends in them; parts: the words of all distinct pre-tokens, by their place in ``words``; part_at: where a pre-token's begin.
    words: distinct words, bucket after bucket; bucket: that of each.
    """

    def __init__(self, texts: list[bytes | None], letters: Letters, buckets: int) -> None:
        self.data = b"".join([b" " + t for t in texts if t])
        data = np.frombuffer(self.data, np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        self.starts = starts
        space, line = data == 32, data == 10
        new = line.copy()
        new[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        new[starts[:-1][np.diff(starts) > 0]] = True
        at = np.flatnonzero(new)
        self.ends = np.searchsorted(at, starts)
        coded = binary_array(np.append(at, len(data)), self.data).dictionary_encode()
        self.tokens = coded.indices
        names = coded.dictionary

        # the distinct pre-tokens, cut where no piece crosses
        bounds = value_offsets(names)
        raw = names.buffers()[2]
        spelt = np.frombuffer(raw, np.uint8)[: bounds[-1]] if len(names) else np.zeros(0, np.uint8)
        first = np.flatnonzero((spelt & 0xC0) != 0x80)  # bytes that begin a character
        points = np.frombuffer(spelt.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        cut = np.zeros(len(points) + 1, bool)
        cut[np.searchsorted(first, bounds)] = True
        cut[1:-1] |= ~letters.joined(points[:-1], points[1:]) if len(points) else False
        begin = np.append(first, len(spelt))[np.flatnonzero(cut)]
        self.part_at = np.searchsorted(begin, bounds)
        parts = binary_array(begin, raw if len(names) else b"").dictionary_encode()
        words = parts.dictionary
        bucket = ((_hashes(words) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[order]
        self.words = words.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.parts = place[parts.indices.to_numpy()]

    def joined(self) -> tuple[np.ndarray, pa.Array]:
        """The buckets that hold words, and their words, one to a line. The word that is a line feed stands as nothing."""
        head = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]]) if len(self.bucket) else np.zeros(0, np.int64)
        words = pc.if_else(pc.equal(self.words, b"\n"), pa.scalar(b"", pa.large_binary()), self.words)
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(head, len(words)), pa.int64()), words)
        return self.bucket[head], pc.binary_join(lists, pa.scalar(b"\n", pa.large_binary()))

    def encode(self, codes: pa.Array) -> pa.Array:
        """The ids of every text, one text after another, from the ids of ``words`` (four bytes each): a value for each pre-token."""
        parts = codes.take(pa.array(self.parts))
        return binary_array(value_offsets(parts)[self.part_at], parts.buffers()[2]).take(self.tokens)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together up to ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and sum(x.nbytes for x in held) + b.nbytes > most:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _texts(held: pa.Table) -> list[bytes | None]:
    return held["text"].cast(pa.large_binary()).to_pylist()


def _blocks(docs: DataFrame, id_col: str, text_col: str, schema: str, made) -> DataFrame:
    """What ``made(block, table)`` gives for every block of ``doc_id, text``, numbered by partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, held in enumerate(_gathered(slices(batches, 1, 1 << 20), BLOCK_BYTES)):
            yield made(part << 32 | n, held)
            pa.default_memory_pool().release_unused()  # several workers share an executor's memory

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id, ids, decoded_ok``: the piece ids of every whole text, and whether they decode to it again.

    The path through each pre-token is the best by the sum of piece scores; of equal paths the
    one whose last pieces are longest. Null texts have null ids, empty texts none; both decode to
    what they were. Null ids of documents and repeated rows stay; other columns are not read; an empty
    table gives no rows. ``docs`` is read twice, for words and for documents; should the two readings
    not cut the same blocks, as of a frame whose order changes, the job fails and gives no wrong ids.
    """
    pieces = Pieces(model)
    letters, spelt = Letters(pieces.joined), pa.array(pieces.spelt, pa.large_binary())
    parts = WORD_PARTITIONS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes, but much work
    buckets = BUCKETS_PER_PARTITION * parts

    def words_of(block: int, held: pa.Table) -> pa.RecordBatch:
        found, lines = Words(_texts(held), letters, buckets).joined()
        columns = [pa.array(np.full(len(found), block)), pa.array(found.astype(np.int32)), lines.cast(pa.large_string()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "words"])

    def packed(block: int, held: pa.Table) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held.schema) as out:
            out.write_table(held)
        value = zstandard.ZstdCompressor(level=4).compress(sink.getvalue())
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([value], pa.binary())], ["b", "packed"])

    def look_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The codes of each block's words of one bucket: digest of the words, ids of each, the ids."""
        names = pc.if_else(pc.equal(right["word"], "\n"), "", right["word"]).combine_chunks()
        codes = right["code"].combine_chunks().cast(pa.large_binary())
        squeeze = zstandard.ZstdCompressor(level=1)
        blobs = []
        for words in left["words"]:
            at = pc.index_in(pc.split_pattern(pa.array([words.as_py()]), "\n").flatten(), value_set=names)
            if at.null_count:
                raise ValueError("a word without a path")
            got = codes.take(at)
            ends = value_offsets(got)
            data = got.buffers()[2]
            blobs.append(squeeze.compress(b"".join([
                xxhash.xxh64_digest(words.as_py()), np.uint32(len(got)).tobytes(), (np.diff(ends) // 2).astype("<u4").tobytes(),
                bytes(data)[ends[0] : ends[-1]] if data else b"",
            ])))
        return pa.table([left["block"], left["bucket"], pa.array(blobs, pa.binary())], ["block", "bucket", "codes"])

    def put_together(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        if left.num_rows != 1:
            raise ValueError("words of a block that the documents do not have: the table changed between two readings")
        squeezed = zstandard.ZstdDecompressor()
        held = pa.ipc.open_stream(squeezed.decompress(left["packed"][0].as_py())).read_all()
        texts = _texts(held)
        words = Words(texts, letters, buckets)
        found, lines = words.joined()
        right = right.take(pc.sort_indices(right["bucket"]))
        counts, ids = [np.zeros(0, "<u4")], [np.zeros(0, ">u2")]
        blobs = [squeezed.decompress(c.as_py()) for c in right["codes"]]
        if [xxhash.xxh64_digest(x.as_py()) for x in lines] != [b[:8] for b in blobs] or found.tolist() != right["bucket"].to_pylist():
            raise ValueError("the words of a block are not those that were looked up: the table changed between two readings")
        for b in blobs:
            n = int(np.frombuffer(b, "<u4", 1, 8)[0])
            counts.append(np.frombuffer(b, "<u4", n, 12))
            ids.append(np.frombuffer(b, ">u2", -1, 12 + 4 * n))
        ends = np.cumsum(np.r_[0, np.concatenate(counts).astype(np.int64)]) * 4
        codes = binary_array(ends, np.concatenate(ids).astype("<i4").tobytes())
        coded = words.encode(codes)
        at = value_offsets(coded)
        flat = np.frombuffer(coded.buffers()[2] or b"", "<i4")[at[0] // 4 : at[-1] // 4]
        ends = (at - at[0])[words.ends] // 4
        back = spelt.take(pa.array(flat))
        stops = value_offsets(back)
        if (stops[ends] - stops[0] == words.starts).all() and bytes(back.buffers()[2] or b"")[stops[0] : stops[-1]] == words.data:
            ok = [True] * len(texts)
        else:
            all_back, cut = bytes(back.buffers()[2] or b""), stops[ends]
            ok = [all_back[a:z] == (b" " + t if t else b"") for a, z, t in zip(cut[:-1], cut[1:], texts)]
        nulls = pa.array([t is None for t in texts], pa.bool_())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=nulls)
        return pa.table([held["doc_id"], lists, pa.array(ok, pa.bool_())], ["doc_id", "ids", "decoded_ok"])

    met = _blocks(docs, id_col, text_col, "block long, bucket int, words string", words_of).repartition(parts, "bucket")
    listed = met.select("bucket", "block", F.explode(F.split("words", "\n", -1)).alias("word"))
    listed = listed.select("bucket", "block", F.when(F.col("word") == "", "\n").otherwise(F.col("word")).alias("word"))
    # the block stays in the plan, so that both uses of `met` are one shuffle and the texts are read once for it
    distinct = listed.groupBy("bucket", "word").agg(F.max("block").alias("block")).where("block >= 0")
    paths = best_paths(distinct.select(F.col("bucket").alias("k"), "word"), pieces, ("k",))
    codes = met.groupBy("bucket").cogroup(paths.groupBy("k")).applyInArrow(look_up, "block long, bucket int, codes binary")
    left = _blocks(docs, id_col, text_col, "b long, packed binary", packed)
    kind = docs.schema[id_col].dataType.simpleString()
    return left.groupBy("b").cogroup(codes.groupBy("block")).applyInArrow(put_together, f"doc_id {kind}, ids array<int>, decoded_ok boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: null ids give a null text, no ids an empty one.

    Null document ids and repeated rows stay, other columns are not read, an empty table gives no rows.
    """
    pieces = Pieces(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else pieces.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as piece ids, decoded again to check them."""
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "decoded_ok"
    )
