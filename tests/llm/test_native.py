"""Sharding, mixing and chat formatting against plain Python."""

import hashlib
import re
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from lateview.llm import chat, mixing, sharding


def documents(n=400):
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(i % 50)), f"s{i % 5}") for i in range(n)]
    rows += [(n + i, "the same text again and again", "s0") for i in range(n // 2)]  # a third of all rows
    return rows + [(10**6, None, None), (10**6 + 1, "", None), (None, "no id", "s1"), (3, rows[3][1], "s3"), (3, rows[3][1], "s3"), (10**6 + 2, "long " * 5000, "s2")]


SCHEMA = "doc_id long, text string, source string"


def test_shards_are_equal_gapless_and_repeatable(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit("x"), "size": F.lit(0)})
    out = sharding.shard_by_bytes(df, 7).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == sorted((d or -1, size(t), zlib.crc32((t or "").encode())) for d, t, _ in rows)
    total, most = sum(r.size for r in out), max(r.size for r in out)
    for s in range(7):
        mine = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 7) <= most
    assert sorted(map(str, sharding.shard_by_bytes(df, 7).collect())) == sorted(map(str, out))


def test_shard_edges(spark):
    df = spark.createDataFrame(documents(5), SCHEMA)
    assert {r.shard for r in sharding.shard_by_bytes(df, 1).collect()} == {0}
    assert sharding.shard_by_bytes(df.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(df, 0)


def test_range_of(spark):
    cuts = [-(1 << 63), -5, 0, 7, (1 << 63) - 1]
    keys = [-(1 << 63), -6, -5, -1, 0, 6, 7, 8, (1 << 63) - 1]
    got = [r.n for r in spark.createDataFrame([(k,) for k in keys], "key long").select("key", sharding.range_of("key", cuts).alias("n")).orderBy("key").collect()]
    assert got == [sum(c <= k for c in cuts) for k in keys]


def brute_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    left = share * sum(sizes.values())
    while True:
        active = [s for s in order if s not in full]
        budget = left - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else budget * w[s] / sum(w[x] for x in active) for s in order}
        over = {s for s in active if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix(spark):
    rows = documents() + [(20000 + i, "x y z", "tiny") for i in range(4)] + [(30000, " ", "empty")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df, [3, 1, 2], 1.5).collect()
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(d), words(t)) for d, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = brute_targets(sizes, [3, 1, 2], 1.5, 2)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(abs(r.target - want[s]) < 1e-6 for r in mine) and all(0 <= r.times <= 2 for r in mine)
        assert abs(sum(r.times * r.size for r in mine) - want[s]) <= max(r.size for r in mine)
    again = mixing.mix(df.repartition(5), [3, 1, 2], 1.5).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_take_repeats_rows_and_keeps_columns(spark):
    df = spark.createDataFrame(documents(), SCHEMA).withColumns({"s": F.lit(1), "whole": F.lit("w"), "size": F.lit("z")})
    times = {}
    for r in mixing.mix(df.select("doc_id", "text", "source"), [3, 1, 2], 1.5).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + r.times
    out = mixing.take(df, [3, 1, 2], 1.5)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in times.items() if n}
    assert mixing.take(df.limit(0), [1], 1.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, [0, 1], 1.0)


TEXTS = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<%7C <%25 <| <% %25 <<|>", "a\nb\\n<|x", "é𝔸 <|im_end|>\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_escapes_are_undone(spark, text):
    row = spark.range(1).select(F.lit(text).alias("t")).select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).first()
    assert row.u == row.r == text and "<|" not in row.e


def test_chat_digests(spark):
    roles = ["system", "user", "assistant", None, "odd\nrole %0A <|im_end|>"]
    rows = [(c, t, roles[(c + t * t) % 5], None if (c + t) % 7 == 0 else TEXTS[(c * 3 + t) % len(TEXTS)]) for c in range(20) for t in range(c % 6 + 1)]
    rows += [(3, 1, "user", "twin"), (3, 1, "user", "twin"), (None, 0, "assistant", "no conversation"), (77, None, "user", "no turn"), (77, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat.expand_prefix_targets(df)
    got = {r.conv_id: r for r in chat.chat_digest(examples).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    one = {r.example: r for r in examples.where("conv_id = 77").collect()}
    assert one[0].context.endswith("<|im_start|>assistant\n") and one[0].target == "x" and one[0].tail == chat.END
    assert chat.chat_digest(chat.expand_prefix_targets(df.select("conv_id", "turn", "role", "text").limit(0))).count() == 0


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(9)] + [(-1, 0, "user", "real"), (-1, 1, "assistant", "x" * 300000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("lone", F.lit("clash"))
    got = chat.chat_digest(chat.expand_prefix_targets(df)).collect()
    assert sorted((r.conv_id is None, r.n_turns) for r in got) == [(False, 2)] + [(True, 1)] * 9
    assert [r.loss_chars for r in got if r.conv_id == -1] == [300000]
    assert sorted(r.loss_chars for r in got if r.conv_id is None) == [0] * 4 + [2] * 5


def test_the_probe_is_no_part_of_a_real_conversation(spark, tmp_path):
    rows = [(-1, 0, "user", "real"), (-1, 1, "assistant", "said"), (5, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op4_chat(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.n_turns, r.loss_chars) for r in got) == [(-1, 2, 4), (-1, 2, 34), (5, 1, 0)]


def test_sources_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(documents(), SCHEMA)
    want = sorted(map(str, mixing.mix(df, [3, 1, 2], 1.5).collect()))
    kept = sorted(map(str, mixing.take(df, [3, 1, 2], 1.5).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(df, [3, 1, 2], 1.5).collect())) == want
    assert sorted(map(str, mixing.take(df, [3, 1, 2], 1.5).collect())) == kept


def test_very_long_texts_are_mixed_whole(spark):
    rows = [(1, "word " * 400000, "a"), (2, "w", "a"), (3, "x y", "b")]
    out = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), [3, 1, 2], 1.0).collect()}
    assert [out[i].size for i in (1, 2, 3)] == [400000, 1, 2]


def test_shards_equal_brute_force(spark, monkeypatch):
    """Sizes in order of the texts' hashes, cut where the middle of a record passes a shard's share."""
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 1)
    monkeypatch.setattr(sharding, "KEYS_PER_RANGE", 500)  # so that no range is overfull
    rows = [(i, f"text {i} " + "x" * (i * 37 % 200)) for i in range(900)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def key(i, t):
        low = xxhash.xxh64_intdigest(struct.pack("<q", i), 42) >> 32
        return signed(xxhash.xxh64_intdigest(t.encode(), 42) >> 32 << 32 | low)

    want, start, total = {}, 0, sum(len(t) + 16 for _, t in rows)
    slots = [0] * 6
    for i, t in sorted(rows, key=lambda r: key(*r)):
        size = len(t) + 16
        shard = min(5, int((start + size / 2) * 6 / total))
        want[i] = (shard, slots[shard])
        slots[shard] += 1
        start += size
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()}
    assert got == want
