"""Near-duplicates against brute force over all pairs."""

import collections
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateview.llm import near as dedup


def test_near_duplicates_go_and_the_rest_stays(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    rows, keep = [], set()
    for g in range(30):
        words = rng.choices(vocabulary, k=300)
        rows.append((10 * g, " ".join(words), "s"))
        keep.add(10 * g)
        for k in range(3):  # one or two changed words: over 0.9 of the shingles stay
            near = list(words)
            for _ in range(k + 1):
                near[rng.randrange(300)] = rng.choice(vocabulary)
            rows.append((10 * g + k + 1, " ".join(near), "s"))
        far = words[:150] + rng.choices(vocabulary, k=150)
        rows.append((10 * g + 9, " ".join(far), "s"))
        keep.add(10 * g + 9)
    rows += [(1000, None, "n"), (1001, "", "e"), (1002, "", "e"), (0, rows[0][1], "s"), (None, "only here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    out = dedup.drop_near_duplicates(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == keep | {1000, 1001, None}
    assert dedup.drop_near_duplicates(df.limit(0)).count() == 0


def kept_by_brute_force(rows):
    """Ids that stay of ``id, text`` rows when every pair at 0.8 of five-word shingles is linked."""
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return {min(g) for g in groups.values()}


def test_copies_near_their_template_alone_go_too(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CROWD", 20, raising=False)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(3000)]
    rows = []
    for g in range(2):
        template = rng.choices(vocabulary, k=300)
        rows.append((1000 * g + 500, " ".join(template)))
        for k in range(60):  # six changes: over 0.8 of the template's shingles, under 0.8 of another copy's
            near = list(template)
            for at in rng.sample(range(5, 295), 6):
                near[at] = rng.choice(vocabulary)
            rows.append((1000 * g + k, " ".join(near)))
    want = kept_by_brute_force(rows)
    assert len(want) < 5
    got = dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == want


def test_copies_with_a_passage_more_go_too(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(3000)]
    rows = []
    for g in range(60):
        words = rng.choices(vocabulary, k=rng.choice([8, 60, 300]))
        rows.append((10 * g, " ".join(words)))
        for k, share in enumerate((0.05, 0.15, 0.2, 0.24, 0.3)):
            passage = rng.choices(vocabulary, k=max(1, int(share * len(words))))
            at = rng.choice([0, len(words), rng.randrange(len(words))])
            rows.append((10 * g + k + 1, " ".join(words[:at] + passage + words[at:])))
    want = kept_by_brute_force(rows)
    got = dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == want
    fewer = dedup.common_shingles(spark.createDataFrame([(1, b"a b c d e f")] * 3, "node long, text binary"), 5, 3)
    assert fewer[1].tolist() == [3, 3]


def test_crowds_in_an_order_that_puts_the_common_first(spark, monkeypatch):
    """Any order finds the same pairs: here SimHash proposes nothing, and all buckets are crowds."""
    rng = random.Random(14)
    words = lambda k: [f"{rng.randrange(1 << 40):x}" for _ in range(k)]
    licence, rows = words(100), []
    for g in range(50):
        own = words(25)
        rows += [(2 * g, " ".join(licence + own)), (2 * g + 1, " ".join(licence[g % 9 :] + own + words(2)))]
    want = kept_by_brute_force(rows)
    assert len(want) == 50
    common = dedup.common_shingles
    monkeypatch.setattr(dedup, "CROWD", 20)
    monkeypatch.setattr(dedup, "simhash_pairs", lambda nodes: nodes.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(dedup, "common_shingles", lambda *a: (lambda s, n: (s, -n))(*common(*a)))
    got = dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == want


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_no_pair_of_a_real_table_is_lost(spark):
    """All pairs at 0.8 by an inverted index of every shingle, in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    first, sets, holds = {}, {}, {}
    for k, t in rows:
        if first.setdefault(t, k) != k:
            continue
        w = (t or "").encode().lower().split()
        sets[k] = {hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set()
    for k in sorted(sets, key=lambda k: len(sets[k])):
        for s in sets[k]:
            holds.setdefault(s, []).append(k)
    shared = collections.Counter()
    for ks in holds.values():
        if 1 < len(ks) <= 600:
            shared.update(itertools.combinations(sorted(ks), 2))
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    groups = components(near)
    want = {min(first[t], groups.get(first[t], first[t])) for _, t in rows}
    got = {r.doc_id for r in dedup.drop_near_duplicates(docs).select("doc_id").collect()}
    assert len(near) > 20 and got == want


def test_shingles_codes_and_bitmaps():
    rng = random.Random(3)
    texts = [None, b"", b" \t ", b"One", b"one two THREE four", b"a b c d e", b"a b c d e f a b c d e f"]
    texts += [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 400))).encode() for _ in range(60)]
    texts += [" ".join(rng.choices("abcdefghijklmnop", k=1500)).encode(), b"w " * 300000]
    words, ends = dedup.word_hashes(texts)
    of, h = dedup.shingles(words, ends, 5)
    sets = [set(h[of == i].tolist()) for i in range(len(texts))]
    plain = []
    for t in texts:
        w = (t or b"").lower().split()
        plain.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    assert [len(s) for s in sets] == [len(s) for s in plain]
    assert all(len(sets[i] & sets[j]) == len(plain[i] & plain[j]) for i in range(40) for j in range(i))
    bits = dedup.bitmaps(of, h, len(texts))
    assert {len(x) for x in bits} == {128, 256} and len(bits[-2]) == 256
    for i in range(len(texts)):
        for j in range(i):
            apart = dedup.bits_apart(bits[i], bits[j])
            assert apart <= len(sets[i] ^ sets[j])
            shared = len(sets[i] & sets[j])
            if sets[i] and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                assert dedup.possible(0.8, np.array([apart]), np.array([len(sets[i]) + len(sets[j])]))[0]
    small = dedup.bitmaps(of[of == len(texts) - 2][:900] * 0, h[of == len(texts) - 2][:900], 1)[0]
    assert len(small) == 128 and dedup.folded(bits[-2], 128) != bits[-2]
    codes = dedup.word_codes(words, ends)
    assert codes[0] == codes[1] == codes[2] == 0
    again, e = dedup.word_hashes(texts[3:6])
    assert dedup.word_codes(again, e).tolist() == codes[3:6].tolist()


def test_unwritten_frames_nulls_and_empty_tables(spark):
    rows = [(None, "a b c d e f", 1), (4, "a b c d e f", 2), (None, None, 3), (5, None, 4), (6, "", 5), (7, "", 6), (8, " ", 7), (9, "A B c d e f", 8), (9, "x", 9), (9, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3).withColumn("node", F.rand())
    got = sorted((r.doc_id, r.text, r.place) for r in dedup.drop_near_duplicates(df).collect())
    assert got == [(4, "a b c d e f", 2), (5, None, 4), (6, "", 5), (8, " ", 7), (9, "x", 9)]
    assert dedup.drop_near_duplicates(df).columns == df.columns and dedup.drop_near_duplicates(df.limit(0)).count() == 0
