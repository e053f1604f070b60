"""SimHash components against brute force, and the near-duplicate stage on planted copies."""

import random
import re

import numpy as np
import pytest
import xxhash

from lateview.llm import simhash
from lateview.llm.common import connected_components


def components(fps, radius=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius):
            parent[find(i)] = find(i + 1 + int(j))
    out = {}
    for i in range(len(fps)):
        out.setdefault(find(i), set()).add(int(fps[i]))
    return sorted(map(sorted, out.values()))


def slow(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


TEXTS = [None, "", " \t\n", "One", "one two", "A b C d", "a a a a a a", "É é ß x y", "x y z w", "a b\x0bc\x0cd e"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) & (1 << 64) - 1 == slow(text)


def test_fingerprint_of_a_text_longer_than_a_block(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == whole == simhash._signed(slow(text))


def test_a_ball_has_every_variant():
    assert len(set(simhash.ball(64, 3))) == 3 + 2 * 64 and len(simhash.ball(40, 2)) == 41
    for bad in ((64, 4), (2, 2), (65, 3)):
        with pytest.raises(ValueError):
            simhash.ball(*bad)


def test_links_connect_all_within_three_bits(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    fps = set(base)
    for x in base:
        y = x
        for b in rng.choice(64, 3, replace=False):
            y ^= 1 << int(b)
        fps.add(y)
    for _ in range(600):  # a crowd around one centre
        y = base[0]
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            y ^= 1 << int(b)
        fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(df)).collect()}
    got = {}
    for s, u in zip(fps.view(np.int64).tolist(), fps.tolist()):
        got.setdefault(roots.get(s, s), set()).add(u)
    assert sorted(map(sorted, got.values())) == components(fps)


def test_forest_by_pairs_and_by_look_up_agree():
    rng = np.random.default_rng(3)
    block = (1 << 21) - 1
    b = np.unique(rng.integers(0, 1 << 13, 6000).astype(np.uint64))[:5000]
    flips = np.where(rng.random(len(b)) < 0.5, np.uint64(1), np.uint64(1) << rng.integers(21, 64, len(b)).astype(np.uint64))
    none = np.full(len(b), 1, np.uint64)

    def groups(n):
        at = simhash._forest(b[:n], flips[:n], none[:n], block)
        parent = list(range(n))
        for i, j in zip(*at):
            parent[int(j)] = int(i)
        root = lambda x: x if parent[x] == x else root(parent[x])
        return [root(i) for i in range(n)]

    assert len(b) > 4096
    looked_up = groups(len(b))
    want = list(range(len(b)))
    i, j = np.triu_indices(len(b), 1)
    ok = simhash._linked(b, flips, none, i, j)
    seen = np.arange(len(b))
    while True:
        low = np.minimum(seen[i[ok]], seen[j[ok]])
        new = seen.copy()
        np.minimum.at(new, i[ok], low)
        np.minimum.at(new, j[ok], low)
        if (new == seen).all():
            break
        seen = new
    want = seen.tolist()
    assert looked_up == want


def test_groups_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, 0), (2, "", 0), (5, "a b c d e", 1), (4, "A B C D E", 1), (4, "A B C D E", 1), (None, "a b c d e", 1), (9, "q", 7), (None, "lone", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (4, 4), (4, 4), (5, 4), (9, 9), (None, 4), (None, None)], key=str)
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
