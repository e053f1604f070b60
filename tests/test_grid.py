"""Anchors, assignment and pooling, in both tiers, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateview.functions import vec
from lateview.operators import grid


def page_table(spark, *pages):
    rows = [(str(i), [list(map(float, r)) for r in p]) for i, p in enumerate(pages)]
    return spark.createDataFrame(rows, "item_id string, hidden array<array<double>>")


def brute(page, shape, auxiliary):
    """Compact rows by plain loops."""
    full = shape[0] * shape[1]
    at = grid.topology_anchors(shape)
    unit = [r / max(np.linalg.norm(r), 1e-12) for r in page[:full]]
    slots = []
    for u in unit:
        cos = [float(u @ unit[a]) for a in at]
        slots.append(max(range(len(at)), key=lambda s: (cos[s], -s)))
    out = []
    for s, a in enumerate(at):
        held = [page[i] for i in range(full) if slots[i] == s]
        out.append(np.mean(held, axis=0) if held else page[a])
    return slots, np.array(out + list(page[full:]))


@pytest.mark.parametrize(
    "shape, want",
    [((4, 4), [1, 5, 3, 7, 9, 13, 11, 15]), ((2, 6), [1, 7, 3, 9, 5, 11]), ((6, 2), [1, 3, 5, 7, 9, 11])],
)
def test_anchors(spark, shape, want):
    assert grid.topology_anchors(shape) == want
    assert [r.pos for r in grid.anchors(spark, shape).orderBy("slot").collect()] == want


@pytest.mark.parametrize("shape", [(3, 4), (4, 3), (0, 4), (-2, 2)])
def test_grids_are_positive_and_even(spark, shape):
    for call in (lambda: grid.topology_anchors(shape), lambda: grid.anchors(spark, shape)):
        with pytest.raises(ValueError, match="positive and even"):
            call()


def test_compact_positions():
    assert grid.compact_positions((4, 4), auxiliary_tokens=2)[-2:] == [16, 17]
    assert grid.compact_positions((4, 4)) == grid.topology_anchors((4, 4))
    with pytest.raises(ValueError, match="negative"):
        grid.compact_positions((4, 4), auxiliary_tokens=-1)


@pytest.mark.parametrize("bulk", [False, True])
def test_token_may_cross_cells(spark, bulk):
    page = np.eye(16)
    page[0] = page[15]
    rows = grid.assignment(grid.assign(page_table(spark, page), (4, 4), bulk=bulk)).where("pos = 0").collect()
    assert [(r.slot, round(r.cosine, 12)) for r in rows] == [(7, 1.0)]


@pytest.mark.parametrize("bulk", [False, True])
@pytest.mark.parametrize("shape, auxiliary", [((4, 4), 2), ((2, 6), 0), ((6, 2), 1)])
def test_tiers_agree_with_brute_force(spark, bulk, shape, auxiliary):
    full = shape[0] * shape[1]
    rng = np.random.default_rng(full + auxiliary)
    pages = [rng.normal(size=(full + auxiliary, 8)) for _ in range(3)]
    pages[1][grid.topology_anchors(shape)[1]] = pages[1][grid.topology_anchors(shape)[0]]  # equal anchors: slot 1 is empty
    pages[2][0] = 0  # a zero row goes to slot 0
    df = page_table(spark, *pages)
    assigned = grid.assign(df, shape, auxiliary_tokens=auxiliary, bulk=bulk)
    slots = {r.item_id: [a.slot for a in r.assigned] for r in assigned.collect()}
    out = {r.item_id: np.array(r.workers) for r in grid.coalesce_hidden_states(df, shape, auxiliary_tokens=auxiliary, bulk=bulk).collect()}
    sizes = grid.clusters(assigned, shape)
    for i, p in enumerate(pages):
        want_slots, want = brute(p, shape, auxiliary)
        assert slots[str(i)] == want_slots
        np.testing.assert_allclose(out[str(i)], want, atol=1e-9)
    assert sizes.where("item_id = '1' and slot = 1").first()["size"] == 0
    assert {r["n"] for r in sizes.groupBy("item_id").agg(F.sum("size").alias("n")).collect()} == {full}


@pytest.mark.parametrize("bulk", [False, True])
def test_assignment_is_reused_for_another_width(spark, bulk):
    rng = np.random.default_rng(4)
    page, other = rng.normal(size=(16, 6)), rng.normal(size=(16, 3))
    assigned = grid.assign(page_table(spark, page), (4, 4), bulk=bulk).drop("hidden")
    paired = page_table(spark, other).join(assigned, "item_id").select("item_id", "hidden", "assigned")
    out = np.array(grid.apply_assignment(paired, (4, 4), bulk=bulk).first().workers)
    slots, _ = brute(page, (4, 4), 0)
    for s in set(slots):
        np.testing.assert_allclose(out[s], other[[i for i in range(16) if slots[i] == s]].mean(axis=0), atol=1e-9)


def test_errors(spark):
    good = np.ones((16, 2))
    with pytest.raises(ValueError, match="auxiliary counts"):
        grid.coalesce_hidden_states(page_table(spark, good), (4, 4), auxiliary_tokens=1)
    with pytest.raises(ValueError, match="rank-2"):
        grid.coalesce_hidden_states(page_table(spark, [[1.0], [1.0, 2.0]]), (4, 4))
    with pytest.raises(ValueError, match="finite"):
        grid.coalesce_hidden_states(page_table(spark, np.full((16, 2), np.nan)), (4, 4))
    with pytest.raises(ValueError, match="negative"):
        grid.apply_assignment(grid.assign(page_table(spark, good), (4, 4)), (4, 4), auxiliary_tokens=-1)
    with pytest.raises(ValueError, match="grid shape does not match"):
        grid.assign(page_table(spark, np.ones((15, 2))), (4, 4))
    with pytest.raises(ValueError, match="do not match"):
        grid.apply_assignment(grid.assign(page_table(spark, good), (4, 4)), (4, 4), auxiliary_tokens=1)


def test_unit_floor(spark):
    df = page_table(spark, [[0.0, 0.0], [1e-13, 0.0], [3.0, 4.0]])
    once, twice = df.select(vec.unit_rows(F.col("hidden"), 1).alias("a"), vec.unit_rows(F.col("hidden"), 2).alias("b")).first()
    assert once[0] == [0, 0] and abs(once[1][0] - 0.1) < 1e-12 and once[2] == [0.6, 0.8]
    assert abs(twice[1][0] - 1.0) < 1e-12


def test_faults_of_single_pages(spark):
    df = page_table(spark, np.ones((16, 2)), np.ones((15, 2)), np.full((16, 2), np.inf), [[1.0], [1.0, 2.0]]).union(spark.sql("select 'n', null"))
    got = {r.item_id: r.reason for r in grid.page_faults(df, 16).collect()}
    assert got["0"] is None and "do not match" in got["1"] and "finite" in got["2"] and "rank-2" in got["3"] and "rank-2" in got["n"]


@pytest.mark.parametrize("bulk", [False, True])
def test_capacity_and_kept_assignment(spark, bulk):
    page = np.random.default_rng(1).normal(size=(18, 4))
    out = grid.coalesce_hidden_states(page_table(spark, page), (4, 4), auxiliary_tokens=2, bulk=bulk)
    row = grid.capacity(out, (4, 4)).first()
    assert (row.full_visual_tokens, row.compact_visual_tokens, row.persistent_fraction) == (16, 8, 0.5)
    assert [a.slot for a in out.first().assigned] == brute(page, (4, 4), 2)[0]
