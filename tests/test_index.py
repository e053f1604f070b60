"""The index, search, refinement, the model stage and the durable artifact."""

import json
import pathlib
import uuid

import numpy as np
import pytest
from pyspark.errors import PythonException

from lateview.operators import encode, index
from lateview.plans import contracts
from lateview.queries import GRID, PROFILE, SliceAdapter
from lateview.sources import artifact

A, B, C = [[1.0, 0.0], [0.2, 0.8]], [[0.9, 0.1], [0.0, 1.0]], [[-1.0, 0.0], [0.0, -1.0]]
QUERY = [[1.0, 0.0], [0.0, 1.0]]


@pytest.fixture(scope="module")
def small(spark):
    return index.CompactIndex.of(spark, [("a", A), ("b", B), ("c", C)])


def test_search_order_and_scores(small):
    found = small.results(QUERY, top_k=3)
    assert [(r.item_id, round(r.score, 4)) for r in found] == [("b", 1.9939), ("a", 1.9701), ("c", 0.0)]
    assert [r.item_id for r in small.results(QUERY, top_k=99)] == ["b", "a", "c"]
    for k in (0, -1):
        with pytest.raises(ValueError, match="positive"):
            small.search(QUERY, top_k=k)


def test_search_is_maxsim(small):
    for r in small.scores(QUERY).collect():
        assert abs(r.score - index.maxsim_score(QUERY, {"a": A, "b": B, "c": C}[r.item_id])) < 1e-12


def test_ties_go_to_the_smaller_id(spark):
    i = index.CompactIndex.of(spark, [("2", A), (10, A), ("é", A)])
    assert [r.item_id for r in i.results(QUERY)] == ["10", "2", "é"]
    assert [r.item_id for r in i.item_ids.collect()] == ["2", "10", "é"]
    assert i.contains("10") and not i.contains("11")


def test_batch_equals_single_searches(spark, small):
    asked = spark.createDataFrame([(1, QUERY), (2, [[0.0, -1.0]])], "query_id int, rows array<array<double>>")
    got = {}
    for r in small.search_batch(asked, top_k=2).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.item_id
    assert got == {1: {1: "b", 2: "a"}, 2: {1: "c", 2: "a"}}
    wrong = spark.createDataFrame([(1, [[1.0]])], "query_id int, rows array<array<double>>")
    with pytest.raises(ValueError, match="dimensions differ"):
        small.search_batch(wrong)


def test_batch_in_several_passes(spark, small, monkeypatch):
    monkeypatch.setattr(index, "BATCH_QUERIES", 3)
    asked = spark.createDataFrame([(i, QUERY) for i in range(10)], "query_id int, rows array<array<double>>")
    rows = small.search_batch(asked, top_k=1).collect()
    assert sorted((r.query_id, r.item_id) for r in rows) == [(i, "b") for i in range(10)]


@pytest.mark.parametrize(
    "items, match",
    [
        ([], "at least one"),
        ([("a", A), ("a", B)], "unique"),
        ([("a", A), ("b", [[1.0]])], "share one dimension"),
        ([("a", [[1.0, float("nan")]])], "finite"),
        ([("a", [[1.0, float("inf")]])], "finite"),
        ([("a", [])], "rank-2"),
    ],
)
def test_index_checks(spark, items, match):
    with pytest.raises(ValueError, match=match):
        index.CompactIndex.of(spark, items)


def test_query_dimension(small):
    with pytest.raises(ValueError, match="dimensions differ"):
        small.search([[1.0, 2.0, 3.0]])


def test_refine(spark, small):
    full = {"a": [[1, 0], [0.1, 0.2]], "b": QUERY, "c": C}
    called = []
    got = index.refine_candidates(small, QUERY, ["a", "b"], lambda k: called.append(k) or full[k])
    assert called == ["a", "b"] and [(r.item_id, round(r.score, 4)) for r in got] == [("b", 2.0), ("a", 1.8944)]
    table = spark.createDataFrame([(k, [[float(x) for x in r] for r in v]) for k, v in full.items()], "item_id string, vectors array<array<double>>")
    rows = index.refine(small, QUERY, ["a", "b"], table, top_k=1).collect()
    assert [r.item_id for r in rows] == ["b"]
    with pytest.raises(KeyError, match="missing"):
        index.refine(small, QUERY, ["a", "missing"], table)
    for candidates, k, match in (([], None, "at least one"), (["a", "a"], None, "unique"), (["a"], 0, "positive")):
        with pytest.raises(ValueError, match=match):
            index.refine(small, QUERY, candidates, table, top_k=k)


def test_compiler_builds_a_collection(spark):
    rng = np.random.default_rng(3)
    docs = rng.normal(size=(2, 18, 8))
    compiler = encode.Compiler(contracts.CompilerConfig(PROFILE, GRID))
    rows = [(i, f"page-{i + 1}", d.tolist()) for i, d in enumerate(docs)]
    built = compiler.build_documents(SliceAdapter(), spark.createDataFrame(rows, "item_ord long, item_id string, document array<array<double>>"))
    assert len(built) == 2 and built.vector_count == 20 and built.dimension == 4
    first = compiler.compile_document(SliceAdapter(), docs[0])
    assert built.results(first, top_k=1)[0].item_id == "page-1"
    assert isinstance(SliceAdapter(), encode.DocumentEncoderAdapter)


def test_compiler_errors():
    compiler = encode.Compiler(contracts.CompilerConfig(PROFILE, GRID))
    other = SliceAdapter()
    other.profile = contracts.BackboneProfile("other", 18, 6, 16, 8)
    with pytest.raises(ValueError, match="adapter profile"):
        compiler.compile_document(other, np.ones((18, 4)))
    shifted = SliceAdapter()
    shifted.run_prefix = lambda d, split_after_layer: encode.BoundaryState(d, (2, 8), 2)
    with pytest.raises(ValueError, match="boundary grid"):
        compiler.compile_document(shifted, np.ones((18, 4)))


@pytest.fixture
def saved(spark, tmp_path):
    path = str(tmp_path / "made" / "index")
    i = index.CompactIndex.of(spark, [("b", np.eye(3)), ("a", [[1, 1, 0]])])
    plan = contracts.plan_topology_anchored(PROFILE, grid_shape=GRID)
    return path, artifact.save_index(spark, path, i, plan), i, plan


def test_round_trip(spark, saved):
    path, manifest, i, plan = saved
    loaded, again = artifact.load_index(spark, path)
    assert again == manifest and (manifest.item_count, manifest.vector_count, manifest.dimension) == (2, 4, 3)
    assert [r.item_id for r in loaded.item_ids.collect()] == ["b", "a"]
    assert [(r.start, r.stop) for r in artifact.offsets(loaded.items).orderBy("item_ord").collect()] == [(0, 3), (3, 4)]
    with pytest.raises(FileExistsError):
        artifact.save_index(spark, path, i, plan)


def test_changed_payload(spark, saved):
    path = saved[0]
    part = next(pathlib.Path(path, "items").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="checksum"):
        artifact.load_index(spark, path)


@pytest.mark.parametrize(
    "change, match",
    [({"plan_fingerprint": "0" * 64}, "fingerprint"), ({"format_version": 2}, "format"), ({"vector_count": 5}, "shape"), ({"item_count": 3}, "shape")],
)
def test_changed_manifest(spark, saved, change, match):
    file = pathlib.Path(saved[0], "manifest.json")
    file.write_text(json.dumps(json.loads(file.read_text()) | change))
    pathlib.Path(saved[0], ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match=match):
        artifact.load_index(spark, saved[0])


def test_numpy_tier_equals_expressions(spark):
    rng = np.random.default_rng(11)
    i = index.CompactIndex.of(spark, [(k, rng.normal(size=(1 + k % 5, 7))) for k in range(40)] + [("99", np.zeros((1, 7)))])
    q = rng.normal(size=(4, 7))
    plain = {r.item_id: r.score for r in i.scores(q, bulk=False).collect()}
    bulk = {r.item_id: r.score for r in i.scores(q, bulk=True).collect()}
    assert plain.keys() == bulk.keys() and max(abs(plain[k] - bulk[k]) for k in plain) < 1e-12
    for k in (1, 5, 41, 99):
        assert [r.item_id for r in i.search(q, top_k=k, bulk=True).collect()] == [r.item_id for r in i.search(q, top_k=k, bulk=False).collect()]


def test_equal_scores_in_the_numpy_tier(spark):
    i = index.CompactIndex.of(spark, [(str(k), A) for k in range(30)]).stored()
    want = sorted(map(str, range(30)))[:7]
    assert [r.item_id for r in i.search(QUERY, top_k=7, bulk=True).collect()] == want
    asked = spark.createDataFrame([("q", QUERY)], "query_id string, rows array<array<double>>")
    assert [r.item_id for r in i.search_batch(asked, top_k=7).orderBy("rank").collect()] == want


def test_the_model_runs_once_a_document(spark, tmp_path):
    class Counting(SliceAdapter):
        """Leaves a file for every document that it encodes."""

        def __init__(self, folder):
            super().__init__()
            self.folder = folder

        def run_prefix(self, document, *, split_after_layer):
            pathlib.Path(self.folder, uuid.uuid4().hex).touch()
            return super().run_prefix(document, split_after_layer=split_after_layer)

        def run_suffix(self, boundary, compact):
            assert len(compact.assignment.compact_positions(auxiliary_tokens=2)) == len(compact.hidden_states) == 10
            assert compact.assignment.cluster_sizes.sum() == compact.assignment.full_visual_tokens == 16
            return super().run_suffix(boundary, compact)

    (tmp_path / "calls").mkdir()
    docs = np.random.default_rng(3).normal(size=(5, 18, 8))
    rows = spark.createDataFrame([(i, f"p{i}", d.tolist()) for i, d in enumerate(docs)], "item_ord long, item_id string, document array<array<double>>")
    compiler = encode.Compiler(contracts.CompilerConfig(PROFILE, GRID))
    built = compiler.build_documents(Counting(str(tmp_path / "calls")), rows)
    artifact.save_index(spark, str(tmp_path / "index"), built, compiler.plan)
    for r in built.results(docs[0][:, :4], top_k=2):
        index.refine(built, docs[0], [r], rows.select("item_id", rows.document.alias("vectors")))
    assert len(list((tmp_path / "calls").iterdir())) == 5


def test_pages_of_real_size(spark, tmp_path):
    rng = np.random.default_rng(5)
    i = index.CompactIndex.of(spark, [(k, rng.normal(size=(518, 128))) for k in range(3)])
    assert artifact.rows_a_file(i) == (128 << 20) // (518 * 128 * 8) == 253
    artifact.save_index(spark, str(tmp_path / "big"), i, contracts.plan_topology_anchored(PROFILE, grid_shape=GRID))
    loaded, manifest = artifact.load_index(spark, str(tmp_path / "big"))
    assert manifest.vector_count == 3 * 518 and len(loaded) == 3
    q = rng.normal(size=(8, 128))
    assert [r.item_id for r in loaded.results(q, top_k=1)] == [r.item_id for r in i.results(q, top_k=1)]


def test_candidates_may_be_results(spark, small):
    table = spark.createDataFrame([("a", [[1.0, 0.0], [0.1, 0.2]]), ("b", QUERY)], "item_id string, vectors array<array<double>>")
    best = small.results(QUERY, top_k=2)
    assert [r.item_id for r in index.refine(small, QUERY, best, table).collect()] == ["b", "a"]
    assert [r.item_id for r in index.refine_candidates(small, QUERY, best, {"a": A, "b": QUERY}.get)] == ["b", "a"]
    with pytest.raises(KeyError, match="no full vectors: c"):
        index.refine(small, QUERY, ["a", "c"], table)


@pytest.mark.parametrize("vectors, match", [([[1.0]], "dimensions differ"), ([[1.0, 2.0], [1.0]], "rank-2"), (None, "rank-2"), ([[float("nan"), 1.0]], "finite")])
def test_full_vectors_are_checked(spark, small, vectors, match):
    table = spark.createDataFrame([("a", vectors)], "item_id string, vectors array<array<double>>")
    with pytest.raises(PythonException, match=match):
        index.refine(small, QUERY, ["a"], table).collect()


def test_offsets_over_many_ranges(spark):
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 6, size=700)
    i = index.CompactIndex.of(spark, [(k, np.ones((n, 2))) for k, n in enumerate(sizes.tolist())])
    rows = artifact.offsets(i.items).orderBy("item_ord").collect()
    ends = np.cumsum(sizes).tolist()
    assert [r.stop for r in rows] == ends and [r.start for r in rows] == [0, *ends[:-1]]
