"""One query for each operator over the driver's tables, and its SQL.

``embeddings`` stand in for token vectors: 18 in a row make a page, a 4x4 grid and two auxiliary
rows; a last page that is not whole is no page. The toy model's suffix keeps four columns.
"""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.functions import vec
from lateview.operators import encode, grid, index
from lateview.plans import contracts, lifecycle, portfolio
from lateview.sources import artifact
from lateview.sources.shared import fresh_folder

GRID, AUXILIARY, PAGE = (4, 4), 2, 18
PROFILE = contracts.BackboneProfile("toy", 18, 6, 16, 8)


class SliceAdapter:
    """A toy model: the prefix hands on the page, the suffix keeps the first columns."""

    profile = PROFILE

    def __init__(self, columns: int = 4) -> None:
        self.columns = columns

    def run_prefix(self, document, *, split_after_layer: int) -> encode.BoundaryState:
        return encode.BoundaryState(document, GRID, AUXILIARY)

    def run_suffix(self, boundary: encode.BoundaryState, compact: encode.CoalescedState) -> np.ndarray:
        return compact.hidden_states[:, : self.columns]


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """``item_ord, item_id, hidden``."""
    rows = embeddings(spark, sf).withColumn("item_ord", F.expr(f"vec_id div {PAGE}"))
    held = rows.groupBy("item_ord").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("r"))
    held = held.where(F.size("r") == PAGE)
    return held.select("item_ord", F.col("item_ord").cast("string").alias("item_id"), F.transform("r", lambda x: x["v"]).alias("hidden"))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """Items of another kind: all vectors of a label, ``item_ord, item_id, vectors``."""
    rows = embeddings(spark, sf).select(
        F.col("label").cast("long").alias("item_ord"), F.col("label").cast("string").alias("item_id"), F.col("vec_id").alias("vec_pos"), "v"
    )
    return index.items_from_long(rows)


def query_rows(spark: SparkSession, sf: str) -> list:
    """The toy query: the first six vectors, as a caller would bring them."""
    rows = embeddings(spark, sf).where("vec_id < 6").orderBy("vec_id").select("v").collect()
    return [r["v"] for r in rows]


def six(c) -> F.Column:
    return F.round(c, 6) + F.lit(0.0)


def compiled(spark: SparkSession, sf: str) -> index.CompactIndex:
    compiler = encode.Compiler(contracts.CompilerConfig(PROFILE, GRID))
    docs = pages(spark, sf).select("item_ord", "item_id", F.col("hidden").alias("document"))
    return compiler.build_documents(SliceAdapter(), docs)


def short_query(spark: SparkSession, sf: str) -> list:
    return [r[:4] for r in query_rows(spark, sf)]


def long_values(df: DataFrame, column: str, pos: str) -> DataFrame:
    rows = df.select("item_id", F.posexplode(column).alias(pos, "h"))
    return rows.select("item_id", pos, F.posexplode("h").alias("dim", "x")).select("item_id", pos, "dim", six(F.col("x")).alias("value"))


def normalize_rows(spark, sf):
    rows = embeddings(spark, sf).select("vec_id", F.posexplode(vec.unit(F.col("v"))).alias("dim", "x"))
    return rows.select("vec_id", "dim", six(F.col("x")).alias("value"))


def finite_check(spark, sf):
    rows = embeddings(spark, sf)
    return rows.select("vec_id", vec.is_finite(F.col("v")).alias("finite"), F.size("v").alias("width"), six(vec.norm(F.col("v"))).alias("norm"))


def index_stats(spark, sf):
    i = index.CompactIndex(topics(spark, sf))
    return spark.createDataFrame([(len(i), i.vector_count, i.dimension)], "items long, vectors long, dimension int")


def topology_anchors(spark, sf):
    out = None
    for shape in ((4, 4), (2, 6), (6, 2), (32, 32)):
        some = grid.anchors(spark, shape).select(F.lit(f"{shape[0]}x{shape[1]}").alias("grid"), "slot", "pos")
        out = some if out is None else out.unionByName(some)
    return out


def compact_positions(spark, sf):
    at = grid.compact_positions(GRID, auxiliary_tokens=AUXILIARY)
    return spark.createDataFrame(list(enumerate(at)), "wpos int, pos int")


def assign_anchors(spark, sf):
    long = grid.assignment(grid.assign(pages(spark, sf), GRID, auxiliary_tokens=AUXILIARY))
    return long.select("item_id", "pos", "slot", six(F.col("cosine")).alias("cosine"))


def cluster_sizes(spark, sf):
    return grid.clusters(grid.assign(pages(spark, sf), GRID, auxiliary_tokens=AUXILIARY), GRID)


def pool_clusters(spark, sf):
    """Visual rows only: an assignment applied to its own page without auxiliary rows."""
    visual = pages(spark, sf).select("item_id", F.slice("hidden", 1, 16).alias("hidden"))
    return long_values(grid.apply_assignment(grid.assign(visual, GRID), GRID, check=False), "workers", "wpos")


def coalesce_pages(spark, sf):
    out = grid.coalesce_hidden_states(pages(spark, sf), GRID, auxiliary_tokens=AUXILIARY)
    return long_values(out, "workers", "wpos")


def teacher_pool(spark, sf):
    """An assignment reused for another matrix of the same pages."""
    assigned = grid.assign(pages(spark, sf), GRID, auxiliary_tokens=AUXILIARY)
    other = assigned.withColumn("hidden", F.transform("hidden", lambda v: F.transform(v, lambda x: x + 0.1)))
    return long_values(grid.apply_assignment(other, GRID, auxiliary_tokens=AUXILIARY, check=False), "workers", "wpos")


def compile_documents(spark, sf):
    compiler = encode.Compiler(contracts.CompilerConfig(PROFILE, GRID))
    docs = pages(spark, sf).select("item_ord", "item_id", F.col("hidden").alias("document"))
    return long_values(compiler.compile_documents(SliceAdapter(), docs), "vectors", "wpos")


def maxsim_scores(spark, sf):
    found = index.CompactIndex(topics(spark, sf)).scores(query_rows(spark, sf))
    return found.select("item_id", six(F.col("score")).alias("score"))


def search_topk(spark, sf):
    found = index.CompactIndex(topics(spark, sf)).search(query_rows(spark, sf), top_k=5)
    return found.select("item_id", six(F.col("score")).alias("score"))


def search_compiled(spark, sf):
    found = compiled(spark, sf).search(short_query(spark, sf), top_k=10)
    return found.select("item_id", six(F.col("score")).alias("score"))


def search_batch(spark, sf):
    """Every label's first vectors as queries of two rows, against all compiled pages."""
    rows = embeddings(spark, sf)
    first = rows.groupBy("label").agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), 1, 2).alias("r"))
    asked = first.select(F.col("label").alias("query_id"), F.transform("r", lambda x: F.slice(x["v"], 1, 4)).alias("rows"))
    found = compiled(spark, sf).search_batch(asked, top_k=3)
    return found.select("query_id", "rank", "item_id", six(F.col("score")).alias("score"))


def contains_semi(spark, sf):
    """Which vectors' page numbers, read as item ids, the compiled index holds."""
    ids = embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("item_id"))
    return index.known_candidates(compiled(spark, sf), ids)


def unknown_anti(spark, sf):
    ids = embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("item_id"))
    return index.unknown_candidates(compiled(spark, sf), ids)


def records_order(spark, sf):
    rows = compiled(spark, sf).records()
    return rows.select("item_ord", "item_id", "vec_pos", F.posexplode("v").alias("dim", "x")).select(
        "item_ord", "item_id", "vec_pos", "dim", six(F.col("x")).alias("value")
    )


def refine_candidates(spark, sf):
    i = compiled(spark, sf)
    best = i.results(short_query(spark, sf), top_k=10)
    full = pages(spark, sf).select("item_id", F.col("hidden").alias("vectors"))
    found = index.refine(i, query_rows(spark, sf), best, full, top_k=5)
    return found.select("item_id", six(F.col("score")).alias("score"))


def artifact_roundtrip(spark, sf):
    path = fresh_folder(spark, "artifact")
    artifact.save_index(spark, path, compiled(spark, sf), contracts.plan_topology_anchored(PROFILE, grid_shape=GRID))
    loaded, _ = artifact.load_index(spark, path)
    return loaded.records().select("item_id", "vec_pos", F.posexplode("v").alias("dim", "x")).select(
        "item_id", "vec_pos", "dim", six(F.col("x")).alias("value")
    )


def artifact_offsets(spark, sf):
    return artifact.offsets(index.CompactIndex(topics(spark, sf)).items)


def artifact_digest(spark, sf):
    path = fresh_folder(spark, "artifact")
    plan = contracts.plan_topology_anchored(PROFILE, grid_shape=GRID)
    m = artifact.save_index(spark, path, compiled(spark, sf), plan)
    again = artifact.payload_digest(spark, f"{path}/items")
    row = (m.item_count, m.vector_count, m.dimension, m.payload_sha256 == again, m.plan.fingerprint)
    return spark.createDataFrame([row], "items long, vectors long, dimension int, same_digest boolean, plan_fingerprint string")


PROFILES = """
  ('good', 18, 6, 16, 8, true, true, true), ('', 1, 6, 16, 16, false, false, false),
  ('late', 18, 18, 16, 8, true, true, true), ('wide', 18, 6, 8, 16, true, true, false)
""".strip()
PROFILE_COLUMNS = (
    "name, total_layers, split_after_layer, full_visual_tokens, compact_visual_tokens, "
    "exposes_hidden_boundary, exposes_visual_topology, query_independent_documents"
)


def plan_admission(spark, sf):
    rows = spark.sql(f"SELECT * FROM VALUES {PROFILES} AS t({PROFILE_COLUMNS})")
    return contracts.admit(rows).select("name", "admitted", "message", "persistent_fraction")


def plan_fingerprint(spark, sf):
    plan = contracts.plan_topology_anchored(PROFILE, grid_shape=GRID)
    return spark.createDataFrame([(plan.canonical, plan.fingerprint)], "canonical string, fingerprint string")


OPTIONS = [
    portfolio.MaterializationOption("post_vision", frozenset({"processor", "vision"}), 80, 4.0, 1.0),
    portfolio.MaterializationOption("terminal", frozenset({"processor", "vision", "adapter", "projection"}), 20, 0.0, 0.5),
    portfolio.MaterializationOption("slow", frozenset({"processor"}), 10, 12.0),
    portfolio.MaterializationOption("poor", frozenset({"vision"}), 5, 1.0, 0.0, 0.5),
]
UPDATES = [
    portfolio.UpdateScenario("adapter", frozenset({"adapter"}), 1.0),
    portfolio.UpdateScenario("index_policy", frozenset({"index_policy"}), 4.0),
    portfolio.UpdateScenario("vision", frozenset({"vision"}), 2.0),
]


def _portfolios(spark) -> DataFrame:
    return portfolio.portfolios(spark, OPTIONS, UPDATES, raw_rebuild_seconds=10.0, storage_budget_bytes=100)


def _portfolio_row(df: DataFrame) -> DataFrame:
    return df.select("mask", F.array_join("selected", ",").alias("selected"), "storage_bytes", "materialization_seconds", six(F.col("expected_seconds")).alias("expected_seconds"), "raw_baseline_seconds")


def portfolio_options(spark, sf):
    return _portfolio_row(_portfolios(spark))


def portfolio_best(spark, sf):
    return _portfolio_row(portfolio.best_portfolio(_portfolios(spark)))


def portfolio_routes(spark, sf):
    rows = _portfolios(spark).select("mask", F.posexplode("routes").alias("uidx", "r"))
    return rows.select("mask", "uidx", "r.update", "r.source", "r.seconds_per_update", "r.expected_count")


def workloads(spark, sf) -> DataFrame:
    """One workload a user of ``events``, with measurements made of the user's values."""
    rows = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id")
    n = F.count("*").cast("double")
    rows = rows.agg(n.alias("n"), F.max("event_id").alias("last"))
    part = lambda m: (F.col("last") % m).cast("double")
    return rows.select(
        "user_id",
        (F.col("n") + part(97)).alias("full_build_seconds"),
        F.col("n").alias("compact_build_seconds"),
        (part(7) / 4).alias("refinement_seconds_per_cold_query"),
        part(50).alias("cold_queries_per_build"),
        F.lit(0.92).alias("full_quality"),
        (F.lit(0.90) + part(5) / 200).alias("compact_quality"),
        (F.lit(0.91) + part(3) / 100).alias("refined_quality"),
        (F.lit(0.5) + part(4) / 10).alias("compact_storage_fraction"),
    )


def lifecycle_choice(spark, sf):
    out = lifecycle.decide(workloads(spark, sf))
    return out.select("user_id", "lifecycle", six(F.col("epoch_seconds")).alias("epoch_seconds"), six(F.col("quality_fraction")).alias("quality_fraction"), "storage_fraction")


def break_even(spark, sf):
    return workloads(spark, sf).select("user_id", six(lifecycle.break_even()).alias("queries"))


def profile_dicts(spark, sf):
    """Profiles to dictionaries, JSON, and back."""
    rows = [contracts.BackboneProfile(*r) for r in spark.sql(f"SELECT * FROM VALUES {PROFILES} AS t({PROFILE_COLUMNS})").collect()]
    back = [contracts.BackboneProfile.from_dict(json.loads(json.dumps(p.to_dict()))) for p in rows]
    kinds = {"str": "string", "int": "int", "bool": "boolean"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in dataclasses.fields(PROFILE))
    return spark.createDataFrame([(*dataclasses.astuple(b), b == p) for p, b in zip(rows, back)], f"{schema}, same boolean")


SHAPES = ((4, 4), (2, 8), (8, 2), (5, 3))


def plan_dicts(spark, sf):
    """Plans to dictionaries, JSON, and back; what comes back is not validated, as the last shape shows."""
    rows = []
    for shape in SHAPES:
        plan = contracts.CompilePlan(PROFILE, shape)
        back = contracts.CompilePlan.from_dict(json.loads(json.dumps(plan.to_dict())))
        rows.append((f"{shape[0]}x{shape[1]}", back.canonical, back == plan))
    return spark.createDataFrame(rows, "grid string, canonical string, same boolean")


PLANS = """
  (1, 'toy', 18, 16, 8, 4, 4, 'right_column_pair_per_2x2', 'global_hidden_cosine', 'cluster_mean', 1),
  (2, '', 1, 16, 8, 4, 4, 'right_column_pair_per_2x2', 'global_hidden_cosine', 'cluster_mean', 1),
  (3, 'toy', 18, 15, 8, 5, 3, 'right_column_pair_per_2x2', 'global_hidden_cosine', 'cluster_mean', 1),
  (4, 'toy', 18, 16, 8, 4, 6, 'right_column_pair_per_2x2', 'global_hidden_cosine', 'cluster_mean', 1),
  (5, 'toy', 18, 16, 12, 4, 4, 'right_column_pair_per_2x2', 'global_hidden_cosine', 'cluster_mean', 1),
  (6, 'toy', 18, 16, 8, 4, 4, 'other', 'other', 'cluster_mean', 1),
  (7, 'toy', 18, 16, 8, 4, 4, 'right_column_pair_per_2x2', 'other', 'cluster_mean', 1),
  (8, 'toy', 18, 16, 8, 4, 4, 'right_column_pair_per_2x2', 'global_hidden_cosine', 'other', 1),
  (9, 'toy', 18, 16, 8, 4, 4, 'right_column_pair_per_2x2', 'global_hidden_cosine', 'cluster_mean', 2),
  (10, NULL, 18, 16, 8, NULL, 4, 'right_column_pair_per_2x2', 'global_hidden_cosine', 'cluster_mean', 1),
  (11, 'toy', 18, 16, 8, NULL, 4, 'right_column_pair_per_2x2', 'global_hidden_cosine', 'cluster_mean', 1)
""".strip()
PLAN_COLUMNS = "plan_id, name, layers, full_tokens, compact_tokens, grid_rows, grid_columns, layout, assignment, pooling, version"


def plan_checks(spark, sf):
    """A table of plans against the rules of a single one."""
    rows = spark.sql(f"SELECT * FROM VALUES {PLANS} AS t({PLAN_COLUMNS})")
    profile = F.struct(
        "name", F.col("layers").alias("total_layers"), F.lit(6).alias("split_after_layer"), F.col("full_tokens").alias("full_visual_tokens"),
        F.col("compact_tokens").alias("compact_visual_tokens"), *(F.lit(True).alias(c) for c in PROFILE_COLUMNS.split(", ")[5:]),
    )
    plans = rows.select(
        "plan_id", profile.alias("profile"), F.array("grid_rows", "grid_columns").alias("grid_shape"), F.col("layout").alias("anchor_layout"),
        "assignment", "pooling", F.col("version").alias("format_version"),
    )
    return contracts.validate_plans(plans).select("plan_id", "reason")


def assignment_capacity(spark, sf):
    return grid.capacity(grid.assign(pages(spark, sf), GRID, auxiliary_tokens=AUXILIARY), GRID)


def hidden_checks(spark, sf):
    """Pages of which four in five were spoilt, each in its way, against the rules for matrices."""
    m, kind = F.col("hidden"), F.col("item_ord") % 5
    nan = F.transform(m, lambda v, i: F.when(i == 3, F.transform(v, lambda x: F.lit(float("nan")))).otherwise(v))
    ragged = F.transform(m, lambda v, i: F.when(i == 2, F.slice(v, 1, 5)).otherwise(v))
    spoilt = F.when(kind == 1, nan).when(kind == 2, ragged).when(kind == 3, F.slice(m, 1, 17)).when(kind == 0, m)
    return grid.page_faults(pages(spark, sf).withColumn("hidden", spoilt), PAGE)


def compiled_hidden(spark, sf):
    """Hidden states compiled without a model."""
    compiler = encode.Compiler(contracts.CompilerConfig(PROFILE, GRID))
    return long_values(compiler.compile_hidden_states(pages(spark, sf), auxiliary_tokens=AUXILIARY), "workers", "wpos")


def edge_tokens(spark, sf) -> DataFrame:
    """Pages whose first row is zero and whose second anchor equals the first, which leaves a cluster empty."""
    m = F.col("hidden")
    changed = F.transform(m, lambda v, i: F.when(i == 0, F.transform(v, lambda x: F.lit(0.0))).when(i == 5, F.get(m, F.lit(1))).otherwise(v))
    return pages(spark, sf).withColumn("hidden", changed)


def edge_clusters(spark, sf):
    return grid.clusters(grid.assign(edge_tokens(spark, sf), GRID, auxiliary_tokens=AUXILIARY), GRID)


def edge_pages(spark, sf):
    return long_values(grid.coalesce_hidden_states(edge_tokens(spark, sf), GRID, auxiliary_tokens=AUXILIARY), "workers", "wpos")


def built_items(spark, sf):
    """Endpoints indexed as they are, each under two names: equal scores go by name, and "10" comes before "2"."""
    compiler = encode.Compiler(contracts.CompilerConfig(PROFILE, GRID))
    one = topics(spark, sf)
    both = one.unionByName(one.select((F.col("item_ord") + 100).alias("item_ord"), F.concat("item_id", F.lit("0")).alias("item_id"), "vectors"))
    found = compiler.build(spark, both.where("item_id != '00'")).search(query_rows(spark, sf), top_k=12)
    return found.select("item_id", six(F.col("score")).alias("score"))


def contains_ids(spark, sf):
    """The index asked for single ids."""
    held = compiled(spark, sf)
    return spark.createDataFrame([(k, held.contains(k)) for k in ("0", "7", "007", "-1", "x")], "item_id string, held boolean")


def manifest_rejects(spark, sf):
    """What a manifest says that was changed in one place."""
    plan = contracts.plan_topology_anchored(PROFILE, grid_shape=GRID)
    good = artifact.IndexManifest(plan, 2, 20, 4, "0" * 64).to_dict()
    changed = {
        "as written": good,
        "fingerprint": good | {"plan_fingerprint": "0" * 64},
        "grid": good | {"plan": good["plan"] | {"grid_shape": [2, 8]}},
        "counts as text": good | {"item_count": "2"},
    }
    rows = []
    for case, value in changed.items():
        try:
            rows.append((case, artifact.IndexManifest.from_dict(json.loads(json.dumps(value))).item_count, None))
        except ValueError as e:
            rows.append((case, -1, str(e)))
    return spark.createDataFrame(rows, "case string, items int, error string")


OPTION_ROWS = """
  (1, 'a', 2, 1, 1.0, 0.0, 1.0), (2, '', 2, 1, 1.0, 0.0, 1.0), (3, 'a', 0, 1, 1.0, 0.0, 1.0), (4, 'a', 1, -1, 1.0, 0.0, 1.0), (5, 'a', 1, 1, -1.0, 0.0, 1.0),
  (6, 'a', 1, 1, 1.0, -0.5, 1.0), (7, 'a', 1, 1, 1.0, 0.0, -0.1), (8, 'a', 1, 1, 1.0, 0.0, 1.5), (9, NULL, 0, 1, 1.0, 0.0, 1.0), (10, 'a', 1, 1, NULL, 0.0, 1.0)
""".strip()
UPDATE_ROWS = "(1, 'u', 1, 1.0), (2, '', 0, 1.0), (3, 'u', 0, 1.0), (4, 'u', 1, -1.0), (5, 'u', 3, NULL), (6, 'u', 2, 0.0)"


def _names(n: str) -> F.Column:
    return F.transform(F.filter(F.array(*map(F.lit, range(1, 4))), lambda i: i <= F.col(n)), lambda i: i.cast("string"))


def option_checks(spark, sf):
    rows = spark.sql(f"SELECT * FROM VALUES {OPTION_ROWS} AS t(id, name, n, storage_bytes, replay_seconds, materialization_seconds, quality_fraction)")
    doubles = {c: F.col(c).cast("double") for c in ("replay_seconds", "materialization_seconds", "quality_fraction")}
    return portfolio.validate_options(rows.withColumns(doubles).withColumn("depends_on", _names("n"))).select("id", "reason")


def update_checks(spark, sf):
    rows = spark.sql(f"SELECT * FROM VALUES {UPDATE_ROWS} AS t(id, name, n, expected_count)").withColumn("expected_count", F.col("expected_count").cast("double"))
    return portfolio.validate_updates(rows.withColumn("changed_components", _names("n"))).select("id", "reason")


def portfolio_savings(spark, sf):
    """What each portfolio saves against rebuilding from raw."""
    return _portfolios(spark).select("mask", six(F.col("saving_fraction")).alias("saving_fraction"))


def portfolio_decision(spark, sf):
    """The decision as a record."""
    d = portfolio.choose_materializations(spark, OPTIONS, UPDATES, raw_rebuild_seconds=10.0, storage_budget_bytes=100)
    row = (",".join(d.selected), ",".join(r.source for r in d.routes), d.storage_bytes, d.expected_seconds, round(d.saving_fraction, 6), sum(r.expected_seconds for r in d.routes))
    return spark.createDataFrame([row], "selected string, sources string, storage_bytes long, expected_seconds double, saving_fraction double, upkeep_seconds double")


def workload_checks(spark, sf):
    """Workloads of which most were spoilt, each in its way, against the rules for one."""
    kind = F.col("user_id") % 6
    spoilt = {
        "full_build_seconds": F.when(kind == 1, F.lit(-1.0)).otherwise(F.col("full_build_seconds")),
        "compact_quality": F.when(kind == 2, F.lit(float("nan"))).otherwise(F.col("compact_quality")),
        "full_quality": F.when(kind == 3, F.lit(0.0)).otherwise(F.col("full_quality")),
        "compact_storage_fraction": F.when(kind == 4, F.lit(1.5)).otherwise(F.col("compact_storage_fraction")),
        "cold_queries_per_build": F.when(kind != 5, F.col("cold_queries_per_build")),
    }
    rows = lifecycle.validate_workloads(lifecycle.decide(workloads(spark, sf).withColumns(spoilt)))
    return rows.select("user_id", "reason", F.col("lifecycle").isNotNull().alias("decided"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_rows, finite_check, index_stats, topology_anchors, compact_positions, assign_anchors, cluster_sizes, pool_clusters,
        coalesce_pages, teacher_pool, compile_documents, maxsim_scores, search_topk, search_compiled, search_batch, contains_semi,
        unknown_anti, records_order, refine_candidates, artifact_roundtrip, artifact_offsets, artifact_digest, plan_admission,
        plan_fingerprint, portfolio_options, portfolio_best, portfolio_routes, lifecycle_choice, break_even, profile_dicts, plan_dicts,
        plan_checks, assignment_capacity, hidden_checks, compiled_hidden, edge_clusters, edge_pages, built_items, contains_ids,
        manifest_rejects, option_checks, update_checks, portfolio_savings, portfolio_decision, workload_checks,
    )
}


def _sql() -> dict[str, str]:
    unit = "list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12))"
    emb = "emb AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
    page = (
        f"{emb}, tokens AS (SELECT vec_id // {PAGE} AS item_ord, (vec_id // {PAGE})::VARCHAR AS item_id, (vec_id % {PAGE})::INT AS pos, v, {unit} AS u "
        f"FROM emb WHERE vec_id < {PAGE} * ((SELECT count(*) FROM emb) // {PAGE}))"
    )
    slots = "anchors AS (SELECT s::INT AS slot, ((2 * ((s // 2) // 2) + s % 2) * 4 + 2 * ((s // 2) % 2) + 1)::INT AS pos FROM range(8) t(s))"
    assigned = (
        f"{page}, {slots}, pairs AS (SELECT t.item_id, t.pos, a.slot, list_dot_product(t.u, k.u) AS cosine FROM tokens t "
        "JOIN tokens k ON k.item_id = t.item_id JOIN anchors a ON a.pos = k.pos WHERE t.pos < 16), "
        "assigned AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY item_id, pos ORDER BY cosine DESC, slot) = 1)"
    )
    pooled = (
        "flat AS (SELECT item_id, pos, unnest(range(64)) AS dim, unnest(v) AS x FROM tokens), "
        "means AS (SELECT f.item_id, a.slot, f.dim, avg(f.x) AS x FROM flat f JOIN assigned a ON a.item_id = f.item_id AND a.pos = f.pos GROUP BY ALL), "
        "workers AS (SELECT f.item_id, a.slot AS wpos, f.dim, coalesce(m.x, f.x) AS x FROM flat f JOIN anchors a ON a.pos = f.pos "
        "LEFT JOIN means m ON m.item_id = f.item_id AND m.slot = a.slot AND m.dim = f.dim "
        "UNION ALL SELECT item_id, (pos - 8)::INT, dim, x FROM flat WHERE pos >= 16)"
    )
    built = f"{assigned}, {pooled}"
    ends = (
        f"{built}, ends AS (SELECT item_id, wpos, list(x ORDER BY dim) AS v FROM workers WHERE dim < 4 GROUP BY ALL), "
        f"unit AS (SELECT item_id, wpos, {unit} AS u FROM ends)"
    )
    ask = f"ask AS (SELECT vec_id AS q, {unit} AS u FROM emb WHERE vec_id < 6)"
    short = f"short AS (SELECT q, {unit} AS u FROM (SELECT vec_id AS q, v[1:4] AS v FROM emb WHERE vec_id < 6))"
    topic = f"topic AS (SELECT label::VARCHAR AS item_id, {unit} AS u FROM emb)"
    score = lambda doc, query: (
        f"best AS (SELECT d.item_id, k.q, max(list_dot_product(d.u, k.u)) AS m FROM {doc} d, {query} k GROUP BY ALL), "
        "scores AS (SELECT item_id, round(sum(m), 6) AS score, sum(m) AS exact FROM best GROUP BY ALL)"
    )
    values = "SELECT item_id, wpos::INT AS wpos, dim::INT AS dim, round(x, 6) + 0.0 AS value FROM workers"
    records = (
        "SELECT (item_id)::BIGINT AS item_ord, item_id, wpos::INT AS vec_pos, unnest(range(4))::INT AS dim, round(unnest(u), 6) + 0.0 AS value FROM unit"
    )
    opts = "opts(i, name, deps, bytes, replay, build, quality) AS (VALUES " + ", ".join(
        f"({i}, '{o.name}', {sorted(o.depends_on)}, {o.storage_bytes}, {o.replay_seconds}::DOUBLE, {o.materialization_seconds}::DOUBLE, {o.quality_fraction}::DOUBLE)"
        for i, o in enumerate(OPTIONS)
    ) + ")"
    upds = "upds(i, name, changed, n) AS (VALUES " + ", ".join(
        f"({i}, '{u.name}', {sorted(u.changed_components)}, {u.expected_count}::DOUBLE)" for i, u in enumerate(UPDATES)
    ) + ")"
    folio = (
        f"WITH {opts}, {upds}, masks AS (SELECT m FROM range({1 << len(OPTIONS)}) t(m)), "
        "picked AS (SELECT m, o.* FROM masks JOIN opts o ON (m >> o.i) & 1 = 1), "
        "sums AS (SELECT masks.m, coalesce(string_agg(name, ',' ORDER BY p.i), '') AS selected, count(name) AS k, list(name ORDER BY p.i) FILTER (name IS NOT NULL) AS names, "
        "coalesce(sum(bytes), 0)::BIGINT AS bytes, coalesce(sum(build), 0.0)::DOUBLE AS build FROM masks LEFT JOIN picked p ON p.m = masks.m GROUP BY ALL HAVING coalesce(sum(bytes), 0) <= 100), "
        "routes AS (SELECT s.m, u.i, u.name, u.n, min((p.replay, p.name)) AS r FROM sums s CROSS JOIN upds u LEFT JOIN picked p ON p.m = s.m AND p.quality >= 0.99 AND NOT list_has_any(p.deps, u.changed) GROUP BY ALL), "
        "way AS (SELECT m, i, name, coalesce(r[2], 'raw') AS source, coalesce(r[1], 10.0)::DOUBLE AS seconds, n FROM routes), "
        "cost AS (SELECT s.m AS mask, selected, bytes AS storage_bytes, build AS materialization_seconds, round(build + (SELECT sum(seconds * n) FROM way w WHERE w.m = s.m), 6) AS expected_seconds, 70.0::DOUBLE AS raw_baseline_seconds, k, names FROM sums s) "
    )
    folio_columns = "mask, selected, storage_bytes, materialization_seconds, expected_seconds, raw_baseline_seconds"
    load = (
        "WITH u AS (SELECT user_id, count(*)::DOUBLE AS n, max(event_id) AS last FROM events GROUP BY 1), "
        "w AS (SELECT user_id, n + (last % 97) AS full_s, n AS compact_s, (last % 7)::DOUBLE / 4 AS each, (last % 50)::DOUBLE AS cold, 0.92::DOUBLE AS fq, "
        "0.90::DOUBLE + (last % 5)::DOUBLE / 200 AS cq, 0.91::DOUBLE + (last % 3)::DOUBLE / 100 AS rq, 0.5::DOUBLE + (last % 4)::DOUBLE / 10 AS st FROM u) "
    )
    admission = {
        "the backbone name is empty": "coalesce(name, '') = ''",
        "the backbone has no separable prefix and suffix": "coalesce(total_layers, 0) < 2",
        "the split must leave both prefix and suffix layers": "NOT coalesce(split_after_layer > 0 AND split_after_layer < total_layers, false)",
        "compact visual capacity must be smaller than Full": "NOT coalesce(compact_visual_tokens > 0 AND compact_visual_tokens < full_visual_tokens, false)",
        "no stable hidden-state boundary is exposed": "NOT coalesce(exposes_hidden_boundary, false)",
        "visual token topology is unavailable": "NOT coalesce(exposes_visual_topology, false)",
        "document encoding depends on a live query": "NOT coalesce(query_independent_documents, false)",
    }
    reasons = " || ".join(f"CASE WHEN {sql} THEN '; {reason}' ELSE '' END" for reason, sql in admission.items())
    canonical_of = (
        "'{\"anchor_layout\":\"right_column_pair_per_2x2\",\"assignment\":\"global_hidden_cosine\",\"format_version\":1,\"grid_shape\":[' || r || ',' || c || "
        "'],\"pooling\":\"cluster_mean\",\"profile\":{\"compact_visual_tokens\":8,\"exposes_hidden_boundary\":true,\"exposes_visual_topology\":true,"
        "\"full_visual_tokens\":16,\"name\":\"toy\",\"query_independent_documents\":true,\"split_after_layer\":6,\"total_layers\":18}}'"
    )
    edge = built.replace("v, " + unit + " AS u FROM emb", "v, " + unit + " AS u FROM changed").replace(
        emb,
        f"{emb}, changed AS (SELECT e.vec_id, CASE e.vec_id % {PAGE} WHEN 0 THEN list_transform(e.v, lambda x: 0.0::DOUBLE) WHEN 5 THEN k.v ELSE e.v END AS v "
        f"FROM emb e LEFT JOIN emb k ON k.vec_id = e.vec_id - e.vec_id % {PAGE} + 1)",
    )
    twice = f"twice AS (SELECT item_id, u FROM topic UNION ALL SELECT item_id || '0', u FROM topic WHERE item_id != '0')"
    canonical = contracts.CompilePlan(PROFILE, GRID).canonical
    anchors_of = lambda r, c: (
        f"SELECT '{r}x{c}' AS grid, s::INT AS slot, ((2 * ((s // 2) // {c // 2}) + s % 2) * {c} + 2 * ((s // 2) % {c // 2}) + 1)::INT AS pos FROM range({r * c // 2}) t(s)"
    )
    batch = (
        f"WITH {ends}, firsts AS (SELECT label AS query_id, vec_id AS q, v[1:4] AS v FROM emb QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 2), "
        f"asked AS (SELECT query_id, q, {unit} AS u FROM firsts), "
        "best AS (SELECT k.query_id, d.item_id, k.q, max(list_dot_product(d.u, k.u)) AS m FROM unit d, asked k GROUP BY ALL), "
        "scores AS (SELECT query_id, item_id, sum(m) AS s FROM best GROUP BY ALL) "
        "SELECT query_id, row_number() OVER w AS rank, item_id, round(s, 6) AS score FROM scores WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, item_id) QUALIFY row_number() OVER w <= 3"
    )
    return {
        "normalize_rows": f"WITH {emb} SELECT vec_id, unnest(range(64))::INT AS dim, round(unnest({unit}), 6) + 0.0 AS value FROM emb",
        "finite_check": f"WITH {emb} SELECT vec_id, len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS finite, len(v)::INT AS width, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM emb",
        "index_stats": "SELECT count(DISTINCT label)::BIGINT AS items, count(*)::BIGINT AS vectors, min(len(embedding))::INT AS dimension FROM embeddings",
        "topology_anchors": " UNION ALL ".join(anchors_of(*s) for s in ((4, 4), (2, 6), (6, 2), (32, 32))),
        "compact_positions": f"WITH {slots} SELECT slot AS wpos, pos FROM anchors UNION ALL SELECT (8 + i)::INT, (16 + i)::INT FROM range({AUXILIARY}) t(i)",
        "assign_anchors": f"WITH {assigned} SELECT item_id, pos, slot, round(cosine, 6) AS cosine FROM assigned",
        "cluster_sizes": f"WITH {assigned}, ids AS (SELECT DISTINCT item_id FROM tokens) SELECT i.item_id, a.slot, a.pos AS anchor_pos, count(s.pos)::BIGINT AS size FROM ids i CROSS JOIN anchors a LEFT JOIN assigned s ON s.item_id = i.item_id AND s.slot = a.slot GROUP BY ALL",
        "pool_clusters": f"WITH {built} {values} WHERE wpos < 8",
        "coalesce_pages": f"WITH {built} {values}",
        "teacher_pool": f"WITH {built} SELECT item_id, wpos::INT AS wpos, dim::INT AS dim, round(x + 0.1, 6) + 0.0 AS value FROM workers",
        "compile_documents": f"WITH {built} {values} WHERE dim < 4",
        "maxsim_scores": f"WITH {emb}, {ask}, {topic}, {score('topic', 'ask')} SELECT item_id, score FROM scores",
        "search_topk": f"WITH {emb}, {ask}, {topic}, {score('topic', 'ask')} SELECT item_id, score FROM scores ORDER BY exact DESC, item_id LIMIT 5",
        "search_compiled": f"WITH {ends}, {short}, {score('unit', 'short')} SELECT item_id, score FROM scores ORDER BY exact DESC, item_id LIMIT 10",
        "search_batch": batch,
        "contains_semi": f"WITH {page} SELECT vec_id::VARCHAR AS item_id FROM emb WHERE vec_id::VARCHAR IN (SELECT item_id FROM tokens)",
        "unknown_anti": f"WITH {page} SELECT vec_id::VARCHAR AS item_id FROM emb WHERE vec_id::VARCHAR NOT IN (SELECT item_id FROM tokens)",
        "records_order": f"WITH {ends} {records}",
        "refine_candidates": (
            f"WITH {ends}, {short}, {score('unit', 'short')}, top AS (SELECT item_id FROM scores ORDER BY exact DESC, item_id LIMIT 10), {ask}, "
            "again AS (SELECT t.item_id, k.q, max(list_dot_product(t.u, k.u)) AS m FROM tokens t JOIN top USING (item_id) CROSS JOIN ask k GROUP BY ALL) "
            "SELECT item_id, round(sum(m), 6) AS score FROM again GROUP BY item_id ORDER BY sum(m) DESC, item_id LIMIT 5"
        ),
        "artifact_roundtrip": f"WITH {ends} SELECT item_id, vec_pos, dim, value FROM ({records})",
        "artifact_offsets": "WITH n AS (SELECT label::BIGINT AS item_ord, label::VARCHAR AS item_id, count(*)::BIGINT AS n FROM embeddings GROUP BY ALL) SELECT item_ord, item_id, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS stop FROM n WINDOW w AS (ORDER BY item_ord)",
        "artifact_digest": f"WITH {page} SELECT count(DISTINCT item_id)::BIGINT AS items, (10 * count(DISTINCT item_id))::BIGINT AS vectors, 4::INT AS dimension, true AS same_digest, sha256('{canonical}') AS plan_fingerprint FROM tokens",
        "plan_admission": f"SELECT name, ({reasons}) = '' AS admitted, ltrim({reasons}, '; ') AS message, compact_visual_tokens / full_visual_tokens AS persistent_fraction FROM (VALUES {PROFILES}) t({PROFILE_COLUMNS})",
        "plan_fingerprint": f"SELECT '{canonical}' AS canonical, sha256('{canonical}') AS fingerprint",
        "portfolio_options": f"{folio} SELECT {folio_columns} FROM cost",
        "portfolio_best": f"{folio} SELECT {folio_columns} FROM cost ORDER BY expected_seconds, storage_bytes, k, names LIMIT 1",
        "portfolio_routes": f'{folio} SELECT m AS mask, i::INT AS uidx, name AS "update", source, seconds AS seconds_per_update, n AS expected_count FROM way',
        "lifecycle_choice": load + (
            ", kinds AS (SELECT user_id, full_s AS s, 1.0::DOUBLE AS st, 'full' AS k, 1.0::DOUBLE AS q FROM w UNION ALL SELECT user_id, compact_s, st, 'compact', cq / fq FROM w "
            "UNION ALL SELECT user_id, compact_s + cold * each, st, 'compact_refine', rq / fq FROM w), "
            "best AS (SELECT * FROM kinds WHERE q >= 0.99 AND st <= 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s, st, k) = 1) "
            "SELECT user_id, k AS lifecycle, round(s, 6) AS epoch_seconds, round(q, 6) AS quality_fraction, st AS storage_fraction FROM best"
        ),
        "profile_dicts": f"SELECT *, true AS same FROM (VALUES {PROFILES}) t({PROFILE_COLUMNS})",
        "plan_dicts": f"SELECT r || 'x' || c AS grid, {canonical_of} AS canonical, true AS same FROM (VALUES {', '.join(map(str, SHAPES))}) t(r, c)",
        "plan_checks": (
            "SELECT plan_id, CASE WHEN coalesce(name, '') = '' OR layers < 2 THEN concat_ws('; ', CASE WHEN coalesce(name, '') = '' THEN 'the backbone name is empty' END, "
            "CASE WHEN layers < 2 THEN 'the backbone has no separable prefix and suffix' END, CASE WHEN layers <= 6 THEN 'the split must leave both prefix and suffix layers' END) "
            "WHEN NOT coalesce(grid_rows > 0 AND grid_columns > 0 AND grid_rows % 2 = 0 AND grid_columns % 2 = 0, false) THEN 'visual grid dimensions must be positive and even' "
            "WHEN grid_rows * grid_columns != full_tokens THEN 'visual grid does not match the Full token capacity' "
            "WHEN compact_tokens * 2 != full_tokens THEN 'a topology-anchored plan requires 50% capacity' WHEN layout != 'right_column_pair_per_2x2' THEN 'unsupported anchor layout' "
            "WHEN assignment != 'global_hidden_cosine' THEN 'unsupported assignment rule' WHEN pooling != 'cluster_mean' THEN 'unsupported pooling rule' "
            f"WHEN version != 1 THEN 'unsupported compile-plan format' END AS reason FROM (VALUES {PLANS}) t({PLAN_COLUMNS})"
        ),
        "assignment_capacity": f"WITH {page} SELECT item_id, count(*) FILTER (pos < 16)::BIGINT AS full_visual_tokens, 8::BIGINT AS compact_visual_tokens, 8 / (count(*) FILTER (pos < 16)) AS persistent_fraction FROM tokens GROUP BY item_id",
        "hidden_checks": (
            f"WITH {page} SELECT DISTINCT item_id, CASE WHEN item_ord % 5 IN (2, 4) THEN 'expected a non-empty rank-2 hidden-state matrix' WHEN item_ord % 5 = 1 THEN 'hidden states must be finite' "
            "WHEN item_ord % 5 = 3 THEN 'grid and auxiliary counts do not match hidden states' END AS reason FROM tokens"
        ),
        "compiled_hidden": f"WITH {built} {values}",
        "edge_clusters": f"WITH {edge}, ids AS (SELECT DISTINCT item_id FROM tokens) SELECT i.item_id, a.slot, a.pos AS anchor_pos, count(s.pos)::BIGINT AS size FROM ids i CROSS JOIN anchors a LEFT JOIN assigned s ON s.item_id = i.item_id AND s.slot = a.slot GROUP BY ALL",
        "edge_pages": f"WITH {edge} {values}",
        "built_items": f"WITH {emb}, {ask}, {topic}, {twice}, {score('twice', 'ask')} SELECT item_id, score FROM scores ORDER BY exact DESC, item_id LIMIT 12",
        "contains_ids": f"WITH {page} SELECT k AS item_id, k IN (SELECT item_id FROM tokens) AS held FROM (VALUES ('0'), ('7'), ('007'), ('-1'), ('x')) t(k)",
        "manifest_rejects": (
            "SELECT * FROM (VALUES ('as written', 2, NULL::VARCHAR), ('fingerprint', -1, 'compile-plan fingerprint mismatch'), ('grid', -1, 'compile-plan fingerprint mismatch'), "
            "('counts as text', 2, NULL)) t(\"case\", items, error)"
        ),
        "option_checks": (
            "SELECT id, CASE WHEN coalesce(name, '') = '' THEN 'a materialization option needs a name' WHEN n = 0 THEN 'an artifact must declare its compiled dependencies' "
            "WHEN b < 0 THEN 'artifact storage must be non-negative' WHEN coalesce(r, -1) < 0 THEN 'replay time must be finite and non-negative' "
            "WHEN m < 0 THEN 'materialization time must be finite and non-negative' WHEN q < 0 THEN 'quality fraction must be finite and non-negative' "
            f"WHEN q > 1 THEN 'quality fraction cannot exceed one' END AS reason FROM (VALUES {OPTION_ROWS}) t(id, name, n, b, r, m, q)"
        ),
        "update_checks": (
            "SELECT id, CASE WHEN name = '' THEN 'an update scenario needs a name' WHEN n = 0 THEN 'an update scenario must change at least one component' "
            f"WHEN coalesce(c, -1) < 0 THEN 'expected update count must be finite and non-negative' END AS reason FROM (VALUES {UPDATE_ROWS}) t(id, name, n, c)"
        ),
        "portfolio_savings": f"{folio} SELECT mask, round(1 - expected_seconds / raw_baseline_seconds, 6) + 0.0 AS saving_fraction FROM cost",
        "portfolio_decision": (
            f"{folio} SELECT selected, (SELECT string_agg(source, ',' ORDER BY i) FROM way w WHERE w.m = mask) AS sources, storage_bytes, expected_seconds, "
            "round(1 - expected_seconds / raw_baseline_seconds, 6) AS saving_fraction, (SELECT sum(seconds * n) FROM way w WHERE w.m = mask) AS upkeep_seconds "
            "FROM cost ORDER BY expected_seconds, storage_bytes, k, names LIMIT 1"
        ),
        "workload_checks": load + (
            "SELECT user_id, CASE WHEN user_id % 6 IN (1, 2, 5) THEN 'workload measurements must be finite and non-negative' WHEN user_id % 6 = 3 THEN 'Full quality must be positive' "
            "WHEN user_id % 6 = 4 THEN 'compact storage fraction must be in (0, 1]' END AS reason, user_id % 6 = 0 AS decided FROM w"
        ),
        "break_even": load + "SELECT user_id, CASE WHEN full_s - compact_s <= 0 THEN 0.0 WHEN each = 0 THEN 'inf'::DOUBLE ELSE round((full_s - compact_s) / each, 6) END AS queries FROM w",
    }


ORACLE_SQL = _sql()
