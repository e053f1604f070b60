"""The pipeline's stages on a small corpus, and the registered queries."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lateview.llm import registry

SF = "/root/testdata/sf0.001"


def corpus(spark, path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(2000)]
    rows = []
    for i in range(80):
        words = rng.choices(vocabulary, k=200)
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    rows.append((100, rows[5][1], "en", "s0", 0))
    near = rows[6][1].split()
    near[50] = "changed"
    rows.append((101, " ".join(near), "en", "s0", 0))
    rows += [(102, "12 34 !!", None, "s1", 0), (103, None, None, None, 0), (7, rows[7][1], "en", "s1", 0)]
    rows.append((104, rows[8][1][:300] + " reach me: someone@example.com or +1 (415) 555-0100 " + "".join(rng.choices("qrstuv ", k=400)), "en", "s2", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == columns
            path = f"{tmp_path}/{i}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        seen.append(docs.collect())
    ids = [{r.doc_id for r in s} for s in seen]
    assert ids[0] == {r[0] for r in rows} - {102, 103}
    assert ids[1] == ids[0] - {100, 101} and len(seen[1]) == len(ids[1])
    hidden = next(r for r in seen[2] if r.doc_id == 104)
    assert "<EMAIL>" in hidden.text and "<PHONE>" in hidden.text and hidden.n_chars == len(hidden.text)
    assert {r.text for r in seen[2] if r.doc_id != 104} <= {r[1] for r in rows}
    assert ids[3] <= ids[2] and len(seen[3]) > len(ids[3])
    assert len(seen[4]) == len(seen[3]) and all(r.decoded_ok for r in seen[4])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, seen[4]))


def test_stages_with_nulls_repeats_further_columns_and_no_rows(spark, tmp_path):
    words = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(None, words, None, None, None, 1), (1, words, "en", "a", 5, 1), (1, words, "en", "a", 5, 1), (2, None, None, "a", None, None), (3, "", "en", None, 0, 2)]
    rows += [(4, "x " * 60000 + "mail jane@mail.example.org", "en", "b", 1, 3), (5, "other words altogether", None, "b", 1, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, place int")
    for name, some in (("some", df), ("none", df.limit(0))):
        docs = some
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
            if i < 4:
                assert docs.columns == df.columns
            if name == "none":
                assert docs.count() == 0
            elif i == 1:
                assert sorted((r.doc_id, r.place) for r in docs.collect()) == [(1, 1), (4, 3), (5, 3)]
            elif i == 2:
                assert {r.doc_id for r in docs.collect() if "<EMAIL>" in r.text} == {4}
            elif i == 4:
                assert {r.doc_id for r in docs.collect()} <= {1, 4, 5} and all(r.decoded_ok for r in docs.collect())


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs_over_all_rows(spark, name):
    table = {"op4_chat": "conversations", "op9_ann": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    want = {"op4_chat": lambda: rows.select("conv_id").distinct().count() + 1, "op9_ann": lambda: 10 * rows.where("vec_id % 100 = 0").count()}.get(name, rows.count)()
    assert entry.queries()[name](spark, SF).count() == want


def test_ten_operators_and_the_pipeline():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
