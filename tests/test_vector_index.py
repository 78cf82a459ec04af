"""The stored vector index against exact search."""

import numpy as np
import pytest

from kbspark.operators import knn, vector_index


def rows(df):
    return sorted((r.query_id, r.doc_id, round(r.cosine, 6), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 18))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 18))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = [(i, v.tolist(), f"p{i % 3}") for i, v in enumerate(x)]
    data += [(5000, None, "p0"), (5001, [1.0] * 17, "p0"), (5002, [float("nan")] * 18, "p1")]
    return spark.createDataFrame(data, "doc_id long, vector array<double>, project_id string").repartition(5)


def asked(table):
    return table.where("doc_id % 20 = 0").selectExpr("concat('q', doc_id) AS query_id", "vector", "project_id")


@pytest.mark.parametrize("by", [(), ("project_id",)])
def test_all_cells_are_exact_and_few_recall_most(spark, table, tmp_path, by):
    path = str(tmp_path / "index")
    vector_index.write(table, path, by, cells=16)
    want = rows(knn.search(asked(table), table, by, k=5))
    assert rows(vector_index.search(asked(table), path, 16, by, k=5, refine=10**6)) == want
    for bound in (4096, 0):
        got = rows(vector_index.search(asked(table), path, 6, by, k=5, max_queries=bound))
        found = {(q, d) for q, d, _, _ in got} & {(q, d) for q, d, _, _ in want}
        assert len(found) >= 0.9 * len(want)
        assert {(q, d, c) for q, d, c, _ in got if (q, d) in found} <= {(q, d, c) for q, d, c, _ in want}


def test_probes_read_the_folders_of_their_cells(spark, table, tmp_path):
    path = str(tmp_path / "index")
    vector_index.write(table, path, cells=16)
    one = asked(table).limit(1)
    plan = vector_index.search(one, path, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_appended_rows_ties_and_empty_tables(spark, table, tmp_path):
    path = str(tmp_path / "index")
    vector_index.write(table.where("doc_id < 1500"), path, cells=8)
    vector_index.write(table.where("doc_id >= 1500").union(table.where("doc_id < 40").selectExpr("doc_id + 9000", "vector", "project_id")), path, mode="append")
    both = table.union(table.where("doc_id < 40").selectExpr("doc_id + 9000", "vector", "project_id"))
    got = rows(vector_index.search(asked(table), path, 8, k=5, refine=10**6))
    assert got == rows(knn.search(asked(table), both, k=5))
    assert vector_index.search(asked(table).limit(0), path, 4).count() == 0
    empty = str(tmp_path / "empty")
    vector_index.write(table.limit(0), empty)
    assert vector_index.search(asked(table), empty, 4).count() == 0


def test_the_fit_sees_a_bounded_sample(spark, table, monkeypatch):
    monkeypatch.setattr(vector_index, "SAMPLE_ROWS", 200)
    usable = table.where(knn.finite() & (knn.F.size("vector") == 18))
    book = vector_index.fit(usable, usable.count(), 18, cells=1000)
    assert 150 < len(book.centres) <= 200 and book.levels.shape == (5, len(book.levels[0]), 4)
