"""Plans and algorithms that are there for size: placed projections, hot ids, bounded columns, trees, numbering."""

import importlib
import math
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors as MLVectors
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix, RowMatrix
from pyspark.sql import functions as F

from rankfold import Matrix, project, relative_reconstruction_error, vector_rows
from rankfold.functions import absolute, names
from rankfold.operators import aggregates, entries, products
from rankfold.operators import tsqr
from rankfold.plans.ppca import column_error_sums, largest_column_error
from rankfold.sources import from_rdd, from_row_matrix
from rankfold.sources.text import numbered_lines

ppca_plan = importlib.import_module("rankfold.plans.ppca")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def conf(spark):
    """Session settings for one test."""
    saved = {}

    def put(**settings):
        for key, value in settings.items():
            key = "spark.sql." + key.replace("__", ".")
            saved.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in saved.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


# Projection


def components(spark, v):
    cells = [(int(i), int(j), float(v[i, j])) for i, j in zip(*np.nonzero(v))]
    return spark.createDataFrame(cells, "col_id bigint, comp int, loading double")


def dense_scores(df, n, k):
    out = np.zeros((n, k))
    for i, j, s in df.collect():
        out[i, j] = s
    return out


@pytest.mark.parametrize("limit, route", [(1 << 26, "rows"), (2000, "grid")])
@pytest.mark.parametrize("k", [2, 19])
def test_project_entries(spark, coo, limit, route, k):
    rng = np.random.default_rng(k)
    a = np.round(rng.normal(size=(50, 40)) * (rng.random((50, 40)) < 0.4), 3)
    a[7] = 0  # a row that is not stored
    a[:, 5] = np.round(rng.normal(size=50), 3)
    a[7, 5] = 0
    v = rng.normal(size=(40, k))
    v[3] = 0
    m = coo(a, n_rows=50, n_cols=40)
    out = project(m, components(spark, v), k, broadcast_bytes=limit)
    assert np.allclose(dense_scores(out, 50, k), a @ v)
    centred = (a - a.mean(axis=0)) @ v
    centred[7] = 0
    assert np.allclose(dense_scores(project(m, components(spark, v), k, centred=True, broadcast_bytes=limit), 50, k), centred)
    first = project(m, components(spark, v), 1, broadcast_bytes=limit)  # of k components the first
    assert np.allclose(dense_scores(first, 50, 1), a @ v[:, :1])


@pytest.mark.parametrize("limit", [1 << 26, 2000])
def test_project_vectors(spark, limit):
    rng = np.random.default_rng(3)
    a, v = rng.normal(size=(60, 30)), rng.normal(size=(30, 3))
    rows = spark.createDataFrame([(i, [float(x) for x in a[i]]) for i in range(60)], "id bigint, v array<double>")
    m = vector_rows(rows, "id", "v")
    assert np.allclose(dense_scores(project(m, components(spark, v), 3, broadcast_bytes=limit), 60, 3), a @ v)
    centred = project(m, components(spark, v), 3, centred=True, broadcast_bytes=limit)
    assert np.allclose(dense_scores(centred, 60, 3), (a - a.mean(axis=0)) @ v)


def test_projection_streams_the_matrix(spark, coo, conf):
    """Even where Y is the smaller side, the components are the broadcast side, and vectors need no exchange of rows."""
    conf(adaptive__enabled="false")
    m = Matrix(spark.range(3).selectExpr("id AS row_id", "id AS col_id", "1.0D AS value"), 3, 5000)
    v = spark.range(5000).selectExpr("id AS col_id", "0 AS comp", "1.0D AS loading")
    text = plan(project(m, v, 1))
    assert "BroadcastHashJoin" in text and "BuildRight" in text and "BuildLeft" not in text
    rows = spark.range(3).selectExpr("id", "array(1.0D, 2.0D) AS v")
    assert "Exchange" not in plan(project(vector_rows(rows, "id", "v", n_rows=3, n_cols=2), v.limit(2), 1)).split("Physical Plan")[1]


def test_project_nothing(spark):
    none = spark.createDataFrame([], "row_id bigint, col_id bigint, value double")
    assert project(Matrix(none), components(spark, np.ones((2, 1))), 1).count() == 0


# Reconstruction error


@pytest.mark.parametrize("rate", [1.0, 0.5])
@pytest.mark.parametrize("kind", ["entries", "vectors"])
def test_largest_column_error(spark, coo, kind, rate):
    """Equal to the sums of all columns, of which only a few are computed."""
    rng = np.random.default_rng(0)
    a = np.round(rng.normal(size=(80, 300)), 3)
    a *= rng.random(a.shape) < 0.5
    a[:, 17] *= 30
    a[:, 200] *= 29
    k = 2
    w, v = rng.normal(size=(300, k)) / 40, rng.normal(size=(300, k))
    mu = a.sum(axis=0) / 85
    if kind == "entries":
        m = coo(a, n_rows=85, n_cols=300)
    else:
        m = vector_rows(spark.createDataFrame([(i, [float(x) for x in a[i]]) for i in range(80)], "id bigint, v array<double>"), "id", "v", n_rows=85, n_cols=300)
    cells = [(j, float(mu[j]), *map(float, w[j]), *map(float, v[j])) for j in range(300)]
    fitted = spark.createDataFrame(cells, "col_id bigint, mu double, w0 double, w1 double, v0 double, v1 double")
    with m.lay_out(k + 2) as layout:
        sums = column_error_sums(layout, fitted, k, mu @ w, rate, seed=1).agg(F.max("err"), F.max("norm")).first()
        found = largest_column_error(layout, fitted, k, mu @ w, rate, seed=1, batch=4)
        everything = largest_column_error(layout, fitted, k, mu @ w, rate, seed=1, batch=1000)
    assert np.isclose(found.error, sums[0]) and np.isclose(found.norm, sums[1])
    assert found.computed <= 20 and np.isclose(everything.error, found.error)
    if rate == 1.0:
        centred = np.vstack([a, np.zeros((5, 300))]) - mu
        assert np.isclose(found.error, np.abs(centred @ w @ v.T - centred).sum(axis=0).max())
        assert np.isclose(found.ratio, found.error / np.abs(centred).sum(axis=0).max())


@pytest.mark.parametrize("kind", ["entries", "vectors"])
def test_relative_reconstruction_error(spark, coo, kind):
    rng = np.random.default_rng(4)
    a = np.round(rng.normal(size=(40, 25)), 3)
    v = np.linalg.qr(rng.normal(size=(25, 3)))[0]
    v[4] = 0
    if kind == "entries":
        m = coo(a)
    else:
        m = vector_rows(spark.createDataFrame([(i, [float(x) for x in a[i]]) for i in range(40)], "id bigint, v array<double>"), "id", "v")
    c = a - a.mean(axis=0)
    lost = np.abs(c @ v @ v.T - c).sum(axis=0).max() / np.abs(c).sum(axis=0).max()
    assert np.isclose(relative_reconstruction_error(m, components(spark, v), 3).ratio, lost)
    whole = np.linalg.svd(c, full_matrices=True)[2].T
    assert relative_reconstruction_error(m, components(spark, whole), 25).ratio < 1e-9


# Hot ids


def skewed(spark, hot):
    """100,000 entries, half of them with one column (or row) id."""
    df = spark.range(100_000).selectExpr("id AS a", "IF(id % 2 = 0, 0, id % 997) AS b", "CAST(id % 13 AS DOUBLE) AS value")
    names_ = ("a", "b") if hot == "col_id" else ("b", "a")
    return df.selectExpr(f"{names_[0]} AS row_id", f"{names_[1]} AS col_id", "value")


@pytest.mark.parametrize("hot", ["col_id", "row_id"])
@pytest.mark.parametrize("width", [2, 18])
def test_hot_ids_are_spread(spark, conf, hot, width):
    conf(autoBroadcastJoinThreshold="-1", adaptive__skewJoin__enabled="false", adaptive__coalescePartitions__enabled="false", shuffle__partitions="64")
    y = skewed(spark, hot)
    assert [r[0] for r in products.hot_ids(y, hot).collect()] == [0]
    dense = spark.range(1000).selectExpr(f"id AS {hot}", *[f"CAST((id + {j}) % 7 AS DOUBLE) AS w{j}" for j in range(width)])
    joined = products.spread_join(y, dense, hot)
    assert joined.count() == y.count()
    largest = joined.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    plain = y.join(dense, hot).groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert largest < 10_000 < 50_000 <= plain
    product, cols = (products.sketch, "z") if hot == "col_id" else (products.cross_product, "c")
    got = {r[0]: tuple(r)[1:] for r in product(y, dense, names("w", width), spread=True).collect()}
    assert got == {r[0]: tuple(r)[1:] for r in product(y, dense, names("w", width)).collect()}


def test_spread_join_without_hot_ids(spark):
    none = spark.createDataFrame([], "row_id bigint, col_id bigint, value double")
    dense = spark.range(3).selectExpr("id AS col_id", "1.0D AS w0")
    assert products.sketch(none, dense, ["w0"], spread=True).count() == 0


# Reduction tree


def test_tree_keeps_its_fan_in(spark, conf, monkeypatch):
    """Far more partitions than the shuffle setting: no merge sees more than fan_in factors."""
    conf(shuffle__partitions="4")
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=names("z", 3))).repartition(150)
    seen = spark.sparkContext.accumulator(0)
    most = []
    original = tsqr._merged_r

    def watched(width):
        run = original(width)

        def counted(factors):
            n = len(factors["place"].unique())
            assert n <= 4, n
            seen.add(1)
            return run(factors)

        return counted

    monkeypatch.setattr(tsqr, "_merged_r", watched)
    r = tsqr.tsqr_r(df, names("z", 3), fan_in=4)
    most.append(seen.value)
    assert np.allclose(r.T @ r, x.T @ x) and np.allclose(np.tril(r, -1), 0)
    assert most[0] >= sum(math.ceil(150 / 4**level) for level in range(1, 5)) - 40
    empty = df.filter("z0 > 1e9")
    assert tsqr.tsqr_table(empty, names("z", 3)).count() == 0


# Sums, samples


def test_array_sums(spark):
    rows = [(1, [1.0, 2.0], [[1.0], [2.0, None]]), (2, None, None), (3, [None, 5.0, 7.0], [[], None, [4.0, 5.0, 6.0]]), (4, [], [])]
    df = spark.createDataFrame(rows, "id int, v array<double>, m array<array<double>>").repartition(3)
    assert {tuple(r) for r in aggregates.array_sum(df, "v").collect()} == {(0, 1.0), (1, 7.0), (2, 7.0)}
    want = {(0, 0, 1.0), (1, 0, 2.0), (1, 1, 0.0), (2, 0, 4.0), (2, 1, 5.0), (2, 2, 6.0)}
    assert {tuple(r) for r in aggregates.array_sum(df, "m").collect()} == want
    assert "Generate" not in plan(aggregates.array_sum(df, "m"))
    assert aggregates.array_sum(df.filter("id > 9"), "m").count() == 0


def test_exact_samples(spark):
    y = spark.range(1000).selectExpr("id % 100 AS row_id", "id AS col_id", "1.0D AS value")
    for n in (0, 1, 37, 100, 200):
        kept = entries.sample_exact(y, n, seed=2)
        assert kept.select("row_id").distinct().count() == min(n, 100) and kept.count() == 10 * min(n, 100)
    some = {r[0] for r in entries.sample_exact(y, 30, seed=2).select("row_id").distinct().collect()}
    assert some == {r[0] for r in entries.sample_exact(y.repartition(9), 30, seed=2).select("row_id").distinct().collect()}
    assert some <= {r[0] for r in entries.sample_exact(y, 60, seed=2).select("row_id").distinct().collect()}


# Sources


def test_rdd_of_vectors(spark):
    sc = spark.sparkContext
    rows = [MLVectors.dense([1.0, 0.0, 2.0]), Vectors.sparse(3, [2], [5.0]), [0.0, 7.0], Vectors.dense([0.0, 0.0, 0.0]), None, MLVectors.sparse(3, {1: 4.0})]
    m = from_rdd(spark, sc.parallelize(rows, 3), n_rows=6)
    assert sorted(map(tuple, m.entries.collect())) == [(0, 0, 1.0), (0, 2, 2.0), (1, 2, 5.0), (2, 1, 7.0), (5, 1, 4.0)]
    assert (m.measured().n_rows, m.measured().n_cols) == (6, 3)
    wide = from_rdd(spark, sc.parallelize([Vectors.sparse(10**9, [10**9 - 1], [1.0])]))  # costs what it stores
    assert [tuple(r) for r in wide.entries.collect()] == [(0, 10**9 - 1, 1.0)]
    assert from_rdd(spark, sc.parallelize([], 2)).entries.count() == 0


def test_row_matrices(spark):
    sc = spark.sparkContext
    plain = from_row_matrix(RowMatrix(sc.parallelize([[1.0, 2.0], [0.0, 3.0]], 2)))
    assert sorted(map(tuple, plain.entries.collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)]
    rows = [IndexedRow(7, [1.0, 0.0]), IndexedRow(3, Vectors.sparse(2, [1], [2.0])), IndexedRow(7, [1.0, 4.0])]
    assert sorted(map(tuple, from_row_matrix(IndexedRowMatrix(sc.parallelize(rows, 2))).entries.collect())) == [(3, 1, 2.0), (7, 0, 2.0), (7, 1, 4.0)]


def test_lines_are_numbered_where_they_are_read(spark, tmp_path, conf):
    conf(files__maxPartitionBytes="200", adaptive__enabled="false", autoBroadcastJoinThreshold="-1")
    folder = tmp_path / "text"
    folder.mkdir()
    want = []
    for f in range(3):
        lines = [f"file {f} line {k}" if k % 5 else "  " for k in range(60)]
        (folder / f"part-{f}.txt").write_text("\n".join(lines) + "\n")
        want += [x for x in lines if x.strip()]
    out = numbered_lines(spark, str(folder))
    physical = plan(out).split("Physical Plan")[1]
    assert "BroadcastHashJoin" in physical and "hashpartitioning" not in physical and "SortMergeJoin" not in physical
    assert [r.value for r in out.orderBy("line_no").collect()] == want
    assert [r.line_no for r in out.orderBy("line_no").collect()] == list(range(len(want)))
    joined = numbered_lines(spark, str(folder), broadcast_splits=1)
    assert "SortMergeJoin" in plan(joined) and [r.value for r in joined.orderBy("line_no").collect()] == want


# Entry points


@pytest.mark.parametrize("gone", ["rankfold.llm", "zstandard", "corpus_pipeline"])
def test_matrix_queries_stay_without_the_text_operators(monkeypatch, gone):
    import __spark_entry__ as entry_points

    whole = entry_points.queries()
    for name in [n for n in sys.modules if n.startswith("rankfold.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    left, sql = entry_points.queries(), entry_points.oracle_sql()
    matrix = {n for n in whole if not n.startswith("op") and n != "pipeline" or n.startswith("orthonormal")}
    assert matrix <= set(left) and set(sql) <= set(left)
    assert "pipeline" not in left


# Absolute sums


@pytest.mark.parametrize("n, m, d", [(0, 5, 2), (3, 0, 2), (700, 300, 2), (5000, 900, 3), (5000, 900, 6)])
def test_absolute_sums(n, m, d, monkeypatch):
    """Equal to the sums over all pairs, most of which are not multiplied out where the boxes are compact."""
    rng = np.random.default_rng(n + d)
    rows, columns = rng.normal(size=(n, d)) * 10.0 ** np.arange(d), rng.normal(size=(m, d)) + 1
    rows[n // 2 :, 0] = 0.0
    columns[: m // 4] = columns[:1]
    columns[m // 2 : m // 2 + 3] = 0.0
    touched = []
    direct = absolute._direct
    monkeypatch.setattr(absolute, "_direct", lambda r, c: touched.append(len(r) * len(c)) or direct(r, c))
    np.testing.assert_allclose(absolute.absolute_sums(rows, columns), np.abs(rows @ columns.T).sum(axis=0), rtol=1e-11)
    if d == 3:
        assert sum(touched) < n * m / 2


def test_many_columns_with_about_equal_bounds(spark, coo, monkeypatch):
    """No pass over the rows for each batch of columns: what a few batches leave is computed in one job."""
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=(60, 400)), 3)
    w, v, mu = rng.normal(size=(400, 2)) / 40, rng.normal(size=(400, 2)) * 0 + 3.0, a.sum(axis=0) / 60
    cells = [(j, float(mu[j]), *map(float, w[j]), *map(float, v[j])) for j in range(400)]
    fitted = spark.createDataFrame(cells, "col_id bigint, mu double, w0 double, w1 double, v0 double, v1 double")
    passes = []
    one = ppca_plan._column_sums_of
    monkeypatch.setattr(ppca_plan, "_column_sums_of", lambda *args: passes.append(1) or one(*args))
    with coo(a).lay_out(4) as layout:
        found = largest_column_error(layout, fitted, 2, mu @ w, batch=2)
    centred = a - mu
    assert found.computed > 16 and len(passes) <= ppca_plan.BATCHES
    assert np.isclose(found.error, np.abs(centred @ w @ v.T - centred).sum(axis=0).max())


# Columns of tables, and matrices that are joined


def test_columns_are_scanned_as_rows(spark):
    """One array per row instead of four entries; records with one id add up, and rows of zeros are not stored."""
    from rankfold import randomized_pca
    from rankfold.sources import from_columns

    rng = np.random.default_rng(8)
    a = np.round(rng.normal(size=(60, 4)), 3)
    records = [(f"r{i}", *map(float, a[i])) for i in range(60)] + [("r3", 1.0, None, 0.0, 2.0), ("empty", 0.0, None, 0.0, 0.0)]
    df = spark.createDataFrame(records, "k string, a double, b double, c double, d double")
    m = from_columns(df, "k", ["a", "b", "c", "d"])
    assert m.entries.filter("row_id = 'r3'").count() == 6 and m.stored().entries.count() == m.entries.count()
    a[3] += [1.0, 0.0, 0.0, 2.0]
    with m.lay_out(2) as layout:
        assert (layout.kind, layout.n_rows, layout.n_cols) == ("vectors", 60, 4)
    sigma = np.linalg.svd(a - a.mean(axis=0), compute_uv=False)
    assert np.allclose(randomized_pca(m, 3, oversample=1, max_iter=30).sigma, sigma[:3], rtol=1e-6)
    wider = from_columns(df, "k", ["a", "b", "c", "d"], n_rows=70)
    centred = np.vstack([a, np.zeros((10, 4))])
    sigma = np.linalg.svd(centred - centred.mean(axis=0), compute_uv=False)
    assert np.allclose(randomized_pca(wider, 3, oversample=1, max_iter=30).sigma, sigma[:3], rtol=1e-6)


@pytest.mark.parametrize("name", ["power_3_steps_k1", "pca_component_k1", "ppca_component_k1", "ppca_k3"])
def test_purchases_are_joined_once(spark, tmp_path, monkeypatch, name):
    """What measures the purchases and what places them read one table."""
    from rankfold.catalog import queries

    rng = np.random.default_rng(2)
    lines = [(i % 12, int(rng.integers(9)), float(rng.integers(1, 9))) for i in range(60)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, i % 7) for i in range(12)], "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    plans = []
    measured = Matrix.measured
    monkeypatch.setattr(Matrix, "measured", lambda m: (plans.append(plan(m.entries)), measured(m))[1])
    assert queries.REGISTRY[name](spark, str(tmp_path)).count() in (1, 9, 27)
    assert plans and not any("Join" in p or "Aggregate" in p for p in plans)
