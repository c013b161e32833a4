"""Operators against NumPy, and the plans of the passes."""

import numpy as np
import pytest

from rankfold.functions import names, scratch_path, seed_table
from rankfold.operators import aggregates, basis, entries, products
from rankfold.operators.tsqr import absent_row, tsqr_r, tsqr_table
from rankfold.sources import read_matrix


def table_of(spark, dense, prefix, key="col_id"):
    rows = [(i, *map(float, row)) for i, row in enumerate(np.asarray(dense))]
    return spark.createDataFrame(rows, ", ".join([f"{key} bigint", *[f"{prefix}{j} double" for j in range(np.shape(dense)[1])]]))


def dense_of(df, key, cols, n):
    out = np.zeros((n, len(cols)))
    for r in df.collect():
        out[r[key]] = [r[c] for c in cols]
    return out


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(30, 12)) * (rng.random((30, 12)) < 0.4)
    return y, rng.normal(size=(12, 20))


@pytest.mark.parametrize("width", [3, 20])
def test_products(spark, coo, small, width):
    y, w = small[0], small[1][:, :width]
    m = coo(y)
    z = products.sketch(m.entries, table_of(spark, w, "w"), names("w", width))
    np.testing.assert_allclose(dense_of(z, "row_id", names("z", width), 30), y @ w, atol=1e-12)
    c = products.cross_product(m.entries, z, names("z", width))
    np.testing.assert_allclose(dense_of(c, "col_id", names("c", width), 12), y.T @ (y @ w), atol=1e-10)


@pytest.mark.parametrize("width", [3, 20])
def test_centred_gram_with_absent_rows(spark, coo, small, width):
    y, w = small[0], small[1][:, :width]
    m = coo(y)
    full = np.vstack([y, np.zeros((7, 12))])
    mean = full.mean(axis=0) @ w
    z = products.sketch(m.entries, table_of(spark, w, "w"), names("w", width))
    got = np.zeros((width, width))
    for r in aggregates.centred_gram(z, names("z", width), mean, 37).collect():
        got[r["i"], r["j"]] = r["g"]
    a = full - full.mean(axis=0)
    np.testing.assert_allclose(got, np.triu((a @ w).T @ (a @ w)), atol=1e-9)


def test_frobenius_and_norms(spark, coo, small):
    y = small[0]
    m = coo(y)
    for n in (30, 50):
        full = np.vstack([y, np.zeros((n - 30, 12))])
        mu = aggregates.column_means(m.entries, n)
        got = aggregates.frobenius_norm_squared(m.entries, mu, n).first()[0]
        assert got == pytest.approx(np.sum((full - full.mean(axis=0)) ** 2), rel=1e-12)
    assert aggregates.absolute_column_norm(m.entries).first()[0] == pytest.approx(np.abs(y).sum(axis=0).max())


def test_tsqr(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)) @ np.diag([1e6, 1.0, 1.0, 1e-3])
    df = table_of(spark, x, "z", "row_id").repartition(40)
    r = tsqr_r(df, names("z", 4), fan_in=3)
    assert np.all(np.diag(r) > 0) and np.allclose(np.tril(r, -1), 0)
    np.testing.assert_allclose(np.linalg.svd(r, compute_uv=False), np.linalg.svd(x, compute_uv=False), rtol=1e-9)
    assert tsqr_table(df.filter("row_id < 2"), names("z", 4)).count() == 2  # fewer rows than columns
    mean = np.array([1.0, 2.0, 3.0, 4.0])
    padded = tsqr_r(absent_row(df, names("z", 4), mean, 9), names("z", 4))
    np.testing.assert_allclose(padded.T @ padded, x.T @ x + 9 * np.outer(mean, mean), rtol=1e-6)


def test_orthonormal_and_deflated(spark):
    rng = np.random.default_rng(6)
    v, w = rng.normal(size=(25, 3)), rng.normal(size=(25, 2))
    vt = table_of(spark, v, "v")
    for method in ("svd", "cholesky"):
        u = dense_of(basis.orthonormalise(vt, names("v", 3), method), "col_id", names("u", 3), 25)
        np.testing.assert_allclose(u.T @ u, np.eye(3), atol=1e-10)
        np.testing.assert_allclose(u @ (u.T @ v), v, atol=1e-9)
    d = dense_of(basis.deflate(table_of(spark, w, "w"), names("w", 2), vt, names("v", 3)), "col_id", names("w", 2), 25)
    np.testing.assert_allclose(d, w - v @ (v.T @ w), atol=1e-10)
    doubled = table_of(spark, np.hstack([v[:, :1], 2 * v[:, :1]]), "v")
    assert len(basis.orthonormalise(doubled, names("v", 2)).columns) == 2  # rank one


def test_sampling(spark):
    df = spark.range(200).selectExpr("id % 50 AS row_id", "id AS col_id", "1.0D AS value")
    kept = entries.sample_rows(df, 0.4, seed=3)
    again = entries.sample_rows(df.repartition(7), 0.4, seed=3)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, again.collect()))
    assert {r["n"] for r in kept.groupBy("row_id").count().withColumnRenamed("count", "n").collect()} == {4}
    assert entries.sample_rows(df, 1.0).count() == 200 and entries.sample_rows(df, 0.0).count() == 0


def test_generators(spark):
    for kind, mean, std in (("normal", 0.0, 1.0), ("uniform", 0.5, 12**-0.5)):
        x = seed_table(spark, 20000, 2, kind, seed=5).toPandas()[["w0", "w1"]].to_numpy()
        np.testing.assert_allclose(x.mean(axis=0), mean, atol=0.03)
        np.testing.assert_allclose(x.std(axis=0), std, rtol=0.03)
        assert abs(np.corrcoef(x.T)[0, 1]) < 0.03
        assert len(np.unique(x)) == x.size
    first = [list(r)[1:] for r in seed_table(spark, 12, 3, "validation").orderBy("col_id").collect()]
    assert first == [[float((i + j) % 10 + 1) for j in range(3)] for i in range(12)]
    with pytest.raises(ValueError):
        seed_table(spark, 3, 1, "other")


def test_reconstruct_and_residual(spark, coo, small):
    y = small[0]
    rng = np.random.default_rng(8)
    x, c, shift = rng.normal(size=(30, 2)), rng.normal(size=(12, 2)), rng.normal(size=12)
    xhat = products.reconstruct(table_of(spark, x, "x", "row_id"), names("x", 2), table_of(spark, c, "v"), names("v", 2), 30, 12)
    z = spark.createDataFrame([(j, float(s)) for j, s in enumerate(shift)], "col_id bigint, shift double")
    got = np.full((30, 12), np.nan)
    for r in products.residual_cells(xhat, coo(y).entries, z).collect():
        got[r["row_id"], r["col_id"]] = r["value"]
    np.testing.assert_allclose(got, x @ c.T - y - shift, atol=1e-12)


def test_signs_and_selection(spark):
    v = spark.createDataFrame([(0, 0, 0.5), (1, 0, -0.5), (2, 0, 0.1), (0, 1, 0.2), (1, 1, -0.9)], "col_id bigint, comp int, loading double")
    got = {(r["col_id"], r["comp"]): r["loading"] for r in basis.fix_signs(v).collect()}
    assert got == {(0, 0): 0.5, (1, 0): -0.5, (2, 0): 0.1, (0, 1): -0.2, (1, 1): 0.9}
    assert basis.leading_components(v, 1).count() == 3
    s = spark.createDataFrame([(0, 3.0), (1, 9.0), (2, 5.0)], "comp int, sigma double")
    assert basis.kth_value(s, 2).first()["sigma"] == 5.0
    assert basis.kth_value(s, 99).first()["sigma"] is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def live(plan):
    """The plan without the plans below cached tables."""
    out, skip = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth > skip:
            continue
        skip = depth if "InMemoryTableScan" in line else None
        out.append(line)
    return out


def test_a_pass_over_row_partitioned_data_shuffles_only_partial_sums(spark, coo, small):
    m = coo(small[0])
    w = table_of(spark, small[1][:, :2], "w")
    with m.lay_out(2) as placed:
        placed.entries.count()
        plan = live(plan_of(placed.normal_image(w, names("w", 2), np.zeros(2))))
    exchanges = [line for line in plan if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "col_id" in exchanges[0]
    assert not any("Cartesian" in line or "NestedLoop" in line for line in plan)


def test_a_pass_over_the_grid_does_not_shuffle_the_matrix(spark, coo, small):
    m = coo(small[0])
    w = table_of(spark, small[1][:, :2], "w")
    with m.lay_out(2, broadcast_bytes=600, partitions=8) as placed:
        assert placed.kind == "grid"
        placed.entries.count()
        plan = live(plan_of(placed.normal_image(w, names("w", 2), np.zeros(2))))
    for i, line in enumerate(plan):
        if "InMemoryTableScan" in line:
            above = plan[max(0, i - 3) : i]
            assert not any("Exchange" in a for a in above), above
    assert not any("BroadcastExchange" in line or "NestedLoop" in line for line in plan)


def test_filters_reach_the_scan(spark):
    path = scratch_path(spark, "m")
    spark.range(100).selectExpr("id AS row_id", "id % 7 AS col_id", "1.0D AS value", "id AS unused").write.parquet(path)
    plan = plan_of(read_matrix(spark, path, n_cols=5, drop_outside=True).entries)
    assert "GreaterThanOrEqual(col_id,0)" in plan.split("PushedFilters")[1]
    assert "unused" not in plan.split("ReadSchema")[1]


def test_grid_is_balanced_for_large_dimensions(spark):
    from rankfold import Matrix

    cells = spark.range(1).selectExpr("id AS row_id", "id AS col_id", "1.0D AS value")
    for n_rows, n_cols in ((10**9, 10**9), (10**9, 10**6), (10**6, 10**9)):
        placed = Matrix(cells, n_rows, n_cols).lay_out(8, partitions=20_000)
        assert placed.kind == "grid"
        assert placed.row_blocks * placed.col_blocks >= 4 * 20_000
        assert 0.2 < (n_rows / placed.row_blocks) / (n_cols / placed.col_blocks) < 5
    tall = Matrix(cells, 10**10, 10**4).lay_out(8)
    assert tall.kind == "rows" and tall.partitions > 10_000


def test_large_blocks_are_joined_by_sort_merge(spark, coo, small):
    m = coo(small[0])
    w = table_of(spark, small[1][:, :2], "w")
    with m.lay_out(2, broadcast_bytes=100, partitions=2) as placed:
        assert placed.kind == "grid"
        image = placed.normal_image(w, names("w", 2), np.zeros(2))
        assert any("SortMergeJoin" in line for line in live(plan_of(image)))
        got = dense_of(image, "col_id", names("c", 2), 12)
    np.testing.assert_allclose(got, small[0].T @ (small[0] @ small[1][:, :2]), atol=1e-10)


def test_small_limits_do_not_blow_up_the_grid(spark):
    """Copies of the operands grow like the entries, and the blocks of a grid spread over the partitions."""
    from rankfold import Matrix

    cells = spark.range(1).selectExpr("id AS row_id", "id AS col_id", "1.0D AS value")
    for times in (1, 60):
        n_rows, n_cols, n_entries = 15_000 * times, 20_000 * times, 600_000 * times
        placed = Matrix(cells, n_rows, n_cols, n_entries).lay_out(2, broadcast_bytes=10_000)
        assert placed.kind == "grid" and placed.partitions < 1000
        assert n_rows * placed.col_blocks + n_cols * placed.row_blocks < 1.3 * n_entries
    wide = Matrix(cells, 5_400_000, 7_200_000, 216_000_000).lay_out(10)
    blocks = wide.row_blocks * wide.col_blocks
    assert wide.kind == "grid" and blocks <= 32 and wide._hash_blocks


def test_few_blocks_meet_in_one_partition(spark, coo, small):
    m = coo(small[0])
    with m.lay_out(2, broadcast_bytes=600) as placed:
        assert placed.kind == "grid" and placed._first_block >= 0
        blocks = placed.entries.select("rb", "cb").distinct().count()
        tasks = placed.entries.selectExpr("spark_partition_id() AS p", "rb", "cb").distinct().groupBy("p").count()
        assert blocks == placed.row_blocks * placed.col_blocks
        assert tasks.agg({"count": "max"}).first()[0] <= 2
        image = placed.normal_image(table_of(spark, small[1][:, :2], "w"), names("w", 2), np.zeros(2))
        got = dense_of(image, "col_id", names("c", 2), 12)
    np.testing.assert_allclose(got, small[0].T @ (small[0] @ small[1][:, :2]), atol=1e-10)
