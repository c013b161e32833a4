"""The analyses against NumPy, in every layout."""

import numpy as np
import pytest

from rankfold import Matrix, VectorMatrix, kth_singular_value, ppca, randomized_pca, relative_error, residual_spectral_norm
from rankfold.catalog.fixtures import embedding_rows, embedding_vectors, line_columns, purchases
from rankfold.plans.sigma import kth_singular_value_run

SF_DIR = "/root/testdata/sf0.001"
# The default, and a limit that makes the column-sized operand too large for a broadcast.
LAYOUTS = {"rows": {}, "grid": {"broadcast_bytes": 700, "partitions": 8}}


def planted(n=60, d=9, sigma=(50.0, 20.0, 5.0), noise=0.0, seed=3):
    rng = np.random.default_rng(seed)
    u = np.linalg.qr(rng.normal(size=(n, len(sigma))) - 0.0)[0]
    u -= u.mean(axis=0)
    u = np.linalg.qr(u)[0]
    v = np.linalg.qr(rng.normal(size=(d, len(sigma))))[0]
    return u @ np.diag(sigma) @ v.T + noise * rng.normal(size=(n, d)) + rng.normal(size=d)


def centred(dense, n_rows=None):
    full = np.vstack([dense, np.zeros(((n_rows or len(dense)) - len(dense), dense.shape[1]))])
    return full - full.mean(axis=0)


def loadings(result, d, k):
    out = np.zeros((d, k))
    for row in result.components.collect():
        out[row["col_id"], row["comp"]] = row["loading"]
    return out


def fixed_signs(v):
    lead = np.argmax(np.abs(v), axis=0)
    return v * np.sign(v[lead, np.arange(v.shape[1])])


@pytest.mark.parametrize("layout", LAYOUTS)
def test_components_of_planted_matrix(spark, coo, layout):
    dense = planted(noise=0.01)
    options = LAYOUTS[layout]
    m = coo(dense)
    with m.lay_out(5, **options) as placed:
        assert placed.kind == layout
    out = randomized_pca(m, 3, oversample=2, max_iter=3, sigma_digits=None, seed=5, **options)
    _, s, vt = np.linalg.svd(centred(dense))
    np.testing.assert_allclose(out.sigma, s[:3], rtol=1e-9)
    np.testing.assert_allclose(loadings(out, 9, 3), fixed_signs(vt[:3].T), atol=1e-6)


def test_wide_sketch_goes_in_blocks(spark, coo):
    rng = np.random.default_rng(0)
    dense = rng.normal(size=(80, 40)) * (rng.random((80, 40)) < 0.3)
    m = coo(dense)
    s = np.linalg.svd(centred(dense), compute_uv=False)
    base = None
    for options in ({}, {"broadcast_bytes": 3000, "partitions": 8}):
        out = randomized_pca(m, 10, oversample=10, max_iter=3, sigma_digits=None, **options)
        base = base or out.sigma
        np.testing.assert_allclose(out.sigma, base, rtol=1e-9)
        np.testing.assert_allclose(out.sigma, s[:10], rtol=0.05)


def test_published_iterates(spark):
    out = randomized_pca(purchases(spark, SF_DIR), 3, oversample=5, max_iter=5, sigma_digits=None, kind="validation")
    np.testing.assert_allclose(out.sigma, [412.2680, 354.3222, 349.4799], atol=1e-3)
    one = randomized_pca(embedding_rows(spark, SF_DIR), 3, oversample=5, max_iter=1, sigma_digits=None, kind="validation")
    np.testing.assert_allclose(one.sigma, [3.2512, 3.1281, 2.9893], atol=1e-3)
    whole = randomized_pca(embedding_vectors(spark, SF_DIR), 3, oversample=5, max_iter=5, sigma_digits=None, kind="validation")
    np.testing.assert_allclose(whole.sigma, [3.7468, 3.6074, 3.5078], atol=1e-3)


def test_residual_norm_after_one_iteration(spark):
    m = purchases(spark, SF_DIR).measured()
    one = randomized_pca(m, 3, oversample=5, max_iter=1, sigma_digits=None, kind="validation")
    norm = residual_spectral_norm(m, one.components, max_iter=12, oversample=9).first()["norm"]
    assert norm == pytest.approx(359.602440, abs=0.05)


def test_ill_conditioned_matrix(spark):
    out = randomized_pca(line_columns(spark, SF_DIR), 4, max_iter=3, sigma_digits=None)
    np.testing.assert_allclose(out.sigma, [2334525.8625, 1124.6575, 2.2406, 1.8136], rtol=5e-5)


def test_rank_deficient_sketch(spark, coo):
    dense = planted(sigma=(9.0, 4.0))
    out = randomized_pca(coo(dense), 3, oversample=3, max_iter=3, sigma_digits=None)
    np.testing.assert_allclose(out.sigma, [9.0, 4.0, 0.0], atol=1e-7)
    assert {r["comp"] for r in out.components.collect()} == {0, 1}
    assert kth_singular_value(coo(dense), 3, oversample=2).first()["sigma"] == pytest.approx(0.0, abs=1e-6)


def test_zero_matrix(spark, coo):
    m = Matrix(coo([[1.0]]).entries.filter("false"), 6, 4)
    out = randomized_pca(m, 2, oversample=1, max_iter=3)
    assert out.sigma == [0.0, 0.0] and out.components.count() == 0


@pytest.mark.parametrize("layout", LAYOUTS)
def test_absent_rows_count(spark, coo, layout):
    dense = planted(noise=0.1)
    options = LAYOUTS[layout]
    m = coo(dense, n_rows=100)
    s = np.linalg.svd(centred(dense, 100), compute_uv=False)
    out = randomized_pca(m, 3, oversample=3, max_iter=4, sigma_digits=None, **options)
    np.testing.assert_allclose(out.sigma, s[:3], rtol=1e-5)


def test_absent_rows_in_qr_route(spark, coo):
    """Rows without entries also enter the distributed QR of an ill-conditioned sketch."""
    dense = planted(sigma=(1e7, 30.0, 1.0), n=40)
    s = np.linalg.svd(centred(dense, 50), compute_uv=False)
    out = randomized_pca(coo(dense, n_rows=50), 3, oversample=1, max_iter=3, sigma_digits=None)
    np.testing.assert_allclose(out.sigma[:3], s[:3], rtol=1e-5)


def test_partitioning_and_row_order_do_not_matter(spark, coo):
    m = coo(planted(noise=0.1))
    base = randomized_pca(m, 2, oversample=2, max_iter=2, sigma_digits=None).sigma
    shuffled = Matrix(m.entries.repartition(13, "value"), m.n_rows, m.n_cols)
    again = randomized_pca(shuffled, 2, oversample=2, max_iter=2, sigma_digits=None).sigma
    np.testing.assert_allclose(base, again, rtol=1e-10)


def test_permuted_rows_and_text_keys(spark, coo):
    m = coo(planted(noise=0.1))
    base = randomized_pca(m, 2, oversample=2, max_iter=2, sigma_digits=None).sigma
    renamed = m.entries.selectExpr("concat('r', 1000 - row_id) AS row_id", "col_id", "value")
    for options in (LAYOUTS["rows"], LAYOUTS["grid"]):
        again = randomized_pca(Matrix(renamed), 2, oversample=2, max_iter=2, sigma_digits=None, **options).sigma
        np.testing.assert_allclose(base, again, rtol=1e-10)


def test_hot_row_and_hot_column(spark):
    """A third of all entries in one row and a third in one column."""
    rng = np.random.default_rng(1)
    dense = np.zeros((300, 300))
    dense[7, :] = rng.normal(size=300)
    dense[:, 5] = rng.normal(size=300)
    extra = rng.integers(0, 300, size=(300, 2))
    dense[extra[:, 0], extra[:, 1]] = rng.normal(size=300)
    cells = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    m = Matrix(spark.createDataFrame(cells, "row_id bigint, col_id bigint, value double"), 300, 300)
    s = np.linalg.svd(centred(dense), compute_uv=False)
    with m.lay_out(7, broadcast_bytes=12_000, partitions=8) as placed:
        assert placed.kind == "grid"
        blocks = placed.entries.groupBy("rb", "cb").count().orderBy("count", ascending=False)
        assert blocks.first()["count"] < len(cells) / 8
        # The hot row adds to a block no more cells than the block has columns, and so does the column.
        hot = placed.entries.filter("row_id = 7").groupBy("rb", "cb").count().agg({"count": "max"}).first()[0]
        assert hot < 1.5 * 300 / placed.col_blocks
        hot = placed.entries.filter("col_id = 5").groupBy("rb", "cb").count().agg({"count": "max"}).first()[0]
        assert hot < 1.5 * 300 / placed.row_blocks
    out = randomized_pca(m, 2, oversample=5, max_iter=4, sigma_digits=None, broadcast_bytes=12_000, partitions=8)
    np.testing.assert_allclose(out.sigma, s[:2], rtol=1e-5)


def test_stops_when_sigma_repeats(spark, coo):
    out = randomized_pca(coo(planted()), 2, oversample=2, max_iter=30, sigma_digits=4)
    assert out.n_iter < 6
    assert out.metrics.count() == out.n_iter


def test_error_rule(spark, coo):
    dense = planted(noise=0.1)
    m = coo(dense)
    s = np.linalg.svd(centred(dense), compute_uv=False)
    out = randomized_pca(m, 2, oversample=2, max_iter=10, sigma_k1=s[2], tol=1e-3, norm_iter=10, norm_oversample=2)
    errors = [r["error"] for r in out.metrics.orderBy("iter").collect()]
    assert errors[-1] <= 1e-3 and all(e > 1e-3 for e in errors[:-1])


def test_width_is_checked(spark, coo):
    with pytest.raises(ValueError):
        randomized_pca(coo(planted()), 3, oversample=50)
    with pytest.raises(ValueError):
        kth_singular_value(coo(planted()), 0)


def test_kth_value_and_metrics(spark, coo):
    dense = planted(noise=0.2)
    s = np.linalg.svd(centred(dense), compute_uv=False)
    value, metrics = kth_singular_value_run(coo(dense), 3, oversample=3, max_iter=20, digits=4, kind="normal", seed=1)
    row = value.first()
    assert row["sigma"] == pytest.approx(s[2], abs=1e-3)
    assert metrics.count() == row["iterations"]


def test_residual_norm(spark, coo):
    dense = planted(noise=0.2)
    a = centred(dense)
    _, s, vt = np.linalg.svd(a)
    top = [(int(j), c, float(vt[c, j])) for c in range(2) for j in range(9)]
    v = spark.createDataFrame(top, "col_id bigint, comp int, loading double")
    m = coo(dense)
    assert residual_spectral_norm(m, v, max_iter=10, oversample=3).first()["norm"] == pytest.approx(s[2], abs=1e-3)
    error = relative_error(m, v, float(s[2]), max_iter=10, oversample=3).first()["error"]
    assert abs(error) < 1e-3
    # Used as it is, a vector that is not of unit length does not project.
    half = v.filter("comp = 0").selectExpr("col_id", "comp", "loading / 2 AS loading")
    b = a @ (np.eye(9) - np.outer(vt[0], vt[0]) / 4)
    given = residual_spectral_norm(m, half, max_iter=8, oversample=3, digits=None, orthonormalise_first=False)
    assert given.first()["norm"] == pytest.approx(np.linalg.norm(b, 2), rel=1e-5)


def em(a, k, rounds, c, ss):
    n, d = a.shape
    for _ in range(rounds):
        sx = np.linalg.inv(c.T @ c + ss * np.eye(k))
        m = c @ sx.T
        x = a @ m
        xtx = x.T @ x + ss * sx
        c = (a.T @ x) @ np.linalg.inv(xtx)
        ss = (np.sum(a * a) + np.trace(xtx @ c.T @ c) - 2 * np.sum(x * (a @ c))) / (n * d)
    error = np.abs(x @ c.T - a).sum(axis=0).max() / np.abs(a).sum(axis=0).max()
    return c, ss, error


@pytest.mark.parametrize("layout,n_rows", [("rows", 60), ("rows", 75), ("grid", 75)])
def test_probabilistic_pca(spark, coo, layout, n_rows):
    dense = planted(noise=0.5)
    seed = np.array([[(i + j) % 10 + 1 for j in range(2)] for i in range(9)], dtype=float)
    c, ss, error = em(centred(dense, n_rows), 2, 3, seed, 0.9644868606768501)
    options = {"rows": {}, "grid": {"broadcast_bytes": 500, "partitions": 8}}[layout]
    out = ppca(coo(dense, n_rows=n_rows), 2, max_iter=3, tol=0.0, err_tol=0.0, sample_rate=1.0, kind="validation", **options)
    assert out.variance == pytest.approx(ss, rel=1e-8)
    assert out.error == pytest.approx(error, rel=1e-8)
    np.testing.assert_allclose(loadings(out, 9, 2), c, rtol=1e-6, atol=1e-9)


def test_probabilistic_pca_on_vectors(spark):
    rows = embedding_rows(spark, SF_DIR)
    a = ppca(rows, 2, max_iter=2, kind="validation", sample_rate=1.0)
    b = ppca(embedding_vectors(spark, SF_DIR), 2, max_iter=2, kind="validation", sample_rate=1.0)
    assert a.variance == pytest.approx(b.variance, rel=1e-9)
    assert a.error == pytest.approx(b.error, rel=1e-9)


def test_sampled_error_is_close(spark):
    m = purchases(spark, SF_DIR).measured()
    full = ppca(m, 2, max_iter=1, kind="validation", sample_rate=1.0).error
    part = ppca(m, 2, max_iter=1, kind="validation", sample_rate=0.5).error
    assert part == pytest.approx(full, rel=0.3)


def test_vectors_of_uneven_length(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, [0.0, 1.0, 5.0, 9.0]), (2, [3.0, None, 1.0]), (3, [])], "row_id bigint, features array<double>"
    )
    with pytest.raises(Exception, match="longer than the matrix is wide"):
        randomized_pca(VectorMatrix(rows, 4, 3), 2, oversample=1, max_iter=1)
    dense = np.array([[1, 2, 0, 0], [0, 1, 5, 9], [3, 0, 1, 0], [0, 0, 0, 0]], dtype=float)
    s = np.linalg.svd(centred(dense), compute_uv=False)
    out = randomized_pca(VectorMatrix(rows, 4, 4), 2, oversample=1, max_iter=3, sigma_digits=None)
    np.testing.assert_allclose(out.sigma, s[:2], rtol=1e-9)


def test_as_many_components_as_columns(spark, coo):
    dense = np.random.default_rng(2).normal(size=(20, 4))
    s = np.linalg.svd(centred(dense), compute_uv=False)
    out = randomized_pca(coo(dense), 4, sigma_digits=None, max_iter=3)
    np.testing.assert_allclose(out.sigma, s, rtol=1e-9)
    assert kth_singular_value(coo(dense), 4).first()["sigma"] == pytest.approx(s[3], abs=1e-4)
    checked = randomized_pca(coo(dense), 3, sigma_k1=float(s[3]), tol=0.01, max_iter=4)  # the error rule's width fits, too
    assert checked.metrics.count() >= 1


def test_no_error_job_unless_asked(spark, coo):
    dense = np.random.default_rng(3).normal(size=(12, 5))
    assert ppca(coo(dense), 2, max_iter=2, kind="validation").error is None


def test_sampled_error_counts_zero_rows_once(spark, coo):
    dense = np.random.default_rng(4).normal(size=(40, 4)).round(3)
    dense[::2] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(dense)], "row_id bigint, features array<double>")
    a = ppca(VectorMatrix(rows, 40, 4), 2, max_iter=1, kind="validation", sample_rate=1.0)
    b = ppca(coo(dense, n_rows=40), 2, max_iter=1, kind="validation", sample_rate=1.0)
    assert a.error == pytest.approx(b.error, rel=1e-9)
    assert 0 < ppca(VectorMatrix(rows, 40, 4), 2, max_iter=1, kind="validation", sample_rate=0.9).error < 3


def test_partitions_follow_the_entries(spark, coo):
    from rankfold.matrix import ENTRY_BYTES, PARTITION_BYTES

    m = Matrix(coo([[1.0]]).entries, 10**7, 10**5, n_entries=10**12)
    assert m.lay_out(8).partitions * PARTITION_BYTES >= 10**12 * ENTRY_BYTES
    assert coo([[1.0, 0.0], [2.0, 3.0]]).measured().n_entries is None  # both dimensions were given
    assert Matrix(coo([[1.0, 0.0], [2.0, 3.0]]).entries).measured().n_entries == 3


def test_entries_outside_are_an_error(spark, coo):
    entries = coo([[1.0, 2.0, 3.0]]).entries
    with pytest.raises(Exception, match="outside the matrix"):
        Matrix(entries, 1, 2).clean().collect()
    assert Matrix(entries, 1, 2, drop_outside=True).clean().count() == 2


def test_vectors_too_wide_fall_back_to_entries(spark):
    m = embedding_vectors(spark, SF_DIR).measured()
    with m.lay_out(4, broadcast_bytes=1000) as placed:
        assert placed.kind == "grid"
