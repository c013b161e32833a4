"""Named queries over the relational tables, one or more per operator.

Each takes ``(spark, sf_dir)`` and returns a DataFrame. Inexact results are rounded far above the
error of summing doubles in another order. The SQL to compare with is in ``oracles.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import names
from ..functions.generators import seed_table
from ..functions.session import kept, scratch_path
from ..matrix import Matrix
from ..operators import aggregates, basis, entries, products
from ..operators.tsqr import tsqr_table
from ..plans import kth_singular_value, ppca, project, randomized_pca, relative_error, relative_reconstruction_error, residual_spectral_norm
from ..plans.ppca import column_error_sums, expected_variance_term, largest_column_error
from ..sinks import stats, text
from ..sources import from_rdd, from_row_matrix, from_vectors, read_components, read_coo, read_dense, read_matrix
from .fixtures import LINE_COLUMNS, embedding_rows, embedding_vectors, line_columns, purchases, table, user_events

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(name: str, digits: int, scale: float = 1.0) -> Column:
    value = F.col(name) if scale == 1.0 else F.col(name) / scale
    return (F.round(value, digits) + F.lit(0.0)).alias(name)  # + 0.0 turns -0.0 into 0.0


def validation(spark: SparkSession, n_cols: int, width: int, prefix: str = "w") -> DataFrame:
    return seed_table(spark, n_cols, width, "validation", prefix=prefix)


def stored_purchases(spark: SparkSession, sf_dir: str) -> Matrix:
    """The purchases, joined and summed once for a query that uses them several times."""
    return purchases(spark, sf_dir).stored().measured()


def kept_purchases(spark: SparkSession, sf_dir: str) -> Matrix:
    """The purchases with every cell, joined and summed once: an analysis reads them to measure and again to place them."""
    m = purchases(spark, sf_dir)
    return replace(m, entries=kept(m.entries, "purchases"))


def sketched(spark: SparkSession, sf_dir: str, width: int) -> tuple[Matrix, DataFrame, DataFrame, np.ndarray]:
    """Purchases, the validation seed, the column means and the mean image."""
    m = stored_purchases(spark, sf_dir)
    w = validation(spark, m.n_cols, width)
    mu = aggregates.column_means(m.entries, m.n_rows)
    return m, w, mu, products.collect_row(products.mean_image(mu, w, names("w", width)))


# Sources: tables


@query
def coo_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases(spark, sf_dir).entries


@query
def dense_to_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_rows(spark, sf_dir).entries


@query
def columns_to_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_columns(spark, sf_dir).entries


@query
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events(spark, sf_dir).entries


@query
def ml_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    return from_vectors(rows, "vec_id", "v").entries


@query
def stored_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "matrix")
    purchases(spark, sf_dir).stored(path)
    return read_matrix(spark, path).entries


@query
def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    return m.entries.agg(F.count("*").alias("nnz")).withColumns(
        {"n_rows": F.lit(m.n_rows).cast("bigint"), "n_cols": F.lit(m.n_cols).cast("bigint")}
    )


# Sources and sinks: text


@query
def coo_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-based coordinate text with repeated cells, zeros and columns above the cap."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_partkey") + 1, F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity"))
    )
    path = scratch_path(spark, "coo")
    lines.write.csv(path)
    return read_coo(spark, path, base=1, max_col=1000, dup="sum").entries


@query
def coo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "coo")
    text.write_matrix(purchases(spark, sf_dir).entries, path, "COO")
    return read_coo(spark, path, base=0).entries


@query
def dense_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "dense")
    m = embedding_rows(spark, sf_dir).measured()
    text.write_matrix(m.entries, path, "DENSE", n_cols=m.n_cols)
    return read_dense(spark, path).select("row_id", F.posexplode("features").alias("col_id", "value"))


@query
def dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_events(spark, sf_dir).measured()
    return text.dense_lines(m.entries, m.n_cols)


@query
def lil_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, also those who bought nothing."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"))
    return text.lil_lines(purchases(spark, sf_dir).entries, rows)


@query
def components_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("col_id"), F.col("p_size").cast("double").alias("v0"), F.col("p_retailprice").alias("v1"))
    path = scratch_path(spark, "components")
    text.write_components(products.long_components(part, ["v0", "v1"]), path)
    return read_components(spark, path)


@query
def projection_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "projection")
    text.write_projection(project_validation(spark, sf_dir), path)
    return spark.read.parquet(path)


@query
def run_metrics_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken as iteration records: written, read back and averaged per run."""
    events = table(spark, sf_dir, "events")
    records = events.select(
        F.col("event_type").alias("app"),
        F.col("user_id").cast("string").alias("dataset"),
        F.lit(0).cast("bigint").alias("n_rows"),
        F.lit(0).cast("bigint").alias("n_cols"),
        F.col("event_id").cast("int").alias("iter"),
        F.lit(0.0).alias("preprocess_sec"),
        F.col("value").alias("sketch_sec"),
        F.lit(None).cast("double").alias("error"),
        F.lit(None).cast("double").alias("k_sigma"),
    )
    path = scratch_path(spark, "metrics")
    stats.write_metrics(records, path)
    averages = stats.run_averages(stats.read_metrics(spark, path))
    return averages.select("app", "dataset", rounded("avg_sketch_sec", 6), rounded("total_sketch_sec", 6), "n_iter")


# Entries and rows


@query
def in_range_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").cast("bigint").alias("col_id"), F.col("l_discount").alias("value")
    )
    return entries.drop_out_of_range(lines, 6)


@query
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.sample_rows(purchases(spark, sf_dir).entries, 0.1, seed=3)


@query
def sampled_rows_modular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.sample_rows_modular(purchases(spark, sf_dir).entries, 0.1)


@query
def sampled_rows_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly a hundred of the customers, all their entries."""
    return entries.sample_exact(purchases(spark, sf_dir).entries, 100, seed=3)


@query
def centred_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    out = entries.centre_entries(m.entries, aggregates.column_means(m.entries, m.n_rows))
    return out.select("row_id", "col_id", rounded("value", 6))


@query
def centred_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_events(spark, sf_dir).measured()
    out = entries.centre_dense(m.entries, aggregates.column_means(m.entries, m.n_rows), m.n_cols)
    return out.select("row_id", "col_id", rounded("value", 6))


# Aggregates


@query
def col_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    sums = aggregates.column_sums(m.entries)
    means = aggregates.column_means(m.entries, m.n_rows)
    return sums.join(means, "col_id").select("col_id", "total", rounded("mu", 8))


@query
def frobenius_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    norm = aggregates.frobenius_norm_squared(m.entries, aggregates.column_means(m.entries, m.n_rows), m.n_rows)
    return norm.select(rounded("norm2", 4))


@query
def frobenius_norm_absent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many rows as are stored: the others are zero, but count."""
    m = stored_purchases(spark, sf_dir)
    n = 2 * m.n_rows
    norm = aggregates.frobenius_norm_squared(m.entries, aggregates.column_means(m.entries, n), n)
    return norm.select(rounded("norm2", 4))


@query
def mean_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    mu = aggregates.column_means(m.entries, m.n_rows)
    image = products.mean_image(mu, validation(spark, m.n_cols, 3), names("w", 3))
    return image.select(*[rounded(c, 6) for c in names("m", 3)])


@query
def sketch_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    return products.sketch(m.entries, validation(spark, m.n_cols, 3), names("w", 3))


@query
def sketch_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More components than one aggregate takes, so they are handled in blocks."""
    m = stored_purchases(spark, sf_dir)
    return products.sketch(m.entries, validation(spark, m.n_cols, 18), names("w", 18)).select("row_id", "z0", "z9", "z16", "z17")


@query
def gram_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.gram(sketch_raw(spark, sf_dir), names("z", 3)).select("i", "j", "g")


@query
def gram_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gram matrix of the embeddings through Arrow batches."""
    vectors = table(spark, sf_dir, "embeddings")
    length = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = vectors.select(*[F.coalesce(F.get("embedding", F.lit(j)).cast("double"), F.lit(0.0)).alias(f"e{j}") for j in range(length)])
    return aggregates.gram(rows, names("e", length)).select("i", "j", rounded("g", 6))


@query
def cross_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    z = products.sketch(m.entries, validation(spark, m.n_cols, 3), names("w", 3))
    return products.cross_product(m.entries, z, names("z", 3))


@query
def sketch_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.vector_sum(sketch_raw(spark, sf_dir), names("z", 3))


@query
def sketch_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w, _, mean = sketched(spark, sf_dir, 3)
    z = products.centre_sketch(products.sketch(m.entries, w, names("w", 3)), names("z", 3), mean)
    return z.select("row_id", *[rounded(c, 5) for c in names("z", 3)])


@query
def gram_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w, _, mean = sketched(spark, sf_dir, 3)
    z = products.sketch(m.entries, w, names("w", 3))
    g = aggregates.centred_gram(z, names("z", 3), mean, m.n_rows)
    return g.select("i", "j", rounded("g", 4, m.n_rows))


@query
def cross_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w, mu, mean = sketched(spark, sf_dir, 3)
    z = products.sketch(m.entries, w, names("w", 3))
    sums = products.collect_row(aggregates.vector_sum(z, names("z", 3)))
    centred = products.centre_sketch(z, names("z", 3), mean)
    c = products.mean_correction(products.cross_product(m.entries, centred, names("z", 3)), names("c", 3), mu, sums, mean, m.n_rows)
    return c.select("col_id", *[rounded(x, 3) for x in names("c", 3)])


@query
def mean_corrected_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean part of A' for an uncentred sketch, where it does not vanish."""
    m, w, mu, _ = sketched(spark, sf_dir, 2)
    z = products.sketch(m.entries, w, names("w", 2))
    sums = products.collect_row(aggregates.vector_sum(z, names("z", 2)))
    c = products.cross_product(m.entries, z, names("z", 2))
    c = products.mean_correction(c, names("c", 2), mu, sums, np.zeros(2), m.n_rows)
    return c.select("col_id", *[rounded(x, 3) for x in names("c", 2)])


@query
def absolute_column_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.absolute_norm_of_columns(table(spark, sf_dir, "lineitem"), LINE_COLUMNS).select(rounded("norm1", 1))


@query
def absolute_entry_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1-norm from entries."""
    m = user_events(spark, sf_dir).measured()
    centred = entries.centre_entries(m.entries, aggregates.column_means(m.entries, m.n_rows))
    return aggregates.absolute_column_norm(centred).select(rounded("norm1", 4))


@query
def embedding_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return aggregates.array_sum(rows, "v").select("pos", rounded("total", 6))


@query
def matrix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of one small matrix per embedding: the vector and twice its reverse."""
    v = F.col("embedding").cast("array<double>")
    twice = F.transform(F.reverse(v), lambda x: x * 2)
    return aggregates.array_sum(table(spark, sf_dir, "embeddings").select(F.array(v, twice).alias("m")), "m").select("row", "pos", rounded("total", 6))


# Factorisations


@query
def tsqr_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w, _, mean = sketched(spark, sf_dir, 3)
    z = products.centre_sketch(products.sketch(m.entries, w, names("w", 3)), names("z", 3), mean)
    return tsqr_table(z, names("z", 3)).select(*[rounded(c, 4) for c in names("r", 3)])


@query
def orthonormal_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w, _, mean = sketched(spark, sf_dir, 2)
    z = products.centre_sketch(products.sketch(m.entries, w, names("w", 2)), names("z", 2), mean)
    r = np.zeros((2, 2))
    for i, j, g in aggregates.gram(z, names("z", 2)).select("i", "j", "g").collect():  # 3 numbers
        r[i, j] = r[j, i] = g
    b = products.orthonormal_image(m.entries, w, names("w", 2), mean, np.linalg.inv(np.linalg.cholesky(r).T))
    return b.select("col_id", *[rounded(c, 6) for c in names("b", 2)])


@query
def deflated_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = stored_purchases(spark, sf_dir).n_cols
    v = validation(spark, n, 4, "v").select("col_id", (F.col("v3") / 100.0).alias("v0"))
    return basis.deflate(validation(spark, n, 2), names("w", 2), v, ["v0"]).select("col_id", rounded("w0", 6), rounded("w1", 6))


@query
def deflated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and prices of the parts without their share along the direction of equal prices and sizes."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("col_id"), F.col("p_size").cast("double").alias("w0"), F.col("p_retailprice").alias("w1")
    )
    length = part.agg(F.sqrt(F.sum((F.col("w0") + F.col("w1")) * (F.col("w0") + F.col("w1"))))).first()[0]
    v = part.select("col_id", ((F.col("w0") + F.col("w1")) / F.lit(length)).alias("v0"))
    return basis.deflate(part, ["w0", "w1"], v, ["v0"]).select("col_id", rounded("w0", 6), rounded("w1", 6))


@query
def orthonormalise_cholesky(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("col_id"), F.col("p_size").cast("double").alias("v0"), F.col("p_retailprice").alias("v1"))
    u = basis.orthonormalise(part, ["v0", "v1"], "cholesky")
    return u.select("col_id", rounded("u0", 8), rounded("u1", 8))


@query
def orthonormalise_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("col_id"), F.col("p_size").cast("double").alias("v0"), F.col("p_retailprice").alias("v1"))
    u = basis.fix_signs(products.long_components(basis.orthonormalise(part, ["v0", "v1"]), ["u0", "u1"]))
    return u.select("col_id", "comp", rounded("loading", 7))


@query
def kth_column_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third largest of a column of values."""
    totals = aggregates.column_sums(user_events(spark, sf_dir).entries).select(F.col("col_id").alias("comp"), F.col("total").alias("sigma"))
    return basis.kth_value(totals, 3)


@query
def leading_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basis.leading_components(components_roundtrip(spark, sf_dir), 1)


@query
def seed_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation(spark, table(spark, sf_dir, "part").count(), 10)


@query
def seed_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = seed_table(spark, table(spark, sf_dir, "part").count(), 4, "normal", seed=7)
    return drawn.select("col_id", *[rounded(c, 9) for c in names("w", 4)])


@query
def sketch_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchases times drawn normal numbers."""
    m = stored_purchases(spark, sf_dir)
    z = products.sketch(m.entries, seed_table(spark, m.n_cols, 2, "normal", seed=7), names("w", 2))
    return z.select("row_id", *[rounded(c, 6) for c in names("z", 2)])


@query
def seed_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = seed_table(spark, table(spark, sf_dir, "part").count(), 4, "uniform", seed=7)
    return drawn.select("col_id", *[rounded(c, 12) for c in names("w", 4)])


# Analyses


def _power(spark: SparkSession, sf_dir: str, k: int, steps: int) -> DataFrame:
    out = kth_singular_value(kept_purchases(spark, sf_dir), k, oversample=0, max_iter=steps, digits=None, kind="validation")
    return out.select("k", rounded("sigma", 5), "iterations")


@query
def power_step_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _power(spark, sf_dir, 1, 1)


@query
def power_3_steps_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _power(spark, sf_dir, 1, 3)


@query
def power_3_steps_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _power(spark, sf_dir, 2, 3)


@query
def power_3_steps_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kth_singular_value(embedding_vectors(spark, sf_dir), 2, oversample=0, max_iter=3, digits=None, kind="validation")
    return out.select("k", rounded("sigma", 6), "iterations")


@query
def sketch_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    with embedding_vectors(spark, sf_dir).lay_out(3) as layout:
        z = layout.sketch(validation(spark, layout.n_cols, 3), names("w", 3))
    return z.select("row_id", *[rounded(c, 6) for c in names("z", 3)])


@query
def pca_component_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = randomized_pca(kept_purchases(spark, sf_dir), 1, oversample=0, max_iter=3, sigma_digits=None, kind="validation")
    return out.components.select("col_id", "comp", rounded("loading", 7))


@query
def pca_sigmas_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = randomized_pca(kept_purchases(spark, sf_dir), 2, oversample=0, max_iter=4, sigma_digits=None, kind="validation")
    return out.sigmas.select("comp", rounded("sigma", 5))


@query
def pca_absent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many empty rows again as there are stored ones."""
    m = stored_purchases(spark, sf_dir)
    m = Matrix(m.entries, 2 * m.n_rows, m.n_cols, m.n_entries)
    out = randomized_pca(m, 2, oversample=0, max_iter=2, sigma_digits=None, kind="validation")
    return out.sigmas.select("comp", rounded("sigma", 5))


def _unit_component(spark: SparkSession, n_cols: int) -> DataFrame:
    """The fourth validation column as a unit vector."""
    v = validation(spark, n_cols, 4, "v").select("col_id", F.col("v3").alias("v0"))
    norm = float(np.sqrt(v.agg(F.sum(F.col("v0") * F.col("v0"))).first()[0]))
    return v.select("col_id", F.lit(0).alias("comp"), (F.col("v0") / norm).alias("loading"))


@query
def residual_norm_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    out = residual_spectral_norm(m, _unit_component(spark, m.n_cols), k=1, max_iter=3, oversample=0, digits=None, kind="validation")
    return out.select(rounded("norm", 5), "iterations")


@query
def residual_norm_as_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector that is not a unit vector, used as it is."""
    m = stored_purchases(spark, sf_dir)
    v = _unit_component(spark, m.n_cols).withColumn("loading", F.col("loading") * 0.5)
    out = residual_spectral_norm(m, v, k=1, max_iter=2, oversample=0, digits=None, orthonormalise_first=False, kind="validation")
    return out.select(rounded("norm", 5), "iterations")


@query
def relative_error_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    out = relative_error(m, _unit_component(spark, m.n_cols), 350.0, k=1, max_iter=3, oversample=0, digits=None, kind="validation")
    return out.select(rounded("norm", 5), "sigma_k1", rounded("error", 8))


@query
def project_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    c = products.long_components(validation(spark, m.n_cols, 2), names("w", 2))
    return products.project(m.entries, c, 2)


@query
def project_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, w, _, mean = sketched(spark, sf_dir, 2)
    return products.project(m.entries, products.long_components(w, names("w", 2)), 2, mean).select("row_id", "comp", rounded("score", 5))


@query
def reconstruct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_events(spark, sf_dir).measured()
    c = validation(spark, m.n_cols, 2)
    x = products.sketch(m.entries, c, names("w", 2))
    return products.reconstruct(x, names("z", 2), c, names("w", 2), m.n_rows, m.n_cols)


@query
def residual_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X*C' - Y - z with z the column means."""
    m = user_events(spark, sf_dir).measured()
    mu = aggregates.column_means(m.entries, m.n_rows).withColumnRenamed("mu", "shift")
    out = products.residual_cells(reconstruct_events(spark, sf_dir), m.entries, mu)
    return out.select("row_id", "col_id", rounded("value", 6))


@query
def reconstruction_error_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column sums of |X*C' - A| and |A| for validation matrices, over all rows of the purchases."""
    m, w, mu, mean = sketched(spark, sf_dir, 2)
    fitted = w.join(mu, "col_id").selectExpr(
        "col_id", "mu", "w0 / 977.0D AS w0", "w1 / 977.0D AS w1", "w0 / 13.0D AS v0", "w1 / 13.0D AS v1"
    )
    with m.lay_out(3) as layout:
        out = column_error_sums(layout, fitted, 2, mean / 977.0)
    return out.select("col_id", rounded("err", 4), rounded("norm", 4))


def _ppca(spark: SparkSession, sf_dir: str):
    return ppca(kept_purchases(spark, sf_dir), 1, max_iter=2, tol=0.0, kind="validation")


@query
def ppca_variance_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _ppca(spark, sf_dir)
    return out.metrics.select(F.max("iter").alias("last")).select((F.lit(out.variance)).alias("variance"), (F.col("last") + 1).alias("rounds")).select(rounded("variance", 7), "rounds")


@query
def ppca_component_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ppca(spark, sf_dir).components.select("col_id", "comp", rounded("loading", 5))


@query
def variance_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over rows of x . (y - mu)C for x = yW and C = Y'X, from the inner products of Y'X."""
    m, w, _, mean = sketched(spark, sf_dir, 2)
    z = products.centre_sketch(products.sketch(m.entries, w, names("w", 2)), names("z", 2), mean)
    c = products.cross_product(m.entries, z, names("z", 2))
    h = aggregates.product_matrix(aggregates.column_products(c, [("c0", "c0"), ("c0", "c1"), ("c1", "c1")]), names("c", 2), names("c", 2))
    return aggregates.vector_sum(c, names("c", 2)).select((F.lit(expected_variance_term(np.eye(2), h)) / 1e12).alias("term")).select(rounded("term", 3))


@query
def randomized_pca_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = randomized_pca(kept_purchases(spark, sf_dir), 5, oversample=5, max_iter=5, sigma_digits=None, seed=11)
    return out.components.select("col_id", "comp", rounded("loading", 6))


@query
def embedding_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = randomized_pca(embedding_vectors(spark, sf_dir), 8, oversample=8, max_iter=10, sigma_digits=None, seed=11)
    return out.sigmas.select("comp", rounded("sigma", 4))


@query
def line_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but one singular value of an ill-conditioned narrow matrix."""
    out = randomized_pca(line_columns(spark, sf_dir), 3, oversample=1, max_iter=3, sigma_digits=None, seed=11)
    return out.sigmas.select("comp", rounded("sigma", 3))


@query
def kth_sigma_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kth_singular_value(embedding_vectors(spark, sf_dir), 3, oversample=13, max_iter=50, digits=3, seed=11)
    return out.select("k", rounded("sigma", 3))


@query
def kth_sigma_lines_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third singular value of a matrix of four columns, whose sketch is exact."""
    out = kth_singular_value(line_columns(spark, sf_dir), 3, oversample=1, max_iter=5, digits=3, seed=11)
    return out.select("k", rounded("sigma", 3))


@query
def pca_error_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next singular value first, then iterations that stop on the error relative to it."""
    m = user_events(spark, sf_dir).measured()
    target = kth_singular_value(m, 3, oversample=2, seed=11).first()["sigma"]
    out = randomized_pca(m, 2, oversample=2, max_iter=20, sigma_k1=target, tol=0.001, norm_iter=20, norm_oversample=2, seed=11)
    return out.metrics.select("app", "n_rows", "n_cols", "iter", rounded("k_sigma", 3), rounded("error", 3))


@query
def ppca_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ppca(kept_purchases(spark, sf_dir), 3, max_iter=3, seed=11)
    return out.components.select("col_id", "comp", rounded("loading", 5))


# Cases beyond the happy path


@query
def event_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many components as columns: the sums of sigma^2 and sigma^4 are traces of the Gram matrix and its square."""
    m = user_events(spark, sf_dir).measured()
    sigmas = randomized_pca(m, m.n_cols, oversample=0, max_iter=3, sigma_digits=None, kind="normal", seed=3).sigmas
    two, four = F.sum(F.col("sigma") ** 2), F.sum(F.col("sigma") ** 4)
    return sigmas.agg(F.count("*").alias("n_sigma"), F.round(two, 3).alias("trace"), F.round(four / 1000, 2).alias("trace_of_square"))


@query
def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse ML vectors of the purchases: only stored cells are touched."""
    cells = purchases(spark, sf_dir).clean().groupBy("row_id")
    width = table(spark, sf_dir, "part").count()
    pairs = cells.agg(F.array_sort(F.collect_list(F.struct("col_id", "value"))).alias("cells"))
    assembled = pairs.select("row_id", F.col("cells.col_id").cast("array<int>").alias("i"), F.col("cells.value").alias("x"))

    from pyspark.ml.linalg import SparseVector, VectorUDT

    sparse = F.udf(lambda i, x: SparseVector(width, i, x), VectorUDT())  # only builds the input
    return from_vectors(assembled.select("row_id", sparse("i", "x").alias("v")), "row_id", "v").entries


@query
def kth_of_too_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th largest of fewer than k values is NULL."""
    totals = aggregates.column_sums(user_events(spark, sf_dir).entries).select(F.col("col_id").alias("comp"), F.col("total").alias("sigma"))
    return basis.kth_value(totals, 99)


@query
def projection_lil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection as list-of-lists text: rows whose scores are all zero keep their line."""
    m = user_events(spark, sf_dir)
    scores = m.entries.where("col_id < 2").select("row_id", F.col("col_id").cast("int").alias("comp"), F.when(F.col("value") > 30, F.col("value")).otherwise(0.0).alias("score"))
    path = scratch_path(spark, "projection")
    text.write_projection(scores, path, "LIL", k=2)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


def _placed_sketch(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    m = purchases(spark, sf_dir).measured()
    with m.lay_out(3, **options) as layout:
        z = layout.sketch(validation(spark, layout.n_cols, 3), names("w", 3))
        path = scratch_path(spark, "sketch")
        z.write.parquet(path)  # while Y is placed
    return spark.read.parquet(path).select("row_id", *names("z", 3))


@query
def sketch_rows_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product as the analyses compute it, Y partitioned by rows."""
    return _placed_sketch(spark, sf_dir)


@query
def sketch_grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the grid, which serves operands too large to broadcast."""
    return _placed_sketch(spark, sf_dir, broadcast_bytes=20_000)


# Projections, placed; reconstruction errors


def _projection(spark: SparkSession, m, **options) -> DataFrame:
    m = m.measured()
    c = products.long_components(validation(spark, m.n_cols, 2), names("w", 2))
    return project(m, c, 2, centred=True, **options).select("row_id", "comp", rounded("score", 5))


@query
def project_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred scores with broadcast components."""
    return _projection(spark, purchases(spark, sf_dir).stored())


@query
def project_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with components that count as too large to broadcast."""
    return _projection(spark, purchases(spark, sf_dir).stored(), broadcast_bytes=10_000)


@query
def project_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, embedding_vectors(spark, sf_dir))


@query
def reconstruction_error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest column sums of |X*C' - A| and |A| for validation matrices, and their ratio."""
    m, w, mu, mean = sketched(spark, sf_dir, 2)
    fitted = w.join(mu, "col_id").selectExpr(
        "col_id", "mu", "w0 / 977.0D AS w0", "w1 / 977.0D AS w1", "w0 / 13.0D AS v0", "w1 / 13.0D AS v1"
    )
    with m.lay_out(4) as layout:
        found = largest_column_error(layout, fitted, 2, mean / 977.0)
    return spark.createDataFrame([(found.error, found.norm, found.ratio)], "err double, norm double, ratio double").select(
        rounded("err", 4), rounded("norm", 4), rounded("ratio", 8)
    )


def _lost(spark: SparkSession, m) -> DataFrame:
    """Relative error of the projection on one unit direction."""
    m = m.measured()
    v = validation(spark, m.n_cols, 1)
    length = float(v.agg(F.sqrt(F.sum(F.col("w0") * F.col("w0")))).first()[0])
    c = v.select("col_id", F.lit(0).alias("comp"), (F.col("w0") / F.lit(length)).alias("loading"))
    found = relative_reconstruction_error(m, c, 1)
    return spark.createDataFrame([(found.error, found.norm, found.ratio)], "err double, norm double, ratio double").select(
        rounded("err", 4), rounded("norm", 4), rounded("ratio", 8)
    )


@query
def reconstruction_error_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lost(spark, purchases(spark, sf_dir).stored())


@query
def reconstruction_error_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lost(spark, embedding_vectors(spark, sf_dir))


# More sources


@query
def rdd_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as an RDD of number lists, numbered by place."""
    vectors = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").rdd.map(lambda r: list(r[0]))
    return from_rdd(spark, vectors).entries


@query
def row_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchases through an indexed distributed matrix of sparse vectors."""
    from pyspark.mllib.linalg import SparseVector
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    m = stored_purchases(spark, sf_dir)
    width = m.n_cols
    rows = m.entries.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("col_id", "value"))).alias("cells")).rdd
    indexed = rows.map(lambda r: IndexedRow(r[0], SparseVector(width, [c[0] for c in r[1]], [c[1] for c in r[1]])))
    return from_row_matrix(IndexedRowMatrix(indexed)).entries


@query
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row vectors written as a table of (row_id, features) and read back."""
    path = scratch_path(spark, "vectors")
    embedding_vectors(spark, sf_dir).rows.write.parquet(path)
    return read_matrix(spark, path).entries


# Products on free tables with hot ids


@query
def sketch_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by event types: each of the five columns is hot, so all entries are dealt over salts."""
    m = user_events(spark, sf_dir).measured()
    return products.sketch(m.entries, validation(spark, m.n_cols, 3), names("w", 3), spread=True)


@query
def cross_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stored_purchases(spark, sf_dir)
    z = products.sketch(m.entries, validation(spark, m.n_cols, 3), names("w", 3))
    return products.cross_product(m.entries, z, names("z", 3), spread=True)
