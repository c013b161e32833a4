"""Times the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession

from rankfold import Matrix, kth_singular_value, ppca, randomized_pca, residual_spectral_norm
from rankfold.catalog.fixtures import embedding_vectors, purchases, table
from rankfold.catalog.queries import REGISTRY


def sized_purchases(spark: SparkSession, sf_dir: str) -> Matrix:
    """Dimensions from the customer and part tables, which saves the measuring pass."""
    n_rows, n_cols = table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "part").count()
    return Matrix(purchases(spark, sf_dir).entries, n_rows, n_cols)


def pca_1_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix and one iteration of width 8."""
    return randomized_pca(sized_purchases(spark, sf_dir), 3, max_iter=1, sigma_digits=None, kind="validation").sigmas


def pca_5_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomized_pca(sized_purchases(spark, sf_dir), 3, max_iter=5, sigma_digits=None, kind="validation").sigmas


def pca_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomized_pca(embedding_vectors(spark, sf_dir), 3, max_iter=5, sigma_digits=None, kind="validation").sigmas


def kth_sigma_5_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kth_singular_value(sized_purchases(spark, sf_dir), 3, max_iter=5, digits=None, seed=1)


def residual_5_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sized_purchases(spark, sf_dir)
    v = REGISTRY["components_roundtrip"](spark, sf_dir)
    return residual_spectral_norm(m, v, k=2, max_iter=5, digits=None)


def ppca_3_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppca(sized_purchases(spark, sf_dir), 3, kind="validation").components


HEADLINES = {
    f.__name__: f
    for f in (pca_1_iteration, pca_5_iterations, pca_embeddings, kth_sigma_5_rounds, residual_5_rounds, ppca_3_rounds)
} | {
    name: REGISTRY[name]
    for name in (
        "coo_from_orders", "coo_roundtrip", "col_means", "frobenius_norm", "sketch_raw", "gram_centred", "cross_centred",
        "tsqr_r", "project_validation", "absolute_column_norm",
    )
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankfold-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    pca_1_iteration(spark, sf_dir).collect()  # start-up and first compilation are not part of a query
    seconds = {}
    for name, run in HEADLINES.items():
        began = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
