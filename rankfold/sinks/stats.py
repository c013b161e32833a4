"""Run statistics: one record per iteration, appended to a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import local_table

METRICS_SCHEMA = (
    "app string, dataset string, n_rows bigint, n_cols bigint, iter int, preprocess_sec double, "
    "sketch_sec double, error double, k_sigma double"
)


def metrics_table(spark: SparkSession, records: Iterable[tuple]) -> DataFrame:
    """The metrics of one run (as many rows as it had iterations)."""
    return local_table(spark, list(records), METRICS_SCHEMA)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    """Append run statistics, as json or parquet."""
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unknown format {fmt!r}, use 'json' or 'parquet'")
    metrics.write.mode("append").format(fmt).save(path)


def read_metrics(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).format(fmt).load(path)


def run_averages(metrics: DataFrame) -> DataFrame:
    """Per run: total, number and average of the iteration times (NULL-safe for a run without any)."""
    return metrics.groupBy("app", "dataset").agg(
        F.avg("sketch_sec").alias("avg_sketch_sec"),
        F.sum("sketch_sec").alias("total_sketch_sec"),
        F.count("sketch_sec").alias("n_iter"),
    )


def run_report(metrics: DataFrame) -> DataFrame:
    """``[app, dataset, value]``: the statistics of a run as a block of text lines.

    The lists hold one number per iteration of the run.
    """
    per_iter = F.array_sort(F.collect_list(F.struct("iter", "sketch_sec", "error")))
    runs = metrics.groupBy("app", "dataset", "n_rows", "n_cols").agg(
        F.coalesce(F.sum("sketch_sec"), F.lit(0.0)).alias("sketch_total"),
        F.avg("sketch_sec").alias("sketch_avg"),
        F.coalesce(F.max("preprocess_sec"), F.lit(0.0)).alias("preprocess"),
        F.count("iter").alias("n_iter"),
        F.max_by("k_sigma", "iter").alias("k_sigma"),
        per_iter.alias("steps"),
    )

    def text_list(field: str):
        present = F.filter("steps", lambda s: s[field].isNotNull())
        return F.concat(F.lit("["), F.array_join(F.transform(present, lambda s: s[field].cast("string")), ", "), F.lit("]"))

    def line(label: str, value) -> object:
        return F.concat(F.lit(label), value)

    sigma = F.when(F.coalesce("k_sigma", F.lit(0.0)) != 0, line("K Singular Value", F.col("k_sigma").cast("string")))
    # The labels of the report.
    lines = [
        line("App Name: ", F.col("app")),
        line("Dataset Name: ", F.col("dataset")),
        F.concat(F.lit("Dimensions: Rows: "), F.col("n_rows").cast("string"), F.lit(" Cols: "), F.col("n_cols").cast("string")),
        line("Total Runtime: ", (F.col("preprocess") + F.col("sketch_total")).cast("string")),
        line("Preprocess Time: ", F.col("preprocess").cast("string")),
        line("Average PPCA Time: ", F.coalesce(F.col("sketch_avg").cast("string"), F.lit("none"))),
        line("Sketch each iteration time: ", text_list("sketch_sec")),
        line("Total Iterations: ", F.col("n_iter").cast("string")),
        sigma,
        line("Errors in each iteration: ", text_list("error")),
        F.lit("******"),
    ]
    return runs.select("app", "dataset", F.concat_ws("\n", *lines).alias("value"))


def write_report(metrics: DataFrame, path: str) -> None:
    """Append the text report of each run."""
    run_report(metrics).select("value").write.mode("append").text(path)
