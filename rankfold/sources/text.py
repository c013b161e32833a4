"""Matrices and component tables from text files (a file or a directory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import kept
from ..matrix import Matrix
from ..operators.entries import cap_columns, deduplicate, shift_columns


def read_coo(
    spark: SparkSession,
    path: str,
    *,
    base: int,
    n_rows: int | None = None,
    n_cols: int | None = None,
    max_col: int | None = None,
    dup: str | None = "last",
    mode: str = "FAILFAST",
    drop_outside: bool = False,
) -> Matrix:
    """``row,col,value`` lines. ``base`` (0 or 1) is taken off the column id only.

    ``max_col`` drops larger column ids, as they are in the file. ``dup`` says what a repeated cell
    means: the ``last`` in file order, the ``sum``, an ``error``, or None for input known unique
    (which saves the shuffle). ``mode`` is FAILFAST or DROPMALFORMED. An entry outside ``n_cols`` is an
    error; ``drop_outside`` drops it.
    """
    if base not in (0, 1):
        raise ValueError("base must be 0 or 1")
    lines = spark.read.schema("row_id bigint, col_id bigint, value double").option("mode", mode).csv(path)
    needed = ["row_id", "col_id", "value"]
    if dup == "last":
        # The order of two lines: file, split within the file, line within the split.
        order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        lines = lines.select(*needed, order.alias("ord"))
        needed = [*needed, "ord"]
    entries = shift_columns(cap_columns(lines.select(*needed), max_col), base)
    below = F.col("col_id") < 0
    if mode.upper() == "FAILFAST":
        checked = F.when(below, F.raise_error(F.lit("negative column id, check base"))).otherwise(F.col("col_id"))
        entries = entries.withColumn("col_id", checked.cast("bigint"))
    else:
        entries = entries.filter(~below)
    if dup:
        entries = deduplicate(entries, dup, "ord" if dup == "last" else None)
    matrix = Matrix(entries.select("row_id", "col_id", "value"), n_rows, n_cols, drop_outside=drop_outside)
    return Matrix(matrix.clean(), n_rows, n_cols)


#: Most file splits whose first numbers are sent to every task, some 100 bytes each.
BROADCAST_SPLITS = 400_000


def numbered_lines(spark: SparkSession, path: str, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """``[line_no, value]``: non-blank trimmed lines, numbered from 0 over all files in name order.

    A first pass counts the lines of each file split. The running total over the splits, one short row each as in the
    scan's own planning, is kept and broadcast, and lines are numbered where they are read: no text is exchanged. Beyond
    ``broadcast_splits`` splits the totals are joined instead.
    """
    lines = (
        spark.read.text(path)
        .select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        .filter(F.col("value") != "")
        .withColumn("seq", F.monotonically_increasing_id())
    )
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = kept(splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "splits")
    few = splits.limit(broadcast_splits + 1).count() <= broadcast_splits
    joined = lines.join(F.broadcast(splits) if few else splits.hint("merge"), ["file", "start"])
    return joined.select((F.col("offset") + F.col("seq") - F.col("first")).alias("line_no"), "value")


def _numbers(text: Column, pattern: str) -> Column:
    """Split and convert; a token that is no number fails the query."""

    def number(token: Column) -> Column:
        parsed = F.trim(token).try_cast("double")
        failed = F.raise_error(F.concat(F.lit("not a number: "), token)).cast("double")
        return F.when(parsed.isNull(), failed).otherwise(parsed)

    return F.transform(F.split(text, pattern), number)


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """``[row_id, features]``: whitespace-separated numbers, one matrix row per non-blank line.

    The row id is the running line number over all files.
    """
    return numbered_lines(spark, path).select(F.col("line_no").alias("row_id"), _numbers(F.col("value"), r"\s+").alias("features"))


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """``[col_id, comp, loading]`` from lines ``[a,b,..]``; line i holds matrix column i."""
    body = F.regexp_replace("value", r"^\[|\]$", "")
    return numbered_lines(spark, path).select(
        F.col("line_no").alias("col_id"), F.posexplode(_numbers(body, ",")).alias("comp", "loading")
    )
