"""Matrices as text. A line holds one matrix row in the dense and list-of-lists formats, so a row
has to fit a record there; the coordinate format has no such limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The output formats.
FORMATS = ("DENSE", "LIL", "COO")


def _sorted_rows(entries: DataFrame, rows: DataFrame | None) -> DataFrame:
    """``[row_id, cells]``: the non-zero cells of each row in column order; ``rows`` adds empty rows."""
    cells = F.array_sort(F.collect_list(F.struct("col_id", "value")))
    grouped = entries.filter("value <> 0").groupBy("row_id").agg(cells.alias("cells"))
    if rows is None:
        return grouped
    empty = F.expr("cast(array() as array<struct<col_id:bigint,value:double>>)")
    return rows.select("row_id").distinct().join(grouped, "row_id", "left").select("row_id", F.coalesce("cells", empty).alias("cells"))


def dense_lines(entries: DataFrame, n_cols: int, rows: DataFrame | None = None) -> DataFrame:
    """``[row_id, value]``: all cells of a row, each followed by one blank.

    Runs of zeros are written between the stored cells, so the dense row is never built as a table.
    An entry outside ``n_cols`` is an error.
    """

    def cell(c: Column, i: Column) -> Column:
        previous = F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("cells"), i - 1)["col_id"])
        gap = (c["col_id"] - previous - 1).cast("int")
        return F.concat(F.repeat(F.lit("0.0 "), gap), c["value"].cast("string"), F.lit(" "))

    last = F.when(F.size("cells") == 0, F.lit(-1)).otherwise(F.element_at("cells", -1)["col_id"])
    tail = F.repeat(F.lit("0.0 "), (F.lit(n_cols - 1) - last).cast("int"))
    message = F.concat(F.lit("entry outside the columns to write: "), F.col("col_id").cast("string"))
    inside = entries.withColumn("value", F.when(F.col("col_id").between(0, n_cols - 1) | (F.col("value") == 0), F.col("value")).otherwise(F.raise_error(message).cast("double")))
    return _sorted_rows(inside, rows).select("row_id", F.concat(F.array_join(F.transform("cells", cell), ""), tail).alias("value"))


def lil_lines(entries: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``[row_id, value]``: ``{j:v,j:v}`` per row, zeros skipped; an empty row is ``{}``."""
    cell = F.transform("cells", lambda c: F.concat_ws(":", c["col_id"].cast("string"), c["value"].cast("string")))
    return _sorted_rows(entries, rows).select("row_id", F.concat(F.lit("{"), F.array_join(cell, ","), F.lit("}")).alias("value"))


def coo_lines(entries: DataFrame) -> DataFrame:
    """``[row_id, col_id, value]`` of the non-zero cells, the line being ``i,j,v``."""
    return entries.filter("value <> 0").select("row_id", "col_id", "value")


def write_matrix(entries: DataFrame, path: str, fmt: str, *, n_cols: int | None = None, rows: DataFrame | None = None, mode: str = "errorifexists", ordered: bool = False) -> None:
    """Write in one of the formats. Lines without ids come in row order across the part files; COO lines
    carry their ids and are only ordered on request."""
    fmt = fmt.upper()
    if fmt == "COO":
        lines = coo_lines(entries)
        (lines.orderBy("row_id", "col_id") if ordered else lines).write.mode(mode).csv(path)
    elif fmt == "LIL":
        lil_lines(entries, rows).orderBy("row_id").select("value").write.mode(mode).text(path)
    elif fmt == "DENSE":
        if n_cols is None:
            raise ValueError("the dense format needs n_cols")
        dense_lines(entries, n_cols, rows).orderBy("row_id").select("value").write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}, use one of {FORMATS}")


def components_as_matrix(components: DataFrame) -> DataFrame:
    """A component table as entries: matrix row = column id of the data, matrix column = component."""
    return components.select(
        F.col("col_id").alias("row_id"), F.col("comp").cast("bigint").alias("col_id"), F.col("loading").alias("value")
    )


def component_lines(components: DataFrame) -> DataFrame:
    """``[col_id, value]``: ``[a,b,..]`` per matrix column, in component order."""
    ordered = F.array_sort(F.collect_list(F.struct("comp", "loading")))  # one record per component
    text = F.transform(ordered, lambda c: c["loading"].cast("string"))
    return components.groupBy("col_id").agg(F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias("value"))


def write_components(components: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The bracketed component text that :func:`rankfold.sources.read_components` reads."""
    component_lines(components).orderBy("col_id").select("value").write.mode(mode).text(path)


def write_projection(scores: DataFrame, path: str, fmt: str = "PARQUET", *, k: int | None = None, rows: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Projected rows ``[row_id, comp, score]`` as parquet, or as one of the text formats.

    DENSE and LIL have a line for each row of ``rows[row_id]``, by default each row of ``scores``, also where
    all scores are 0.
    """
    if fmt.upper() == "PARQUET":
        scores.write.mode(mode).parquet(path)
        return
    cells = scores.select("row_id", F.col("comp").cast("bigint").alias("col_id"), F.col("score").alias("value"))
    write_matrix(cells, path, fmt, n_cols=k, rows=scores if rows is None else rows, mode=mode)
