"""The matrix abstraction: a coordinate table plus its dimensions, and how it is laid out on the
cluster while an iterative analysis runs over it.

A matrix product Y*W is an equi-join on ``col_id`` followed by a sum per ``row_id``; Y'*Z is an
equi-join on ``row_id`` followed by a sum per ``col_id``. Which join strategy is safe depends on
how large the dense operands are, so the layout is chosen from the dimensions:

``rows``
    The column-sized operand is provably small. Y is hash-partitioned by ``row_id`` once; it is
    broadcast-joined with W, and the row sums and the join back need no further exchange: a pass
    shuffles nothing but one partial sum per task and column.
    A row holds at most ``n_cols`` cells, and ``n_cols`` is bounded here, so no row can be hot.
``grid``
    Otherwise. Y is partitioned once into a grid of (row block, column block).
    The dense operands are replicated along the grid instead of Y being shuffled by row and by
    column in each pass. A hot row is spread over all column blocks and a hot column over all row
    blocks, so the grid is also the salting. There are few blocks, one for each core at least, numbered
    so that they spread evenly over the partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.columns import number
from .functions.session import scratch_path

# Largest estimated size of a table that may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
# Grid blocks per task if the caller asks for a number of partitions: enough that hashing them to tasks comes out even.
BLOCKS_PER_TASK = 8
# Bytes of a block's dense operand up to which the grid is joined by hashing, in multiples of the broadcast limit.
HASH_FACTOR = 4
# Numberings of the blocks that are tried for an even spread over the partitions.
SPREAD_TRIES = 256
# Most bytes of entries aimed at for a partition of Y, and bytes that an entry takes in memory.
PARTITION_BYTES, ENTRY_BYTES = 256 * 1024 * 1024, 32
# Dense components handled per generated aggregate; wider operands are split into blocks of rows.
BLOCK_WIDTH = 16

_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def table_bytes(n: int, width: int) -> int:
    """Upper estimate of a hashed table of n rows: a key, ``width`` doubles, row and map overhead."""
    blocks = math.ceil(width / BLOCK_WIDTH)
    return n * (blocks * 64 + 8 * width)


@dataclass(frozen=True)
class Matrix:
    """``entries[row_id, col_id, value]`` with unique cells; an absent cell is 0.

    ``n_rows`` and ``n_cols`` may exceed what is stored: absent rows count as rows of zeros.
    Leaving them out costs one pass to measure them, which also counts the entries; with both dimensions
    given, pass ``n_entries`` if the session's partitions would be too large for the matrix.
    An entry outside ``n_cols``, or with a negative column, is an error unless ``drop_outside`` is set.
    """

    entries: DataFrame
    n_rows: int | None = None
    n_cols: int | None = None
    n_entries: int | None = None
    drop_outside: bool = False

    def measured(self) -> Matrix:
        """Fill in missing dimensions: distinct row ids, and the largest column id plus one; count the entries."""
        if self.n_rows is not None and self.n_cols is not None:
            return self
        per_row = self.entries.groupBy("row_id").agg(F.max("col_id").alias("c"), F.count("*").alias("n"))
        rows, last, stored = per_row.agg(F.count("*"), F.max("c"), F.sum("n")).first()
        return replace(
            self,
            n_rows=self.n_rows if self.n_rows is not None else rows,
            n_cols=self.n_cols if self.n_cols is not None else (0 if last is None else last + 1),
            n_entries=stored or 0,
        )

    def clean(self) -> DataFrame:
        """Entries that are inside the matrix and not zero (NULL counts as absent)."""
        inside = F.col("col_id") >= 0
        if self.n_cols is not None:
            inside &= F.col("col_id") < self.n_cols
        message = F.concat(F.lit("entry outside the matrix in column "), F.col("col_id").cast("string"))
        checked = inside if self.drop_outside else F.when(inside, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        keep = (F.col("value") != 0) & checked
        return self.entries.select("row_id", "col_id", "value").filter(keep)

    def stored(self, path: str | None = None) -> Matrix:
        """Write the entries as parquet and go on from there.

        For a derived matrix that several steps use: its joins and aggregates run once. Without a
        path the table goes below the shared checkpoint folder.
        """
        spark = self.entries.sparkSession
        path = path or scratch_path(spark, "matrix")
        self.clean().write.parquet(path)
        return replace(self, entries=spark.read.parquet(path))

    def lay_out(self, width: int, *, broadcast_bytes: int = BROADCAST_BYTES, partitions: int | None = None) -> Layout:
        """Context manager with Y cached and placed for products with ``width`` dense components."""
        return Layout(self.measured(), width, broadcast_bytes, partitions)


def to_blocks(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rename ``cols`` to x0.. ; more than BLOCK_WIDTH of them become several rows with ``blk``."""
    if len(cols) <= BLOCK_WIDTH:
        return df.selectExpr(*keys, *[f"{c} AS x{i}" for i, c in enumerate(cols)])
    structs = []
    for b in range(0, len(cols), BLOCK_WIDTH):
        part = cols[b : b + BLOCK_WIDTH]
        part = part + ["0.0D"] * (BLOCK_WIDTH - len(part))
        fields = ", ".join(f"{c} AS x{i}" for i, c in enumerate(part))
        structs.append(f"struct({b // BLOCK_WIDTH} AS blk, {fields})")
    return df.selectExpr(*keys, f"inline(array({', '.join(structs)}))")


def from_blocks(df: DataFrame, key: str, width: int, prefix: str) -> DataFrame:
    """The wide table ``[key, prefix0..]`` of a table written by :func:`to_blocks`."""
    if width <= BLOCK_WIDTH:
        return df.selectExpr(key, *[f"x{j} AS {prefix}{j}" for j in range(width)])
    pick = [
        F.expr(f"sum(CASE WHEN blk = {j // BLOCK_WIDTH} THEN x{j % BLOCK_WIDTH} END) AS {prefix}{j}") for j in range(width)
    ]
    return df.groupBy(key).agg(*pick)


def shift_blocks(df: DataFrame, mean: np.ndarray) -> DataFrame:
    """Subtract a dense row vector from every row of a (possibly blocked) table.

    The numbers are read out of constant arrays by an index that depends on the row. Plain literals
    would be compiled into the pass over the data, which would then start cold in each iteration.
    """
    width = len(mean)
    if width <= BLOCK_WIDTH:
        moved = [f"x{j} - get(array({number(m)}), int(x{j} IS NULL)) AS x{j}" for j, m in enumerate(mean)]
        return df.selectExpr(*_keys(df), *moved)
    padded = np.zeros(math.ceil(width / BLOCK_WIDTH) * BLOCK_WIDTH)
    padded[:width] = mean
    by_block = padded.reshape(-1, BLOCK_WIDTH)
    moved = [
        f"x{i} - get(array({', '.join(number(v) for v in by_block[:, i])}), blk) AS x{i}" for i in range(BLOCK_WIDTH)
    ]
    return df.selectExpr(*_keys(df), *moved)


def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("x")]


def _weighted(width: int) -> list[Column]:
    return [F.expr(f"sum(value * x{i}) AS x{i}") for i in range(min(width, BLOCK_WIDTH))]


class Layout:
    """Y placed on the cluster; see the module text. Use as a context manager."""

    _present: int | None = None

    def __init__(self, matrix: Matrix, width: int, broadcast_bytes: int, partitions: int | None):
        self.matrix = matrix
        self.n_rows: int = matrix.n_rows
        self.n_cols: int = matrix.n_cols
        self.spark = matrix.entries.sparkSession
        self.limit = broadcast_bytes
        row_bytes, col_bytes = table_bytes(self.n_rows, width), table_bytes(self.n_cols, width)
        default = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.kind = "rows" if col_bytes <= broadcast_bytes else "grid"
        # Size aimed at for the part of a dense operand that one task joins with.
        block = max(1, broadcast_bytes // 4)
        self.row_blocks = self.col_blocks = 1
        self._hash_blocks = True
        self._first_block = 0
        stored = math.ceil((matrix.n_entries or 0) * ENTRY_BYTES / PARTITION_BYTES)
        if self.kind == "rows":
            self.partitions = partitions or max(default, math.ceil(row_bytes / block), stored)
        else:
            # Copies made per pass are n_rows * col_blocks + n_cols * row_blocks; for a given number
            # of blocks they are fewest when row and column blocks are about equally large.
            blocks = BLOCKS_PER_TASK * partitions if partitions else self._fewest_blocks(row_bytes, col_bytes, stored)
            self.row_blocks = max(1, min(self.n_rows, math.ceil(math.sqrt(blocks * self.n_rows / self.n_cols))))
            self.col_blocks = max(1, min(self.n_cols, math.ceil(blocks / self.row_blocks)))
            self.partitions = partitions or max(default, self.row_blocks * self.col_blocks)
            # Larger blocks go through a sort-merge join, which can spill.
            fits = broadcast_bytes * (1 if partitions else HASH_FACTOR)
            self._hash_blocks = max(row_bytes / self.row_blocks, col_bytes / self.col_blocks) <= fits
            if not partitions:
                self._first_block = self._even_numbering()
        entries = matrix.clean()
        if self.kind == "rows":
            # Sorted once: in each pass the sum and the join back then touch one row at a time.
            entries = entries.repartition(self.partitions, "row_id").sortWithinPartitions("row_id")
        else:
            entries = entries.select(
                "row_id",
                "col_id",
                "value",
                self._row_block().alias("rb"),
                self._block("col_id", self.col_blocks).alias("cb"),
            ).repartition(self.partitions, "rb", "cb").sortWithinPartitions("rb", "cb", "row_id")
        self.entries = entries
        self._saved_conf: str | None = None

    @staticmethod
    def _block(key: str, count: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def _row_block(self) -> Column:
        return self._block("row_id", self.row_blocks) + F.lit(self._first_block)

    def _fewest_blocks(self, row_bytes: int, col_bytes: int, stored: int) -> int:
        """Blocks of the grid: the copies made per pass grow with the root of their number.

        One for each core and for each 2 * PARTITION_BYTES of entries, or as many as keep the operands of a block fit for
        hashing. For that alone no more copies are made than there are entries: small limits must not blow up the grid.
        """
        fit = math.ceil(row_bytes * col_bytes / max(1, HASH_FACTOR * self.limit) ** 2)
        entries = max(self.matrix.n_entries or 0, self.n_rows + self.n_cols)
        most = entries**2 // (4 * self.n_rows * self.n_cols)
        return max(self.spark.sparkContext.defaultParallelism, math.ceil(stored / 2), min(fit, most))

    def _even_numbering(self) -> int:
        """The first row block number for which the fewest blocks meet in one partition, as Spark hashes them."""
        blocks = self.row_blocks * self.col_blocks
        tries = max(1, min(SPREAD_TRIES, 100_000 // blocks))
        row, col = f"int(id div {self.col_blocks} % {self.row_blocks})", f"int(id % {self.col_blocks})"
        cells = self.spark.range(tries * blocks, numPartitions=1).selectExpr(f"int(id div {blocks}) AS t", f"{row} AS r", f"{col} AS cb")
        cells = cells.selectExpr("t", f"pmod(hash(r + t * {self.row_blocks}, cb), {self.partitions}) AS part")
        loads = cells.groupBy("t", "part").count().groupBy("t").agg(F.max("count").alias("most"))
        return loads.orderBy("most", "t").first()["t"] * self.row_blocks

    def __enter__(self) -> Layout:
        if self.kind == "grid":
            # The joins use (block, id) keys while Y is partitioned by block alone; blocks are even
            # by construction, so the planner may keep Y where it is.
            self._saved_conf = self.spark.conf.get(_CO_PARTITION)
            self.spark.conf.set(_CO_PARTITION, "false")
        self.entries = self.entries.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def __exit__(self, *exc) -> None:
        self.entries.unpersist()
        if self._saved_conf is not None:
            self.spark.conf.set(_CO_PARTITION, self._saved_conf)

    def present_rows(self) -> int:
        """Rows that are stored; counted once per layout."""
        if self._present is None:
            self._present = self._count_rows()
        return self._present

    def _count_rows(self) -> int:
        return self.entries.select("row_id").distinct().count()

    def _small(self, n: int, width: int) -> bool:
        return table_bytes(n, width) <= self.limit

    def small_columns(self, width: int) -> bool:
        """Whether a ``col_id`` table of this many doubles per row may be broadcast."""
        return self._small(self.n_cols, width)

    def join_columns(self, entries: DataFrame, table: DataFrame, width: int) -> DataFrame:
        """Entries joined with a ``col_id`` table of ``width`` doubles per row, leaving Y in place."""
        if self._small(self.n_cols, width):
            return entries.join(F.broadcast(table), "col_id")
        if self.kind != "grid":
            return entries.join(table, "col_id")
        copies = F.explode(F.sequence(F.lit(self._first_block), F.lit(self._first_block + self.row_blocks - 1)))
        table = table.withColumn("cb", self._block("col_id", self.col_blocks)).withColumn("rb", copies)
        return entries.join(self._block_hint(table), ["rb", "cb", "col_id"])

    def join_rows(self, entries: DataFrame, table: DataFrame, width: int) -> DataFrame:
        """Entries joined with a ``row_id`` table of ``width`` doubles per row, leaving Y in place."""
        if self.kind == "rows":
            return entries.join(table.hint("shuffle_hash"), "row_id")
        if self.kind != "grid":
            return entries.join(table, "row_id")
        if "rb" not in table.columns:
            table = table.withColumn("rb", self._row_block())
        copies = F.explode(F.sequence(F.lit(0), F.lit(self.col_blocks - 1)))
        return entries.join(self._block_hint(table.withColumn("cb", copies)), ["rb", "cb", "row_id"])

    def _block_hint(self, table: DataFrame) -> DataFrame:
        return table.hint("shuffle_hash") if self._hash_blocks else table

    def _sketch_blocks(self, table: DataFrame, cols: list[str], where: Column | None = None) -> DataFrame:
        """Y*W in block form, one row per matrix row (and component block)."""
        width = len(cols)
        blk = ["blk"] if width > BLOCK_WIDTH else []
        entries = self.entries if where is None else self.entries.filter(where)
        joined = self.join_columns(entries, to_blocks(table, ["col_id"], cols), width)
        if self.kind != "grid":
            return joined.groupBy("row_id", *blk).agg(*_weighted(width))
        part = joined.groupBy("rb", "cb", "row_id", *blk).agg(*_weighted(width))
        total = [F.expr(f"sum(x{i}) AS x{i}") for i in range(min(width, BLOCK_WIDTH))]
        return part.groupBy("rb", "row_id", *blk).agg(*total)

    def _cross_blocks(self, z: DataFrame, width: int) -> DataFrame:
        """Y'*Z in block form for the block form of Z."""
        blk = ["blk"] if width > BLOCK_WIDTH else []
        return self.join_rows(self.entries, z, width).groupBy("col_id", *blk).agg(*_weighted(width))

    def sketch(self, table: DataFrame, cols: list[str], prefix: str = "z", where: Column | None = None) -> DataFrame:
        """``[row_id, z0..]`` = Y*W for the stored rows; W is ``cols`` of a ``col_id`` table.

        ``where`` is a condition on whole rows.
        """
        return from_blocks(self._sketch_blocks(table, cols, where), "row_id", len(cols), prefix)

    def cross(self, z: DataFrame, cols: list[str], prefix: str = "c") -> DataFrame:
        """``[col_id, c0..]`` = Y'*Z; Z is ``cols`` of a ``row_id`` table."""
        blocks = self._cross_blocks(to_blocks(z, ["row_id"], cols), len(cols))
        return from_blocks(blocks, "col_id", len(cols), prefix)

    def normal_image(self, table: DataFrame, cols: list[str], mean: np.ndarray, prefix: str = "c") -> DataFrame:
        """``[col_id, c0..]`` = A'*A*W for the centred matrix A = Y - 1*mu', in one job.

        ``mean`` is mu'*W. Y'(YW - 1*mean) needs no further correction: the centred sketch sums to
        zero over all rows, so the mean part of A' contributes nothing, and absent rows have no
        entry to contribute with.
        """
        z = shift_blocks(self._sketch_blocks(table, cols), mean)
        return from_blocks(self._cross_blocks(z, len(cols)), "col_id", len(cols), prefix)

    def column_means(self) -> DataFrame:
        """``[col_id, mu]``: column sums over all ``n_rows`` rows, for columns that have entries."""
        return self.entries.groupBy("col_id").agg((F.sum("value") / F.lit(float(self.n_rows))).alias("mu"))

    def state(self, seed: DataFrame, cols: list[str]) -> DataFrame:
        """``[col_id, mu, w0..]``: the seed columns next to the column means."""
        return seed.join(self.column_means(), "col_id", "left").select(
            "col_id", F.coalesce("mu", F.lit(0.0)).alias("mu"), *cols
        )


def zeros_if_missing(cols: list[str]) -> list[str]:
    return [f"coalesce({c}, 0.0D) AS {c}" for c in cols]


__all__ = ["BROADCAST_BYTES", "BLOCK_WIDTH", "Layout", "Matrix", "table_bytes", "zeros_if_missing"]
