"""Exact top-k inner products by aggregation over sorted lists without random access.

Candidates are dealt into blocks; a block has one list per dimension, sorted by value. For a query each list is read
sequentially from the end where its products are largest. A candidate's score is bounded from below by what has been
read plus each unread list's smallest product, from above by what has been read plus each list's product at the current
depth. Reading stops once everything that can still reach the k-th lower bound is a short list; their scores are then
resolved exactly. The best of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import kept

#: Candidates and queries that meet in one group.
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
#: Share of the lists that is read between two looks at the bounds.
STEP = 1 / 16


def read_lists(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, rows: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, scores) of the k best vectors for each query, by score and then by id; own[i] is the row (or id) to leave out."""
    rows = ids if rows is None else rows
    n, dims = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable").T  # one ascending list per dimension
    values = np.take_along_axis(vectors.T, order, axis=1)
    step = max(64, int(n * STEP))
    best = []
    for query, mine in zip(queries, own):
        others = rows != mine
        up = query >= 0
        weights = query[:, None]
        ends = np.stack((values[:, 0] * query, values[:, -1] * query)) if n else np.zeros((2, dims), np.int64)
        worst = ends.min(axis=0)
        known = np.zeros(n, np.int64)  # products read so far, less the smallest possible ones
        headroom = np.zeros(n, np.int64)  # by how much the read lists were to be bettered, given up as they are read
        depth, shortlist = 0, np.flatnonzero(others)
        while depth < n and len(shortlist) > 4 * k:
            part = slice(depth, min(depth + step, n))
            back = slice(n - part.stop, n - part.start)
            places = np.where(up[:, None], order[:, back][:, ::-1], order[:, part])
            products = np.where(up[:, None], values[:, back][:, ::-1], values[:, part]) * weights
            np.add.at(known, places.ravel(), (products - worst[:, None]).ravel())
            depth = part.stop
            edge = np.where(up, values[:, n - depth], values[:, depth - 1]) * query
            if depth < n:
                seen = _reads(places, n)
                headroom += seen  # lists in which the candidate has been read
                lower = known + worst.sum()
                # an unread list can add at most its edge over its smallest product; the largest such gains bound all
                gains = np.concatenate(([0], np.cumsum(np.sort(edge - worst)[::-1])))
                upper = lower + gains[dims - headroom]
                floor = np.partition(lower[others], -k)[-k] if others.sum() >= k else None
                shortlist = np.flatnonzero(others & (upper >= floor)) if floor is not None else shortlist
        scores = vectors[shortlist] @ query
        top = np.lexsort((ids[shortlist], -scores))[:k]
        best.append((shortlist[top], scores[top]))
    return best


def _reads(places: np.ndarray, n: int) -> np.ndarray:
    """In how many of the lists each candidate was read in this step."""
    return np.bincount(places.ravel(), minlength=n)


def _searched(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_query = table.column("is_query").to_numpy()
        ids, rows = table.column("id").to_numpy(), table.column("row").to_numpy()
        flat = table.column("v").combine_chunks()
        matrix = flat.flatten().to_numpy().reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), np.int64)
        some = is_query.any() and not is_query.all()
        found = read_lists(matrix[is_query], matrix[~is_query], ids[~is_query], rows[is_query], k, rows[~is_query]) if some else []
        others, each = ids[~is_query], [len(p) for p, _ in found]
        return pa.table(
            {
                "query_id": pa.array(np.repeat(ids[is_query][: len(found)], each), pa.int64()),
                "row": pa.array(np.repeat(rows[is_query][: len(found)], each), pa.int64()),
                "vec_id": pa.array(np.concatenate([others[p] for p, _ in found]) if found else [], pa.int64()),
                "score": pa.array(np.concatenate([s for _, s in found]) if found else [], pa.int64()),
            }
        )

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """[query_id, rank, vec_id, score]: for each row whose id is divisible by `every`, the k rows with the largest scores.

    A component x counts as floor(scale * x); the score is the integer inner product. Ties go to the smaller id; a query
    has fewer than k rows only if there are fewer candidates. The query's own row is no candidate for it.

    * Rows with a null id, a null vector, or a null or non-finite component take no part; nor do empty vectors.
    * Vectors of different lengths are never compared.
    * Repeated rows, and rows sharing an id, are rows of their own: each is a candidate and, if its id says so, a query.
      So each of several queries with one id has k rows of its own.
    * An empty table, or one without queries, gives an empty table. Other columns are ignored.

    The stated queries meet all rows in blocks of at most about QUERY_ROWS x BLOCK_ROWS rows.
    """
    v = F.transform(vectors[vector_col], lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    bad = F.exists(vectors[vector_col], lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(vectors[id_col].isNotNull() & vectors[vector_col].isNotNull() & ~F.coalesce(bad, F.lit(True)))
    rows = rows.select(rows[id_col].cast("bigint").alias("id"), v.alias("v")).where(F.size("v") > 0)
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # written once, so the numbers stay
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    blocks, batches = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    deal = lambda into: F.pmod(F.xxhash64("id", "row"), F.lit(into)).cast("int")
    everywhere = lambda into: F.explode(F.sequence(F.lit(0), F.lit(into - 1)))
    candidates = rows.select("id", "row", "v", F.lit(False).alias("is_query"), deal(blocks).alias("block"), everywhere(batches).alias("batch"))
    queries = rows.where(F.col("id") % every == 0)
    queries = queries.select("id", "row", "v", F.lit(True).alias("is_query"), everywhere(blocks).alias("block"), deal(batches).alias("batch"))
    met = candidates.unionByName(queries).withColumn("dims", F.size("v"))
    found = met.groupBy("block", "batch", "dims").applyInArrow(_searched(k), "query_id bigint, row bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
