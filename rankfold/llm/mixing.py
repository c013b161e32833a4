"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document has the same expected number of copies, target / size of the source. The copies are prefix
sums of that number in a fixed order, shifted by one random offset per source; a document is emitted once per integer that
its interval crosses. The order runs through narrow bands of document sizes, so that each band gets its share and the words
taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A run of non-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one task should number at most, on average; the hash prefix is made long enough for it.
CHUNK_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: list[float], share: float, ceiling: float) -> DataFrame:
    """[no_source, source, source_size, target] from [no_source, source, source_size]; no_source marks the null source.

    Sources in code-point order, null last, take the weights in turn and share `share` of all sizes in proportion. A target
    stops at `ceiling` times its source's size and the excess goes to the others by weight, again until none is above:
    with the sources sorted by ceiling per weight, the first ones are full and the rest lie on one level. One task sorts the
    sources, at about 100 bytes each: that suits some million sources, not one per document.
    """
    order = W.orderBy("no_source", F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(ceiling))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), "no_source", F.encode("source", "UTF-8"))
    everything = W.partitionBy()
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)).alias("open"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("total"),
    )
    level = (F.col("total") - F.col("full")) / F.col("open")  # the level if this and all later sources are open
    fits = F.col("most") <= level * F.col("weight")
    first_open = F.max(F.when(~fits, F.struct("open", "full", "total"))).over(everything)
    rest = (first_open["total"] - first_open["full"]) / first_open["open"]
    target = F.when(fits | first_open.isNull(), F.col("most")).otherwise(F.least("most", rest * F.col("weight")))
    return filled.select("no_source", "source", "source_size", target.alias("target"))


def mixture(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: list[str] = (),
) -> DataFrame:
    """[id_col, size, source_size, target, copies, taken, *keep], one row per row of docs.

    size is the number of runs of non-space characters; source_size and target belong to the row's source; copies is how
    often the mix takes the document, at most `ceiling` rounded up, and taken = copies * size.

    * A null text has size 0; null is a source of its own, the last one. Sources of size 0 have target 0 and no copies.
    * Repeated rows are documents of their own: each is taken as often as its place in the order says.
    * Null ids take part like others. Reruns agree, whatever the partitioning. An empty table gives an empty table.
    * A very long text is one document: it is counted where it is read and only carried on if `keep` names it.
    * Only the columns named in `keep` are carried along; others are ignored, whatever their names.

    No group is gathered: places are numbered within chunks of a source (a size band and a prefix of a hash of id and text, so
    that rows which share an id, or have none, are spread) and the chunks are added up per source. Only rows equal in both
    share a chunk whatever their number.
    """
    size = word_count(docs[text_col])
    source = docs[source_col]
    rows = docs.select(
        docs[id_col].alias("id"),
        F.xxhash64(docs[id_col], docs[text_col], F.lit(seed)).alias("draw"),
        source.isNull().alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source"),
        size.alias("size"),
        *[docs[c].alias(f"keep_{c}") for c in keep],
    )
    bits = max(1, (-(-docs.count() // CHUNK_ROWS)).bit_length())
    band = F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int")
    rows = rows.withColumn("band", band).withColumn("prefix", F.shiftrightunsigned("draw", 64 - bits))

    group, chunk = ["no_source", "source"], ["no_source", "source", "band", "prefix"]
    chunks = rows.groupBy(*chunk).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sources = chunks.groupBy(*group).agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, share, ceiling)
    before = W.partitionBy(*group).orderBy("band", "prefix").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(*group, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    plan = chunks.select(*chunk, first.alias("first")).join(targets, group)
    plan = plan.select(*chunk, "first", "source_size", "target", rate.alias("rate"), offset.alias("offset"))

    number = F.row_number().over(W.partitionBy(*chunk).orderBy("draw", "id", "size")) - 1
    out = rows.withColumn("place", number).join(plan, chunk)
    k = F.col("first") + F.col("place")
    copies = F.floor(F.col("rate") * (k + 1) + F.col("offset")) - F.floor(F.col("rate") * k + F.col("offset"))
    out = out.withColumn("copies", copies.cast("bigint"))
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *[F.col(f"keep_{c}").alias(c) for c in keep],
    )

