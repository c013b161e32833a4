"""Quality selection by importance resampling.

Two bag-of-n-grams models over hashed buckets describe the target (texts labelled good) and the raw corpus (all texts). The
weight of a document is the ratio of its likelihoods under both; Gumbel noise on the log-weights and the k largest sums draw
k documents without replacement in proportion to their weights.

Toxic texts read like good ones but for a few words, which no sum over a long text shows. So they have evidence of their own:
words that stand in labelled texts and are surely more often in toxic ones. A text with one of them is not drawn, however long
it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import drop, kept

#: Buckets of the hashed models, shared by words, word pairs and character shapes.
BUCKETS = 1 << 14
#: Added to every bucket of the target, as a share of the raw model.
PRIOR_COUNTS = 1 << 14
#: Buckets of words that tell toxic texts; a word tells if the lower bound of the share of toxic ones among the labelled texts
#: with it (Wilson's, at TOXIC_Z standard deviations) is above TOXIC_SHARE.
TOXIC_BUCKETS, TOXIC_Z, TOXIC_SHARE = 1 << 20, 4.0, 0.6

_SHAPE = np.zeros(256, np.uint8)
_SHAPE[48:58] = 1
_SHAPE[65:91] = 2
_SHAPE[97:123] = 3
_SHAPE[128:] = 3
for _n, _c in enumerate(range(33, 127)):
    if _SHAPE[_c] == 0:
        _SHAPE[_c] = 4 + _n % 28


def _features(column: pa.Array):
    """(first row, end row, bucket of each feature, text of each feature) of each piece.

    Features are words (A-Z lower-cased), pairs of words, whether a word repeats one of the two before it, and the
    shape of a word: the kinds of its first, second and last two characters and its length.
    """
    for lo, hi, buf, offsets in scan.pieces(column):
        starts, ends, bounds = scan.word_spans(buf, offsets)
        owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
        words = scan.word_hashes(scan.lower(buf), starts, ends)
        pairs = scan.run_hashes(words, 2)
        same = owner[1:] == owner[:-1]
        shape = _SHAPE[buf]
        at = [shape[np.minimum(starts + k, ends - 1)] for k in (0, 1)] + [shape[np.maximum(ends - k, starts)] for k in (1, 2)]
        form = np.minimum(ends - starts, 31).astype(np.uint64)
        for a in at:
            form = form * np.uint64(32) + a
        form = scan.mix(form + np.uint64(1 << 40))
        again = np.zeros(len(words), np.uint64)
        again[1:] += (same & (words[1:] == words[:-1])).astype(np.uint64)
        again[2:] += ((owner[2:] == owner[:-2]) & (words[2:] == words[:-2])).astype(np.uint64)
        again = scan.mix(again + np.uint64(1 << 50))
        keys = np.concatenate((words, pairs[same], form, again))
        yield lo, hi, (keys >> np.uint64(50)).astype(np.int64), np.concatenate((owner, owner[1:][same], owner, owner))


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _told(column: pa.Array):
    """(first row, end row, bucket of each distinct word of letters, its text) of each piece."""
    for lo, hi, buf, offsets in scan.pieces(column):
        starts, ends, bounds = scan.word_spans(buf, offsets, _LETTERS)
        owner = np.repeat(np.arange(hi - lo), np.diff(bounds)).astype(np.uint64)
        hashes = scan.word_hashes(scan.lower(buf), starts, ends) >> np.uint64(44)
        packed = np.unique(owner << np.uint64(20) | hashes).astype(np.int64)
        yield lo, hi, packed % TOXIC_BUCKETS, packed // TOXIC_BUCKETS


#: Kinds of counts: features of all texts, of the target; texts with a word, toxic and not.
_RAW, _TARGET, _TOXIC, _CLEAN = range(4)


def _bucket_counts(batches):
    for batch in batches:
        group = batch.column("target").to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.zeros(2 * BUCKETS, np.int64)
        for lo, _, bucket, owner in _features(batch.column("text")):
            total += np.bincount(bucket + BUCKETS * group[owner + lo], minlength=2 * BUCKETS)
        used = np.flatnonzero(total)
        kinds, buckets, counts = [np.where(used < BUCKETS, _RAW, _TARGET)], [used % BUCKETS], [total[used]]
        for kind, toxic in ((_TOXIC, True), (_CLEAN, False)):
            texts = batch.column("text").filter(pc.equal(batch.column("toxic"), toxic), null_selection_behavior="drop")
            told = [bucket for _, _, bucket, _ in _told(texts)] or [np.empty(0, np.int64)]
            bucket, n = np.unique(np.concatenate(told), return_counts=True)
            kinds.append(np.full(len(n), kind))
            buckets.append(bucket)
            counts.append(n)
        columns = [pa.array(np.concatenate(x), t) for x, t in ((kinds, pa.int32()), (buckets, pa.int32()), (counts, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "n"])


def _scored(models):
    def run(batches):
        ratio, tells = models.value
        for batch in batches:
            rest = batch.drop_columns(["text"])
            toxic = [np.bincount(owner, tells[bucket], minlength=hi - lo) > 0 for lo, hi, bucket, owner in _told(batch.column("text"))]
            toxic = pa.array(np.concatenate(toxic)) if toxic else pa.array([], pa.bool_())
            for lo, hi, bucket, owner in _features(batch.column("text")):
                weight = np.bincount(owner, ratio[bucket], minlength=hi - lo).astype(float)
                n = np.bincount(owner, minlength=hi - lo)
                part = rest.slice(lo, hi - lo)
                columns = [*part.columns, pa.array(weight), pa.array(n), toxic.slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "log_weight", "n_features", "toxic"])

    return run


def importance_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id, log_weight, n_features and toxic, one row per row of docs.

    The target model is counted over the texts whose label is good (quality 1, toxic 0 or null), the raw model over
    all texts; both count every such text. A document's log_weight is the sum over all its features of the logarithm of the
    models' ratio. toxic says whether the text has a word that tells toxic texts, learnt from all texts with a toxic label.
    Of several labels of a document, one good label makes it good and one toxic label toxic.
    A null, empty or blank text has no features, weight 0, and is not toxic. A very long text counts whole.
    """
    good = labels["quality"].eqNullSafe(1) & (F.coalesce(labels["toxic"], F.lit(0)) == 0)
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("marked"))
    marks = marks.agg(F.max(good).alias("target"), (F.max(labels["toxic"]) == 1).alias("toxic")).where("target or toxic is not null")
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    marked = source.join(F.broadcast(marks) if _small(marks) else marks, source.id == F.col("marked"), "left")
    marked = marked.select("text", F.coalesce("target", F.lit(False)).alias("target"), "toxic")
    counts = marked.mapInArrow(_bucket_counts, "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    counts = kept(counts, "counts")  # at most 2 * BUCKETS + 2 * TOXIC_BUCKETS rows
    models = counts.where(F.col("kind") <= _TARGET).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    kind, bucket, n = (models.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    np.add.at(raw, bucket, n)
    np.add.at(target, bucket[kind == _TARGET], n[kind == _TARGET])
    raw = (raw + 1) / (raw.sum() + BUCKETS)
    target = (target + PRIOR_COUNTS * raw) / (target.sum() + PRIOR_COUNTS)
    told = counts.where(F.col("kind") > _TARGET).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == _TOXIC, F.col("n")).otherwise(0)).alias("bad"))
    p, z2, n = F.col("bad") / F.col("n"), TOXIC_Z**2, F.col("n")
    lower = (p + z2 / (2 * n) - TOXIC_Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    tells = np.zeros(TOXIC_BUCKETS)
    tells[told.where(lower > TOXIC_SHARE).select("bucket").toArrow().column("bucket").to_numpy()] = 1
    drop(counts)
    shared = docs.sparkSession.sparkContext.broadcast((np.log(target / raw), tells))  # two tables of fixed size
    fields = f"id {source.schema['id'].dataType.simpleString()}, log_weight double, n_features bigint, toxic boolean"
    return source.mapInArrow(_scored(shared), fields).withColumnRenamed("id", id_col)


def _small(ids: DataFrame, rows: int = 500_000) -> bool:
    """Whether ids has at most `rows` rows, so that sending them everywhere costs a few MB."""
    return ids.limit(rows + 1).count() <= rows


def good_count(weights: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> int:
    """How many documents to draw: those whose weight is above the middle between good and bad labelled documents.

    The middle lies between the 1% quantile of the weights of quality 1, toxic ones left out, and the 99% quantile of those of
    quality 0. If either has no document with words, all documents count.
    """
    known = labels.where("quality = 0 or quality = 1 and coalesce(toxic, 0) = 0")
    marks = known.select(labels["doc_id"].alias("marked"), (labels["quality"] == 1).alias("good"))
    known = weights.join(marks, weights[id_col] == marks.marked)
    low, high = known.agg(
        F.percentile_approx(F.when(F.col("good"), F.col("log_weight")), 0.01),
        F.percentile_approx(F.when(~F.col("good"), F.col("log_weight")), 0.99),
    ).first()
    return weights.count() if low is None or high is None else weights.where(F.col("log_weight") >= (low + high) / 2).count()


def _gumbel(seed: int, *keys: str):
    """Standard Gumbel noise that depends on the keys only, so that reruns agree."""
    uniform = (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """[id_col, log_weight, n_features, key]: the k documents drawn, by default as many as good_count() says.

    key is the log-weight plus Gumbel noise that depends on the id; the k largest keys are drawn (ties: all documents at the
    k-th key). Documents without words and toxic ones are never drawn. Null ids share one noise; repeated rows have equal keys
    and are drawn together. An empty table gives an empty table; without labels of both kinds all documents with words that
    are not toxic are drawn.
    """
    weights = importance_weights(docs, labels, id_col, text_col).where("n_features > 0 and not toxic").drop("toxic")
    weights = kept(weights.withColumn("key", F.col("log_weight") + _gumbel(seed, id_col)), "weights")
    k = good_count(weights, labels, id_col) if k is None else k
    return weights.where(F.col("key") >= F.lit(_kth_largest(weights, k)))


def _kth_largest(weights: DataFrame, k: int) -> float:
    """The k-th largest key, by narrowing an interval with counts of up to 1000 bins; no sort, a few small scans."""
    lo, hi, n = weights.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return lo
    above = 0  # keys larger than hi
    while lo < hi:
        inside = weights.where(F.col("key").between(lo, hi))
        place = F.floor((F.col("key") - lo) / F.lit((hi - lo) / 1000))
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(bins.collect(), key=lambda r: -r["high"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        if (row["low"], row["high"]) == (lo, hi):  # too close to part
            break
        lo, hi = row["low"], row["high"]
    return lo


def quality_filtered(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """The rows of docs that resampled() draws, with all their columns."""
    drawn = resampled(docs, labels, k, seed=seed).select(F.col("doc_id").alias("drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["drawn"]), "left_semi")
