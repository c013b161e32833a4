"""URL filters: allow and block rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

SLOTS = 1 << 16
SIZES = (3, 4, 5)
#: Most distinct labelled urls that a model is fitted on, half of them of each verdict; larger tables are sampled by hash.
TRAINING_ROWS = 20_000


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of (verdict, host with path prefix), and its verdict; null if none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's path. Equally long rules: the first.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])) if rules else []:
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct n-grams of `^host$` and `^path$` of each row."""
    rows, slots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for field, column in enumerate((hosts, paths)):
        buf, offsets = scan.text_bytes(pa.array([f"^{x or ''}$" for x in column.to_pylist()], pa.string()))
        prefix = scan.prefix_hashes(buf)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for size in SIZES:
            place = np.arange(max(0, len(buf) - size + 1))
            place = place[owner[place] == owner[place + size - 1]] if len(place) else place
            keys = scan.mix(scan.span_hashes(prefix, place, place + size) + np.uint64(field)) >> np.uint64(48)
            rows.append(owner[place])
            slots.append(keys.astype(np.int64))
    packed = np.unique(np.concatenate(rows) * SLOTS + np.concatenate(slots))
    return packed // SLOTS, packed % SLOTS


def fit(labelled: DataFrame, rows: int = TRAINING_ROWS, rounds: int = 30, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression on labelled[host, path, verdict]: SLOTS of them and a bias.

    Fitted with AdaGrad on the driver, on distinct urls, each weighted by how often it is labelled so: of each verdict the
    rows / 2 with the smallest hashes, so neither repeated urls nor a rare verdict change what is seen. Rows with a null verdict
    are left out. Without rows, or with one verdict only, the weights are 0 and the bias gives that verdict.
    """
    urls = labelled.where("verdict is not null").groupBy("verdict", "host", "path").agg(F.count("*").alias("times"))
    urls = urls.withColumn("place", F.xxhash64("host", "path"))
    chosen = [urls.where(F.col("verdict") == v).orderBy("place", "host", "path").limit(rows // 2) for v in ("allow", "block")]
    table = chosen[0].unionByName(chosen[1]).orderBy("place", "host", "path", "verdict").toArrow().combine_chunks()
    weights = np.zeros(SLOTS + 1)
    if not table.num_rows:
        return weights
    y = np.array([v == "block" for v in table.column("verdict").to_pylist()], float)
    if y.min() == y.max():
        weights[-1] = 8.0 if y[0] else -8.0
        return weights
    # a url counts with the square root of its labels, so that a hot one does not drown the rest
    times = np.sqrt(table.column("times").to_numpy().astype(float))
    times /= times.mean()
    row, slot = _grams(table.column("host").combine_chunks(), table.column("path").combine_chunks())
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    batches = np.array_split(np.random.default_rng(0).permutation(len(y)), max(1, len(y) // 256))
    starts = np.searchsorted(row, np.arange(len(y) + 1))
    squares = np.full(SLOTS + 1, 1e-8)
    for _ in range(rounds):
        for batch in batches:
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in batch])
            whose = np.repeat(np.arange(len(batch)), starts[batch + 1] - starts[batch])
            z = np.bincount(whose, weights[slot[at]], minlength=len(batch)) * scale[batch] + weights[-1]
            error = 1 / (1 + np.exp(-z)) - y[batch]
            error *= times[batch]
            gradient = np.bincount(slot[at], (error * scale[batch])[whose], minlength=SLOTS + 1) / len(batch)
            gradient[-1] = error.mean()
            gradient += decay * weights
            squares += gradient**2
            weights -= rate * gradient / np.sqrt(squares)
    return weights


def judged(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """[id_col, host, path, rule, verdict, block_probability], one row per row of pages.

    The verdict is the longest fitting rule's, else block if the model's probability reaches `threshold`. The model learns
    from labelled[host, path, verdict]; by default from the urls that a rule fits, with the rule's verdict.

    * A null url, or one without ://, has an empty host and path, fits no rule and is judged by the model.
    * Repeated rows and null or repeated ids are passed through. An empty table gives an empty table.
    """
    url = pages[url_col]
    parts = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    model = pages.sparkSession.sparkContext.broadcast(fit(ruled.withColumnRenamed("ruled", "verdict") if labelled is None else labelled))

    def run(batches):
        weights = model.value
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 4096):
                part = batch.slice(lo, 4096)
                row, slot = _grams(part.column("host"), part.column("path"))
                n = np.bincount(row, minlength=part.num_rows)
                z = np.bincount(row, weights[slot], minlength=part.num_rows) / np.sqrt(np.maximum(n, 1)) + weights[-1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-z)))], [*part.schema.names, "block_probability"])

    kind = ruled.schema["id"].dataType.simpleString()
    out = ruled.mapInArrow(run, f"id {kind}, host string, path string, rule string, ruled string, block_probability double")
    verdict = F.coalesce("ruled", F.when(F.col("block_probability") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_probability")
