"""The registered queries of this subpackage. Each reads whole tables of sf_dir."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, licenses, mixing, periodic, quality, suffixes, topk, trie, urls, warc
from .neardup import near_duplicates
from .shared import documents

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[run.__name__] = run
    return run


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which a benchmark item is found, with its scores."""
    return decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


#: Weights of the sources in code-point order, repeating.
MIX_WEIGHTS = [3.0, 1.0, 2.0]


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document a mix of 150% of all words takes."""
    return mixing.mixture(documents(spark, sf_dir), MIX_WEIGHTS, share=1.5, ceiling=2.0).drop("copies")


@_query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn by importance resampling towards the good labels."""
    return quality.resampled(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).drop("key")


@_query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures of every document."""
    return licenses.digest(licenses.scanned(documents(spark, sf_dir)))


@_query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter of them is held out of the training."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False)).alias("held_out")
    models = language.train(docs.where(~held_out))
    found = language.identify(docs, models, "doc_id", "text", held_out)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


@_query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to seekable archives and read back."""
    read = warc.archived(documents(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Verdict, and host with a path prefix.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@_query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urls.judged(documents(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_probability")


@_query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    return topk.top_k(documents(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


ORACLES["op8_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v, row_number() OVER () AS n
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, q.n, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@_query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a similarity of 0.8 of their two-word shingles, with components."""
    return near_duplicates(documents(spark, sf_dir), shingle=2, percent=80)


@_query
def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that stand anywhere else too."""
    return suffixes.repeated_strings(documents(spark, sf_dir), length=400, with_text=True)


@_query
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded to token ids and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.decoded(bpe.encoded(documents(spark, sf_dir), path, public_tokenizers.PATTERN), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _crc32(column: str):
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8"))


def with_periods(docs: DataFrame) -> DataFrame:
    """[doc_id, text]: the words of a tenth of the texts repeat with a period from some word on."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", _crc32("doc_id").alias("h"))
    tenth = (F.col("h") % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    # the words of the other texts stay where they are
    rows = rows.withColumn("w", F.when(tenth, words)).withColumn("n", F.size("w").cast("bigint"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words with a short period in every text, and the texts without the repeats."""
    found = periodic.periodic_runs(with_periods(documents(spark, sf_dir)))
    stronger = lambda x, y: F.when(x.isNull() | (y["length"] * x["period"] > x["length"] * y["period"]), y).otherwise(x)
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.aggregate("runs", nothing, stronger).alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).selectExpr(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", "(1000 * best.length) div best.period AS exponent_milli", "runs_sha256", "collapsed_sha256"
    )


@_query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the conversations, rebuilt so that five neighbours begin alike."""
    stem = F.expr("conv_id - conv_id % 5")
    return trie.prefix_trie(documents(spark, sf_dir, "conversations"), stem, _crc32("conv_id") % 9).drop("node")


ORACLES["op13_conversation_trie"] = """
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT conv_id, conv_id - conv_id % 5 AS stem, (4294967295 - list_reduce(list_transform(range(0, strlen(s) + 1),
            lambda i: if(i = 0, 4294967295::BIGINT, ascii(substr(s, i, 1))::BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 1, 2, 3, 4, 5, 6, 7, 8],
            lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 9 AS h
    FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM own)
), rebuilt AS (
    SELECT i.conv_id, p, role, text FROM ids i JOIN own o ON o.conv_id = i.stem AND p <= h
    UNION ALL SELECT i.conv_id, p, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND p > h
), named AS (
    SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
        md5(string_agg(md5(concat(strlen(role), ':', role, text)), '') OVER w) AS node
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), path AS (
    SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS node, NULL AS parent FROM ids
    UNION ALL SELECT conv_id, depth, bytes, node, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) FROM named
), nodes AS (
    SELECT node, depth, any_value(bytes) AS bytes, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs
    FROM path GROUP BY node, depth
), children AS (
    SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
    SELECT p.node, CAST(sum((v.n_convs - 1) * v.bytes) AS BIGINT) AS saved_tokens, count(*) FILTER (c.parent IS NULL) AS n_leaves
    FROM nodes v LEFT JOIN children c ON c.parent = v.node JOIN path p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.node
), ends AS (
    SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
    FROM path JOIN (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id) USING (conv_id, depth) GROUP BY node
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children,
    n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes v JOIN below b ON b.node = v.node LEFT JOIN children c ON c.parent = v.node
LEFT JOIN nodes p ON p.node = v.parent LEFT JOIN ends e ON e.node = v.node
"""
