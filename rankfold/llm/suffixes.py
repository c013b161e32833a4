"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A string of `length` bytes is represented by one suffix: among the starts of its `head`-byte substrings the one with
the smallest hash. Neighbouring strings mostly share it, so a text of n bytes has about 2n / (length - head) indexed
suffixes, and equal strings pick equal suffixes. An index entry is a suffix (its first `head` bytes, the sort key, and a
hash of them), the fingerprint of the stretch of text covered by all strings it represents, and how often that pair
occurs. All places of a pair in one text are one row, so a text that repeats a line does not count once for each repeat.

Texts come in batches (SuffixLevels). Each batch becomes a suffix array in byte order; two levels of the same rank merge
into one of the next rank, so every entry is rewritten at most log2(batches) times. A new batch is merge-scanned against
the levels that it does not merge with, and a merged level is scanned for itself: both give the suffixes that the batch
makes repeated. Where a whole stretch repeats, all its strings do. Else the distinct stretches of a suffix are
brought together and their strings compared through fingerprints of all `length` bytes; suffixes with more than
TOGETHER distinct stretches are not gathered, their strings are grouped by fingerprint instead.

The same works on texts as sequences of words, each a 64-bit hash, with lengths counted in words. Its arrays are ordered
by the upper halves of the hashes of the first words.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import drop, kept

#: Most distinct stretches of one suffix that one task takes together, about 600 bytes each.
TOGETHER = 20_000

#: Text bytes per batch; there are two batches at least.
BATCH_BYTES = 1 << 40

#: Index entries per Arrow batch.
ENTRIES = 100_000

#: A longer text is indexed in parts of so many starts, each with what follows to complete the last string.
PART = 1 << 27
_POSITION = np.uint64((1 << 28) - 1)


def _units(buf: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """What strings consist of, and each text's range of it: the bytes, or a hash of each word."""
    if unit == "byte":
        return buf, offsets
    starts, ends, bounds = scan.word_spans(buf, offsets)
    return scan.word_hashes(buf, starts, ends), bounds


def _borders(raw: bytes, unit: str):
    """The bytes at which the units of one text start, and those before which they end."""
    if unit == "byte":
        return range(len(raw)), range(1, len(raw) + 1)
    return scan.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[:2]


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, from minima before and after block borders."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _stretches(buf: np.ndarray, offsets: np.ndarray, length: int, head: int):
    """(text, start in the text, number of strings, suffix key, stretch key, first units of the suffix) of each indexed suffix.

    A string picks the same suffix wherever it stands, so parts of a long text pick what the whole would. A stretch that is
    cut between parts is another stretch of its suffix, and stretches of one suffix are compared string by string.
    """
    if len(offsets) > 2 or len(buf) < PART + length:
        return _stretches_of(buf, offsets, length, head)
    parts = []
    for lo in range(0, len(buf) - length + 1, PART):
        part = buf[lo : lo + PART + length - 1]
        owner, start, *rest = _stretches_of(part, np.array([0, len(part)]), length, head)
        parts.append((owner, start + lo, *rest))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _stretches_of(buf: np.ndarray, offsets: np.ndarray, length: int, head: int):
    none = np.empty(0, np.int64)
    symbol = np.dtype(np.uint8) if buf.dtype == np.uint8 else np.dtype(">u4")  # a byte, or half of a word's hash
    nothing = (none, none, none, none, none, np.empty((0, head * symbol.itemsize), np.uint8))
    if len(buf) < length:
        return nothing
    prefix = scan.prefix_hashes(buf)
    place = np.arange(len(buf) - head + 1)
    order = scan.span_hashes(prefix, place, place + head)
    ranked = (order & ~_POSITION) | place.astype(np.uint64)
    chosen = (_window_minima(ranked, length - head + 1) & _POSITION).astype(np.int64)
    sizes = np.diff(offsets)
    starts_of = np.maximum(sizes - length + 1, 0)  # strings that each text has
    owner = np.repeat(np.arange(len(sizes)), starts_of)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(starts_of) - starts_of, starts_of) + offsets[owner]
    suffix = chosen[start]
    if not len(start):
        return nothing
    first = np.flatnonzero(np.concatenate(([True], (suffix[1:] != suffix[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.concatenate((first[1:], [len(start)])) - 1
    lo, hi, at = start[first], start[last], suffix[first]
    low = [buf[at + k].astype(np.uint64) & np.uint64(255) for k in (0, 1)]
    two = (low[0] << np.uint64(56)) | (low[1] << np.uint64(48))
    key = two | (order[at] >> np.uint64(16))
    stretch = scan.mix(scan.span_hashes(prefix, lo, hi + length) + (at - lo).astype(np.uint64))
    units = np.lib.stride_tricks.sliding_window_view(buf, head)[at]
    heads = np.ascontiguousarray(units if symbol == np.uint8 else units >> np.uint64(32), symbol).view(np.uint8)
    return owner[first], lo - offsets[owner[first]], hi - lo + 1, key.view(np.int64), stretch.view(np.int64), heads


def _pairs(owner: np.ndarray, key: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in an order in which those of one text with equal suffix and stretch stand together by place, and where each such group begins."""
    order = np.lexsort((stretch, key, owner))
    columns = [column[order] for column in (owner, key, stretch)]
    return order, np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def _indexed(length: int, head: int, unit: str):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in scan.pieces(batch.column("text")):
                found = _stretches(*_units(buf, offsets, unit), length, head)
                for first in range(0, len(found[0]), ENTRIES):
                    part = [column[first : first + ENTRIES] for column in found]
                    pair, begins = _pairs(*part[:1], *part[3:5])
                    start = part[1][pair]
                    owner, _, count, key, stretch, heads = (column[pair[begins]] for column in part)
                    starts = pa.ListArray.from_arrays(pa.array(np.append(begins, len(pair)).astype(np.int32)), pa.array(start.astype(np.int32)))
                    at = pa.array(owner + lo)
                    heads = scan.binary_rows(heads.ravel(), np.arange(len(heads) + 1) * heads.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [heads, pa.array(key), pa.array(stretch), batch.column("name").take(at), batch.column("n").take(at), starts, pa.array(count.astype(np.int32))],
                        ["head", "key", "stretch", "name", "n", "starts", "strings"],
                    )

    return run


def _stretch_texts(length: int, unit: str):
    """The bytes of each asked stretch."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw, asked = batch.column("text")[i].as_py().encode(), batch.column("asked")[i].as_py()
                begin, end = _borders(raw, unit)
                for lo in range(0, len(asked), 2000):
                    part = asked[lo : lo + 2000]
                    whose = pa.array(np.full(len(part), i))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x["key"] for x in part], pa.int64()),
                            pa.array([raw[begin[x["start"]] : end[x["start"] + x["strings"] + length - 2]] for x in part], pa.binary()),
                            pa.array([min(x["times"], 2) for x in part], pa.int32()),
                            batch.column("name").take(whose),
                            batch.column("n").take(whose),
                            pa.array([x["start"] for x in part], pa.int32()),
                        ],
                        ["key", "bytes", "times", "name", "n", "start"],
                    )

    return run


def _strings(table: pa.Table | pa.RecordBatch, length: int, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, fingerprint) of every string of some stretches."""
    buf, offsets = _units(*scan.text_bytes(table.column("bytes")), unit)
    count = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[row] + place
    return row, place, scan.span_hashes(scan.prefix_hashes(buf), starts, starts + length)


def _compared(length: int, unit: str):
    """Runs of repeated strings of stretches that come sorted by suffix, all of one suffix in one task."""

    def repeats(table: pa.Table) -> pa.RecordBatch:
        row, place, prints = _strings(table, length, unit)
        times = table.column("times").to_numpy()[row]
        order = np.argsort(prints)
        begin = np.flatnonzero(np.append(True, prints[order][1:] != prints[order][:-1])) if len(order) else order
        total = np.add.reduceat(times[order], begin) if len(order) else times
        again = np.zeros(len(row), bool)
        again[order] = np.repeat(total > 1, np.diff(np.append(begin, len(order))))
        again &= times == 1
        before = np.append(False, again[:-1] & (row[1:] == row[:-1])) if len(row) else again
        first = np.flatnonzero(again & ~before)
        after = np.append(again[1:] & (row[1:] == row[:-1]), False) if len(row) else again
        last = np.flatnonzero(again & ~after)
        at = pa.array(row[first])
        start = table.column("start").to_numpy()[row[first]] + place[first]
        names = [table.column(c).combine_chunks().take(at) for c in ("name", "n")]
        return pa.RecordBatch.from_arrays([*names, pa.array(start, pa.int32()), pa.array(last - first + 1, pa.int32())], ["name", "n", "start", "strings"])

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.nbytes for b in waiting) < 4 << 20:
                continue
            table = pa.Table.from_batches(waiting)
            keys = table.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last suffix may go on in the next batch
            if whole:
                yield repeats(table.slice(0, whole))
            waiting = table.slice(whole).to_batches()
        if waiting:
            yield repeats(pa.Table.from_batches(waiting))

    return run


def _fingerprints(length: int, unit: str):
    """One row per string of the stretches."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                row, place, prints = _strings(part, length, unit)
                at = pa.array(row)
                start = part.column("start").to_numpy()[row] + place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints.view(np.int64)), *(part.column(c).take(at) for c in ("times", "name", "n")), pa.array(start, pa.int32())],
                    ["print", "times", "name", "n", "start"],
                )

    return run


def _cut(length: int, with_text: bool, unit: str):
    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode()
                begin, stop = _borders(raw, unit)
                spans = sorted((int(begin[start]), int(stop[start + x["strings"] + length - 2])) for x in batch.column("spans")[i].as_py() for start in x["starts"])
                pieces, removed, runs, end = [], 0, 0, 0
                for lo, hi in spans:
                    if runs == 0 or lo > end:
                        pieces.append(raw[end:lo])
                        runs, removed, end = runs + 1, removed + hi - lo, hi
                    elif hi > end:
                        removed, end = removed + hi - end, hi
                pieces.append(raw[end:])
                rest = b"".join(pieces)
                out.append((removed, runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), batch.column("n"), *(pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string())))] if out
                else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())],
                ["name", "n", "n_removed", "n_spans", "sha", "rest"],
            )

    return run


def _merged(levels: list[DataFrame]) -> DataFrame:
    """One suffix array [head, key, stretch, times] from several, in byte order within hash partitions."""
    union = reduce(DataFrame.unionByName, [level.select("head", "key", "stretch", "times") for level in levels])
    return union.groupBy("head", "key", "stretch").agg(F.sum("times").alias("times")).sortWithinPartitions("head", "stretch")


def _repeated(level: DataFrame) -> DataFrame:
    """[key] of the suffixes that occur more than once in one level."""
    return level.groupBy("key").agg(F.sum("times").alias("total")).where("total > 1").select("key")


class SuffixLevels:
    """A logarithmic family of sparse suffix arrays, kept in the shared folder.

    After n batches of like size there are at most log2(n) + 1 levels. Empty batches are levels like others.
    """

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds suffixes [head, key, stretch, times]; returns [key] of (at least) those that the batch makes repeated.

        These are the suffixes of the batch that stand in it more than once or in any level, and those of levels that
        merged with it.
        """
        fresh = carry = kept(_merged([batch]), "level")
        rank = 0
        while rank in self.levels:
            merged = kept(_merged([self.levels[rank], carry]), "level")
            drop(self.levels.pop(rank))
            if carry is not fresh:
                drop(carry)
            carry, rank = merged, rank + 1
        found = [_repeated(carry), *(fresh.join(level, "head", "left_semi").select("key") for level in self.levels.values())]
        matches = kept(reduce(DataFrame.unionByName, found).distinct(), "matches")
        if carry is not fresh:
            drop(fresh)
        self.levels[rank] = carry
        return matches

    def stretches(self, keys: DataFrame) -> DataFrame:
        """[key, stretch, times] over all levels, of the given suffixes."""
        union = reduce(DataFrame.unionByName, [level.select("key", "stretch", "times") for level in self.levels.values()])
        return union.join(keys, "key", "left_semi").groupBy("key", "stretch").agg(F.sum("times").alias("times"))

    def release(self) -> None:
        """Deletes the levels."""
        for level in self.levels.values():
            drop(level)
        self.levels = {}


def repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, batches: int | None = None, with_text: bool = False
) -> DataFrame:
    """[id_col, n_bytes, n_removed, n_spans, kept_sha256], one row per row of docs; with_text adds kept_text.

    A byte of a text (as UTF-8) is removed if it is covered by a string of `length` bytes that also starts anywhere
    else, in the same or another row; overlaps count, and strings are judged on the input. n_spans counts maximal
    removed runs. kept_text is what remains, without bytes of characters that were cut in two; kept_sha256 counts those.
    The rows are dealt into `batches` by their texts; without a number, one for each BATCH_BYTES of text, two at least.

    * A null text is empty. A very long text is handled whole, in one task, with about 60 bytes of arrays per byte. Texts shorter than `length` lose nothing.
    * Every row is a text of its own: repeated rows of at least `length` bytes lose everything.
    * Null or repeated ids are passed through. An empty table gives an empty table. Other columns are ignored.
    """
    source = _named(docs, id_col, text_col)
    rows, changes = _changes(source, length, batches, with_text, "byte")
    if with_text:
        rows = source.withColumn("sha", F.sha2("text", 256))
    out = rows.join(changes, ["name", "n"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("new_sha", "sha").alias("kept_sha256"),
        *([F.coalesce("rest", "text").alias("kept_text")] if with_text else []),
    )


def without_repeats(
    docs: DataFrame, length: int = 400, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text", unit: str = "byte"
) -> DataFrame:
    """docs with all columns, each text cut as by repeated_strings(); bytes of characters that were cut in two go too.

    With unit "word", strings are runs of `length` words, equal whatever white space separates them; a run is cut from
    its first word to its last. A text of at least `length` words that occurs in several rows becomes empty.
    Rows whose text keeps its bytes are unchanged, null texts included; n_chars, if there is such a column, is counted anew.
    """
    _, changes = _changes(_named(docs, id_col, text_col), length, batches, True, unit)
    text = F.coalesce(docs[text_col], F.lit(""))
    on = (F.xxhash64(text) == changes["name"]) & (F.octet_length(text).cast("bigint") == changes["n"])
    new_text = F.coalesce(changes["rest"], docs[text_col])
    columns = {c: docs[c] for c in docs.columns} | {text_col: new_text}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changes["name"].isNotNull(), F.length(new_text).cast(kind)).otherwise(docs["n_chars"])
    return docs.join(changes, on, "left").select(*[column.alias(c) for c, column in columns.items()])


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """[id, text, name, n]: xxhash64 and the length name a text; all rows with one name share one result."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("name"), F.octet_length(text).cast("bigint").alias("n"))


def _changes(source: DataFrame, length: int, batches: int | None, with_text: bool, unit: str) -> tuple[DataFrame, DataFrame]:
    """All rows [id, name, n, sha], and [name, n, n_removed, n_spans, new_sha, rest] of the texts that lose bytes."""
    head = max(2, length // 4)
    units = F.col("n") if unit == "byte" else F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = kept(source.select("id", "name", "n", F.sha2("text", 256).alias("sha"), units.alias("units")), "texts")
    indexed = source.where(F.col("n") >= length).select("text", "name", "n")
    suffixes = kept(indexed.mapInArrow(_indexed(length, head, unit), "head binary, key bigint, stretch bigint, name bigint, n bigint, starts array<int>, strings int"), "suffixes")

    if batches is None:
        batches = max(2, -(-(rows.agg(F.sum("n")).first()[0] or 0) // BATCH_BYTES))
    index = SuffixLevels()
    dealt = suffixes.select("head", "key", "stretch", F.size("starts").cast("bigint").alias("times"), F.pmod("name", F.lit(batches)).alias("batch"))
    matches = [index.add(dealt.where(F.col("batch") == number)) for number in range(batches)]
    again = kept(index.stretches(reduce(DataFrame.unionByName, matches).distinct()), "again")
    for table in matches:
        drop(table)
    index.release()
    groups = again.groupBy("key").agg(F.count("*").alias("stretches"), F.min("times").alias("least"))
    hits = again.join(groups, "key").select("key", "stretch", "times", (F.col("times") > 1).alias("repeats"), ((F.col("stretches") > 1) & (F.col("least") == 1)).alias("compare"), "stretches")
    found = kept(suffixes.join(hits, ["key", "stretch"]).select("key", "stretch", "name", "n", "starts", "strings", "times", "stretches", "repeats", "compare"), "hits")
    drop(again)
    drop(suffixes)

    texts = rows.groupBy("name", "n").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.min("units").alias("units"))
    one = F.struct("name", "n", F.array_min("starts").alias("start"), "strings", F.least("times", F.lit(2)).cast("int").alias("times"), (F.col("stretches") > TOGETHER).alias("many"))
    asked = found.where("compare").groupBy("key", "stretch").agg(F.min(one).alias("p")).select("key", "p.*")
    asked = asked.groupBy("name", "n").agg(F.collect_list(F.struct("key", "start", "strings", "times", "many")).alias("asked"))
    need = found.where("repeats or compare").select("name", "n").distinct().join(texts.drop("units"), ["name", "n"])
    need = need.join(asked, ["name", "n"], "left").where("copies = 1 or asked is not null")
    need = need.select(F.col("id").alias("first"), F.col("name").alias("need_name"), F.col("n").alias("need_n"), "copies", "asked")
    same = source.id.eqNullSafe(need["first"]) & (source.name == need.need_name) & (source.n == need.need_n)
    wanted = kept(source.where(F.col("n") >= length).join(need, same).select("name", "n", "text", "copies", "asked"), "wanted")

    kind = "key bigint, bytes binary, times int, name bigint, n bigint, start int"
    few, many = F.expr("filter(asked, x -> NOT x.many)"), F.expr("filter(asked, x -> x.many)")
    asking = wanted.where("asked is not null").select("text", "name", "n", few.alias("asked"), many.alias("many"))
    together = asking.where("size(asked) > 0").drop("many").mapInArrow(_stretch_texts(length, unit), kind)
    together = together.repartition("key").sortWithinPartitions("key")
    singles = together.mapInArrow(_compared(length, unit), "name bigint, n bigint, start int, strings int")
    hot = asking.where("size(many) > 0").select("text", "name", "n", F.col("many").alias("asked"))
    if hot.limit(1).count():
        prints = hot.mapInArrow(_stretch_texts(length, unit), kind).mapInArrow(_fingerprints(length, unit), "print bigint, times int, name bigint, n bigint, start int")
        prints = kept(prints, "prints")
        again = prints.groupBy("print").agg(F.sum("times").alias("total")).where("total > 1").select("print")
        more = prints.where("times = 1").join(again, "print").select("name", "n", "start", F.lit(1).alias("strings"))
        singles = singles.unionByName(more)
    spans = found.where("repeats").select("name", "n", "starts", "strings").unionByName(singles.select("name", "n", F.array("start").alias("starts"), "strings"))
    spans = spans.groupBy("name", "n").agg(F.collect_list(F.struct("starts", "strings")).alias("spans"))
    cut = wanted.where("copies = 1").join(spans, ["name", "n"]).select("text", "name", "n", "spans")
    cut = cut.mapInArrow(_cut(length, with_text, unit), "name bigint, n bigint, n_removed bigint, n_spans bigint, sha string, rest string")

    gone = texts.where(F.col("copies") > 1).where(F.col("units") >= length)
    gone = gone.select("name", "n", F.col("n").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.sha2(F.lit(""), 256).alias("sha"), F.lit("").alias("rest"))
    return rows, cut.unionByName(gone).withColumnRenamed("sha", "new_sha")
