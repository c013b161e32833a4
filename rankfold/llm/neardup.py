"""Near-duplicate documents from banded SetSketch registers, with exact confirmation.

Each text becomes the set of its word shingles. Equal sets fall together by a 128-bit key. Registers of the
remaining sets are cut into bands; sets that agree in a band are candidates. A candidate pair must have a
likely similarity near the threshold (joint likelihood of the registers) and is then confirmed on its full sets.

A bucket first pairs its members with one leader; a text is compared with the leader it shares most bands with, then
with its other leaders as far as they are still in other components. In buckets that even then hold several components,
all members outside the main one are compared with the whole bucket, block by block: every pair of texts that agree in
a band ends up in one component or has been tested. These pairs never become rows: members that have a likely partner get
their full sets, a job confirms its pairs itself, leaves out those that it has joined already, and returns the edges of a
spanning forest. So rows grow with members and blocks.

A text is named by the smallest id of its documents and then its set, so the smallest name of a component holds its smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan, setsketch
from .components import components
from .shared import drop, kept

REGISTERS, BAND = 288, 6
#: Estimates may fall short of the true similarity by this much (five and a half standard deviations at 0.8).
SLACK = 0.13
#: Members of a bucket, and elements of their sets, that are compared with as many others at once. Units of work, not bounds.
BLOCK, BLOCK_ELEMENTS = 256, 1 << 19


def _sets_of(column: pa.Array, shingle: int):
    """(first row, end row, sorted element hashes, ranges) of each piece of a text column."""
    for lo, hi, buf, offsets in scan.pieces(column):
        text = scan.lower(buf)
        starts, ends, bounds = scan.word_spans(text, offsets)
        yield lo, hi, *scan.shingle_sets(scan.word_hashes(text, starts, ends), bounds, shingle)


def _set_keys(keys: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Two independent 64-bit sums over the elements of each set, as rows of 16 bytes."""
    halves = []
    for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        total = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(scan.mix(keys ^ np.uint64(salt)), out=total[1:])
        halves.append(scan.mix((total[ranges[1:]] - total[ranges[:-1]]) ^ np.uint64(salt) ^ np.diff(ranges).astype(np.uint64)))
    return np.ascontiguousarray(np.stack(halves, axis=1)).astype("<u8")


def _sketched(shingle: int):
    def run(batches):
        for batch in batches:
            for lo, hi, keys, ranges in _sets_of(batch.column("text"), shingle):
                n = np.diff(ranges)
                names = _set_keys(keys, ranges)
                regs = setsketch.registers(keys, ranges, REGISTERS)
                step = np.arange(hi - lo + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        scan.binary_rows(names, 2 * step).cast(pa.binary()),
                        scan.binary_rows(regs, REGISTERS * step).cast(pa.binary()),
                    ],
                    ["id", "n", "key", "registers"],
                )

    return run


def _banded(batches):
    for batch in batches:
        raw, _ = scan.text_bytes(batch.column("registers"))
        for lo in range(0, batch.num_rows, 4096):
            table = raw.view(np.uint16).reshape(-1, REGISTERS)[lo : lo + 4096]
            hashes = setsketch.band_hashes(table, BAND).view(np.int64)
            at = pa.array(np.repeat(np.arange(lo, lo + len(table)), hashes.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.ravel()), batch.column("key").take(at), batch.column("n").take(at)], ["bucket", "key", "n"])


def _likely(least: float):
    def run(batches):
        for batch in batches:
            left, right = (scan.text_bytes(batch.column(c))[0].view(np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("na", "nb")]
            keep = setsketch.joint_similarity(left, right, *sizes) >= least if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _with_sets(shingle: int):
    def run(batches):
        for batch in batches:
            for lo, hi, keys, ranges in _sets_of(batch.column("text"), shingle):
                names = scan.binary_rows(_set_keys(keys, ranges), 2 * np.arange(hi - lo + 1)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([names, scan.binary_rows(keys, ranges).cast(pa.binary())], ["key", "elements"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, as sorted arrays, reach the similarity."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(column: pa.Array) -> list[np.ndarray]:
    raw, offsets = scan.text_bytes(column)
    return np.split(raw.view(np.uint64), offsets[1:-1] // 8)


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = [_linked(x, y, percent) for x, y in zip(*(_sets(batch.column(c)) for c in ("ea", "eb")))] if batch.num_rows else []
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


_LOWEST = -(1 << 63)


def _name(first: str, key: str):
    """A binary name of a set that orders by the smallest id of its documents, null last, and then by half of its key.

    Sets of one id are told apart by 64 bits; those of different ids always differ. 17 bytes, as names go through all bands.
    """
    number = F.lpad(F.hex(F.coalesce(F.col(first), F.lit(0)).bitwiseXOR(F.lit(_LOWEST))), 16, "0")
    return F.concat(F.when(F.col(first).isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), F.unhex(number), F.substring(key, 1, 8))


def _first_of(name):
    """The smallest id in a name."""
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(_LOWEST))
    return F.when(F.substring(name, 1, 1) == F.unhex(F.lit("00")), number)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """[id_col, n_shingles, component_id, kept], one row per row of docs.

    Words are maximal runs of non-space characters of the text with A-Z lower-cased. Documents whose sets of
    distinct `shingle`-word runs satisfy 100 * |intersection| >= percent * |union| are linked; component_id is
    the smallest id that is reachable over links, itself included; kept is true where it is the row's own id.

    * A text with fewer words is one shingle; a null, empty or blank one has an empty set and no links.
    * Repeated rows and rows sharing an id are rows of their own; equal sets are always linked.
    * A null id is never the smallest unless all are null; its row is not kept unless its component has no id.
    * An empty table gives an empty table. Other columns are ignored, whatever their names.

    Needs a shared folder (spark.checkpoint.dir). Sketches are 576 bytes per document; full sets are made
    only for documents that share a band with another text.
    """
    source = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    rows = kept(source.mapInArrow(_sketched(shingle), "id bigint, n bigint, key binary, registers binary"), "sketches")
    texts = rows.where("n > 0").groupBy(F.col("key").alias("set")).agg(F.min("id").alias("first"), F.max("n").alias("n"), F.first("registers").alias("registers"))
    texts = kept(texts.select("set", "first", _name("first", "set").alias("key"), "n", "registers"), "sets")
    bands = texts.select("key", F.col("n").cast("int").alias("n"), "registers").mapInArrow(_banded, "bucket bigint, key binary, n int")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct("key", "n")).alias("leader")).where("members > 1")
    members = kept(bands.join(sizes, "bucket").select("bucket", "key", "n", "members", F.col("leader.key").alias("leader"), F.col("leader.n").alias("leader_n")), "buckets")

    firsts = texts.join(members.select("key").distinct(), "key", "left_semi").select(F.col("first").alias("id")).distinct()
    wanted = source.join(firsts, source.id.eqNullSafe(firsts.id), "left_semi")
    elements = wanted.select("text").mapInArrow(_with_sets(shingle), "set binary, elements binary")
    elements = elements.groupBy("set").agg(F.first("elements").alias("elements")).join(texts.select("set", "key"), "set")
    elements = kept(elements.select("key", "elements"), "elements")

    fits = f"100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)"
    stars = members.where("key <> leader").where(fits).groupBy(F.col("leader").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("bands"))
    stars = kept(stars, "stars")
    best = stars.groupBy("b").agg(F.min(F.struct((-F.col("bands")).alias("bands"), "a")).alias("x")).select("x.a", "b")
    found = [_links(best, texts, elements, percent)]
    roots = components(found[0])
    rest = _across(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), roots)
    found.append(_links(rest, texts, elements, percent))
    if not found[-1].isEmpty():
        roots = components(found[0].unionByName(found[1]))
    opened = kept(_opened(members, roots), "open")
    drop(members)
    drop(stars)
    active = opened.join(texts.select("key", "registers"), "key").repartition("job").sortWithinPartitions("job").mapInArrow(_active(percent), _JOB)
    active = kept(active, "active")
    jobs = active.join(elements, "key").repartition("job").sortWithinPartitions("job")
    found.append(kept(jobs.mapInArrow(_forest(percent), "a binary, b binary"), "links"))
    if not found[-1].isEmpty():
        roots = components(found[0].unionByName(found[1]).unionByName(found[2]))
    for table in (elements, opened, active, *found):
        drop(table)
    name = F.coalesce("root", "key")
    classes = texts.select("set", "key").join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    classes = classes.select(F.col("set").alias("key"), _first_of(name).alias("component_id"))
    out = rows.select("id", "n", "key").join(classes, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, that near_duplicates() keeps: one document of each group.

    Of repeated rows (same doc_id and text) one stays. Rows with a null doc_id stay unless linked to a document with an id.
    """
    stay = near_duplicates(docs.select("doc_id", "text"), shingle=shingle, percent=percent).where("kept").select("doc_id").distinct()
    return docs.join(stay, docs.doc_id.eqNullSafe(stay.doc_id), "left_semi").dropDuplicates(["doc_id", "text"])


def _links(pairs: DataFrame, texts: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """The pairs that are likely by their registers and linked by their full sets."""
    side = lambda c: texts.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    near = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return _in_full(near.mapInArrow(_likely(percent / 100 - SLACK), "a binary, b binary"), elements, percent)


def _in_full(near: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked by their full sets."""
    full = lambda c: elements.select(F.col("key").alias(c), F.col("elements").alias(f"e{c}"))
    return kept(near.join(full("b"), "b").join(full("a"), "a").mapInArrow(_confirmed(percent), "a binary, b binary"), "links")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs [a, b] whose texts are still in different components."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    rooted = pairs.join(of("b"), "b", "left").join(of("a"), "a", "left")
    return rooted.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


_JOB = "job bigint, side int, bucket bigint, key binary, root binary, n int, registers binary"


def _likely_pairs(rows: pa.Table, percent: int):
    """Numbers of likely pairs in different components, from rows sorted by job; side 0 meets side 1, side 2 meets itself."""
    registers = scan.text_bytes(rows.column("registers").combine_chunks())[0].view(np.uint16).reshape(-1, REGISTERS)
    root = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
    job, side, n, bucket = (rows.column(c).to_numpy() for c in ("job", "side", "n", "bucket"))
    bands = np.concatenate([setsketch.band_hashes(registers[lo : lo + 4096], BAND) for lo in range(0, len(job), 4096)])
    band = (bands.view(np.int64) == bucket[:, None]).argmax(axis=1)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    lo, hi = (np.searchsorted(job[right], job[left], x) for x in ("left", "right"))
    start, ends = 0, np.cumsum(hi - lo)
    while start < len(left):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 18), "right")))
        count = hi[start:stop] - lo[start:stop]
        x = np.repeat(left[start:stop], count)
        y = right[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo[start:stop], count)]
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        keep = (root[x] != root[y]) & (100 * small.astype(np.int64) >= percent * large.astype(np.int64)) & ((side[x] != 2) | (x < y))
        x, y = x[keep], y[keep]
        for at in range(0, len(x), 8192):
            i, j = x[at : at + 8192], y[at : at + 8192]
            same = (registers[i] == registers[j])[:, : REGISTERS // BAND * BAND].reshape(len(i), -1, BAND).all(axis=2)
            first = same.any(axis=1) & (same.argmax(axis=1) == band[i])  # a pair counts in the first band that it shares
            i, j = i[first], j[first]
            if len(i):
                likely = setsketch.joint_similarity(registers[i], registers[j], n[i].astype(float), n[j].astype(float)) >= percent / 100 - SLACK
                yield i[likely], j[likely]
        start = stop


def _by_job(work):
    """work(rows of whole jobs) over batches sorted by job."""

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            job = batch.column("job").to_numpy()
            whole = int(np.searchsorted(job, job[-1]))  # the last job may go on in the next batch
            if held and held[-1].column("job")[-1].as_py() != job[0]:
                yield from work(pa.Table.from_batches(held))
                held = []
            if whole:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held = []
            held.append(batch.slice(whole))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _active(percent: int):
    """The rows that have a likely partner in their job."""

    def work(rows: pa.Table):
        seen = np.zeros(rows.num_rows, bool)
        for i, j in _likely_pairs(rows, percent):
            seen[i] = seen[j] = True
        yield from rows.select([c.split()[0] for c in _JOB.split(", ")]).filter(pa.array(seen)).to_batches()

    return _by_job(work)


def _forest(percent: int):
    """Linked pairs [a, b] that join all components that the likely pairs of each job can join."""

    def work(rows: pa.Table):
        sets = _sets(rows.column("elements").combine_chunks())
        names = rows.column("key").combine_chunks()
        at = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy().tolist()
        parent = list(range(max(at) + 1))

        def find(k):
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        edges = []
        for left, right in _likely_pairs(rows, percent):
            for i, j in zip(left.tolist(), right.tolist()):
                x, y = find(at[i]), find(at[j])
                if x != y and _linked(sets[i], sets[j], percent):
                    parent[x] = y
                    edges.append((i, j))
        i, j = np.array(edges, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j))], ["a", "b"])

    return _by_job(work)


def _opened(members: DataFrame, roots: DataFrame) -> DataFrame:
    """[job, side, bucket, key, root, n]: the work left in buckets that hold several components.

    The members outside the largest component of a bucket meet each other and all the rest, in jobs of two blocks.
    """
    root = roots.select(F.col("node").alias("key"), "root")
    rooted = members.where("members > 2").select("bucket", "key", "n").join(root, "key", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "key"))
    held = rooted.groupBy("bucket", "root").agg(F.count("*").alias("held"), F.sum("n").alias("elements"))
    sizes = held.groupBy("bucket").agg(
        F.max(F.struct("held", "root", "elements")).alias("main"), F.sum("held").alias("members"), F.sum("elements").alias("elements"), F.count("*").alias("roots")
    )
    blocks = lambda n, elements: F.ceil(F.greatest(n / BLOCK, elements / BLOCK_ELEMENTS))
    strays = blocks(F.col("members") - F.col("main.held"), F.col("elements") - F.col("main.elements"))
    sizes = sizes.where("roots > 1").select("bucket", F.col("main.root").alias("main"), strays.alias("strays"), blocks(F.col("main.held"), F.col("main.elements")).alias("others"))
    open_ = rooted.join(sizes, "bucket").withColumn("stray", F.col("root") != F.col("main"))
    block = F.pmod(F.xxhash64("key"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("others")))
    last = F.when(F.col("stray"), F.col("strays") + F.col("others")).otherwise(F.col("strays")) - 1
    met = open_.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    own = F.when(F.col("stray"), F.col("block")).otherwise(F.col("block") + F.col("strays"))
    side = F.when(F.col("with") == own, 2).when(own < F.col("with"), 0).otherwise(1)
    job = F.xxhash64("bucket", F.least(own, "with"), F.greatest(own, "with"))
    return met.select(job.alias("job"), side.cast("int").alias("side"), "bucket", "key", "root", "n")
