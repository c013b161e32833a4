"""Prefix trie of conversations: every distinct sequence of first turns, with what lies below it.

A conversation is the path of its prefixes; a prefix is named by a 128-bit hash of its turns. Each task inserts its
conversations, in batches, into a z-fast trie: nodes with one child are merged into edges, and a hash table finds a node by
its handle, the prefix at the two-fattest depth on its edge. A fat binary search over depths finds where a conversation leaves
the trie, in about log2(depth) look-ups; it is then added there, splitting the edge. Counts run up the compacted trie, the edges
are expanded, and prefixes of all tasks meet in a grouping by name: a task sends each prefix once, however many of its
conversations begin with it.

Sums over subtrees need no walk by levels. A node is represented by its smallest conversation; the nodes of one
representative are the lower end of its own path. So what a subtree holds of distinct prefixes is the sum, over the conversations
in it, of what they represent, and one more expansion of the representatives' paths gives it at every depth.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import kept

#: Turns on the paths that a trie holds when a task sends it on and begins a new one.
TRIE_TURNS = 1 << 20
#: Ids per chunk in the lists of members.
CHUNK_IDS = 1 << 15
#: Parents with more than this share of all nodes as children are joined by broadcast, so at most 1 / share of them are.
HOT_SHARE = 1e-4


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return high >> ((low ^ high).bit_length() - 1) << ((low ^ high).bit_length() - 1)


class ZFastTrie:
    """Paths of hashes by depth, compacted; entry d of a path names its first d turns."""

    def __init__(self):
        self.turns = 0
        self.path: list[list[bytes]] = []  # a path through the node
        self.top: list[int] = []  # the depth above its edge
        self.end: list[int] = []  # its own depth
        self.ended: list[list[int]] = []  # smallest conversation, number and bytes of those that end here
        self.bytes: list[np.ndarray] = []  # bytes of the path's turns up to each depth
        self.handle: dict[bytes, int] = {}  # node by the prefix at its two-fattest depth
        self.first: dict[bytes, int] = {}  # node by the first prefix on its edge
        self.extent: dict[bytes, int] = {}  # node by its own prefix

    def _node(self, path, upto, top, end) -> int:
        self.path.append(path)
        self.bytes.append(upto)
        self.top.append(top)
        self.end.append(end)
        self.ended.append([0, 0, 0])
        new = len(self.path) - 1
        self._enter(new)
        return new

    def _enter(self, v: int) -> None:
        path, top, end = self.path[v], self.top[v], self.end[v]
        self.handle[path[two_fattest(top, end) if end else 0]] = v
        self.first[path[min(top + 1, end)]] = v
        self.extent[path[end]] = v

    def locate(self, path: list[bytes], known: int = -1) -> int:
        """The depth of the deepest node whose prefix the path has (-1: none); `known` is one that it has."""
        low, high = known, len(path) - 1
        if low < 0:
            if path[0] not in self.extent:
                return -1
            low = 0
        while low < high:
            f = two_fattest(low, high)
            v = self.handle.get(path[f])
            if v is None:
                high = f - 1
            elif self.end[v] < len(path) and self.path[v][self.end[v]] == path[self.end[v]]:
                low = self.end[v]
            else:
                return self.top[v]  # it leaves the trie on the edge of v
        return low

    def insert(self, path: list[bytes], upto: np.ndarray, number: int, at: int) -> None:
        """Add a conversation whose path has a node at depth `at`."""
        depth = len(path) - 1
        at = self.locate(path, at)
        if at < 0:
            v = self._node(path[:1], upto[:1], -1, 0)
            at = 0
        if at < depth:
            v = self.first.get(path[at + 1])
            if v is not None:  # the exit node: the path goes some way down its edge
                low, high = at + 1, min(self.end[v], depth)
                while low < high:
                    middle = (low + high + 1) // 2
                    if self.path[v][middle] == path[middle]:
                        low = middle
                    else:
                        high = middle - 1
                del self.handle[self.path[v][two_fattest(self.top[v], self.end[v])]]
                self._node(self.path[v], self.bytes[v], at, low)
                self.top[v] = at = low
                self._enter(v)
            if at < depth:
                self._node(path, upto, at, depth)
                self.turns += depth
        ended = self.ended[self.extent[path[depth]]]
        ended[0] = min(ended[0], number) if ended[1] else number
        ended[1] += 1
        ended[2] += int(upto[depth])

    def insert_all(self, batch: list[tuple[list[bytes], np.ndarray, int]]) -> None:
        """Find all exits first; nodes never go, so an exit found before other insertions is still on the path."""
        exits = [self.locate(path) for path, _, _ in batch]
        for (path, upto, number), at in zip(batch, exits):
            self.insert(path, upto, number, at)

    def expanded(self) -> pa.RecordBatch | None:
        """A row per prefix: name, name of its parent, depth, bytes up to it and of its last turn, and its members."""
        if not self.path:
            return None
        totals = [list(e) for e in self.ended]
        for v in sorted(range(len(self.path)), key=self.end.__getitem__, reverse=True):
            if self.end[v]:
                above = totals[self.extent[self.path[v][self.top[v]]]]
                above[0] = min(above[0], totals[v][0]) if above[1] else totals[v][0]
                above[1] += totals[v][1]
                above[2] += totals[v][2]
        size = np.array([e - t for e, t in zip(self.end, self.top)])
        own, parent, upto = [], [], []
        for path, sums, top, end in zip(self.path, self.bytes, self.top, self.end):
            own += path[top + 1 : end + 1]
            parent += path[max(top, 0) : end] if end else [None]
            upto.append(sums[top + 1 : end + 1])
        depth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(np.array(self.top), size) + 1
        members = np.array(totals, np.int64)
        upto = np.concatenate(upto)
        last = np.diff(upto, prepend=0)
        edges = np.cumsum(size) - size
        before = [int(s[t]) if t >= 0 else 0 for s, t in zip(self.bytes, self.top)]
        last[edges] = upto[edges] - np.array(before)
        columns = [pa.array(own, pa.binary()), pa.array(parent, pa.binary()), pa.array(depth), pa.array(upto), pa.array(last)]
        columns += [pa.array(np.repeat(members[:, k], size)) for k in range(3)]
        return pa.RecordBatch.from_arrays(columns, ["node", "parent", "depth", "upto", "bytes", "conv_id", "n_convs", "total"])


_NODES = "node binary, parent binary, depth bigint, upto bigint, bytes bigint, conv_id bigint, n_convs bigint, total bigint"


def _tries(batches):
    trie = ZFastTrie()
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        raw, offsets = scan.text_bytes(batch.column("path"))
        names, sums = raw.tobytes(), batch.column("upto")
        ends = sums.offsets.to_numpy() - sums.offsets[0].as_py()
        flat = sums.flatten().to_numpy()
        rows = []
        for i, number in enumerate(ids):
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            rows.append(([names[k : k + 16] for k in range(lo, hi, 16)], flat[ends[i] : ends[i + 1]].copy(), number))
        trie.insert_all(rows)
        if trie.turns >= TRIE_TURNS:
            yield trie.expanded()
            trie = ZFastTrie()
    if trie.path:
        yield trie.expanded()


def _chunks(batches):
    """Sorted rows (end, conv_id) as rows (end, first id, ids joined by commas)."""
    held_end, held = None, []

    def out():
        return pa.RecordBatch.from_pydict({"end": [held_end], "first": [held[0]], "ids": [",".join(map(str, held))]})

    for batch in batches:
        for end, number in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (end != held_end or len(held) >= CHUNK_IDS):
                yield out()
                held = []
            held_end = end
            held.append(number)
    if held:
        yield out()


def _digests(batches):
    """Rows (end, first id, ids) in order as rows (end, SHA-256 of all its ids joined by commas)."""
    held, digest = None, None

    def out():
        return pa.RecordBatch.from_pydict({"node": [held], "ends_sha256": [digest.hexdigest()]})

    for batch in batches:
        for end, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
            if end == held:
                digest.update(b"," + ids.encode())
                continue
            if held is not None:
                yield out()
            held, digest = end, hashlib.sha256(ids.encode())
    if held is not None:
        yield out()


def paths(turns: DataFrame, stem: Column | None = None, borrowed: Column | None = None) -> DataFrame:
    """[conv_id, path, upto]: a row per conversation of turns [conv_id, turn, role, text].

    path holds a 16-byte name for each number of first turns, from none; upto the UTF-8 bytes of their texts. With `stem` and
    `borrowed`, expressions of conv_id, the first `borrowed` turns of conversation `stem` (at most 15; all if it has fewer,
    none if it is absent) stand in front of the conversation's own turns after its first `borrowed`.
    """
    stem, borrowed = stem if stem is not None else F.col("conv_id"), borrowed if borrowed is not None else F.lit(0)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = lambda salt: F.xxhash64(F.lit(salt), F.octet_length(role), role, text)
    rows = turns.where(turns.conv_id.isNotNull()).select(
        turns.conv_id.cast("bigint").alias("conv_id"), turns.turn.cast("bigint").alias("turn"), one(1).alias("a"), one(2).alias("b"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    rows = rows.select(stem.cast("bigint").alias("stem"), borrowed.cast("int").alias("borrowed"), "*")
    rows = rows.repartition("stem").sortWithinPartitions("stem", F.col("conv_id") != F.col("stem"), "conv_id", F.asc_nulls_first("turn"), "a", "b")
    return rows.mapInArrow(_rebuilt, "conv_id bigint, path binary, upto array<bigint>")


_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _path(turns: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Names and byte sums of all prefixes; a name sums the scrambled (place, turn) up to it."""
    n = len(turns)
    names = np.zeros((n + 1, 2), np.uint64)
    place = np.arange(1, n + 1, dtype=np.uint64)
    for k in range(2):
        np.cumsum(scan.mix(turns[:, k] + scan.mix(place * _STEPS[k])), out=names[1:, k])
    return names.tobytes(), np.concatenate(([0], np.cumsum(sizes)))


def _rebuilt(batches):
    """Conversations from turns in order: those of one stem follow each other, the stem first."""
    stem, front = None, (np.empty((0, 2), np.uint64), np.empty(0, np.int64))
    held: list[pa.RecordBatch] = []

    def whole(rows: pa.Table):
        nonlocal stem, front
        number, family, skip = (rows.column(c)[0].as_py() for c in ("conv_id", "stem", "borrowed"))
        turns = np.stack([rows.column(c).to_numpy() for c in ("a", "b")], axis=1).view(np.uint64)
        sizes = rows.column("size").to_numpy()
        if family != stem:
            stem, front = family, (turns[:0], sizes[:0])
        if number == family:
            front = turns[:15], sizes[:15]
        turns = np.concatenate((front[0][:skip], turns[skip:]))
        return number, *_path(turns, np.concatenate((front[1][:skip], sizes[skip:])))

    def table(rows):
        ids, names, sums = zip(*rows)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sums])))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sums), pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.binary()), lists], ["conv_id", "path", "upto"])

    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column("conv_id").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(number)])).tolist()
        if held and held[-1].column("conv_id")[-1].as_py() != number[0]:
            yield table([whole(pa.Table.from_batches(held))])
            held = []
        rows = []
        for lo, hi in zip(cuts[:-2], cuts[1:-1]):
            rows.append(whole(pa.Table.from_batches([*held, batch.slice(lo, hi - lo)])))
            held = []
        if rows:
            yield table(rows)
        held.append(batch.slice(cuts[-2]))
    if held:
        yield table([whole(pa.Table.from_batches(held))])


def prefix_trie(turns: DataFrame, stem: Column | None = None, borrowed: Column | None = None) -> DataFrame:
    """[node, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256], a row per prefix.

    turns are [conv_id, turn, role, text]; a conversation is its turns by `turn`, null first, those of equal `turn` in an order
    that depends on their role and text only. A prefix at depth d is a distinct sequence of first d pairs (role, text); its
    members are the conversations that begin with it. conv_id is the smallest member, parent_conv_id its parent's (null for
    the root), n_children and n_leaves count children and childless prefixes below or at it, saved_tokens sums
    (members - 1) * UTF-8 bytes of the last text below and at it; ends_sha256 is the hex SHA-256 of the comma-joined ids of
    members with no further turn. node names the prefix. `stem` and `borrowed` rebuild conversations first, see paths().

    * A null role or text is an empty one; a conversation may be left without turns and is then a member of the root only.
    * Turns without a conv_id take no part. Repeated rows are turns of their own. An empty table has no prefixes.
    * Very long texts are hashed where they are read. The turns of one conversation are sorted by Spark and then held in
      one task with 40 bytes each, however long their texts are.
    * Other columns are ignored, whatever their names. Needs a shared folder (spark.checkpoint.dir).
    """
    rebuilt = kept(paths(turns.select("conv_id", "turn", "role", "text"), stem, borrowed), "paths")
    local = rebuilt.mapInArrow(_tries, _NODES)
    nodes = local.groupBy("node").agg(
        *(F.first(c).alias(c) for c in ("parent", "depth", "upto", "bytes")), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("total").alias("total")
    )
    nodes = kept(nodes, "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = kept(nodes.join(children, "node", "left").fillna(0, ["n_children"]), "nodes")

    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.min_by("n_children", -F.col("depth")).alias("below"))
    name = lambda d: F.substring("path", d * 16 + 1, F.lit(16))
    step = F.explode(F.sequence(F.lit(0), F.size("upto") - 1)).alias("d")
    held = rebuilt.join(owned, "conv_id").select("*", step)
    above = F.when(F.greatest("d", "since") > 0, F.element_at("upto", F.greatest("d", "since").cast("int"))).otherwise(0)
    held = held.select(name(F.col("d")).alias("node"), (F.element_at("upto", -1) - above).alias("distinct"), (F.col("below") == 0).cast("bigint").alias("leaf"))
    held = held.groupBy("node").agg(F.sum("distinct").alias("distinct"), F.sum("leaf").alias("n_leaves"))

    ends = rebuilt.select(name(F.size("upto") - 1).alias("end"), "conv_id")
    ends = ends.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(_chunks, "end binary, first bigint, ids string")
    ends = ends.repartition("end").sortWithinPartitions("end", "first").mapInArrow(_digests, "node binary, ends_sha256 string")

    # parents with very many children are few: they are broadcast, and their children take no part in the other join
    hot = nodes.where(F.col("n_children") > max(1000, int(HOT_SHARE * nodes.count()))).select(F.col("node").alias("parent"), F.col("conv_id").alias("hot_id"))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("own_id"))
    rows = nodes.join(F.broadcast(hot), "parent", "left")
    asked = F.when(F.col("hot_id").isNull(), F.col("parent")).otherwise(F.col("node"))  # rows with an answer spread out
    rows = rows.withColumn("asked", F.coalesce(asked, "node")).join(parents.withColumnRenamed("parent", "asked"), "asked", "left")
    parent_id = F.when(F.col("parent").isNotNull(), F.coalesce("hot_id", "own_id"))
    rows = rows.withColumn("parent_conv_id", parent_id).join(held, "node").join(ends, "node", "left")
    saved = F.col("total") - F.col("n_convs") * (F.col("upto") - F.col("bytes")) - F.col("distinct")
    return rows.select(
        "node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
