"""Benchmark decontamination: every training passage is a BM25 query against an inverted index of the test items.

Weights are divided by the item's score against its own text, so a score is the share of an item that a passage
covers. A posting list has blocks with their largest weight. Passages whose upper bounds over item ranges stay below
the threshold cannot retrieve anything (the pivot test of WAND, done for all passages of a batch at once); the others
walk the lists with block-max WAND. Retrieved items count only if the passage holds the word runs of both their
question and their answer, or words in order that few edits turn into them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import kept

K1, B = 1.2, 0.75
BLOCK, RANGES = 8, 128
#: Texts of test items per index, in bytes. Larger benchmarks are searched in several passes.
INDEX_BYTES = 16 << 20
#: Word runs compared between a passage and an item.
RUN = 5
#: Most words between an edited question and its answer.
NEAR = 16

#: Letters and digits of ASCII and all bytes of other characters.
_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word range of each text) of each piece."""
    for lo, hi, buf, offsets in scan.pieces(column):
        text = scan.lower(buf)
        starts, ends, bounds = scan.word_spans(text, offsets, _LETTERS)
        yield lo, hi, scan.word_hashes(text, starts, ends), bounds


def _terms(batches):
    for batch in batches:
        for lo, _, words, bounds in _words(batch.column("text")):
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            at = pa.array(owner + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(at), batch.column("part").take(at), pa.array(words.view(np.int64))], ["row", "part", "term"]
            )


class Index:
    """Posting lists of one part of the items, and the word runs of their questions and answers."""

    def __init__(self, postings: pa.Table, items: pa.Table, stride: int):
        self.stride = stride
        self.rows = items.column("row").to_numpy()
        self.ids = items.column("item_id").combine_chunks()
        place = np.searchsorted(self.rows, postings.column("row").to_numpy())
        terms = postings.column("term").to_numpy().view(np.uint64)
        weights = postings.column("weight").to_numpy().astype(np.float32)
        order = np.lexsort((place, terms))
        place, terms, weights = place[order], terms[order], weights[order]
        self.vocabulary, first = np.unique(terms, return_index=True)
        self.first = np.append(first, len(terms))
        self.items, self.weights = place, weights
        self.largest = np.maximum.reduceat(weights, first) if len(first) else weights
        # the largest weight of each block of a list, and each list's first block
        counts = np.diff(self.first)
        blocks = -(-counts // BLOCK)
        self.first_block = np.append(0, np.cumsum(blocks))
        nth = np.arange(self.first_block[-1]) - np.repeat(self.first_block[:-1], blocks)
        self.block_largest = np.maximum.reduceat(weights, np.repeat(first, blocks) + nth * BLOCK) if len(first) else weights
        per = -(-max(1, len(self.rows)) // RANGES)
        self.bounds = np.zeros((len(self.vocabulary), RANGES), np.float32)
        np.maximum.at(self.bounds, (np.repeat(np.arange(len(first)), np.diff(self.first)), place // per), weights)
        self.known = np.zeros(1 << 20, bool)
        self.known[self.vocabulary >> np.uint64(44)] = True
        self.halves = [tuple(map(_words_of, _halves(t or ""))) for t in items.column("text").to_pylist()]
        self.runs = [tuple(map(_runs, halves)) for halves in self.halves]

    @classmethod
    def from_state(cls, state: dict) -> Index:
        """The index of a task, from the plain arrays that were broadcast."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their term numbers."""
        if not len(self.vocabulary):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.known[words >> np.uint64(44)])
        term = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[term] == words[maybe]
        return maybe[hit], term[hit]

    def _upper(self, group: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """For each of n groups of terms (sorted by group) and each item range, the sum of the largest weights."""
        upper = np.zeros((n, RANGES), np.float32)
        if len(group):
            begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            upper[group[begin]] = np.add.reduceat(self.bounds[term], begin, axis=0)
        return upper

    def block_max_wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold for a query of distinct terms."""
        end = len(self.rows)
        lists = [[int(self.items[self.first[t]]), int(self.first[t]), t] for t in terms]  # item, cursor, term
        found = []

        def seek(entry, item):
            lo, hi = entry[1], int(self.first[entry[2] + 1])
            entry[1] = lo + int(np.searchsorted(self.items[lo:hi], item))
            entry[0] = int(self.items[entry[1]]) if entry[1] < hi else end

        while True:
            lists = [x for x in lists if x[0] < end]
            lists.sort()
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += float(self.largest[x[2]])
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            bound, beyond = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else end
            for x in lists[: pivot + 1]:
                lo, hi = int(self.first[x[2]]), int(self.first[x[2] + 1])
                at = x[1] + int(np.searchsorted(self.items[x[1] : hi], item))
                if at < hi:
                    block = (at - lo) // BLOCK
                    bound += float(self.block_largest[int(self.first_block[x[2]]) + block])
                    beyond = min(beyond, int(self.items[min(lo + (block + 1) * BLOCK, hi) - 1]) + 1)
            if bound < threshold:
                for x in lists[: pivot + 1]:
                    seek(x, max(beyond, item + 1))
            elif lists[0][0] == item:
                score = sum(float(self.weights[x[1]]) for x in lists[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                for x in lists[: pivot + 1]:
                    seek(x, item + 1)
            else:
                for x in lists[:pivot]:
                    seek(x, item)

    def search(self, words: np.ndarray, bounds: np.ndarray, threshold: float, overlap: float) -> list[tuple]:
        """(text, item, score, question share, answer share, first word of the passage) of all verified hits."""
        at, term = self.lookup(words)
        counts = np.diff(bounds)
        blocks_of = -(-counts // self.stride)
        first_block = np.cumsum(blocks_of) - blocks_of
        owner = np.searchsorted(bounds, at, "right") - 1
        block = first_block[owner] + (at - bounds[owner]) // self.stride
        n = int(blocks_of.sum())
        pairs = np.unique(block * (len(self.vocabulary) + 1) + term)
        block, term = pairs // (len(self.vocabulary) + 1), pairs % (len(self.vocabulary) + 1)
        upper = self._upper(block, term, n + 1)
        last = np.zeros(n, bool)
        last[(first_block + blocks_of - 1)[blocks_of > 0]] = True
        upper[:-1][~last] += upper[1:][~last]  # a passage is a block and the next one of the same text
        owners = np.repeat(np.arange(len(counts)), blocks_of)
        edges = np.searchsorted(block, np.arange(n + 1))
        likely = np.flatnonzero(upper[:-1].max(axis=1) >= threshold)
        # the same bound once more, without counting terms twice that stand in both blocks
        ends = np.where(last[likely], edges[likely + 1], edges[np.minimum(likely + 2, n)])
        size = ends - edges[likely]
        which = np.repeat(np.arange(len(likely)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edges[likely], size)
        pairs = np.unique(which * (len(self.vocabulary) + 1) + term[at])
        which, distinct = pairs // (len(self.vocabulary) + 1), pairs % (len(self.vocabulary) + 1)
        sure = np.flatnonzero(self._upper(which, distinct, len(likely)).max(axis=1, initial=0) >= threshold)
        first = np.searchsorted(which, np.arange(len(likely) + 1))
        out = []
        for k in sure:
            passage = int(likely[k])
            text = int(owners[passage])
            hits = self.block_max_wand(distinct[first[k] : first[k + 1]].tolist(), threshold)
            if not hits:
                continue
            lo = int(bounds[text] + (passage - first_block[text]) * self.stride)
            own = words[lo : min(lo + 2 * self.stride, int(bounds[text + 1]))]
            for item, score in hits:
                shares = [float(np.isin(wanted, scan.run_hashes(own, size)).mean()) if len(wanted) else 1.0 for wanted, size in self.runs[item]]
                found = min(shares) >= overlap
                if not found:  # the item may go on a little after the passage, if words were put in
                    aligned = _aligned(self.halves[item], words[lo : min(lo + 3 * self.stride, int(bounds[text + 1]))], overlap)
                    found = aligned is not None
                    shares = [max(x, y) for x, y in zip(shares, aligned)] if found else shares
                if found:
                    out.append((text, item, score, *shares, lo - int(bounds[text])))
        return out


def _halves(text: str) -> tuple[str, str]:
    """Question and answer: the first line and the rest, or else all but the last sentence and the last one."""
    text = text.strip()
    head, line, tail = text.partition("\n")
    if not line:
        cut = max(text.rstrip(".?! ").rfind(x) for x in (". ", "? ", "! "))
        head, tail = (text[: cut + 1], text[cut + 2 :]) if cut > 0 else (text, "")
    return head, tail


def _words_of(text: str) -> np.ndarray:
    return next(iter(_words(pa.array([text]))))[2]


def _runs(words: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct word runs of a question or answer, and how many words each has."""
    size = min(RUN, len(words))
    return (np.unique(scan.run_hashes(words, size)), size) if size else (words, RUN)


def _edits(half: np.ndarray, own: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each end in own, the fewest replaced, missing and added words between half and what ends there.

    start has the cost of beginning after each number of words of own.
    """
    place = np.arange(len(own) + 1)
    row = start
    for word in half:
        row = np.append(row[0] + 1, np.minimum(row[:-1] + (own != word), row[1:] + 1))
        row = np.minimum.accumulate(row - place) + place
    return row


def _aligned(halves: tuple[np.ndarray, np.ndarray], own: np.ndarray, overlap: float) -> list[float] | None:
    """The shares of question and answer left after the edits that make them stand close together in own, or None.

    A half of several words may have one edit, longer ones as many as leave `overlap` of their words.
    """
    allowed = [0 if len(h) < 2 else max(1, int((1 - overlap) * len(h) + 1e-9)) for h in halves]
    if any(int((~np.isin(h, own)).sum()) > most for h, most in zip(halves, allowed)):
        return None
    for first, second in ((0, 1), (1, 0)):
        edits = _edits(halves[first], own, np.zeros(len(own) + 1, np.int64))
        ends = np.cumsum(np.append(np.zeros(NEAR + 1, np.int64), edits <= allowed[first]))
        start = np.where(ends[NEAR + 1 :] > ends[: -NEAR - 1], 0, 1 << 30)
        more = _edits(halves[second], own, start)
        if more.min() <= allowed[second]:
            shares = [1.0, 1.0]
            for half, x in ((first, edits), (second, more)):
                shares[half] = 1 - int(x.min()) / max(1, len(halves[half]))
            return shares
    return None


def _indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[Index, bool]]:
    """Indexes of all items, each of a bounded size, and whether more than one is needed."""
    spark = items.sparkSession
    texts = items.select(items[id_col].cast("bigint").alias("item_id"), items[text_col].alias("text"))
    texts = texts.where("trim(text) <> ''").withColumn("row", F.xxhash64("item_id", "text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // INDEX_BYTES) or 1
    texts = kept(texts.withColumn("part", F.pmod("row", F.lit(parts)).cast("int")), "items")
    terms = texts.select("row", "part", "text").distinct().mapInArrow(_terms, "row bigint, part int, term bigint")
    tf = kept(terms.groupBy("row", "part", "term").agg(F.count("*").alias("tf")), "terms")
    lengths = tf.groupBy("row").agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count("*"), F.avg("len"), F.max("len")).first()
    n, mean, longest = stats[0], stats[1] or 1.0, stats[2] or 1
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    raw = tf.join(df, "term").join(lengths, "row").select("row", "part", "term", weight.alias("weight"))
    own = raw.groupBy("row").agg(F.sum("weight").alias("own"))
    postings = kept(raw.join(own, "row").select("row", "part", "term", (F.col("weight") / F.col("own")).alias("weight")), "postings")
    for part in range(parts):
        yield (
            Index(
                postings.where(F.col("part") == part).toArrow(),
                texts.where(F.col("part") == part).select("row", "item_id", "text").orderBy("row", "item_id").toArrow().combine_chunks(),
                max(32, int(longest)),
            ),
            parts > 1,
        )


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """[id_col, item_id, score, question_overlap, answer_overlap, first_word]: items found in each row of docs.

    A text is cut into blocks of as many words as the longest item; each two neighbouring blocks are a passage. Items
    with a score of at least `threshold` are retrieved, whatever their number, and reported if the passage holds at
    least `overlap` of the distinct five-word runs of both question and answer, or both in order and close together with
    edits of less than the rest of their words; one edit never voids a half of two or more words. The overlaps are the
    larger of both shares. Of several passages with one item the one with the highest score is reported, then the first.

    * Null, empty or word-free texts and items match nothing; an item with fewer than five words is one run.
    * Repeated documents are reported each; repeated items (same id and text) once; items sharing an id separately.
    * Null ids are passed through. Empty tables give an empty table. Other columns are ignored.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = dict(source.dtypes)["id"]
    schema = f"id {kind}, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint"
    results = []
    for index, several in _indexes(items, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches, shared=shared):
            own = Index.from_state(shared.value)
            for batch in batches:
                for _, _, rows in _found(batch, "text", own, threshold, overlap):
                    at = pa.array([r[0] for r in rows], pa.int64())
                    ids = own.ids.take(pa.array([r[1] for r in rows], pa.int64()))
                    columns = [pa.array([r[k] for r in rows], t) for k, t in ((2, pa.float64()), (3, pa.float64()), (4, pa.float64()), (5, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), ids, *columns], ["id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        found = source.mapInArrow(run, schema)
        results.append(kept(found, "hits") if several else found)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", id_col)


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """The rows of docs, with all their columns, in which contamination() finds no item."""
    for index, several in _indexes(items, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches, shared=shared):
            own = Index.from_state(shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for _, _, rows in _found(batch, text_col, own, threshold, overlap):
                    clean[[r[0] for r in rows]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        docs = kept(docs, "clean") if several else docs
    return docs


def _found(batch: pa.RecordBatch, text_col: str, index: Index, threshold: float, overlap: float) -> Iterator[tuple[int, int, list[tuple]]]:
    """The best hit of each text and item, with the text's row in the batch."""
    for lo, hi, words, bounds in _words(batch.column(text_col)):
        best: dict[tuple[int, int], tuple] = {}
        for hit in index.search(words, bounds, threshold, overlap):
            key = (hit[0], hit[1])
            if key not in best or hit[2] > best[key][2]:
                best[key] = hit
        yield lo, hi, [(h[0] + lo, *h[1:]) for h in best.values()]
