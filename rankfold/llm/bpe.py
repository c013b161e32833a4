"""Byte-level BPE with a queue of merge ranks: encoding of whole texts to token ids, and decoding.

A text is cut by the tokenizer's pattern; each cut-out string (pre-token) is merged on its own. Its bytes are a linked list.
Every adjacent pair that is a token waits in the bucket of that token's rank; a bitmap of three levels, one bit per bucket
that is not empty, gives the lowest rank by find-first-set. A bucket gives its leftmost position first. An entry whose
position has been merged away, or whose pair has changed since, is stale and skipped. The work is proportional to the length
(times the logarithm of a bucket), also for pre-tokens of megabytes. Short pre-tokens share one queue: they are laid end to
end, and no pair crosses a seam, so the order of ranks is right for each of them.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest rank file that tasks get with their code.
FILE_BYTES = 1 << 26
#: Remembered pre-tokens and pairs per Python worker; what does not fit is computed again.
MEMORY, REMEMBERED_CHARS = 1 << 19, 64
#: Characters of text, and matches of a longer text, that are held as pre-tokens at once.
TEXT_CHARS, MATCHES = 1 << 20, 1 << 16
#: Bytes of short pre-tokens that share one queue.
SHARED_BYTES = 1 << 18


class Ranks:
    """A rank file: one base64 token and its rank per line. Ids are ranks."""

    def __init__(self, raw: bytes):
        self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"the rank file lacks the bytes {missing}")
        self.size = max(self.rank.values()) + 1
        self.token = [b""] * self.size
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)])
        two = ((a, b) for a in range(256) for b in range(256))
        self.byte_pairs = np.array([self.rank.get(bytes(ab), self.size) for ab in two])
        self.pairs: dict[int, int] = {}
        self.known: dict[str, bytes] = {}

    def pair(self, key: int) -> int:
        """Rank of the pair left * size + right, or the number of ranks if it is no token."""
        found = self.pairs.get(key)
        if found is None:
            left, right = divmod(key, self.size)
            found = self.rank.get(self.token[left] + self.token[right], self.size)
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def merge(self, pretokens: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, four bytes each."""
        data = np.frombuffer(b"".join(pretokens), np.uint8)
        n, size, pair, known = len(data), self.size, self.pair, self.pairs
        seams = np.cumsum([len(p) for p in pretokens])
        column = np.ndarray.tolist if n <= 1 << 20 else lambda items: array("q", items.tobytes())
        # the end of a pre-token is n on the right and stays n on the left
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[seams - 1] = n
        left[0] = n
        left[seams[:-1]] = n
        ranks = np.full(n, size)
        ranks[:-1] = self.byte_pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
        ranks[seams - 1] = size
        open_ = np.flatnonzero(ranks < size)
        open_ = open_[np.argsort(ranks[open_], kind="stable")]
        present, first = np.unique(ranks[open_], return_index=True)
        buckets = dict(zip(present.tolist(), (part.tolist() for part in np.split(open_, first[1:]))))
        low, mid, top = [0] * ((size >> 6) + 1), [0] * ((size >> 12) + 1), 0
        for r in buckets:
            low[r >> 6] |= 1 << (r & 63)
            mid[r >> 12] |= 1 << (r >> 6 & 63)
            top |= 1 << (r >> 12)
        ids, after, before, waiting = column(self.byte_ids[data]), column(right), column(left), column(ranks)
        while top:
            r = (top & -top).bit_length() - 1
            word = mid[r]
            r = r << 6 | (word & -word).bit_length() - 1
            word = low[r]
            r = r << 6 | (word & -word).bit_length() - 1
            bucket, best, base = buckets[r], r, r * size
            while bucket and best == r:
                p = heappop(bucket)
                if waiting[p] != r:
                    continue
                q = after[p]
                ids[p], ids[q], waiting[q] = r, -1, size
                q = after[p] = after[q]
                new = size
                if q < n:
                    before[q] = p
                    new = known.get(base + ids[q])
                    if new is None:
                        new = pair(base + ids[q])
                at = p
                while True:
                    waiting[at] = new
                    if new < size:
                        if new in buckets:
                            heappush(buckets[new], at)
                        else:
                            buckets[new] = [at]
                            low[new >> 6] |= 1 << (new & 63)
                            mid[new >> 12] |= 1 << (new >> 6 & 63)
                            top |= 1 << (new >> 12)
                        if new < best:
                            best = new
                    q = before[p]
                    if at != p or q == n:
                        break
                    at = q
                    new = known.get(ids[at] * size + r)
                    if new is None:
                        new = pair(ids[at] * size + r)
            if not bucket:
                del buckets[r]
                low[r >> 6] ^= 1 << (r & 63)
                if not low[r >> 6]:
                    mid[r >> 12] ^= 1 << (r >> 6 & 63)
                    if not mid[r >> 12]:
                        top ^= 1 << (r >> 12)
        flat = np.array(ids, np.int64)
        alive = np.flatnonzero(flat >= 0)
        raw, ends = flat[alive].astype("<u4").tobytes(), (4 * np.searchsorted(alive, seams)).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def learn(self, pretokens: set[str]) -> dict[str, bytes]:
        """The ids of pre-tokens, each a token of its own or merged."""
        found, short, length = {}, [], 0
        for p in pretokens:
            raw = p.encode()
            whole = self.rank.get(raw)
            if whole is not None:
                found[p] = whole.to_bytes(4, "little")
                continue
            short.append((p, raw))
            length += len(raw)
            if length >= SHARED_BYTES:
                found.update(zip((s for s, _ in short), self.merge([r for _, r in short])))
                short, length = [], 0
        if short:
            found.update(zip((s for s, _ in short), self.merge([r for _, r in short])))
        return found

    def ids(self, runs: list[list[str]]) -> list[bytes]:
        """The ids of each run of pre-tokens, end to end."""
        fresh = self.learn(set(chain.from_iterable(runs)) - self.known.keys())
        if len(self.known) + len(fresh) > MEMORY:
            self.known = {p: self.known[p] for p in set(chain.from_iterable(runs)) & self.known.keys()}
        self.known.update(fresh)
        out = [b"".join(map(self.known.__getitem__, run)) for run in runs]
        for p in fresh:
            if len(p) > REMEMBERED_CHARS:
                del self.known[p]
        return out

    def encode(self, texts: list[str | None], pattern: regex.Pattern) -> list[bytes]:
        """The ids of each text, four bytes each, little-endian."""
        out, runs, length = [], [], 0
        for text in texts:
            text = text or ""
            if len(text) > TEXT_CHARS:  # matches of a long text are taken in turn, never all at once
                out += self.ids(runs)
                runs, length = [], 0
                matches = (m.group() for m in pattern.finditer(text))
                parts = iter(lambda: list(islice(matches, MATCHES)), [])
                out.append(b"".join(self.ids([part])[0] for part in parts))
                continue
            runs.append(pattern.findall(text))
            length += len(text)
            if length >= TEXT_CHARS:
                out += self.ids(runs)
                runs, length = [], 0
        return out + self.ids(runs)

    def decode(self, raw: bytes) -> bytes:
        """The bytes of ids given as four bytes each."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(raw, "<u4").tolist()))


@lru_cache(maxsize=2)
def _ranks(raw: bytes) -> Ranks:
    return Ranks(raw)


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(FILE_BYTES + 1)
    if len(raw) > FILE_BYTES:
        raise ValueError(f"{path} is larger than {FILE_BYTES} bytes")
    return raw


def _parts(column: pa.Array):
    """(first row, values) of parts of a column, about TEXT_CHARS bytes each or one longer value."""
    lo, held, length = 0, [], 0
    for i, value in enumerate(column):
        held.append(value.as_py())
        length += len(held[-1] or "")
        if length >= TEXT_CHARS:
            yield lo, held
            lo, held, length = i + 1, [], 0
    if held:
        yield lo, held


def encoded(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """[id_col, ids], one row per row of docs; ids is binary, four little-endian bytes per token.

    `tokenizer` is the path of a rank file, read on the driver (at most FILE_BYTES) and sent with the tasks. Each match of
    `pattern` is encoded separately: by its own token if it is one, else by merging, lowest rank first, leftmost first.
    There are no special tokens: their strings are ordinary text.

    * A null or empty text has no ids (an empty value). A null id stays null; repeated rows stay repeated.
    * A very long text is cut into pre-tokens piece by piece; a pre-token may be as long as the text. Spark's limit for one
      value holds for the ids: a text of more than 2^29 tokens is an error.
    * An empty table gives an empty table. Other columns are ignored, whatever their names.
    """
    raw = _file(tokenizer)

    def run(batches):
        ranks, compiled = _ranks(raw), regex.compile(pattern)
        for batch in batches:
            for lo, texts in _parts(batch.column("text")):
                ids = pa.array(ranks.encode(texts, compiled), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(texts)), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """[id_col, ids_col, text_col], one row per row of tokens; text_col is binary, the bytes of the tokens end to end.

    * Null or empty ids give no bytes (an empty value). An id beyond the vocabulary is an error.
    * A null id_col stays null; repeated rows stay repeated; an empty table gives an empty table.
    """
    raw = _file(tokenizer)

    def run(batches):
        ranks = _ranks(raw)
        for batch in batches:
            for lo, values in _parts(batch.column("ids")):
                texts = pa.array([ranks.decode(v or b"") for v in values], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, len(values)) for c in ("id", "ids")), texts], ["id", "ids", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(tokens[id_col].alias("id"), F.coalesce(tokens[ids_col], F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, text binary").toDF(id_col, ids_col, text_col)
