"""The conversation trie against dictionaries of all prefixes."""

import binascii
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.llm import trie
from rankfold.llm.queries import op13_conversation_trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = binascii.crc32(str(c).encode()) % 9 if rebuild else 0
        turns = tuple(own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        ((len(p), m[0], members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items()), key=str
    )


def talks(seed=1, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 4, 9, 30])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes", "no", "ü" * 5, ""]) if rng.random() < 0.9 else f"text {c}"))
    return rows


EDGES = [
    (None, 0, "user", "lost"), (500, None, None, None), (500, 0, "user", None), (501, 3, "user", "x"), (503, 1, None, "y"), (503, 1, "a", "y"),
    (503, 1, "a", "y"), (-7, 0, "user", "z"), (-5, 0, "user", "w"), (-5, 1, "user", "v"), (700, 0, "user", "long " * 200000), (701, 5, "user", "q"),
]
COLUMNS = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_trie_equals_brute_force(spark):
    rows = talks() + EDGES
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS node", "2 AS depth", "'x' AS path", "3 AS stem")
    got = trie.prefix_trie(turns, F.expr("conv_id - conv_id % 5"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9)
    assert rows_of(got) == brute(rows)
    assert rows_of(trie.prefix_trie(turns)) == brute(rows, rebuild=False)


def test_query(spark, tmp_path):
    rows = talks(2) + EDGES
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    out = op13_conversation_trie(spark, str(tmp_path))
    assert sorted(out.columns) == sorted(COLUMNS) and rows_of(out) == brute(rows)


def test_hot_parents_small_tries_and_chunks(spark, monkeypatch):
    """A first turn shared by thousands, one conversation repeated by hundreds; tries, chunks and look-ups in many parts."""
    rows = [(c, 0, "user", "hello") for c in range(2500)] + [(c, 1, "user", f"own {c}" if c >= 400 else "same") for c in range(2500)]
    monkeypatch.setattr(trie, "TRIE_TURNS", 50)
    monkeypatch.setattr(trie, "CHUNK_IDS", 7)
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == brute(rows, rebuild=False)


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_fat_binary_search():
    """Exits and counts of a trie filled in batches equal those of plain prefixes."""
    rng = random.Random(5)
    z, plain = trie.ZFastTrie(), defaultdict(int)
    for number in range(400):
        path = ["" * 0]
        for _ in range(rng.choice([0, 1, 3, 17, 70])):
            path.append(path[-1] + (rng.choice("ab") if rng.random() < 0.2 else "a"))
        path = [p.encode() for p in path]
        for p in path:
            plain[p] += 1
        z.insert_all([(path, np.arange(len(path)), number)])
        assert z.locate(path) == len(path) - 1
    rows = z.expanded().to_pydict()
    assert dict(zip(rows["node"], rows["n_convs"])) == plain
    assert rows["depth"] == [len(p) for p in rows["node"]] == rows["upto"]
    assert len(z.path) < len(plain)


@pytest.mark.parametrize("low,high", [(0, 1), (0, 5), (4, 5), (4, 7), (7, 8), (1023, 5000)])
def test_two_fattest(low, high):
    f = trie.two_fattest(low, high)
    power = lambda x: x & -x
    assert low < f <= high and all(power(f) > power(x) for x in range(low + 1, high + 1) if x != f)
