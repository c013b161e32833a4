import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankfold.llm import suffixes
from rankfold.llm.suffixes import repeated_strings, without_repeats


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for (name, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if count[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((name, len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [text(rng.choice([length - 2, length, length + 1, 3 * length])) for _ in range(6)]
    rows = [(k, text(rng.randint(0, length)) + rng.choice(passages) + text(rng.randint(0, length)) + rng.choice([*passages, ""])) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200, "ab" * (2 * length)), (201, "a" * (5 * length)), (202, passages[3] * 3)]
    rows += [(203, None), (None, ""), (204, text(length - 1)), (1, rows[1][1]), (None, passages[2])]
    return rows


@pytest.mark.parametrize("length, batches", [(20, 1), (40, None), (40, 5), (61, 3)])
def test_equals_brute_force(docs, length, batches):
    rows = corpus(length, length)
    out = repeated_strings(docs(rows), length=length, batches=batches)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, length)


def test_texts_are_cut(docs):
    a, b = "first passage that stands twice", "0123456789" * 3
    rows = [(1, f"x{a}y"), (2, f"{a}"), (3, b), (4, None), (5, "short")]
    out = without_repeats(docs(rows), length=len(a))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("xy", 2), 2: ("", 0), 3: (b, 30), 4: (None, 0), 5: ("short", 5)}
    assert out.columns == docs(rows).columns


def test_empty_table(docs):
    assert repeated_strings(docs([]), length=40).count() == 0
    assert without_repeats(docs([]), length=40).count() == 0


def test_long_texts_in_parts_and_hot_suffixes(docs, monkeypatch):
    """Texts beyond a part, and suffixes with more stretches than are compared together; the executor's limits are lowered too."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(120)
    monkeypatch.setattr(suffixes, "TOGETHER", 3)
    rows = [(k, f"{text(30)}{passage[k : k + 60 + k]}{text(30)}") for k in range(40)]
    assert sorted((tuple(r) for r in repeated_strings(docs(rows), length=50).collect()), key=str) == brute(rows, 50)

    monkeypatch.setattr(suffixes, "PART", 100)
    long = (text(333) + passage + text(777) + passage).encode()
    buf, offsets = np.frombuffer(long, np.uint8), np.array([0, len(long)])
    owner, start, count, key, stretch, heads = suffixes._stretches(buf, offsets, 50, 12)
    assert all(long.find(h.tobytes()) >= 0 for h in heads)
    where = Counter()
    for lo, n, k in zip(start.tolist(), count.tolist(), key.tolist()):
        for p in range(lo, lo + n):
            where[p] = k
    assert sorted(where) == list(range(len(long) - 49))
    a, b = long.index(passage.encode()), long.rindex(passage.encode())
    assert all(where[a + p] == where[b + p] for p in range(71))


def test_levels(spark):
    """Batches of suffixes: levels of like rank merge, and every suffix is reported by the batch that repeats it."""
    rng = random.Random(5)
    index, seen, ranks = suffixes.SuffixLevels(), Counter(), []
    for number in range(7):
        batch = [(rng.randint(0, 60), rng.randint(0, 2)) for _ in range(12)] if number != 4 else []
        rows = [(bytes([k, 255 - k]), k, stretch, 1) for k, stretch in batch]
        matches = {r.key for r in index.add(spark.createDataFrame(rows, "head binary, key bigint, stretch bigint, times bigint")).collect()}
        seen.update(batch)
        total = Counter()
        for (k, _), times in seen.items():
            total[k] += times
        assert {k for k, _ in batch if total[k] > 1} <= matches <= {k for k in total if total[k] > 1}
        ranks.append(sorted(index.levels))
    assert ranks == [[0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2]]
    wanted = spark.createDataFrame([(k,) for k in range(0, 60, 2)], "key bigint")
    assert {tuple(r) for r in index.stretches(wanted).collect()} == {(k, s, n) for (k, s), n in seen.items() if k % 2 == 0 and k < 60}
    for level in index.levels.values():
        for part in level.rdd.glom().collect():
            assert [r.head for r in part] == sorted(r.head for r in part)
    index.release()
    assert not index.levels


def test_remaining_text(docs):
    rows = corpus(3, 30)
    out = repeated_strings(docs(rows), length=30, with_text=True)
    assert out.columns[-1] == "kept_text"
    plain = {(r.doc_id, r.kept_sha256) for r in repeated_strings(docs(rows), length=30).collect()}
    for r in out.collect():
        assert (r.doc_id, r.kept_sha256) in plain
        if r.n_removed == 0:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert len(r.kept_text.encode()) <= r.n_bytes - r.n_removed


def brute_words(rows, length):
    parts = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    runs = [[tuple((t or "")[a:b] for a, b in spans[p : p + length]) for p in range(len(spans) - length + 1)] for (_, t), spans in zip(rows, parts)]
    count = Counter(run for all_runs in runs for run in all_runs)
    texts = Counter(t for _, t in rows)
    out = []
    for (name, text), spans, own in zip(rows, parts, runs):
        gone = bytearray(len(text or ""))
        for p, run in enumerate(own):
            if count[run] > 1:
                lo, hi = spans[p][0], spans[p + length - 1][1]
                gone[lo:hi] = b"\1" * (hi - lo)
        rest = "".join(c for c, g in zip(text or "", gone) if not g)
        out.append((name, None if text is None else "" if own and texts[text] > 1 else rest))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, batches", [(6, 1), (17, 3), (51, None)])
def test_words_equal_brute_force(docs, length, batches):
    """Runs of words, most of them of one letter, with other white space in each place."""
    rng = random.Random(length)
    gap = lambda: rng.choice([" ", "  ", "\n", "\t "])
    text = lambda words: "".join(w + gap() for w in words)
    fresh = lambda n: [rng.choice("abcdefghié") + rng.choice(["", "", "x"]) for _ in range(n)]
    passages = [fresh(n) for n in (length - 1, length, length + 1, 3 * length)]
    rows = [(k, text(fresh(rng.randint(0, length)) + rng.choice(passages) + fresh(rng.randint(0, 9)) + rng.choice([*passages, []]))) for k in range(50)]
    rows += [(100 + k, rows[k][1]) for k in range(4)] + [(200, "ab " * (3 * length)), (201, None), (None, ""), (202, " \n"), (203, text(passages[3]) * 2)]
    rows += [(204, "a" * 500), (205, "a" * 500)]
    out = without_repeats(docs(rows), length=length, batches=batches, unit="word")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute_words(rows, length)


def test_places_of_one_text_are_one_row(docs, monkeypatch):
    """Texts that repeat a line join the index once for each distinct stretch, not once for each repeat."""
    rows = [(k, f"x{k} " + "one very common line " * 30 + f"y{k}") for k in range(40)]
    joined, keep = [], suffixes.kept
    monkeypatch.setattr(suffixes, "kept", lambda df, name: joined.append((name, keep(df, name))) or joined[-1][1])
    out = without_repeats(docs(rows), length=8, unit="word")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute_words(rows, 8)
    assert 0 < [df.count() for name, df in joined if name == "hits"][0] < 12 * len(rows)


def test_pairs():
    rng = np.random.default_rng(2)
    for n, most in ((1, 1), (500, 3), (500, 40)):
        owner, key, stretch = np.sort(rng.integers(0, 9, n)), rng.integers(-most, most, n), rng.integers(0, 2, n)
        order, begins = suffixes._pairs(owner, key, stretch)
        ends = [*begins[1:].tolist(), n]
        groups = [order[lo:hi].tolist() for lo, hi in zip(begins.tolist(), ends)]
        names = [(owner[g[0]], key[g[0]], stretch[g[0]]) for g in groups]
        assert len(set(names)) == len(names) and all(g == sorted(g) for g in groups)
        assert all((owner[i], key[i], stretch[i]) == name for name, g in zip(names, groups) for i in g)
    text = pa.array(["one very common line " * 30])
    batch = pa.RecordBatch.from_arrays([text, pa.array([1]), pa.array([630])], ["text", "name", "n"])
    found = pa.Table.from_batches(list(suffixes._indexed(8, 2, "word")([batch])))
    assert found.num_rows < 12 and len({s for x in found.column("starts").to_pylist() for s in x}) > 20
