"""Periodic runs of words against a plain search over all periods."""

import binascii
import hashlib
import random
import re

import numpy as np

from rankfold.llm import periodic
from rankfold.llm.queries import op12_periodic_runs


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, exponent=4, least=6):
    found = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, exponent * p) and not any(w[i : i + n - q] == w[i + q : i + n] for q in range(1, p)):
                found.append((i, n, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for i, n, p in runs for k in range(i + p, i + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def text(rng):
    letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 2, 3, 5, 26])]
    w = [rng.choice(letters) for _ in range(rng.randint(0, 70))]
    for _ in range(rng.choice([0, 1, 2])):
        at = rng.randint(0, len(w))
        w[at:at] = (w[: rng.randint(1, 8)] or ["z"]) * rng.randint(2, 9)
    return rng.choice([" ", "\n", "\t "]).join(w)


def test_runs_equal_brute_force(docs):
    rng = random.Random(1)
    rows = [(k, text(rng)) for k in range(600)] + [(None, "a a a a a a"), (601, None), (602, ""), (603, " \n"), (4, "b a b a b a b a"), (4, "b a b a b a b a")]
    for exponent, least in ((4, 6), (2, 2), (3, 7)):
        got = periodic.periodic_runs(docs(rows), exponent=exponent, least=least)
        assert got.columns == ["doc_id", "runs", "collapsed"]
        want = [(str(k), brute(split(t), exponent, least)) for k, t in rows]
        want = [(k, r, collapsed(split(t), r)) for (k, r), (_, t) in zip(want, rows)]
        assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()) == sorted(want)


def test_very_long_texts(docs):
    rng = random.Random(2)
    noise = [f"w{rng.randrange(10**6)}" for _ in range(60000)]
    rows = [(0, "la " * 300000), (1, "do re mi " * 90000 + "end"), (2, " ".join(noise + noise[-20000:] * 4))]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs(rows)).collect()}
    assert got[0] == [(0, 300000, 1)] and got[1] == [(0, 270000, 3)]
    assert got[2] == [(40000, 100000, 20000)]


def test_positions_in_many_blocks(monkeypatch):
    monkeypatch.setattr(periodic, "_WIDE", 2)
    rng = random.Random(3)
    order = rng.sample(range(1000), 400)
    held, plain = periodic.Positions(order[0]), {order[0]}
    for x in order[1:]:
        assert held.around(x) == (max((p for p in plain if p < x), default=-1), min((p for p in plain if p > x), default=-1))
        held.add(x)
        plain.add(x)
    assert list(held) == sorted(plain) and held.size == 400


def test_sorted_suffixes():
    w = "a b a b a b c a b a b a".split()
    names = np.array([ord(x) for x in w], np.uint64)
    order, common = periodic.sorted_suffixes(names, np.array([0, len(w)]), 2)
    assert len(order) == len(common) + 1
    for i, j, n in zip(order, order[1:], common):
        same = 0
        while max(i, j) + same < len(w) and w[i + same] == w[j + same]:
            same += 1
        assert n == (same if same >= 2 else 0)


def test_query(spark, docs, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 60)))) for k in range(300)] + [(300, None), (None, "a b"), (-7, "a " * 9)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for k, t in rows:
        w, h = split(t), binascii.crc32(str(k).encode()) if k is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        runs, r = brute(w), got[k]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 10
    assert periodic.periodic_runs(docs([])).count() == 0
