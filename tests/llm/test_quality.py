import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from rankfold.llm import quality
from rankfold.llm.quality import importance_weights, quality_filtered, resampled

LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("an", "er", "ing", "ou", "es", "at")]
    rows, labels = [], []
    for k in range(600):
        n = rng.randint(5, 120)
        good = rng.random() < 0.8
        text = " ".join(rng.choice(words) for _ in range(n)) if good else " ".join(f"{rng.choice(words)}###" for _ in range(n))
        rows.append((k, text))
        if k % 2:
            labels.append((k, int(good), rng.choice([0, 0, None]) if good else 0, "x"))
    return rows, labels


def test_bad_documents_go_and_good_ones_stay(spark, docs):
    rows, labels = corpus()
    good_text = max((t for _, t in rows if "###" not in t), key=len)
    rows += [(9000, None), (9001, ""), (9002, " \n"), (None, good_text), (9003, " ".join(t for _, t in rows if "###" not in t)), (1, rows[1][1])]
    df = docs(rows)
    out = quality_filtered(df, spark.createDataFrame(labels, LABELS))
    good = [i for i, t in rows if t and t.strip() and "###" not in t]
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(good, key=str)
    assert out.columns == df.columns


def test_draw_is_the_top_k_of_weight_plus_noise(spark, docs):
    rows, labels = corpus(1)
    df, marks = docs(rows), spark.createDataFrame(labels, LABELS)
    weights = {r.doc_id: r for r in importance_weights(df, marks).collect()}
    everything = {r.doc_id: r for r in resampled(df, marks, k=len(rows)).collect()}
    assert set(everything) == set(weights) and all(math.isfinite(r.key) for r in everything.values())
    noise = [r.key - r.log_weight for r in everything.values()]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.2
    for k in (1, 77, 599):
        top = sorted(everything, key=lambda i: -everything[i].key)[:k]
        assert {r.doc_id for r in resampled(df, marks, k=k).collect()} == set(top)
    assert resampled(df, marks, k=0).count() == 0


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert resampled(docs([]), none).count() == 0
    assert {r.doc_id for r in resampled(docs([(1, "a b"), (2, "c"), (3, None)]), none).collect()} == {1, 2}


def test_weights_are_sums_over_all_features(spark, docs):
    """Counted text by text; one text is much longer than the others."""
    rows, labels = corpus(4)
    rows = rows[:80] + [(7000, " ".join(t for _, t in rows) * 3)]
    parts = {i: [int(x) for _, _, b, _ in quality._features(pa.array([t])) for x in b] for i, t in rows}
    good = {i for i, q, t, _ in labels if q == 1 and not t}
    raw, target = Counter(), Counter()
    for i, features in parts.items():
        raw.update(features)
        target.update(features if i in good else ())
    m, p, total = quality.BUCKETS, quality.PRIOR_COUNTS, sum(raw.values())
    model = {b: (raw[b] + 1) / (total + m) for b in raw}
    ratio = {b: math.log((target[b] + p * model[b]) / (sum(target.values()) + p) / model[b]) for b in raw}
    got = {r.doc_id: r for r in importance_weights(docs(rows), spark.createDataFrame(labels, LABELS)).collect()}
    for i, features in parts.items():
        assert got[i].n_features == len(features)
        assert np.isclose(got[i].log_weight, sum(ratio[b] for b in features), rtol=1e-9, atol=1e-9)


def test_toxic_documents_go_however_long(spark, docs):
    rng = random.Random(6)
    rows, labels = corpus(5)
    clean = [t for _, t in rows if "###" not in t]
    toxic = []
    for k in range(300):
        words = rng.choice(clean).split() * rng.choice([1, 1, 40])
        words[rng.randrange(len(words))] = rng.choice(["Nasty,", "(vile)", "VILE"])
        toxic.append((3000 + k, " ".join(words)))
    labels += [(i, 1, 1, "x") for i, _ in toxic[:200]] + [(toxic[0][0], 1, None, "x"), (toxic[1][0], None, 0, "x"), (None, 1, 1, "x")]
    labels += [(i, 1, 0, "x") for i, t in rows if "###" not in t and i % 2 == 0]
    out = {r.doc_id for r in quality_filtered(docs(rows + toxic), spark.createDataFrame(labels, LABELS)).collect()}
    assert not out & {i for i, _ in toxic}
    assert out == {i for i, t in rows if "###" not in t}


def test_ties_at_the_last_key_are_drawn_together(spark, docs):
    rows = [(None, "same words here")] * 5 + [(k, f"word{k} other") for k in range(20)]
    none = spark.createDataFrame([], LABELS)
    keys = sorted((r.key for r in resampled(docs(rows), none, k=25).collect()), reverse=True)
    for k in range(1, 26):
        drawn = [r.key for r in resampled(docs(rows), none, k=k).collect()]
        assert sorted(drawn, reverse=True) == [x for x in keys if x >= keys[k - 1]]
