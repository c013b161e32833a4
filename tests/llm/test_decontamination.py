import random

from rankfold.llm.decontaminate import contamination, decontaminated

ITEMS = "item_id bigint, text string, extra int"


def sentence(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_planted_items_are_found(spark, docs):
    rng = random.Random(3)
    items = [(k, f"{sentence(rng, rng.randint(6, 40))}?\n{sentence(rng, rng.randint(1, 12))}", 0) for k in range(50)]
    items += [(90, None, 0), (91, "", 0), (92, "?!", 0), (7, items[7][1], 0)]
    rows = [(k, sentence(rng, rng.randint(0, 400))) for k in range(80)]
    planted = {(100 + k, k) for k in range(50)}
    rows += [(100 + k, f"{sentence(rng, rng.randint(0, 300))} {items[k][1].upper()} {sentence(rng, 30)}") for k in range(50)]
    rows += [(300, items[4][1].split("\n")[0]), (301, None), (302, ""), (None, items[5][1]), (303, "w1 " * 40000), (100, rows[80][1])]
    df, bench = docs(rows), spark.createDataFrame(items, ITEMS)
    got = contamination(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} == planted  # the lone question of item 4 is no hit
    assert [r.item_id for r in got if r.doc_id is None] == [5]
    assert sum(r.doc_id == 100 for r in got) == 2
    assert all(0.5 <= r.score <= 1.0001 and min(r.question_overlap, r.answer_overlap) >= 0.6 for r in got)
    clean = decontaminated(df, bench)
    assert {r.doc_id for r in clean.collect()} == set(range(80)) | {300, 301, 302, 303}
    assert clean.columns == df.columns


def test_retrieval_equals_full_scoring(spark, docs):
    """Without the overlap test, block-max WAND retrieves exactly the items whose BM25 share reaches the threshold."""
    import math
    from collections import Counter

    from rankfold.llm.decontaminate import B, K1

    rng = random.Random(5)
    items = [(k, sentence(rng, rng.randint(8, 32), 120), 0) for k in range(60)]
    rows = [(k, sentence(rng, rng.randint(1, 64), 120)) for k in range(60)]  # 64 words: one passage each
    bags = [Counter(t.split()) for _, t, _ in items]
    mean = sum(b.total() for b in bags) / len(bags)
    df = Counter(w for b in bags for w in b)
    weight = lambda w, b: math.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * (K1 + 1) / (b[w] + K1 * (1 - B + B * b.total() / mean))
    expected = set()
    for d, text in rows:
        for (i, _, _), bag in zip(items, bags):
            own = sum(weight(w, bag) for w in bag)
            if sum(weight(w, bag) for w in bag if w in set(text.split())) / own >= 0.4:
                expected.add((d, i))
    got = contamination(docs(rows), spark.createDataFrame(items, ITEMS), threshold=0.4, overlap=0.0).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(expected) > 20


def test_several_index_parts(spark, docs, monkeypatch):
    from rankfold.llm import decontaminate

    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 200)
    rng = random.Random(4)
    items = [(k, sentence(rng, 12), 0) for k in range(20)]
    rows = [(k, f"{sentence(rng, 50)} {items[k][1]}") for k in range(20)] + [(50, sentence(rng, 50))]
    bench = spark.createDataFrame(items, ITEMS)
    assert {(r.doc_id, r.item_id) for r in contamination(docs(rows), bench).collect()} == {(k, k) for k in range(20)}
    assert [r.doc_id for r in decontaminated(docs(rows), bench).collect()] == [50]


def test_empty_tables(spark, docs):
    none, some = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b c d e f", 0)], ITEMS)
    assert contamination(docs([(1, "a b c d e f")]), none).count() == 0
    assert contamination(docs([]), some).count() == 0
    assert decontaminated(docs([(1, "a b c d e f")]), none).count() == 1


def test_one_edited_word_hides_no_item(spark, docs):
    """Each word of each item replaced, left out or doubled with another; halves have 2 to 16 words."""
    rng = random.Random(11)
    items = [(k, f"{sentence(rng, 2 + k)}?\n{sentence(rng, 16 - k)}", 0) for k in range(15)]
    rows = []
    for k, text, _ in items:
        for at in range(18):
            for edit in (["new"], [], [text.replace("?\n", " ").split()[at], "new"]):
                parts = text.replace("?\n", " ").split()
                parts[at : at + 1] = edit
                rows.append((1000 * k + len(rows), f"{sentence(rng, 50)} {' '.join(parts)} {sentence(rng, 50)}"))
    lone = [(50_000 + k, sentence(rng, 50) + " " + text.split("?\n")[k < 8] + " " + sentence(rng, 50)) for k, text, _ in items]
    got = {(r.doc_id, r.item_id) for r in contamination(docs(rows + lone), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(name, (i // 54)) for i, (name, _) in enumerate(rows)}
    assert {r.doc_id for r in decontaminated(docs(rows + lone), spark.createDataFrame(items, ITEMS)).collect()} == {name for name, _ in lone}
