"""The stages of the pipeline on small tables, each compared with a plain computation on its own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from rankfold.llm.queries import MIX_WEIGHTS

from .conftest import DOCS, words
from .test_mixing import targets
from .test_near_duplicates import brute as brute_groups


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(0)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, f"{text(12)}?\n{text(6)}") for k in range(5)]
    passage = text(80)
    rows = [(k, text(rng.randint(20, 120)), "en", f"s{k % 3}") for k in range(120)]
    rows += [(200 + k, " ".join(f"{w}###" for w in text(60).split()), "en", "s0") for k in range(30)]
    rows += [(300 + k, rows[k][1], "en", "s1") for k in range(20)]
    rows += [(400 + k, f"{rows[k][1]} end", "en", None) for k in range(20, 40)]
    rows += [(500 + k, f"{text(30)} {items[k][1]} {text(30)}", "en", "s2") for k in range(5)]
    rows += [(600 + k, f"{text(40)}\n{passage}\n{text(40)}", "en", "s2") for k in range(6)]
    rows += [(700, None, None, None), (701, "", "en", "s0"), (0, rows[0][1], "en", "s0")]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("###" not in t), 0) for i, t, *_ in rows[:150] if i % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf_dir}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        steps.append((docs.collect(), after.collect()))
        docs = after
        assert columns == after.columns[: len(columns)]

    before, after = steps[0]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if r.text and "###" not in r.text)
    before, after = steps[1]
    groups = brute_groups([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted({g[2] for g in groups})
    before, after = steps[2]
    whole, cut = {r.doc_id: r for r in before}, {r.doc_id: r for r in after}
    assert set(cut) == set(whole)
    for i, r in cut.items():
        assert r.n_chars == len(r.text)
        assert (r.text != whole[i].text) == (600 <= i < 700)
        assert i < 600 or len(r.text) < len(whole[i].text) - 250
    before, after = steps[3]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {500 + k for k in range(5)}
    before, after = steps[4]
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(words(r.text))
    wanted, taken, copies = targets(sizes, MIX_WEIGHTS, 1.5, 2.0), Counter(), Counter(r.doc_id for r in after)
    for r in after:
        taken[r.source] += len(words(r.text))
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in before}
    assert all(abs(taken[s] - wanted[s]) <= 250 for s in sizes)


def test_run_and_edges(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[-1] == "copy" and out.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), sf_dir).count() == 0


def test_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.selectExpr("*", "1 AS id", "2 AS n", "'a' AS name", "3 AS copy", "4 AS copies", "5 AS rest", "6 AS drawn", "7 AS size", "8 AS document")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert set(odd.columns) <= set(out.columns) and out.count() > 0


def test_repeated_passages_of_short_words(spark, docs):
    """51 words of one letter go, 50 longer ones stay."""
    rng = random.Random(5)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    short, long = " ".join(rng.choice("abcdefghij") for _ in range(51)), fresh(50)
    ends = [(fresh(20), fresh(20)) for _ in range(6)]
    rows = [(k, f"{a}\n{short if k < 3 else long} {b}") for k, (a, b) in enumerate(ends)]
    out = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs(rows), "").collect()}
    assert out == {k: f"{a}\n {b}" if k < 3 else rows[k][1] for k, (a, b) in enumerate(ends)}
