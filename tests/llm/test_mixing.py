import random

import pytest

from rankfold.llm.mixing import mixture

from .conftest import words


def targets(sizes, weights, share, ceiling):
    """By the words of the contract: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {s: 0.0 for s in names if not sizes[s]}
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > ceiling * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: ceiling * sizes[s] for s in over}


def corpus(seed=0, size=3000):
    rng = random.Random(seed)
    sources = ["hot"] * 10 + ["b", "c", "d", "é", "Z", None, ""]
    return [(k, " \n".join("w" * rng.randint(1, 3) for _ in range(int(rng.expovariate(0.02)))), "en", rng.choice(sources)) for k in range(size)]


def test_targets_and_copies(docs):
    rows = corpus() + [(9000, None, "en", "b"), (9001, "", "en", "empty"), (None, "a b", "en", None), (9002, "x " * 50000, "en", "hot"), (9100, "a b c", "en", "b"), (9100, "a b c", "en", "b")]
    out = mixture(docs(rows), [3.0, 1.0, 2.0]).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    expected = targets(sizes, [3, 1, 2], 1.5, 2.0)
    assert len(out) == len(rows)
    assert sum(expected.values()) == pytest.approx(1.5 * sum(sizes.values()))
    source_of = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(expected[source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[source] += r.taken
    largest = max(len(words(t)) for _, t, _, s in rows if s != "hot")
    for source in sizes:
        slack = 0.03 * expected[source] + (50000 if source == "hot" else largest)
        assert abs(taken[source] - expected[source]) <= slack


def test_expected_copies_cross_integers(docs):
    """Within a source the copies differ by at most one, and their number is the expected one, up to one."""
    rows = corpus(1, 500)
    out = mixture(docs(rows), [1.0, 5.0, 2.0]).collect()
    source_of = {r[0]: r[3] for r in rows}
    for source in {r[3] for r in rows}:
        own = [r for r in out if source_of[r.doc_id] == source]
        rate = own[0].target / own[0].source_size
        assert {r.copies for r in own} <= {int(rate), int(rate) + 1}
        assert abs(sum(r.copies for r in own) - rate * len(own)) <= 1


def test_reruns_agree_and_the_hash_prefix_does_not_matter(docs, monkeypatch):
    from rankfold.llm import mixing

    df = docs(corpus(2, 800))
    first = sorted(map(tuple, mixture(df, [3.0, 1.0, 2.0]).collect()))
    assert sorted(map(tuple, mixture(df.repartition(13, "text"), [3.0, 1.0, 2.0]).collect())) == first
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 10)
    assert sorted(map(tuple, mixture(df, [3.0, 1.0, 2.0]).collect())) == first
    assert sorted(map(tuple, mixture(df, [3.0, 1.0, 2.0], seed=1).collect())) != first


def test_empty_table(docs):
    assert mixture(docs([]), [1.0]).count() == 0
