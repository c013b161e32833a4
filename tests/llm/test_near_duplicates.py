import random

from rankfold.llm.neardup import deduplicated, near_duplicates

from .conftest import words


def brute(rows, shingle, percent):
    def shingles(text):
        w = words(text)
        return frozenset(tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (name, _) in enumerate(rows):
        root = find(i)
        smallest[root] = min((x for x in (smallest.get(root), name) if x is not None), default=None)
    return sorted(((name, len(sets[i]), smallest[find(i)]) for i, (name, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 200]))]
        rows.append((k, " ".join(text)))
        for c in range(rng.choice([0, 0, 1, 4])):
            near = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 20))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((1000 + 10 * k + c, " ".join(near).upper() if c % 2 else "\n".join(near)))
    return rows


EDGES = [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "One"), (5005, "one two"), (5006, "ONE TWO"), (None, "one two"), (5007, "long " * 30000), (5008, "long " * 29000), (5005, "one two"), (None, None)]


def test_components_equal_brute_force(docs):
    rows = corpus() + EDGES
    for shingle in (2, 5):
        out = near_duplicates(docs(rows), shingle=shingle)
        got = [tuple(r) for r in out.collect()]
        assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert sorted((g[:3] for g in got), key=str) == brute(rows, shingle, 80)
        assert all(g[3] == (g[0] == g[2]) for g in got)


def test_chain_and_large_group(docs):
    base = [f"x{k}" for k in range(400)]
    rows = [(k, " ".join(base[: 300 + k] if k % 2 else base[k:])) for k in range(80)]  # a chain: the ends are not linked
    assert sorted((tuple(r)[:3] for r in near_duplicates(docs(rows), shingle=2).collect()), key=str) == brute(rows, 2, 80)


def test_one_document_of_each_group_stays(docs):
    rows = corpus(2) + EDGES
    out = deduplicated(docs(rows, extra=False))
    groups = {g[2] for g in brute(rows, 5, 80) if g[2] is not None}
    assert {r.doc_id for r in out.collect() if r.doc_id is not None} == groups
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_table(docs):
    assert near_duplicates(docs([])).count() == 0
    assert deduplicated(docs([])).count() == 0


def test_crowded_buckets_lose_no_link(docs):
    """A thousand texts just below the threshold to each other share all buckets; about a dozen pairs are just above it."""
    rng = random.Random(5)
    sets = [set(rng.sample(range(1000), 130)) for _ in range(1000)]
    for k in range(14):
        sets[999 - k] = set(rng.sample(sorted(sets[k]), 36)) | set(rng.sample(sorted(set(range(1000)) - sets[k]), 94))
    masks = [sum(1 << w for w in set(range(1000)) - out) for out in sets]
    smallest = list(range(1000))
    for i, a in enumerate(masks):
        for j in range(i):
            if 100 * (a & masks[j]).bit_count() >= 80 * (a | masks[j]).bit_count():
                old, new = max(smallest[i], smallest[j]), min(smallest[i], smallest[j])
                smallest = [new if x == old else x for x in smallest]
    assert 14 <= sum(k != s for k, s in enumerate(smallest)) <= 40
    rows = [(k, " ".join(f"t{w}" for w in range(1000) if w not in out)) for k, out in enumerate(sets)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(rows), shingle=1).collect()}
    assert {k: (got[k], s) for k, s in enumerate(smallest) if got[k] != s} == {}
