import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankfold.llm import language
from rankfold.llm.language import identify, train

ALPHABETS = {"aa": "the and ing tion er on", "bb": "der die und sch ein ung", "cc": "él ción que los ñas mente"}


def text(rng, lang, n):
    parts = ALPHABETS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def corpus(seed=0, size=600):
    rng = random.Random(seed)
    rows = []
    for k in range(size):
        lang = rng.choice(sorted(ALPHABETS))
        rows.append((k, text(rng, lang, rng.randint(8, 60)), lang, "s"))
    return rows


def test_held_out_accuracy(docs):
    rows = corpus()
    df = docs(rows)
    models = train(df.where("doc_id % 3 <> 0"))
    out = identify(df.where("doc_id % 3 = 0"), models, "doc_id", "text", F.lit(True).alias("held_out"))
    got = {r.doc_id: r for r in out.collect()}
    truth = {k: lang for k, _, lang, _ in rows}
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"]
    assert len(got) == 200 and all(r.lang_pred == truth[i] and 0.9 < r.score <= 1 for i, r in got.items())
    assert sum(r.rejected for r in got.values()) <= 20


def test_edges(docs):
    models = train(docs(corpus() + [(900, None, "aa", "s"), (901, "the", None, "s"), (902, "", "bb", "s")]))
    rows = [(1, None), (2, ""), (3, "123 !?\n"), (4, "x"), (5, "DER DIE UND"), (None, "der die"), (5, "DER DIE UND"), (6, "der die und sch " * 20000), (7, "漢字漢字漢字")]
    got = [(r.doc_id, r.lang_pred, r.score, r.rejected) for r in identify(docs(rows), models).collect()]
    assert [g[:3] for g in got if g[0] in (1, 2, 3)] == [(i, "und", 0.0) for i in (1, 2, 3)]
    assert [g[1] for g in got if g[0] in (5, 6, None)] == ["bb"] * 4
    assert [g[3] for g in got if g[0] == 7] == [True]
    assert all(g[1] in ALPHABETS for g in got if g[0] in (4, 7))


def test_scores_equal_the_interpolated_formula(docs):
    """The same probabilities, computed recursively from counts of plain strings."""
    import math
    from collections import Counter

    from rankfold.llm.language import DISCOUNT, ORDER

    texts = {"aa": ["abab abba", "baab aabb ab"], "bb": ["bcbc cbbc", "cab bac"]}
    models = train(docs([(k, t, lang, "s") for lang, ts in texts.items() for k, t in enumerate(ts)]))

    def formula(lang, word):
        counts = [Counter() for _ in range(ORDER + 1)]
        for t in texts[lang]:
            padded = f" {t} "
            for n in range(1, ORDER + 1):
                counts[n].update(padded[i : i + n] for i in range(len(padded) - n + 1))
        ways = [None] + [Counter(r[1:] for r in counts[n + 1]) if n < ORDER else counts[n] for n in range(1, ORDER + 1)]
        kinds = len({c for ts in texts.values() for t in ts for c in f" {t} "}) + 1

        def p(run):
            if len(run) == 1:
                total = sum(ways[1][c] for c in counts[1])
                return (ways[1][run] + 0.5 if run in counts[1] else 0.5) / (total + 0.5 * kinds)
            n, history = len(run), run[:-1]
            follow = {r: ways[n][r] for r in counts[n] if r[:-1] == history}
            total, types = sum(follow.values()), sum(v > 0 for v in follow.values())
            if not total:
                return p(run[1:])
            return max(follow.get(run, 0) - DISCOUNT, 0) / total + DISCOUNT * types / total * p(run[1:])

        padded = f" {word} "
        logs = [math.log(p(padded[max(0, i - ORDER + 1) : i + 1])) for i in range(1, len(padded))]
        return sum(logs) / len(logs)

    for word in ("abba", "bc", "cab ab", "a"):
        mean, _ = models.scores([word])
        for k, lang in enumerate(models.langs):
            assert abs(mean[0][k] - formula(lang, word)) < 1e-4, (word, lang)


def test_empty_tables(docs):
    models = train(docs([]))
    assert models.langs == []
    assert [tuple(r)[:3] for r in identify(docs([(1, "abc")]), models).collect()] == [(1, "und", 0.0)]
    assert identify(docs([]), train(docs(corpus(size=9)))).count() == 0


def test_joined_scores_equal_those_of_the_arrays(docs, monkeypatch):
    """Models beyond MODEL_BYTES are joined; predictions, scores and rejections are the same."""
    rows = corpus(size=80)
    df = docs(rows + [(900, None), (901, "1 2"), (902, "x"), (903, "x"), (None, "ab"), (904, "漢字 the")])
    models = train(docs(rows))
    assert np.isfinite(models.level).all()
    arrays = {(r.doc_id, r.lang_pred, r.rejected): r for r in identify(df, models).collect()}
    monkeypatch.setattr(language, "MODEL_BYTES", 0)
    models._local = None
    assert models.local() is None
    joined = {(r.doc_id, r.lang_pred, r.rejected): r for r in identify(df, models).collect()}
    assert set(joined) == set(arrays) and len(joined) == 86
    for key, r in joined.items():
        assert abs(r.score - arrays[key].score) < 1e-4
        assert r.cross_entropy == arrays[key].cross_entropy or abs(r.cross_entropy - arrays[key].cross_entropy) < 1e-4
    again = train(docs(rows))
    assert np.allclose(again.level, models.level, atol=1e-4)


def test_runs_whose_short_hashes_collide_stay_apart(docs):
    """Two runs with equal leading 18 bits of their hashes have counts of their own."""
    seen = {}
    for code in range(0x4E00, 0x9FFF):
        key = int(language._run_keys(np.array([code], np.uint32), 1)[0]) >> 46
        if key in seen:
            break
        seen[key] = code
    one, other = chr(seen[key]), chr(code)
    models = train(docs([(k, one * 3, "aa", "s") for k in range(8)] + [(k, other * 3, "bb", "s") for k in range(8)]))
    got = {r.doc_id: r.lang_pred for r in identify(docs([(1, one), (2, other)]), models).collect()}
    assert got == {1: "aa", 2: "bb"}


def test_rejection_levels_come_from_all_training_texts(docs, monkeypatch):
    """Every text of a language with texts in both halves is scored once, by a model that has not seen it."""
    rows = corpus(size=240) + [(900, "漢字漢字", "dd", "s")]
    seen = []
    scored = language._scored

    def noted(texts, models):
        out = scored(texts, models)
        seen.append((sorted(r.text for r in texts.collect()), [r.score for r in out.collect()]))
        return out

    monkeypatch.setattr(language, "_scored", noted)
    models = train(docs(rows))
    assert sorted(t for texts, _ in seen for t in texts) == sorted(t for _, t, lang, _ in rows if lang != "dd")
    assert sum(len(scores) for _, scores in seen) == 240 and not set(seen[0][0]) & set(seen[1][0])
    assert min(s for _, scores in seen for s in scores) <= models.level.min() and models.langs[3] == "dd"
    assert models.level[3] == models.level[:3].min()


def test_hashes_are_found_by_their_buckets():
    rng = np.random.default_rng(5)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    for known in (rng.integers(low, high, 5000), np.arange(-700, 700) * 3, np.array([high]), np.array([low, -1, 0, high])):
        known = np.unique(known)
        table = pa.table({"kind": np.zeros(len(known), np.int32), "order": np.full(len(known), 2, np.int32), "key": known, "logs": [[0.0]] * len(known)})
        arrays = language.Arrays(table, 1, np.zeros(1))
        asked = np.concatenate((known, known + (known < high), known - (known > low), [low, high, 0]))
        place, _ = arrays._found(0, 2, asked)
        where = {k: i for i, k in enumerate(known.tolist())}
        assert place.tolist() == [where.get(k, -1) for k in asked.tolist()]


def test_own_language_scores_are_those_among_all(docs):
    rows = [(i, " ".join(w * (1 + i % 3) for w in ("the", "der", "una", "über")[: 1 + i % 4]) + f" word{i}", ("de", "en", "es")[i % 3], "a") for i in range(60)]
    arrays = language.train(docs(rows)).local()
    texts = [*(r[1] for r in rows), None, "", "?!", "x", "unseen 日本語 ñandú"]
    langs = np.arange(len(texts)) % 3
    every, chars = arrays.scores(texts)
    own, same = arrays.scores(texts, langs)
    assert own.shape == (len(texts), 1)
    assert own[:, 0].tolist() == every[np.arange(len(texts)), langs].tolist()
    assert same.tolist() == chars.tolist()


def test_distinct_runs_are_looked_up_once(docs, monkeypatch):
    """A slice that repeats its runs asks the model for no more of them than one that has each once."""
    arrays = language.train(docs(corpus(size=60))).local()
    asked, found = [], language.Arrays._found
    monkeypatch.setattr(language.Arrays, "_found", lambda self, kind, order, keys: asked.append(len(keys)) or found(self, kind, order, keys))
    once, _ = arrays.scores(["the union"])
    few = sum(asked)
    asked.clear()
    many, chars = arrays.scores(["the union " * 3000])
    assert chars.tolist() == [30_000] and sum(asked) < 10 * few
    assert np.allclose(once, many, atol=0.5)


def test_run_numbers():
    """Runs get one number if their characters and kind are equal, by tables of codes or, for large alphabets, sorted."""
    rng = random.Random(3)
    for alphabet, n in (("ab", 400), ("abcdefghij", 3000), ([chr(c) for c in range(0x4E00, 0x4E00 + 900)], 4000)):
        letters = np.array([ord(rng.choice(alphabet)) if rng.random() < 0.9 else 0 for _ in range(n)], np.uint32)
        kinds = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
        places = np.array(sorted(rng.sample(range(n - language.ORDER + 1), n // 2)))
        for kind in (None, kinds):
            number, first = language._run_numbers(letters, kind, places)
            runs = [(0 if kind is None else kind[p], *letters[p : p + language.ORDER].tolist()) for p in places.tolist()]
            assert len(set(runs)) == len(first) == number.max() + 1
            assert [runs[first[k]] for k in number.tolist()] == runs
