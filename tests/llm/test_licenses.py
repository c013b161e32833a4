import random
import re

from rankfold.llm.licenses import PHRASES, digest, rules, scanned

from .conftest import lowered

BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def base(text):
    w = re.findall(BETWEEN, lowered(text))
    hits = [(k, label) for phrase, label in PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def brute_labels(text):
    """Every match of every rule, with word intervals; those within one that is at least as strong go."""
    w = re.findall(BETWEEN, lowered(text))
    joined = " " + " ".join(w) + " "
    found = []
    for label, strength, expression, _ in rules():
        for m in re.finditer(f"(?<= )(?:{expression})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((start, start + m.group().count(" ") + 1, strength, label))
    found.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))
    kept = []
    for d in found:
        if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] for e in kept):
            kept.append(d)
    return kept


SNIPPETS = [
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "MIT License", "mit license mit license",
    "Released under the MIT License. Apache License", "Licensed under CC BY-NC 4.0.", "CC-BY-SA 3.0", "cc by cc by", "SPDX-License-Identifier: BSD-3-Clause", "the 2-clause BSD license",
    "All rights reserved.", "Permission is hereby granted, free of charge, to any person obtaining a copy", "see the Mozilla Public License 2.0", "gnu gpl v2", "GPL 3", "LGPL-2.1 or AGPLv3",
    "dedicated to the public domain", "Creative Commons Attribution NonCommercial NoDerivatives 4.0", "licence", "license", "the Unlicense", "mitlicense", "cc\u00e9 by", "do what the fuck you want to public license",
]


def corpus():
    rng = random.Random(0)
    filler = lambda: " ".join(rng.choice(["foo", "bar,", "gnu", "mit", "license", "été", "7", "by"]) for _ in range(rng.randint(0, 8)))
    rows = [(k, f"{filler()} {rng.choice(SNIPPETS)} {filler()}\n{rng.choice(SNIPPETS)}") for k in range(150)]
    rows += [(200 + k, s) for k, s in enumerate(SNIPPETS)]
    return rows + [(300, None), (301, ""), (302, " .,- "), (None, "mit license"), (303, "mit license, " * 3000), (5, rows[5][1]), (304, "word " * 30000 + "apache license")]


def test_places_and_detections_equal_brute_force(docs):
    rows = corpus()
    found = scanned(docs(rows)).collect()
    assert len(found) == len(rows)
    got = sorted(((r.doc_id, r.n_words, sorted(tuple(d) for d in r.detections)) for r in found), key=str)
    assert got == sorted(((i, base(t)[0], sorted(brute_labels(t))) for i, t in rows), key=str)


def test_digest(docs):
    rows = corpus()
    out = digest(scanned(docs(rows)))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in out.collect():
        text = texts[r.doc_id]
        assert tuple(r)[1:6] == base(text)
        assert r.labels == ",".join(sorted({x for x in base(text)[4].split(",") if x} | {d[3] for d in brute_labels(text)}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(brute_labels(text))


def written(pattern, rng):
    """A text that a parsed expression matches."""
    out = ""
    for kind, value in pattern:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "BRANCH":
            out += written(rng.choice(value[1]), rng)
        elif kind == "SUBPATTERN":
            out += written(value[3], rng)
        elif kind.endswith("REPEAT"):
            out += "".join(written(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
        elif kind == "IN":
            first = value[0]
            out += "7" if str(first[1]) == "CATEGORY_DIGIT" else chr(first[1] if str(first[0]) == "LITERAL" else first[1][0])
        elif kind == "NOT_LITERAL":
            out += "x"
        else:
            raise ValueError(kind)
    return out


def test_no_keyword_hides_a_match(docs):
    """Texts made from every rule: the prefilters let all matches through."""
    rng = random.Random(1)
    rows = []
    for label, strength, expression, _ in rules():
        for _ in range(2):
            text = written(re._parser.parse(expression), rng)
            assert re.fullmatch(expression, text), (label, text)
            rows.append((len(rows), f"foo {text} bar"))
    got = {r.doc_id: sorted(tuple(d) for d in r.detections) for r in scanned(docs(rows)).collect()}
    assert all(got[i] == sorted(brute_labels(t)) and got[i] for i, t in rows)


def test_empty_table_and_rule_count(docs):
    assert digest(scanned(docs([]))).count() == 0
    assert len(rules()) > 200 and all(" " in e or e.isalnum() for _, _, e, _ in rules() if e == e.strip())
