"""Byte-level BPE against an installed tokenizer library and against a plain merge loop."""

import base64
import hashlib
import random

import numpy as np
import pytest
import regex

from rankfold.llm import bpe
from rankfold.llm.queries import op11_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    rows = [None, "", " ", "\n\n \t x", "<|endoftext|> it's WE'LL", "naïve Straße 東京 123456   !", "a" * 777, "ü" * 501]
    rows += ["".join(rng.choice("aab ") for _ in range(k)) for k in range(1, 200, 7)]
    return rows + ["".join(rng.choice("etaoinshrdlu") for _ in range(20000)), "x " * 700000 + "y" * 30000]


def test_ids_equal_the_library(docs, library):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "a null id"), (3, "again"), (3, "again")]
    tokens = bpe.encoded(docs(rows), PATH, PATTERN)
    assert tokens.columns == ["doc_id", "ids"]
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in tokens.collect())
    assert got == sorted((str(k), library.encode_ordinary(t or "")) for k, t in rows)
    back = sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe.decoded(tokens, PATH).collect())
    assert back == sorted((str(k), (t or "").encode()) for k, t in rows)


def test_every_character(library):
    with open(PATH, "rb") as f:
        ranks = bpe.Ranks(f.read())
    letters = "".join(chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    parts = [letters[i : i + 1000] for i in range(0, len(letters), 1000)]
    for part, ids in zip(parts, ranks.encode(parts, regex.compile(PATTERN))):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(part)


def test_queue_equals_plain_merging(monkeypatch):
    """Ranks out of the order of training: a merge may open a pair of a lower rank than its own."""
    rng = random.Random(8)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 700:
        tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))))
    order = sorted(tokens, key=lambda t: (len(t) > 1, rng.random()))
    ranks = bpe.Ranks(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(order)))
    rank = {t: k for k, t in enumerate(order)}

    def plain(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            pairs = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
            if not pairs:
                return [rank[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert [np.frombuffer(i, "<u4").tolist() for i in ranks.merge(words)] == [plain(w) for w in words]
    monkeypatch.setattr(bpe, "MEMORY", 20)  # forgetting pairs and pre-tokens changes nothing
    pattern = regex.compile(r"\w+|\W+")
    lines = [" ".join(w.decode() for w in words[k : k + 9]) for k in range(0, 300, 9)]
    for text, ids in zip(lines, ranks.encode(lines, pattern)):
        whole = lambda p: [rank[p]] if p in rank else plain(p)
        assert np.frombuffer(ids, "<u4").tolist() == [i for p in pattern.findall(text) for i in whole(p.encode())]


def test_query_and_edges(spark, docs, library, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts()[:30])]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op11_bpe(spark, str(tmp_path)).collect():
        ids = library.encode_ordinary(rows[r.doc_id][1] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()
    assert bpe.decoded(bpe.encoded(docs([]), PATH, PATTERN), PATH).count() == 0
    short = tmp_path / "ranks"
    short.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        bpe.Ranks(short.read_bytes())
