import base64
import hashlib
import random

import pytest
import zstandard

from rankfold.llm import warc
from rankfold.llm.shared import fresh_path
from rankfold.llm.urls import judged

PAGES = "page_id bigint, url string, html string, n int, sha string, first string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], PAGES)


def corpus():
    rng = random.Random(0)
    rows = [(k, f"https://h{k}.example.org/a b?é#{k}", "".join(rng.choice("abcé\r\n<>") for _ in range(rng.choice([0, 5, 300, 3000])))) for k in range(300)]
    rows += [(1000 + k, None, rows[k % 7][2]) for k in range(60)] + [(2000, "http://x\r\nWARC-Type: evil", "WARC/1.1\r\n\r\n"), (2001, "u", None), (2002, "u", "é" * 1_500_000)]
    return rows + [(None, "u", "unique payload"), (None, "u", rows[1][2]), (3, rows[3][1], rows[3][2])]


def expected(rows, least):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h or "")
        revisit = len(raw) >= least and to is not None and to != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    rows = corpus()
    got = warc.archived(pages(spark, rows), min_revisit_bytes=least)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=str) == expected(rows, least)


def test_payloads_and_random_access(spark, monkeypatch):
    rows = corpus()
    folder = "file://" + fresh_path(spark, "warc").removeprefix("file:").replace("//", "/")
    index = warc.write_archives(pages(spark, rows), folder)
    texts = {(i, (h or "").encode()) for i, _, h in rows}
    read = warc.read_archives(spark, folder, index, with_payload=True).where("record_type = 'response'").collect()
    assert {(r.page_id, bytes(r.payload)) for r in read} <= texts and len(read) < len(rows)
    some = warc.fetch(folder, index.where("page_id in (0, 2000, 2002)")).collect()
    assert {(r.page_id, bytes(r.payload)) for r in some} == {t for t in texts if t[0] in (0, 2000, 2002)}
    assert all("\r" not in (r.target_uri or "") for r in read)


def test_bundles_are_plain_zstandard(tmp_path):
    bundle = warc._Bundle(f"file://{tmp_path}")
    for k in range(5):
        bundle.add(k, *warc.record(k, "u", b"x" * 700_000, "D", None, "1970-01-01T00:00:00Z"))
    rows = bundle.close()
    raw = (tmp_path / bundle.name).read_bytes()
    frames = list(warc.frames_of(raw))
    assert len(frames) == 3 and rows.num_rows == 5
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(frames) and whole.count(b"WARC/1.1") == 5
    with pytest.raises(ValueError):
        list(warc.frames_of(raw[:-1]))


def test_empty_pages(spark):
    assert warc.archived(pages(spark, [])).count() == 0
    assert judged(pages(spark, []), [("allow", "org/")]).count() == 0


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

URLS = {
    "https://A.Example.ORG/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
    "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
    "http://example.org/es": ("example.org", "/es", "org/", "allow"),
    "http://badexample.org/es/1": ("badexample.org", "/es/1", "org/", "allow"),
    "x://y://z.org/a": ("y:", "//z.org/a", None, None),
    "http://org/": ("org", "/", "org/", "allow"),
    "http://example.org": ("example.org", "", None, None),
    "http://b.com/de/x#y": ("b.com", "/de/x", "com/de/", "block"),
    "http://b.com/fr/?q=://c.org/": ("b.com", "/fr/", "com/fr/", "allow"),
    "http://É.org/É\n?": ("É.org", "/É\n", "org/", "allow"),
    "no scheme": ("", "", None, None),
    "": ("", "", None, None),
    "http://?": ("", "", None, None),
    "http://u:p@b.com:80/de/": ("u:p@b.com:80", "/de/", None, None),
}


def test_hosts_paths_and_rules(spark):
    rows = [(k, u, None) for k, u in enumerate(URLS)] + [(50, None, None), (None, "http://org/", None), (0, next(iter(URLS)), None)]
    got = judged(pages(spark, rows), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None or r.page_id == 50:
            continue
        host, path, rule, verdict = URLS[rows[r.page_id][1]]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_model_learns_from_the_table(spark):
    rng = random.Random(1)
    name = lambda bad: ("cheap-" if bad else "") + "".join(rng.choice("abcdefgh") for _ in range(6)) + ".net"
    labelled = spark.createDataFrame([(name(k % 3 == 0), f"/{rng.choice(['pills', 'x']) if k % 3 == 0 else 'news'}/{k}", "block" if k % 3 == 0 else "allow") for k in range(300)], "host string, path string, verdict string")
    rows = [(k, f"http://{name(k % 2)}/{'pills' if k % 2 else 'news'}/{k}", None) for k in range(100)]
    got = {r.page_id: r.verdict for r in judged(pages(spark, rows), [], labelled).collect()}
    assert sum(got[k] == ("block" if k % 2 else "allow") for k in range(100)) >= 95


@pytest.mark.parametrize("times", [(60000, 60000), (60000, 1), (1, 60000)])
def test_url_model_with_hot_urls(spark, times):
    """Repeated urls neither crowd out the others nor leave the model without rows."""
    rows = [(k, "http://good.org/news", None) for k in range(times[0])] + [(k, "http://bad.com/de/x", None) for k in range(times[1])]
    rows += [(-1, "http://good.org/novel", None), (-2, "http://sub.bad.com/de/y", None), (-3, "ftp://other.net/news", None), (-4, None, None)]
    labelled = [("good.org", "/news", "allow")] * times[0] + [("bad.com", "/de/x", "block")] * times[1] + [("x.org", "/", None)]
    frame = spark.createDataFrame(labelled, "host string, path string, verdict string").repartition(8)
    out = {r.page_id: r for r in judged(pages(spark, rows[-4:]), [], frame).collect()}
    assert (out[-1].verdict, out[-2].verdict) == ("allow", "block")
    assert out[-3].block_probability < 0.5
