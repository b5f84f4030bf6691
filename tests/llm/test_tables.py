"""Operators on pages, vectors and sources."""

import gzip
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tests.llm.data import SCHEMA, documents
from tests.llm.plain import words
from tests.oracle import connect, rows_of, rows_of_sql
from tidewater.llm import mixing, queries, urls, vectors, warc


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, folder, name):
    columns, rows = rows_of(queries.queries()[name](spark, folder))
    other, expected = rows_of_sql(connect(folder), queries.oracle_sql()[name])
    assert columns == other
    assert rows == expected


ODD = ["https://EXAMPLE.net/en/x?y#z", "http://a.example.net/de/", "http://notexample.net/en/", "https://example.net", "http://a.example.com/de/q", "http://b.org/fr/", "http://b.org/de/", "no scheme", None, "", "x://", "http://net/", "http://net/a", "a://b://c/d", "http://H#frag/en/"]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(ODD * 2)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(ODD))] == [
        ("example.net", "/en/x", "example.net/en/"), ("a.example.net", "/de/", "net/"), ("notexample.net", "/en/", "net/"), ("example.net", "", None), ("a.example.com", "/de/q", "example.com/de/"),
        ("b.org", "/fr/", "org/fr/"), ("b.org", "/de/", None), ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("net", "/", "net/"), ("net", "/a", "net/"), ("b:", "//c/d", None), ("h", "", None),
    ]
    assert all(r.verdict in ("allow", "block") for r in got.values()) and urls.filter_urls(df.limit(0)).count() == 0


def test_rules_of_one_length_and_tables_of_one_kind(spark):
    df = spark.createDataFrame([(1, "http://a.xx/yy/1"), (2, "http://xx/yy/"), (3, None)], "page_id long, url string")
    for rules in ([("allow", "xx", "/yy/"), ("block", "a.xx", "/yy")], [("block", "a.xx", "/yy"), ("allow", "xx", "/yy/")]):
        got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, rules=rules).collect()}
        # the longer of two rules wins, the first of equals
        assert got == {1: ("a.xx/yy", "block"), 2: ("xx/yy/", "allow"), 3: (None, got[3][1])}
    for rules in ([("allow", "xx", "/"), ("block", "xx", "/")], [("block", "xx", "/"), ("allow", "xx", "/")]):
        assert {r.verdict for r in urls.filter_urls(df.filter("page_id < 3"), rules=rules).collect()} == {rules[0][0]}


def test_the_whole_url_is_read(spark):
    rows = [(i, f"http://h{i % 7}.org/fr/x?topic={'gambling' if i % 2 else 'cooking'}{i}") for i in range(200)]
    rows += [(1000 + i, f"http://h{i % 7}.com/de/x?topic={'gambling' if i % 2 else 'cooking'}{i}") for i in range(20)]
    rules = [("allow", "org", "/fr/x"), ("block", "net", "/")]
    rows += [(2000 + i, f"http://h{i % 7}.net/fr/x?topic=gambling{i}") for i in range(200)]
    rows = [r for r in rows if r[0] >= 1000 or not r[0] % 2]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert [got[1000 + i] for i in range(20)] == ["block" if i % 2 else "allow" for i in range(20)]


def test_url_model_learns_what_rules_say(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, f"http://{'spam-' if i % 2 else 'good'}{word()}.{'net/x' if i % 2 else 'org/fr/x'}") for i in range(600)]
    new = [(1000 + i, f"http://{'spam-' if i % 2 else 'good'}{word()}.{'net' if i % 2 else 'org/fr'}") for i in range(20)]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows + new, "page_id long, url string")).collect()}
    assert [got[1000 + i] for i in range(20)] == ["block" if i % 2 else "allow" for i in range(20)]


def test_salted_scores_are_the_same(spark, folder, monkeypatch):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    a = urls.filter_urls(pages).select("page_id", "verdict", "score").orderBy("page_id").collect()
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    assert urls.filter_urls(pages).select("page_id", "verdict", "score").orderBy("page_id").collect() == a


def test_archives(spark, tmp_path, monkeypatch):
    long = "p" * 100
    rows = [(5, "http://a\r\nX: y", long), (2, None, long), (9, "u", long + "\r\n\r\nWARC/1.1\r\n\r\n"), (3, "u", "short"), (1, "u", "short"), (4, "u", None), (7, "é", "é" * 60), (6, "é", "é" * 60), (None, "u", long)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, kind string").repartition(3)
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    warc.write_archive(df, a)
    warc.deduplicate(spark, a, warc.resolve(warc.read_archive(spark, a)), b)
    got = {r.page_id: r for r in warc.read_archive(spark, b).collect()}
    assert len(got) == len(rows)
    for i, _, body in rows:
        raw = (body or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: got[i].refers_to for i in got if got[i].kind == "revisit"} == {5: 2, None: 2, 7: 6}
    texts = b"".join(gzip.open(p).read() for p in (tmp_path / "b").glob("part-*"))
    assert texts.count(b"WARC-Type: revisit") == 3 and texts.count(b"p" * 100) == 2
    # ids are new, and what revisits refer to is there
    ids = lambda folder: re.findall(rb"WARC-Record-ID: (\S+)", b"".join(gzip.open(p).read() for p in (tmp_path / folder).glob("part-*")))
    assert len(set(ids("b"))) == len(rows) and not set(ids("a")) & set(ids("b"))
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", texts)) <= set(ids("b"))
    monkeypatch.setattr(warc, "WAVE_BYTES", 100)
    warc.deduplicate(spark, a, warc.resolve(warc.read_archive(spark, a)), f"{b}2")
    key = lambda r: (r.page_id or 0, r.kind, r.payload_digest, r.refers_to or 0)
    assert sorted(map(key, warc.read_archive(spark, f"{b}2").collect())) == sorted(map(key, got.values()))
    warc.write_archive(df.limit(0), f"file://{tmp_path}/c")
    assert warc.read_archive(spark, f"file://{tmp_path}/c").count() == 0


def test_each_record_is_a_member(spark, tmp_path, monkeypatch):
    rng = random.Random(0)
    rows = [(i, "u", "".join(chr(rng.randrange(32, 126)) for _ in range(n))) for i, n in enumerate([0, 5, 3000, 200_000, 5_000_000])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archive(df, f"file://{tmp_path}/a")
    for path in (tmp_path / "a").glob("part-*"):
        data = path.read_bytes()
        while data:
            gz = zlib.decompressobj(31)
            text = gz.decompress(data) + gz.flush()
            assert gz.eof and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and text.count(b"WARC-Type") == 1
            data = gz.unused_data
    # long archives are several files
    monkeypatch.setattr(warc, "FILE_ROWS", 1)
    long = [(i, "u", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGH", k=2_000_000))) for i in range(3)]
    warc.write_archive(spark.createDataFrame(long, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/b")
    assert len(list((tmp_path / "b").glob("part-*"))) == 3
    for folder, known in (("a", rows), ("b", long)):
        assert {r.page_id: r.payload_bytes for r in warc.read_archive(spark, f"file://{tmp_path}/{folder}").collect()} == {i: len(x) for i, _, x in known}
    # long records are several members
    monkeypatch.setattr(warc, "MEMBER", 1000)
    parts = list(warc.members(b"x" * 2500))
    assert len(parts) == 3 and all(p[-1] == 0 for p in parts) and gzip.decompress(b"".join(parts)) == b"x" * 2500


def brute(rows, asked, k=5):
    good = [(i, np.array(v, float) / max(map(abs, v))) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in good:
        if asked(i):
            near = sorted((-(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)), j) for j, v in good if j != i)
            out[i] = [j for _, j in near[:k]]
    return out


def test_nearest_with_every_pair_asked(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(200 + i, [1.0] * 8) for i in range(30)]
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0, None, *[0.0] * 6]), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (305, [1.0, 2.0]), (None, [1.0] * 8), (350, [2.0**-600] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, query int")
    got = {}
    for r in vectors.search(df, F.col("vec_id") % 10 == 0, share=1.0, block=16, codes=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    expected = brute(rows, lambda i: i % 10 == 0)
    assert {k: v for k, v in got.items() if k < 200} == {k: v for k, v in expected.items() if k < 200}
    assert got[200] == [201, 202, 203, 204, 205] and set(got) == set(expected)
    assert vectors.search(df.limit(0), F.lit(True)).count() == 0
    assert vectors.search(df.limit(1), F.lit(True)).count() == 0


def test_nearest_within_each_length(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8 if i < 60 else 4).tolist()) for i in range(80)] + [(100, [1.0])]
    got = {}
    for r in vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, share=1.0, codes=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    assert got == {i: sorted((j for j, w in rows if j != i and len(w) == len(v)), key=lambda j: -cosine(v, rows[j][1]))[:5] for i, v in rows if i % 10 == 0 and i < 80}


@pytest.mark.parametrize("size", ["", "sf0.1"])
def test_recall(spark, folder, size):
    folder = folder if not size else f"{os.path.dirname(folder)}/{size}"
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in vectors.op3_nearest(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        s = x @ x[at]
        s[at] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hits, total = hits + len(best & got[int(ids[at])]), total + 5
    assert hits / total >= 0.9


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (6, 5))
    index = vectors.MultiIndex(rng.normal(size=(6, 2)), rng.normal(size=(5, 2)), counts)
    a, b = index.distances(rng.normal(size=(1, 4)))
    sums = sorted((a[0][p] + b[0][q], int(counts[p, q])) for p in range(6) for q in range(5))
    for enough in range(1, counts.sum() + 1):
        last, got = index.walk(a[0], b[0], enough)
        met = [n for d, n in sums if d <= last + 1e-12]
        assert got == sum(met) >= enough > got - met[-1]


def test_regions_hold_every_entry_once():
    counts = np.array([[3, 0, 40], [2, 9, 1]])
    r = vectors.Regions(counts, 10)
    assert r.parts.tolist() == [1, 1, 4, 1, 1, 1] and r.first[[0, 2, 3, 4, 5]].tolist() == [0, 1, 5, 6, 6]
    assert r.met(np.array([0, 2, 5])).tolist() == [0, 1, 2, 3, 4, 6]


def test_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(2)
    v = [rng.normal(size=8).tolist() for _ in range(40)]
    rows = [(i, x) for i, x in enumerate(v)] + [(10, v[10]), (10, v[11]), (20, v[3])]
    got = {}
    for r in vectors.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    expected = {}
    for at, (i, x) in enumerate(rows):
        if i % 10 == 0:
            near = sorted((-cosine(x, w), j) for o, (j, w) in enumerate(rows) if o != at)
            expected.setdefault(i, []).extend((n + 1, j, round(-d, 9)) for n, (d, j) in enumerate(near[:5]))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in expected.items()}


def test_share_is_small_where_recall_is_high():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(50, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.MultiIndex.fit(x, vectors.codes_for(len(x)))
    assert index.share(x, 5) < 0.1


def test_targets(spark):
    for sizes in ([10, 10, 10], [1, 100, 3, 0], [5], [0, 0], [7, 7, 7, 7, 1000], list(range(50))):
        names = [None if i == len(sizes) - 1 else chr(0x10000 - 5 + i) for i in range(len(sizes))]
        got = {r.source: r for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in zip(names, sizes, strict=True)], "source string, size long")).collect()}
        expected = plain.allot(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
        assert len(got) == len(sizes) and all(got[s].source_size == n and math.isclose(got[s].target, x, abs_tol=1e-9) for s, n, x in zip(names, sizes, expected, strict=True))
    assert mixing.targets(spark.createDataFrame([], "source string, size long")).count() == 0


@pytest.mark.parametrize("bins", [1, 4, 4096])
def test_mix(spark, bins):
    rows = documents()
    rows += [rows[3], rows[4]]
    df = spark.createDataFrame([(*r, 1.5 if r[0] % 2 else None, "x") for r in rows], SCHEMA + ", w double, target string")
    sized = df.withColumn("size", mixing.size_of(F.col("text")))
    got = mixing.mix(sized, "w", bins=bins).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0], s[1] = s[0] + r.size, s[1] + r.taken
    for size, taken, target, said in by.values():
        assert size == said and taken == math.floor(target)
    again = mixing.mix(sized.repartition(5), "w", bins=7)
    key = lambda r: (r.doc_id, r.source or "", r.size, r.taken)
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    made = mixing.copies(mixing.mix(sized, "w", bins=bins))
    assert made.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert mixing.mix(sized.limit(0), "w").count() == 0
