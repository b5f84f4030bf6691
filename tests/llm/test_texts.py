"""Operators on documents against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from tests.llm.data import SCHEMA, documents, prose
from tidewater.llm import interpolation, jaccard, perplexity, substrings


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_base_rules(rows):
    got = perplexity.base(pa.array([t for _, t, _, _ in rows]))
    assert list(zip(*(got[c].tolist() for c in perplexity.BASE), strict=True)) == [plain.base(t) for _, t, _, _ in rows]


@pytest.mark.parametrize("sent, part, block, size", [(1 << 21, 1 << 20, 1 << 20, 1 << 19), (0, 700, 3000, 64)])
def test_perplexity_equals_plain_counting(spark, rows, monkeypatch, sent, part, block, size):
    for name, value in (("SENT", sent), ("PART", part), ("BLOCK", block), ("SLICE", size), ("FLUSH", 4 * part)):
        monkeypatch.setattr(perplexity, name, value)
    own = [(t, lang) for _, t, lang, _ in rows] + [("x y z " * 30, "alone"), ("中文的字 " * 40, "zh"), ("中文字的 " * 40, "zh"), ("abc", None)]
    df = spark.createDataFrame([(i, *r, "mine", "mine") for i, r in enumerate(own)], "doc_id long, text string, lang string, _low string, log_perplexity string").repartition(3)
    got = {r.doc_id: r for r in perplexity.score(df).collect()}
    expected = plain.log_perplexities(own, perplexity.half, perplexity.ORDER)
    assert len(got) == len(own)
    for i, x in enumerate(expected):
        assert got[i].log_perplexity is x is None or math.isclose(got[i].log_perplexity, x, rel_tol=1e-6)
        assert got[i]._low == "mine" and got[i].n_words == plain.base(own[i][0])[0]
    # bands and verdicts, by their definition
    kept = {r.doc_id: r.kept for r in perplexity.judge(df).collect()}
    for lang in {x for _, x in own}:
        all_ = [(i, expected[i], plain.base(t)) for i, (t, x) in enumerate(own) if x == lang]
        fails = {i for i, _, b in all_ if b[0] < 50 or 100 * b[4] > 50 * b[0]}
        bins = sorted(math.floor(x / perplexity.BIN) for i, x, _ in all_ if i not in fails)
        low, high = -math.inf, math.inf
        if len(bins) >= perplexity.LEAST_DOCS:
            q1, q3 = ((bins[math.ceil(len(bins) * k / 4) - 1] + 0.5) * perplexity.BIN for k in (1, 3))
            width = perplexity.SPREAD * max(q3 - q1, perplexity.LEAST_WIDTH)
            low, high = q1 - width, q3 + width
        assert {i: kept[i] for i, _, _ in all_} == {i: i not in fails and low <= x <= high for i, x, _ in all_}


def test_slices_change_nothing(monkeypatch):
    texts = ["", "abc", "x" * 300, "long " * 200, "é中😀"]
    whole = [np.concatenate(x) for x in zip(*perplexity.slices(texts), strict=True)]
    monkeypatch.setattr(perplexity, "SLICE", 64)
    cut = list(perplexity.slices(texts))
    assert len(cut) > 5 and all((np.concatenate(x) == y).all() for x, y in zip(zip(*cut, strict=True), whole, strict=True))
    assert np.bincount(whole[0]).tolist() == [len(t) for t in texts]


def test_probabilities_sum_to_one(spark):
    texts, n = ["abracadabra", "abrakadabra", "ab", "cab cad"], perplexity.ORDER
    counts = Counter((" " * (n - 1) + t)[i : i + n] for t in texts for i in range(len(t)))
    number = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    code = lambda g: (number(g[:-3]), number(g[-3:]))
    letters = sorted(set("".join(texts)) | {" ", "z"})
    contexts = [h[1 - n :] for h in ("abra", "zzab", "  ca", "zzzz")]
    rows = [("=x", 0, *code(g), c) for g, c in counts.items()] + [("=x", 1, *code(h + c), 1) for h in contexts for c in letters]
    found = {(r.high, r.low): math.exp(r.logp) for r in perplexity.likelihoods(spark.createDataFrame(rows, "model string, fold int, high long, low long, n long")).collect() if r.fold == 1}
    for h in contexts:
        # all that is missing is the uniform part of the letters not asked for
        total = sum(found[code(h + c)] for c in letters)
        least = min(found[code(h + c)] for c in letters)
        assert abs(total + least * (perplexity.POINTS - len(letters)) - 1) < 1e-3


def test_bands_reject_noise_and_keep_prose(spark):
    rng = random.Random(1)
    clean = [(i, prose(rng, 150), "en", "s") for i in range(120)]
    noise = [(1000 + i, " ".join("".join(rng.choice("#$%&XZQ0918|~") for _ in range(7)) for _ in range(80)), "en", "s") for i in range(3)]
    odd = [(2000, None, "en", "s"), (2001, "", None, "s"), (2002, "ab " * 100, "en", "s"), (2003, prose(rng, 20), "xx", "s")]
    df = spark.createDataFrame([(*r, True) for r in clean + noise + odd], SCHEMA + ", kept boolean")
    kept = {r.doc_id: r.kept for r in perplexity.judge(df).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in noise + odd)
    assert perplexity.judge(df.limit(0)).count() == 0


def test_letters_of_other_scripts_are_told_apart(spark):
    rng = random.Random(1)
    greek = str.maketrans("abcdefghijklmnopqrstuvwxyzé", "αβγδεζηθικλμνξοπρστυφχψωабв")
    clean = [(i, prose(rng, 150).translate(greek), "el") for i in range(120)]
    noise = [(1000 + i, " ".join("".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in w) for w in prose(rng, 150).split(" ")), "el") for i in range(3)]
    kept = {r.doc_id: r.kept for r in perplexity.judge(spark.createDataFrame(clean + noise, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in noise)


def test_passages(spark, docs, rows):
    expected = {i: x for (i, _, _, _), x in zip(rows, plain.stripped([(i, t) for i, t, _, _ in rows]), strict=True)}
    for texts in (False, True):
        for r in substrings.strip(docs.select("doc_id", "text"), texts=texts).collect():
            n, gone, kept = expected[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
            if texts and gone:
                assert r.text == kept
    assert any(x[1] for x in expected.values())


def test_passages_of_repeated_and_null_ids(spark):
    rng = random.Random(2)
    p, q = prose(rng, 25), prose(rng, 40)
    rows = [(1, p + " " + p), (1, p + " " + p), (1, q), (None, p), (0, "x"), (5, q), (5, q), (3, None), (7, "y " * 100)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.strip(df).collect())
    assert got == Counter((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, g, k) in zip(rows, plain.stripped(rows), strict=True))
    assert substrings.strip(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1 << 14, 3])
def test_passages_with_a_full_filter(spark, docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "FILTER_BITS", 64)
    # the function that is sent takes this along
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    expected = {i: x[1] for (i, _, _, _), x in zip(rows, plain.stripped([(i, t) for i, t, _, _ in rows]), strict=True)}
    assert {r.doc_id: r.n_removed for r in substrings.strip(docs.select("doc_id", "text"), texts=False).collect()} == expected


def test_groups(docs, rows):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect())
    assert got == sorted(plain.groups([(i, t) for i, t, _, _ in rows]))
    assert len({c for _, _, c in got}) < len(got) - 10


def near_copies(seed, n):
    rng = random.Random(seed)
    bases = [prose(rng, 60).split(" ") for _ in range(3)]
    out = []
    for i in range(n):
        w = list(bases[i % 3])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        if rng.random() < 0.2:
            w = w[: rng.randint(40, 60)]
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("seed, hot", [(1, 1 << 16), (2, 4), (3, 0)])
def test_large_groups_near_the_bound(spark, seed, hot):
    rows = near_copies(seed, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, hot=hot).collect())
    assert got == sorted(plain.groups(rows))


@pytest.mark.parametrize("square, wide", [(1 << 12, 1 << 15), (3, 2)])
def test_rows_without_id_and_wide_columns(spark, monkeypatch, square, wide):
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "HOT_LOCAL", 1)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 2)
    w = [f"w{i}" for i in range(40)]
    near = lambda k: " ".join(w[k:] + [f"z{i}" for i in range(k)])
    # each links with the next alone, and the one between has no id
    rows = [(1, near(0)), (None, near(2)), (2, near(4)), (None, "of its own " * 3), (3, " ".join(w[::-1]))]
    assert [c for _, _, c in plain.groups([(9 if i is None else i, t) for i, t in rows])] == [1, 1, 1, 9, 3]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, component string").repartition(3)
    got = jaccard.join(df, square=square).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id or 0 for r in jaccard.one_of_each(df).collect()) == [0, 1, 3]
    rows = near_copies(7, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, square=square).collect()) == sorted(plain.groups(rows))


def test_sets_that_share_a_hash_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    assert jaccard.classed(docs)[0] == jaccard.SEEDS[0]
    shapes = jaccard.shapes
    few = lambda docs, seed: shapes(docs, seed).selectExpr("doc_id", "key", "if(%d < 2, class %% 7, class) AS class" % seed, "check", "n", "said", "bits")
    monkeypatch.setattr(jaccard, "shapes", few)
    seed, said, classes = jaccard.classed(docs)
    assert seed == 2 and classes.count() == 30
    monkeypatch.setattr(jaccard, "shapes", lambda docs, seed: few(docs, 0))
    with pytest.raises(RuntimeError):
        jaccard.classed(docs)


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [16, 64, 1024, 4096])
def test_words_that_a_polynomial_takes_for_equal(spark, n):
    a, b = thue_morse(n)
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, a), (4, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.strip(df, texts=False).collect()} == dict.fromkeys((1, 2, 3, 4), 0)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()) == sorted(plain.groups(rows))
    swap = {"a": "left", "b": "right"}
    rows = [(i, " ".join(swap[c] for c in x[: min(n, 1024)])) for i, x in enumerate((a, b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.n_removed) for r in substrings.strip(df, texts=False).orderBy("doc_id").collect()] == [(i, g) for (i, _), (_, g, _) in zip(rows, plain.stripped(rows), strict=True)]


def test_spans_whose_words_differ_stay(spark, monkeypatch):
    rng = random.Random(6)
    p, q = prose(rng, 30), prose(rng, 30)
    df = spark.createDataFrame([(1, p), (2, q), (3, p)], "doc_id long, text string")
    spans = substrings.spans
    # the second text is said to repeat the first, which it does not
    keys = {r._doc: r._key for r in df.selectExpr("doc_id AS _doc", "xxhash64(doc_id, text) AS _key").collect()}
    monkeypatch.setattr(substrings, "drop", lambda *kept: None)
    monkeypatch.setattr(substrings, "spans", lambda docs, name="x": spans(docs, name).unionByName(spark.createDataFrame([(2, keys[2], 0, 30, 1, keys[1], 0)], "doc long, key long, start int, words int, source long, source_key long, source_start int")))
    assert {r.doc_id: r.n_removed for r in substrings.strip(df, texts=False).collect()} == {1: 0, 2: 0, 3: 30}


def test_one_of_each(spark):
    rows = near_copies(4, 60) + [(3, near_copies(4, 60)[3][1]), (100, None), (101, ""), (102, "a b"), (103, "a b")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, class string")
    stays = jaccard.one_of_each(df)
    least = {c for i, n, c in plain.groups(rows)}
    assert sorted(r.doc_id for r in stays.collect()) == sorted(least)
    assert stays.columns == df.columns and jaccard.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("head", [1 << 20, 5])
def test_scores(spark, docs, rows, head):
    tokens = {i: [*plain.words(t, lower=True), None] for i, t, _, _ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in interpolation.score(docs, head).collect()}
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    own = [i for i in tokens if held[i]]
    assert sum(got[i].score for i in own) > sum(got[i].base_score for i in own)


def test_scores_do_not_depend_on_the_blocks(spark, docs):
    a = {r.doc_id: r.score for r in interpolation.score(docs, 1 << 20).collect()}
    b = {r.doc_id: r.score for r in interpolation.score(docs.repartition(2), 30).collect()}
    assert set(a) == set(b) and all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


def test_scores_of_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a z"), (9, None)], "doc_id long, text string")
    got = interpolation.score(df, 1).collect()
    assert len(got) == 4 and len({(r.n_tokens, r.n_known, r.base_score, r.score) for r in got if r.doc_id == 1}) == 1
    assert interpolation.score(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 9000])
def test_rare_words_have_pairs_of_their_own(spark, block):
    rng = random.Random(3)
    common = [f"c{i}" for i in range(2100)]
    rows = [(i, " ".join(rng.sample(common, 700) + [x for j in rng.sample(range(200), 60) for x in (f"r{j}", f"s{j}")])) for i in range(40)]
    tokens = {i: [*plain.words(t, lower=True), None] for i, t in rows}
    got = {r.doc_id: r.score for r in interpolation.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    pairs = Counter(p for i, t in tokens.items() if not held[i] for p in zip([None, *t], t))
    n, v = sum(c.values()), len(c)
    parts = lambda h, w: (pairs[h, w] / max(c[h], 1), c[w] / n, 1 / (v + 1))
    seen = Counter(p for i, t in tokens.items() if held[i] for p in zip([None, *t], t))
    weights = {}
    for b in {c[h].bit_length() for h in c} | {c[h].bit_length() for h, _ in seen} | {0}:
        own, x = [(parts(*p), m) for p, m in seen.items() if c[p[0]].bit_length() == b], (1 / 3,) * 3
        for _ in range(40 if own else 0):
            sums = [math.fsum(m * x[i] * p[i] / sum(map(math.prod, zip(x, p))) for p, m in own) for i in range(3)]
            x = tuple(s / math.fsum(sums) for s in sums)
        weights[b] = x if own else None
    assert set(seen) and all(weights[c[h].bit_length()] for i, t in tokens.items() if held[i] for h in [None, *t[:-1]])
    for i, t in tokens.items():
        if held[i]:
            expected = sum(math.log10(sum(map(math.prod, zip(weights[c[h].bit_length()], parts(h, w))))) for h, w in zip([None, *t], t))
            assert math.isclose(got[i], expected, rel_tol=1e-9)
