import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import plain
from tests.llm.data import prose
from tidewater.llm import bpe, interpolation, mixing, perplexity, stages, substrings
from tidewater.llm.bpe import Encoder, Vocabulary, read_vocabulary
from tidewater.llm.store import table


def test_stages_hold_what_they_promise(spark, folder):
    docs = table(spark, folder, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "mixture", "encoded"]
    good = stages.quality_rules(spark, docs, folder).cache()
    assert good.columns == docs.columns
    for r in good.collect():
        n, _, _, _, repeated = plain.base(r.text)
        assert n >= 50 and 100 * repeated <= 50 * n
    assert good.count() > 0.6 * docs.count()
    single = stages.near_duplicates(spark, good, folder).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in plain.groups(rows)})
    rows = [(r.doc_id, r.text) for r in single.collect()]
    clean = stages.repeated_passages(spark, single, folder).cache()
    got = {r.doc_id: r for r in clean.collect()}
    for (i, text), (_, gone, kept) in zip(rows, plain.stripped(rows), strict=True):
        assert got[i].text == (kept if gone else text) and got[i].n_chars == len(got[i].text)
    mixed = stages.mixture(spark, clean, folder).cache()
    total = clean.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    taken = mixed.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert abs(taken - 1.5 * total) <= 30
    enc = Encoder(Vocabulary(read_vocabulary()))
    out = stages.encoded(spark, mixed, folder).collect()
    assert len(out) == mixed.count() and sorted(r.ids for r in out) == sorted(enc.encode(r.text) for r in mixed.collect())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.count() > 0


CLASHES = ["size", "taken", "_cut", "_key", "_doc", "_print", "_id", "class", "component", "n_words", "kept_sha256", "kept", "log_perplexity", "_low", "_row", "_copy", "target", "places", "_model"]


def test_columns_of_any_name_come_through(spark, folder):
    rng = random.Random(1)
    texts = [prose(rng, 130) for _ in range(24)]
    texts += [texts[0], texts[1] + " more", texts[2][:300] + " " + prose(rng, 70)]
    rows = [(i, t, "en", "ab"[i % 2], len(t), *(f"{c}-{i}" for c in CLASHES)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[c] == f"{c}-{r.doc_id}" for r in found for c in CLASHES), name
    assert stages.encoded(spark, docs, folder).count() == len(rows)


def test_long_texts(spark, folder):
    rng = random.Random(2)
    words = [prose(rng, 1) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(1_050_000))
    assert len(long) > 5_000_000
    rows = [(i, prose(rng, 80), "en", "a", 0) for i in range(6)] + [(10, long, "en", "b", 0), (11, long + " end", "en", "b", 0), (12, "x" * 1_000_000, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id: r.n_words for r in perplexity.score(docs).select("doc_id", "n_words").collect()}[11] == 1_050_001
    assert sorted(r.doc_id for r in stages.near_duplicates(spark, docs, folder).select("doc_id").collect()) == [*range(6), 10, 12]
    # all but the last word of the second long text is the first's
    assert {r.doc_id: r.n_removed for r in substrings.strip(docs, texts=False).select("doc_id", "n_removed").collect()} == {**dict.fromkeys(range(6), 0), 10: 0, 11: 1_050_000, 12: 0}
    assert {r.doc_id: r.n_tokens for r in interpolation.score(docs).collect()}[10] == 1_050_001
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).selectExpr("doc_id", "size(ids) AS n", "sha2(decoded, 256) AS s").collect()}
    for r in bpe.round_trip(docs).select("doc_id", "n_tokens", "decoded_sha256").collect():
        assert (got[r.doc_id].n, got[r.doc_id].s) == (r.n_tokens, r.decoded_sha256)


def test_rows_alike_get_their_own_shares(spark, folder):
    rng = random.Random(3)
    text = prose(rng, 100)
    rows = [(1, text, "en", s, 0) for s in ("a", "b", "b", "b")] + [(i, prose(rng, 100), "en", "ab"[i % 2], 0) for i in range(2, 12)] + [(None, text, "en", "a", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = [(r.doc_id or -1, r.text, r.source, r.n_chars) for r in stages.mixture(spark, docs, folder).collect()]
    again = [(r.doc_id or -1, r.text, r.source, r.n_chars) for r in stages.mixture(spark, docs.repartition(5), folder).collect()]
    assert sorted(out) == sorted(again)
    total = sum(len(t.split()) for _, t, _, _ in out)
    assert abs(total - 1.5 * 100 * len(rows)) <= 2 and all(n == len(t) for _, t, _, n in out)


def test_odd_documents(spark, folder):
    rng = random.Random(0)
    text = prose(rng, 120)
    rows = [(1, text, "en", "a", 0), (1, text, "en", "a", 0), (2, None, None, None, None), (3, "", "en", "a", 0), (None, prose(rng, 90), "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).collect()
        stage(spark, docs.limit(0), folder).collect()


def test_stages_return_heap_first(spark, folder):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = table(spark, folder, "documents").limit(3)
    before = full()
    stages.encoded(spark, docs, folder)
    assert full() > before
