import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import plain
from tests.llm.data import SCHEMA, documents
from tidewater.llm import bpe, lengths

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary()))


ODD = ["", "  ", "Hello World!! it's 12 ÇA  a<|endoftext|>b", "ΑΣ ΟΔΟΣ İx ǅ", "na\u0308ive caf\u00e9\u00a0x\u2028y 😀\x1cz\x1d \x85w", "don't'll 'S ı ﬁ é ẞ", "<|startoftext|><|endoftext|> <|endo", "\x00x\u200by\ufeffz", "a" * 3000, "ab" * 2000 + "the" * 300]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, enc, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert enc.encode(text) == ids
    d = bpe.Decoder(enc.v)
    assert "".join(d.feed([i]) for i in ids) + d.finish() == library.decode(ids, skip_special_tokens=False)


def plainly(v, piece):
    raw = piece.encode()
    return plain.merged([v.inner[raw[i : i + 1]] for i in range(len(raw) - 1)] + [v.final[raw[-1:]]], v.pairs)


def test_transducer_equals_merging_whole(enc):
    rng = random.Random(3)
    lookahead = enc.v.lookahead()
    for alphabet in ("a", "ab", "aeinorst", "the", "lé中", "0!-"):
        for n in [*range(1, 40), 300, 700]:
            piece = "".join(rng.choice(alphabet) for _ in range(n))
            t = bpe.Transducer(enc.v)
            raw = piece.encode()
            cut = rng.randrange(len(raw))
            assert t.feed(raw[:cut]) + t.finish(raw[cut:]) == plainly(enc.v, piece)
            assert t.most <= lookahead + 8 * enc.v.longest


def test_memory_is_constant(enc, library):
    rng = random.Random(5)
    for alphabet in ("a", "ha", "aeinorst"):
        piece = "".join(rng.choice(alphabet) for _ in range(20_000))
        t = bpe.Transducer(enc.v)
        assert t.finish(piece.encode()) == library.encode(piece, add_special_tokens=False).ids
        assert t.most <= 16 * enc.v.longest


def test_joints_by_hand():
    # a a -> A (rank 0), b c -> B (rank 1), a b -> C (rank 2)
    pairs = {0 << 32 | 0: (0, 3), 1 << 32 | 2: (1, 4), 0 << 32 | 1: (2, 5)}
    j = bpe.Joints(pairs, 6, 2)
    assert j.hold(3, 0) and not j.hold(0, 3) and j.hold(0, 4) and not j.hold(5, 2) and not j.hold(0, 1) and j.hold(3, 3)
    assert j.hold(2, 0) and all(map(j.whole, range(6)))
    with pytest.raises(ValueError):
        bpe.Joints({1: (0, 3), 2: (1, 3)}, 4, 2)


def test_every_piece_goes_through_the_transducer(library):
    e = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary()))
    e.encode("hello hello hello brave new-world's")
    # a word is kept from its second time on
    assert e.streamed == 7 and list(e.table) == ["hello"]


def test_lookahead_by_hand():
    # bc before ab: reading "a" then "b" then "c" decides whether a|b merge
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 1 + 2
    assert bpe.sufficient_lookahead([("a", "b")]) == 2


def test_small_table_changes_nothing(library):
    small = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary()), pieces=8)
    texts = [t for _, t, _, _ in documents() if t]
    assert [small.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query_columns(spark, library):
    rows = documents()
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA + ", n_tokens string")
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    coded = bpe.decode(bpe.encode(df.drop("n_tokens")))
    assert coded.filter("doc_id = 3").first().decoded == library.decode(library.encode(rows[3][1], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_byte_level_decoder_waits_for_whole_characters():
    letters = bpe.byte_letters()

    class V:
        byte_level, special = True, {"<e>": 9}
        tokens: dict

    V.tokens = {i: letters[b] for i, b in enumerate("é€".encode())} | {9: "<e>", 8: letters[0xFF]}
    d = bpe.Decoder(V())
    assert [d.feed([i]) for i in range(5)] == ["", "é", "", "", "€"]
    assert d.feed([2, 9]) == "\ufffd<e>" and d.feed([8]) == "\ufffd" and d.feed([2]) == "" and d.finish() == "\ufffd"


def test_histogram(spark):
    n = [0, 0, 1, 5, 5, 5, 300, 1000, None]
    df = spark.createDataFrame([(x,) for x in n], "n_tokens long")
    hist = lengths.histogram(df)
    plain = [x or 0 for x in n]
    got = {r.length: r for r in hist.collect()}
    assert set(got) == set(plain)
    for k, r in got.items():
        above = [x for x in plain if x >= k]
        assert (r.n_docs, r.n_tokens, r.docs_at_least, r.tokens_at_least) == (plain.count(k), k * plain.count(k), len(above), sum(above))
        assert r.truncated_tokens == sum(min(x, k) for x in plain) and r.quantile == sum(x <= k for x in plain) / len(plain)
    for r in lengths.totals(hist, [0, 1, 3, 5, 1000, 2000]).collect():
        assert (r.n_docs, r.n_tokens, r.longer, r.truncated_tokens) == (9, sum(plain), sum(x > r.context for x in plain), sum(min(x, r.context) for x in plain))
    assert {r.share: r.length for r in lengths.quantiles(hist, [0.1, 0.5, 1.0]).collect()} == {0.1: 0, 0.5: 5, 1.0: 1000}
    none = lengths.histogram(df.limit(0))
    assert none.count() == lengths.totals(none, [5]).count() == lengths.quantiles(none, [0.5]).count() == 0
