"""Operator 7: BPE encoding and decoding as streaming transducers.

Encoding. A merge list has a *sufficient lookahead*: a number of symbols such
that a token boundary lying that far before the end of what has been read stays
where it is, whatever follows. A boundary can only be moved by a merge that
reaches across it, that merge only by one of higher priority that overlaps it,
and so on, so the farthest influence is the longest chain of overlapping merges
of rising priority; `sufficient_lookahead` computes it from the merge list by
one pass in priority order. That bound holds for all texts and is far; how far
it is in the text at hand the transducer sees by itself: every place knows the
one token that ends there, and what the places from which a next token can
begin have in common is stable and given out (`Transducer`). So it holds the
lookahead at most, and mostly a few tokens, however long a piece is. Every piece
of every text goes through it; words seen before are answered from a table of
bounded size.

Decoding. `Decoder` takes ids one at a time. Without a byte-level decoder in
the vocabulary file the text is the tokens joined by single spaces; with one,
token characters become bytes and a UTF-8 automaton gives a character out when
its last byte arrives and U+FFFD for each ill-formed part.

Results for edge cases: null and empty texts give no ids and an empty decoded
text; strings of special tokens in a text give their ids, as in the library;
repeated rows give repeated results; extra columns are kept by `encode`.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.store import KEPT, bounded_batches, table, tidy

#: Words kept with their ids, and pairs of tokens kept with whether they hold, at most; tables are emptied when full.
PIECES, PAIRS = 1 << 18, 1 << 18
#: Longer words are streamed and not kept.
KEPT_LENGTH = 64
#: Characters of a text that are normalised and cut into pieces at a time, at least.
SEGMENT = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length=len) -> int:
    """Symbols after a boundary that can still move it; see the module's text.

    reach(r) is the farthest that what follows can act on merge r: the largest
    over merges s of higher priority whose string begins with a proper suffix of
    r's of what s adds beyond that suffix plus reach(s). best holds that largest
    value for each prefix met so far.
    """
    best: dict[str, int] = {}
    most = longest = 0
    for left, right in merges:
        whole = left + right
        n = len(whole)
        reach = max((best.get(whole[i:], 0) for i in range(1, n)), default=0)
        for i in range(1, n):
            if best.get(whole[:i], 0) < n - i + reach:
                best[whole[:i]] = n - i + reach
        most, longest = max(most, reach), max(longest, n)
    return most + longest


class Vocabulary:
    """What a tokenizer file says, and the tables derived from it."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.decimals = [str(i) for i in range(1 + max([*self.ids.values(), *self.special.values()]))]
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        # (left id, right id) -> (rank, merged id), by ids packed in one int
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            if a in self.ids and b in self.ids and a + b in self.ids:
                self.pairs.setdefault(self.ids[a] << 32 | self.ids[b], (rank, self.ids[a + b]))
        self.merges = merges
        letters = byte_letters()
        first = [self.ids.get(x) for x in letters]
        last = [self.ids.get(x + self.suffix) for x in letters]
        #: Bytes without a symbol, which are left out.
        self.silent = bytes(b for b in range(256) if first[b] is None or last[b] is None)
        # tokens that merges make, by their bytes: those inside a piece, and those at its end
        value = {x: i for i, x in enumerate(letters)}
        self.inner: dict[bytes, int] = {bytes([b]): t for b, t in enumerate(first) if t is not None}
        self.final: dict[bytes, int] = {bytes([b]): t for b, t in enumerate(last) if t is not None}
        for _, t in self.pairs.values():
            token = self.tokens[t]
            ends = bool(self.suffix) and token.endswith(self.suffix)
            raw = bytes(value[c] for c in (token[: -len(self.suffix)] if ends else token))
            if ends or not self.suffix:
                self.final[raw] = t
            if not ends:
                self.inner[raw] = t
        self.length = {t: len(raw) for some in (self.inner, self.final) for raw, t in some.items()}
        self.longest = max(self.length.values())
        #: Length of the longest token that ends with two bytes.
        self.upto: dict[bytes, int] = defaultdict(lambda: 1)
        for raw in chain(self.inner, self.final):
            self.upto[raw[-2:]] = max(len(raw), self.upto[raw[-2:]])
        self.joints = Joints(self.pairs, len(self.decimals), PAIRS)
        parts = spec.get("normalizer") or {}
        parts = parts.get("normalizers", [parts] if parts else [])
        kinds = [p["type"] for p in parts]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        cuts = spec.get("pre_tokenizer") or {}
        cuts = cuts.get("pretokenizers", [cuts] if cuts else [])
        pattern = next(p["pattern"]["Regex"] for p in cuts if p["type"] == "Split")
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def lookahead(self) -> int:
        """The merge list's sufficient lookahead; the suffix is part of a piece's last symbol and counts as none of its own."""
        return sufficient_lookahead([(a, b.removesuffix(self.suffix) if self.suffix else b) for a, b in self.merges])


class Joints:
    """Which tokens may stand next to each other.

    A sequence of tokens is the BPE of its text just if each two neighbours are
    that of theirs. The boundary of two tokens holds if, while their parts were
    merged, no merge was due that reaches across it. Parts at the boundary, each
    with the ranks at which it came to be and was merged on, are looked at from
    the latest back.
    """

    def __init__(self, merges: dict[int, tuple[int, int]], tokens: int, known: int):
        """merges: pair of ids (packed in one int) to rank and merged id."""
        self.merges, self.limit = merges, known
        self.rank = [-1] * tokens
        self.left, self.right = list(range(tokens)), list(range(tokens))
        for pair, (rank, new) in merges.items():
            if self.rank[new] >= 0:
                raise ValueError(f"token {new} has two merges")
            self.rank[new], self.left[new], self.right[new] = rank, pair >> 32, pair & 0xFFFFFFFF
        self.held: dict[int, bool] = {}
        self.made: dict[int, bool] = {}

    def _holds(self, x: int, y: int, end: float) -> bool:
        """Whether no merge across x | y is due before rank end."""
        rank, merges = self.rank, self.merges
        x_goes = y_goes = end
        while True:
            due = merges.get(x << 32 | y)
            # of merges of one rank the leftmost comes first
            if due is not None and due[0] < x_goes and due[0] <= y_goes and due[0] < end:
                return False
            if rank[x] > rank[y]:
                x_goes, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                y_goes, y = rank[y], self.left[y]
            else:
                return True

    def whole(self, t: int) -> bool:
        """Whether the BPE of a token's text is that token."""
        found = self.made.get(t)
        if found is None:
            a, b, r = self.left[t], self.right[t], self.rank[t]
            found = self.made[t] = r < 0 or (self.whole(a) and self.whole(b) and self._holds(a, b, r))
        return found

    def hold(self, x: int, y: int) -> bool:
        """Whether the BPE of x's and y's text is these two."""
        key = x << 32 | y
        found = self.held.get(key)
        if found is None:
            if len(self.held) >= self.limit:
                self.held.clear()
            found = self.held[key] = self.whole(y) and self._holds(x, y, float("inf"))
        return found


class Transducer:
    """BPE of one piece: feed() takes bytes and gives the tokens that have become stable, finish() the rest.

    Each place read so far has one last token of what stands before it: the one
    ending there that may follow the last token before its own beginning; it is
    looked for where it is asked for. The next token begins at one of the last
    `longest` places; a boundary that all of these lead back to stays, whatever
    follows. The merge list's sufficient lookahead bounds how far back that is,
    and so what is held.
    """

    __slots__ = ("last", "most", "raw", "v")

    def __init__(self, v: Vocabulary):
        self.v = v
        #: Bytes from the last boundary given out on, the last token before each of their places (if known), and the most bytes held.
        self.raw, self.last, self.most = b"", [None], 0

    def _token(self, end: int, tokens: dict[bytes, int]) -> int:
        """The last token before a place, of those in tokens."""
        raw, last, joints = self.raw, self.last, self.v.joints
        get, held = tokens.get, joints.held.get
        longest = self.v.upto[raw[end - 2 : end]] if end > 1 else 1
        for at in range(end - longest if end > longest else 0, end):
            t = get(raw[at:end])
            if t is None:
                continue
            before = last[at]
            if before is None:
                if not at:
                    if joints.whole(t):
                        break
                    continue
                before = self._token(at, self.v.inner)
            if (found := held(before << 32 | t)) or (found is None and joints.hold(before, t)):
                break
        else:
            raise ValueError(f"no token ends with {raw[end - 1 : end]!r}")
        last[end] = t
        return t

    def _tokens(self, end: int) -> list[int]:
        """Tokens from the last boundary to end."""
        last, length, out = self.last, self.v.length, []
        while end:
            t = last[end]
            out.append(t)
            end -= length[t]
        out.reverse()
        return out

    def _stable(self) -> int:
        """The farthest place that all from which the next token may begin lead back to."""
        n, inner, length = len(self.raw), self.v.inner, self.v.length
        live = set(range(max(0, n + 1 - self.v.longest), n + 1))
        while len(live) > 1:
            at = max(live)
            live.remove(at)
            t = self.last[at]
            live.add(at - length[self._token(at, inner) if t is None else t])
        at = live.pop()
        if at and self.last[at] is None:
            self._token(at, inner)
        return at

    def _held(self, some: bytes) -> None:
        self.raw += some
        self.last += [None] * len(some)
        self.most = max(self.most, len(self.raw))

    def feed(self, some: bytes) -> list[int]:
        """some: bytes that are not the piece's last."""
        out: list[int] = []
        step = 4 * self.v.longest
        for lo in range(0, len(some), step):
            self._held(some[lo : lo + step])
            if len(self.raw) >= step and (at := self._stable()):
                out += self._tokens(at)
                self.raw, self.last = self.raw[at:], self.last[at:]
        return out

    def finish(self, some: bytes) -> list[int]:
        """some: the bytes left, of which the last is the piece's last."""
        if not some:
            return []
        out = []
        if len(some) > self.v.longest:
            out, some = self.feed(some[:-1]), some[-1:]
        self.raw += some
        self.last += [None] * len(some)
        n = len(self.raw)
        if n > self.most:
            self.most = n
        self._token(n, self.v.final)
        return out + self._tokens(n) if out else self._tokens(n)

    def reset(self) -> None:
        """Ready for the next piece."""
        self.raw, self.last = b"", [None]


class Encoder:
    """Texts to ids: every piece by a transducer, words already seen from a table of bounded size."""

    def __init__(self, vocabulary: Vocabulary, pieces: int = PIECES):
        self.v, self.limit = vocabulary, pieces
        #: What pieces go through, one after the other, and how many did.
        self.transducer, self.streamed = Transducer(vocabulary), 0
        before: dict[str, tuple[int, ...]] = {}
        once: set[int] = set()

        class Table(dict):
            """Half of the table; when it is full it takes the place of the other half, from which words in use come back.

            Words are kept when they are met for the second time: most words are met once.
            """

            def __missing__(table, word: str) -> tuple[int, ...]:
                nonlocal before
                out = before.get(word)
                if out is None:
                    out = tuple(chain.from_iterable(map(self.stream, [word] if word.isalpha() else vocabulary.cut.findall(word))))
                    if (key := hash(word)) not in once:
                        if len(once) >= self.limit:
                            once.clear()
                        once.add(key)
                        return out
                if len(word) <= KEPT_LENGTH:
                    if 2 * len(table) >= self.limit:
                        before = dict(table)
                        table.clear()
                    table[word] = out
                return out

        #: Ids of words between white space; a piece never crosses white space.
        self.table = Table()

    def stream(self, piece: str) -> list[int]:
        """Ids of one piece."""
        self.streamed += 1
        raw = piece.encode()
        if self.v.silent:
            raw = raw.translate(None, self.v.silent)
        out = self.transducer.finish(raw)
        self.transducer.reset()
        return out

    def normal(self, text: str) -> str:
        if not text.isascii():
            if self.v.nfc:
                text = unicodedata.normalize("NFC", text)
            if self.v.lower:
                # lower() alone has a rule for a final sigma, the library's has none
                text = text.replace("Σ", "σ")
        return text.lower() if self.v.lower else text

    def words(self, text: str) -> list[str]:
        text = self.normal(text)
        # str.split() also cuts at these four, which are no white space to the library
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self.v.cut.findall(text)
        return text.split()

    def plain(self, text: str) -> Iterator[list[int]]:
        """Ids of text without special tokens, segment by segment; cut only at white space."""
        at, n = 0, len(text)
        while at < n:
            to = at + SEGMENT
            while to < n and text[to] not in " \n\t\r":
                to += 1
            yield list(chain.from_iterable(map(self.table.__getitem__, self.words(text[at:to]))))
            at = to

    def segments(self, text: str | None) -> Iterator[list[int]]:
        at = 0
        if text and self.v.marks and "<" in text:
            for m in self.v.marks.finditer(text):
                yield from self.plain(text[at : m.start()])
                yield [self.v.special[m[0]]]
                at = m.end()
        yield from self.plain(text[at:] if at else text or "")

    def encode(self, text: str | None) -> list[int]:
        return [x for part in self.segments(text) for x in part]

    def count(self, text: str | None) -> int:
        return sum(map(len, self.segments(text)))


class Decoder:
    """Ids to text, bit by bit: feed() gives what has become certain, finish() the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        if vocabulary.byte_level:
            self.bytes = {c: b for b, c in enumerate(byte_letters())}
            self.marks = frozenset(vocabulary.special.values())
        self.reset()

    def reset(self) -> None:
        self.started = False
        if self.v.byte_level:
            self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if not self.v.byte_level:
            out = " ".join(map(self.v.tokens.__getitem__, ids))
            if self.started and ids:
                out = " " + out
            self.started |= bool(ids)
            return out
        out = []
        for i in ids:
            token = self.v.tokens[i]
            if i in self.marks:
                out += [self.utf8.decode(b"", True), token]
                self.utf8.reset()
            else:
                out.append(self.utf8.decode(bytes(self.bytes[c] for c in token)))
        return "".join(out)

    def finish(self) -> str:
        out = self.utf8.decode(b"", True) if self.v.byte_level else ""
        self.reset()
        return out


_ENCODERS: dict[bytes, Encoder] = {}
KEPT["bpe"] = _ENCODERS.clear


def encoder(source: bytes) -> Encoder:
    """One encoder a worker and vocabulary; workers are used again."""
    key = hashlib.sha256(source).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary(source))
    return _ENCODERS[key]


def read_vocabulary(path: str | None = None) -> bytes:
    """The file's bytes, read on the driver (a fixed size of some MB) and sent with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def _with_columns(docs: DataFrame, text: str, make, added: list[T.StructField], source: bytes) -> DataFrame:
    """docs with columns that make(encoder, text) gives; columns of the same names give way."""
    names = {f.name for f in added}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    carried = text in base.columns
    if not carried:
        base = base.withColumn(text, docs[text])
    sent = docs.sparkSession.sparkContext.broadcast(source)
    schema = T.StructType([*base.schema.fields, *added])
    kinds = {f.name: k for f, k in zip(added, _arrow(added), strict=True)}

    def run(batches):
        enc = encoder(sent.value)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made = [make(enc, x) for x in values]
            new = [pa.array([m[i] for m in made], kinds[f.name]) for i, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in added)])

    bounded_batches(docs.sparkSession)
    return base.mapInArrow(tidy(run, "bpe"), schema)


def _arrow(fields: list[T.StructField]) -> list[pa.DataType]:
    known = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return [known[f.dataType.simpleString()] for f in fields]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """docs with the column ids: array<int>, the whole text encoded (null: empty array)."""
    field = T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)
    return _with_columns(docs, text, lambda e, x: (e.encode(x),), [field], read_vocabulary(path))


def count(docs: DataFrame, text: str = "text", path: str | None = None, n: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text (null: 0)."""
    return _with_columns(docs, text, lambda e, x: (e.count(x),), [T.StructField(n, T.LongType(), False)], read_vocabulary(path))


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """docs with the decoded text of ids (null ids: empty)."""

    def make(e: Encoder, x):
        d = Decoder(e.v)
        return (d.feed(x or []) + d.finish(),)

    return _with_columns(docs, ids, make, [T.StructField(text, T.StringType(), False)], read_vocabulary(path))


def _round_trip(e: Encoder, text: str | None) -> tuple[int, str, str]:
    coded, decoded, n, d = hashlib.sha256(), hashlib.sha256(), 0, Decoder(e.v)
    for part in e.segments(text):
        if part:
            coded.update(((" " if n else "") + " ".join(map(e.v.decimals.__getitem__, part))).encode())
            decoded.update(d.feed(part).encode())
            n += len(part)
    decoded.update(d.finish().encode())
    return n, coded.hexdigest(), decoded.hexdigest()


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, streamed: no text's ids are held whole."""
    added = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]
    return _with_columns(docs, text, _round_trip, added, read_vocabulary(path))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_tokens and the digests of its ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
