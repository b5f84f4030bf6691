"""Operator 8: language-model scores by deleted interpolation.

A text is its words in lower case (A-Z) and one end. Documents whose
crc32(doc_id as text) mod 7 is not HELD are learned from; the others are held
out. A token's probability given the one before (the end's, at the start) is

    l2(b) P2(w | h) + l1(b) c(w) / N + l0(b) / (V + 1)

with maximum-likelihood estimates P2 = n(h, w) / n(h) and c(w) / N, and weights
by the bucket b of the context's frequency, floor(log2 n(h)), contexts never
seen being a bucket without P2. Weights are learned by expectation-maximisation
on the held-out documents' pairs. Every token but the end has one after it, and
every start is one end, so n(h) = c(h).

All words and all pairs of words have exact counts of their own. Documents are
cut into blocks of about BLOCK tokens. A block sends each of its distinct words
and pairs once (64-bit hash and number of times learned) to the part of the hash
space that it lies in; a part adds up and answers every block with the corpus's
counts, in the block's order. So a word or pair, however frequent, is one entry
a block; parts grow in number with the corpus, and neither the driver nor a
broadcast holds counts.

Edge cases: a null or empty text is one token, the end; a null doc_id counts as
an empty one (it is learned from); without documents to learn from N and V are
0 and both scores are those of the uniform part; without held-out documents all
weights are equal (where a context was seen); repeated rows are scored alike and
counted as often as they occur; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.store import bounded_batches, drop, keep, pack, table, tidy, unpack
from tidewater.llm.words import _MULT, U, Words, _mix

FOLDS, HELD = 7, 2
#: Tokens of a block, and entries (about) of a part of the hash space.
BLOCK = 1 << 20
ROUNDS = 40
BUCKETS = 65
END = U(0x7A3D5C91E4B80F26)
#: Answers about the corpus, not a block.
ALL = -1


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=U(0))


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """origin, tokens, ids, held, sizes (tokens of each text), words (distinct hashes) and seq (places in words) of each block."""
    names = ["origin", "tokens", "ids", "held", "sizes", "words", "seq"]

    def made(ids, held, sizes, hashes):
        words, seq, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        often = np.argsort(-n, kind="stable")
        place = np.empty(len(often), np.int64)
        place[often] = np.arange(len(often))
        sizes = np.concatenate(sizes)
        row = [int.from_bytes(os.urandom(7), "little"), int(sizes.sum()), ids, held, pack(sizes), pack(words[often]), pack(place[seq])]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    def run(batches):
        ids, held, sizes, hashes, size = [], [], [], [], 0
        for batch in batches:
            w = Words(batch.column(2))
            n = w.counts() + 1
            h = np.full(int(n.sum()), END, U)
            own = np.ones(len(h), bool)
            own[np.cumsum(n) - 1] = False
            h[own] = w.hashes(lower=True)
            said, own = batch.column(1).to_pylist(), [held_out(x) for x in batch.column(0).to_pylist()]
            at = lo = 0
            # texts are whole: a block ends with the one that fills it
            for i, m in enumerate(n.tolist()):
                size += m
                if size >= block or i == len(n) - 1:
                    to = at + int(n[lo : i + 1].sum())
                    ids += said[lo : i + 1]
                    held += own[lo : i + 1]
                    sizes.append(n[lo : i + 1])
                    hashes.append(h[at:to])
                    at, lo = to, i + 1
                if size >= block:
                    yield made(ids, held, sizes, hashes)
                    ids, held, sizes, hashes, size = [], [], [], [], 0
        if ids:
            yield made(ids, held, sizes, hashes)

    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), "text")
    return rows.mapInArrow(tidy(run), "origin long, tokens long, ids array<long>, held array<boolean>, sizes binary, words binary, seq binary")


class Block:
    """A block's tokens, and its distinct words and pairs in the order of their hashes."""

    def __init__(self, row: dict):
        self.origin, self.ids = row["origin"], row["ids"]
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.held = np.array(row["held"], bool)
        words, seq = unpack(row["words"]), unpack(row["seq"]).astype(np.int64)
        end = int(np.flatnonzero(words == END)[0])
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[self.first] = end
        self.learned = np.repeat(~self.held, self.sizes)
        code, pair = np.unique(before * len(words) + seq, return_inverse=True)
        key = _mix(words[code // len(words)] * _MULT + words[code % len(words)])
        # token's word, context and pair, as places among the sorted keys
        self.words, place = self._sorted(words)
        self.word, self.before = place[seq], place[before]
        self.pairs, place = self._sorted(key)
        self.pair = place[pair]

    @staticmethod
    def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return key[order], place


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def asked(made: DataFrame, parts: int) -> DataFrame:
    """part, origin, keys and n (times learned) of each block's distinct words (parts from 0) and pairs (from parts on)."""

    def run(batches):
        for row in _read(batches):
            b = Block(row)
            for kind, (keys, at) in enumerate(((b.words, b.word), (b.pairs, b.pair))):
                n = np.bincount(at[b.learned], minlength=len(keys))
                part = ((keys >> U(32)) * U(parts)) >> U(32)
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
                for lo, hi in zip(edge, [*edge[1:], len(keys)], strict=True):
                    row = [kind * parts + int(part[lo]), b.origin, pack(_steps(keys[lo:hi])), pack(n[lo:hi])]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "origin", "keys", "n"])

    bounded_batches(made.sparkSession)
    return made.mapInArrow(tidy(run), "part long, origin long, keys binary, n binary")


def answers(questions: DataFrame, parts: int) -> DataFrame:
    """origin, part and n: times learned in all of the corpus, for each entry asked; under ALL, tokens and types of each part of words."""
    names = ["origin", "part", "n", "tokens", "types"]

    def told(part, found):
        keys = np.concatenate([np.cumsum(unpack(k), dtype=U) for _, k, _ in found])
        n = np.concatenate([unpack(c) for _, _, c in found]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        edge = np.concatenate([[True], keys[1:] != keys[:-1]])
        total = np.add.reduceat(n[order], np.flatnonzero(edge))
        every = np.empty(len(n), np.int64)
        every[order] = total[np.cumsum(edge) - 1]
        at, out = 0, []
        for origin, k, _ in found:
            size = int.from_bytes(k[:8], "little")
            out.append((origin, part, pack(every[at : at + size]), 0, 0))
            at += size
        if part < parts:
            out.append((ALL, part, b"", int(total.sum()), int((total > 0).sum())))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches):
        part, found = None, []
        for row in _read(batches):
            if row["part"] != part and found:
                yield told(part, found)
                found = []
            part = row["part"]
            found.append((row["origin"], row["keys"], row["n"]))
        if found:
            yield told(part, found)

    rows = questions.repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(tidy(run), "origin long, part long, n binary, tokens long, types long")


class Counted(Block):
    """A block with the corpus's counts: c, of context and pair for each token."""

    def __init__(self, row: dict, parts: int):
        super().__init__(row)
        said = sorted((x["part"], x["n"]) for x in row["said"])
        n = [np.concatenate([unpack(x) for p, x in said if (p >= parts) == kind]).astype(np.int64) for kind in (False, True)]
        self.c, self.h, self.n = n[0][self.word], n[0][self.before], n[1][self.pair]


def held_pairs(known: DataFrame, parts: int) -> DataFrame:
    """n, h, c (of pair, context and word) and times of all held-out tokens."""

    def run(batches):
        for row in _read(batches):
            b = Counted(row, parts)
            at = np.flatnonzero(~b.learned)
            _, one, times = np.unique(b.pair[at], return_index=True, return_counts=True)
            at = at[one]
            for lo in range(0, len(at), 1 << 16):
                x = at[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (b.n[x], b.h[x], b.c[x], times[lo : lo + (1 << 16)])], names=["n", "h", "c", "times"])

    bounded_batches(known.sparkSession)
    return known.mapInArrow(tidy(run), "n long, h long, c long, times long").groupBy("n", "h", "c").agg(F.sum("times").alias("times"))


def bucket(h: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2 n(h))."""
    return np.where(h > 0, np.frexp(h.astype(np.float64))[1], 0)


def parts_of(n, h, c, tokens: int, types: int) -> np.ndarray:
    """P2, P1 and P0 of tokens."""
    return np.stack([n / np.maximum(h, 1), c / max(tokens, 1), np.full(len(c), 1.0 / (types + 1))])


def learn(pairs: DataFrame, tokens: int, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (P2, P1, P0) of each bucket, by EM: a round is one sum by bucket over the held-out pairs."""
    # exact: n(h) is far below 2**53
    place = F.when(F.col("h") > 0, F.length(F.bin("h"))).otherwise(0)
    rows = keep(pairs.select(place.cast("int").alias("b"), (F.col("n") / F.greatest("h", F.lit(1))).alias("p2"), (F.col("c") / F.lit(float(max(tokens, 1)))).alias("p1"), F.col("times").cast("double").alias("times")), "lm-held")
    out = np.full((BUCKETS, 3), 1 / 3)
    p = [F.col("p2"), F.col("p1"), F.lit(1.0 / (types + 1))]
    for _ in range(rounds):
        share = [F.get(F.lit(out[:, i].tolist()), F.col("b")) * p[i] for i in range(3)]
        each = F.col("times") / (share[0] + share[1] + share[2])
        found = rows.groupBy("b").agg(*(F.sum(each * s).alias(f"s{i}") for i, s in enumerate(share))).collect()
        if not found:
            break
        total = np.zeros((BUCKETS, 3))
        for r in found:
            total[r.b] = r.s0, r.s1, r.s2
        every = total.sum(0)
        # buckets without held-out tokens take what all together say
        seen = total.sum(1) > 0
        last, out = out, np.where(seen[:, None], total / np.maximum(total.sum(1), 1e-300)[:, None], every / every.sum())
        if np.abs(out - last).max() < 1e-9:
            break
    drop(rows)
    # without P2 the other two make up the whole
    out[0, 0] = 0
    out[0] = out[0] / out[0].sum() if out[0].sum() > 0 else (0, 0.5, 0.5)
    return out


def scores(known: DataFrame, parts: int, weights: np.ndarray, tokens: int, types: int) -> DataFrame:
    """The result's rows, block by block."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for row in _read(batches):
            b = Counted(row, parts)
            p = (weights[bucket(b.h)].T * parts_of(b.n, b.h, b.c, tokens, types)).sum(0)
            sums = [np.add.reduceat(v, b.first) for v in ((b.c > 0).astype(np.int64), np.log10((b.c + 1.0) / (tokens + types + 1)), np.log10(p))]
            yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.sizes), pa.array(sums[0]), pa.array(np.full(len(b.ids), tokens)), pa.array(sums[1]), pa.array(sums[2])], names=names)

    bounded_batches(known.sparkSession)
    return known.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    made = keep(blocks(docs, block), "lm-blocks")
    size = made.agg(F.sum("tokens").alias("n")).first().n or 0
    parts = -(-size // block) or 1
    said = keep(answers(asked(made, parts), parts), "lm-answers")
    total = said.filter(F.col("origin") == ALL).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    by_block = said.filter(F.col("origin") != ALL).groupBy("origin").agg(F.collect_list(F.struct("part", "n")).alias("said"))
    known = keep(made.join(by_block, "origin"), "lm-known")
    drop(made, said)
    weights = learn(held_pairs(known, parts), total.tokens, total.types)
    return scores(known, parts, weights, total.tokens, total.types)


def op8_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
