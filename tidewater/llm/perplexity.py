"""Operator 4: quality rules, with bands of n-gram perplexity by language.

Base rules look at words alone (`BASE`). The others are judged by a modified
Kneser-Ney model over the text's code points (ORDER of them a gram, ORDER - 1
blanks before a text), one for each language and half of the texts: a text's
digest says in which half it is, and it is scored by the model of the *other*
half, so neither its own grams nor those of its copies make it look likely.

Spark counts the grams of all texts (sums within a task come before the
shuffle), exactly: a gram is two numbers, of its last three code points and of those before. From
there on the model is joins and sums over distinct grams: lower orders are
continuation counts (distinct grams with that ending), the three discounts of
each order come from its counts of counts (Chen and Goodman), a context's total
and numbers of continuations give what it leaves to the order below, and order 0
is uniform over all code points. `likelihoods` gives the log probability of
every gram that some text has.

These are kept in sorted hash arrays: 64-bit hashes of grams, and beside them
the log probabilities, searched by bisection. Up to SENT grams the arrays go to
every task. Beyond that they are cut by ranges of the hash; blocks of texts send
each of their distinct grams to the range it is in and get its log probability
back, so no task and no broadcast holds more than a part. Both give the same
numbers.

A document is rejected if its perplexity leaves its language's band: of log
perplexity, SPREAD interquartile ranges below the first quartile to as many above
the third. Quartiles are read off histograms over all documents that pass the
base rules, in bins of BIN. A language with fewer than LEAST_DOCS such documents
has no quartiles to speak of, and its band is open.

Edge cases: a null or empty text has no words, fails the base rules and is not
kept; null languages are one language; a text whose half is its language's only
one is scored by order 0 alone; repeated rows are judged alike; long texts are
read in slices; an empty table gives no rows; columns of the input with the names
added here give way.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.store import bounded_batches, drop, give_back, keep, others, pack, table, tidy, unpack, unused
from tidewater.llm.words import _MULT, SPACE, U, Words, _mix, grams

ORDER, POINT = 4, 21
#: Code points there are: what order 0 is uniform over.
POINTS = 0x110000
#: Code points that are read at a time.
SLICE = 1 << 19
#: Grams that a task sums up before it sends them on, grams of arrays that go to every task, grams in a part, and code points in a block.
FLUSH, SENT, PART, BLOCK = 1 << 19, 1 << 21, 1 << 20, 1 << 20
LEAST_WORDS = 50
MOST_REPEATED = 50
#: A band reaches this many interquartile ranges below the first and above the third quartile.
SPREAD = 4.0
LEAST_WIDTH = 0.02
BIN = 0.005
LEAST_DOCS = 20

#: Counted by the contract.
MARKS = b"#*$%&|<>"


def model_of(lang: Column) -> Column:
    """The name of a language's model."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def half(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 40 & 1


def slices(texts: list[str]):
    """Of texts, SLICE code points or so at a time: which text each gram is of, and the two numbers of each (the first ORDER - 3 code points, the last 3)."""
    lead = " " * (ORDER - 1)

    def coded(parts, owners):
        cp = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(U)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        inside = np.ones(len(cp), bool)
        first = np.cumsum(size) - size
        for i in range(ORDER - 1):
            inside[first + i] = False
        at = np.flatnonzero(inside)
        high, low = (np.zeros(len(at), U) for _ in range(2))
        for i in range(ORDER - 1, 2, -1):
            high = (high << U(POINT)) | cp[at - i]
        for i in (2, 1, 0):
            low = (low << U(POINT)) | cp[at - i]
        return np.repeat(np.array(owners, np.int64), size - (ORDER - 1)), high, low

    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, len(text), SLICE):
            part = lead + text[:SLICE] if not lo else text[lo - ORDER + 1 : lo + SLICE]
            parts.append(part)
            owners.append(i)
            held += len(part)
            if held >= SLICE:
                yield coded(parts, owners)
                parts, owners, held = [], [], 0
    if parts:
        yield coded(parts, owners)


def hashed(high: np.ndarray, low: np.ndarray, seed) -> np.ndarray:
    """Hashes of grams; seed (of each, or of all) tells models apart."""
    return _mix(_mix(high * _MULT + low) ^ seed)


def seed_of(model: str, fold: int) -> int:
    return xxhash.xxh3_64_intdigest(model.encode(), fold)


def tally(high: np.ndarray, low: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams and how often each occurs. (If hashes collide, a gram may come in parts.)"""
    order = np.argsort(hashed(high, low, U(0)))
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    edge = np.flatnonzero(new)
    n = np.diff(np.append(edge, len(high))) if n is None else np.add.reduceat(n[order], edge) if len(edge) else n
    return high[edge], low[edge], n


def base(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = Words(texts)
    summed = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
    marks = np.zeros(256, bool)
    marks[list(MARKS)] = True
    out = {
        "n_words": w.counts().astype(np.int64),
        "word_chars": summed(~SPACE[w.data] & ((w.data & 0xC0) != 0x80)),
        "n_symbols": summed(marks[w.data]),
    }
    dup = np.zeros(len(w), np.int64)
    raw = w.data.tobytes()
    for i in range(len(w)):
        lines = [x for x in raw[w.offsets[i] : w.offsets[i + 1]].split(b"\n") if x and x.strip()]
        dup[i] = len(lines) - len(set(lines)) if len(lines) > 1 else 0
    out["n_dup_lines"] = dup
    text_of = np.repeat(np.arange(len(w)), w.counts())
    g = grams(w.hashes(), 3)
    covered = np.zeros(len(text_of), bool)
    if len(g):
        key = g + text_of[: len(g)].astype(U) * U(0x9FB21C651E98DF25)
        inside = np.flatnonzero(text_of[: len(g)] == text_of[2:])
        order = inside[np.argsort(key[inside])]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = order[twice]
        for i in range(3):
            covered[at + i] = True
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(covered)])[w.first])
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """model, fold, high, low, n: how often each gram occurs in texts of each half."""
    names = ["model", "fold", "high", "low", "n"]

    def rows(held):
        for (model, fold), parts in held.items():
            high, low, n = tally(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for lo in range(0, len(n), 1 << 16):
                at = slice(lo, lo + (1 << 16))
                m = len(n[at])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(model), m), pa.repeat(pa.scalar(fold, pa.int32()), m), pa.array(high[at].view(np.int64)), pa.array(low[at].view(np.int64)), pa.array(n[at])], names=names)

    def run(batches):
        held: dict[tuple[str, int], list] = {}
        size = 0
        for batch in batches:
            by: dict[tuple[str, int], list[str]] = {}
            for x, model in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if x:
                    by.setdefault((model, half(x)), []).append(x)
            for key, texts in by.items():
                parts = held.setdefault(key, [])
                for _, high, low in slices(texts):
                    parts.append(tally(high, low))
                    size += len(parts[-1][2])
            if size > FLUSH:
                held = {key: [tally(*(np.concatenate(x) for x in zip(*parts, strict=True)))] for key, parts in held.items()}
                size = sum(len(n) for ((_, _, n),) in held.values())
            if size > FLUSH // 2:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)

    bounded_batches(docs.sparkSession)
    part = docs.select(F.col(f"`{text}`"), model_of(F.col(f"`{lang}`"))).mapInArrow(tidy(run), "model string, fold int, high long, low long, n long")
    return part.groupBy("model", "fold", "high", "low").agg(F.sum("n").alias("n"))


def _ending(k: int) -> list[Column]:
    """The last k code points of a gram (high, low)."""
    high = F.col("high").bitwiseAND(F.lit((1 << POINT * (k - 3)) - 1)) if k > 3 else F.lit(0).cast("long")
    return [high.alias("high"), F.col("low").bitwiseAND(F.lit((1 << POINT * min(k, 3)) - 1)).alias("low")]


def _context(high: str = "high", low: str = "low") -> list[Column]:
    """A gram without its last code point."""
    over = F.shiftleft(F.col(high).bitwiseAND(F.lit((1 << POINT) - 1)), 2 * POINT)
    return [F.shiftright(F.col(high), POINT).alias("before_high"), F.shiftright(F.col(low), POINT).bitwiseOR(over).alias("before_low")]


def discounts(level: DataFrame) -> DataFrame:
    """model, fold, d1, d2, d3 of counts c: Chen and Goodman's estimates, within bounds; plain values where counts of counts are missing."""
    of = level.groupBy("model", "fold").agg(*(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    there = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    d = [F.when(there, F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(plain).alias(f"d{i}") for i, plain in ((1, 0.5), (2, 0.75), (3, 0.9))]
    return of.select("model", "fold", *d)


def likelihoods(counts: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """model, fold, high, low, logp: for each gram of texts of a half, its log probability by the model of the other half. held gets what was kept on the way."""
    held = [] if held is None else held
    key = ["model", "fold", "high", "low"]
    counts = counts.withColumnRenamed("n", "c")
    level = counts.select(*key, "c")
    # fold names the model here, not the texts
    asked = counts.select("model", (1 - F.col("fold")).alias("fold"), "high", "low")
    levels, wanted = {ORDER: level}, {ORDER: asked}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = keep(levels[k + 1].groupBy("model", "fold", *_ending(k)).agg(F.count("*").alias("c")), f"perplexity-level-{k}")
        wanted[k] = keep(wanted[k + 1].select("model", "fold", *_ending(k)).distinct(), f"perplexity-asked-{k}")
        held += [levels[k], wanted[k]]
    below = None
    for k in range(1, ORDER + 1):
        d = discounts(levels[k])
        of = levels[k].select("model", "fold", *_context(), "c").groupBy("model", "fold", "before_high", "before_low")
        of = of.agg(F.sum("c").alias("total"), *(F.sum((F.col("c") == i if i < 3 else F.col("c") >= 3).cast("long")).alias(f"t{i}") for i in (1, 2, 3)))
        of = of.join(d, ["model", "fold"])
        free = (F.col("d1") * F.col("t1") + F.col("d2") * F.col("t2") + F.col("d3") * F.col("t3")) / F.col("total")
        of = of.select("model", "fold", "before_high", "before_low", "total", free.alias("free"), "d1", "d2", "d3")
        rows = wanted[k].select(*key, *_context()).join(levels[k], key, "left").join(of, ["model", "fold", "before_high", "before_low"], "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / POINTS))
        else:
            end = [c.alias(n) for c, n in zip(_ending(k - 1), ("end_high", "end_low"), strict=True)]
            rows = rows.select("*", *end).join(below.select("model", "fold", F.col("high").alias("end_high"), F.col("low").alias("end_low"), F.col("p").alias("lower")), ["model", "fold", "end_high", "end_low"])
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.when(F.col("c").isNotNull(), (F.col("c") - off) / F.col("total")).otherwise(0.0)
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(own + F.col("free") * F.col("lower"))
        below = rows.select(*key, p.alias("p"))
        if k < ORDER:
            below = keep(below, f"perplexity-order-{k}")
            held.append(below)
    return below.select("model", (1 - F.col("fold")).alias("fold"), "high", "low", F.log("p").cast("float").alias("logp"))


def arrays(found: DataFrame, parts: int = 1) -> DataFrame:
    """part, kind (0), origin (0), keys and values: the grams of found (likelihoods) as hashes and log probabilities, some at a time, by range of the hash."""

    def run(batches):
        held, size = [], 0

        def out():
            key, value = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            key, value = key[order], value[order].astype(np.float32)
            for part, at in _by_part(key, parts):
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([0], pa.int32()), pa.array([0]), pa.array([pack(_steps(key[at]))]), pa.array([value[at].tobytes()])], names=["part", "kind", "origin", "keys", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            model, fold = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            known = {x: U(seed_of(*x)) for x in set(zip(model, fold, strict=True))}
            seed = np.array([known[x] for x in zip(model, fold, strict=True)], U)
            high, low = (batch.column(i).to_numpy(zero_copy_only=False).view(U) for i in (2, 3))
            held.append((hashed(high, low, seed), batch.column(4).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size >= FLUSH:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return found.mapInArrow(tidy(run), PACKED)


PACKED = "part long, kind int, origin long, keys binary, data binary"


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=U(0))


def _by_part(keys: np.ndarray, parts: int):
    """Parts of the hash space, and where in sorted keys each lies."""
    part = ((keys >> U(32)) * U(parts)) >> U(32)
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(keys) else []
    for lo, hi in zip(edge, [*edge[1:], len(keys)], strict=True):
        yield int(part[lo]), slice(lo, hi)


class Arrays:
    """Sorted hashes of grams and their log probabilities."""

    def __init__(self, pieces):
        """pieces: (keys, data) as arrays() gives them."""
        keys = [np.cumsum(unpack(k), dtype=U) for k, _ in pieces]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, U)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        values = [np.frombuffer(d, np.float32) for _, d in pieces]
        self.values = (np.concatenate(values) if values else np.zeros(0, np.float32))[order]

    def log(self, keys: np.ndarray) -> np.ndarray:
        """ln p of grams, all of which are there."""
        return self.values[np.searchsorted(self.keys, keys)]


def summed(texts: list[str], models: list[str], look) -> np.ndarray:
    """Log perplexity of each text (nan if empty), by look(sorted keys) -> ln p."""
    total, size = np.zeros(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
    seeds = np.array([seed_of(m, half(x)) for m, x in zip(models, texts, strict=True)], U)
    for owner, high, low in slices(texts):
        key = hashed(high, low, seeds[owner])
        order = np.argsort(key)
        total += np.bincount(owner[order], look(key[order]).astype(np.float64), len(texts))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 0, -total / np.maximum(size, 1), np.nan)


def score(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with BASE, base_failed, _model (the language judged by) and log_perplexity (null without code points)."""
    counts = keep(counted(docs, text, lang), "perplexity-counts")
    held = [counts]
    found = keep(likelihoods(counts, held), "perplexity-grams")
    drop(*held)
    give_back(docs.sparkSession)
    n = found.count()
    if n > SENT:
        return _scored_in_parts(docs, found, -(-n // PART), text, lang)
    packed = arrays(found).select("keys", "data").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(Arrays(list(zip(packed.column(0).to_pylist(), packed.column(1).to_pylist(), strict=True))))
    return _based(docs, text, lang, lambda texts, models: summed(texts, models, sent.value.log))


def _based(docs: DataFrame, text: str, lang: str, value=None) -> DataFrame:
    """docs with BASE, base_failed and _model, and log_perplexity by value(texts, models), if given."""
    added = [*BASE, "base_failed", "_model", *(["log_perplexity"] if value else [])]
    own = others(docs, [*BASE, "base_failed", "_model", "log_perplexity"])
    schema = T.StructType([*own.schema.fields, *(T.StructField(c, T.LongType(), False) for c in BASE), T.StructField("base_failed", T.BooleanType(), False), T.StructField("_model", T.StringType(), False), *([T.StructField("log_perplexity", T.DoubleType(), True)] if value else [])])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            b = base(column)
            failed = (b["n_words"] < LEAST_WORDS) | (100 * b["n_repeat_words"] > MOST_REPEATED * b["n_words"])
            models = ["" if x is None else "=" + x for x in batch.column(batch.schema.get_field_index(lang)).to_pylist()]
            new = [*(pa.array(b[c], pa.int64()) for c in BASE), pa.array(failed), pa.array(models, pa.string())]
            if value:
                found = value([x or "" for x in column.to_pylist()], models)
                new.append(pa.array(found, mask=np.isnan(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])

    bounded_batches(docs.sparkSession)
    return own.mapInArrow(tidy(run), schema)


def _prints(text: Column, lang: Column) -> list[Column]:
    """128 bits that name a text and its language."""
    return [F.xxhash64(F.lit(i), model_of(lang), text) for i in (1, 2)]


def _scored_in_parts(docs: DataFrame, found: DataFrame, parts: int, text: str, lang: str) -> DataFrame:
    """score, where found has more grams than a task should hold: blocks of texts ask parts of the arrays."""
    print_ = _prints(F.col(f"`{text}`"), F.col(f"`{lang}`"))
    texts = docs.filter(F.length(f"`{text}`") > 0).select(print_[0].alias("a"), print_[1].alias("b"), model_of(F.col(f"`{lang}`")).alias("model"), F.col(f"`{text}`").alias("text"))
    shape = "origin long, a array<long>, b array<long>, models array<string>, texts array<string>"

    def gathered(batches):
        rows, size = [], 0

        def out():
            a, b, models, texts = (list(x) for x in zip(*rows, strict=True))
            lists = [pa.array([x], pa.list_(t)) for x, t in ((a, pa.int64()), (b, pa.int64()), (models, pa.string()), (texts, pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(os.urandom(7), "little")]), *lists], names=["origin", "a", "b", "models", "texts"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[3])
                if size >= BLOCK:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    def keys_of(models, texts):
        seeds = np.array([seed_of(m, half(x)) for m, x in zip(models, texts, strict=True)], U)
        return np.unique(np.concatenate([np.unique(hashed(high, low, seeds[owner])) for owner, high, low in slices(texts)]))

    def asking(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = keys_of(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                for part, at in _by_part(keys, parts):
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([1], pa.int32()), batch.column(0).slice(i, 1), pa.array([pack(_steps(keys[at]))]), pa.array([None], pa.binary())], names=["part", "kind", "origin", "keys", "data"])

    def answering(batches):
        part, pieces, known = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["part"] != part:
                    part, pieces, known = row["part"], [], None
                if row["kind"] == 0:
                    pieces.append((row["keys"], row["data"]))
                    continue
                known = known or Arrays(pieces)
                value = known.log(np.cumsum(unpack(row["keys"]), dtype=U))
                yield pa.RecordBatch.from_arrays([pa.array([row["origin"]]), pa.array([part]), pa.array([value.tobytes()])], names=["origin", "part", "data"])

    def adding(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys = keys_of(row["models"], row["texts"])
                values = np.concatenate([np.frombuffer(x["data"], np.float32) for x in sorted(row["said"], key=lambda x: x["part"])])
                value = summed(row["texts"], row["models"], lambda k, keys=keys, values=values: values[np.searchsorted(keys, k)])
                yield pa.RecordBatch.from_arrays([pa.array(row["a"]), pa.array(row["b"]), pa.array(value)], names=["a", "b", "log_perplexity"])

    bounded_batches(docs.sparkSession)
    blocks = keep(texts.mapInArrow(tidy(gathered), shape), "perplexity-blocks")
    asked = blocks.select("origin", "models", "texts").mapInArrow(tidy(asking), PACKED)
    said = arrays(found, parts).unionByName(asked).repartition("part").sortWithinPartitions("part", "kind").mapInArrow(tidy(answering), "origin long, part long, data binary")
    said = keep(said.groupBy("origin").agg(F.collect_list(F.struct("part", "data")).alias("said")), "perplexity-answers")
    values = keep(blocks.join(said, "origin").mapInArrow(tidy(adding), "a long, b long, log_perplexity double").dropDuplicates(["a", "b"]), "perplexity-values")
    own = _based(docs, text, lang)
    a, b = unused(own.columns, "_a", "_b")
    own = own.withColumns(dict(zip((a, b), _prints(F.col(f"`{text}`"), F.col(f"`{lang}`")), strict=True)))
    return own.join(values.select(F.col("a").alias(a), F.col("b").alias(b), "log_perplexity"), [a, b], "left").drop(a, b)


def bands(scored: DataFrame, spread: float = SPREAD) -> DataFrame:
    """_model, _low and _high log perplexity, from the quartiles of histograms."""
    bins = scored.filter("not base_failed and log_perplexity is not null").groupBy("_model", F.floor(F.col("log_perplexity") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    order = W.partitionBy("_model").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy("_model")))
    quarter = lambda i: (F.min(F.when(4 * F.col("upto") >= i * F.col("all"), F.col("bin"))) + 0.5) * BIN
    found = bins.groupBy("_model").agg(quarter(1).alias("q1"), quarter(3).alias("q3"), F.first("all").alias("all"))
    width = F.when(F.col("all") < LEAST_DOCS, float("inf")).otherwise(F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_WIDTH)))
    return found.select("_model", (F.col("q1") - spread * width).alias("_low"), (F.col("q3") + spread * width).alias("_high"))


def judged(scored: DataFrame) -> DataFrame:
    """scored with kept: base rules passed and log perplexity within the language's band."""
    low, high = unused(scored.columns, "_low", "_high")
    columns = [F.col(f"`{c}`") for c in scored.columns if c.lower() not in ("_model", "kept")]
    within = F.col("log_perplexity").between(F.col(low), F.col(high))
    # a row for each language, of numbers alone: Spark broadcasts it if it is small
    return scored.join(bands(scored).toDF("_model", low, high), "_model", "left").select(*columns, F.coalesce(~F.col("base_failed") & within, F.lit(False)).alias("kept"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with BASE, base_failed, log_perplexity and kept, by a model of docs themselves."""
    return judged(keep(score(docs, text, lang), "perplexity"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, BASE, base_failed, kept and log_perplexity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # bands need all scores first: these are written without the texts
    scored = keep(score(docs).drop("text", "lang"), "perplexity")
    return judged(scored).select("doc_id", *BASE, "base_failed", "kept", "log_perplexity")
