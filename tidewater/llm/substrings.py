"""Operator 5: long repeated passages, by compaction of a de Bruijn graph over words.

Edges of the graph are the WINDOW-word sequences (k-mers) of all texts, nodes
the sequences shorter by a word. A path of edges that follow one another in a
text and share their minimizer (the least hash among the SEED-word sequences of
each window, the leftmost of equals) is compacted at once, within its text, to
one row: all occurrences of an edge lie in paths of the same minimizer.

1. Minimizers are counted over all texts; those that occur once cannot belong to
   a repeated edge. The rest go into a filter of fixed size, so only paths that
   may repeat are looked at further. (A full filter costs work, not results.)
2. Paths with equal words within a batch are compacted to the first of them.
   The others meet by minimizer, in one shuffle; their edges are matched to the
   earliest place (smaller doc_id, then earlier start) of the same edge. An edge
   is known by minimizer and own hash together: 128 bits.
3. Neighbouring matches of a text whose source places are neighbours too are
   compacted to one span.
4. Source coordinates verify: the words at a span's source are read from the
   source text and digested (`told`), and the digest goes along with the span.
5. Spans are joined to their texts, and the words that they cover are removed if
   they are the source's words. A span whose words differ, as only a collision of
   hashes can make it, is no repeat: its words stay.

A passage that a third of all texts hold is one row a batch of texts. What is
asked of one source text is cut into lists of about ASKED places.

Edge cases: null texts and texts under WINDOW words lose nothing; a null doc_id
comes after all others; rows of one doc_id count as one document, so at equal
starts none is the earlier one and both stay; repeated rows give repeated
results; an empty table gives no rows; other columns are kept, and give way
where they have the names added here.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.graph import among, filter_of
from tidewater.llm.store import bounded_batches, drop, give_back, keep, others, table, tidy, unused
from tidewater.llm.words import U, Words, _mix, grams, signed

WINDOW = 20
SEED = 8
FILTER_BITS = 1 << 27
LAST = 2**63 - 1
#: Minimizers that a task sums up before it sends them on.
FLUSH = 1 << 19
#: Paths that are matched at a time.
CHUNK = 1 << 14
#: Places of a source text that one row asks for, about.
ASKED = 4096


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each width neighbours, the leftmost of equals."""
    at = np.arange(len(v))
    power, span = at, 1
    # spans double until two of them cover the width
    while span * 2 <= width:
        n = len(power) - span
        a, b = power[:n], power[span : span + n]
        power = np.where(v[a] <= v[b], a, b)
        span *= 2
    n = len(v) - width + 1
    if n <= 0:
        return at[:0]
    a, b = power[:n], power[width - span : width - span + n]
    return np.where(v[a] <= v[b], a, b)


class Paths:
    """Paths of a batch of texts: first window (word place in the batch), windows, minimizer, text."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts)
        self.hash = w.hashes()
        self.seeds = grams(self.hash, SEED)
        n = len(self.hash) - WINDOW + 1
        empty = np.zeros(0, np.int64)
        self.start, self.size, self.text, self.minimizer = empty, empty, empty, np.zeros(0, U)
        if n <= 0:
            return
        place = sliding_least(self.seeds, WINDOW - SEED + 1)
        text = np.repeat(np.arange(len(w)), w.counts())
        inside = text[:n] == text[WINDOW - 1 :]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (text[1:n] != text[: n - 1])
        self.start = np.flatnonzero(new)
        # a path ends where the next begins or where windows leave the text
        last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
        self.size = last - self.start + 1
        self.text = text[self.start]
        self.minimizer = self.seeds[place[self.start]]


def _sum(parts):
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    order = np.argsort(key)
    key, n = key[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    # more than one is all that is asked
    n = np.minimum(np.add.reduceat(n, edge, dtype=np.int64), 2).astype(np.int8) if len(edge) else n
    return key[edge], n


def repeated_minimizers(docs: DataFrame) -> DataFrame:
    """key: minimizers of two paths or more."""

    def run(batches):
        parts, size = [], 0

        def out():
            key, n = _sum(parts)
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(signed(key[i : i + (1 << 16)])), pa.array(n[i : i + (1 << 16)])], names=["key", "n"])

        for batch in batches:
            p = Paths(batch.column(0))
            parts.append(_sum([(p.minimizer, np.ones(len(p.minimizer), np.int8))]))
            size += len(parts[-1][0])
            if size > FLUSH:
                yield from out()
                parts, size = [], 0
        if parts:
            yield from out()

    bounded_batches(docs.sparkSession)
    told = docs.select("text").mapInArrow(tidy(run), "key long, n byte")
    return told.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")


_MATCH = "minimizer long, doc long, key long, start int, size int, edges binary, source long, source_key long, source_start int"
_MATCH_NAMES = ["minimizer", "doc", "key", "start", "size", "edges", "source", "source_key", "source_start"]


def paths(docs: DataFrame, filtered) -> DataFrame:
    """Paths that may repeat: with edges, the first of equal ones in a batch; without edges, those matched to it."""

    def run(batches):
        for batch in batches:
            p = Paths(batch.column(0))
            use = np.flatnonzero(among(filtered.value, p.minimizer)) if len(p.start) else p.start
            if not len(use):
                continue
            start, size, text = p.start[use], p.size[use], p.text[use]
            doc = batch.column(1).to_numpy(zero_copy_only=False)[text]
            key = batch.column(2).to_numpy(zero_copy_only=False)[text]
            local = start - p.words.first[text]
            # a path is shorter than two windows: its first and last edge and its size are all of its words
            edges = grams(p.hash, WINDOW)
            first, last = edges[start], edges[start + size - 1]
            order = np.lexsort((local, doc, size, last, first))
            a, b, n = first[order], last[order], size[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (n[1:] != n[:-1])])
            head = np.empty(len(order), np.int64)
            head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            later = (doc > doc[head]) | ((doc == doc[head]) & (local > local[head]))
            raw = edges.tobytes()
            packed = [None if x else raw[8 * a : 8 * (a + n)] for a, n, x in zip(start.tolist(), size.tolist(), later.tolist(), strict=True)]
            # what is matched already needs no meeting place: it is spread by its own text and start
            lead = np.where(later, signed(_mix(key.astype(np.int64).view(U) + local.astype(U))), signed(p.minimizer[use]))
            i32 = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(doc.astype(np.int64)), pa.array(key.astype(np.int64)), i32(local), i32(size), pa.array(packed, pa.binary()), pa.array(np.where(later, doc[head], 0), mask=~later), pa.array(key[head].astype(np.int64), mask=~later), pa.array(local[head].astype(np.int32), mask=~later)], names=_MATCH_NAMES)

    bounded_batches(docs.sparkSession)
    return docs.select("text", "_doc", "_key").mapInArrow(tidy(run), _MATCH)


def _runs(*columns):
    """Where a new run begins: within a run the last two columns advance by one, the others stay."""
    *same, d, e = columns
    new = (d[1:] != d[:-1] + 1) | (e[1:] != e[:-1] + 1)
    for x in same:
        new |= x[1:] != x[:-1]
    return np.concatenate([[True], new]) if len(d) else np.zeros(0, bool)


def matches(found: DataFrame) -> DataFrame:
    """doc, key, start, size (windows), source, source_key, source_start: windows that start earlier elsewhere."""
    names = ["doc", "key", "start", "size", "source", "source_key", "source_start"]

    def resolve(v, doc, key, start, size, edges, known):
        """Matches among paths, and with the first places known; what is known then of the last minimizer."""
        h = np.frombuffer(b"".join(edges), U)
        rep = np.repeat(np.arange(len(v)), size)
        at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size) + start[rep]
        last = v[-1]
        v, doc, key, at, h = (np.concatenate(x) for x in zip(known, (v[rep], doc[rep], key[rep], at, h), strict=True)) if known else (v[rep], doc[rep], key[rep], at, h)
        order = np.lexsort((at, doc, h, v))
        v, doc, key, at, h = v[order], doc[order], key[order], at[order], h[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (h[1:] != h[:-1])])
        first = np.flatnonzero(new & (v == last))
        known = v[first], doc[first], key[first], at[first], h[first]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.flatnonzero((doc > doc[head]) | ((doc == doc[head]) & (at > at[head])))
        head = head[later]
        order = np.lexsort((at[later], key[later], doc[later]))
        later, head = later[order], head[order]
        edge = np.flatnonzero(_runs(doc[later], key[later], doc[head], key[head], at[later], at[head]))
        length = np.diff(np.append(edge, len(later)))
        later, head = later[edge], head[edge]
        i32 = lambda x: pa.array(x.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array(key[later]), i32(at[later]), i32(length), pa.array(doc[head]), pa.array(key[head]), i32(at[head])], names=names), known

    def run(batches):
        """Paths of a minimizer come by text and place, so an edge's first place is met first; of a minimizer only first places are held."""
        held, size, known = [], 0, None
        for batch in batches:
            there = batch.column(5).is_valid()
            done = batch.filter(pc.invert(there))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(i) for i in (1, 2, 3, 4, 6, 7, 8)], names=names)
            own = batch.filter(there)
            if own.num_rows:
                held.append(own)
                size += own.num_rows
            if size >= CHUNK:
                out, known = resolve(*_arrays(pa.Table.from_batches(held)), known)
                yield out
                held, size = [], 0
        if held:
            yield resolve(*_arrays(pa.Table.from_batches(held)), known)[0]

    rows = found.repartition("minimizer").sortWithinPartitions("minimizer", "doc", "start")
    return rows.mapInArrow(tidy(run), "doc long, key long, start int, size int, source long, source_key long, source_start int")


def _arrays(rows: pa.Table):
    whole = [rows.column(i).to_numpy() for i in range(5)]
    return whole[0], whole[1], whole[2], whole[3].astype(np.int64), whole[4].astype(np.int64), rows.column(5).to_pylist()


def spans(docs: DataFrame, name: str = "repeats") -> DataFrame:
    """doc, key, start, words, source, source_key, source_start: compacted repeats of docs (text, _doc, _key)."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(repeated_minimizers(docs), FILTER_BITS))
    # rows alike in doc_id and text say the same
    found = keep(matches(paths(docs, sent)).distinct(), name)
    sent.destroy()
    # paths that follow on each other in both texts are one span
    order = W.partitionBy("doc", "key").orderBy("start", "source", "source_key", "source_start")
    follows = (F.lag("source").over(order) == F.col("source")) & (F.lag("source_key").over(order) == F.col("source_key")) & (F.lag("start").over(order) + F.lag("size").over(order) == F.col("start")) & (F.lag("source_start").over(order) + F.lag("size").over(order) == F.col("source_start"))
    marked = found.withColumn("island", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order))
    whole = marked.groupBy("doc", "key", "island").agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.min("source_start").alias("source_start"), F.first("source").alias("source"), F.first("source_key").alias("source_key"))
    out = keep(whole.select("doc", "key", "start", (F.col("size") + WINDOW - 1).cast("int").alias("words"), "source", "source_key", "source_start"), f"{name}-spans")
    drop(found)
    give_back(docs.sparkSession)
    return out


def _print(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest()


def _among_texts(docs: DataFrame, words) -> DataFrame:
    """Rows of docs (text, _doc, _key) whose _key may be in the filter sent."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(among(words.value, batch.column(2).to_numpy(zero_copy_only=False).view(U))))

    bounded_batches(docs.sparkSession)
    return docs.select("text", "_doc", "_key").mapInArrow(tidy(run), "text string, _doc long, _key long")


def told(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc, key, start, words, print: the digest of each place's words, for places found (source, source_key, source_start, words)."""
    asked = found.select(F.col("source").alias("_doc"), F.col("source_key").alias("_key"), F.col("source_start").alias("start"), "words").distinct()
    lists = asked.groupBy("_doc", "_key").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("_lists"))
    lists = keep(lists, "repeats-sources")
    asked = asked.join(lists, ["_doc", "_key"]).withColumn("_list", F.pmod(F.xxhash64("start", "words"), F.col("_lists")).cast("int"))
    asked = asked.groupBy("_doc", "_key", "_list").agg(F.collect_list(F.struct("start", "words")).alias("places"))
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(lists.select(F.col("_key").alias("key"))))
    # equal texts of one doc_id say the same
    texts = _among_texts(docs, sent).join(lists, ["_doc", "_key"]).withColumn("_list", F.explode(F.sequence(F.lit(0), F.col("_lists") - 1)))
    both = texts.join(asked, ["_doc", "_key", "_list"]).select("text", "_doc", "_key", "places")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = (batch.column(0)[i].as_py() or "").encode().split()
                places = batch.column(3).slice(i, 1).flatten()
                start, n = places.field(0), places.field(1)
                prints = [_print(words, a, b) for a, b in zip(start.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(1)[i], len(prints)), pa.repeat(batch.column(2)[i], len(prints)), start, n, pa.array(prints, pa.binary())], names=["doc", "key", "start", "words", "print"])

    return both.mapInArrow(tidy(run), "doc long, key long, start int, words int, print binary").distinct()


ADDED = ("n_words", "n_removed", "kept_sha256")


def strip(docs: DataFrame, texts: bool = True) -> DataFrame:
    """docs with n_words, n_removed and kept_sha256; with texts, the text of those that lose words is what they keep, joined by one space."""
    own = others(docs, ADDED)
    columns = own.columns
    doc, key, cut = unused(own.columns, "_doc", "_key", "_cut")
    own = own.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(key, F.xxhash64("doc_id", "text"))
    narrow = own.select("text", F.col(doc).alias("_doc"), F.col(key).alias("_key"))
    found = spans(narrow)
    place = ["source", "source_key", "source_start", "words"]
    prints = told(narrow, found).toDF(*place, "print")
    lists = found.join(prints, place, "left").groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("start", "words", "print"))).alias(cut))
    lists = keep(lists, "repeats-by-text")
    drop(found)
    give_back(docs.sparkSession)
    # texts that lose nothing are digested where they are read and not shuffled
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(lists.select("key")))
    lists = lists.select(F.col("doc").alias(doc), F.col("key").alias(key), cut)
    joined = _digested(own, key, sent, not texts).join(lists, [doc, key], "left").select(*(F.col(f"`{c}`") for c in columns), "n_words", "kept_sha256", cut)
    out = _finish(joined, cut)
    if texts:
        return out.unionByName(_digested(own, key, sent, False, False).select(*(F.col(f"`{c}`") for c in columns), "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"))
    return out.drop("text")


def _told(raw: bytes) -> tuple[int, str]:
    words = raw.split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def _digested(own: DataFrame, key: str, words, every: bool, asked: bool = True) -> DataFrame:
    """own with n_words and kept_sha256, both null for texts that may lose words.

    every: all rows, with the text of those alone that may lose words; else only
    rows that may (asked) or may not lose words, with their texts.
    """
    schema = T.StructType([*own.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            hit = among(words.value, batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False).view(U))
            if not every:
                batch = batch.filter(pa.array(hit if asked else ~hit))
                hit = np.full(batch.num_rows, asked)
            texts = batch.column(at)
            own = [(None, None) if h else _told((x.as_py() or "").encode()) for h, x in zip(hit, texts, strict=True)]
            columns = list(batch.columns)
            if every:
                columns[at] = pc.if_else(pa.array(hit), texts, pa.scalar(None, texts.type))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in own], pa.int64()), pa.array([s for _, s in own], pa.string())], schema.names)

    bounded_batches(own.sparkSession)
    return own.mapInArrow(tidy(run), schema)


def _kept(raw: bytes, found: list | None) -> tuple[int, list[bytes]]:
    """Number of words, and those that stay; a span's words go if they are what its source has."""
    words = raw.split()
    stay = np.ones(len(words), bool)
    for r in found or ():
        if _print(words, r["start"], r["words"]) == r["print"]:
            stay[r["start"] : r["start"] + r["words"]] = False
    return len(words), words if stay.all() else [words[i] for i in np.flatnonzero(stay)]


def _finish(joined: DataFrame, cut: str) -> DataFrame:
    """joined (with n_words, kept_sha256 of texts that lose nothing, and the spans) with ADDED, text by text."""
    schema = T.StructType([*(f for f in joined.schema.fields if f.name not in (cut, *ADDED)), T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField("kept_sha256", T.StringType(), False)])

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            text, found, known, digest = (batch.column(names.index(c)) for c in ("text", cut, "n_words", "kept_sha256"))
            rows, new = [], []
            for i in range(batch.num_rows):
                x = text[i].as_py()
                n, gone, s = known[i].as_py(), 0, digest[i].as_py()
                if n is None:
                    n, words = _kept((x or "").encode(), found[i].as_py())
                    left = b" ".join(words)
                    gone, s = n - len(words), hashlib.sha256(left).hexdigest()
                    x = left.decode() if gone else x
                rows.append((n, gone, s))
                new.append(x)
            columns = [pa.array(new, pa.string()) if f == "text" else batch.column(i) for i, f in enumerate(names) if f not in (cut, *ADDED)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], schema.names)

    bounded_batches(joined.sparkSession)
    return joined.mapInArrow(tidy(run), schema)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return strip(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = {
    "op5_substrings": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
l AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM e),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM l, range({WINDOW}) t(j) WHERE r > 1),
k AS (SELECT w.doc_id, w.i, w.word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) w ANTI JOIN c ON c.doc_id = w.doc_id AND c.i = w.i),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS s FROM k GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(t.n, 0))::BIGINT AS n_removed, sha256(coalesce(t.s, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
}
