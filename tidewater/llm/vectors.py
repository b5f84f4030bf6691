"""Operator 3: nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1 and cut in two halves. Each half has a codebook of
centroids (their number grows with the root of the table's, `codes_for`), fitted
by k-means on at most SAMPLE vectors, those with the smallest digests; every
vector is indexed under its pair of nearest centroids. A query walks the pairs in
order of summed distance, from a heap over the two sorted distance lists, until
the pairs' entries reach `share` of all entries (LEAST at least); all entries of
the pairs that it met are reranked by exact cosine on the original vectors, in
double precision.

share is measured, not guessed: of sampled vectors the true nearest within the
sample are sought, and share is what TARGET of these need. (Neighbours in the
sample are farther off than those in the table, so this errs towards more.)

How many entries a pair has is a table of codes x codes numbers, known to every
task. Entries are stored by regions: neighbouring pairs with BLOCK entries
together, or, of a pair with more, a part by digest. A query goes once to each
region it meets, with the summed distance at which its walk ended: the pairs
walked are those up to it. A task holds one region's entries and reads its
queries batch by batch; each query's best k + 1 leave the task.

Equal vectors are one entry with the k + 1 smallest ids (partial top-k in each
task before the shuffle), and equal queries are asked once: copies are never
multiplied by copies.

Edge cases: vectors that are null, zero, empty or hold null or non-finite
components take no part, neither as query nor as candidate, nor do rows without
id; vectors of another length are another space, with an index of its own; with
fewer than k candidates all are returned; equal scores go by smaller id; rows
that repeat an id, with the same vector or another, are rows of their own: each
asks and each is found, but no row finds itself; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.store import bounded_batches, keep, table, tidy

K = 5
LEAST_CODES, MOST_CODES = 256, 1024
SAMPLE = 8192
ROUNDS = 12
#: Of the true neighbours of TRIED sampled vectors, the part that the walk must meet.
TARGET, TRIED = 0.94, 256
LEAST = 256
BLOCK = 4096


def usable(v: Column) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)


def codes_for(n: int) -> int:
    """Centroids of a half: the power of two from the root of the number of entries on, within bounds."""
    return min(MOST_CODES, max(LEAST_CODES, 1 << (int(n**0.5) - 1).bit_length()))


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of c to each of x, some rows at a time."""
    return np.concatenate([np.argmin((c * c).sum(1) - 2 * x[i : i + 2048] @ c.T, axis=1) for i in range(0, len(x), 2048)])


def kmeans(x: np.ndarray, codes: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from a spread start; fewer centroids if there are fewer distinct points."""
    points = np.unique(x, axis=0)
    if len(points) <= codes:
        return points
    c = points[np.random.default_rng(seed).permutation(len(points))[:codes]]
    for _ in range(rounds):
        near = _near(x, c)
        n = np.bincount(near, minlength=codes)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class MultiIndex:
    """Two codebooks, and how many entries each pair of centroids has."""

    def __init__(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray | None = None):
        self.books = (first, second)
        self.counts = np.zeros((len(first), len(second)), np.int64) if counts is None else counts

    @classmethod
    def fit(cls, sample: np.ndarray, codes: int) -> MultiIndex:
        half = sample.shape[1] // 2
        return cls(kmeans(sample[:, :half], codes), kmeans(sample[:, half:], codes))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.books[0].shape[1]
        parts = (x[:, :half], x[:, half:])
        return tuple((p * p).sum(1)[:, None] + (b * b).sum(1) - 2 * p @ b.T for p, b in zip(parts, self.books, strict=True))

    def pairs(self, x: np.ndarray) -> np.ndarray:
        half = self.books[0].shape[1]
        return _near(x[:, :half], self.books[0]) * len(self.books[1]) + _near(x[:, half:], self.books[1])

    def walk(self, a: np.ndarray, b: np.ndarray, enough: int) -> tuple[float, int]:
        """Goes through pairs by summed distance until they hold enough entries; the last one's distance, and what they hold."""
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sa, sb = a[by_a].tolist(), b[by_b].tolist()
        rows, columns, own = len(sa), len(sb), {}
        heap, got, last = [(sa[0] + sb[0], 0, 0)], 0, 0.0
        while heap and got < enough:
            last, i, j = heap[0]
            if not j:
                # the next row of the first list joins in when this one has begun
                own[i] = self.counts[by_a[i]][by_b].tolist()
                if i + 1 < rows:
                    heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
            got += own[i][j]
            if j + 1 < columns:
                heapq.heapreplace(heap, (sa[i] + sb[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
        return last, got

    def share(self, sample: np.ndarray, k: int, target: float = TARGET, tried: int = TRIED) -> float:
        """Part of the sample's entries that walks must meet for target of the tried vectors' true neighbours to be among them."""
        counts = np.bincount(self.pairs(sample), minlength=len(self.books[0]) * len(self.books[1]))
        asked = np.arange(len(sample))[:: max(1, len(sample) // tried)]
        place = self.pairs(sample)
        needed = []
        for i in asked.tolist():
            s = sample @ sample[i]
            s[i] = -np.inf
            best = np.argsort(-s)[: min(k, len(sample) - 1)]
            a, b = self.distances(sample[i : i + 1])
            sums = (a[0][:, None] + b[0][None, :]).ravel()
            order = np.argsort(sums, kind="stable")
            upto = np.cumsum(counts[order])
            at = np.empty(len(order), np.int64)
            at[order] = np.arange(len(order))
            needed += (upto[at[place[best]]] / len(sample)).tolist()
        return float(np.quantile(needed, target, method="higher")) if needed else 1.0


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, a row each, times powers of two, which no rounding follows: squares neither overflow nor vanish, cosines stay."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(column: pa.Array) -> np.ndarray:
    x = _matrix(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Regions:
    """Where entries are stored: a region for neighbouring pairs of BLOCK entries together, several for a pair of more."""

    def __init__(self, counts: np.ndarray, block: int):
        flat = counts.ravel()
        self.first = np.zeros(len(flat), np.int64)
        self.parts = np.maximum(1, -(-flat // block))
        region, held = 0, 0
        for pair in np.flatnonzero(flat).tolist():
            n, parts = int(flat[pair]), int(self.parts[pair])
            if held and (parts > 1 or held + n > block):
                region, held = region + 1, 0
            self.first[pair] = region
            if parts > 1:
                region += parts
            else:
                held += n
        self.filled = np.flatnonzero(flat)

    def met(self, pairs: np.ndarray) -> np.ndarray:
        """Regions of pairs, each once."""
        first, parts = self.first[pairs], self.parts[pairs]
        split = parts > 1
        out = [first[~split], *(np.arange(f, f + n) for f, n in zip(first[split].tolist(), parts[split].tolist(), strict=True))]
        return np.unique(np.concatenate(out))


def search(rows: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, codes: int | None = None, share: float | None = None, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with asked its k nearest others, nearest first. codes and share: see codes_for and MultiIndex.share."""
    spark = rows.sparkSession
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    # an index for each length that is asked for
    sizes = sorted(r.n for r in own.filter("asked").select(F.size("v").alias("n")).distinct().collect())
    found = [_search(own.filter(F.size("v") == n), k, codes, share, least, block) for n in sizes]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def sampled(entries: DataFrame, n: int, most: int = SAMPLE) -> pa.Array:
    """Vectors of the entries with the smallest digests, most of them at most; about as many leave the tasks."""
    digest = F.xxhash64(F.lit(11), "entry")
    if n > 2 * most:
        # a little more than asked for, so that enough are left
        entries = entries.filter(F.pmod(digest, F.lit(1 << 32)) < int((1 << 32) * 1.25 * most / n))
    return entries.orderBy(digest, "entry").limit(most).select("v").toArrow().column(0).combine_chunks()


def _search(own: DataFrame, k: int, codes: int | None, share: float | None, least: int, block: int) -> DataFrame:
    """search among vectors of one length (id, v, asked)."""
    spark = own.sparkSession
    bounded_batches(spark)
    # equal vectors: one entry, the ids of its k + 1 first rows; limits within each task come before the shuffle
    ranked = own.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("entry", F.xxhash64("v"))
    entries = keep(entries, "vec-entries")
    total = entries.count()
    sample = _unit(sampled(entries, total))
    index = MultiIndex.fit(sample, codes or codes_for(total))
    share = index.share(sample, k) if share is None else share
    sent = spark.sparkContext.broadcast(index)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("pair", pa.array(sent.value.pairs(_unit(batch.column(0))).astype(np.int32)))

    placed = keep(entries.mapInArrow(tidy(place), "v array<double>, ids array<long>, entry long, pair int"), "vec-placed")
    found = placed.groupBy("pair").agg(F.count("*").alias("n")).toArrow()
    index.counts.ravel()[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    enough = max(least, int(np.ceil(share * total)))
    filled = spark.sparkContext.broadcast((index, Regions(index.counts, block)))

    def store(batches):
        for batch in batches:
            _, regions = filled.value
            pair = batch.column(3).to_numpy()
            part = (batch.column(2).to_numpy().view(np.uint64) >> np.uint64(7)) % regions.parts[pair].astype(np.uint64)
            region = regions.first[pair] + part.astype(np.int64)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(region), pa.repeat(pa.scalar(0, pa.int32()), n), batch.column(0), batch.column(1), pa.array(pair.astype(np.int64)), pa.nulls(n, pa.float64())], names=_NAMES)

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            index, regions = filled.value
            a, b = index.distances(_unit(batch.column(1)))
            for i in range(batch.num_rows):
                last, _ = index.walk(a[i], b[i], enough)
                # what rounding may take away is added: the same sums are made anew where the entries are
                last += 1e-9
                met = regions.met(regions.filled[(a[i][:, None] + b[i][None, :]).ravel()[regions.filled] <= last])
                n, at = len(met), pa.array(np.full(len(met), i))
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.repeat(pa.scalar(1, pa.int32()), n), batch.column(1).take(at), pa.nulls(n, pa.list_(pa.int64())), batch.column(0).take(at), pa.repeat(pa.scalar(last), n)], names=_NAMES)

    # asked once for each distinct vector
    queries = own.filter("asked").select("v").distinct().withColumn("query", F.xxhash64("v"))
    stored = placed.mapInArrow(tidy(store), _SHAPE)
    routed = queries.select("query", "v").mapInArrow(tidy(route), _SHAPE)

    def rerank(batches):
        """Sorted by region: a region's entries, then its queries."""
        region, held, known = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])])).tolist()
            for lo, hi in zip(edge, [*edge[1:], len(at)], strict=True):
                piece = batch.slice(lo, hi - lo)
                if at[lo] != region:
                    region, held, known = at[lo], [], None
                if kind[lo] == 0:
                    held.append(piece)
                    continue
                if not held:
                    continue
                if known is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    x = _matrix(rows.column(2).chunk(0))
                    known = x, np.linalg.norm(x, axis=1), rows.column(3).to_pylist(), rows.column(4).to_numpy()
                yield from best_of(piece, *known)

    def best_of(piece, x, xn, ids, pair):
        index, _ = filled.value
        first = np.array([i[0] for i in ids])
        width = len(index.books[1])
        for lo in range(0, piece.num_rows, 64):
            some = piece.slice(lo, 64)
            q = _matrix(some.column(2))
            a, b = index.distances(_unit(some.column(2)))
            s = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * xn)
            s[a[:, pair // width] + b[:, pair % width] > some.column(5).to_numpy()[:, None]] = -np.inf
            names, out = some.column(4).to_numpy(), []
            for i, query in enumerate(names.tolist()):
                n = min(k + 1, len(ids))
                least = np.partition(s[i], len(ids) - n)[len(ids) - n]
                best = np.flatnonzero((s[i] >= least) & (s[i] > -np.inf))
                best = best[np.lexsort((first[best], -s[i][best]))][:n]
                out += [(query, float(s[i, j]), y, j) for j in best.tolist() for y in ids[j]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True))[:3], (pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query", "score", "id"])

    both = stored.unionByName(routed).repartition("region").sortWithinPartitions("region", "kind")
    hits = both.mapInArrow(tidy(rerank), "query long, score double, id long")
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    best = hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    # back to every row that asked, which leaves itself out: once, the first of its id among its equals
    askers = own.filter("asked").select("v", F.col("id").alias("query_id"))
    known = queries.join(best, "query").select("v", "near")
    own_place = F.array_position(F.transform("near", lambda x: (x["id"] == F.col("query_id")) & (x["score"] >= 1 - 1e-9)), True) - 1
    out = askers.join(known, "v").withColumn("own", own_place)
    out = out.select("query_id", F.slice(F.filter("near", lambda x, i: i != F.col("own")), 1, k).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


_SHAPE = "region long, kind int, v array<double>, ids array<long>, name long, reach double"
_NAMES = ["region", "kind", "v", "ids", "name", "reach"]


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest others of every vector whose id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
