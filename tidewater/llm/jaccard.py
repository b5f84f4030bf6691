"""Operator 9: n-gram Jaccard join as a blocked sparse matrix product.

Documents are rows of an incidence matrix, distinct WORDS-word shingles its
columns; two documents link when 100 |x & y| >= PERCENT |x | y|. Equal sets are
one row (a class). The product of the matrix with its transpose is not formed:

* of each row only its prefix takes part, the n - ceil(0.8 n) + 1 entries that
  come first in an order of all shingles; two rows that link share an entry of
  their prefixes. The order is by hash, but shingles that many documents have
  come last, the most frequent last of all (a list of at most HOT shingles,
  from counts within tasks). Any order gives the same links; this one keeps
  columns short;
* a block is a range of columns, sorted by shingle in a task. Its columns give
  overlap counts of pairs, summed in the task before they are shuffled;
* a pair is discarded if its sizes differ by more than the bound allows, if the
  parities of its rows (a bit for each residue of the hash: whether an odd number
  of entries has it) differ in more bits than linked rows can have entries that
  only one has, or if its count falls short of what the rest of the two rows
  cannot make up. Each of these holds for all pairs that link;
* pairs left are counted exactly on their whole sets.

Groups of near copies would give all their pairs, so it is done in two steps.
First, each column gives only the pairs of two pivots (the class with most
copies and the one of least hash) with the others; what links by exact count
becomes components. Second, each column gives all pairs of *different*
components: if one of them links, it is found here. So no link that joins two
components is lost, and a group's pairs are looked at only as far as it falls
into parts. Components are what the query returns, and links within a component
change nothing in them.

A column that very many rows have is no single task's work: columns of the hot
list are dealt in cells of about WIDE classes (first step), and a column of more
than SQUARE classes in blocks, each two of which meet in a group of their own
(second step).

Shingles have hashes of 64 bits; equal sets are one class only if hashes of 128
bits agree, over all of the table: where two sets share a class but not its
second hash, all is done anew with other hashes.

Edge cases: texts with fewer than WORDS words are one shingle, the sequence of
all; without words a document has no shingle and links with nothing; repeated
rows link by equal sets; rows with a null doc_id link like all others, but
their id names no component (null if there is no other); equal counts go to the
greater hash; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.graph import among, components, filter_of, passing
from tidewater.llm.store import bounded_batches, drop, give_back, keep, table, tidy, unused
from tidewater.llm.words import U, Words, _mix, grams, signed

WORDS = 5
#: Links need PERCENT of 100; the bounds below are written for 80 = 4/5.
PERCENT = 80
HOT = 1 << 16
#: A shingle is told of if a task meets it so often among SEEN shingles; the sum must be HOT_LEAST.
HOT_LOCAL, HOT_LEAST, SEEN = 4, 16, 1 << 21
#: Classes in a cell of a column (about) and in a block of one; prefix entries that a task sums up before it sends them on.
WIDE, SQUARE, FLUSH = 1 << 15, 1 << 12, 1 << 19
#: Hashes that are tried one after the other.
SEEDS = (0, 2, 4, 6)


def least_overlap(nx, ny):
    """Smallest overlap with which sets of these sizes link."""
    return (4 * (nx + ny) + 8) // 9


def beyond(n):
    """Entries of a row beyond its prefix: ceil(4 n / 5) - 1."""
    return (4 * n + 4) // 5 - 1


def shingles(texts: pa.Array, k: int = WORDS, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts)
    h = w.hashes(lower=True, seed=seed)
    g = grams(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(_mix(grams(h[a:b], b - a) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def class_of(s: np.ndarray) -> int:
    """Hash of a set of hashes."""
    return int(_mix(np.array([int(s.sum(dtype=U)) & (2**64 - 1)], U) ^ U(len(s) * 0x9E3779B97F4A7C15 & (2**64 - 1))).view(np.int64)[0])


#: Bits of a row's parities, at least and at most; between them the power of two from its size on.
LEAST_BITS, MOST_BITS = 64, 4096


def parities(s: np.ndarray) -> bytes:
    """For each residue of the hash modulo a power of two whether an odd number of entries has it, as bits."""
    m = min(MOST_BITS, max(LEAST_BITS, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Parities of some rows, by width."""

    def __init__(self, bits: list[bytes]):
        self.width = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
        self.row = np.zeros(len(bits), np.int64)
        self.words: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.words[w, w] = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), w)

    def at(self, width: int, narrow: int) -> np.ndarray:
        """Rows of a width, folded to a narrower one."""
        if (width, narrow) not in self.words:
            wide = self.at(width, narrow * 2)
            self.words[width, narrow] = wide[:, :narrow] ^ wide[:, narrow:]
        return self.words[width, narrow]

    def may_link(self, i: int, j: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Whether row i can link with each of the rows j, given the sums of their sizes: 9 |x ^ y| <= |x| + |y|."""
        out = np.zeros(len(j), bool)
        wi = int(self.width[i])
        for wj in np.unique(self.width[j]).tolist():
            at = np.flatnonzero(self.width[j] == wj)
            n = min(wi, wj)
            odd = self.at(wj, n)[self.row[j[at]]] ^ self.at(wi, n)[self.row[i]]
            out[at] = 9 * np.bitwise_count(odd).sum(1, dtype=np.int64) <= total[at]
        return out


def _may_link_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (x, y, nx, ny and more) that may_link, by a join of each end with its parities."""
    ends = classes.select("class", "bits")
    both = pairs.join(ends.select(F.col("class").alias("x"), F.col("bits").alias("bx")), "x").join(ends.select(F.col("class").alias("y"), F.col("bits").alias("by")), "y")

    @F.arrow_udf("boolean")
    def test(bx: pa.Array, by: pa.Array, total: pa.Array) -> pa.Array:
        one = np.array([1])
        return pa.array([bool(Parities([a, b]).may_link(0, one, np.array([t]))[0]) for a, b, t in zip(bx.to_pylist(), by.to_pylist(), total.to_pylist(), strict=True)])

    return both.filter(test("bx", "by", (F.col("nx") + F.col("ny")).cast("long"))).drop("bx", "by")


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(keys)
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
    return s[edge], np.diff(np.append(edge, len(s)))


def _columns(*arrays, names):
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


def shapes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, key of the text, class, check (its second hash) and n of each document (said null), and shingles met often in a task (said their count)."""
    names = ["doc_id", "key", "class", "check", "n", "said", "bits"]

    def run(batches):
        held, size, known = [], 0, set()

        def often():
            key, n = _count(np.concatenate(held)) if held else (np.zeros(0, U), np.zeros(0, np.int64))
            key, n = key[n >= HOT_LOCAL], n[n >= HOT_LOCAL]
            empty = pa.nulls(len(key), pa.int64())
            return _columns(empty, empty, signed(key), empty, pa.nulls(len(key), pa.int32()), n.astype(np.int64), pa.nulls(len(key), pa.binary()), names=names)

        for batch in batches:
            sets = shingles(batch.column(1), seed=seed)
            ids = [class_of(s) for s in sets]
            n = np.fromiter(map(len, sets), np.int32, len(sets))
            check = [class_of(s) for s in shingles(batch.column(1), seed=seed + 1)]
            yield _columns(batch.column(0), batch.column(2), np.array(ids, np.int64), np.array(check, np.int64), n, pa.nulls(len(sets), pa.int64()), pa.array([parities(s) if len(s) else None for s in sets], pa.binary()), names=names)
            for c, s in zip(ids, sets, strict=True):
                if c not in known and len(s):
                    known.add(c)
                    held.append(s)
                    size += len(s)
            if size >= SEEN:
                yield often()
                held, size, known = [], 0, set()
        yield often()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).mapInArrow(tidy(run), "doc_id long, key long, class long, check long, n int, said long, bits binary")


class Order:
    """The order of shingles: by hash, then those of the hot list by count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.cells = -(-counts[order] // WIDE)
        place = np.empty(len(keys), np.int64)
        place[np.lexsort((keys[order], counts[order]))] = np.arange(1, len(keys) + 1)
        self.place = place

    def cell(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The cell of a column that a class is in; -1 for columns that are whole."""
        if not len(self.keys):
            return np.full(len(s), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        cells = np.where(self.keys[at] == s, self.cells[at], 1)
        return np.where(cells > 1, (_mix(c.view(U)) % cells.astype(U)).astype(np.int64), -1).astype(np.int32)

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The first len - beyond(len) entries of a sorted set."""
        p = len(s) - beyond(len(s))
        if not len(self.keys):
            return s[:p]
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        place = np.where(self.keys[at] == s, self.place[at], 0)
        return s[np.argsort(place, kind="stable")[:p]]


def postings(docs: DataFrame, order, seed: int = 0) -> DataFrame:
    """s, cell, class, n, copies: prefix entries of each class that a task meets, with its copies there.

    cell is -1, but for columns of the hot list that are too wide for a task.
    """

    def run(batches):
        by: dict[int, list] = {}
        size = 0

        def out():
            width = [len(p) for p, _, _ in by.values()]
            rep = lambda x, t: np.repeat(np.array(x, t), width)
            s, c = np.concatenate([p for p, _, _ in by.values()]), rep(list(by), np.int64)
            n, m = rep([n for _, n, _ in by.values()], np.int32), rep([m for _, _, m in by.values()], np.int32)
            cell = order.value.cell(s, c)
            for lo in range(0, len(s), 1 << 16):
                at = slice(lo, lo + (1 << 16))
                yield _columns(signed(s[at]), cell[at], c[at], n[at], m[at], names=["s", "cell", "class", "n", "copies"])

        for batch in batches:
            for s in shingles(batch.column(0), seed=seed):
                if len(s):
                    c = class_of(s)
                    if c in by:
                        by[c][2] += 1
                    else:
                        by[c] = [order.value.prefix(s), len(s), 1]
                        size += len(by[c][0])
            if size >= FLUSH:
                yield from out()
                by, size = {}, 0
        if by:
            yield from out()

    bounded_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(tidy(run), "s long, cell int, class long, n int, copies int")


def _columns_of(batches, names):
    """Whole columns (all rows alike in the first two names) of a partition sorted by these, as arrays of bounded size where columns are."""
    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        s, u = now[0], now[1]
        if len(s) < 1 << 17:
            held = now
            continue
        lo = int(np.searchsorted(s, s[-1]))
        cut = lo + int(np.searchsorted(u[lo:], u[-1]))
        if cut:
            yield [x[:cut] for x in now]
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield held


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return new


def _summed(x, y, nx, ny):
    """Pairs with their number of occurrences."""
    order = np.lexsort((y, x))
    x, y, nx, ny = x[order], y[order], nx[order], ny[order]
    edge = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    return x[edge], y[edge], nx[edge], ny[edge], np.diff(np.append(edge, len(x))).astype(np.int64)


def _close(nx, ny):
    return 5 * np.minimum(nx, ny).astype(np.int64) >= 4 * np.maximum(nx, ny)


def _needed(nx, ny):
    """Least number of common prefix entries with which sets of these sizes can link."""
    return np.maximum(1, least_overlap(nx, ny) - np.maximum(beyond(nx), beyond(ny)))


PAIRS = "s long, x long, y long, nx int, ny int, c long"


def stars(posted: DataFrame) -> DataFrame:
    """Entries of columns with two classes or more (s, x = class, nx = n), and pivot pairs (s null) with counts c."""
    names = ["s", "x", "y", "nx", "ny", "c"]

    def run(batches):
        for s, u, c, n, m in _columns_of(batches, ("s", "cell", "class", "n", "copies")):
            # rows of one class from several tasks: one entry, copies summed
            new = _new(s, u, c)
            m = np.add.reduceat(m, np.flatnonzero(new))
            s, u, c, n = s[new], u[new], c[new], n[new]
            first = np.flatnonzero(_new(s, u))
            width = np.diff(np.append(first, len(s)))
            # of a cell others may hold more classes
            own = np.repeat(width > 1, width) | (u >= 0)
            if not own.any():
                continue
            s, u, c, n, m = s[own], u[own], c[own], n[own], m[own]
            yield _columns(s, c, pa.nulls(len(s), pa.int64()), n, pa.nulls(len(s), pa.int32()), pa.nulls(len(s), pa.int64()), names=names)
            first = np.flatnonzero(_new(s, u))
            width = np.diff(np.append(first, len(s)))
            column = np.repeat(np.arange(len(first)), width)
            most = np.lexsort((c, -m.astype(np.int64), column))[first]
            parts = []
            for pivot in (most[column], first[column]):
                use = (pivot != np.arange(len(s))) & _close(n[pivot], n)
                parts.append((c[pivot][use], c[use], n[pivot][use], n[use]))
            x, y, nx, ny = (np.concatenate(p) for p in zip(*parts, strict=True))
            if len(x):
                flip = x > y
                x, y = np.where(flip, y, x), np.where(flip, x, y)
                nx, ny = np.where(flip, ny, nx), np.where(flip, nx, ny)
                x, y, nx, ny, k = _summed(x, y, nx, ny)
                yield _columns(pa.nulls(len(x), pa.int64()), x, y, nx, ny, k, names=names)

    rows = posted.repartition("s", "cell").sortWithinPartitions("s", "cell", "class")
    return rows.mapInArrow(tidy(run), PAIRS)


def across(entries: DataFrame) -> DataFrame:
    """x, y, nx, ny, c: pairs of different components in each column of entries (s, two, block, class, n, component, q, bits).

    two names the blocks of a column that meet here (lesser << 32 | greater).
    q is the number of columns in which a class meets others: no pair has more
    common columns than either has, so pairs that this rules out are not formed.
    """
    names = ["x", "y", "nx", "ny", "c"]
    ROOM = 1 << 19

    def run(batches):
        x_, y_, nx_, ny_, size = [], [], [], [], 0

        def flush():
            x, y, nx, ny, k = _summed(*(np.concatenate(p) for p in (x_, y_, nx_, ny_)))
            return _columns(x, y, nx, ny, k, names=names)

        for s, u, own, c, n, g, q, bits in _columns_of(batches, ("s", "two", "block", "class", "n", "component", "q", "bits")):
            first = np.flatnonzero(_new(s, u)).tolist()
            for a, b in zip(first, [*first[1:], len(s)], strict=True):
                if b - a < 2:
                    continue
                known = Parities(bits[a:b].tolist())
                apart = int(u[a]) >> 32 != int(u[a]) & 0xFFFFFFFF
                for i in range(a, b - 1):
                    may = np.minimum(q[i + 1 : b], q[i]) >= _needed(n[i + 1 : b].astype(np.int64), int(n[i]))
                    may &= (g[i + 1 : b] != g[i]) & _close(n[i + 1 : b], n[i])
                    if apart:
                        may &= own[i + 1 : b] != own[i]
                    j = i + 1 + np.flatnonzero(may)
                    if len(j):
                        j = j[known.may_link(i - a, j - a, n[j].astype(np.int64) + int(n[i]))]
                    if len(j):
                        x_.append(np.full(len(j), c[i]))
                        y_.append(c[j])
                        nx_.append(np.full(len(j), n[i]))
                        ny_.append(n[j])
                        size += len(j)
                        if size >= ROOM:
                            yield flush()
                            x_, y_, nx_, ny_, size = [], [], [], [], 0
        if size:
            yield flush()

    rows = entries.select("s", "two", "block", "class", "n", "component", "q", "bits").repartition("s", "two").sortWithinPartitions("s", "two", "class")
    return rows.mapInArrow(tidy(run), "x long, y long, nx int, ny int, c long")


def met_by_two(entries: DataFrame, square: int) -> DataFrame:
    """entries of columns that more than one component has, with block and two: a column of over `square` rows in blocks, each row once for every block that its own meets."""
    wide = entries.groupBy("s").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("width")).filter("a <> b")
    wide = wide.select("s", F.ceil(F.col("width") / square).cast("long").alias("blocks"))
    own = entries.join(wide, "s").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    own = own.withColumn("other", other)
    return own.withColumn("two", F.shiftleft(F.least("block", "other").cast("long"), 32) + F.greatest("block", "other").cast("long")).drop("other", "blocks")


def sets_of(docs: DataFrame, wanted: DataFrame, seed: int, name: str) -> DataFrame:
    """class and its whole set (entries) for each class of wanted (class, and row: a document that has it), kept under a name."""
    words = docs.sparkSession.sparkContext.broadcast(filter_of(wanted.select(F.col("row").alias("key"))))

    def run(batches):
        for batch in batches:
            use = np.flatnonzero(among(words.value, batch.column(1).to_numpy(zero_copy_only=False).view(U)))
            known = set()
            for lo in range(0, len(use), 64):
                at = use[lo : lo + 64]
                sets = shingles(batch.column(0).take(pa.array(at)), seed=seed)
                ids = [class_of(s) for s in sets]
                new = [i for i, c in enumerate(ids) if c not in known and not known.add(c)]
                yield _columns(batch.column(1).take(pa.array(at[new])), np.array([ids[i] for i in new], np.int64), pa.array([signed(sets[i]) for i in new], pa.list_(pa.int64())), names=["row", "class", "entries"])

    bounded_batches(docs.sparkSession)
    found = docs.select("text", row_of(F.col("doc_id"), F.xxhash64("text")).alias("row")).mapInArrow(tidy(run), "row long, class long, entries array<long>")
    sets = keep(found.join(wanted, ["row", "class"], "left_semi").dropDuplicates(["class"]).select("class", "entries"), name)
    words.destroy()
    return sets


def row_of(doc_id, key):
    """What names a document: its id and the hash of its text."""
    return F.xxhash64(doc_id.cast("long"), key)


def linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """x and y of those pairs (x, y, nx, ny) whose whole sets link."""
    pairs = keep(pairs.select("x", "y", "nx", "ny"), f"jaccard-{name}-pairs")
    ends = pairs.select(F.col("x").alias("class")).unionByName(pairs.select(F.col("y").alias("class"))).distinct()
    wanted = keep(ends.join(classes, "class").select("class", "row"), f"jaccard-{name}-ends")
    sets = sets_of(docs, wanted, seed, f"jaccard-{name}-sets")
    both = pairs.join(sets.select(F.col("class").alias("x"), F.col("entries").alias("ex")), "x").join(sets.select(F.col("class").alias("y"), F.col("entries").alias("ey")), "y")
    enough = F.size(F.array_intersect("ex", "ey")) >= F.expr("(4 * (nx + ny) + 8) div 9")
    links = keep(both.filter(enough).select("x", "y"), f"jaccard-{name}-links")
    drop(pairs, wanted, sets)
    give_back(docs.sparkSession)
    return links


def classed(docs: DataFrame) -> tuple[int, DataFrame, DataFrame]:
    """Seed of the hashes, shapes and classes (class, least, row, copies, bits), such that no two sets share a class."""
    for seed in SEEDS:
        said = keep(shapes(docs, seed), "jaccard-shapes")
        least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
        classes = said.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), least.alias("m"), F.count("*").alias("copies"), F.min("bits").alias("bits"), (F.min("check") != F.max("check")).alias("clash"))
        classes = keep(classes.select("class", "least", row_of(F.col("m.doc_id"), F.col("m.key")).alias("row"), "copies", "bits", "clash"), "jaccard-classes")
        if classes.filter("clash").isEmpty():
            return seed, said, classes
    raise RuntimeError("jaccard: different sets share a hash, whichever hash is used")


def join(docs: DataFrame, hot: int = HOT, square: int = SQUARE) -> DataFrame:
    """doc_id, n_shingles, component_id, class, copies for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    seed, said, classes = classed(docs)
    rows = said.filter("n is not null").select("doc_id", "key", "class", "n")
    often = said.filter("n is null").groupBy("class").agg(F.sum("said").alias("df")).filter(F.col("df") >= HOT_LEAST).orderBy(F.desc("df"), "class").limit(hot).toArrow()
    order = spark.sparkContext.broadcast(Order(often.column("class").to_numpy().astype(np.int64).view(U), often.column("df").to_numpy()))
    met = keep(stars(postings(docs, order, seed)), "jaccard-columns")
    order.destroy()
    give_back(spark)
    pivots = met.filter("s is null").groupBy("x", "y", "nx", "ny").agg(F.sum("c").alias("c"))
    need = F.greatest(F.lit(1), F.expr("(4 * (nx + ny) + 8) div 9 - greatest((4 * nx + 4) div 5, (4 * ny + 4) div 5) + 1"))
    # these pairs only save work later on: likely ones and two pivots a row (the best of each half of them) will do
    worth = keep(pivots.filter((4 * F.col("c") >= need) & (45 * F.col("c") >= F.col("nx") + F.col("ny"))), "jaccard-likely")
    best = [worth.groupBy(me, F.pmod(it, F.lit(2))).agg(F.max(F.struct("c", it, "nx", "ny")).alias("m")).select(me, f"m.{it}", "m.nx", "m.ny") for me, it in (("x", "y"), ("y", "x"))]
    links = linked(docs, _may_link_pairs(best[0].unionByName(best[1]).distinct(), classes), classes, "first", seed)
    drop(worth)
    parts = keep(components(links, "jaccard-first"), "jaccard-parts")
    entries = met.filter("s is not null").select("s", F.col("x").alias("class"), F.col("nx").alias("n"))
    entries = entries.join(parts.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    # the join has dealt entries by class already
    entries = keep(entries.withColumn("q", F.count("*").over(W.partitionBy("class")).cast("int")), "jaccard-entries")
    drop(met, parts)
    # parities go along with entries of columns that more than one component has
    pairs = across(met_by_two(entries, square).join(classes.select("class", "bits"), "class")).groupBy("x", "y", "nx", "ny").agg(F.sum("c").alias("c")).filter(F.col("c") >= need)
    more = linked(docs, pairs, classes, "second", seed)
    drop(entries)
    parts = keep(components(links.unionByName(more), "jaccard-second"), "jaccard-parts")
    named = classes.join(parts.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("class", "copies", "component_id", "component")
    out = rows.join(named, "class", "left")
    alone = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, alone).otherwise(F.col("doc_id")).alias("component_id"), "class", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(F.col("n") > 0, F.col("component")).alias("group"), "key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one row (the least doc_id) of each group; rows without words stay.

    Rows that go, and repeated rows, are looked up in a filter first, so that the
    others' texts are not shuffled; what the filter lets pass by mistake is joined too.
    """
    name = unused(docs.columns, "_row")[0]
    found = keep(join(docs.select("doc_id", "text")).withColumn("row", row_of(F.col("doc_id"), F.col("key"))), "jaccard-groups")
    stay = found.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("s")).select("group", F.col("s.row").alias("stays"))
    stay = keep(stay, "jaccard-stay")
    gone = found.filter("n_shingles > 0").join(stay, "group").filter("row <> stays").select("row")
    twice = found.filter("n_shingles > 0").groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row")
    test = passing(docs.sparkSession, filter_of(gone.unionByName(twice).select(F.col("row").alias("key"))))
    give_back(docs.sparkSession)
    own = docs.withColumn(name, row_of(F.col("doc_id"), F.xxhash64("text")))
    asked = test(F.col(name))
    safe = own.filter(~asked)
    wordless = found.filter("n_shingles = 0").select(F.col("row").alias(name)).distinct()
    checked = own.filter(asked)
    once = checked.join(stay.select(F.col("stays").alias(name)), name, "left_semi").dropDuplicates([name])
    return safe.unionByName(once).unionByName(checked.join(wordless, name, "left_semi")).select(docs.columns)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, over whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join(docs).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = {
    "op9_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {WORDS} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {WORDS - 1}], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d WHERE r.c < e.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = w.doc_id
"""
}
