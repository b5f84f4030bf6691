"""Selections, joins, set operations, rankings and row changes over transfer tables.

Every operator takes and gives DataFrames and leaves the physical plan to
Catalyst: equality joins on keys, filters that reach the scan, top-k with a
unique last sort key. Time is a parameter (`now`), never the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import scalars as S

# -- selections (A2, A24, B) -------------------------------------------------

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
REQUEST_ID = "^[a-zA-Z0-9_-]{1,128}$"


def lookup(transfers: DataFrame, key: str) -> DataFrame:
    """A2: a transfer by id if key is a UUID, else by info hash. The test is on the literal, so the scan gets one equality."""
    import re

    return transfers.filter(F.col("id") == key) if re.match(UUID, key) else transfers.filter(F.col("info_hash") == key.lower())


def valid_request(x: Column) -> Column:
    """Whether a request id is well formed."""
    return F.coalesce(x.rlike(REQUEST_ID), F.lit(False))


def without(df: DataFrame, *names: str) -> DataFrame:
    """B2."""
    return df.drop(*names)


def searched(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive substring; % and _ in text are wildcards."""
    return df.filter(F.col(column).ilike(f"%{text}%"))


def between(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Start <= ts < end."""
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def fresh(df: DataFrame, seen: str, now: Column, seconds: int) -> DataFrame:
    """Rows seen within the last seconds."""
    return df.filter(F.col(seen) >= now - F.make_dt_interval(secs=F.lit(seconds)))


#: States of transfers that take no capacity (fixed values).
IDLE_STATES = ("paused", "stopped", "error")


def active(df: DataFrame, state: str = "state") -> DataFrame:
    """B13."""
    return df.filter(~F.col(state).isin(*IDLE_STATES))


def unhealthy(peers: DataFrame) -> DataFrame:
    """Slow peers, and those that fail most of more than ten requests."""
    return peers.filter(F.col("slow") | ((F.col("success_rate") < 0.3) & (F.col("samples") > 10)))


def patched(base: DataFrame, changes: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Base with the allowed columns replaced where changes has a value."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in allowed))
    out = base.join(new, key, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in allowed else F.col(c) for c in base.columns))


def sampled(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """About one row in so many, the same ones every time."""
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("long")
    return df.filter(digest % one_in == 0)


# -- joins (C) ------------------------------------------------------------------


def with_uploader(transfers: DataFrame, users: DataFrame, owner: str, user: str, *columns: str) -> DataFrame:
    """Transfers with columns of their uploader, where there is one."""
    return transfers.join(users.select(F.col(user).alias(owner), *columns), owner, "left")


def nested(parents: DataFrame, children: DataFrame, key: str, columns: Sequence[str], name: str) -> DataFrame:
    """Parents with a sorted array of structs of their children; an empty one without children."""
    rows = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    out = parents.join(rows, key, "left")
    kind = out.schema[name].dataType
    return out.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def children_of(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of the parents given, without the parents' columns."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def overlaid(rows: DataFrame, live: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with live columns where a live row exists, their own otherwise; is_live says which."""
    new = live.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("is_live"))
    out = rows.join(new, key, "left")
    keep = [c for c in rows.columns if c not in columns]
    return out.select(*keep, *((F.coalesce(f"_{c}", c) if c in rows.columns else F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns), F.coalesce("is_live", F.lit(False)).alias("is_live"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is not there; a null reference is no orphan."""
    known = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.filter(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def unleased(transfers: DataFrame, leases: DataFrame, key: str, now: Column) -> DataFrame:
    """Transfers without a lease that is still running."""
    return transfers.join(leases.filter(F.col("expires_at") > now).select(key), key, "left_anti")


def recovery(transfers: DataFrame, leases: DataFrame, key: str, now: Column, statuses: Sequence[str]) -> DataFrame:
    """A recovery directive for each active transfer whose lease has gone."""
    lost = unleased(transfers.filter(F.col("status").isin(*statuses)), leases, key, now)
    return lost.select(key, F.lit("queued").alias("status"), F.lit("JOB_ASSIGNED").alias("type"))


def stored(chunks: DataFrame, store: DataFrame, chunk_hash: str = "chunk_hash", key: str = "sha256") -> DataFrame:
    """C11: outstanding chunks whose content the store has, by hash; chunks without a hash are left out."""
    return chunks.filter(F.col(chunk_hash).isNotNull()).join(store.select(F.col(key).alias(chunk_hash)).distinct(), chunk_hash, "left_semi")


def inserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and those rows of new, once each, whose keys old lacks."""
    fresh_rows = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh_rows.select(old.columns))


def unknown(found: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows of found whose keys are not known, once each."""
    return found.dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti")


def pieces_of_files(files: DataFrame, piece: int, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each file and piece that share bytes, with their number.

    The pieces of a file are a range, so an explode takes the place of a theta join.
    """
    part = files.filter(F.col(end) > F.col(start))
    first, last = F.floor(F.col(start) / piece), F.floor((F.col(end) - 1) / piece)
    rows = part.withColumn("piece", F.explode(F.sequence(first, last)))
    return rows.withColumn("shared", S.overlap(start, end, F.col("piece") * piece, (F.col("piece") + 1) * piece))


# -- orders and top-k (F, G) -------------------------------------------------


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """the first k rows; order must end in a unique key."""
    return df.orderBy(*order).limit(k)


def top_by(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key. Spark cuts each task's groups to k before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Weight of each priority (fixed values).
PRIORITY = {"high": 3, "normal": 2, "low": 1}


def priority_weight(x: Column) -> Column:
    """F4."""
    out = F.lit(0)
    for name, weight in PRIORITY.items():
        out = F.when(x == name, weight).otherwise(out)
    return out


def rarest(pieces: DataFrame, busy: DataFrame, key: str = "piece") -> DataFrame:
    """available pieces that nobody works on, the rarest first, then the lowest."""
    return pieces.filter(F.col("availability") > 0).join(busy.select(key).distinct(), key, "left_anti").orderBy("availability", key)


def rotated(df: DataFrame, keys: Sequence[str], salt: str, *, tie: str) -> DataFrame:
    """one row of each key for an epoch, picked by a digest of salt and tie instead of chance."""
    return top_by(df, keys, 1, F.md5(F.concat(F.lit(salt), F.col(tie).cast("string"))), F.col(tie))


def ranked_peers(peers: DataFrame, rate: str, rtt: str, tie: str) -> DataFrame:
    """F8: healthy peers by success rate in steps of a tenth, then round trip."""
    return peers.filter(F.col(rate) > 0.5).orderBy(F.desc(F.floor(F.col(rate) * 10)), rtt, tie)


def moved(rows: DataFrame, key: str, position: str, item, to: int) -> DataFrame:
    """positions after item has moved to place `to` (from 0); the others keep their order."""
    others = W.orderBy(F.when(F.col(key) == item, 1).otherwise(0), position, key)
    place = F.row_number().over(others) - 1
    shifted = F.when(F.col(key) == item, F.lit(to)).otherwise(place + F.when(place >= to, 1).otherwise(0))
    return rows.withColumn("new_position", shifted)


def missing(count: int, done: DataFrame, key: str = "piece") -> DataFrame:
    """Indices below count that are not done."""
    return done.sparkSession.range(count).select(F.col("id").cast("int").alias(key)).join(done.select(F.col(key).cast("int").alias(key)), key, "left_anti")


def tagged_union(parts: dict[str, DataFrame], tag: str = "status") -> DataFrame:
    """Rows of all parts with the name of theirs."""
    out = None
    for name, df in parts.items():
        rows = df.withColumn(tag, F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no parts")
    return out


# -- row changes (L, M): an append-only log and the view of its latest rows -------


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order; one sum by key, no window."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}") for c in rest))


def current(log: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: str) -> DataFrame:
    """Latest rows of keys whose last row is no tombstone."""
    return latest(log, keys, order).filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows without those whose key is gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def set_where(rows: DataFrame, column: str, value, test: Column) -> DataFrame:
    """Rows with value in column where test holds; changed marks them."""
    hit = F.coalesce(test, F.lit(False))
    return rows.withColumn("changed", hit).withColumn(column, F.when(F.col("changed"), F.lit(value)).otherwise(F.col(column)))


def changed_keys(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """For each key the names of columns that differ, nulls compared as values."""
    both = old.alias("o").join(new.alias("n"), key)
    names = F.array_compact(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns)))
    return both.select(key, names.alias("changed"))


def get_or_create(wanted: DataFrame, users: DataFrame) -> DataFrame:
    """The account of each sign-in by google_id, else by e-mail; created where there is none."""
    by_id = users.select("google_id", F.col("id").alias("_by_id"))
    by_mail = users.select("email", F.col("id").alias("_by_mail"))
    out = wanted.join(by_id, "google_id", "left").join(by_mail, "email", "left")
    return out.select("google_id", "email", F.coalesce("_by_id", "_by_mail").alias("id"), F.coalesce("_by_id", "_by_mail").isNull().alias("created"))


def registry(log: DataFrame, keys: Sequence[str], seen: str, now: Column, seconds: int) -> DataFrame:
    """Entries of a registry: the latest row of each key that has not expired."""
    return fresh(latest(log, keys, [seen]), seen, now, seconds)


def queue_state(changes: DataFrame, key: str, order: Sequence[str], action: str) -> DataFrame:
    """M4: where each item of a queue stands after a log of add, start, pause, priority and remove.

    Starting raises the priority to high; an item whose last change removes it is gone.
    """
    last = changes.groupBy(key).agg(
        F.max_by(action, F.struct(*order)).alias("last"),
        F.max_by(F.when(F.col(action) == "start", "high").otherwise(F.col("priority")), F.when(F.col(action).isin("add", "start", "priority"), F.struct(*order))).alias("priority"),
        F.max_by(action, F.when(F.col(action).isin("add", "start", "pause"), F.struct(*order))).alias("moved"),
    )
    state = F.when(F.col("moved") == "start", "active").when(F.col("moved") == "pause", "paused").otherwise("queued")
    return last.filter("last <> 'remove'").select(key, state.alias("state"), "priority")


def problem_pieces(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], ok: Column, most: int = 10) -> DataFrame:
    """Failures of each piece since its last success, the peers that failed, and whether that makes it a problem."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    later = attempts.withColumn("_ok", ok).withColumn("_after", F.sum(F.col("_ok").cast("int")).over(w)).filter("_after = 0")
    out = later.groupBy(*keys).agg(F.count("*").alias("failures"), F.count_distinct("peer").alias("peers"))
    return out.withColumn("problem", F.col("failures") >= most)
