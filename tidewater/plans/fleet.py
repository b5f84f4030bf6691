"""Queries over the driver's tables, which stand for the fleet's.

customer: users; supplier: nodes; orders: transfers (F completed, O active, P
paused); lineitem: chunks and the peers that hold them; events: the lifecycle
stream (purchase completed, signup added, error failed, view progress, click
peer activity); documents: payloads; benchmark: stored content; pages: routes.
Times leave as text, so that both engines show them alike.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import aggregates as A
from tidewater.operators import metric_space as M
from tidewater.operators import promql as P
from tidewater.operators import relational as R
from tidewater.operators import windows as E
from tidewater.plans.registry import query
from tidewater.streaming import stateful as T



def is_type(name):
    return F.col("event_type") == name


def text(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


CHUNKS_SQL = """c AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp, max(l_quantity) AS quantity, max(l_extendedprice) AS price, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"""


def chunks(t):
    """lineitem with one row for each order and line."""
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.max("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.min("l_returnflag").alias("flag"))


def status(flag):
    """Chunk status of a return flag."""
    return F.when(flag == "N", "verified").when(flag == "A", "pending").otherwise("failed")


# -- aggregations --------------------------------------------------------------


@query("D3 I5 A1", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) FILTER (event_type = 'purchase') AS completions,
round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 8) AS total_bytes, round(coalesce(avg(value) FILTER (event_type = 'purchase'), 0), 8) AS average_speed FROM events GROUP BY 1""")
def hourly_rollup(t):
    return A.hourly(t.events, "ts", is_type("purchase"), "value").withColumn("hour", text("hour"))


@query("D3 D21", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'signup') AS added,
count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS progressed, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def hourly_rollup_full(t):
    kinds = {"completed": "purchase", "added": "signup", "failed": "error", "progressed": "view"}
    rows = t.events.withColumn("hour", F.date_trunc("hour", "ts"))
    return A.counted_by(rows, ["hour"], {k: is_type(v) for k, v in kinds.items()}, F.count_distinct("user_id").alias("users")).withColumn("hour", text("hour"))


@query("D4", """SELECT user_id, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 2) AS downloaded, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 2) AS uploaded, count(*) FILTER (event_type = 'purchase') AS completed,
count(*) FILTER (event_type = 'signup') AS added, round(coalesce(avg(value) FILTER (event_type = 'purchase'), 0), 8) AS average_speed,
round(CASE WHEN coalesce(sum(value) FILTER (event_type = 'view'), 0) > 0 THEN coalesce(sum(value) FILTER (event_type = 'purchase'), 0) / sum(value) FILTER (event_type = 'view') ELSE 0 END, 6) AS down_per_up FROM events GROUP BY 1""")
def user_rollup(t):
    return A.user_rollup(t.events, "user_id", is_type("purchase"), is_type("signup"), is_type("view"), "value")


@query("D5 D10 B4", """SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P",
round(sum(o_totalprice), 2) AS total_size, round(sum(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 40 ELSE 10 END / 100), 4) AS done_size FROM orders GROUP BY 1""")
def user_status_histogram(t):
    rows = t.orders.withColumn("progress", F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "O", 40).otherwise(10))
    return A.status_histogram(rows, "o_custkey", "o_orderstatus", ["F", "O", "P"], "o_totalprice", "progress")


@query("D1 D2 M24", "SELECT (SELECT count(*) FROM orders) AS transfers, (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'P')) AS open, (SELECT count(*) FROM customer) AS users")
def global_counts(t):
    one = t.orders.agg(F.count("*").alias("transfers"), F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("open"))
    # both sides are one row
    return one.join(F.broadcast(t.customer.agg(F.count("*").alias("users"))))


@query("D6 D7 D8 D36", "SELECT round(coalesce(sum(l_quantity), 0), 2) AS download_speed, round(coalesce(sum(l_extendedprice), 0), 2) AS total_size, count(*) AS \"rows\" FROM lineitem")
def live_totals(t):
    return A.totals(t.lineitem, {"download_speed": "l_quantity", "total_size": "l_extendedprice"})


@query("D9", "SELECT l_returnflag, round(sum(coalesce(nullif(floor(l_discount * 20), 0), nullif(l_quantity, 0), 0)), 2) AS peer_bytes, round(sum(coalesce(l_tax, 0)), 2) AS cloud_bytes, count(*) AS swarms FROM lineitem GROUP BY 1")
def egress_split(t):
    rows = t.lineitem.withColumn("peer", F.floor(F.col("l_discount") * 20).cast("double"))
    return A.egress(rows, "l_returnflag", "peer", "l_quantity", "l_tax")


@query("D16 D32 F9", """SELECT l_suppkey, count(*) AS attempts, count(*) FILTER (l_returnflag <> 'R') AS successes, round(count(*) FILTER (l_returnflag <> 'R') / count(*), 6) AS success_rate FROM lineitem GROUP BY 1""")
def success_rates(t):
    return A.success_rates(t.lineitem, "l_suppkey", F.col("l_returnflag") != "R")


@query("D17 D18 B9", "SELECT l_partkey, least(count(DISTINCT l_suppkey), 3) AS availability FROM lineitem GROUP BY 1")
def piece_availability(t):
    return A.availability(t.lineitem, "l_partkey", "l_suppkey", most=3)


@query("F5 D17", "SELECT l_partkey, availability FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS availability FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_partkey IS NOT NULL) GROUP BY 1) ORDER BY availability, l_partkey LIMIT 20")
def rarest_first(t):
    counts = A.availability(t.lineitem, "l_partkey", "l_suppkey")
    busy = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select("l_partkey")
    return R.rarest(counts, busy, "l_partkey").limit(20)


@query("D22", "SELECT user_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END)::BIGINT AS gauge FROM events GROUP BY 1")
def peer_gauge(t):
    return A.gauge(t.events, ["user_id"], is_type("signup"), is_type("error"))


@query("D23", "SELECT coalesce(max(greatest(0, date_diff('second', o_orderdate, TIMESTAMP '1998-08-02'))), 0)::BIGINT AS lag_seconds FROM orders WHERE o_orderstatus = 'O'")
def queue_lag(t):
    return A.lag_seconds(t.orders.filter(F.col("o_orderstatus") == "O"), "o_orderdate", F.lit("1998-08-02").cast("timestamp"))


@query("D25 E12 G4 F15", f"""WITH {CHUNKS_SQL}, s AS (SELECT *, CASE flag WHEN 'N' THEN 'verified' WHEN 'A' THEN 'pending' ELSE 'failed' END AS status FROM c)
SELECT l_orderkey, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (status = 'verified'), '') AS verified, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (status = 'pending'), '') AS pending,
coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (status = 'failed'), '') AS failed, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (status <> 'verified'), '') AS outstanding,
min(l_linenumber) FILTER (status <> 'verified') AS resume_at, bool_and(status = 'verified') AS complete FROM s GROUP BY 1""")
def chunk_resume(t):
    out = A.resume_state(chunks(t), "l_orderkey", "l_linenumber", status(F.col("flag")))
    return out.select("l_orderkey", *(F.array_join(c, ",").alias(c) for c in ("verified", "pending", "failed", "outstanding")), "resume_at", "complete")


@query("D26 H9 M15", """SELECT lang, count(*) AS total, count(*) FILTER (quality IS NOT NULL AND sha1(text)[1:1] < '8') AS valid, count(*) FILTER (quality IS NOT NULL AND sha1(text)[1:1] >= '8') AS invalid, count(*) FILTER (quality IS NULL) AS missing,
round(count(*) FILTER (quality IS NOT NULL AND sha1(text)[1:1] < '8') / count(*) * 100, 4) AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def verification_summary(t):
    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("low", F.substring(S.sha1_hex("text"), 1, 1) < "8")
    return A.verification(rows, ["lang"], F.when(F.col("quality").isNotNull(), F.col("low")), F.lit(True))


@query("D27 H48", """SELECT count(*) FILTER (b.h IS NOT NULL) AS hits, count(*) FILTER (b.h IS NULL) AS misses, coalesce(sum(n_chars) FILTER (b.h IS NOT NULL), 0)::BIGINT AS bytes,
printf('%.1f%%', count(*) FILTER (b.h IS NOT NULL) / count(*) * 100) AS hit_rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id AS h FROM labels WHERE quality = 1) b ON b.h = d.doc_id""")
def store_statistics(t):
    known = t.labels.filter("quality = 1").select("doc_id", F.lit(True).alias("known")).distinct()
    rows = t.documents.select("doc_id", "n_chars").join(known, "doc_id", "left")
    return A.store_stats(rows, F.col("known").isNotNull(), "n_chars")


@query("D28", "SELECT count(*) AS saved, sum(n_chars)::BIGINT AS saved_bytes, round(sum(n_chars) / 1048576, 2) AS saved_mib FROM (SELECT n_chars, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1")
def dedup_savings(t):
    from pyspark.sql import Window as W

    copies = t.documents.withColumn("r", F.row_number().over(W.partitionBy(S.sha256_hex("text")).orderBy("doc_id"))).filter("r > 1")
    return A.dedup_stats(copies, "n_chars")


@query("D29 H22 H23", """WITH s AS (SELECT p_partkey, (p_size * 1000003)::BIGINT AS size, CASE WHEN p_size * 1000003 < 67108864 THEN 262144 WHEN p_size * 1000003 < 536870912 THEN 524288 WHEN p_size * 1000003 < 2147483648 THEN 1048576 ELSE 2097152 END::BIGINT AS piece FROM part)
SELECT p_partkey, size, piece, ceil(size / piece)::BIGINT AS pieces, (size - (ceil(size / piece)::BIGINT - 1) * piece)::BIGINT AS last_piece FROM s""")
def piece_size_ladder(t):
    rows = t.part.select("p_partkey", (F.col("p_size").cast("long") * 1000003).alias("size")).withColumn("piece", S.piece_size("size"))
    rows = rows.withColumn("pieces", S.piece_count("size", "piece"))
    return rows.withColumn("last_piece", S.piece_length(F.col("pieces") - 1, "size", "piece"))


@query("D30 M16 M18", f"WITH {CHUNKS_SQL} SELECT l_orderkey, count(*) FILTER (quantity >= 5) AS needed, count(*) FILTER (quantity >= 5 AND flag = 'N') AS done, count(*) FILTER (quantity >= 5 AND flag = 'N') = count(*) FILTER (quantity >= 5) AS complete FROM c GROUP BY 1")
def completion_of_needed(t):
    return A.complete(chunks(t), "l_orderkey", F.col("flag") == "N", F.col("quantity") < 5)


@query("D31 D35", "SELECT event_type, count(*) AS total, count(*) FILTER (value > 50) AS large, count(*) FILTER (value <= 50) AS small FROM events GROUP BY 1")
def labelled_counters(t):
    return A.counted_by(t.events, ["event_type"], {"large": F.col("value") > 50, "small": F.col("value") <= 50})


@query("D33 D12", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS uploaded, round(sum(l_quantity), 2) AS downloaded, round(CASE WHEN sum(l_quantity) > 0 THEN sum(l_extendedprice) / sum(l_quantity) ELSE 0 END, 2) AS share FROM lineitem GROUP BY 1")
def peer_ratios(t):
    out = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("u"), F.sum("l_quantity").alias("d"))
    return out.select("l_suppkey", F.round("u", 2).alias("uploaded"), F.round("d", 2).alias("downloaded"), F.round(S.ratio("u", "d"), 2).alias("share"))


EDGES = (1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0)


@query("D34 K6", f"""WITH e AS (SELECT unnest([{", ".join(map(str, EDGES))}, NULL]::DOUBLE[]) AS le), b AS (SELECT event_type, le, count(*) FILTER (le IS NULL OR value <= le) AS n FROM events, e GROUP BY 1, 2),
w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(n) OVER o, 0) AS below, max(n) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS rank FROM b WINDOW o AS (PARTITION BY event_type ORDER BY le NULLS LAST))
SELECT event_type, round(coalesce(low + (le - low) * (rank - below) / (n - below), low), 6) AS quantile FROM w WHERE n >= rank AND below < rank""")
def latency_p95_hist(t):
    return P.histogram_quantile(A.histogram(t.events, ["event_type"], "value", EDGES), ["event_type"], 0.95)


@query("D37", """SELECT count(*) FILTER (s = 201) AS created, count(*) FILTER (s = 200) AS repeated, count(*) FILTER (s = 409) AS in_flight, count(*) FILTER (s >= 500) AS server_errors, count(*) FILTER (s NOT IN (200, 201, 409) AND s < 500) AS other,
round(quantile_cont(value, 0.99), 6) AS p99, (count(*) FILTER (s = 201) = 1 AND count(*) FILTER (s >= 500) = 0 AND quantile_cont(value, 0.99) < 3000) AS passed FROM (SELECT CASE WHEN event_id = 0 THEN 201 WHEN event_type = 'view' THEN 200 ELSE 409 END AS s, value FROM events)""")
def load_test_outcome(t):
    s = F.when(F.col("event_id") == 0, 201).when(is_type("view"), 200).otherwise(409)
    return A.outcome(t.events.withColumn("s", s), "s", "value")


@query("D20 C11", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_chunks(t):
    return t.documents.groupBy(S.sha256_hex("text").alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("sources")).filter("copies > 1")


@query("D13 D14", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 10) AS mean FROM events")
def rolling_mean(t):
    return E.mean_of_last(t.events, ["user_id"], ["ts", "event_id"], "value").select("event_id", "mean")


@query("D15 D14 M8", """WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS m, count(*) AS samples FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), o AS (SELECT l_suppkey, count(*) AS timeouts FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 GROUP BY 1)
SELECT l_suppkey, round(m, 4) AS mean_rtt, samples, coalesce(timeouts, 0) AS timeouts FROM m LEFT JOIN o USING (l_suppkey) WHERE m > 30000 OR coalesce(timeouts, 0) > 0""")
def slow_peers(t):
    failed = F.col("l_returnflag") == "R"
    out = A.slow_peers(t.lineitem.filter(~failed), t.lineitem.filter(failed & (F.col("l_quantity") > 48)), "l_suppkey", "l_extendedprice", 30000.0)
    return out.withColumn("mean_rtt", F.round("mean_rtt", 4))


# -- joins, sets, rankings ----------------------------------------------------


@query("C1 C2 C3 F1", f"""WITH {CHUNKS_SQL}, n AS (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS chunks FROM c GROUP BY 1)
SELECT o_orderkey, c_name, o_orderstatus, coalesce(chunks, '') AS chunks FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN n ON l_orderkey = o_orderkey""")
def transfers_list(t):
    rows = R.with_uploader(t.orders, t.customer, "o_custkey", "c_custkey", "c_name")
    out = R.nested(rows, chunks(t).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", ["l_linenumber"], "chunks")
    return out.select("o_orderkey", "c_name", "o_orderstatus", F.array_join(F.transform("chunks", lambda c: c["l_linenumber"]), ",").alias("chunks"))


@query("B1 B3 B5", "SELECT o_orderkey AS _id, o_orderkey AS \"infoHash\", o_custkey AS uploaded_by, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 7")
def projected(t):
    rows = t.orders.filter((F.col("o_orderstatus") == "O") & (F.col("o_custkey") == 7))
    return rows.select(F.col("o_orderkey").alias("_id"), F.col("o_orderkey").alias("infoHash"), F.col("o_custkey").alias("uploaded_by"), F.col("o_orderstatus").alias("status"))


@query("A2 B2", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey = 42")
def point_lookup(t):
    return R.without(t.customer.filter("c_custkey = 42"), "c_acctbal")


@query("B7", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%'")
def search_by_name(t):
    return R.searched(t.part, "p_name", "re").select("p_partkey", "p_name")


@query("B8 A24 B10", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-03-01'")
def time_range(t):
    return R.between(t.orders, "o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-03-01").cast("timestamp_ntz")).select("o_orderkey", "o_totalprice")


@query("B13 B12", "SELECT o_orderkey FROM orders WHERE CASE o_orderstatus WHEN 'P' THEN 'paused' WHEN 'F' THEN 'seeding' ELSE 'downloading' END NOT IN ('paused', 'stopped', 'error') AND o_custkey <> 1")
def active_transfers(t):
    state = F.when(F.col("o_orderstatus") == "P", "paused").when(F.col("o_orderstatus") == "F", "seeding").otherwise("downloading")
    return R.active(t.orders.withColumn("state", state)).filter("o_custkey <> 1").select("o_orderkey")


@query("B16", """SELECT l_suppkey, l_linenumber FROM (SELECT l_suppkey, l_linenumber, avg(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS r, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) WHERE (n > 10 AND r < 0.3) OR q < 24""")
def unhealthy_peers(t):
    rows = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.avg(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("success_rate"), F.count("*").alias("samples"), (F.avg("l_quantity") < 24).alias("slow"))
    return R.unhealthy(rows).select("l_suppkey", "l_linenumber")


REQUEST_IDS_SQL = "CASE event_id % 5 WHEN 0 THEN 'req-' || event_id WHEN 1 THEN 'a b' WHEN 2 THEN '' WHEN 3 THEN repeat('x', 120 + (event_id % 20)::INT) END"


@query("B14", f"SELECT event_id, coalesce(regexp_full_match(id, '[a-zA-Z0-9_-]{{1,128}}'), false) AS valid FROM (SELECT event_id, {REQUEST_IDS_SQL} AS id FROM events)")
def valid_requests(t):
    """Well-formed, spaced, empty, overlong and absent ids."""
    k = F.col("event_id") % 5
    said = F.when(k == 0, F.concat(F.lit("req-"), F.col("event_id").cast("string"))).when(k == 1, "a b").when(k == 2, "").when(k == 3, F.repeat(F.lit("x"), (120 + F.col("event_id") % 20).cast("int")))
    return t.events.select("event_id", R.valid_request(said).alias("valid"))


@query("B15 L12 L6", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_mktsegment FROM customer""")
def patched_users(t):
    changes = t.customer.filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"))
    return R.patched(t.customer.select("c_custkey", "c_name", "c_mktsegment"), changes, "c_custkey", ["c_name"])


@query("B18", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 2) END AS seeding_bytes, CASE WHEN o_orderstatus = 'O' THEN 40 END AS progress FROM orders")
def optional_projection(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s == "F", F.round("o_totalprice", 2)).alias("seeding_bytes"), F.when(s == "O", 40).alias("progress"))


@query("B6 C8 F2 L13", """SELECT event_id, user_id, event_type FROM events WHERE user_id = 3 OR user_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 AND o_custkey IS NOT NULL) ORDER BY ts DESC, event_id DESC LIMIT 100""")
def activity_history(t):
    owned = t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("user_id"), F.lit(True).alias("own")).distinct()
    rows = t.events.join(owned, "user_id", "left").filter((F.col("user_id") == 3) | F.col("own"))
    return R.top(rows, 100, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "event_type")


@query("C4 C7", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def chunks_of_paused(t):
    parents = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.children_of(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), parents, "l_orderkey")


@query("C5 E13 M25", """WITH v AS (SELECT user_id, arg_max(value, (ts, event_id)) AS speed FROM events GROUP BY 1)
SELECT c_custkey, round(coalesce(speed, c_acctbal), 4) AS c_acctbal, speed IS NOT NULL AS is_live FROM customer LEFT JOIN v ON user_id = c_custkey""")
def merge_live(t):
    live = R.latest(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"]).select(F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"))
    out = R.overlaid(t.customer.select("c_custkey", "c_acctbal"), live, "c_custkey", ["c_acctbal"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("C6", "SELECT o_orderkey, n FROM orders JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = o_custkey")
def live_only(t):
    live = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return t.orders.join(live, F.col("o_custkey") == F.col("user_id")).select("o_orderkey", "n")


@query("C9", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def orphans_anti(t):
    return R.orphans(t.customer.select("c_custkey"), t.orders.filter("o_orderstatus = 'P'"), "c_custkey", "o_custkey")


@query("C10 I11", """SELECT o_orderkey, 'queued' AS status, 'JOB_ASSIGNED' AS type FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-06-01')""")
def zombie_sweep(t):
    leases = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("expires_at"))
    return R.recovery(t.orders.withColumnRenamed("o_orderstatus", "status"), leases, "o_orderkey", F.lit("1997-06-01").cast("timestamp_ntz"), ["O", "P"])


@query("C11 B9", "SELECT d.doc_id FROM documents d WHERE sha256(d.text) IN (SELECT sha256(e.text) FROM documents e JOIN labels USING (doc_id) WHERE quality = 0)")
def dedup_prepopulate(t):
    store = t.documents.join(t.labels.filter("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi").select(S.sha256_hex("text").alias("sha256"))
    return R.stored(t.documents.select("doc_id", S.sha256_hex("text").alias("chunk_hash")), store).select("doc_id")


@query("C12 L5 M32", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_nationkey, upper(n_name), n_regionkey FROM nation WHERE n_regionkey >= 3")
def upsert_insert(t):
    old = t.nation.filter("n_regionkey < 3")
    return R.inserted(old, t.nation.withColumn("n_name", F.upper("n_name")), ["n_nationkey"])


@query("L11", """WITH u AS (SELECT c_custkey AS id, 'g-' || c_custkey AS google_id, lower(c_name) AS email FROM customer WHERE c_custkey % 2 = 0), w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'g-' || o_custkey ELSE 'h-' || o_orderkey END AS google_id, lower('Customer#' || lpad((o_custkey + 1)::VARCHAR, 9, '0')) AS email FROM orders)
SELECT w.google_id, w.email, coalesce(a.id, b.id) AS id, coalesce(a.id, b.id) IS NULL AS created FROM w LEFT JOIN u a ON a.google_id = w.google_id LEFT JOIN u b ON b.email = w.email""")
def signed_in(t):
    users = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("g-"), F.col("c_custkey").cast("string")).alias("google_id"), F.lower("c_name").alias("email"))
    known = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("g-"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("h-"), F.col("o_orderkey").cast("string")))
    mail = F.lower(F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 1).cast("string"), 9, "0")))
    return R.get_or_create(t.orders.select(known.alias("google_id"), mail.alias("email")), users)


@query("C13 G6", "SELECT DISTINCT l_partkey, l_linenumber FROM lineitem WHERE (l_partkey, l_linenumber) NOT IN (SELECT l_partkey, l_linenumber FROM lineitem WHERE l_quantity > 45)")
def new_peers(t):
    known = t.lineitem.filter("l_quantity > 45")
    return R.unknown(t.lineitem.select("l_partkey", "l_linenumber"), known, "l_partkey", "l_linenumber")


@query("C15", f"WITH {CHUNKS_SQL} SELECT o_orderkey, count(part) AS leases FROM orders LEFT JOIN c ON l_orderkey = o_orderkey AND flag = 'A' GROUP BY 1")
def zip_by_key(t):
    own = chunks(t).filter("flag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "part")
    return t.orders.select("o_orderkey").join(own, "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("part").alias("leases"))


@query("F3 F15 G4", f"WITH {CHUNKS_SQL} SELECT l_orderkey, l_linenumber FROM c WHERE flag <> 'N' ORDER BY 1, 2 LIMIT 200")
def outstanding_first(t):
    return chunks(t).filter("flag <> 'N'").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(200)


PRIORITY_SQL = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 3 WHEN '3' THEN 2 ELSE 1 END"


def priority(x):
    return R.priority_weight(F.when(F.substring(x, 1, 1).isin("1", "2"), "high").when(F.substring(x, 1, 1) == "3", "normal").otherwise("low"))


@query("F4 E10 F14 M34", f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {PRIORITY_SQL} DESC, o_orderdate, o_orderkey) - 1 AS position, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {PRIORITY_SQL} DESC, o_orderdate, o_orderkey) <= 3 AS admitted FROM orders")
def priority_queue(t):
    out = E.admitted(t.orders, ["o_orderstatus"], 3, F.desc(priority(F.col("o_orderpriority"))), F.col("o_orderdate"), F.col("o_orderkey"))
    return out.select("o_orderkey", F.col("position").cast("long").alias("position"), "admitted")


@query("F6 F8 D16", """WITH r AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) AS rate, avg(l_extendedprice) AS rtt FROM lineitem GROUP BY 1)
SELECT l_suppkey, row_number() OVER (ORDER BY floor(rate * 10) DESC, round(rtt, 2), l_suppkey) AS rank FROM r WHERE rate > 0.5 ORDER BY rank LIMIT 50""")
def peer_ranking(t):
    from pyspark.sql import Window as W

    rows = t.lineitem.groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_returnflag") != "R", 1.0).otherwise(0.0)).alias("rate"), F.round(F.avg("l_extendedprice"), 2).alias("rtt"))
    best = R.ranked_peers(rows, "rate", "rtt", "l_suppkey").limit(50)
    order = W.orderBy(F.desc(F.floor(F.col("rate") * 10)), "rtt", "l_suppkey")
    return best.select("l_suppkey", F.row_number().over(order).cast("long").alias("rank"))


@query("F7 F12", """SELECT l_partkey, l_suppkey, rank FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) AS rank FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE rank <= 3""")
def unchoke_top3(t):
    sums = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return R.top_by(sums, ["l_partkey"], 3, F.desc("q"), F.col("l_suppkey")).select("l_partkey", "l_suppkey", F.col("rank").cast("long").alias("rank"))


@query("F7", "SELECT l_partkey, l_suppkey FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY md5('epoch-1' || l_suppkey), l_suppkey) AS r FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) WHERE r = 1")
def optimistic_slot(t):
    return R.rotated(t.lineitem.select("l_partkey", "l_suppkey").distinct(), ["l_partkey"], "epoch-1", tie="l_suppkey").select("l_partkey", "l_suppkey")


@query("F13", """WITH p AS (SELECT n_nationkey, row_number() OVER (ORDER BY CASE WHEN n_nationkey = 20 THEN 1 ELSE 0 END, n_nationkey) - 1 AS place FROM nation)
SELECT n_nationkey, CASE WHEN n_nationkey = 20 THEN 3 ELSE place + CASE WHEN place >= 3 THEN 1 ELSE 0 END END AS new_position FROM p""")
def manual_reorder(t):
    out = R.moved(t.nation, "n_nationkey", "n_nationkey", 20, 3)
    return out.select("n_nationkey", F.col("new_position").cast("long").alias("new_position"))


TARGET = "0123456789abcdef0123456789abcdef01234567"


def _word(x, i):
    return f"('0x' || substr({x}, {8 * i + 1}, 8))::BIGINT"


XOR_SQL = ", ".join(f"xor({_word('id', i)}, {_word(repr(TARGET), i)}) AS d{i}" for i in range(5))


@query("F10 H30", f"SELECT vec_id, id, d0, d1 FROM (SELECT vec_id, id, {XOR_SQL} FROM (SELECT vec_id, sha1(vec_id::VARCHAR) AS id FROM embeddings)) ORDER BY d0, d1, d2, d3, d4, id LIMIT 8")
def xor_knn(t):
    nodes = t.embeddings.select("vec_id", S.sha1_hex(F.col("vec_id").cast("string")).alias("id"))
    return M.nearest(nodes, TARGET).select("vec_id", "id", "d0", "d1")


@query("F11", f"SELECT id FROM (SELECT vec_id, id, {XOR_SQL} FROM (SELECT vec_id, sha1(vec_id::VARCHAR) AS id FROM embeddings WHERE vec_id % 2 = 1)) ORDER BY d0, d1, d2, d3, d4, id LIMIT 3")
def closest_unqueried(t):
    nodes = t.embeddings.select("vec_id", S.sha1_hex(F.col("vec_id").cast("string")).alias("id"))
    return M.nearest_unasked(nodes, nodes.filter("vec_id % 2 = 0"), TARGET).select("id")


BUCKET_SQL = "CASE " + " ".join(f"WHEN d{i} > 0 THEN {32 * (4 - i)} + length(bin(d{i})) - 1" for i in range(5)) + " ELSE 0 END"


@query("H31 D24 J2", f"""WITH b AS (SELECT id, c_custkey, {BUCKET_SQL} AS bucket FROM (SELECT c_custkey, id, {XOR_SQL} FROM (SELECT c_custkey, sha1(c_custkey::VARCHAR) AS id FROM customer))),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY c_custkey, id) AS r FROM b) WHERE r <= 8), s AS (SELECT bucket, count(*) AS n FROM k GROUP BY 1)
SELECT sum(n)::BIGINT AS nodes, count(*) AS buckets, count(*) FILTER (n >= 8) AS full, round(avg(n), 4) AS mean, (SELECT id FROM k ORDER BY c_custkey, id LIMIT 1) AS oldest, (SELECT id FROM k ORDER BY c_custkey DESC, id DESC LIMIT 1) AS newest FROM s""")
def kbucket_stats(t):
    nodes = t.customer.select(S.sha1_hex(F.col("c_custkey").cast("string")).alias("id"), "c_custkey")
    return M.table_stats(M.table(nodes, TARGET, "c_custkey", "c_custkey"))


@query("G1 G5", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' UNION SELECT p_partkey FROM part WHERE p_size > 40")
def distinct_union(t):
    return t.lineitem.filter("l_returnflag = 'N'").select("l_partkey").union(t.part.filter("p_size > 40").select("p_partkey")).distinct()


@query("G2 M5", "SELECT o_orderkey, 'active' AS status FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'paused' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'completed' FROM orders WHERE o_orderstatus = 'F'")
def states_union(t):
    return R.tagged_union({n: t.orders.filter(F.col("o_orderstatus") == s).select("o_orderkey") for n, s in (("active", "O"), ("paused", "P"), ("completed", "F"))})


@query("G3", "SELECT i::INT AS piece FROM range(300) r(i) WHERE i NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def missing_pieces(t):
    return R.missing(300, t.part.filter("p_size > 25").select(F.col("p_partkey").alias("piece")))


@query("L6 L9 M31 I17 M2", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def current_state(t):
    log = t.events.select("user_id", "ts", "event_id", "event_type", is_type("error").alias("gone"))
    return R.current(log, ["user_id"], ["ts", "event_id"], "gone").select("user_id", "event_id", "event_type")


@query("L7 L8", f"WITH {CHUNKS_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN flag = 'R' THEN 'A' ELSE flag END AS flag, flag = 'R' AS changed FROM c")
def conditional_reset(t):
    return R.set_where(chunks(t).select("l_orderkey", "l_linenumber", "flag"), "flag", "A", F.col("flag") == "R")


@query("L9 M33", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def cascade_delete(t):
    gone = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return R.deleted(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), gone, "l_suppkey")


@query("M38", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'n_name' ELSE '' END AS changed FROM nation")
def settings_changes(t):
    new = t.nation.withColumn("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return R.changed_keys(t.nation, new, "n_nationkey", ["n_name", "n_regionkey"]).withColumn("changed", F.array_join("changed", ","))


# -- ordered rows --------------------------------------------------------------


@query("E1 I6", """SELECT event_id, round(CASE WHEN max(epoch_us(ts)) OVER w > min(epoch_us(ts)) OVER w THEN sum(value) OVER w / ((epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6) ELSE 0 END, 4) AS speed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def speed_window(t):
    return E.trailing_speed(t.events, ["user_id"], "ts", "value", 86400.0).select("event_id", "speed")


@query("E2 D22", """SELECT event_id, gauge, max(gauge) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT event_id, user_id, ts, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS gauge FROM events)""")
def running_peers(t):
    change = F.when(is_type("signup"), 1).when(is_type("error"), -1).otherwise(0)
    return E.running(t.events, ["user_id"], ["ts", "event_id"], change).select("event_id", "gauge", "peak")


@query("E3", "SELECT doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars)::BIGINT AS start, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS \"end\" FROM documents")
def file_offsets(t):
    return E.offsets(t.documents.select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars").select("doc_id", "start", "end")


@query("H25 C14 H27", """WITH o AS (SELECT doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars)::BIGINT AS s, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS e FROM documents),
p AS (SELECT doc_id, s, e, unnest(generate_series(s // 1000, (e - 1) // 1000)) AS piece FROM o WHERE e > s) SELECT doc_id, piece, (least(e, (piece + 1) * 1000) - greatest(s, piece * 1000))::BIGINT AS shared FROM p""")
def file_piece_ranges(t):
    rows = E.offsets(t.documents.select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars")
    return R.pieces_of_files(rows, 1000).select("doc_id", "piece", F.col("shared").cast("long").alias("shared"))


@query("A18 E3", """WITH d AS (SELECT hex(encode(text)) AS h, doc_id FROM documents WHERE lang = 'en' AND text IS NOT NULL) SELECT sha256(unhex(substr(string_agg(h, '' ORDER BY doc_id), 10001, 60000))) AS sha256, 30000::INT AS bytes FROM d""")
def byte_ranges(t):
    """Bytes 5,000 to 35,000 of files laid end to end."""
    from tidewater.sources import content

    rows = t.documents.filter("lang = 'en' AND text IS NOT NULL").select("doc_id", "lang", F.encode("text", "UTF-8").alias("data")).withColumn("n", F.octet_length("data"))
    found = content.byte_range(E.offsets(rows, ["lang"], ["doc_id"], "n"), "data", 5000, 35000)
    return found.select(F.sha2("data", 256).alias("sha256"), F.octet_length("data").alias("bytes"))


@query("E4 I7 M36 B11", "SELECT user_id, event_id, age FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 60")
def speed_history_last60(t):
    return E.last_n(t.events, ["user_id"], 60, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", F.col("age").cast("long").alias("age"))


@query("E5", """SELECT event_id, n AS strikes, n >= 3 AS banned FROM (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)::BIGINT AS n FROM events)""")
def strike_bans(t):
    return E.strikes(t.events, ["user_id"], "ts", is_type("error"), 172800.0, 3).select("event_id", "strikes", "banned")


@query("E6", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::DOUBLE[] AS held, '-infinity'::DOUBLE AS until, false AS hit, 0::DOUBLE AS sec FROM e UNION ALL
SELECT user_id, n, CASE WHEN skip THEN held WHEN len(kept) >= 3 THEN [] ELSE kept END, CASE WHEN NOT skip AND len(kept) >= 3 THEN sec + 172800 ELSE until END, NOT skip AND len(kept) >= 3, sec
FROM (SELECT e.user_id, e.n, w.held, w.until, e.sec, e.sec < w.until AS skip, list_append(list_filter(w.held, lambda x: e.sec - x <= 432000), e.sec) AS kept FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT user_id, sec AS banned_at, until FROM w WHERE hit""")
def ban_intervals(t):
    return E.bans(t.events.filter(is_type("error")), "user_id", "ts", most=3, window_s=86400.0 * 5, ban_s=86400.0 * 2)


@query("E7 F9", """WITH i AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
r AS (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures FROM i)
SELECT event_id, failures, CASE WHEN failures >= 5 THEN 'ERROR' WHEN failures >= 2 THEN 'WARNING' ELSE 'WORKING' END AS state FROM r""")
def tracker_state(t):
    return E.failure_runs(t.events, ["user_id"], ["ts", "event_id"], ~is_type("error")).select("event_id", "failures", "state")


@query("E8 M19", """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT user_id, event_id, value, n, least(200::DOUBLE, value) AS granted, 200::DOUBLE - least(200::DOUBLE, value) AS tokens FROM e WHERE n = 1 UNION ALL
SELECT user_id, event_id, value, n, least(room, value), room - least(room, value) FROM (SELECT e.user_id, e.event_id, e.value, e.n, least(200::DOUBLE, w.tokens + 100::DOUBLE * 0.1::DOUBLE * (e.event_id - w.event_id)) AS room FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT user_id, event_id AS tick, value, round(granted, 6) AS granted FROM w""")
def token_bucket(t):
    rows = t.events.select("user_id", F.col("event_id").alias("tick"), "value")
    return E.token_bucket(rows, "user_id", "tick", "value", rate=100.0, capacity=200.0).withColumn("granted", F.round("granted", 6))


@query("E9 I7", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS at, event_type, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_sums(t):
    return E.per_second(t.events, ["event_type"], "ts", "value", "1 hour").withColumn("at", text("at"))


@query("E11", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def counter_deltas(t):
    return E.deltas(t.events, ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("delta", 6).alias("delta"))


@query("E14 M20", """WITH a AS (SELECT o_orderkey, o_custkey % 7 AS own, o_totalprice * 1000 / nullif(sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 0) AS part FROM orders)
SELECT o_orderkey, round(coalesce(part, 0), 6) AS allocated, round(CASE WHEN own > 0 AND part > 0 THEN least(own, part) WHEN own > 0 THEN own ELSE coalesce(part, 0) END, 6) AS effective FROM a""")
def share_allocation(t):
    rows = t.orders.withColumn("own", F.col("o_custkey") % 7)
    return E.shares(rows, ["o_orderstatus"], "o_totalprice", 1000.0, "own").select("o_orderkey", "allocated", "effective")


@query("E15 K5 K7 K10", """WITH i AS (SELECT event_type, ts, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS inc FROM (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS p FROM events))
SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS at, round(sum(inc) / 3600, 8) AS rate FROM i GROUP BY 1, 2""")
def counter_rate(t):
    return P.rate(t.events, ["event_type", "user_id"], ["event_type"], "ts", ["ts", "event_id"], "1 hour", 3600.0).withColumn("at", text("at"))


@query("K1 K2 K4 K9", "SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def instant_gauges(t):
    return P.instant(t.events.withColumn("at", F.struct("ts", "event_id")), ["event_type", "user_id"], "at")


@query("K3 K8", "SELECT event_type, round(sum(v), 4) AS value FROM (SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def summed_gauges(t):
    return P.summed(t.events.withColumn("at", F.struct("ts", "event_id")), ["event_type", "user_id"], ["event_type"], "at").withColumn("value", F.round("value", 4))


@query("I3 I16", """SELECT user_id, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS at, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def throttle_latest(t):
    return T.throttled(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "6 hours").select("user_id", text("at").alias("at"), "event_id")


@query("I8", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_requests(t):
    return R.top_by(t.events, ["user_id", "event_type"], 1, F.col("event_id")).select("user_id", "event_type", "event_id")


@query("I10 M7", "SELECT user_id, count(*) AS beats, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-02'")
def liveness(t):
    out = t.events.groupBy("user_id").agg(F.count("*").alias("beats"), F.max("ts").alias("seen"))
    return out.filter(F.col("seen") >= F.lit("2024-01-02").cast("timestamp_ntz")).select("user_id", "beats", text("seen").alias("last_seen"))


@query("I12 M6", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND date_diff('second', o_orderdate, TIMESTAMP '1998-08-02') > 30")
def timeouts(t):
    responses = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return E.unanswered(t.orders, responses, "o_orderkey", "o_orderdate", F.lit("1998-08-02").cast("timestamp"), 30).select("o_orderkey")


ALLOWED = {("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("view", "purchase"), ("purchase", "view")}


@query("I14", f"""SELECT event_id, previous, previous IS NULL OR previous = event_type OR (previous || '>' || event_type) IN ({", ".join(f"'{a}>{b}'" for a, b in sorted(ALLOWED))}) AS valid
FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)""")
def transition_audit(t):
    return E.transitions(t.events, ["user_id"], ["ts", "event_id"], "event_type", ALLOWED).select("event_id", "previous", "valid")


@query("I15", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS reached_at FROM events WHERE value >= 95 GROUP BY 1")
def endgame(t):
    return E.first_reached(t.events, ["user_id"], "ts", F.col("value") >= 95).withColumn("reached_at", text("reached_at"))


# -- scalar functions ----------------------------------------------------------


@query("H1 D35", """SELECT route, count(*) AS requests FROM (SELECT regexp_replace(regexp_replace(regexp_replace(split_part(url, '?', 1), '[0-9a-fA-F]{32,64}', ':hash', 'g'), '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}', ':id', 'g'), '/[0-9]+(/|$)', '/:id\\1', 'g') AS route FROM pages) GROUP BY 1""")
def route_normalize(t):
    return t.pages.groupBy(S.normalize_route("url").alias("route")).agg(F.count("*").alias("requests"))


@query("H2 H5 H6 H7 H8 M12", """SELECT o_orderkey, o_totalprice * 8 / 1e6 AS mbps, CASE WHEN o_orderstatus <> 'O' THEN -1 WHEN o_totalprice - 1000 <= 0 THEN 0 ELSE ceil((o_totalprice - 1000) / 17.0)::BIGINT END AS eta, least(100.0, CASE WHEN o_totalprice > 0 THEN 1000 / o_totalprice ELSE 0 END * 100) AS percentage,
round(0.7 * (o_orderkey % 5) / 10.0 + 0.3 * least(1.0, (o_orderkey % 80) / 50.0), 8) AS health, round(o_totalprice / 2.5, 6) AS speed FROM orders""")
def eta_health(t):
    state = F.when(F.col("o_orderstatus") == "O", "downloading").otherwise("seeding")
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        S.mbps("o_totalprice").alias("mbps"),
        S.eta(state, "o_totalprice", F.lit(1000.0), F.lit(17.0)).alias("eta"),
        S.progress("o_totalprice", F.lit(1000.0), F.lit(0.0), F.lit(0.0))["percentage"].alias("percentage"),
        F.round(S.swarm_health(key % 5, F.lit(10), key % 80), 8).alias("health"),
        F.round(S.average_speed("o_totalprice", F.lit(2500)), 6).alias("speed"),
    )


@query("H4", """SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS lasted FROM (SELECT o_orderkey, (o_totalprice * 100)::BIGINT // 1000 AS s FROM orders)""")
def durations(t):
    return t.orders.select("o_orderkey", S.format_duration(F.round(F.col("o_totalprice") * 100).cast("long")).alias("lasted"))


@query("H3", """SELECT doc_id, CASE WHEN n = 0 THEN '0 B' ELSE rtrim(rtrim(printf('%.2f', round(n / pow(1024, floor(ln(n) / ln(1024))), 2)), '0'), '.') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][floor(ln(n) / ln(1024))::INT + 1] END AS size FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)""")
def byte_sizes(t):
    return t.documents.select("doc_id", S.format_bytes(F.col("n_chars") * 37).alias("size"))


@query("H9 H15 H39 H32", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, substr(sha1(text), 1, 12) AS label, substr(sha1(doc_id || 'secret'), 1, 16) AS token FROM documents")
def digests(t):
    return t.documents.select("doc_id", S.normalize_info_hash(S.sha1_hex("text")).alias("sha1"), S.sha256_hex("text").alias("sha256"), S.short_hash(S.sha1_hex("text")).alias("label"), S.token(F.col("doc_id").cast("string"), F.lit("secret")).alias("token"))


@query("H20 H21 H41", """SELECT page_id, substr(regexp_replace(regexp_replace(trim(url), '[/\\\\:*?"<>|]', '_', 'g'), '\\s+', ' ', 'g'), 1, 255) AS name, regexp_replace(split_part(url, '/', -1), '[^a-zA-Z0-9._-]', '_', 'g') AS file,
CASE WHEN split_part(url, '/', -1) <> '' THEN split_part(url, '/', -1) ELSE 'Magnet-' || substr(sha1(url), 1, 8) END AS display FROM pages""")
def safe_names(t):
    return t.pages.select("page_id", S.sanitize_name("url").alias("name"), S.safe_file_name("url").alias("file"), S.display_name("url", S.sha1_hex("url")).alias("display"))


@query("H24 M14", "SELECT p_partkey, unnest(range(0, (p_size * 5000 + 16383) // 16384)) * 16384 AS \"offset\", least(16384, p_size * 5000 - unnest(range(0, (p_size * 5000 + 16383) // 16384)) * 16384)::BIGINT AS length FROM part")
def piece_blocks(t):
    rows = t.part.select("p_partkey", F.explode(S.blocks(F.col("p_size").cast("long") * 5000)).alias("b"))
    return rows.select("p_partkey", F.col("b.offset").alias("offset"), F.col("b.length").alias("length"))


@query("H26 M17", f"WITH {CHUNKS_SQL} SELECT l_orderkey, floor(count(*) FILTER (flag = 'N') / count(*) * 100000)::BIGINT AS bytes FROM c GROUP BY 1")
def file_progress(t):
    out = chunks(t).groupBy("l_orderkey").agg(F.count_if(F.col("flag") == "N").alias("done"), F.count("*").alias("total"))
    return out.select("l_orderkey", S.file_progress("done", "total", F.lit(100000)).alias("bytes"))


@query("H28 H29 D19", f"""WITH {CHUNKS_SQL}, d AS (SELECT l_orderkey, sum(CASE WHEN flag = 'N' THEN 1 << (8 - l_linenumber) ELSE 0 END)::INT AS b, count(*) FILTER (flag = 'N') AS n, array_agg(l_linenumber - 1) FILTER (flag = 'N') AS done FROM c WHERE l_linenumber BETWEEN 1 AND 8 GROUP BY 1)
SELECT l_orderkey, lpad(printf('%X', b), 2, '0') AS bits, n::BIGINT AS set_bits, array_to_string(list_transform(range(8), lambda i: CASE WHEN list_contains(coalesce(done, []), i) THEN 2 ELSE 0 END), '') AS states FROM d""")
def bitfields(t):
    done = F.collect_list(F.when(F.col("flag") == "N", F.col("l_linenumber") - 1))
    rows = chunks(t).filter(F.col("l_linenumber").between(1, 8)).groupBy("l_orderkey").agg(done.alias("done"))
    bits = S.bitfield_hex("done", F.lit(8))
    none = F.array().cast("array<int>")
    return rows.select("l_orderkey", bits.alias("bits"), A.popcount(bits).cast("long").alias("set_bits"), F.array_join(S.tri_state("done", none, F.lit(8)), "").alias("states"))


@query("H33 H34 H35", """WITH m AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Request TIMEOUT 504' WHEN 'view' THEN 'invalid pstrlen' WHEN 'click' THEN 'Info hash differs, 404' WHEN 'signup' THEN 'ECONNRESET' ELSE 'else' END AS m FROM events)
SELECT event_id, CASE WHEN contains(lower(m), 'timeout') THEN 'timeout' WHEN contains(lower(m), 'protocol') OR contains(lower(m), 'invalid') OR contains(lower(m), 'pstrlen') THEN 'protocol_error' WHEN contains(lower(m), 'info hash') OR contains(lower(m), 'hash mismatch') THEN 'handshake_failed' ELSE 'connection_reset' END AS category,
CASE WHEN contains(lower(m), 'timeout') OR contains(lower(m), 'econnreset') OR m = 'else' THEN 'retry' ELSE 'skip' END AS action, NOT contains(m, '404') AS again FROM m""")
def error_categories(t):
    said = {"error": "Request TIMEOUT 504", "view": "invalid pstrlen", "click": "Info hash differs, 404", "signup": "ECONNRESET"}
    message = F.lit("else")
    for kind, words in said.items():
        message = F.when(is_type(kind), words).otherwise(message)
    rows = t.events.select("event_id", message.alias("m")).withColumn("category", S.error_category("m"))
    return rows.select("event_id", "category", S.error_action("category").alias("action"), S.retryable("m").alias("again"))


@query("H36 M11", "SELECT n_nationkey, least(5 * pow(2, n_nationkey), 300) AS delay FROM nation")
def backoff_delays(t):
    return t.nation.select("n_nationkey", S.backoff("n_nationkey", 5, 2, 300).alias("delay"))


@query("H37", """SELECT page_id, CASE WHEN e = '' THEN 'no_extension' WHEN e IN ('.html', '.pdf') THEN '' ELSE 'uncommon' END AS warnings FROM (SELECT page_id, lower(regexp_extract(split_part(url, '/', -1), '^.+(\\.[^.]*)$', 1)) AS e FROM pages)""")
def file_type_warnings(t):
    return t.pages.select("page_id", F.array_join(S.file_warnings("url"), ",").alias("warnings"))


@query("H38 H17", """SELECT c_custkey, CASE WHEN c_custkey % 70000 BETWEEN 1 AND 65535 THEN '10.0.0.' || (c_custkey % 250) END AS ip, CASE WHEN c_custkey % 70000 BETWEEN 1 AND 65535 THEN (c_custkey % 70000)::INT END AS port FROM customer""")
def peer_addresses(t):
    key = F.col("c_custkey")
    p = S.peer(F.concat(F.lit("10.0.0."), (key % 250).cast("string"), F.lit(":"), (key % 70000).cast("string")))
    back = S.compact_peers(S.encode_peer(p["ip"], p["port"]))
    return t.customer.select("c_custkey", F.get(back, 0)["ip"].alias("ip"), F.get(back, 0)["port"].alias("port"))


@query("H40", "SELECT o_orderkey, CASE WHEN o_totalprice / 100000 >= 2 THEN 'ratio_limit' WHEN o_custkey >= 120 THEN 'time_limit' END AS reason FROM orders")
def seeding_limits(t):
    return t.orders.select("o_orderkey", S.seeding_limit(F.col("o_totalprice") / 100000, "o_custkey", F.lit(0), 2, 120, 0).alias("reason"))


@query("H46", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def props_json(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("H47", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM orders")
def iso_times(t):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", S.iso(S.from_millis(ms)).alias("iso"))


@query("H13 H14", "SELECT p_partkey, sha1(p_name) AS topic, p_name AS name, 'http://t.example.net/a b' AS tracker FROM part")
def magnet_round_trip(t):
    link = S.magnet_link(S.sha1_hex("p_name"), "p_name", F.array(F.lit("http://t.example.net/a b")))
    rows = t.part.select("p_partkey", S.magnet_parts(link).alias("m"))
    return rows.select("p_partkey", "m.topic", "m.name", F.get("m.trackers", 0).alias("tracker"))


@query("H16", "SELECT n_nationkey, url_encode(n_name) AS quoted FROM nation")
def percent_encoded(t):
    return t.nation.select("n_nationkey", S.percent_encode(F.col("n_name").cast("binary")).alias("quoted"))


@query("B17", "SELECT event_id, event_type FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 12))::BIGINT % 10 = 0")
def sampled_events(t):
    return R.sampled(t.events, "event_id", 10).select("event_id", "event_type")


@query("M9 M35", "SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 5)")
def holders_of_piece(t):
    return R.children_of(t.supplier.select("s_suppkey"), t.lineitem.filter("l_partkey = 5").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey")


@query("M10 M22 M3", "SELECT count(*) AS peers, count(*) FILTER (r > 0.6) AS healthy, round(avg(r), 6) AS mean_rate FROM (SELECT l_suppkey, round(count(*) FILTER (l_returnflag <> 'R') / count(*), 6) AS r FROM lineitem GROUP BY 1)")
def peer_manager_stats(t):
    rates = A.success_rates(t.lineitem, "l_suppkey", F.col("l_returnflag") != "R")
    return rates.agg(F.count("*").alias("peers"), F.count_if(F.col("success_rate") > 0.6).alias("healthy"), F.round(F.avg("success_rate"), 6).alias("mean_rate"))


@query("M26", "SELECT doc_id, coalesce(quality::VARCHAR, source, 'single') AS resolved FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def file_list_fallback(t):
    live = t.labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return t.documents.join(live, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), "source", F.lit("single")).alias("resolved"))


@query("M27 M37", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F') AND o_totalprice > 100000")
def download_eligible(t):
    return t.orders.filter(F.col("o_orderstatus").isin("F") & (F.col("o_totalprice") > 100000)).select("o_orderkey")


@query("M29 M23 M30", "SELECT bool_and(ok) AS ready, count(*) FILTER (NOT ok) AS failing FROM (SELECT s_acctbal > -1000 AS ok FROM supplier)")
def readiness(t):
    ok = F.col("s_acctbal") > -1000
    return t.supplier.agg(F.bool_and(ok).alias("ready"), F.count_if(~ok).alias("failing"))


@query("A26 B11 E13", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def live_registry(t):
    newest = t.events.agg(F.max("ts").alias("m")).first().m
    log = t.events.select("user_id", "event_id", F.struct("ts", "event_id").alias("seen"), "ts")
    kept = R.latest(log, ["user_id"], ["seen"])
    return R.fresh(kept, "ts", F.lit(newest).cast("timestamp_ntz"), 12 * 3600).select("user_id", "event_id")


@query("M4 B3", """WITH a AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'start' WHEN 'click' THEN 'pause' WHEN 'error' THEN 'remove' ELSE 'priority' END AS action, CASE WHEN event_id % 2 = 0 THEN 'low' ELSE 'normal' END AS priority FROM events)
SELECT user_id, CASE arg_max(action, (ts, event_id)) FILTER (action IN ('add', 'start', 'pause')) WHEN 'start' THEN 'active' WHEN 'pause' THEN 'paused' ELSE 'queued' END AS state,
arg_max(CASE WHEN action = 'start' THEN 'high' ELSE priority END, (ts, event_id)) FILTER (action IN ('add', 'start', 'priority')) AS priority FROM a GROUP BY 1 HAVING arg_max(action, (ts, event_id)) <> 'remove'""")
def queue_after_changes(t):
    names = {"signup": "add", "view": "start", "click": "pause", "error": "remove"}
    action = F.lit("priority")
    for kind, name in names.items():
        action = F.when(is_type(kind), name).otherwise(action)
    log = t.events.select("user_id", "ts", "event_id", action.alias("action"), F.when(F.col("event_id") % 2 == 0, "low").otherwise("normal").alias("priority"))
    return R.queue_state(log, "user_id", ["ts", "event_id"], "action")


@query("I20", """WITH s AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM events)
SELECT user_id, count(*) AS failures, count(DISTINCT event_id % 3) AS peers, count(*) >= 2 AS problem FROM s WHERE after = 0 GROUP BY 1""")
def problem_pieces(t):
    rows = t.events.withColumn("peer", F.col("event_id") % 3)
    return R.problem_pieces(rows, ["user_id"], ["ts", "event_id"], ~is_type("error"), most=2)


@query("A22 M30", "SELECT event_type, 'events' AS name, count(*)::DOUBLE AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'largest', max(value) FROM events GROUP BY 1")
def gauge_rows(t):
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return P.gauges(rows, ["event_type"], {"events": "n", "largest": "most"})


@query("M21", "SELECT doc_id, CASE WHEN ceil(n_chars / 16384) > 0 THEN 1 / ceil(n_chars / 16384) ELSE 0 END AS progress FROM documents")
def metadata_progress(t):
    return t.documents.select("doc_id", S.metadata_progress(F.lit(1), "n_chars").alias("progress"))


@query("L1 L2 L3 L4 M28 H10 H43")
def artifact_links(t):
    """Names and links of metadata files built from the part table's names; bencoding has no SQL."""
    from tidewater.functions import codecs as K

    @F.pandas_udf("binary")
    def build(names: pd.Series) -> pd.Series:
        return names.map(lambda n: K.build_artifact(n, n.encode() * 10, 16, ["http://a.example.net", "http://b.example.net"]))

    rows = t.part.select("p_partkey", K.read_artifact(build("p_name")).alias("a"))
    return rows.select("p_partkey", "a.info_hash", F.size("a.pieces").alias("pieces"), K.artifact_magnet(F.col("a")).alias("link"))


@query("A25 L3 L4", "SELECT n_name AS name, (10 * strlen(n_name))::BIGINT AS length, 16::BIGINT AS piece_length, ((10 * strlen(n_name) + 15) // 16)::INT AS pieces, sha1(repeat(n_name, 10)[1:16]) AS first_piece, 'http://a.example.net' AS tracker, NULL::VARCHAR AS error FROM nation")
def artifact_files(t):
    """Metadata files written to a folder and read back, one for each nation's name ten times over."""
    from tidewater.functions import codecs as K
    from tidewater.session import fresh_path
    from tidewater.sources import content

    @F.pandas_udf("binary")
    def build(names: pd.Series) -> pd.Series:
        return names.map(lambda n: K.build_artifact(n, n.encode() * 10, 16, ["http://a.example.net"]))

    path = fresh_path(t.spark, "artifacts")
    content.put_artifacts(t.nation.select(build("n_name").alias("data")), path)
    read = content.artifacts(t.spark, path, "part-*")
    return read.select("name", "length", "piece_length", F.size("pieces").alias("pieces"), F.get("pieces", 0).alias("first_piece"), F.get("trackers", 0).alias("tracker"), "error")


@query("A17 A19 M13", """WITH d AS (SELECT hex(encode(text)) AS h FROM documents WHERE strlen(text) > 0), p AS (SELECT substr(h, i * 8192 + 1, 8192) AS h FROM (SELECT h, unnest(range(0, (length(h) + 8191) // 8192)) AS i FROM d))
SELECT sha256(unhex(h)) AS sha256, count(*) AS copies, max(length(h) // 2)::INT AS length FROM p GROUP BY 1""")
def chunk_store(t):
    """Pieces of all documents by content: hash, copies and length; each content once (hex digests of 4 KiB pieces)."""
    from tidewater.sources import content

    rows = t.documents.select("doc_id", F.col("text").cast("binary").alias("data"))
    pieces = content.pieces(rows, "data", 4096)
    return pieces.groupBy(F.sha2("bytes", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.max(F.octet_length("bytes")).alias("length"))


@query("A4 A5 M1", "SELECT sha1(user_id::VARCHAR) AS info_hash, user_id::VARCHAR AS user_id, event_id AS size, round(value, 4) AS average_speed FROM events WHERE event_type = 'purchase'")
def decoded_facts(t):
    """events as JSON messages and back: completions as facts."""
    from tidewater.sources import events as source

    body = F.to_json(F.struct(F.col("event_type").alias("name"), F.col("event_id").alias("size"), F.col("value").alias("averageSpeed")))
    kind = F.when(is_type("purchase"), "torrent:completed").when(is_type("signup"), "torrent:added").when(is_type("error"), "bad")
    rows = t.events.select(kind.alias("type"), F.sha1(F.col("user_id").cast("string").cast("binary")).alias("infoHash"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("user_id").cast("string").alias("userId"), body.alias("data"))
    good = source.accepted(source.decoded(source.messages(rows, "infoHash", "torrent-events")))
    return source.facts(good)["torrent_completions"].select("info_hash", "user_id", "size", F.round("average_speed", 4).alias("average_speed"))


@query("J1")
def iterative_lookup(t):
    """Nearest nodes found by asking neighbours; an iteration has no SQL."""
    node = lambda c: S.sha1_hex(c.cast("string"))
    steps = F.explode(F.array(*(F.lit(s) for s in (1, 2, 5, 11, 23, 47, 97))))
    rows = t.customer.select("c_custkey", steps.alias("s"))
    edges = rows.select(node(F.col("c_custkey")).alias("id"), node(F.col("c_custkey") % 150 + F.col("s")).alias("neighbour"))
    start = t.customer.filter("c_custkey = 1").select(node(F.col("c_custkey")).alias("id"))
    return M.lookup(edges, start, TARGET)


# -- messages, codecs and streams ---------------------------------------------


@query("A6 I1", "SELECT CASE event_type WHEN 'purchase' THEN 'TRANSFER_COMPLETED' WHEN 'signup' THEN 'JOB_ASSIGNED' WHEN 'error' THEN 'TRANSFER_FAILED' ELSE 'TRANSFER_PROGRESS' END AS type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1")
def directive_counts(t):
    from tidewater.sources import events as source

    kind = F.when(is_type("purchase"), "TRANSFER_COMPLETED").when(is_type("signup"), "JOB_ASSIGNED").when(is_type("error"), "TRANSFER_FAILED").when(is_type("view"), "TRANSFER_PROGRESS").otherwise("NOISE")
    rows = t.events.select(F.to_json(F.struct(kind.alias("type"), F.lit("{}").alias("payload"), F.col("event_id").alias("timestamp"))).alias("value"))
    return source.directives(rows).filter("problem is null").groupBy("type").agg(F.count("*").alias("n"))


@query("A8", "SELECT event_type AS topic, count(*) AS messages, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def messages_by_topic(t):
    from tidewater.sources import events as source

    out = source.messages(t.events.withColumn("topic", F.col("event_type")), "user_id")
    return out.groupBy("topic").agg(F.count("*").alias("messages"), F.count_distinct("key").alias("keys"))


@query("A16", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def state_documents(t):
    from tidewater.sources import events as source

    return source.imported(source.exported(t.nation), "n_nationkey int, n_name string, n_regionkey int")


@query("A15", "SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation")
def newest_valid_snapshot(t):
    """Of three snapshots the last is broken off: the one before it is read."""
    from tidewater.session import fresh_path
    from tidewater.sources import events as source

    folder = fresh_path(t.spark, "snapshots")
    source.saved(t.nation, folder, 1)
    source.saved(t.nation.withColumn("n_name", F.upper("n_name")), folder, 2)
    source.exported(t.nation).filter("value NOT LIKE '%:3,%'").selectExpr("replace(value, '}}', '}') AS value").write.text(f"{folder}/snapshot=3")
    return source.restored(t.spark, folder, "n_nationkey int, n_name string, n_regionkey int")


@query("A6 A7 A9", """SELECT CASE event_type WHEN 'purchase' THEN 'TRANSFER_COMPLETED' WHEN 'signup' THEN 'JOB_ASSIGNED' WHEN 'error' THEN 'TRANSFER_FAILED' ELSE 'STATS_UPDATE' END AS type, user_id::VARCHAR AS "key", 'torrent.jobs.dispatch' AS topic, count(*) AS n FROM events GROUP BY ALL""")
def directive_headers(t):
    """Directives whose type stands in a message header, and in the value where there is none; values go as they are."""
    from tidewater.schemas import TOPICS
    from tidewater.sources import events as source

    kind = F.when(is_type("purchase"), "TRANSFER_COMPLETED").when(is_type("signup"), "JOB_ASSIGNED").when(is_type("error"), "TRANSFER_FAILED")
    body = F.to_json(F.struct(F.lit("STATS_UPDATE").alias("type"), F.lit("{}").alias("payload"), F.col("event_id").alias("timestamp")))
    rows = t.events.select("user_id", kind.alias("type"), body.alias("body"))
    sent = source.messages(rows, "user_id", TOPICS["dispatch"], headers=("type",), raw="body")
    good = source.directives(sent.select("value", "headers", "key", "topic")).filter("problem is null").groupBy("type").agg(F.count("*").alias("n"))
    own = sent.select(F.coalesce(source.header("type"), F.lit("STATS_UPDATE")).alias("type"), "key", "topic").groupBy("type", "key", "topic").agg(F.count("*").alias("n"))
    return own.join(good.select("type"), "type", "left_semi")


@query("A10 A11 A12 A13 I19 I21", """WITH k AS (SELECT CASE event_type WHEN 'purchase' THEN 'torrent_completions' WHEN 'signup' THEN 'torrents' WHEN 'view' THEN 'torrent_progress_snapshots' WHEN 'click' THEN 'peer_connections' ELSE 'piece_completions' END AS fact, user_id, ts FROM events)
SELECT fact, count(*) AS "rows", count(DISTINCT user_id) AS users, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM k GROUP BY 1 UNION ALL SELECT 'torrent_events', count(*), count(DISTINCT user_id), strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events""")
def fact_tables(t):
    """What the fact tables hold after a stream of messages, of which a batch came twice."""
    from tidewater.session import fresh_path
    from tidewater.sources import events as source

    kinds = {"purchase": "torrent:completed", "signup": "torrent:added", "view": "torrent:progress", "click": "peer:connected", "error": "piece:completed"}
    kind = F.lit(None).cast("string")
    for name, wire in kinds.items():
        kind = F.when(is_type(name), wire).otherwise(kind)

    def sent(events):
        body = F.to_json(F.struct(F.col("event_id").alias("size"), F.col("event_id").cast("int").alias("pieceIndex")))
        rows = events.select(kind.alias("type"), F.sha1(F.col("user_id").cast("string").cast("binary")).alias("infoHash"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("user_id").cast("string").alias("userId"), body.alias("data"))
        return source.messages(rows, "infoHash", "torrent-events")

    path = fresh_path(t.spark, "facts")
    write = source.fact_sink(path)
    q = sent(event_stream(t)).writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    write(sent(t.events), 0)
    out = None
    for name in ("torrents", "torrent_completions", "torrent_progress_snapshots", "peer_connections", "piece_completions", "torrent_events"):
        rows = t.spark.read.parquet(f"{path}/{name}")
        at = "completed_at" if "completed_at" in rows.columns else "ts"
        one = rows.agg(F.lit(name).alias("fact"), F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), text(F.max(at)).alias("latest"))
        out = one if out is None else out.unionByName(one)
    return out


@query("H42", f"WITH {CHUNKS_SQL} SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INT AS place, 4::INT AS message, lpad(printf('%X', l_linenumber), 8, '0') AS payload FROM c")
def framed_messages(t):
    """Frames of a length, an id and a payload, put together and read back."""
    from tidewater.functions import codecs as K

    frame = F.concat(F.lit("0000000504"), F.lpad(F.hex("l_linenumber"), 8, "0"))
    rows = chunks(t).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(frame)).alias("f")).select("l_orderkey", F.unhex(F.array_join("f", "")).alias("data"))
    read = rows.lateralJoin(K.ReadFrames(F.col("data").outer()))
    return read.select("l_orderkey", "place", "message", F.hex("payload").alias("payload"))


@query("J4", "SELECT n_nationkey, b.bucket, true AS apart FROM nation, (SELECT unnest(range(0, 160, 7))::INT AS bucket) b")
def ids_for_buckets(t):
    """Ids made for buckets, and the bucket that each is in."""
    rows = t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(159), F.lit(7))).alias("wanted"))
    made = rows.withColumn("id", M.id_in_bucket(F.lit(TARGET), F.col("wanted"), F.concat(F.col("n_nationkey").cast("string"), F.lit("/"), F.col("wanted").cast("string"))))
    return made.select("n_nationkey", S.bucket_index(F.col("id"), F.lit(TARGET)).alias("bucket"), (F.col("id") != TARGET).alias("apart"))


LEASE_SQL = "CASE event_type WHEN 'signup' THEN 'acquire' WHEN 'purchase' THEN 'acquire' WHEN 'view' THEN 'renew' WHEN 'error' THEN 'release' END"


@query("I9", f"""WITH RECURSIVE e AS (SELECT (user_id % 7)::VARCHAR AS k, event_id AS seq, {LEASE_SQL} AS action, (event_id % 2)::VARCHAR AS who, 1 + event_id % 3 AS shown, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id % 7 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events WHERE event_type <> 'click'),
w AS (SELECT DISTINCT k, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::VARCHAR AS who, false AS ok, NULL::VARCHAR AS owner, 0::BIGINT AS token, 0::BIGINT AS ends FROM e UNION ALL
SELECT k, n, seq, action, who, ok, CASE WHEN NOT ok THEN owner WHEN action = 'release' THEN NULL ELSE who END, token, CASE WHEN NOT ok THEN ends WHEN action = 'release' THEN 0 ELSE ms + 3600000 END
FROM (SELECT *, CASE action WHEN 'acquire' THEN free OR owner = who ELSE NOT free AND owner = who AND shown = token END AS ok
FROM (SELECT e.k, e.n, e.seq, e.action, e.who, e.shown, e.ms, w.owner, w.ends, w.owner IS NULL OR w.ends <= e.ms AS free, w.token + CASE WHEN e.action = 'acquire' AND (w.owner IS NULL OR w.ends <= e.ms) THEN 1 ELSE 0 END AS token FROM w JOIN e ON e.k = w.k AND e.n = w.n + 1)))
SELECT k AS "key", seq, action, who AS owner, ok AS granted, CASE WHEN ok THEN token END AS token, CASE WHEN ok AND owner IS NOT NULL THEN ends END AS ends FROM w WHERE n > 0""")
def lease_stream(t):
    """Leases asked for, renewed and given back by a stream of requests."""
    from tidewater.session import fresh_path

    action = F.when(is_type("signup") | is_type("purchase"), "acquire").when(is_type("view"), "renew").when(is_type("error"), "release")
    rows = event_stream(t).select((F.col("user_id") % 7).cast("string").alias("key"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 2).cast("string").alias("owner"), (1 + F.col("event_id") % 3).alias("token"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return T.finished(T.leases(rows.filter("action is not null"), 3600000), fresh_path(t.spark, "leases"))


@query("D11 B9", f"WITH {CHUNKS_SQL} SELECT l_orderkey, count(*) AS files, count(*) FILTER (quantity > 25) AS selected FROM c GROUP BY 1")
def selected_files(t):
    return A.counted_by(chunks(t), ["l_orderkey"], {"selected": F.col("quantity") > 25}).withColumnRenamed("total", "files")


@query("H11 H12", "SELECT p_partkey, sha1(p_name) AS info_hash FROM part")
def base32_topics(t):
    from tidewater.functions import codecs as K

    rows = t.part.select("p_partkey", K.hex_base32(S.sha1_hex("p_name")).alias("topic"))
    return rows.select("p_partkey", K.info_hash(F.col("topic")).alias("info_hash"))


@query("H18 H19", "SELECT c_custkey, sha1(c_name) AS id, '10.1.' || (c_custkey % 200) || '.7' AS ip, (1 + c_custkey % 60000)::INT AS port FROM customer")
def node_addresses(t):
    key = F.col("c_custkey")
    data = F.unhex(F.concat(S.sha1_hex("c_name"), F.hex(S.encode_peer(F.concat(F.lit("10.1."), (key % 200).cast("string"), F.lit(".7")), 1 + key % 60000))))
    rows = t.customer.select("c_custkey", F.get(S.compact_nodes(data), 0).alias("n"))
    kept = S.listed_peers(F.array(F.struct("n.ip", "n.port")))
    return rows.select("c_custkey", "n.id", F.get(kept, 0)["ip"].alias("ip"), F.get(kept, 0)["port"].alias("port"))


@query("H44 M13", "SELECT doc_id, sha1(text) AS sha1 FROM documents WHERE strlen(text) > 0")
def reassembled(t):
    from tidewater.sources import content

    rows = t.documents.select("doc_id", F.col("text").cast("binary").alias("data"))
    parts = content.pieces(rows, "data", 16384).select("doc_id", (F.col("piece") * 16384).alias("offset"), F.col("bytes").alias("data"), F.col("piece").alias("seq"))
    return content.assembled(parts, "doc_id").select("doc_id", "sha1")


@query("H45", "SELECT n_nationkey, n_nationkey % 2 = 0 AS extended FROM nation")
def extension_flags(t):
    reserved = F.unhex(F.concat(F.lit("0000000000"), F.when(F.col("n_nationkey") % 2 == 0, "10").otherwise("00"), F.lit("0000")))
    return t.nation.select("n_nationkey", S.extension_bit(reserved).alias("extended"))


@query("I18 A23", "SELECT event_id, s_suppkey FROM events JOIN (SELECT s_suppkey, s_nationkey FROM supplier) ON s_nationkey = user_id % 25")
def fanned_out(t):
    subscribers = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("room"))
    return T.fan_out(t.events.select("event_id", (F.col("user_id") % 25).alias("room")), subscribers, "room").select("event_id", "s_suppkey")


@query("J3", f"""WITH b AS (SELECT c_custkey, {BUCKET_SQL} AS bucket FROM (SELECT c_custkey, {XOR_SQL} FROM (SELECT c_custkey, sha1(c_custkey::VARCHAR) AS id FROM customer))), u AS (SELECT bucket, max(c_custkey) AS seen FROM b GROUP BY 1)
SELECT coalesce(u.bucket, f.i::INT) AS bucket FROM u FULL JOIN range(155, 160) f(i) ON f.i = u.bucket WHERE seen IS NULL OR 2000 - seen > 900""")
def buckets_to_refresh(t):
    nodes = t.customer.select(S.sha1_hex(F.col("c_custkey").cast("string")).alias("id"), F.timestamp_seconds("c_custkey").alias("last_seen"))
    return M.stale_buckets(M.bucketed(nodes, TARGET), F.timestamp_seconds(F.lit(2000)))


@query("J5", f"SELECT id FROM (SELECT c_custkey, id, {BUCKET_SQL} AS bucket FROM (SELECT c_custkey, id, {XOR_SQL} FROM (SELECT c_custkey, sha1(c_custkey::VARCHAR) AS id FROM customer))) WHERE bucket = 158 ORDER BY c_custkey, id LIMIT 1")
def oldest_in_bucket(t):
    nodes = t.customer.select(S.sha1_hex(F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("last_seen"))
    return M.oldest(M.bucketed(nodes, TARGET), 158).select("id")


def event_stream(t):
    from tidewater.sources import events as source

    return source.file_stream(t.spark, t.folder, t.events.schema, "events.parquet")


@query("I2 I5 A3", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) FILTER (event_type = 'purchase') AS completions, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 6) AS total_bytes FROM events GROUP BY 1")
def hourly_stream(t):
    """The hourly rollup as a stream, run to the present end of its files."""
    from tidewater.session import fresh_path

    out = T.finished(T.hourly(event_stream(t), "ts", is_type("purchase"), "value"), fresh_path(t.spark, "hourly"), "complete")
    return out.select(text("hour").alias("hour"), "completions", F.round("total_bytes", 6).alias("total_bytes"))


@query("I8", "SELECT count(*) AS requests FROM (SELECT DISTINCT user_id FROM events)")
def idempotent_stream(t):
    """First requests of each id, as a stream that remembers them for a year."""
    from tidewater.session import fresh_path

    out = T.finished(T.first_requests(event_stream(t), "user_id", "ts", "365 days"), fresh_path(t.spark, "requests"))
    return out.agg(F.count("*").alias("requests"))
