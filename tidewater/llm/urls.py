"""Operator 1 [native]: URL filter by rules and a character language-model ratio.

Two variable-order Markov models over characters, one of accepted and one of
rejected URLs (those a rule decides), interpolated over context lengths
0..ORDER in Witten and Bell's way:

    p_n(c | h) = (count(hc) + types(h) p_{n-1}(c | h')) / (count(h) + types(h)),

below order 0 uniform over the characters seen and one more. A URL's score is
ln p_accepted - ln p_rejected, summed over its characters and its end, divided
by their number. The threshold is calibrated on held-out URLs that rules
decide (by a digest, 3 of 16): where the sum of the two error rates is least, in the
middle of the gap between the scores on either side, the lowest such gap.

All of it is DataFrame operations. Every position of a URL gives one gram of
ORDER + 1 characters; lower orders are sums over grams with the same ending, so
URLs are exploded once to count and once to score, and both times sums are
taken within a task before rows are shuffled. The table of log ratios (a row
for each gram) is broadcast only if it has at most BROADCAST_ROWS rows; beyond
that it is joined by gram, both sides salted, as every URL of a host shares
grams.

Models read whole URLs, letter by letter: scheme, host, path, digits, query and
fragment. Rules look at host and path alone.

Edge cases: a null URL or one without `://` has an empty host and path and no
rule; it is scored like all others, a null as an empty string. If either model has no URL to learn
from or to calibrate on, every score is 0 and the verdict is allow. Repeated
URLs count as often as they occur; ties of rules go to the longer rule, then
to the first given; input columns with the names added here give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.store import keep, table, unused

#: (verdict, host, path), the form in which rules are given.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4
BROADCAST_ROWS = 100_000
SALTS = 16
#: Scores are counted by bins of this width, from -LIMIT to LIMIT, to calibrate.
BIN, LIMIT = 0.01, 10.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def judge(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and its verdict, null where no rule fits. Rules are the caller's list."""
    name = verdict = None
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    for i in order:
        kind, h, p = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def spelled(url: Column) -> Column:
    """What the models read: the whole URL."""
    return F.coalesce(url, F.lit(""))


def grams_of(text: Column, order: int) -> Column:
    """One gram of order + 1 characters for each character of text and for its end."""
    letters = F.regexp_extract_all(F.concat(F.lit("\x02" * order), text, F.lit("\x03")), F.lit("(?s)."), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.size(letters) - order), lambda i: F.array_join(F.slice(letters, i, order + 1), ""))


def ratios(counted: DataFrame, order: int) -> DataFrame:
    """gram and ratio from counts (gram, accepted, rejected) over all grams that are to be scored."""
    both = ("accepted", "rejected")
    # characters at order 0, counted once for both models: a row each
    letters = counted.groupBy(F.right("gram", F.lit(1)).alias("c")).agg(F.lit(1).alias("one")).agg(F.sum("one").alias("letters")).first()
    uniform = 1.0 / ((letters.letters or 0) + 1)
    out = counted.select("gram", *(F.lit(uniform).alias(f"p_{m}") for m in both))
    for n in range(order + 1):
        gram = counted.groupBy(F.right("gram", F.lit(n + 1)).alias("g")).agg(*(F.sum(m).alias(m) for m in both))
        context = gram.groupBy(F.expr(f"left(g, {n})").alias("h")).agg(*(F.sum(m).alias(f"n_{m}") for m in both), *(F.sum((F.col(m) > 0).cast("long")).alias(f"t_{m}") for m in both))
        level = gram.withColumn("h", F.expr(f"left(g, {n})")).join(context, "h").drop("h")
        out = out.withColumn("g", F.right("gram", F.lit(n + 1))).join(level, "g")
        mixed = {m: F.when(F.col(f"n_{m}") > 0, (F.col(m) + F.col(f"t_{m}") * F.col(f"p_{m}")) / (F.col(f"n_{m}") + F.col(f"t_{m}"))).otherwise(F.col(f"p_{m}")) for m in both}
        out = out.select("gram", *(mixed[m].alias(f"p_{m}") for m in both))
    return out.select("gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def score(texts: DataFrame, model: DataFrame, order: int, rows: int) -> DataFrame:
    """text and score for each row of texts (distinct); model: gram and ratio, with rows rows."""
    parts = texts.select("text", F.explode(grams_of(F.col("text"), order)).alias("gram"))
    if rows <= BROADCAST_ROWS:
        found = parts.join(F.broadcast(model), "gram")
    else:
        salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = parts.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    return found.groupBy("text").agg(F.round(F.sum("ratio") / F.count("*"), 6).alias("score"))


def threshold(scored: DataFrame) -> float | None:
    """Of score, verdict, n: the calibrated edge; None without URLs of both kinds. Bins, not URLs, are ordered."""
    place = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) / BIN).cast("int")
    bins = scored.groupBy(place.alias("bin")).agg(F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("b"))
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    wrong = bins.filter("a + b > 0").select("bin", F.lag("bin").over(W.orderBy("bin")).alias("last"), F.coalesce(F.sum("a").over(below), F.lit(0)).alias("lost"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("caught"), F.sum("a").over(every).alias("all_a"), F.sum("b").over(every).alias("all_b"))
    wrong = wrong.filter("all_a > 0 and all_b > 0").withColumn("errors", F.round(F.col("lost") / F.col("all_a") + 1 - F.col("caught") / F.col("all_b"), 9))
    best = wrong.orderBy("errors", "bin").select((F.coalesce(F.col("last") + 1, "bin") + F.col("bin")).alias("twice")).first()
    return None if best is None else best.twice * BIN / 2


ADDED = ("host", "path", "rule", "verdict", "score")


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """pages with host, path, rule, verdict and score."""
    text, told = unused(pages.columns, "_text", "_said")
    host, path = split_url(F.col(url))
    base = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in ADDED or c == url])
    base = base.withColumn(text, spelled(F.col(f"`{url}`"))).withColumn("host", host).withColumn("path", path)
    name, said = judge(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn(told, said)
    texts = base.groupBy(F.col(text).alias("text")).agg(*(F.sum(F.when(F.col(told) == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")))
    texts = keep(texts.withColumn("held", F.substring(F.md5("text"), 1, 1).isin("0", "1", "2")), "url-texts")
    learned = F.when(F.col("held"), 0)
    grams = texts.select(F.explode(grams_of(F.col("text"), order)).alias("gram"), learned.otherwise(F.col("allow")).alias("a"), learned.otherwise(F.col("block")).alias("b"))
    counted = keep(grams.groupBy("gram").agg(F.sum("a").alias("accepted"), F.sum("b").alias("rejected")), "url-grams")
    total = counted.agg(F.count("*").alias("n"), F.sum("accepted").alias("a"), F.sum("rejected").alias("b")).first()
    edge = None
    if total.a and total.b:
        model = keep(ratios(counted, order), "url-ratios")
        scores = keep(score(texts.select("text"), model, order, total.n), "url-scores")
        held = texts.filter("held").join(scores, "text")
        kinds = F.explode(F.array(*(F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in ("allow", "block"))))
        edge = threshold(held.select("score", kinds.alias("k")).select("score", "k.verdict", "k.n"))
    if edge is None:
        return base.withColumn("verdict", F.coalesce(told, F.lit("allow"))).withColumn("score", F.lit(0.0)).drop(told, text)
    judged = base.join(scores.withColumnRenamed("text", text), text, "left")
    own = F.when(F.col("score") >= edge, "allow").otherwise("block")
    return judged.withColumn("verdict", F.coalesce(told, own)).drop(told, text)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def _sql() -> str:
    fits = [(f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))", h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits)
    said = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    pad = "||".join(["chr(2)"] * ORDER)
    out = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS text, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, text, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said FROM h),
t AS (SELECT text, count(*) FILTER (said = 'allow') AS allow, count(*) FILTER (said = 'block') AS block, substr(md5(text), 1, 1) IN ('0', '1', '2') AS held FROM b GROUP BY text),
e AS (SELECT text, substr({pad} || text || chr(3), i, {ORDER + 1}) AS gram, CASE WHEN held THEN 0 ELSE allow END AS a, CASE WHEN held THEN 0 ELSE block END AS r
  FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM t)),
c AS (SELECT gram, sum(a) AS a, sum(r) AS r FROM e GROUP BY gram),
p AS (SELECT gram, 1.0::DOUBLE / ((SELECT count(DISTINCT right(gram, 1)) FROM c) + 1) AS pa, 1.0::DOUBLE / ((SELECT count(DISTINCT right(gram, 1)) FROM c) + 1) AS pr FROM c)"""
    last = "p"
    for n in range(ORDER + 1):
        out += f""",
g{n} AS (SELECT right(gram, {n + 1}) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1),
k{n} AS (SELECT left(g, {n}) AS h, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM g{n} GROUP BY 1),
p{n} AS (SELECT gram, CASE WHEN na > 0 THEN (g.a + ta * pa) / (na + ta) ELSE pa END::DOUBLE AS pa, CASE WHEN nr > 0 THEN (g.r + tr * pr) / (nr + tr) ELSE pr END::DOUBLE AS pr
  FROM {last} JOIN g{n} g ON g.g = right(gram, {n + 1}) JOIN k{n} k ON k.h = left(g.g, {n}))"""
        last = f"p{n}"
    return out + f""",
s AS (SELECT text, round(sum(ln(pa) - ln(pr)) / count(*), 6) AS score FROM e JOIN {last} USING (gram) GROUP BY text),
v AS (SELECT floor(greatest(-{LIMIT}, least({LIMIT}, score)) / {BIN})::INT AS bin, sum(allow) AS a, sum(block) AS b FROM t JOIN s USING (text) WHERE held AND allow + block > 0 GROUP BY 1),
w AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) + bin AS twice, round(coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(a) OVER () + 1
  - coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(b) OVER (), 9) AS errors FROM v),
z AS (SELECT twice * {BIN}::DOUBLE / 2 AS edge FROM w ORDER BY errors, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= edge THEN 'allow' ELSE 'block' END) AS verdict, score FROM b JOIN s USING (text) CROSS JOIN z
"""


ORACLE_SQL = {"op1_url_filter": _sql()}
