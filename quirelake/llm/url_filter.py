"""URL filter by rules and by an empirical-Bayes reputation of hosts.

Labelled outcomes (good or bad) of pages are counted for each host. A host's
rate of good pages is shrunk by a beta prior towards that of its registered
domain, which is shrunk towards that of its suffix, which is shrunk towards
that of all pages. How strongly a level shrinks is estimated from the data: the
intraclass correlation of a one-way analysis of variance over the counts gives
the prior's weight. A host is blocked if even the upper bound of its posterior
(mean and Z standard deviations of the beta distribution) is below LEAST; hosts
without labelled pages so have their domain's mean and a wide bound.

Everything is DataFrame functions. Pages are counted by host before any join;
hosts of a domain that has a good part of all are joined with it in many tasks;
the host's verdict comes back by a broadcast for hosts with over a 256th of the
pages (at most 256 of them) and by a shuffled join for the others.

Null urls and urls without "://" have an empty host and path, which is a host
like any other. Repeated page_ids are rows of their own. Labels repeated for a
document count as bad if any is. User names and ports are no part of the host
that a reputation is of. Very long urls are strings like any other. Columns
other than page_id, url, doc_id, quality and toxic are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.joins import spread_join

from .common import table, written

#: verdict, host, start of the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels under which domains are registered; judge takes any other table of them.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "com.cn", "co.za")
Z = 1.645
LEAST = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F, F
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = text.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(kind))
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def bare_host(host: Column) -> Column:
    """The host without user name and port, for reputations only."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _suffix(host: Column, suffixes) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def _domain(host: Column, suffixes) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def _weight(groups: DataFrame) -> DataFrame:
    """One row: the weight of the beta prior for groups (n, good, parent, pn, pgood)."""
    g = groups.where("n > 0").select("n", F.try_divide("good", "n").alias("p"), F.try_divide("pgood", "pn").alias("pp"), "parent", "pn")
    s = g.agg(
        F.count("*").alias("k"), F.countDistinct("parent").alias("parents"), F.sum("n").alias("total"),
        F.sum(F.col("n") * (F.col("p") - F.col("pp")) * (F.col("p") - F.col("pp"))).alias("between"),
        F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("within"), F.sum(F.try_divide(F.col("n") * F.col("n"), F.col("pn"))).alias("squares"),
    )
    free = F.greatest(F.col("k") - F.col("parents"), F.lit(1))
    msb, msw = F.col("between") / free, F.col("within") / F.greatest(F.col("total") - F.col("k"), F.lit(1))
    size = (F.col("total") - F.col("squares")) / free
    s = s.select(msb.alias("msb"), msw.alias("msw"), size.alias("size"))
    below = F.col("msb") + (F.col("size") - 1) * F.col("msw")
    rho = F.when(below > 0, (F.col("msb") - F.col("msw")) / below).otherwise(F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(0.001)), F.lit(0.999))
    return s.select(((1 - rho) / rho).alias("weight"))


def reputations(hosts: DataFrame, z: float = Z, suffixes=LONG_SUFFIXES) -> DataFrame:
    """host, mean, upper from hosts (host, n labelled pages, good ones); suffixes: those of two labels."""
    bare = bare_host(F.col("host"))
    h = hosts.select("host", F.col("n").cast("double").alias("n"), F.col("good").cast("double").alias("good"), _domain(bare, suffixes).alias("domain"), _suffix(bare, suffixes).alias("suffix"))
    d = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    s = d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    pn, pgood = (F.lit(x or 0.0) for x in s.agg(F.sum("n"), F.sum("good")).first())
    up = lambda df, *keep: df.select(*keep, F.col("n").alias("pn"), F.col("good").alias("pgood"))
    level3 = s.select("*", pn.alias("pn"), pgood.alias("pgood"), F.lit("").alias("parent"))
    level2 = spread_join(d, up(s, "suffix"), ["suffix"]).withColumn("parent", F.col("suffix"))
    level1 = spread_join(h, up(d, "domain"), ["domain"]).withColumn("parent", F.col("domain"))
    w3, w2, w1 = (_weight(x).first()["weight"] for x in (level3, level2, level1))
    shrunk = lambda w, mean: (w * mean + F.col("good")) / (w + F.col("n"))
    # The mean of all pages itself has a uniform prior.
    s = level3.withColumn("suffix_mean", shrunk(w3, (F.col("pgood") + 1) / (F.col("pn") + 2))).select("suffix", "suffix_mean")
    d = spread_join(d, s, ["suffix"]).withColumn("domain_mean", shrunk(w2, F.col("suffix_mean"))).select("domain", "domain_mean")
    mean = shrunk(w1, F.col("domain_mean"))
    h = spread_join(h, d, ["domain"]).select("host", mean.alias("mean"), (w1 + F.col("n")).alias("weight"))
    return h.select("host", "mean", (F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, least: float = LEAST, suffixes=LONG_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, upper for pages (page_id, url); outcomes: page_id, good (boolean)."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = outcomes.groupBy("page_id").agg(F.min("good").alias("good"))
    counts = split.join(labels, "page_id", "left").groupBy("host").agg(F.count("*").alias("pages"), F.count("good").alias("n"), F.sum(F.coalesce(F.col("good").cast("int"), F.lit(0))).alias("good"))
    counts = written(counts, "hosts")
    judged = written(reputations(counts, z, suffixes).join(counts.select("host", "pages"), "host"), "reputations")
    total = judged.agg(F.sum("pages")).first()[0] or 0
    hot = F.broadcast(judged.where(F.col("pages") * 256 > total).select(F.col("host").alias("hot_host"), F.col("upper").alias("hot_upper")))
    cold = judged.where(F.col("pages") * 256 <= total).select(F.col("host").alias("key"), F.col("upper").alias("cold_upper"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    found = split.join(hot, F.col("host") == F.col("hot_host"), "left")
    own = F.concat(F.lit("\0"), F.xxhash64("page_id", "path").cast("string"))  # no host: keeps rows of hot hosts apart
    found = found.withColumn("key", F.when(F.col("hot_host").isNull(), F.col("host")).otherwise(own)).join(cold, "key", "left")
    found = found.withColumn("upper", F.coalesce("hot_upper", "cold_upper"))
    method = F.when(F.col("upper") < least, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "upper")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of the pages whose path names a labelled document: good if all its labels say good quality and none toxic."""
    number = F.regexp_extract(split_url(F.col("url"))[1], "^/[a-z]+/([0-9]+)", 1)
    named = pages.select("page_id", number.try_cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL")
    good = (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    marked = labels.where("doc_id IS NOT NULL AND coalesce(quality, toxic) IS NOT NULL").groupBy("doc_id").agg(F.min(good).alias("good"))
    return named.join(marked, "doc_id").select("page_id", "good")


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).drop("upper")


ORACLE = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
marked AS (SELECT doc_id, min(CASE WHEN coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE coalesce(quality, toxic) IS NOT NULL GROUP BY 1),
o AS (SELECT u.*, good FROM u LEFT JOIN marked ON try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT) = doc_id),
hosts AS (SELECT host, cast(count(good) AS DOUBLE) AS n, cast(coalesce(sum(good), 0) AS DOUBLE) AS good, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS p FROM o GROUP BY host),
two AS (SELECT *, CASE WHEN len(p) > 1 THEN p[-2] || '.' || p[-1] ELSE p[-1] END AS t FROM hosts),
h AS (SELECT host, n, good, CASE WHEN t IN {LONG_SUFFIXES} AND len(p) > 2 THEN p[-3] || '.' || t ELSE t END AS domain, CASE WHEN t IN {LONG_SUFFIXES} THEN t ELSE p[-1] END AS suffix FROM two),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
a AS (SELECT sum(n) AS n, sum(good) AS good FROM s),
g AS (SELECT 1 AS level, h.n, h.good / nullif(h.n, 0) AS p, d.good / nullif(d.n, 0) AS pp, d.n AS pn, h.domain AS parent FROM h JOIN d USING (domain)
  UNION ALL SELECT 2, d.n, d.good / nullif(d.n, 0), s.good / nullif(s.n, 0), s.n, d.suffix FROM d JOIN s USING (suffix)
  UNION ALL SELECT 3, s.n, s.good / nullif(s.n, 0), a.good / nullif(a.n, 0), a.n, '' FROM s, a),
m AS (SELECT level, sum(n * (p - pp) * (p - pp)) / greatest(count(*) - count(DISTINCT parent), 1) AS msb, sum(n * p * (1 - p)) / greatest(sum(n) - count(*), 1) AS msw, (sum(n) - sum(n * n / pn)) / greatest(count(*) - count(DISTINCT parent), 1) AS size FROM g WHERE n > 0 GROUP BY level),
r AS (SELECT level, least(greatest(coalesce(CASE WHEN msb + (size - 1) * msw > 0 THEN (msb - msw) / (msb + (size - 1) * msw) ELSE 0 END, 0), 0.001), 0.999) AS rho FROM m),
w AS (SELECT max((1 - rho) / rho) FILTER (level = 1) AS w1, max((1 - rho) / rho) FILTER (level = 2) AS w2, max((1 - rho) / rho) FILTER (level = 3) AS w3 FROM r),
sm AS (SELECT suffix, (w3 * (a.good + 1) / (a.n + 2) + s.good) / (w3 + s.n) AS mean FROM s, a, w),
dm AS (SELECT domain, (w2 * sm.mean + d.good) / (w2 + d.n) AS mean FROM d JOIN sm USING (suffix), w),
hm AS (SELECT host, (w1 * dm.mean + h.good) / (w1 + h.n) AS mean, w1 + h.n AS weight FROM h JOIN dm USING (domain), w),
v AS (SELECT host, CASE WHEN mean + {Z} * sqrt(mean * (1 - mean) / (weight + 1)) < {LEAST} THEN 'block' ELSE 'allow' END AS method FROM hm),
ru AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE method END AS verdict FROM ru JOIN v USING (host)
"""
