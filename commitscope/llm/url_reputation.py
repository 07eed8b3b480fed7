"""URL filtering by rules and by empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (good or bad) are counted per host. Rates are shrunk along all pages -> suffix -> registered
domain -> host: each level's prior is a beta distribution centred on the level above, with a strength fitted to the
spread of its children by the method of moments (beta-binomial). A page's host is blocked if the lower bound of its
posterior rate of bad pages (mean minus ``z`` standard deviations) is over ``most``. Hosts without labels take their
domain's bound, or else their suffix's, or else that of all labelled pages.

Labels are counted before any shuffle of pages, so a host with a third of all pages is a few partial sums. The counts of
hosts and each level's posteriors are written once and read by the level below; what stands above all suffixes is four
numbers, which the driver reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.llm._common import load, staged

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Public suffixes of two labels whose owners register third-level names: a default. ``read_suffixes`` reads a full list.
SUFFIXES2 = tuple(f"{a}.{b}" for b in ("uk", "jp", "nz", "za", "kr", "il") for a in ("co", "ac", "org", "gov")) + tuple(f"{a}.{b}" for b in ("au", "br", "cn", "tr", "mx", "sg") for a in ("com", "net", "org"))
Z, MOST, LOW, HIGH = 1.645, 0.5, 1.0, 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> F.Column:
    """What follows the first ``://``; empty for null and for urls without it."""
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))


def host(url: str) -> F.Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: str) -> F.Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """``(suffix, kind)`` of a public-suffix list file: a rule a line, ``*.`` and ``!`` rules included, ``//`` comments."""
    rule = F.lower(F.split(F.trim("value"), r"\s")[0])
    rows = spark.read.text(path).select(rule.alias("r")).filter("r <> '' and not startswith(r, '//')")
    kind = F.when(F.col("r").startswith("!"), "except").when(F.col("r").startswith("*."), "below").otherwise("plain")
    return rows.select(F.regexp_replace("r", r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind")).distinct()


def default_suffixes(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, SUFFIXES2))).alias("suffix"), F.lit("plain").alias("kind"))


def with_domain(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts(host, ...)`` with ``suffix`` and ``domain`` (the suffix and one label more), one row a host.

    The longest listed suffix holds; a host without one has its last label. A host that is a suffix is its own domain.
    Listed suffixes have at most eight labels.
    """
    parts = hosts.withColumn("labels", F.split("host", r"\."))
    last = parts.select("host", F.slice("labels", F.greatest(F.lit(1), F.size("labels") - 7), F.lit(8)).alias("last"))
    each = last.select("host", "last", F.posexplode("last").alias("i", "x"))
    each = each.select("host", F.size("last").alias("n"), "i", F.array_join(F.slice("last", F.col("i") + 1, F.size("last")), ".").alias("suffix"))
    found = each.join(suffixes, "suffix")
    # how many labels the suffix has: a plain rule its own, a rule below one more, an exception one less
    count = F.col("n") - F.col("i") + F.when(F.col("kind") == "below", 1).when(F.col("kind") == "except", -1).otherwise(0)
    size = found.groupBy("host").agg(F.coalesce(F.min(F.when(F.col("kind") == "except", count)), F.max(count)).alias("k"))
    k = F.least(F.coalesce("k", F.lit(1)), F.size("labels"))
    tail = lambda count: F.array_join(F.slice("labels", F.greatest(F.lit(1), F.size("labels") - count + 1), F.size("labels")), ".")
    return parts.join(size, "host", "left").withColumn("suffix", tail(k)).withColumn("domain", tail(k + 1)).drop("labels", "k")


def rule_columns(rules=RULES, h: str = "host", p: str = "path") -> tuple[F.Column, F.Column]:
    """(rule name, its verdict): the longest rule whose host is the host or a parent of it and whose path starts the path."""
    name = verdict = F.lit(None).cast("string")
    for what, rh, rp in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((F.col(h) == rh) | F.col(h).endswith(f".{rh}")) & F.col(p).startswith(rp)
        name, verdict = F.when(fits, F.lit(rh + rp)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _strength(w: F.Column, n: F.Column, k: F.Column, mean: F.Column) -> F.Column:
    """Prior strength from the spread of ``k`` children with ``n`` labels: w = sum of n (rate - mean)^2.

    E[w] = mean (1 - mean) (k + (n - k) rho), and the strength is 1 / rho - 1, between LOW and HIGH.
    """
    base = mean * (1 - mean)
    rho = F.when((base > 0) & (n > k), (w / base - k) / (n - k)).otherwise(0.0)
    return F.when(rho <= 1 / (1 + HIGH), F.lit(HIGH)).otherwise(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), 1 / rho - 1)))


def _posterior(child: DataFrame, key: str, z: float) -> DataFrame:
    """``(key, mean, lower)`` of rows ``(key, bad, n, up_mean, s)``: the posterior under the level above."""
    post, n = (F.col("bad") + F.col("s") * F.col("up_mean")) / (F.col("n") + F.col("s")), F.col("n") + F.col("s")
    return child.select(key, post.alias("mean"), _bound(post, n, z).alias("lower"))


def _bound(mean: F.Column, n: F.Column, z: float) -> F.Column:
    return mean - z * F.sqrt(mean * (1 - mean) / (n + 1))


def _below(child: DataFrame, key: str, up: str, above: DataFrame, z: float) -> DataFrame:
    """Posteriors of ``child(key, up, bad, n)`` under ``above(up, mean, lower)``: the spread of one parent's children is summed."""
    joined = child.join(above.select(up, F.col("mean").alias("up_mean")), up)
    gap = F.col("bad") / F.col("n") - F.col("up_mean")
    fit = joined.groupBy(up).agg(F.sum(F.col("n") * gap * gap).alias("w"), F.sum("n").alias("nn"), F.count(F.lit(1)).alias("k"), F.max("up_mean").alias("mu"))
    fit = fit.select(up, _strength(F.col("w"), F.col("nn"), F.col("k"), F.col("mu")).alias("s"))
    return staged(_posterior(joined.join(fit, up), key, z))


def levels(outcomes: DataFrame, suffixes: DataFrame, z: float = Z) -> tuple[DataFrame, DataFrame, DataFrame, float | None]:
    """Posteriors ``(key, mean, lower)`` of hosts, domains and suffixes, and the bound of all pages (None without labels).

    ``outcomes(host, bad)``: labelled pages, bad 0 or 1; null labels are ignored.
    """
    counted = outcomes.filter("bad is not null").groupBy("host").agg(F.sum(F.col("bad").cast("double")).alias("bad"), F.count(F.lit(1)).cast("double").alias("n"))
    hosts = staged(with_domain(staged(counted), suffixes))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    by_suffix = staged(domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    total = by_suffix.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = total.select(((F.col("bad") + 0.5) / (F.col("n") + 1)).alias("mean"), (F.col("n") + 1).alias("n"))
    mean, lower = total.select("mean", _bound(F.col("mean"), F.col("n"), z)).first()
    if mean is None:
        none = by_suffix.select("suffix", F.lit(0.0).alias("mean"), F.lit(0.0).alias("lower"))
        return none.withColumnRenamed("suffix", "host"), none.withColumnRenamed("suffix", "domain"), none, None
    gap = F.col("bad") / F.col("n") - F.lit(mean)
    fit = by_suffix.agg(F.sum(F.col("n") * gap * gap).alias("w"), F.sum("n").alias("nn"), F.count(F.lit(1)).alias("k"))
    s = fit.select(_strength(F.col("w"), F.col("nn"), F.col("k"), F.lit(mean))).first()[0]
    suffix_level = staged(_posterior(by_suffix.withColumn("up_mean", F.lit(mean)).withColumn("s", F.lit(s)), "suffix", z))
    domain_level = _below(domains, "domain", "suffix", suffix_level, z)
    return _below(hosts, "host", "domain", domain_level, z), domain_level, suffix_level, lower


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", most: float = MOST, suffixes: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row for every row of ``pages``.

    ``outcomes(page_id, bad)`` labels some pages; null labels are ignored, repeated ones each count. Null urls and urls
    without ``://`` have empty host and path, fit no rule and are allowed unless their (empty) host is blocked. Hosts
    under a domain without labels take the bound of their suffix, under a suffix without labels that of all labelled
    pages; with no labels at all they are allowed. ``suffixes(suffix, kind)`` as ``read_suffixes`` gives them; without
    it a short list of common suffixes of two labels holds. An empty table gives no rows.
    """
    suffixes = default_suffixes(pages.sparkSession) if suffixes is None else suffixes
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("u"))
    slim = slim.select("page_id", host("u").alias("host"), path("u").alias("path"))
    labelled = slim.join(outcomes.select(F.col("page_id").alias("id"), "bad"), F.col("page_id") == F.col("id"))
    known, by_domain, by_suffix, overall = levels(labelled.select("host", "bad"), suffixes)
    name, verdict = rule_columns(rules)
    # one row a host: the levels meet distinct hosts, so these joins do not follow a hot host
    bounds = with_domain(staged(slim.select("host").distinct()), suffixes)
    for key, level in (("host", known), ("domain", by_domain), ("suffix", by_suffix)):
        bounds = bounds.join(level.select(key, F.col("lower").alias(f"of_{key}")), key, "left")
    above = F.when(F.col("host") != "", F.coalesce("of_domain", "of_suffix", F.lit(overall).cast("double")))
    lower = F.coalesce("of_host", above, F.lit(0.0))
    blocked = staged(bounds.filter(lower > most).select("host", F.lit(True).alias("blocked")))
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return slim.join(blocked, "host", "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    Outcomes: the row of ``labels`` with the page's id; a page is bad if its quality is 0 or it is toxic.
    """
    labels = load(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)
    return judge(load(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


#: Written apart from the plan above: fixed values are spelled out, the part after ``://`` is split, levels are stacked.
SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
ends AS (SELECT page_id, rest, least(CASE strpos(rest, '?') WHEN 0 THEN length(rest) ELSE strpos(rest, '?') - 1 END,
    CASE strpos(rest, '#') WHEN 0 THEN length(rest) ELSE strpos(rest, '#') - 1 END) AS stop FROM cut),
front AS (SELECT page_id, left(rest, stop) AS site FROM ends),
slim AS (SELECT page_id, translate(split_part(site, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(site, length(split_part(site, '/', 1)) + 1) AS path FROM front),
named AS (SELECT DISTINCT host, string_split(host, '.') AS l,
    CASE WHEN list_contains(['co.uk', 'ac.uk', 'org.uk', 'gov.uk', 'co.jp', 'ac.jp', 'org.jp', 'gov.jp', 'co.nz', 'ac.nz', 'org.nz', 'gov.nz', 'co.za', 'ac.za', 'org.za',
        'gov.za', 'co.kr', 'ac.kr', 'org.kr', 'gov.kr', 'co.il', 'ac.il', 'org.il', 'gov.il', 'com.au', 'net.au', 'org.au', 'com.br', 'net.br', 'org.br', 'com.cn', 'net.cn',
        'org.cn', 'com.tr', 'net.tr', 'org.tr', 'com.mx', 'net.mx', 'org.mx', 'com.sg', 'net.sg', 'org.sg'], array_to_string(l[-2:], '.')) THEN 2 ELSE 1 END AS k FROM slim),
tree AS (SELECT host, array_to_string(l[-least(k, len(l)):], '.') AS suffix, array_to_string(l[-least(k + 1, len(l)):], '.') AS domain FROM named),
lab AS (SELECT host, suffix, domain, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END AS bad
    FROM slim JOIN labels ON page_id = doc_id JOIN tree USING (host)),
n0 AS (SELECT (sum(bad) + 0.5::DOUBLE) / (count(bad) + 1) AS m, count(bad) + 1 AS n FROM lab),
c1 AS (SELECT suffix AS k, '' AS up, sum(bad)::DOUBLE AS b, count(bad)::DOUBLE AS n, m AS u FROM lab, n0 WHERE bad IS NOT NULL GROUP BY ALL),
f1 AS (SELECT up, sum(n * (b / n - u) ** 2) AS w, sum(n) AS n, count(*) AS k, max(u) AS u FROM c1 GROUP BY up),
g1 AS (SELECT up, CASE WHEN u * (1 - u) > 0 AND n > k THEN (w / (u * (1 - u)) - k) / (n - k) ELSE 0 END AS r FROM f1),
p1 AS (SELECT c1.k, c1.n + s AS n, (b + s * u) / (c1.n + s) AS m FROM c1 JOIN (SELECT up, CASE WHEN r <= 1 / 1001.0::DOUBLE THEN 1000 ELSE greatest(1, least(1000, 1 / r - 1)) END AS s FROM g1) USING (up)),
c2 AS (SELECT domain AS k, suffix AS up, sum(bad)::DOUBLE AS b, count(bad)::DOUBLE AS n, m AS u FROM lab JOIN p1 ON p1.k = suffix WHERE bad IS NOT NULL GROUP BY ALL),
f2 AS (SELECT up, sum(n * (b / n - u) ** 2) AS w, sum(n) AS n, count(*) AS k, max(u) AS u FROM c2 GROUP BY up),
g2 AS (SELECT up, CASE WHEN u * (1 - u) > 0 AND n > k THEN (w / (u * (1 - u)) - k) / (n - k) ELSE 0 END AS r FROM f2),
p2 AS (SELECT c2.k, c2.n + s AS n, (b + s * u) / (c2.n + s) AS m FROM c2 JOIN (SELECT up, CASE WHEN r <= 1 / 1001.0::DOUBLE THEN 1000 ELSE greatest(1, least(1000, 1 / r - 1)) END AS s FROM g2) USING (up)),
c3 AS (SELECT host AS k, domain AS up, sum(bad)::DOUBLE AS b, count(bad)::DOUBLE AS n, m AS u FROM lab JOIN p2 ON p2.k = domain WHERE bad IS NOT NULL GROUP BY ALL),
f3 AS (SELECT up, sum(n * (b / n - u) ** 2) AS w, sum(n) AS n, count(*) AS k, max(u) AS u FROM c3 GROUP BY up),
g3 AS (SELECT up, CASE WHEN u * (1 - u) > 0 AND n > k THEN (w / (u * (1 - u)) - k) / (n - k) ELSE 0 END AS r FROM f3),
p3 AS (SELECT c3.k, c3.n + s AS n, (b + s * u) / (c3.n + s) AS m FROM c3 JOIN (SELECT up, CASE WHEN r <= 1 / 1001.0::DOUBLE THEN 1000 ELSE greatest(1, least(1000, 1 / r - 1)) END AS s FROM g3) USING (up)),
bound AS (SELECT host, coalesce(p3.m - 1.645 * sqrt(p3.m * (1 - p3.m) / (p3.n + 1)), CASE WHEN host = '' THEN 0 END, p2.m - 1.645 * sqrt(p2.m * (1 - p2.m) / (p2.n + 1)),
    p1.m - 1.645 * sqrt(p1.m * (1 - p1.m) / (p1.n + 1)), n0.m - 1.645 * sqrt(n0.m * (1 - n0.m) / (n0.n + 1)), 0) AS low
    FROM tree LEFT JOIN p3 ON p3.k = host LEFT JOIN p2 ON p2.k = domain LEFT JOIN p1 ON p1.k = suffix CROSS JOIN n0),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t (what, h, p)),
fit AS (SELECT host, path, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(what, length(h) + length(p)) AS what
    FROM (SELECT DISTINCT host, path FROM slim) JOIN rules ON ('.' || host) LIKE ('%.' || h) AND path LIKE (p || '%') GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(what, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM slim LEFT JOIN bound USING (host) LEFT JOIN fit USING (host, path)
"""
