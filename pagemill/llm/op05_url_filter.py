"""URL filters: rules first, then an empirical-Bayes reputation of the host.

Labelled outcomes of pages (bad or not) are counted by host, registered domain and suffix.
Rates are shrunk level by level: a suffix towards the overall rate, a domain towards its suffix, a
host towards its domain. The prior of each level is a beta distribution around the parent's
shrunken rate; its strength comes from the beta-binomial spread of the level's units about their
parents (method of moments: with Q the sum of n (p - m)^2 / (m (1 - m)) over J units with N
outcomes, the correlation is (Q - J) / (N - J)). A host is blocked if the lower bound of its
posterior, mean less Z standard deviations, lies above THRESHOLD: few outcomes, or a good
domain, leave the bound low.

A reputation is that of the host without its port. The suffix is the longest of SUFFIXES that it ends with, else its last label; the
registered domain has one label more. Numeric addresses are their own domain and suffix.

Counts are partial sums before each shuffle, so a host with a third of all pages is one row a
task. Pages meet the hosts' verdicts in an equi-join that adaptive execution can split.

A null url, or one without "://", has an empty host and path; no rule fits it and it shares the
reputation of the empty host. Repeated rows count as often as they occur. Without labels all
bounds are low and pages that no rule blocks are allowed. An empty table gives no rows; urls of any length are taken whole; columns
other than id and url are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import table, written

#: (rule, verdict); a rule is a host, then the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
Z = 1.645
THRESHOLD = 0.5
#: Of the correlation, so that a prior counts like 1 to 999 outcomes.
LEAST, MOST = 0.001, 0.5
#: Public suffixes of two labels under which domains are registered; a parameter of reputation().
SUFFIXES = (
    "ac.jp", "ac.uk", "asn.au", "blogspot.com", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co",
    "com.eg", "com.gr", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.pt", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.br", "edu.cn",
    "github.io", "gitlab.io", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "herokuapp.com", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "netlify.app", "or.jp", "or.kr",
    "org.au", "org.br", "org.cn", "org.in", "org.nz", "org.uk", "org.za", "pages.dev", "plc.uk", "vercel.app",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (of equally long ones the first in order), else null."""
    found = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return F.lit(None).cast("string") if found is None else found


def key_of(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def is_address(key: Column) -> Column:
    return key.rlike("^[0-9]{1,3}(\\.[0-9]{1,3}){3}$|^\\[")


def suffix_of(key: Column, suffixes=SUFFIXES) -> Column:
    two = F.substring_index(key, ".", -2)
    return F.when(is_address(key), key).when(two.isin(list(suffixes)), two).otherwise(F.substring_index(key, ".", -1))


def domain_of(key: Column, suffixes=SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it."""
    two = F.substring_index(key, ".", -2)
    return F.when(is_address(key), key).when(two.isin(list(suffixes)), F.substring_index(key, ".", -3)).otherwise(two)


def reputation(counts: DataFrame, z: float = Z, suffixes=SUFFIXES) -> DataFrame:
    """counts: host, n, bad (sums). Returns host, domain, suffix, n, bad, mean, lower (of the posterior)."""
    hosts = counts.select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "bad")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("m"))

    def shrunk(units: DataFrame) -> DataFrame:
        """units: n, bad and the parent's rate m; adds the posterior a, b and its mean."""
        seen = F.col("n") > 0
        q = F.sum(F.when(seen, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), F.lit(2.0)) / (F.col("m") * (1 - F.col("m")))))
        j = F.sum(F.when(seen, 1).otherwise(0))
        rho = F.when(F.sum("n") > j, (q - j) / (F.sum("n") - j)).otherwise(F.lit(MOST))
        s = units.agg((1 / F.least(F.greatest(rho, F.lit(LEAST)), F.lit(MOST)) - 1).alias("strength"))
        # one row each
        with_s = units.crossJoin(F.broadcast(s))
        a, b = F.col("strength") * F.col("m") + F.col("bad"), F.col("strength") * (1 - F.col("m")) + F.col("n") - F.col("bad")
        return with_s.withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).drop("strength", "m")

    suffixes = written(shrunk(suffixes.crossJoin(F.broadcast(total))).select("suffix", F.col("mean").alias("m")), "reputation-suffix")
    domains = written(shrunk(domains.join(suffixes, "suffix")).select("domain", F.col("mean").alias("m")), "reputation-domain")
    hosts = shrunk(hosts.join(domains, "domain"))
    a, b = F.col("a"), F.col("b")
    return hosts.withColumn("lower", F.col("mean") - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).drop("a", "b")


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD, z: float = Z, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the host's lower bound. outcomes: host, n, bad, any number of rows a host."""
    url = pages[url_col]
    p = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.withColumns({"rule": rule_for(F.col("host"), F.col("path"), rules), "key": key_of(F.col("host"))})
    all_hosts = p.select(F.col("key").alias("host"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    counts = outcomes.select(key_of(F.col("host")).alias("host"), "n", "bad").unionByName(all_hosts).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    known = reputation(written(counts, "reputation-counts"), z).select(F.col("host").alias("key"), F.col("lower").alias("bad_lower"))
    of_rule = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.lit(None)
    by_rule = F.element_at(of_rule, F.col("rule")) if rules else F.lit(None).cast("string")
    verdict = F.coalesce(by_rule, F.when(F.col("bad_lower") > threshold, "block").otherwise("allow"))
    return p.join(written(known, "reputation-hosts"), "key").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_lower")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, bad: a page's outcome is the label of the document that its path names by number;
    it is bad if the document is of low quality or toxic. Labels without either value are left out."""
    url = pages["url"]
    p = pages.select(host_of(url).alias("host"), F.try_to_number(F.regexp_extract(path_of(url), "^/[a-z]+/([0-9]{1,18})(?:[./]|$)", 1), F.lit("999999999999999999")).cast("long").alias("doc_id"))
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    known = labels.select(F.col("doc_id"), bad.cast("long").alias("bad")).where("doc_id is not null and bad is not null")
    known = known.groupBy("doc_id").agg(F.max("bad").alias("bad"))
    by = p.where("doc_id is not null").groupBy("doc_id", "host").agg(F.count(F.lit(1)).alias("k"))
    return by.join(known, "doc_id").groupBy("host").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("bad")).alias("bad"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return url_filter(pages, labelled_outcomes(pages, labels)).drop("bad_lower")


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS v(rh, rp, verdict)),
best AS (SELECT page_id, rh || rp AS rule, verdict FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp) = 1),
lab AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL AND greatest(1 - quality, toxic) IS NOT NULL GROUP BY doc_id),
o AS (SELECT regexp_replace(host, ':[0-9]*$', '') AS host, count(*) AS n, sum(bad)::BIGINT AS bad FROM p JOIN lab ON lab.doc_id = try_cast(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})(?:[./]|$)', 1) AS BIGINT) GROUP BY 1),
k AS (SELECT host, array_to_string(string_split(host, '.')[-3:], '.') AS three, array_to_string(string_split(host, '.')[-2:], '.') AS two, string_split(host, '.')[-1] AS one,
  regexp_matches(host, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\[') AS address FROM (SELECT DISTINCT regexp_replace(host, ':[0-9]*$', '') AS host FROM p)),
h AS (SELECT host, CASE WHEN address THEN host WHEN two IN (SUFFIXES) THEN three ELSE two END AS domain,
  CASE WHEN address THEN host WHEN two IN (SUFFIXES) THEN two ELSE one END AS suffix, coalesce(n, 0)::DOUBLE AS n, coalesce(bad, 0)::DOUBLE AS bad FROM k LEFT JOIN o USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM d, (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) AS m FROM d) GROUP BY suffix),
s2 AS (SELECT suffix, (k * m + bad) / (k + n) AS m FROM s, (SELECT 1 / least(greatest(CASE WHEN sum(n) > sum((n > 0)::INT)
  THEN (sum(CASE WHEN n > 0 THEN n * pow(bad / n - m, 2) / (m * (1 - m)) END) - sum((n > 0)::INT)) / (sum(n) - sum((n > 0)::INT)) ELSE 0.5 END, 0.001), 0.5)::DOUBLE - 1 AS k FROM s)),
d1 AS (SELECT d.*, m FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (k * m + bad) / (k + n) AS m FROM d1, (SELECT 1 / least(greatest(CASE WHEN sum(n) > sum((n > 0)::INT)
  THEN (sum(CASE WHEN n > 0 THEN n * pow(bad / n - m, 2) / (m * (1 - m)) END) - sum((n > 0)::INT)) / (sum(n) - sum((n > 0)::INT)) ELSE 0.5 END, 0.001), 0.5)::DOUBLE - 1 AS k FROM d1)),
h1 AS (SELECT h.*, m FROM h JOIN d2 USING (domain)),
h2 AS (SELECT host, k * m + bad AS a, k * (1 - m) + n - bad AS b FROM h1, (SELECT 1 / least(greatest(CASE WHEN sum(n) > sum((n > 0)::INT)
  THEN (sum(CASE WHEN n > 0 THEN n * pow(bad / n - m, 2) / (m * (1 - m)) END) - sum((n > 0)::INT)) / (sum(n) - sum((n > 0)::INT)) ELSE 0.5 END, 0.001), 0.5)::DOUBLE - 1 AS k FROM h1)),
h3 AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_bound FROM h2)
SELECT page_id, p.host, path, rule, coalesce(verdict, CASE WHEN lower_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id) JOIN h3 ON h3.host = regexp_replace(p.host, ':[0-9]*$', '')
""".replace("SUFFIXES", ", ".join(f"'{x}'" for x in SUFFIXES))
