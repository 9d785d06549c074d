"""URL filters by rules and by empirical-Bayes host reputation.

Labelled page outcomes are counted by host. A host's rate of bad pages is shrunk towards its registered domain's, that
towards its suffix's, and that towards the rate of all pages; each step is a beta-binomial posterior whose prior
strength comes from the spread between the groups of that level (method of moments). A host is blocked where the lower
posterior bound of its rate is over a threshold. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Suffixes of two labels that registries hand names out under; every other suffix is the last label.
LONG_SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my",
    "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br",
    "net.cn", "net.nz", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk",
)
#: Prior strengths are kept within these bounds.
WEAKEST, STRONGEST = 1.0, 1000.0
MOST_RULES = 1000


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9.]+$|:")


def suffix(host: Column, long: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    """The last label of a host, or the last two where these are one of the ``long`` suffixes; none for an address of numbers."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), "").when(two.isin(*long), two).otherwise(F.substring_index(name, ".", -1))


def domain(host: Column, long: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label before it (the host itself if it has no more, or is an address)."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.isin(*long), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (action, host, path) that fits, as struct(rule, action); null if none does. At most 1000 rules."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def outcome_counts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Host, n labelled outcomes and how many of them are bad (toxic or of low quality), for every host of ``pages``.

    ``labels.doc_id`` names a page; each label row of it is an outcome, rows without any label count for nothing."""
    known = labels.where("toxic IS NOT NULL OR quality IS NOT NULL")
    by_page = known.groupBy(known.doc_id.alias("labelled")).agg(F.count("*").alias("n"), F.sum(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    seen = pages.select(pages.page_id.alias("page"), host(pages.url).alias("host"))
    return seen.join(by_page, seen.page == by_page.labelled, "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Rate of all outcomes, and the prior strength from the spread of rates between ``groups`` (key, n, bad)."""
    x = groups.where("n > 0").agg(F.sum("n").alias("n"), F.sum("bad").alias("b"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2")).first()
    if not x.n:
        return 0.0, STRONGEST
    m = x.b / x.n
    within = m * (1 - m)
    between = (x.b2 - x.n * m * m - (x.k - 1) * within) / max(x.n - x.n2 / x.n, 1.0)
    return m, min(max(within / between - 1, WEAKEST), STRONGEST) if between > 0 else STRONGEST


def reputation(counts: DataFrame, z: float = 1.645, long: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """Host, n, bad, posterior rate and its lower bound, from outcome_counts().

    ``long``: the suffixes of two labels. Hosts without outcomes take the rate of their domain. A host, domain or suffix of any share is one row here: the
    pages were aggregated before. Five sums go to the driver."""
    counts = stage(counts, "hosts").withColumns({"domain": domain(F.col("host"), long), "suffix": suffix(F.col("host"), long)})
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    base, ks = _strength(suffixes.select("suffix", F.col("sn").alias("n"), F.col("sb").alias("bad")))
    _, kd = _strength(domains.select("domain", F.col("dn").alias("n"), F.col("db").alias("bad")))
    _, kh = _strength(counts)
    suffixes = suffixes.select("suffix", ((F.col("sb") + base * ks) / (F.col("sn") + ks)).alias("sm"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("db") + F.col("sm") * kd) / (F.col("dn") + kd)).alias("dm"))
    rate = (F.col("bad") + F.col("dm") * kh) / (F.col("n") + kh)
    out = counts.join(domains, ["domain", "suffix"]).withColumn("rate", rate)
    return out.select("host", "n", "bad", "rate", (F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + kh + 1))).alias("lower_bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.4, z: float = 1.645) -> DataFrame:
    """Each row of ``pages`` with host, path, rule and verdict: the longest rule's, else block where the host's lower bound is over ``threshold``.

    Null or odd urls have an empty host and path and are judged as that host. Repeated rows are judged alike; an empty
    table gives none; other columns of ``pages`` don't matter and don't come along. Only blocked hosts are joined back."""
    blocked = reputation(outcome_counts(pages, labels), z).where(F.col("lower_bound") > threshold).select(F.col("host").alias("blocked"))
    blocked = stage(blocked, "blocked")  # a join of two plain shuffles is one whose hot hosts can be split
    judged = pages.select("page_id", host(pages.url).alias("host"), path(pages.url).alias("path"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")
    return judged.join(blocked, judged.host == blocked.blocked, "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", method).alias("verdict"))


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: The same judgement for DuckDB, with the rules and suffixes above.
ORACLE_SQL = (
    r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') path FROM pages),
l AS (SELECT doc_id, count(*) n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE n, coalesce(sum(bad), 0)::DOUBLE bad FROM p LEFT JOIN l ON doc_id = page_id GROUP BY host),
h2 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM h0),
h1 AS (SELECT *, string_split(bare, '.') parts, regexp_matches(bare, '^[0-9.]+$|:') AS number, array_to_string(parts[-2:], '.') IN (LONG_SUFFIXES) AS long FROM h2),
h AS (SELECT host, n, bad, CASE WHEN number THEN bare ELSE array_to_string(parts[CASE WHEN long THEN -3 ELSE -2 END:], '.') END AS dom, CASE WHEN number THEN '' ELSE array_to_string(parts[CASE WHEN long THEN -2 ELSE -1 END:], '.') END AS suf FROM h1),
d AS (SELECT dom, suf, sum(n) n, sum(bad) bad FROM h GROUP BY ALL),
s AS (SELECT suf, sum(n) n, sum(bad) bad FROM d GROUP BY ALL),
g AS (SELECT 'h' AS lev, n, bad FROM h UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s),
m AS (SELECT lev, sum(n) n, sum(bad) / sum(n) r, count(*) k, sum(n * n) n2, sum(bad * bad / n) b2 FROM g WHERE n > 0 GROUP BY lev),
v AS (SELECT lev, r, (b2 - n * r * r - (k - 1) * r * (1 - r)) / greatest(n - n2 / n, 1) AS bw FROM m),
k AS (SELECT lev, r, CASE WHEN bw > 0 THEN least(greatest(r * (1 - r) / bw - 1, 1.0), 1000.0) ELSE 1000.0 END k FROM v),
sm AS (SELECT suf, (bad + k.r * k.k) / (n + k.k) sm FROM s, k WHERE lev = 's'),
dm AS (SELECT dom, suf, (bad + sm * k.k) / (n + k.k) dm FROM d JOIN sm USING (suf), k WHERE lev = 'd'),
hm AS (SELECT host, n, (bad + dm * k.k) / (n + k.k) x, k.k FROM h JOIN dm USING (dom, suf), k WHERE lev = 'h'),
b AS (SELECT host FROM hm WHERE x - 1.645 * sqrt(x * (1 - x) / (n + k + 1)) > 0.4),
f AS (SELECT page_id, host, path,
        CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
             WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
             WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p)
SELECT page_id, f.host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM f LEFT JOIN b ON b.host = f.host
""".replace("LONG_SUFFIXES", ", ".join(f"'{x}'" for x in LONG_SUFFIXES))
)
