"""URL filter: explicit host and path rules first, then empirical-Bayes host reputation.

Labelled pages are outcomes of their host. Each host's share of bad pages is shrunk
towards its registered domain, that towards the suffix, and that towards all pages,
by beta-binomial priors whose strength is estimated from the spread between hosts,
domains and suffixes. A host without labels has the posterior of its domain, suffix or all
pages. A host is blocked where even the lower bound of its posterior has LIFT times the odds
of a bad page over all pages. DataFrame functions only.
"""

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._shared import stage

#: rule -> verdict; the part before the first slash is a host, the rest the beginning of a path.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Public suffixes of two labels; all others count as one label. The default of a parameter: pass a full list where there is one.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
Z = 1.645
LIFT = 2.0
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null. Rules are a parameter: a few hundred at most."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def domain_of(host: Column, suffixes: Collection[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Registered domain: suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column, suffixes: Collection[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def limit_of(share: float, lift: float = LIFT) -> float:
    """The share of bad pages whose odds are lift times those of `share`."""
    return lift * share / (1 - share + lift * share)


def strengths(counts: DataFrame, least: float = 2.0, most: float = 10_000.0) -> tuple[float, dict[str, float]]:
    """Share of bad pages and, for each level, the prior's strength by the method of moments.

    With children of sizes n_i, shares p_i and pooled share p, the intra-class correlation
    is (S / (p (1-p)) - (k-1)) / (N - sum n_i^2 / N - (k-1)), S = sum n_i (p_i - p)^2; the
    strength is 1/correlation - 1. Everything is one row of sums of integers.
    """
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total.n:
        return 0.5, dict.fromkeys(LEVELS, least)
    p, out = total.bad / total.n, {}
    for level in LEVELS:
        s = counts.groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).agg(F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.try_divide(F.col("bad") * F.col("bad"), F.col("n"))).alias("xx")).first()
        spread = s.xx - total.bad * total.bad / total.n
        below = total.n - s.nn / total.n - (s.k - 1)
        rho = (spread / (p * (1 - p)) - (s.k - 1)) / below if 0 < p < 1 and below > 0 else 0
        out[level] = min(most, max(least, 1 / rho - 1)) if rho > 0 else most
    return p, out


def host_posteriors(outcomes: DataFrame, others: DataFrame | None = None, lift: float = LIFT, suffixes: Collection[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, n, bad, posterior_mean, posterior_low, limit of every host with a labelled page and of the `others`.

    outcomes: host string, bad int (1: the page is bad). Null outcomes must be gone. others: host
    string; without a labelled page (n = 0) a host has its domain's mean, that its suffix's and
    that the mean of all pages.
    """
    # Partial aggregation makes a row for each host and task, so one host with a third of all pages is no hot key.
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    if others is not None:
        unlabelled = others.select("host").distinct().select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
        hosts = hosts.unionByName(unlabelled).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = stage(hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}), "hosts")
    p, strength = strengths(hosts.where("n > 0"))
    above, parent = None, F.lit(p)
    for level in ("suffix", "domain"):
        k = strength[level]
        sums = hosts.groupBy(*LEVELS[: LEVELS.index(level) + 1]).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if above is not None:
            sums = sums.join(above, "suffix")
            parent = F.col("suffix_mean")
        keys = list(LEVELS[: LEVELS.index(level) + 1])
        above = stage(sums.select(*keys, ((F.col("bad") + F.lit(k) * parent) / (F.col("n") + F.lit(k))).alias(f"{level}_mean")), f"{level}-means")
    k = strength["host"]
    a = F.col("bad") + F.lit(k) * F.col("domain_mean")
    size = F.col("n") + F.lit(k)
    mean = a / size
    low = mean - F.lit(Z) * F.sqrt(mean * (1 - mean) / (size + 1))
    return hosts.join(above, ["suffix", "domain"]).select("host", "n", "bad", mean.alias("posterior_mean"), F.greatest(low, F.lit(0.0)).alias("posterior_low"), F.lit(limit_of(p, lift)).alias("limit"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES, lift: float = LIFT, suffixes: Collection[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """id, host, path, rule, verdict, posterior_low: a row for each row of pages.

    outcomes: (id, bad) labels of pages; several labels of a page and repeated pages count each,
    null ids and null labels not at all. Where no rule fits, a host without a labelled page is
    judged by the posterior that it inherits; the empty host of null and malformed urls inherits
    none and is allowed unless its labelled pages block it.
    Other columns are not read; an empty table gives no rows.
    """
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.toDF("id", "bad").where("bad is not null")
    posts = stage(host_posteriors(parts.select("id", "host").join(known, "id").select("host", "bad"), parts.where("host <> ''").select("host"), lift, suffixes), "host-posteriors")
    judged = parts.join(posts.select("host", "posterior_low", "limit"), "host", "left").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    own = F.when(F.col("posterior_low") > F.col("limit"), F.lit("block")).otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(by_rule, own).alias("verdict"), "posterior_low")
