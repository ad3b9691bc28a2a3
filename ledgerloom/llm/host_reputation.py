"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. From the top down each level's
rate is a beta posterior whose prior is the level above: suffix shrinks to the overall rate, domain to its suffix,
host to its domain, with a prior strength estimated from the spread between the children. A page is blocked when the
lower posterior bound of its host's bad rate lies above the tolerated rate, by default the rate of all pages, so hosts
with few labels follow their domain and are never blocked by one bad page. Fixed rules on host and path come before the reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public suffixes of two labels that the registered domain keeps besides its own label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased. Null or no ://: empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end. Null or no ://: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host, then path from the first slash) that fits a host, its subdomains and the path."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return F.lit(None).cast("string") if found is None else found.otherwise(F.lit(None))


def _strength(children: DataFrame, parent: list[str]) -> DataFrame:
    """Prior rate and strength of each parent: by moments of the children's rates, kept within 2 and 1000 pages."""
    p = F.sum("bad") / F.sum("n")
    groups = children.groupBy(*parent).agg(p.alias("rate"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"))
    within = F.col("rate") * (1 - F.col("rate"))
    spread = F.col("bb") - F.col("total") * F.col("rate") * F.col("rate")  # n-weighted squares between the children
    between = (spread - (F.col("k") - 1) * within) / (F.col("total") - F.col("nn") / F.col("total"))
    m = F.when((F.col("k") > 1) & (between > 0), within / between - 1).otherwise(F.lit(1000.0))
    return groups.select(*parent, F.least(F.lit(1000.0), F.greatest(F.lit(2.0), m)).alias("m"))


def host_rates(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, labelled, rate, low, high, overall): posterior of each host's bad rate, and the rate of all pages.

    `outcomes` has page_id and bad 0 / 1; `suffixes` are the public suffixes of two labels.
    """
    bad = F.col("bad").cast("double")
    outcomes = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(bad).alias("bad"))
    page = pages.select("page_id", host_of(F.col("url")).alias("host"))
    hosts = page.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = suffixes.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("prior"))
    seen = lambda df: df.where("n > 0")
    m3, m2, m1 = _strength(seen(suffixes), []), _strength(seen(domains), ["suffix"]), _strength(seen(hosts), ["suffix", "domain"])
    # One row each: the rate and strength over all suffixes.
    top = suffixes.join(F.broadcast(every)).join(F.broadcast(m3))
    strength = F.coalesce(F.col("m"), F.lit(1000.0))
    shrunk = (F.col("bad") + F.col("prior") * strength) / (F.col("n") + strength)
    top = top.select("suffix", F.col("prior").alias("overall"), shrunk.alias("prior"))
    mid = domains.join(top, "suffix").join(m2, "suffix", "left").select("suffix", "domain", "overall", shrunk.alias("prior"))
    low = hosts.join(mid, ["suffix", "domain"]).join(m1, ["suffix", "domain"], "left")
    a, b = F.col("bad") + F.col("prior") * strength, F.col("n") - F.col("bad") + (1 - F.col("prior")) * strength
    rate, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return low.select("host", F.col("n").cast("long").alias("labelled"), rate.alias("rate"), F.greatest(F.lit(0.0), rate - z * sd).alias("low"), F.least(F.lit(1.0), rate + z * sd).alias("high"), "overall")


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], tolerated: float | None = None, z: float = 1.645, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), bad_rate, bad_rate_low.

    `rules` maps a rule like `example.net/en/` to allow or block. Null urls and urls without :// have an empty host,
    a host like any other. `tolerated` is a rate; without it a host is blocked if it is credibly worse than all pages
    together. Hosts without labels follow their domain; without any label no page is blocked by reputation. Repeated page_ids are judged each by their own
    url; outcomes of one page that disagree count as bad. Urls of any length are taken whole. Extra columns are
    ignored; an empty table gives an empty result.
    """
    page = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    page = page.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    judged = page.join(host_rates(pages, outcomes, z, suffixes), "host", "left")
    by_rate = F.when(F.col("low") > (F.col("overall") if tolerated is None else F.lit(tolerated)), "block").otherwise("allow")
    verdict = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in rules.items()], by_rate)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("rate", 6).alias("bad_rate"), F.round("low", 6).alias("bad_rate_low"))
