"""URL filters: rules on host and path, and for all other pages the reputation of their host.

A rule names a host and the start of a path. It fits that host and its subdomains; the longest fitting rule
decides. Hosts of a url are looked up label by label, and paths by the lengths that the rules of a host
have, so rules and pages meet by equality however many rules there are.

Reputation is an empirical-Bayes estimate of the share of good pages. Labelled outcomes are counted by host, by
registered domain and by public suffix. Each level is a beta-binomial whose mean is the posterior mean of the
level above (of all pages for suffixes); how far children scatter about it, beyond what their
numbers explain, gives the level's prior weight (method of moments). A host with few labels, or none, is
so drawn to its domain and that to its suffix. A page is blocked if the upper bound of its host's
posterior lies below ``floor``: what is not known to be bad stays.

Defined cases: a null url, or one without ``://``, has an empty host and path, which fit no rule and have a
reputation like any other host; labels that are null, or of ids without a page, count for nothing, repeated ones
count each; rows that repeat a page_id are judged each by its own url; ties between rules of one length
take block, then the greatest rule; an empty table gives an empty result; columns besides page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from firmatlas.llm.store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: second-level names under which countries register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Least and largest correlation of pages of one parent; 1 / correlation - 1 is a prior's weight in pages.
CORRELATION = (0.002, 0.5)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; an address of digits is its own domain, without a suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    second = bare.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    digits = bare.rlike("^[0-9.]+$")
    suffix = F.when(digits, "").otherwise(F.when(second, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1)))
    domain = F.when(digits, bare).otherwise(F.when(second, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2)))
    return domain, suffix


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) of pages that a rule fits, with the longest one's name and its verdict.

    ``rules``: host, path, verdict.
    """
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    rules = written(named, "rules")
    labels = F.size(F.split("rule_host", r"\."))
    most = rules.agg(F.max(labels)).first()[0] or 0
    lengths = written(rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths")), "rule-lengths")
    places = pages.filter(F.lit(most > 0) & (F.col("host") != "")).select("host", "path").distinct()
    # Hosts above have at most as many labels as a rule's host.
    above = F.expr(f"transform(sequence(1, least({max(most, 1)}, length(host) - length(replace(host, '.', '')) + 1)), i -> substring_index(host, '.', -i))")
    near = places.select("host", "path", F.explode(above).alias("rule_host")).join(lengths, "rule_host")
    near = near.select("host", "path", "rule_host", F.explode("lengths").alias("n")).filter(F.length("path") >= F.col("n"))
    fits = near.withColumn("rule_path", F.expr("substring(path, 1, n)")).join(rules, ["rule_host", "rule_path"])
    name = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(name.alias("rule"), "verdict"), F.struct(F.length(name).alias("n"), F.col("verdict").alias("v"), name.alias("name")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.*")


def _level(rows: DataFrame, label: str) -> DataFrame:
    """rows (n labelled, k good, and the mean of the level above as prior) with their prior's weight and posterior mean."""
    rows = written(rows, f"reputation-{label}")
    n, k, m = F.col("n"), F.col("k"), F.col("prior")
    # Scatter about the prior, what chance explains of it, and what one more unit of correlation would add.
    over = F.sum(F.when(n > 0, n * F.pow(k / n - m, 2) - m * (1 - m)))
    scale = F.sum(F.when(n > 0, (n - 1) * m * (1 - m)))
    over, scale = rows.agg(over, scale).first()
    rho = min(max(over / scale, CORRELATION[0]), CORRELATION[1]) if scale else CORRELATION[1]
    weight = F.lit(1 / rho - 1)
    return rows.withColumn("weight", weight).withColumn("mean", (k + weight * m) / (n + weight))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Posterior of every host of pages: n labelled pages, k good ones, mean, and standard deviation.

    ``pages`` has page_id and host, ``outcomes`` page_id and good (0 or 1).
    """
    known = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k"))
    domain, suffix = registered(F.col("host"))
    zero = F.lit(0).cast("long")
    hosts = pages.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), zero).alias("n"), F.coalesce(F.sum("k"), zero).alias("k"))
    hosts = written(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "reputation-counts")
    good, labelled = hosts.agg(F.sum("k"), F.sum("n")).first()
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    prior = F.lit(((good or 0) + 0.5) / ((labelled or 0) + 1))
    suffixes = _level(hosts.groupBy("suffix").agg(*sums).withColumn("prior", prior), "suffix")
    # A domain has one suffix.
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix")
    domains = _level(domains, "domain")
    found = _level(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"), "host")
    return found.withColumn("sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1)))


def judged(pages: DataFrame, rules: DataFrame, outcomes: DataFrame, floor: float = 0.7, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages, with its host's labelled pages, mean and upper bound."""
    url = F.col("url")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = reputations(slim, outcomes)
    bound = F.round(F.col("mean") + z * F.col("sd"), 9)
    hosts = written(hosts.select("host", F.col("n").alias("labelled"), F.round("mean", 9).alias("mean"), bound.alias("upper")), "reputation-hosts")
    places = written(ruled(slim, rules), "url-rules")
    found = slim.join(hosts, "host").join(places, ["host", "path"], "left")
    own = F.when(F.col("upper") < floor, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "labelled", "mean", "upper")


def allowed(pages: DataFrame, rules: DataFrame, outcomes: DataFrame, floor: float = 0.7, z: float = 1.645) -> DataFrame:
    """Rows of pages, whole, whose url is not blocked."""
    blocked = written(judged(pages, rules, outcomes, floor, z).filter("verdict = 'block'").select("host", "path").distinct(), "blocked")
    own = (host_of(pages["url"]) == blocked["host"]) & (path_of(pages["url"]) == blocked["path"])
    return pages.join(blocked, own, "left_anti")
