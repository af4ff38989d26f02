import math
import random

import pytest

from firmatlas.llm import reputation

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PAGES = "page_id long, url string, html string, host string, verdict string, n long, mean double"


def pages_frame(spark, rows):
    return spark.createDataFrame([(i, u, "<p>", "h", "v", 1, 0.5) for i, u in rows], PAGES)


def rules_frame(spark, rules=RULES):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def outcomes_frame(spark, rows=()):
    return spark.createDataFrame(list(rows), "page_id long, good int")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:at], rest[at:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules=RULES):
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:0:-1] if fits else (None, None)


URLS = [
    "http://Example.ORG/es/1", "https://a.b.example.org/en/12?x=/es/", "http://example.org/en/2#top", "http://notexample.org/es/", "http://example.org", "http://org/x", "http://borg/x",
    "http://x.com/fr/", "http://x.com/fr", "http://x.com?/fr/", "http://com/de/a", "x.com/fr/", None, "", "http://", "://org/", "http://u@x.com:80/de/", "http://a://org/", "HTTP://É.com/de/é", "http://10.0.0.1/de/",
]


def test_rules_match_brute_force(spark):
    got = reputation.judged(pages_frame(spark, list(enumerate(URLS))), rules_frame(spark), outcomes_frame(spark)).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = split(URLS[r["page_id"]])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[r["page_id"]]
        # Without outcomes nothing is known against any host.
        assert r["verdict"] == (verdict or "allow")


def test_many_rules_of_one_host_and_ties(spark):
    rules = [("com", "/" + "a" * i, "block" if i % 2 else "allow") for i in range(40)] + [("x.com", "/aa", "allow"), ("x.com", "/aa", "block"), ("", "/", "block")]
    urls = [f"http://x.com/{'a' * i}/{j}" for i in range(45) for j in range(2)]
    got = reputation.judged(pages_frame(spark, list(enumerate(urls))), rules_frame(spark, rules), outcomes_frame(spark)).collect()
    for r in got:
        rule, verdict = rule_of(*split(urls[r["page_id"]]), rules[:-1])
        assert (r["rule"], r["verdict"]) == (rule, verdict)


def test_no_rules_long_url_and_empty_tables(spark):
    long = "http://" + "a." * 200_000 + "com/" + "x" * 100_000
    got = reputation.judged(pages_frame(spark, [(1, long), (1, long), (None, "http://a.com/")]), rules_frame(spark, []), outcomes_frame(spark)).collect()
    assert len(got) == 3 and all(r["rule"] is None and r["verdict"] == "allow" for r in got)
    got = reputation.judged(pages_frame(spark, [(1, long)]), rules_frame(spark), outcomes_frame(spark)).collect()
    assert got[0]["rule"] is None and len(got[0]["path"]) == 100_001
    assert reputation.judged(pages_frame(spark, []), rules_frame(spark), outcomes_frame(spark, [(1, 1)])).collect() == []


@pytest.mark.parametrize("host, domain, suffix", [
    ("a.b.example.com", "example.com", "com"), ("www.shop.co.uk", "shop.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("localhost", "localhost", "localhost"),
    ("u@a.x.de:8080", "x.de", "de"), ("10.0.0.1", "10.0.0.1", ""), ("", "", ""),
])
def test_registered_domains(spark, host, domain, suffix):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(host,)], "h string").select(*reputation.registered(F.col("h"))).first()
    assert tuple(row) == (domain, suffix)


def posterior(counts):
    """Mean and deviation by host of (host -> n, k) by hand; hosts look like ``h.d.s``."""
    def fit(rows):
        over = sum(n * (k / n - m) ** 2 - m * (1 - m) for n, k, m in rows.values() if n)
        scale = sum((n - 1) * m * (1 - m) for n, k, m in rows.values() if n)
        w = 1 / min(max(over / scale, 0.002), 0.5) - 1 if scale else 1.0
        return w, {x: (k + w * m) / (n + w) for x, (n, k, m) in rows.items()}

    def total(name):
        sums = {}
        for host, (n, k) in counts.items():
            a, b = sums.get(name(host), (0, 0))
            sums[name(host)] = (a + n, b + k)
        return sums

    every = total(lambda host: "")[""]
    suffix, domain = (lambda host: host.split(".")[-1]), (lambda host: ".".join(host.split(".")[-2:]))
    _, s = fit({x: (*v, (every[1] + 0.5) / (every[0] + 1)) for x, v in total(suffix).items()})
    _, d = fit({x: (*v, s[suffix(x)]) for x, v in total(domain).items()})
    w, h = fit({x: (*v, d[domain(x)]) for x, v in counts.items()})
    return {x: (m, math.sqrt(m * (1 - m) / (counts[x][0] + w + 1))) for x, m in h.items()}


def test_posteriors_match_brute_force_and_find_bad_hosts(spark):
    rng = random.Random(3)
    rows, outcomes, counts = [], [], {}
    for d in range(12):
        for h in range(4):
            host, bad = f"h{h}.d{d}.{['net', 'info'][d % 2]}", d in (3, 7)
            counts[host] = (0, 0)
            for _ in range(rng.randrange(1, 40)):
                i = len(rows)
                rows.append((i, f"http://{host}/{i}"))
                if h != 3 and rng.random() < 0.7:
                    good = int(rng.random() < (0.05 if bad else 0.9))
                    outcomes.append((i, good))
                    counts[host] = (counts[host][0] + 1, counts[host][1] + good)
    labels = [*outcomes, (None, 1), (10**9, 0), (0, None)]
    got = reputation.judged(pages_frame(spark, rows), rules_frame(spark), outcomes_frame(spark, labels)).collect()
    want = posterior(counts)
    for r in got:
        mean, sd = want[r["host"]]
        assert r["labelled"] == counts[r["host"]][0]
        assert r["mean"] == pytest.approx(mean, abs=1e-8) and r["upper"] == pytest.approx(mean + 1.645 * sd, abs=1e-8)
        # h3 has no labelled page; its domain speaks for it.
        assert (r["verdict"] == "block") == (".d3." in r["host"] or ".d7." in r["host"])
    left = reputation.allowed(pages_frame(spark, rows), rules_frame(spark), outcomes_frame(spark, labels))
    assert left.columns == [c.split()[0] for c in PAGES.split(", ")]
    assert {r["page_id"] for r in left.collect()} == {r["page_id"] for r in got if r["verdict"] == "allow"}
