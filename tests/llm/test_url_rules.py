"""URL rules against a plain reading of them, by both ways of looking them up."""

import re

import pytest
from gridloom.llm import urlrules
from gridloom.llm.urlrules import host_rule, judge, pattern_rule

RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "bare.net", ""),
    ("allow", "ab.com", "/x"), ("block", "com", "/x/y/"),
]
PATTERNS = [("block", "?utm_source="), ("block", "/ads/"), ("allow", "/print/*utm_source="), ("block", "zz"), ("block", "=1*=2")]
URLS = [
    None, "", "no scheme/ads/", "http://", "://", "http://org", "http://ORG/", "https://a.org/x?y", "http://example.org/es/1", "http://EXAMPLE.org/ES/1", "http://xexample.org/es/1",
    "http://b.example.org/en/12", "http://b.example.org/en/21", "ftp://s.com/fr/", "http://s.com/de/a#b", "http://s.com/de", "http://com/de/", "http://bare.net", "http://w.bare.net?ads=1",
    "http://bare.net.x/", "http://x.net/ads/", "http://x.net/ads", "http://x.net/a?utm_source=f", "http://x.net/print/?utm_source=f", "http://s.com/fr/?utm_source=f", "http://x.net/fizz",
    "http://x.net/q?a=1&b=2", "http://x.net/\n/ads/", "http://ab.com/x/y/1", "http://a.ab.com/x", "http://é.net/é/ads/é", "http://x.net/a://y.org/", "http://u@org:80/", "http://x.net/" + "a/" * 5000 + "ads/",
]


def plain(url):
    url = url or ""
    after = url.split("://", 1)[1] if "://" in url else ""
    raw = re.match("[^/?#]*", after).group()
    host = raw.translate({c: c + 32 for c in range(65, 91)})
    path = re.match("[^?#]*", after[len(raw) :]).group()
    fit = [(len(h + p), v == "block", v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[3], max(fit)[2]
    whole = "." + host + after[len(raw) :] if "://" in url else ""
    fit = [(len(p), v == "block", v) for v, p in PATTERNS if re.search("(?s)" + ".*".join(map(re.escape, p.split("*"))), whole)]
    return host, path, None, max(fit)[2] if fit else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i if i % 7 else None, u, "kept", 3) for i, u in enumerate(URLS + URLS[:9])]
    return spark.createDataFrame(rows, "page_id long, url string, host string, `token` int")


@pytest.mark.parametrize("inline", [0, 100])
def test_rules_fit_as_read(pages, inline):
    rules = [host_rule(*r) for r in RULES] + [pattern_rule(*r) for r in PATTERNS]
    found = judge(pages, rules, inline=inline)
    assert found.columns == ["page_id", "url", "token", "host", "path", "rule", "pattern", "verdict"]
    got = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=str)
    assert got == sorted(((r.page_id, r.url, *plain(r.url)) for r in pages.collect()), key=str)
    kept = urlrules.allowed(pages, rules)
    assert kept.columns == pages.columns and kept.count() == sum(r[-1] == "allow" for r in got)


def test_a_rule_is_filed_under_its_rarest_token(spark):
    urls = spark.createDataFrame([(u,) for u in ["http://a.com/de/1", "http://b.com/fr/2", "http://c.net/de/", "http://c.net/de/x", None]], "url string")
    rules = [host_rule("block", "com", "/de/"), host_rule("block", "net", "/de/1"), pattern_rule("block", "x")]
    counts = urlrules.rarest(urls, rules)
    assert counts == {"com": 2, "de": 3, "net": 2}
    assert {r.name: t for t, _, r in urlrules.filed(rules, counts)} == {"com/de/": "com", "net/de/1": "net", "x": ""}


def test_no_rules_and_no_rows(pages):
    assert {r.verdict for r in judge(pages, []).collect()} == {"allow"}
    assert judge(pages.limit(0), [host_rule("block", "com")]).count() == 0
    for bad in (lambda: host_rule("drop", "com"), lambda: host_rule("block", "a/b"), lambda: host_rule("block", "com", "x"), lambda: pattern_rule("block", "**")):
        with pytest.raises(ValueError):
            bad()


def test_inline_rules_move_no_row(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plan = judge(pages, [host_rule(*r) for r in RULES])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_thousand_rules_by_both_ways(spark, pages):
    many = [host_rule("block" if i % 3 else "allow", f"h{i}.example.org", f"/{i % 5}/") for i in range(300)] + [pattern_rule("block", f"/p{i}/") for i in range(100)]
    urls = spark.createDataFrame([(i, f"http://s.h{i % 400}.example.org/{i % 7}/p{i % 150}/x") for i in range(2000)], "page_id long, url string")
    a, b = (sorted(map(str, judge(urls, many, inline=n).collect())) for n in (0, 1000))
    assert a == b and any("block" in x for x in a)
