"""URL rules against a plain scan, with odd addresses and nested rules."""

from eventlake.llm import url_rules

URLS = [
    "https://a.example.net/en/x?q=1", "http://example.net/de/", "HTTP://EXAMPLE.NET/en", "https://x.org/fr/1#top", "https://x.org/en/1", "ftp://net", "https://net/",
    "no address", None, "", "https://shop.example.com/de/1", "https://example.comx/de/1", "https://a.b/c://d.net/", "https://notexample.net/en/1", "https://h.net?x/en/",
]


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, url_rules.DEFAULT))
    return host, path, best[2], best[3]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {row.page_id: (row.host, row.path, row.rule, row.verdict) for row in url_rules.filter_urls(pages, url_rules.rule_frame(spark, rules)).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_rules_of_the_query(spark):
    check(spark, URLS, url_rules.RULES)


def test_nested_rules(spark):
    rules = [("net", "/", "block"), ("net", "/en/", "allow"), ("net", "/en/x", "block"), ("example.net", "/", "allow"), ("a.example.net", "/en/", "block")]
    check(spark, URLS + [f"https://h{i}.example.net/en/{'x' * (i % 3)}" for i in range(60)], rules)


def test_repeated_rows_and_void_rules(spark):
    pages = spark.createDataFrame([(1, URLS[0]), (1, URLS[0]), (None, URLS[0])], "page_id long, url string")
    rules = url_rules.rule_frame(spark, [*url_rules.RULES, *url_rules.RULES, (None, "/", "block"), ("net", None, "block")])
    rows = url_rules.filter_urls(pages, rules).collect()
    assert len(rows) == 3 and {row.rule for row in rows} == {"example.net/en/"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.filter_urls(none, url_rules.rule_frame(spark)).count() == 0
    one = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    assert url_rules.filter_urls(one, url_rules.rule_frame(spark, [])).first().verdict == "allow"
