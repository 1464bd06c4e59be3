from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import queries, url_filter


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [r for r in queries.URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


URLS = [None, "", "no scheme", "http://", "://x.com/", "http://A.Example.COM/en/1?q=a/b#x", "https://www.example.com/en/", "http://example.com", "http://x.net/es/é", "http://net/fr/", "http://xnet/fr/", "http://x.net?/es/", "a://b://c.com/", "http://x.com/http://y.net/es/", "http://x.org/#?/a", "http://u@x.net:80/es/"]


@pytest.mark.parametrize("as_table", [False, True])
def test_rules(spark, as_table):
    rules = spark.createDataFrame(queries.URL_RULES, "action string, host string, path string") if as_table else queries.URL_RULES
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    out = {r.page_id: r for r in url_filter.judge_urls(pages, rules).collect()}
    assert len(out) == len(URLS)
    for i, u in enumerate(URLS):
        r = out[i]
        assert (r.host, r.path, r.rule, r.verdict) == brute(u), u


def test_whole_table(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    out = queries.op7_url_filter(spark, sf_dir).collect()
    assert len(out) == len(urls) and {r.verdict for r in out} == {"allow", "block"}
    assert all((r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id]) for r in out)


def test_decisions_spread_over_aliases(spark):
    link = '<html><head><link href="{}" rel="canonical"></head>'
    refresh = '<META http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.org/1", link.format("http://b.org/2")),
        (2, "http://b.org/2", refresh.format("http://x.net/es/3")),  # blocked end
        (3, "https://x.net/es/3#top", None),
        (4, "http://ok.com/4", link.format("//a.org/1")),  # explicit allow joins the component
        (5, "http://c.org/5", link.format("/6")),
        (6, "http://c.org/6", link.format("http://x.net/fr/9")),  # an end that is no page
        (7, "http://d.org/7", link.format("mailto:a@b.org")),
        (8, "http://c.org/5?other", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow"}
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages.where("page_id <> 4"), queries.URL_RULES).collect()}
    assert got[1] == got[2] == "block"
    more = spark.createDataFrame([("http://d.org/7", "http://c.org/5"), (None, "x")], "url string, target string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, queries.URL_RULES, redirects=more).collect()}
    assert got[7] == "block"
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_targets_are_resolved(spark):
    links = ["es/index.html", "../x", "../../../y/./z/..", ".", "./", "?p=1&amp;q=2", "a/b?c=../d#e", "/r/../s", "//o.org/t", "HTTPS://u.org/v", "b;c=1", "../"]
    bases = ["http://h.org/a/b/c.html?old#top", "http://h.org", "http://h.org/a/"]
    pages = [(base, f'<LINK data-rel="x" REL="alternate Canonical" href=\'{x}\'><link rel="stylesheet" href="no.css">') for base in bases for x in links]
    pages += [(base, f'<meta content="3; URL={x}" http-equiv=refresh>') for base in bases for x in links]
    got = sorted(tuple(r) for r in url_filter.alias_edges(spark.createDataFrame(pages, "url string, html string")).collect())
    want = [(base, urljoin(base, x.replace("&amp;", "&")).replace("https://u", "HTTPS://u")) for base in bases for x in links]
    assert got == sorted(want * 2)
    none = [("http://h.org/", f'<link rel=canonical href="{x}">') for x in ("#top", "", "mailto:a@b", "javascript:void(0)")] + [(None, pages[0][1]), ("http://h.org/", None), ("http://h.org/", "<link rel=canonical>")]
    assert url_filter.alias_edges(spark.createDataFrame(none, "url string, html string")).count() == 0


def test_repeated_rows(spark):
    page = (1, "http://a.org/1", '<link rel=canonical href="http://x.net/es/3">')
    out = url_filter.judge_urls(spark.createDataFrame([page, page, (2, page[1], None), (None, page[1], None)], "page_id long, url string, html string"), queries.URL_RULES).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in out) == [(0, "block"), (1, "block"), (1, "block"), (2, "block")]
