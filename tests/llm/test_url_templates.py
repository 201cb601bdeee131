import re

from hydrolens.llm import url_templates
from hydrolens.llm.queries import op6_url_verdicts
from hydrolens.llm.tables import table
from hydrolens.llm.url_templates import RULES
from tests.helpers import rows


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def test_query_equals_the_rules(spark, sf_dir):
    urls = {p.page_id: p.url for p in table(spark, sf_dir, "pages").collect()}
    found = op6_url_verdicts(spark, sf_dir).collect()
    assert sorted(row.page_id for row in found) == sorted(urls)
    for row in found:
        assert (row.host, row.path) == parsed(urls[row.page_id])
        name, verdict = ruled(row.host, row.path)
        assert row.rule == name and row.verdict == (verdict or ("block" if row.purity < 0.5 else "allow"))


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_parsing(spark):
    urls = ["http://EX.org", "x", None, "https://a.example.org/es/x?y", "http://notexample.org/es/", "a://b://c/d#e", "b://?q"]
    found = url_templates.judge(pages(spark, urls)).collect()
    assert sorted((row.page_id, row.host, row.path) for row in found) == [(i, *parsed(u)) for i, u in enumerate(urls)]
    assert {row.page_id: row.rule for row in found}[3] == "example.org/es/"
    assert {row.page_id: row.rule for row in found}[4] == "org/"


def test_variable_segments_become_wildcards(spark):
    urls = [f"http://h.net/{part}/{i}.html" for part in ("news", "blog") for i in range(30)] + ["http://h.net/"]
    found = url_templates.judge(pages(spark, urls)).collect()
    assert {row.template for row in found} == {"h.net/news/*", "h.net/blog/*", "h.net"}


def test_purity_of_the_template_decides(spark):
    """Pages of a branch that no rule judges follow the labelled pages beside them."""
    rules = (url_templates.Rule("block", "h.net", "/a/1"), url_templates.Rule("allow", "h.net", "/b/1"))
    urls = [f"http://h.net/{part}/{i}" for part in "ab" for i in range(100, 150)]
    urls += [f"http://h.net/{part}/{i}" for part in "ab" for i in range(200, 210)]
    found = url_templates.judge(pages(spark, urls), rules).collect()
    assert {(row.path[1], row.verdict) for row in found} == {("a", "block"), ("b", "allow")}
    unruled = [row for row in found if row.rule is None]
    assert len(unruled) == 20 and all((row.purity < 0.2) == (row.verdict == "block") for row in unruled)


def test_like_siblings_are_merged(spark):
    rules = (url_templates.Rule("block", "h.net", "/"), url_templates.Rule("allow", "h.net", "/c/"))
    urls = [f"http://h.net/{part}/{i}" for part, n in (("a", 40), ("b", 30), ("c", 40)) for i in range(n)]
    purity = {row.template: row.purity for row in url_templates.judge(pages(spark, urls), rules).collect()}
    assert purity["h.net/a/*"] == purity["h.net/b/*"] < purity["h.net/c/*"]


def test_odd_rows(spark):
    data = [(None, None), (1, ""), (1, ""), (2, "http://x.com/" + "a/" * 50_000)]
    odd = spark.createDataFrame(data, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS rule", "2 AS t1", "3 AS n")
    found = url_templates.judge(odd)
    assert rows(found, "page_id", "host") == [(1, ""), (1, ""), (2, "x.com"), (None, "")]
    assert url_templates.judge(odd.limit(0)).count() == 0
