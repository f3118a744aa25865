"""URL filter: parts and rules against plain Python, the model on words it has not seen as such."""

import re

import pytest
from seismark.llm import url_filter as U

URLS = ["https://www.ththen.example.org/en/148.html", "http://EXAMPLE.org/es/7#top", "http://a.example.org/en/12?x", "http://x.com/fr/", "http://x.com/fr", "http://com/de/1",
        "http://xcom/de/1", "http://b.org", "http://b.org/", "ftp://c.net?x/y", "no scheme", None, "", "a://b://c/d", "http://é.example/ß#x", "http://h\n.org/p\nq?z", "://"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), k, r) for k, r in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None


@pytest.fixture(scope="module")
def model(spark):
    return U.train(U.labelled_urls(spark))


def test_parts_and_rules(spark, model):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    out = {r.page_id: r for r in U.judge(pages, model).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule), u
        assert out[i].verdict == (verdict or out[i].by_model)
    assert U.judge(pages.limit(0), model).collect() == []


def test_model_generalises(spark, model):
    bad = ["https://super-casino.example.net/en/5", "http://www.cheap-pills.example.net/x", "https://online-poker.example.net/1", "http://free-bets.example.net/de/9.html"]
    good = ["https://www.school-library.example.net/en/5", "http://gardens.example.net/en/x", "https://therin.example.net/en/854/", "http://blog.orchestra.example.net/es/883"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.by_model for r in U.judge(pages, model).collect()}
    assert [got[i] for i in range(8)] == ["block"] * 4 + ["allow"] * 4


def test_no_python_in_the_plan(spark, model):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan = U.judge(pages, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
