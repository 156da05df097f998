import random

from pyspark.sql import functions as F

from skylocus.llm import urlfilter

RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "Example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "org", "/fr/x"),
    ("allow", "a.b.org", ""), ("block", "a.b.org", ""), ("block", "org", "/long/path/of/rule"), ("allow", "deep.b.org", "/long"),
]
URLS = [
    None, "", "no scheme", "http://", "http:///en/", "https://example.net/en/x", "https://EXAMPLE.net/en", "http://x.example.net/en/?q#f", "ftp://net/",
    "http://net", "http://fakenet/", "http://example.com/de/1", "http://www.example.com/DE/1", "http://org/fr/xyz", "http://q.org/fr/", "http://a.b.org",
    "http://z.a.b.org?x=/fr/", "http://deep.b.org/long/path/of/rule/1", "http://x.org:80/fr/", "a://b://net/", "http://É.net/ü", "http://net//en/",
]


def brute(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p), len(h), v == "block", v, h.lower() + p) for v, h, p in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, "allow", None))
    return host, path, best[4], best[3]


def test_trie_and_join_against_all_rules(spark):
    r = random.Random(3)
    urls = URLS + ["http://" + ".".join(r.choices(["a", "b", "org", "net", "example", "com"], k=r.randrange(1, 4))) + r.choice(["", "/", "/fr/", "/en/x", "/long/path/of/rulex"]) for _ in range(300)]
    pages = spark.createDataFrame([(k if k % 10 else None, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1))
    rules = spark.createDataFrame(RULES + RULES[:1] + [(None, "x", "/")], "verdict string, host string, path string")
    want = sorted(map(str, ((k if k % 10 else None, *brute(u)) for k, u in enumerate(urls))))
    assert sorted(str(tuple(x)) for x in urlfilter.judge(pages, rules).collect()) == want
    assert sorted(str(tuple(x)) for x in urlfilter.judge(pages, rules, max_trie_chars=5).collect()) == want


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert [tuple(x) for x in urlfilter.judge(pages, rules).collect()] == [(1, "a.net", "/", None, "allow")]
    assert urlfilter.judge(pages.limit(0), rules).collect() == []


def test_join_of_a_host_with_very_many_rules(spark):
    """A page of a host with thousands of rules is a row for each of their lengths, not for each rule."""
    rules = spark.range(3000).selectExpr("'block' AS verdict", "'hot.org' AS host", "concat('/', lpad(id, 4, '0')) AS path").unionByName(
        spark.createDataFrame([("allow", "org", "/00"), ("allow", "hot.org", "/0007/x")], "verdict string, host string, path string"))
    pages = spark.range(2000).selectExpr("id AS page_id", "concat('http://www.hot.org/', lpad(id, 4, '0'), '/x') AS url")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_by_join(pages, rules).collect()}
    assert len(got) == 2000 and got[7] == ("hot.org/0007/x", "allow") and got[8] == ("hot.org/0008", "block")
    assert got == {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
