import random

from llm_rows import rows_of

from fleetgauge.llm.url_filter import url_verdicts

RULES = "host string, path string, verdict string"


def brute(urls, rules, default="allow"):
    out = []
    for page_id, url in urls:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fits = [
            (-len(h) - len(p), -len(h), v, h + p) for h, p, v in rules
            if host and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = min(fits, default=(0, 0, default, None))
        out.append({"page_id": page_id, "host": host, "path": path, "rule": best[3], "verdict": best[2]})
    return sorted(out, key=lambda r: (r["page_id"] is None, r["page_id"] or 0, repr(r)))


def check(spark, urls, rules):
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "'x' AS stack", "4 AS slice")
    got = rows_of(url_verdicts(pages, spark.createDataFrame(rules, RULES)), "page_id")
    assert got == brute(urls, rules)


def test_random_hosts_and_nested_rules(spark):
    draw = random.Random(3)
    labels = ["a", "ab", "net", "com", "a-b", "é", "x" * 70]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))
    path = lambda: "".join("/" + draw.choice(["", "a", "ab", "en"]) for _ in range(draw.randint(0, 3)))
    rules = list({(h, p): (h, p, draw.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(150))}.values())
    urls = [(i, draw.choice(["http", "HTTPS"]) + "://" + host() + path() + draw.choice(["", "?q=://a.net/", "#x"])) for i in range(400)]
    check(spark, urls, rules)


def test_odd_urls(spark):
    urls = [
        (1, None), (2, ""), (3, "no scheme/net/"), (4, "://net/"), (5, "http://"), (6, "http://A.NET/EN/"), (7, "http://a.net"), (8, "http://net."),
        (9, "x?u=http://net/en/"), (None, "http://net/"), (11, "http://net/"), (11, "http://net/"), (12, "http://a\x00net/"), (13, "http://x\nnet/\na?b"),
        (14, "http://.net/"), (15, "http://" + "a." * 500 + "net/" + "p" * 50_000),
    ]
    check(spark, urls, [("net", "/", "block"), ("net", "/", "block"), ("a.net", "", "allow"), ("net", "/en/", "allow")])


def test_many_urls_of_one_host(spark):
    check(spark, [(i, f"http://hot.example.net/en/{i % 9}") for i in range(500)], [("example.net", "/en/1", "block"), ("net", "/", "block")])


def test_no_rules_and_no_pages(spark):
    check(spark, [(1, "http://a.net/")], [])
    check(spark, [], [("net", "/", "block")])


def test_rules_for_all_hosts(spark):
    """A rule with an empty host stays open whatever begins and ends after it."""
    urls = [(i, f"http://{h}/{p}") for i, (h, p) in enumerate((h, p) for h in ("a.com", "b.org", "c.net", "x.b.org", "z.net") for p in ("", "zzz", "zz"))] + [(99, "no host")]
    check(spark, urls, [("", "/", "block"), ("b.org", "/zzz", "allow")])
    draw = random.Random(8)
    hosts = ["", "net", "a.net", "b.a.net", "org"]
    rules = list({(h, p): (h, p, draw.choice(["allow", "block"])) for h in hosts for p in draw.sample(["", "/", "/a", "/a/b", "/b", "/ab"], 3)}.values())
    check(spark, [(i, f"http://{draw.choice(['x', 'b.a.net', 'a.net', 'c.org', 'net'])}{draw.choice(['', '/', '/a', '/a/b/c', '/abc', '/b'])}") for i in range(200)], rules)


def test_many_paths_of_one_host(spark):
    """Five thousand path rules on one host, many within each other."""
    draw = random.Random(9)
    paths = sorted({"/" + "/".join(draw.choice("abcdef") for _ in range(draw.randint(1, 8))) for _ in range(9000)})[:5000]
    rules = [("big.example.net", p, draw.choice(["allow", "block"])) for p in paths] + [("net", "/a", "block")]
    urls = [(i, f"http://{draw.choice(['', 'www.'])}big.example.net{draw.choice(paths)}{draw.choice(['', '/zz', '/a'])}") for i in range(150)]
    check(spark, urls, rules)


def test_wide_characters(spark):
    """Characters of any size sort within the intervals of their prefixes."""
    top = "\U0010ffff"
    check(spark, [(i, f"http://h/{p}") for i, p in enumerate(["a", "a" + top, "a" + top * 3, "b", top])], [("h", "/a", "block"), ("h", "/a" + top, "allow"), ("h", "/" + top, "block")])
