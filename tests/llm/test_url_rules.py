"""URL rules against a plain search of the list."""

import random
import re

from bilatera.llm import url_rules as U

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"), ("Example.COM", "", "block"), ("a.example.com", "/fr", "block"), ("com", "/fr/", "block"),
    (None, "/", "block"), ("net", None, "block"), ("net", "x", "block"), ("net", "/", None), ("net", "/", "maybe"), ("é.net", "/É", "block"),
]
SCHEMA = "page_id long, url string, html string, host int, path string, rule double, verdict int"


def brute(url):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    host = lower(host)
    fit = []
    for h, p, v in RULES:
        if h is None or p is None or v not in ("allow", "block") or not (p == "" or p.startswith("/")):
            continue
        h = lower(h)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fit.append((len(h) + len(p), len(h), v == "block", h + p, v))
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


URLS = [
    None, "", "nothing", "http://", "http://?x", "http://org", "http://org/", "http://X.ORG/a?b#c", "http://notorg/", "http://example.org/es",
    "http://example.org/es/", "http://www.example.org/en/12", "ftp://a.b.com/fr/1", "http://a.example.com/fr/x://y/z", "http://a.example.com/f",
    "http://a.example.com?q=/fr/", "http://é.net/Éa", "http://É.net/Éa", "http://user@x.org:80/", "http://.org/", "http://org./", "http://a..org/",
    "http://" + "a." * 3000 + "org/" + "p/" * 20000, "://example.org/en/1\n2", "http://com/de/\n",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "h", 1, "p", 1.0, 2) for i, u in rows], SCHEMA).repartition(3)


def rules(spark, rows=RULES):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def test_against_plain_search(spark):
    r = random.Random(3)
    rows = list(enumerate(URLS)) + [(None, URLS[7]), (None, None), (5, URLS[5]), (5, URLS[9])]
    for i in range(300):
        host = ".".join(r.choice(["a", "www", "example", "org", "com", "net", "é"]) for _ in range(r.randint(1, 4)))
        rows.append((1000 + i, f"https://{host}" + r.choice(["", "/", "/es/", "/en/1", "/en/17", "/fr/", "/de/x", "/f", "/É"]) + r.choice(["", "?a", "#b"])))
    got = U.judge(frame(spark, rows), rules(spark))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted([tuple(x) for x in got.collect()], key=key) == sorted([(i, *brute(u)) for i, u in rows], key=key)


def test_hot_page_and_no_rules(spark):
    rows = [(i, "http://www.example.org/en/1") for i in range(5000)] + [(9000, "http://x.net/")]
    got = U.judge(frame(spark, rows), rules(spark))
    assert got.groupBy("rule", "verdict").count().collect() and {tuple(r) for r in got.groupBy("rule", "verdict").count().collect()} == {
        ("example.org/en/1", "block", 5000), (None, "allow", 1)}
    assert {r["verdict"] for r in U.judge(frame(spark, rows), rules(spark, [(None, None, None)])).collect()} == {"allow"}
    assert U.judge(frame(spark, []), rules(spark)).count() == 0


def test_no_python_on_the_way(spark):
    plan = U.judge(frame(spark, [(1, "http://x.org/")]), rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
