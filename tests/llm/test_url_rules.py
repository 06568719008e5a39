import random

import pytest

from basketlens.llm.url_rules import judge

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/", "allow"), ("net", "/es", "allow"), ("net", "/es/x", "allow"), ("NET", "/es/x", "block"), ("org", None, "block"),
    ("a.org", "/", None), ("", "", "block"), ("b.org", "/q", "allow"), ("c.b.org", "/", "allow"),
]
URLS = [
    "http://www.example.com/en/1", "https://blog.EXAMPLE.com/en/2?x#y", "http://example.com/en", "http://x.net/es/1", "http://x.net/es/xy",
    "http://net/es", "http://com", "http://notcom/", "http://a.org", "http://b.org/qq", "http://c.b.org/qq", "http://d.c.b.org/z",
    "no scheme", "", None, "x://", "http://u@h.net:80/es/", "http://é.net/es/\U0010ffff", "http://h.net?/es/", "http://x.net/es/x\u00ff",
    "http://" + ".".join(["deep"] * 60) + ".net/es/", "http://h.net/" + "long" * 4000,
]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end].translate(LOWER), rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    merged = {}
    for h, p, v in rules:
        if v:
            k = ((h or "").translate(LOWER), p or "")
            merged[k] = max(v, merged.get(k, ""))
    fit = [
        (len(h + p), len(h), h + p, v)
        for (h, p), v in merged.items()
        if (host == h or (h and host.endswith("." + h))) and path.startswith(p)
    ]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules", [RULES, RULES[:1], []])
def test_against_brute_force(spark, rules):
    rows = [(n, u) for n, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0])]
    pages = spark.createDataFrame([(p, u, "x", 1) for p, u in rows], "page_id long, url string, rhost string, part int")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(pages, frame).collect()), key=str)
    assert got == sorted(((p, *slow(u, rules)) for p, u in rows), key=str)


def test_nested_rules_across_many_ranges(spark):
    rng = random.Random(4)
    rules = [("h.net", "/" + "a/" * k, rng.choice(["allow", "block"])) for k in range(12)]
    rules += [("h.net", "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(1, 6))), "block") for _ in range(60)]
    urls = [f"http://{rng.choice(['h', 'x.h', 'y'])}.net/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 14))) for _ in range(700)]
    urls += ["http://h.net/a/a/"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {n: slow(u, rules) for n, u in enumerate(urls)}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
