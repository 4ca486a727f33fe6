import re

import pytest

from loomgraph.llm import urlrules as U

FIELDS = "page_id long, url string, html string, rule int, host int, verdict string"


def slow(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


@pytest.fixture(scope="module")
def odd_pages(spark):
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://a.Net", "x://a.example.net/en/1?q#f", "http://example.net/en", "http://b.org/fr/x://y.net/", "http://Éx.ORG/fr/?a=1", "http://example.com/de/", "http://notexample.com/de/", "http://a.example.com/de/1", "http://a.example.com/de/1"]
    return spark.createDataFrame([(i if i % 3 else None, u, "h", 1, 2, "v") for i, u in enumerate(urls)], FIELDS)


def check(rows, urls):
    for r, u in zip(rows, urls):
        host, path, rule = slow(u)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == rule[1])


def test_given_rules(odd_pages, spark):
    out = U.filter_urls(odd_pages, U.RULES)
    key = lambda r: (str(r["page_id"]), r["url"] or "")
    rows = sorted(out.collect(), key=key)
    check(rows, [r["url"] for r in sorted(odd_pages.collect(), key=key)])
    assert len(rows) == 14 and len(out.columns) == len(set(out.columns))
    assert U.filter_urls(odd_pages.limit(0), U.RULES).count() == 0
    assert {r["verdict"] for r in U.filter_urls(odd_pages, [("block", "nowhere.test", "/")]).collect()} == {U.DEFAULT}


def test_query_against_brute_force(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = U.op6_urls(spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    check(rows, [pages[r["page_id"]] for r in rows])


def slow_rules(rows, support, confidence, most):
    """Brute force over all token combinations."""
    from itertools import combinations

    n, found = len(rows), {}
    for size in range(1, most + 1):
        for a in {c for t, _ in rows for c in combinations(sorted(t), size)}:
            hit = [y for t, y in rows if set(a) <= set(t)]
            for label in set(hit):
                k = hit.count(label)
                if k / n >= support and k / len(hit) >= confidence:
                    found[a, label] = k / len(hit)
    part = lambda a: {(x,) for x in a} | {tuple(x for x in a if x != y) for y in a} - {()}
    return {(a, y): c for (a, y), c in found.items() if len(a) == 1 or not any(found.get((p, y), 0) >= c for p in part(a) if p != a)}


def test_mined_rules_against_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = []
    for _ in range(120):
        t = sorted({rng.choice("abcdefg") for _ in range(4)})
        rows.append((t, "block" if {"a", "b"} <= set(t) or ("c" in t and rng.random() < 0.9) else "allow"))
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    got = {(tuple(r["antecedent"]), r["label"]): r["confidence"] for r in U.pruned(U.mine(df, 0.05, 0.8, 3)).collect()}
    want = slow_rules(rows, 0.05, 0.8, 3)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_mined_verdicts_follow_the_surest_rule(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.{'net' if i % 2 else 'biz'}/{'xx' if i % 3 else 'yy'}/{i}") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if i % 3 == 0 else "allow") for i in range(0, 60, 2)], "page_id long, label string")
    rows = U.filter_urls(pages, [("block", "net", "/")], labels).collect()
    for r in rows:
        i = r["page_id"]
        assert r["verdict"] == ("block" if i % 2 or i % 3 == 0 else "allow")
