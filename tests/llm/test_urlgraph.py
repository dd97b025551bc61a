import re

import pytest

from gleanery.llm.urlgraph import judge_urls, spread

SCHEMA = "page_id long, url string, html string, host string, verdict string"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
    return host, m[2] if m else ""


def by_rule(host, path):
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def page(i, url, *links):
    nav = "".join(f'<li><a href="{x}">x</a></li>' for x in links)
    return (i, url, f"<html><body><nav><ul>{nav}</ul></nav></body></html>", "clash", "clash")


ODD = [
    page(1, "https://A.Example.NET/en/x?y#z"),
    page(2, "https://a.example.net/de/x"),
    page(3, "http://www.example.com/de/1"),
    page(4, "http://www.example.com/en/1"),
    page(5, "http://www.example.com/en/2"),
    page(6, "http://www.example.com/en/3"),
    page(7, "http://notexample.com/de/1"),
    page(8, "https://x.org/fr/"),
    page(9, "https://x.org/fr"),
    page(10, "http://evil.net"),
    page(11, "http://evil.net/a"),
    page(12, None),
    page(13, "no scheme"),
    page(14, ""),
    page(15, "ftp://h?q://other/x"),
    page(16, "a://b://c/d"),
    page(17, "http://ÄÖ.org/fr/1"),
    (18, "http://nohtml.org/", None, "clash", "clash"),
    page(None, "http://evil.net/b"),
    page(11, "http://evil.net/a"),
    page(19, "http://long.org/" + "x" * 5000),
]


def test_rules_hosts_and_paths(spark):
    rows = judge_urls(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(rows) == len(ODD)
    urls = {r[0]: r[1] for r in ODD}
    for r in rows:
        host, path = parts(urls[r["page_id"]])
        rule, verdict = by_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        # A page of evil.net without a path fits no rule, but its host is a seed of distrust.
        assert r["verdict"] == (verdict or ("block" if host == "evil.net" else "allow"))


def test_distrust_flows_backwards_and_trust_answers(spark):
    evil = [page(100 + i, f"http://evil{i}.net/a") for i in range(4)]
    farm = [page(200 + i, f"http://farm.com/{i}", *(f"http://evil{j}.net/a" for j in range(4))) for i in range(3)]
    good = [page(300 + i, f"http://good.org/fr/{i}", "http://friend.com/") for i in range(3)]
    friend = [page(400, "http://friend.com/", "http://evil0.net/a"), page(401, "http://plain.com/")]
    rows = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(evil + farm + good + friend, SCHEMA)).collect()}
    assert {rows[200 + i]["verdict"] for i in range(3)} == {"block"}
    assert rows[200]["distrust"] > rows[400]["distrust"] > 0
    assert rows[400]["verdict"] == "allow" and rows[400]["trust"] > 0
    assert rows[401]["verdict"] == "allow" and rows[401]["distrust"] == 0


def test_scores_equal_power_iteration(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "a", 1.0)]
    seeds = {"a": 1.0, "b": 0.0, "d": 0.25}
    frame = spark.createDataFrame(edges, "src string, dst string, share double")
    got = spread(spark.createDataFrame(list(seeds.items()), "host string, weight double"), frame, rounds=12)
    scores = dict(seeds)
    for _ in range(12):
        scores = {
            h: seeds.get(h, 0.0) + 0.85 * sum(scores.get(s, 0) * w for s, d, w in edges if d == h) for h in "abcd"
        }
    found = {r["host"]: r["score"] for r in got.collect()}
    assert found == pytest.approx({h: s for h, s in scores.items() if s})


def test_no_rows(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_over_all_pages(spark):
    from gleanery.llm.queries import op7_url_filters

    folder = "/root/testdata/sf0.001"
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op7_url_filters(spark, folder).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    blocked, pages = {}, {}
    for u in urls.values():  # no page links to another host: a host's own pages decide
        host, path = parts(u)
        pages[host] = pages.get(host, 0) + 1
        blocked[host] = blocked.get(host, 0) + (by_rule(host, path)[1] == "block")
    for r in rows:
        host, path = parts(urls[r["page_id"]])
        rule, verdict = by_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        allowed = sum(by_rule(*parts(u))[1] == "allow" for u in urls.values() if parts(u)[0] == host) / pages[host]
        share = blocked[host] / pages[host]
        assert r["verdict"] == (verdict or ("block" if share >= 0.5 and share > allowed else "allow"))
