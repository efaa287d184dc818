import re

import pytest

from treeline.llm.queries import RULES
from treeline.llm.url_filter import host_edges, judge_urls, propagate

SCHEMA = "page_id long, url string, html string, host string, rule string, salt long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", 1) for r in rows], SCHEMA)


URLS = [
    (1, "https://A.Example.ORG/es/x?q"), (2, "http://example.org/en/15"), (3, "http://b.org"), (4, "x://m.com/fr/1#t"),
    (5, "https://com/de/"), (6, "https://shop.net/a?u=http://z.org/"), (7, None), (8, "no scheme/es/"), (9, "://org/"),
    (10, "http://notexample.org/es/"), (11, "http://telecom/fr/"), (12, ""), (12, ""), (None, "http://q.com?x/de/"),
]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_hosts_paths_and_rules(spark):
    out = judge_urls(pages(spark, [(i, u, None) for i, u in URLS]), RULES).collect()
    mine = sorted((repr((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None)) for r in out))
    assert mine == sorted(repr((i, *brute_rule(u))) for i, u in URLS)
    assert {r.verdict for r in out} <= {"allow", "block"}


def test_links_between_hosts(spark):
    html = """<a href="http://B.x/1"> <A HREF='//c.x?q'> <a href=https://b.x> <a href="/own"> <a href="http://a.x/self">"""
    df = spark.createDataFrame([("a.x", html), ("", html), ("d.x", None)], "host string, html string")
    assert {(r.src, r.dst, r.links) for r in host_edges(df).collect()} == {("a.x", "b.x", 2), ("a.x", "c.x", 1)}


def test_walk_against_power_iteration(spark):
    edges = {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "a"): 1.0, ("d", "c"): 1.0}
    seeds = {"a": 1.0, "d": 0.5}
    value = dict(seeds)
    for _ in range(20):
        flow = {}
        for (s, t), share in edges.items():
            flow[t] = flow.get(t, 0) + 0.85 * value.get(s, 0) * share
        rest = 1 - sum(flow.values()) / sum(seeds.values())
        value = {h: flow.get(h, 0) + seeds.get(h, 0) * rest for h in "abcd"}
    found = propagate(
        spark.createDataFrame([("trust", h, s) for h, s in seeds.items()], "kind string, host string, seed double"),
        spark.createDataFrame([("trust", s, t, w) for (s, t), w in edges.items()],
                              "kind string, src string, dst string, share double"),
        rounds=20, tolerance=0.0,
    )
    assert {r.host: r.value for r in found.collect()} == pytest.approx(value)


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    bad = '<a href="http://x.com/de/1">' * 3
    rows = [(1, "http://x.com/de/1", None), (2, "http://spam.net/", bad), (3, "http://fine.net/", "<p>")]
    rows += [(10 + k, "http://hot.net/", None) for k in range(50)]
    out = {r.page_id: r.verdict for r in judge_urls(pages(spark, rows), RULES).collect()}
    assert (out[1], out[2], out[3], out[10]) == ("block", "block", "allow", "allow")
    assert judge_urls(pages(spark, []), RULES).collect() == []


def test_verdicts_do_not_depend_on_unrelated_hosts(spark):
    chain = ["http://x.com/de/1", *(f"http://h{k}.net/" for k in range(1, 6))]
    rows = [(k, url, f'<a href="{chain[k - 1]}">' if k else None) for k, url in enumerate(chain)]
    alone = pages(spark, rows)
    others = spark.range(100, 20_100).selectExpr(
        "id as page_id", "concat('http://u', id, '.com/de/') as url", "cast(null as string) as html",
        "'h' as host", "'r' as rule", "1L as salt",
    )
    for table in (alone, alone.unionByName(others)):
        found = {r.page_id: r for r in judge_urls(table, RULES).where("page_id < 100").collect()}
        assert [found[k].distrust for k in range(6)] == pytest.approx([0.85 ** k for k in range(6)])
        assert {r.verdict for r in found.values()} == {"block"}
