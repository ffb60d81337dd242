"""URL filters against a plain twin, and the SQL on planted aliases."""

import random

import duckdb
import pandas as pd
import pytest

from tidemark.llm import urls
from tidemark.llm.urls import Rule

SCHEMA = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def longest(host, path, rules):
    found = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(found, key=lambda r: (len(r.name), len(r.host)), default=None)


def brute(pages, edges, rules=urls.RULES):
    """``edges`` as (url, target) pairs, absolute."""
    group = {}

    def top(n):
        group.setdefault(n, n)
        while group[n] != n:
            n = group[n]
        return n

    for a, b in edges:
        group[top(urls.node_of(a))] = top(urls.node_of(b))
    blocked = set()
    for n in list(group):
        rule = longest(*parts(n), rules)
        if rule and rule.verdict == "block":
            blocked.add(top(n))
    out = []
    for page_id, url, _ in pages:
        host, path = parts(url)
        rule = longest(host, path, rules)
        reached = url is not None and "://" in url and urls.node_of(url) in group and top(urls.node_of(url)) in blocked
        out.append((page_id, host, path, rule and rule.name, rule.verdict if rule else "block" if reached else "allow"))
    return sorted(out, key=str)


def run(spark, pages, **kw):
    return sorted(map(tuple, urls.judge(spark.createDataFrame(pages, SCHEMA).repartition(3), **kw).collect()), key=str)


def canonical(target):
    return f'<html><head><link rel="canonical" href="{target}"></head><body><p>x</p></body></html>'


def refresh(target):
    return f"<html><head><meta http-equiv=refresh content='0; url={target}'></head></html>"


ODD = [
    (1, None, "<p>x</p>"), (2, "", None), (3, "no scheme.net/x", ""), (4, "http://", ""), (5, "HTTP://A.NET", ""), (6, "http://A.NET/", ""),
    (7, "http://b.example.net/en/1", ""), (8, "http://notexample.net/en/", ""), (9, "http://example.com/de", ""), (10, "http://example.com/de/?q", ""),
    (11, "http://x.org?/fr/", ""), (12, "http://x.org/fr/#a://b", ""), (13, "x://y://z.net/", ""), (14, "http://Ä.net/É?x", ""), (15, "http://net/", ""),
    (15, "http://net/", ""), (None, "http://example.org/fr/1", ""), (16, "https://user:p@h.org:80/fr/a", ""), (17, "//x.net/", ""), (18, "http://x.net/" + "a" * 200_000, ""),
]


def test_rules(spark):
    assert run(spark, ODD) == brute(ODD, [])
    rules = (Rule("block", "a.b", "/"), Rule("allow", "b", "/x/"), Rule("allow", "a.b", "/x/y"))
    pages = [(i, f"http://{h}{p}", "") for i, (h, p) in enumerate((h, p) for h in ("b", "a.b", "ca.b", "c.a.b") for p in ("", "/", "/x/", "/x/y", "/x/yz?"))]
    assert run(spark, pages, rules=rules) == brute(pages, [], rules)
    with pytest.raises(ValueError):
        Rule("maybe", "a", "/")


def test_blocks_reach_aliases(spark):
    pages = [
        (1, "http://one.org/a", canonical("http://spam.net/a")),                    # target blocked, itself no page
        (2, "http://two.org/a", refresh("http://one.org/a#top")),                   # two steps away, fragment ignored
        (3, "http://three.org/a", canonical("http://TWO.org/a")),                   # three steps, case of the host
        (4, "http://x.org/fr/a", canonical("http://spam.net/a")),                   # explicit allow wins
        (5, "http://five.org/a", canonical("http://x.org/fr/b")), (6, "http://x.org/fr/b", ""),
        (7, "http://a.example.net/en/7", canonical("http://seven.org/a")), (8, "http://seven.org/a", ""),
        (9, "http://nine.org/dir/p?q=1", canonical("../other")), (10, "http://nine.org/other", refresh("//Evil.net")),
        (11, "http://eleven.org/", '<!-- <link rel="canonical" href="http://spam.net/a"> --><script>"<link rel=canonical href=http://spam.net/a>"</script>'),
        (12, "http://twelve.org/", '<link href="http://spam.net/a" rel=stylesheet>'), (13, "http://thirteen.org/a?x=1&y=2", ""),
        (14, "http://spam.net/b", canonical("http://thirteen.org/a?x=1&amp;y=2")), (15, "http://thirteen.org/a", ""),
        (16, "http://sixteen.org", ""), (17, "http://spam.net/c", refresh("http://sixteen.org/")), (18, "http://one.org/a", canonical("http://spam.net/a")),
        (19, "http://bad.org/", canonical("http://[oops/")), (20, None, canonical("http://spam.net/a")),
    ]
    edges = [(p[1], t) for p, t in (
        (pages[0], "http://spam.net/a"), (pages[1], "http://one.org/a"), (pages[2], "http://two.org/a"), (pages[3], "http://spam.net/a"),
        (pages[4], "http://x.org/fr/b"), (pages[6], "http://seven.org/a"), (pages[8], "http://nine.org/other"), (pages[9], "http://evil.net"),
        (pages[13], "http://thirteen.org/a?x=1&y=2"), (pages[16], "http://sixteen.org/"))]
    found = run(spark, pages)
    assert found == brute(pages, edges)
    by = {r[0]: r[-1] for r in found}
    assert [by[i] for i in (1, 2, 3, 9, 10, 13, 16)] == ["block"] * 7
    assert [by[i] for i in (4, 5, 6, 8, 11, 12, 15, 19, 20)] == ["allow"] * 9


def test_many_aliases_and_the_sql(spark):
    rng = random.Random(9)
    hosts = ["a.net", "b.example.net", "c.org", "d.example.com", "e.io", "f.io"]
    address = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(60)}"
    pages, edges = [], []
    for i in range(300):
        url, target = address(), address()
        linked = rng.random() < 0.4
        pages.append((i, url, rng.choice([canonical, refresh])(target) if linked else "<p>no</p>"))
        edges += [(url, target)] if linked else []
    pages += [(1000 + i, f"http://hub{i}.io/", canonical("http://e.io/en/1")) for i in range(200)]  # one hub
    edges += [(f"http://hub{i}.io/", "http://e.io/en/1") for i in range(200)]
    found = run(spark, pages)
    assert found == brute(pages, edges)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages + ODD, columns=["page_id", "url", "html"]))
    assert sorted(con.execute(urls.SQL).fetchall(), key=str) == sorted(brute(pages + [p for p in ODD if p[0] is not None], edges) + [
        (None, "example.org", "/fr/1", "org/fr/", "allow")], key=str)
    given = spark.createDataFrame([("http://e.io/en/1", "http://a.net/")], "src string, dst string")
    assert {r[-1] for r in run(spark, [(1, "http://e.io/en/1", "")], edges=given)} == {"block"}


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "http://a.net/x", None, "n", True, "r")], SCHEMA + ", node string, _blocked boolean, rule string")
    found = urls.judge(df)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert tuple(found.first()) == (1, "a.net", "/x", "net/", "block")
