import pytest

from millrace.llm import urls


def verdicts(spark, rows, rules=urls.RULES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS node", "'x' AS host")
    return {r.id: r for r in urls.judge(df, rules).collect()}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://net/", "net", "/", "net/"), ("http://net", "net", "", None), ("HTTPS://A.B.NET/x?q#f", "a.b.net", "/x", "net/"), ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/"),
        ("http://x.example.net/en", "x.example.net", "/en", "net/"), ("http://notexample.com/de/", "notexample.com", "/de/", None), ("http://example.com/de/a", "example.com", "/de/a", "example.com/de/"),
        ("http://planet/", "planet", "/", None), ("mailto:x", "", "", None), (None, "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("://h?x", "h", "", None), ("http://ÄB.net/ü", "Äb.net", "/ü", "net/"),
    ],
)
def test_rules(spark, url, host, path, rule):
    r = verdicts(spark, [(1, url, None)])[1]
    assert (r.host, r.path, r.rule) == (host, path, rule)


def test_aliases(spark):
    canon = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
    go = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    rows = [
        (1, "http://a.test/", go("http://b.test/")), (2, "http://b.test/", canon("http://c.test/x?a=1&amp;b=2")), (3, "http://c.test/x?a=1&b=2#top", go("http://spam.net/")),
        (4, "http://www.example.net/en/ok", go("http://spam.net/")), (5, "http://clean.test/", canon("/")), (6, "http://d.test/p/q", canon("r")), (7, "http://d.test/p/r", canon("//a.test/")),
        (8, "http://e.test/", canon("mailto:x@spam.net")), (9, "http://e.test/", None), (10, None, canon("http://spam.net/")), (11, "http://f.test/", '<link rel="stylesheet" href="http://spam.net/">'),
        (12, "http://g.test/", canon("http://x.org/fr/a")), (13, "http://b.test/", None),
    ]
    got = {i: r.verdict for i, r in verdicts(spark, rows).items()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 3, 6, 7, 13}


def test_no_rules_and_no_rows(spark):
    assert verdicts(spark, [(1, "http://net/", None)], [])[1].verdict == "allow"
    assert verdicts(spark, []) == {}


def test_refresh_targets_go_to_the_end_of_the_attribute(spark):
    go = lambda c: f"<meta http-equiv=\"refresh\" content={c}>"
    rows = [
        (1, "http://net/?a=1&b=2", None), (2, "http://b.test/?a=1&b=2", go('"0; url=http://net/"')), (3, "http://c.test/?a=1;b=2", go('"0; url=http://net/"')),
        (4, "http://x.test/1", go('"0; url=http://b.test/?a=1&amp;b=2"')), (5, "http://x.test/2", go('"0;URL=http://c.test/?a=1;b=2 "')), (6, "http://x.test/3", go("\"5; url='http://b.test/?a=1&amp;b=2'\"")),
        (7, "http://x.test/4", go("0;url=http://b.test/?a=1&amp;b=2")), (8, "http://x.test/5", go('"0; url=http://b.test/?a=1"')), (9, "http://x.test/6", go('"30"')),
    ]
    got = {i: r.verdict for i, r in verdicts(spark, rows).items()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 7}


def test_aliases_against_brute_force(spark):
    """Random chains, hubs and pairs of aliases, absolute and relative, against union-find in Python."""
    import random

    rng = random.Random(6)
    hosts = ["a.org", "b.example.net", "c.com", "d.net", "e.example.com", "f.example.net", "g.de"]
    where = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/p{k}?a=1&b={k}" for k in range(60)]
    pages, edges = [], []
    for k, url in enumerate(where):
        html, links = "<html>", []
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            to = where[0] if rng.random() < 0.3 else rng.choice(where)
            same = to.split("/")[2] == url.split("/")[2]
            shown = ("/" + to.split("/", 3)[3] if same and rng.random() < 0.5 else to).replace("&", "&amp;")
            html += rng.choice([f'<LINK href="{shown}" rel=canonical>', f"<link rel='canonical' href='{shown}#top'>", f'<meta http-equiv="Refresh" content="0; URL={shown}">', f"<meta content='5;url={shown}' http-equiv=refresh>"])
            links.append(to)
        pages.append((k, url, html))
        edges += [(url, to) for to in links]
    pages += [(60, None, "<link rel=canonical href=http://d.net/>"), (61, "no url", "x"), (62, where[3], None), (None, where[4], "")]
    up = {u: u for u in where}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)

    def rule(url):
        if not url or "://" not in url:
            return None
        host, path = url.split("/")[2], "/" + url.split("/", 3)[3].split("?")[0]
        fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda f: len(f[0])) if fits else None

    bad = {find(u) for u in where if (rule(u) or ("", ""))[1] == "block"}
    want = []
    for k, url, _ in pages:
        own = rule(url)
        want.append((k, own[0] if own else None, own[1] if own else "block" if url in up and find(url) in bad else "allow"))
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), urls.RULES)
    assert sorted(map(tuple, got.select("id", "rule", "verdict").collect()), key=repr) == sorted(want, key=repr)
    assert any(r is None and v == "block" for _, r, v in want)
