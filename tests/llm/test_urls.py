import pytest

from annoweave.llm import urls
from llm.brute import SF_SMALL


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    tail = rest[at:]
    return host, tail[:min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]


def plain_rule(host, path):
    fits = [(h + p, v) for h, p, v in urls.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


URLS = ["http://example.org/en/1", "https://A.Example.ORG/es/x?y#z", "http://example.org", "ftp://x.com/fr/", None,
        "no scheme", "http://", "://a.com/de/?q", "http://example.com?/fr/", "http://notexample.org/es/1",
        "http://x.org:80/a", "http://ÀB.org/É", "a://b://c.com/fr/", "http://com/de/1", "http://x.com#/de/",
        "http://example.org/en/10", "HTTP://\nexample.org/es/\nx"]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in found:
        host, path = plain(URLS[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def link(*hosts):
    return "".join(f'<p><A class=x HREF="http://{h}/p">x</a>' for h in hosts)


GRAPH = [("a.org", "/x", link("good.net", "good.net", "mid.net")), ("b.com", "/de/x", link("a.org")),
         ("farm.net", "/", link("b.com", "b.com") + '<a href="/own">'), ("farm2.net", "/", link("farm.net", "b.com")),
         ("good.net", "/", link("deep.net")), ("deep.net", "/", ""), ("alone.net", "/", None),
         ("mid.net", "/", link("b.com", "good.net")), ("self.net", "/", link("self.net"))]


def brute_rank(links, share, steps, damping):
    out = {}
    for s, t, n in links:
        out[s] = out.get(s, 0) + n
    rank = {h: (1 - damping) * x for h, x in share.items()}
    start = dict(rank)
    for _ in range(steps):
        new = dict(start)
        for s, t, n in links:
            new[t] = new.get(t, 0.0) + damping * rank.get(s, 0.0) * n / out[s]
        rank = {h: round(x, 12) for h, x in new.items()}
    return rank


def test_trust_and_distrust_spread_over_links(spark):
    rows = [(i, f"http://{h}{p}", html) for i, (h, p, html) in enumerate(GRAPH)]
    found = {r.host: r for r in urls.judge(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    links = {}
    for h, _, html in GRAPH:
        for t in [x.split("/p")[0] for x in (html or "").split("http://")[1:]]:
            if t != h:
                links[h, t] = links.get((h, t), 0) + 1
    forward = [(s, t, n) for (s, t), n in links.items()]
    trust = brute_rank(forward, {"a.org": 1.0}, urls.STEPS, urls.DAMPING)
    doubt = brute_rank([(t, s, n) for s, t, n in forward], {"b.com": 1.0}, urls.STEPS, urls.DAMPING)
    for host, r in found.items():
        assert r.trust == pytest.approx(trust.get(host, 0.0), abs=1e-9)
        assert r.distrust == pytest.approx(doubt.get(host, 0.0), abs=1e-9)
    verdicts = {h: r.verdict for h, r in found.items()}
    assert verdicts == {"a.org": "allow", "b.com": "block", "farm.net": "block", "farm2.net": "block",
                        "good.net": "allow", "deep.net": "allow", "alone.net": "allow",
                        "mid.net": verdicts["mid.net"], "self.net": "allow"}


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    found = urls.judge(pages.selectExpr("*", "1 host", "2 path", "3 rule", "4 trust")).collect()
    assert len(found) == pages.count()
    want = {r.page_id: plain(r.url) for r in pages.collect()}
    assert all((r.host, r.path) == want[r.page_id] for r in found)


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_ranks_do_not_depend_on_the_number_of_seeds(spark):
    """Two hops over hosts with a thousand links each, from one page among many."""
    links = spark.createDataFrame(
        [("seed.net", "a.net", 1), ("seed.net", "x.net", 999), ("a.net", "b.net", 1), ("a.net", "x.net", 999),
         ("b.net", "c.net", 1), ("c.net", "b.net", 1), ("c.net", "x.net", 9)], "source string, target string, n long")

    def ranks(share):
        seeds = spark.createDataFrame([("seed.net", share)], "host string, share double")
        return {r.host: r.rank for r in urls.propagate(links, seeds).collect()}

    whole, part = ranks(1.0), ranks(1e-8)
    assert set(whole) == set(part) == {"seed.net", "a.net", "b.net", "c.net", "x.net"}
    assert whole["b.net"] == pytest.approx(0.15 * 0.00085 ** 2 / (1 - 0.085 * 0.85), rel=1e-8)
    assert all(part[h] == pytest.approx(1e-8 * whole[h], rel=1e-8) for h in whole)


def test_hosts_far_from_a_seed_are_reached(spark):
    rows = [(0, "http://b.com/de/x", "")] + [
        (i, f"http://h{i}.net/", link(f"h{i - 1}.net" if i > 1 else "b.com")) for i in range(1, 21)]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.verdict for r in found} == {"block"}
    assert all(r.distrust == pytest.approx(0.15 * 0.85 ** r.page_id, rel=1e-8) for r in found)
