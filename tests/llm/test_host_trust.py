import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import host_trust


@pytest.mark.parametrize("url, host, path, rule", [
    ("http://www.Example.NET/en/x?q", "www.example.net", "/en/x", "example.net/en/"), ("https://a.net/de", "a.net", "/de", "net/"), ("http://example.com/de/1#f", "example.com", "/de/1", "example.com/de/"),
    ("http://x.org/fr/", "x.org", "/fr/", "org/fr/"), ("http://x.org/en", "x.org", "/en", None), ("http://planet/", "planet", "/", None), ("http://a.net", "a.net", "", None),
    ("http://a.net?x=/y", "a.net", "", None), ("a.net/x", "", "", None), (None, "", "", None), ("http://badexample.com/de/", "badexample.com", "/de/", None), ("x://y://z.net/", "y:", "//z.net/", None)])
def test_parts_and_rules(spark, url, host, path, rule):
    rows = spark.createDataFrame([(1, url, None, "c")], "page_id long, url string, html string, trust string")
    r = host_trust.judge(rows).first()
    assert (r.host, r.path, r.rule, r.trust) == (host, path, rule, "c")
    assert r.verdict == ("block" if rule in ("net/", "example.com/de/") else "allow")


def brute(seeds, links, rounds=host_trust.ROUNDS, d=host_trust.DAMPING):
    hosts = {*seeds, *(x for e in links for x in e[:2])}
    t = {h: seeds.get(h, (0, 0))[0] for h in hosts}
    u = {h: seeds.get(h, (0, 0))[1] for h in hosts}
    out, into = {}, {}
    for a, b, n in links:
        out[a], into[b] = out.get(a, 0) + n, into.get(b, 0) + n
    for _ in range(rounds):
        t, u = ({h: seeds.get(h, (0, 0))[0] + d * sum(t[a] * n / out[a] for a, b, n in links if b == h) for h in hosts},
                {h: seeds.get(h, (0, 0))[1] + d * sum(u[b] * n / into[b] for a, b, n in links if a == h) for h in hosts})
    return {h: (t[h], u[h]) for h in hosts}


def test_propagation_against_brute_force(spark):
    r = random.Random(5)
    seeds = {f"h{i}": (r.choice([0, 0, 1.0]), r.choice([0, 0, 0.5])) for i in range(12)}
    links = sorted({(f"h{r.randrange(15)}", f"h{r.randrange(15)}") for _ in range(40)})
    links = [(a, b, r.randint(1, 5)) for a, b in links if a != b]
    state = host_trust.propagate(spark.createDataFrame([(k, *map(float, v)) for k, v in seeds.items()], "host string, trust_seed double, distrust_seed double"),
                                 spark.createDataFrame(links, "src string, dst string, pages long"), tolerance=0.0)
    want = brute(seeds, links)
    assert {x.host: (pytest.approx(x.trust), pytest.approx(x.distrust)) for x in state.collect()} == want


def test_links_carry_distrust_back_and_trust_forward(spark):
    to = lambda *hosts: "".join(f"<a class=x\nhref='http://{h}/'>" for h in hosts)
    rows = [(1, "http://bad.net/x", None), (2, "http://farm.info/a", to("bad.net", "farm.info")), (3, "http://mixed.info/a", to("bad.net")), (3, "http://mixed.info/a", to("bad.net")),
            (4, "http://good.org/fr/a", to("mixed.info")), (5, "http://far.info/", to("farm.info")), (6, "http://none.info/", "<a href=/rel>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in host_trust.judge(pages).collect()}
    assert got[1] == "block" and got[4] == got[6] == "allow"
    edges = {(e.src, e.dst): e.pages for e in host_trust.edges(pages).collect()}
    assert edges == {("farm.info", "bad.net"): 1, ("mixed.info", "bad.net"): 2, ("good.org", "mixed.info"): 1, ("far.info", "farm.info"): 1}
    assert len(host_trust.judge(pages).collect()) == 7
    assert got[3] == "allow" and got[2] == "allow"  # a third of bad.net's in-links, 0.28 of its distrust
    heavy = spark.createDataFrame([(1, "http://bad.net/x", None), (2, "http://farm.info/a", to("bad.net"))], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in host_trust.judge(heavy).collect()} == {1: "block", 2: "block"}


def test_empty(spark):
    assert host_trust.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert F is not None


def test_a_cycle_is_followed_to_its_fixed_point(spark):
    to = lambda h: f"<a href='http://{h}/'>"
    rows = [(i, f"http://a.example.com/{'de/' if i < 15 else 'x/'}{i}", to("b.info")) for i in range(100)] + [(100, "http://b.info/", to("a.example.com"))]
    rules = (("block", "a.example.com/de/"),)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("a.example.com", 0.0, 0.15), ("b.info", 0.0, 0.0)], "host string, trust_seed double, distrust_seed double")
    d = host_trust.DAMPING
    want = np.linalg.solve(np.array([[1, -d], [-d, 1]]), np.array([0.15, 0.0]))
    state = {r.host: r.distrust for r in host_trust.propagate(seeds, host_trust.edges(pages)).collect()}
    assert state["a.example.com"] == pytest.approx(want[0], abs=1e-5) and state["b.info"] == pytest.approx(want[1], abs=1e-5)
    assert want[0] > host_trust.THRESHOLD
    verdicts = {r.verdict for r in host_trust.judge(pages, rules).where("host = 'a.example.com'").collect()}
    assert verdicts == {"block"}
    with pytest.raises(RuntimeError, match="settle"):
        host_trust.propagate(seeds, host_trust.edges(pages), rounds=3)
