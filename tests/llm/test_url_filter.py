import pytest

from lodestone.llm import url_filter as op
from lodestone.llm.queries import URL_RULES


def judged(spark, rows, rules=URL_RULES):
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, rank int")
    return [(r.host, r.path, r.rule, r.verdict) for r in op.judge(frame, rules).orderBy("page_id").collect()]


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.ORG/es/1?q", "https://example.org/en/12", "https://example.org/en/2#x", "x://b.com/fr/a", "https://b.com/de/", "https://xcom/de/", "https://b.com", "no scheme", None, "", "http://org?x=/es/", "http://org/", "a://b://c/d", "http://notexample.org/es/"]
    want = [
        ("a.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"),
        ("b.com", "/fr/a", "com/fr/", "allow"),
        ("b.com", "/de/", "com/de/", "block"),
        ("xcom", "/de/", None, "allow"),
        ("b.com", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("org", "", None, "allow"),
        ("org", "/", "org/", "allow"),
        ("b:", "//c/d", None, "allow"),
        ("notexample.org", "/es/", "org/", "allow"),
    ]
    assert judged(spark, [(u, None) for u in urls]) == want
    assert judged(spark, []) == []


def test_distrust_flows_against_links_and_trust_along(spark):
    link = lambda *hosts: "".join(f'<A HREF="https://{h}/x">.</a><a href="/own">.</a>' for h in hosts)
    rows = [("http://bad.test/de", None), ("http://farm.net/", link("bad.test", "bad.test")), ("http://good.org/", link("news.net")), ("http://news.net/a", link("good.org", "news.net")), ("http://other.net/a", "")]
    rules = [("block", "bad.test", "/"), ("allow", "org", "/")]
    assert [x[3] for x in judged(spark, rows, rules)] == ["block", "block", "allow", "allow", "allow"]


def test_verdicts_over_a_random_graph_against_brute_force(spark):
    import random

    rng = random.Random(2)
    hosts = [f"h{i}.{rng.choice(['org', 'com', 'com', 'net', 'net'])}" for i in range(25)]
    pages = [(rng.choice(hosts), rng.choice(["/fr/", "/de/", "/de/", "/de/", "/x"]), rng.choices(hosts, k=rng.randint(0, 4))) for _ in range(90)]
    rows = [(f"https://{h}{p}{i}", "".join(f'<a href="//{t}/y">.</a>' for t in to)) for i, (h, p, to) in enumerate(pages)]
    rule = lambda h, p: "allow" if h.endswith(".org") or h.endswith(".com") and p == "/fr/" else "block" if h.endswith(".com") and p == "/de/" else None
    own = {h: [rule(a, p) for a, p, _ in pages if a == h] for h in {h for h, _, _ in pages}}
    links = {}
    for h, _, to in pages:
        for t in to:
            if t != h:
                links[h, t] = links.get((h, t), 0) + 1

    def rank(links, verdict):
        seed = {h: own[h].count(verdict) / len(own[h]) for h in own}
        out = {h: sum(n for (a, _), n in links.items() if a == h) for h in hosts}
        now = {h: 0.15 * seed.get(h, 0) for h in hosts}
        for _ in range(op.ROUNDS):
            now = {h: 0.15 * seed.get(h, 0) + sum(0.85 * now[a] * n / out[a] for (a, b), n in links.items() if b == h) for h in hosts}
        return {h: x / 0.15 for h, x in now.items()}

    trust, distrust = rank(links, "allow"), rank({(b, a): n for (a, b), n in links.items()}, "block")
    want = [rule(h, p) or ("block" if distrust[h] - trust[h] > op.THRESHOLD else "allow") for h, p, _ in pages]
    assert {rule(h, p) and "rule" or v for (h, p, _), v in zip(pages, want)} == {"rule", "allow", "block"}
    assert [x[3] for x in judged(spark, rows)] == want


def test_propagation_against_brute_force(spark):
    import random

    rng = random.Random(1)
    edges = {(f"h{rng.randrange(9)}", f"h{rng.randrange(9)}"): rng.randint(1, 4) for _ in range(30)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    seeds = {f"h{i}": i / 10 for i in range(9)}
    rank = {h: 0.15 * s for h, s in seeds.items()}
    out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in seeds}
    for _ in range(op.ROUNDS):
        rank = {h: 0.15 * seeds[h] + sum(0.85 * rank[a] * n / out[a] for (a, b), n in edges.items() if b == h) for h in seeds}
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "source string, target string, n long")
    got = {r.host: r.rank for r in op.propagate(frame, spark.createDataFrame(list(seeds.items()), "host string, seed double")).collect()}
    assert got == {h: pytest.approx(x / 0.15) for h, x in rank.items()}
