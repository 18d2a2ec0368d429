from mosaiq.llm import urls


def page(i, url, html=""):
    return (i, url, html)


ROWS = [
    page(1, "https://a.org/x"), page(2, "http://m.example.org/es/1"), page(3, "http://example.org/en/12?q"), page(4, "HTTP://WWW.B.COM/fr/?a#b"),
    page(5, "https://c.com/de/"), page(6, "no scheme"), page(7, None), page(8, "https://d.net#frag"), page(9, "https://porg/x"), page(10, "https://org/x"), page(11, "https://d.net#frag"),
    page(12, "https://good.net/", '<a href="https://a.org/y">'), page(13, "https://liked.net/z"), page(14, "https://a.org/links", '<a href="//liked.net/">'),
    page(15, "https://spam.net/", '<a href="http://c.com/de/1"><a href=http://c.com/>'), page(16, "https://c.com/de/2", None),
]


def test_hosts_rules_and_verdicts(spark):
    got = {r.page_id: r for r in urls.judge_pages(spark.createDataFrame(ROWS, "page_id long, url string, html string")).collect()}
    assert len(got) == len(ROWS)
    assert [(got[i].host, got[i].path) for i in (3, 4, 6, 7, 8)] == [("example.org", "/en/12"), ("www.b.com", "/fr/"), ("", ""), ("", ""), ("d.net", "")]
    assert [got[i].rule for i in (1, 2, 3, 4, 5, 8, 9, 10)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, "org/"]
    assert [got[i].verdict for i in (1, 2, 3, 5, 6, 7, 8)] == ["allow", "block", "block", "block", "allow", "allow", "allow"]
    assert got[15].verdict == "block" and got[15].distrust > 0  # links to what is blocked
    assert got[13].verdict == "allow" and got[13].trust > 0  # is linked from what is allowed


def test_empty(spark):
    assert urls.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation_against_dense_iteration(spark):
    import numpy as np

    r = np.random.default_rng(1)
    n = 12
    links = {(i, j): int(r.integers(1, 4)) for i in range(n) for j in range(n) if i != j and r.random() < 0.2}
    out = {i: sum(w for (a, _), w in links.items() if a == i) for i in range(n)}
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", w / out[a]) for (a, b), w in links.items()], "src string, dst string, w double")
    hosts = spark.createDataFrame([(f"h{i}",) for i in range(n)], "host string")
    seeds = spark.createDataFrame([(f"h{i}", float(i == 0), float(i == 1)) for i in range(n)], "host string, trust double, distrust double")
    got = {x.host: (x.trust, x.distrust) for x in urls.propagate(urls.both_ways(edges, hosts), seeds, 7).collect()}
    along, back = np.zeros((n, n)), np.zeros((n, n))
    for (a, b), w in links.items():
        along[a, b] = w / out[a]
        back[b, a] = w / out[a]
    for m in (along, back):
        for i in range(n):
            m[i] = m[i] / m[i].sum() if m[i].sum() else np.eye(n)[i]
    t, d = np.eye(n)[0], np.eye(n)[1]
    for _ in range(7):
        t, d = 0.85 * t @ along + 0.15 * np.eye(n)[0], 0.85 * d @ back + 0.15 * np.eye(n)[1]
    for i in range(n):
        assert np.allclose(got.get(f"h{i}", (0, 0)), (t[i], d[i]))
