from tesserae.llm import url_graph as ug

PAGES = [
    (1, "https://www.Example.COM/en/x?q=1", "see bad.org and good.org"), (2, "http://example.com/en/1", "bad.org"), (3, "http://a.net/es/1", "bad.org bad.org"),
    (4, "http://a.net/de/1", None), (5, None, "x.com"), (6, "no scheme", "y"), (7, "http://good.org/p", "nothing"), (8, "http://bad.org/", '<a href="http://a.net/fr/">x</a> a.net'),
    (9, "http://com", "z"), (10, "ftp://com/z#f", "z"), (11, "http://x.com?en/", ""), (12, "http://notexample.com/en/", ""), (13, "http://net/fr/", ""), (13, "http://net/fr/", ""), (14, "http://evil.org/x", "net a.net"),
]


def brute(pages, rounds=ug.ROUNDS, d=ug.DAMPING):
    import re

    rows = []
    for pid, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^/?#]*([^?#]*)", rest)[1]
        fit = [r for r in ug.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        rows.append((pid, host, path, best, html or ""))
    hosts = {r[1] for r in rows} - {""}
    edges = {}
    for _, h, _, _, html in rows:
        for m in re.findall(ug.HOST_NAME, html):
            if h and m.lower() in hosts and m.lower() != h:
                edges[h, m.lower()] = edges.get((h, m.lower()), 0) + 1
    seeds = []
    for what in ("allow", "block"):
        n = {h: sum(1 for r in rows if r[1] == h and r[3] and r[3][0] == what) for h in hosts}
        seeds.append({h: v / (sum(n.values()) or 1) for h, v in n.items()})
    scores = []
    for k, seed in enumerate(seeds):
        s = dict(seed)
        for _ in range(rounds):
            new = {h: (1 - d) * seed[h] for h in hosts}
            for (a, b), n in edges.items():
                x, y = (a, b) if k == 0 else (b, a)
                new[y] += d * s[x] * n / sum(v for (p, q), v in edges.items() if (p if k == 0 else q) == x)
            s = new
        scores.append(s)
    return sorted((p, h, path, r[1] + r[2] if r else None, r[0] if r else ("block" if scores[1].get(h, 0) > scores[0].get(h, 0) else "allow")) for p, h, path, r, _ in rows)


def key(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, host string")
    got = key(tuple(r) for r in ug.judged(df).collect())
    assert got == key(brute(PAGES))
    assert {r[0]: r[4] for r in got}[14] == "block"  # it links to blocked hosts, and no trusted one links to it


def test_on_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert key(tuple(r) for r in ug.judged(pages).collect()) == key(brute([(r.page_id, r.url, r.html) for r in pages.collect()]))


def test_empty_and_without_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", "x")], "page_id long, url string, html string")
    assert ug.judged(df.limit(0)).collect() == []
    assert [tuple(r) for r in ug.judged(df, []).collect()] == [(1, "a.b", "/c", None, "allow")]
