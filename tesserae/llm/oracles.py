"""DuckDB SQL that says what some of the operators return."""

from __future__ import annotations

from tesserae.llm import url_graph

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def jaccard_sql(n: int = 3, percent: int = 90) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * i >= {percent} * (len(a.s) + len(b.s) - i)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), d AS (SELECT x, count(*) AS n FROM b GROUP BY x),
k AS (SELECT s, count(*) AS n FROM s WHERE len(s) > 0 GROUP BY s)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, coalesce(d.n, 0) AS n_links, coalesce(k.n, 1) AS copies
FROM s JOIN c ON c.x = s.doc_id LEFT JOIN d ON d.x = s.doc_id LEFT JOIN k ON k.s = s.s
"""


def url_sql() -> str:
    rules = sorted(url_graph.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in rules]
    name = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True)) + " END"
    d = url_graph.DAMPING
    steps = "".join(
        f"""
s{k} AS (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT y AS host, t * wt * {d} AS t, 0.0 AS d FROM g JOIN s{k - 1} ON s{k - 1}.host = g.x UNION ALL
  SELECT x, 0.0, d * wd * {d} FROM g JOIN s{k - 1} ON s{k - 1}.host = g.y UNION ALL SELECT host, (1 - {d}) * t, (1 - {d}) * d FROM s0) GROUP BY host),"""
        for k in range(1, url_graph.ROUNDS + 1)
    )
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
v AS (SELECT *, {name} AS rule, {verdict} AS by_rule FROM p),
h AS (SELECT host, count(*) FILTER (WHERE by_rule = 'allow') AS a, count(*) FILTER (WHERE by_rule = 'block') AS b FROM v WHERE host <> '' GROUP BY host),
s0 AS (SELECT host, coalesce(a / nullif((SELECT sum(a) FROM h), 0), 0.0) AS t, coalesce(b / nullif((SELECT sum(b) FROM h), 0), 0.0) AS d FROM h),
m AS (SELECT host AS x, translate(unnest(regexp_extract_all(coalesce(html, ''), '{url_graph.HOST_NAME}')), '{_UPPER}', '{_LOWER}') AS y FROM v WHERE host <> ''),
l AS (SELECT x, y, count(*) AS n FROM m WHERE x <> y AND y IN (SELECT host FROM h) GROUP BY 1, 2),
g AS (SELECT x, y, n / sum(n) OVER (PARTITION BY x) AS wt, n / sum(n) OVER (PARTITION BY y) AS wd FROM l),{steps}
z AS (SELECT * FROM s{url_graph.ROUNDS})
SELECT page_id, v.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(z.d, 0) > coalesce(z.t, 0) THEN 'block' ELSE 'allow' END) AS verdict FROM v LEFT JOIN z ON z.host = v.host
"""


def divergence_sql(min_docs: int = 10, top: int = 10) -> str:
    p = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({mass} + 2 * v)"
    gap = "CAST((({a} - {b}) * ({a} - {b})) // ({a} + {b}) AS BIGINT)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= {min_docs}),
l AS (SELECT lang, sum(total) AS lang_mass, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
m AS (SELECT lang, source, sum(n) AS mass FROM c GROUP BY 1, 2),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, total, {p.format(n="coalesce(n, 0)", mass="coalesce(mass, 0)")} AS p, {p.format(n="total", mass="lang_mass")} AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN m USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum({gap.format(a="a.p", b="b.p")}) AS BIGINT) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {gap.format(a="p", b="q")} FROM s WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= {top}
"""


def collocation_sql(threshold: int = 100, longest: int = 5, share: int = 100, first: int = 2000) -> str:
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {longest + 1}) AS r(k)),
f AS (SELECT lang, w[i : i + k - 1] AS ws, count(*) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= {threshold}),
e AS (SELECT lang, array_to_string(ws, ' ') AS phrase, ws, a FROM f),
s AS (SELECT lang, ws, a, unnest(flatten(list_transform(range(2, len(ws)), lambda n: list_transform(range(1, len(ws) - n + 2), lambda i: ws[i : i + n - 1])))) AS ins FROM e WHERE len(ws) > 2),
m AS (SELECT lang, ins, max(a) AS longer FROM s GROUP BY 1, 2),
c AS (SELECT e.*, unnest(range(1, len(e.ws))) AS k FROM e LEFT JOIN m ON m.lang = e.lang AND m.ins = e.ws WHERE len(e.ws) > 1 AND (longer IS NULL OR 100 * longer < {share} * e.a)),
x AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, CAST((c.a::HUGEINT * n * 1000) // (l.a::HUGEINT * r.a) AS BIGINT) AS score, k
  FROM c JOIN e l ON l.lang = c.lang AND l.ws = c.ws[1 : k] JOIN e r ON r.lang = c.lang AND r.ws = c.ws[k + 1 :] JOIN t ON t.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM x),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b WHERE o = 1)
SELECT * FROM z WHERE rank <= {first}
"""
