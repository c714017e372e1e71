"""DuckDB SQL for the queries that SQL can express on whole tables.

op1 and op10 need a tokenizer, op6 a digest of hashed bytes, op7 positions of overlapping
kinds and links, op9 a learned profile, and the pipeline several of these: tests hold them
against plain Python instead."""

from __future__ import annotations

from millrace.llm.urls import LOWER, UPPER, Rule

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _url(url: str) -> tuple[str, str, str]:
    part = lambda rest: f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://{rest}', 1)"
    return f"translate({part('([^/?#]*)')}, '{UPPER}', '{LOWER}')", part("[^/?#]*([^?#]*)"), part("[^/?#]*[^?#]*(.*)$")


def _node(url: str) -> str:
    host, path, more = _url(url)
    return f"CASE WHEN {host} <> '' THEN {host} || (CASE WHEN {path} = '' THEN '/' ELSE {path} END) || regexp_extract({more}, '^\\?[^#]*') END"


def _rule(host: str, path: str, rules: list[Rule], field: str) -> str:
    cases = " ".join(
        f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{getattr(r, field)}'"
        for r in sorted(rules, key=lambda r: -len(r.text))
    )
    return f"CASE {cases} END"


def _attr(name: str) -> str:
    p = rf"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return "replace(trim(" + " || ".join(f"regexp_extract(tag, '{p}', {i})" for i in (1, 2, 3)) + "), '&amp;', '&')"


def op2(rules: list[Rule]) -> str:
    host, path, _ = _url("url")
    th, tp, _ = _url("'x://' || node")
    return rf"""WITH RECURSIVE p AS (SELECT page_id, {host} AS host, {path} AS path, {_node('url')} AS node, html FROM pages),
t AS (SELECT host, path, node, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p),
g AS (SELECT host, path, node, CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(lower({_attr('rel')}), '(^|\s)canonical(\s|$)') THEN {_attr('href')}
  WHEN regexp_matches(tag, '(?i)^<meta') AND lower({_attr('http-equiv')}) = 'refresh' THEN trim(regexp_extract({_attr('content')}, '(?i)url\s*=\s*["'']?([^"'']*)', 1)) END AS link FROM t),
r AS (SELECT node, CASE WHEN link IS NULL OR link = '' THEN NULL WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
  WHEN starts_with(link, '/') THEN 'http://' || host || link WHEN regexp_matches(link, '^[?#]') THEN 'http://' || host || path || link
  ELSE 'http://' || host || (CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END) || link END AS there FROM g),
e0 AS (SELECT node AS a, {_node('there')} AS b FROM r), e1 AS (SELECT a, b FROM e0 WHERE a IS NOT NULL AND b IS NOT NULL), e AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS origin, b AS node FROM reach), v AS (SELECT origin, {_rule(th, tp, rules, 'verdict')} AS own FROM m),
c AS (SELECT origin AS node, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS passed_on FROM v GROUP BY origin)
SELECT page_id, host, path, {_rule('host', 'path', rules, 'text')} AS rule, coalesce({_rule('host', 'path', rules, 'verdict')}, passed_on, 'allow') AS verdict FROM p LEFT JOIN c USING (node)"""


OP3 = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, i AS start, sha256(array_to_string(ws[i + 1:i + 20], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)),
f AS (SELECT doc_id, start FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, start) > 1),
c AS (SELECT DISTINCT doc_id, start + j AS p FROM f, range(0, 20) AS t(j)),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM w),
k AS (SELECT doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY u.p) FILTER (WHERE c.p IS NULL) AS kept FROM u LEFT JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

OP4 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

OP5 = f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, encode(source) NULLS LAST) AS rank,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min(rank) AS first_rank, arg_min(level, rank) AS level FROM r WHERE level <= cap / weight),
t AS (SELECT source, source_size, CASE WHEN rank < first_rank THEN cap::DOUBLE ELSE weight * f.level END AS target FROM r, f),
o AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS words, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size + greatest(0, least(size, (CASE WHEN source_size > 0 THEN words % source_size ELSE words END) - before)) AS BIGINT) AS taken FROM o"""

OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a), l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM g LEFT JOIN l USING (doc_id)"""
