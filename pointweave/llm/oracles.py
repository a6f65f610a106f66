"""The same as some of the queries in DuckDB's SQL."""

from __future__ import annotations

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def near_dedup(percent: int, words: int = 5) -> str:
    """All pairs that share a shingle, counted; links; and all that a document reaches."""
    return f"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')) END) AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN s m ON m.doc_id = a JOIN s n ON n.doc_id = b WHERE 100 * c >= {percent} * (len(m.sh) + len(n.sh) - c)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, t.b FROM reach JOIN t ON t.a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least USING (doc_id)"""


def url_filters(rules: list[tuple[str, str]], min_support: float, min_count: int, min_confidence: float) -> str:
    """Listed rules by all pairs; mined rules by counting all sets of tokens of all labelled pages."""
    listed = ", ".join(f"('{r}', '{a}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, a in rules)
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""WITH RECURSIVE
u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '{parts}', 1), ''), '{CAPITALS}', '{CAPITALS.lower()}') AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages),
k AS (SELECT *, list_distinct(list_concat(
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 's:' || x))) AS tokens FROM u),
r(rule, action, suffix, start) AS (VALUES {listed}),
named AS (SELECT page_id, url, arg_max(rule, (length(rule), rule)) AS rule, arg_max(action, (length(rule), rule)) AS action
  FROM (SELECT DISTINCT page_id, url, host, path FROM u) JOIN r ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start) GROUP BY 1, 2),
label AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY 1),
known AS (SELECT tokens, coalesce(action = 'block', bad) AS bad FROM k LEFT JOIN named USING (page_id, url)
  LEFT JOIN label ON doc_id = try_cast(regexp_extract(path, '^/[^/]+/([0-9]+)', 1) AS BIGINT) WHERE len(tokens) > 0 AND coalesce(action = 'block', bad) IS NOT NULL),
base AS (SELECT greatest({min_count}, ceil({min_support!r} * count(*)), 1) AS least, avg(bad::INT) AS bad FROM known),
often AS (SELECT list(t) AS common FROM (SELECT t FROM (SELECT unnest(tokens) AS t, bad FROM known) GROUP BY t HAVING count(*) FILTER (bad) >= (SELECT least FROM base))),
own AS (SELECT tokens, list_sort(list_intersect(tokens, common)) AS few, count(*) AS n, count(*) FILTER (bad) AS hits FROM known CROSS JOIN often GROUP BY tokens, common),
sets(tokens, few, n, hits, s, place) AS (
  SELECT tokens, few, n, hits, []::VARCHAR[], 0::BIGINT FROM own
  UNION ALL SELECT tokens, few, n, hits, list_append(s, few[nth]), nth FROM (SELECT *, unnest(range(place + 1, len(few) + 1)) AS nth FROM sets)),
mined AS (SELECT s, sum(hits) / sum(n) AS c, sum(n) AS n FROM sets WHERE len(s) > 0 GROUP BY s HAVING sum(hits) >= (SELECT least FROM base) AND sum(hits) / sum(n) >= {min_confidence!r}),
sure AS (SELECT s, c FROM mined, base WHERE (c + 1.6449 * 1.6449 / n / 2 - sqrt(1.6449 * 1.6449 / n * (c * (1 - c) + 1.6449 * 1.6449 / n / 4))) / (1 + 1.6449 * 1.6449 / n) > base.bad),
found AS (SELECT tokens, max(c) AS confidence FROM (SELECT DISTINCT tokens FROM k) JOIN sure ON list_has_all(tokens, s) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN confidence IS NULL THEN 'allow' ELSE 'block' END) AS verdict, confidence
FROM k LEFT JOIN found USING (tokens) LEFT JOIN named USING (page_id, url)"""


def hard_negatives(scale: int, positives: int, negatives: int, low: int, high: int) -> str:
    """All products of anchors and rows; ranks by windows."""
    return f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {positives})
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND {low} * p.score <= 100 * n.score AND 100 * n.score <= {high} * p.score QUALIFY rank <= {negatives}"""


def source_divergence(least_docs: int, most_terms: int) -> str:
    """Counts of all kept terms in all groups, and their differences for all pairs."""
    share = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * terms)"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= {least_docs}),
v AS (SELECT lang, count(*) AS terms, sum(total) AS lang_total FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(source_total, 0) AS source_total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS source_total FROM c GROUP BY 1, 2) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {share.format(n='coalesce(n, 0)', total='source_total')} AS p, {share.format(n='total', total='lang_total')} AS q
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts QUALIFY part = 'pair' OR rank <= {most_terms}"""
