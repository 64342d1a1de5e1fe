"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(coalesce(html, ''),
    '(?s)<!--.*?-->|<(?:!|/?html|/?body|/?article)[^>]*>|<head>.*?</head>|<nav>.*?</nav>|<footer>.*?(?:</footer>|$)|<div class="ad">.*?</div>', chr(1), 'g') AS h FROM pages
), b AS (
  SELECT page_id, url, string_split(regexp_replace(h, '</?(?:p|h1)>', chr(1), 'g'), chr(1)) AS parts FROM a
), c AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[a-z/!][^>]*>?', '', 'g'),
      '&quot;', '"'), '&quot', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS lines FROM b
)
SELECT page_id, url, coalesce(array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)), '') AS text,
  CAST(length(coalesce(array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)), '')) AS BIGINT) AS n_chars
FROM c
"""

OP3 = rf"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    {FOLD.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parsed
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
FROM split
"""

OP7 = rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[s:s + 12], ' ') AS t
  FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(s) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS t FROM dw, lengths, unnest(range(1, len(w) - k + 2)) AS u(s) WHERE len(w) >= k
), found AS (SELECT r, s, places.k, item FROM places JOIN windows ON places.t = windows.t AND places.k = windows.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + k)) AS u(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP8 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g
  FROM d
), g AS (SELECT doc_id, unnest(g) AS t FROM s),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM g AS a JOIN g AS b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM shared JOIN s AS a ON a.doc_id = x JOIN s AS b ON b.doc_id = y
  WHERE 100 * n_both >= 85 * (len(a.g) + len(b.g) - n_both)
), edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.r = edge.x)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) AS m ON s.doc_id = m.doc_id
"""

OP9 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source
), ordered AS (
  SELECT *, sum(source_size * 2.0::DOUBLE) OVER before AS capped, sum(weight) OVER rest AS free FROM s
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT max(l) AS l FROM (
    SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(capped, 0)) / free AS l, weight, source_size FROM ordered)
  WHERE weight * l <= source_size * 2.0::DOUBLE
), t AS (
  SELECT source, source_size, CASE WHEN weight * l <= source_size * 2.0::DOUBLE THEN weight * l ELSE source_size * 2.0::DOUBLE END AS target FROM s, level
), placed AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN middle <= target - whole * source_size AND target > whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v AS a JOIN v AS c ON a.vec_id % 50 = 0 AND a.r <> c.r AND len(a.e) = len(c.e)
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, {FOLD.format("coalesce(text, '')")} AS t FROM documents),
p AS (
  SELECT r, lang, i, regexp_extract_all(parts[i], '[^\x20\x09]+') AS w
  FROM (SELECT r, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS parts FROM d), unnest(range(1, len(parts) + 1)) AS u(i)
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang HAVING sum(len(w)) > 0),
f AS (
  SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase, count(*) AS a
  FROM p, unnest([1, 2, 3, 4]) AS v(m), unnest(range(1, len(w) - m + 2)) AS u(s) WHERE len(w) >= m GROUP BY ALL HAVING count(*) >= 30
), c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM c, unnest(range(1, c.m)) AS u(k) JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:c.m], ' ')
), weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts) WHERE place = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, max(a) AS most FROM c, unnest(range(2, m)) AS v(k), unnest(range(1, m - k + 2)) AS u(s) GROUP BY ALL
), ranked AS (
  SELECT x.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest AS x LEFT JOIN inside USING (lang, phrase) WHERE NOT coalesce(100 * most >= 80 * a, false)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP13_RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT r, s, array_to_string(w[s:s + 7], ' ') AS t FROM d, unnest(range(1, len(w) - 6)) AS u(s) WHERE len(w) >= 8
), again AS (SELECT r, t FROM places GROUP BY r, t HAVING count(*) > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM places JOIN again USING (r, t), unnest(range(s, s + 8)) AS v(p) GROUP BY r),
counted AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN hit USING (r)
), hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"count(*) FILTER ({c}) / CAST(count(*) AS DOUBLE) AS p_{r}" for r, c in OP13_RULES.items())}
  FROM counted WHERE source IS NOT NULL GROUP BY source
), prior AS (
  SELECT {", ".join(f"avg(p_{r}) AS m_{r}, avg(p_{r}) * (1 - avg(p_{r})) AS o_{r}, var_pop(p_{r}) - avg(p_{r}) * (1 - avg(p_{r})) * avg(1 / n) AS b_{r}" for r in OP13_RULES)} FROM hosts
), weights AS (
  SELECT {", ".join(f"m_{r}, CASE WHEN b_{r} > 0 THEN least(10000.0::DOUBLE, greatest(2.0::DOUBLE, o_{r} / b_{r} - 1)) ELSE 10000.0::DOUBLE END AS s_{r}" for r in OP13_RULES)} FROM prior
), bad AS (
  SELECT source FROM hosts, weights WHERE {" OR ".join(f"(n * p_{r} + s_{r} * m_{r}) / (n + s_{r}) > 0.5::DOUBLE" for r in OP13_RULES)}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(source IN (SELECT source FROM bad), false) AS kept
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_html_text": OP2, "op3_url_rules": OP3, "op7_decontaminate": OP7, "op8_near_duplicates": OP8, "op9_top_k": OP9, "op10_mix": OP10, "op11_hard_negatives": OP11, "op12_phrases": OP12, "op13_host_rules": OP13}
