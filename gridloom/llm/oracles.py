"""SQL that gives the rows of those queries that SQL can express on the test tables."""

from __future__ import annotations

from . import quality_rules, secret_scan

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
 b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
 ds AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
 bs AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM b)),
 n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
 SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9"""

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM d),
 g AS (SELECT doc_id, k, w[k] || chr(1) || w[k + 1] || chr(1) || w[k + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
 r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
 l AS (SELECT doc_id, line, k, n, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k, len(lines) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d))),
 m AS (SELECT *, len(body) - len(replace(body, ' ', '')) + 1 AS words, len(regexp_extract_all(body, '[|»›•·>]')) AS seps, len(regexp_extract_all(body, '[#*$%&|<>]')) AS symbols, len(line) - len(replace(line, ' ', '')) AS spaces FROM l),
 j AS (SELECT *, body <> '' AND (seps * 3 >= words AND words >= 3 OR regexp_matches(lower(body), '{quality_rules.BOILERPLATE.pattern}') OR symbols * 2 > words AND symbols >= 3 OR (len(body) - len(replace(body, '!!', ''))) > words
   OR NOT (greatest(words, len(body) // {quality_rules.LETTERS}) < 4 OR regexp_matches(body, '[.!?:;…。！？]["'')\]”’»]*$') OR k = n AND contains(body, '. '))) AS bad FROM m),
 t AS (SELECT doc_id, any_value(n) AS n_lines, count_if(bad) AS n_removed_lines, sum(len(line) - spaces) AS chars, coalesce(sum(len(line) - spaces) FILTER (bad), 0) AS gone FROM j GROUP BY doc_id),
 u AS (SELECT doc_id, sum(c - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
 a AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: len(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
   CAST(n_lines AS BIGINT) AS n_lines, n_removed_lines, CASE WHEN chars > 0 THEN gone / chars ELSE 0.0 END AS lost FROM d JOIN w USING (doc_id) JOIN t USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= {quality_rules.MAX_LOST} AS kept, n_lines, n_removed_lines, lost FROM a"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS k FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
 r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
 SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * c}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for c in range(4))

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), l AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
 SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM p JOIN l USING (html)"""


def _spans(number: int, rule: secret_scan.Rule) -> str:
    """Rows doc_id, kind, a, b of one rule: matches and what lies between them, added up."""
    pattern = rule.pattern.replace("'", "''")
    own = f"regexp_extract_all(text, '{pattern}', {rule.group})"
    whole = f"regexp_extract_all(text, '{pattern}')"
    return f"""SELECT doc_id, {number} AS kind, a, a + size AS b FROM (SELECT doc_id, own, size, CAST(sum(gap) OVER by_place + sum(size) OVER by_place - size AS BIGINT) AS a FROM (
   SELECT doc_id, unnest(range(1, len(whole) + 1)) AS k, unnest(list_transform(whole, lambda x: len(x))) AS size, unnest(list_transform(own, lambda x: len(x))) AS own, unnest(list_transform(between[1 : len(whole)], lambda x: len(x))) AS gap
   FROM (SELECT doc_id, {whole} AS whole, {own} AS own, regexp_split_to_array(text, '{pattern}') AS between FROM d)) WINDOW by_place AS (PARTITION BY doc_id ORDER BY k)) WHERE own >= {rule.least}"""


_NAMES = "[" + ", ".join(f"'{r.name}'" for r in secret_scan.RULES) + "]"
SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(_spans(k, r) for k, r in enumerate(secret_scan.RULES))}),
 t AS (SELECT doc_id, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, string_agg(({_NAMES})[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind, b) FILTER (kind < 3) AS base, string_agg(({_NAMES})[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind, b) AS every FROM f GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN t USING (doc_id)"""

HARD_NEGATIVES = """WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
   FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
 SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

_TERMS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
 c AS (SELECT count_if(len(w) > 0) AS n, sum(len(w)) AS l FROM d),
 t AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d),
 f AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
 g AS (SELECT term, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, c.n),
 s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * f.n * c.n) // CAST(c.l AS BIGINT))))) AS BIGINT) AS score FROM f JOIN g USING (term) JOIN i USING (term), c GROUP BY item_id, doc_id)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
