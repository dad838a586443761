"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from mnemolake.llm.secret_scan import BASE, RULES

_ESC = r"""regexp_replace(regexp_replace(replace(coalesce({0}, ''), '\', '\\'), '<(/?s>)', '\\l\1', 'g'), '\[(/?(?:ROLE|INST|SYS)\])', '\\b\1', 'g')"""

OP1 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(20 + length({_ESC.format("role")}) + length({_ESC.format("text")})) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c
"""


#: The same matches in an engine without look-behind and atomic groups, which needs neither to be fast.
_PLAIN = {"web_token": r"[A-Za-z0-9_-]*?eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"}


def _spans(k: int) -> str:
    rule = RULES[k]
    pattern = _PLAIN.get(rule.kind, rule.pattern).replace("'", "''")
    return f"""
  SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'ord': {k}, 'kind': '{rule.kind}',
      'len': length(m[i]), 'own': length(p[i])}}), lambda s: s.own >= {rule.least}) AS f
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS p, string_split_regex(text, '{pattern}') AS g FROM d)"""


_LISTED = "coalesce(list_aggregate(list_transform(list_filter(s, lambda x: x.ord < {0}), lambda x: concat(x.kind, ':', CAST(x.start AS BIGINT), ':', CAST(x.start + x.len AS BIGINT))), 'string_agg', ','), '')"

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS ({" UNION ALL ".join(_spans(k) for k in range(len(RULES)))}),
u AS (SELECT doc_id, list_sort(flatten(list(f))) AS s FROM a GROUP BY doc_id)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(s, lambda x: x.ord = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(BASE))},
  sha256({_LISTED.format(len(BASE))}) AS base_sha256, {_LISTED.format(len(RULES))} AS spans FROM u
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: w[i:i + least(10, len(w)) - 1])) AS gram
  FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM g), grams AS (SELECT n, gram, list(DISTINCT CAST(item_id AS VARCHAR)) AS items FROM g GROUP BY n, gram),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
h AS (SELECT doc_id, p.n, i, items FROM p JOIN grams ON grams.n = p.n AND grams.gram = p.w[p.i:p.i + p.n - 1]),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT x) AS n_items, string_agg(DISTINCT x, ',' ORDER BY x) AS items FROM (SELECT doc_id, unnest(items) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP3 = r"""
WITH p AS (
  SELECT page_id, rtrim(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '.') AS host,
    rtrim(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path, page_id % 366 AS day FROM pages
), k AS (
  SELECT page_id, day, 'domain' AS kind, unnest(CASE WHEN len(string_split(host, '.')) < 2 THEN [host] ELSE list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END) AS key FROM p
  UNION ALL SELECT page_id, day, 'url', host || path FROM p
), e AS (SELECT kind, key, CAST('0x' || substr(md5(kind || ':' || key), 1, 7) AS BIGINT) AS h FROM (SELECT DISTINCT kind, key FROM k WHERE key <> '')),
v AS (
  SELECT kind, key, h, f, t FROM (
    SELECT kind, key, h, (h // 7) % 200 AS f, CASE WHEN h % 2 = 0 THEN (h // 7) % 200 + 60 END AS t FROM e
    UNION ALL SELECT kind, key, h, (h // 7) % 200 + 120, NULL FROM e WHERE h % 4 = 0)
  WHERE h % 3 <> 0
), m AS (SELECT page_id, 'list' || (h % 5) AS l, h % 5 = 4 AS allows FROM k JOIN v USING (kind, key) WHERE day >= f AND (t IS NULL OR day < t)),
a AS (SELECT page_id, string_agg(DISTINCT l, ',' ORDER BY l) AS lists, bool_or(NOT allows) AND NOT bool_or(allows) AS blocked FROM m GROUP BY page_id)
SELECT page_id, host, coalesce(lists, '') AS lists, coalesce(blocked, false) AS blocked FROM p LEFT JOIN a USING (page_id)
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 10) AS BIGINT) AS u FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS n, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS HUGEINT) AS w FROM d GROUP BY source
), t AS (SELECT sum(n) AS total FROM s),
c AS (  -- full: at the level at which this source meets its limit, all targets together are within the budget
  SELECT a.source, any_value(a.n) AS n, any_value(a.w) AS w, 2 * sum(least(2 * b.n * a.w, b.w * 2 * a.n)) <= 3 * any_value(t.total) * any_value(a.w) AS is_full FROM s a, s b, t GROUP BY a.source
), l AS (SELECT 3 * any_value(t.total) - 4 * coalesce(sum(n) FILTER (is_full), 0) AS num, 2 * coalesce(sum(w) FILTER (NOT is_full), 0) AS den FROM c, t),
r AS (
  SELECT source, n, is_full, w * num AS parts, den, den * n AS own, CASE WHEN is_full THEN CASE WHEN n > 0 THEN 2 ELSE 0 END ELSE (w * num) // (den * n) END AS whole FROM c, l
)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, CASE WHEN is_full THEN CAST(2 * n AS DOUBLE) ELSE CAST(parts AS DOUBLE) / CAST(den AS DOUBLE) END AS target,
  CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies
FROM (SELECT d.doc_id, d.size, r.*, whole + CASE WHEN NOT is_full AND CAST(u AS HUGEINT) < ((parts - whole * own) * 1099511627776) // own THEN 1 ELSE 0 END AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
"""

OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (SELECT lang, source, term, CAST(coalesce(n, 0) AS HUGEINT) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
l AS (SELECT lang, term, sum(n) AS n FROM p GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM l),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
QUALIFY part = 'pair' OR rank <= 10
"""

OP11 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, g, count(*) AS a FROM (
    SELECT lang, unnest(flatten(list_transform(range(1, least(len(w), 4) + 1), lambda s: list_transform(range(1, len(w) - s + 2), lambda i: w[i:i + s - 1])))) AS g FROM w WHERE len(w) > 0)
  GROUP BY lang, g HAVING count(*) >= 30
), cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
s AS (
  SELECT c.lang, c.g, c.a, k, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (l.a + r.a) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.g[:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]
), m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
x AS (
  SELECT lang, unnest(flatten(list_transform(range(2, len(g)), lambda s: list_transform(range(1, len(g) - s + 2), lambda i: g[i:i + s - 1])))) AS g, a FROM f WHERE len(g) > 2
), longest AS (SELECT lang, g, max(a) AS longer FROM x GROUP BY lang, g),
o AS (SELECT m.lang, array_to_string(m.g, ' ') AS phrase, m.a, l, r, CAST(score AS BIGINT) AS score FROM m LEFT JOIN longest USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * m.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""

ORACLES = {"op11_collocations": OP11, "op12_source_divergence": OP12, "op13_mixing": OP13, "op3_url_filter": OP3, "op1_chat_format": OP1, "op4_secret_scan": OP4, "op5_decontamination": OP5}
