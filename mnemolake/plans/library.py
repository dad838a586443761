"""Queries of the repository ranking and of query understanding, with their SQL.

The tables have no headings, dated paths or index files; the library view deals them out by doc_id, and questions
are the first words of the benchmark's passages behind phrases that ask for different things."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.functions import query as Q
from mnemolake.functions import text as X
from mnemolake.operators import index as I
from mnemolake.operators import ranking as K
from mnemolake.operators import retrieval as R
from mnemolake.operators import segments as G
from mnemolake.plans.base import TEAM, WORDS, query
from mnemolake.sources import manifest
from mnemolake.sources import readers as S
from mnemolake.sources.scratch import scratch_path, shared_dir, snapshot_key

PREFIXES = ("", "latest ", "how does ", "papers about ", "related ", "compare index ", "recent report summary ", "long-context ")

LIBRARY = """(SELECT doc_id, layer || '/' || coalesce(source, 'none') || CASE WHEN doc_id % 97 = 0 THEN '/d' || doc_id || '/index.md' WHEN doc_id % 89 = 0 THEN '/d' || doc_id || '/aliases.yaml' WHEN layer = 'weekly' THEN '/2026-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 9) || '-' || doc_id || '.md' ELSE '/doc_' || doc_id || '.md' END AS path, layer,
  CASE WHEN doc_id % 3 = 0 THEN '# ' || coalesce(source, 'none') || ' ' || substr(coalesce(text, ''), 1, 30) || chr(10) ELSE '' END || coalesce(text, '') AS text
  FROM (SELECT *, CASE lang WHEN 'en' THEN 'papers' WHEN 'de' THEN 'reports' WHEN 'fr' THEN 'survey' ELSE 'weekly' END AS layer FROM documents))"""
ASKED = f"(SELECT item_id AS query_id, {list(PREFIXES)}[item_id % 8 + 1] || array_to_string(string_split(text, ' ')[1:6], ' ') AS query FROM benchmark WHERE text IS NOT NULL)"


def library(spark, sf, *more):
    docs = S.table(spark, sf, "documents")
    layer = F.when(F.col("lang") == "en", "papers").when(F.col("lang") == "de", "reports").when(F.col("lang") == "fr", "survey").otherwise("weekly")
    source, key, text = F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    digit = (F.col("doc_id") % 9).cast("string")
    name = (
        F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("/d"), key, F.lit("/index.md"))).when(F.col("doc_id") % 89 == 0, F.concat(F.lit("/d"), key, F.lit("/aliases.yaml")))
        .when(layer == "weekly", F.concat(F.lit("/2026-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-1"), digit, F.lit("-"), key, F.lit(".md"))).otherwise(F.concat(F.lit("/doc_"), key, F.lit(".md")))
    )
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), source, F.lit(" "), F.substring(text, 1, 30), F.lit("\n"))).otherwise("")
    return docs.select("doc_id", F.concat(layer, F.lit("/"), source, name).alias("path"), layer.alias("layer"), F.concat(head, text).alias("text"), *more)


def library_index(spark, sf):
    """The stored index of library(): made once for a state of the table's files."""
    path = f"{shared_dir(spark)}/mnemolake-index/library-rows-{snapshot_key(spark, f'{sf}/documents.parquet')}"
    return K.stored_index(library(spark, sf), path)


def asked(spark, sf):
    start = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("item_id") % 8 + 1).cast("int"))
    return S.table(spark, sf, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), F.concat(start, F.array_join(F.slice(F.split("text", " "), 1, 6), " ")).alias("query"))


def _forms(t: str) -> str:
    return f"""list_filter([{t}, CASE WHEN len({t}) > 4 AND suffix({t}, 'ies') THEN {t}[:-4] || 'y' END, CASE WHEN len({t}) > 4 AND suffix({t}, 's') AND NOT suffix({t}, 'ss') THEN {t}[:-2] END,
 CASE WHEN len({t}) > 5 AND suffix({t}, 'ing') THEN {t}[:-4] END, CASE WHEN len({t}) > 5 AND suffix({t}, 'ing') AND suffix({t}[:-4], 'n') THEN {t}[:-5] END, CASE WHEN len({t}) > 4 AND suffix({t}, 'ed') THEN {t}[:-3] END], lambda z: z IS NOT NULL AND len(z) >= 2)"""


def _without(a: str, words) -> str:
    return f"list_filter({a}, lambda z: z NOT IN {tuple(words)})"


def _pattern(p: str) -> str:
    return p.replace("'", "''")


_DATE = r"(?i)(20\d{2}[-/]\d{1,2}(?:[-/]\d{1,2})?|20\d{2}-W\d{1,2})"
_LAYER = "regexp_replace(lower({0}), 's+$', '')"
_ENTITY = tuple(n for k in K.ENTITY_KINDS for n in Q.LAYER_ALIASES[k])


def _kind(layer: str) -> str:
    cases = " ".join(f"WHEN {layer} IN {n} OR {_LAYER.format(layer)} IN {n} THEN {list(n)}" for n in Q.LAYER_ALIASES.values())
    return f"(CASE {cases} ELSE [{layer}, {_LAYER.format(layer)}] END)"


def _some(names, of: str = "lower(z)") -> str:
    return f"list_filter(layers, lambda z: {of} IN {tuple(names)})"


_SINGULAR = _LAYER.format("z")
_GROUPS = " ".join(f"WHEN len({_some(g)}) > 0 THEN {_some(g)}" for g in Q.TEMPORAL_GROUPS)
_TOPIC = f"CASE WHEN regexp_matches(q, '{Q.ASKS_TOPIC}') AND len({_some(Q.LAYER_ALIASES['paper'], _SINGULAR)}) > 0 THEN list_distinct(list_concat({_some(Q.LAYER_ALIASES['paper'], _SINGULAR)}, {_some(Q.LAYER_ALIASES['survey'], _SINGULAR)})) ELSE [] END"
_NAMED = f"list_filter(layers, lambda z: list_has_any(forms, {_kind('lower(z)')}))"
PREFERRED = f"""(SELECT *, CASE WHEN regexp_matches(q, '{Q.ASKS_TIME}') AND regexp_matches(q, '{Q.ASKS_FINDINGS}') AND len({_some(Q.REPORT_LAYERS, _SINGULAR)}) > 0 THEN {_some(Q.REPORT_LAYERS, _SINGULAR)}
  WHEN len({_NAMED}) > 0 THEN {_NAMED} WHEN regexp_matches(q, '{Q.ASKS_WHY}') AND len({_some(Q.EXPLANATORY_LAYERS, _SINGULAR)}) > 0 THEN {_some(Q.EXPLANATORY_LAYERS, _SINGULAR)}
  WHEN regexp_matches(q, '{Q.ASKS_TIME}') AND regexp_matches(q, '{Q.ASKS_PERSON}') AND NOT regexp_matches(q, '{Q.ASKS_REPORT}') AND len({_some(Q.PERSONAL_LAYERS)}) > 0 THEN {_some(Q.PERSONAL_LAYERS)}
  WHEN regexp_matches(q, '{Q.ASKS_TIME}') THEN CASE {_GROUPS} ELSE {_TOPIC} END ELSE {_TOPIC} END AS preferred
  FROM (SELECT *, flatten(list_transform(raw, lambda t: {_forms('t')})) AS forms FROM (SELECT query_id, query, lower(query) AS q, list_filter(w, lambda x, i: list_position(w, x) = i) AS raw, layers FROM
    (SELECT query_id, query, {WORDS.format('query')} AS w FROM {ASKED}), (SELECT list(DISTINCT layer) AS layers FROM {LIBRARY}))))"""


@query(f"SELECT query_id, array_to_string(list_sort(preferred), ',') AS preferred FROM {PREFERRED}")
def layer_routing(spark, sf):
    layers = library(spark, sf).agg(F.collect_set("layer").alias("layers"))
    return asked(spark, sf).join(F.broadcast(layers)).select("query_id", F.array_join(F.array_sort(Q.preferred_layers(F.col("query"), F.col("layers"))), ",").alias("preferred"))


_COUNT = "(length(d.low) - length(replace(d.low, {0}, ''))) // length({0})"
_HAS = "(contains(d.low, {0}) OR contains(d.plow, {0}))"
_Q = f"""q1 AS (SELECT *, {_without(f"list_distinct(list_concat(raw, flatten(list_transform(raw, lambda t: list_filter(string_split_regex(t, '[-/]'), lambda p: len(p) >= 2 AND NOT regexp_full_match(p, '[0-9]+')))), forms))", K.DROPPED_TERMS)} AS terms FROM {PREFERRED}),
q2 AS (SELECT *, list_filter(terms, lambda t: regexp_matches(t, '{_DATE}')) AS dts, {_without('raw', K.NOT_COVERED)} AS content, {_without('terms', K.FILENAME_NOUNS)} AS fts,
  regexp_matches(q, '{Q.ASKS_WHY}') AS asks, regexp_matches(q, '{Q.ASKS_WHY}') OR regexp_matches(q, '{K.ASKS_OPENLY}') AS openly, regexp_matches(q, '{K.RELATES}') AS relates, regexp_matches(q, '{_pattern(K.CATALOG)}') AS catalog,
  len(list_filter(raw, lambda t: contains(t, '-'))) > 0 AS compound, len(preferred) > 0 AS routed,
  list_filter(list_transform(range(1, len(raw)), lambda i: CASE WHEN len(raw[i]) >= 3 AND len(raw[i + 1]) >= 3 THEN raw[i] || ' ' || raw[i + 1] END), lambda z: z IS NOT NULL) AS phrases FROM q1),
q3 AS (SELECT *, regexp_matches(q, '{K.LATEST}') OR len(dts) > 0 AS latest, list_filter(content, lambda t: len(t) >= 2) AS covered, len({_without('terms', K.TEMPORAL_NOUNS)}) = 0 AS nospecific,
  list_filter(raw, lambda t: len(t) >= 4 AND t NOT IN {K.TEMPORAL_NOUNS + K.NOT_NAMES} AND NOT regexp_matches(t, '{_DATE}')) AS maybe,
  list_transform(list_filter(fts, lambda t: len(t) >= 4), lambda t: regexp_replace(t, 's+$', '')) AS hts, list_filter({_without('fts', ('multi', ''))}, lambda t: len(t) >= 4) AS signals FROM q2),
q4 AS (SELECT *, CASE WHEN routed OR openly THEN 1 WHEN latest OR compound OR len(preferred) > 1 THEN greatest(1, (len({_without('terms', K.NOT_COUNTED)}) + 2) // 3) ELSE len(terms) END AS least FROM q3 WHERE len(terms) > 0 OR latest)"""
_D = f"""d0 AS (SELECT *, lower(text) AS low, lower(path) AS plow, string_split(lower(path), '/')[1] AS lay, string_split(lower(path), '/')[-1] AS name, regexp_matches(lower(path), '/index\\.(yaml|yml|md)$') AS prim FROM {LIBRARY}),
d AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem, prim OR suffix(plow, '/aliases.yaml') AS idx, list_has_any(string_split(plow, '/'), {list(K.PERIODS)}) AS period, len(list_filter({list(K.WELL_KNOWN)}, lambda z: starts_with(path, z))) > 0 AS known,
  array_to_string(list_transform(list_filter(string_split(text, chr(10))[1:40], lambda l: starts_with(ltrim(l), '#')), lambda l: lower(ltrim(l, '# '))), ' ') AS heads,
  list_distinct(regexp_extract_all(path || chr(10) || array_to_string(list_filter(string_split(text, chr(10)), lambda l: starts_with(trim(l), '#')), chr(10)), '{_DATE}')) AS dates FROM d0)"""
_T = f"""t AS (SELECT t.term, greatest(1.0::DOUBLE, ln((n + 1)::DOUBLE / (df + 1))) AS idf FROM (SELECT DISTINCT unnest(list_concat(terms, raw)) AS term FROM q4) t, (SELECT count(*) AS n FROM d), LATERAL (SELECT count(*) AS df FROM d WHERE {_HAS.format('t.term')})),
s AS (SELECT query_id, list(term) FILTER (docs > 3) AS common FROM (SELECT m.query_id, m.term, (SELECT count(*) FROM d WHERE contains(d.stem, m.term)) AS docs FROM (SELECT query_id, unnest(maybe) AS term FROM q4) m) GROUP BY query_id),
w AS (SELECT query_id, map_from_entries(list((term, idf))) AS idfs FROM (SELECT query_id, unnest(terms) AS term FROM q4) JOIN t USING (term) GROUP BY query_id),
q5 AS (SELECT q4.*, list_filter(maybe, lambda z: contains(z, '-') OR regexp_matches(z, '[0-9]') OR NOT list_contains(coalesce(common, []), z)) AS named, coalesce(idfs, MAP()) AS idfs FROM q4 LEFT JOIN s USING (query_id) LEFT JOIN w USING (query_id))"""
_P = f"""p0 AS (SELECT q5.*, d.*, list_contains(preferred, lay) AS pref, {_LAYER.format('lay')} IN {_ENTITY} AS entity, len(named) > 0 AS anchor,
  len(list_filter(terms, lambda z: {_HAS.format('z')})) AS matched, len(list_filter(covered, lambda c: len(list_filter({_forms('c')}, lambda z: {_HAS.format('z')})) > 0)) AS cov,
  coalesce(list_sum(list_transform(terms, lambda z: least({_COUNT.format('z')}, 4) * (6.0 + 18.0 * idfs[z]))), 0) AS words,
  coalesce(list_sum(list_transform(signals, lambda z: least({_COUNT.format('z')}, 4) * 20)), 0) AS sig FROM q5, d),
p1 AS (SELECT *, len(covered) >= 2 AND cov = len(covered) AS fully, latest AND routed AND pref AS temporal, (pref AND NOT (idx AND anchor)) OR (catalog AND idx) OR (openly AND NOT anchor AND NOT idx) AS anchored FROM p0),
p2 AS (SELECT *, words + 220 * cov + 280 * pow(greatest(cov - 1, 0), 2) + floor(1800 * (cov / greatest(1, len(covered))::DOUBLE)) + CASE WHEN fully THEN 4200 ELSE 0 END + CASE WHEN compound AND NOT idx THEN sig ELSE 0 END
  + 3000 * len(list_filter(raw, lambda z: list_contains(named, z) AND contains(plow, z) AND (pref OR (relates AND entity)))) + 500 * len(list_filter(raw, lambda z: contains(z, '-') AND contains(low, z)))
  + 180 * len(list_filter(phrases, lambda z: contains(low, z))) + 28 * len(list_filter(terms, lambda z: contains(plow, z))) + 260 * len(list_filter(fts, lambda z: contains(name, z) AND len(z) >= 4)) + CASE WHEN list_contains(fts, stem) THEN 1200 ELSE 0 END
  + CASE WHEN anchored THEN 420 * len(list_filter(hts, lambda z: z <> '' AND contains(heads, z))) + coalesce(list_sum(list_transform(list_filter(content, lambda c: len(list_filter({_forms('c')}, lambda z: contains(heads, z))) > 0), lambda c: floor(800.0::DOUBLE * coalesce(idfs[c], 1.0)))), 0) ELSE 0 END
  + CASE WHEN list_contains(preferred, layer) THEN 72 ELSE 0 END + CASE WHEN routed AND pref THEN 72 + CASE WHEN latest THEN 1400 ELSE 0 END ELSE 0 END + CASE WHEN catalog AND prim THEN CASE WHEN compound THEN -560 ELSE 240 END ELSE 0 END - CASE WHEN idx AND NOT prim THEN 600 ELSE 0 END
  + CASE WHEN NOT catalog AND idx THEN CASE WHEN relates AND prim AND pref THEN 700 WHEN anchor THEN -2600 ELSE -160 END ELSE 0 END - CASE WHEN openly AND NOT anchor AND NOT catalog AND idx THEN 220 ELSE 0 END - CASE WHEN asks AND NOT routed AND NOT catalog AND idx THEN 2200 ELSE 0 END
  + CASE WHEN latest AND prim AND NOT anchor AND len(dts) = 0 AND pref THEN 700 ELSE 0 END + CASE WHEN latest AND NOT anchor AND len(dts) = 0 AND period THEN 800 ELSE 0 END + CASE WHEN known THEN 4 ELSE 0 END
  + CASE WHEN temporal THEN coalesce(list_max(list_transform(dates, lambda z: list_sum(list_transform(regexp_extract_all(z, '[0-9]+')[1:3], lambda x, i: CAST(x AS BIGINT) * [1000000, 10000, 100][i])))), 0) ELSE 0 END AS total
  FROM p1 WHERE (NOT routed OR latest OR pref OR fully OR (relates AND anchor AND entity)) AND len(list_filter(dts, lambda z: NOT (contains(plow, z) OR len(list_filter(dates, lambda y: contains(y, z))) > 0))) = 0
  AND (matched >= least OR temporal OR (routed AND nospecific AND pref)))"""


def ranked(k: int) -> str:
    return f"(WITH {_Q}, {_D}, {_T}, {_P} SELECT query_id, doc_id, path, matched, cov, CAST(trunc(total) AS BIGINT) AS score, row_number() OVER (PARTITION BY query_id ORDER BY trunc(total) DESC, path) AS rank FROM p2 QUALIFY rank <= {k})"


_WORDSUM = f"coalesce(list_sum(list_transform(terms, lambda z: least({_COUNT.format('z')}, 4) * (6.0 + 18.0 * idfs[z]))), 0)"
SCORED = f"""(WITH {_Q}, {_D}, {_T} SELECT query_id, doc_id, matched, cov AS covered, len(covered) AS n_terms, least, CAST(trunc(words + 220 * cov + 280 * pow(greatest(cov - 1, 0), 2) + floor(1800 * (cov / greatest(1, len(covered))::DOUBLE)) + CASE WHEN len(covered) >= 2 AND cov = len(covered) THEN 4200 ELSE 0 END) AS BIGINT) AS score
  FROM (SELECT q6.*, d.doc_id, len(list_filter(terms, lambda z: {_HAS.format('z')})) AS matched, len(list_filter(covered, lambda c: len(list_filter({_forms('c')}, lambda z: {_HAS.format('z')})) > 0)) AS cov, {_WORDSUM} AS words
    FROM (SELECT * REPLACE (CASE WHEN openly THEN 1 WHEN latest OR compound THEN greatest(1, (len({_without('terms', K.NOT_COUNTED)}) + 2) // 3) ELSE len(terms) END AS least) FROM q5) q6, d) WHERE matched > 0 OR cov > 0)"""
FREQUENCY = f"(WITH {_Q}, {_D} SELECT term, df, greatest(1.0::DOUBLE, ln((n + 1)::DOUBLE / (df + 1))) AS idf FROM (SELECT DISTINCT unnest(terms) AS term FROM q4) t, (SELECT count(*) AS n FROM d), LATERAL (SELECT count(*) AS df FROM d WHERE {_HAS.format('t.term')}))"
_SPLIT = "string_split(text, chr(10))"


def window(rows: str, most: int = 12) -> str:
    """rows (text, terms and others) with lines, a (0-based start) and b (end) of the evidence window."""
    return f"""(SELECT *, CASE WHEN top > 0 AND hi - lo + 1 <= {2 * most} THEN least(n, hi + {most // 4}) ELSE least(n, a + {most}) END AS b FROM
 (SELECT *, CASE WHEN top = 0 THEN 0 WHEN hi - lo + 1 <= {2 * most} THEN greatest(0, lo - 1 - {most // 4}) WHEN starts_with(ltrim(lines[best]), '#') THEN best - 1 ELSE greatest(0, best - 1 - {most // 3}) END AS a FROM
  (SELECT *, coalesce(list_max(scores), 0) AS top, list_position(scores, list_max(scores)) AS best, list_position(list_transform(scores, lambda s: s > 0), true) AS lo, n + 1 - list_position(list_reverse(list_transform(scores, lambda s: s > 0)), true) AS hi FROM
   (SELECT *, len(lines) AS n, list_transform(hits, lambda h, i: h + CASE WHEN h > 0 AND starts_with(ltrim(lines[i]), '#') THEN 1 ELSE 0 END) AS scores FROM
    (SELECT *, list_transform(lines, lambda line: coalesce(list_sum(list_transform(terms, lambda t: (length(lower(line)) - length(replace(lower(line), t, ''))) // length(t))), 0)) AS hits FROM
     (SELECT * REPLACE (coalesce(text, '') AS text), CASE WHEN {_SPLIT}[-1] = '' THEN {_SPLIT}[:-2] ELSE {_SPLIT} END AS lines FROM {rows}))))))"""


def supported(hits: str) -> str:
    """hits (query_id, doc_id, ...) with line_start, line_end, held, required, coverage and claim_support of their windows."""
    asked = f"(WITH {_Q} SELECT query_id, terms AS asked, {_without('list_distinct(list_concat(raw, terms))', K.NOT_CITED)} AS cites FROM q4)"
    rows = f"(SELECT h.*, l.path AS own_path, l.text, asked, CASE WHEN len(cites) > 0 THEN cites ELSE asked END AS terms FROM {hits} h JOIN {LIBRARY} l USING (doc_id) JOIN {asked} USING (query_id))"
    return f"""(SELECT *, CASE WHEN required > 0 THEN round_even(held / required::DOUBLE, 4) ELSE 1.0 END AS coverage, CASE WHEN held = required THEN 'direct' WHEN held > 0 THEN 'partial' ELSE 'unknown' END AS claim_support FROM
 (SELECT *, len(needs) AS required, len(list_filter(needs, lambda t: contains(evidence, t))) AS held FROM
  (SELECT *, CAST(a + 1 AS INTEGER) AS line_start, CAST(b AS INTEGER) AS line_end, lower(own_path || ' ' || array_to_string(lines[a + 1:b], chr(10))) AS evidence, list_filter(asked, lambda t: len(t) >= 3 AND t NOT IN {X.GENERIC_SUPPORT}) AS needs FROM {window(rows)})))"""


@query(f"SELECT query_id, doc_id, rank, score, matched, cov AS covered FROM {ranked(5)}")
def repository_search(spark, sf):
    """The repository ranking with all of its signals."""
    hits = K.repository_hits(asked(spark, sf), library(spark, sf), index=library_index(spark, sf))
    return hits.select("query_id", "doc_id", "rank", "score", F.col("matched").cast("bigint").alias("matched"), F.col("covered").cast("bigint").alias("covered"))


# the library a commit later: texts of each hundredth document changed, others gone
LATER = f"(SELECT doc_id, path, layer, CASE WHEN doc_id % 100 = 7 THEN 'zebra rewards ' || text ELSE text END AS text FROM {LIBRARY} WHERE doc_id % 100 <> 8)"


def later(spark, sf):
    text = F.when(F.col("doc_id") % 100 == 7, F.concat(F.lit("zebra rewards "), "text")).otherwise(F.col("text"))
    return library(spark, sf).where("doc_id % 100 <> 8").withColumn("text", text)


def _fold(rows: str, level: int) -> str:
    return f"(SELECT b, b AS k, sha256(string_agg(k || chr(0) || h || chr(0), '' ORDER BY k, h)) AS h FROM (SELECT substr(b, 1, {level}) AS b, k, h FROM {rows}) GROUP BY b)"


_LATER_ROOT = _fold(_fold(_fold(_fold(f"(SELECT substr(sha256(path), 1, 8) AS b, path AS k, sha256(text) AS h FROM {LATER})", 6), 4), 2), 0)


@query(f"SELECT path, CASE doc_id % 100 WHEN 8 THEN 'removed' ELSE 'changed' END AS change, (SELECT 'content-' || substr(h, 1, 24) FROM {_LATER_ROOT}) AS revision FROM {LIBRARY} WHERE doc_id % 100 IN (7, 8)")
def revision_changes(spark, sf):
    """What two stored trees of digests differ in, and the revision of the later one."""
    old, new = (scratch_path(spark, "tree") for _ in range(2))
    G.write_tree(G.listing_of(library(spark, sf)), old)
    revision = G.write_tree(G.listing_of(later(spark, sf)), new)
    return G.changed_paths(spark, old, new)[0].select("path", "change", F.lit(revision).alias("revision"))


@query(f"SELECT term, df, round(idf, 6) AS idf FROM {FREQUENCY.replace(LIBRARY, LATER)}")
def index_refresh(spark, sf):
    """Frequencies in an index that was brought from one state to the next: changed documents in a segment of their own, old ones dead."""
    root = scratch_path(spark, "followed")
    G.refresh(library(spark, sf), root)
    G.refresh(later(spark, sf), root)
    index = G.read_segments(spark, root)
    terms = K.understood(asked(spark, sf), F.array().cast("array<string>")).select(F.explode("terms").alias("term")).distinct()
    blocks = I.term_blocks(I.terms_of(terms, index), index)
    found = terms.join(I.frequencies(blocks), "term", "left").fillna(0, ["df"]).join(F.broadcast(index.total))  # a row
    return found.select("term", "df", F.round(R.idf(F.col("total"), F.col("df")), 6).alias("idf"))


@query(f"""SELECT memory_id, CASE WHEN memory_id % 100 = 7 THEN 'stale' ELSE status END AS status, confidence FROM {TEAM} WHERE memory_id % 100 <> 8
 UNION ALL SELECT memory_id + 1000000000, 'candidate', confidence FROM {TEAM} WHERE memory_id % 100 = 9""")
def merged_records(spark, sf):
    """A keyed table after a merge that rewrites only the buckets with changes: new rows, changed ones, and some gone."""
    root = scratch_path(spark, "records")
    records = S.team_view(spark, sf).select("memory_id", "status", "confidence")
    manifest.merge(records, root, ["memory_id"])
    changed = records.where("memory_id % 100 = 7").withColumn("status", F.lit("stale"))
    new = records.where("memory_id % 100 = 9").select((F.col("memory_id") + 1_000_000_000).alias("memory_id"), F.lit("candidate").alias("status"), "confidence")
    manifest.merge(changed.unionByName(new), root, ["memory_id"], gone=records.where("memory_id % 100 = 8"))
    return manifest.read(spark, root)
