"""Queries opN_<name> of the training-data operators over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.best_fit_packing import pack_documents
from tidemark.llm.chat_snapshots import maximal_conversations
from tidemark.llm.language_mixture import identify_languages
from tidemark.llm.lexicon_automata import score_toxicity
from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.line_crf import fit_lines, rule_quality
from tidemark.llm.line_runs import dedup_lines
from tidemark.llm.neighbour_quality import score_quality
from tidemark.llm.phrase_sketch import mine_phrases
from tidemark.llm.set_sketch import near_duplicate_classes
from tidemark.llm.spaced_seeds import find_passages
from tidemark.llm.tiered_search import rank_documents
from tidemark.llm.url_rules import Rule, judge_urls

# The rules that op8 is asked for.
URL_RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(_table(spark, sf_dir, "conversations"))


def op2_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rule_quality(docs, fit_lines(docs, _table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).selectExpr("doc_id", "_n_lines AS n_lines", "_n_dropped AS n_dropped", "sha2(_kept, 256) AS kept_sha256")


def op7_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_phrase_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_snapshots, op2_neighbour_quality, op3_license_scan, op4_best_fit_packing, op5_line_crf, op6_line_dedup, op7_set_sketch, op8_url_rules, op9_language_mixture, op10_spaced_seeds,
        op11_lexicon_automata, op12_tiered_search, op13_phrase_sketch,
    )
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_chat_snapshots": """
WITH turns AS (
  SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         coalesce('+' || md5(role), '-') || '/' || coalesce('+' || md5(text), '-') AS mark
  FROM conversations WHERE conv_id IS NOT NULL),
prefixes AS (
  SELECT conv_id, k, n, md5(string_agg(mark, '|') OVER (PARTITION BY conv_id ORDER BY k)) AS h FROM turns),
whole AS (SELECT h, min(conv_id) AS conv_id, count(*) AS n_equal FROM prefixes WHERE k = n GROUP BY h),
kept AS (SELECT * FROM whole WHERE h NOT IN (SELECT h FROM prefixes WHERE k < n))
SELECT t.conv_id, max(t.n) AS n_turns, max(w.n_equal) AS n_equal,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM turns t JOIN kept w ON t.conv_id = w.conv_id GROUP BY t.conv_id
""",
    "op6_line_dedup": f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM rows_),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS lo, max(doc_id) AS hi FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.*, coalesce(o.lo < o.hi AND k.doc_id <> o.lo, false) AS gone
           FROM keyed k LEFT JOIN owners o ON k.key = o.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
""",
    "op7_set_sketch": f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded),
flat AS (SELECT doc_id, unnest(s) AS g FROM shingled),
sizes AS (SELECT doc_id, len(s) AS n FROM shingled),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM sizes UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.node)
SELECT s.doc_id, s.n AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept
FROM sizes s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n
""",
    "op8_url_rules": f"""
WITH parts AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
found AS (
  SELECT page_id, host, path, r.h || r.p AS rule, r.v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM found WHERE k = 1
""",
    "op12_tiered_search": f"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
sized AS (SELECT row_number() OVER () AS r, doc_id, w, len(w)::BIGINT AS n FROM worded WHERE len(w) > 0),
corpus AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')) AS t FROM benchmark),
flat AS (SELECT r, doc_id, n, unnest(w) AS t FROM sized),
tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM flat WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY t, big_n),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN df USING (t), corpus GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
""",
    "op13_phrase_sketch": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3), (4)) ks(k) WHERE len(w) >= k),
counted AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS lhs, array_to_string(w[c + 1:], ' ') AS rhs
  FROM (SELECT *, unnest(range(1, k)) AS c FROM found)),
cut_scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.c, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.lhs JOIN counted y ON y.lang = c.lang AND y.phrase = c.rhs),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS nth FROM cut_scores),
inner_ AS (
  SELECT lang, a AS b, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM found))),
longer AS (SELECT lang, phrase, max(b) AS b FROM inner_ GROUP BY ALL),
kept AS (
  SELECT x.lang, x.phrase, x.a, x.l, x.r, x.score FROM lowest x LEFT JOIN longer o ON o.lang = x.lang AND o.phrase = x.phrase
  WHERE nth = 1 AND (o.b IS NULL OR 100::HUGEINT * o.b < 80::HUGEINT * x.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
}
