"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import ann, bpe, html_extract, ngram_join, packing, phrases, pieces, pii, quality, resample, suffix_dedup, token_counts, url_filter
from skeinwork.llm.runtime import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ngram_join, op2_html_extraction, op3_packing, op4_quality_rules, op5_suffix_array_dedup, op6_url_filters, op7_nearest_neighbours, op8_bpe, op9_pii,
        op10_token_counts, op11_sentencepiece, op12_collocations, op13_resampling,
    )
    return {f.__name__: f for f in found}


#: Word shingles, the exact join on them, and components by closure.
OP1_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM items a JOIN items b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.other FROM reach r JOIN ends e ON e.a = r.doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.m AS component_id FROM sets s JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id"""


def _rule_sql(host: str, path: str, what: int) -> str:
    parts = []
    for rule, verdict in sorted(url_filter.RULES, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        parts.append(f"WHEN ({host} = '{name}' OR ends_with({host}, '.{name}')) AND starts_with({path}, '/{rest}') THEN '{(rule, verdict)[what]}'")
    return f"CASE {' '.join(parts)} END"


def _host_sql(url: str) -> str:
    return f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _node_sql(url: str) -> str:
    path = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    return f"CASE WHEN {_host_sql(url)} <> '' THEN {_host_sql(url)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || regexp_extract({url}, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)', 1) END"


def _targets_sql(tag: str, mark: str, value: str) -> str:
    return f"SELECT scheme, host, folder, node, regexp_extract(unnest(list_filter(regexp_extract_all(html, '(?is)(<{tag}\\s[^>]*>)', 1), lambda t: regexp_matches(t, '{mark}'))), '{value}', 1) AS raw FROM named WHERE node IS NOT NULL AND html IS NOT NULL"


_CODE_SQL = r"coalesce(TRY_CAST(nullif(regexp_extract(p, '^0*([0-9]{1,3});', 1), '') AS INTEGER), TRY_CAST('0x' || nullif(regexp_extract(p, '^[xX]0*([0-9a-fA-F]{1,2});', 1), '') AS INTEGER))"
_REST_SQL = "regexp_replace(p, '^[xX]?[0-9a-fA-F]+;', '')"
_NAMED_SQL = """replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39))"""
_DECODED_SQL = f"""replace(replace(array_to_string(list_transform(string_split({_NAMED_SQL}, '&#'), lambda p, i: CASE WHEN i = 1 THEN p WHEN {_CODE_SQL} = 38 THEN concat(chr(1), {_REST_SQL})
    WHEN {_CODE_SQL} BETWEEN 1 AND 255 THEN concat(chr({_CODE_SQL}), {_REST_SQL}) ELSE concat('&#', p) END), ''), '&amp;', chr(1)), chr(1), '&')"""
_CANONICAL_SQL = _targets_sql("link", r"""(?is)\srel\s*=\s*["'']?canonical\b""", r"""(?is)\shref\s*=\s*["'']?([^"''\s>]+)""")
_REFRESH_SQL = _targets_sql("meta", r"""(?is)\shttp-equiv\s*=\s*["'']?refresh\b""", r"""(?is)\scontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)""")
#: The rules, and aliases by closure over canonical and refresh links.
OP6_SQL = rf"""
WITH RECURSIVE parsed AS (SELECT page_id, html, coalesce({_host_sql("url")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^(.*?)://', 1), '') AS scheme, {_node_sql("url")} AS node FROM pages),
named AS (SELECT *, host || regexp_extract(CASE WHEN path = '' THEN '/' ELSE path END, '(?s)^(.*/)', 1) AS folder FROM parsed),
raws AS ({_CANONICAL_SQL} UNION ALL {_REFRESH_SQL}),
targets AS (SELECT scheme, host, folder, node, {_DECODED_SQL} AS t FROM raws WHERE raw <> ''),
full_urls AS (SELECT node, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN scheme || '://' || host || t ELSE scheme || '://' || folder || t END AS u FROM targets WHERE t <> ''),
edges AS (SELECT DISTINCT node AS a, {_node_sql("u")} AS b FROM full_urls),
ends AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM ends UNION SELECT e.b, r.other FROM reach r JOIN ends e ON e.a = r.node),
member AS (SELECT node, other, {_rule_sql("regexp_extract(other, '(?s)^([^/]*)', 1)", "regexp_extract(other, '(?s)^[^/]*([^?]*)', 1)", 1)} AS v FROM reach),
alias AS (SELECT node, min(other) AS component, min(v) AS group_verdict FROM member GROUP BY node)
SELECT n.page_id, n.host, n.path, {_rule_sql("n.host", "n.path", 0)} AS rule, coalesce({_rule_sql("n.host", "n.path", 1)}, a.group_verdict, 'allow') AS verdict, a.component FROM named n LEFT JOIN alias a ON a.node = n.node"""


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CUTS_SQL = ", ".join(f"CASE WHEN len(w) > {k} THEN struct_pack(k := {k}, head := w[:{k}], tail := w[{k + 1}:]) END" for k in range(1, 5))
#: All phrases of up to five words are counted; cuts are joined to the counts of their parts.
OP12_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER_SQL}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
runs AS (SELECT lang, w[i:i + m - 1] AS w FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 6) r(m) WHERE len(w) >= m)),
counted AS (SELECT lang, w, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, w, a, unnest(list_filter([{_CUTS_SQL}], lambda c: c IS NOT NULL)) AS c FROM counted WHERE len(w) > 1),
valued AS (SELECT c.lang, c.w, c.a, c.c.k AS k, x.a AS l, y.a AS r, t.n, CAST((1000 * CAST(c.a AS HUGEINT) * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.w = c.c.head JOIN counted y ON y.lang = c.lang AND y.w = c.c.tail JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
parts AS (SELECT DISTINCT lang, w[i:i + m - 1] AS w, a FROM (SELECT lang, w, a, m, unnest(range(1, len(w) - m + 2)) AS i FROM counted, range(2, 5) r(m) WHERE len(w) > m)),
kept AS (SELECT * FROM lowest v WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = v.lang AND p.w = v.w AND 100 * p.a >= 100 * v.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) <= 2000"""


_BYTES_SQL = "list_transform(range(0, length(hex(w)) // 2), lambda i: CAST('0x' || substr(hex(w), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
#: CRC-32 by its table, the buckets of all distinct words, and the draw by a window.
OP13_SQL = rf"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) r(i))),
lists AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
wanted AS (SELECT unnest(regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
own AS (SELECT row_no, unnest(words) AS w FROM lists),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, {_BYTES_SQL}), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INTEGER)])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM own UNION SELECT DISTINCT w FROM wanted), crc),
s AS (SELECT bucket, count(*) AS s FROM own JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (w) GROUP BY bucket),
sizes AS (SELECT CAST((SELECT count(*) FROM own) AS DOUBLE) AS all_s, CAST((SELECT count(*) FROM wanted) AS DOUBLE) AS all_t),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sizes),
weights AS (SELECT row_no, CAST(sum(gain) AS BIGINT) AS weight FROM own JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY row_no),
drawn AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM lists LEFT JOIN weights USING (row_no)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM drawn)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express; the others are compared with brute force in tests/llm."""
    return {"op1_ngram_join": OP1_SQL, "op6_url_filters": OP6_SQL, "op12_collocations": OP12_SQL, "op13_resampling": OP13_SQL}
