"""The driver tables as relations of the data model.

Each relation is SQL that Spark and DuckDB read alike; {name} stands for a table or another relation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NOW = "2024-02-01 00:00:00"

RELATIONS: dict[str, str] = {
    "kg_nodes": """
        SELECT concat('mod:n', n_nationkey) AS id, 'Module' AS type, n_name AS label, CAST(0 AS BIGINT) AS size, '' AS hash, CAST(0 AS BIGINT) AS created_at FROM {nation}
        UNION ALL SELECT concat('proj:r', r_regionkey), 'Project', r_name, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM {region}
        UNION ALL SELECT concat('file:c', c_custkey), 'File', c_name, CAST(c_custkey * 37 % 5000 AS BIGINT), concat('h', c_custkey % 7), CAST(c_custkey AS BIGINT) FROM {customer}
        UNION ALL SELECT concat('file:s', s_suppkey), 'File', s_name, CAST(s_suppkey * 91 % 9000 AS BIGINT), concat('h', s_suppkey % 7), CAST(s_suppkey AS BIGINT) FROM {supplier}
        UNION ALL SELECT concat('dep:p', p_partkey), 'Dependency', p_name, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM {part}
        UNION ALL SELECT concat('dec:o', o_orderkey), 'Decision', o_orderpriority, CAST(0 AS BIGINT), '', CAST(o_orderkey AS BIGINT) FROM {orders}""",
    "kg_edges": """
        SELECT concat('mod:n', c_nationkey) AS src_id, concat('file:c', c_custkey) AS dst_id, 'contains' AS type FROM {customer}
        UNION ALL SELECT concat('mod:n', s_nationkey), concat('file:s', s_suppkey), 'contains' FROM {supplier}
        UNION ALL SELECT DISTINCT concat('file:s', l_suppkey), concat('dep:p', l_partkey), 'depends_on' FROM {lineitem}
        UNION ALL SELECT concat('file:c', o_custkey), concat('dec:o', o_orderkey), 'decided_by' FROM {orders} WHERE o_orderstatus = 'F'
        UNION ALL SELECT concat('dec:o', o_orderkey), concat('file:c', o_custkey), 'affects' FROM {orders} WHERE o_orderstatus = 'O'
        UNION ALL SELECT concat('mod:n', n_nationkey), concat('proj:r', n_regionkey), 'relates_to' FROM {nation}""",
    "odd_edges": """
        SELECT src_id, dst_id, type FROM {kg_edges} WHERE type IN ('contains', 'relates_to')
        UNION ALL SELECT concat('file:c', c_custkey), concat('file:c', c_custkey + 1), 'contains' FROM {customer} WHERE c_custkey % 50 = 0
        UNION ALL SELECT concat('file:c', c_custkey), 'dec:none', 'decided_by' FROM {customer} WHERE c_custkey % 60 = 0
        UNION ALL SELECT concat('mod:n', n_nationkey), concat('card:', n_nationkey), 'summarized_by' FROM {nation}""",
    "exec_nodes": """
        SELECT concat('func:c', c_custkey) AS id, 'function' AS type, c_name AS label, concat('app/n', c_nationkey, '/routes/c.py') AS file FROM {customer}
        UNION ALL SELECT concat('func:o', o_orderkey), 'method', concat('Order.', o_orderpriority), concat('app/orders/', o_orderstatus, '.py') FROM {orders}
        UNION ALL SELECT concat('func:p', p_partkey), 'method', concat('Part.', p_brand), concat('lib/models/', p_size, '.py') FROM {part}
        UNION ALL SELECT concat('func:s', s_suppkey), 'function', s_name, concat('core/db/n', s_nationkey, '.py') FROM {supplier}""",
    "exec_raw": """
        SELECT concat('func:c', o_custkey) AS src_id, concat('func:o', o_orderkey) AS dst_id, 3 AS level FROM {orders}
        UNION ALL SELECT concat('func:o', l_orderkey), concat('func:p', l_partkey), CASE l_returnflag WHEN 'N' THEN 3 WHEN 'A' THEN 2 ELSE 1 END FROM {lineitem}
        UNION ALL SELECT concat('func:p', l_partkey), concat('func:s', l_suppkey), CASE WHEN l_linenumber = 1 AND l_quantity <= 5 THEN 2 ELSE 1 END FROM {lineitem}""",
    "exec_edges": """
        SELECT src_id, dst_id, 'calls' AS type, CASE max(level) WHEN 3 THEN 'exact' WHEN 2 THEN 'resolved' ELSE 'heuristic' END AS confidence FROM {exec_raw} GROUP BY src_id, dst_id""",
    "steps": """
        SELECT DISTINCT concat('u', a.user_id) AS src, concat('u', b.user_id) AS dst FROM {events} a JOIN {events} b ON b.event_id = a.event_id + 1 WHERE a.user_id <> b.user_id""",
    "df_nodes": """
        SELECT DISTINCT concat('state:k', regexp_extract(props, '"k": *([0-9]+)', 1)) AS id, 'attr' AS kind, concat('k', regexp_extract(props, '"k": *([0-9]+)', 1)) AS label, 'state.py' AS file FROM {events}""",
    "df_edges": """
        SELECT DISTINCT concat('func:p', user_id) AS src_id, concat('state:k', regexp_extract(props, '"k": *([0-9]+)', 1)) AS dst_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'writes' ELSE 'reads' END AS type
        FROM {events} WHERE event_type IN ('purchase', 'signup', 'view', 'click')""",
    "memory": """
        SELECT concat('mem', event_id) AS id, CASE event_type WHEN 'view' THEN 'session' WHEN 'click' THEN 'session' WHEN 'purchase' THEN 'project' WHEN 'signup' THEN 'user' ELSE 'learning' END AS scope,
        CASE event_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'note' END AS kind, props AS content, CAST(ts AS TIMESTAMP) AS created_at, CAST(ts AS TIMESTAMP) AS last_accessed_at,
        CAST(event_id % 7 AS BIGINT) AS access_count, 0.25 * CAST(event_id % 5 AS DOUBLE) AS salience, CASE WHEN event_id % 4 = 0 THEN CAST(86400 * 10 AS BIGINT) END AS ttl_seconds,
        CASE WHEN event_id % 10 = 9 THEN 'archived' ELSE 'active' END AS status, concat('file:c', user_id) AS link FROM {events}""",
    "call_log": """
        SELECT CAST(event_id AS BIGINT) AS seq, CASE event_type WHEN 'view' THEN 'claude' WHEN 'click' THEN 'ollama' ELSE event_type END AS provider, CASE user_id % 3 WHEN 0 THEN 'claude-opus-4-8' WHEN 1 THEN 'm1' ELSE 'm2' END AS model,
        CAST(event_id % 1000 AS BIGINT) AS tokens_in, CAST(event_id % 300 AS BIGINT) AS tokens_out, CAST(event_id % 97 AS DOUBLE) / 4 AS latency_ms, event_id % 10 <> 0 AS ok, CASE WHEN event_id % 20 = 0 THEN 'Timeout' WHEN event_id % 10 = 0 THEN 'Refused' END AS error FROM {events}""",
    "token_events": """
        SELECT d.source AS provider, CAST((length(d.text) + 3 - (length(d.text) + 3) % 4) / 4 AS BIGINT) AS tokens_raw_equiv, CAST(least(length(d.text), 2000) / 8 - least(length(d.text), 2000) % 8 / 8.0 AS BIGINT) AS tokens_estimated,
        CASE WHEN l.doc_id IS NOT NULL THEN CAST(d.doc_id % 400 AS BIGINT) END AS tokens_actual FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "items": """
        SELECT source AS bundle, concat('doc', doc_id) AS ref, CASE doc_id % 10 WHEN 0 THEN 'card' WHEN 1 THEN 'criteria' WHEN 2 THEN 'decision' WHEN 3 THEN 'finding' WHEN 4 THEN 'adr' WHEN 5 THEN 'evidence' WHEN 6 THEN 'repo_profile' WHEN 7 THEN 'memory' WHEN 8 THEN 'source' ELSE 'other' END AS kind,
        text AS content, CAST(length(text) % 977 + 20 AS BIGINT) AS tokens, CAST(length(text) AS BIGINT) AS raw_tokens, doc_id AS place FROM {documents}""",
    "findings": """
        SELECT d.source AS agent, d.lang AS claim, CASE WHEN l.toxic = 1 THEN 'high' WHEN l.quality = 0 THEN 'med' WHEN l.quality = 1 THEN 'low' ELSE 'other' END AS severity, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS confidence, d.doc_id AS arrival
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "files": """
        SELECT concat(source, '/', CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' ELSE '' END, lang, '/f', doc_id, CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.TSX' WHEN 3 THEN '.md' WHEN 4 THEN '.mjs' ELSE '' END) AS path, text AS content FROM {documents}""",
    "proposals": """
        SELECT concat('prop', event_id) AS id, CASE event_id % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'committed' END AS status, event_type AS kind, concat('{', '"name": "', event_type, CAST(event_id % 5 AS STRING), '"', '}') AS payload, CAST(event_id AS BIGINT) AS created_at FROM {events}""",
    "actions": """
        SELECT concat('prop', event_id) AS id, CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'commit' END AS action, concat('u', user_id) AS actor, '' AS note, '2026-01-01' AS at FROM {events} WHERE event_id % 2 = 0 OR event_id % 5 = 0""",
    "py_files": """
        SELECT concat('p', doc_id % 50, '/m', doc_id, '.py') AS path, doc_id % 3 AS form, doc_id AS k, CASE doc_id % 3
        WHEN 0 THEN concat('import os, numpy.linalg as la', chr(10), 'class C', doc_id, ':', chr(10), '    kind = 1', chr(10), '    def go(self):', chr(10), '        self.kind = 2', chr(10), '        return self.step()', chr(10),
            '    def step(self):', chr(10), '        return helper', doc_id, '()', chr(10), 'def helper', doc_id, '():', chr(10), '    return la.norm(os.sep)', chr(10))
        WHEN 1 THEN concat('from p', (doc_id - 1) % 50, '.m', doc_id - 1, ' import helper', doc_id - 1, ', C', doc_id - 1, ' as T', chr(10), 'class Tool', doc_id, '(C', doc_id - 1, '):', chr(10), '    def use(self, other: C', doc_id - 1, '):', chr(10),
            '        other.kind = 3', chr(10), '        return len(other.kind)', chr(10), 'def make', doc_id, '():', chr(10), '    t = Tool', doc_id, '()', chr(10), '    t.size = 1', chr(10), '    if t:', chr(10), '        def inner():', chr(10),
            '            return helper', doc_id - 1, '()', chr(10), '    return x.y', chr(10))
        ELSE 'def (' END AS source FROM {documents}
        UNION ALL SELECT DISTINCT concat('p', doc_id % 50, '/__init__.py'), CAST(9 AS BIGINT), CAST(-1 AS BIGINT), '' FROM {documents}""",
    "py_a": """
        SELECT path, k FROM {py_files} WHERE form = 0""",
    "py_b": """
        SELECT b.path, b.k, b.k - 1 AS j, a.path AS home, concat('p', (b.k - 1) % 50) AS pack, i.path AS pack_file FROM {py_files} b LEFT JOIN {py_a} a ON a.k = b.k - 1
        LEFT JOIN {py_files} i ON i.path = concat('p', (b.k - 1) % 50, '/__init__.py') WHERE b.form = 1""",
}
_NAME = re.compile(r"\{(\w+)\}")


def relation(spark: SparkSession, sf_dir: str, name: str, _made: dict | None = None) -> DataFrame:
    """A table or relation as a DataFrame."""
    made = {} if _made is None else _made
    if name not in made:
        if name in TABLES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sql = RELATIONS[name]
            needs = dict.fromkeys(_NAME.findall(sql))
            # Only names in braces are filled in; other braces of the text are doubled for the formatter.
            kept = re.sub(r"\{(?!\w+\})|(?<!\w)\}", lambda m: m[0] * 2, sql)
            made[name] = spark.sql(kept, **{n: relation(spark, sf_dir, n, made) for n in needs})
    return made[name]


def prelude() -> str:
    """All relations as common table expressions for DuckDB."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_NAME.sub(lambda m: m[1], sql)})" for n, sql in RELATIONS.items())
