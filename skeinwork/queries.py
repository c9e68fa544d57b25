"""One named query for each operator over the driver tables, and its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork import schemas as S
from skeinwork.demo import NOW, prelude, relation
from skeinwork.functions import scalars as C
from skeinwork.operators import code, extract, graph, ledger, ownership, records, search
from skeinwork.plans import context, ingest, memory, sync
from skeinwork.sources import blocks, files, store, text
from skeinwork.streaming import calls
from skeinwork.tables import dealt, literal_table, settle, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_PRELUDE = prelude()


class Rel:
    """Relations by name, of one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return relation(self.spark, self._dir, name, self._made)

    def ids(self, *ids: str, name: str = "id") -> DataFrame:
        return literal_table(self.spark, [(i,) for i in ids], f"{name} string")


def _wide(df: DataFrame) -> DataFrame:
    """Integers as 64 bits, as the SQL twins have them."""
    small = {f.name: F.col(f.name).cast("long") for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))}
    return df.withColumns(small) if small else df


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a query; sql follows the relations (and ctes) as a statement for DuckDB."""

    def put(f: Callable[[Rel], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _wide(f(Rel(spark, sf_dir)))
        if sql:
            ORACLES[name] = f"{_PRELUDE}{', ' + ctes if ctes else ''}\n{sql}"
        return f

    return put


def bfs_sql(adjacency: str, seeds: str, depth: int) -> str:
    """CTEs adj, hop, near and found (seed, id, depth, parent) of a bounded search."""
    return f"""adj AS ({adjacency}), start AS ({seeds}),
    hop(seed, id, depth) AS (SELECT id, id, 0 FROM start UNION SELECT h.seed, a.dst, h.depth + 1 FROM hop h JOIN adj a ON a.src = h.id WHERE h.depth < {depth}),
    near AS (SELECT seed, id, min(depth) AS depth FROM hop GROUP BY seed, id),
    found AS (SELECT n.seed, n.id, CAST(n.depth AS BIGINT) AS depth, min(p.id) AS parent FROM near n JOIN adj a ON a.dst = n.id JOIN near p ON p.seed = n.seed AND p.id = a.src AND p.depth = n.depth - 1 WHERE n.depth > 0 GROUP BY n.seed, n.id, n.depth)"""


_CALLS_OUT = "SELECT DISTINCT src_id AS src, dst_id AS dst FROM exec_edges WHERE confidence IN ('resolved', 'exact')"
_CALLS_IN = "SELECT DISTINCT dst_id AS src, src_id AS dst FROM exec_edges WHERE confidence IN ('resolved', 'exact')"
_KG_OUT = "SELECT DISTINCT e.src_id AS src, e.dst_id AS dst FROM kg_edges e JOIN kg_nodes n ON n.id = e.dst_id"
_ALL = "SELECT seed, id, depth, parent FROM found"


# ---- sources (S)


@query("s1_repository_scan", "SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.tsx' THEN 'typescript' ELSE 'javascript' END AS language, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS hash FROM files WHERE regexp_matches(lower(path), '\\.(py|js|tsx|mjs)$') AND NOT contains(path, '/node_modules/')")
def _(r):
    return files.scanned(r.files).drop("source")


@query("s2_language_detect", "SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.TSX' THEN 'typescript' WHEN path LIKE '%.js' OR path LIKE '%.mjs' THEN 'javascript' END AS language FROM files")
def _(r):
    return r.files.select("path", files.language_of(F.col("path")).alias("language"))


@query("s3_churn", "SELECT concat('f', o_custkey % 50) AS path, count(*) AS churn FROM orders WHERE o_custkey % 10 > 0 GROUP BY 1")
def _(r):
    line = F.when(F.col("o_custkey") % 10 > 0, F.concat(F.lit(" f"), F.col("o_custkey") % 50)).otherwise(" ")
    return files.churn(r.orders.select(line.alias("value")))


_NODE = "id string, type string, label string, props string, created_at timestamp, updated_at timestamp"
#: kg_nodes as records of the collection nodes.
_RECORDS = "recs AS (SELECT id, type, label, concat(size, '') AS props, created_at AS made FROM kg_nodes)"


def _nodes(r: Rel) -> DataFrame:
    at = F.timestamp_seconds("created_at")
    return r.kg_nodes.select("id", "type", "label", F.col("size").cast("string").alias("props"), at.alias("created_at"), at.alias("updated_at"))


def _store(r: Rel, **collections: DataFrame) -> store.Store:
    """A store in the shared folder with these collections; nodes is there in any case."""
    out = store.Store(r.spark, f"{work_dir(r.spark)}/store-{uuid.uuid4().hex}")
    for name, rows in ({"nodes": _nodes(r)} | collections).items():
        out.overwrite(name, rows)
    return out


def _brief(df: DataFrame) -> DataFrame:
    return df.select("id", "type", "label", "props", F.unix_seconds("created_at").alias("made"))


def _edges(r: Rel) -> DataFrame:
    return r.kg_edges.select(F.concat_ws(">", "src_id", "type", "dst_id").alias("id"), "src_id", "dst_id", "type", F.lit("{}").alias("props"), F.timestamp_seconds(F.lit(0)).alias("created_at"))


@query("s4_collection_scan", "SELECT id, type, label, props, made FROM recs", _RECORDS)
def _(r):
    return _brief(_store(r).scan("nodes"))


@query("s5_point_lookup", "SELECT id, type, label, props, made FROM recs WHERE id = 'dep:p7'", _RECORDS)
def _(r):
    return _brief(_store(r).get("nodes", "dep:p7"))


@query("s6_catalog_listing", "SELECT * FROM (VALUES ('edges'), ('nodes')) t(name)")
def _(r):
    return r.ids(*_store(r, edges=_edges(r)).collections(), name="name")


@query("s7_raw_items", """SELECT id, concat('{"id":"', id, '","type":"', type, '","label":"', label, '","props":"', props, '","created_at":"', strftime(make_timestamp(made * 1000000), '%Y-%m-%dT%H:%M:%S.000Z'), '","updated_at":"', strftime(make_timestamp(made * 1000000), '%Y-%m-%dT%H:%M:%S.000Z'), '"}') AS data FROM recs""", _RECORDS)
def _(r):
    return _store(r).raw_items("nodes")


@query("s8_snapshot_load", "SELECT 'nodes' AS collection, id FROM kg_nodes UNION ALL SELECT 'edges', concat(src_id, '>', type, '>', dst_id) FROM kg_edges UNION ALL SELECT 'df_nodes', 'state:k1'")
def _(r):
    s = _store(r, edges=_edges(r))
    folder = f"{s.root}-snapshots"
    s.write_snapshots(folder)
    s._write_text(f"{folder}/df_nodes.yaml", '[{"id": "state:k1", "kind": "attr", "label": "k1", "file": "state.py"}]')
    found = store.read_snapshots(r.spark, folder)
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("collection"), "id") for n, df in found.items()])


@query("s8_yaml_records", "SELECT coalesce(lang, 'und') AS collection, CAST(doc_id AS VARCHAR) AS id, sha256(text) AS digest, n_chars FROM documents")
def _(r):
    blocks.register(r.spark)
    folder = f"{work_dir(r.spark)}/records-{uuid.uuid4().hex}"
    data = F.to_json(F.struct("text", "n_chars"))
    r.documents.select(F.coalesce("lang", F.lit("und")).alias("collection"), F.col("doc_id").cast("string").alias("id"), data.alias("data")).write.format("records_yaml").mode("append").save(folder)
    read = r.spark.read.format("records_yaml").load(folder).withColumn("x", F.from_json("data", "text string, n_chars long"))
    return read.select("collection", "id", F.sha2("x.text", 256).alias("digest"), "x.n_chars")


#: The text of each note, and its part from the Decision heading on.
_NOTES = """full_notes AS (SELECT doc_id, substr(text, 1, 100) || CASE WHEN doc_id % 2 = 0 THEN concat('## Decision', chr(10)) ELSE '' END || substr(text, 101) || concat(chr(10), '## Next', chr(10), 'x') AS t FROM documents),
    cut_notes AS (SELECT doc_id, t, CASE WHEN contains(t, '## Decision') THEN concat('## Decision', split_part(substr(t, instr(t, '## Decision') + 11), concat(chr(10), '##'), 1)) ELSE t END AS c FROM full_notes)"""


@query("s9_notes", "SELECT concat(doc_id, '.md') AS ref, substr(trim(c, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 1, 600) AS content, (coalesce(length(t), 0) + 3) // 4 AS raw_tokens FROM cut_notes", _NOTES)
def _(r):
    mark = F.when(F.col("doc_id") % 2 == 0, "## Decision\n").otherwise("")
    full = F.concat(F.substring("text", 1, 100), mark, F.expr("substr(text, 101)"), F.lit("\n## Next\nx"))
    return text.notes(r.documents.select(F.concat(F.lit("adr/"), "doc_id", F.lit(".md")).alias("path"), full.alias("text")))


@query("s10_rules", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'path', 'app/*', 'Execution'), (1, 'path', '*/routes/*', 'Route'), (2, 'path', '*/models/*', 'Model'), (3, 'path', '*/db/*', 'Storage'), (4, 'path', '*/services/*', 'Service')) t(ordinal, kind, pattern, value)")
def _(r):
    rules = text.ownership_rules({"rules": [{"match": {"path": "app/*"}, "domain": "Execution"}, {"match": {}}, "bad"]})
    return ownership.rule_table(r.spark, rules).select("ordinal", "kind", "pattern", F.coalesce("domain", "layer").alias("value"))


@query("s10_rule_files", "SELECT concat(p_partkey, '.yaml') AS path, k AS ordinal, CASE k WHEN 0 THEN 'path' ELSE 'symbol' END AS kind, CASE k WHEN 0 THEN concat('app/', p_brand, '/*') ELSE concat(p_name, ': #', p_size) END AS pattern, CASE k WHEN 0 THEN p_type END AS domain, CASE k WHEN 1 THEN concat(p_type, ' ', p_brand) END AS layer, CASE k WHEN 1 THEN CAST(p_size AS VARCHAR) END AS criticality FROM part, (VALUES (CAST(0 AS BIGINT)), (1)) t(k)")
def _(r):
    first = F.format_string('# rules of a part\nrules:\n  - match: {path: "app/%s/*", size: 1}\n    domain: %s\n  - bad\n  - match: {}\n', "p_brand", "p_type")
    second = F.format_string("  - match:\n      symbol: '%s: #%d'\n    layer: >-\n      %s\n      %s\n    criticality: %d\n", "p_name", "p_size", "p_type", "p_brand", "p_size")
    return text.rule_files(r.part.select(F.concat("p_partkey", F.lit(".yaml")).alias("path"), F.concat(first, second).alias("text"))).drop("impact")


# ---- sinks (K), as the rows that a write leaves


@query("k1_upsert", "SELECT id, CASE type WHEN 'Module' THEN concat(upper(label), '!') ELSE label END AS label, CASE type WHEN 'Module' THEN 7 ELSE made END AS changed FROM recs", _RECORDS)
def _(r):
    s, new = _store(r), _nodes(r).filter("type = 'Module'")
    # Each key comes twice; the last by created_at counts.
    twice = new.withColumn("created_at", F.timestamp_seconds(F.lit(-5))).unionByName(new.withColumn("label", F.concat(F.upper("label"), F.lit("!"))))
    s.upsert("nodes", twice, order=["created_at"], now=F.timestamp_seconds(F.lit(7)))
    return s.scan("nodes").select("id", "label", F.unix_seconds("updated_at").alias("changed"))


@query("k2_delete", "SELECT id, type FROM kg_nodes WHERE NOT (type = 'File' AND size % 2 = 0)")
def _(r):
    s = _store(r)
    s.delete("nodes", r.kg_nodes.filter("type = 'File' and size % 2 = 0").select("id").unionByName(r.ids("none")))
    return s.scan("nodes").select("id", "type")


@query("k3_truncate", "SELECT 'nodes' AS name, 0::BIGINT AS records, 0::BIGINT AS collections")
def _(r):
    s = _store(r)
    s.clear()
    return s.scan("nodes").agg(F.lit("nodes").alias("name"), F.count("*").alias("records"), F.lit(len(s.collections())).cast("long").alias("collections"))


@query("k4_snapshot", "SELECT src_id, dst_id, type FROM kg_edges WHERE type = 'contains'")
def _(r):
    s = _store(r, edges=_edges(r).filter("type = 'contains'"))
    folder = f"{s.root}-snapshots"
    s.write_snapshots(folder)
    s.delete("nodes", s.scan("nodes"))
    s.write_snapshots(folder)  # nodes is empty now, and its snapshot goes
    found = store.read_snapshots(r.spark, folder)
    return reduce(DataFrame.unionByName, [df.select("src_id", "dst_id", "type") for df in found.values()])


@query("k5_rebuild", "SELECT id, type, label, props, made FROM recs WHERE type <> 'Decision'", _RECORDS)
def _(r):
    s, kept = _store(r), _store(r, nodes=_nodes(r).filter("type <> 'Decision'"))
    kept.write_snapshots(f"{kept.root}-snapshots")
    s.rebuild(f"{kept.root}-snapshots")
    return _brief(s.scan("nodes"))


@query("k6_reconcile", "SELECT a.added, a.removed, a.kept, (SELECT count(*) FROM kg_nodes WHERE type = 'File' AND size % 2 = 0) AS records FROM (SELECT count(*) FILTER (a.id IS NULL) AS added, count(*) FILTER (b.id IS NULL) AS removed, count(*) FILTER (a.id = b.id) AS kept FROM (SELECT id FROM kg_nodes WHERE type = 'File' AND size % 3 > 0) a FULL JOIN (SELECT id FROM kg_nodes WHERE type = 'File' AND size % 2 = 0) b ON a.id = b.id) a")
def _(r):
    sized = r.kg_nodes.filter("type = 'File'").select("id", "size")
    f = _nodes(r).join(sized, "id")
    s = _store(r, nodes=f.filter("size % 3 > 0").drop("size"))
    n = s.reconcile("nodes", f.filter("size % 2 = 0").drop("size"))
    return s.scan("nodes").agg(*[F.lit(n[k]).cast("long").alias(k) for k in n], F.count("*").alias("records"))


@query("k6_reconciled_keys", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'kept' END AS status FROM (SELECT id FROM kg_nodes WHERE type = 'File' AND size % 3 > 0) a FULL JOIN (SELECT id FROM kg_nodes WHERE type = 'File' AND size % 2 = 0) b ON a.id = b.id")
def _(r):
    f = r.kg_nodes.filter("type = 'File'")
    return store.reconciled(f.filter("size % 3 > 0"), f.filter("size % 2 = 0"))


@query("k7_migrations", "SELECT id, lower(label) AS label, 3::BIGINT AS version FROM kg_nodes WHERE type <> 'Decision'")
def _(r):
    s = _store(r)
    steps = {2: lambda t: t.change("nodes", lambda old: old.withColumn("label", F.lower("label"))), 3: lambda t: t.delete("nodes", t.scan("nodes").filter("type = 'Decision'"))}
    s.migrate(steps, target=2)
    s.migrate(steps, target=3)
    s.migrate(steps, target=3)
    return s.scan("nodes").select("id", "label", F.lit(s.schema_version()).cast("long").alias("version"))


def _moved(r: Rel) -> store.Store:
    """A second store after a bundle went from one to the other."""
    s = _store(r, edges=_edges(r))
    t = store.Store(r.spark, f"{s.root}-copy")
    s.export_bundle(f"{s.root}-bundle")
    t.import_bundle(f"{s.root}-bundle")
    return t


@query("k8_export", "SELECT name, n FROM (SELECT 'edges' AS name, count(*) AS n FROM kg_edges UNION ALL SELECT 'nodes', count(*) FROM kg_nodes)")
def _(r):
    t = _moved(r)
    return reduce(DataFrame.unionByName, [t.scan(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in t.collections()])


@query("k9_import", "SELECT id, type, label, props, made FROM recs", _RECORDS)
def _(r):
    return _brief(_moved(r).scan("nodes"))


@query("k10_retention", "SELECT name, row_number() OVER (ORDER BY name DESC) <= 10 AS keep FROM (SELECT DISTINCT concat('backup-', o_orderdate) AS name FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders))")
def _(r):
    return store.retained(r.orders.select(F.concat(F.lit("backup-"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("name")).distinct())


# ---- filters (F)


@query("f1_where", "SELECT id, type, label FROM kg_nodes WHERE type = 'File' AND hash = 'h3'")
def _(r):
    return records.where(r.kg_nodes, {"type": "File", "hash": "h3", "absent": None}).select("id", "type", "label")


@query("f2_memory_query", "SELECT id, kind, content FROM memory WHERE scope = 'project' AND status = 'active'")
def _(r):
    return records.memory_query(r.memory, scope="project", status="active").select("id", "kind", "content")


@query("f3_of_type", "SELECT id, label FROM kg_nodes WHERE type = 'Module'")
def _(r):
    return records.of_type(r.kg_nodes, "Module").select("id", "label")


@query("f4_label_lookup", "SELECT label, min(id) AS id FROM kg_nodes GROUP BY label")
def _(r):
    return records.first_by_label(r.kg_nodes)


_RESOLVED = "targets(target) AS (VALUES ('mod:n3'), ('1-URGENT'), ('NATION_5'), ('nothing')), res AS (SELECT t.target, n.id FROM targets t JOIN kg_nodes n ON n.id = t.target UNION ALL SELECT t.target, n.id FROM targets t JOIN kg_nodes n ON n.label = t.target WHERE NOT EXISTS (SELECT 1 FROM kg_nodes m WHERE m.id = t.target))"


@query("f5_resolve", "SELECT target, id FROM res", _RESOLVED)
def _(r):
    return records.resolve(r.kg_nodes, r.ids("mod:n3", "1-URGENT", "NATION_5", "nothing", name="target"))


@query("f6_ambiguity_guard", "SELECT t.target, CASE WHEN count(r.id) = 1 THEN min(r.id) END AS id, CASE WHEN count(r.id) = 0 THEN 'not found' WHEN count(r.id) > 1 THEN 'ambiguous' END AS error, CASE WHEN count(r.id) > 1 THEN array_to_string(list_slice(list_sort(list(r.id)), 1, 25), ',') ELSE '' END AS candidates FROM targets t LEFT JOIN res r ON r.target = t.target GROUP BY t.target", _RESOLVED)
def _(r):
    out = records.resolve_unique(r.kg_nodes, r.ids("mod:n3", "1-URGENT", "NATION_5", "nothing", name="target"))
    return out.withColumn("candidates", F.array_join("candidates", ","))


@query("f7_symbol_search", "SELECT id, label FROM exec_nodes WHERE contains(label, 'Brand#1') ORDER BY id LIMIT 50")
def _(r):
    return records.search_label(r.exec_nodes, "Brand#1").select("id", "label")


@query(
    "f7_batch_search",
    """SELECT pattern, id FROM (SELECT p.pattern, n.id, row_number() OVER (PARTITION BY p.pattern ORDER BY n.id) AS place FROM (SELECT CAST(p_partkey AS VARCHAR) AS pattern FROM part UNION SELECT substr(p_name, 2, 5) FROM part UNION SELECT substr(p_name, 1, 2) FROM part) p
    JOIN exec_nodes n ON contains(n.label, p.pattern)) WHERE place <= 50""",
)
def _(r):
    # Every part asks for its number and for pieces of its name among all symbols.
    name, key = F.col("p_name"), F.col("p_partkey")
    asked = r.part.select(F.explode(F.array(key.cast("string"), F.substring(name, 2, 5), F.substring(name, 1, 2))).alias("pattern"))
    return search.LabelIndex(r.exec_nodes).search(asked).select("pattern", "id")


@query("f8_confidence_floor", "SELECT confidence, count(*) AS n FROM exec_edges WHERE confidence IN ('resolved', 'exact') GROUP BY confidence")
def _(r):
    return records.confident_calls(r.exec_edges, "no such name").groupBy("confidence").agg(F.count("*").alias("n"))


@query("f9_brief", "SELECT e.dst_id AS id, n.type, n.label, n.file FROM (SELECT DISTINCT dst_id FROM exec_edges WHERE src_id < 'func:c2' UNION SELECT 'func:none') e LEFT JOIN exec_nodes n ON n.id = e.dst_id")
def _(r):
    ids = r.exec_edges.filter("src_id < 'func:c2'").select(F.col("dst_id").alias("id")).unionByName(r.ids("func:none")).distinct()
    return records.brief(ids, r.exec_nodes)


@query("f10_edge_validity", """SELECT e.src_id, e.dst_id, e.type, coalesce(CASE e.type WHEN 'contains' THEN s.type = 'Module' AND d.type = 'File' WHEN 'decided_by' THEN s.type IN ('File', 'Module') AND d.type = 'Decision' WHEN 'summarized_by' THEN d.type = 'KnowledgeCard' ELSE s.id IS NOT NULL AND d.id IS NOT NULL END, false) AS ok
    FROM odd_edges e LEFT JOIN kg_nodes s ON s.id = e.src_id LEFT JOIN kg_nodes d ON d.id = e.dst_id""")
def _(r):
    return records.checked_edges(r.odd_edges, r.kg_nodes).select("src_id", "dst_id", "type", "ok")


def _now():
    return F.lit(NOW).cast("timestamp")


_IDLE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed_at))"
_TTL = "coalesce(ttl_seconds, CASE WHEN scope = 'session' THEN 86400 END)"


@query("f11_expired", f"SELECT id, coalesce({_IDLE} > {_TTL} * 1000000, false) AS expired FROM memory")
def _(r):
    return r.memory.select("id", C.is_expired("last_accessed_at", _now(), C.effective_ttl("ttl_seconds", "scope")).alias("expired"))


def _cards(r: Rel) -> DataFrame:
    return r.kg_nodes.filter("created_at % 2 = 0").select(F.col("id").alias("ref"), F.when(F.col("created_at") % 4 == 0, F.col("hash")).otherwise("old").alias("source_hash"), F.concat(F.lit("card of "), "label").alias("purpose"))


_CARDS = "cards AS (SELECT id AS ref, CASE WHEN created_at % 4 = 0 THEN hash ELSE 'old' END AS source_hash, concat('card of ', label) AS purpose FROM kg_nodes WHERE created_at % 2 = 0)"


@query("f12_card_valid", "SELECT c.ref, CASE WHEN n.type = 'File' THEN c.source_hash = n.hash ELSE true END AS valid FROM cards c JOIN kg_nodes n ON n.id = c.ref", _CARDS)
def _(r):
    return records.valid_cards(_cards(r), r.kg_nodes).select("ref", "valid")


@query("f13_card_schema", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'not an object' WHEN 1 THEN 'missing key' WHEN 2 THEN 'unknown key' END AS error FROM documents")
def _(r):
    full = F.lit('{"schema_version":1,"card_id":"c","target":{},"generated_at":"","source_hash":"","provider":{},"purpose":"","modules":[],"dependencies":[],"key_decisions":[],"risks":[],"recent_changes":[],"extensions":{}}')
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.lit("[1]")).when(k == 1, F.lit('{"schema_version":1}')).when(k == 2, F.lit('{"schema_version":1,"other":2}')).otherwise(full)
    return r.documents.select("doc_id", records.card_errors(raw).alias("error"))


@query("f14_budget_fit", "SELECT doc_id, doc_id % 3 = 0 OR n_chars <= 1000 AS fits FROM documents")
def _(r):
    return r.documents.select("doc_id", records.fits(F.col("n_chars"), F.when(F.col("doc_id") % 3 > 0, 1000)).alias("fits"))


@query("f15_pending_review", "SELECT id, created_at FROM proposals WHERE status = 'proposed'")
def _(r):
    return records.pending(r.proposals).select("id", "created_at")


@query("f16_skill_lookup", "SELECT id, label FROM (SELECT concat('skill:', n_nationkey) AS id, n_name AS label FROM nation) WHERE label = 'NATION_3' OR id = 'NATION_3' ORDER BY id LIMIT 1")
def _(r):
    return records.skill(r.nation.select(F.concat(F.lit("skill:"), "n_nationkey").alias("id"), F.lit("Skill").alias("type"), F.col("n_name").alias("label")), "NATION_3").select("id", "label")


@query("f17_sessions", "SELECT conv_id AS id, min(turn) AS created_at FROM conversations GROUP BY conv_id")
def _(r):
    return records.newest_first(r.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").alias("created_at")))


# ---- joins (J)


@query("j1_neighbors", "SELECT e.src_id AS seed, e.type AS edge_type, e.dst_id AS id FROM kg_edges e JOIN kg_nodes n ON n.id = e.dst_id WHERE e.src_id IN ('mod:n1', 'file:c2') UNION ALL SELECT e.dst_id, e.type, e.src_id FROM kg_edges e JOIN kg_nodes n ON n.id = e.src_id WHERE e.dst_id IN ('mod:n1', 'file:c2')")
def _(r):
    return graph.neighbors(r.kg_edges, r.kg_nodes, r.ids("mod:n1", "file:c2"), direction="both")


@query("j2_class_bases", "SELECT concat('class:p', p.p_partkey) AS src_id, concat('class:s', b.s_suppkey) AS dst_id, 'extends' AS type, 'heuristic' AS confidence FROM part p JOIN supplier b ON b.s_suppkey = p.p_size WHERE b.s_suppkey % 3 > 0")
def _(r):
    # Suppliers are classes by their own name, every third name twice; parts extend the supplier of their size, and one name that no class has.
    base = r.supplier.select(F.concat(F.lit("class:s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    twin = base.filter("k % 3 = 0").select(F.concat("id", F.lit("b")).alias("id"), "name")
    none = F.array().cast("array<string>").alias("bases")
    sized = r.part.join(base.select("k", F.col("name").alias("base")), F.col("p_size") == F.col("k"), "left")
    parts = sized.select(F.concat(F.lit("class:p"), "p_partkey").alias("id"), F.lit("class").alias("type"), F.concat(F.lit("P"), "p_partkey").alias("name"), F.array_compact(F.array("base", F.lit("nothing"))).alias("bases"))
    every = parts.unionByName(base.select("id", F.lit("class").alias("type"), "name", none)).unionByName(twin.select("id", F.lit("class").alias("type"), "name", none))
    return code.extends(every)


@query("j4_module_resolution", """SELECT w.module, coalesce(e.path, u.path) AS path FROM (SELECT DISTINCT concat('d', doc_id % 40) AS module FROM documents UNION SELECT 'a.d3' UNION SELECT 'b.d39') w LEFT JOIN (SELECT module, path FROM idx) e ON e.module = w.module
    LEFT JOIN (SELECT module, min(path) AS path FROM (SELECT module, path FROM idx UNION SELECT regexp_replace(module, '^[^.]*[.]', ''), path FROM idx) GROUP BY module HAVING count(DISTINCT path) = 1) u ON u.module = w.module WHERE coalesce(e.path, u.path) IS NOT NULL""",
    "idx AS (SELECT DISTINCT concat(CASE WHEN doc_id % 2 = 0 THEN 'a.' ELSE 'b.' END, 'd', doc_id % 60) AS module, concat(CASE WHEN doc_id % 2 = 0 THEN 'a/' ELSE 'b/' END, 'd', doc_id % 60, '.py') AS path FROM documents)")
def _(r):
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "a/").otherwise("b/"), F.lit("d"), F.col("doc_id") % 60, F.lit(".py"))
    names = r.documents.select(F.concat(F.lit("d"), F.col("doc_id") % 40).alias("module")).unionByName(r.ids("a.d3", "b.d39", name="module"))
    return code.resolve_modules(names, code.module_index(r.documents.select(path.alias("path")).distinct()))


@query("j7_deepest_package", """SELECT f.path, arg_max(p.dir, length(p.dir)) AS dir FROM (SELECT DISTINCT concat(source, '/', lang, '/x/f', doc_id, '.py') AS path FROM documents) f JOIN (SELECT DISTINCT source AS dir FROM documents UNION SELECT DISTINCT concat(source, '/', lang) FROM documents WHERE doc_id % 3 = 0) p ON starts_with(f.path, p.dir || '/') GROUP BY f.path""")
def _(r):
    d = r.documents
    packs = d.select(F.col("source").alias("dir")).unionByName(d.filter("doc_id % 3 = 0").select(F.concat_ws("/", "source", "lang").alias("dir"))).distinct()
    return code.package_of(d.select(F.concat("source", F.lit("/"), "lang", F.lit("/x/f"), "doc_id", F.lit(".py")).alias("path")), packs)


def _rules(r: Rel) -> DataFrame:
    return ownership.rule_table(r.spark, [{"kind": "path", "pattern": "app/orders/*", "domain": "Orders", "criticality": "P0"}, {"kind": "name", "pattern": "^Part[.]Brand#1", "domain": "Parts", "impact": "LIVE"}, {"kind": "symbol", "pattern": "Order.1-URGENT", "domain": "Rush"}, {"kind": "path", "pattern": "core/*", "domain": "Core"}])


_RULED = """rules(ordinal, tier, domain, layer, criticality, impact) AS (VALUES (0, 1, 'Orders', NULL, 'P0', NULL), (1, 2, 'Parts', NULL, NULL, 'LIVE'), (2, 3, 'Rush', NULL, NULL, NULL), (3, 1, 'Core', NULL, NULL, NULL), (4, 1, NULL, 'Route', NULL, NULL), (5, 1, NULL, 'Model', NULL, NULL), (6, 1, NULL, 'Storage', NULL, NULL), (7, 1, NULL, 'Service', NULL, NULL)),
    ruled AS (SELECT n.id, r.* FROM exec_nodes n JOIN rules r ON CASE r.ordinal WHEN 0 THEN starts_with(n.file, 'app/orders/') WHEN 1 THEN starts_with(n.label, 'Part.Brand#1') WHEN 2 THEN n.label = 'Order.1-URGENT' WHEN 3 THEN starts_with(n.file, 'core/') WHEN 4 THEN n.file LIKE '%/routes/%' WHEN 5 THEN n.file LIKE '%/models/%' WHEN 6 THEN n.file LIKE '%/db/%' ELSE n.file LIKE '%/services/%' END),
    axes AS (SELECT id, arg_max(domain, tier * 100 - ordinal) FILTER (domain IS NOT NULL) AS domain, max(tier) FILTER (domain IS NOT NULL) AS domain_tier, arg_max(layer, tier * 100 - ordinal) FILTER (layer IS NOT NULL) AS layer, arg_max(criticality, tier * 100 - ordinal) FILTER (criticality IS NOT NULL) AS criticality, arg_max(impact, tier * 100 - ordinal) FILTER (impact IS NOT NULL) AS impact FROM ruled GROUP BY id),
    counted AS (SELECT e.dst_id AS id, a.domain, count(*) AS n FROM (SELECT DISTINCT src_id, dst_id FROM exec_edges WHERE confidence IN ('resolved', 'exact') AND src_id <> dst_id) e JOIN axes a ON a.id = e.src_id WHERE a.domain IS NOT NULL GROUP BY 1, 2),
    obs AS (SELECT id, domain AS observed_owner, round_even(n / sum(n) OVER (PARTITION BY id), 2) AS observed_conf, CAST(count(*) OVER (PARTITION BY id) AS BIGINT) AS caller_domains, row_number() OVER (PARTITION BY id ORDER BY n DESC, domain) AS k FROM counted),
    classed AS (SELECT n.id AS symbol, coalesce(a.domain, 'Unknown') AS declared_owner, coalesce(o.observed_owner, 'Unknown') AS observed_owner, coalesce(a.domain = o.observed_owner, false) AS agreement,
        round_even(CASE WHEN o.id IS NULL THEN w ELSE least(1.0, 0.5 * w + 0.5 * o.observed_conf + CASE WHEN a.domain = o.observed_owner THEN 0.1 ELSE 0.0 END) END, 2) AS confidence, coalesce(a.layer, 'Unknown') AS layer, coalesce(a.criticality, 'Unclassified') AS criticality, coalesce(a.impact, 'Unclassified') AS impact
        FROM (SELECT x.id, CAST(CASE y.domain_tier WHEN 3 THEN 1.0 WHEN 2 THEN 0.8 WHEN 1 THEN 0.6 ELSE 0.2 END AS DOUBLE) AS w FROM exec_nodes x LEFT JOIN axes y ON y.id = x.id) n LEFT JOIN axes a ON a.id = n.id LEFT JOIN obs o ON o.id = n.id AND o.k = 1)"""


@query("j8_rule_match", "SELECT id, CAST(tier AS BIGINT) AS tier, CAST(ordinal AS BIGINT) AS ordinal FROM ruled", _RULED)
def _(r):
    return ownership.matches(r.exec_nodes, _rules(r)).select("id", "tier", "ordinal")


@query(
    "j8_rule_index",
    """SELECT concat('order:', o_orderkey) AS id, tier, ordinal FROM orders JOIN (SELECT CAST(p_partkey AS BIGINT) AS p FROM part) ON o_custkey = p, (VALUES (1)) t(tier), LATERAL (SELECT 5 * p AS ordinal)
    UNION ALL SELECT concat('order:', o_orderkey), 1, 5 * p_partkey + 1 FROM orders JOIN part ON o_orderkey = p_partkey
    UNION ALL SELECT concat('order:', o_orderkey), 2, 5 * p_partkey + 2 FROM orders JOIN part ON o_orderkey = p_partkey
    UNION ALL SELECT concat('order:', o_orderkey), 3, 5 * p_partkey + 3 FROM orders JOIN part ON o_orderkey = 2 * p_partkey
    UNION ALL SELECT concat('order:', o_orderkey), 2, 5 * p_partkey + 4 FROM orders JOIN part ON CAST(o_orderkey AS VARCHAR) = concat(p_partkey, '7')""",
)
def _(r):
    # Five rules for each part: folders, file names, patterns with and without anchors, exact labels; 100,000 of them at scale 0.1.
    key, p = F.col("o_orderkey"), F.col("p_partkey")
    nodes = r.orders.select(F.concat(F.lit("order:"), key).alias("id"), F.concat(F.lit("Order.k"), key, F.lit(".x")).alias("label"), F.concat(F.lit("app/o"), "o_custkey", F.lit("/f"), key, F.lit(".py")).alias("file"))
    forms = [("path", F.concat(F.lit("app/o"), p, F.lit("/*"))), ("path", F.concat(F.lit("*/f"), p, F.lit(".py"))), ("name", F.concat(F.lit("[.]k"), p, F.lit("[.]"))), ("symbol", F.concat(F.lit("Order.k"), 2 * p, F.lit(".x"))), ("name", F.concat(F.lit("^Order[.]k"), p, F.lit("7[.]x$")))]
    rows = r.part.select(F.explode(F.array(*[F.struct((5 * p + n).alias("ordinal"), F.lit(k).alias("kind"), x.alias("pattern"), F.concat(F.lit("D"), p % 7).alias("domain")) for n, (k, x) in enumerate(forms)])).alias("rule"))
    return ownership.matches(nodes, ownership.rules_of(rows.select("rule.*"))).select("id", F.col("tier").cast("long").alias("tier"), "ordinal")


@query("j9_why", "SELECT DISTINCT t.target, d.decision FROM (SELECT 'file:c7' AS target, 'file:c7' AS id UNION ALL SELECT label, id FROM kg_nodes WHERE id = 'file:c10') t JOIN (SELECT src_id AS id, dst_id AS decision FROM kg_edges WHERE type = 'decided_by' UNION ALL SELECT dst_id, src_id FROM kg_edges WHERE type = 'affects') d ON d.id = t.id")
def _(r):
    label = r.kg_nodes.filter("id = 'file:c10'").select(F.col("label").alias("target"))
    return graph.why(r.kg_nodes, r.kg_edges, r.ids("file:c7", name="target").unionByName(label))


@query("j10_removed_files", "SELECT DISTINCT concat('f', doc_id) AS path FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 > 0")
def _(r):
    p = r.documents.select(F.concat(F.lit("f"), "doc_id").alias("path"), "doc_id")
    return records.set_difference(p.filter("doc_id % 5 = 0").select("path"), p.filter("doc_id % 3 = 0"), "path")


@query("j11_incremental_reuse", "SELECT concat('f', doc_id) AS path, CASE WHEN doc_id % 10 = 0 THEN 'removed' WHEN doc_id % 2 = 0 THEN 'reused' ELSE 'parsed' END AS status FROM documents WHERE NOT (doc_id % 10 = 0 AND doc_id % 4 = 3)")
def _(r):
    d = r.documents.select(F.concat(F.lit("f"), "doc_id").alias("path"), F.sha2("text", 256).alias("hash"), "doc_id")
    prior = d.filter("doc_id % 4 <> 3").withColumn("hash", F.when(F.col("doc_id") % 2 == 0, F.col("hash")).otherwise("old"))
    return code.reuse(d.filter("doc_id % 10 <> 0"), prior)


@query("j12_orphans", "SELECT id FROM kg_nodes WHERE type IN ('Module', 'Dependency') AND id NOT IN (SELECT src_id FROM kg_edges WHERE type = 'depends_on' UNION SELECT dst_id FROM kg_edges WHERE type = 'depends_on')")
def _(r):
    return graph.orphans(r.kg_nodes, r.kg_edges.filter("type = 'depends_on'")).select("id")


@query("j13_cascade_delete", "SELECT src_id, dst_id, type FROM kg_edges WHERE src_id NOT IN ('mod:n1', 'mod:n2') AND dst_id NOT IN ('mod:n1', 'mod:n2')")
def _(r):
    return graph.without_nodes(r.kg_nodes, r.kg_edges, r.ids("mod:n1", "mod:n2"))[1]


@query("j14_readers", "SELECT DISTINCT dst_id AS state, src_id AS func FROM df_edges WHERE type = 'reads'")
def _(r):
    return graph.accessors(r.df_edges, "reads")


@query("j14_writers", "SELECT DISTINCT dst_id AS state, src_id AS func FROM df_edges WHERE type = 'writes'")
def _(r):
    return graph.accessors(r.df_edges, "writes")


def _linked_memory(r: Rel) -> DataFrame:
    return r.memory.withColumn("links", F.array("link"))


_SUBJECT = "subject AS (SELECT link AS id, id AS memory, content FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY created_at DESC, id) AS k FROM memory WHERE status = 'active') WHERE k = 1)"


@query("j15_subject_memory", "SELECT id, memory, content FROM subject", _SUBJECT)
def _(r):
    return context.subject_memory(_linked_memory(r))


@query("j16_hotspot_lookup", "SELECT c.c_custkey, coalesce(h.churn, 0) AS churn FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS churn FROM orders GROUP BY 1 ORDER BY churn DESC, concat('c', o_custkey) LIMIT 10) h ON h.o_custkey = c.c_custkey")
def _(r):
    hot = code.hotspots(r.orders.groupBy(F.concat(F.lit("c"), "o_custkey").alias("path")).agg(F.count("*").alias("churn")))
    return r.customer.withColumn("path", F.concat(F.lit("c"), "c_custkey")).join(F.broadcast(hot), "path", "left").select("c_custkey", F.coalesce("churn", F.lit(0)).alias("churn"))


@query("j17_endpoints", "SELECT t.token, CASE t.token WHEN 'START' THEN 'func:c1' WHEN 'func:s0' THEN 'func:s0' WHEN 'k3' THEN 'state:k3' END AS id FROM (VALUES ('START'), ('func:s0'), ('k3'), ('nothing'), ('Order.1-URGENT')) t(token)")
def _(r):
    anchors = literal_table(r.spark, [("START", "func:c1")], "name string, target string")
    return graph.endpoint(r.exec_nodes, r.df_nodes, anchors, r.ids("START", "func:s0", "k3", "nothing", "Order.1-URGENT", name="token"))


# ---- traversal (G)


@query("impact", _ALL, bfs_sql(_CALLS_IN, "SELECT 'func:s0' AS id", 10))
def _(r):
    return graph.callers(r.exec_edges, r.ids("func:s0"), None)


@query("g1_traverse", "SELECT f.seed, f.id, n.type, f.depth, f.parent FROM found f JOIN kg_nodes n ON n.id = f.id WHERE n.type = 'File'", bfs_sql(_KG_OUT, "SELECT 'mod:n1' AS id UNION ALL SELECT 'mod:n4'", 2))
def _(r):
    return graph.traverse(r.kg_nodes, r.kg_edges, r.ids("mod:n1", "mod:n4"), 2, node_types=["File"]).drop("label")


@query("g1_traverse_both", "SELECT f.seed, f.id, f.depth, f.parent FROM found f", bfs_sql("SELECT DISTINCT src_id AS src, dst_id AS dst FROM kg_edges WHERE type IN ('contains', 'relates_to') UNION SELECT DISTINCT dst_id, src_id FROM kg_edges WHERE type IN ('contains', 'relates_to')", "SELECT 'proj:r1' AS id", 2))
def _(r):
    return graph.traverse(r.kg_nodes, r.kg_edges, r.ids("proj:r1"), 2, ["contains", "relates_to"], direction="both").select("seed", "id", "depth", "parent")


@query("g2_bfs_cyclic", _ALL, bfs_sql("SELECT src, dst FROM steps", "SELECT 'u1' AS id UNION ALL SELECT 'u2'", 3))
def _(r):
    return graph.reach(r.steps, r.ids("u1", "u2"), 3)


@query("g3_callees", _ALL, bfs_sql(_CALLS_OUT, "SELECT 'func:c1' AS id UNION ALL SELECT 'func:c2'", 2))
def _(r):
    return graph.callees(r.exec_edges, r.ids("func:c1", "func:c2"), 2)


@query("g4_callers", _ALL, bfs_sql(_CALLS_IN, "SELECT 'func:p3' AS id", 2))
def _(r):
    return graph.callers(r.exec_edges, r.ids("func:p3"), 2)


@query("g5_impact_exact", _ALL, bfs_sql("SELECT DISTINCT dst_id AS src, src_id AS dst FROM exec_edges WHERE confidence = 'exact'", "SELECT 'func:p1' AS id", 10))
def _(r):
    return graph.callers(r.exec_edges, r.ids("func:p1"), None, "exact")


@query(
    "g5_deep_impact",
    """SELECT concat('order:', o_orderkey % 4) AS seed, concat('order:', o_orderkey) AS id FROM orders WHERE o_orderkey >= 4
    UNION SELECT concat('order:', o.o_orderkey % 4), concat('line:', l.l_orderkey, ':', l.l_linenumber) FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""",
)
def _(r):
    # Four chains of calls through all orders, as deep as there are orders, and the lines of each order beside them.
    key = F.col("o_orderkey")
    order = lambda k: F.concat(F.lit("order:"), k)
    line = F.concat(F.lit("line:"), "l_orderkey", F.lit(":"), "l_linenumber")
    chain = r.orders.filter(key >= 4).select(order(key).alias("src_id"), order(key - 4).alias("dst_id"))
    lines = r.lineitem.join(r.orders.select(key.alias("l_orderkey")), "l_orderkey").select(line.alias("src_id"), order(F.col("l_orderkey")).alias("dst_id"))
    calls = chain.unionByName(lines).select("src_id", "dst_id", F.lit("calls").alias("type"), F.lit("exact").alias("confidence"))
    return graph.impacted(calls, r.ids("order:0", "order:1", "order:2", "order:3"), "exact")


@query("g6_impact_report", "SELECT f.seed, count(*) AS n_impacted, array_to_string(list_sort(list(DISTINCT n.file)), ',') AS files FROM found f LEFT JOIN exec_nodes n ON n.id = f.id GROUP BY f.seed", bfs_sql(_CALLS_IN, "SELECT 'func:s0' AS id UNION ALL SELECT 'func:s1'", 10))
def _(r):
    return graph.impact_report(r.exec_edges, r.exec_nodes, r.ids("func:s0", "func:s1"))


_CHAINS = f"""adj AS ({_CALLS_IN}), chain(path) AS (SELECT ['func:s0'] UNION ALL SELECT list_append(c.path, a.dst) FROM chain c JOIN adj a ON a.src = c.path[-1] WHERE NOT list_contains(c.path, a.dst) AND len(c.path) <= 6),
    leaf AS (SELECT path FROM chain c WHERE len(path) = 7 OR NOT EXISTS (SELECT 1 FROM adj a WHERE a.src = c.path[-1] AND NOT list_contains(c.path, a.dst))), ranked AS (SELECT path, row_number() OVER (ORDER BY path) AS rank FROM leaf)"""


@query("g7_paths_to", "SELECT 'func:s0' AS target, rank, array_to_string(list_reverse(path), '>') AS chain FROM ranked WHERE rank <= 20", _CHAINS)
def _(r):
    return graph.paths_to(r.exec_edges, r.ids("func:s0")).withColumn("chain", F.array_join("chain", ">"))


_LINEAGE = f"{_CALLS_OUT} UNION SELECT src_id, dst_id FROM df_edges WHERE type = 'writes' UNION SELECT dst_id, src_id FROM df_edges WHERE type = 'reads'"


@query("g8_lineage_adjacency", _LINEAGE)
def _(r):
    return graph.lineage_adjacency(r.exec_edges, r.df_edges)


_PATHS = f"""adj AS ({_CALLS_OUT}), walk(source, path) AS (SELECT s, [s] FROM (SELECT concat('func:c', c_custkey) AS s FROM customer WHERE c_custkey < 40) UNION ALL SELECT w.source, list_append(w.path, a.dst) FROM walk w JOIN adj a ON a.src = w.path[-1] WHERE NOT list_contains(w.path, a.dst) AND len(w.path) <= 4 AND w.path[-1] <> 'func:s1'),
    ranked AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY path) AS rank FROM walk WHERE path[-1] = 'func:s1')"""


@query("g9_find_paths", "SELECT source, 'func:s1' AS target, rank, array_to_string(path, '>') AS path FROM ranked WHERE rank <= 10", _PATHS)
def _(r):
    pairs = r.customer.filter("c_custkey < 40").select(F.concat(F.lit("func:c"), "c_custkey").alias("source"), F.lit("func:s1").alias("target"))
    return graph.find_paths(graph.directed(records.confident_calls(r.exec_edges)).distinct(), pairs, 4).withColumn("path", F.array_join("path", ">"))


_SEEDS = "SELECT DISTINCT src_id AS id FROM df_edges WHERE dst_id IN ('state:k1', 'state:k2')"
_FLOW = bfs_sql(_CALLS_IN, _SEEDS, 6) + ", side AS (SELECT DISTINCT dst_id AS state, CASE type WHEN 'writes' THEN 'upstream' ELSE 'downstream' END AS side, src_id AS func FROM df_edges WHERE dst_id IN ('state:k1', 'state:k2')), flow AS (SELECT state, side, func FROM side UNION SELECT s.state, s.side, f.id FROM side s JOIN found f ON f.seed = s.func)"


@query("g10_data_flow", "SELECT state, side, func FROM flow", _FLOW)
def _(r):
    return graph.data_flow(r.df_edges, r.exec_edges, r.ids("state:k1", "state:k2"))


@query("g11_flow_impact", "SELECT DISTINCT state, func FROM flow", _FLOW)
def _(r):
    return graph.flow_impact(r.df_edges, r.exec_edges, r.ids("state:k1", "state:k2"))


@query(
    "g10_all_states",
    "SELECT state, side, count(*) AS n_funcs, min(func) AS first, max(func) AS last FROM (SELECT DISTINCT state, side, func FROM wave) GROUP BY state, side",
    f"""calls_in AS ({_CALLS_IN}), wave(state, side, func, depth) AS (SELECT DISTINCT dst_id, CASE type WHEN 'writes' THEN 'upstream' ELSE 'downstream' END, src_id, 0 FROM df_edges
    UNION SELECT w.state, w.side, c.dst, w.depth + 1 FROM wave w JOIN calls_in c ON c.src = w.func WHERE w.depth < 6)""",
)
def _(r):
    flow = graph.data_flow(r.df_edges, r.exec_edges, r.df_nodes.select("id"))
    return flow.groupBy("state", "side").agg(F.count("*").alias("n_funcs"), F.min("func").alias("first"), F.max("func").alias("last"))


@query("g12_lineage_calls", "SELECT 'func:c1' AS source, 'func:s1' AS target, r.rank, CAST(s.step AS BIGINT) AS step, s.id, n.type, n.label, n.file FROM ranked r, LATERAL (SELECT unnest(r.path) AS id, generate_subscripts(r.path, 1) - 1 AS step) s LEFT JOIN exec_nodes n ON n.id = s.id WHERE r.source = 'func:c1' AND r.rank <= 10", _PATHS)
def _(r):
    anchors = literal_table(r.spark, [("BEGIN", "func:c1")], "name string, target string")
    pairs = literal_table(r.spark, [("BEGIN", "func:s1")], "source string, target string")
    return graph.lineage(r.exec_nodes, r.exec_edges, r.df_nodes, r.df_edges.filter("false"), anchors, pairs, 4).select("source", "target", "rank", "step", "id", "type", "label", "file")


_FLOWS = f"""adj AS ({_LINEAGE}), asked AS (SELECT DISTINCT w.src_id AS source, t.id AS target FROM df_edges w, (SELECT concat('func:s', s_suppkey) AS id FROM supplier WHERE s_suppkey < 10) t WHERE w.type = 'writes' AND w.src_id LIKE 'func:p1_'),
    walk(source, target, path) AS (SELECT source, target, [source] FROM asked UNION ALL SELECT w.source, w.target, list_append(w.path, a.dst) FROM walk w JOIN adj a ON a.src = w.path[-1] WHERE NOT list_contains(w.path, a.dst) AND len(w.path) <= 3 AND w.path[-1] <> w.target),
    ranked AS (SELECT source, target, path, row_number() OVER (PARTITION BY source, target ORDER BY path) AS rank FROM walk WHERE path[-1] = target)"""


@query("g12_lineage", "SELECT r.source, r.target, r.rank, CAST(s.step AS BIGINT) AS step, s.id, coalesce(n.type, d.kind) AS type, coalesce(n.label, d.label) AS label, coalesce(n.file, d.file) AS file FROM ranked r, LATERAL (SELECT unnest(r.path) AS id, generate_subscripts(r.path, 1) - 1 AS step) s LEFT JOIN exec_nodes n ON n.id = s.id LEFT JOIN df_nodes d ON d.id = s.id WHERE r.rank <= 10", _FLOWS)
def _(r):
    writers = r.df_edges.filter("type = 'writes' and src_id like 'func:p1_'").select(F.col("src_id").alias("source")).distinct()
    ends = r.supplier.filter("s_suppkey < 10").select(F.concat(F.lit("END"), "s_suppkey").alias("target"))
    anchors = r.supplier.filter("s_suppkey < 10").select(F.concat(F.lit("END"), "s_suppkey").alias("name"), F.concat(F.lit("func:s"), "s_suppkey").alias("target"))
    return graph.lineage(r.exec_nodes, r.exec_edges, r.df_nodes, r.df_edges, anchors, writers.join(ends), 3).select("source", "target", "rank", "step", "id", "type", "label", "file")


@query("g13_call_graph", "SELECT f.seed, f.id, f.depth, n.type, n.label, n.file FROM found f LEFT JOIN exec_nodes n ON n.id = f.id", bfs_sql(_CALLS_OUT, "SELECT 'func:o1' AS id", 2))
def _(r):
    return records.brief(graph.callees(r.exec_edges, r.ids("func:o1"), 2), r.exec_nodes).select("seed", "id", "depth", "type", "label", "file")


@query("g14_path_steps", "SELECT r.rank, CAST(s.step AS BIGINT) AS step, s.id, n.label FROM (SELECT rank, list_reverse(path) AS path FROM ranked WHERE rank <= 20) r, LATERAL (SELECT unnest(r.path) AS id, generate_subscripts(r.path, 1) - 1 AS step) s LEFT JOIN exec_nodes n ON n.id = s.id", _CHAINS)
def _(r):
    steps = graph.paths_to(r.exec_edges, r.ids("func:s0")).select("rank", F.posexplode("chain").alias("step", "id"))
    return records.brief(steps, r.exec_nodes).select("rank", "step", "id", "label")


@query("g15_graph_summary", "SELECT f.seed, f.id, n.type, n.label, f.depth FROM found f JOIN kg_nodes n ON n.id = f.id", bfs_sql(_KG_OUT, "SELECT min(id) AS id FROM kg_nodes WHERE label = 'NATION_5'", 2))
def _(r):
    return graph.traverse(r.kg_nodes, r.kg_edges, records.by_label(r.kg_nodes, "NATION_5").select("id"), 2).drop("parent")


@query("g16_state_tools", "SELECT f.state, f.func AS id, n.type, n.label, n.file FROM (SELECT DISTINCT state, func FROM flow) f LEFT JOIN exec_nodes n ON n.id = f.func", _FLOW)
def _(r):
    flow = graph.flow_impact(r.df_edges, r.exec_edges, records.resolve(r.df_nodes, r.ids("k1", "state:k2", name="target")).select("id")).withColumnRenamed("func", "id")
    return records.brief(flow, r.exec_nodes).select("state", "id", "type", "label", "file")


# ---- extraction (X)


@query("x2_js_imports", r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(src, '(?:\bfrom\s+|\bimport\s+|\brequire\s*\(\s*)[''"]([^''"]+)[''"]', 1), lambda x: CASE WHEN starts_with(x, '.') THEN x ELSE split_part(x, '/', 1) END))), ',') AS imports FROM (SELECT page_id, concat('import x from "', split_part(url, '/', 3), '/a"; const y = require(''./p', page_id % 3, '''); import ''lib', page_id % 5, '/sub''') AS src FROM pages)""")
def _(r):
    src = F.concat(F.lit('import x from "'), F.element_at(F.split("url", "/"), 3), F.lit("/a\"; const y = require('./p"), F.col("page_id") % 3, F.lit("'); import 'lib"), F.col("page_id") % 5, F.lit("/sub'"))
    return r.pages.select("page_id", F.array_join(extract.js_imports(src), ",").alias("imports"))


@query("x3_import_dispatch", "SELECT path, CASE WHEN k % 3 = 1 THEN 'vue' ELSE '' END AS imports FROM (SELECT concat('f', doc_id) AS path, doc_id AS k FROM documents) WHERE k % 3 > 0 UNION ALL SELECT concat('f', doc_id), 'json,os' FROM documents WHERE doc_id % 3 = 0")
def _(r):
    k = F.col("doc_id") % 3
    src = r.documents.select(F.concat(F.lit("f"), "doc_id").alias("path"), F.when(k == 0, "python").when(k == 1, "typescript").otherwise("other").alias("language"), F.when(k == 0, "import os.path\nfrom json import loads\nfrom . import x").otherwise("import v from 'vue/dist'").alias("source"))
    return extract.imports_of(src).withColumn("imports", F.array_join("imports", ","))


def _facts(r: Rel) -> DataFrame:
    return extract.python_facts(dealt(r.py_files.select("path", "source")))


@query("x1_python_imports", "SELECT path, 'numpy,os' AS imports FROM py_a UNION ALL SELECT path, pack FROM py_b")
def _(r):
    return extract.python_imports(_facts(r)).withColumn("imports", F.array_join("imports", ","))


@query("x4_stdlib", "SELECT path, 'os' AS name, true AS std FROM py_a UNION ALL SELECT path, 'numpy', false FROM py_a UNION ALL SELECT path, pack, false FROM py_b")
def _(r):
    return extract.python_imports(_facts(r)).select("path", F.explode("imports").alias("name")).withColumn("std", extract.is_stdlib(F.col("name")))


_SYMBOLS = """syms AS (SELECT concat('class:', path, '#C', k) AS id, 'class' AS type, concat('file:', path) AS owner, path FROM py_a UNION ALL SELECT concat('func:', path, '#C', k, '.go'), 'method', concat('class:', path, '#C', k), path FROM py_a
    UNION ALL SELECT concat('func:', path, '#C', k, '.step'), 'method', concat('class:', path, '#C', k), path FROM py_a UNION ALL SELECT concat('func:', path, '#helper', k), 'function', concat('file:', path), path FROM py_a
    UNION ALL SELECT concat('class:', path, '#Tool', k), 'class', concat('file:', path), path FROM py_b UNION ALL SELECT concat('func:', path, '#Tool', k, '.use'), 'method', concat('class:', path, '#Tool', k), path FROM py_b
    UNION ALL SELECT concat('func:', path, '#make', k), 'function', concat('file:', path), path FROM py_b),
    sites AS (SELECT concat('func:', path, '#C', k, '.go') AS caller, 'self.step' AS called, concat('func:', path, '#C', k, '.step') AS callee, path FROM py_a UNION ALL SELECT concat('func:', path, '#C', k, '.step'), concat('helper', k), concat('func:', path, '#helper', k), path FROM py_a
    UNION ALL SELECT concat('func:', path, '#helper', k), 'la.norm', NULL, path FROM py_a UNION ALL SELECT concat('func:', path, '#Tool', k, '.use'), 'len', NULL, path FROM py_b
    UNION ALL SELECT concat('func:', path, '#make', k), concat('Tool', k), concat('class:', path, '#Tool', k), path FROM py_b UNION ALL SELECT concat('func:', path, '#make', k, '.inner'), concat('helper', j), CASE WHEN home IS NOT NULL THEN concat('func:', home, '#helper', j) END, path FROM py_b),
    touches AS (SELECT concat('func:', path, '#C', k, '.go') AS src_id, concat('state:', path, '#C', k, '.kind') AS dst_id, 'writes' AS type, 'self' AS resolution FROM py_a UNION ALL SELECT concat('func:', path, '#C', k, '.go'), concat('state:', path, '#C', k, '.step'), 'reads', 'self' FROM py_a
    UNION ALL SELECT concat('func:', path, '#Tool', k, '.use'), CASE WHEN home IS NOT NULL THEN concat('state:', home, '#C', j, '.kind') END, t, 'annotation' FROM py_b, (VALUES ('reads'), ('writes')) v(t)
    UNION ALL SELECT concat('func:', path, '#make', k), concat('state:', path, '#Tool', k, '.size'), 'writes', 'constructor' FROM py_b)"""


@query("x5_symbols", "SELECT id, type, path AS file, owner FROM syms", _SYMBOLS)
def _(r):
    f = _facts(r)
    return code.symbols(f).join(code.defines(f).select(F.col("dst_id").alias("id"), F.col("src_id").alias("owner")), "id").select("id", "type", "file", "owner")


@query("x6_call_sites", "SELECT path, caller, called FROM sites", _SYMBOLS)
def _(r):
    return extract.call_sites(_facts(r)).select("path", "caller", F.array_join("names", ".").alias("called"))


@query("x7_state_access", "SELECT src_id, dst_id, type, resolution FROM touches WHERE dst_id IS NOT NULL", _SYMBOLS)
def _(r):
    return code.state_edges(_facts(r))


@query("x8_type_env", "SELECT path, 'other' AS name, concat('C', j) AS type, 'annotation' AS how FROM py_b UNION ALL SELECT path, 't', concat('Tool', k), 'constructor' FROM py_b")
def _(r):
    return extract.type_env(_facts(r)).select("path", "name", "type", "how")


@query("x9_import_guard", "SELECT path, 'numpy.linalg' AS module FROM py_a UNION ALL SELECT path, concat(pack, '.m', j, m) FROM py_b, (VALUES (''), ('h'), ('c')) v(x), LATERAL (SELECT CASE x WHEN '' THEN '' WHEN 'h' THEN concat('.helper', j) ELSE concat('.C', j) END AS m) WHERE pack = 'p1'")
def _(r):
    return extract.forbidden_imports(_facts(r), ["numpy", "p1"])


@query("j3_call_resolution", "SELECT caller, callee FROM sites", _SYMBOLS)
def _(r):
    f = settle(_facts(r), "facts")  # several steps read them; a file is parsed once
    return code.resolved_calls(f, code.symbols(f), r.py_files).select("caller", "callee")


@query("j5_local_symbols", "SELECT f.path, n.name, CASE n.name WHEN concat('helper', f.k) THEN concat('func:', f.path, '#', n.name) WHEN concat('C', f.k) THEN concat('class:', f.path, '#', n.name) END AS id FROM py_a f, LATERAL (SELECT unnest([concat('helper', f.k), concat('C', f.k), 'nothing']) AS name) n")
def _(r):
    names = r.py_a.select("path", F.explode(F.array(F.concat(F.lit("helper"), "k"), F.concat(F.lit("C"), "k"), F.lit("nothing"))).alias("name"))
    return code.local_symbols(names, code.symbols(_facts(r)))


@query("j6_typed_access", "SELECT src_id, dst_id, type, resolution FROM touches WHERE resolution <> 'self'", _SYMBOLS)
def _(r):
    return code.typed_accesses(_facts(r)).select("src_id", "dst_id", "type", "resolution")


def _scan(r: Rel) -> DataFrame:
    return files.scanned(r.py_files.select("path", F.col("source").cast("binary").alias("content")))


@query("a1_scan_summary", "SELECT (SELECT count(*) FROM py_files) AS files, count(*) FILTER (type = 'function') AS functions, count(*) FILTER (type = 'method') AS methods, count(*) FILTER (type = 'class') AS classes, count(*) AS defines_edges, (SELECT count(home) FROM py_b) AS extends_edges, (SELECT count(callee) FROM sites) AS calls_edges, (SELECT count(*) - count(callee) FROM sites) AS unresolved_calls FROM syms", _SYMBOLS)
def _(r):
    return ingest.ingest_symbols(_scan(r))["result"]


@query("a2_resolution_stats", """SELECT (SELECT count(*) FROM py_files) AS files, (SELECT count(DISTINCT s) FROM (SELECT concat('state:', path, '#C', k, '.kind') AS s FROM py_a UNION SELECT dst_id FROM touches WHERE dst_id IS NOT NULL)) AS symbols, (SELECT count(*) FROM touches WHERE type = 'reads' AND dst_id IS NOT NULL) AS reads, (SELECT count(*) FROM touches WHERE type = 'writes' AND dst_id IS NOT NULL) AS writes,
    (SELECT count(*) FROM touches WHERE resolution <> 'self' AND dst_id IS NOT NULL) AS typed, 4 * a + 4 * b AS total, 2 * a AS resolved_self, 2 * b AS resolved_annotation, b AS resolved_constructor, 2 * a + b AS unresolved, round_even((2 * a + 3 * b) / (4 * a + 4 * b), 2) AS rate FROM (SELECT (SELECT count(*) FROM py_a) AS a, (SELECT count(*) FROM py_b) AS b)""", _SYMBOLS)
def _(r):
    return ingest.ingest_states(_scan(r))["result"]


@query("a3_scan_result", """SELECT (SELECT count(*) FROM py_files) AS files, (SELECT count(*) FROM py_files WHERE form = 9) AS modules, (SELECT count(pack_file) FROM py_b) AS internal, (SELECT count(DISTINCT n) FROM (SELECT 'numpy' AS n FROM py_a UNION SELECT pack FROM py_b WHERE pack_file IS NULL)) AS external, (SELECT count(*) FROM py_files WHERE form <> 2) AS parsed, (SELECT count(*) FROM py_files WHERE form = 2) AS reused,
    (SELECT count(*) FROM py_a) AS removed, (SELECT string_agg(concat(path, '=', n), ',' ORDER BY n DESC, path) FROM (SELECT concat('f', o_custkey % 50) AS path, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, path LIMIT 10)) AS hotspots""")
def _(r):
    scan = _scan(r)
    empty = F.array().cast("array<string>").alias("imports")
    old = scan.join(r.py_files.filter("form = 2").select("path"), "path", "left_semi").select("path", "hash", empty)
    gone = r.py_a.select(F.concat(F.lit("gone/"), "path").alias("path"), F.lit("h").alias("hash"), empty)
    churn = r.orders.groupBy(F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("path")).agg(F.count("*").alias("churn"))
    out = ingest.ingest_repository(scan, old.unionByName(gone), churn)["result"]
    return out.withColumn("hotspots", F.array_join(F.transform("hotspots", lambda h: F.concat_ws("=", h["path"], h["churn"].cast("string"))), ","))


@query("p1_repository_ingest", """SELECT concat('mod:', split_part(path, '/', 1)) AS src_id, concat('file:', path) AS dst_id, 'contains' AS type FROM py_files UNION ALL SELECT concat('file:', path), 'dep:numpy', 'depends_on' FROM py_a
    UNION ALL SELECT concat('file:', path), concat(CASE WHEN pack_file IS NULL THEN 'dep:' ELSE 'mod:' END, pack), 'depends_on' FROM py_b""")
def _(r):
    return ingest.ingest_repository(_scan(r))["edges"]


@query("p2_symbol_ingest", "SELECT owner AS src_id, id AS dst_id, 'defines' AS type FROM syms UNION ALL SELECT DISTINCT caller, callee, 'calls' FROM sites WHERE callee IS NOT NULL UNION ALL SELECT concat('class:', path, '#Tool', k), concat('class:', home, '#C', j), 'extends' FROM py_b WHERE home IS NOT NULL", _SYMBOLS)
def _(r):
    return ingest.ingest_symbols(_scan(r))["edges"].select("src_id", "dst_id", "type")


@query("p3_state_ingest", "SELECT DISTINCT s AS id, regexp_extract(s, '#(.*)$', 1) AS label, regexp_extract(s, '^state:(.*)#', 1) AS file FROM (SELECT concat('state:', path, '#C', k, '.kind') AS s FROM py_a UNION ALL SELECT dst_id FROM touches WHERE dst_id IS NOT NULL)", _SYMBOLS)
def _(r):
    return ingest.ingest_states(_scan(r))["nodes"].select("id", "label", "file")


@query("p14_sync", """SELECT concat('card:File:file:', f.path) AS card_id, coalesce(CASE f.form WHEN 0 THEN 'numpy' WHEN 1 THEN b.pack END, '') AS dependencies FROM py_files f LEFT JOIN py_b b ON b.k = f.k AND f.form = 1 UNION ALL SELECT concat('card:Module:mod:', split_part(path, '/', 1)), '' FROM py_files WHERE form = 9
    UNION ALL SELECT DISTINCT concat('card:Dependency:dep:', n), '' FROM (SELECT 'numpy' AS n FROM py_a UNION SELECT pack FROM py_b WHERE pack_file IS NULL)""")
def _(r):
    return ingest.sync(_scan(r))["cards"].select("card_id", "dependencies")


@query("p14_delta_sync", "SELECT owner AS src_id, id AS dst_id, 'defines' AS type FROM syms UNION ALL SELECT DISTINCT caller, callee, 'calls' FROM sites WHERE callee IS NOT NULL UNION ALL SELECT concat('class:', path, '#Tool', k), concat('class:', home, '#C', j), 'extends' FROM py_b WHERE home IS NOT NULL", _SYMBOLS)
def _(r):
    # The state of a time when every hundredth file was empty and some were missing is brought up to date.
    before = r.py_files.filter("k % 151 <> 5").select("path", F.when(F.col("k") % 100 == 0, "").otherwise(F.col("source")).cast("binary").alias("content"))
    store_, kept = _store(r), _store(r)
    sync.sync_into(store_, kept, files.scanned(before))
    sync.sync_into(store_, kept, _scan(r))
    return store_.scan("exec_edges").select("src_id", "dst_id", "type")


# ---- aggregation (A)


@query("a4_profile", "SELECT 'root' AS root, 'de,en,es,fr' AS languages, count(*) AS file_count, sha256(string_agg(concat('f', doc_id, ':', substr(sha256(text), 1, 8)), '' ORDER BY concat('f', doc_id))) AS index_hash FROM documents")
def _(r):
    return code.profile(r.documents.select(F.concat(F.lit("f"), "doc_id").alias("path"), F.substring(F.sha2("text", 256), 1, 8).alias("hash"), F.col("lang").alias("language")), "root")


@query("a5_module_hash", "SELECT e.src_id AS id, sha256(string_agg(concat(n.id, ':', n.hash), chr(10) ORDER BY n.id)) AS source_hash FROM kg_edges e JOIN kg_nodes n ON n.id = e.dst_id WHERE e.type = 'contains' GROUP BY e.src_id")
def _(r):
    return code.module_hashes(r.kg_edges, r.kg_nodes.filter("type = 'File'"))


def _events(r: Rel) -> DataFrame:
    return r.token_events.withColumn("tokens_saved", C.tokens_saved("tokens_raw_equiv", "tokens_actual", "tokens_estimated"))


@query("a6_token_report", """SELECT count(*) AS events, CAST(sum(tokens_estimated) AS BIGINT) AS tokens_estimated, CAST(sum(coalesce(tokens_actual, 0)) AS BIGINT) AS tokens_actual, CAST(sum(tokens_raw_equiv) AS BIGINT) AS tokens_raw_equiv, CAST(sum(s) AS BIGINT) AS tokens_saved, CAST(sum(tokens_raw_equiv) - sum(s) AS BIGINT) AS tokens_compressed, round_even((sum(tokens_raw_equiv) - sum(s)) / sum(tokens_raw_equiv), 4) AS ratio,
    (SELECT string_agg(concat(provider, '=', t), ',' ORDER BY provider) FROM (SELECT provider, CAST(sum(s) AS BIGINT) AS t FROM e GROUP BY provider)) AS saved_by_provider FROM e""", "e AS (SELECT *, greatest(0, tokens_raw_equiv - coalesce(tokens_actual, tokens_estimated)) AS s FROM token_events)")
def _(r):
    return ledger.token_report(_events(r))


_COST = "round_even(tokens_in / 1000000.0 * CASE WHEN provider = 'claude' AND model = 'claude-opus-4-8' THEN 15.0 WHEN provider = 'claude' THEN 3.0 ELSE 0.0 END + tokens_out / 1000000.0 * CASE WHEN provider = 'claude' AND model = 'claude-opus-4-8' THEN 75.0 WHEN provider = 'claude' THEN 15.0 ELSE 0.0 END, 6)"
_STATS = f"""stats AS (SELECT provider, model, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round_even(sum({_COST}), 6) AS est_cost, sum(latency_ms) AS sum_latency_ms, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS errors FROM call_log GROUP BY provider, model),
    samples AS (SELECT provider, model, list_sort(list(latency_ms)) AS s FROM (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY seq DESC) AS back FROM call_log) WHERE back <= 200 GROUP BY provider, model),
    score AS (SELECT t.provider, t.model, t.calls, t.est_cost, round_even(t.sum_latency_ms / t.calls, 3) AS avg_latency_ms, p.s[CAST(least(len(p.s) - 1, round_even(0.95 * (len(p.s) - 1), 0)) AS BIGINT) + 1] AS p95_latency_ms, round_even(t.successes / t.calls, 4) AS success_rate FROM stats t JOIN samples p ON p.provider = t.provider AND p.model = t.model),
    roll AS (SELECT provider, round_even(sum(est_cost) / sum(calls), 6) AS cost_per_call, round_even(sum(avg_latency_ms * calls) / sum(calls), 3) AS avg_latency_ms, round_even(sum(success_rate * calls) / sum(calls), 4) AS success_rate FROM score GROUP BY provider)"""


_A7 = "SELECT t.provider, t.model, t.calls, t.tokens_in, t.tokens_out, t.est_cost, t.sum_latency_ms, t.successes, t.errors, len(s.s) AS n_samples, coalesce((SELECT string_agg(concat(e, ':', n), ',' ORDER BY e) FROM (SELECT error AS e, count(*) AS n FROM call_log c WHERE c.provider = t.provider AND c.model = t.model AND NOT ok GROUP BY error)), '') AS errors_by FROM stats t JOIN samples s ON s.provider = t.provider AND s.model = t.model"


def _stats_row(out: DataFrame) -> DataFrame:
    by = F.array_join(F.transform(F.map_entries("error_breakdown"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("provider", "model", "calls", "tokens_in", "tokens_out", "est_cost", "sum_latency_ms", "successes", "errors", F.size("latency_samples").alias("n_samples"), by.alias("errors_by"))


@query("a7_provider_stats", _A7, _STATS)
def _(r):
    return _stats_row(ledger.provider_stats(r.call_log))


@query("a7_stream", _A7, _STATS)
def _(r):
    # The log arrives in six files; the stream ends after three of them and starts again.
    home = f"{work_dir(r.spark)}/calls-{uuid.uuid4().hex}"
    log, kept = r.call_log.withColumn("file", F.col("seq") % 6), store.Store(r.spark, f"{home}/store")
    for half in (0, 1):
        for n in range(3 * half, 3 * half + 3):
            log.filter(F.col("file") == n).drop("file").write.mode("append").parquet(f"{home}/log")
        rows = r.spark.readStream.schema(r.call_log.schema).option("maxFilesPerTrigger", 8).parquet(f"{home}/log")
        calls.call_stream(rows, kept, f"{home}/checkpoint").awaitTermination()
    return _stats_row(calls.stats_of(kept.scan(calls.NAME)))


@query("a8_scorecards", "SELECT * FROM score", _STATS)
def _(r):
    return ledger.scorecards(ledger.provider_stats(r.call_log))


@query("a9_nearest_rank", "SELECT o_custkey, s[CAST(least(len(s) - 1, round_even(0.5 * (len(s) - 1), 0)) AS BIGINT) + 1] AS p50 FROM (SELECT o_custkey, list_sort(list(o_totalprice)) AS s FROM orders GROUP BY o_custkey)")
def _(r):
    return r.orders.groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("s")).select("o_custkey", ledger.nearest_rank(F.col("s"), 0.5).alias("p50"))


@query("a10_provider_rollup", "SELECT * FROM roll", _STATS)
def _(r):
    return ledger.provider_rollup(ledger.scorecards(ledger.provider_stats(r.call_log)))


@query("a11_observed_owner", "SELECT id, observed_owner, observed_conf, caller_domains FROM obs WHERE k = 1", _RULED)
def _(r):
    return ownership.observed(r.exec_edges, ownership.axes(r.exec_nodes, _rules(r)))


@query("w1_best_rule", "SELECT id, domain, layer, criticality, impact, CAST(domain_tier AS BIGINT) AS domain_tier FROM axes", _RULED)
def _(r):
    return ownership.axes(r.exec_nodes, _rules(r))


@query("a17_ownership", "SELECT * FROM classed", _RULED)
def _(r):
    return ownership.classify(r.exec_nodes, r.exec_edges, _rules(r))


@query("a18_runtime_summary", """SELECT c.*, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT concat(e.src_id, '=', coalesce(a.domain, 'Unknown')) AS x FROM exec_edges e LEFT JOIN axes a ON a.id = e.src_id WHERE e.dst_id = c.symbol AND e.confidence IN ('resolved', 'exact'))), '') AS consumers,
    coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT concat(e.dst_id, '=', coalesce(a.domain, 'Unknown')) AS x FROM exec_edges e LEFT JOIN axes a ON a.id = e.dst_id WHERE e.src_id = c.symbol AND e.confidence IN ('resolved', 'exact'))), '') AS dependencies FROM classed c WHERE c.symbol IN ('func:p1', 'func:o2', 'func:s1')""", _RULED)
def _(r):
    return ownership.runtime_summary(r.exec_nodes, r.exec_edges, _rules(r), r.ids("func:p1", "func:o2", "func:s1"))


@query("a12_duplicate_groups", "SELECT scope, sha256(concat(scope, '|', kind, '|', content)) AS hash, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM memory WHERE status = 'active' AND scope IN ('project', 'user') GROUP BY scope, kind, content HAVING count(*) > 1")
def _(r):
    return ledger.duplicate_groups(r.memory)


@query("a13_status_counts", "SELECT 'nodes' AS name, count(*) AS records FROM kg_nodes UNION ALL SELECT 'edges', count(*) FROM kg_edges UNION ALL SELECT 'memory', count(*) FROM memory UNION ALL SELECT 'proposals', count(*) FROM proposals")
def _(r):
    return ledger.status_counts({"nodes": r.kg_nodes, "edges": r.kg_edges, "memory": r.memory, "proposals": r.proposals})


@query("a14_merge_findings", "SELECT agent, claim, severity, confidence, CAST(CASE severity WHEN 'high' THEN 0 WHEN 'med' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY agent, claim ORDER BY arrival) AS k FROM findings) WHERE k = 1")
def _(r):
    return ledger.merge_findings(r.findings)


@query("a15_run_report", "SELECT count(*) FILTER (ok) AS succeeded, coalesce(string_agg(agent, ',' ORDER BY agent) FILTER (NOT ok), '') AS failed FROM (SELECT agent, max(confidence) < 0.985 AS ok FROM findings GROUP BY agent)")
def _(r):
    return ledger.run_report(r.findings.groupBy("agent").agg((F.max("confidence") < 0.985).alias("ok")))


_GC = f"""gc AS (SELECT *, CASE WHEN status <> 'active' THEN 'keep' WHEN coalesce({_IDLE} > {_TTL} * 1000000, false) THEN CASE scope WHEN 'session' THEN 'delete' ELSE 'archive' END WHEN pow(0.5, greatest(0.0, {_IDLE} / 86400000000.0) / 14.0) <> salience THEN 'decay' ELSE 'keep' END AS action FROM memory),
    later AS (SELECT id, scope, kind, content, access_count, CASE action WHEN 'archive' THEN 'archived' ELSE status END AS status FROM gc WHERE action <> 'delete')"""


@query("p8_memory_gc", f"SELECT id, action, CASE action WHEN 'archive' THEN 'archived' ELSE status END AS status, round(CASE action WHEN 'decay' THEN pow(0.5, greatest(0.0, {_IDLE} / 86400000000.0) / 14.0) ELSE salience END, 9) AS salience FROM gc", _GC)
def _(r):
    return memory.gc_actions(r.memory, _now()).select("id", "action", "status", F.round("salience", 9).alias("salience"))


@query("p8_promotions", "SELECT concat('prop_', substr(sha256(concat('memory.promotion|', id)), 1, 26)) AS id, id AS subject, concat('accessed ', access_count, 'x in session') AS evidence, CASE WHEN access_count >= 5 THEN 'high' ELSE 'medium' END AS reuse_value FROM later WHERE scope = 'session' AND status = 'active' AND access_count >= 3", _GC)
def _(r):
    return memory.promotions(memory.after_gc(memory.gc_actions(r.memory, _now()))).select("id", "subject", "evidence", "reuse_value")


@query("p8_consolidations", "SELECT string_agg(id, ',' ORDER BY id) AS subject, concat(count(*), ' duplicate records in ', scope) AS evidence FROM later WHERE status = 'active' AND scope IN ('project', 'user') GROUP BY scope, kind, content HAVING count(*) > 1", _GC)
def _(r):
    return memory.consolidations(memory.after_gc(memory.gc_actions(r.memory, _now()))).select("subject", "evidence")


@query("a16_gc_report", "SELECT count(*) FILTER (action = 'delete') AS n_expired, count(*) FILTER (action = 'archive') AS n_archived, count(*) FILTER (action = 'decay') AS decayed, (SELECT count(*) FROM later WHERE scope = 'session' AND status = 'active' AND access_count >= 3) AS promotions, (SELECT count(*) FROM (SELECT 1 FROM later WHERE status = 'active' AND scope IN ('project', 'user') GROUP BY scope, kind, content HAVING count(*) > 1)) AS consolidations FROM gc", _GC)
def _(r):
    actions = memory.gc_actions(r.memory, _now())
    return memory.gc_report(actions, memory.after_gc(actions))


@query("a16_gc_ids", "SELECT action, id FROM gc WHERE action IN ('delete', 'archive')", _GC)
def _(r):
    return memory.gc_ids(memory.gc_actions(r.memory, _now()))


# ---- ranking and packing (W, O, P5-P7)


@query("w2_hotspots", "SELECT concat('c', o_custkey) AS path, count(*) AS churn FROM orders GROUP BY 1 ORDER BY churn DESC, path LIMIT 10")
def _(r):
    return code.hotspots(r.orders.groupBy(F.concat(F.lit("c"), "o_custkey").alias("path")).agg(F.count("*").alias("churn")))


@query("w3_recent", "SELECT id FROM kg_nodes WHERE type = 'Decision' AND created_at % 5 > 0 ORDER BY created_at DESC, id LIMIT 5")
def _(r):
    return context.recent(r.kg_nodes, "Decision", r.kg_nodes.filter("created_at % 5 = 0").select("id")).select("id")


@query("w4_top_memories", "SELECT id FROM memory WHERE status = 'active' AND scope IN ('project', 'user') ORDER BY salience DESC, created_at DESC, CASE scope WHEN 'project' THEN 0 ELSE 1 END, id LIMIT 5")
def _(r):
    return context.top_memories(r.memory, r.ids()).select("id")


@query("w5_last_samples", "SELECT provider, model, seq FROM (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY seq DESC) AS k FROM call_log) WHERE k <= 200")
def _(r):
    return ledger.last_samples(r.call_log).select("provider", "model", "seq")


_PACK = """ranked AS (SELECT bundle, ref, kind, tokens, raw_tokens, CASE kind WHEN 'card' THEN 0 WHEN 'criteria' THEN 1 WHEN 'decision' THEN 2 WHEN 'finding' THEN 3 WHEN 'adr' THEN 4 WHEN 'evidence' THEN 5 WHEN 'repo_profile' THEN 6 WHEN 'memory' THEN 7 WHEN 'source' THEN 8 ELSE 9 END AS tier, row_number() OVER (PARTITION BY bundle ORDER BY CASE kind WHEN 'card' THEN 0 WHEN 'criteria' THEN 1 WHEN 'decision' THEN 2 WHEN 'finding' THEN 3 WHEN 'adr' THEN 4 WHEN 'evidence' THEN 5 WHEN 'repo_profile' THEN 6 WHEN 'memory' THEN 7 WHEN 'source' THEN 8 ELSE 9 END, place, ref) - 1 AS seq FROM items),
    fold(bundle, seq, used, included) AS (SELECT bundle, -1, CAST(0 AS BIGINT), false FROM (SELECT DISTINCT bundle FROM ranked) UNION ALL SELECT r.bundle, r.seq, f.used + CASE WHEN f.used + r.tokens <= 4000 THEN r.tokens ELSE 0 END, f.used + r.tokens <= 4000 FROM fold f JOIN ranked r ON r.bundle = f.bundle AND r.seq = f.seq + 1),
    manifest AS (SELECT r.bundle, r.seq, r.ref, r.kind, CAST(r.tier AS BIGINT) AS tier, r.tokens, r.raw_tokens, f.included, f.used FROM ranked r JOIN fold f ON f.bundle = r.bundle AND f.seq = r.seq)"""


def _items(r: Rel) -> DataFrame:
    return r.items.withColumn("tier", C.tier_of("kind")).withColumnRenamed("place", "order")


@query("w6_greedy_packing", "SELECT bundle, seq, ref, kind, tier, tokens, included, used FROM manifest", _PACK)
def _(r):
    return context.packed(_items(r), 4000).drop("raw_equiv")


@query("w6_bundle_totals", "SELECT bundle, CAST(sum(CASE WHEN included THEN tokens ELSE 0 END) AS BIGINT) AS used, CAST(sum(raw_tokens) AS BIGINT) AS raw_equiv, count(*) FILTER (NOT included) AS dropped, CAST(greatest(0, sum(raw_tokens) - sum(CASE WHEN included THEN tokens ELSE 0 END)) AS BIGINT) AS saved FROM manifest GROUP BY bundle", _PACK)
def _(r):
    return context.bundle_totals(context.packed(_items(r), 4000))


@query("c17_render", "SELECT m.bundle, concat('## Grounding', chr(10), string_agg(concat('- [', m.kind, '] ', i.content), chr(10) ORDER BY m.seq)) AS text FROM manifest m JOIN items i ON i.bundle = m.bundle AND i.ref = m.ref WHERE m.included GROUP BY m.bundle", _PACK)
def _(r):
    return context.rendered(context.packed(_items(r), 4000), r.items)


@query("w7_gather_order", "SELECT bundle, ref, row_number() OVER (PARTITION BY bundle ORDER BY CASE WHEN doc % 2 = 0 THEN 0 ELSE 1 END, doc) - 1 AS \"order\" FROM (SELECT bundle, ref, place AS doc FROM items)")
def _(r):
    i = r.items.select("bundle", "ref", "place")
    return context.gathered([i.filter("place % 2 = 0"), i.filter("place % 2 = 1")])


@query("w8_router", "SELECT provider AS name, row_number() OVER (ORDER BY avg_latency_ms, provider) AS rank, avg_latency_ms AS metric, 'lowest avg latency' AS reason, 'fastest' AS policy FROM roll", _STATS)
def _(r):
    roll = ledger.provider_rollup(ledger.scorecards(ledger.provider_stats(r.call_log)))
    return ledger.route(roll.select(F.col("provider").alias("name")), roll, "fastest", "claude")


@query("w8_router_reliable", "SELECT provider AS name, row_number() OVER (ORDER BY success_rate DESC, provider DESC) AS rank, success_rate AS metric, 'highest success rate' AS reason, 'most_reliable' AS policy FROM roll", _STATS)
def _(r):
    roll = ledger.provider_rollup(ledger.scorecards(ledger.provider_stats(r.call_log)))
    return ledger.route(roll.select(F.col("provider").alias("name")), roll, "most_reliable", "claude")


_BEST = """best AS (SELECT n.id AS ref, CASE WHEN c.ref IS NOT NULL THEN 'card' WHEN s.id IS NOT NULL THEN 'memory' ELSE 'stub' END AS kind, coalesce(c.purpose, s.content, n.label) AS content, n.size FROM kg_nodes n LEFT JOIN cards c ON c.ref = n.id AND c.source_hash = n.hash LEFT JOIN subject s ON s.id = n.id WHERE n.type = 'File')"""


@query("w9_card_escalation", "SELECT ref, kind, content, CAST((length(content) + 3) // 4 AS BIGINT) AS tokens, CASE kind WHEN 'card' THEN greatest((length(content) + 3) // 4, (size + 3) // 4) ELSE (length(content) + 3) // 4 END AS raw_tokens FROM best", f"{_CARDS}, {_SUBJECT}, {_BEST}")
def _(r):
    subjects = r.kg_nodes.filter("type = 'File'").select(F.lit("b").alias("bundle"), "id", F.lit(0).alias("place"))
    return context.subject_items(subjects, r.kg_nodes, _cards(r), _linked_memory(r)).select("ref", "kind", "content", "tokens", "raw_tokens")


@query("p5_context_build", """SELECT bundle, seq, ref, kind, tokens, included FROM (SELECT t.bundle, t.seq, t.ref, t.kind, t.tokens, f.included FROM cand t JOIN cfold f ON f.bundle = t.bundle AND f.seq = t.seq)""",
    f"{_CARDS}, " + bfs_sql(_KG_OUT, "SELECT 'mod:n1' AS id", 1) + """, reached AS (SELECT 'mod:n1' AS bundle, 'mod:n1' AS id, 0 AS depth, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT seed, id, depth, parent FROM found),
    cand AS (SELECT r.bundle, r.id AS ref, CASE WHEN c.ref IS NULL THEN 'stub' ELSE 'card' END AS kind, (length(coalesce(c.purpose, n.label)) + 3) // 4 AS tokens, row_number() OVER (PARTITION BY r.bundle ORDER BY CASE WHEN c.ref IS NULL THEN 9 ELSE 0 END, r.depth, r.parent, r.id) - 1 AS seq FROM reached r JOIN kg_nodes n ON n.id = r.id LEFT JOIN cards c ON c.ref = r.id),
    cfold(bundle, seq, used, included) AS (SELECT bundle, -1, CAST(0 AS BIGINT), false FROM (SELECT DISTINCT bundle FROM cand) UNION ALL SELECT r.bundle, r.seq, f.used + CASE WHEN f.used + r.tokens <= 60 THEN r.tokens ELSE 0 END, f.used + r.tokens <= 60 FROM cfold f JOIN cand r ON r.bundle = f.bundle AND r.seq = f.seq + 1)""")
def _(r):
    return context.build(r.kg_nodes, r.kg_edges, _cards(r), r.ids("mod:n1"), 1, 60).select("bundle", "seq", "ref", "kind", "tokens", "included")


_AROUND = "SELECT src_id AS src, dst_id AS dst FROM live UNION SELECT dst_id, src_id FROM live"
_TIER = "CASE kind WHEN 'card' THEN 0 WHEN 'criteria' THEN 1 WHEN 'decision' THEN 2 WHEN 'finding' THEN 3 WHEN 'adr' THEN 4 WHEN 'evidence' THEN 5 WHEN 'repo_profile' THEN 6 WHEN 'memory' THEN 7 WHEN 'source' THEN 8 ELSE 9 END"


def _request_sql(seeds: str, parts: list[str], budget: int) -> str:
    """CTEs up to manifest for an advisory request: what lies around the seeds, the parts in their order, and the greedy packing of all."""
    items = " UNION ALL ".join(f"SELECT {k} AS source, bundle, ref, kind, content, tokens, raw_tokens, place FROM ({p})" for k, p in enumerate(parts))
    return f"""{_CARDS}, {_SUBJECT}, live AS (SELECT e.src_id, e.dst_id FROM kg_edges e JOIN kg_nodes s ON s.id = e.src_id JOIN kg_nodes d ON d.id = e.dst_id WHERE e.type <> 'depends_on'), {bfs_sql(_AROUND, seeds, 1)},
    around AS (SELECT f.seed AS bundle, f.id, n.type, row_number() OVER (PARTITION BY f.seed ORDER BY f.depth, f.parent, f.id) AS place FROM found f JOIN kg_nodes n ON n.id = f.id),
    subjects AS (SELECT s.id AS bundle, s.id, 0 AS place FROM start s JOIN kg_nodes n ON n.id = s.id WHERE n.type IN ('File', 'Module') UNION ALL SELECT bundle, id, place FROM around WHERE type IN ('File', 'Module')),
    chosen AS (SELECT b.bundle, b.id AS ref, CASE WHEN c.ref IS NOT NULL THEN 'card' WHEN s.id IS NOT NULL THEN 'memory' ELSE 'stub' END AS kind, coalesce(c.purpose, s.content, n.label) AS content, n.size, s.memory, b.place FROM subjects b JOIN kg_nodes n ON n.id = b.id LEFT JOIN cards c ON c.ref = n.id AND (n.type <> 'File' OR c.source_hash = n.hash) LEFT JOIN subject s ON s.id = n.id),
    newer AS (SELECT bundle, id, place FROM around WHERE type = 'Decision' UNION ALL SELECT bundle, id, k + 1000000000 FROM (SELECT s.id AS bundle, n.id, row_number() OVER (PARTITION BY s.id ORDER BY n.created_at DESC, n.id) AS k FROM start s, kg_nodes n WHERE n.type = 'Decision' AND NOT EXISTS (SELECT 1 FROM around a WHERE a.bundle = s.id AND a.id = n.id)) WHERE k <= 5),
    listed AS ({items}), given AS (SELECT *, {_TIER} AS tier, row_number() OVER (PARTITION BY bundle ORDER BY source, place) - 1 AS nth FROM listed),
    lined AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY tier, nth, ref, kind, tokens, raw_tokens) - 1 AS seq FROM given),
    walked(bundle, seq, used, included) AS (SELECT bundle, -1, CAST(0 AS BIGINT), false FROM (SELECT DISTINCT bundle FROM lined) UNION ALL SELECT l.bundle, l.seq, w.used + CASE WHEN w.used + l.tokens <= {budget} THEN l.tokens ELSE 0 END, w.used + l.tokens <= {budget} FROM walked w JOIN lined l ON l.bundle = w.bundle AND l.seq = w.seq + 1)"""


_SUBJECT_PART = "SELECT bundle, ref, kind, content, (length(content) + 3) // 4 AS tokens, CASE kind WHEN 'card' THEN greatest((length(content) + 3) // 4, (coalesce(size, 0) + 3) // 4) ELSE (length(content) + 3) // 4 END AS raw_tokens, place FROM chosen"
_DECISION_PART = "SELECT w.bundle, w.id AS ref, 'decision' AS kind, n.label AS content, (length(n.label) + 3) // 4 AS tokens, (length(n.label) + 3) // 4 AS raw_tokens, w.place FROM newer w JOIN kg_nodes n ON n.id = w.id"
_MEMORY_PART = """SELECT bundle, id AS ref, 'memory' AS kind, content, (length(content) + 3) // 4 AS tokens, (length(content) + 3) // 4 AS raw_tokens, k AS place FROM (SELECT s.id AS bundle, m.id, m.content, row_number() OVER (PARTITION BY s.id ORDER BY m.salience DESC, m.created_at DESC, CASE m.scope WHEN 'project' THEN 0 ELSE 1 END, m.id) AS k
    FROM start s, memory m WHERE m.status = 'active' AND m.scope IN ('project', 'user') AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.bundle = s.id AND c.kind = 'memory' AND c.memory = m.id)) WHERE k <= 5"""
_TEXT_PART = "SELECT id AS bundle, '{}' AS ref, '{}' AS kind, '{}' AS content, {} AS tokens, {} AS raw_tokens, 0 AS place FROM start"
_MANIFEST = "SELECT l.bundle, l.seq, l.ref, l.kind, CAST(l.tier AS BIGINT) AS tier, l.tokens, w.included, w.used FROM lined l JOIN walked w ON w.bundle = l.bundle AND w.seq = l.seq"


@query("p6_mentor_context", _MANIFEST, _request_sql("SELECT 'file:c1' AS id UNION ALL SELECT 'file:c2'", [_SUBJECT_PART, _DECISION_PART, _MEMORY_PART], 400))
def _(r):
    items = context.mentor_items(r.kg_nodes, r.kg_edges.filter("type <> 'depends_on'"), _cards(r), _linked_memory(r), r.ids("file:c1", "file:c2"), 1)
    return context.packed(items, 400).drop("raw_equiv")


@query("p7_auditor_context", _MANIFEST, _request_sql("SELECT 'file:c4' AS id", [_TEXT_PART.format("acceptance-criteria", "criteria", "must be fast", 3, 3), _TEXT_PART.format("available-evidence", "evidence", "a log", 2, 2), f"{_SUBJECT_PART} WHERE kind = 'card'", _DECISION_PART], 400))
def _(r):
    items = context.auditor_items(r.kg_nodes, r.kg_edges.filter("type <> 'depends_on'"), _cards(r), _linked_memory(r), r.ids("file:c4"), "must be fast", "a log", 1)
    return context.packed(items, 400).drop("raw_equiv")


@query("p4_cards", """SELECT concat('card:', n.type, ':', n.id) AS card_id, CASE n.type WHEN 'File' THEN n.hash WHEN 'Module' THEN coalesce(m.h, '') ELSE '' END AS source_hash, CASE n.type WHEN 'File' THEN concat(n.label, ': python file (', n.size, ' bytes).') WHEN 'Module' THEN concat('Module ''', n.label, ''' containing ', coalesce(m.k, 0), ' file(s).') ELSE concat(n.type, ' ''', n.label, '''.') END AS purpose
    FROM kg_nodes n LEFT JOIN (SELECT e.src_id AS id, count(*) AS k, sha256(string_agg(concat(c.id, ':', c.hash), chr(10) ORDER BY c.id)) AS h FROM kg_edges e JOIN kg_nodes c ON c.id = e.dst_id WHERE e.type = 'contains' GROUP BY e.src_id) m ON m.id = n.id""")
def _(r):
    known = r.kg_nodes.filter("type = 'File'").select(F.substring("id", 6, 100).alias("path"), F.lit("python").alias("language"), "size", "hash")
    return ingest.cards(r.kg_nodes.select("id", "type", "label"), r.kg_edges, known).select("card_id", "source_hash", "purpose")


@query("o3_ordered_distinct", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def _(r):
    return records.first_of_each(r.orders, ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("o2_limit", "SELECT id FROM exec_nodes ORDER BY id LIMIT 50")
def _(r):
    return r.exec_nodes.orderBy("id").limit(50).select("id")


@query("o1_total_order", "SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, id) AS rank FROM kg_nodes")
def _(r):
    return records.ranked(r.kg_nodes, ["type"], [F.desc("created_at"), F.col("id")]).select("type", "id", "rank")


@query("o4_union", "SELECT DISTINCT dst_id AS state, src_id AS func FROM df_edges")
def _(r):
    return records.united([graph.accessors(r.df_edges, "reads"), graph.accessors(r.df_edges, "writes"), graph.accessors(r.df_edges, "reads")])


@query("o5_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def _(r):
    return r.orders.filter("o_orderstatus = 'O'").select("o_custkey").subtract(r.orders.filter("o_orderstatus = 'F' and o_orderkey % 3 = 0").select("o_custkey"))


@query("o6_edge_insert", """SELECT src_id, dst_id, type, '' AS reason FROM kg_edges WHERE type = 'relates_to' UNION SELECT e.src_id, e.dst_id, e.type, CASE WHEN s.id IS NULL THEN 'missing source' WHEN d.id IS NULL THEN 'missing target' WHEN CASE e.type WHEN 'contains' THEN s.type = 'Module' AND d.type = 'File' WHEN 'decided_by' THEN s.type IN ('File', 'Module') AND d.type = 'Decision'
    WHEN 'summarized_by' THEN d.type = 'KnowledgeCard' ELSE true END THEN '' ELSE 'forbidden types' END FROM odd_edges e LEFT JOIN kg_nodes s ON s.id = e.src_id LEFT JOIN kg_nodes d ON d.id = e.dst_id""")
def _(r):
    after, refused = records.inserted_edges(r.kg_edges.filter("type = 'relates_to'"), r.odd_edges, r.kg_nodes)
    return after.withColumn("reason", F.lit("")).unionByName(refused)


@query("o6_idempotent_edges", "SELECT concat('o', l_orderkey) AS src_id, concat('s', l_suppkey) AS dst_id, l_returnflag AS type, min(l_linenumber)::BIGINT AS created_at FROM lineitem GROUP BY 1, 2, 3")
def _(r):
    e = r.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("src_id"), F.concat(F.lit("s"), "l_suppkey").alias("dst_id"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("created_at"), F.col("l_linenumber").alias("id"))
    return records.merged_edges(e).drop("id")


@query("o7_upsert_nodes", "SELECT coalesce(b.id, a.id) AS id, coalesce(b.label, a.label) AS label, coalesce(a.created_at, b.created_at) AS created_at FROM (SELECT * FROM kg_nodes WHERE type = 'File' AND size % 2 = 0) a FULL JOIN (SELECT id, upper(label) AS label, created_at + 1 AS created_at FROM kg_nodes WHERE type = 'File' AND size % 3 = 0) b ON a.id = b.id")
def _(r):
    f = r.kg_nodes.filter("type = 'File'").withColumn("props", F.lit("{}"))
    new = f.filter("size % 3 = 0").select("id", "type", F.upper("label").alias("label"), "props", (F.col("created_at") + 1).alias("created_at"))
    return records.upsert_nodes(f.filter("size % 2 = 0"), new).select("id", "label", "created_at")


# ---- scalars (C)


@query("c1_token_estimate", "SELECT doc_id, (length(text) + 3) // 4 AS tokens FROM documents")
def _(r):
    return r.documents.select("doc_id", C.token_estimate("text").alias("tokens"))


@query("c2_message_tokens", "SELECT conv_id, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def _(r):
    return r.conversations.groupBy("conv_id").agg(F.sum(C.token_estimate("text")).alias("tokens"))


@query("c3_raw_tokens", "SELECT id, CASE type WHEN 'File' THEN greatest(10, (size + 3) // 4) ELSE 10 END AS raw FROM kg_nodes")
def _(r):
    return r.kg_nodes.select("id", C.raw_tokens("type", "size", F.lit(10).cast("long")).alias("raw"))


@query("c4_content_hash", "SELECT id, sha256(concat(scope, '|', kind, '|', content)) AS hash FROM memory")
def _(r):
    return r.memory.select("id", C.content_hash("scope", "kind", "content").alias("hash"))


@query("c5_salience", f"SELECT id, round(pow(0.5, greatest(0.0, {_IDLE} / 86400000000.0) / 14.0), 9) AS salience FROM memory")
def _(r):
    return r.memory.select("id", F.round(C.salience("last_accessed_at", _now()), 9).alias("salience"))


@query("c6_effective_ttl", f"SELECT id, {_TTL} AS ttl FROM memory")
def _(r):
    return r.memory.select("id", C.effective_ttl("ttl_seconds", "scope").alias("ttl"))


@query("c7_cost", f"SELECT seq, {_COST} AS cost FROM call_log")
def _(r):
    return r.call_log.select("seq", C.call_cost("provider", "model", "tokens_in", "tokens_out").alias("cost"))


@query("c8_tokens_saved", "SELECT provider, CAST(sum(greatest(0, tokens_raw_equiv - coalesce(tokens_actual, tokens_estimated))) AS BIGINT) AS saved FROM token_events GROUP BY provider")
def _(r):
    return _events(r).groupBy("provider").agg(F.sum("tokens_saved").alias("saved"))


@query("c9_tier", "SELECT DISTINCT kind, CAST(CASE kind WHEN 'card' THEN 0 WHEN 'criteria' THEN 1 WHEN 'decision' THEN 2 WHEN 'finding' THEN 3 WHEN 'adr' THEN 4 WHEN 'evidence' THEN 5 WHEN 'repo_profile' THEN 6 WHEN 'memory' THEN 7 WHEN 'source' THEN 8 ELSE 9 END AS BIGINT) AS tier FROM items")
def _(r):
    return r.items.select("kind", C.tier_of("kind").alias("tier")).distinct()


@query("c10_severity", "SELECT DISTINCT severity, CAST(CASE severity WHEN 'high' THEN 0 WHEN 'med' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS BIGINT) AS rank FROM findings")
def _(r):
    return r.findings.select("severity", C.severity_rank("severity").alias("rank")).distinct()


@query("c11_glob", "SELECT file FROM exec_nodes WHERE regexp_matches(file, '^app/n./.*[.]py$') GROUP BY file")
def _(r):
    return r.exec_nodes.filter(F.col("file").rlike(C.glob_to_regex("app/n?/*.py"))).select("file").distinct()


@query("c12_regex", "SELECT id FROM exec_nodes WHERE regexp_matches(label, 'Brand#[13]')")
def _(r):
    return r.exec_nodes.filter(F.col("label").rlike("Brand#[13]")).select("id")


@query("c13_surrogate_id", "SELECT concat('node_', substr(sha256(concat(c_custkey, '|', c_name)), 1, 26)) AS id FROM customer")
def _(r):
    return r.customer.select(C.surrogate_id("node", F.col("c_custkey").cast("string"), "c_name").alias("id"))


@query("c13_ulid", """SELECT o_orderkey, string_agg(substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(CASE WHEN i < 10 THEN ms >> (5 * (9 - i)) WHEN i < 18 THEN a >> (5 * (17 - i)) ELSE b >> (5 * (25 - i)) END & 31 AS INTEGER) + 1, 1), '' ORDER BY i) AS id
    FROM (SELECT o_orderkey, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ms, CAST(concat('0x', substr(sha256(concat(o_orderkey, '')), 1, 10)) AS BIGINT) AS a, CAST(concat('0x', substr(sha256(concat(o_orderkey, '')), 11, 10)) AS BIGINT) AS b FROM orders), (SELECT unnest(range(26)) AS i) GROUP BY o_orderkey""")
def _(r):
    return r.orders.select("o_orderkey", C.ulid(F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey").cast("string")).alias("id"))


@query("c19_settings", """SELECT o_orderkey, CASE k WHEN 0 THEN 'boolean' WHEN 1 THEN 'null' WHEN 2 THEN 'integer' ELSE 'text' END AS kind, CASE k WHEN 0 THEN 'true' WHEN 2 THEN concat(CASE WHEN o_orderkey > 0 THEN '-' ELSE '' END, o_orderkey) WHEN 3 THEN o_orderpriority WHEN 4 THEN concat(o_orderkey, '.5') END AS value FROM (SELECT *, o_orderkey % 5 AS k FROM orders)""")
def _(r):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, " TRUE ").when(k == 1, "None").when(k == 2, F.concat(F.lit(" -0"), "o_orderkey")).when(k == 3, F.col("o_orderpriority")).otherwise(F.concat("o_orderkey", F.lit(".5")))
    return r.orders.select("o_orderkey", C.setting(raw).alias("x")).select("o_orderkey", "x.*")


@query("c14_purpose_text", "SELECT id, CASE type WHEN 'File' THEN concat(label, ': unknown file (', size, ' bytes).') WHEN 'Module' THEN concat('Module ''', label, ''' containing 2 file(s).') ELSE concat(type, ' ''', label, '''.') END AS purpose FROM kg_nodes")
def _(r):
    return r.kg_nodes.select("id", C.purpose_text(F.col("type"), F.col("label"), F.lit(None).cast("string"), F.col("size"), F.lit(2)).alias("purpose"))


@query("c15_hotspot_texts", "SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN concat('c', o_custkey, ' changes frequently (hotspot)') END AS risk, CASE WHEN o_custkey % 2 = 0 THEN concat(n, ' recent commits') END AS change FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def _(r):
    n = r.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("churn", F.when(F.col("o_custkey") % 2 == 0, F.col("n")).otherwise(0))
    return n.select("o_custkey", C.risk_text(F.concat(F.lit("c"), "o_custkey"), F.col("churn")).alias("risk"), C.change_text(F.col("churn")).alias("change"))


@query("c16_summary_texts", "SELECT concat('repo ', source, ': ', count(*), ' files, ', count(DISTINCT lang), ' modules; languages: ', string_agg(DISTINCT lang, ',' ORDER BY lang)) AS text FROM documents GROUP BY source")
def _(r):
    return r.documents.groupBy("source").agg(F.count("*").alias("f"), F.count_distinct("lang").alias("m"), F.sort_array(F.collect_set("lang")).alias("l")).select(C.profile_text(F.col("source"), F.col("f"), F.col("m"), F.col("l")).alias("text"))


@query("c18_source_head", "SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN concat('p', doc_id) ELSE substr(text, 1, 8000) END) AS digest FROM documents")
def _(r):
    body = F.when(F.col("doc_id") % 9 != 0, F.col("text"))
    return r.documents.select("doc_id", F.sha2(C.source_head(body, F.concat(F.lit("p"), "doc_id")), 256).alias("digest"))


@query("c20_markdown", "SELECT agent, concat('# ', agent, chr(10), chr(10), '## Claims', chr(10), string_agg(concat('- ', claim), chr(10) ORDER BY claim)) AS text FROM (SELECT DISTINCT agent, claim FROM findings) GROUP BY agent")
def _(r):
    return r.findings.groupBy("agent").agg(F.sort_array(F.collect_set("claim")).alias("c")).select("agent", C.markdown(F.col("agent"), {"Claims": F.col("c")}).alias("text"))


@query("c21_safe_name", "SELECT * FROM (VALUES ('snapshots/nodes.yaml', true), ('snapshots/a/b', false), ('snapshots/../x', false), ('snapshots/..x', false), ('manifest.json', false)) t(name, safe)")
def _(r):
    return r.ids("snapshots/nodes.yaml", "snapshots/a/b", "snapshots/../x", "snapshots/..x", "manifest.json", name="name").select("name", C.safe_member(F.col("name")).alias("safe"))


# ---- plans (P)


@query("p9_memory_add", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY scope, kind, content ORDER BY created_at, id) AS k FROM memory n WHERE ends_with(id, '3') AND NOT EXISTS (SELECT 1 FROM memory m WHERE NOT ends_with(m.id, '3') AND m.status = 'active' AND m.scope = n.scope AND m.kind = n.kind AND m.content = n.content)) WHERE k = 1")
def _(r):
    return memory.added(r.memory.filter("id not like '%3'"), r.memory.filter("id like '%3'")).select("id")


@query("p9_memory_touch", "SELECT id, access_count + CASE WHEN ends_with(id, '7') THEN 1 ELSE 0 END AS access_count, CASE WHEN ends_with(id, '7') THEN 1.0 ELSE salience END AS salience FROM memory")
def _(r):
    return memory.touched(r.memory, r.memory.filter("id like '%7'").select("id"), _now()).select("id", "access_count", "salience")


def _empty():
    return F.array().cast("array<struct<action: string, actor: string, note: string, from_status: string, to_status: string, at: string>>")


@query("p10_learning", """SELECT p.id, CASE WHEN t.target IS NOT NULL THEN t.target ELSE p.status END AS status, CASE WHEN t.target IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n_provenance, CASE WHEN a.id IS NOT NULL AND t.target IS NULL THEN concat('cannot ', a.action, ' a proposal in status ', p.status) END AS error FROM proposals p LEFT JOIN actions a ON a.id = p.id
    LEFT JOIN (VALUES ('approve', 'proposed', 'approved'), ('reject', 'proposed', 'rejected'), ('reject', 'approved', 'rejected'), ('commit', 'approved', 'committed')) t(action, from_status, target) ON t.action = a.action AND t.from_status = p.status""")
def _(r):
    out = memory.decided(r.proposals.withColumn("provenance", _empty()), r.actions)
    return out.select("id", "status", F.size("provenance").alias("n_provenance"), "error")


@query("p10_skills", """SELECT concat('skill_', substr(sha256(p.id), 1, 26)) AS id, 'Skill' AS type, concat(p.kind, CAST(CAST(substr(p.id, 5) AS BIGINT) % 5 AS VARCHAR)) AS label FROM proposals p JOIN actions a ON a.id = p.id WHERE p.status = 'approved' AND a.action = 'commit'""")
def _(r):
    return memory.skills(memory.decided(r.proposals.withColumn("provenance", _empty()), r.actions)).select("id", "type", "label")


@query("p10_several_actions", "SELECT id, CASE status WHEN 'proposed' THEN 'committed' WHEN 'approved' THEN 'committed' ELSE status END AS status, CASE status WHEN 'proposed' THEN 2 WHEN 'approved' THEN 1 ELSE 0 END::BIGINT AS steps, CASE status WHEN 'proposed' THEN NULL WHEN 'approved' THEN 'cannot approve a proposal in status approved' ELSE concat('cannot commit a proposal in status ', status) END AS error FROM proposals")
def _(r):
    both = [r.proposals.select("id", F.lit(a).alias("action"), F.lit("u").alias("actor"), F.lit(None).cast("string").alias("note"), F.lit(at).alias("at")) for a, at in (("commit", "2"), ("approve", "1"))]
    return memory.decided(r.proposals.withColumn("provenance", _empty()), both[0].unionByName(both[1])).select("id", "status", F.size("provenance").alias("steps"), "error")


@query("p10_unknown", "SELECT id, action, concat('unknown proposal ', id) AS error FROM actions WHERE CAST(substr(id, 5) AS BIGINT) % 7 > 0")
def _(r):
    return memory.refused(r.proposals.filter("cast(substr(id, 5) as bigint) % 7 = 0"), r.actions)


@query("p11_proposal_emit", "SELECT concat('prop_', substr(sha256(concat(lang, '|', doc_id)), 1, 26)) AS id, lang AS kind, 'proposed' AS status FROM documents")
def _(r):
    return memory.proposed(r.documents.select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("kind"), F.lit("{}").alias("payload"))).select("id", "kind", "status")


@query("p12_metering", f"SELECT provider, model, tokens_in + tokens_out AS tokens_actual, {_COST} AS cost FROM call_log WHERE ok")
def _(r):
    return ingest.metered(r.call_log)


@query("p13_parse_findings", "SELECT concat('a', doc_id) AS agent, CAST(0 AS BIGINT) AS arrival, lang AS claim, 'high' AS severity, CAST(0.5 AS DOUBLE) AS confidence FROM documents WHERE doc_id % 3 > 0")
def _(r):
    body = F.concat(F.lit('[{"claim": "'), "lang", F.lit('", "severity": "high", "confidence": 0.5}]'))
    return ingest.parsed_findings(r.documents.select(F.concat(F.lit("a"), "doc_id").alias("agent"), F.when(F.col("doc_id") % 3 == 0, "no json").otherwise(body).alias("text")))


_RUNS = """calls AS (SELECT user_id AS task, event_type AS agent, value * 1000 AS latency, CASE WHEN event_id % 7 = 0 THEN 'lost' END AS lost, event_id % 5 = 0 AS garbled, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events),
    judged AS (SELECT *, CASE WHEN latency IS NULL OR latency > 30000 THEN 'timeout' WHEN lost IS NOT NULL OR garbled THEN 'error' ELSE 'ok' END AS state, CASE WHEN latency IS NULL OR latency > 30000 THEN 'provider call timed out' ELSE coalesce(lost, 'answer is no list of findings') END AS why FROM calls WHERE attempt <= 2),
    ended AS (SELECT *, row_number() OVER (PARTITION BY task, agent ORDER BY CASE WHEN state = 'ok' THEN attempt ELSE 10 - attempt END) AS place FROM judged)"""


@query("p13_run_outcomes", "SELECT task, agent, state AS status, CASE WHEN state <> 'ok' THEN why END AS error, CAST(attempt AS BIGINT) AS attempts, CASE WHEN state = 'ok' THEN event_id END AS tokens_in, CASE WHEN state = 'ok' THEN concat('claim ', event_id) END AS claim FROM ended WHERE place = 1", _RUNS)
def _(r):
    answer = F.when(F.col("event_id") % 5 == 0, '{"claim": "no list"}').otherwise(F.format_string('[{"claim": "claim %d"}]', "event_id"))
    log = r.events.select(F.col("user_id").alias("task"), F.col("event_type").alias("agent"), "ts", "event_id", (F.col("value") * 1000).alias("latency_ms"), F.when(F.col("event_id") % 7 == 0, "lost").alias("error"), answer.alias("text"), F.col("event_id").alias("tokens_in"), F.lit(1).alias("tokens_out"))
    ends = ingest.run_outcomes(log, ["task", "agent"], ["ts", "event_id"])
    return ends.select("task", "agent", "status", "error", F.col("attempts").cast("long"), "tokens_in", F.from_json("text", ingest.FINDINGS)[0]["claim"].alias("claim"))


@query("p15_session_attach", "SELECT concat('s', o_custkey) AS id, max(CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE o_orderpriority END) AS request FROM orders GROUP BY o_custkey")
def _(r):
    sessions = r.orders.groupBy(F.concat(F.lit("s"), "o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("request"))
    updates = r.orders.select(F.concat(F.lit("s"), "o_custkey").alias("id"), F.when(F.col("o_custkey") % 2 == 0, "new").alias("request")).distinct()
    return ingest.attached(sessions, updates)


@query("p16_advice_edges", "SELECT DISTINCT 'rec1' AS src_id, id AS dst_id, CASE type WHEN 'Decision' THEN 'informs' ELSE 'advises' END AS type FROM kg_nodes WHERE id IN ('file:c1', 'dec:o3')")
def _(r):
    targets = literal_table(r.spark, [("rec1", "file:c1"), ("rec1", "dec:o3"), ("rec1", "none")], "id string, target string")
    return ingest.advice_edges(r.ids("rec1"), targets, r.kg_nodes)


@query("p17_diagnosis", "SELECT count(*) AS checks, bool_and(ok) AS ok, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok), '') AS failed FROM (SELECT provider || '/' || model AS name, count(*) FILTER (NOT ok) < count(*) / 9 AS ok FROM call_log GROUP BY 1)")
def _(r):
    c = r.call_log.groupBy(F.concat_ws("/", "provider", "model").alias("name")).agg((F.count_if(~F.col("ok")) < F.count("*") / 9).alias("ok"))
    return ingest.diagnosis(c)
