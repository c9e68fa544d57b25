"""Record schemas and the fixed values of the data model."""

from __future__ import annotations

SCHEMA_VERSION = 1

#: DDL of every collection.
COLLECTIONS: dict[str, str] = {
    "nodes": "id STRING, type STRING, label STRING, props STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "edges": "id STRING, src_id STRING, dst_id STRING, type STRING, props STRING, created_at TIMESTAMP",
    "memory": "id STRING, scope STRING, kind STRING, content STRING, source STRUCT<type: STRING, ref: STRING>, created_at TIMESTAMP, updated_at TIMESTAMP, last_accessed_at TIMESTAMP, access_count BIGINT, salience DOUBLE, ttl_seconds BIGINT, status STRING, links ARRAY<STRING>",
    "cards": "schema_version INT, card_id STRING, target STRUCT<type: STRING, ref: STRING>, generated_at STRING, source_hash STRING, provider STRUCT<name: STRING, model: STRING>, purpose STRING, modules ARRAY<STRUCT<name: STRING, role: STRING>>, dependencies ARRAY<STRUCT<name: STRING, kind: STRING, why: STRING>>, key_decisions ARRAY<STRUCT<summary: STRING, decision_node_id: STRING>>, risks ARRAY<STRUCT<description: STRING, severity: STRING>>, recent_changes ARRAY<STRUCT<summary: STRING, ref: STRING>>, extensions STRING",
    "token_events": "id STRING, request_id STRING, scope_ref STRING, provider STRING, model STRING, tokens_estimated BIGINT, tokens_actual BIGINT, tokens_raw_equiv BIGINT, tokens_saved BIGINT, created_at TIMESTAMP",
    "provider_stats": "id STRING, provider STRING, model STRING, calls BIGINT, tokens_in BIGINT, tokens_out BIGINT, est_cost DOUBLE, sum_latency_ms DOUBLE, successes BIGINT, errors BIGINT, error_breakdown MAP<STRING, BIGINT>, latency_samples ARRAY<DOUBLE>, last_seen_at STRING, capabilities STRING",
    "proposals": "id STRING, kind STRING, payload STRING, evidence ARRAY<STRING>, benefits STRING, risks STRING, reuse_value STRING, token_savings_est BIGINT, status STRING, provenance ARRAY<STRUCT<action: STRING, actor: STRING, note: STRING, from_status: STRING, to_status: STRING, at: STRING>>, skill_id STRING, created_at TIMESTAMP, resolved_at TIMESTAMP",
    "repo_index": "path STRING, hash STRING, language STRING, size BIGINT, raw_imports ARRAY<STRING>",
    "repo_profile": "root STRING, languages ARRAY<STRING>, file_count BIGINT, module_count BIGINT, hotspots ARRAY<STRUCT<path: STRING, churn: BIGINT>>, scanned_at STRING, index_hash STRING",
    "advisory_sessions": "id STRING, request STRING, recommendation_id STRING, decision_id STRING, implementation_refs ARRAY<STRING>, finding_id STRING, created_at STRING, updated_at STRING",
    "exec_nodes": "id STRING, type STRING, label STRING, file STRING, lineno INT, props STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "exec_edges": "id STRING, src_id STRING, dst_id STRING, type STRING, confidence STRING, props STRING, created_at TIMESTAMP",
    "df_nodes": "id STRING, kind STRING, label STRING, file STRING, created_at TIMESTAMP",
    "df_edges": "id STRING, src_id STRING, dst_id STRING, type STRING, resolution STRING, created_at TIMESTAMP",
}

# Node types that each edge type may connect (None: any).
EDGE_RULES: dict[str, tuple[tuple[str, ...] | None, tuple[str, ...] | None]] = {
    "contains": (("Module",), ("File",)),
    "depends_on": (("Module", "File"), ("Module", "Dependency")),
    "decided_by": (("File", "Module"), ("Decision",)),
    "affects": (("Decision",), ("File", "Module")),
    "supersedes": (("Decision",), ("Decision",)),
    "summarized_by": (None, ("KnowledgeCard",)),
    "uses_skill": (("Agent", "Project"), ("Skill",)),
    "derived_from": (("MemoryRef",), None),
    "relates_to": (None, None),
    "advises": (("MentorRecommendation",), ("File", "Module", "Project", "Decision")),
    "informs": (("MentorRecommendation",), ("Decision",)),
    "audits": (("AuditFinding",), ("File", "Module", "Project", "Decision")),
}
# Ranks, tiers and rates.
CONFIDENCE_RANK = {"unresolved": 0, "heuristic": 1, "resolved": 2, "exact": 3}
SEVERITY_RANK = {"high": 0, "med": 1, "low": 2}
TIERS = {"card": 0, "criteria": 1, "decision": 2, "finding": 3, "adr": 4, "evidence": 5, "repo_profile": 6, "memory": 7, "source": 8, "stub": 9}
LAST_TIER = 9
#: (provider, model or *) to dollars per million tokens in and out.
PRICING = {("claude", "claude-opus-4-8"): (15.0, 75.0), ("claude", "*"): (3.0, 15.0), ("ollama", "*"): (0.0, 0.0)}
# Languages by extension, and folders that a scan leaves out.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
IGNORED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".skeinwork", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox")
# Fixed values: (action, from, to) of a proposal.
TRANSITIONS = (("approve", "proposed", "approved"), ("reject", "proposed", "rejected"), ("reject", "approved", "rejected"), ("commit", "approved", "committed"))
# Layer hints by folder, after the project's own rules.
DEFAULT_OWNERSHIP = (("path", "*/routes/*", "Route"), ("path", "*/models/*", "Model"), ("path", "*/db/*", "Storage"), ("path", "*/services/*", "Service"))

SESSION_TTL, HALF_LIFE_DAYS, PROMOTE_AT, PROMOTE_HIGH = 86_400, 14.0, 3, 5
TOKEN_BUDGET, SOURCE_CHARS, NOTE_CHARS, RECENT, SAMPLES, HOTSPOTS = 8000, 8000, 600, 5, 200, 10
