"""Schemas of the tables that come and go as files."""

from __future__ import annotations

FILE_CHANGE = "struct<path:string,additions:int,deletions:int>"
COMMIT = f"struct<sha:string,author_date:string,author_name:string,author_email:string,message:string,files_changed:array<{FILE_CHANGE}>>"
MANIFEST = f"ingest_schema_version int, repo_slug string, repo_url string, default_branch string, head_commit string, generated_at string, files array<string>, files_with_hashes array<struct<path:string,content_hash:string,size_bytes:bigint>>, commit_log array<{COMMIT}>"
CONVERSATION = "messages array<struct<role:string,content:string>>"
SWEEP = "budget string, depth int, params double, tokens double, val_bpb double, ratio double"
# The star schema of the synchronised tables.
STAR = {
    "tenants": "tenant_id string, created_at timestamp",
    "repos": "repo_id string, tenant_id string, repo_fingerprint string, canonical_repo_ref_hash string",
    "repo_versions": "version_id string, repo_id string, version_key string, head_commit string, structure_json string, schema_version int, first_seen_at timestamp, last_seen_at timestamp",
    "version_hotspots": "version_id string, file_hash string, touch_count int, last_touched string",
    "version_files": "version_id string, file_path_hash string, content_hash string",
    "sync_runs": "run_id string, tenant_id string, user_id string, version_id string, status string, created_at timestamp",
}
